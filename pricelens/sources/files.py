"""Listings of dataset folders."""

from __future__ import annotations

import posixpath
import re
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Only files of this dataset are picked by a word in their path.
MARKET_DATASET = "01_stock_market_data"
MARKET_WORD = "sp500"


_FILE_SYSTEM = "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def _folder(root: str) -> str:
    return posixpath.normpath(urlsplit(root).path).rstrip("/")


def root_length(path: str, root: str) -> int:
    """How many characters of a full file path lie before its part below `root`."""
    system = re.match(_FILE_SYSTEM, path)
    start = system.end() if system else 0
    folder = _folder(root)
    if folder.startswith("/") or not folder:
        return start + len(folder) + 1
    return path.index(f"/{folder}/", start) + len(folder) + 2


def below(path, root: str) -> Column:
    """The part of a full file path below `root`, which may or may not name its file system."""
    folder = _folder(root)
    local = F.regexp_replace(path, _FILE_SYSTEM, "")
    if folder.startswith("/") or not folder:
        return F.substring(local, len(folder) + 2, 1 << 30)
    marker = f"/{folder}/"
    return F.substring(local, F.instr(local, marker) + len(marker), F.lit(1 << 30))


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """relative_path and size_mb of every file below `root`, by path.

    Only the listing is read, never the content. As everywhere in Spark, names that start with
    `_` or `.` do not count as data.
    """
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path", "length")
    )
    return listing.select(
        below("path", root).alias("relative_path"),
        F.bround(F.col("length") / (1024 * 1024), 2).alias("size_mb"),
    ).orderBy("relative_path")


def write_inventory(listing: DataFrame, path: str) -> None:
    listing.write.csv(path, header=True)


def is_selected(path: Column, dataset: str) -> Column:
    """Whether a file of a dataset is cleaned: CSV files, of the market dataset only those of the S&P 500."""
    chosen = path.endswith(".csv")
    if dataset == MARKET_DATASET:
        # Asked of every row of a scan: a path that has the word as it is need not be lower-cased, which costs more.
        chosen = chosen & (path.contains(MARKET_WORD) | F.lower(path).contains(MARKET_WORD))
    return chosen


def select_files(listing: DataFrame, dataset: str) -> DataFrame:
    """The files of a listing that `is_selected` takes, by path."""
    return listing.filter(is_selected(F.col("relative_path"), dataset)).orderBy("relative_path")
