"""Cleaning all files of a dataset folder, with a log of what happened to each."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.functions.text import DATE_FORMATS, NA_TOKENS
from pricelens.operators.clean import PROVENANCE, basic_clean
from pricelens.sources import export
from pricelens.sources.files import inventory, is_selected, write_inventory
from pricelens.sources.raw_csv import (
    RawFiles,
    escape_glob,
    every_file,
    named_columns,
    scan_files,
    source_file,
    store_cells,
)

LOG_SCHEMA = (
    "source_file STRING, table_type_guess STRING, raw_rows BIGINT, cleaned_rows BIGINT, "
    "sample_file STRING, saved_mode STRING"
)
NAMES_SCHEMA = "source_file STRING, output_name STRING"
TOO_MANY_CELLS = "error: a row has more cells than the header"
NO_TEXT = "error: the file has no header"


@dataclass(frozen=True)
class _Rules:
    """How texts are read: what names a date column, date formats, cells that mean missing."""

    match: str
    formats: tuple[str, ...]
    na_tokens: tuple[str, ...]


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _status(raw: RawFiles, cells: DataFrame) -> DataFrame:
    """Per input file with any text: header, raw_rows and whether it is broken.

    Broken are files with a line of too many cells to parse, which were not opened, and files with a cell beyond their
    header. One aggregate over the parsed rows of all files; a file that fails costs the others nothing.
    """
    files = raw.files.groupBy(PROVENANCE).agg(
        F.min("header").alias("header"), F.max("too_wide").alias("too_wide")
    )
    counts = cells.groupBy(PROVENANCE).agg(F.count("*").alias("raw_rows"), F.max("extra").alias("extra"))
    return files.join(counts, PROVENANCE, "left").select(
        PROVENANCE,
        "header",
        F.coalesce("raw_rows", F.lit(0)).alias("raw_rows"),
        (F.col("too_wide") | F.coalesce("extra", F.lit(False))).alias("broken"),
    )


def _cleaned(raw: RawFiles, cells: DataFrame, status: DataFrame, folder: str, rules: _Rules) -> list[tuple[str, DataFrame]]:
    """Kind and stored rows of each header's readable files."""
    broken = status.filter("broken").select(PROVENANCE)
    if not broken.isEmpty():
        cells = cells.join(broken, PROVENANCE, "left_anti")
    found = []
    for number, (header, names) in enumerate(raw.names.items()):
        rows = cells.filter(F.col("header") == header)
        rows = rows.select(PROVENANCE, *named_columns(names, rules.na_tokens))
        rows, kind = basic_clean(rows, rules.match, rules.formats)
        found.append((kind, _stored(rows, f"{folder}/rows_{number}")))
    return found


def _log_rows(inputs: DataFrame, status: DataFrame, kinds: DataFrame, stats: DataFrame, names: DataFrame) -> DataFrame:
    """A row per input file: what became of it, or why nothing did."""
    error = F.when(F.col("header").isNull(), NO_TEXT).when(F.col("broken"), TOO_MANY_CELLS)
    log = (
        inputs.join(status, PROVENANCE, "left")
        .join(kinds, "header", "left")
        .join(stats, PROVENANCE, "left")
        .join(names, PROVENANCE)
        .withColumn("error", error)
    )
    good = F.col("error").isNull()
    return log.select(
        PROVENANCE,
        F.when(good, F.col("kind")).otherwise("ERROR").alias("table_type_guess"),
        F.when(good, F.col("raw_rows")).alias("raw_rows"),
        F.when(good, F.coalesce("cleaned_rows", F.lit(0))).alias("cleaned_rows"),
        F.when(good, F.concat("output_name", F.lit("__sample.csv"))).alias("sample_file"),
        F.coalesce("error", "saved_mode", F.lit("full")).alias("saved_mode"),
    )


def clean_dataset(
    spark: SparkSession,
    dataset: str,
    root: str,
    out: str,
    match: str = "token",
    formats=DATE_FORMATS,
    na_tokens=NA_TOKENS,
    files=None,
) -> DataFrame:
    """Clean all selected CSV files below `root` into `out`; returns the log.

    A run writes into a folder of its own below `out`, and names it in the manifest when it is done: `inventory`,
    `samples`, `cleaned` (a folder per input file), `log` and `tables` lie in `export.finished(spark, out)`. A run that
    was stopped is repeated by calling this again; what it left behind is not read by anyone.

    All files are parsed by one job and counted by another, whatever their headers; the rows of each header are then
    cleaned and exported. A file that cannot be read gets an ERROR row in the log and the others go on. `formats` and
    `na_tokens` replace the date formats and the cells that mean missing; `files`, paths relative to `root`, replaces
    the selection by size and name. Input files of one name get outputs of their own (`export.output_names`); the log
    names each file's sample.
    """
    run = export.new_attempt(out)
    tables = f"{run}/tables"
    listing = inventory(spark, root)
    write_inventory(listing, f"{run}/inventory")
    rules = _Rules(match, tuple(formats), tuple(na_tokens))
    folder = root.rstrip("/")
    if files is None:
        chosen = functools.partial(is_selected, dataset=dataset)
        selected = listing.filter(chosen(F.col("relative_path")))
        paths = [folder]
    else:
        chosen = every_file
        wanted = spark.createDataFrame([(f,) for f in files], "relative_path STRING")
        selected = listing.join(wanted, "relative_path", "left_semi")
        paths = [escape_glob(f"{folder}/{f}") for f in files]
    inputs = selected.select(source_file("relative_path").alias(PROVENANCE)).distinct()
    export.output_names(inputs).write.parquet(f"{tables}/names")
    names = spark.read.schema(NAMES_SCHEMA).parquet(f"{tables}/names")
    inputs = names.select(PROVENANCE)
    raw = scan_files(spark, paths, tables, root, chosen) if paths else None
    if raw is None or not raw.names:
        log = inputs.selectExpr(
            PROVENANCE, "'ERROR'", "CAST(NULL AS BIGINT)", "CAST(NULL AS BIGINT)", "CAST(NULL AS STRING)", f"'{NO_TEXT}'"
        )
    else:
        cells = store_cells(spark, raw, f"{tables}/cells")
        status = _stored(_status(raw, cells), f"{tables}/status")
        cleaned = _cleaned(raw, cells, status, tables, rules)
        # Stored, so that Spark knows their size and broadcasts them or not by that.
        stats = _stored(export.file_stats([rows for _, rows in cleaned]), f"{tables}/stats")
        chunked = {r["table"] for r in stats.filter("saved_mode = 'chunked'").select("table").distinct().collect()}
        for number, (_, rows) in enumerate(cleaned):
            export.write_sample(rows, f"{run}/samples", names=names)
            own = stats.filter(F.col("table") == number)
            export.write_full_or_chunked(rows, f"{run}/cleaned", own, names=names, some_chunked=number in chunked)
        kinds = [(header, kind) for header, (kind, _) in zip(raw.names, cleaned)]
        kinds = spark.createDataFrame(kinds, "header BIGINT, kind STRING")
        log = _log_rows(inputs, status, kinds, stats, names)
    log.toDF(*[c.split()[0] for c in LOG_SCHEMA.split(", ")]).write.csv(f"{run}/log", header=True)
    export.finish(spark, out, run)
    return spark.read.schema(LOG_SCHEMA).csv(f"{run}/log", header=True)
