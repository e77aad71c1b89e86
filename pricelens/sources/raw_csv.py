"""Reading CSV files whose headers differ, all of them in one scan.

A first pass over the lines as text finds each file's header, which is kept as a hash, so the aggregate runs on numbers
and each task sends one small row per file. The texts of the different headers come from one file each. Then one CSV
read takes all files by position, as wide as the widest header, and a join by file says which position has which name.
Files with a quoted cell that runs over a line end are left to a second branch of that read. The number of jobs is the
same for any number of files and headers; of the files only the odd ones are known to the driver by name.
"""

from __future__ import annotations

import csv
import re
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelens.functions.scratch import scratch
from pricelens.functions.text import NA_TOKENS, null_if_in
from pricelens.operators.clean import PROVENANCE
from pricelens.sources.files import below

CLEANED_PATTERN = "*__cleaned.csv"

# Cells of a line that are parsed; a file with more commas in a line is not parsed at all.
MAX_CELLS = 200_000

# Rows of one stored file of cells: cells can be stored so tightly that a task's rows would be too few bytes to be split
# among the tasks that read them.
CELL_ROWS = 500_000

_FILES = "path STRING, source_file STRING, header BIGINT, multi_line BOOLEAN, too_wide BOOLEAN"


@dataclass(frozen=True)
class RawFiles:
    """What the first pass found.

    `files`, a stored table, has path, source_file (below the root), header (a hash), multi_line (a quoted cell runs over
    a line end) and too_wide for each chosen file with any text. `names` are each header's columns, in the order of the headers' first files.
    `multi_line` and `too_wide` are the paths of the odd files.
    """

    paths: tuple[str, ...]
    chosen: Callable[[Column], Column]
    files: DataFrame
    names: dict[int, tuple[str, ...]]
    multi_line: tuple[str, ...]
    too_wide: tuple[str, ...]


def escape_glob(path: str) -> str:
    return re.sub(r"([{}\[\]*?\\])", r"\\\1", path)


def decoded(path) -> Column:
    """A metadata path without URL escapes."""
    plus_kept = F.replace(path, F.lit("+"), F.lit("%2B"))
    return F.when(path.contains("%"), F.url_decode(plus_kept)).otherwise(path)


def source_file(inner) -> Column:
    """The input file of a path below the root; a CSV folder written by Spark counts as one file."""
    column = F.col(inner) if isinstance(inner, str) else inner
    part = F.regexp_replace(column, r"(\.csv)/part-[^/]*$", "$1")
    return F.when(column.contains(".csv/part-"), part).otherwise(column)


def _reader(spark: SparkSession):
    return spark.read.option("recursiveFileLookup", "true")


def every_file(path: Column) -> Column:
    return F.lit(True)


def scan_files(
    spark: SparkSession, paths, folder: str, root: str, chosen: Callable[[Column], Column] = every_file
) -> RawFiles:
    """The pass over the lines of the files at `paths` whose path below `root` meets `chosen`.

    The rule is first put to the full path, which must then meet it as well: Spark drops files by that when it lists
    them. Writes the table `files` into `folder`. The driver gets one path per header and those of odd files.
    """
    value = F.col("value")
    quotes = F.length(value) - F.length(F.replace(value, F.lit('"')))
    commas = F.length(value) - F.length(F.replace(value, F.lit(",")))
    # Most lines have no quote and are short, so nothing is replaced in them.
    open_quote = value.contains('"') & (quotes % 2 == 1)
    too_wide = (F.octet_length(value) >= MAX_CELLS) & (commas >= MAX_CELLS)
    lines = _reader(spark).text(list(paths)).filter(chosen(F.col("_metadata.file_path"))).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        F.xxhash64(value).alias("hash"),
        (F.trim(value) != "").alias("text"),
        open_quote.alias("open_quote"),
        too_wide.alias("too_wide"),
    )
    candidate = F.when((F.col("block") == 0) & F.col("text"), F.col("line"))
    (
        lines.groupBy("path")
        .agg(
            F.min_by("hash", candidate).alias("header"),
            F.max("open_quote").alias("multi_line"),
            F.max("too_wide").alias("too_wide"),
        )
        .filter("header is not null")
        .withColumn("inner", below(decoded(F.col("path")), root))
        .filter(chosen(F.col("inner")))
        .select("path", source_file("inner").alias(PROVENANCE), "header", "multi_line", "too_wide")
        .write.parquet(f"{folder}/files")
    )
    files = spark.read.schema(_FILES).parquet(f"{folder}/files")
    first = files.groupBy("header").agg(F.min("path").alias("path")).withColumn("plain", decoded(F.col("path")))
    examples = sorted(first.collect(), key=lambda r: r["path"])
    odd = files.filter("multi_line or too_wide").select("path", "too_wide").collect()
    return RawFiles(
        tuple(paths),
        chosen,
        files,
        _names(spark, examples),
        tuple(r["path"] for r in odd if not r["too_wide"]),
        tuple(r["path"] for r in odd if r["too_wide"]),
    )


def _names(spark: SparkSession, examples) -> dict[int, tuple[str, ...]]:
    """The columns of each header, whose text is looked for in its example file by the hash."""
    if not examples:
        return {}
    own = F.xxhash64("value")
    lines = spark.read.text([escape_glob(r["plain"]) for r in examples]).select(own.alias("header"), "value")
    found = lines.filter(F.col("header").isin([r["header"] for r in examples])).distinct().collect()
    text = {r["header"]: r["value"] for r in found}
    return {r["header"]: header_names(text[r["header"]]) for r in examples}


def header_names(line: str) -> tuple[str, ...]:
    """Column names of a header line; a blank name becomes `Unnamed: <position>`."""
    cells = next(csv.reader([line.removeprefix("\ufeff")]))
    names, taken = [], defaultdict(int)
    for i, cell in enumerate(cells):
        name = cell if cell.strip() else f"Unnamed: {i}"
        taken[name.lower()] += 1
        again = taken[name.lower()]
        names.append(name if again == 1 else f"{name}.{again - 1}")
    return tuple(names)


def _by_header(raw: RawFiles, value: Callable[[tuple[str, ...]], Column]) -> Column:
    """A value that depends on the row's header alone."""
    entries = [x for header, names in raw.names.items() for x in (F.lit(header), value(names))]
    return F.element_at(F.create_map(*entries), F.col("header"))


def read_cells(spark: SparkSession, raw: RawFiles) -> DataFrame:
    """All rows of the files as `source_file`, `header`, the cells c0, c1, ... as text, and `extra`: whether a cell
    beyond the file's header is not empty. Files that are too wide are left out, before they are opened."""
    width = max(map(len, raw.names.values()))
    cells = [f"c{i}" for i in range(width + 1)]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in cells])
    path = F.col("_metadata.file_path")

    def read(multi_line: bool, of) -> DataFrame:
        rows = (
            _reader(spark)
            .schema(schema)
            .options(header=True, enforceSchema=True, quote='"', escape='"')
            .options(multiLine=multi_line, maxColumns=MAX_CELLS)
            .csv(list(raw.paths))
            .filter(raw.chosen(path))
        )
        return (rows if of is None else rows.filter(of)).select(path.alias("path"), *cells)

    odd = [*raw.multi_line, *raw.too_wide]
    rows = read(False, ~path.isin(odd) if odd else None)
    if raw.multi_line:
        rows = rows.union(read(True, path.isin(list(raw.multi_line))))
    # Spark broadcasts the table by its stored size, or shuffles and splits large files.
    rows = rows.join(raw.files.select("path", PROVENANCE, "header"), "path")
    filled = F.coalesce(*(F.when(F.col(f"c{i}").isNotNull(), i + 1) for i in reversed(range(width + 1))), F.lit(0))
    extra = filled > _by_header(raw, lambda names: F.lit(len(names)))
    return rows.select(PROVENANCE, "header", *cells[:-1], extra.alias("extra"))


def named_columns(names: tuple[str, ...], na_tokens=NA_TOKENS) -> list[Column]:
    """The cells of one header's rows under its names."""
    return [null_if_in(f"c{i}", na_tokens).alias(n) for i, n in enumerate(names)]


def _places(spark: SparkSession, root: str, files, pattern: str | None) -> list[str]:
    folder = root.rstrip("/")
    if files is not None:
        return [escape_glob(f"{folder}/{f}") for f in files]
    return [f"{folder}/{pattern}" if pattern else folder]


def read_raw_groups(
    spark: SparkSession, root: str, files=None, pattern: str | None = None, na_tokens=NA_TOKENS
) -> list[DataFrame]:
    """CSV files as one frame of text columns per header.

    All files below `root`, or `files` (paths relative to it), or those matching `pattern`. The files are parsed once,
    into a table of cells in a folder of the run; each frame reads its header's part.
    """
    paths = _places(spark, root, files, pattern)
    if not paths:
        return []
    folder = scratch(spark)
    raw = scan_files(spark, paths, folder, root)
    if not raw.names:
        return []
    rows = store_cells(spark, raw, f"{folder}/cells")
    return [
        rows.filter(F.col("header") == header).select(PROVENANCE, *named_columns(names, na_tokens))
        for header, names in raw.names.items()
    ]


def store_cells(spark: SparkSession, raw: RawFiles, path: str) -> DataFrame:
    """`read_cells` as a table with a part for each header."""
    rows = read_cells(spark, raw)
    rows.write.option("maxRecordsPerFile", CELL_ROWS).partitionBy("header").parquet(path)
    return spark.read.schema(rows.schema).parquet(path).select(rows.columns)


def read_raw_csv(
    spark: SparkSession, root: str, files=None, pattern: str | None = None, na_tokens=NA_TOKENS
) -> DataFrame:
    """All rows in one frame, matched by column name whatever its case; missing columns are null."""
    paths = _places(spark, root, files, pattern)
    raw = scan_files(spark, paths, scratch(spark), root) if paths else None
    if raw is None or not raw.names:
        raise ValueError(f"no CSV file with a header below {root}")
    rows = read_cells(spark, raw)
    if len(raw.names) == 1:
        return rows.select(PROVENANCE, *named_columns(next(iter(raw.names.values())), na_tokens))
    every = {n.lower(): n for names in reversed(raw.names.values()) for n in reversed(names)}
    order = list(dict.fromkeys(n.lower() for names in raw.names.values() for n in names))

    def places(names) -> Column:
        own = {n.lower(): i for i, n in enumerate(names)}
        return F.array(*(F.lit(own.get(n)).cast("int") for n in order))

    cells = F.array(*(c for c in rows.columns if c not in (PROVENANCE, "header", "extra")))
    placed = rows.select(PROVENANCE, cells.alias("cells"), _by_header(raw, places).alias("places"))
    found = [null_if_in(F.get("cells", F.get("places", F.lit(i))), na_tokens).alias(every[n]) for i, n in enumerate(order)]
    return placed.select(PROVENANCE, *found)


def read_uniform_csv(
    spark: SparkSession, root: str, multi_line: bool = False, na_tokens=NA_TOKENS
) -> DataFrame:
    """Files known to share one header, without the pass over their lines.

    A file with another header makes the read fail instead of mixing up columns.
    """
    rows = (
        spark.read.option("recursiveFileLookup", "true")
        .options(header=True, enforceSchema=False, quote='"', escape='"', multiLine=multi_line)
        .csv(root)
    )
    names = rows.columns
    return rows.select(
        source_file(below(decoded(F.col("_metadata.file_path")), root)).alias(PROVENANCE),
        *[null_if_in(F.col(f"`{n}`"), na_tokens).alias(n) for n in names],
    )


def read_cleaned_prices(spark: SparkSession, root: str) -> list[DataFrame]:
    """The cleaned files in `root`, one frame per header; others are not read.

    `x__cleaned.csv` may be a file or a folder of part files.
    """
    return read_raw_groups(spark, root, pattern=CLEANED_PATTERN)
