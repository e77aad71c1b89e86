"""Writers of cleaned tables: samples, whole or chunked files, staging and load files.

Output for one input file is a folder named after it, such as `output=aapl__cleaned.csv`, holding
part files. Of several input files with one name the first by path has that name and the others a
number in front, `output=2__aapl__cleaned.csv`. All input files of a table are written by one job.

Writers add to a folder. A run of several writes does so in an attempt, a new folder that the manifest beside it names
once the run is done, so a run that was stopped between two writes can be repeated without doubling a row.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelens.functions.text import snake_case_text
from pricelens.functions.windows import first_rows
from pricelens.operators.clean import PROVENANCE, clean_order
from pricelens.operators.staging import file_name

MAX_FULL_MB = 45
SAMPLE_ROWS = 300
CHUNK_ROWS = 150_000
_OUTPUT = "output"


def stem(path=PROVENANCE) -> Column:
    """Snake-case name of an input file without folder and ending."""
    return snake_case_text(F.regexp_replace(file_name(F.col(path)), r"\.[^.]*$", ""))


def output_names(files: DataFrame) -> DataFrame:
    """source_file and output_name, one row per input file; no two input files share a name.

    `files` has one row per input file. Names of one run must come from one call over all its files.
    A snake-case name has no two underscores in a row, so a numbered one is nobody else's.
    """
    same_name = Window.partitionBy("output_name").orderBy(PROVENANCE)
    return (
        files.select(PROVENANCE, stem().alias("output_name"))
        .withColumn("_place", F.row_number().over(same_name))
        .select(
            PROVENANCE,
            F.when(F.col("_place") == 1, F.col("output_name"))
            .otherwise(F.concat_ws("__", "_place", "output_name"))
            .alias("output_name"),
        )
    )


def sample_rows(cleaned: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """First rows of each input file in the order of the cleaned table."""
    return first_rows(cleaned, [PROVENANCE], clean_order(cleaned), rows)


def write_sample(
    cleaned: DataFrame, path: str, rows: int = SAMPLE_ROWS, names: DataFrame | None = None
) -> None:
    """Write `sample_rows`; `names` are the `output_names` of the run, else those of `cleaned`."""
    if names is None:
        names = output_names(cleaned.select(PROVENANCE).distinct())
    (
        sample_rows(cleaned, rows)
        .join(names, PROVENANCE)
        .withColumn(_OUTPUT, F.concat("output_name", F.lit("__sample.csv")))
        .sortWithinPartitions(_OUTPUT, *clean_order(cleaned))
        .drop(PROVENANCE, "output_name")
        .write.mode("append")
        .partitionBy(_OUTPUT)
        .csv(path, header=True)
    )


def file_stats(cleaned, max_full_mb: float = MAX_FULL_MB) -> DataFrame:
    """cleaned_rows, csv_bytes and saved_mode per input file: `full` up to the size limit.

    `cleaned` is a table or a list of tables with files of their own; `table` is the place in the list. One job for all.
    """
    tables = [cleaned] if isinstance(cleaned, DataFrame) else list(cleaned)
    lines = []
    for number, rows in enumerate(tables):
        data = [c for c in rows.columns if c != PROVENANCE]
        line = F.octet_length(F.to_csv(F.struct(*(F.col(f"`{c}`") for c in data)))) + 1
        lines.append(
            rows.select(PROVENANCE, F.lit(number).alias("table"), line.alias("line"), F.lit(len(",".join(data)) + 1).alias("header"))
        )
    return (
        functools.reduce(DataFrame.union, lines)
        .groupBy(PROVENANCE, "table")
        .agg(F.count("*").alias("cleaned_rows"), (F.sum("line") + F.max("header")).alias("csv_bytes"))
        .withColumn(
            "saved_mode",
            F.when(F.col("csv_bytes") <= max_full_mb * 1024 * 1024, "full").otherwise("chunked"),
        )
    )


def write_full_or_chunked(
    cleaned: DataFrame,
    path: str,
    stats: DataFrame | None = None,
    max_full_mb: float = MAX_FULL_MB,
    chunk_rows: int = CHUNK_ROWS,
    names: DataFrame | None = None,
    some_chunked: bool | None = None,
) -> DataFrame:
    """Write each input file's rows, sorted, and return `file_stats`.

    `cleaned` and `stats` are read several times, so they should be stored tables. `names` are the
    `output_names` of the run, else those of `cleaned`. `some_chunked` says whether a file is over the limit, if known.

    A small file is one part. A big one is spread by range over tasks, so no task holds all of
    it, and each part has at most `chunk_rows` rows.
    """
    stats = file_stats(cleaned, max_full_mb) if stats is None else stats
    names = output_names(stats) if names is None else names
    order = clean_order(cleaned)
    named = (
        cleaned.join(stats.select(PROVENANCE, "saved_mode").join(names, PROVENANCE), PROVENANCE)
        .withColumn(_OUTPUT, F.concat("output_name", F.lit("__cleaned.csv")))
        .select(_OUTPUT, "saved_mode", *[c for c in cleaned.columns if c != PROVENANCE])
    )
    whole = named.filter("saved_mode = 'full'").repartition(_OUTPUT)
    chunks = named.filter("saved_mode = 'chunked'").repartitionByRange(_OUTPUT, *order)
    if some_chunked is None:
        some_chunked = not stats.filter("saved_mode = 'chunked'").isEmpty()
    for rows, cap in ((whole, 0), (chunks, chunk_rows)) if some_chunked else ((whole, 0),):
        (
            rows.drop("saved_mode")
            .sortWithinPartitions(_OUTPUT, *order)
            .write.mode("append")
            .option("maxRecordsPerFile", cap)
            .partitionBy(_OUTPUT)
            .csv(path, header=True)
        )
    return stats


def new_attempt(out: str) -> str:
    """A folder below `out` for one run's writes; nothing is in it yet."""
    return f"{out.rstrip('/')}/attempt-{uuid.uuid4().hex}"


def finish(spark: SparkSession, out: str, attempt: str) -> None:
    """Name a run's folder in the manifest, by one small file that is there as a whole or not at all."""
    done = spark.range(1).select(F.lit(attempt.rsplit("/", 1)[1]).alias("attempt"), F.current_timestamp().alias("finished"))
    done.coalesce(1).write.mode("append").parquet(f"{out.rstrip('/')}/manifest")


def finished(spark: SparkSession, out: str) -> str:
    """The folder of the run that finished last."""
    out = out.rstrip("/")
    last = spark.read.schema("attempt STRING, finished TIMESTAMP").parquet(f"{out}/manifest")
    return f"{out}/{last.agg(F.max_by('attempt', F.struct('finished', 'attempt'))).first()[0]}"


def write_prices_csv(prices: DataFrame, path: str) -> None:
    """Staging or load rows as CSV sorted by ticker and day, a header in every part.

    The sort spreads rows by range of ticker and day, so a long ticker takes several parts.
    """
    prices.orderBy("ticker", "trading_date").write.mode("overwrite").csv(path, header=True)
