"""Queries over the cleaning and staging operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.functions.scratch import scratch
from pricelens.operators import clean, staging
from pricelens.plans.cleaning import clean_dataset
from pricelens.sources import export, files, raw_csv
from registry.dirty import (
    broken_prices,
    dirty_companies,
    dirty_news,
    dirty_prices,
    write_raw_files,
    write_raw_lines,
    write_whole_files,
)
from registry.mapping import read

MARKET = files.MARKET_DATASET
CUTOFF = "2000-01-01"


def snake_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.snake_case_columns(dirty_companies(spark, sf_dir))


def normalize_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.normalize_strings(clean.snake_case_columns(dirty_companies(spark, sf_dir)))


def normalize_ticker(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = clean.snake_case_columns(dirty_companies(spark, sf_dir))
    return clean.normalize_ticker_columns(named).select("company_name", "symbol", "old_ticker")


def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = clean.snake_case_columns(dirty_news(spark, sf_dir))
    parsed = clean.parse_date_columns(named)
    return parsed.select("article", "sentiment", F.to_date("published_at").alias("published"))


def drop_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("f"), (F.col("l_suppkey") % 5).cast("string")).alias("source_file"),
        "l_returnflag",
        "l_linestatus",
        "l_quantity",
    )
    return clean.drop_exact_duplicates(lines)


def drop_duplicates_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("f"), (F.col("l_suppkey") % 5).cast("string")).alias("source_file"),
        "l_returnflag",
        "l_linestatus",
        "l_quantity",
    )
    return clean.drop_exact_duplicates(lines, scope="dataset")


def _prepared(df: DataFrame) -> DataFrame:
    return (
        df.transform(clean.snake_case_columns)
        .transform(clean.normalize_strings)
        .transform(clean.parse_date_columns)
        .transform(clean.normalize_ticker_columns)
    )


def _days(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {c: F.to_date(c) for c, t in df.dtypes if t == "timestamp_ntz"}
    )


def clean_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days(clean.clean_price(_prepared(dirty_prices(spark, sf_dir))))


def clean_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_company(_prepared(dirty_companies(spark, sf_dir)))


def clean_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days(clean.clean_news(_prepared(dirty_news(spark, sf_dir))))


def clean_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select(
        F.lit("events.csv").alias("source_file"), "user_id", "event_type"
    )
    return clean.clean_generic(events)


def classify_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind and size of the untidy tables."""
    found = None
    for table in (dirty_companies, dirty_news, dirty_prices):
        named = clean.snake_case_columns(table(spark, sf_dir))
        kind = clean.classify_table(named.columns)
        row = named.agg(F.count("*").alias("raw_rows")).select(
            F.lit(table.__name__).alias("table_name"), F.lit(kind).alias("kind"), "raw_rows"
        )
        found = row if found is None else found.unionByName(row)
    return found


def basic_clean_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, kind = clean.basic_clean(dirty_prices(spark, sf_dir))
    return _days(rows).withColumn("kind", F.lit(kind))


def basic_clean_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, kind = clean.basic_clean(dirty_companies(spark, sf_dir))
    return rows.withColumn("kind", F.lit(kind))


def basic_clean_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, kind = clean.basic_clean(dirty_news(spark, sf_dir))
    return _days(rows).withColumn("kind", F.lit(kind))


def _raw_prices(spark, sf_dir) -> str:
    root = scratch(spark)
    write_raw_files(dirty_prices(spark, sf_dir), f"{root}/raw")
    return root


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _raw_prices(spark, sf_dir)
    rows = clean.snake_case_columns(raw_csv.read_raw_csv(spark, f"{root}/raw"))
    return rows.withColumn("source_file", staging.file_name(F.col("source_file")))


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input file, number of parts and size of a listing of text files, written and read back."""
    root = scratch(spark)
    line = F.concat_ws(
        ",", "l_orderkey", "l_partkey", "l_suppkey", F.to_date("l_shipdate").cast("string")
    )
    lines = read(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", F.lit(".csv")).alias("file"), line.alias("value")
    )
    write_whole_files(lines, f"{root}/raw")
    files.write_inventory(files.inventory(spark, f"{root}/raw"), f"{root}/inventory")
    listing = spark.read.schema("relative_path STRING, size_mb DOUBLE").csv(
        f"{root}/inventory", header=True
    )
    return listing.groupBy(staging.file_name(F.col("relative_path")).alias("file")).agg(
        F.count("*").alias("parts"), F.max("size_mb").alias("size_mb")
    )


def inventory_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _raw_prices(spark, sf_dir)
    path = F.col("relative_path")
    return (
        files.inventory(spark, f"{root}/raw")
        .select(staging.file_name(path).alias("file"), (F.col("size_mb") >= 0).alias("has_size"))
        .distinct()
    )


def select_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _raw_prices(spark, sf_dir)
    chosen = files.select_files(files.inventory(spark, f"{root}/raw"), MARKET)
    return chosen.select(staging.file_name(F.col("relative_path")).alias("file")).distinct()


def _cleaned_prices(spark, sf_dir, root: str) -> DataFrame:
    """Cleaned rows as a stored table, which the exports read more than once."""
    clean.basic_clean(dirty_prices(spark, sf_dir))[0].write.parquet(f"{root}/table")
    return spark.read.parquet(f"{root}/table")


def sample_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch(spark)
    export.write_sample(_cleaned_prices(spark, sf_dir, root), f"{root}/samples", rows=40)
    back = raw_csv.read_raw_csv(spark, f"{root}/samples")
    return back.select(
        staging.file_name(F.col("source_file")).alias("file"),
        F.to_date("date").alias("date"),
        F.col("open").cast("double").alias("open"),
        F.col("close").cast("double").alias("close"),
        F.col("adjusted_close").cast("double").alias("adjusted_close"),
        F.col("volume").cast("double").alias("volume"),
    )


def chunk_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written sizes and modes with the rows read back; parts keep to the cap."""
    root = scratch(spark)
    cap = 1000
    cleaned = _cleaned_prices(spark, sf_dir, root)
    export.file_stats(cleaned, max_full_mb=0.2).write.parquet(f"{root}/stats")
    stats = export.write_full_or_chunked(
        cleaned, f"{root}/cleaned", spark.read.parquet(f"{root}/stats"), chunk_rows=cap
    ).withColumn("file", F.concat(export.stem(), F.lit("__cleaned.csv")))
    parts = (
        spark.read.option("recursiveFileLookup", "true")
        .csv(f"{root}/cleaned", header=True)
        .groupBy(F.col("_metadata.file_path").alias("path"))
        .count()
    )
    back = parts.groupBy(staging.file_name(F.col("path")).alias("file")).agg(
        F.sum("count").alias("rows_back"),
        F.max("count").alias("largest"),
        F.count("*").alias("parts"),
    )
    kept_cap = F.when(F.col("saved_mode") == "full", F.col("parts") == 1).otherwise(
        F.col("largest") <= cap
    )
    return stats.join(back, "file").select(
        "source_file",
        "cleaned_rows",
        "rows_back",
        "csv_bytes",
        "saved_mode",
        kept_cap.alias("kept_cap"),
    )


def cleaning_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _raw_prices(spark, sf_dir)
    log = clean_dataset(spark, MARKET, f"{root}/raw", f"{root}/ready")
    return log.withColumn("source_file", staging.file_name(F.col("source_file")))


def cleaning_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of a run in which some of the files cannot be read."""
    root = scratch(spark)
    write_raw_lines(broken_prices(spark, sf_dir), f"{root}/raw")
    log = clean_dataset(spark, "any", f"{root}/raw", f"{root}/ready")
    return log.withColumn("source_file", staging.file_name(F.col("source_file")))


def _combined(spark, sf_dir) -> DataFrame:
    root = _raw_prices(spark, sf_dir)
    clean_dataset(spark, MARKET, f"{root}/raw", f"{root}/ready")
    return staging.combine_prices(raw_csv.read_cleaned_prices(spark, f"{export.finished(spark, f'{root}/ready')}/cleaned"))


def combine_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _combined(spark, sf_dir)
    return rows.withColumns(
        {
            "trading_date": F.to_date("trading_date"),
            **{c: F.col(c).cast("double") for c in ("open", "close", "adj_close", "volume")},
        }
    )


def same_named_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaning files of one name in three folders: rows and samples by output."""
    root = scratch(spark)
    folder = F.concat(F.lit("f"), (F.col("o_custkey") % 3).cast("string"), F.lit("/p2.csv"))
    rows = read(spark, sf_dir, "orders").select(
        folder.alias("source_file"),
        F.to_date("o_orderdate").cast("string").alias("Date"),
        (F.col("o_orderkey") % 100).cast("string").alias("Close"),
        F.lit("1").alias("Volume"),
    )
    write_raw_files(rows, f"{root}/raw")
    clean_dataset(spark, "any", f"{root}/raw", f"{root}/ready")
    combined = staging.combine_prices(raw_csv.read_cleaned_prices(spark, f"{export.finished(spark, f'{root}/ready')}/cleaned"))
    found = combined.groupBy("source_file", "ticker").agg(
        F.count("*").alias("rows"), F.sum(F.col("close").cast("double")).alias("closes")
    )
    output = F.regexp_replace(staging.file_name(F.col("source_file")), "__sample", "__cleaned")
    samples = (
        raw_csv.read_raw_csv(spark, f"{export.finished(spark, f'{root}/ready')}/samples")
        .groupBy(output.alias("source_file"))
        .agg(F.count("*").alias("sampled"))
    )
    return found.join(samples, "source_file")


def _typed(spark, sf_dir) -> DataFrame:
    """Cleaned price rows of the market files as `combine_prices` hands them on."""
    cleaned = clean.basic_clean(dirty_prices(spark, sf_dir))[0].filter(
        F.col("source_file").contains(files.MARKET_WORD)
    )
    output = F.concat(export.stem(), F.lit("__cleaned.csv"))
    return staging.combine_prices(cleaned.withColumn("source_file", output))


def _read_back(spark, prices: DataFrame) -> DataFrame:
    root = scratch(spark)
    export.write_prices_csv(prices, f"{root}/prices")
    return spark.read.schema(prices.schema).csv(f"{root}/prices", header=True)


def finalize_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staging rows, written as CSV and read back."""
    return _read_back(spark, staging.finalize_staging(_typed(spark, sf_dir)))


def load_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load rows, written as CSV and read back."""
    staged = staging.finalize_staging(_typed(spark, sf_dir))
    return _read_back(spark, staging.load_ready(staged, CUTOFF))


def load_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.load_summary(staging.finalize_staging(_typed(spark, sf_dir)), CUTOFF)


QUERIES = {
    f.__name__: f
    for f in (
        snake_case,
        normalize_strings,
        normalize_ticker,
        parse_dates,
        drop_duplicates,
        drop_duplicates_dataset,
        clean_price,
        clean_company,
        clean_news,
        clean_generic,
        classify_tables,
        basic_clean_price,
        basic_clean_company,
        basic_clean_news,
        csv_round_trip,
        inventory,
        inventory_files,
        select_files,
        sample_export,
        chunk_export,
        cleaning_log,
        cleaning_errors,
        combine_prices,
        same_named_files,
        finalize_staging,
        load_ready,
        load_summary,
    )
}
