"""Untidy text tables derived from the test tables, and CSV folders written from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry.mapping import read

_FILE = "source_file"


def dirty_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = read(spark, sf_dir, "supplier")
    nation = F.col("s_nationkey").cast("string")
    symbol = F.concat(F.lit("  n."), nation, F.lit("/x b\t"))
    return supplier.select(
        F.lit("companies.csv").alias(_FILE),
        F.when(F.col("s_nationkey") % 7 == 0, " nan ").otherwise(symbol).alias(" Symbol "),
        F.concat(F.lit(" "), "s_name", F.lit(" ")).alias("Company  Name"),
        F.concat(F.lower(F.replace("s_name", F.lit("#"), F.lit("."))), F.lit(" ")).alias(
            "Old-Ticker"
        ),
        F.when(F.col("s_suppkey") % 4 == 0, "None").otherwise("Active").alias("Sentiment (now)"),
    )


def dirty_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    day = F.to_date("o_orderdate").cast("string")
    american = F.date_format("o_orderdate", "MM/dd/yyyy")
    slot = key % 100
    return orders.select(
        F.concat(F.lit("news_"), (key % 3).cast("string"), F.lit(".csv")).alias(_FILE),
        F.concat(F.lit(" "), "o_orderpriority", F.lit("\t")).alias("Title"),
        F.when(slot != 13, F.concat(F.lit("http://x/"), slot.cast("string"))).alias("URL"),
        F.when(key % 11 == 0, "soon")
        .when(key % 2 == 0, american)
        .otherwise(day)
        .alias("Published At"),
        F.when(F.col("o_orderstatus") == "F", "good").otherwise("bad time").alias("Sentiment"),
        key.cast("string").alias("Article"),
    )


def dirty_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price files `sp500/t<nn>.csv` and `other/t<nn>.csv`; one file holds a third of the rows."""
    line = F.col("l_linenumber")
    quantity = F.col("l_quantity").cast("bigint")
    price = (F.floor(F.col("l_extendedprice") / 20000) * 20000).cast("bigint")
    number = F.when(F.col("l_suppkey") % 3 == 0, 0).otherwise(F.col("l_suppkey") % 25)
    folder = F.when(number < 20, "sp500/t").otherwise("other/t")
    iso = F.to_date("l_shipdate").cast("string")
    american = F.date_format("l_shipdate", "MM/dd/yyyy")
    return read(spark, sf_dir, "lineitem").select(
        F.concat(folder, F.lpad(number.cast("string"), 2, "0"), F.lit(".csv")).alias(_FILE),
        F.when((line == 4) & (quantity < 5), "n/a")
        .when(line == 3, american)
        .otherwise(iso)
        .alias("Date"),
        (quantity % 5).cast("string").alias("Open"),
        F.when(line == 7, "abc")
        .otherwise(F.concat(F.lit(" "), price.cast("string"), F.lit(" ")))
        .alias("Close"),
        F.when(line == 2, None).otherwise(price.cast("string")).alias("Adjusted Close"),
        F.when(line == 6, "-5")
        .when(line == 5, None)
        .otherwise((quantity % 5).cast("string"))
        .alias("Volume"),
    )


def write_raw_files(rows: DataFrame, root: str) -> None:
    """Write untidy rows as CSV files named by their `source_file`.

    Files with an odd number have their columns in another order and another name for
    the adjusted close, where there is one.
    """
    name = F.element_at(F.split(_FILE, "/"), -1)
    folder = F.coalesce(F.get(F.reverse(F.split(_FILE, "/")), F.lit(1)), F.lit("all"))
    named = rows.withColumns({"folder": folder, "file": name})
    odd = F.regexp_extract("file", "([0-9]+)", 1).cast("int") % 2 == 1
    data = [c for c in rows.columns if c != _FILE]
    turned = [
        F.col(f"`{c}`").alias("Adj Close" if c == "Adjusted Close" else c) for c in reversed(data)
    ]
    plain = [F.col(f"`{c}`") for c in data]
    for part, columns in ((named.filter(~odd), plain), (named.filter(odd), turned)):
        (
            part.select("folder", "file", *columns)
            .hint("rebalance", "folder", "file")
            .write.mode("append")
            .partitionBy("folder", "file")
            # Cells keep their spaces, as in the files people hand in.
            .options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
            .csv(root)
        )


_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
# Files that a task has open at once; beyond, it sorts its rows by file.
MAX_OPEN = 100


def write_whole_files(lines: DataFrame, root: str) -> None:
    """Write (file, value) rows as text files of one part each, so that a file's size is no matter of chance.

    All rows of a file are written by one task, which passes them on as they come: Spark would sort them by file first,
    and hold them all, unless a task may have several files open.
    """
    conf = lines.sparkSession.conf
    before = conf.get(_WRITERS, None)
    conf.set(_WRITERS, MAX_OPEN)
    try:
        lines.repartition("file").write.partitionBy("file").text(root)
    finally:
        if before is None:
            conf.unset(_WRITERS)
        else:
            conf.set(_WRITERS, before)


def write_raw_lines(lines: DataFrame, root: str) -> None:
    """Write (file, place, line) rows as they are, one part per file, its lines by place."""
    (
        lines.repartition("file")
        .sortWithinPartitions("file", "place")
        .select("file", "line")
        .write.partitionBy("file")
        .options(quote="", sep="\x01", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        .csv(root)
    )


def broken_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of twelve price files: one with cells beyond the header, one of blank lines, one with a line of more cells
    than are parsed, one with its columns in another order; all the others are as they should be."""
    orders = read(spark, sf_dir, "orders")
    number = F.col("o_custkey") % 12
    day = F.to_date("o_orderdate").cast("string")
    close = (F.col("o_orderkey") % 50).cast("string")
    extra = F.when(F.col("o_orderkey") % 7 == 0, ",more").otherwise("")
    wide = F.when(F.col("o_orderkey") % 1000 == 3, F.repeat(F.lit(","), 250_000)).otherwise("")
    line = (
        F.when(number == 3, F.concat(day, F.lit(","), close, F.lit(",1"), extra))
        .when(number == 5, F.lit("  "))
        .when(number == 7, F.concat(F.lit("1,"), close, F.lit(","), day))
        .when(number == 8, F.concat(day, F.lit(","), close, F.lit(",1"), wide))
        .otherwise(F.concat(day, F.lit(","), close, F.lit(",1")))
    )
    rows = orders.select(number.alias("n"), F.col("o_orderkey").alias("place"), line.alias("line"))
    header = F.when(F.col("n") == 5, "").when(F.col("n") == 7, "Volume,Close,Date").otherwise("Date,Close,Volume")
    headers = rows.select("n").distinct().select("n", F.lit(-1).cast("long").alias("place"), header.alias("line"))
    name = F.concat(F.lit("p"), F.col("n").cast("string"), F.lit(".csv"))
    return headers.union(rows).select(name.alias("file"), "place", "line")
