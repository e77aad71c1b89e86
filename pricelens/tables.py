"""The star schema the operators read, and how it is stored."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, fields

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "sector": "sector_id BIGINT, sector_name STRING",
    "industry": "industry_id BIGINT, industry_name STRING, sector_id BIGINT",
    "company": (
        "company_id BIGINT, ticker STRING, company_name STRING, exchange STRING, "
        "cik STRING, industry_id BIGINT"
    ),
    "company_profile": (
        "company_id BIGINT, short_name STRING, long_name STRING, city STRING, state STRING, "
        "country STRING, long_business_summary STRING, current_price DOUBLE, market_cap DOUBLE, "
        "ebitda DOUBLE, revenue_growth DOUBLE, weight DOUBLE"
    ),
    "company_financial_snapshot": (
        "company_id BIGINT, price DOUBLE, price_earnings DOUBLE, dividend_yield DOUBLE, "
        "earnings_share DOUBLE, week_52_low DOUBLE, week_52_high DOUBLE, market_cap DOUBLE, "
        "ebitda DOUBLE, price_sales DOUBLE, price_book DOUBLE, sec_filings STRING"
    ),
    "price_source": "source_id BIGINT, priority_rank INT",
    "price_daily": (
        "company_id BIGINT, source_id BIGINT, trading_date DATE, open DOUBLE, high DOUBLE, "
        "low DOUBLE, close DOUBLE, adj_close DOUBLE, volume BIGINT"
    ),
    "news_article": (
        "article_id BIGINT, source STRING, title STRING, summary STRING, url STRING, "
        "published_at TIMESTAMP, lm_level INT, lm_score1 DOUBLE, lm_score2 DOUBLE, "
        "lm_sentiment STRING"
    ),
    "article_mention": "article_id BIGINT, company_id BIGINT, mention_confidence DOUBLE",
}


@dataclass(frozen=True)
class Tables:
    """One DataFrame per relation; an operator only needs the ones it reads."""

    sector: DataFrame | None = None
    industry: DataFrame | None = None
    company: DataFrame | None = None
    company_profile: DataFrame | None = None
    company_financial_snapshot: DataFrame | None = None
    price_source: DataFrame | None = None
    price_daily: DataFrame | None = None
    news_article: DataFrame | None = None
    article_mention: DataFrame | None = None
    # Written by `store_tables`: lower-case tickers and names in order, for look-ups by their beginnings.
    company_lookup: DataFrame | None = None


@dataclass(frozen=True)
class Layout:
    """Folders by `folder`, or a coarser date, in each the rows dealt to buckets by `key` and sorted by `order`."""

    folder: str
    key: str
    order: tuple[str, ...]


# Columns that name folders of news, each with the unit that its date is cut to.
NEWS_FOLDERS = {"published_day": "DD", "published_month": "MM"}
# Articles and their mentions lie alike, so they are joined bucket by bucket within the days asked for.
LAYOUTS = {
    "price_daily": Layout("trading_month", "company_id", ("company_id", "trading_date")),
    "news_article": Layout("published_day", "article_id", ("article_id",)),
    "article_mention": Layout("published_day", "article_id", ("article_id", "company_id")),
}
# About so many rows lie in a bucket, over all its folders.
ROWS_PER_BUCKET = 4_000_000
# With fewer articles a day than this, news lie by month, as most files would be tiny.
ARTICLES_PER_DAY = 100_000
LOOKUP = "company_lookup"
_LOOKUP_SCHEMA = "key STRING, is_name BOOLEAN, ticker STRING, company_id BIGINT"
_LAYOUT_SCHEMA = "name STRING, folder STRING, buckets INT"


def load_tables(spark, root: str, names=tuple(SCHEMAS)) -> Tables:
    """Read the relations below `root`, one Parquet folder each, with their fixed schema.

    What `store_tables` wrote is opened with its folders and buckets.
    """
    layouts = _stored_layouts(spark, root)
    lookup = None
    if LOOKUP in layouts and "company" in names:
        lookup = spark.read.schema(_LOOKUP_SCHEMA).parquet(f"{root}/{LOOKUP}")
    return Tables(
        company_lookup=lookup,
        **{
            n: _open_buckets(spark, root, n, *layouts[n])
            if n in layouts
            else spark.read.schema(SCHEMAS[n]).parquet(f"{root}/{n}")
            for n in names
        },
    )


def _stored_layouts(spark: SparkSession, root: str) -> dict[str, tuple[str, int]]:
    """The folders' column and the number of buckets of each relation below `root` that has a layout."""
    try:
        rows = spark.read.schema(_LAYOUT_SCHEMA).parquet(f"{root}/layout").collect()
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    return {r["name"]: (r["folder"], r["buckets"]) for r in rows}


def _table_name(root: str, name: str) -> str:
    """A name in the catalog for a relation at a place."""
    return f"{name}_{hashlib.sha256(f'{root}/{name}'.encode()).hexdigest()[:16]}"


def _open_buckets(spark: SparkSession, root: str, name: str, folder: str, buckets: int) -> DataFrame:
    """The stored files as a table of the session's catalog, which is where Spark looks for buckets.

    The table is external: dropping it leaves the files. A session that finds it in its catalog, at this place and with
    these buckets, uses it as it is.
    """
    layout, table = LAYOUTS[name], _table_name(root, name)
    place = f"{root}/{name}".replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({SCHEMAS[name]}, {folder} DATE) USING parquet "
        f"PARTITIONED BY ({folder}) CLUSTERED BY ({layout.key}) SORTED BY ({', '.join(layout.order)}) "
        f"INTO {buckets} BUCKETS LOCATION '{place}'"
    )
    spark.catalog.recoverPartitions(table)
    return spark.table(table)


def store_tables(tables: Tables, root: str, buckets: int | None = None, news_folder: str | None = None) -> None:
    """Write all relations below `root` as `load_tables` reads them.

    Prices lie by month and articles with their mentions by day, or by month where a day has few articles
    (`news_folder` says which), each dealt to buckets by company or article, so that operators skip folders and group or
    join without a shuffle by that key. Every bucket of a folder is one sorted file. The number of buckets follows the
    rows, and is the same for articles and mentions.
    """
    stored = {f.name: getattr(tables, f.name) for f in fields(tables) if getattr(tables, f.name) is not None}
    stored.pop(LOOKUP, None)
    session = next(iter(stored.values())).sparkSession
    folders = {}
    if "price_daily" in stored:
        folders["price_daily"] = "trading_month"
        stored["price_daily"] = stored["price_daily"].withColumn("trading_month", F.trunc("trading_date", "MM"))
    if "news_article" in stored:
        if news_folder is None:
            sizes = stored["news_article"].agg(F.count("*"), F.count_distinct(F.to_date("published_at"))).first()
            news_folder = "published_day" if sizes[0] >= ARTICLES_PER_DAY * sizes[1] else "published_month"
        day = F.to_date(F.date_trunc(NEWS_FOLDERS[news_folder], "published_at"))
        folders["news_article"] = news_folder
        stored["news_article"] = stored["news_article"].withColumn(news_folder, day)
        if "article_mention" in stored:
            folders["article_mention"] = news_folder
            # The last one, should an article be there twice: a mention must be found from each of them.
            days = stored["news_article"].groupBy("article_id").agg(F.max(news_folder).alias(news_folder))
            stored["article_mention"] = stored["article_mention"].join(days, "article_id", "left")
    found: dict[str, int] = {}
    for name, rows in stored.items():
        if name not in folders:
            rows.write.parquet(f"{root}/{name}")
            continue
        layout, folder, written = LAYOUTS[name], folders[name], f"{_table_name(root, name)}_written"
        same = [found[n] for n in found if LAYOUTS[n].key == layout.key]
        n = buckets or (same[0] if same else max(1, math.ceil(rows.count() / ROWS_PER_BUCKET)))
        types = dict(c.split() for c in SCHEMAS[name].split(", "))
        (
            rows.select(*[F.col(c).cast(types[c]) for c in types if c in rows.columns], folder)
            # As Spark deals rows to buckets, so a bucket is written by one task.
            .repartition(n, layout.key)
            .sortWithinPartitions(folder, *layout.order)
            .write.partitionBy(folder)
            .bucketBy(n, layout.key)
            .sortBy(*layout.order)
            .option("path", f"{root}/{name}")
            .format("parquet")
            .saveAsTable(written)
        )
        session.sql(f"DROP TABLE {written}")
        found[name] = n
    rows = [(name, folders[name], n) for name, n in found.items()]
    if "company" in stored:
        # In ranges of the key, so a beginning is in few files and in few parts of them.
        lookup_keys(stored["company"]).repartitionByRange("key").sortWithinPartitions("key").write.parquet(f"{root}/{LOOKUP}")
        rows.append((LOOKUP, None, 0))
    session.createDataFrame(rows, _LAYOUT_SCHEMA).coalesce(1).write.parquet(f"{root}/layout")


def lookup_keys(company: DataFrame) -> DataFrame:
    """A row for each company's ticker and for its name, in lower case."""
    kinds = [("ticker", False), ("company_name", True)]
    ticker = F.col("ticker").alias("ticker")
    parts = [
        company.select(F.lower(c).alias("key"), F.lit(is_name).alias("is_name"), ticker, F.col("company_id").cast("bigint").alias("company_id"))
        for c, is_name in kinds
    ]
    return parts[0].union(parts[1]).filter("key is not null")


def save_prices(price_daily: DataFrame, path: str) -> None:
    """Store prices by month of the trading day, clustered by company inside a month.

    Operators that get dates skip whole months through `trading_month`. The rebalance hint
    lets adaptive execution split a month that is too big for one task and merge small ones.
    """
    (
        price_daily.withColumn("trading_month", F.trunc("trading_date", "MM"))
        .hint("rebalance", "trading_month")
        .sortWithinPartitions("trading_month", "company_id", "trading_date")
        .write.partitionBy("trading_month")
        .parquet(path)
    )


def listed_companies(tables: Tables, how: str = "inner") -> DataFrame:
    """Companies with industry and sector; `how="left"` keeps the unclassified ones."""
    industry = tables.industry.select("industry_id", "industry_name", "sector_id")
    sector = tables.sector.select("sector_id", "sector_name")
    return tables.company.join(industry, "industry_id", how).join(sector, "sector_id", how)
