"""Queries over the mapped test tables, one or more per operator."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.functions.params import range_window
from pricelens.functions.scratch import scratch
from pricelens.operators import directory, industries, leaders, news, prices
from pricelens.tables import Tables, listed_companies, load_tables, store_tables
from registry.mapping import LISTING, NEWS, PRICES, read, tables_c, tables_s

LAST_DAY = dt.date(2024, 1, 30)
NOW = dt.datetime(2001, 8, 1)


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles rounded, so that sums added in another order compare equal."""
    return df.selectExpr(
        *[f"round({c}, {digits}) AS {c}" if t == "double" else c for c, t in df.dtypes]
    )


def _primary_c(spark, sf_dir):
    tables = tables_c(spark, sf_dir)
    return prices.primary_price(tables.price_daily, tables.price_source), tables


def primary_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _primary_c(spark, sf_dir)[0]


def latest_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices.latest_trade(_primary_c(spark, sf_dir)[0])


def latest_primary_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = tables_c(spark, sf_dir)
    return prices.latest_primary_trade(tables.price_daily, tables.price_source)


def sector_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    primary, tables = _primary_c(spark, sf_dir)
    return rounded(prices.sector_benchmark(primary, listed_companies(tables)))


def sector_price_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    primary, tables = _primary_c(spark, sf_dir)
    return prices.sector_price_rank(primary, listed_companies(tables))


def sector_price_rank_banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan for more companies than are broadcast."""
    primary, tables = _primary_c(spark, sf_dir)
    return prices.sector_price_rank(primary, listed_companies(tables), max_companies=0)


def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    primary = _primary_c(spark, sf_dir)[0].select("company_id", "trading_date", "close")
    averaged = prices.with_moving_average(prices.with_moving_average(primary, 7), 30)
    return rounded(averaged)


def daily_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    primary = _primary_c(spark, sf_dir)[0].select("company_id", "trading_date", "close")
    return rounded(prices.with_daily_return(primary))


def price_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(prices.price_series(tables_c(spark, sf_dir)))


def price_series_1w(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, end = range_window(LAST_DAY, "1W")
    return rounded(prices.price_series(tables_c(spark, sf_dir), start=start, end=end))


def _stored(spark, mapped: Tables, names) -> Tables:
    root = scratch(spark)
    store_tables(mapped, root, buckets=4)
    return load_tables(spark, root, names)


def price_series_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A week of the series from stored tables, prices by month and in buckets by company."""
    start, end = range_window(LAST_DAY, "1W")
    return rounded(prices.price_series(_stored(spark, tables_c(spark, sf_dir), PRICES), start=start, end=end))


def price_series_ticker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(prices.price_series(tables_c(spark, sf_dir), ticker=" c000007 "))


def top_gainers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(leaders.top_gainers(tables_c(spark, sf_dir), LAST_DAY, limit=1000))


def top_average_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(leaders.top_average_returns(tables_c(spark, sf_dir), LAST_DAY, 10, 25))


def sector_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(leaders.sector_momentum(tables_c(spark, sf_dir), LAST_DAY, limit=1000))


def source_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        leaders.source_disagreement(
            tables_c(spark, sf_dir), "2024-01-01", LAST_DAY, min_sources=2, limit=1000
        )
    )


def company_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = news.company_news(tables_s(spark, sf_dir, NEWS), lookback_days=30, now=NOW)
    return found.withColumn("sentiment", news.sentiment_label())


def company_news_ticker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news.company_news(
        tables_s(spark, sf_dir, NEWS), "s000003", lookback_days=60, now=NOW
    )


def company_news_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From stored tables, articles and mentions by day and in buckets by article."""
    stored = _stored(spark, tables_s(spark, sf_dir, NEWS), NEWS)
    found = news.company_news(stored, lookback_days=30, now=NOW)
    found = found.withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))
    return found.withColumn("sentiment", news.sentiment_label())


def trending_news_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _stored(spark, tables_s(spark, sf_dir, NEWS), NEWS)
    return rounded(news.trending_news(stored, lookback_days=30, min_articles=5, limit=1000, now=NOW))


def trending_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        news.trending_news(
            tables_s(spark, sf_dir, NEWS), lookback_days=30, min_articles=5, limit=1000, now=NOW
        )
    )


def industry_rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        industries.industry_rotations(
            tables_s(spark, sf_dir, PRICES), "2000-01-01", "2000-12-31", limit=1000
        )
    )


def search_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directory.search_companies(tables_c(spark, sf_dir, LISTING), "c00001", limit=20)


def search_companies_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Looked up by the beginning of stored keys."""
    stored = _stored(spark, tables_c(spark, sf_dir, LISTING), LISTING)
    return directory.search_companies(stored, "c00001", limit=20)


def company_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = directory.company_profile(
        tables_c(spark, sf_dir, (*PRICES, "company_profile", "company_financial_snapshot"))
    )
    return directory.profile_labels(profiles)


def list_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directory.list_sectors(tables_c(spark, sf_dir, ("sector",)))


def sector_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directory.sector_companies(tables_c(spark, sf_dir, LISTING), " ASIA ")


def list_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directory.list_companies(tables_c(spark, sf_dir, LISTING))


def _copies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every line item as a quote of its supplier's month: many differing rows of one feed and day."""
    lines = read(spark, sf_dir, "lineitem")
    feed = F.when(F.col("l_returnflag") == "N", 1).when(F.col("l_returnflag") == "A", 2).otherwise(3)
    daily = lines.select(
        F.col("l_suppkey").alias("company_id"),
        F.trunc("l_shipdate", "MM").alias("trading_date"),
        feed.cast("long").alias("source_id"),
        F.col("l_discount").alias("open"),
        F.col("l_quantity").alias("high"),
        F.col("l_tax").alias("low"),
        F.col("l_extendedprice").alias("close"),
        F.col("l_partkey").alias("volume"),
    )
    feeds = spark.createDataFrame([(1, 2), (2, 1), (3, None)], "source_id long, priority_rank int")
    return daily, feeds


def primary_price_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All quotes of the row taken, and its close alone: both are of the same row."""
    daily, feeds = _copies(spark, sf_dir)
    alone = prices.primary_price(daily, feeds, columns=("close",)).withColumnRenamed("close", "close_alone")
    return prices.primary_price(daily, feeds).join(alone, ["company_id", "trading_date"])


def latest_trade_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily, feeds = _copies(spark, sf_dir)
    two_steps = prices.latest_trade(prices.primary_price(daily, feeds))
    names = {c: f"{c}_two_steps" for c in two_steps.columns if c != "company_id"}
    return prices.latest_primary_trade(daily, feeds).join(two_steps.withColumnsRenamed(names), "company_id")


QUERIES = {
    f.__name__: f
    for f in (
        primary_price,
        latest_trade,
        latest_primary_trade,
        primary_price_copies,
        latest_trade_copies,
        sector_benchmark,
        sector_price_rank,
        sector_price_rank_banded,
        moving_average,
        daily_return,
        price_series,
        price_series_1w,
        price_series_stored,
        price_series_ticker,
        top_gainers,
        top_average_returns,
        sector_momentum,
        source_disagreement,
        company_news,
        company_news_ticker,
        company_news_stored,
        trending_news,
        trending_news_stored,
        industry_rotations,
        search_companies,
        search_companies_stored,
        company_profile,
        list_sectors,
        sector_companies,
        list_companies,
    )
}
