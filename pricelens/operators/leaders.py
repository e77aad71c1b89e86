"""Leaderboards: gainers, average returns, sector momentum and feed disagreement.

Ranks come after the row limit where that gives the same number: every row that ranks above a
row of the top k is in the top k as well. So no task ever ranks a whole sector or all companies.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricelens.functions.dates import between, latest_date
from pricelens.functions.params import optional_date, positive_int, required_date
from pricelens.functions.size import MAX_SECTORS, skewed_join
from pricelens.functions.windows import first_rows
from pricelens.operators.prices import daily_return, primary_price
from pricelens.tables import Tables, listed_companies


def top_gainers(tables: Tables, trading_date, limit=10) -> DataFrame:
    """Companies whose last daily change beats the mean change of their sector.

    The day is the newest one not after `trading_date`; a company's newest row may be up to ten
    days older.
    """
    asked = required_date(trading_date, "trading_date")
    limit = positive_int(limit, 10, "limit")
    anchor = latest_date(tables.price_daily, asked) or asked
    closes = primary_price(
        tables.price_daily,
        tables.price_source,
        anchor - dt.timedelta(days=10),
        anchor,
        columns=("close",),
    )
    newest = Window.partitionBy("company_id").orderBy(F.desc("trading_date"))
    change = (F.col("close") / F.nullif(F.col("prev_close"), F.lit(0.0)) - 1) * 100
    paired = (
        closes.withColumn("place", F.row_number().over(newest))
        .withColumn("prev_close", F.lead("close").over(newest))
        .withColumn("prev_trading_date", F.lead("trading_date").over(newest))
        .filter("place = 1 and prev_trading_date is not null")
        .withColumn("pct_change", change)
        .join(listed_companies(tables), "company_id")
    )
    averages = paired.groupBy("sector_id").agg(F.avg("pct_change").alias("avg_sector_change"))
    order = [F.desc("pct_change"), F.asc("ticker"), F.asc("company_id")]
    best = (
        skewed_join(paired, averages, "sector_id", tables.sector, MAX_SECTORS)
        .filter("pct_change > avg_sector_change")
        .orderBy(*order)
        .limit(limit)
    )
    in_sector = Window.partitionBy("sector_id").orderBy(F.desc("pct_change"))
    return (
        best.withColumn("sector_rank", F.rank().over(in_sector))
        .orderBy(*order)
        .select(
            "ticker",
            "company_name",
            "sector_name",
            "industry_name",
            "trading_date",
            "prev_trading_date",
            "close",
            "prev_close",
            "pct_change",
            "avg_sector_change",
            "sector_rank",
        )
    )


def top_average_returns(
    tables: Tables, end_date=None, min_observations=10, limit=5, today=None
) -> DataFrame:
    """Companies by mean daily return (a fraction) over the 30 days up to the anchor.

    The anchor is the newest day not after `end_date` or today, else the newest day of all.
    """
    asked = optional_date(end_date, "end_date") or optional_date(today, "today")
    min_observations = positive_int(min_observations, 10, "min_observations")
    limit = positive_int(limit, 5, "limit")
    asked = asked or dt.date.today()
    known = tables.price_daily.join(
        tables.price_source.select("source_id"), "source_id", "left_semi"
    )
    anchor = latest_date(known, asked) or latest_date(known) or asked
    closes = primary_price(
        tables.price_daily,
        tables.price_source,
        anchor - dt.timedelta(days=30),
        anchor,
        columns=("close",),
    )
    stats = (
        closes.withColumn("daily_return", daily_return())
        .groupBy("company_id")
        .agg(
            F.avg("daily_return").alias("avg_daily_return"),
            F.stddev_samp("daily_return").alias("return_volatility"),
            F.count("daily_return").alias("n_obs"),
        )
        .filter(F.col("n_obs") >= min_observations)
    )
    order = [F.desc("avg_daily_return"), F.asc("ticker"), F.asc("company_id")]
    best = stats.join(listed_companies(tables), "company_id").orderBy(*order).limit(limit)
    overall = Window.orderBy(F.desc("avg_daily_return"))
    return (
        best.withColumn("return_rank", F.rank().over(overall))
        .orderBy("return_rank", "ticker", "company_id")
        .select(
            "ticker",
            "company_name",
            "industry_name",
            "sector_name",
            "avg_daily_return",
            "return_volatility",
            "n_obs",
            "return_rank",
        )
    )


def sector_momentum(
    tables: Tables, as_of=None, sector_name=None, limit=200, today=None
) -> DataFrame:
    """Companies whose return over seven rows beats the mean of their sector on the anchor day.

    The anchor is the newest day not after `as_of` or today; without one the result is empty.
    A null return (zero or null close) ranks before all others and is not shown.
    """
    asked = optional_date(as_of, "as_of") or optional_date(today, "today") or dt.date.today()
    limit = positive_int(limit, 200, "limit")
    anchor = latest_date(tables.price_daily, asked) or asked
    companies = listed_companies(tables)
    if sector_name is not None and str(sector_name).strip():
        companies = companies.filter(F.col("sector_name") == F.lit(str(sector_name)))
    closes = primary_price(
        tables.price_daily,
        tables.price_source,
        anchor - dt.timedelta(days=20),
        anchor,
        columns=("close",),
    )
    days = Window.partitionBy("company_id").orderBy("trading_date")
    change = (F.col("close") / F.nullif(F.col("close_7d_ago"), F.lit(0.0)) - 1) * 100
    returns = (
        closes.withColumn("close_7d_ago", F.lag("close", 7).over(days))
        .filter((F.col("trading_date") == F.lit(anchor)) & F.col("close_7d_ago").isNotNull())
        .withColumn("return_7d", change)
        .join(companies, "company_id")
    )
    sectors = returns.groupBy("sector_id").agg(
        F.avg("return_7d").alias("avg_sector_return"),
        F.count_if(F.col("return_7d").isNull()).alias("nulls_first"),
    )
    compared = skewed_join(returns, sectors, "sector_id", tables.sector, MAX_SECTORS)
    above = compared.filter("return_7d > avg_sector_return")
    # Only the best `limit` of each sector can be shown. They rank after the sector's null
    # returns and then among themselves.
    order = [F.desc("return_7d"), F.asc("ticker"), F.asc("company_id")]
    in_sector = Window.partitionBy("sector_id").orderBy(F.desc("return_7d"))
    return (
        first_rows(above, ["sector_id"], order, limit)
        .withColumn("sector_rank", (F.rank().over(in_sector) + F.col("nulls_first")).cast("int"))
        .orderBy("sector_name", "sector_rank", "ticker", "company_id")
        .limit(limit)
        .select(
            "ticker",
            "company_name",
            "industry_name",
            "sector_name",
            F.col("trading_date").alias("as_of_date"),
            "return_7d",
            "avg_sector_return",
            "sector_rank",
        )
    )


def source_disagreement(tables: Tables, start, end, min_sources=2, limit=50) -> DataFrame:
    """Each company's day with the widest relative gap between the closes of its feeds.

    `n_sources` counts rows with a close. Companies without industry take part.
    """
    start, end = required_date(start, "start"), required_date(end, "end")
    min_sources = positive_int(min_sources, 2, "min_sources")
    limit = positive_int(limit, 50, "limit")
    spread = F.col("max_close") - F.col("min_close")
    days = (
        between(tables.price_daily, start, end)
        .filter(F.col("close").isNotNull())
        .groupBy("company_id", "trading_date")
        .agg(
            F.count("*").alias("n_sources"),
            F.min("close").alias("min_close"),
            F.max("close").alias("max_close"),
            F.avg("close").alias("mean_close"),
        )
        .filter(F.col("n_sources") >= min_sources)
        .withColumn("close_spread", spread)
        .withColumn("pct_spread", spread / F.nullif(F.col("mean_close"), F.lit(0.0)) * 100)
    )
    widest = [F.desc_nulls_last("pct_spread"), F.desc_nulls_last("close_spread")]
    return (
        first_rows(days, ["company_id"], [*widest, F.desc("trading_date")], 1)
        .join(tables.company.select("company_id", "ticker", "company_name"), "company_id")
        .orderBy(*widest, F.asc("ticker"), F.asc("company_id"))
        .limit(limit)
        .select(
            "ticker",
            "company_name",
            "trading_date",
            "n_sources",
            "min_close",
            "max_close",
            "close_spread",
            "pct_spread",
        )
    )
