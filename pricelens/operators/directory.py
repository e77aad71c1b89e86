"""Company search, listings and profiles."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.functions.companies import only_ids, with_ticker
from pricelens.functions.params import optional_ticker, positive_int, required_text
from pricelens.operators.prices import latest_primary_trade
from pricelens.tables import Tables, listed_companies

LISTING_COLUMNS = ("company_id", "ticker", "company_name", "industry_name", "sector_name")


def _starts_with(text: str) -> str:
    """Prefix pattern; `%` and `_` of the text stay wildcards, a backslash escapes any sign."""
    return re.sub(
        r"\\(.)", lambda m: m[0] if m[1] in "%_\\" else m[1], text + "%", flags=re.DOTALL
    )


def _beginning(pattern: str) -> str:
    """What a pattern starts with before its first wildcard, without escapes."""
    found = re.match(r"(?:[^\\%_]|\\.)*", pattern, flags=re.DOTALL)[0]
    return re.sub(r"\\(.)", r"\1", found, flags=re.DOTALL)


def _looked_up(lookup: DataFrame, text: str, limit: int) -> DataFrame:
    """company_id and place of the first `limit` companies whose ticker or name starts with `text`.

    The keys lie in order and the beginning reaches the scan, so only the parts of the files that hold it are read.
    """
    pattern = _starts_with(text).lower()
    key = F.col("key")
    place = F.when(F.col("is_name"), 2).when(F.col("ticker") == F.lit(text.upper()), 0).otherwise(1)
    found = lookup.filter(key.startswith(_beginning(pattern))).filter(key.like(pattern))
    return (
        found.select("company_id", "ticker", place.alias("place"))
        .groupBy("company_id", "ticker")
        .agg(F.min("place").alias("place"))
        .orderBy("place", F.col("ticker").asc_nulls_last(), "company_id")
        .limit(limit)
        .select("company_id", "place")
    )


def search_companies(tables: Tables, q, limit=20) -> DataFrame:
    """Companies whose ticker or name starts with `q`: exact ticker, ticker prefix, name prefix.

    Tables that `store_tables` wrote are looked up by the beginning; of others every company is compared.
    """
    required_text(q, "q")
    limit = positive_int(limit, 20, "limit")
    text = q.strip(" ")
    if tables.company_lookup is not None:
        found = _looked_up(tables.company_lookup, text, limit)
        places = {r["company_id"]: r["place"] for r in found.collect()}  # at most `limit`
        ids = [F.lit(x) for item in places.items() for x in item]
        place = F.element_at(F.create_map(*ids), F.col("company_id")) if ids else F.lit(0)
        listed = listed_companies(tables, "left").filter(F.col("company_id").isin(list(places)))
    else:
        by_ticker = F.col("ticker").ilike(_starts_with(text.upper()))
        by_name = F.col("company_name").ilike(_starts_with(text))
        place = (
            F.when(F.col("ticker") == F.lit(text.upper()), 0).when(by_ticker, 1).otherwise(2)
        )
        listed = listed_companies(tables, "left").filter(by_ticker | by_name)
    return (
        listed.withColumn("place", place)
        .orderBy("place", F.col("ticker").asc_nulls_last(), "company_id")
        .limit(limit)
        .select(*LISTING_COLUMNS)
    )


def list_sectors(tables: Tables) -> DataFrame:
    return tables.sector.select("sector_id", "sector_name").orderBy(
        F.col("sector_name").asc_nulls_last()
    )


def sector_companies(tables: Tables, sector_name, limit=500) -> DataFrame:
    """Companies of one sector by ticker; the name must match exactly after trimming."""
    name = required_text(sector_name, "sector")
    limit = positive_int(limit, 500, "limit")
    return (
        listed_companies(tables)
        .filter(F.col("sector_name") == F.lit(name))
        .orderBy(F.col("ticker").asc_nulls_last(), "company_id")
        .limit(limit)
        .select(*LISTING_COLUMNS)
    )


def list_companies(tables: Tables, limit=200) -> DataFrame:
    """Companies by ticker, classified or not."""
    limit = positive_int(limit, 200, "limit")
    return (
        listed_companies(tables, "left")
        .orderBy(F.col("ticker").asc_nulls_last(), "company_id")
        .limit(limit)
        .select(*LISTING_COLUMNS)
    )


def company_profile(tables: Tables, ticker=None) -> DataFrame:
    """Company, profile, financial snapshot and latest trade in one row, missing parts null."""
    ticker = optional_ticker(ticker)
    prices = tables.price_daily
    if ticker is not None:
        prices = only_ids(prices, with_ticker(tables.company, ticker))
    profile = tables.company_profile.select(
        "company_id",
        "short_name",
        "long_name",
        "city",
        "state",
        "country",
        "long_business_summary",
        F.col("current_price").alias("profile_current_price"),
        F.col("market_cap").alias("profile_market_cap"),
        F.col("ebitda").alias("profile_ebitda"),
        F.col("revenue_growth").alias("profile_revenue_growth"),
        F.col("weight").alias("sp500_weight"),
    )
    snapshot = tables.company_financial_snapshot.select(
        "company_id",
        F.col("price").alias("snapshot_price"),
        "price_earnings",
        "dividend_yield",
        "earnings_share",
        "week_52_low",
        "week_52_high",
        F.col("market_cap").alias("snapshot_market_cap"),
        F.col("ebitda").alias("snapshot_ebitda"),
        "price_sales",
        "price_book",
        "sec_filings",
    )
    return (
        with_ticker(listed_companies(tables, "left"), ticker)
        .join(profile, "company_id", "left")
        .join(snapshot, "company_id", "left")
        .join(latest_primary_trade(prices, tables.price_source), "company_id", "left")
        .select(
            "company_id",
            "ticker",
            "company_name",
            "exchange",
            "cik",
            "industry_name",
            "sector_name",
            *profile.columns[1:],
            *snapshot.columns[1:],
            "latest_trading_date",
            "latest_close",
            "latest_volume",
        )
    )


def profile_labels(profiles: DataFrame) -> DataFrame:
    """Adds the figures a profile page shows.

    Market cap and EBITDA come from the snapshot, from the profile where that is null or 0. The
    location joins what is known of city, state and country. The 52-week range needs both ends.
    """
    both = F.col("week_52_low").isNotNull() & F.col("week_52_high").isNotNull()
    place = F.concat_ws(
        ", ", *[F.nullif(F.col(c), F.lit("")) for c in ("city", "state", "country")]
    )

    def first_known(name):
        own = F.nullif(F.col(f"snapshot_{name}"), F.lit(0.0))
        return F.coalesce(own, f"profile_{name}")

    return profiles.withColumns(
        {
            "market_cap": first_known("market_cap"),
            "ebitda": first_known("ebitda"),
            "location": F.nullif(place, F.lit("")),
            "range_52_week_low": F.when(both, F.col("week_52_low")),
            "range_52_week_high": F.when(both, F.col("week_52_high")),
        }
    )
