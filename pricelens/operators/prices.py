"""Daily prices: one best feed per company and day, and the series built on it.

After `primary_price` a company has at most one row per calendar day, so a window over one company
is bounded by the length of the calendar. A sector on one day is ranked by its different closes
(`sector_position`), so copies of a price, or companies without one, weigh nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelens.functions.companies import with_ticker
from pricelens.functions.dates import between
from pricelens.functions.params import optional_date, optional_ticker
from pricelens.functions.scratch import scratch
from pricelens.functions.size import at_most
from pricelens.tables import Tables, listed_companies

QUOTES = ("open", "high", "low", "close", "adj_close", "volume")
# Up to this many feeds their places are broadcast, two numbers each.
MAX_FEEDS = 1_000_000

def ordered_feeds(price_source: DataFrame) -> DataFrame:
    """source_id with its place in the priority order, 1 = best, unranked feeds last.

    The window has no partition: the table has one row per feed.
    """
    place = Window.orderBy(F.col("priority_rank").asc_nulls_last(), "source_id")
    return price_source.select("source_id", F.row_number().over(place).alias("feed_order"))


def _with_feeds(prices: DataFrame, price_source: DataFrame) -> DataFrame:
    """Prices with their feed's place, feeds broadcast if they are few.

    There are few different feeds, so a shuffle by feed would bring most prices into a few tasks. Spark does not know
    the size of every table that is handed in, so it is checked.
    """
    feeds = ordered_feeds(price_source)
    return prices.join(F.broadcast(feeds) if at_most(price_source, MAX_FEEDS) else feeds, "source_id")


def choice(columns) -> Column:
    """What is smallest for the row to take: its feed's place, then its quotes, whatever else is asked for.

    Rows of one feed that differ are put in order by all quotes the table has, nulls first, so every
    operator takes the same one. Only equal rows tie.
    """
    return F.struct("feed_order", *[c for c in QUOTES if c in columns])


def primary_price(
    price_daily: DataFrame,
    price_source: DataFrame,
    start=None,
    end=None,
    columns=QUOTES,
) -> DataFrame:
    """The row of the best feed per company and day, also when its close is null.

    Each task keeps one row per company and day before the shuffle. `columns` are the quotes to
    return; the choice reads all of them. Feeds without a `price_source` row are left out.
    """
    prices = between(price_daily, optional_date(start, "start"), optional_date(end, "end"))
    return (
        _with_feeds(prices, price_source)
        .groupBy("company_id", "trading_date")
        .agg(F.min(choice(prices.columns)).alias("best"))
        .select(
            "company_id",
            "trading_date",
            *[F.col(f"best.{c}") for c in columns if c in prices.columns],
        )
    )


def latest_trade(primary: DataFrame) -> DataFrame:
    """Date, close and volume of the newest row per company."""
    return primary.groupBy("company_id").agg(
        F.max("trading_date").alias("latest_trading_date"),
        F.max_by("close", "trading_date").alias("latest_close"),
        F.max_by("volume", "trading_date").alias("latest_volume"),
    )


def latest_primary_trade(price_daily: DataFrame, price_source: DataFrame) -> DataFrame:
    """`latest_trade(primary_price(...))` in one aggregate straight from the raw feeds.

    The newest day wins, then the row `primary_price` takes. Each task sends one row per company
    instead of one per company and day.
    """
    newest_first = (-F.unix_date("trading_date")).alias("age")
    first = F.struct(newest_first, choice(price_daily.columns).alias("row"), "trading_date")
    return (
        _with_feeds(price_daily, price_source)
        .groupBy("company_id")
        .agg(F.min(first).alias("newest"))
        .select(
            "company_id",
            F.col("newest.trading_date").alias("latest_trading_date"),
            F.col("newest.row.close").alias("latest_close"),
            F.col("newest.row.volume").alias("latest_volume"),
        )
    )


def daily_return(close="close") -> Column:
    """Change against the company's previous row as a fraction; null after a zero or null close."""
    days = Window.partitionBy("company_id").orderBy("trading_date")
    return F.col(close) / F.nullif(F.lag(close).over(days), F.lit(0.0)) - 1


def moving_average(rows: int, close="close") -> Column:
    """Mean close of the company's last `rows` rows, this one included; nulls are skipped."""
    days = Window.partitionBy("company_id").orderBy("trading_date")
    return F.avg(close).over(days.rowsBetween(1 - rows, 0))


def with_daily_return(prices: DataFrame) -> DataFrame:
    return prices.withColumn("daily_return", daily_return())


def with_moving_average(prices: DataFrame, rows: int) -> DataFrame:
    return prices.withColumn(f"ma_{rows}_day", moving_average(rows))


# Up to this many companies their ids are broadcast, two numbers each; beyond, the join is a plain one.
MAX_COMPANIES = 1_000_000
# Up to this many companies their names are broadcast as well.
MAX_NAMES = 200_000


def _sector_ids(companies: DataFrame, max_companies: int) -> DataFrame:
    """company_id and sector_id, broadcast if there are few companies."""
    ids = companies.select("company_id", "sector_id")
    return F.broadcast(ids) if at_most(ids, max_companies) else ids


def sector_benchmark(primary: DataFrame, companies: DataFrame) -> DataFrame:
    """Mean close per sector and day. `companies` holds company_id and sector_id."""
    return (
        primary.join(_sector_ids(companies, MAX_COMPANIES), "company_id")
        .groupBy("sector_id", "trading_date")
        .agg(F.avg("close").alias("sector_avg_close"))
    )


_DAY = ("sector_id", "trading_date")


def sector_position(
    prices: DataFrame, companies: DataFrame, max_companies: int = MAX_COMPANIES
) -> DataFrame:
    """Adds sector_id, sector_avg_close and sector_price_rank to rows of company, day and close.

    `companies` holds company_id and sector_id. Prices of companies not in it are left out. Equal closes of a sector and
    day, null ones too, are one row with a count before anything is ranked. With up to `max_companies` companies a
    window holds a day's different closes, which are no more; beyond, they are ranked in bands (`_banded`).
    """
    few = at_most(companies.select("company_id"), max_companies)
    ids = companies.select("company_id", "sector_id")
    rows = prices.join(F.broadcast(ids) if few else ids, "company_id")
    closes = rows.groupBy(*_DAY, "close").agg(F.count("*").alias("rows"))
    placed = _windowed(closes) if few else _banded(closes)
    placed = placed.select(
        *[F.col(c).alias(f"_{c}") for c in (*_DAY, "close")], "sector_price_rank", "sector_avg_close"
    )
    same = [rows[c].eqNullSafe(placed[f"_{c}"]) for c in (*_DAY, "close")]
    return rows.join(placed, same).drop(*[f"_{c}" for c in (*_DAY, "close")])


def _before(*keys) -> Column:
    """Rows above a close among those of the keys, 0 for the highest."""
    higher = Window.partitionBy(*keys).orderBy(F.col("close").desc_nulls_last())
    return F.coalesce(F.sum("rows").over(higher.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _windowed(closes: DataFrame) -> DataFrame:
    """Rank and mean of a sector's day from its different closes, which one task holds."""
    of_day = Window.partitionBy(*_DAY)
    known = F.sum(F.when(F.col("close").isNotNull(), F.col("rows"))).over(of_day)
    return closes.select(
        *_DAY,
        "close",
        (_before(*_DAY) + 1).cast("int").alias("sector_price_rank"),
        (F.sum(F.col("close") * F.col("rows")).over(of_day) / known).alias("sector_avg_close"),
    )


def _banded(closes: DataFrame) -> DataFrame:
    """The same with no task for a whole day.

    The closes are dealt out by range of sector, day and close, so a day that is too much for one task lies in several,
    one after the other. Each of these bands ranks its own closes and starts where the bands before it end; only the
    bands' sums are put in order. The bands are a stored table, so that sums and ranks are of the same bands, also after
    an executor is lost.
    """
    spark = closes.sparkSession
    dealt = closes.repartitionByRange(*_DAY, F.col("close").desc_nulls_last())
    dealt = dealt.withColumn("band", F.spark_partition_id())
    path = f"{scratch(spark)}/closes"
    dealt.write.parquet(path)
    bands = spark.read.schema(dealt.schema).parquet(path)
    sums = bands.groupBy(*_DAY, "band").agg(
        F.sum("rows").alias("in_band"),
        F.sum(F.col("close") * F.col("rows")).alias("total"),
        F.sum(F.when(F.col("close").isNotNull(), F.col("rows"))).alias("known"),
    )
    of_day = Window.partitionBy(*_DAY)
    earlier = of_day.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        *_DAY,
        "band",
        F.coalesce(F.sum("in_band").over(earlier), F.lit(0)).alias("start"),
        (F.sum("total").over(of_day) / F.sum("known").over(of_day)).alias("sector_avg_close"),
    )
    ranked = bands.withColumn("before", _before(*_DAY, "band"))
    keys = (*_DAY, "band")
    same = [ranked[c].eqNullSafe(starts[c]) for c in keys]
    return ranked.join(starts, same).select(
        *[ranked[c] for c in _DAY],
        "close",
        (F.col("start") + F.col("before") + 1).cast("int").alias("sector_price_rank"),
        "sector_avg_close",
    )


def sector_price_rank(
    primary: DataFrame, companies: DataFrame, max_companies: int = MAX_COMPANIES
) -> DataFrame:
    """Rank of the close inside sector and day, highest first, null closes last."""
    closes = primary.select("company_id", "trading_date", "close")
    return sector_position(closes, companies, max_companies).select(
        "sector_id", "trading_date", "company_id", "sector_price_rank"
    )


SERIES_COLUMNS = (
    "company_name",
    "ticker",
    "sector_name",
    "industry_name",
    "trading_date",
    *QUOTES,
    "daily_return_pct",
    "ma_7_day",
    "ma_30_day",
    "sector_avg_close",
    "sector_price_rank",
)


def _with_history(prices: DataFrame) -> DataFrame:
    """Adds what depends on a company's earlier rows."""
    return prices.withColumns(
        {
            "daily_return_pct": daily_return() * 100,
            "ma_7_day": moving_average(7),
            "ma_30_day": moving_average(30),
        }
    )


def price_series(tables: Tables, ticker=None, start=None, end=None) -> DataFrame:
    """Quotes with daily return, moving averages, sector average and rank in the sector.

    Windows see only rows inside the date range. Companies without industry or sector are left
    out. One ticker comes sorted by day; the series of all companies comes unsorted, as sorting
    it would be one more shuffle of the whole result.
    """
    ticker = optional_ticker(ticker)
    start, end = optional_date(start, "start"), optional_date(end, "end")
    listed = companies = listed_companies(tables)
    daily = tables.price_daily
    if ticker is not None:
        companies = with_ticker(listed, ticker)
        listed = listed.join(companies.select("sector_id"), "sector_id", "left_semi")
        daily = daily.join(_sector_ids(listed, MAX_COMPANIES), "company_id", "left_semi")
    names = companies.select(
        "company_id", "company_name", "ticker", "sector_name", "industry_name"
    )
    few_names = at_most(names, MAX_NAMES)
    primary = primary_price(daily, tables.price_source, start, end)
    if ticker is None:
        # Before the join by sector and day, so that rows stored by company need not move for these windows.
        primary = _with_history(primary)
        if not few_names:
            primary = primary.join(names, "company_id")
        placed = sector_position(primary, listed)
    else:
        # An inner join stays above the choice of feeds, so ranks and quotes share one scan of the sector.
        placed = sector_position(primary, listed).join(companies.select("company_id"), "company_id")
        placed = _with_history(placed)
    if few_names or ticker is not None:
        placed = placed.join(F.broadcast(names) if few_names else names, "company_id")
    result = placed.select(*SERIES_COLUMNS)
    return result if ticker is None else result.orderBy("trading_date")
