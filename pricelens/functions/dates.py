"""Date slices of the price table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def between(prices: DataFrame, start: dt.date | None, end: dt.date | None) -> DataFrame:
    """Rows of the inclusive range; bounds are literals, so the scan can skip files by them.

    A table stored by `save_prices` also carries the month, and whole folders are skipped.
    """
    monthly = "trading_month" in prices.columns
    if start is not None:
        prices = prices.filter(F.col("trading_date") >= F.lit(start))
        if monthly:
            prices = prices.filter(F.col("trading_month") >= F.lit(start.replace(day=1)))
    if end is not None:
        prices = prices.filter(F.col("trading_date") <= F.lit(end))
        if monthly:
            prices = prices.filter(F.col("trading_month") <= F.lit(end.replace(day=1)))
    return prices


# How far back each probe of `latest_date` reaches, in days.
_REACH = (31, 372, 3720)


def latest_date(prices: DataFrame, upto: dt.date | None = None) -> dt.date | None:
    """Newest trading date, not after `upto` when that is given.

    Probes short ranges before `upto` first: on a table of many years the answer nearly always
    lies in the last month, and only that month is read. One date comes back to the driver,
    which makes the bounds of the main query plain literals.
    """
    newest = F.max("trading_date")
    end = upto
    if upto is not None:
        for days in _REACH:
            start = dt.date.fromordinal(max(1, upto.toordinal() - days))
            found = between(prices, start, end).agg(newest).first()[0]
            if found is not None:
                return found
            end = start
    return between(prices, None, end).agg(newest).first()[0]
