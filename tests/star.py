"""Small star schemas for the unit tests."""

from __future__ import annotations

import datetime as dt

from pricelens.tables import SCHEMAS, Tables

SECTORS = [(1, "Technology"), (2, "Energy")]
INDUSTRIES = [(10, "Software", 1), (11, "Chips", 1), (20, "Oil", 2)]
SOURCES = [(1, 1), (2, 2), (3, None)]


def day(text):
    return dt.date.fromisoformat(text)


def days(first, count):
    return [day(first) + dt.timedelta(days=i) for i in range(count)]


def company(company_id, ticker, industry_id=10, name=None):
    return (company_id, ticker, name or f"{ticker} Inc.", "NYSE", f"{company_id:010d}", industry_id)


def price(company_id, date, close, source_id=1, volume=100):
    date = day(date) if isinstance(date, str) else date
    return (company_id, source_id, date, close, close, close, close, close, volume)


def tables(spark, **rows):
    rows = {"sector": SECTORS, "industry": INDUSTRIES, "price_source": SOURCES, **rows}
    return Tables(**{n: spark.createDataFrame(r, SCHEMAS[n]) for n, r in rows.items()})


def dicts(df):
    return [r.asDict() for r in df.collect()]
