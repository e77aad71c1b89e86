"""Cleaning rules for raw tables of text columns.

The rules look at one input file at a time. A frame of many files carries `source_file`, which
is part of every duplicate key, so one job cleans them all; `scope="dataset"` drops that border.
Where a rule keeps the first of several rows, the order is the stated one and then all other
columns, never the order in which Spark happens to read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.functions.projection import computed_once
from pricelens.functions.text import (
    DATE_FORMATS,
    MISSING_TEXTS,
    normalize_ticker,
    null_if_in,
    parse_number,
    parse_timestamp,
    snake_case,
    strip,
)
from pricelens.functions.windows import first_rows

PROVENANCE = "source_file"

# Column names and name parts the rules look for.
DATE_PARTS = ("date", "published", "time", "timestamp")
TICKER_PARTS = ("ticker", "symbol")
PRICE_MARKERS = {"open", "high", "low", "close"}
NEWS_MARKERS = {"title", "url", "published_at"}
COMPANY_MARKERS = {"sector", "industry", "company_name", "ticker", "symbol"}
PRICE_REQUIRED = ("date", "trading_date", "close", "volume")
PRICE_NUMBERS = ("open", "high", "low", "close", "adj_close", "adjusted_close", "volume")
PRICE_ORDER = ("ticker", "symbol", "date", "trading_date")
NEWS_ORDER = ("published_at", "date", "published_date")


def _data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != PROVENANCE]


def _texts(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t == "string" and c != PROVENANCE]


def _present(df: DataFrame, names) -> list[str]:
    return [c for c in names if c in df.columns]


def _file_key(df: DataFrame, scope: str) -> list[str]:
    if scope not in ("file", "dataset"):
        raise ValueError("scope must be 'file' or 'dataset'")
    return _present(df, [PROVENANCE]) if scope == "file" else []


def _first_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key; each task keeps one candidate per key before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    sort = [F.asc_nulls_last(c) for c in [*order, *rest]] or [F.lit(0)]
    return first_rows(df, keys, sort, 1)


def snake_case_columns(df: DataFrame) -> DataFrame:
    """Snake-case names; a name that comes up again gets `_2`, `_3`, ..."""
    names, taken = [], {}
    for column in df.columns:
        name = snake_case(column)
        taken[name] = taken.get(name, 0) + 1
        names.append(name if taken[name] == 1 else f"{name}_{taken[name]}")
    return df.toDF(*names)


def normalize_strings(df: DataFrame) -> DataFrame:
    """Strip the text columns; `nan`, `None` and `NaT` become null."""
    stripped = computed_once(df, {c: strip(c) for c in _texts(df)})
    return computed_once(stripped, {c: null_if_in(c, MISSING_TEXTS) for c in _texts(df)})


def is_date_name(name: str, match: str = "token") -> bool:
    """Whether a column holds dates by its name.

    `token` wants a whole word of the name (`published_at`), `substring` any part of it, which
    also hits `sentiment` through `time`.
    """
    if match == "token":
        return not {*DATE_PARTS, "datetime"}.isdisjoint(name.split("_"))
    if match == "substring":
        return any(part in name for part in DATE_PARTS)
    raise ValueError("match must be 'token' or 'substring'")


def parse_date_columns(df: DataFrame, match: str = "token", formats=DATE_FORMATS) -> DataFrame:
    """Text columns with a date name as timestamps, unreadable values null."""
    dates = [c for c in _texts(df) if is_date_name(c, match)]
    return computed_once(df, {c: parse_timestamp(c, formats) for c in dates})


def normalize_ticker_columns(df: DataFrame) -> DataFrame:
    tickers = [c for c in _texts(df) if any(part in c for part in TICKER_PARTS)]
    return computed_once(df, {c: normalize_ticker(c) for c in tickers})


def drop_exact_duplicates(df: DataFrame, scope: str = "file") -> DataFrame:
    """One of each set of equal rows; the copies collapse in each task before the shuffle."""
    if PROVENANCE in df.columns and not _file_key(df, scope):
        return (
            df.groupBy(*_data_columns(df))
            .agg(F.min(PROVENANCE).alias(PROVENANCE))
            .select(*df.columns)
        )
    return df.dropDuplicates()


def classify_table(columns) -> str:
    """`price`, `news`, `company` or `generic` by the column names, first hit wins."""
    names = set(columns)
    for kind, markers in (
        ("price", PRICE_MARKERS),
        ("news", NEWS_MARKERS),
        ("company", COMPANY_MARKERS),
    ):
        if names & markers:
            return kind
    return "generic"


def clean_price(df: DataFrame) -> DataFrame:
    """Rows with the required fields and no negative number.

    Required fields are checked as text, before the numbers are read, so a row with an
    unreadable close stays, with a null close.
    """
    required = _present(df, PRICE_REQUIRED)
    numbers = _present(df, PRICE_NUMBERS)
    kept = df.dropna(subset=required) if required else df
    types = dict(df.dtypes)
    texts = [c for c in numbers if types[c] == "string"]
    kept = computed_once(kept, {c: parse_number(c) for c in texts})
    for column in numbers:
        kept = kept.filter(F.coalesce(F.col(column) >= 0, F.lit(True)))
    return kept


def clean_company(df: DataFrame, scope: str = "file") -> DataFrame:
    """First row per ticker, else per symbol, else distinct rows."""
    for key in ("ticker", "symbol"):
        if key in df.columns:
            return _first_per(df, [*_file_key(df, scope), key], [])
    return drop_exact_duplicates(df, scope)


def clean_news(df: DataFrame, scope: str = "file") -> DataFrame:
    """Oldest row per url, else per title and time, else distinct rows. Null keys are equal."""
    if "url" in df.columns:
        key = ["url"]
    elif {"title", "published_at"} <= set(df.columns):
        key = ["title", "published_at"]
    else:
        return drop_exact_duplicates(df, scope)
    order = [c for c in _present(df, NEWS_ORDER) if c not in key]
    return _first_per(df, [*_file_key(df, scope), *key], order)


def clean_generic(df: DataFrame, scope: str = "file") -> DataFrame:
    return drop_exact_duplicates(df, scope)


def clean_order(df: DataFrame) -> list:
    """Sort order of a cleaned table: by ticker and day, by time, else by the duplicate key.

    Kept out of the cleaning itself; the writers sort once, when they write.
    """
    kind = classify_table(_data_columns(df))
    if kind == "price":
        first = _present(df, PRICE_ORDER)
    elif kind == "news":
        first = _present(df, NEWS_ORDER)
    elif kind == "company":
        first = _present(df, ("ticker", "symbol"))[:1]
    else:
        first = []
    rest = [c for c in _data_columns(df) if c not in first]
    return [F.asc_nulls_last(c) for c in [*first, *rest]]


def basic_clean(
    df: DataFrame, match: str = "token", formats=DATE_FORMATS, scope: str = "file"
) -> tuple[DataFrame, str]:
    """All rules in order; returns the cleaned rows and the kind of table."""
    df = (
        df.transform(snake_case_columns)
        .transform(normalize_strings)
        .transform(parse_date_columns, match, formats)
        .transform(normalize_ticker_columns)
        .transform(drop_exact_duplicates, scope)
    )
    kind = classify_table(_data_columns(df))
    if kind == "price":
        return clean_price(df), kind
    if kind == "news":
        return clean_news(df, scope), kind
    if kind == "company":
        return clean_company(df, scope), kind
    # Distinct rows are what the duplicate rule left.
    return df, kind
