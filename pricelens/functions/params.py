"""Argument rules. Bad arguments raise ValueError; blank optional ones take their default."""

from __future__ import annotations

import datetime as dt
import re

_ISO = re.compile(r"\d{4}-\d{2}-\d{2}")

# Days back from the end date for each range key.
RANGE_DAYS = {"1W": 7, "2W": 14, "1M": 30, "3M": 90, "6M": 180, "1Y": 365, "5Y": 1825}
MAX_START = dt.date(1970, 1, 4)


def positive_int(value, default: int, name: str) -> int:
    if value is None or value == "":
        return default
    try:
        number = float(value)
    except (TypeError, ValueError):
        number = None
    if isinstance(value, bool) or number is None or number != number or number <= 0 or number % 1:
        raise ValueError(f"{name} must be a positive integer")
    return int(number)


def optional_date(value, name: str) -> dt.date | None:
    if value is None or value == "":
        return None
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    if not isinstance(value, str) or not _ISO.fullmatch(value):
        raise ValueError(f"{name} must be YYYY-MM-DD")
    try:
        return dt.date.fromisoformat(value)
    except ValueError:
        raise ValueError(f"{name} must be YYYY-MM-DD") from None


def required_date(value, name: str) -> dt.date:
    date = optional_date(value, name)
    if date is None:
        raise ValueError(f"{name} (YYYY-MM-DD) is required")
    return date


def optional_ticker(value) -> str | None:
    """None means all companies; a blank text is an error."""
    if value is None:
        return None
    ticker = str(value).strip()
    if not ticker:
        raise ValueError("ticker required")
    return ticker.upper()


def required_text(value, name: str) -> str:
    text = value.strip() if isinstance(value, str) else ""
    if not text:
        raise ValueError(f"{name} is required")
    return text


def range_window(end, key: str) -> tuple[dt.date, dt.date]:
    """First and last day of a named range ending at `end`; an unknown key means one year."""
    end = required_date(end, "end")
    if key == "MAX":
        return MAX_START, end
    if key == "YTD":
        return end.replace(month=1, day=1), end
    return end - dt.timedelta(days=RANGE_DAYS.get(key, RANGE_DAYS["1Y"])), end
