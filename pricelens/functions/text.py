"""Text rules of the cleaning step as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Cells that pandas.read_csv reads as missing.
NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# Texts that stand for a missing string after trimming.
MISSING_TEXTS = ("nan", "None", "NaT")

# Formats tried in turn for dates that are not ISO; month first, as pandas reads them.
DATE_FORMATS = (
    "M/d/yyyy",
    "M/d/yyyy H:mm",
    "M/d/yyyy H:mm:ss",
    "M-d-yyyy",
    "yyyy/M/d",
    "yyyyMMdd",
    "yyyy/M/d H:mm",
    "yyyy/M/d H:mm:ss",
    "yyyy.M.d",
    "M/d/yy",
    "M/d/yyyy h:mm a",
    "M/d/yyyy h:mm:ss a",
    "MMM d, yyyy",
    "MMM d, yyyy h:mm a",
    "MMMM d, yyyy",
    "d MMM yyyy",
    "d MMM yyyy H:mm:ss",
    "d MMMM yyyy",
    "d-MMM-yyyy",
)

# Two-digit years up to this one are in this century.
_LAST_SHORT_YEAR = 2068


def snake_case(name) -> str:
    """`  Adj. Close (USD) ` -> `adj_close_usd`."""
    return "_".join(re.findall("[A-Za-z0-9]+", str(name))).lower()


def snake_case_text(text: Column) -> Column:
    """`snake_case` for the values of a column."""
    return F.lower(F.btrim(F.regexp_replace(text, "[^A-Za-z0-9]+", "_"), F.lit("_")))


def strip(text) -> Column:
    """Without white space around. A text between two plain ASCII characters is taken as it is."""
    column = F.col(text) if isinstance(text, str) else text
    # Texts compare by bytes, so the first character decides without being cut out.
    first = (column >= "!") & (column < "\x7f")
    last = F.substring(column, -1, 1).between("!", "~")
    plain = first & last
    return F.when(plain, column).otherwise(F.btrim(column, F.lit(WHITE_SPACE)))


def null_if_in(text, tokens) -> Column:
    """Null for the listed texts; null stays null."""
    column = F.col(text) if isinstance(text, str) else text
    return F.when(~column.isin(*tokens), column)


def normalize_ticker(text) -> Column:
    """Upper case, `.` and `/` become `-`, no white space around and no spaces inside."""
    return F.translate(F.upper(strip(text)), "./ ", "--")


# Only cells of these shapes are parsed. Others are null at once: a failed parse costs an
# exception per cell, which on untidy files would be most of the run.
_NUMBER_SHAPE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_ZONED = r"\d:\d\d(:\d\d(\.\d+)?)?\s?(Z|UTC|GMT|[+-]\d\d:?\d\d)$"
_WEEKDAY = "^(Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*, "
_NAME_SHAPES = {"MMM": "[A-Za-z]{3}", "MMMM": "[A-Za-z]+", "a": "[AaPp][Mm]"}


def _fields(date_format: str) -> list[tuple[str, str]]:
    """(field, "") or ("", text between fields) for each part of a date format."""
    found = re.findall(r"(([A-Za-z])\2*)|([^A-Za-z]+)", date_format)
    return [(field, other) for field, _, other in found]


def date_shape(date_format: str) -> str:
    """Regular expression for the texts a date format can read, one group per field."""
    parts = []
    for field, other in _fields(date_format):
        if other:
            parts.append(re.escape(other))
        elif field in _NAME_SHAPES:
            parts.append(f"({_NAME_SHAPES[field]})")
        elif field == "yyyy":
            parts.append(r"(\d{4})")
        else:
            parts.append(r"(\d{1,2})" if len(field) == 1 else rf"(\d{{{len(field)}}})")
    return "^" + "".join(parts) + "$"


def _iso_template(date_format: str) -> str | None:
    """Replacement that turns a match of `date_shape` into ISO text; None if fields have names."""
    place = {}
    for field, other in _fields(date_format):
        if not other:
            place[field[0]] = f"${len(place) + 1}"
            if field in _NAME_SHAPES or field == "yy" or field[0] not in "yMdHms":
                return None
    if not {"y", "M", "d"} <= set(place):
        return None
    day = "{y}-{M}-{d}".format(**place)
    if "H" not in place:
        return day
    return f"{day} {place['H']}:{place.get('m', '00')}:{place.get('s', '00')}"


def _named(text: Column, date_format: str) -> Column:
    found = F.try_to_timestamp(text, F.lit(date_format)).cast("timestamp_ntz")
    if "yy" not in [field for field, _ in _fields(date_format)]:
        return found
    century_ago = (found - F.make_ym_interval(F.lit(100))).cast("timestamp_ntz")
    return F.when(F.year(found) > _LAST_SHORT_YEAR, century_ago).otherwise(found)


def parse_timestamp(text, formats=DATE_FORMATS) -> Column:
    """ISO text or one of `formats` as a timestamp without time zone, anything else null.

    A time with an offset, `Z` or `GMT` is brought to UTC. A day of the week in front is passed
    over. Two-digit years are 1969 to 2068.

    A cell is told apart first and then read once: with a year and a dash in front it is cast as it is; in the shape of
    a format of numbers it is rewritten to ISO text and cast, as that fails without an exception; with letters and
    digits it goes through the format parser. Others are null.
    """
    column = F.col(text) if isinstance(text, str) else text
    templates = {f: _iso_template(f) for f in formats}
    in_utc = F.convert_timezone(
        F.current_timezone(), F.lit("UTC"), column.try_cast("timestamp").cast("timestamp_ntz")
    )
    # A bare number or a time of day would cast as well; neither is a date here.
    zoned = (F.length(column) > 10) & column.rlike(_ZONED)
    as_iso = F.when(zoned, in_utc).otherwise(column.try_cast("timestamp_ntz"))
    year_first = (F.substring(column, 5, 1) == "-") & ~F.substring(column, 1, 4).contains("-")
    named = [f for f, template in templates.items() if not template]
    # Without a letter only formats of numbers are left.
    plain = [f for f in formats if not _NAME_SHAPES.keys() & {field for field, _ in _fields(f)}]
    shaped = {f: column.rlike(date_shape(f)) for f in plain}
    values = {
        f: F.regexp_replace(column, date_shape(f), templates[f]).try_cast("timestamp_ntz") if templates[f] else _named(column, f)
        for f in plain
    }
    # A format that starts like ISO but goes on in another order gets what ISO cannot read.
    like_iso = [F.when(shaped[f], values[f]) for f in plain if f.startswith("yyyy-")]
    found = F.when(year_first, F.coalesce(as_iso, *like_iso))
    for date_format in plain:
        found = found.when(shaped[date_format], values[date_format])
    if not named:
        return found
    # A zone without an offset from UTC changes nothing and is cut off, as is a day's name.
    spelled = F.when(column.rlike("^[A-Z]"), F.regexp_replace(column, _WEEKDAY, "")).otherwise(column)
    spelled = F.regexp_replace(spelled, r" (GMT|UTC)$", "")
    read = F
    for date_format in named:
        read = read.when(spelled.rlike(date_shape(date_format)), _named(spelled, date_format))
    return found.when(column.rlike("[0-9]"), read)


def parse_number(text) -> Column:
    """A plain decimal number as a double, anything else null."""
    column = F.col(text) if isinstance(text, str) else text
    return F.when(column.rlike(_NUMBER_SHAPE), column.try_cast("double"))
