from __future__ import annotations

import datetime as dt
import os
import re

import pandas as pd
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F
from star import day, dicts

from pricelens.functions.text import (
    date_shape,
    normalize_ticker,
    parse_number,
    parse_timestamp,
    snake_case,
    snake_case_text,
    strip,
)
from pricelens.operators import clean, staging
from pricelens.plans.cleaning import NO_TEXT, TOO_MANY_CELLS, clean_dataset
from pricelens.sources import export, files, raw_csv
from registry import dirty


def values(df, column="x"):
    return [r[column] for r in df.select(column).collect()]


def texts(spark, cells, name="x"):
    return spark.createDataFrame([(i, c) for i, c in enumerate(cells)], f"i INT, {name} STRING")


def write(folder, name, text):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        out.write(text)


@pytest.mark.parametrize(
    "name, expected",
    [("  Adj. Close (USD) ", "adj_close_usd"), ("A__b", "a_b"), ("publishedAt", "publishedat"),
     ("_x_", "x"), ("P/E", "p_e"), ("", "")],
)
def test_snake_case(spark, name, expected):
    assert snake_case(name) == expected
    df = texts(spark, [name])
    assert values(df.select(snake_case_text(df.x).alias("x"))) == [expected]


def test_snake_case_columns_keeps_names_apart(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`A b` INT, `a_b` INT, c INT")
    assert clean.snake_case_columns(df).columns == ["a_b", "a_b_2", "c"]


def test_ticker_rules(spark):
    cells = [" brk.b ", "brk/b", "BRK B", None, "\t\naapl ", "a. /b"]
    df = texts(spark, cells)
    found = values(df.select(normalize_ticker("x").alias("x")))
    assert found == ["BRK-B", "BRK-B", "BRKB", None, "AAPL", "A--B"]


def test_strip_is_python_strip(spark):
    cells = [" a ", "\x1fa b\x85", "　x\xa0", "", "  ", "a", "é ", "\u200bz", None]
    df = texts(spark, cells)
    assert values(df.select(strip("x").alias("x"))) == [c and c.strip() for c in cells]


def test_missing_texts(spark):
    df = texts(spark, [" nan ", "None", "NaT", "NAN", "none", "", " x"])
    found = values(clean.normalize_strings(df))
    assert found == [None, None, None, "NAN", "none", "", "x"]


def test_dates(spark):
    cells = {
        "2020-01-02": "2020-01-02 00:00:00", "2020-1-2": "2020-01-02 00:00:00",
        "2020-01-02T10:11:12": "2020-01-02 10:11:12", "1/5/2020": "2020-01-05 00:00:00",
        "01/05/2020 7:08": "2020-01-05 07:08:00", "20200105": "2020-01-05 00:00:00",
        "Jan 5, 2020": "2020-01-05 00:00:00", "5 Feb 2021": "2021-02-05 00:00:00",
        "13/05/2020": None, "2020": None, "12:30": None, "x": None, "2020-02-30": None,
        "": None,
    }
    df = texts(spark, list(cells))
    found = values(df.select(parse_timestamp("x").cast("string").alias("x")))
    assert found == list(cells.values())
    european = df.select(parse_timestamp("x", ("d/M/yyyy",)).cast("date").alias("x"))
    assert values(european)[list(cells).index("13/05/2020")] == day("2020-05-13")
    assert date_shape("MMM d, yyyy").startswith("^([A-Za-z]{3})")


def test_numbers(spark):
    cells = ["1", "-2.5", "1e3", ".5", "5.", "abc", "1d", "2f", "nan", "1,000", "", "0x1", None]
    df = texts(spark, cells)
    found = values(df.select(parse_number("x").alias("x")))
    assert found == [1.0, -2.5, 1000.0, 0.5, 5.0] + [None] * 8


def test_date_names_by_word_or_by_part(spark):
    df = spark.createDataFrame(
        [("good", "2024-01-02", "2024-01-03", "x")],
        "sentiment STRING, published_at STRING, trading_date STRING, last_updated STRING",
    )
    by_word = clean.parse_date_columns(df).first()
    assert by_word["sentiment"] == "good" and by_word["last_updated"] == "x"
    assert str(by_word["published_at"]) == "2024-01-02 00:00:00"
    by_part = clean.parse_date_columns(df, match="substring").first()
    assert by_part["sentiment"] is None and by_part["last_updated"] is None
    assert by_part["trading_date"] == by_word["trading_date"]
    with pytest.raises(ValueError):
        clean.parse_date_columns(df, match="other")


def test_classification():
    assert clean.classify_table(["low", "title"]) == "price"
    assert clean.classify_table(["url", "ticker"]) == "news"
    assert clean.classify_table(["symbol"]) == "company"
    assert clean.classify_table(["a"]) == "generic"


PRICE_DDL = "source_file STRING, date STRING, close STRING, volume STRING"


def test_price_rules(spark):
    df = spark.createDataFrame(
        [
            ("a.csv", "2024-01-01", "1", "5"), ("a.csv", "2024-01-01", "1", "5"),
            ("b.csv", "2024-01-01", "1", "5"), ("a.csv", "2024-01-02", "abc", "5"),
            ("a.csv", "2024-01-03", "1", "-5"), ("a.csv", "2024-01-04", None, "5"),
            ("a.csv", "soon", "1", "5"), ("a.csv", "2024-01-05", "0", "0"),
        ],
        PRICE_DDL,
    )
    rows, kind = clean.basic_clean(df)
    found = sorted((r["source_file"], str(r["date"])[:10], r["close"]) for r in rows.collect())
    # Equal rows of two files stay, as their tickers are in the file names.
    assert kind == "price" and [f for f in found if f[2] is not None] == [
        ("a.csv", "2024-01-01", 1.0), ("a.csv", "2024-01-05", 0.0), ("b.csv", "2024-01-01", 1.0),
    ]
    # An unreadable close is not a missing one.
    assert ("a.csv", "2024-01-02", None) in found and len(found) == 4
    whole, _ = clean.basic_clean(df, scope="dataset")
    assert whole.count() == 3


def test_company_and_news_keep_one(spark):
    companies = spark.createDataFrame(
        [("f", " a", "z"), ("f", "A ", "b"), ("g", "a", "c"), ("f", None, "q"), ("f", None, "r")],
        "source_file STRING, symbol STRING, company_name STRING",
    )
    rows, kind = clean.basic_clean(companies)
    assert kind == "company"
    assert sorted(map(str, rows.select("source_file", "symbol", "company_name").collect())) == [
        "Row(source_file='f', symbol='A', company_name='b')",
        "Row(source_file='f', symbol=None, company_name='q')",
        "Row(source_file='g', symbol='A', company_name='c')",
    ]
    articles = spark.createDataFrame(
        [("f", None, "2024-01-02", "late"), ("f", None, "2024-01-01", "early"),
         ("f", "u", None, "none"), ("f", "u", "2024-01-03", "dated")],
        "source_file STRING, url STRING, published_at STRING, title STRING",
    )
    rows, kind = clean.basic_clean(articles)
    assert kind == "news" and sorted(values(rows, "title")) == ["dated", "early"]
    untitled = clean.clean_news(articles.drop("url").unionByName(articles.drop("url")))
    assert untitled.count() == 4


def _number(text):
    try:
        return float(text)
    except ValueError:
        return None


def _plain_clean(rows):
    """The price rules, row by row: what is left of (date, open, close, volume) texts."""
    left, seen = [], set()
    for row in rows:
        date, *cells = [None if x is None else x.strip() for x in row]
        day = dt.date.fromisoformat(date) if re.fullmatch(r"\d{4}-\d\d-\d\d", date) else None
        texts = (day, *cells)
        complete = day is not None and cells[1] is not None and cells[2] is not None
        numbers = [None if x is None else _number(x) for x in cells]
        if complete and texts not in seen and not any(x is not None and x < 0 for x in numbers):
            left.append((day, *numbers))
        seen.add(texts)
    return left


def test_price_rules_agree_with_plain_ones(spark):
    cells = ["1", " 2.5", "abc", "-1", None, "0", "1e2"]
    rows = [
        (f"2024-01-{1 + i % 28:02d}" if i % 9 else "bad", cells[i % 7], cells[(i // 7) % 7],
         cells[(i // 3) % 7])
        for i in range(300)
    ]
    ddl = "source_file STRING, date STRING, open STRING, close STRING, volume STRING"
    found, _ = clean.basic_clean(spark.createDataFrame([("f", *r) for r in rows * 2], ddl))
    ours = [(r.date.date(), r.open, r.close, r.volume) for r in found.collect()]
    assert sorted(map(str, ours)) == sorted(map(str, _plain_clean(rows * 2)))


def _dataset(folder):
    root = f"{folder}/raw data"
    write(root, "sp500/AAPL.csv", "Date,Low,Close,Volume,Adjusted Close\n"
          "2020-01-02,1,2.5,100,2.4\n2020-01-02,1,2.5,100,2.4\n2020-01-03,1,abc,100,2.4\n")
    write(root, "sp500/brk b+.csv", "Volume,Adj Close,Close,Low,Date\n5,1,9,1,2021-02-03\n"
          "5,1,NA,1,2021-02-04\n5,1,7,1,2015-12-31\n")
    write(root, "sp500/news.csv", 'Title,URL,Published At,Sentiment\n"a\nb",u,2020-01-02,Good\n'
          "c,u,2019-01-02,Bad\nd,,2019-01-02,Bad\n")
    write(root, "sp500/ragged.csv", "Symbol,Name\n a.b ,x\nq,w,e\n")
    write(root, "sp500/blank.csv", "\n\n")
    write(root, "sp500/list[1].csv", "Symbol,Name\n a.b ,x\nA/B,y\nNA,z\n")
    write(root, "other/z.csv", "a,b\n1,2\n")
    return root


def test_cleaning_run(spark, folder):
    root = _dataset(folder)
    listing = files.inventory(spark, root)
    assert values(listing, "relative_path") == [
        "other/z.csv", "sp500/AAPL.csv", "sp500/blank.csv", "sp500/brk b+.csv",
        "sp500/list[1].csv", "sp500/news.csv", "sp500/ragged.csv",
    ]
    assert files.select_files(listing, "04_sp500_stocks").count() == 7
    log = {r["source_file"]: r for r in clean_dataset(
        spark, files.MARKET_DATASET, root, f"{folder}/out").collect()}
    found = {k: (r["table_type_guess"], r["raw_rows"], r["cleaned_rows"], r["saved_mode"])
             for k, r in log.items()}
    assert found == {
        "sp500/AAPL.csv": ("price", 3, 2, "full"),
        "sp500/brk b+.csv": ("price", 3, 2, "full"),
        "sp500/news.csv": ("news", 3, 2, "full"),
        "sp500/list[1].csv": ("company", 3, 2, "full"),
        "sp500/ragged.csv": ("ERROR", None, None, TOO_MANY_CELLS),
        "sp500/blank.csv": ("ERROR", None, None, NO_TEXT),
    }
    assert log["sp500/brk b+.csv"]["sample_file"] == "brk_b__sample.csv"
    groups = raw_csv.read_cleaned_prices(spark, f"{export.finished(spark, f'{folder}/out')}/cleaned")
    prices = [g for g in groups if "date" in g.columns]
    staged = staging.finalize_staging(staging.combine_prices(prices))
    assert staged.columns == ["ticker", "trading_date", "low", "close", "adj_close", "volume",
                              "source_name", "source_file"]
    rows = sorted((r.ticker, str(r.trading_date), r.close, r.adj_close) for r in staged.collect())
    # The unreadable close was written as a blank and is missing now.
    assert rows == [("AAPL", "2020-01-02", 2.5, 2.4), ("BRK_B", "2015-12-31", 7.0, 1.0),
                    ("BRK_B", "2021-02-03", 9.0, 1.0)]
    assert staging.load_ready(staged).count() == 2


def test_unreadable_files_do_not_stop_the_others(spark, folder):
    for name in ("a", "b", "d"):
        write(folder, f"raw/{name}.csv", f"Symbol,Name\n{name},x\n")
    write(folder, "raw/ragged.csv", "Symbol,Name\nr,x,more\n")
    write(folder, "raw/wide.csv", "Symbol,Name\n" + "x," * 30_000 + "\n")
    write(folder, "raw/wider.csv", "Symbol,Name\n" + "x," * 300_000 + "\n")
    write(folder, "raw/blank.csv", "\n\n")
    log = clean_dataset(spark, "x", f"{folder}/raw", f"{folder}/out").collect()
    modes = {r["source_file"]: r["saved_mode"] for r in log}
    assert {f: m for f, m in modes.items() if m == "full"} == dict.fromkeys(
        ("a.csv", "b.csv", "d.csv"), "full"
    )
    too_many = "error: a row has more cells than the header"
    assert (modes["ragged.csv"], modes["wide.csv"]) == (too_many, too_many)
    assert modes["wider.csv"] == too_many
    assert modes["blank.csv"] == "error: the file has no header"


def test_files_of_one_name_stay_apart(spark, folder):
    for place, close in (("a/x", 1), ("b/x", 2), ("b/X", 3), ("c/brk-b", 4), ("c/brk_b", 5)):
        write(folder, f"raw/{place}.csv", f"Date,Close,Volume\n2020-01-02,{close},{close}\n")
    log = clean_dataset(spark, "x", f"{folder}/raw", f"{folder}/out").collect()
    assert {r["source_file"]: r["sample_file"] for r in log} == {
        "a/x.csv": "x__sample.csv", "b/X.csv": "2__x__sample.csv", "b/x.csv": "3__x__sample.csv",
        "c/brk-b.csv": "brk_b__sample.csv", "c/brk_b.csv": "2__brk_b__sample.csv",
    }
    groups = raw_csv.read_cleaned_prices(spark, f"{export.finished(spark, f'{folder}/out')}/cleaned")
    rows = staging.combine_prices(groups).collect()
    assert sorted((r.source_file, r.ticker, float(r.close)) for r in rows) == [
        ("2__brk_b__cleaned.csv", "BRK_B", 5.0), ("2__x__cleaned.csv", "X", 3.0),
        ("3__x__cleaned.csv", "X", 2.0), ("brk_b__cleaned.csv", "BRK_B", 4.0),
        ("x__cleaned.csv", "X", 1.0),
    ]
    samples = raw_csv.read_raw_csv(spark, f"{export.finished(spark, f'{folder}/out')}/samples")
    assert samples.select("source_file").distinct().count() == 5


def test_failures_that_are_no_file_end_the_run(spark, folder, monkeypatch):
    from pyspark.errors import PySparkException

    from pricelens.plans import cleaning

    def failing(*_):
        raise PySparkException("No space left on device")

    write(folder, "raw/a.csv", "Symbol,Name\na,x\n")
    monkeypatch.setattr(cleaning, "store_cells", failing)
    with pytest.raises(PySparkException):
        clean_dataset(spark, "x", f"{folder}/raw", f"{folder}/out")


def test_a_stopped_run_is_repeated_without_doubling(spark, folder, monkeypatch):
    """A run ends between the exports of two headers; the next one's rows are all there, once."""
    write(folder, "raw/a.csv", "Date,Close,Volume\n2020-01-02,1,1\n")
    write(folder, "raw/b.csv", "Volume,Close,Date\n2,2,2020-01-02\n")
    inner, calls = export.write_full_or_chunked, []

    def stopping(*args, **more):
        if len(calls) == 1:
            raise RuntimeError("lost")
        calls.append(1)
        return inner(*args, **more)

    monkeypatch.setattr(export, "write_full_or_chunked", stopping)
    with pytest.raises(RuntimeError):
        clean_dataset(spark, "x", f"{folder}/raw", f"{folder}/out")
    with pytest.raises(Exception):
        export.finished(spark, f"{folder}/out")
    monkeypatch.setattr(export, "write_full_or_chunked", inner)
    for _ in range(2):
        clean_dataset(spark, "x", f"{folder}/raw", f"{folder}/out")
        done = export.finished(spark, f"{folder}/out")
        rows = staging.combine_prices(raw_csv.read_cleaned_prices(spark, f"{done}/cleaned"))
        assert sorted((r.ticker, float(r.close)) for r in rows.collect()) == [("A", 1.0), ("B", 2.0)]


def _jobs(spark, name, run):
    """How many jobs `run` takes."""
    spark.sparkContext.setJobGroup(name, name)
    run()
    spark.sparkContext.setJobGroup("none", "none")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_headers_do_not_add_jobs(spark, folder):
    """Two headers or twelve, with and without quoted line ends: the same jobs, and the rows by name."""
    for name, n in (("few", 2), ("many", 12)):
        for i in range(n):
            columns = [f"c{(i + k) % n}" for k in range(min(n, 3))]
            write(folder, f"{name}/f{i}.csv", ",".join(columns) + "\n" + ",".join(f"{c} of {i}" for c in columns) + "\n")
        write(folder, f"{name}/q.csv", 'c0,C1\n"a\nb",x\n')
    counts = {
        name: _jobs(spark, f"{folder}/{name}", lambda: raw_csv.read_raw_csv(spark, f"{folder}/{name}").collect())
        for name in ("few", "many")
    }
    assert counts["few"] == counts["many"]
    rows = raw_csv.read_raw_csv(spark, f"{folder}/many").collect()
    assert len(rows) == 13
    for r in rows:
        i = r["source_file"][1:-4]
        own = {k: v for k, v in r.asDict().items() if k != "source_file" and v is not None}
        assert own == ({"c0": "a\nb", "c1": "x"} if i == "" else {f"c{(int(i) + k) % 12}": f"c{(int(i) + k) % 12} of {i}" for k in range(3)})


def test_files_that_are_not_chosen_are_not_opened(spark, folder):
    """The rule on the path drops files where Spark lists them: a file that cannot be read does no harm."""
    write(folder, "raw/sp500/a.csv", "Symbol,Name\na,x\n")
    write(folder, "raw/other/b.csv", "Symbol,Name\nb,y\n")
    raw = raw_csv.scan_files(
        spark, [f"{folder}/raw"], f"{folder}/t", f"{folder}/raw", lambda path: path.contains("sp500/")
    )
    cells = raw_csv.read_cells(spark, raw)
    os.remove(f"{folder}/raw/other/b.csv")
    os.makedirs(f"{folder}/raw/other/b.csv.d")
    assert [r["c0"] for r in cells.collect()] == ["a"]


def test_headers_without_rows_and_repeated_headers(spark, folder):
    write(folder, "raw/empty.csv", "Symbol,Name\n")
    write(folder, "raw/twice.csv", "\n  \nSymbol,Name\na,x\nSymbol,Name\n")
    write(folder, "raw/quote.csv", 'Name,Symbol\n5" tall,b\n')
    log = {r["source_file"]: tuple(r)[1:4] for r in clean_dataset(spark, "x", f"{folder}/raw", f"{folder}/out").collect()}
    assert log == {"empty.csv": ("company", 0, 0), "twice.csv": ("company", 2, 2), "quote.csv": ("company", 1, 1)}


def test_clean_dataset_takes_files_formats_and_missing_texts(spark, folder):
    write(folder, "raw/a.csv", "Date,Name\n20#01#2016,-\n")
    write(folder, "raw/b.csv", "Date,Name\n2016-01-20,x\n")
    log = clean_dataset(
        spark, "x", f"{folder}/raw", f"{folder}/out", formats=("d#M#yyyy",), na_tokens=("", "-"),
        files=["a.csv"],
    ).collect()
    assert [r["source_file"] for r in log] == ["a.csv"]
    rows = spark.read.option("header", True).csv(f"{export.finished(spark, f'{folder}/out')}/cleaned/output=a__cleaned.csv").collect()
    assert rows[0]["date"].startswith("2016-01-20") and rows[0]["name"] is None


@pytest.mark.parametrize(
    "text, expected",
    [
        ("20-Jan-2016", "2016-01-20 00:00:00"),
        ("January 20, 2016", "2016-01-20 00:00:00"),
        ("20 January 2016", "2016-01-20 00:00:00"),
        ("Jan 20, 2016 9:30 AM", "2016-01-20 09:30:00"),
        ("1/20/2016 9:30 PM", "2016-01-20 21:30:00"),
        ("1/20/16", "2016-01-20 00:00:00"),
        ("1/20/99", "1999-01-20 00:00:00"),
        ("2016.01.20", "2016-01-20 00:00:00"),
        ("2016/01/20 10:00", "2016-01-20 10:00:00"),
        ("Wed, 20 Jan 2016 10:00:00 GMT", "2016-01-20 10:00:00"),
        ("2016-01-20T10:00:00Z", "2016-01-20 10:00:00"),
        ("2016-01-20T10:00:00-05:00", "2016-01-20 15:00:00"),
        ("2016-01-20 10:00:00", "2016-01-20 10:00:00"),
        ("2016-01-20", "2016-01-20 00:00:00"),
        ("10:30", None),
        ("2016", None),
        ("no date", None),
    ],
)
def test_date_spellings(spark, text, expected):
    from pricelens.functions.text import parse_timestamp

    row = spark.createDataFrame([(text,)], "t string").select(parse_timestamp("t").alias("d")).first()
    assert (None if row["d"] is None else str(row["d"])) == expected


def test_formats_in_another_order_after_the_year(spark):
    from pyspark.sql import functions as F

    from pricelens.functions.text import parse_timestamp

    cells = ["2020-03-04", "2020-31-01", "31|1|2020", "1-20-2016", "2020-99-99"]
    rows = spark.createDataFrame([(c,) for c in cells], "t string")
    found = rows.select(F.to_date(parse_timestamp("t", ("yyyy-dd-MM", "d|M|yyyy", "M-d-yyyy"))).cast("string").alias("d"))
    assert [r["d"] for r in found.collect()] == ["2020-03-04", "2020-01-31", "2020-01-31", "2016-01-20", None]


def test_missing_cells_and_quotes(spark, folder):
    write(folder, "raw/a.csv", 'x,y,\n"p ""q"", r",N/A,1\n<NA>,None,\n-nan,z\n')
    rows = raw_csv.read_raw_csv(spark, f"{folder}/raw")
    assert rows.columns == ["source_file", "x", "y", "Unnamed: 2"]
    assert sorted(map(str, (tuple(r)[1:] for r in rows.collect()))) == sorted(
        map(str, [('p "q", r', None, "1"), (None, None, None), (None, "z", None)])
    )
    kept = raw_csv.read_raw_csv(spark, f"{folder}/raw", na_tokens=("",))
    assert "N/A" in values(kept, "y")


def test_columns_match_by_name(spark, folder):
    write(folder, "raw/a.csv", "date,close\n2024-01-01,1.5\n")
    write(folder, "raw/b.csv", "\ufeffclose,date\n2.5,2024-01-02\n")
    rows = raw_csv.read_raw_csv(spark, f"{folder}/raw")
    assert sorted((r["date"], r["close"]) for r in rows.collect()) == [
        ("2024-01-01", "1.5"), ("2024-01-02", "2.5"),
    ]
    with pytest.raises(Exception, match="(?i)header|schema"):
        raw_csv.read_uniform_csv(spark, f"{folder}/raw").collect()


def test_uniform_files_read_in_one_pass(spark, folder):
    write(folder, "raw/a.csv", "date,close\n2024-01-01,NA\n")
    write(folder, "raw/b.csv", "date,close\n2024-01-02,2\n")
    rows = raw_csv.read_uniform_csv(spark, f"{folder}/raw")
    assert sorted(map(tuple, rows.fillna("-").collect())) == [
        ("a.csv", "2024-01-01", "-"), ("b.csv", "2024-01-02", "2"),
    ]


def test_ticker_from_file_separator(spark):
    df = texts(spark, ["x/brk_b__cleaned.csv", "output=a_b__cleaned.csv/part-0.csv", "Q.csv"])
    assert values(df.select(staging.ticker_from_file(df.x).alias("x"))) == ["BRK_B", "A_B", "Q"]
    assert values(df.select(staging.ticker_from_file(df.x, "-").alias("x")))[0] == "BRK-B"


def test_combine_renames_per_frame(spark):
    one = spark.createDataFrame([("a__cleaned.csv", "2024-01-01", "1")],
                                "source_file STRING, date STRING, adjusted_close STRING")
    two = spark.createDataFrame(
        [("b__cleaned.csv", "2024-01-01", "2", "3", "e")],
        "source_file STRING, date STRING, adj_close STRING, adjusted_close STRING, extra STRING")
    rows = staging.combine_prices([one, two])
    assert rows.columns == ["ticker", "trading_date", "adj_close", "source_name", "source_file",
                            "adjusted_close", "extra"]
    assert sorted((r.ticker, r.adj_close, r.adjusted_close) for r in rows.fillna("-").collect()) == [
        ("A", "1", "-"), ("B", "2", "3"),
    ]


STAGED = "ticker STRING, trading_date STRING, close STRING, source_file STRING"


def test_load_filter_and_summary(spark, folder):
    df = spark.createDataFrame(
        [("a", None, "1", "f"), ("a", "2015-12-31", "1", "f"), ("a", "2016-01-01", "1", "f"),
         ("A", "2017-01-01", "1", "f"), (None, "2018-01-01", "1", "f")],
        STAGED,
    )
    kept = staging.load_ready(df)
    assert sorted(str(d) for d in values(kept, "trading_date")) == [
        "2016-01-01", "2017-01-01", "2018-01-01"]
    assert tuple(staging.load_summary(df).first()) == (
        5, 3, 2, 1, day("2016-01-01"), day("2018-01-01"))
    none = staging.load_ready(df, "2030-01-01")
    export.write_prices_csv(none, f"{folder}/load")
    assert spark.read.csv(f"{folder}/load", header=True).columns == kept.columns
    assert tuple(staging.load_summary(df, "2030-01-01").first()) == (5, 0, 5, 0, None, None)
    renamed = staging.load_ready(
        df.withColumnsRenamed({"ticker": "symbol", "trading_date": "date"}))
    assert renamed.columns[:2] == ["ticker", "trading_date"] and renamed.count() == 3


def test_staging_keeps_the_first_source(spark):
    df = spark.createDataFrame(
        [("a", "2024-01-01", "1", "z.csv"), ("a", "2024-01-01", "1.0", "b.csv"),
         ("a", "2024-01-01", None, "a.csv"), (None, "2024-01-01", "1", "a.csv")],
        STAGED,
    )
    assert [tuple(r) for r in staging.finalize_staging(df).collect()] == [
        ("a", day("2024-01-01"), 1.0, "b.csv")]


def test_chunks_hold_all_rows_in_order(spark, folder):
    rows = [("big.csv", f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", float(i), 1.0)
            for i in range(1000)]
    rows += [("small.csv", "2024-01-01 00:00:00", 1.0, 1.0)]
    df = spark.createDataFrame(
        rows, "source_file STRING, date STRING, close DOUBLE, volume DOUBLE").repartition(6)
    stats = export.write_full_or_chunked(df, f"{folder}/c", max_full_mb=0.01, chunk_rows=150)
    assert {r["source_file"]: r["saved_mode"] for r in stats.collect()} == {
        "big.csv": "chunked", "small.csv": "full"}
    parts = sorted(
        os.path.join(base, f)
        for base, _, names in os.walk(f"{folder}/c")
        for f in names if f.endswith(".csv") and "big" in base
    )
    read = [pd.read_csv(p) for p in parts]
    assert max(len(p) for p in read) <= 150 and sum(len(p) for p in read) == 1000
    assert all(p["date"].is_monotonic_increasing for p in read)
    export.write_sample(df, f"{folder}/s", rows=300)
    sample = raw_csv.read_raw_csv(spark, f"{folder}/s")
    closes = [float(v) for v in values(sample.filter("source_file LIKE '%big%'"), "close")]
    assert sorted(closes) == [float(i) for i in range(300)]


def test_empty_inventory(spark, folder):
    os.makedirs(f"{folder}/empty")
    listing = files.inventory(spark, f"{folder}/empty")
    assert listing.count() == 0 and listing.columns == ["relative_path", "size_mb"]


def test_cells_are_stored_in_files_of_few_rows(spark, folder, monkeypatch):
    """So that the tasks that clean them share the rows, however tightly these are stored."""
    monkeypatch.setattr(raw_csv, "CELL_ROWS", 100)
    write(folder, "r/a.csv", "Date,Close\n" + "".join(f"2024-01-02,{i}\n" for i in range(950)))
    raw = raw_csv.scan_files(spark, [f"{folder}/r"], f"{folder}/t", f"{folder}/r")
    cells = raw_csv.store_cells(spark, raw, f"{folder}/cells")
    sizes = [r["count"] for r in cells.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) >= 10 and max(sizes) <= 100 and sum(sizes) == 950


def test_market_files_are_chosen_whatever_their_case(spark):
    paths = ["a/SP500/x.csv", "a/sp500/x.csv", "a/Sp500x.csv", "a/sp50/x.csv", "sp500/x.txt", None]
    frame = spark.createDataFrame([(p,) for p in paths], "x STRING")
    assert values(frame.filter(files.is_selected(F.col("x"), files.MARKET_DATASET))) == paths[:3]


def test_whole_files_are_written_without_a_sort(spark, folder, monkeypatch):
    """One part per file, null has its own; the setting that spares the sort is back after the write."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before, during, write_text = spark.conf.get(key), [], DataFrameWriter.text

    def spied(self, *args, **kwargs):
        during.append(int(spark.conf.get(key)))
        return write_text(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "text", spied)
    lines = [(f"f{i % 7}.csv" if i % 7 else None, str(i)) for i in range(700)]
    dirty.write_whole_files(spark.createDataFrame(lines, "file STRING, value STRING").repartition(5), f"{folder}/w")
    assert during and min(during) >= 7 and spark.conf.get(key) == before
    parts = files.inventory(spark, f"{folder}/w").count()
    back = {(r["file"], r["value"]) for r in spark.read.text(f"{folder}/w").collect()}
    assert parts == 7 and back == {(f, v) for f, v in lines}


def test_inventory_sizes_and_relative_roots(spark, folder):
    write(folder, "r/a b.csv", "x" * 160_000)
    for root in (f"{folder}/r", f"{folder}/r/", f"file://{folder}/r", f"file:{folder}/./r"):
        assert [tuple(r) for r in files.inventory(spark, root).collect()] == [("a b.csv", 0.15)]
    assert dicts(files.select_files(files.inventory(spark, f"{folder}/r"), "x"))
