from __future__ import annotations

import datetime as dt
import json
import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from star import company, day, days, dicts, price, tables

from pricelens.functions.dates import between, latest_date
from pricelens.functions.params import range_window
from pricelens.operators import prices
from pricelens.tables import listed_companies, load_tables, save_prices


def test_best_feed_wins_with_a_null_close(spark):
    t = tables(
        spark,
        price_daily=[
            price(1, "2024-01-02", None, 1),
            price(1, "2024-01-02", 10.0, 2),
            price(1, "2024-01-03", 11.0, 3),
            price(1, "2024-01-03", 12.0, 2),
            price(1, "2024-01-04", 13.0, 3),
            price(1, "2024-01-05", 13.0, 99),
        ],
    )
    found = {
        r["trading_date"]: r["close"]
        for r in prices.primary_price(t.price_daily, t.price_source).collect()
    }
    # Feed 3 has no rank and comes last, feed 99 is unknown.
    assert found == {
        day("2024-01-02"): None,
        day("2024-01-03"): 12.0,
        day("2024-01-04"): 13.0,
    }


def test_equal_ranks_are_decided_by_source_id(spark):
    t = tables(
        spark,
        price_source=[(7, 1), (5, 1)],
        price_daily=[price(1, "2024-01-02", 7.0, 7), price(1, "2024-01-02", 5.0, 5)],
    )
    assert prices.primary_price(t.price_daily, t.price_source).first()["close"] == 5.0


def test_differing_copies_of_one_feed_give_one_row_whatever_the_order(spark):
    rows = [price(1, "2024-01-02", float(i), 1, i) for i in range(50)]
    seen = set()
    for seed in range(4):
        random.Random(seed).shuffle(rows)
        t = tables(spark, price_daily=rows)
        found = prices.primary_price(t.price_daily.repartition(5), t.price_source).collect()
        assert len(found) == 1
        # All columns come from the same copy.
        assert found[0]["close"] == found[0]["open"] == found[0]["volume"]
        seen.add(found[0]["close"])
    assert len(seen) == 1


def test_prices_are_not_shuffled_by_their_few_feeds(spark, capsys):
    """Also where Spark does not know how small the table of feeds is."""
    daily = tables(spark, price_daily=[price(1, "2024-01-02", 9.0, 1), price(1, "2024-01-02", 8.0, 2), price(2, "2024-01-02", 1.0, 7)]).price_daily
    feeds = spark.createDataFrame([(1, 2), (2, None), (3, 1)], "source_id long, priority_rank int")
    for found in (prices.primary_price(daily, feeds), prices.latest_primary_trade(daily, feeds)):
        found.explain()
        plan = capsys.readouterr().out
        assert "BroadcastHashJoin" in plan and "hashpartitioning(source_id" not in plan
        assert [r["company_id"] for r in found.collect()] == [1]


@pytest.mark.parametrize("most", [0, 10])
def test_any_number_of_feeds_gives_the_same_rows(spark, monkeypatch, most):
    monkeypatch.setattr(prices, "MAX_FEEDS", most)
    daily = tables(spark, price_daily=[price(1, "2024-01-02", 9.0, 1), price(1, "2024-01-02", 8.0, 2), price(2, "2024-01-02", 1.0, 7)]).price_daily
    feeds = spark.createDataFrame([(1, 2), (2, None), (3, 1)], "source_id long, priority_rank int")
    assert [r["close"] for r in prices.primary_price(daily, feeds).collect()] == [9.0]
    assert [r["latest_close"] for r in prices.latest_primary_trade(daily, feeds).collect()] == [9.0]


def test_a_worse_feed_never_changes_the_primary_price(spark):
    rows = [price(c, d, float(c + i), 1) for c in (1, 2) for i, d in enumerate(days("2024-01-01", 9))]
    worse = [price(c, d, 1000.0, 2) for c in (1, 2) for d in days("2024-01-01", 9)]
    t, u = tables(spark, price_daily=rows), tables(spark, price_daily=rows + worse)
    one = prices.primary_price(t.price_daily, t.price_source).collect()
    two = prices.primary_price(u.price_daily, u.price_source).collect()
    assert sorted(one) == sorted(two)


def test_latest_trade_agrees_in_one_and_two_steps(spark):
    rng = random.Random(3)
    rows = [
        price(c, d, None if rng.random() < 0.1 else rng.random(), s, rng.randrange(9))
        for c in range(6)
        for d in rng.sample(days("2023-12-20", 30), 6)
        for s in rng.sample([1, 2, 3], rng.randrange(1, 4))
    ]
    t = tables(spark, price_daily=rows)
    primary = prices.primary_price(t.price_daily, t.price_source)
    two = prices.latest_trade(primary).collect()
    one = prices.latest_primary_trade(t.price_daily, t.price_source).collect()
    assert sorted(one, key=str) == sorted(two, key=str)
    assert len(one) == 6


def test_dates_before_the_epoch_order_right(spark):
    t = tables(
        spark, price_daily=[price(1, "1960-05-02", 1.0), price(1, "1969-12-30", 2.0, 2)]
    )
    row = prices.latest_primary_trade(t.price_daily, t.price_source).first()
    assert (row["latest_trading_date"], row["latest_close"]) == (day("1969-12-30"), 2.0)


def _fixture_series(closes):
    return [
        price(1, d, c)
        for d, c in zip(
            ("2022-11-01", "2022-11-08", "2022-11-15", "2022-11-22", "2022-11-29",
             "2022-12-06", "2022-12-12"),
            closes,
        )
    ]


# Closes with their published daily returns and seven-row means.
GOLDEN = [
    (
        [150.65, 139.50, 150.04, 150.18, 141.17, 142.91, 144.49],
        [None, -7.4, 7.55, 0.09, -6.0, 1.23, 1.11],
        [150.65, 145.07, 146.73, 147.59, 146.31, 145.74, 145.56],
    ),
    (
        [228.17, 228.87, 241.78, 247.49, 240.33, 248.00, 252.51],
        [None, 0.31, 5.64, 2.36, -2.89, 3.19, 1.82],
        [228.17, 228.52, 232.94, 236.58, 237.33, 239.11, 241.02],
    ),
]


@pytest.mark.parametrize("closes, returns, means", GOLDEN)
def test_series_reproduces_published_figures(spark, closes, returns, means):
    t = tables(spark, company=[company(1, "AAA")], price_daily=_fixture_series(closes))
    rows = dicts(prices.price_series(t, "aaa "))
    assert [r["close"] for r in rows] == closes
    for row, change, mean in zip(rows, returns, means):
        if change is None:
            assert row["daily_return_pct"] is None
        else:
            assert math.isclose(row["daily_return_pct"], change, abs_tol=0.011)
        assert math.isclose(row["ma_7_day"], mean, abs_tol=0.011)
        assert row["sector_avg_close"] == row["close"]
        assert row["sector_price_rank"] == 1
    assert tuple(rows[0]) == prices.SERIES_COLUMNS


def _random_star(spark, companies=12, length=12, seed=5):
    rng = random.Random(seed)
    listed = [company(i, f"T{i}", rng.choice([10, 11, 20, None])) for i in range(1, companies + 1)]
    rows = [
        price(c[0], d, rng.choice([None, 0.0, 1.0, round(rng.random() * 300, 2)]), s)
        for c in listed
        for d in days("2024-01-01", length)
        if rng.random() < 0.8
        for s in (1, 2)
    ]
    return tables(spark, company=listed, price_daily=rows)


def _key(rows):
    return sorted(
        (tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=str
    )


def test_one_ticker_equals_its_part_of_the_whole(spark):
    t = _random_star(spark)
    every = prices.price_series(t, start="2024-01-03", end="2024-01-10")
    for ticker in ("T1", "T2", "T3", "T4", "T5"):
        one = prices.price_series(t, ticker, "2024-01-03", "2024-01-10")
        assert _key(one.collect()) == _key(every.filter(F.col("ticker") == ticker).collect())
    assert every.count() > 0


def _plain_position(primary, ids):
    """Rank and mean by windows over the rows themselves."""
    of_day = Window.partitionBy("sector_id", "trading_date")
    return primary.join(ids.select("company_id", "sector_id"), "company_id").select(
        "company_id",
        "trading_date",
        F.rank().over(of_day.orderBy(F.col("close").desc_nulls_last())).alias("sector_price_rank"),
        F.avg("close").over(of_day).alias("sector_avg_close"),
    )


@pytest.mark.parametrize("max_companies", [0, 1_000_000])
def test_ranks_equal_a_window_over_all_rows(spark, max_companies):
    t = _random_star(spark, companies=30, seed=8)
    # Values on both sides of zero, ties, nulls and extremes in one sector and day.
    odd = [-5.0, -0.001, 0.0, -0.0, 0.001, 1e-300, 1e300, 7.0, 7.0, None, None, float("nan"),
           float("inf"), float("-inf")]
    closes = spark.createDataFrame(
        [(100 + i, day("2024-02-01"), c) for i, c in enumerate(odd)],
        "company_id BIGINT, trading_date DATE, close DOUBLE",
    )
    ids = spark.range(100, 100 + len(odd)).selectExpr("id AS company_id", "1L AS sector_id")
    ranked = prices.sector_price_rank(closes, ids, max_companies).select(
        "company_id", "sector_price_rank"
    )
    plain = _plain_position(closes, ids).select("company_id", "sector_price_rank")
    assert sorted(ranked.collect()) == sorted(plain.collect())
    primary = prices.primary_price(t.price_daily, t.price_source)
    listed = listed_companies(t)
    one = _plain_position(primary, listed)
    two = prices.sector_position(primary, listed, max_companies).select(one.columns)
    assert _key(one.collect()) == _key(two.collect())


def test_a_sector_of_one_price_is_ranked_by_few_rows(spark):
    """A sector without closes and one with a single price: nothing ranks their companies one by one."""
    rows = spark.range(4000).selectExpr(
        "id AS company_id", "DATE'2024-01-02' AS trading_date", "IF(id < 2000, NULL, 5.0D) AS close"
    )
    ids = spark.range(4000).selectExpr("id AS company_id", "IF(id < 2000, 1L, 2L) AS sector_id")
    found = prices.sector_position(rows, ids)
    seen = found.groupBy("sector_id", "sector_price_rank", "sector_avg_close").count().collect()
    assert sorted(map(tuple, seen)) == [(1, 1, None, 2000), (2, 1, 5.0, 2000)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    window = next(i for i, line in enumerate(lines) if "Window [" in line)
    # Below every window lies the aggregate that leaves one row per sector, day and close.
    assert any("Aggregate [" in line and "close" in line for line in lines[window:])
    assert not any("rank(" in line for line in lines)


def test_unclassified_and_unknown_tickers_give_no_series(spark):
    t = tables(
        spark,
        company=[company(1, "AAA"), company(2, "BBB", None)],
        price_daily=[price(1, "2024-01-02", 1.0), price(2, "2024-01-02", 1.0)],
    )
    assert prices.price_series(t, "BBB").count() == 0
    assert prices.price_series(t, "ZZZ").count() == 0
    assert prices.price_series(t).count() == 1
    with pytest.raises(ValueError):
        prices.price_series(t, "  ")
    with pytest.raises(ValueError):
        prices.price_series(t, start="2024-1-1")


def test_windows_see_only_the_range(spark):
    t = tables(
        spark,
        company=[company(1, "AAA")],
        price_daily=[price(1, d, float(i)) for i, d in enumerate(days("2024-01-01", 5), 1)],
    )
    first = dicts(prices.price_series(t, "AAA", "2024-01-03"))[0]
    assert first["daily_return_pct"] is None and first["ma_30_day"] == 3.0


def test_range_window():
    end = dt.date(2022, 12, 12)
    assert range_window(end, "1W") == (dt.date(2022, 12, 5), end)
    assert range_window("2022-12-12", "YTD") == (dt.date(2022, 1, 1), end)
    assert range_window(end, "MAX") == (dt.date(1970, 1, 4), end)
    assert range_window(end, "nonsense") == range_window(end, "1Y")
    assert range_window(end, "5Y")[0] == end - dt.timedelta(days=1825)


def test_latest_date_looks_back_as_far_as_needed(spark):
    t = tables(
        spark,
        price_daily=[price(1, d, 1.0) for d in ("1990-01-01", "2020-01-01", "2024-01-01")],
    )
    find = lambda text: latest_date(t.price_daily, day(text))
    assert find("2024-01-01") == day("2024-01-01")
    assert find("2023-12-31") == day("2020-01-01")
    assert find("2019-06-01") == day("1990-01-01")
    assert find("1980-01-01") is None
    assert latest_date(t.price_daily) == day("2024-01-01")


def test_stored_prices_are_read_by_month(spark, folder):
    t = tables(
        spark,
        price_daily=[price(1, d, 1.0) for d in ("2023-11-05", "2024-01-05", "2024-01-20")],
    )
    save_prices(t.price_daily, f"{folder}/price_daily")
    stored = load_tables(spark, folder, ["price_daily"]).price_daily
    part = between(stored, day("2024-01-01"), day("2024-01-10"))
    assert part.count() == 1
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "trading_month" in plan.split("PartitionFilters: [")[1].split("]")[0]
    pushed = plan.split("PushedFilters: [")[1]
    assert "GreaterThanOrEqual(trading_date,2024-01-01)" in pushed
    assert len(part.inputFiles()) >= 1
    files = spark.read.parquet(f"{folder}/price_daily").select("trading_month").distinct()
    assert files.count() == 2


def test_fixture_dates_serialise(spark):
    t = tables(spark, company=[company(1, "AAA")], price_daily=[price(1, "2024-01-02", 1.5)])
    assert json.loads(prices.price_series(t, "AAA").toJSON().first())["close"] == 1.5
