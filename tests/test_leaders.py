from __future__ import annotations

import random

import pytest
from star import company, day, days, dicts, price, tables

from pricelens.functions import size
from pricelens.operators import leaders
from pricelens.operators.industries import industry_rotations


def test_gainers_pairing_rules(spark):
    t = tables(
        spark,
        company=[
            company(1, "UP"), company(2, "OLD"), company(3, "ONE"), company(4, "ZERO"),
            company(5, "LOSE"), company(6, "NOIND", None), company(7, "FAR"),
        ],
        price_daily=[
            price(1, "2024-01-29", 10.0), price(1, "2024-01-30", 12.0),
            # Newest row older than the anchor day, but within ten days of it.
            price(2, "2024-01-20", 10.0), price(2, "2024-01-22", 13.0),
            price(3, "2024-01-30", 5.0),
            price(4, "2024-01-29", 0.0), price(4, "2024-01-30", 5.0),
            price(5, "2024-01-29", 10.0), price(5, "2024-01-30", 1.0),
            price(6, "2024-01-29", 10.0), price(6, "2024-01-30", 99.0),
            price(7, "2024-01-19", 1.0), price(7, "2024-01-30", 99.0),
        ],
    )
    rows = dicts(leaders.top_gainers(t, "2024-02-03"))
    assert [(r["ticker"], r["sector_rank"]) for r in rows] == [("OLD", 1), ("UP", 2)]
    assert rows[0]["trading_date"] == day("2024-01-22")
    assert rows[0]["pct_change"] == pytest.approx(30.0)
    # The null change of ZERO does not count in the mean.
    assert rows[0]["avg_sector_change"] == pytest.approx((30 + 20 - 90) / 3)
    assert leaders.top_gainers(t, "2020-01-01").count() == 0
    with pytest.raises(ValueError):
        leaders.top_gainers(t, "")
    with pytest.raises(ValueError):
        leaders.top_gainers(t, "2024-02-03", limit=0)


def _ranked(spark, count=40, seed=2):
    rng = random.Random(seed)
    listed = [company(i, f"T{i:02d}", rng.choice([10, 11, 20])) for i in range(count)]
    closes = [
        price(c[0], d, float(rng.choice([0, 1, 2, 4, 5, 8, 10])))
        for c in listed
        for d in days("2024-01-10", 12)
    ]
    return tables(spark, company=listed, price_daily=closes)


def test_limit_does_not_change_ranks(spark):
    t = _ranked(spark)
    for query in (
        lambda n: leaders.top_gainers(t, "2024-01-21", n),
        lambda n: leaders.sector_momentum(t, "2024-01-21", limit=n),
        lambda n: leaders.top_average_returns(t, "2024-01-21", 3, n),
        lambda n: leaders.source_disagreement(t, "2024-01-01", "2024-01-31", 1, n),
    ):
        whole = query(1001).collect()
        assert len(whole) > 4
        for n in (1, 3):
            assert query(n).collect() == whole[:n]


def test_many_sectors_take_the_salted_join(spark, monkeypatch):
    t = _ranked(spark)
    gainers = leaders.top_gainers(t, "2024-01-21", 50).collect()
    momentum = leaders.sector_momentum(t, "2024-01-21").collect()
    monkeypatch.setattr(leaders, "MAX_SECTORS", 0)
    assert leaders.top_gainers(t, "2024-01-21", 50).collect() == gainers
    salted = leaders.sector_momentum(t, "2024-01-21")
    assert salted.collect() == momentum
    assert "_salt" in salted._jdf.queryExecution().toString()


def test_momentum_needs_seven_earlier_rows_and_the_anchor_day(spark):
    closes = [price(1, d, float(i)) for i, d in enumerate(days("2024-01-10", 8), 10)]
    closes += [price(2, d, 5.0) for d in days("2024-01-11", 7)]
    closes += [price(3, d, 5.0) for d in days("2024-01-08", 9)]
    closes += [price(4, d, 5.0) for d in days("2024-01-10", 8)]
    t = tables(
        spark,
        company=[company(i, n) for i, n in ((1, "UP"), (2, "SHORT"), (3, "STALE"), (4, "FLAT"))],
        price_daily=closes,
    )
    rows = dicts(leaders.sector_momentum(t, "2024-01-17"))
    assert [r["ticker"] for r in rows] == ["UP"]
    assert rows[0]["return_7d"] == pytest.approx(70.0)
    assert rows[0]["avg_sector_return"] == pytest.approx(35.0)
    assert leaders.sector_momentum(t, "2024-01-17", "Energy").count() == 0
    assert leaders.sector_momentum(t, "2024-01-17", " Technology").count() == 0
    assert leaders.sector_momentum(t, "2024-01-17", " ").count() == 1
    assert leaders.sector_momentum(t, "2000-01-01").count() == 0


def test_a_null_return_ranks_first(spark):
    closes = [price(1, d, float(i)) for i, d in enumerate(days("2024-01-10", 8), 10)]
    closes += [price(2, d, 5.0) for d in days("2024-01-10", 8)]
    closes += [price(3, d, 0.0 if i == 0 else 5.0) for i, d in enumerate(days("2024-01-10", 8))]
    closes += [price(4, d, None if i == 7 else 5.0) for i, d in enumerate(days("2024-01-10", 8))]
    t = tables(
        spark, company=[company(i, f"T{i}") for i in (1, 2, 3, 4)], price_daily=closes
    )
    rows = dicts(leaders.sector_momentum(t, "2024-01-17"))
    assert [(r["ticker"], r["sector_rank"]) for r in rows] == [("T1", 3)]


def test_average_returns_anchor_and_minimum(spark):
    closes = [price(1, d, float(i)) for i, d in enumerate(days("2024-01-01", 4), 1)]
    closes += [price(2, d, float(i)) for i, d in enumerate(days("2024-01-02", 3), 1)]
    closes += [price(3, d, 5.0, 99) for d in days("2024-02-01", 2)]
    t = tables(spark, company=[company(i, f"T{i}") for i in (1, 2, 3)], price_daily=closes)
    rows = dicts(leaders.top_average_returns(t, "2024-03-01", 3))
    # The later rows come from an unknown feed, so the anchor is 2024-01-04.
    assert [(r["ticker"], r["n_obs"], r["return_rank"]) for r in rows] == [("T1", 3, 1)]
    assert rows[0]["avg_daily_return"] == pytest.approx((1 + 1 / 2 + 1 / 3) / 3)
    # No day up to the end date: the newest day of all is used.
    assert leaders.top_average_returns(t, "1999-01-01", 2).count() == 2
    assert leaders.top_average_returns(t, "2024-01-04", 4).count() == 0


def test_single_observation_has_no_volatility(spark):
    t = tables(
        spark,
        company=[company(1, "A")],
        price_daily=[price(1, "2024-01-01", 1.0), price(1, "2024-01-02", 2.0)],
    )
    row = dicts(leaders.top_average_returns(t, "2024-01-02", 1))[0]
    assert row["n_obs"] == 1 and row["return_volatility"] is None


def test_disagreement_counts_rows_and_keeps_unclassified(spark):
    t = tables(
        spark,
        company=[company(1, "A", None), company(2, "B"), company(3, "C")],
        price_daily=[
            price(1, "2024-01-01", 214.98, 1), price(1, "2024-01-01", 215.67, 2),
            price(1, "2024-01-02", 10.0, 1), price(1, "2024-01-02", None, 2),
            price(2, "2024-01-01", 7.0, 1), price(2, "2024-01-01", 7.0, 2),
            price(2, "2024-01-03", 7.0, 1), price(2, "2024-01-03", 7.0, 1),
            price(3, "2024-01-01", 0.0, 1), price(3, "2024-01-01", 0.0, 2),
        ],
    )
    rows = dicts(leaders.source_disagreement(t, "2024-01-01", "2024-01-31"))
    assert [r["ticker"] for r in rows] == ["A", "B", "C"]
    assert rows[0]["close_spread"] == pytest.approx(0.69, abs=0.01)
    assert rows[0]["pct_spread"] == pytest.approx(0.32, abs=0.01)
    # Equal closes are a spread of zero; the later of two equal days is shown.
    assert (rows[1]["pct_spread"], rows[1]["trading_date"]) == (0.0, day("2024-01-03"))
    assert rows[2]["pct_spread"] is None
    assert all(r["close_spread"] >= 0 for r in rows)
    with pytest.raises(ValueError):
        leaders.source_disagreement(t, None, "2024-01-31")


def test_rotations_rules(spark):
    def month(company_id, first, change):
        return [price(company_id, first, 100.0), price(company_id, days(first, 2)[1], 100 * change)]

    t = tables(
        spark,
        company=[company(1, "A", 10), company(2, "B", 11), company(3, "X", None)],
        price_daily=[
            *month(1, "2024-01-10", 1.1), *month(2, "2024-01-10", 1.2),
            *month(3, "2024-01-10", 9.0),
            # Software is missing in February and compares March with January.
            *month(2, "2024-02-10", 1.2),
            *month(1, "2024-03-10", 1.9), *month(2, "2024-03-10", 1.0),
        ],
    )
    rows = dicts(industry_rotations(t, "2024-01-01", "2024-12-31"))
    found = {(r["industry_name"], str(r["month"])): (r["prev_rnk"], r["rnk"]) for r in rows}
    assert found == {
        ("Chips", "2024-02-01"): (1, 1),
        ("Software", "2024-03-01"): (2, 1),
        ("Chips", "2024-03-01"): (1, 2),
    }
    assert [r["rank_improvement"] for r in rows] == [-1, 1, 0]
    # Compounded over the month; the first return goes back to the month before.
    march = next(r for r in rows if r["industry_name"] == "Software")
    assert march["industry_month_ret"] == pytest.approx(100 / 110 * 1.9 - 1)


def test_rotations_drop_total_losses(spark):
    t = tables(
        spark,
        company=[company(1, "A", 10)],
        price_daily=[
            price(1, "2024-01-10", 100.0), price(1, "2024-01-11", 0.05),
            price(1, "2024-01-12", 0.1), price(1, "2024-02-12", 0.2),
        ],
    )
    rows = dicts(industry_rotations(t, "2024-01-01", "2024-12-31"))
    assert rows[0]["industry_month_ret"] == pytest.approx(1.0)


def test_results_do_not_depend_on_partitions(spark):
    t = _ranked(spark)
    first = leaders.top_gainers(t, "2024-01-21", 50).collect()
    moved = type(t)(**{**t.__dict__, "price_daily": t.price_daily.repartition(7, "close")})
    assert leaders.top_gainers(moved, "2024-01-21", 50).collect() == first


def test_at_most(spark):
    assert size.at_most(spark.range(5), 5)
    assert not size.at_most(spark.range(6), 5)
