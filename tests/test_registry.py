"""Every registered query against its SQL, and the plans of the price queries."""

from __future__ import annotations

import re
from dataclasses import replace

import pytest
from compare import connect, differences

import __spark_entry__ as contract
from registry.mapping import tables_c

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(contract.queries()) - set(contract.oracle_sql()) <= set(contract.TEXT_QUERIES)
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(contract.oracle_sql()) - set(contract.TEXT_QUERIES)))
def test_query_equals_sql(spark, duck, name):
    found = differences(
        contract.queries()[name](spark, SF_DIR), duck, contract.oracle_sql()[name]
    )
    assert found == []


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Map C written as star-schema Parquet."""
    from pricelens.tables import load_tables, save_prices

    root = str(tmp_path_factory.mktemp("star"))
    t = tables_c(spark, SF_DIR)
    names = ["sector", "industry", "company", "price_source"]
    for name in names:
        getattr(t, name).write.parquet(f"{root}/{name}")
    save_prices(t.price_daily, f"{root}/price_daily")
    return load_tables(spark, root, [*names, "price_daily"])


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _scans(plan, column):
    return [line for line in plan.splitlines() if "FileScan" in line and column in line]


def test_gainers_plan(stored):
    from pricelens.operators.leaders import top_gainers

    plan = _plan(top_gainers(stored, "2024-01-30"))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "TakeOrderedAndProject" in plan
    for scan in _scans(plan, "trading_date"):
        assert "trading_month" in scan
        assert re.search(r"PartitionFilters: \[[^\]]*trading_month", scan)
    # The feeds are merged by an aggregate that keeps one row per company and day in each task. It
    # orders rows by all quotes, so it reads them all and is a sort aggregate.
    assert "partial_min(" in plan


def test_series_plan_has_no_window_over_all_rows(stored):
    from pricelens.operators.prices import price_series

    plan = _plan(price_series(stored))
    single = [line for line in plan.splitlines() if "SinglePartition" in line]
    # Only the table of feeds, two columns and one row per feed, meets in one partition. The merge of
    # the feeds stands in the plan twice, for the ranks and for the rows, until its exchange is reused.
    assert len(single) <= 2


def test_ranks_and_rows_share_one_merge_of_the_feeds(stored):
    from pricelens.operators.prices import price_series

    for ticker in (None, "C000007"):
        series = price_series(stored, ticker)
        series.collect()
        final = _plan(series).split("Initial Plan")[0]
        assert "ReusedExchange [company_id" in final
        assert final.count("partial_min(") == 1


def test_momentum_cuts_before_the_shuffle(stored):
    from pricelens.operators.leaders import sector_momentum

    plan = _plan(sector_momentum(stored, "2024-01-30"))
    assert re.search(r"WindowGroupLimit.*Partial", plan)


def test_no_python_in_the_plans(spark):
    for name in ("price_series", "company_news", "basic_clean_price", "load_ready"):
        df = contract.queries()[name](spark, SF_DIR)
        assert "Python" not in _plan(df) and "Arrow" not in _plan(df)


@pytest.fixture(scope="module")
def bucketed(spark, tmp_path_factory):
    """Both maps as `store_tables` writes them, the news by day of a few weeks."""
    from pyspark.sql import functions as F

    from pricelens.tables import load_tables, store_tables
    from registry.mapping import NEWS, PRICES, tables_s

    found = {}
    c, s = tables_c(spark, SF_DIR), tables_s(spark, SF_DIR, NEWS)
    recent = s.news_article.where(F.col("published_at") >= "2001-07-15")
    for name, t, names in (("prices", c, PRICES), ("news", replace(s, news_article=recent), NEWS)):
        root = str(tmp_path_factory.mktemp(name))
        store_tables(t, root, buckets=3, news_folder="published_day")
        found[name] = load_tables(spark, root, names)
        again = load_tables(spark, root, names)  # the catalog knows the tables by now
        assert again.company.count() == found[name].company.count()
    return found


def _moves(plan, column):
    """Shuffles by a column, in a plan that has not run."""
    return [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line and f"({column}#" in line]


def test_stored_prices_need_no_shuffle_by_company(bucketed):
    from pricelens.operators import prices

    t = bucketed["prices"]
    primary = prices.primary_price(t.price_daily, t.price_source)
    for df in (primary, prices.with_daily_return(primary), prices.with_moving_average(primary, 7)):
        plan = _plan(df)
        assert "Bucketed: true" in plan and "hashpartitioning" not in plan
    plan = _plan(prices.price_series(t, start="2024-01-01", end="2024-01-10"))
    assert "Bucketed: true" in plan and not _moves(plan, "company_id")
    for scan in _scans(plan, "trading_date"):
        assert "trading_month" in scan.split("PartitionFilters: [")[1].split("]")[0]


def test_stored_news_are_pruned_and_merged_where_they_lie(bucketed):
    from pricelens.operators import news
    from registry.queries import NOW

    for df in (news.company_news(bucketed["news"], lookback_days=5, now=NOW), news.trending_news(bucketed["news"], lookback_days=5, now=NOW)):
        plan = _plan(df)
        scans = [x for x in plan.splitlines() if "FileScan" in x and "published_day" in x]
        assert scans
        for scan in scans:
            assert "published_day" in scan.split("PartitionFilters: [")[1].split("]")[0]
        assert "SortMergeJoin [article_id" in plan and not _moves(plan, "article_id")
        # below the merge of mentions and articles there is nothing but sorts of buckets
        merge = plan[plan.index("SortMergeJoin [article_id") :]
        assert "Exchange" not in merge[: merge.index("FileScan")]


def test_stored_news_give_the_same_rows(spark, bucketed):
    from pyspark.sql import functions as F

    from pricelens.operators import news
    from registry.mapping import NEWS, tables_s
    from registry.queries import NOW

    plain = tables_s(spark, SF_DIR, NEWS)
    for ticker in (None, "S000003"):
        same = [
            sorted(map(str, news.company_news(t, ticker, lookback_days=10, now=NOW).withColumn("published_at", F.col("published_at").cast("string")).collect()))
            for t in (plain, bucketed["news"])
        ]
        assert same[0] == same[1]


def test_banded_ranks_equal_windowed_ones(spark):
    """Days that lie in several bands, with ties, null closes and a day without a close."""
    from pricelens.operators import prices

    rows = [(i, f"2024-01-0{1 + i % 2}", None if i % 11 == 0 else float(i * 7 % 90)) for i in range(400)]
    rows += [(i, "2024-01-03", None) for i in range(5)]
    frame = spark.createDataFrame(rows, "company_id BIGINT, trading_date STRING, close DOUBLE")
    frame = frame.withColumn("trading_date", frame.trading_date.cast("date"))
    of = spark.range(400).selectExpr("id AS company_id", "id % 3 AS sector_id")
    few, many = (prices.sector_position(frame, of, most) for most in (1000, 0))
    assert "spark_partition_id" not in _plan(few) and len(few.collect()) == 405
    key = lambda r: (r.company_id, str(r.trading_date), r.sector_price_rank, None if r.sector_avg_close is None else round(r.sector_avg_close, 9))
    assert sorted(map(str, map(key, few.collect()))) == sorted(map(str, map(key, many.collect())))
