from __future__ import annotations

import datetime as dt

import pytest
from star import company, dicts, price, tables

from pricelens.functions.params import optional_date, positive_int
from pricelens.operators import directory, news
from pricelens.tables import load_tables, store_tables

NOW = dt.datetime(2024, 2, 1, 12)


def article(article_id, published_at, sentiment="Positive"):
    return (article_id, "wire", f"title {article_id}", "text", f"http://x/{article_id}",
            published_at, 1, 0.1, 0.2, sentiment)


def _news(spark, mentions, articles, companies=None):
    return tables(
        spark,
        company=companies or [company(1, "AAA"), company(2, "BBB", None)],
        article_mention=mentions,
        news_article=articles,
    )


ARTICLES = [
    article(1, dt.datetime(2024, 1, 2, 12)),
    article(2, dt.datetime(2024, 1, 2, 11, 59)),
    article(3, dt.datetime(2030, 1, 1)),
    article(4, dt.datetime(2024, 1, 20), ""),
]


def test_window_edges_and_double_mentions(spark):
    t = _news(
        spark,
        [(1, 1, 0.5), (2, 1, 0.5), (3, 1, 0.5), (4, 1, 0.5), (4, 1, 0.5), (4, 2, 0.9)],
        ARTICLES,
    )
    rows = dicts(news.company_news(t, " aaa", now=NOW).withColumn("label", news.sentiment_label()))
    # The future article and the one on the edge are in, the one a minute older is not.
    assert [(r["title"], r["recency_rank"]) for r in rows] == [
        ("title 3", 1), ("title 4", 2), ("title 4", 2), ("title 1", 4),
    ]
    assert {r["articles_in_window"] for r in rows} == {3}
    assert [r["label"] for r in rows] == ["positive", None, None, "positive"]
    other = dicts(news.company_news(t, "BBB", now=NOW))
    assert other[0]["sector_name"] is None and len(other) == 1


@pytest.mark.parametrize("limit", [1, 2, 3, 4, 1500])
def test_limit_counts_rows_not_articles(spark, limit):
    t = _news(spark, [(3, 1, 0.5), (4, 1, 0.5), (4, 1, 0.5), (4, 1, 0.7), (1, 1, None)], ARTICLES)
    rows = dicts(news.company_news(t, limit=limit, now=NOW))
    ranks = sorted(r["recency_rank"] for r in rows)
    assert ranks == [1, 2, 2, 2, 5][:limit]


def test_trending_rules(spark):
    articles = [article(i, dt.datetime(2024, 1, 15)) for i in range(1, 20)]
    mentions = [(i, 1, 0.5) for i in range(1, 8)]
    mentions += [(i, 2, 0.5) for i in range(1, 6)] + [(1, 2, 0.5)]
    mentions += [(1, 3, 0.5)]
    mentions += [(i, 4, 0.5) for i in range(1, 20)]
    mentions += [(i, 5, 0.5) for i in range(1, 10)]
    listed = [company(1, "A"), company(2, "B"), company(3, "C"), company(4, "N", None),
              company(5, "E", 20)]
    t = _news(spark, mentions, articles, listed)
    rows = dicts(news.trending_news(t, now=NOW))
    # E is alone in its sector, so not above its mean; C counts in the mean of A and B.
    assert [(r["ticker"], r["article_count"], r["sector_rank"]) for r in rows] == [
        ("A", 7, 1), ("B", 5, 2),
    ]
    assert rows[0]["avg_sector_mentions"] == pytest.approx((7 + 5 + 1) / 3)
    assert [r["ticker"] for r in dicts(news.trending_news(t, min_articles=6, now=NOW))] == ["A"]
    assert news.trending_news(t, lookback_days=5, now=NOW).count() == 0


def test_many_articles_take_a_plain_join(spark, monkeypatch):
    t = _news(spark, [(3, 1, 0.5), (4, 1, 0.5), (4, 1, 0.5), (1, 2, 0.3)] * 5, ARTICLES)
    listed, counted = news.company_news(t, now=NOW), news.trending_news(t, min_articles=1, now=NOW)
    monkeypatch.setattr(news, "MAX_ARTICLES", 0)
    salted = news.company_news(t, now=NOW)
    plan = salted._jdf.queryExecution().toString()
    assert "_salt" not in plan and "explode(sequence(0" not in plan
    assert sorted(map(str, salted.collect())) == sorted(map(str, listed.collect()))
    again = news.trending_news(t, min_articles=1, now=NOW)
    assert again.collect() == counted.collect()


def test_now_defaults_to_the_clock(spark):
    today = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    t = _news(
        spark,
        [(1, 1, 0.5), (2, 1, 0.5)],
        [article(1, today - dt.timedelta(days=29)), article(2, today - dt.timedelta(days=31))],
    )
    assert [r["title"] for r in dicts(news.company_news(t))] == ["title 1"]


_DIRECTORY = ("sector", "industry", "company")


def _directory(spark):
    return tables(
        spark,
        company=[
            company(1, "ABC", 10, "Zeta"), company(2, "AB", 11, "Yeta"),
            company(3, "ZZ", None, "abacus"), company(4, "A_C", 20, "Oil"),
        ],
        company_profile=[
            (1, "s", "l", "Rome", None, "Italy", "b", 1.0, 50.0, 5.0, None, None),
            (2, "s", "l", "", "", None, "b", 1.0, 0.0, None, None, None),
        ],
        company_financial_snapshot=[
            (1, 1.0, None, None, None, 3.0, 9.0, 0.0, None, None, None, "f"),
            (2, 1.0, None, None, None, 3.0, None, 0.0, 7.0, None, None, "f"),
        ],
        price_daily=[price(1, "2024-01-01", 1.0), price(1, "2024-01-02", None, 1, 7),
                     price(1, "2024-01-02", 3.0, 2, 8)],
    )


@pytest.mark.parametrize("stored", [False, True])
def test_search_order_and_wildcards(spark, folder, stored):
    t = _directory(spark)
    if stored:
        store_tables(t, folder)
        t = load_tables(spark, folder, _DIRECTORY)
        assert t.company_lookup.count() == 8
    find = lambda q, **k: [r["ticker"] for r in dicts(directory.search_companies(t, q, **k))]
    assert find(" ab ") == ["AB", "ABC", "ZZ"]
    assert find("ab", limit=1) == ["AB"]
    assert find("a_c") == ["A_C", "ABC"]
    assert find("a\\_c") == ["A_C"]
    assert find("\\a\\b\\c") == ["ABC"]
    assert find("abac") == ["ZZ"]
    assert find("nothing") == [] and find("%")[0] == "AB"
    for blank in ("", "  ", None):
        with pytest.raises(ValueError):
            directory.search_companies(t, blank)


def test_looked_up_beginnings_reach_the_scan(spark, folder):
    store_tables(_directory(spark), folder)
    t = load_tables(spark, folder, _DIRECTORY)
    for text, pushed in (("ab", "StringStartsWith(key,ab)"), ("a_c", "StringStartsWith(key,a)"), ("a\\_c", "StringStartsWith(key,a_c)")):
        plan = directory._looked_up(t.company_lookup, text, 5)._jdf.queryExecution().executedPlan().toString()
        assert pushed in plan.split("PushedFilters: [")[1].split("]")[0]
    keys = [r["key"] for r in t.company_lookup.collect()]
    assert keys == sorted(keys)


def test_listings(spark):
    t = _directory(spark)
    assert [r["ticker"] for r in dicts(directory.list_companies(t))] == ["AB", "ABC", "A_C", "ZZ"]
    found = dicts(directory.sector_companies(t, " Technology "))
    assert [r["ticker"] for r in found] == ["AB", "ABC"]
    assert directory.sector_companies(t, "technology").count() == 0
    names = [r["sector_name"] for r in dicts(directory.list_sectors(t))]
    assert names == ["Energy", "Technology"]


def test_profile(spark):
    t = _directory(spark)
    rows = {
        r["ticker"]: r
        for r in dicts(directory.profile_labels(directory.company_profile(t)))
    }
    assert len(rows) == 4 and len(directory.company_profile(t).columns) == 32
    one = rows["ABC"]
    # The best feed's null close of the newest day is the latest close.
    assert (one["latest_close"], one["latest_volume"]) == (None, 7)
    assert (one["market_cap"], one["ebitda"]) == (50.0, 5.0)
    assert one["location"] == "Rome, Italy"
    assert (one["range_52_week_low"], one["range_52_week_high"]) == (3.0, 9.0)
    two = rows["AB"]
    assert (two["market_cap"], two["ebitda"]) == (0.0, 7.0)
    assert two["location"] is None and two["range_52_week_low"] is None
    assert rows["ZZ"]["sector_name"] is None and rows["ZZ"]["latest_trading_date"] is None
    assert [r["company_id"] for r in dicts(directory.company_profile(t, "abc"))] == [1]
    assert directory.company_profile(t, "none").count() == 0


def test_argument_rules():
    assert positive_int("", 5, "n") == 5 and positive_int("12", 5, "n") == 12
    for bad in (0, -1, 1.5, "x", True):
        with pytest.raises(ValueError):
            positive_int(bad, 5, "n")
    assert optional_date("", "d") is None
    for bad in ("2024-13-01", "24-01-01", "2024-01-01x", 5):
        with pytest.raises(ValueError):
            optional_date(bad, "d")
