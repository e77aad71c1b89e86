"""News of a company and companies with unusually many mentions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelens.functions.companies import only_ids, with_ticker
from pricelens.functions.params import optional_ticker, positive_int
from pricelens.functions.size import MAX_ARTICLES, MAX_SECTORS, sized_join, skewed_join
from pricelens.functions.windows import first_rows
from pricelens.tables import NEWS_FOLDERS, Tables, listed_companies

ARTICLE_COLUMNS = (
    "source",
    "title",
    "summary",
    "url",
    "lm_level",
    "lm_score1",
    "lm_score2",
    "lm_sentiment",
)


def _first_moment(news: DataFrame, lookback_days: int, now: dt.datetime | None) -> Column:
    if now is None:
        first = F.current_timestamp() - F.make_dt_interval(F.lit(lookback_days))
    else:
        first = F.lit((now - dt.timedelta(days=lookback_days)).isoformat(sep=" "))
    return first.cast(news.schema["published_at"].dataType)


def _recent(news: DataFrame, lookback_days: int, now: dt.datetime | None) -> DataFrame:
    """Articles from `lookback_days` before `now` on; later ones are not cut off."""
    first = _first_moment(news, lookback_days, now)
    return _from_day(news, first).filter(F.col("published_at") >= first)


def _folder(rows: DataFrame) -> list[str]:
    """The column that names the folders of a table that `store_tables` wrote."""
    return [c for c in NEWS_FOLDERS if c in rows.columns]


def _from_day(rows: DataFrame, first: Column) -> DataFrame:
    """Skips the folders of days or months before, in a table that `store_tables` wrote. A day less is skipped, as the
    table may have been written under another time zone."""
    for column in _folder(rows):
        day = F.date_trunc(NEWS_FOLDERS[column], F.date_sub(F.to_date(first), 1))
        rows = rows.filter(F.col(column) >= F.to_date(day))
    return rows


def _seen(mentions: DataFrame, recent: DataFrame, how: str = "inner") -> DataFrame:
    """Mentions of recent articles. Stored tables are merged bucket by bucket, where they lie; of others the articles are
    broadcast if they are few."""
    folder = _folder(mentions)
    if folder and folder == _folder(recent):
        return mentions.drop(*folder).hint("merge").join(recent.drop(*folder), "article_id", how)
    return sized_join(mentions, recent, "article_id", recent, MAX_ARTICLES, how)


def _newest(seen: DataFrame, recency: list, limit: int) -> DataFrame:
    """The first `limit` mentions per company, each copy a row, with their rank."""
    order = [*recency, F.desc_nulls_last("mention_confidence")]
    of_company = Window.partitionBy("company_id")
    before = F.sum("copies").over(
        of_company.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        first_rows(seen, ["company_id"], order, limit)
        .withColumn("room", F.lit(limit) - F.coalesce(before, F.lit(0)))
        .filter("room > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", "room"))))
        .withColumn("recency_rank", F.rank().over(of_company.orderBy(*recency)))
        .drop("copies", "room", "copy")
    )


def company_news(
    tables: Tables, ticker=None, lookback_days=30, limit=10, now: dt.datetime | None = None
) -> DataFrame:
    """Newest articles that mention the company, at most `limit` per company.

    `articles_in_window` counts each article once; the rows themselves keep double mentions,
    which share a `recency_rank`. Only ids and times pass the join and the ranking; the texts
    join the few rows that are left.
    """
    ticker = optional_ticker(ticker)
    lookback_days = positive_int(lookback_days, 30, "lookback_days")
    limit = positive_int(limit, 10, "limit")
    companies = with_ticker(listed_companies(tables, "left"), ticker)
    mentions = tables.article_mention
    if ticker is not None:
        mentions = only_ids(mentions, with_ticker(tables.company, ticker))
    recent = _recent(tables.news_article, lookback_days, now)
    mentions = _from_day(mentions, _first_moment(tables.news_article, lookback_days, now))
    folder = _folder(mentions) if _folder(mentions) == _folder(recent) else []
    recency = [F.desc("published_at"), F.desc("article_id")]
    seen = (
        _seen(
            mentions.select("article_id", "company_id", "mention_confidence", *folder),
            recent.select("article_id", "published_at", *folder),
        )
        # Equal mentions collapse here. The filter is always true; it keeps the plan below equal
        # for the counts and the newest rows, so that Spark runs it once.
        .groupBy("company_id", "article_id", "published_at", "mention_confidence")
        .agg(F.count("*").alias("copies"))
        .filter("copies > 0")
    )
    counts = seen.groupBy("company_id").agg(
        F.count_distinct("article_id").alias("articles_in_window")
    )
    newest = _newest(seen, recency, limit).drop("published_at")
    result = (
        newest.join(counts, "company_id")
        .join(
            companies.select(
                "company_id", "company_name", "ticker", "sector_name", "industry_name"
            ),
            "company_id",
        )
        .join(recent.select("article_id", "published_at", *ARTICLE_COLUMNS), "article_id")
    )
    if ticker is not None:
        result = result.orderBy(*recency).limit(limit)
    return result.select(
        "company_name",
        "ticker",
        "sector_name",
        "industry_name",
        "source",
        "published_at",
        "title",
        "summary",
        "url",
        "lm_level",
        "lm_score1",
        "lm_score2",
        "lm_sentiment",
        "mention_confidence",
        "articles_in_window",
        "recency_rank",
    )


def sentiment_label(sentiment="lm_sentiment") -> Column:
    """Lower-cased sentiment, null when empty."""
    return F.lower(F.nullif(F.col(sentiment), F.lit("")))


def trending_news(
    tables: Tables,
    lookback_days=30,
    min_articles=5,
    limit=10,
    now: dt.datetime | None = None,
) -> DataFrame:
    """Companies with more mentioning articles than the mean of their sector.

    The mean covers the sector's companies with at least one mention, also those below
    `min_articles`.
    """
    lookback_days = positive_int(lookback_days, 30, "lookback_days")
    min_articles = positive_int(min_articles, 5, "min_articles")
    limit = positive_int(limit, 10, "limit")
    recent = _recent(tables.news_article, lookback_days, now)
    mentions = _from_day(tables.article_mention, _first_moment(tables.news_article, lookback_days, now))
    folder = _folder(mentions) if _folder(mentions) == _folder(recent) else []
    counts = (
        _seen(mentions.select("article_id", "company_id", *folder), recent.select("article_id", *folder), "left_semi")
        .groupBy("company_id")
        .agg(F.count_distinct("article_id").alias("article_count"))
        .join(listed_companies(tables), "company_id")
    )
    averages = counts.groupBy("sector_id").agg(
        F.avg("article_count").alias("avg_sector_mentions")
    )
    order = [F.desc("article_count"), F.asc("ticker"), F.asc("company_id")]
    enough = counts.filter(F.col("article_count") >= min_articles)
    best = (
        skewed_join(enough, averages, "sector_id", tables.sector, MAX_SECTORS)
        .filter("article_count > avg_sector_mentions")
        .orderBy(*order)
        .limit(limit)
    )
    in_sector = Window.partitionBy("sector_id").orderBy(F.desc("article_count"))
    return (
        best.withColumn("sector_rank", F.rank().over(in_sector))
        .orderBy(*order)
        .select(
            "ticker",
            "company_name",
            "sector_name",
            "industry_name",
            "article_count",
            "avg_sector_mentions",
            "sector_rank",
        )
    )
