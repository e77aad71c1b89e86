"""The star schema seen in the TPC-H-like test tables.

Map C: customers are companies, their events the price feeds. Map S: suppliers are companies,
line items their prices and mentions, orders the news. Tables are given as SQL expressions; only
the ones a query names are opened.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pricelens.tables import Tables

# Event type -> (source_id, priority_rank).
FEEDS_C = {
    "click": (1, 3),
    "error": (2, 5),
    "purchase": (3, 1),
    "signup": (4, 4),
    "view": (5, 2),
}
# Return flag -> (source_id, priority_rank).
FEEDS_S = {"A": (1, 2), "N": (2, 1), "R": (3, 3)}

# Given, so that opening a table starts no job to find its columns.
SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": (
        "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"
    ),
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
        "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"
    ),
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
        "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
        "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"
    ),
    "events": (
        "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, "
        "props STRING"
    ),
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _feeds(feeds) -> str:
    rows = ", ".join(f"({source_id}L, {rank})" for source_id, rank in feeds.values())
    return f"SELECT * FROM VALUES {rows} AS feeds(source_id, priority_rank)"


def _source_id(column, feeds) -> str:
    cases = " ".join(f"WHEN '{name}' THEN {feed[0]}L" for name, feed in feeds.items())
    return f"CASE {column} {cases} END"


_DIMENSIONS = {
    "sector": (
        "region",
        "SELECT CAST(r_regionkey AS BIGINT) AS sector_id, r_name AS sector_name FROM {region}",
    ),
    "industry": (
        "nation",
        """SELECT CAST(n_nationkey AS BIGINT) AS industry_id, n_name AS industry_name,
                  CAST(n_regionkey AS BIGINT) AS sector_id
           FROM {nation}""",
    ),
}

_MAP_C = {
    **_DIMENSIONS,
    "company": (
        "customer",
        """SELECT c_custkey AS company_id,
                  concat('C', lpad(CAST(c_custkey AS STRING), 6, '0')) AS ticker,
                  c_name AS company_name, c_mktsegment AS exchange,
                  lpad(CAST(c_custkey AS STRING), 10, '0') AS cik,
                  CAST(c_nationkey AS BIGINT) AS industry_id
           FROM {customer}""",
    ),
    "price_source": (None, _feeds(FEEDS_C)),
    "price_daily": (
        "events",
        f"""SELECT user_id AS company_id, {_source_id("event_type", FEEDS_C)} AS source_id,
                   to_date(ts) AS trading_date, min_by(value, event_id) AS open,
                   max(value) AS high, min(value) AS low, max(value) AS close,
                   max(value) AS adj_close, count(*) AS volume
            FROM {{events}} GROUP BY 1, 2, 3""",
    ),
    "company_profile": (
        "customer",
        """SELECT c_custkey AS company_id, c_name AS short_name, upper(c_name) AS long_name,
                  IF(c_custkey % 3 = 0, '', c_mktsegment) AS city,
                  IF(c_custkey % 2 = 0, NULL, CAST(c_nationkey AS STRING)) AS state,
                  IF(c_custkey % 12 = 0, '', 'Country') AS country,
                  CAST(NULL AS STRING) AS long_business_summary, c_acctbal AS current_price,
                  c_acctbal * 1000 AS market_cap,
                  IF(c_custkey % 7 = 0, NULL, c_acctbal * 10) AS ebitda,
                  CAST(NULL AS DOUBLE) AS revenue_growth, CAST(NULL AS DOUBLE) AS weight
           FROM {customer}""",
    ),
    # The mean is taken over whole cents, so that it does not depend on the order of the sum.
    "company_financial_snapshot": (
        "orders",
        """SELECT o_custkey AS company_id,
                  sum(CAST(round(o_totalprice * 100) AS BIGINT)) / count(o_totalprice) / 100.0D
                    AS price,
                  CAST(NULL AS DOUBLE) AS price_earnings, CAST(NULL AS DOUBLE) AS dividend_yield,
                  CAST(NULL AS DOUBLE) AS earnings_share,
                  IF(o_custkey % 4 = 0, NULL, min(o_totalprice)) AS week_52_low,
                  max(o_totalprice) AS week_52_high,
                  IF(o_custkey % 5 = 0, 0.0D, max(o_totalprice) * 100) AS market_cap,
                  IF(o_custkey % 3 = 0, NULL, min(o_totalprice) * 10) AS ebitda,
                  CAST(NULL AS DOUBLE) AS price_sales, CAST(NULL AS DOUBLE) AS price_book,
                  CAST(NULL AS STRING) AS sec_filings
           FROM {orders} GROUP BY o_custkey""",
    ),
}

_MAP_S = {
    **_DIMENSIONS,
    "company": (
        "supplier",
        """SELECT s_suppkey AS company_id,
                  concat('S', lpad(CAST(s_suppkey AS STRING), 6, '0')) AS ticker,
                  s_name AS company_name, CAST(NULL AS STRING) AS exchange,
                  CAST(NULL AS STRING) AS cik, CAST(s_nationkey AS BIGINT) AS industry_id
           FROM {supplier}""",
    ),
    "price_source": (None, _feeds(FEEDS_S)),
    "price_daily": (
        "lineitem",
        f"""SELECT l_suppkey AS company_id, {_source_id("l_returnflag", FEEDS_S)} AS source_id,
                   to_date(l_shipdate) AS trading_date,
                   max(l_extendedprice / l_quantity) AS close
            FROM {{lineitem}} GROUP BY 1, 2, 3""",
    ),
    "news_article": (
        "orders",
        """SELECT o_orderkey AS article_id, o_orderpriority AS source,
                  concat('Order ', CAST(o_orderkey AS STRING)) AS title,
                  CAST(NULL AS STRING) AS summary,
                  concat('http://x/', CAST(o_orderkey AS STRING)) AS url,
                  o_orderdate AS published_at, length(o_orderpriority) AS lm_level,
                  o_totalprice AS lm_score1, CAST(NULL AS DOUBLE) AS lm_score2,
                  CASE o_orderstatus WHEN 'F' THEN 'Positive' WHEN 'O' THEN '' ELSE 'NEGATIVE' END
                    AS lm_sentiment
           FROM {orders}""",
    ),
    "article_mention": (
        "lineitem",
        """SELECT l_orderkey AS article_id, l_suppkey AS company_id,
                  l_discount AS mention_confidence
           FROM {lineitem}""",
    ),
}

LISTING = ("sector", "industry", "company")
PRICES = (*LISTING, "price_source", "price_daily")
NEWS = (*LISTING, "news_article", "article_mention")


def _mapped(spark, sf_dir, definitions, names) -> Tables:
    tables = {}
    for name in names:
        table, sql = definitions[name]
        opened = {} if table is None else {table: read(spark, sf_dir, table)}
        tables[name] = spark.sql(sql, **opened)
    return Tables(**tables)


def tables_c(spark: SparkSession, sf_dir: str, names=PRICES) -> Tables:
    return _mapped(spark, sf_dir, _MAP_C, names)


def tables_s(spark: SparkSession, sf_dir: str, names) -> Tables:
    return _mapped(spark, sf_dir, _MAP_S, names)
