"""DuckDB SQL for the cleaning and staging queries."""

from __future__ import annotations

_COMPANIES = """
companies AS (
  SELECT 'companies.csv' AS source_file,
         CASE WHEN s_nationkey % 7 = 0 THEN ' nan '
              ELSE concat('  n.', CAST(s_nationkey AS VARCHAR), '/x b', chr(9)) END AS symbol,
         concat(' ', s_name, ' ') AS company_name,
         concat(lower(replace(s_name, '#', '.')), ' ') AS old_ticker,
         CASE WHEN s_suppkey % 4 = 0 THEN 'None' ELSE 'Active' END AS sentiment_now
  FROM supplier
)"""

_NEWS = """
news AS (
  SELECT concat('news_', CAST(o_orderkey % 3 AS VARCHAR), '.csv') AS source_file,
         concat(' ', o_orderpriority, chr(9)) AS title,
         CASE WHEN o_orderkey % 100 <> 13
              THEN concat('http://x/', CAST(o_orderkey % 100 AS VARCHAR)) END AS url,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END
           AS published_at,
         CASE WHEN o_orderstatus = 'F' THEN 'good' ELSE 'bad time' END AS sentiment,
         CAST(o_orderkey AS VARCHAR) AS article
  FROM orders
)"""

_PRICES = """
numbered AS (
  SELECT *, CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE l_suppkey % 25 END AS number,
         CAST(floor(l_extendedprice / 20000) * 20000 AS BIGINT) AS price,
         CAST(l_quantity AS BIGINT) AS quantity
  FROM lineitem
),
dirty AS (
  SELECT concat(CASE WHEN number < 20 THEN 'sp500/t' ELSE 'other/t' END,
                lpad(CAST(number AS VARCHAR), 2, '0'), '.csv') AS source_file,
         CASE WHEN l_linenumber = 4 AND quantity < 5 THEN 'n/a'
              WHEN l_linenumber = 3 THEN strftime(l_shipdate, '%m/%d/%Y')
              ELSE strftime(l_shipdate, '%Y-%m-%d') END AS date,
         CAST(quantity % 5 AS VARCHAR) AS open,
         CASE WHEN l_linenumber = 7 THEN 'abc'
              ELSE concat(' ', CAST(price AS VARCHAR), ' ') END AS close,
         CASE WHEN l_linenumber <> 2 THEN CAST(price AS VARCHAR) END AS adjusted_close,
         CASE WHEN l_linenumber = 6 THEN '-5'
              WHEN l_linenumber <> 5 THEN CAST(quantity % 5 AS VARCHAR) END AS volume
  FROM numbered
),
parsed AS (
  SELECT source_file,
         CAST(coalesce(try_strptime(date, '%Y-%m-%d'), try_strptime(date, '%m/%d/%Y')) AS DATE)
           AS date,
         open, trim(close) AS close, adjusted_close, volume
  FROM dirty
),
kept AS (
  SELECT source_file, date, TRY_CAST(open AS DOUBLE) AS open, TRY_CAST(close AS DOUBLE) AS close,
         TRY_CAST(adjusted_close AS DOUBLE) AS adjusted_close, TRY_CAST(volume AS DOUBLE) AS volume
  FROM parsed
  WHERE date IS NOT NULL AND close IS NOT NULL AND volume IS NOT NULL
    AND TRY_CAST(volume AS DOUBLE) >= 0
),
cleaned AS (SELECT DISTINCT * FROM kept)"""

_ODD = "CAST(regexp_extract(source_file, 't([0-9]+)', 1) AS INTEGER) % 2 = 1"

_WITH_COMPANIES = f"WITH {_COMPANIES}"
_WITH_NEWS = f"WITH {_NEWS}"
_WITH_PRICES = f"WITH {_PRICES}"

_STRIP = "trim({0}, ' ' || chr(9))"
_SYMBOL = (
    "replace(replace(replace(upper(" + _STRIP + "), '.', '-'), '/', '-'), ' ', '')"
)
_TICKER = "upper(regexp_extract(source_file, '([^/]+)\\.csv$', 1))"
_OUTPUT = "concat(regexp_extract(source_file, '([^/]+)\\.csv$', 1), '__{0}.csv')"


def _stripped(column):
    text = _STRIP.format(column)
    return f"CASE WHEN {text} NOT IN ('nan', 'None', 'NaT') THEN {text} END"


def _companies(where="TRUE", kind=""):
    symbol = f"CASE WHEN s <> 'NAN' THEN s END"
    return f"""{_WITH_COMPANIES},
named AS (
  SELECT source_file, {_SYMBOL.format('symbol')} AS s, {_stripped('company_name')} AS company_name,
         {_SYMBOL.format('old_ticker')} AS old_ticker,
         {_stripped('sentiment_now')} AS sentiment_now
  FROM companies
),
placed AS (
  SELECT source_file, {symbol} AS symbol, company_name, old_ticker, sentiment_now,
         row_number() OVER (PARTITION BY {symbol}
           ORDER BY company_name NULLS LAST, old_ticker NULLS LAST,
                    sentiment_now NULLS LAST) AS place
  FROM named
)
SELECT source_file, symbol, company_name, old_ticker, sentiment_now{kind}
FROM placed WHERE place = 1"""


def _news(kind=""):
    return f"""{_WITH_NEWS},
placed AS (
  SELECT source_file, {_STRIP.format('title')} AS title, url, published_at, sentiment, article,
         row_number() OVER (PARTITION BY source_file, url
           ORDER BY published_at NULLS LAST, {_STRIP.format('title')}, sentiment, article) AS place
  FROM news
)
SELECT source_file, title, url, published_at, sentiment, article{kind}
FROM placed WHERE place = 1"""


_STAGED = f"""{_WITH_PRICES},
combined AS (
  SELECT {_TICKER} AS ticker, date AS trading_date, open, close, adjusted_close AS adj_close,
         volume, 'stock_market_data_sp500' AS source_name,
         {_OUTPUT.format('cleaned')} AS source_file
  FROM cleaned WHERE source_file LIKE 'sp500/%'
),
staged AS (
  SELECT DISTINCT ticker, trading_date, open, close, adj_close, CAST(volume AS BIGINT) AS volume,
         source_name, source_file
  FROM combined WHERE close IS NOT NULL
)"""

ORACLE = {
    "snake_case": f"{_WITH_COMPANIES} SELECT * FROM companies",
    "normalize_strings": f"""{_WITH_COMPANIES}
SELECT source_file, {_stripped('symbol')} AS symbol, {_stripped('company_name')} AS company_name,
       {_stripped('old_ticker')} AS old_ticker, {_stripped('sentiment_now')} AS sentiment_now
FROM companies""",
    "normalize_ticker": f"""{_WITH_COMPANIES}
SELECT company_name, {_SYMBOL.format('symbol')} AS symbol,
       {_SYMBOL.format('old_ticker')} AS old_ticker
FROM companies""",
    "parse_dates": f"{_WITH_NEWS} SELECT article, sentiment, published_at AS published FROM news",
    "drop_duplicates": """
SELECT DISTINCT concat('f', CAST(l_suppkey % 5 AS VARCHAR)) AS source_file, l_returnflag,
       l_linestatus, l_quantity
FROM lineitem""",
    "drop_duplicates_dataset": """
SELECT min(concat('f', CAST(l_suppkey % 5 AS VARCHAR))) AS source_file, l_returnflag,
       l_linestatus, l_quantity
FROM lineitem GROUP BY l_returnflag, l_linestatus, l_quantity""",
    "clean_price": f"{_WITH_PRICES} SELECT * FROM kept",
    "clean_company": _companies(),
    "clean_news": _news(),
    "clean_generic": """
SELECT DISTINCT 'events.csv' AS source_file, user_id, event_type FROM events""",
    "classify_tables": """
SELECT 'dirty_companies' AS table_name, 'company' AS kind, count(*) AS raw_rows FROM supplier
UNION ALL SELECT 'dirty_news', 'news', count(*) FROM orders
UNION ALL SELECT 'dirty_prices', 'price', count(*) FROM lineitem""",
    "basic_clean_price": f"{_WITH_PRICES} SELECT *, 'price' AS kind FROM cleaned",
    "basic_clean_company": _companies(kind=", 'company' AS kind"),
    "basic_clean_news": _news(kind=", 'news' AS kind"),
    "csv_round_trip": f"""{_WITH_PRICES}
SELECT regexp_extract(source_file, '[^/]+$') AS source_file,
       CASE WHEN date <> 'n/a' THEN date END AS date, open, close,
       CASE WHEN {_ODD} THEN adjusted_close END AS adj_close,
       CASE WHEN NOT ({_ODD}) THEN adjusted_close END AS adjusted_close, volume
FROM dirty""",
    "inventory": """
SELECT concat(l_returnflag, '.csv') AS file, CAST(1 AS BIGINT) AS parts,
       -- a comma between four fields and a line end
       round_even(sum(length(CAST(l_orderkey AS VARCHAR)) + length(CAST(l_partkey AS VARCHAR))
                      + length(CAST(l_suppkey AS VARCHAR)) + 10 + 4) / 1048576.0, 2) AS size_mb
FROM lineitem GROUP BY l_returnflag""",
    "same_named_files": """
SELECT concat(CASE WHEN f > 0 THEN concat(CAST(f + 1 AS VARCHAR), '__') ELSE '' END,
              'p2__cleaned.csv') AS source_file,
       'P2' AS ticker, count(*) AS rows, CAST(sum(close) AS DOUBLE) AS closes,
       least(count(*), 300) AS sampled
FROM (SELECT DISTINCT o_custkey % 3 AS f, CAST(o_orderdate AS DATE) AS day,
             o_orderkey % 100 AS close FROM orders)
GROUP BY f""",
    "inventory_files": f"""{_WITH_PRICES}
SELECT DISTINCT regexp_extract(source_file, '[^/]+$') AS file, TRUE AS has_size FROM dirty""",
    "select_files": f"""{_WITH_PRICES}
SELECT DISTINCT regexp_extract(source_file, '[^/]+$') AS file FROM dirty
WHERE source_file LIKE 'sp500/%'""",
    "sample_export": f"""{_WITH_PRICES}
SELECT {_OUTPUT.format('sample')} AS file, date, open, close, adjusted_close, volume
FROM (
  SELECT *, row_number() OVER (PARTITION BY source_file
              ORDER BY date NULLS LAST, open NULLS LAST, close NULLS LAST,
                       adjusted_close NULLS LAST, volume NULLS LAST) AS place
  FROM cleaned
) WHERE place <= 40""",
    "chunk_export": f"""{_WITH_PRICES},
sizes AS (
  SELECT source_file, count(*) AS cleaned_rows,
         -- day, four numbers written as 12.0, four commas, line end; then the header
         CAST(sum(23 + 4 + 1
             + coalesce(length(CAST(CAST(open AS BIGINT) AS VARCHAR)) + 2, 0)
             + coalesce(length(CAST(CAST(close AS BIGINT) AS VARCHAR)) + 2, 0)
             + coalesce(length(CAST(CAST(adjusted_close AS BIGINT) AS VARCHAR)) + 2, 0)
             + coalesce(length(CAST(CAST(volume AS BIGINT) AS VARCHAR)) + 2, 0)) AS BIGINT)
           + length('date,open,close,adjusted_close,volume') + 1 AS csv_bytes
  FROM cleaned GROUP BY source_file
)
SELECT source_file, cleaned_rows, cleaned_rows AS rows_back, csv_bytes,
       CASE WHEN csv_bytes <= 0.2 * 1024 * 1024 THEN 'full' ELSE 'chunked' END AS saved_mode,
       TRUE AS kept_cap
FROM sizes""",
    "cleaning_log": f"""{_WITH_PRICES},
raw AS (SELECT source_file, count(*) AS raw_rows FROM dirty GROUP BY source_file),
done AS (SELECT source_file, count(*) AS cleaned_rows FROM cleaned GROUP BY source_file)
SELECT regexp_extract(r.source_file, '[^/]+$') AS source_file, 'price' AS table_type_guess,
       raw_rows, cleaned_rows,
       concat(regexp_extract(r.source_file, '([^/]+)\\.csv$', 1), '__sample.csv') AS sample_file,
       'full' AS saved_mode
FROM raw r JOIN done d ON d.source_file = r.source_file
WHERE r.source_file LIKE 'sp500/%'""",
    "combine_prices": f"{_STAGED} SELECT * FROM combined",
    "finalize_staging": f"{_STAGED} SELECT * FROM staged",
    "load_ready": f"""{_STAGED}
SELECT * FROM staged WHERE trading_date >= DATE '2000-01-01'""",
    "load_summary": f"""{_STAGED}
SELECT count(*) AS rows_in, count(*) FILTER (trading_date >= DATE '2000-01-01') AS rows_out,
       count(*) FILTER (trading_date < DATE '2000-01-01') AS rows_removed,
       count(DISTINCT upper(ticker)) FILTER (trading_date >= DATE '2000-01-01') AS unique_tickers,
       min(trading_date) FILTER (trading_date >= DATE '2000-01-01') AS min_date,
       max(trading_date) FILTER (trading_date >= DATE '2000-01-01') AS max_date
FROM staged""",
    "cleaning_errors": """
WITH files AS (
  SELECT o_custkey % 12 AS n, count(*) AS rows, count(DISTINCT (CAST(o_orderdate AS DATE), o_orderkey % 50)) AS kept,
         bool_or(o_orderkey % 7 = 0) AS more, bool_or(o_orderkey % 1000 = 3) AS wide
  FROM orders GROUP BY o_custkey % 12
),
judged AS (
  SELECT *, CASE WHEN n = 5 THEN 'error: the file has no header'
                 WHEN n = 3 AND more OR n = 8 AND wide THEN 'error: a row has more cells than the header' END AS error
  FROM files
)
SELECT concat('p', n, '.csv') AS source_file, CASE WHEN error IS NULL THEN 'price' ELSE 'ERROR' END AS table_type_guess,
       CASE WHEN error IS NULL THEN rows END AS raw_rows, CASE WHEN error IS NULL THEN kept END AS cleaned_rows,
       CASE WHEN error IS NULL THEN concat('p', n, '__sample.csv') END AS sample_file, coalesce(error, 'full') AS saved_mode
FROM judged""",
}
