"""Restricting a fact table to the company of one ticker."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Up to this many ids become literals in the scan filter; more go through a join.
MAX_LITERAL_IDS = 1000


def with_ticker(company: DataFrame, ticker: str | None) -> DataFrame:
    return company if ticker is None else company.filter(F.col("ticker") == F.lit(ticker))


def only_ids(facts: DataFrame, wanted: DataFrame, key: str = "company_id") -> DataFrame:
    """Rows of `facts` whose key is in `wanted`.

    A few ids become an IN list, which reaches the Parquet scan. The check reads at most
    `MAX_LITERAL_IDS + 1` rows to the driver; beyond that it is a semi join.
    """
    ids = [r[0] for r in wanted.select(key).limit(MAX_LITERAL_IDS + 1).collect()]
    if len(ids) > MAX_LITERAL_IDS:
        return facts.join(wanted.select(key), key, "left_semi")
    return facts.filter(F.col(key).isin(ids))
