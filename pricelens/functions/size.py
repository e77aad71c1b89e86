"""Joins with a side that is broadcast only after its size was checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Up to this many sectors, one row of values per sector is broadcast.
MAX_SECTORS = 100_000
# Up to this many recent articles, their ids and times are broadcast.
MAX_ARTICLES = 2_000_000

_SALTS = 64


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether `df` has no more than `rows` rows; counting stops beyond."""
    return df.select(F.lit(1)).limit(rows + 1).count() <= rows


def sized_join(
    rows: DataFrame,
    values: DataFrame,
    key: str,
    bound: DataFrame,
    max_rows: int,
    how: str = "inner",
) -> DataFrame:
    """Join `rows` with one row of `values` per key, where a key is in few rows.

    `values` has no more rows than `bound`. If those are few, `values` is broadcast; else both
    sides are shuffled by the key once, and nothing is copied.
    """
    few = at_most(bound, max_rows)
    return rows.join(F.broadcast(values) if few else values, key, how)


def skewed_join(
    rows: DataFrame,
    values: DataFrame,
    key: str,
    bound: DataFrame,
    max_rows: int,
    how: str = "inner",
) -> DataFrame:
    """Join `rows`, most of which may share one key, with one row of `values` per key.

    `values` has no more rows than `bound`. If those are few, `values` is broadcast and `rows`
    are not shuffled. Else each key is split: rows take a salt from where they lie, and every
    value is there for each salt.
    """
    if at_most(bound, max_rows):
        return rows.join(F.broadcast(values), key, how)
    salt = F.pmod(F.spark_partition_id(), F.lit(_SALTS))
    copies = values.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return rows.withColumn("_salt", salt).join(copies, [key, "_salt"], how).drop("_salt")
