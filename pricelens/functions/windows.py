"""First rows per group when one group may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Up to this many rows per group Spark itself cuts each task's rows before the shuffle
# (spark.sql.optimizer.windowGroupLimitThreshold).
_CUT_BY_SPARK = 1000


def first_rows(df: DataFrame, keys: list[str], order: list, rows: int) -> DataFrame:
    """The first `rows` rows per group in a total order.

    Only candidates are shuffled to the group's task: each task's first `rows` rows per group.
    Spark does that by itself for few rows; for more the cut is a step of its own.
    """
    if rows > _CUT_BY_SPARK:
        here = F.spark_partition_id()
        df = _cut(df.withColumn("_part", here), [*keys, "_part"], order, rows).drop("_part")
    return _cut(df, keys, order, rows)


def _cut(df: DataFrame, keys: list[str], order: list, rows: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter(F.col("_place") <= rows).drop("_place")
