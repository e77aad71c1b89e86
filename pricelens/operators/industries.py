"""Industry rotations: monthly rank shifts of industries inside their sector."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricelens.functions.params import positive_int, required_date
from pricelens.operators.prices import daily_return, primary_price
from pricelens.tables import Tables, listed_companies


def industry_rotations(tables: Tables, start, end, limit=50) -> DataFrame:
    """Industries by how far their rank in the sector moved since their previous month.

    Daily returns compound to a month per company; an industry takes the plain mean of its
    companies. Days with a return of -0.999 or below do not count, and a return that spans two
    months belongs to the later one. The first month of an industry has nothing to compare.
    """
    start, end = required_date(start, "start"), required_date(end, "end")
    limit = positive_int(limit, 50, "limit")
    closes = primary_price(
        tables.price_daily, tables.price_source, start, end, columns=("close",)
    )
    growth = F.greatest(1 + F.col("ret"), F.lit(1e-9))
    company_month = (
        closes.withColumn("ret", daily_return())
        .filter("ret > -0.999")
        .groupBy("company_id", F.trunc("trading_date", "MM").alias("month"))
        .agg((F.exp(F.sum(F.log(growth))) - 1).alias("month_ret"))
    )
    companies = listed_companies(tables).select("company_id", "sector_name", "industry_name")
    industry_month = (
        company_month.join(companies, "company_id")
        .groupBy("sector_name", "industry_name", "month")
        .agg(F.avg("month_ret").alias("industry_month_ret"))
    )
    # From here on one row per industry and month.
    in_sector = Window.partitionBy("sector_name", "month").orderBy(
        F.col("industry_month_ret").desc_nulls_first()
    )
    months = Window.partitionBy("sector_name", "industry_name").orderBy("month")
    return (
        industry_month.withColumn("rnk", F.rank().over(in_sector))
        .withColumn("prev_rnk", F.lag("rnk").over(months))
        .filter("prev_rnk is not null")
        .withColumn("rank_improvement", F.col("prev_rnk") - F.col("rnk"))
        .orderBy(
            F.desc(F.abs("rank_improvement")), F.desc("month"), "sector_name", "industry_name"
        )
        .limit(limit)
        .select(
            "sector_name",
            "industry_name",
            "month",
            "prev_rnk",
            "rnk",
            "rank_improvement",
            "industry_month_ret",
        )
    )
