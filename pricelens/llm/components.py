"""Connected components of a graph of links, by alternating stars; every round is a fixed number of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pricelens.llm.common import written


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the least of the node and its neighbours."""
    both = links.union(links.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the least of them. Links have a > b."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """From links (a, b) of longs to (id, root): every id that has a link, and the least id reachable from it.

    Links to oneself and repeated links change nothing. No links give no rows. Every round's links are a table in the
    shared folder; only their count and a checksum reach the driver."""
    links = links.toDF("a", "b").where("a <> b")
    links = written(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    before = None
    while True:
        # (count, checksum): the star forest is reached when a round changes nothing
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return links.select(F.col("a").alias("id"), F.col("b").alias("root")).union(
                links.select("b", "b").distinct()
            )
        before = now
        links = written(_small_star(_large_star(links).distinct()).distinct(), "links")
