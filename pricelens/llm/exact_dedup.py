"""Exact duplicates over a persistent index of digests, in DataFrame expressions only.

The index is a table bucketed and sorted by digest. New documents come in parts, the longest texts first. Each part is
anti-joined with the index by sort-merge, and the digests it does not hold are appended with the document that stays: as no
later part has a longer text, that document is final when it is written."""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pricelens.llm.common import written

#: Fewest buckets of a new index; one of more rows than BUCKET_ROWS a bucket gets more.
BUCKETS = 16
BUCKET_ROWS = 1 << 20
#: Parts, by length of text, in which a batch is added.
PARTS = 4
#: A digest of more than one row in so many is looked up without a shuffle; there are fewer than HOT of them.
HOT = 1000
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), SPACES, F.coalesce(text, F.lit("")))


class DigestIndex:
    """Rows: digest, keep_id, n_chars (of the text that stays) and the batch that first had the digest."""

    def __init__(self, spark: SparkSession, table: str, buckets: int | None = None):
        self.spark, self.table, self.buckets = spark, table, buckets

    def _n_buckets(self, n_rows: int) -> int:
        if self.spark.catalog.tableExists(self.table):
            said = self.spark.sql(f"DESCRIBE EXTENDED {self.table}").where("col_name = 'Num Buckets'").first()
            return int(said["data_type"])
        return self.buckets or max(BUCKETS, 1 << (n_rows // BUCKET_ROWS).bit_length())

    def _append(self, rows: DataFrame, buckets: int) -> None:
        # one task writes a bucket, so a part adds one file to each
        (
            rows.repartition(buckets, "digest")
            .write.mode("append")
            .bucketBy(buckets, "digest")
            .sortBy("digest")
            .format("parquet")
            .saveAsTable(self.table)
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def _add_part(self, part: DataFrame, batch: str, buckets: int) -> None:
        best = F.min(F.struct((-F.col("n_chars")).alias("n"), F.isnull("doc_id").alias("none"), "doc_id"))
        rows = (
            part.groupBy("digest")
            .agg(best.alias("best"))
            .select("digest", F.col("best.doc_id").alias("keep_id"), (-F.col("best.n")).alias("n_chars"), F.lit(batch).alias("batch"))
        )
        if self.spark.catalog.tableExists(self.table):
            rows = rows.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        self._append(rows, buckets)

    def add(
        self, docs: DataFrame, *, batch: str | None = None, parts: int = PARTS, doc_id: str = "doc_id", text: str = "text"
    ) -> DataFrame:
        """Adds a batch and returns one row per document of it: doc_id, keep_id, group_size, kept, text_sha256.

        Texts are equal when identical without ASCII white space; a null text is an empty one. Of equal texts in a
        batch the one with the most code points stays, then the smallest id; an id of null comes last. A digest that
        an earlier batch brought stays with that batch's document, and the new ones all go. group_size counts the
        batch's rows with the digest. Rows that repeat the id that stays are all marked kept, as no column tells them
        apart. Other columns are left out.

        `batch` names the batch. A run that ended midway is repeated with the same name and the same documents: digests
        it appended are found by the anti-join, are not appended again and count as its own, so the rows are those of a
        run that never stopped. The lengths between the parts are approximate quantiles; they divide the work and
        change no row."""
        batch = batch or uuid4().hex
        docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
        digests = written(
            docs.select(
                "doc_id",
                F.sha2(normalised(F.col("text")), 256).alias("digest"),
                F.char_length(F.coalesce("text", F.lit(""))).alias("n_chars"),
            ),
            "digests",
        )
        n_rows = digests.count()
        shares = [i / parts for i in range(1, parts)]
        borders = sorted(set(digests.approxQuantile("n_chars", shares, 0.01)), reverse=True) if shares else []
        buckets = self._n_buckets(n_rows)
        for low, high in zip([*borders, None], [None, *borders]):
            part = digests if low is None else digests.where(F.col("n_chars") >= low)
            self._add_part(part if high is None else part.where(F.col("n_chars") < high), batch, buckets)
        sizes = digests.groupBy("digest").agg(F.count("*").alias("group_size"))
        found = written(sizes.join(self.rows().select("digest", "keep_id", "batch").hint("merge"), "digest"), "found")
        # a digest of very many rows would make one task of a join by digest
        is_hot = F.col("group_size") > n_rows / HOT
        hot = found.where(is_hot)
        rest = digests.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
        rows = rest.join(found.where(~is_hot), "digest").unionByName(digests.join(F.broadcast(hot), "digest"))
        return rows.select(
            F.col("doc_id").alias(doc_id),
            "keep_id",
            "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("batch") == batch)).alias("kept"),
            F.col("digest").alias("text_sha256"),
        )
