"""Lines repeated across documents, over levelled sorted runs of line hashes.

A run is a table sorted by hash with, for each of its keys, the number of documents and the last document. A new batch is
anti-joined by merge with the runs: the keys that none of them has become a run themselves, so a key is in one run only. Keys
that a run has already are kept apart, as further documents of that run's row. Where a level has enough runs they are merged
into one run of the next level."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from pricelens.llm.common import append, raw_texts, slices, written

#: Shorter keys never count.
LEAST_CHARACTERS = 20
#: A key in so many documents loses its lines.
LEAST_DOCUMENTS = 3
#: Runs of a level that are merged into one of the next.
FANOUT = 4
BATCHES = 4

_KEY = ("hi", "lo")


def line_key(line: bytes) -> bytes | None:
    """The 16 hash bytes of a line's key, None where the key is too short."""
    key = line.strip().lower()  # on bytes: the six ASCII white-space characters, and A-Z
    if len(key) < LEAST_CHARACTERS:
        return None
    if len(key) < 4 * LEAST_CHARACTERS and not key.isascii() and len(key.decode(errors="replace")) < LEAST_CHARACTERS:
        return None
    return xxhash.xxh3_128_digest(key)


class LineRuns:
    """Runs hold hi, lo (the hash), n_docs and last_doc of the batch that first had the key, and `further` the same of later
    batches. Batches hold disjoint documents."""

    def __init__(self, fanout: int = FANOUT):
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = [[]]
        self.further: list[DataFrame] = []

    def _runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, keys: DataFrame) -> DataFrame:
        """Adds a batch of distinct (hi, lo, doc). Returns its run: the keys that no earlier batch had."""
        batch = keys.groupBy(*_KEY).agg(F.count("*").alias("n_docs"), F.max("doc").alias("last_doc"))
        seen = self._runs()
        if seen:
            batch = written(batch, "batch")
            known = _union(seen).select(*_KEY).hint("merge")
            self.further.append(written(batch.join(known, list(_KEY), "left_semi"), "further"))
            batch = batch.join(known, list(_KEY), "left_anti")
        run = written(batch.sortWithinPartitions(*_KEY), "run")
        self.levels[0].append(run)
        self._compact()
        return run

    def _compact(self) -> None:
        for level, runs in enumerate(self.levels):
            if len(runs) >= self.fanout:
                if level + 1 == len(self.levels):
                    self.levels.append([])
                one = _union(runs).repartition(*_KEY).sortWithinPartitions(*_KEY)
                self.levels[level + 1].append(written(one, "run"))
                self.levels[level] = []

    def held_by(self, least: int) -> DataFrame:
        """One row per key that at least so many documents hold: hi, lo, n_docs, last_doc."""
        rows = _union(self._runs())
        if self.further:
            more = _union(self.further).groupBy(*_KEY).agg(F.sum("n_docs").alias("more"), F.max("last_doc").alias("later"))
            rows = rows.join(more, list(_KEY), "left").select(
                *_KEY,
                (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs"),
                F.greatest("last_doc", "later").alias("last_doc"),
            )
        return rows.where(F.col("n_docs") >= least)


def _union(runs: list[DataFrame]) -> DataFrame:
    out = runs[0]
    for run in runs[1:]:
        out = out.unionByName(run)
    return out


def line_keys(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Distinct (hi, lo, doc) of all lines whose keys are long enough."""
    docs = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    schema = StructType([docs.schema["doc"], StructField("hi", LongType()), StructField("lo", LongType())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                row, keys = [], []
                for i, raw in enumerate(raw_texts(part, "text")):
                    found = {line_key(line) for line in raw.split(b"\n")} - {None}
                    keys += found
                    row += [i] * len(found)
                both = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc").take(pa.array(row, pa.int64())), *(pa.array(both[:, k].copy()) for k in (0, 1))],
                    names=["doc", "hi", "lo"],
                )

    return docs.mapInArrow(run, schema).distinct()


def without_repeated_lines(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    least_documents: int = LEAST_DOCUMENTS,
    batches: int = BATCHES,
) -> DataFrame:
    """The documents with repeated lines dropped from the text, and n_lines (before) and n_dropped added.

    Lines end at line feeds. A line's key is the line without ASCII white space at both ends and with A-Z lower-cased.
    Keys of at least 20 code points in at least `least_documents` documents lose all their lines, except in the largest
    id that holds the key; what stays is joined by line feeds. A null or empty text is one empty line, and comes back
    empty. Rows that share an id are one document; rows with a null id are one document smaller than all others.
    Other columns stay; ones named n_lines or n_dropped are replaced.

    The documents' keys are dealt to `batches` batches by a hash of the id, each added to the runs in turn."""
    keys = written(
        line_keys(docs, doc_id=doc_id, text=text).withColumn("batch", F.pmod(F.xxhash64("doc"), F.lit(batches))), "keys"
    )
    runs = LineRuns()
    for i in range(batches):
        runs.add(keys.where(F.col("batch") == i).drop("batch"))
    repeated = runs.held_by(least_documents).select(*_KEY, "last_doc")
    gone = (
        keys.join(repeated, list(_KEY))
        .where(~F.col("doc").eqNullSafe(F.col("last_doc")))
        .groupBy("doc")
        .agg(F.collect_list(F.struct(*_KEY)).alias("_gone"))
        .withColumnRenamed("doc", "_doc")
        .hint("shuffle_hash")
    )
    held = docs.select([c for c in docs.columns if c not in ("n_lines", "n_dropped", "_doc", "_gone")])
    joined = held.join(gone, held[doc_id].eqNullSafe(gone["_doc"]), "left").drop("_doc")
    fields = [StructField(text, StringType()), StructField("n_lines", LongType()), StructField("n_dropped", LongType())]

    def make():
        def work(part: pa.RecordBatch) -> list[pa.Array]:
            kept, n_lines, n_dropped = [], [], []
            for raw, gone in zip(raw_texts(part, text), part.column("_gone").to_pylist()):
                lines = raw.split(b"\n")
                n_lines.append(len(lines))
                if gone:
                    drop = {np.array([g["hi"], g["lo"]], "<i8").tobytes() for g in gone}
                    lines = [line for line in lines if line_key(line) not in drop]
                kept.append(b"\n".join(lines))
                n_dropped.append(n_lines[-1] - len(lines))
            return [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]

        return work

    out = append(joined, text, fields, make)
    return out.select(*held.columns, "n_lines", "n_dropped")
