"""Near-duplicate documents by SimHash fingerprints and multi-index hashing.

Fingerprints within two bits meet in a table. Each fingerprint enumerates the ball of one bit within each 16-bit segment.
A table keyed on a segment alone puts all near copies of a text in one bucket, whose pairs grow with its square; so the
key is the segment's ball member together with the other segments, and both sides of a pair enumerate. Two fingerprints
within two bits then share a member, at most 65 fingerprints share one, and a chain through each bucket, checked by
complete distances, links them all."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import LongType, StructField

from pricelens.llm.common import append, raw_texts, written
from pricelens.llm.components import components

WORDS = 3
SEED = 42
BITS = 2
SEGMENTS = 4

_PART = 1 << 14


def shingle_hashes(raw: bytes, n_words: int) -> np.ndarray:
    """XXH64 of the shingles, repeats included; of the whole sequence where it has fewer words; none without words."""
    words = raw.lower().split()  # on bytes: A-Z only, and the six ASCII white-space characters only
    if len(words) < n_words:
        shingles = [b" ".join(words)] if words else []
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(n_words))))
    digest = xxhash.xxh64_intdigest
    n = max(min(1, len(words)), len(words) - n_words + 1)
    return np.fromiter((digest(s, SEED) for s in shingles), np.uint64, n)


def majority(hashes: np.ndarray) -> np.ndarray:
    """From n rows of 64-bit words to one row, with the bits set in over half of the rows."""
    ones = np.zeros(64 * hashes.shape[1], np.int64)
    for at in range(0, len(hashes), _PART):
        part = np.ascontiguousarray(hashes[at : at + _PART], "<u8").view(np.uint8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.uint16)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8").astype(np.uint64)


def fingerprint(raw: bytes, n_words: int = WORDS) -> int:
    """Majority bits of the shingles' XXH64, from UTF-8; 0 for a text without words."""
    return int(majority(shingle_hashes(raw, n_words)[:, None])[0])


def fingerprints(docs: DataFrame, *, text: str = "text", to: str = "fingerprint", n_words: int = WORDS) -> DataFrame:
    """Adds the fingerprint, a long that holds the 64 bits. A null text counts as empty. Other columns stay; one named
    like the new column is replaced."""

    def make():
        def work(part: pa.RecordBatch) -> list[pa.Array]:
            found = np.array([fingerprint(t, n_words) for t in raw_texts(part, text)], np.uint64)
            return [pa.array(found.view(np.int64))]

        return work

    return append(docs, text, [StructField(to, LongType())], make)


def links(fps: DataFrame) -> DataFrame:
    """From distinct fingerprints `fp` to links (a, b), whose components are those of all pairs within two bits."""
    width = 64 // SEGMENTS
    balls = [
        F.col("fp").bitwiseXOR(F.lit((1 << bit) - (1 << 64 if bit == 63 else 0)))
        for segment in range(SEGMENTS)
        for bit in range(segment * width, (segment + 1) * width)
    ]
    table = fps.select("fp", F.explode(F.array("fp", *balls)).alias("member"))
    chain = W.partitionBy("member").orderBy("fp")
    return (
        table.withColumn("other", F.lag("fp").over(chain))
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= BITS)
        .select(F.col("fp").alias("a"), F.col("other").alias("b"))
        .distinct()
    )


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n_words: int = WORDS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id among the documents reachable over links of two or fewer differing bits, the
    document included. Texts without words have fingerprint 0 and link like any other. A null doc_id counts for no
    component_id, which is null where no document has one. Repeated rows each give a row. Other columns are left out."""
    table = written(
        fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), text="text", to="fp", n_words=n_words)
        .select("doc_id", "fp"),
        "fingerprints",
    )
    groups = written(table.groupBy("fp").agg(F.min("doc_id").alias("least")), "groups")
    rooted = components(links(groups.select("fp"))).withColumnRenamed("id", "fp")
    found = groups.join(rooted, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = found.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = written(found.join(least, "root").select("fp", "component_id"), "classes")
    return table.join(classes, "fp").select(
        F.col("doc_id").alias(doc_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def first_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n_words: int = WORDS) -> DataFrame:
    """The document with the smallest id of each component, with all its columns. Rows that repeat such an id all stay;
    rows with a null id stay, as nothing says which of them are the same document."""
    found = near_duplicates(docs, doc_id=doc_id, text=text, n_words=n_words)
    gone = found.where(F.col(doc_id) != F.col("component_id")).select(F.col(doc_id).alias("_gone")).distinct()
    return docs.join(gone, docs[doc_id] == gone["_gone"], "left_anti")
