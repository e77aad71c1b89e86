"""Ranked lexical search, term at a time over short lists and document at a time over long ones.

The documents are indexed in segments, tables of postings with their documents in id order. A task ranks all items over
its segments one after the other. For an item the short lists of a segment are summed into accumulators; these are then
one more iterator, with a bound of its own for every window of documents, beside the long lists. The windows are gone
through in order of the documents; one whose bounds add up to less than the item's lowest kept score is skipped, and in
the others lists are added from the highest bound on until what is left cannot reach that score."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from pricelens.llm.common import raw_texts, slices, written

TOP = 10
#: Bytes of text of a segment, at most (or one text); also at most one Arrow batch.
SEGMENT = 16 << 20
#: Documents of a window.
WINDOW = 512
#: A list is short where it has at most one in so many of the segment's documents.
SHORT = 16
#: Terms, repeats included, of the items that are searched in one pass over the documents (about; items are whole).
BLOCK_TERMS = 1 << 20

#: A-Z become a-z; 0-9, a-z and bytes of other characters stay; all else parts terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_LISTS = {"n": LongType(), "terms": IntegerType(), "sizes": IntegerType(), "places": IntegerType(), "tfs": IntegerType()}


def terms_of(raw: bytes) -> list[bytes]:
    return raw.translate(_FOLD).split()


def segments(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """The index of (doc_id, text): a row for each segment. `docs` has the ids in order, nulls last, and `n` their
    numbers of terms; `terms` the numbers of the vocabulary's terms that are there, `sizes` the documents that hold each;
    `places` and `tfs` the postings of one term after the other, as places in `docs` and occurrences."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = docs.schema["doc_id"].dataType
    schema = StructType([StructField("docs", ArrayType(kind)), *(StructField(c, ArrayType(t)) for c, t in _LISTS.items())])

    def run(batches):
        known = sent.value
        for batch in batches:
            for part in slices(batch, "text", SEGMENT):
                part = part.take(pc.sort_indices(part, [("doc_id", "ascending")]))
                n, held, terms, tfs = [], [], [], []
                for raw in raw_texts(part, "text"):
                    words = terms_of(raw)
                    found = [(known[w], c) for w, c in Counter(words).items() if w in known]
                    n.append(len(words))
                    held.append(len(found))
                    terms += [t for t, _ in found]
                    tfs += [c for _, c in found]
                terms, tfs = np.array(terms, np.int32), np.array(tfs, np.int32)
                order = np.argsort(terms, kind="stable")
                places = np.repeat(np.arange(len(n), dtype=np.int32), held)[order]
                there, sizes = np.unique(terms, return_counts=True)
                columns = [part.column("doc_id"), *(pa.array(x) for x in (np.array(n, np.int64), there, sizes.astype(np.int32), places, tfs[order]))]
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns], names=["docs", *_LISTS]
                )

    return docs.mapInArrow(run, schema)


@dataclass
class Plan:
    """What every task needs: of each item its terms' numbers and how often it has them, the terms' weights, the number
    of documents with a term, and all their terms."""

    items: list[tuple[np.ndarray, np.ndarray]]
    weights: np.ndarray
    n_docs: int
    n_terms: int
    top: int = TOP


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Segment:
    """One segment's lists with their scores, and their highest scores by window."""

    def __init__(self, plan: Plan, row: dict):
        n, sizes = np.asarray(row["n"], np.int64), np.asarray(row["sizes"], np.int64)
        self.docs, self.n_docs = row["docs"], len(n)
        self.slot = {t: i for i, t in enumerate(np.asarray(row["terms"]).tolist())}
        self.ends = np.concatenate([[0], np.cumsum(sizes)])
        self.places = np.asarray(row["places"], np.int64)
        tf = np.asarray(row["tfs"], np.int64)
        if 75 * plan.n_docs * int(n.max(initial=0)) >= 1 << 63:
            length = 25 + np.array([75 * plan.n_docs * int(x) // plan.n_terms for x in n], np.int64)
        else:
            length = 25 + 75 * plan.n_docs * n // max(1, plan.n_terms)
        of = plan.weights[np.asarray(row["terms"], np.int64)]
        self.scores = np.repeat(of, sizes) * (1_000_000_000 * tf // (1000 * tf + 8 * length[self.places]))
        self.n_windows = -(-self.n_docs // WINDOW)
        self._windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def windows(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Where list i's windows start, and the highest score in each."""
        if i not in self._windows:
            a, b = self.ends[i], self.ends[i + 1]
            starts = a + np.searchsorted(self.places[a:b], np.arange(self.n_windows + 1) * WINDOW)
            most = np.zeros(self.n_windows, np.int64)
            full = starts[1:] > starts[:-1]
            most[full] = np.maximum.reduceat(self.scores, starts[:-1][full])  # up to the next full window's start
            if full.any():
                last = np.flatnonzero(full)[-1]
                most[last] = self.scores[starts[last] : b].max()
            self._windows[i] = starts, most
        return self._windows[i]

    def search(self, item: tuple[np.ndarray, np.ndarray], best: list[tuple], top: int) -> list[tuple]:
        """The item's best (-score, no id, id), from those so far and the segment's documents."""
        short, long = [], []
        for t, times in zip(*(x.tolist() for x in item)):
            i = self.slot.get(t)
            if i is not None:
                (short if SHORT * (self.ends[i + 1] - self.ends[i]) <= self.n_docs else long).append((i, times))
        if not short and not long:
            return best
        sums = np.zeros(self.n_windows * WINDOW, np.int64)
        for i, times in short:
            a, b = self.ends[i], self.ends[i + 1]
            sums[self.places[a:b]] += times * self.scores[a:b]
        bound = sums.reshape(-1, WINDOW).max(1) if short else np.zeros(self.n_windows, np.int64)
        own = [(times * self.windows(i)[1], self.windows(i)[0], times) for i, times in long]
        bound = bound + sum(most for most, _, _ in own)
        least = max(1, -best[-1][0]) if len(best) == top else 1
        for w in np.flatnonzero(bound >= least).tolist():
            if bound[w] < least:  # it has risen meanwhile
                continue
            at = w * WINDOW
            found = sums[at : at + WINDOW]
            lists = sorted(((int(most[w]), s[w], s[w + 1], times) for most, s, times in own if most[w]), reverse=True)
            left = sum(x[0] for x in lists)
            for most, a, b, times in lists:
                if int(found.max()) + left < least:
                    break
                found[self.places[a:b] - at] += times * self.scores[a:b]
                left -= most
            else:
                places = np.flatnonzero(found >= least)
                if len(places):
                    places = places[np.argsort(-found[places], kind="stable")][:top]  # ids are in order
                    more = [(-int(found[p]), (d := self.docs[at + p]) is None, 0 if d is None else d) for p in places.tolist()]
                    best = sorted(best + more)[:top]
                    least = max(1, -best[-1][0]) if len(best) == top else 1
        return best


def ranked(index: DataFrame, plan: Plan) -> DataFrame:
    """(item, doc_id, score): of each task the best documents of each item, by the item's number."""
    sent = index.sparkSession.sparkContext.broadcast(plan)
    kind = index.schema["docs"].dataType.elementType
    schema = StructType([StructField("item", IntegerType()), StructField("doc_id", kind), StructField("score", LongType())])

    def run(batches):
        plan = sent.value
        best: list[list[tuple]] = [[] for _ in plan.items]
        out = None
        for batch in batches:
            out = batch.schema.field("docs").type.value_type
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].values for c in batch.schema.names}
                segment = Segment(plan, {c: v.to_pylist() if c == "docs" else v.to_numpy() for c, v in row.items()})
                for k, item in enumerate(plan.items):
                    best[k] = segment.search(item, best[k], plan.top)
        if out is not None:
            rows = [(k, None if null else d, -s) for k, x in enumerate(best) for s, null, d in x]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), out, pa.int64()))],
                names=["item", "doc_id", "score"],
            )

    return index.mapInArrow(run, schema)


def search(
    docs: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    top: int = TOP,
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` documents with the highest score above 0 for each item.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z lower-cased; null has none.
    With N documents that have terms, L terms in all, a document of n, and df documents that hold a term, its weight is
    floor(1000 ln((2N + 2) / (2df + 1))), and a document's score the sum over the item's terms, repeats included, of
    weight * (10^9 tf div (1000 tf + 8 (25 + 75 n N div L))). Equal scores are in the order of the ids, null last. Rows
    of documents that repeat, or share an id, are ranked each for itself. Rows of items that repeat count once, others
    that share an id, null among them, are one item with all their terms. Other columns are left out.

    Items are dealt to blocks of about `block_terms` terms by a hash of the id; a block's items and vocabulary are at
    the driver and in the tasks, one block at a time, and each block is one index of the documents."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).distinct()
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) / 6)  # a rule of thumb for terms
    n_blocks = max(1, math.ceil((asked.agg(size).first()[0] or 0) / block_terms))
    parts = []
    for block in range(n_blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block).collect()
        counted: dict = {}
        for r in rows:
            counted.setdefault(r["item_id"], Counter()).update(terms_of((r["text"] or "").encode()))
        ids = list(counted)
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*counted.values())))}
        index = written(segments(docs, vocabulary), "segments")
        total = index.agg(
            F.sum(F.size(F.filter("n", lambda n: n > 0)).cast("long")), F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, n: a + n))
        ).first()
        n_docs, n_terms = (x or 0 for x in total)
        held = index.select(F.inline(F.arrays_zip("terms", "sizes"))).groupBy("terms").agg(F.sum("sizes").alias("df"))
        weights = np.zeros(len(vocabulary), np.int64)
        for t, df in held.collect():  # no more rows than the block's vocabulary
            weights[t] = weight(n_docs, df)
        plan = Plan([], weights, n_docs, n_terms, top)
        for i in ids:
            terms = np.array([vocabulary[t] for t in counted[i]], np.int64)
            times = np.array(list(counted[i].values()), np.int64)
            plan.items.append((terms[weights[terms] > 0], times[weights[terms] > 0]))
        names = spark.createDataFrame(
            list(enumerate(ids)), StructType([StructField("item", IntegerType()), StructField("item_id", asked.schema["item_id"].dataType)])
        )
        order = W.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        best = ranked(index, plan).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        parts.append(written(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "ranked"))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.select(F.col("item_id").alias(item_id), "rank", F.col("doc_id").alias(doc_id), "score")
