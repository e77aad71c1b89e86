"""Benchmark passages in documents, by Wu-Manber search over words.

Patterns are windows of consecutive words of benchmark items. All patterns of one length m share tables over blocks of
the last one or two words: a shift table says how far a block's appearance lets the search move on; a block that ends a
pattern leads to its bucket by suffix and prefix, and the words are compared directly."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from pricelens.llm.common import append, raw_texts

WINDOW = 10
#: Bytes of benchmark text in one set of tables; a larger benchmark is searched in several sets, one after the other.
BLOCK_BYTES = 8 << 20

#: A-Z become a-z; bytes outside digits, letters and non-ASCII become spaces.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class _SameLength:
    """Tables for patterns of m words."""

    def __init__(self, m: int, patterns: dict[tuple[bytes, ...], set[str]]):
        self.m, self.b = m, min(2, m)
        self.default = m - self.b + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple, list] = defaultdict(list)
        for pattern, items in patterns.items():
            for end in range(self.b, m + 1):
                block = pattern[end - self.b : end]
                self.shift[block] = min(self.shift.get(block, self.default), m - end)
            self.buckets[pattern[-self.b :], pattern[: self.b]].append((pattern, items))

    def search(self, doc: list[bytes], marks: np.ndarray, items: set[str]) -> None:
        """Marks where occurrences begin (+1) and end (-1), and collects their items."""
        m, b, shift, default, buckets = self.m, self.b, self.shift, self.default, self.buckets
        at, n = m, len(doc)
        while at <= n:
            block = tuple(doc[at - b : at])
            move = shift.get(block, default)
            if move:
                at += move
                continue
            start = at - m
            for pattern, found in buckets.get((block, tuple(doc[start : start + b])), ()):
                if tuple(doc[start:at]) == pattern:
                    marks[start] += 1
                    marks[at] -= 1
                    items |= found
            at += 1


class Matcher:
    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            w = words(text)
            m = min(window, len(w))
            for i in range(len(w) - m + 1 if m else 0):
                by_length[m][tuple(w[i : i + m])].add(item)
        self.tables = [_SameLength(m, patterns) for m, patterns in sorted(by_length.items())]

    def search(self, doc: list[bytes], marks: np.ndarray, items: set[str]) -> None:
        for table in self.tables:
            table.search(doc, marks, items)


_SPAN = StructType([StructField("start", LongType()), StructField("end", LongType())])


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Adds n_words and n_hit (long), hit_spans (array of [start, end) in words, merged) and items (array of the item
    ids as strings, sorted) to the documents.

    A word is a run of letters, digits or non-ASCII characters after A-Z are lower-cased. An item's windows are all its
    runs of `window` words; a shorter item is one window; an item without words has none. A null text has no words. A
    null item id reads as "null"; items that repeat an id count as one. Documents that repeat stay. Other columns stay;
    one named like a new one is replaced.

    The benchmark is read in blocks of bounded size, hashed by item. Each block's tables are sent to the tasks, and one pass
    over the documents goes through all blocks, adding to the spans."""
    spark = docs.sparkSession
    items = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"),
        F.coalesce(F.col(item_text), F.lit("")).cast("binary").alias("words"),
    )
    size = items.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))
    fields = [
        StructField("n_words", LongType()),
        StructField("n_hit", LongType()),
        StructField("hit_spans", ArrayType(_SPAN)),
        StructField("items", ArrayType(StringType())),
    ]
    if text in {f.name for f in fields}:
        raise ValueError(f"the text column has the name of a result: {text}")
    out = docs
    for block in range(n_blocks):
        # Each block holds about block_bytes; an item is in one block whole.
        rows = items.distinct().where(F.pmod(F.xxhash64("item", "words"), F.lit(n_blocks)) == block).collect()
        sent = spark.sparkContext.broadcast([(r["item"], bytes(r["words"])) for r in rows])
        out = _search(out, text, fields, sent, window, block > 0)
    return out


def _search(docs, text, fields, sent, window, goes_on) -> DataFrame:
    def make():
        matcher = Matcher(sent.value, window)

        def work(part: pa.RecordBatch) -> list[pa.Array]:
            n_words, n_hit, spans, items = [], [], [], []
            before = zip(part.column("hit_spans").to_pylist(), part.column("items").to_pylist()) if goes_on else None
            for raw in raw_texts(part, text):
                doc = words(raw)
                marks, found = np.zeros(len(doc) + 1, np.int64), set()
                if before:
                    old, known = next(before)
                    found.update(known)
                    for span in old:
                        marks[span["start"]] += 1
                        marks[span["end"]] -= 1
                matcher.search(doc, marks, found)
                edges = np.diff(np.concatenate([[0], (np.cumsum(marks) > 0).astype(np.int8)])) if found else marks
                starts, ends = np.flatnonzero(edges > 0), np.flatnonzero(edges < 0)
                n_words.append(len(doc))
                n_hit.append(int((ends - starts).sum()))
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(starts, ends)])
                items.append(sorted(found))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            return [
                pa.array(n_words, pa.int64()),
                pa.array(n_hit, pa.int64()),
                pa.array(spans, kind),
                pa.array(items, pa.list_(pa.string())),
            ]

        return work

    return append(docs, text, fields, make)


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with their own columns."""
    added = ("n_words", "n_hit", "hit_spans", "items")
    clash = [c for c in docs.columns if c in added]
    if clash:  # keep the documents' columns of these names through the search
        held = docs.withColumnsRenamed({c: f"_own_{c}" for c in clash})
        out = contamination(held, benchmark, **options).where("n_hit = 0").drop(*added)
        return out.withColumnsRenamed({f"_own_{c}": c for c in clash}).select(docs.columns)
    return contamination(docs, benchmark, **options).where("n_hit = 0").select(docs.columns)
