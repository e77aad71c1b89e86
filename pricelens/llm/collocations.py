"""Phrases whose words keep together, mined by best-first growth from word pairs.

A phrase can only score as much as the count of its beginning allows: an extension occurs no more often than what it
extends, so a beginning with count f whose first word has count l gives no phrase above 2f / (l + f), however it is cut.
The frontier of beginnings is grown in batches from the highest bound down, each batch by one pass for the longer
phrases, which are counted only where their beginning, or an end that has to be settled, is in the batch. Once a language
has its phrases above the batch's lowest bound, nothing that is left to grow can change them, ties included.

Every pass reads a table of the documents' words as numbers. Beginnings and ends reach its tasks as bit maps of bounded
size; a false hit there only counts a phrase too many."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pricelens.functions.windows import first_rows
from pricelens.llm.common import raw_texts, slices, written

TOP = 2000
LEAST = 30
#: A phrase goes if a longer one that holds it has this many hundredths of its occurrences.
SHARE = 80
LONGEST = 4
#: Pairs of a language, as a multiple of the phrases that are asked for, that the first batch takes; each next one takes
#: GROWTH times as many.
FRONTIER, GROWTH = 2, 4
#: Bits of a bit map for each key, and at most.
KEY_BITS, MOST_BITS = 16, 1 << 28
#: Words that are worked on together; words a task remembers the numbers of.
CHUNK, KNOWN = 1 << 20, 1 << 19

_PIECE = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes(10 if c in _PIECE else c + 32 if 65 <= c <= 90 else c for c in range(256))
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_PART = 1 << 16


class _Numbers(dict):
    """From a language's words to numbers other than 0."""

    def __init__(self, lang: str, seed: int):
        self.seed = xxhash.xxh64_intdigest(lang.encode(), seed)

    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN:
            self.clear()
        x = xxhash.xxh64_intdigest(word, self.seed) or 1
        self[word] = x = x - (1 << 64) if x >> 63 else x
        return x


def pieces(raw: bytes) -> list[list[bytes]]:
    """The words of the pieces between punctuation marks and line ends, A-Z lower-cased."""
    return [p.split() for p in raw.translate(_FOLD).split(b"\n")]  # what else split() knows as space is a line end


def _tokens(docs: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """From (lang, text) the words, (words array<long>) with 0 after each piece, and (lang, id, word, n)."""

    def streams(batches):
        numbers: dict[str, _Numbers] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                ends, words = [0], []
                for lang, raw in zip(part.column("lang").to_pylist(), raw_texts(part, "text")):
                    if lang not in numbers:
                        numbers[lang] = _Numbers(lang, seed)
                    number = numbers[lang].__getitem__
                    for piece in pieces(raw):
                        if piece:
                            words.extend(map(number, piece))
                            words.append(0)
                    ends.append(len(words))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(words, pa.int64()))], names=["words"])

    def counts(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                counted: dict[str, dict[bytes, int]] = {}
                for lang, raw in zip(part.column("lang").to_pylist(), raw_texts(part, "text")):
                    own = counted.setdefault(lang, {})
                    for piece in pieces(raw):
                        for word in piece:
                            own[word] = own.get(word, 0) + 1
                for lang, own in counted.items():
                    number = _Numbers(lang, seed)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(own), pa.string()), pa.array([number[w] for w in own], pa.int64()),
                         pa.array(list(own), pa.binary()).cast(pa.string()), pa.array(list(own.values()), pa.int64())],
                        names=["lang", "id", "word", "n"],
                    )

    words = docs.mapInArrow(counts, "lang string, id long, word string, n long").groupBy("lang", "id", "word").agg(F.sum("n").alias("n"))
    return docs.mapInArrow(streams, "words array<long>"), words


def _keys(words: list[np.ndarray]) -> np.ndarray:
    """A hash of each phrase, from its words' numbers."""
    h = np.zeros(len(words[0]), np.uint64)
    for w, odd in zip(words, _MIX):
        h = (h ^ (w.view(np.uint64) * odd)) * _MIX[0]
        h ^= h >> np.uint64(29)
    return h


def _places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each key in a map of a power of two of bits."""
    return keys & np.uint64(bits - 1), (keys >> np.uint64(32)) & np.uint64(bits - 1)


class BitMap:
    """A set of phrases that may hold more than was put in, never less."""

    def __init__(self, parts: dict[int, bytes], bits: int):
        self.bits = bits
        self.map = np.zeros(bits // 8, np.uint8)
        for k, part in parts.items():
            self.map[k * _PART // 8 : (k + 1) * _PART // 8] = np.frombuffer(part, np.uint8)

    def has(self, words: list[np.ndarray]) -> np.ndarray:
        a, b = _places(_keys(words), self.bits)
        hit = (self.map[(a >> np.uint64(3)).view(np.int64)] >> (a & np.uint64(7)).astype(np.uint8)) & 1
        at = np.flatnonzero(hit)
        b = b[at]
        out = np.zeros(len(hit), bool)
        out[at] = (self.map[(b >> np.uint64(3)).view(np.int64)] >> (b & np.uint64(7)).astype(np.uint8)) & 1
        return out


def bit_map(phrases: DataFrame, columns: list[str]) -> BitMap:
    """The phrases' map, made in the tasks part by part. Its size follows their number up to MOST_BITS, which bounds what
    reaches the driver and the tasks; with more phrases false hits become more."""
    phrases = phrases.select(*columns)
    n = phrases.count()
    bits = min(MOST_BITS, max(_PART, 1 << (KEY_BITS * n).bit_length()))

    def run(batches):
        for batch in batches:
            at = np.concatenate(_places(_keys([batch.column(c).to_numpy() for c in columns]), bits)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at // _PART), pa.array((at % _PART).astype(np.int32))], names=["part", "bit"])

    def packed(batches):
        for batch in batches:
            out = []
            for found in batch.column("found").to_pylist():
                ones = np.zeros(_PART, np.uint8)
                ones[found] = 1
                out.append(np.packbits(ones, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(out, pa.binary())], names=["part", "bytes"])

    found = phrases.mapInArrow(run, "part long, bit int").groupBy("part").agg(F.collect_set("bit").alias("found"))
    return BitMap({r["part"]: r["bytes"] for r in found.mapInArrow(packed, "part long, bytes binary").collect()}, bits)


def _counted(streams: DataFrame, n: int, maps: dict[str, BitMap], wanted: Callable) -> DataFrame:
    """(w1..wn, a): phrases of n words and their occurrences, of those where `wanted(maps, words)` is true. It must
    depend on nothing but the phrase, so that a phrase's occurrences are all counted or none."""
    sent = streams.sparkSession.sparkContext.broadcast(maps)
    names = [f"w{k}" for k in range(1, n + 1)]

    def run(batches):
        maps = sent.value
        for batch in batches:
            flat = batch.column("words").flatten().to_numpy()  # every text ends with 0
            for at in range(0, len(flat), CHUNK):
                part = flat[at : at + CHUNK + n - 1]
                words = [part[k : len(part) - n + 1 + k] for k in range(n)]
                inside = np.flatnonzero(np.logical_and.reduce([w != 0 for w in words]))
                words = [w[inside] for w in words]
                if len(inside):
                    hit = np.flatnonzero(wanted(maps, words))
                    words = [w[hit] for w in words]
                order = np.argsort(_keys(words))
                words = [w[order] for w in words]
                new = np.append(True, np.logical_or.reduce([w[1:] != w[:-1] for w in words])) if len(order) else np.zeros(0, bool)
                starts = np.flatnonzero(new)
                counts = np.diff(np.append(starts, len(order)))
                yield pa.RecordBatch.from_arrays([*(pa.array(w[starts]) for w in words), pa.array(counts)], names=[*names, "a"])

    schema = ", ".join([*(f"{c} long" for c in names), "a long"])
    return streams.mapInArrow(run, schema).groupBy(*names).agg(F.sum("a").alias("a"))


def _both_frequent(maps, words):
    return maps["words"].has(words[:1]) & maps["words"].has(words[1:])


def _grown(maps, words):
    """All pairs in it are frequent, and its beginning is grown or its end settled."""
    out = np.ones(len(words[0]), bool)
    for k in range(len(words) - 1):
        at = np.flatnonzero(out)
        out[at] = maps["pairs"].has([w[at] for w in words[k : k + 2]])
    at = np.flatnonzero(out)
    words = [w[at] for w in words]
    out[at] = maps["grow"].has(words[:-1]) | maps["settle"].has(words[1:])
    return out


def _named(maps, words):
    return maps["named"].has(words)


def score(a: str, left: str, right: str) -> Column:
    """floor(2000000 a / (left + right)); products beyond 64 bits are exact."""
    wide = lambda c: f"CAST({c} AS DECIMAL(20, 0))"
    return F.expr(f"({wide(a)} * 2000000) div ({wide(left)} + {wide(right)})")


def _cut(k: int, left: str, right: str) -> Column:
    return F.struct(score("a", left, right).alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))


def _bound(first: str) -> Column:
    """What no phrase that begins like this one scores above; `first` is the count of its first word."""
    return score("a", first, "a")


def _longest_share(short: DataFrame, longer: DataFrame, n: int) -> DataFrame:
    """Phrases of n words with `most`, the occurrences of the most frequent one of n + 1 that holds it."""
    own = [f"w{k}" for k in range(1, n + 1)]
    ends = [longer.select(*(F.col(f"w{k + d}").alias(f"w{k}") for k in range(1, n + 1)), "a") for d in (0, 1)]
    most = ends[0].union(ends[1]).groupBy(*own).agg(F.max("a").alias("most"))
    return short.join(most, own, "left")


def _cuts(pairs: DataFrame, most: int, settled: DataFrame | None) -> DataFrame:
    """(lang, cut): the score of the pair at place `most`, 0 where there are fewer; a settled language keeps its cut."""
    best = first_rows(pairs.select("lang", "score"), ["lang"], [F.desc("score")], most)
    cuts = best.groupBy("lang").agg(F.when(F.count("*") < most, 0).otherwise(F.min("score")).cast("long").alias("cut"))
    if settled is not None:
        cuts = cuts.join(settled.withColumnRenamed("cut", "own"), "lang", "left").select("lang", F.coalesce("own", "cut").alias("cut"))
    return written(cuts, "cuts")


def _batch(streams: DataFrame, words: DataFrame, pairs: DataFrame, cuts: DataFrame, maps: dict[str, BitMap], least: int, share: int) -> DataFrame:
    """All phrases that score at least their language's cut and stay: (lang, w1..w4, a, l, r, score)."""
    counts = words.select("id", F.col("n"))
    freq = lambda w, to: counts.toDF(w, to)
    two = lambda i, j, to: pairs.select(F.col("w1").alias(i), F.col("w2").alias(j), F.col("a").alias(to))
    own = written(pairs.join(cuts, "lang").where("bound >= cut"), "grown_pairs")
    asked = own.where("score >= cut")
    found = {**maps, "grow": bit_map(own, ["w1", "w2"]), "settle": bit_map(asked, ["w1", "w2"])}
    three = written(_counted(streams, 3, found, _grown).where(F.col("a") >= least), "three")
    scored = (
        three.join(two("w1", "w2", "f12"), ["w1", "w2"])
        .join(two("w2", "w3", "f23"), ["w2", "w3"])
        .join(words.select(F.col("id").alias("w1"), F.col("n").alias("f1"), "lang"), "w1")
        .join(freq("w3", "f3"), "w3")
        .join(cuts, "lang")
        .withColumn("best", F.least(_cut(1, "f1", "f23"), _cut(2, "f12", "f3")))
        .select("lang", "cut", "w1", "w2", "w3", "a", "f1", "f12", "best.*", _bound("f1").alias("bound"))
    )
    scored = written(scored.where("bound >= cut"), "grown_three")
    asked_three = scored.where("score >= cut")
    found = {**maps, "grow": bit_map(scored, ["w1", "w2", "w3"]), "settle": bit_map(asked_three, ["w1", "w2", "w3"])}
    four = written(_counted(streams, 4, found, _grown).where(F.col("a") >= least), "four")
    # a phrase of four can reach the cut only if its beginning is grown; of the other cuts one may lack a count
    maybe = written(
        four.join(scored.select("lang", "cut", "w1", "w2", "w3", "f1", "f12", F.col("a").alias("f123")), ["w1", "w2", "w3"])
        .join(two("w3", "w4", "f34"), ["w3", "w4"])
        .join(freq("w4", "f4"), "w4")
        .where(F.least(score("a", "f1", "a"), score("a", "f12", "f34"), score("a", "f123", "f4")) >= F.col("cut")),
        "maybe",
    )
    end = maybe.select(*(F.col(f"w{k + 1}").alias(f"w{k}") for k in (1, 2, 3))).distinct()
    open_ends = written(end.join(three, ["w1", "w2", "w3"], "left_anti"), "open_ends")
    if not open_ends.isEmpty():
        more = _counted(streams, 3, {"named": bit_map(open_ends, ["w1", "w2", "w3"])}, _named)
        three = three.union(written(more.join(open_ends, ["w1", "w2", "w3"], "left_semi"), "ends"))
    ends = three.toDF("w2", "w3", "w4", "f234")
    fours = maybe.join(ends, ["w2", "w3", "w4"]).withColumn("best", F.least(_cut(1, "f1", "f234"), _cut(2, "f12", "f34"), _cut(3, "f123", "f4")))
    fours = fours.select("lang", "cut", "w1", "w2", "w3", "w4", "a", "best.*").where("score >= cut")
    stays = F.col("most").isNull() | (100 * F.col("most") < share * F.col("a"))
    none = F.lit(None).cast("long")
    columns = ["lang", "w1", "w2", "w3", "w4", "a", "l", "r", "score"]
    twos = _longest_share(asked, three, 2).where(stays).withColumns({"w3": none, "w4": none})
    threes = _longest_share(asked_three, four, 3).where(stays).withColumn("w4", none)
    return written(twos.select(columns).union(threes.select(columns)).union(fours.select(columns)), "phrases")


def collocations(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", top: int = TOP, least: int = LEAST, share: int = SHARE,
    frontier: int = FRONTIER,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases of 2 to 4 words.

    Texts are lower-cased (A-Z) and parted at punctuation marks and line ends; words are parted by spaces and tabs. A
    null text has none, a null language is `und`; repeated rows count as often as they are there. Of phrases with at
    least `least` occurrences a, the score is the least floor(2000000 a / (l + r)) over the cuts into two, l and r being
    what the parts occur; of equal cuts the one after the fewest words counts. A phrase that lies in a longer one with
    `share` hundredths of its occurrences, itself of at least `least`, is left out. n are the language's words. In the
    order of score, a (both downward) and phrase. No documents give no rows. Other columns are left out."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    seed = 0
    while True:
        streams, words = _tokens(rows, seed)
        words = written(words, "words")
        # two words of one number would share their counts; another seed parts them
        if words.groupBy("id").agg(F.count("*").alias("k")).where("k > 1").isEmpty():
            break
        seed += 1
    streams = written(streams, "streams")
    total = written(words.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    words = written(words.where(F.col("n") >= least), "frequent_words")
    pairs = (
        _counted(streams, 2, {"words": bit_map(words, ["id"])}, _both_frequent)
        .where(F.col("a") >= least)
        .join(words.select(F.col("id").alias("w1"), F.col("n").alias("l"), "lang"), "w1")
        .join(words.select(F.col("id").alias("w2"), F.col("n").alias("r")), "w2")
        .select("lang", "w1", "w2", "a", "l", "r", score("a", "l", "r").alias("score"), _bound("l").alias("bound"))
    )
    pairs = written(pairs, "pairs")
    maps = {"pairs": bit_map(pairs, ["w1", "w2"])}
    most, settled = frontier * top, None
    while True:
        cuts = _cuts(pairs, most, settled)
        found = _batch(streams, words, pairs, cuts, maps, least, share)
        state = cuts.join(found.groupBy("lang").agg(F.count("*").alias("found")), "lang", "left")
        settled = written(state.where((F.col("cut") <= 0) | (F.coalesce("found", F.lit(0)) >= top)).select("lang", "cut"), "settled")
        if cuts.join(settled, "lang", "left_anti").isEmpty():
            break
        most *= GROWTH
    for k in range(1, LONGEST + 1):
        found = found.join(words.select(F.col("id").alias(f"w{k}"), F.col("word").alias(f"word{k}")), f"w{k}", "left")
    found = found.withColumn("phrase", F.concat_ws(" ", *(f"word{k}" for k in range(1, LONGEST + 1))))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    best = first_rows(found, ["lang"], order, top)
    return best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).join(total, "lang").select(
        F.col("lang").alias(lang), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score"
    )
