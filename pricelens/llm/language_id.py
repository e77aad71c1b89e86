"""Languages of texts by interpolated Kneser-Ney models over characters, one per language.

Spark counts the n-grams of a bounded sample of each language's documents and from them what each order gives and leaves
to the order below. The models of all languages stand side by side in sorted arrays of n-gram hashes, with a row of
logarithms for each, so a look-up serves all languages. A text gets the language with the lowest cross-entropy per
character. Documents that no model has seen turn its lead over the next language into a probability, and say from which
lead and up to which cross-entropy a language is accepted."""

from __future__ import annotations

import math
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField

from pricelens.functions.windows import first_rows
from pricelens.llm.common import append, remainder, slices, texts, written

#: Characters of the longest n-gram.
ORDER = 4
#: Documents of a language that train its model, and that calibrate, at most; taken by the order of the ids' hash.
MOST_TRAINING = 10_000
MOST_CALIBRATION = 5_000
#: Of crc32(id as text) modulo MODULUS: the documents that are held out, and those that calibrate; the others train.
MODULUS, HELD_OUT, CALIBRATION = 4, 2, 3
#: The part of accepted calibration documents that must be right, and of each language's that its cross-entropy keeps.
PRECISION = 0.99
KEPT = 0.999
#: Symbols, times languages, that are worked on together; bytes of text of a slice.
SYMBOLS = 1 << 22
TEXT = 1 << 20

UNKNOWN = "und"
_SPACE = 32
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


class Letters:
    """From code points to the symbols of the models: letters in lower case, marks, and a space for all else."""

    def __init__(self):
        self.symbols = np.full(0x110000, -1, np.int32)
        self.is_letter = np.zeros(0x110000, bool)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        out = self.symbols[points]
        if (out < 0).any():
            for p in np.unique(points[out < 0]).tolist():
                kind, low = unicodedata.category(chr(p))[0], chr(p).lower()
                self.is_letter[p] = kind == "L"
                self.symbols[p] = _SPACE if kind not in "LM" else ord(low) if len(low) == 1 else p
            out = self.symbols[points]
        return out

    def streams(self, found: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The texts' symbols, runs of spaces as one, each text behind ORDER - 1 spaces; the ends of the texts in them;
        whether a text has a letter."""
        points = np.frombuffer("".join(found).encode("utf-32-le", "surrogatepass"), "<u4")
        lengths = np.array([len(t) for t in found], np.int64)
        ends = np.cumsum(lengths)
        symbols = self(points)
        letters = np.concatenate([[0], np.cumsum(self.is_letter[points])])
        has = letters[ends] > letters[ends - lengths]
        first = np.zeros(len(symbols), bool)
        first[(ends - lengths)[lengths > 0]] = True
        space = symbols == _SPACE
        keep = ~space
        keep[1:] |= ~space[:-1] & ~first[1:]
        kept = np.concatenate([[0], np.cumsum(keep)])[ends]
        sizes = np.diff(np.append(0, kept))
        out = np.full(len(found) * (ORDER - 1) + int(sizes.sum()), _SPACE, np.int32)
        at = np.arange(int(sizes.sum())) + np.repeat(np.arange(1, len(found) + 1) * (ORDER - 1), sizes)
        out[at] = symbols[keep]
        return out, kept + np.arange(1, len(found) + 1) * (ORDER - 1), has


def hashes(symbols: np.ndarray) -> list[np.ndarray]:
    """For n from 1 to ORDER the hash of the n symbols that end at each symbol; those at the start are of no text."""
    x = symbols.astype(np.uint64) + np.uint64(1)
    total, out = np.zeros(len(x), np.uint64), []
    for n in range(ORDER):
        total[n:] += x[: len(x) - n] * _ODD[n]
        h = total + np.uint64((n + 1) * int(_ODD[4]) % 2**64)
        h ^= h >> np.uint64(31)
        h *= _ODD[1]
        h ^= h >> np.uint64(29)
        h *= _ODD[2]
        out.append(h ^ (h >> np.uint64(32)))
    return out


def scored(ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n symbols are of texts and not the spaces before one."""
    inside = np.ones(n, bool)
    starts = np.append(0, ends[:-1])
    for k in range(ORDER - 1):
        inside[starts + k] = False
    return inside


class SortedHashes:
    """A sorted array of hashes, with the place where each value of the leading bits starts."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys  # sorted, distinct
        self.shift = np.uint64(64 - max(1, int(len(keys)).bit_length()))
        self.starts = np.searchsorted(keys >> self.shift, np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The hashes' places, -1 for those that are not there."""
        out = np.full(len(hashes), -1, np.int32)
        if not len(self.keys):
            return out
        bits = (hashes >> self.shift).astype(np.int64)
        at, end = self.starts[bits], self.starts[bits + 1]
        left = np.flatnonzero(at < end)
        at, end, wanted = at[left], end[left], hashes[left]
        while len(left):
            hit = self.keys[at] == wanted
            out[left[hit]] = at[hit]
            at = at + 1
            more = ~hit & (at < end)
            left, at, end, wanted = left[more], at[more], end[more], wanted[more]
        return out


@dataclass
class Model:
    """For each order the n-grams' hashes and natural logarithms of their probabilities, a column for each language, and
    the contexts' with what they leave to the order below; what is left for unknown symbols. Then the calibration."""

    langs: list[str]
    grams: list[np.ndarray] = field(default_factory=list)
    logs: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    left: list[np.ndarray] = field(default_factory=list)
    floor: np.ndarray | None = None
    slope: float = 1.0
    offset: float = 0.0
    least_score: float = 0.0
    most_entropy: dict[str, float] = field(default_factory=dict)


def _gram_counts(sample: DataFrame) -> DataFrame:
    """(lang, h1..h4, c1..c3, n): the longest n-grams with the hashes of their ends and of their contexts' ends."""
    names = [f"h{n}" for n in range(1, ORDER + 1)] + [f"c{n}" for n in range(1, ORDER)]

    def run(batches):
        letters = Letters()
        for batch in batches:
            for part in slices(batch, "text", TEXT):
                of = np.array(part.column("lang").to_pylist(), object)
                raw = texts(part, "text")
                for lang in sorted(set(of)):
                    symbols, ends, _ = letters.streams([raw[i] for i in np.flatnonzero(of == lang)])
                    found = hashes(symbols)
                    at = np.flatnonzero(scored(ends, len(symbols)))
                    distinct, first, n = np.unique(found[-1][at], return_index=True, return_counts=True)
                    at = at[first]
                    columns = [h[at] for h in found] + [h[at - 1] for h in found[:-1]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(n), pa.string()), *(pa.array(c.view(np.int64)) for c in columns), pa.array(n)],
                        names=["lang", *names, "n"],
                    )

    schema = ", ".join(["lang string", *(f"{c} long" for c in names), "n long"])
    longest = f"h{ORDER}"
    return (
        sample.mapInArrow(run, schema)
        .groupBy("lang", longest)
        .agg(F.sum("n").alias("n"), *(F.min(c).alias(c) for c in names if c != longest))
    )


def _order(counts: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(lang, gram, context, suffix, own) and (lang, context, left) of order n."""
    ones, twos = (F.count(F.when(F.col("n") == k, 1)) for k in (1, 2))
    discount = F.greatest(F.lit(0.05), F.least(F.lit(0.95), F.coalesce(F.try_divide(ones, ones + 2 * twos), F.lit(0.5))))
    by_lang = counts.groupBy("lang").agg(discount.alias("d"))
    none = F.lit(0).cast("long")
    rows = counts.select(
        "lang", F.col(f"h{n}").alias("gram"), (F.col(f"c{n - 1}") if n > 1 else none).alias("context"),
        (F.col(f"h{n - 1}") if n > 1 else none).alias("suffix"), "n",
    ).join(by_lang, "lang")
    totals = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), (F.first("d") * F.count("*") / F.sum("n")).alias("left"))
    own = rows.join(totals, ["lang", "context"]).select("lang", "gram", "context", "suffix", ((F.col("n") - F.col("d")) / F.col("total")).alias("own"))
    return own, totals.select("lang", "context", "left")


def _matrix(rows: pa.Table, key: str, value: str, place: dict[str, int], absent: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, a matrix of values by key and language, and for each key a row that it comes from."""
    keys, first, of = np.unique(rows[key].to_numpy().astype(np.int64).view(np.uint64), return_index=True, return_inverse=True)
    out = np.full((len(keys), len(place)), absent)
    out[of, np.array([place[x] for x in rows["lang"].to_pylist()], np.int64)] = rows[value].to_numpy()
    return keys, out, first


def train(sample: DataFrame) -> Model:
    """The models of (lang, text) rows, none of them null. The n-grams of the rows must fit the driver."""
    counts = written(_gram_counts(sample), "grams")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    model, place = Model(langs), {x: i for i, x in enumerate(langs)}
    tables = {ORDER: counts}
    for n in range(ORDER - 1, 0, -1):
        # a lower order counts the kinds of symbols before an n-gram
        rest = [f"h{k}" for k in range(1, n)] + [f"c{k}" for k in range(1, n)]
        tables[n] = tables[n + 1].groupBy("lang", f"h{n}").agg(F.count("*").alias("n"), *(F.min(c).alias(c) for c in rest))
    below_keys, below = np.zeros(1, np.uint64), None
    for n in range(1, ORDER + 1):
        own, totals = (x.toArrow() for x in _order(tables[n], n))
        contexts, left, _ = _matrix(totals, "context", "left", place, 1.0)
        grams, p, first = _matrix(own, "gram", "own", place, 0.0)
        if below is None:
            below = np.full((1, len(langs)), 1 / (len(grams) + 1))
            model.floor = np.log(below[0])
        of = {c: own[c].to_numpy().astype(np.int64).view(np.uint64)[first] for c in ("context", "suffix")}
        p += left[np.searchsorted(contexts, of["context"])] * below[np.searchsorted(below_keys, of["suffix"])]
        for to, x in ((model.grams, grams), (model.logs, np.log(p)), (model.contexts, contexts), (model.left, np.log(left))):
            to.append(x)
        below_keys, below = grams, p
    return model


class Scorer:
    def __init__(self, model: Model):
        self.model, self.letters = model, Letters()
        self.grams = [SortedHashes(g) for g in model.grams]
        self.contexts = [SortedHashes(c) for c in model.contexts]

    def logs(self, found: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        """Natural logarithms of the probabilities of the symbols at these places, a column for each language."""
        m = self.model
        out = np.zeros((len(at), len(m.langs)))
        todo = np.arange(len(at))
        for n in range(ORDER, 0, -1):
            row = self.grams[n - 1].find(found[n - 1][at])
            hit = row >= 0
            out[todo[hit]] += m.logs[n - 1][row[hit]]
            todo, at = todo[~hit], at[~hit]
            if not len(todo):
                return out
            row = self.contexts[n - 1].find(found[n - 2][at - 1]) if n > 1 else np.zeros(len(at), np.int32)
            hit = row >= 0
            out[todo[hit]] += m.left[n - 1][row[hit]]
        out[todo] += m.floor
        return out

    def entropies(self, raw: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits per symbol of each text, a column for each language; the symbols; whether there is a letter."""
        symbols, ends, has = self.letters.streams(raw)
        found = hashes(symbols)
        at = np.flatnonzero(scored(ends, len(symbols)))
        of = np.searchsorted(ends, at, side="right")
        sums = np.zeros((len(raw), len(self.model.langs)))
        step = max(1, SYMBOLS // max(1, len(self.model.langs)))
        for a in range(0, len(at), step):
            logs, rows = self.logs(found, at[a : a + step]), of[a : a + step]
            starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
            np.add.at(sums, rows[starts], np.add.reduceat(logs, starts, axis=0))
        n = np.bincount(of, minlength=len(raw))
        return -sums / np.maximum(n, 1)[:, None] / math.log(2), n, has


def evidence(entropies: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log(1 + lead), the lead being bits that the best language saves over the next on the whole text."""
    if entropies.shape[1] < 2:
        return np.full(len(entropies), 50.0)
    two = np.partition(entropies, 1, axis=1)
    return np.log1p((two[:, 1] - two[:, 0]) * n)


def predictions(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """Adds lang_pred, score (0 to 1, the calibrated chance that it is right), cross_entropy (bits per symbol) and rejected.

    lang_pred is the language with the lowest cross-entropy, the first by name of equal ones, also where it is rejected;
    `und` with score 0, rejected, for a text that is null or has no letter, and for all where no language was learned.
    Rejected are scores and cross-entropies beyond the calibrated bounds. Other columns stay; ones named like the new
    ones are replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer, model = Scorer(sent.value), sent.value
        most = np.array([model.most_entropy.get(x, np.inf) for x in model.langs])

        def work(part: pa.RecordBatch) -> list[pa.Array]:
            raw = texts(part, text)
            if not model.langs:
                return [pa.array([x] * len(raw), t) for x, t in ((UNKNOWN, pa.string()), (0.0, pa.float64()), (None, pa.float64()), (True, pa.bool_()))]
            bits, n, has = scorer.entropies(raw)
            best = bits.argmin(1)
            lowest = bits[np.arange(len(raw)), best]
            score = np.where(has, 1 / (1 + np.exp(-(model.slope * evidence(bits, n) + model.offset))), 0.0)
            names = [model.langs[b] if h else UNKNOWN for b, h in zip(best, has)]
            rejected = ~has | (score < model.least_score) | (lowest > most[best])
            return [pa.array(names, pa.string()), pa.array(score), pa.array(lowest, mask=~has), pa.array(rejected)]

        return work

    new = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("cross_entropy", DoubleType()), StructField("rejected", BooleanType())]
    return append(docs, text, new, make, most=TEXT)


def _logistic(t: np.ndarray, right: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the chance to be right by the evidence t, from counts; half a document is added to each side."""
    t = np.concatenate([t, [t.min(), t.max()]])
    right, n = np.concatenate([right, [0.5, 0.5]]), np.concatenate([n, [1, 1]])
    x = np.stack([t, np.ones(len(t))], 1)
    w = np.array([0.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (right - n * p) - 1e-3 * w
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 0.0), float(w[1])


def calibrate(model: Model, sample: DataFrame, *, precision: float = PRECISION, kept: float = KEPT) -> None:
    """Fits the score and the bounds of rejection to (lang, text) rows that no model has seen; without rows, nothing is
    rejected. The bound of cross-entropy is a percentile within a ten-thousandth of the rows. Evidence is counted in
    steps of a 16th, so only those counts reach the driver."""
    model.slope, model.offset = 1.0, 0.0
    found = predictions(sample, model).where(F.col("lang_pred") != UNKNOWN)
    seen = written(
        # slope 1 and offset 0: the evidence is the logit of the score
        found.select("lang", "cross_entropy", (F.col("lang") == F.col("lang_pred")).cast("int").alias("right"), F.least(F.lit(50.0), -F.log(1 / F.col("score") - 1)).alias("t")),
        "calibration",
    )
    counts = seen.groupBy(F.floor(16 * F.col("t")).alias("t")).agg(F.sum("right").alias("right"), F.count("*").alias("n")).orderBy("t").collect()
    if not counts:
        return
    t, right, n = (np.array([r[c] for r in counts], float) for c in ("t", "right", "n"))
    model.slope, model.offset = _logistic((t + 0.5) / 16, right, n)
    above = np.cumsum(right[::-1])[::-1] / np.cumsum(n[::-1])[::-1]
    good = np.flatnonzero(above >= precision)
    if len(good):
        model.least_score = 1 / (1 + math.exp(-(model.slope * t[good[0]] / 16 + model.offset))) if good[0] else 0.0
    else:
        model.least_score = 1.1
    own = seen.where("right = 1").groupBy("lang").agg(F.percentile_approx("cross_entropy", kept, 10_000).alias("most"))
    model.most_entropy = {r["lang"]: r["most"] for r in own.collect()}


def _sample(docs: DataFrame, of: Column, most: int) -> DataFrame:
    """(lang, text) of the documents that have both and belong to `of`, the `most` of each language with the least hash
    of the id. Only the hashes move; the texts are filtered where they are read. Ids of one hash are in or out together."""
    held = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & of).withColumn("_hash", F.xxhash64("doc_id"))
    last = first_rows(held.select("lang", "_hash"), ["lang"], [F.col("_hash")], most).groupBy("lang").agg(F.max("_hash")).collect()
    if not last:
        return held.select("lang", "text")
    bounds = F.create_map(*(F.lit(x) for row in last for x in row))
    return held.where(F.col("_hash") <= F.element_at(bounds, F.col("lang"))).select("lang", "text")


def fit(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
    most_training: int = MOST_TRAINING, most_calibration: int = MOST_CALIBRATION,
) -> Model:
    """The model of documents that have a text and a language, without those held out (HELD_OUT); at most `most_training`
    and `most_calibration` of each language. Languages are as many as fit the driver with their models."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    part = remainder("doc_id", MODULUS)
    model = train(_sample(docs, ~part.isin(HELD_OUT, CALIBRATION), most_training))
    if model.langs:
        calibrate(model, _sample(docs, part == CALIBRATION, most_calibration))
    return model
