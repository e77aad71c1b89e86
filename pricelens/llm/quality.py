"""Text quality by an interpolated modified Kneser-Ney model over bytes, trained on trusted text.

Spark counts the n-grams and joins them: each n-gram with the totals of its context, and with the probability of its
suffix one order below. The tables are sharded by context and by n-gram; no step holds an order in one task, and no n-gram is
dropped. Each n-gram of a block of texts meets its probability once in a join, with the texts that hold it as an array; only
those that are at least one in HOT_SHARE of the training text are sent to the tasks, which changes no result. A document's
perplexity is held against a quantile of trusted documents of its language that the model has not seen."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from pricelens.llm.byte_paths import SLAB, Table, counted, key, slabs
from pricelens.llm.common import labelled_sample, raw_texts, remainder, slices, written
from pricelens.llm.lm_scoring import uses

#: Bytes of the longest n-gram.
ORDER = 5
#: An n-gram that is looked up in the tasks is at least one in so many symbols of the training text.
HOT_SHARE = 1 << 21
#: Trusted documents that the model is trained on, at most; taken by the order of the ids' hash.
MOST_TRUSTED = 40_000
#: The part of unseen trusted documents of a language that the threshold keeps, and the quantile's error: one in so many ranks.
QUANTILE, RANKS = 0.99, 10_000
#: Remainders of crc32(id as text) modulo 5: held out, for the thresholds; the others train.
HELD_OUT, CALIBRATION = 0, 1
#: Bytes of neighbouring texts whose equal n-grams go into the join as one row; uses and distinct n-grams that a task holds
#: before it sends them on.
BLOCK, MOST_USES, MOST_HELD = 16 << 20, 1 << 20, 1 << 21
#: Rows of one Arrow batch on the way to the join.
ROWS = 1 << 16


@dataclass
class Model:
    """(gram, value) of each order from 1 and (context, value) of each length from 0: log10 of an n-gram's probability, and of
    what a context leaves to the order below. With them the longest n-grams that the tasks look up, and their values."""

    grams: list[DataFrame]
    contexts: list[DataFrame]
    hot: tuple[np.ndarray, np.ndarray]


def _counts(texts: DataFrame) -> DataFrame:
    """(gram, n): the n-grams of the longest order that end with each symbol of the texts."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLAB):
                for found, _, _ in slabs(raw_texts(part, "text"), ORDER):
                    found, n = counted(found)
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["gram", "n"])

    return texts.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> list[float]:
    """The three discounts of an order, from the numbers of n-grams with counts 1 to 4."""
    many = [F.count(F.when(F.col("n") == k, 1)) for k in range(1, 5)]
    n1, n2, n3, n4 = counts.agg(*[m.alias(f"n{k}") for k, m in enumerate(many)]).first()
    if not n1 or not n2:
        return [0.5, 0.75, 0.75]
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.75]
    return [min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, start=1)]


def _last(column: str, length: int) -> Column:
    return F.col(column).bitwiseAND(F.lit((1 << 8 * length) - 1))


def train(texts: DataFrame) -> Model:
    """The model of a column `text`. Without texts every symbol has one chance in 256."""
    orders = {ORDER: written(_counts(texts), "grams")}
    for n in range(ORDER - 1, 0, -1):
        # a lower order counts in how many kinds of the order above an n-gram ends
        orders[n] = written(orders[n + 1].groupBy(_last("gram", n).alias("gram")).agg(F.count("*").alias("n")), "grams")
    below, grams, contexts = None, [], []
    for n in range(1, ORDER + 1):
        d1, d2, d3 = _discounts(orders[n])
        less = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        counts = orders[n].withColumns({"context": F.shiftright("gram", 8), "less": less})
        totals = counts.groupBy("context").agg(F.sum("n").alias("total"), (F.sum("less") / F.sum("n")).alias("left"))
        found = counts.join(totals, "context").withColumn("own", (F.col("n") - F.col("less")) / F.col("total"))
        if below is None:
            found = found.withColumn("q", F.lit(1 / 256))
        else:
            found = found.withColumn("suffix", _last("gram", n - 1)).join(below, "suffix")
        p = F.col("own") + F.col("left") * F.col("q")
        found = written(found.select("gram", "n", p.alias("p")), "probabilities")
        below = found.select(F.col("gram").alias("suffix"), F.col("p").alias("q"))
        grams.append(found.select("gram", "n", F.log10("p").alias("value")))
        contexts.append(written(totals.select("context", F.log10("left").alias("value")), "contexts"))
    size = orders[ORDER].agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = grams[-1].where(F.col("n") >= size / HOT_SHARE).select("gram", "value").toArrow()  # at most HOT_SHARE rows
    return Model([g.select("gram", "value") for g in grams], contexts, (hot["gram"].to_numpy(), hot["value"].to_numpy()))


def _cold(texts: DataFrame, hot) -> DataFrame:
    """(gram): the longest n-grams of the texts that the tasks do not look up, each once."""

    def run(batches):
        table = Table(key(hot.value[0].astype(np.uint64), ORDER))
        held, n = [], 0

        def out(kinds):
            for at in range(0, len(kinds), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(kinds[at : at + ROWS].view(np.int64))], names=["gram"])

        for batch in batches:
            for part in slices(batch, "text", SLAB):
                for found, _, _ in slabs(raw_texts(part, "text"), ORDER):
                    found = counted(found)[0]
                    held.append(found[table.find(key(found, ORDER)) < 0])
                    n += len(held[-1])
                    if n > MOST_HELD:
                        held = [np.unique(np.concatenate(held))]
                        n = len(held[0])
                        if n > MOST_HELD // 2:
                            yield from out(held[0])
                            held, n = [], 0
        if held:
            yield from out(np.unique(np.concatenate(held)))

    return texts.mapInArrow(run, "gram long").distinct()


def backed_off(unseen: DataFrame, model: Model) -> DataFrame:
    """From longest n-grams that training has not seen to (gram, value): what the known contexts leave, down to the longest
    end of the n-gram that is known, and that one's own value."""
    # a key is the length, 16 more for a context, before the bytes; short ones are few and would be hot in a shuffle
    hits = None
    for lengths in (range(3), range(3, ORDER)):
        table, keys = None, []
        for n in lengths:
            parts = [model.contexts[n].select(F.col("context").bitwiseOR(F.lit(16 + n << 48)).alias("key"), "value")]
            keys.append(F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * n) - 1)).bitwiseOR(F.lit(16 + n << 48)))
            if n:
                parts.append(model.grams[n - 1].select(F.col("gram").bitwiseOR(F.lit(n << 48)).alias("key"), "value"))
                keys.append(_last("gram", n).bitwiseOR(F.lit(n << 48)))
            for part in parts:
                table = part if table is None else table.union(part)
        asked = unseen.select("gram", F.explode(F.array(*keys)).alias("key"))
        found = asked.join(F.broadcast(table) if lengths[0] == 0 else table, "key", "left")  # up to two bytes: 131,329 keys
        hits = found if hits is None else hits.union(found)
    code, known = F.shiftright("key", 48), F.col("value").isNotNull()
    found = hits.groupBy("gram").agg(
        F.max(F.when(known & (code < 16), F.struct(code.alias("length"), "value"))).alias("end"),
        *[F.max(F.when(code == 16 + n, F.col("value"))).alias(f"left_{n}") for n in range(ORDER)],
    )
    length = F.coalesce("end.length", F.lit(0))
    value = F.coalesce("end.value", F.lit(-float(np.log10(256))))
    for n in range(ORDER):
        value = value + F.when(length <= n, F.coalesce(f"left_{n}", F.lit(0.0))).otherwise(0.0)
    return found.select("gram", value.alias("value"))


def perplexities(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """All columns but the text, with n_symbols (bytes and one end) and perplexity. A null text is an empty one. Own columns
    named like the new ones are replaced. Repeated rows each give a row."""
    hot = docs.sparkSession.sparkContext.broadcast(model.hot)
    own = [c for c in docs.columns if c not in (text, "n_symbols", "perplexity")]
    docs = docs.select(F.col(text).alias("text"), F.struct(*own, F.lit(0).alias("_")).alias("own"))
    kinds = _cold(docs.select("text"), hot)
    longest = model.grams[-1]
    unseen = written(kinds.join(longest, "gram", "left_anti"), "unseen")
    values = longest.union(backed_off(unseen, model))

    facts = StructType([docs.schema["own"], StructField("n_symbols", LongType()), StructField("log", DoubleType())])
    schema = StructType([
        StructField("gram", LongType()), StructField("block", LongType()), StructField("uses", ArrayType(LongType())),
        StructField("facts", facts),
    ])

    def run(batches):
        grams, logs = hot.value
        table, logs = Table(key(grams.astype(np.uint64), ORDER)), np.append(logs, 0.0)

        def rows(block, gram, starts, found, facts_=None):
            for at in range(0, len(gram), ROWS):
                to = min(at + ROWS, len(gram))
                offsets = pa.array((starts[at : to + 1] - starts[at]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(gram[at:to]),
                        pa.repeat(pa.scalar(block, pa.int64()), to - at),
                        pa.ListArray.from_arrays(offsets, pa.array(found[starts[at] : starts[to]])),
                        facts_.slice(at, to - at) if facts_ else pa.nulls(to - at, facts_type),
                    ],
                    names=schema.names,
                )

        for batch in batches:
            facts_type = pa.struct([("own", batch.schema.field("own").type), ("n_symbols", pa.int64()), ("log", pa.float64())])
            for part in slices(batch, "text", BLOCK):
                keys = part.column("key").to_numpy()  # one after another, as they are of one partition
                block, raws = int(keys[0]), raw_texts(part, "text")
                totals, held, n = np.zeros(len(raws)), [], 0
                for found, starts, of in slabs(raws, ORDER):
                    at = table.find(key(found, ORDER))
                    np.add.at(totals, of, np.add.reduceat(logs[at], starts))  # -1 is the 0 at the end
                    left = np.flatnonzero(at < 0)
                    held.append((found[left], np.repeat(np.array(of, np.int64), np.diff(np.append(starts, len(found))))[left]))
                    n += len(left)
                    if n >= MOST_USES:
                        yield from rows(block, *uses(held))
                        held, n = [], 0
                if n:
                    yield from rows(block, *uses(held))
                # and one row for each document, under an n-gram that nothing has
                sizes = pa.array([len(r) + 1 for r in raws], pa.int64())
                of_docs = pa.StructArray.from_arrays([part.column("own"), sizes, pa.array(totals)], names=facts.names)
                one = np.arange(len(raws) + 1)
                yield from rows(block, -1 - keys, one, one[:-1] << 32, of_docs)

    found = docs.withColumn("key", F.monotonically_increasing_id()).mapInArrow(run, schema)
    used = found.join(values, "gram", "left").select("value", "block", F.explode("uses").alias("use"), "facts")
    times = F.col("use").bitwiseAND(F.lit((1 << 32) - 1))
    log = F.sum(F.coalesce("facts.log", F.lit(0.0)) + F.coalesce(times * F.col("value"), F.lit(0.0)))
    n = F.first("facts.n_symbols", ignorenulls=True)
    return (
        used.groupBy((F.col("block") + F.shiftright("use", 32)).alias("key"))
        .agg(F.first("facts.own", ignorenulls=True).alias("own"), n.alias("n_symbols"), log.alias("log"))
        .select(*[F.col("own")[c].alias(c) for c in own], "n_symbols", F.pow(F.lit(10.0), -F.col("log") / F.col("n_symbols")).alias("perplexity"))
    )


def classified(
    docs: DataFrame,
    labels: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    label: str = "quality",
    quantile: float = QUANTILE,
    most: int = MOST_TRUSTED,
) -> DataFrame:
    """One row per document: doc_id, lang, held_out, n_symbols, perplexity, threshold, kept (perplexity up to threshold).

    Trusted are documents labelled 1. Those with crc32(id as text) modulo 5 of 2 to 4 train the model, at most `most`; those with 1 give
    each language's threshold, the quantile of their perplexities; those with 0 are held out from both. A language without
    such documents, or a null one that has none, takes the quantile over all languages; without any, all are kept. The quantile
    is Spark's approximate one, right to one in RANKS of the ranks. Repeated rows each give a row. Other columns are left out."""
    sample = labelled_sample(docs, labels, label, doc_id=doc_id, text=text, remainders=(2, 3, 4), most=most)
    docs = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    model = train(written(sample.where("label = 1").select("text"), "trusted"))
    scored = written(perplexities(docs, model), "scored")
    trusted = labels.where(F.col(label) == 1).select(F.col(doc_id).alias("_id")).dropna().distinct()
    calibration = scored.where(remainder("doc") == CALIBRATION).join(trusted, F.col("doc") == F.col("_id"), "left_semi")
    at = F.percentile_approx("perplexity", quantile, RANKS)
    general = calibration.agg(at).first()[0]
    # as many rows as languages
    thresholds = calibration.groupBy(F.col("lang").alias("_lang")).agg(at.alias("_own"))
    threshold = F.coalesce("_own", F.lit(general).cast("double"))
    return scored.join(thresholds, F.col("lang").eqNullSafe(F.col("_lang")), "left").select(
        F.col("doc").alias(doc_id),
        "lang",
        (remainder("doc") == HELD_OUT).alias("held_out"),
        "n_symbols",
        "perplexity",
        threshold.alias("threshold"),
        F.coalesce(F.col("perplexity") <= threshold, F.lit(True)).alias("kept"),
    )
