"""Scores of texts by prediction by partial matching over bytes, trained beforehand, beside a word-frequency base.

The model is a trie of byte contexts. A symbol not seen after the longest context escapes to the next shorter one (the
escape's estimate is the number of distinct symbols against all counts, method C), and symbols already seen after the longer
context are excluded there. Symbols that a context has seen are a subset of those of its suffix, so what is excluded depends
on the longer context alone, and each context keeps its escape and its exclusions as sums of logarithms.

Counts are made by Spark over all training texts and no node is dropped. Tasks sum what they count before they send it.
Nodes and contexts are tables sharded by path. Each path of a block of texts meets its logarithm once in a join, with the
texts that hold it as an array. Only paths that are at least one in HOT_SHARE of all symbols are sent to the tasks, which
looks them up without a join and changes no result."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StructField, StructType

from pricelens.llm.byte_paths import SLAB, Table, counted, key, slabs
from pricelens.llm.common import raw_texts, remainder, slices, written

#: Bytes of a trie path: a context of up to five and the symbol after it.
DEPTH = 6
#: A path that is looked up in the tasks, or a frequent word, is at least one in so many symbols or words.
HOT_SHARE = 1 << 22
WORD_SHARE = 1 << 20
#: Longer words go the way of rare ones, so that the frequent ones' table is bounded in bytes too.
LONGEST_FREQUENT = 64
#: Bytes of neighbouring texts whose equal paths and rare words go into the join as one row, and uses that such rows hold
#: before they are sent on; a longer text is a block of its own.
BLOCK = 32 << 20
MOST_USES = 1 << 22
#: Bytes of texts whose words are looked at together.
WORDS = 8 << 20
#: Counts of paths, and bytes of counts of words, that a task holds before it sums equal ones; sums of more than half of that
#: are sent on.
MOST_COUNTS = 1 << 21
MOST_WORDS = 32 << 20
#: Rows of one Arrow batch on the way to the join.
ROWS = 1 << 16

#: The end token's key; no word holds a space.
END = b" "


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts, A-Z lowered, one text's after another's, and the number of the text that each is of."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    words, of = lists.flatten().cast(pa.binary()), np.repeat(np.arange(len(texts)), sizes)
    some = pc.not_equal(pc.binary_length(words), 0)  # space at an end leaves an empty one
    return words.filter(some), of[some.to_numpy(zero_copy_only=False)]


def _sums(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct paths of parts of paths with counts, and their counts' sums."""
    path, n = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(path, kind="stable")
    path = path[order]
    first = np.flatnonzero(np.append(True, path[1:] != path[:-1]))
    return path[first], np.add.reduceat(n[order], first)


def _word_sums(held: list[pa.Table]) -> pa.Table:
    summed = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
    return pa.table({"word": summed["word"], "n": summed["n_sum"]})


def task_counts(docs: DataFrame) -> DataFrame:
    """From (text, held_out) to (word, path, n), summed in each task as far as it holds them."""
    schema = pa.schema([("word", pa.binary()), ("path", pa.int64()), ("n", pa.int64())])

    def words_out(held: pa.Table):
        for batch in held.combine_chunks().to_batches(ROWS):
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("word"), none, batch.column("n")], schema=schema)

    def paths_out(path: np.ndarray, n: np.ndarray):
        for at in range(0, len(path), ROWS):
            own = pa.array(path[at : at + ROWS].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.nulls(len(own), pa.binary()), own, pa.array(n[at : at + ROWS])], schema=schema)

    def run(batches):
        paths, n_paths, words, n_bytes = [], 0, [], 0
        for batch in batches:
            for part in slices(batch, "text", SLAB):
                out = part.column("held_out")
                for times, own in enumerate((part.filter(out), part.filter(pc.invert(out)))):
                    for found, _, _ in slabs(raw_texts(own, "text"), DEPTH):
                        found, n = counted(found)
                        paths.append((found, n * times))
                        n_paths += len(n)
                        if n_paths > MOST_COUNTS:
                            paths = [_sums(paths)]
                            n_paths = len(paths[0][0])
                            if n_paths > MOST_COUNTS // 2:
                                yield from paths_out(*paths[0])
                                paths, n_paths = [], 0
                if own.num_rows:  # the last, those that are not held out
                    found = words_of(own.column("text"))[0].value_counts()
                    words.append(pa.table({"word": found.field("values"), "n": found.field("counts")}))
                    words.append(pa.table({"word": pa.array([END], pa.binary()), "n": pa.array([own.num_rows], pa.int64())}))
                    n_bytes += words[-2].nbytes
                    if n_bytes > MOST_WORDS:
                        words = [_word_sums(words)]
                        n_bytes = words[0].nbytes
                        if n_bytes > MOST_WORDS // 2:
                            yield from words_out(words[0])
                            words, n_bytes = [], 0
        if paths:
            yield from paths_out(*_sums(paths))
        if words:
            yield from words_out(_word_sums(words))

    return docs.mapInArrow(run, "word binary, path long, n long")


def corpus_counts(docs: DataFrame) -> DataFrame:
    """From (text, held_out) to (word, path, n) of the texts that are not held out: words have a null path and paths a null
    word. The end token is the word END. Paths that only held-out texts have are there with 0."""
    # dealt out as they are: tasks have summed theirs, a second sum before the shuffle finds next to nothing
    return task_counts(docs).repartition("word", "path").groupBy("word", "path").agg(F.sum("n").alias("n"))


def _last(path: str, length: int) -> Column:
    return F.col(path).bitwiseAND(F.lit((1 << 8 * length) - 1))


def model(counts: DataFrame) -> tuple[list[DataFrame], list[DataFrame], int]:
    """Nodes (path, n) of each depth from 1, contexts of each length from 0, and the number of symbols.

    Every path is one symbol with its context; a shorter node sums those that end so. A context has `den`, the logarithm
    of what a symbol's count is divided by in it; `fall`, the escape from it all the way down; `skip`, what is
    taken off for a hit below it; `total`, `distinct` and `gone` for the next length."""
    sums = [counts.where("path is not null and n > 0").select("path", "n")]
    for d in range(DEPTH - 1, 0, -1):
        sums.insert(0, written(sums[0].groupBy(_last("path", d).alias("path")).agg(F.sum("n").alias("n")), "nodes"))
    size = sums[0].agg(F.sum("n")).first()[0] or 0
    contexts: list[DataFrame] = []
    for length, own in enumerate(sums):
        own = own.withColumn("context", F.shiftright("path", 8))
        sizes = [F.sum("n").cast("double").alias("total"), F.count("*").cast("double").alias("distinct")]
        if not length:
            found = own.groupBy("context").agg(*sizes).withColumns({"gone": F.lit(0.0), "divided": F.lit(0.0)})
        else:
            # the suffix context's counts of the symbols seen here, and what is left of it without them
            below = sums[length - 1].toDF("suffix", "below")
            up = contexts[-1].select(*[F.col(c).alias(f"up_{c}") for c in ("context", "total", "distinct", "gone")])
            found = own.withColumn("suffix", _last("path", length)).join(below, "suffix")
            found = found.groupBy("context").agg(*sizes, F.sum("below").alias("excluded"))
            found = found.withColumn("up_context", _last("context", length - 1)).join(up, "up_context")
            found = found.withColumn("rest", F.col("up_distinct") - F.col("distinct"))
            whole = F.when(F.col("rest") == 0, 1.0).otherwise(F.col("up_total") - F.col("excluded") + F.col("rest"))
            found = found.withColumn("divided", F.log10(whole))
            gone = F.when(F.col("rest") == 0, 0.0).otherwise(F.log10(F.greatest("rest", F.lit(1.0))) - F.col("divided"))
            found = found.withColumn("gone", F.col("up_gone") + gone)
        den = F.log10(F.col("total") + F.col("distinct"))
        found = found.select(
            "context", "total", "distinct", "gone", den.alias("den"),
            (F.log10("distinct") - den + F.col("gone")).alias("fall"), (F.col("divided") + F.col("gone")).alias("skip"),
        )
        contexts.append(written(found, "contexts"))
    return sums, contexts, size


def unseen_paths(paths: DataFrame, nodes: list[DataFrame], contexts: list[DataFrame]) -> DataFrame:
    """From paths that are no node to (path, value), log10 of the probability of the last byte after the others."""
    of_none = contexts[0].select("distinct").first()
    left = 256 - (of_none[0] if of_none else 0)
    unseen = float(-np.log10(left)) if left else 0.0
    # a key is the length, 16 more for a context, before the bytes; short ones are few and would be hot in a shuffle
    none = F.lit(None).cast("double")
    hits = None
    for lengths in (range(3), range(3, DEPTH)):
        table, keys = None, []
        for n in lengths:
            parts = [
                contexts[n].select(F.col("context").bitwiseOR(F.lit(16 + n << 48)).alias("key"), none.alias("log_n"), "fall", "skip", "den")
            ]
            keys.append(F.shiftright("path", 8).bitwiseAND(F.lit((1 << 8 * n) - 1)).bitwiseOR(F.lit(16 + n << 48)))
            if n:
                key_ = F.col("path").bitwiseOR(F.lit(n << 48))
                parts.append(nodes[n - 1].select(key_, F.log10("n"), none, none, none))
                keys.append(_last("path", n).bitwiseOR(F.lit(n << 48)))
            for part in parts:
                table = part if table is None else table.union(part)
        asked = paths.select("path", F.explode(F.array(*keys)).alias("key"))
        found = asked.join(F.broadcast(table) if lengths[0] == 0 else table, "key", "left")
        hits = found if hits is None else hits.union(found)
    code = F.shiftright("key", 48)
    skips = [F.max(F.when(code == 16 + n, F.col("skip"))).alias(f"skip_{n}") for n in range(1, DEPTH)]
    found = hits.groupBy("path").agg(
        F.max(F.when(F.col("log_n").isNotNull(), F.struct(code.alias("depth"), "log_n"))).alias("node"),
        F.max(F.when(F.col("fall").isNotNull(), F.struct((code - 16).alias("length"), "fall", "den"))).alias("top"),
        *skips,
    )
    # the symbol is found below the longest context, in it, or nowhere
    skip = F.coalesce(*[F.when(F.col("node.depth") == n, F.col(f"skip_{n}")) for n in range(1, DEPTH)])
    value = (
        F.when(F.col("node").isNull(), F.coalesce("top.fall", F.lit(0.0)) + unseen)
        .when(F.col("node.depth") == F.col("top.length") + 1, F.col("node.log_n") - F.col("top.den"))
        .otherwise(F.col("top.fall") + F.col("node.log_n") - skip)
    )
    return found.select("path", value.alias("value"))


class Hot:
    """Logarithms of the paths that are looked up in the tasks."""

    def __init__(self, paths: np.ndarray, values: np.ndarray):
        self.table, self.values = Table(key(paths.astype(np.uint64), DEPTH)), np.append(values, 0.0)

    def texts(self, raws: list[bytes], most: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """The sum for each text over its paths that are here; all others as groups of about `most` `uses`."""
        totals, groups, held, n = np.zeros(len(raws)), [], [], 0
        for found, starts, of in slabs(raws, DEPTH):
            at = self.table.find(key(found, DEPTH))
            np.add.at(totals, of, np.add.reduceat(self.values[at], starts))  # -1 is the 0 at the end
            left = np.flatnonzero(at < 0)
            text = np.repeat(np.array(of, np.int64), np.diff(np.append(starts, len(found))))
            held.append((found[left], text[left]))
            n += len(left)
            if n >= most:
                groups.append(uses(held))
                held, n = [], 0
        if n:
            groups.append(uses(held))
        return totals, groups


def uses(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From parts of paths and the rising numbers of their texts: distinct paths, where the uses of each start (and the end),
    and the uses, each a text's number above 32 bits that say how often the path is in it."""
    path, text = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(path, kind="stable")  # leaves the texts of a path in order
    path, text = path[order], text[order]
    other = np.append(True, path[1:] != path[:-1])
    first = np.flatnonzero(other | np.append(True, text[1:] != text[:-1]))
    times = np.diff(np.append(first, len(path)))
    starts = np.flatnonzero(other[first])
    return path[first][starts].view(np.int64), np.append(starts, len(first)), (text[first] << 32) | times


def base_of(part: pa.RecordBatch, frequent: pa.Array, logs: np.ndarray):
    """Tokens, frequent tokens and the sum of their logarithms for each text; the distinct other words, where each one's uses
    start, and the uses."""
    n_tokens, known, base = (np.zeros(part.num_rows, t) for t in (np.int64, np.int64, np.float64))
    values = np.append(logs, 0.0)
    rare, texts, done = [], [], 0
    for some in slices(part.select(["text"]), "text", WORDS):
        n, first = some.num_rows, done
        done += n
        words, of = words_of(some.column("text"))
        words = pa.concat_arrays([words, pa.repeat(pa.scalar(END, pa.binary()), n)])
        of = np.append(of, np.arange(n))
        at = pc.fill_null(pc.index_in(words, value_set=frequent), -1).to_numpy()
        n_tokens[first:done] = np.bincount(of, minlength=n)
        known[first:done] = np.bincount(of[at >= 0], minlength=n)
        base[first:done] = np.bincount(of, values[at], n)  # -1 is the 0 at the end
        rare.append(words.filter(pa.array(at < 0)))
        texts.append(of[at < 0] + first)
    coded = pa.concat_arrays(rare).dictionary_encode()
    if not len(coded):
        return n_tokens, known, base, coded.dictionary, np.zeros(1, np.int64), np.zeros(0, np.int64)
    code, starts, found = uses([(coded.indices.to_numpy().astype(np.uint64), np.concatenate(texts))])
    return n_tokens, known, base, coded.dictionary.take(pa.array(code)), starts, found


def scores(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", held_out: int = 1) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model and the base learn from the documents whose crc32(id as text) modulo 5 is not `held_out`; a null id has
    remainder 0. A null text is empty: one end token, one end symbol. Without training texts the base is
    log10(1) a token and each symbol has one chance in 256. Repeated rows each learn and give a row. Other columns
    are left out.

    Frequent words (at least one in WORD_SHARE, so at most that many) and hot paths (HOT_SHARE) are looked up in the
    tasks; all others are joined with their counts by word, or with their logarithms by path."""
    spark = docs.sparkSession
    docs = docs.select(
        F.col(doc_id).alias("doc"), (remainder(doc_id) == held_out).alias("held_out"), F.col(text).alias("text")
    )
    counts = written(corpus_counts(docs.select("text", "held_out")), "counts")
    words = counts.where("word is not null").select("word", "n")
    size, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    near = (F.col("n") >= size / WORD_SHARE) & (F.octet_length("word") <= LONGEST_FREQUENT)
    divided = size + 0.5 * (distinct + 1)
    kept = words.where(near).select("word", "n").toArrow()  # at most WORD_SHARE rows
    logs = np.log10((kept["n"].to_numpy() + 0.5) / divided)
    frequent = spark.sparkContext.broadcast((kept["word"].combine_chunks(), logs))
    nodes, contexts, n_symbols = model(counts)
    den = contexts[-1].select("context", "den")
    direct = nodes[-1].withColumn("context", F.shiftright("path", 8)).join(den, "context")
    direct = written(direct.select("path", "n", (F.log10("n") - F.col("den")).alias("value")), "direct")
    near_path = F.col("n") >= n_symbols / HOT_SHARE
    kept = direct.where(near_path).select("path", "value").toArrow()  # at most HOT_SHARE rows
    hot = spark.sparkContext.broadcast((kept["path"].to_numpy(), kept["value"].to_numpy()))
    novel = counts.where("path is not null and n = 0").select("path")
    paths = direct.where(~near_path).select("path", "value").union(unseen_paths(novel, nodes, contexts))

    facts = StructType([
        docs.schema["doc"], docs.schema["held_out"], StructField("n_tokens", LongType()), StructField("known", LongType()),
        StructField("base", DoubleType()), StructField("score", DoubleType()),
    ])
    fields = [
        StructField("path", LongType()), StructField("word", BinaryType()), StructField("block", LongType()),
        StructField("uses", ArrayType(LongType())), StructField("facts", facts),
    ]
    docs = docs.withColumn("key", F.monotonically_increasing_id())

    def run(batches):
        ppm = Hot(*hot.value)
        for batch in batches:
            for part in slices(batch, "text", BLOCK):
                own = part.column("key").to_numpy()  # one after another, as they are of one partition
                total, groups = ppm.texts(raw_texts(part, "text"), MOST_USES)
                n_tokens, known, base, *rare = base_of(part, *frequent.value)

                def rows(path, word, starts, uses, facts_=None):
                    for at in range(0, len(path), ROWS):
                        to = min(at + ROWS, len(path))
                        own_uses = uses[starts[at] : starts[to]]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(path[at:to]),
                                pa.repeat(pa.scalar(b"", pa.binary()), to - at) if word is None else word[at:to],
                                pa.repeat(pa.scalar(int(own[0]), pa.int64()), to - at),
                                pa.ListArray.from_arrays(pa.array((starts[at : to + 1] - starts[at]).astype(np.int32)), pa.array(own_uses)),
                                facts_.slice(at, to - at) if facts_ else pa.nulls(to - at, facts_type),
                            ],
                            names=[f.name for f in fields],
                        )

                arrays = [
                    part.column("doc"), part.column("held_out"), pa.array(n_tokens), pa.array(known), pa.array(base), pa.array(total),
                ]
                of_docs = pa.StructArray.from_arrays(arrays, names=[f.name for f in facts])
                facts_type = of_docs.type
                # one row for each document, under a path that nothing has, for each rare word and for each other path
                n = np.arange(part.num_rows + 1)
                yield from rows(-2 - own, None, n, n[:-1] << 32, of_docs)
                yield from rows(np.full(len(rare[0]), -1), *rare)
                for path, starts, found in groups:
                    yield from rows(path, None, starts, found)

    rows = docs.mapInArrow(run, StructType(fields))
    table = words.where(~near).select(F.lit(-1).cast("long").alias("path"), "word", F.col("n").cast("double").alias("x"))
    table = table.union(paths.select("path", F.lit(b""), "value"))
    # by path first, as sorts compare the first key fastest; a rare word has the negative of its hash there
    is_word = F.octet_length("word") > 0
    hashed = F.when(is_word, F.xxhash64("word").bitwiseOR(F.lit(-(1 << 63)))).otherwise(F.col("path"))
    joined = rows.withColumn("path", hashed).join(table.withColumn("path", hashed), ["path", "word"], "left")
    used = joined.select(
        (F.col("path") >= 0).alias("is_path"), is_word.alias("is_word"), "x", "block", F.explode("uses").alias("use"),
        *[F.col("facts")[f.name].alias(f.name) for f in facts],
    )
    times = F.col("use").bitwiseAND(F.lit((1 << 32) - 1))
    each = F.log10((F.coalesce("x", F.lit(0.0)) + 0.5) / F.lit(float(divided)))
    is_word, is_path = F.col("is_word"), F.col("is_path")
    return (
        used.groupBy((F.col("block") + F.shiftright("use", 32)).alias("key"))
        .agg(
            F.first("doc", ignorenulls=True).alias(doc_id),
            F.first("held_out", ignorenulls=True).alias("held_out"),
            F.sum("n_tokens").alias("n_tokens"),
            F.sum(F.when(is_word, F.when(F.col("x") > 0, times).otherwise(0)).otherwise(F.coalesce("known", F.lit(0)))).alias("n_known"),
            F.sum(F.when(is_word, times * each).otherwise(F.coalesce("base", F.lit(0.0)))).alias("base_score"),
            F.sum(F.when(is_path, times * F.col("x")).otherwise(F.coalesce("score", F.lit(0.0)))).alias("score"),
        )
        .select(doc_id, "held_out", "n_tokens", "n_known", F.lit(size).cast("long").alias("train_tokens"), "base_score", "score")
    )
