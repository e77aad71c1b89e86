"""The text operators against brute force, on edge rows and on a small table."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict
from uuid import uuid4

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from compare import connect, differences
from hypothesis import example, given, settings, strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from pricelens.llm import (
    byte_bpe,
    byte_paths,
    chat_format,
    components,
    decontamination,
    exact_dedup,
    line_dedup,
    lm_scoring,
    quality,
    queries,
    simhash,
    token_counts,
    toxicity,
)

SF_DIR = "/root/testdata/sf0.001"
ROWS = "doc_id long, text string, lang string, source string, n_chars long, score string, fingerprint string, n_hit string"
LONG = "lorem ipsum dolor sit amet " * 8000

EDGE_DOCS = [
    (1, "The quick brown fox jumps over the lazy dog again and again today", "en", "a", 1, "x", "y", "z"),
    (2, "THE quick  brown fox jumps over the lazy dog again and again today ", "en", "a", 1, None, None, None),
    (3, None, None, None, None, None, None, None),
    (4, "", "en", "a", 0, "x", "y", "z"),
    (5, LONG, "en", "a", 1, "x", "y", "z"),
    (6, LONG, "en", "a", 1, "x", "y", "z"),
    (7, " \t\n\x0b\x0c\r ", "de", None, 1, "x", "y", "z"),
    (8, "größe ÄÖÜ <|end|> [INST] ▁ ▁▁  x\x00y 漢字 🙂\n\nlast", "de", "b", 1, "x", "y", "z"),
    (1, "The quick brown fox jumps over the lazy dog again and again today", "en", "a", 1, "x", "y", "z"),
    (None, "no id here but the quick brown fox jumps over the lazy dog again", "fr", "a", 1, "x", "y", "z"),
    (None, None, None, None, None, None, None, None),
    (9, "a line that is repeated in many documents\nown nine", "en", "a", 1, "x", "y", "z"),
    (10, "  A LINE that is repeated in many documents\t\nown ten", "en", "a", 1, "x", "y", "z"),
    (11, "own eleven\na line that is repeated in many documents", "en", "a", 1, "x", "y", "z"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(EDGE_DOCS, ROWS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], ROWS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 1, 0), (None, 1, 1), (8, None, None), (9, 0, 1), (9, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def sf_texts(spark):
    return {r["doc_id"]: r["text"] for r in queries.table(spark, SF_DIR, "documents").collect()}


def crc(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SF_DIR), connect(SF_DIR), queries.ORACLE[name]) == []


# -- 1 decontamination -----------------------------------------------------------------------------------------------

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def hits(text, items, window=10):
    doc = _WORD.findall(lower(text or ""))
    hit, found = set(), set()
    for item, words in items:
        words = _WORD.findall(lower(words or ""))
        m = min(window, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            for j in range(len(doc) - m + 1):
                if doc[j : j + m] == words[i : i + m]:
                    hit |= set(range(j, j + m))
                    found.add("null" if item is None else str(item))
    return len(doc), len(hit), sorted(found)


ITEMS = [
    (1, "quick brown fox jumps over the lazy dog again and again"),
    (2, "lazy dog"),
    (2, "Lazy-dog"),
    (10, "ipsum"),
    (3, None),
    (4, " .. "),
    (None, "GRÖSSE ÄÖÜ"),
    (5, "größe äöü"),
]


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_contamination_edges(spark, docs, empty, block_bytes):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = decontamination.contamination(docs, bench, block_bytes=block_bytes)
    assert set(out.columns) == set(docs.columns) | {"n_words", "n_hit", "hit_spans", "items"}
    for r in out.collect():
        if r["text"] != LONG:
            assert (r["n_words"], r["n_hit"], r["items"]) == hits(r["text"], ITEMS)
            assert r["n_hit"] == sum(s["end"] - s["start"] for s in r["hit_spans"])
        else:
            assert (r["n_words"], r["n_hit"], r["items"]) == (40000, 8000, ["10"])
    assert decontamination.contamination(empty, bench).count() == 0
    assert {r["n_hit"] for r in decontamination.contamination(docs, bench.limit(0)).collect()} == {0}
    kept = decontamination.decontaminated(docs, bench)
    assert kept.columns == docs.columns
    clean = Counter(d for d, t, *_ in EDGE_DOCS if not (t == LONG or hits(t, ITEMS)[1]))
    assert Counter(r["doc_id"] for r in kept.collect()) == clean


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=30), st.lists(st.lists(st.sampled_from("abc"), max_size=7), max_size=5))
def test_wu_manber_finds_what_comparison_finds(doc, items):
    items = [(str(i), " ".join(w)) for i, w in enumerate(items)]
    matcher = decontamination.Matcher([(i, w.encode()) for i, w in items], window=4)
    words = decontamination.words(" ".join(doc).encode())
    marks, found = np.zeros(len(words) + 1, np.int64), set()
    matcher.search(words, marks, found)
    n, n_hit, expected = hits(" ".join(doc), items, 4)
    assert (int((np.cumsum(marks) > 0).sum()), sorted(found)) == (n_hit, expected)


# -- 2 language model -------------------------------------------------------------------------------------------------


class PlainPpm:
    """Prediction by partial matching with sets, symbol by symbol."""

    def __init__(self, raws):
        self.after = defaultdict(Counter)
        for raw in raws:
            whole = b"\xff" * (lm_scoring.DEPTH - 1) + raw + b"\xff"
            for i in range(lm_scoring.DEPTH - 1, len(whole)):
                for n in range(lm_scoring.DEPTH):
                    self.after[whole[i - n : i]][whole[i]] += 1

    def symbol(self, history, symbol):
        p, excluded = 1.0, set()
        for n in range(lm_scoring.DEPTH - 1, -1, -1):
            seen = self.after.get(history[len(history) - n :])
            if not seen:
                continue
            left = {s: c for s, c in seen.items() if s not in excluded}
            if not left:
                continue
            total = sum(left.values()) + len(left)
            if symbol in left:
                return p * left[symbol] / total
            p *= len(left) / total
            excluded |= set(left)
        return p / (256 - len(excluded))

    def text(self, raw):
        whole = b"\xff" * (lm_scoring.DEPTH - 1) + raw + b"\xff"
        return sum(
            math.log10(self.symbol(whole[i - lm_scoring.DEPTH + 1 : i], whole[i])) for i in range(lm_scoring.DEPTH - 1, len(whole))
        )


def plain_scores(rows):
    training = [(t or "").encode() for d, t in rows if crc(d) != 1]
    ppm = PlainPpm(training)
    counts = Counter(w for raw in training for w in raw.lower().split())
    counts[None] += len(training)
    if not training:
        del counts[None]
    n, v = sum(counts.values()), len(counts)
    for d, t in rows:
        words = (t or "").encode().lower().split() + [None]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        yield d, crc(d) == 1, len(words), sum(counts[w] > 0 for w in words), n, base, ppm.text((t or "").encode())


@pytest.mark.parametrize("share, block, uses, rows", [(1 << 19, 8 << 20, 1 << 22, 1 << 16), (20, 4000, 50, 7)])
def test_lm_scores_equal_plain_ppm(spark, docs, monkeypatch, share, block, uses, rows):
    for name, value in (("WORD_SHARE", share), ("HOT_SHARE", share), ("BLOCK", block), ("MOST_USES", uses), ("ROWS", rows)):
        monkeypatch.setattr(lm_scoring, name, value)
    rows = [(r[0], r[1][:3000] if r[1] else r[1]) for r in EDGE_DOCS]
    out = lm_scoring.scores(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string")).collect()
    order = lambda r: tuple(str(x) for x in r[:4]) + (round(r[6], 6),)
    for a, b in zip(sorted(map(tuple, out), key=order), sorted(plain_scores(rows), key=order), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


@pytest.mark.parametrize("share", [1 << 20, 50])
def test_lm_keeps_what_is_rare(spark, monkeypatch, share):
    monkeypatch.setattr(lm_scoring, "HOT_SHARE", share, raising=False)
    learned, held = [d for d in range(40) if crc(d) != 1], [d for d in range(40) if crc(d) == 1]
    rows = [(learned[0], "all work and no play " * 60_000)]  # 1.2 MB, so one occurrence is less than one in 2^20
    rows += [(d, f"zebra{d} quagga xylem {d * d} of no rank") for d in learned[1:]]
    rows += [(d, f"Zebra{d} quagga xylitol {d} \U0001f993 all work") for d in held]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ppm = PlainPpm([t.encode() for d, t in rows if crc(d) != 1])
    out = {r["doc_id"]: r["score"] for r in lm_scoring.scores(frame).collect()}
    assert len(out) == len(rows)
    for d, t in rows[1:]:
        assert out[d] == pytest.approx(ppm.text(t.encode()), rel=1e-9)


def test_lm_tasks_send_each_count_once(spark, monkeypatch):
    texts = [f"the same words \t in {d % 3} texts\n" for d in range(60)]
    frame = spark.createDataFrame([(t, crc(d) == 1) for d, t in enumerate(texts)], "text string, held_out boolean").coalesce(1)
    sent, map_in_arrow = [], type(frame).mapInArrow
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, *a: sent.append(map_in_arrow(self, *a)) or sent[-1])
    monkeypatch.setattr(lm_scoring, "SLAB", 100)
    counts = {tuple(r[:2]): r.n for r in lm_scoring.corpus_counts(frame).collect()}
    assert sent[0].count() == len(counts)
    learned = [t for d, t in enumerate(texts) if crc(d) != 1]
    words = Counter(w.encode() for t in learned for w in t.split()) + Counter({lm_scoring.END: len(learned)})
    assert {w: n for (w, p), n in counts.items() if p is None} == words
    monkeypatch.setattr(lm_scoring, "MOST_COUNTS", 20)
    monkeypatch.setattr(lm_scoring, "MOST_WORDS", 100)
    assert {tuple(r[:2]): r.n for r in lm_scoring.corpus_counts(frame).collect()} == counts
    assert sent[1].count() > len(counts)


def test_lm_words_in_slices_equal_split(monkeypatch):
    texts = ["A b\x0bC", None, "", " \t\n\x0b\f\r", " É\x85é \x1c a\x00 a ", "b " * 50, "a B zz É"]
    monkeypatch.setattr(lm_scoring, "WORDS", 10)
    known = [b"a", b"b", lm_scoring.END]
    part = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    n_tokens, n_known, base, rare, starts, uses = lm_scoring.base_of(part, pa.array(known, pa.binary()), np.array([-1.0, -2.0, -4.0]))
    split = [(t or "").encode().lower().split() + [lm_scoring.END] for t in texts]
    assert n_tokens.tolist() == [len(s) for s in split]
    assert n_known.tolist() == [sum(w in known for w in s) for s in split]
    assert base.tolist() == [-s.count(b"a") - 2 * s.count(b"b") - 4 for s in split]
    got = {w: [(int(u) >> 32, int(u) & 0xFFFFFFFF) for u in uses[a:b]] for w, a, b in zip(rare.to_pylist(), starts, starts[1:])}
    others = {w for s in split for w in s} - set(known)
    assert got == {w: [(i, s.count(w)) for i, s in enumerate(split) if w in s] for w in others}


def test_lm_probabilities_sum_to_one():
    raws = [b"abracadabra", b"abc abd abe", b"\xc3\xa4bc"]
    plain = PlainPpm(raws)
    for history in (b"\xff" * 5, b"zzabr", b"abrac", b"qqqqq"):
        assert sum(plain.symbol(history, s) for s in range(256)) == pytest.approx(1)


def test_lm_without_training(spark, empty):
    assert lm_scoring.scores(empty).count() == 0
    only = spark.createDataFrame([(d, "ab") for d in range(200) if crc(d) == 1][:3], "doc_id long, text string")
    for r in lm_scoring.scores(only).collect():
        assert (r["n_known"], r["train_tokens"], r["base_score"]) == (0, 0, 0.0)
        assert r["score"] == pytest.approx(3 * math.log10(1 / 256))


def test_lm_on_the_table_is_better_than_order_0(spark, sf_texts):
    out = queries.op2_lm_scoring(spark, SF_DIR).where("held_out").collect()
    assert len(out) == sum(crc(d) == 1 for d in sf_texts)
    bits = -sum(r["score"] for r in out) / math.log10(2) / sum(len(sf_texts[r["doc_id"]].encode()) + 1 for r in out)
    assert bits < 3.2


def test_table_finds_all_keys():
    keys = np.unique(np.random.default_rng(1).integers(1, 1 << 56, 5000).astype(np.uint64))
    table = byte_paths.Table(keys)
    assert (table.find(keys) == np.arange(len(keys))).all()
    assert (table.find(keys + np.uint64(1)) == np.where(np.isin(keys + np.uint64(1), keys), np.arange(len(keys)) + 1, -1)).all()


def test_long_texts_are_cut_without_loss(monkeypatch):
    raws = [b"abcdefghijklmnopqrst" * 3, b"", b"xyz"]
    whole = [p for p, _, _ in byte_paths.slabs(raws, 6)]
    monkeypatch.setattr(byte_paths, "_PIECE", 7)
    monkeypatch.setattr(byte_paths, "SLAB", 20)
    parts = list(byte_paths.slabs(raws, 6))
    assert len(parts) > 2 and (np.concatenate(whole) == np.concatenate([p for p, _, _ in parts])).all()


# -- 3 SimHash --------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints):
    """From (id, fingerprint) rows to the least id reachable over two or fewer differing bits, row by row."""
    rows = list(prints.items()) if isinstance(prints, dict) else prints
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (rows[i][1] ^ rows[j][1]).bit_count() <= 2:
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    found = [least.get(find(i)) for i in range(len(rows))]
    return dict(zip(prints, found)) if isinstance(prints, dict) else found


def test_simhash_equals_plain(spark, docs, empty, sf_texts):
    for frame, rows in ((docs, [(r[0], r[1]) for r in EDGE_DOCS]), (queries.table(spark, SF_DIR, "documents"), list(sf_texts.items()))):
        prints = [(d, plain_fingerprint(t)) for d, t in rows]
        expected = Counter((d, f"{x:016x}", c) for (d, x), c in zip(prints, plain_classes(prints)))
        assert Counter(map(tuple, simhash.near_duplicates(frame).collect())) == expected
    assert simhash.near_duplicates(empty).count() == 0


def test_links_reach_all_pairs_within_two_bits(spark):
    rng = np.random.default_rng(5)
    seeds = [int(x) for x in rng.integers(0, 1 << 63, 30)]
    prints = set(seeds)
    for s in seeds:
        for _ in range(20):
            x = s
            for b in rng.integers(0, 64, rng.integers(1, 5)):
                x ^= 1 << int(b)
            prints.add(x)
    signed = {x - (1 << 64) if x >= 1 << 63 else x for x in prints}
    found = components.components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")))
    root = {r["id"]: r["root"] for r in found.collect()}
    mine = {x: x for x in signed}

    def find(x):
        while mine[x] != x:
            x = mine[x]
        return x

    for a, b in itertools.combinations(signed, 2):
        if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
            mine[max(find(a), find(b))] = min(find(a), find(b))
    assert {x: root.get(x, x) for x in signed} == {x: find(x) for x in signed}


def test_components_of_a_long_chain(spark):
    chain = spark.range(300).selectExpr("id AS a", "id + 1 AS b")
    assert {r["root"] for r in components.components(chain).collect()} == {0}
    assert components.components(chain.limit(0)).count() == 0


def test_first_of_each_keeps_columns(docs, empty):
    out = simhash.first_of_each(docs)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect())[5] == 1
    assert 6 not in {r["doc_id"] for r in out.collect()}
    assert simhash.first_of_each(empty).count() == 0


# -- 4 quality --------------------------------------------------------------------------------------------------------


def plain_kneser_ney(raws):
    """Probability of a symbol after a history, by recursion over counted sets."""
    order = quality.ORDER
    counts = {order: Counter()}
    for raw in raws:
        whole = b"\xff" * (order - 1) + raw + b"\xff"
        counts[order].update(whole[i - order + 1 : i + 1] for i in range(order - 1, len(whole)))
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discounts, after = {}, {}
    for n, seen in counts.items():
        many = Counter(seen.values())
        if many[1] and many[2]:
            y = many[1] / (many[1] + 2 * many[2])
            d = [1 - 2 * y * many[2] / many[1], 2 - 3 * y * many[3] / many[2], 3 - 4 * y * many[4] / many[3] if many[3] else 0.75]
            discounts[n] = [min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1)]
        else:
            discounts[n] = [0.5, 0.75, 0.75]
        after[n] = defaultdict(dict)
        for g, c in seen.items():
            after[n][g[:-1]][g[-1]] = c

    def p(history, symbol, n=order):
        if not n:
            return 1 / 256
        seen = after[n].get(history[len(history) - n + 1 :] if n > 1 else b"")
        if not seen:
            return p(history, symbol, n - 1)
        total, less = sum(seen.values()), lambda c: discounts[n][min(c, 3) - 1]
        left = sum(less(c) for c in seen.values()) / total
        own = (seen[symbol] - less(seen[symbol])) / total if symbol in seen else 0
        return own + left * p(history, symbol, n - 1)

    return p


@pytest.mark.parametrize("share, block, held, rows", [(1 << 21, 32 << 20, 1 << 22, 1 << 16), (1, 500, 40, 7), (1 << 10, 2000, 300, 50)])
def test_quality_model_equals_plain_kneser_ney(spark, sf_texts, monkeypatch, share, block, held, rows):
    """Whatever is looked up in the tasks, and however the rest is cut on its way to the join."""
    for name, value in (("HOT_SHARE", share), ("BLOCK", block), ("MOST_USES", held), ("MOST_HELD", held), ("ROWS", rows)):
        monkeypatch.setattr(quality, name, value)
    texts = [t[:400] for _, t in sorted(sf_texts.items())[:30]]
    p = plain_kneser_ney([t.encode() for t in texts])
    model = quality.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    tried = [None, "", "größe Äx", texts[0], texts[0], "\x00 漢字 🙂", sorted(sf_texts.items())[40][1][:300]]
    rows = [(i, t, "own", i) for i, t in enumerate(tried)]
    docs = spark.createDataFrame(rows, "id long, text string, own string, perplexity long").coalesce(1)
    out = quality.perplexities(docs, model)
    assert out.columns == ["id", "own", "n_symbols", "perplexity"]
    found = {r["id"]: r for r in out.collect()}
    assert len(found) == len(tried) and {r["own"] for r in found.values()} == {"own"}
    for i, text in enumerate(tried):
        raw = (text or "").encode()
        whole = b"\xff" * (quality.ORDER - 1) + raw + b"\xff"
        logs = [math.log10(p(whole[:i], whole[i])) for i in range(quality.ORDER - 1, len(whole))]
        assert found[i]["n_symbols"] == len(raw) + 1
        assert found[i]["perplexity"] == pytest.approx(10 ** (-sum(logs) / len(logs)), rel=1e-9)
    assert sum(p(b"\xff" * 4, s) for s in range(256)) == pytest.approx(1)


def test_quality_keeps_what_is_rare(spark):
    """An n-gram that training holds once among over two million is joined with its own probability."""
    texts, tried = ["abcdefgh " * 250_000, "wxyzv"], ["wxyzv", "vzyxw", "abcdefghi"]
    model = quality.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert model.grams[-1].count() > len(model.hot[0]) > 0
    p = plain_kneser_ney([t.encode() for t in texts])
    docs = spark.createDataFrame(list(enumerate(tried)), "id long, text string")
    found = [r["perplexity"] for r in quality.perplexities(docs, model).orderBy("id").collect()]
    for text, perplexity in zip(tried, found):
        whole = b"\xff" * (quality.ORDER - 1) + text.encode() + b"\xff"
        logs = [math.log10(p(whole[:i], whole[i])) for i in range(quality.ORDER - 1, len(whole))]
        assert perplexity == pytest.approx(10 ** (-sum(logs) / len(logs)), rel=1e-9)
    assert found[0] < found[1]


def test_quality_edges(docs, empty, labels):
    out = quality.classified(docs, labels).collect()
    assert len(out) == len(EDGE_DOCS) and all(r["perplexity"] > 0 for r in out)
    assert quality.classified(empty, labels).count() == 0
    assert {r["kept"] for r in quality.classified(docs, labels.limit(0)).collect()} == {True}


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.op4_quality(spark, sf).where("held_out").join(queries.table(spark, sf, "labels"), "doc_id").collect()
    good, bad = [r["kept"] for r in out if r["quality"]], [r["kept"] for r in out if not r["quality"]]
    assert np.mean(good) >= 0.9 and np.mean(good) > np.mean(bad) + 0.3


# -- 5 exact duplicates -----------------------------------------------------------------------------------------------


def plain_groups(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((d, t or ""))
    for text, of in groups.items():
        keep = min(of, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))[0]
        for d, _ in of:
            yield d, keep, len(of), d == keep, hashlib.sha256(text.encode()).hexdigest()


def digest_index(spark, buckets=2):
    return exact_dedup.DigestIndex(spark, f"digest_test_{uuid4().hex}", buckets=buckets)


def test_exact_dedup_edges(spark, docs, empty):
    index = digest_index(spark)
    expected = Counter(plain_groups([r[:2] for r in EDGE_DOCS]))
    assert Counter(map(tuple, index.add(docs).collect())) == expected
    again = index.add(docs.where("doc_id in (1, 8)")).collect()
    assert len(again) == 3 and not any(r["kept"] for r in again)
    new = index.add(spark.createDataFrame([(50, "something new"), (51, "quick brown fox")], "doc_id long, text string"))
    assert [r["kept"] for r in new.collect()] == [True, True]
    assert index.rows().count() == len({r[4] for r in expected}) + 2
    assert digest_index(spark).add(empty).count() == 0


#: Copies that differ in white space, so that they come in different parts, and one text of a third of all rows.
SPACED = [(d, "same text" + " " * (d % 7)) for d in range(40)] + [(100 + d, f"text {d // 2}" + "\t" * (d % 2)) for d in range(60)] + [
    (None, "same text" + " " * 6), (3, "same text   "), (200, None), (201, " \n"), (202, "")
]


@pytest.mark.parametrize("parts, hot", [(1, 1000), (5, 1000), (5, 4)])
def test_copies_in_later_parts_are_met_by_the_anti_join(spark, monkeypatch, parts, hot):
    monkeypatch.setattr(exact_dedup, "HOT", hot)
    index, frame = digest_index(spark), spark.createDataFrame(SPACED, "doc_id long, text string")
    expected = Counter(plain_groups(SPACED))
    assert Counter(map(tuple, index.add(frame, parts=parts).collect())) == expected
    # without the anti-join a digest would be there once for each part that has it
    assert index.rows().count() == len({r[4] for r in expected})


def test_a_stopped_batch_can_be_repeated(spark, monkeypatch):
    index, frame = digest_index(spark, None), spark.createDataFrame(SPACED, "doc_id long, text string")
    index.add(spark.createDataFrame([(900, "text 7")], "doc_id long, text string"), batch="first")
    append, calls = exact_dedup.DigestIndex._append, []

    def stops(self, rows, buckets):
        calls.append(buckets)
        if len(calls) == 3:
            raise RuntimeError("stopped")
        append(self, rows, buckets)

    with monkeypatch.context() as patch:
        patch.setattr(exact_dedup.DigestIndex, "_append", stops)
        with pytest.raises(RuntimeError, match="stopped"):
            index.add(frame, batch="second")
    assert index.rows().where("batch = 'second'").count() > 0 and set(calls) == {exact_dedup.BUCKETS}
    seven = hashlib.sha256(b"text7").hexdigest()
    expected = Counter((d, 900 if x == seven else k, n, kept and x != seven, x) for d, k, n, kept, x in plain_groups(SPACED))
    for _ in range(2):  # and once more when it is done
        assert Counter(map(tuple, index.add(frame, batch="second").collect())) == expected
    assert index.rows().count() == len({r[4] for r in expected})


def test_exact_dedup_runs_no_python(spark):
    plan = queries.op5_exact_dedup(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# -- 6 toxicity -------------------------------------------------------------------------------------------------------


LEXICON = toxicity.Lexicon({"idiot": 1.0, "clown": 2.25}, {"moroni": 2.0, "moronica": 9.0})


def plain_matches(text):
    """Kinds by looking at the words around each insult and threat."""
    sums = Counter()
    for kind, word, weight in {m for clause in re.split(r"[.!?;:\n]", text.lower()) for m in plain_clause(re.findall(r"[^\W\d_]+", clause))}:
        sums[kind] += weight
    return [min(sums[k], toxicity.MOST) // toxicity.STEP * toxicity.STEP for k in toxicity.KINDS]


def plain_clause(words):
    def weight(w):
        return LEXICON.words.get(w) or (9.0 if w.startswith("moronica") and len(w) > 8 else 2.0 if w.startswith("moroni") and len(w) > 6 else None)

    for i, w in enumerate(words):
        before, after = words[max(0, i - 3) : i], words[i + 1 : i + 4]
        insult, threat = weight(w), w in toxicity.THREATS and any(x in toxicity.TARGETS for x in after)
        if insult or threat:
            if any(x in toxicity.REPORTS for x in words[:i]):
                kind = "reported"
            elif any(x in toxicity.NEGATIONS for x in before):
                kind = "negated"
            elif threat and not insult:
                kind = "threat"
            else:
                kind = "directed" if any(x in toxicity.TARGETS for x in before + after) else "insult"
            yield kind, w, insult or toxicity.FIXED_WEIGHT


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from("idiot clown moronic moronically moroni kill hurt you er not nie said dijo the a big . ! \n 7".split(" ")), max_size=25))
@example("kill the lights you see".split())
@example("you kill not you idiot you said kill you".split())
def test_grammar_equals_plain(words):
    text = " ".join(words)
    assert toxicity.matches(text, LEXICON) == plain_matches(text)


def test_toxic_clauses():
    count = lambda t: {k: x for k, x in zip(toxicity.KINDS, toxicity.matches(t, LEXICON)) if x}
    assert count("An IDIOT. What moronic weather, a path, moroni") == {"insult": 3}
    assert count("you are an idiot") == {"directed": 1} == count("what an idiot you are")
    assert count("you are not an idiot") == {"negated": 1}
    assert count("he said you idiot") == {"reported": 1}
    assert count("he said so. idiot") == {"insult": 1}
    assert count("we will kill you") == {"threat": toxicity.FIXED_WEIGHT}
    assert count("we will not hurt you") == {"negated": toxicity.FIXED_WEIGHT}
    assert count("kill the lights, never kill the lights") == {} == count("")


def test_clauses_decide_where_words_do_not(spark):
    """The same insults, directed in toxic texts, negated or reported in others: no sum over toxic words tells them apart."""
    insults, rows = ["idiot", "moron", "loser", "scum"], []
    forms = [("you are such a {}", 1), ("what a {} you are", 1), ("you are not such a {}", 0), ("they wrote what a {} you are", 0)]
    for i in range(400):
        form, toxic = forms[i % 4]
        rows.append((i, f"on day {'abcdefghij'[i // 40]} {form.format(insults[i // 4 % 4])} {'xyzuvw'[i % 6]}", toxic))
    rows = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"))
    insult, directed, negated, reported, threat, _ = model.weights
    assert directed >= insult > 0 and threat >= insult and max(negated, reported) <= insult / 2
    out = toxicity.scores(rows, model).collect()
    held = [r for r in out if crc(r["doc_id"]) == 0]
    assert len(held) > 50 and [r for r in held if r["predicted"] != r["toxic"]] == []
    assert {sum(r["matches"].values()) for r in held if "idiot" in r["text"]} == {toxicity.FIXED_WEIGHT}


def test_toxicity_edges(docs, empty, labels):
    model = toxicity.fit(docs, labels)
    out = toxicity.scores(docs, model)
    assert set(out.columns) == set(docs.columns) | {"predicted", "matches"}
    rows = out.collect()
    assert len(rows) == len(EDGE_DOCS) and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["predicted"] for r in rows} == {0}
    assert toxicity.scores(empty, toxicity.fit(empty, labels.limit(0))).count() == 0


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    out = queries.op6_toxicity(spark, sf).where("held_out").join(queries.table(spark, sf, "labels"), "doc_id").collect()
    hit = [(r["predicted"], r["toxic"]) for r in out]
    assert sum(p == t for p, t in hit) / len(hit) > 0.97
    assert sum(p and t for p, t in hit) / sum(t for _, t in hit) > 0.9


# -- 7 token counts ---------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(queries.MODEL))


_alphabet = st.sampled_from(["a", "e", "th", "the", "in", " ", "  ", "    ", "▁", "\n", "\t", "é", "ß", "漢", "🙂", "1", "<0x0A>", "s", ".", "\x00"])


@settings(max_examples=300, deadline=None)
@given(st.lists(_alphabet, max_size=25).map("".join))
@example(" " * 70)
@example("a" * 90)
@example("   the  the")
def test_prefix_counts_equal_encoding_each_prefix(pieces, text):
    known = token_counts.counter(queries.vocabulary(queries.MODEL))
    counts, starts = known.texts(["x y", text])
    mine = counts[starts[1] : starts[2]].tolist()
    assert mine == [len(pieces.encode(text[:k])) for k in range(len(text) + 1)]


def test_only_lengths_of_tokens_with_that_ending_are_tried():
    known = token_counts.counter(queries.vocabulary(queries.MODEL))
    assert all(list(lengths) == sorted(lengths, reverse=True) for lengths in known.ends.values())
    tried = {(t[-3:], len(t)) for t in known.tokens if len(t) > 2}
    assert all(n in known.ends[end] for end, n in tried)
    pairs = {(end, 2) for end in known.ends if end[-2:] in known.tokens}
    assert sum(map(len, known.ends.values())) == len(tried) + len(pairs)


def test_token_counts_on_the_table(spark, docs, empty, pieces, sf_texts):
    for r in queries.op7_token_counts(spark, SF_DIR).collect():
        text = sf_texts[r["doc_id"]]
        assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), len(pieces.encode(text)))
    model = queries.vocabulary(queries.MODEL)
    out = token_counts.prefix_counts(docs, model)
    out = out.select("text", token_counts.n_tokens().alias("n"), token_counts.longest_prefix(5).alias("k"), token_counts.tokens_of_prefix(F.lit(3)).alias("t"))
    for r in out.collect():
        text = r["text"] or ""
        assert r["n"] == len(pieces.encode(text)) and r["t"] == len(pieces.encode(text[:3]))
        assert len(pieces.encode(text[: r["k"]])) <= 5
    assert token_counts.prefix_counts(empty, model).count() == 0


# -- 8 line dedup -----------------------------------------------------------------------------------------------------


def plain_lines(rows):
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(d)
    last = {k: max(h, key=lambda d: (d is not None, d or 0)) for k, h in holders.items() if len(h) >= 3}
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [line for line in lines if key(line) not in last or last[key(line)] == d]
        yield d, len(lines), len(lines) - len(kept), "\n".join(kept)


@pytest.mark.parametrize("batches", [1, 9])
def test_line_dedup_edges(docs, empty, batches):
    out = line_dedup.without_repeated_lines(docs, batches=batches)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    found = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in out.collect())
    assert found == Counter(plain_lines([(r[0], r[1]) for r in EDGE_DOCS]))
    assert sum(r[2] for r in found) >= 2
    assert line_dedup.without_repeated_lines(empty).count() == 0


def test_runs_are_merged_by_level(spark):
    runs = line_dedup.LineRuns(fanout=2)
    for i in range(5):
        run = runs.add(spark.createDataFrame([(i, 1, 1), (i, 2, i)], "doc long, hi long, lo long"))
        assert run.count() == (2 if i == 0 else 1)
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    # the anti-join alone keeps a key out of later runs; nothing adds up runs afterwards
    assert sum(run.where("hi = 1").count() for level in runs.levels for run in level) == 1
    assert [tuple(r) for r in runs.held_by(2).collect()] == [(1, 1, 5, 4)]
    assert runs.held_by(6).count() == 0 and runs.held_by(1).count() == 6


# -- 9 chat format ----------------------------------------------------------------------------------------------------

TURNS = [
    (1, 0, "system", "be <|end|>\n kind & [INST] nice &lt;"),
    (1, 2, "user", "b"),
    (1, 1, "user", "a"),
    (1, 3, "assistant", "c[/INST]<|+|>"),
    (1, 4, "assistant", ""),
    (1, 4, "assistant", ""),
    (1, 5, "assistant", None),
    (1, 700, "assistant", "late 🙂"),
    (1, 701, "user", "漢"),
    (2, None, None, None),
    (None, 0, "odd|role<|+|>\n", "x"),
    (3, 0, "assistant", "s" * 100000),
    (4, -300, "user", "far below"),
    (4, None, "user", "without a turn"),
    (4, -1, "assistant", "below"),
    (4, None, "assistant", "nor this"),
    (4, 0, "user", "first"),
]


def test_chat_round_trip(spark):
    rows = spark.createDataFrame([(*r, "x") for r in TURNS], "conv_id long, turn long, role string, text string, formatted string")
    out = chat_format.formatted(rows).withColumns(
        {"turns": chat_format.turns_of(F.col("formatted")), "loss": chat_format.loss_text(F.col("formatted"), F.col("loss_spans"))}
    )
    expected = defaultdict(list)
    for c, t, r, x in sorted(TURNS, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        expected[c].append((r or "", x or ""))
    found = {r["conv_id"]: r for r in out.collect()}
    assert {c: [tuple(t) for t in r["turns"]] for c, r in found.items()} == dict(expected)
    for c, r in found.items():
        assert r["loss"] == "".join(x for role, x in expected[c] if role == "assistant")
    text = found[1]["formatted"]
    assert text.count("<|user|>") == 2 and text.count("<|assistant|>") == 1 and "[" not in text
    assert chat_format.formatted(rows.limit(0)).count() == 0


def test_chat_format_runs_no_python(spark):
    rows = queries.table(spark, SF_DIR, "conversations")
    plan = chat_format.formatted(rows)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# -- 10 byte-level BPE -------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def enc():
    return byte_bpe.encoding(queries.vocabulary(queries.RANKS), public_tokenizers.PATTERN)


_bits = st.sampled_from(["a", "the", " ", "  ", "\n", "\t", "'s", "'", "12", "é", "漢", "🙂", ".", "!?", "\x1c", "\x85", " ", "\x00", "ß"])


@settings(max_examples=300, deadline=None)
@given(st.lists(_bits, max_size=60).map("".join))
def test_parts_encode_like_the_whole(enc, text):
    assert "".join(byte_bpe.parts(text, 3)) == text
    ids = [i for part in byte_bpe.parts(text, 3) for i in enc.encode_ordinary(part)]
    assert ids == enc.encode_ordinary(text)
    assert enc.decode_bytes(ids) == text.encode()


@pytest.mark.parametrize("run", [" ", "\n ", "\t"])
@pytest.mark.parametrize("tail", ["", "x", " x", " x"])
def test_long_white_space_is_one_match(enc, run, tail):
    text = "ab" + run * 9000 + tail + " end"
    assert byte_bpe.encode_text(enc, text).tolist() == enc.encode_ordinary(text)


def test_byte_bpe_on_the_table(spark, docs, empty, enc, sf_texts):
    for r in queries.op10_byte_bpe(spark, SF_DIR).collect():
        text = sf_texts[r["doc_id"]]
        ids = enc.encode_ordinary(text)
        assert r["n_tokens"] == len(ids) and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    ranks = queries.vocabulary(queries.RANKS)
    out = byte_bpe.decode(byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks, public_tokenizers.PATTERN)
    assert set(out.columns) == set(docs.columns) | {"ids", "decoded"}
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in out.collect())
    assert byte_bpe.encode(empty, ranks, public_tokenizers.PATTERN).count() == 0


def test_encode_and_decode_is_both(spark, docs, empty, enc):
    ranks, pattern = queries.vocabulary(queries.RANKS), public_tokenizers.PATTERN
    two = byte_bpe.decode(byte_bpe.encode(docs, ranks, pattern), ranks, pattern)
    one = byte_bpe.encode_and_decode(docs, ranks, pattern)
    assert sorted(one.columns) == sorted(two.columns)
    assert Counter(map(str, one.select(two.columns).collect())) == Counter(map(str, two.collect()))
    assert byte_bpe.encode_and_decode(empty, ranks, pattern).count() == 0


# -- pipeline ---------------------------------------------------------------------------------------------------------


def test_pipeline_stages_equal_brute_force(spark, enc):
    """Each stage on what its predecessor kept, against a plain version of the stage."""
    docs = queries.table(spark, SF_DIR, "documents")
    columns = docs.columns
    before = {r["doc_id"]: r for r in docs.collect()}
    stage = dict(corpus_pipeline.STAGES)

    out = stage["toxicity"](spark, docs, SF_DIR)
    assert out.columns == columns
    docs = corpus_pipeline.written(out, "test")
    after = {r["doc_id"]: r for r in docs.collect()}
    marks = {r["doc_id"]: r["toxic"] for r in queries.table(spark, SF_DIR, "labels").collect()}
    gone = set(before) - set(after)
    assert all(after[d] == before[d] for d in after)
    assert sum(marks.get(d, 0) == 0 and d in marks for d in gone) <= 1

    out = stage["line_dedup"](spark, docs, SF_DIR)
    assert out.columns == columns
    docs = corpus_pipeline.written(out, "test")
    lines = {r["doc_id"]: r for r in docs.collect()}
    assert {d: r["text"] for d, r in lines.items()} == {d: t for d, _, _, t in plain_lines([(d, r["text"]) for d, r in after.items()])}
    assert all(r["n_chars"] == len(r["text"]) for r in lines.values())

    out = stage["simhash"](spark, docs, SF_DIR)
    assert out.columns == columns
    classes = plain_classes({d: plain_fingerprint(r["text"]) for d, r in lines.items()})
    docs = corpus_pipeline.written(out, "test")
    kept = {r["doc_id"]: r for r in docs.collect()}
    assert set(kept) == {d for d, c in classes.items() if d == c}

    out = stage["decontamination"](spark, docs, SF_DIR)
    assert out.columns == columns
    docs = corpus_pipeline.written(out, "test")
    items = [(r["item_id"], r["text"]) for r in queries.table(spark, SF_DIR, "benchmark").collect()]
    grams = {tuple(w[i : i + 10]) for _, t in items if (w := _WORD.findall(lower(t))) for i in range(max(1, len(w) - 9))}
    sizes = {len(g) for g in grams}
    clean = set()
    for d, r in kept.items():
        w = _WORD.findall(lower(r["text"]))
        if not any(tuple(w[i : i + m]) in grams for m in sizes for i in range(len(w) - m + 1)):
            clean.add(d)
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(left) == clean

    rows = stage["byte_bpe"](spark, docs, SF_DIR).collect()
    assert {r["doc_id"] for r in rows} == clean
    assert all(r["ids"] == enc.encode_ordinary(left[r["doc_id"]]) and r["round_trip"] for r in rows)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF_DIR).select("doc_id").collect()} == clean


OWN = "score predicted matches n_lines n_dropped _doc _gone n_hit items decoded _n_ids _own ids n_tokens _root fp fingerprint".split()


def test_pipeline_stages_on_edge_rows(spark, docs, empty):
    """Also with columns named like those that the stages add, which come back as they were."""
    narrow = docs.select("doc_id", "text", "lang", "source", "n_chars")
    wide = narrow.withColumns({c: F.lit(f"own {c}") for c in OWN})
    for frame in (narrow, wide, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = corpus_pipeline.written(stage(spark, frame, SF_DIR), "test")
            if name != "byte_bpe":
                assert out.columns == frame.columns
            assert out.count() <= frame.count()
            for c in set(OWN) & set(frame.columns) - {"ids", "n_tokens"}:
                if frame is wide:
                    assert {r[0] for r in out.select(c).distinct().collect()} == {f"own {c}"}
