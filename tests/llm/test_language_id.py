"""Language models against a plain Kneser-Ney version, and their accuracy on documents that they have not seen."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelens.llm import language_id, queries
from pricelens.llm.common import remainder

SF_DIR = "/root/testdata/sf0.001"


def symbols(text):
    out = []
    for c in text or "":
        low = c.lower()
        s = " " if unicodedata.category(c)[0] not in "LM" else low if len(low) == 1 else c
        if not (s == " " and (not out or out[-1] == " ")):
            out.append(s)
    return "".join(out)


def plain_models(rows, order=4):
    """{lang: function from history and symbol to probability}, straight from the definition."""
    streams = defaultdict(list)
    for lang, text in rows:
        streams[lang].append(" " * (order - 1) + symbols(text))
    alphabet = {c for s in streams.values() for t in s for c in t[order - 1 :]}
    models = {}
    for lang, found in streams.items():
        counts = {order: Counter(t[i - order + 1 : i + 1] for t in found for i in range(order - 1, len(t)))}
        for n in range(order - 1, 0, -1):
            counts[n] = Counter(g[1:] for g in counts[n + 1])
        discounts, totals, kinds = {}, {}, {}
        for n, c in counts.items():
            ones, twos = (sum(v == k for v in c.values()) for k in (1, 2))
            discounts[n] = max(0.05, min(0.95, ones / (ones + 2 * twos))) if ones + twos else 0.5
            totals[n], kinds[n] = Counter(), Counter()
            for g, v in c.items():
                totals[n][g[:-1]] += v
                kinds[n][g[:-1]] += 1

        def p(gram, counts=counts, discounts=discounts, totals=totals, kinds=kinds):
            n = len(gram)
            if not n:
                return 1 / (len(alphabet) + 1)
            low = p(gram[1:], counts, discounts, totals, kinds)
            total = totals[n][gram[:-1]]
            if not total:
                return low
            d = discounts[n]
            return max(counts[n][gram] - d, 0) / total + d * kinds[n][gram[:-1]] / total * low

        models[lang] = p
    return models


@pytest.fixture(scope="module")
def rows(spark):
    found = queries.table(spark, SF_DIR, "documents").select("doc_id", "text", "lang").collect()
    return [(r["doc_id"], r["text"], r["lang"]) for r in found]


def test_entropies_equal_plain_kneser_ney(spark, rows):
    train = [(lang, text[:3000]) for _, text, lang in rows[:60]] + [("xx", "ab ab ab"), ("xx", "b 12 é"), ("yy", "")]
    model = language_id.train(spark.createDataFrame(train, "lang string, text string"))
    plain = plain_models([r for r in train if symbols(r[1])])
    assert model.langs == sorted(plain)
    asked = ["", "ab", "  Ab, c!", "1234", "ÉÉ é漢字", *(text[:400] for _, text, _ in rows[60:75])]
    bits, n, has = language_id.Scorer(model).entropies(asked)
    for i, text in enumerate(asked):
        s = symbols(text)
        assert n[i] == len(s) and has[i] == any(unicodedata.category(c)[0] == "L" for c in text)
        for j, lang in enumerate(model.langs):
            whole = "   " + s
            expected = -sum(math.log2(plain[lang](whole[k : k + 4])) for k in range(len(s))) / max(1, len(s))
            assert bits[i, j] == pytest.approx(expected, abs=1e-9)


def test_probabilities_sum_to_one(rows):
    p = plain_models([("a", rows[0][1][:500])])["a"]
    seen = set(symbols(rows[0][1][:500]))
    for history in ("   ", "the", "qqq"):
        assert sum(p(history + c) for c in seen) + p(history + "\0") == pytest.approx(1)


def test_slices_and_blocks_change_nothing(spark, rows, monkeypatch):
    model = language_id.train(spark.createDataFrame([(x, t) for _, t, x in rows[:40]], "lang string, text string"))
    asked = [t for _, t, _ in rows[:50]] + ["", " "]
    bits, n, _ = language_id.Scorer(model).entropies(asked)
    monkeypatch.setattr(language_id, "SYMBOLS", 997)
    again, m, _ = language_id.Scorer(model).entropies(asked)
    assert np.allclose(bits, again) and (n == m).all()


def test_sorted_hashes_find_all():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        keys = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        found = language_id.SortedHashes(keys)
        assert (found.find(keys) == np.arange(len(keys))).all()
        assert (found.find(keys + np.uint64(1)) == -1).all()


EDGE = [
    (1, "le chat est sur la table", "fr"),
    (1, "le chat est sur la table", "fr"),
    (2, None, "fr"),
    (3, "", "de"),
    (4, "123 ... !!", "de"),
    (5, "der hund und die katze " * 20000, "de"),
    (6, "der hund und die katze", None),
    (None, "la table est ici", "fr"),
    (None, None, None),
    (7, "́́", "de"),
    (8, "漢字 🙂 ẞ İ", "zz"),
]


def test_language_edges(spark):
    docs = spark.createDataFrame([(*r, "own", "x") for r in EDGE], "doc_id long, text string, lang string, score string, _hash string").repartition(3)
    model = language_id.fit(docs)
    out = language_id.predictions(docs, model)
    assert set(out.columns) == set(docs.columns) | {"lang_pred", "cross_entropy", "rejected"}
    found = out.collect()
    assert len(found) == len(EDGE)
    for r in found:
        letter = any(unicodedata.category(c)[0] == "L" for c in r["text"] or "")
        assert (r["lang_pred"] in model.langs) if letter else (r["lang_pred"], r["score"]) == ("und", 0.0)
        assert 0 <= r["score"] <= 1
    assert language_id.predictions(docs.limit(0), model).count() == 0
    nothing = language_id.fit(docs.limit(0))
    assert {(r["lang_pred"], r["score"], r["rejected"]) for r in language_id.predictions(docs, nothing).collect()} == {("und", 0.0, True)}


def test_sample_is_bounded_by_language(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("lang"))
    of = remainder("doc_id", 4) != 2
    found = language_id._sample(docs, of, 100).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in found} == {"a": 100, "b": 100}


def test_language_on_held_out_documents(spark, rows):
    found = queries.QUERIES["op13_language_id"](spark, "/root/testdata/sf0.01").collect()
    langs = {r["doc_id"]: r["lang"] for r in queries.table(spark, "/root/testdata/sf0.01", "documents").collect()}
    held = [r for r in found if r["held_out"] and langs[r["doc_id"]] is not None]
    right = [langs[r["doc_id"]] == r["lang_pred"] for r in held]
    assert len(found) == len(langs) and np.mean(right) > 0.98
    assert np.mean([ok for ok, r in zip(right, held) if not r["rejected"]]) >= np.mean(right)


def test_other_languages_are_rejected(spark, rows):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    model = language_id.fit(docs)
    rng = np.random.default_rng(2)
    strange = [(i, " ".join("".join(rng.choice(list("бвгджзклмнпрстаеиоу"), 6)) for _ in range(40))) for i in range(20)]
    found = language_id.predictions(spark.createDataFrame(strange, "doc_id long, text string"), model).collect()
    assert all(r["rejected"] for r in found)
    usual = language_id.predictions(docs.where(remainder("doc_id", 4) == 2), model).collect()
    assert np.mean([r["rejected"] for r in usual]) < 0.1
