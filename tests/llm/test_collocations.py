"""Phrases against a plain version that counts all of them."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

from pricelens.llm import collocations, queries
from pricelens.llm.queries import table


def plain(rows, top, least, share):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for n in range(1, 5):
                counts.update((lang, *w[i : i + n]) for i in range(len(w) - n + 1))
    candidates = {p: a for p, a in counts.items() if len(p) > 2 and a >= least}
    gone = set()
    for q, a in candidates.items():
        for n in range(2, len(q) - 1):
            for i in range(1, len(q) - n + 1):
                p = (q[0], *q[i : i + n])
                if 100 * a >= share * candidates[p]:
                    gone.add(p)
    found = {}
    for p, a in candidates.items():
        if p in gone:
            continue
        cuts = [(2000000 * a // (counts[p[: k + 1]] + counts[(p[0], *p[k + 1 :])]), k) for k in range(1, len(p) - 1)]
        s, k = min(cuts)
        row = (-s, -a, " ".join(p[1:]).encode(), counts[p[: k + 1]], counts[(p[0], *p[k + 1 :])])
        found.setdefault(p[0], []).append(row)
    return [
        (lang, i, phrase.decode(), -a, left, right, totals[lang], -s)
        for lang, x in found.items()
        for i, (s, a, phrase, left, right) in enumerate(sorted(x)[:top], 1)
    ]


def mined(frame, **more):
    out = collocations.collocations(frame, **more)
    assert out.dtypes == [(c, "string" if c in ("lang", "phrase") else "bigint") for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")]
    return sorted(map(tuple, out.collect()))


def corpus(seed, n, size):
    """Texts over few words, with set phrases of 2 to 5 words, some within others."""
    rng = np.random.default_rng(seed)
    fixed = [[f"p{rng.integers(0, 25)}" for _ in range(rng.integers(2, 6))] for _ in range(30)]
    out = []
    for _ in range(n):
        words = []
        while len(words) < size:
            words += fixed[min(29, rng.zipf(1.4) - 1)] if rng.random() < 0.5 else [f"w{min(60, rng.zipf(1.2))}"]
            if rng.random() < 0.1:
                words.append(rng.choice([",", ".\n", "\t", " ;; "]))
        out.append((rng.choice(["en", "en", "de", None]), " ".join(words)))
    return out


@pytest.mark.parametrize("top, least, share, frontier", [(2000, 5, 80, 2), (20, 5, 80, 1), (5, 3, 40, 1), (40, 8, 100, 2), (7, 30, 80, 1)])
def test_phrases_equal_counting_all(spark, top, least, share, frontier):
    rows = corpus(top, 60, 120)
    frame = spark.createDataFrame([(r[0] and str(r[0]), r[1]) for r in rows], "lang string, text string").repartition(3)
    expected = plain(rows, top, least, share)
    assert len(expected) > 10
    assert mined(frame, top=top, least=least, share=share, frontier=frontier) == sorted(expected)


def test_batches_grow_until_all_is_settled(spark, monkeypatch):
    """Pairs that all lie in longer phrases leave the first batches short of what is asked for."""
    seen = []
    inner = collocations._cuts
    monkeypatch.setattr(collocations, "_cuts", lambda *a: seen.append(a[1]) or inner(*a))
    monkeypatch.setattr(collocations, "CHUNK", 50)
    rows = [("en", f"a{i} b{i} c{i} d{i}. x y{i % 3}") for i in range(10) for _ in range(4)]
    rows += [("en", f"k{i} m{i}. k{i}") for i in range(60) for _ in range(3 + i % 4)]
    frame = spark.createDataFrame(rows, "lang string, text string")
    assert mined(frame, top=30, least=3, frontier=1) == sorted(plain(rows, 30, 3, 80))
    assert len(seen) > 1


def test_collocation_edges(spark):
    rows = [("en", t) for t in ["Big apple!", "big  apple", "big\tapple", "big, apple", "big\napple", "", None, " .,;", "x\x00y ÄÖ", "x\x00y ÄÖ"]]
    rows += [(None, "big apple"), ("und", "BIG APPLE"), ("en", "go " * 5000), ("en", "lone")]
    frame = spark.createDataFrame([(*r, "own", 1) for r in rows], "lang string, text string, phrase string, n int")
    for least in (1, 2, 3):
        assert mined(frame, least=least) == sorted(plain(rows, 2000, least, 80))
    assert mined(frame.limit(0)) == []


def test_words_of_one_number_are_told_apart(spark, monkeypatch):
    inner = collocations._tokens
    seeds = []

    def tokens(rows, seed):
        seeds.append(seed)
        streams, words = inner(rows, seed)
        return (streams, words.withColumn("id", words["id"] * 0)) if seed == 0 else (streams, words)

    monkeypatch.setattr(collocations, "_tokens", tokens)
    rows = [("en", "one two")] * 4
    assert mined(spark.createDataFrame(rows, "lang string, text string"), least=2) == plain(rows, 2000, 2, 80)
    assert seeds == [0, 1]


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 3 * 10**15 + 7, 5 * 10**15, 4 * 10**15 + 11
    found = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(collocations.score("a", "l", "r")).first()[0]
    assert found == 2000000 * a // (left + right)


def test_collocations_on_the_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [(r["lang"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    found = queries.QUERIES["op12_collocations"](spark, sf_dir)
    assert sorted(map(tuple, found.collect())) == sorted(plain(rows, 2000, 30, 80))
    assert mined(table(spark, sf_dir, "documents"), top=50, frontier=1) == sorted(plain(rows, 50, 30, 80))
