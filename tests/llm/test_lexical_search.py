"""Ranked search against a plain version that scores every document."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pricelens.llm import lexical_search, queries

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return _TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain(docs, items, top=10):
    """Every document's score for every item, sorted."""
    counts = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = defaultdict(Counter)
    for i, t in dict.fromkeys(items):
        asked[i].update(terms(t))
    out = []
    for i, wanted in asked.items():
        found = []
        for d, c in counts:
            score = 0
            for t, times in wanted.items():
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    m = 100 - 75 + (75 * sum(c.values()) * n_docs) // n_terms
                    score += times * w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(i, k, None if null else d, -s) for k, (s, null, d) in enumerate(sorted(found)[:top], 1)]
    return Counter(out)


EDGE = [
    (1, "alpha beta gamma 10"),
    (2, "Alpha, BETA; gamma/10"),
    (2, "alpha beta gamma 10"),
    (None, "alpha größe"),
    (None, "alpha größe"),
    (3, None),
    (4, ""),
    (5, " .. \x00\t"),
    (6, "beta " * 30000 + "größe"),
    (7, "x\x00y GRÖSSE 漢字🙂"),
    (8, "unrelated words here"),
]
ASKED = [(1, "Alpha alpha beta"), (1, "Alpha alpha beta"), (1, "10"), (2, None), (3, "--"), (None, "größe 漢字🙂"), (4, "nowhere"), (5, "x y y")]


@pytest.mark.parametrize("block_terms", [1 << 20, 2])
def test_search_edges(spark, block_terms):
    rows = [(d, t, "own", 1.5) for d, t in EDGE]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank string, score double").repartition(3)
    items = spark.createDataFrame([(i, t, 9) for i, t in ASKED], "item_id long, text string, doc_id int")
    found = lexical_search.search(docs, items, block_terms=block_terms)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, found.collect())) == plain(EDGE, ASKED)
    for a, b in ((docs.limit(0), items), (docs, items.limit(0))):
        assert lexical_search.search(a, b).count() == 0


@pytest.mark.parametrize("window, segment", [(512, 1 << 24), (4, 3000), (7, 1 << 24)])
def test_search_equals_scoring_every_document(spark, monkeypatch, window, segment):
    """Skewed terms, many ties, and windows small enough that most of them are skipped."""
    monkeypatch.setattr(lexical_search, "WINDOW", window)
    monkeypatch.setattr(lexical_search, "SEGMENT", segment)
    rng = np.random.default_rng(3)
    word = lambda n: " ".join(f"w{int(x)}" for x in np.minimum(rng.zipf(1.3, n), 400))
    rows = [(int(i), word(int(rng.integers(0, 60)))) for i in rng.permutation(900)] + [(2000 + i, "w1 w2 w350") for i in range(40)]
    asked = [(i, word(12)) for i in range(25)] + [(90, "w1 w2"), (91, "w350 w350 w1"), (92, "w399")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    found = lexical_search.search(docs, spark.createDataFrame(asked, "item_id long, text string"))
    assert Counter(map(tuple, found.collect())) == plain(rows, asked)


def test_windows_are_skipped(monkeypatch):
    """The lists' scores are added only in windows whose bounds reach the lowest kept score."""
    monkeypatch.setattr(lexical_search, "WINDOW", 8)
    n = 800
    rare = [400, 401, 402]
    tfs = np.ones(n + len(rare), np.int32)
    row = {"docs": list(range(n)), "n": np.full(n, 5), "terms": [0, 1], "sizes": [n, len(rare)], "places": np.array([*range(n), *rare]), "tfs": tfs}
    plan = lexical_search.Plan([], np.array([1, 5000]), n, 5 * n, 3)
    segment = lexical_search.Segment(plan, row)
    best = [(-10_000_000, False, -k) for k in (3, 2, 1)]
    item = (np.array([0, 1]), np.array([1, 1]))
    segment.windows(0)
    added = []
    places = segment.places
    segment.places = type("Spy", (), {"__getitem__": lambda self, key: added.append(key.stop - key.start) or places[key]})()
    found = segment.search(item, best, 3)
    assert [x[2] for x in found] == rare
    assert sum(added) <= len(rare) + 8  # of 800 postings of the long list


def test_search_on_the_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in queries.table(spark, sf_dir, "documents").collect()]
    items = [(r["item_id"], r["text"]) for r in queries.table(spark, sf_dir, "benchmark").collect()]
    found = queries.QUERIES["op11_lexical_search"](spark, sf_dir)
    assert Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found.collect()) == plain(docs, items)
