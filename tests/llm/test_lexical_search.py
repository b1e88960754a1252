"""Lexical search by k2-treaps against scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkjets.llm import term_grid

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(items, docs, k):
    found = [(i, split(t)) for i, t in docs if i is not None]
    found = [(i, Counter(t), len(t)) for i, t in found if t]
    n_docs, words = len(found), sum(n for _, _, n in found)
    df = Counter(t for _, tf, _ in found for t in tf)
    out = []
    for item, text in items:
        scored = []
        for i, tf, n in found:
            m = 50 + (50 * n * n_docs) // words
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 20 * m))
                for t in set(split(text)) if t in tf
            )
            if score > 0:
                scored.append((-score, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def run(spark, documents, items, docs, k=5):
    named = spark.createDataFrame(items, "item_id long, text string").withColumns({n: F.lit("x") for n in ("item", "terms", "rank")})
    crowded = documents(docs).withColumns({n: F.lit("x") for n in ("n", "tf", "terms", "height", "number", "score")})
    return sorted(map(tuple, term_grid.rank(named, crowded, k).collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(12)
    word = lambda: f"W{int(draw.paretovariate(0.7)) % 700}"
    text = lambda n: " ".join(word() for _ in range(n))
    docs = [(i, text(draw.randint(0, 60))) for i in range(500)]
    docs += [(1000 + i, "w3 w4, W5") for i in range(60)]  # ties beyond every rank
    items = [(i, text(draw.randint(1, 25))) for i in range(20)] + [(20, docs[7][1]), (21, "w3 w5"), (22, "unheardof"), (23, docs[9][1])]
    return items, docs


@pytest.mark.parametrize("limits", [{}, {"SHARD_DOCS": 7, "TOGETHER": 2, "FIRST": 2}, {"SHARD_POSTINGS": 30, "VOCABULARY": 40}])
def test_against_all_documents(spark, documents, corpus, limits, monkeypatch):
    for name, value in limits.items():
        monkeypatch.setattr(term_grid, name, value)
    items, docs = corpus
    assert run(spark, documents, items, docs) == brute(items, docs, 5)


def test_odd_rows(spark, documents, odd):
    docs = odd + [(11, "ÀB àb İ 漢字,x"), (12, "a-b_c 9"), (13, "long"), (14, "\x85\xa0")]
    items = [
        (1, "Some words"), (1, "long TEXT"), (None, "same text"), (2, None), (3, ""), (4, "àb ÀB 漢字 İ"), (5, "-- \n"), (6, "\x85\xa0"),
        (7, "x" * 3000), (8, "a b c 9"),
    ]
    assert run(spark, documents, items, docs) == brute(items, docs, 5)


def test_empty_tables(spark, documents):
    assert run(spark, documents, [(1, "a")], []) == []
    assert run(spark, documents, [], [(1, "a")]) == []
    assert run(spark, documents, [(1, "a")], [(1, None), (2, "--")]) == []
    assert run(spark, documents, [(1, "a")], [(1, "a")]) == brute([(1, "a")], [(1, "a")], 5)


def test_a_very_long_text(spark, documents):
    docs = [(1, "word " * 400_000 + "rare"), (2, "y" * 2_000_000), (3, "rare word")]
    items = [(1, "rare"), (2, "word y")]
    assert run(spark, documents, items, docs) == brute(items, docs, 5)


def grid(draw, rows, columns, n):
    cells = draw.choice(rows * columns, n, replace=False)
    return cells // columns, cells % columns, draw.integers(1, 10**9, n)


@pytest.mark.parametrize("shape", [(1, 1, 1), (300, 40, 900), (5, 900, 2000), (4000, 3, 50)])
def test_treap_round_trip_and_search(shape):
    draw = np.random.default_rng(3)
    rows, columns, impacts = grid(draw, *shape)
    ids = draw.permutation(10 * shape[1])[: shape[1]].astype(np.int64)
    built = term_grid.Treap.build(rows, columns, impacts, ids)
    tree = term_grid.Treap.load(built.save())
    assert (tree.mask == built.mask).all() and (tree.value == built.value).all() and (tree.first == built.first).all()
    wanted = draw.choice(shape[0], min(shape[0], 6), replace=False)
    total = np.zeros(shape[1], np.int64)
    for r, c, v in zip(rows, columns, impacts):
        total[c] += v * (r in wanted)
    best = term_grid.Best(4)
    tree.search(np.sort(wanted), best)
    order = np.lexsort((ids, -total))[:4]
    order = order[total[order] > 0]
    assert best.score.tolist() == total[order].tolist() and best.id.tolist() == ids[order].tolist()


def test_best_first_looks_at_few_cells():
    draw = np.random.default_rng(4)
    rows, columns, impacts = grid(draw, 64, 4096, 60_000)
    impacts[:8] = 10**12
    tree = term_grid.Treap.build(rows, columns, impacts, np.arange(4096))
    best = term_grid.Best(3)
    looked = tree.search(np.unique(rows[:8]), best)
    assert looked < 8 * 4096
