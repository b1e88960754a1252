"""Near duplicates against exact comparison of all pairs."""

import random
import re

import numpy as np
import pytest

from sparkjets.llm import near_dups


def shingle_set(text, words):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not found:
        return frozenset()
    size = min(words, len(found))
    return frozenset(tuple(found[i : i + size]) for i in range(len(found) - size + 1))


def brute(rows, words, threshold=80):
    sets = [shingle_set(t, words) for _, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, _) in enumerate(rows):
        for y, (j, _) in enumerate(rows[:x]):
            if i is None or j is None or not sets[x] or not sets[y]:
                continue
            both = len(sets[x] & sets[y])
            if 100 * both >= threshold * (len(sets[x]) + len(sets[y]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    out = []
    for (i, _), s in zip(rows, sets):
        root = None if i is None else find(i)
        out.append((i, len(s), root, i == root))  # a null id has no component and is kept
    return out


def found(df, words):
    return [tuple(r) for r in near_dups.near_duplicates(df, words).collect()]


def by_text(rows):
    return sorted(map(str, rows))


def changed(draw, words, share):
    return " ".join(w if draw.random() > share else f"n{draw.randrange(10**6)}" for w in words.split())


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(8)
    word = lambda: draw.choice("abcdefghij") + str(draw.randrange(400))
    text = lambda n: " ".join(word() for _ in range(n))
    rows, base, passage = [], text(120), text(80)
    rows += [(i, base) for i in range(30)]  # copies
    rows += [(100 + i, changed(draw, base, 0.004 * (i % 12))) for i in range(90)]  # near copies at all distances
    rows += [(300 + i, f"{passage} {text(60)}") for i in range(90)]  # a passage that many share
    chain = text(100).split()
    for i in range(12):  # a chain whose ends are far apart
        chain[i * 4 : i * 4 + 2] = [word(), word()]
        rows.append((500 - i, " ".join(chain)))
    rows += [(700 + i, text(draw.randint(1, 40))) for i in range(40)]
    rows += [(800, "A b"), (801, "a B"), (802, "a b c"), (803, ""), (804, None), (805, " \n"), (None, base)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize(("small", "block"), [(4, 3), (near_dups.SMALL, near_dups.BLOCK)])
def test_against_all_pairs(documents, corpus, small, block, monkeypatch):
    monkeypatch.setattr(near_dups, "SMALL", small)
    monkeypatch.setattr(near_dups, "BLOCK", block)
    assert by_text(found(documents(corpus, 4), 4)) == by_text(brute(corpus, 4))


def test_branches_against_all_pairs(documents, corpus, monkeypatch):
    for name, value in (("SMALL", 4), ("STRAYS", 1), ("BLOCK", 3)):
        monkeypatch.setattr(near_dups, name, value)
    assert by_text(found(documents(corpus, 4), 4)) == by_text(brute(corpus, 4))


def test_large_nodes_of_few_strays_do_not_branch(documents, monkeypatch):
    """A node of one large component and a few documents beside it was branched into five times its rows."""
    draw = random.Random(4)
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(i, changed(draw, base, 0.02)) for i in range(2 * near_dups.SMALL)] + [(1000 + i, changed(draw, base, 0.07)) for i in range(9)]
    expected = by_text(brute(rows, 4))
    assert len({c for _, _, c, _ in brute(rows, 4)}) > 1
    branched = []
    monkeypatch.setattr(near_dups, "branch", lambda df, to=near_dups.branch: branched.append(df) or to(df))
    assert by_text(found(documents(rows), 4)) == expected and not branched


def test_a_pair_comes_out_of_its_first_common_node_only(spark):
    """Documents that share many nodes were one row for each of these; all pairs still come, but those with the leader."""
    draw = np.random.default_rng(2)
    of = np.unique(draw.integers(0, 1 << 63, 90, dtype=np.uint64))
    x = near_dups.sketch(of, 0).tolist()
    where = {d: [node for node in range(24) if draw.random() < 0.5] for d in range(20)}
    leaders = {node: min(d for d in where if node in where[d]) for node in range(24)}
    rows = [(node, 20, leaders[node], leaders[node], d, d, len(of), 0, x, x) for d in where for node in where[d]]
    columns = "node long, size long, a long, main long, root long, d long, n int, level int, x array<long>, y array<long>"
    df = near_dups._with_earlier(spark.createDataFrame(rows, columns).repartition(3))
    found = sorted(map(tuple, near_dups._pairs_of(df, 80).collect()))
    meet = {(a, b) for a in where for b in where for node in where[a] if a < b and node in where[b] and leaders[node] not in (a, b)}
    assert found == sorted(meet)


def test_rows_that_repeat_an_id(documents):
    rows = [(1, "one two three four five"), (1, "six seven eight nine ten"), (2, "six seven eight nine ten"), (3, "other words of all kinds")]
    assert {(i, c) for i, _, c, _ in found(documents(rows), 4)} == {(1, 1), (2, 1), (3, 3)}


def test_no_documents(documents):
    assert found(documents([]), 4) == []
    assert sorted(found(documents([(1, None), (2, "")]), 5)) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_long_chain_of_links(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 2000)], "a long, b long").repartition(5)
    roots = {r.d: r.root for r in near_dups.components(edges).collect()}
    assert {d: roots.get(d, d) for d in range(301)} == dict.fromkeys(range(301), 0) and roots[2000] == 1000


def test_one_document_of_each_group_stays(documents, odd):
    rows = [*odd, (20, "a b c d e f g h"), (21, "a b c d e f g h")]
    df = documents(rows)
    kept = near_dups.first_of_each(df, 5)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [None, 1, 2, 3, 4, 5, 7, 8, -9, 20]))


def test_rows_that_repeat_an_id_are_judged_by_their_own_texts(documents):
    one, two, three = (" ".join(f"{name}{i}" for i in range(60)) for name in "abc")
    near = one.replace("a59", "other")
    rows = [(1, one), (1, two), (2, near), (3, three), (3, three), (1, two), (4, two), (1, ""), (1, None), (None, one)]
    df = documents(rows)
    kept = near_dups.first_of_each(df, 5)
    assert kept.columns == df.columns
    found = sorted((str(r.doc_id), str(r.text)) for r in kept.collect())
    assert found == sorted([("1", one), ("1", two), ("3", three), ("1", ""), ("1", "None"), ("None", one)])


def test_chance_to_miss_a_pair():
    assert near_dups.missed(0.8) < 1e-5 and near_dups.missed(0.85) < 1e-7


def test_pairs_of_large_nodes_survive_all_rounds(spark):
    """Pairs of similarity exactly 0.8 that share one large node still share one after all branching."""
    draw, n = np.random.default_rng(5), 4000
    one = draw.integers(0, 1 << 32, (n, near_dups.POSITIONS), dtype=np.uint64).astype("<u4")
    two = np.where(draw.random(one.shape) < 0.8, one, one + 1).astype("<u4")
    rows = [(7, i + side * n, 100, bytearray(sig.tobytes())) for side, of in enumerate((one, two)) for i, sig in enumerate(of)]
    sets = spark.createDataFrame(rows, "node long, d long, n long, sig binary").repartition(4).cache()
    nodes = sets.select("node", "d", "n")
    for _ in range(near_dups.LEVELS):
        nodes = near_dups.branch(nodes.join(sets.select("d", "sig"), "d")).distinct()
    left, right = nodes.where(f"d < {n}"), nodes.selectExpr("node", f"d - {n} AS d")
    # five paths of two levels keep 1 - 0.36 ** 5 = 0.994; three rounds with one or two children kept under a half
    assert left.join(right, ["node", "d"]).select("d").distinct().count() > 0.985 * n


def test_sketches_lose_no_link(spark):
    """Pairs at just the threshold pass at every size and across sample levels; far pairs of small sets do not."""
    draw = np.random.default_rng(3)
    rows, expected = [], []
    for n in (1, 5, 9, 90, 450, 500, 512, 540, 1030, 3000, 9000):
        for _ in range(40):
            for similarity in (0.8, 0.6):
                # two sets that share ``both`` of their shingles, the second one larger
                larger = n + int(draw.integers(0, n // 9 + 1))
                both = min(n, int(np.ceil(similarity * (n + larger) / (1 + similarity))))
                of = np.unique(draw.integers(0, 1 << 63, 3 * larger + 9, dtype=np.uint64))
                draw.shuffle(of)
                sides = of[:n], np.concatenate([of[:both], of[n : n + larger - both]])
                row = []
                for side in sides:
                    level = near_dups.sample_level(len(side))
                    row += [len(side), level, *(near_dups.sketch(side, at).tolist() for at in (level, level + 1))]
                rows.append((len(rows), *row))
                expected.append((similarity, n))
    columns = ", ".join(f"n_{e} long, level_{e} int, x_{e} array<long>, y_{e} array<long>" for e in "pq")
    df = spark.createDataFrame(rows, f"id int, {columns}").repartition(3)
    passed = {r.id for r in df.where(near_dups.may_link("p", "q", 80)).collect()}
    assert all(i in passed for i, (similarity, _) in enumerate(expected) if similarity == 0.8)
    assert not any(i in passed for i, (similarity, n) in enumerate(expected) if similarity == 0.6 and n in (90, 450))  # both sides below SAMPLED
