"""Resharding, the rule ledger and the license join against brute force."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkjets.llm import license_join, queries, resharding, rule_ledger


def moved(flow):
    return sum(n for (a, b), n in flow.items() if a != b)


def test_flow_moves_as_little_as_possible():
    draw = random.Random(1)
    for _ in range(30):
        old = {i: draw.randint(0, 50) for i in range(draw.randint(1, 7))}
        new = resharding.near_equal(sum(old.values()), draw.randint(1, 9))
        flow = resharding.transfers(old, new)
        for i, n in old.items():
            assert sum(v for (a, _), v in flow.items() if a == i) == n
        for j, n in new.items():
            assert sum(v for (_, b), v in flow.items() if b == j) == n
        assert moved(flow) == sum(old.values()) - sum(min(n, new.get(i, 0)) for i, n in old.items())


def test_flow_with_general_costs():
    flow = resharding.min_cost_flow([3, 3], [2, 4], np.array([[1.0, 5.0], [1.0, 2.0]]))
    assert sum(n * [[1, 5], [1, 2]][a][b] for (a, b), n in flow.items()) == 2 * 1 + 1 * 5 + 3 * 2


def check_layout(rows, texts, shards):
    size = {}
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None
        size[r.shard] = size.get(r.shard, 0) + r["size"]
    expected = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in rows) == expected
    for shard in set(r.shard for r in rows):
        assert 0 <= shard < shards
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    return size


def test_resharding_query(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    rows = queries.QUERIES["op5_flow_resharding"](spark, data).collect()
    size = check_layout(rows, [(d.doc_id, d.text) for d in docs], 40)
    mean = sum(size.values()) / 40
    most = max(len((d.text or "").encode()) for d in docs) + 16
    assert max(size.values()) - min(size.get(j, 0) for j in range(40)) <= max(0.05 * mean, most)


def test_only_changed_shards_are_written(spark, documents):
    rows = [(i, "x" * 84) for i in range(40)]
    old = F.when(F.col("doc_id") < 10, 0).when(F.col("doc_id") < 20, 1).when(F.col("doc_id") < 35, 2).otherwise(3)
    new, plan = resharding.reshard(documents(rows), old, 4)
    assert set(plan.rounds[0].of) == {2}
    placed = {r.doc_id: r.shard for r in new.collect()}
    assert len(placed) == 40 and sorted(map(list(placed.values()).count, range(4))) == [10, 10, 10, 10]
    assert all(placed[i] == 0 for i in range(10)) and all(placed[i] == 1 for i in range(10, 20))


def test_resharding_of_odd_documents(documents, odd):
    for rows in ([], odd, odd[:1]):
        new, _ = resharding.reshard(documents(rows), F.lit(0), 3)
        assert sorted(str(r.doc_id) for r in new.collect()) == sorted(str(i) for i, _ in rows)


def test_resharding_by_a_column_of_its_own_name(documents, monkeypatch):
    """The old shard may stand in a column named shard; other columns come through, also with one writer per few rows."""
    monkeypatch.setattr(resharding, "WRITE_BYTES", 200)
    rows = [(i % 5, f"{i:084d}") for i in range(60)]
    df = documents(rows).withColumn("shard", F.lit(1)).withColumn("_old", F.col("text"))
    new, _ = resharding.reshard(df, F.col("shard"), 4)
    assert sorted(new.columns) == sorted(df.columns)
    found = new.collect()
    assert sorted((r.doc_id, r.text) for r in found) == sorted(rows) and all(r._old == r.text for r in found)
    counts = [sum(r.shard == shard for r in found) for shard in range(4)]
    assert max(counts) - min(counts) <= 1


def repeated(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(inside)


def test_measurements_of_odd_texts(documents, odd):
    draw = random.Random(3)
    rows = [(i, t) for i, t in odd if t is None or len(t) < 1000]
    for i in range(60):
        words = [draw.choice(["a", "B", "c#", "é", "漢", "a\x1cb"]) for _ in range(draw.randint(0, 40))]
        rows.append((100 + i, "".join(w + draw.choice([" ", "\n", "\t", "  "]) for w in words)))
    found = sorted((str(r.doc_id), *list(r)[1:8]) for r in rule_ledger.ledger(documents(rows)).collect())
    expected = []
    for i, text in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        counts = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum("A" <= c <= "Z" for c in text))
        expected.append((str(i), *counts, len(lines), len(lines) - len(set(lines)), repeated(words)))
    assert found == sorted(expected)


def test_policies_and_ablation(documents):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(1, good), (2, "few"), (3, "AB CD " * 40), (4, good + " ####### ##"), (5, None), (6, "WORD " + good.upper())]
    entries = rule_ledger.ledger(documents(rows)).cache()
    kept = {r.doc_id: r.kept for r in rule_ledger.apply_policy(entries, rule_ledger.STANDARD).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False}
    base = {r.doc_id: r.kept for r in rule_ledger.apply_policy(entries, rule_ledger.BASE).collect()}
    assert base == {1: True, 2: False, 3: False, 4: True, 5: False, 6: True}
    by_rule = {r.rule: (r.n_fail, r.n_only_this, r.n_kept_without) for r in rule_ledger.ablation(entries, rule_ledger.STANDARD).collect()}
    assert by_rule["few_words"] == (2, 2, 3) and by_rule["symbols"] == (1, 1, 2)
    assert by_rule["capitals"] == (2, 1, 2) and by_rule["repeated_words"] == (1, 0, 1)
    df = documents(rows)
    passing = rule_ledger.passing(df)
    assert passing.columns == df.columns and [r.doc_id for r in passing.collect()] == [1]


def test_ledger_of_nothing_and_of_repeated_rows(documents):
    empty = rule_ledger.ledger(documents([]))
    assert empty.columns == ["doc_id", *rule_ledger.MEASURES, "fail_bits"] and empty.collect() == []
    assert rule_ledger.apply_policy(empty, rule_ledger.STANDARD).collect() == []
    assert rule_ledger.ablation(empty, rule_ledger.STANDARD).collect() == []
    assert rule_ledger.passing(documents([])).collect() == []
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(1, good), (1, good), (1, "few"), (None, good), (None, None)]
    entries = rule_ledger.apply_policy(rule_ledger.ledger(documents(rows)), rule_ledger.STANDARD).collect()
    assert sorted((str(r.doc_id), r.n_words, r.kept) for r in entries) == [
        ("1", 1, False), ("1", 60, True), ("1", 60, True), ("None", 0, False), ("None", 60, True)
    ]


def brute_license(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    split = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", x)
    words = split(lower)
    places = []
    for phrase, label in license_join.PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    base = sorted({label for _, label in places})
    best, labels = 0.0, set(base)
    for line in lower.split("\n"):
        for label, notice, needed in license_join.notices():
            shared = len(set(split(line)) & set(notice))
            if shared >= needed:
                labels.add(label)
                best = max(best, round(shared / len(notice), 6))
    starts = [i for i, _ in places]
    return (
        len(words), len(places), min(starts, default=None), max(starts, default=None),
        ",".join(base), ",".join(sorted(labels)), 1.0 if base else best,
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_license_join(documents, odd, seed):
    draw = random.Random(seed)
    notices = list(license_join.TEMPLATES.values()) + list(license_join.PHRASES)
    rows = list(odd)
    for i in range(80):
        text = draw.choice(notices).split()
        if draw.random() < 0.5:
            text.pop(draw.randrange(len(text)))
        if draw.random() < 0.5:
            draw.shuffle(text)
        text = [w.upper() if draw.random() < 0.3 else w for w in text]
        joined = draw.choice([" ", "-", ", ", "\n"]).join(text)
        rows.append((100 + i, f"{draw.choice(['', '...', 'mit '])}{joined}{draw.choice(['.', ' é the of', 'x'])}"))
    rows.append((900, "CC-BY 4.0 and MIT\nLicense; apache license apache license"))
    found = sorted((str(r.doc_id), str(tuple(r)[1:])) for r in license_join.scan(documents(rows)).collect())
    assert found == sorted((str(i), str(brute_license(t))) for i, t in rows)


def test_license_join_of_nothing(documents):
    assert license_join.scan(documents([])).count() == 0


MIT_FILE = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated files"
BSD_FILE = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that"
ISC_FILE = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted"
MPL_FILE = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not"


def test_license_blocks_cross_lines_and_lack_words(documents):
    filler = "\n".join(f"line {i} of prose" for i in range(400))
    texts = {
        1: (MIT_FILE, "mit-text"), 2: (BSD_FILE, "bsd"), 3: (ISC_FILE, "isc"), 4: (f"{filler}\n# {MPL_FILE}\n{filler}", "mpl-2.0"),
        5: ("Permission is granted, free of charge, to any person\nobtaining a copy of this software", "mit-text"),
        6: ("Licensed under the GNU Affero General\nPublic License, version 3", "agpl"),
        7: ("This program is licensed under the GNU Affero General Public License, version 3", "agpl"),
        8: ("Licensed under the GNU\nLesser General Public License 3", "lgpl"),
        9: ("This work is licensed under the GNU General Public License, version 2", "gpl"),
        10: ("This program is licensed under the GNU General\nPublic License, version 3 or the GNU Lesser one", "gpl,gpl-3.0,lgpl"),
        11: ("Licensed under CC\nBY-NC 4.0", "cc-by,cc-by-nc"), 12: ("licensed under the Artistic License, version 2.0", ""),
        13: (MIT_FILE.replace("charge", "charge\n" + filler), ""), 14: (None, ""), 15: ("", ""),
    }
    rows = [(i, text) for i, (text, _) in texts.items()]
    found = {r.doc_id: r.labels for r in license_join.scan_blocks(documents(rows)).collect()}
    assert found == {i: labels for i, (_, labels) in texts.items()}


def test_license_blocks_keep_what_lines_give(documents, odd):
    rows = [*odd, (900, "released under x the y mit z w v u t s license"), (901, "cc by\nmit license")]
    lines = sorted(map(str, license_join.scan(documents(rows)).collect()))
    assert sorted(map(str, license_join.scan_blocks(documents(rows)).collect())) == lines
