"""Packed files, flat files and packing against the tokenizers library and brute force."""

import functools
import itertools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkjets.llm import packed_ids, packing, queries, token_counts, tokens


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@functools.cache
def tokenizer(plain):
    return tokens.Encoder(plain=plain).tokenizer


def library(text, plain=False):
    return tokenizer(plain).encode(text or "", add_special_tokens=False).ids


@settings(deadline=None, max_examples=60)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=60), st.data())
def test_pack_round_trip(bits, values, data):
    ids = np.array([v % (1 << bits) for v in values], "<u4")
    payload, at = packed_ids.pack(ids, bits, 8)
    assert len(payload) == at[-1] and len(payload) * 8 < len(ids) * bits + 8 * len(at)
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert list(packed_ids.unpack(payload, at, bits, a, b, 8)) == list(ids[a:b])


def test_width():
    assert [packed_ids.width(n) for n in (1, 2, 3, 256, 257, 50257, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


def test_packed_file_in_order(spark, documents, odd):
    path = packed_ids.write_packed(documents(odd))
    rows = packed_ids.read_documents(spark, path, with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted((i for i, _ in odd), key=lambda i: (i is not None, i))
    texts = sorted((i if i is not None else -(10**9), t or "") for i, t in odd)
    at = 0
    for row, (_, text) in zip(rows, texts):
        ids = [*library(text), 0]
        assert (row.start, row.n_tokens, row.ids_crc32) == (at, len(ids), crc(ids))
        assert list(np.frombuffer(row.ids, "<u4")) == ids
        at += len(ids)


def test_packed_query_over_whole_table(spark, data):
    rows = queries.QUERIES["op2_packed_ids"](spark, data).orderBy("doc_id").collect()
    docs = spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect()
    at = 0
    for row, doc in zip(rows, docs, strict=True):
        ids = [*library(doc.text), 0]
        assert tuple(row) == (doc.doc_id, at, len(ids), crc(ids))
        at += len(ids)


def test_empty_tables(spark, documents):
    empty = documents([])
    assert packed_ids.read_documents(spark, packed_ids.write_packed(empty)).count() == 0
    path = token_counts.write_flat(empty)
    assert token_counts.count_documents(spark, path, token_counts.END_OF_TEXT).count() == 0
    assert packing.pack_documents(empty).count() == 0


@pytest.mark.parametrize("block", [5, 1 << 20])
def test_flat_file_counts(spark, documents, odd, block, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK_IDS", block)
    monkeypatch.setattr(token_counts, "LISTED", 2)
    path = token_counts.write_flat(documents(odd))
    counted = token_counts.count_documents(spark, path, token_counts.END_OF_TEXT)
    rows = counted.join(token_counts.listed_documents(spark, path), ["file", "ordinal"]).collect()
    found = sorted((str(r.doc_id), r.n_tokens) for r in rows)
    assert found == sorted((str(i), len(library(t, plain=True)) + 1) for i, t in odd)
    ends = {}
    for r in sorted(rows, key=lambda r: (r.file, r.ordinal)):
        assert r.start == ends.get(r.file, 0)
        ends[r.file] = r.start + r.n_tokens
    assert token_counts.open_tails(spark, path, token_counts.END_OF_TEXT).count() == 0


def test_separator_query_over_whole_table(spark, data):
    """Every document of the table once, with the length that the library gives it and no gap in its file."""
    rows = queries.QUERIES["op7_separator_scan"](spark, data).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(library(t, plain=True)) + 1 for i, t in texts.items()}
    assert len(rows) == len(texts)
    ends = {}
    for r in sorted(rows, key=lambda r: (r.file, r.ordinal)):
        assert r.start == ends.get(r.file, 0)
        ends[r.file] = r.start + r.n_tokens


def test_open_tail_and_empty_blocks(spark):
    blocks = [(0, 0, [1, 9]), (0, 1, [3]), (0, 2, [9, 9]), (0, 3, [4, 4]), (1, 0, [5])]
    rows = [("ids", f, b, 4, bytearray(np.array(x, "<u4").tobytes()), None) for f, b, x in blocks]
    schema = "kind string, file int, at long, id_bytes int, payload binary, doc_ids array<long>"
    path = token_counts.new_path(spark, "t")
    spark.createDataFrame(rows, schema).write.partitionBy("kind").parquet(path)
    counted = token_counts.count_documents(spark, path, 9).orderBy("file", "ordinal").collect()
    assert [tuple(r) for r in counted] == [(0, 0, 0, 2), (0, 1, 2, 2), (0, 2, 4, 1)]
    assert sorted(map(tuple, token_counts.open_tails(spark, path, 9).collect())) == [(0, 2), (1, 1)]


def check_packing(rows, texts, capacity, end=0):
    """Every piece has its place, sequences have no gap and no document is cut but long ones."""
    sequences, per_doc = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        per_doc.setdefault(r.doc_id, []).append(r)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    expected = {}
    for doc, text in texts:
        expected.setdefault(doc, []).append([*library(text), end])
    for doc, all_ids in expected.items():
        pieces = []
        for ids in all_ids:
            first = len(ids) % capacity or capacity
            cuts = [0, *range(first, len(ids), capacity), len(ids)]
            pieces += [(i, a, b - a, crc(ids[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in per_doc[doc]) == sorted(pieces)
    return len(sequences)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing_of_odd_documents(documents, odd, capacity):
    rows = packing.pack_documents(documents(odd), capacity).collect()
    check_packing(rows, odd, capacity)


def test_packing_query_over_whole_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    rows = queries.QUERIES["op8_configuration_packing"](spark, data).collect()
    n = check_packing(rows, [(d.doc_id, d.text) for d in docs], 2048)
    assert n <= -(-sum(r.length for r in rows) // 2048) * 1.01 + 1


@pytest.mark.parametrize("scale", [1, 7, 10_000])
def test_program_comes_close_to_the_lower_bound(scale):
    """Lengths skewed to short ones; most sequences come from the program itself, and the work hangs on lengths alone."""
    drawn = np.random.default_rng(4).lognormal(5.5, 0.9, 1500).astype(int).clip(1, 2047)
    counts = {int(length): int(n) * scale for length, n in zip(*np.unique(drawn, return_counts=True))}
    bound = -(-sum(length * n for length, n in counts.items()) // 2048)
    plan = packing.plan_sequences(counts)
    assert sum(n for _, n in plan) <= bound * 1.01 + 1
    left = dict(counts)
    for content, amount in sorted(packing.solve_configurations(counts, 2048), key=lambda x: -x[1]):
        n = min([int(amount + 1e-9), *(left[length] // k for length, k in content.items())])
        if sum(length * k for length, k in content.items()) == 2048:
            left = {length: have - n * content.get(length, 0) for length, have in left.items()}
    assert sum(left.values()) < sum(counts.values())
    assert len(packing.round_up(left, 2048)) <= 4 * len(counts)


def test_filling_against_all_subsets():
    lengths, limit, price = np.array([2, 3, 5, 7]), np.array([3, 1, 2, 1]), np.array([2.1, 3.0, 5.4, 0.0])
    for capacity in range(1, 25):
        found = packing.best_filling(price, lengths, limit, capacity)
        best = max(
            sum(n * p for n, p in zip(use, price))
            for use in itertools.product(*(range(n + 1) for n in limit))
            if sum(n * length for n, length in zip(use, lengths)) <= capacity
        )
        assert sum(lengths[k] * n for k, n in found.items()) <= capacity and all(n <= limit[k] for k, n in found.items())
        assert sum(price[k] * n for k, n in found.items()) == pytest.approx(best)


def test_materialised_sequences(documents, odd):
    pieces = packing.assign_sequences(packing.cut_pieces(documents(odd), 64), 64).cache()
    joined = {r.sequence_id: np.frombuffer(r.ids, "<u4") for r in packing.materialise(pieces).collect()}
    for r in pieces.collect():
        assert joined[r.sequence_id][r.offset : r.offset + r.length].tobytes() == bytes(r.ids)


@settings(deadline=None, max_examples=40)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 50), max_size=12))
def test_plans_place_every_piece_once(counts):
    plan = packing.plan_sequences(counts, 20, 50)
    placed = {}
    for content, n in plan:
        assert n > 0 and 0 < sum(length * k for length, k in content.items()) <= 20
        for length, k in content.items():
            placed[length] = placed.get(length, 0) + n * k
    assert placed == counts
    places = packing.Places(plan)
    seen = set()
    for length, n in counts.items():
        sequence, at = places.find(np.full(n, length), np.arange(n))
        for s, a in zip(sequence, at):
            cells = {(s, int(a) + i) for i in range(length)}
            assert not cells & seen
            seen |= cells
