"""Chunk reuse against the tokenizers library."""

import hashlib
import random

import pyarrow.parquet as pq
import pytest

from sparkjets.llm import chunk_bpe, queries


def expected(codec, text):
    ids = codec.encoder.tokenizer.encode(text or "", add_special_tokens=False).ids
    decoded = codec.encoder.tokenizer.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_cuts_depend_on_content_only():
    draw = random.Random(2)
    words = ["".join(draw.choice("abcdeé漢") for _ in range(draw.randint(1, 9))) for _ in range(3000)]
    passage = " ".join(words).encode()
    other = ("start " * 200).encode()
    own = {passage[a:b] for a, b in zip([0, *chunk_bpe.cuts(passage)], chunk_bpe.cuts(passage))}
    both = other + passage
    shared = {both[a:b] for a, b in zip([0, *chunk_bpe.cuts(both)], chunk_bpe.cuts(both))}
    assert len(own & shared) >= len(own) - 3
    for data in (passage, both, b"", b"x", "漢".encode() * 9000):
        ends = chunk_bpe.cuts(data)
        assert (ends[-1] if ends else 0) == len(data) and ends == sorted(set(ends))
        for a, b in zip([0, *ends], ends):
            assert b - a <= chunk_bpe.LONGEST
            data[a:b].decode()


@pytest.mark.parametrize("memory", [2000, chunk_bpe.MEMORY])
def test_random_texts(memory):
    codec = chunk_bpe.Codec(memory=memory)
    draw = random.Random(4)
    parts = [" ", "  ", "\n", "\n\n", "\t", "a", "word", "Wörter", "!!", "'s", "12", "漢字", "<|endoftext|>", "\xa0", "x" * 700]
    shared = " ".join(draw.choice(parts) for _ in range(900))
    for _ in range(60):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 900))) + draw.choice(["", shared])
        ids = codec.encode(text).tolist()
        assert ids == codec.encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert codec.decode(ids) == codec.encoder.tokenizer.decode(ids, skip_special_tokens=False) == text
    assert codec.hits > 0 or memory < chunk_bpe.MEMORY


def test_broken_bytes_decode_as_the_library_does():
    codec = chunk_bpe.Codec()
    draw = random.Random(4)
    for _ in range(200):
        ids = [draw.randrange(codec.encoder.size) for _ in range(6)]
        assert codec.decode(ids) == codec.encoder.tokenizer.decode(ids, skip_special_tokens=False)


def test_odd_documents(documents, odd):
    codec = chunk_bpe.Codec()
    rows = chunk_bpe.digests(documents(odd)).collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(str((i, *expected(codec, t))) for i, t in odd)
    assert chunk_bpe.digests(documents([])).count() == 0


def test_round_trip_of_tables(documents, odd):
    encoded = chunk_bpe.encode_documents(documents(odd))
    texts = chunk_bpe.decode_documents(encoded).collect()
    assert sorted((str(r.doc_id), r.text) for r in texts) == sorted((str(i), t or "") for i, t in odd)


def test_query_over_whole_table(spark, data):
    codec = chunk_bpe.Codec()
    docs = pq.read_table(f"{data}/documents.parquet").to_pylist()
    rows = {r.doc_id: tuple(r) for r in queries.QUERIES["op3_chunk_reuse_bpe"](spark, data).collect()}
    assert rows == {d["doc_id"]: (d["doc_id"], *expected(codec, d["text"])) for d in docs}
