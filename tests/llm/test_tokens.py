"""The fast encoder against the tokenizers library."""

import random

import pyarrow.parquet as pq

from sparkjets.llm import tokens


def same(encoder, text):
    return list(encoder.encode(text)) == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_every_common_character_in_context():
    encoder = tokens.Encoder()
    common = [chr(i) for i in range(0x2100) if tokens.COMMON.fullmatch(chr(i))]
    assert encoder.merge is not None and len(common) > 900
    for c in common:
        assert same(encoder, f"a{c}b {c} {c}{c}\n{c}1{c}!{c} "), repr(c)


def test_random_mixtures():
    encoder, plain = tokens.Encoder(), tokens.Encoder(plain=True)
    draw = random.Random(1)
    letters = " \t\n\r\x1c\x1f\x85\xa0 ​!'sdaé9　ñ漢\U0001f600.ab"
    for _ in range(5000):
        parts = [draw.choice(letters) if draw.random() < 0.9 else "<|endoftext|>" for _ in range(draw.randint(0, 12))]
        text = "".join(parts)
        assert same(encoder, text) and same(plain, text), repr(text)
    assert list(encoder.encode("<|endoftext|>")) == [50256]
    assert 50256 not in plain.encode("a<|endoftext|> b")
    assert len(encoder.encode(None)) == len(encoder.encode("")) == 0


def test_whole_table(data):
    encoder = tokens.Encoder()
    texts = pq.read_table(f"{data}/documents.parquet")["text"].to_pylist()
    assert all(same(encoder, text or "") for text in texts)
