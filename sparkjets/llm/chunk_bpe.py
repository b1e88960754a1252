"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the last bytes cuts a text where its content says so, so a
passage that many documents share is cut at the same places in all of them. Each
distinct chunk is encoded once by a worker and kept (under a cryptographic digest,
in bounded memory); documents are put together from kept chunks. The ids at a
chunk's ends depend on its neighbours, so every join is repaired: the text between
the last place in the left chunk and the first place in the right chunk from which
the encoding no longer depends on what lies beyond is encoded anew, reaching across
further chunks until there is such a place. From there on kept and new ids agree
exactly, so the result is that of encoding the whole text at once.

Such a place is any white space after another character (see ``tokens``).

Null and empty texts have no ids and decode to the empty text. Every row is answered by
itself: rows that repeat an id or a text give a row each, a null id stays null.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkjets.llm.common import once
from sparkjets.llm.tokens import WHITE, byte_stand_ins, encoder

#: Bytes that the rolling hash looks at; chunk lengths in bytes.
REACH = 32
MEAN, SHORTEST, LONGEST = 512, 128, 8192
#: Bytes of kept ids per generation; two generations are held.
MEMORY = 48 << 20

#: Places where the encoding starts afresh.
FRESH = re.compile(f"(?<=[^{WHITE}])[ \t\n\r]")
_GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of a UTF-8 text: content-defined, never inside a character."""
    n = len(data)
    if n <= SHORTEST:
        return [n] if n else []
    raw = np.frombuffer(data, np.uint8)
    rolled = _GEAR[raw]
    reach, factor = 1, 0x9E3779B1
    while reach < REACH:  # the hash of twice as many bytes from two hashes
        longer = rolled.copy()
        longer[reach:] += rolled[:-reach] * np.uint32(factor) if reach < n else np.uint32(0)
        rolled, reach, factor = longer, reach * 2, factor * factor & 0xFFFFFFFF
    places = np.flatnonzero(rolled[:-1] >> np.uint32(33 - MEAN.bit_length()) == 0) + 1
    starts_character = (raw & 0xC0) != 0x80
    out, start = [], 0
    for place in [*places[starts_character[places]].tolist(), n]:
        while place - start > LONGEST:
            start += LONGEST
            while not starts_character[start]:
                start -= 1
            out.append(start)
        if place - start >= SHORTEST or place == n:
            out.append(place)
            start = place
    return out


class Codec:
    """Encoder and decoder of one worker, with its kept chunks."""

    def __init__(self, vocabulary: str | None = None, memory: int = MEMORY):
        self.encoder = encoder(vocabulary)
        self.memory, self.held = memory, 0
        self.young: dict[bytes, tuple | None] = {}
        self.old: dict[bytes, tuple | None] = {}
        self.hits = self.misses = 0
        byte_of = {c: b for b, c in byte_stand_ins().items()}
        special = set(self.encoder.special)
        self.bytes_of = [b""] * self.encoder.size
        self.digits_of = [str(i).encode() for i in range(self.encoder.size)]
        for token, i in self.encoder.tokenizer.get_vocab(with_added_tokens=True).items():
            self.bytes_of[i] = token.encode() if token in special else bytes(byte_of[c] for c in token)

    def _chunk(self, data: bytes) -> tuple[int, int, np.ndarray] | None:
        """First and last fresh place of a chunk (in characters) and the ids between them; None if it has none."""
        key = hashlib.blake2b(data, digest_size=16).digest()
        if key in self.young:
            self.hits += 1
            return self.young[key]
        if key in self.old:
            self.hits += 1
            found = self.old[key]
        else:
            self.misses += 1
            text = data.decode("utf-8", "surrogatepass")
            places = [m.start() for m in FRESH.finditer(text)]
            found = None
            if places:
                found = (places[0], places[-1], self.encoder.encode(text[places[0] : places[-1]]))
        self.held += 200 + (found[2].nbytes if found else 0)
        if self.held > self.memory:
            self.old, self.young, self.held = self.young, {}, 0
        self.young[key] = found
        return found

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, "<u4")
        data = text.encode("utf-8", "surrogatepass")
        parts, join, start = [], "", 0
        for stop in cuts(data):
            piece = data[start:stop]
            start = stop
            found = self._chunk(piece)
            chunk = piece.decode("utf-8", "surrogatepass")
            if found is None:  # nowhere to agree yet: the join goes on
                join += chunk
                continue
            first, last, ids = found
            parts += [self.encoder.encode(join + chunk[:first]), ids]
            join = chunk[last:]
        parts.append(self.encoder.encode(join))
        return np.concatenate(parts)

    def decode(self, ids) -> str:
        """Text of the ids; bytes that are no UTF-8 become U+FFFD as in the library."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def codec(vocabulary: str | None = None) -> Codec:
    """This worker's codec: chunks stay known from task to task."""
    return once(("codec", vocabulary), lambda: Codec(vocabulary))


def encode_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id`` and ``ids`` (little-endian unsigned 32-bit) of every row, in place: no shuffle."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            ids = [own.encode(text.as_py()).tobytes() for text in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id`` and ``text`` from ``ids``."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            texts = [own.decode(np.frombuffer(ids.as_buffer(), "<u4").tolist()) for ids in batch["ids"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Encode and decode every text in one pass; only lengths and digests leave the task."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            lengths, of_ids, of_text = [], [], []
            for text in batch["text"]:
                ids = own.encode(text.as_py()).tolist()
                lengths.append(len(ids))
                of_ids.append(hashlib.sha256(b",".join(map(own.digits_of.__getitem__, ids))).hexdigest())
                of_text.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            arrays = [batch["doc_id"], pa.array(lengths, pa.int64()), pa.array(of_ids), pa.array(of_text)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(both, schema)
