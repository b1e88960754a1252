"""Token files with fixed-width bit packing.

Every id takes the fewest bits that hold the vocabulary. A file is a Parquet
table of segments; a segment is a run of whole documents: their ids as one packed
payload, cut into blocks of ``BLOCK`` ids that begin at a byte boundary and whose
byte offsets are stored, so any block, document or range of ids is unpacked with
numpy without touching the rest. Segments are written in ascending document
order; Spark's commit makes a file appear whole or not at all.

Rows with a null id come first, rows of one id in the order of a hash of their
text. A null or empty text is a document that holds the end id only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkjets.llm.common import new_path, offsets, text_key
from sparkjets.llm.tokens import encoder

BLOCK = 4096
#: A segment is closed after the document that brings it to so many ids.
SEGMENT = 1 << 20

SEGMENTS = (
    "part int, segment int, start_in_part long, n_ids long, bits int, block_ids int, "
    "doc_ids array<long>, doc_lengths array<long>, block_offsets array<long>, payload binary"
)


def width(vocabulary: int) -> int:
    """Bits that hold the ids below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
    """Packed ids and the byte offset of each block, with the end as the last offset."""
    ids = np.asarray(ids, "<u4")
    whole = -(-block * bits // 8)
    n_blocks = -(-len(ids) // block)
    last = len(ids) - (n_blocks - 1) * block if n_blocks else 0
    at = np.arange(n_blocks + 1, dtype=np.int64) * whole
    if n_blocks:
        at[-1] = at[-2] + -(-last * bits // 8)
    if bits in (8, 16, 32) and block * bits % 8 == 0:
        return ids.astype(f"<u{bits // 8}").tobytes(), at
    parts = []
    for i in range(n_blocks):
        chunk = ids[i * block : (i + 1) * block]
        flags = (chunk[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
        parts.append(np.packbits(flags.astype(np.uint8).ravel(), bitorder="little").tobytes())
    return b"".join(parts), at


def unpack(payload: bytes, at, bits: int, first: int, stop: int, block: int = BLOCK) -> np.ndarray:
    """Ids ``first`` to ``stop`` of a segment; only the blocks that hold them are read."""
    if stop <= first:
        return np.empty(0, "<u4")
    i, j = first // block, (stop - 1) // block + 1
    if bits in (8, 16, 32):
        got = np.frombuffer(payload, f"<u{bits // 8}", stop - i * block, int(at[i])).astype("<u4")
        return got[first - i * block :]
    parts = []
    for k in range(i, j):
        raw = np.frombuffer(payload, np.uint8, int(at[k + 1] - at[k]), int(at[k]))
        n = len(raw) * 8 // bits
        flags = np.unpackbits(raw, count=n * bits, bitorder="little").reshape(n, bits).astype(np.uint32)
        parts.append((flags << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32))
    return np.concatenate(parts)[first - i * block : stop - i * block].astype("<u4")


def write_packed(docs: DataFrame, end_id: int = 0, path: str | None = None, vocabulary: str | None = None) -> str:
    """Encode whole texts, append ``end_id`` to each and write them in ascending ``doc_id`` order; returns the folder.

    One range shuffle brings documents into order; every task then writes its
    range, holding one segment at a time.
    """
    path = path or new_path(docs.sparkSession, "packed-ids")
    key = text_key()
    rows = docs.select("doc_id", key.alias("k"), "text").repartitionByRange("doc_id", "k")
    rows = rows.sortWithinPartitions("doc_id", "k")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(vocabulary)
        bits, part = width(max(encode.size, end_id + 1)), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4")
        ids, docs_in, lengths, total, start, count = [], [], [], 0, 0, 0

        def close():
            payload, at = pack(np.concatenate(ids), bits)
            values = (part, count, start, total, bits, BLOCK, docs_in, lengths, at.tolist(), payload)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, out)], schema=out)

        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                got = np.append(encode.encode(text.as_py()), end)
                ids.append(got)
                docs_in.append(doc)
                lengths.append(len(got))
                total += len(got)
                if total >= SEGMENT:
                    yield close()
                    start, count = start + total, count + 1
                    ids, docs_in, lengths, total = [], [], [], 0
        if docs_in:
            yield close()

    out = pa.schema(
        [("part", pa.int32()), ("segment", pa.int32()), ("start_in_part", pa.int64()), ("n_ids", pa.int64())]
        + [("bits", pa.int32()), ("block_ids", pa.int32())]
        + [(name, pa.list_(pa.int64())) for name in ("doc_ids", "doc_lengths", "block_offsets")]
        + [("payload", pa.binary())]
    )
    rows.mapInArrow(segments, SEGMENTS).write.option("compression", "zstd").parquet(path)
    return path


def segments_in_order(spark: SparkSession, path: str) -> DataFrame:
    """Segments with ``start``, the number of ids in the file before them."""
    files = spark.read.schema(SEGMENTS).parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = offsets(parts, ["part"], "n", "before").select("part", "before")
    return files.join(before, "part").withColumn("start", F.col("before") + F.col("start_in_part")).drop("before")


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` and, if asked for, the ids.

    The checksum is over the ids as little-endian unsigned 32-bit integers.
    """

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch[name][i] for name in batch.schema.names}
                lengths = np.array(row["doc_lengths"].as_py(), np.int64)
                ends = np.cumsum(lengths)
                bits, at, block = row["bits"].as_py(), row["block_offsets"].values.to_numpy(), row["block_ids"].as_py()
                ids = unpack(row["payload"].as_buffer(), at, bits, 0, int(ends[-1]), block)
                raw = [ids[a:b].tobytes() for a, b in zip(ends - lengths, ends)]
                columns = [
                    row["doc_ids"].values,
                    pa.array(row["start"].as_py() + ends - lengths),
                    pa.array(lengths),
                    pa.array([zlib.crc32(r) for r in raw], pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(raw, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    needed = segments_in_order(spark, path).select(
        "start", "bits", "block_ids", "doc_ids", "doc_lengths", "block_offsets", "payload"
    )
    return needed.mapInArrow(documents, schema)
