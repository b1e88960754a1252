"""Token counts of flat token files that have no index.

A flat file is nothing but ids, one after the other, each document closed by an
end id; it is kept as blocks of a fixed number of ids, wherever documents end.
Counting searches every block for end ids at once with numpy. Documents that
cross blocks are stitched by a prefix scan over one small row per block: a running
sum gives each block its place in its file, a running maximum the last end before
it. No block needs another block's ids, and no document must fit a task.

Null and empty texts count their end id only. Every row is a document of its own: rows that
repeat an id or a text are listed one by one, a null id stays null. A file whose last document lacks its end id
has an open rest, which is reported by ``open_tails`` and is no document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkjets.llm.common import new_path
from sparkjets.llm.tokens import encoder

#: Ids of a block: 2 MB in two bytes each.
BLOCK_IDS = 1 << 20
#: End-of-text id of the default vocabulary.
END_OF_TEXT = 50256
#: Documents listed per row beside the files.
LISTED = 4096


def write_flat(docs: DataFrame, end_id: int = END_OF_TEXT, path: str | None = None, vocabulary: str | None = None) -> str:
    """Write every task's documents as one flat file; returns the folder.

    ``kind=ids`` holds the blocks (file, block, payload of two- or four-byte ids)
    and no place of any document; ``kind=order`` lists which documents a file holds,
    in order. ``end_id`` is the vocabulary's end-of-text id; its string inside a text
    is ordinary text, so no text can hold the id itself.
    """
    path = path or new_path(docs.sparkSession, "flat-ids")

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(vocabulary, True)
        form = "<u2" if max(encode.size, end_id + 1) <= 1 << 16 else "<u4"
        file, number, waiting, held, listed, first = TaskContext.get().partitionId(), 0, [], 0, [], 0
        tail = np.array([end_id], "<u4")

        def row(kind, at, payload, ids):
            values = (kind, file, at, np.dtype(form).itemsize, payload, ids)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, out)], schema=out)

        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                waiting += [encode.encode(text.as_py()), tail]
                held += len(waiting[-2]) + 1
                listed.append(doc)
                if len(listed) == LISTED:
                    yield row("order", first, None, listed)
                    listed, first = [], first + LISTED
                if held >= BLOCK_IDS:
                    ids = np.concatenate(waiting)
                    for i in range(0, held - BLOCK_IDS + 1, BLOCK_IDS):
                        yield row("ids", number, ids[i : i + BLOCK_IDS].astype(form).tobytes(), None)
                        number += 1
                    waiting = [ids[held - held % BLOCK_IDS :]]
                    held = len(waiting[0])
        if listed:
            yield row("order", first, None, listed)
        if held:
            yield row("ids", number, np.concatenate(waiting).astype(form).tobytes(), None)

    out = pa.schema(
        [("kind", pa.string()), ("file", pa.int32()), ("at", pa.int64()), ("id_bytes", pa.int32())]
        + [("payload", pa.binary()), ("doc_ids", pa.list_(pa.int64()))]
    )
    schema = "kind string, file int, at long, id_bytes int, payload binary, doc_ids array<long>"
    rows = docs.select("doc_id", "text").mapInArrow(flat, schema)
    rows.write.partitionBy("kind").option("compression", "zstd").parquet(path)
    return path


def _files(spark: SparkSession, path: str, kind: str) -> DataFrame:
    schema = "kind string, file int, at long, id_bytes int, payload binary, doc_ids array<long>"
    return spark.read.schema(schema).parquet(path).where(F.col("kind") == kind)


def scan_blocks(blocks: DataFrame, end_id: int) -> DataFrame:
    """Per block its number of ids, the places of its end ids, and where the scan has come to before it.

    ``blocks``: file, at (block number), id_bytes, payload.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, places = [], []
            for size, payload in zip(batch["id_bytes"].to_pylist(), batch["payload"]):
                ids = np.frombuffer(payload.as_buffer(), f"<u{size}")
                sizes.append(len(ids))
                places.append(np.flatnonzero(ids == end_id).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch["file"], batch["at"], pa.array(sizes, pa.int64()), pa.array(places, pa.list_(pa.int64()))],
                ["file", "at", "n_ids", "ends"],
            )

    found = blocks.select("file", "at", "id_bytes", "payload").mapInArrow(
        search, "file int, at long, n_ids long, ends array<long>"
    )
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = found.withColumn("block_start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    last = F.col("block_start") + F.element_at("ends", -1)
    return placed.withColumns({
        "docs_before": F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).cast("long"),
        "end_before": F.coalesce(F.max(F.when(F.size("ends") > 0, last)).over(before), F.lit(-1)).cast("long"),
    })


def count_documents(spark: SparkSession, path: str, end_id: int) -> DataFrame:
    """``file, ordinal, start, n_tokens`` (with the end id) of every document, found from the ids alone."""
    scanned = scan_blocks(_files(spark, path, "ids"), end_id)
    each = scanned.select(
        "file", "docs_before", "end_before", "block_start", "ends", F.posexplode("ends").alias("i", "end")
    )
    previous = F.when(F.col("i") == 0, F.col("end_before")).otherwise(
        F.col("block_start") + F.try_element_at("ends", F.greatest("i", F.lit(1)))
    )
    return each.select(
        "file",
        (F.col("docs_before") + F.col("i")).alias("ordinal"),
        (previous + 1).alias("start"),
        (F.col("block_start") + F.col("end") - previous).alias("n_tokens"),
    )


def open_tails(spark: SparkSession, path: str, end_id: int) -> DataFrame:
    """Files whose last ids no end id closes, with the number of those ids."""
    scanned = scan_blocks(_files(spark, path, "ids"), end_id)
    stop = F.max(F.col("block_start") + F.col("n_ids"))
    last = F.max(F.when(F.size("ends") > 0, F.col("block_start") + F.element_at("ends", -1)))
    rest = scanned.groupBy("file").agg((stop - F.coalesce(last, F.lit(-1)) - 1).alias("n_open"))
    return rest.where("n_open > 0")


def listed_documents(spark: SparkSession, path: str) -> DataFrame:
    """``file, ordinal, doc_id`` from the list beside the files."""
    order = _files(spark, path, "order")
    return order.select("file", "at", F.posexplode("doc_ids").alias("i", "doc_id")).select(
        "file", (F.col("at") + F.col("i")).alias("ordinal"), "doc_id"
    )
