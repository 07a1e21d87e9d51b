"""Token-id files in ascending document order, coded by :mod:`rangecoder`.

Documents are sorted by id over all tasks, encoded, and written as frames: a
frame holds the ids of consecutive documents in independently readable,
checksummed blocks (see ``rangecoder``), beside the ids and lengths of its
documents, which have a checksum too. A damaged frame raises ValueError. Frames are rows of Parquet files, so they live in any store that
Spark can write to. Shard and frame numbers give the order of the frames.

Cases: a null or empty text is the end id alone. Rows that repeat an id stay
separate, in the order of their texts' hashes. Null ids come first. Texts longer than
a frame make that frame larger. An empty table gives an empty file set. Other
columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices
from .rangecoder import pack_frame, unpack_frame
from .tokens import Encoder

END_ID = 2
#: A frame is closed when it holds this many ids.
FRAME_IDS = 1 << 22
#: Bytes of text that are encoded at a time, about; they stay in Arrow's form.
ENCODED_BYTES = 8 << 20
FRAME_SCHEMA = "shard int, frame int, doc_ids array<long>, lengths array<int>, n_ids long, list_crc long, body binary"
_FRAME = pa.schema([("shard", pa.int32()), ("frame", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("n_ids", pa.int64()), ("list_crc", pa.int64()), ("body", pa.binary())])
_DOC = pa.schema([("shard", pa.int32()), ("frame", pa.int32()), ("place", pa.int32()), ("doc_id", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int64()))])


def list_crc(names: list[int | None], lengths: list[int]) -> int:
    """A checksum of a frame's document ids and lengths."""
    return zlib.crc32(repr((names, lengths)).encode())


def checked_ids(row: dict) -> np.ndarray:
    """The ids of a frame; raises ValueError where they, or its lists of documents and lengths, are damaged."""
    if row["list_crc"] != list_crc(row["doc_ids"], row["lengths"]):
        raise ValueError("the checksum of a frame's documents is wrong")
    ids = unpack_frame(row["body"])
    if len(ids) != row["n_ids"] or len(ids) != sum(row["lengths"]):
        raise ValueError("a frame's ids and lengths disagree")
    return ids


def write_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", frame_ids: int = FRAME_IDS) -> None:
    """Encode every text and write the frames under ``path``."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, frame = TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        held: list[np.ndarray] = []
        n = 0

        def close() -> pa.RecordBatch:
            lengths = [len(x) for x in held]
            row = [[shard], [frame], [names], [lengths], [n], [list_crc(names, lengths)], [pack_frame(np.concatenate(held))]]
            return pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(row, _FRAME, strict=True)], schema=_FRAME)

        for batch in chain.from_iterable(slices(b, 1, ENCODED_BYTES) for b in batches):
            encoded = Encoder.of(vocabulary).encode(batch.column(1), end_id)
            for name, ids in zip(batch.column(0).to_pylist(), encoded, strict=True):
                names.append(name)
                held.append(ids)
                n += len(ids)
                if n >= frame_ids:
                    yield close()
                    names, held, n, frame = [], [], 0, frame + 1
        if held:
            yield close()

    # Rows that repeat an id are ranged by their text's hash, and equal rows by their place in the input, so that no id stands in one task's way.
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("h"), F.monotonically_increasing_id().alias("at"))
    ordered = given.repartitionByRange(tasks, "doc_id", "h", "at").sortWithinPartitions("doc_id", "h", "at")
    ordered.select("doc_id", "text").mapInArrow(frames, FRAME_SCHEMA).write.parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) for every document in the files."""
    rows = spark.read.schema(FRAME_SCHEMA).parquet(path)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, sizes = checked_ids(row), np.array(row["lengths"], dtype=np.int64)
                ends = np.cumsum(sizes)
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B") if len(ids) else b""
                crcs = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                each = np.split(ids.astype(np.int64), ends[:-1]) if with_ids else [None] * len(sizes)
                columns = [[row["shard"]] * len(sizes), [row["frame"]] * len(sizes), range(len(sizes)), row["doc_ids"], ends - sizes, sizes, crcs, each]
                yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(columns, _DOC, strict=True)], schema=_DOC)

    docs = rows.repartition("shard", "frame").mapInArrow(documents, "shard int, frame int, place int, doc_id long, before long, n_tokens long, ids_crc32 long, ids array<long>")
    # Starts come from the frames' id counts alone: a running sum in each shard, and one over the shards' totals.
    counts = rows.select("shard", "frame", "n_ids")
    totals = counts.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    before = F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # one row for each shard
    earlier = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.withColumn("earlier", F.coalesce(earlier, F.lit(0))).join(totals.select("shard", F.coalesce(before, F.lit(0)).alias("shards_before")), "shard")
    starts = starts.select("shard", "frame", (F.col("earlier") + F.col("shards_before")).alias("frame_start"))
    found = docs.join(starts, ["shard", "frame"])
    return found.select("doc_id", (F.col("frame_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
