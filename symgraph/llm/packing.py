"""Packing token ids into windows by best fit decreasing.

A document's ids, closed by an end id, are cut into full windows and one
remainder. Full windows stand alone. Remainders, longest first, enter the open
window with the least room that still holds them; a segment tree over the
possible amounts of room finds it. Remainders are dealt to tasks by a hash of
document and position, and every task packs its share: with tens of thousands
of remainders in a task, the last few open windows are all the padding there is.
Equal rows differ in their place in the stored pieces, so they are dealt too.

Cases: a null or empty text is the end id alone. Rows that repeat an id are
separate documents. An empty table gives no pieces. Very long texts are cut
into many full windows, dealt to all tasks. Pieces of equal length are placed in
the order of their documents, and of windows with equal room the last one
opened is filled first. Other columns play no part.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, map_texts
from .tokens import Encoder

WINDOW = 1_024
END_ID = 0
#: Pieces that one task packs, about.
PART_PIECES = 60_000
#: Sequence ids of a task start at its number times this.
TASK_IDS = 1 << 36

PIECES = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("crc", pa.int64()), ("ids", pa.list_(pa.int32()))]))
COLUMNS = {"doc_tokens": ("long", pa.int64()), "pieces": ("array<struct<start:long,length:long,crc:long,ids:array<int>>>", PIECES)}


class RoomTree:
    """A segment tree over room 0..size: how many open windows have each amount of room."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(self.leaves)]

    def _bump(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.count[node] += by
            node >>= 1

    def open(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        self._bump(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove the window with the least room of at least ``need``: (room, window)."""
        node = self.leaves + need
        if not self.count[node]:
            # Climb to the first subtree on the right that holds a window, then go down its left edge.
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        window = self.windows[room].pop()
        self._bump(room, -1)
        return room, window


def pack(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int], int]:
    """Window and offset of each piece, and the number of windows. ``lengths`` must fall."""
    tree, windows, offsets, opened = RoomTree(window), [], [], 0
    for length in lengths:
        found = tree.take(length)
        if found is None:
            found = (window, opened)
            opened += 1
        room, at = found
        windows.append(at)
        offsets.append(window - room)
        if room > length:
            tree.open(room - length, at)
    return windows, offsets, opened


def cut_pieces(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, doc_tokens, start, length, ids_crc32, ids): every text's ids in pieces of at most a window."""

    def pieces(texts: list[str | None]) -> tuple[list[int], list[list[dict]]]:
        encoded = Encoder.of(vocabulary).encode(texts, end_id)
        cuts = [[(at, ids[at : at + window]) for at in range(0, len(ids), window)] for ids in encoded]
        rows = [
            [{"start": at, "length": len(p), "crc": zlib.crc32(p.astype("<u4").tobytes()), "ids": p if with_ids else None} for at, p in each] for each in cuts
        ]
        return list(map(len, encoded)), rows

    made = map_texts(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ["doc_id"], COLUMNS, pieces)
    flat = made.select("doc_id", "doc_tokens", F.explode("pieces").alias("p"))
    return flat.select("doc_id", "doc_tokens", "p.start", "p.length", F.col("p.crc").alias("ids_crc32"), *(["p.ids"] if with_ids else []))


def pack_documents(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece with its sequence_id and its offset there."""
    # Places are stored with the pieces, so computing a task again cannot move a piece.
    made = cut_pieces(docs, vocabulary, window, end_id, with_ids, doc_id, text)
    pieces = cut(made.withColumn("at", F.monotonically_increasing_id()), "pieces")
    tasks = max(1, -(-pieces.count() // PART_PIECES))
    dealt = pieces.withColumn("task", F.pmod(F.xxhash64("doc_id", "start", "length", "ids_crc32", "at"), F.lit(tasks)).cast("int")).drop("at")
    schema = T.StructType([*dealt.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(table: pa.Table) -> pa.Table:
        keys = pd.DataFrame({k: table.column(k).to_numpy(zero_copy_only=False) for k in ("length", "start", "ids_crc32", "task")})
        keys["doc"] = table.column("doc_id").to_pandas().astype("string").fillna("")
        order = keys.sort_values(["length", "doc", "start", "ids_crc32"], ascending=[False, True, True, True]).index.to_numpy()
        windows, offsets, _ = pack(keys["length"].to_numpy()[order].tolist(), window)
        table = table.take(pa.array(order))
        first = int(keys["task"].iloc[0]) * TASK_IDS
        return table.append_column("sequence_id", pa.array(np.array(windows, dtype=np.int64) + first)).append_column("offset", pa.array(offsets, pa.int64()))

    return dealt.groupBy("task").applyInArrow(place, schema).drop("task")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the windows themselves, from :func:`pack_documents` with ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
