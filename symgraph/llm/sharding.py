"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Rows with equal texts form a group that stays together. Groups sorted by size
enter the bin with the least remaining capacity that still holds them, found
in a balanced tree of remaining capacities. To run on many executors, small
groups are first packed, in parallel and by the same rule, into bundles of a
fixed share of a shard; the bundles and the few large groups are then packed
into the shards. How many of those there are depends on the number of shards,
not on the data, but for one bundle or so per ``PART_GROUPS`` groups.

Cases: a null text has size 1 and belongs with the empty text. Rows that
repeat an id are separate rows, and no number of equal rows stands in one
task's way. An empty table gives no rows. A group larger
than a shard's even share fills a shard of its own. Other columns play no part.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name

#: Bundles are this share of a shard.
BUNDLES_PER_SHARD = 512
#: Small groups that one task packs at most, about.
PART_GROUPS = 200_000


class CapacityTree:
    """A treap of (remaining capacity, bin) pairs."""

    def __init__(self):
        self.root: list | None = None  # [key, priority, left, right]
        self.random = random.Random(7)

    def _split(self, node, key):
        """Nodes below ``key`` and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], right = self._split(node[3], key)
            return node, right
        left, node[2] = self._split(node[2], key)
        return left, node

    def _join(self, left, right):
        if left is None or right is None:
            return left or right
        if left[1] > right[1]:
            left[3] = self._join(left[3], right)
            return left
        right[2] = self._join(left, right[2])
        return right

    def add(self, remaining: int, place: int) -> None:
        left, right = self._split(self.root, (remaining, place))
        self.root = self._join(self._join(left, [(remaining, place), self.random.random(), None, None]), right)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the least pair with remaining >= size."""
        left, right = self._split(self.root, (size, -1))
        if right is None:
            self.root = left
            return None
        key = self._least(right)
        middle, rest = self._split(right, (key[0], key[1] + 1))
        self.root = self._join(left, rest)
        return middle[0]

    def take_emptiest(self) -> tuple[int, int]:
        node = self.root
        while node[3] is not None:
            node = node[3]
        key = node[0]
        self.root, _ = self._split(self.root, key)
        return key

    @staticmethod
    def _least(node) -> tuple[int, int]:
        while node[2] is not None:
            node = node[2]
        return node[0]


def best_fit_decreasing(sizes: Iterable[int], capacity: int, bins: int | None = None) -> tuple[list[int], int]:
    """The bin of each item, and the number of bins.

    ``sizes`` must fall. Without ``bins``, a bin is opened whenever none fits,
    and an item over the capacity gets one for itself. With ``bins`` there are
    that many, and an item that fits nowhere enters the emptiest.
    """
    tree, opened, places = CapacityTree(), bins or 0, []
    for place in range(opened):
        tree.add(capacity, place)
    for size in sizes:
        found = tree.take_tightest(size)
        if found is None:
            found = (capacity, opened) if bins is None else tree.take_emptiest()
            opened += bins is None
        places.append(found[1])
        if bins is not None or found[0] > size:
            tree.add(found[0] - size, found[1])
    return places, opened


def shard_sizes(bundles: list[tuple[int, tuple]], shards: int) -> dict[tuple, int]:
    """The shard of each bundle given as (size, key); those over an even share get a shard each."""
    bundles = sorted(bundles, key=lambda b: (-b[0], b[1]))
    total, alone = sum(size for size, _ in bundles), 0
    while alone < min(len(bundles), shards - 1) and bundles[alone][0] * (shards - alone) > total:
        total -= bundles[alone][0]
        alone += 1
    placed = {key: k for k, (_, key) in enumerate(bundles[:alone])}
    rest = shards - alone
    places, _ = best_fit_decreasing([size for size, _ in bundles[alone:]], -(-total // rest), rest)
    return placed | {key: alone + place for (_, key), place in zip(bundles[alone:], places, strict=True)}


def assign_shards(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row.

    The law is ``bytes``: sizes of shards are near equal. Slots number the
    rows of a shard from 0 without gaps.
    """
    placed = placed_rows(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("at")), shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def placed_rows(docs: DataFrame, shards: int) -> DataFrame:
    """(doc_id, at, size, text_crc32, shard, slot) for rows (doc_id, text, at), where ``at`` tells rows apart that are equal otherwise."""
    spark = docs.sparkSession
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = cut(
        docs.select(
            "doc_id", "at", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
            F.xxhash64(body).alias("g1"), F.xxhash64(F.lit(7), body).alias("g2"),
        ),
        "shard-rows",
    )
    groups = cut(rows.groupBy("g1", "g2").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "shard-groups")
    total, n_rows, n_groups = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    pieces = shards * BUNDLES_PER_SHARD
    unit, crowd = max(1, -(-total // pieces)), max(1, -(-n_rows // pieces))
    # Fewer than ``pieces`` groups can reach a ``pieces``-th of all bytes, and as many of all rows.
    is_large = (F.col("bytes") >= unit) | ((F.col("n") >= crowd) & (F.col("n") > 1))
    parts = max(1, -(-n_groups // PART_GROUPS))

    def bundle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "g1", "g2"], ascending=[False, True, True])
        places, _ = best_fit_decreasing(pdf["bytes"].tolist(), unit)
        return pdf[["g1", "g2", "bytes", "part"]].assign(bundle=places)

    part = F.pmod(F.col("g1"), F.lit(parts)).cast("int").alias("part")
    small = groups.where(~is_large).select("g1", "g2", "bytes", part).groupBy("part")
    small = cut(small.applyInPandas(bundle, "g1 long, g2 long, bytes long, part int, bundle int"), "shard-bundles")
    bundles = [(r["bytes"], (0, r["part"], r["bundle"])) for r in small.groupBy("part", "bundle").agg(F.sum("bytes").alias("bytes")).collect()]
    large = groups.where(is_large).select("g1", "g2", "bytes").collect()
    shard_of = shard_sizes(bundles + [(r["bytes"], (1, r["g1"], r["g2"])) for r in large], shards)
    # Both tables are bounded by the number of bundles and large groups.
    by_bundle = spark.createDataFrame([(k[1], k[2], s) for k, s in shard_of.items() if not k[0]], "part int, bundle int, shard int")
    by_group = spark.createDataFrame([(k[1], k[2], s) for k, s in shard_of.items() if k[0]], "g1 long, g2 long, large_shard int")
    marked = rows.join(F.broadcast(by_group), ["g1", "g2"], "left")
    alone = marked.where("large_shard IS NOT NULL").select("doc_id", "at", "size", "text_crc32", F.col("large_shard").alias("shard"))
    packed = small.join(F.broadcast(by_bundle), ["part", "bundle"]).select("g1", "g2", "shard")
    rest = marked.where("large_shard IS NULL").join(packed, ["g1", "g2"]).select("doc_id", "at", "size", "text_crc32", "shard")
    return with_slots(cut(alone.unionByName(rest), "shard-assigned"))


def with_slots(assigned: DataFrame) -> DataFrame:
    """Number the rows of each shard without sorting a whole shard in one task."""
    spark = assigned.sparkSession
    order = ["shard", "doc_id", "text_crc32", "at"]
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    laid = assigned.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    # The upper bits of this number are the task, the lower 33 count its rows.
    laid = cut(laid.withColumn("row", F.monotonically_increasing_id()).withColumn("task", F.shiftright("row", 33)), "shard-laid")
    counts = laid.groupBy("task", "shard").agg(F.min("row").alias("first"), F.count("*").alias("n")).collect()
    # Tasks hold ranges of (shard, id), so there are fewer counts than tasks and shards together.
    offsets, filled = [], {}
    for r in sorted(counts, key=lambda r: (r["shard"], r["task"])):
        offsets.append((r["task"], r["shard"], filled.get(r["shard"], 0) - r["first"]))
        filled[r["shard"]] = filled.get(r["shard"], 0) + r["n"]
    shift = F.broadcast(spark.createDataFrame(offsets, "task long, shard int, shift long"))
    return laid.join(shift, ["task", "shard"]).select("doc_id", "at", "size", "text_crc32", "shard", (F.col("row") + F.col("shift")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write ``docs`` with their shard and slot, one folder for each shard.

    The added columns are called ``shard`` and ``slot``, with underscores added
    where the input has a column of that name.
    """
    at, shard, slot = (free_name(docs, c) for c in ("at", "shard", "slot"))
    # Written out, so that the numbers stay those of the rows whatever is computed again.
    rows = cut(docs.withColumn(at, F.monotonically_increasing_id()), "shard-docs")
    placed = placed_rows(rows.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(at).alias("at")), shards)
    placed = placed.select(F.col("at").alias(at), F.col("shard").alias(shard), F.col("slot").alias(slot))
    rows.join(placed, at).drop(at).write.partitionBy(shard).parquet(path)


def brute_force(sizes: list[int], capacity: int) -> list[int]:
    """Best fit decreasing by a plain scan, for tests."""
    remaining: list[int] = []
    places = []
    for size in sizes:
        fits = [(r, k) for k, r in enumerate(remaining) if r >= size]
        if fits:
            k = min(fits)[1]
        else:
            remaining.append(capacity)
            k = len(remaining) - 1
        remaining[k] -= size
        places.append(k)
    return places


def fills(places: Iterator[int], sizes: Iterator[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for p, s in zip(places, sizes, strict=True):
        out[p] = out.get(p, 0) + s
    return out
