"""Importance resampling towards a target by hashed n-gram features.

A feature is a run of one to ``orders`` consecutive words, joined by one space;
its bucket is the CRC-32 of its UTF-8 bytes modulo ``buckets``. Each bucket's
gain is the smoothed log ratio of its shares in the target and in the corpus, a
document's weight is the mean gain of its features, and documents are drawn by
the Gumbel top-k trick, so that a draw without replacement follows the weights.

Features are never put together as strings. Every word's CRC is computed once,
for all words of a batch side by side, and CRCs are then composed: with "|" for
concatenation, crc(a|b) = shift(crc(a), len b) xor crc(b), where shifting by n
bytes is a matrix over GF(2). The matrices for 1, 2, 4, ... bytes come from
repeated squaring and are kept as four tables of 256 values each, so a shift by
any length takes one step for each set bit of the length.

Counts reach the driver as one number for each bucket, and the draw as one
number for each distinct whole score; both are bounded by parameters, not by
rows. Ranks come from range partitions over the drawn rows alone.

Cases: a null or empty text has no features and weight 0. A corpus or target
without features gives gains by smoothing alone. Rows that repeat have equal
scores and get ranks of their own, in the order in which they are stored. Null
ids count as an empty id and come before others among equal scores. An empty
table gives no rows. Columns asked for pass through; a new column gets
underscores added where its name would clash with one of them.
"""

from __future__ import annotations

import functools
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import numbered
from .common import cut, free_name, slices

BUCKETS = 10_000
#: Counts and gains of so many buckets at most pass through the driver.
MOST_BUCKETS = 1 << 20
#: Longer words go through zlib one by one; the shorter ones are worked off a byte of all of them at a time.
LONG_WORD = 48
POLYNOMIAL = 0xEDB88320


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


BYTE_TABLE = _byte_table()
#: Bytes with A-Z lowered, and which of them make up words: digits, a-z and all that is beyond ASCII.
LOWERED = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
IS_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def _applied(tables: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    """A matrix, given as tables by byte, times each vector of 32 bits."""
    return tables[0][crcs & 255] ^ tables[1][(crcs >> 8) & 255] ^ tables[2][(crcs >> 16) & 255] ^ tables[3][crcs >> 24]


def _tables(columns: np.ndarray) -> np.ndarray:
    """Tables by byte of the matrix with these 32 columns."""
    out = np.zeros((4, 256), np.uint32)
    for bit in range(32):
        has = np.flatnonzero((np.arange(256) >> (bit % 8)) & 1)
        out[bit // 8, has] ^= columns[bit]
    return out


@functools.cache
def shift_tables(k: int) -> np.ndarray:
    """The matrix that appends 2^k zero bytes."""
    units = np.uint32(1) << np.arange(32, dtype=np.uint32)
    if k == 0:
        return _tables(BYTE_TABLE[units & 255] ^ (units >> 8))
    half = shift_tables(k - 1)
    return _tables(_applied(half, _applied(half, units)))


def shifted(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each CRC after its own number of zero bytes."""
    out = crcs.copy()
    for k in range(int(lengths.max(initial=0)).bit_length()):
        at = np.flatnonzero((lengths >> k) & 1)
        out[at] = _applied(shift_tables(k), out[at])
    return out


def find_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, row) of every word in lowered bytes that hold one text behind another."""
    inside = IS_WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    # A word ends where its text ends, whatever the next one begins with.
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] |= inside[edges]
    last[edges - 1] |= inside[edges - 1]
    starts = np.flatnonzero(first)
    lengths = np.flatnonzero(last) + 1 - starts
    return starts, lengths, np.searchsorted(offsets, starts, "right") - 1


def word_crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRC-32 of each word."""
    order = np.argsort(-lengths, kind="stable")
    n_long = int(np.count_nonzero(lengths > LONG_WORD))
    out = np.empty(len(starts), np.uint32)
    for w in order[:n_long].tolist():
        out[w] = zlib.crc32(data[starts[w] : starts[w] + lengths[w]])
    order = order[n_long:]
    at, left = starts[order], lengths[order]
    # Longest first: the words that still have a byte are the first so many.
    alive = len(order) - np.cumsum(np.bincount(left, minlength=LONG_WORD + 1))
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for k in range(int(left.max(initial=0))):
        n = int(alive[k])
        crc[:n] = BYTE_TABLE[(crc[:n] ^ data[at[:n] + k]) & 255] ^ (crc[:n] >> 8)
    out[order] = ~crc
    return out


def feature_crcs(data: np.ndarray, offsets: np.ndarray, orders: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each number of words from 1 to ``orders``: (row, crc) of every feature, by row."""
    data = LOWERED[data]
    starts, lengths, row = find_words(data, offsets)
    crcs = word_crcs(data, starts, lengths)
    yield row, crcs
    space = np.full(len(crcs), zlib.crc32(b" "), np.uint32)
    behind_space = shifted(space, lengths) ^ crcs
    found = crcs
    for words in range(2, orders + 1):
        found = shifted(found[:-1], lengths[words - 1 :] + 1) ^ behind_space[words - 1 :]
        whole = row[: len(found)] == row[words - 1 :]
        yield row[: len(found)][whole], found[whole]


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts and the places where each one begins, with the end; nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def bucket_counts(texts: DataFrame, orders: int = 1, buckets: int = BUCKETS, text: str = "text") -> DataFrame:
    """(bucket, n) over all texts; a task gives one row for each bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in itertools.chain.from_iterable(slices(b, 0) for b in batches):
            for _, crcs in feature_crcs(*_texts(batch.column(0)), orders):
                total += np.bincount(crcs % buckets, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], names=["bucket", "n"])

    found = texts.select(texts[text].cast("string").alias("__text")).mapInArrow(count, "bucket long, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, orders: int = 1, buckets: int = BUCKETS, text: str = "text") -> np.ndarray:
    """The gain of each bucket, in thousandths, floored."""
    if not 0 < buckets <= MOST_BUCKETS:
        raise ValueError(f"buckets must be from 1 to {MOST_BUCKETS}")
    counts = np.zeros((2, buckets))
    for k, texts in enumerate((docs, target)):
        told = bucket_counts(texts, orders, buckets, text).toPandas()
        counts[k, told["bucket"]] = told["n"]
    s, t = counts
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, keep: list[str], orders: int = 1, text: str = "text") -> DataFrame:
    """The columns ``keep`` with ``n_words``, ``n_features`` and ``weight``, the floored mean gain of the features."""
    lookup = docs.sparkSession.sparkContext.broadcast(gain)
    kept = docs.select(*[docs[k] for k in keep])
    names = [*keep, *(free_name(kept, c) for c in ("n_words", "n_features", "weight"))]
    schema = T.StructType([T.StructField(k, docs.schema[k].dataType) for k in keep] + [T.StructField(c, T.LongType()) for c in names[len(keep) :]])
    place = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in itertools.chain.from_iterable(slices(b, place) for b in batches):
            total, n, n_words = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for words, (row, crcs) in enumerate(feature_crcs(*_texts(batch.column(place)), orders), start=1):
                sums = np.concatenate(([0], np.cumsum(lookup.value[crcs % len(lookup.value)])))
                bounds = np.searchsorted(row, np.arange(batch.num_rows + 1))
                total += sums[bounds[1:]] - sums[bounds[:-1]]
                n += np.diff(bounds)
                n_words = np.diff(bounds) if words == 1 else n_words
            made = (n_words, n, total // np.maximum(n, 1))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(place)] + [pa.array(m, pa.int64()) for m in made], names=names)

    return docs.select(*[docs[k] for k in keep], docs[text].cast("string").alias("__text")).mapInArrow(run, schema)


def noise(doc_id: str, seed: int):
    """Gumbel noise in thousandths, floored, from a keyed hash of the id."""
    told = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(told, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def draw(weighed: DataFrame, percent: int = 10, least_words: int = 20, seed: int = 2024, doc_id: str = "doc_id") -> DataFrame:
    """``weighed`` (from :func:`weigh`) with ``score`` and ``rank``.

    Of the rows with at least ``least_words`` words, ``percent`` of a hundred
    are drawn, the highest scores first and ties by id; the others' rank is
    null. A histogram of scores, which are whole numbers, tells the score from
    which rows are drawn, so only those are sorted.
    """
    scored = cut(weighed.withColumn("score", F.col("weight") + noise(doc_id, seed)), "resample-scores")
    may = scored["n_words"] >= least_words
    told = scored.where(may).groupBy("score").agg(F.count("*").alias("n")).toPandas().sort_values("score", ascending=False)
    wanted = percent * int(told["n"].sum()) // 100
    if not wanted:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    least = int(told["score"].iloc[int(np.searchsorted(told["n"].cumsum().to_numpy(), wanted))])
    high = F.coalesce(may & (F.col("score") >= least), F.lit(False))
    best = scored.where(high).withColumns({"__down": -F.col("score"), "__place": F.monotonically_increasing_id()})
    ranked = numbered(best, "__down", doc_id, "__place", name="__rank")
    rank = F.when(F.col("__rank") <= wanted, F.col("__rank"))
    return ranked.select(*scored.columns, rank.alias("rank")).unionByName(scored.where(~high).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, orders: int = 1, buckets: int = BUCKETS, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of ``docs``."""
    weighed = weigh(docs, gains(docs, target, orders, buckets), ["doc_id"], orders)
    return draw(weighed, percent, least_words, seed)
