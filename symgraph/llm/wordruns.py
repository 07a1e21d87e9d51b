"""Periodic runs of words, all of them, by the runs theorem.

A run is a stretch of consecutive words with smallest period q, at least 2 q
words long, that no neighbouring word extends. By the runs theorem every run
holds a Lyndon word of length q that is the longest Lyndon word at its start
under one of the two alphabet orders, and the longest Lyndon word at i ends
before the next suffix that is smaller. So a text has at most 2 n candidates:
they come from next-smaller values of the inverse suffix array under both
orders. Each is extended to both sides by longest common extensions, which are
minima over the LCP arrays of the text and of its reverse, read from sparse
tables. Work grows as n log n, memory too; there is no cap on lengths.

Many texts share one pass: their words lie behind one another with separators
between them, and symbols of different texts differ, so nothing matches across
texts. Only texts in which some sequence of half the least run length stands
twice can hold a run (``length - q`` words match the words q places on, and
that is at least half); the others leave after the first rounds.

Cases: a null or empty text has no words and no runs. Repeated rows give equal
results. An empty table gives no rows. Columns asked for pass through; a new
column gets underscores added where its name would clash with one of them.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, let, slices, words

#: Runs are at least this many words long.
MIN_LENGTH = 12
#: Bytes of text that share one pass.
PASS_BYTES = 2 << 20


def _firsts(keys: np.ndarray) -> np.ndarray:
    """For sorted keys, the place at which each one's group of equals begins."""
    new = np.concatenate(([True], keys[1:] != keys[:-1]))
    return np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))


def first_ranks(symbols: np.ndarray) -> np.ndarray:
    """How many symbols are smaller than each one."""
    order = np.argsort(symbols, kind="stable")
    ranks = np.empty(len(symbols), np.int32)
    ranks[order] = _firsts(symbols[order])
    return ranks


def _shared(ranks: np.ndarray) -> np.ndarray:
    """Places whose rank another place has too."""
    return np.flatnonzero(np.bincount(ranks, minlength=len(ranks))[ranks] > 1)


def rank_levels(symbols: np.ndarray, most: int | None = None) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... symbols, until all differ or ``most`` symbols count.

    The symbol -1 separates texts. It is smaller than all others and its own
    places are not told apart. The last level is the inverse suffix array.
    """
    levels, reach = [first_ranks(symbols)], 1
    left = _shared(levels[0])
    left = left[symbols[left] >= 0]
    while left.size and (most is None or reach * 2 <= most):
        ranks = levels[-1]
        key = ranks[left].astype(np.int64) * len(symbols) + ranks[left + reach]
        order = np.argsort(key, kind="stable")
        left, key = left[order], key[order]
        within = _firsts(key) - _firsts(ranks[left])
        ranks = ranks.copy()
        ranks[left] += within.astype(np.int32)
        levels.append(ranks)
        reach *= 2
        fresh = _firsts(key)
        again = np.bincount(fresh, minlength=len(key))[fresh] > 1
        left = left[again]
    return levels


def lcp_array(levels: list[np.ndarray], symbols: np.ndarray) -> np.ndarray:
    """By rank: how many symbols each suffix shares with the one ranked before it."""
    places = np.argsort(levels[-1], kind="stable")
    before, at = places[:-1].copy(), places[1:].copy()
    shared = np.zeros(len(at), np.int32)
    live = np.flatnonzero((levels[0][before] == levels[0][at]) & (symbols[at] >= 0))
    a, b, n = before[live], at[live], np.zeros(len(live), np.int32)
    for k in range(len(levels) - 1, -1, -1):
        step = np.where(levels[k][a] == levels[k][b], 1 << k, 0).astype(np.int32)
        a, b, n = a + step, b + step, n + step
    shared[live] = n
    return np.concatenate((np.zeros(1, np.int32), shared))


class Extensions:
    """Longest common extensions of places: minima over the LCP array from a sparse table."""

    def __init__(self, symbols: np.ndarray, longest: int):
        levels = rank_levels(symbols)
        self.ranks = levels[-1]
        self.table = [lcp_array(levels, symbols)]
        while 2 ** len(self.table) <= longest:
            half, last = 2 ** (len(self.table) - 1), self.table[-1]
            self.table.append(np.minimum(last[: len(last) - half], last[half:]))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = np.minimum(self.ranks[a], self.ranks[b]) + 1, np.maximum(self.ranks[a], self.ranks[b]) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.zeros(len(a), np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.table[k][low[at]], self.table[k][high[at] - (1 << k)])
        return out


def next_smaller(ranks: np.ndarray) -> np.ndarray:
    """The next place with a smaller value, by links over places already done; separators end every search."""
    values = ranks.tolist()
    out = [0] * len(values)
    for i in range(len(values) - 2, -1, -1):
        value, j = values[i], i + 1
        while values[j] > value:
            j = out[j]
        out[i] = j
    return np.array(out, np.int64)


def _laid(codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, code) of every place, with a separator (-1) before, between and after texts."""
    text = np.full(len(codes) + len(lengths) + 1, -1, np.int64)
    code = text.copy()
    owner = np.repeat(np.arange(len(lengths)), lengths)
    places = np.arange(len(codes)) + owner + 1
    text[places], code[places] = owner, codes
    return text, code


def _repeating(codes: np.ndarray, lengths: np.ndarray, span: int) -> np.ndarray:
    """The texts in which some ``span`` consecutive words stand twice."""
    text, code = _laid(codes, lengths)
    symbols = np.where(text < 0, -1, text * (int(codes.max(initial=0)) + 1) + code)
    levels = rank_levels(symbols, span)
    ranks, reach = levels[-1], 2 ** (len(levels) - 1)
    if reach * 2 <= span:  # all differ already
        return np.zeros(0, np.int64)
    left = _shared(ranks)
    left = left[(text[left] >= 0) & (left + span <= len(text))]
    left = left[text[left] == text[left + span - 1]]
    key = ranks[left].astype(np.int64) * len(text) + ranks[left + span - reach]
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order][1:] == key[order][:-1])
    return np.unique(text[left[order[same]]])


def runs_of(codes: np.ndarray, lengths: np.ndarray, least: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs of at least ``least`` words as (text, start, length, period), in order of text, start and period.

    ``codes`` number the words of all texts, which follow one another;
    ``lengths`` count the words of each text.
    """
    codes, lengths = codes.astype(np.int64), lengths.astype(np.int64)
    held = _repeating(codes, lengths, max(1, (least + 1) // 2))
    if not held.size:
        return (np.zeros(0, np.int64),) * 4
    ends = np.cumsum(lengths)
    codes = np.concatenate([codes[ends[d] - lengths[d] : ends[d]] for d in held.tolist()])
    lengths = lengths[held]
    text, code = _laid(codes, lengths)
    size = int(codes.max()) + 1
    symbols = np.where(text < 0, -1, text * size + code)
    contrary = np.where(text < 0, -1, text * size + (size - 1 - code))
    longest = int(lengths.max())
    ahead, behind = Extensions(symbols, longest), Extensions(symbols[::-1], longest)
    last = len(symbols) - 1

    found = []
    for ranks in (ahead.ranks, rank_levels(contrary)[-1]):
        root = np.flatnonzero(text >= 0)
        follow = next_smaller(np.where(text < 0, -1, ranks))[root]
        # Only a root whose first word or whose preceding word stands again a period later can be extended.
        live = (symbols[root] == symbols[follow]) | (symbols[root - 1] == symbols[follow - 1]) & (text[root - 1] >= 0)
        root, follow = root[live], follow[live]
        period = follow - root
        right = np.where(symbols[root] == symbols[follow], 0, -1)
        at = np.flatnonzero(right == 0)
        right[at] = ahead.of(root[at], follow[at])
        left = np.where((symbols[root - 1] == symbols[follow - 1]) & (text[root - 1] >= 0), 0, -1)
        at = np.flatnonzero(left == 0)
        left[at] = behind.of(last - (root[at] - 1), last - (follow[at] - 1))
        start, end = root - np.maximum(left, 0), follow + np.maximum(right, 0)
        good = end - start >= np.maximum(least, 2 * period)
        found.append(np.stack((start[good], end[good] - start[good], period[good])))
    start, length, period = np.concatenate(found, axis=1)
    _, unique = np.unique(start * (last + 1) + period, return_index=True)
    start, length, period = start[unique], length[unique], period[unique]
    owner = text[start]
    begins = np.cumsum(lengths) - lengths + np.arange(len(lengths)) + 1
    return held[owner], start - begins[owner], length, period


def kept_words(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """False for the words that some run holds after its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, start + length, -1)
    return np.cumsum(depth[:-1]) == 0


RUNS = "array<struct<start:long,length:long,period:long>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(docs: DataFrame, keep: list[str], text: str = "text", least: int = MIN_LENGTH) -> DataFrame:
    """The columns ``keep`` with ``runs``, in order of start and period, and ``collapsed``.

    ``collapsed`` is the text without the words that repeat a run's first
    period, its other words joined by one space.
    """
    kept = docs.select(*[docs[k] for k in keep])
    fields = [T.StructField(k, docs.schema[k].dataType) for k in keep]
    names = [*keep, free_name(kept, "runs"), free_name(kept, "collapsed")]
    schema = T.StructType([*fields, T.StructField(names[-2], T._parse_datatype_string(RUNS)), T.StructField(names[-1], T.StringType())])
    place = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in itertools.chain.from_iterable(slices(b, place, PASS_BYTES) for b in batches):
            # Splitting bytes at white space means exactly the six characters of the contract.
            told = [(t or b"").split() for t in batch.column(place).cast(pa.binary()).to_pylist()]
            lengths = np.fromiter(map(len, told), np.int64, len(told))
            codes = pa.array(itertools.chain.from_iterable(told), pa.large_binary()).dictionary_encode().indices.to_numpy()
            owner, *runs = runs_of(codes, lengths, least)
            bounds = np.searchsorted(owner, np.arange(len(told) + 1))
            for d in np.unique(owner).tolist():
                mine = [r[bounds[d] : bounds[d + 1]] for r in runs]
                told[d] = list(itertools.compress(told[d], kept_words(len(told[d]), *mine).tolist()))
            listed = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(r, pa.int64()) for r in runs], fields=list(_RUN)))
            collapsed = pa.array([b" ".join(w) for w in told], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(place)] + [listed, collapsed], names=names)

    return docs.select(*[docs[k] for k in keep], docs[text].cast("string").alias("__text")).mapInArrow(run, schema)


def planted(text: Column, doc_id: Column) -> Column:
    """The text, or for a tenth of all ids (by checksum) its words with a periodic tail; a null id plants nothing."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10).cast("long")

    def periodic(w: Column) -> Column:
        n = F.size(w)

        def tail(a: Column, p: Column) -> Column:
            return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int")))), " ")

        return F.when(n == 0, "").otherwise(let(g % n, lambda a: let(1 + F.floor((n - a) / (3 + g % 8)).cast("long"), lambda p: tail(a, p))))

    return F.when(h % 10 == 0, let(words(text), periodic)).otherwise(text)


def digests(docs: DataFrame) -> DataFrame:
    """For (doc_id, runs, collapsed): the number of runs, the longest one, and checksums of all runs and of the collapsed text."""
    longest = F.try_element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("down"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(1))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    told = docs.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("r"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length = -F.col("r.down")
    return told.select(
        "doc_id", "n_runs", F.col("r.start").alias("start"), length.alias("length"), F.col("r.period").alias("period"),
        F.floor(1000 * length / F.col("r.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
