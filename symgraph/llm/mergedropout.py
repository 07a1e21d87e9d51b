"""SentencePiece BPE with seeded merge dropout.

Text is cut into units: runs of spaces with the word behind them. In a unit,
an agenda holds the candidate merges of neighbouring pieces, best score first
and leftmost among equals. A keyed hash of seed, document, the unit's place in
the text and the candidate's place in the unit decides whether a candidate is
skipped, so every occurrence of a word is split on its own; skipped ones never
come back. What remains is merged as usual, characters without a piece fall
back to bytes, and the ids decode to the text again whatever was skipped.
Without dropout the ids are those of the sentencepiece library.

A bounded table holds each word's characters, its ids without any skip, and all
candidates offered on the way there. An occurrence whose key skips none of them
takes those ids. Every other occurrence goes through an agenda of its own: many
units at once as columns of a matrix, or one by one through a heap if long.

Cases: null and empty texts have no ids. U+2581 in a text is coded as bytes,
so that it decodes to itself. Texts of any length are coded whole. Rows that
repeat an id and a text get equal ids. Other columns pass through or play no part.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import defaultdict
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

DROPOUT = 0.1
SEED = 20_240_607
#: Units that the table holds; those met after that are worked out anew in each batch.
CACHE_UNITS = 400_000
#: Occurrences whose candidates are hashed together.
HASHED_ROWS = 50_000
#: Units of up to this many characters are handled as columns of a matrix.
MATRIX_CHARS = 32
MATRIX_COLUMNS = 16_384
#: A candidate's left, middle and right place in a short unit are the digits of one number to this base.
_BASE = MATRIX_CHARS + 1
_SPACE = "▁"
#: Stands for U+2581 itself; no valid text holds a lone surrogate.
_LITERAL = "\udc81"
UNIT_RE = re.compile(f"{_SPACE}*[^{_SPACE}]+|{_SPACE}+")
_NONE = np.int32(2**31 - 1)
_SLOTS = 20
_M = np.uint64(0x9E3779B97F4A7C15)
_C = np.uint64(0xFF51AFD7ED558CCD)
_S = np.uint64(33)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _C
    return x ^ (x >> _S)


def skipped(key: np.ndarray, left: np.ndarray, middle: np.ndarray, right: np.ndarray, dropout: float) -> np.ndarray:
    """Whether the candidate that joins [left, middle) and [middle, right) is skipped; ``key`` stands for seed, document and unit place."""
    with np.errstate(over="ignore"):
        place = (left.astype(np.uint64) * _M + middle.astype(np.uint64)) * _M + right.astype(np.uint64)
        return (_mix(_mix(key.astype(np.uint64)) + place) >> np.uint64(32)).astype(np.int64) < int(dropout * 2**32)


class MergeDropout:
    """Encoder and decoder over one model file; one lives in each Python worker."""

    _made: dict[tuple, MergeDropout] = {}

    def __init__(self, path: str, dropout: float = DROPOUT, seed: int = SEED):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.dropout, self.seed = dropout, seed
        size = self.library.get_piece_size()
        special = [self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) or self.library.is_unused(i) for i in range(size)]
        self.pieces = {self.library.id_to_piece(i): i for i in range(size) if not special[i]}
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        scores = np.array([self.library.get_score(i) for i in range(size)])
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        joins = {}
        for piece, at in self.pieces.items():
            for k in range(1, len(piece)):
                left, right = self.pieces.get(piece[:k]), self.pieces.get(piece[k:])
                if left is not None and right is not None:
                    joins[left << 32 | right] = at
        self.joins = joins
        keys = np.array(sorted(joins), dtype=np.int64)
        self.keys, self.targets = keys, np.array([joins[k] for k in keys.tolist()], dtype=np.int32)
        # Where a pair stands among the keys, by hash; -1 where no pair has the hash, -2 where several have.
        slots, at, times = np.unique(self._slot(keys), return_index=True, return_counts=True)
        self.place = np.full(1 << _SLOTS, -1, np.int32)
        self.place[slots] = np.where(times == 1, at, -2)
        self.symbol_of = -1 - np.arange(0x110000, dtype=np.int32)
        for piece, at in self.pieces.items():
            if len(piece) == 1:
                self.symbol_of[ord(piece)] = at
        # The table of units: numbers by unit, and what is known of each number.
        self.codes: defaultdict[str, int] = defaultdict(count().__next__)
        self.symbols, self.ids, self.offers = (_Lists(np.int32), _Lists(np.int32), _Lists(np.uint16))

    @classmethod
    def of(cls, path: str, dropout: float, seed: int) -> MergeDropout:
        key = (path, dropout, seed)
        if key not in cls._made:
            cls._made[key] = cls(path, dropout, seed)
        return cls._made[key]

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys >> 32) * 40_503 + (keys & 0xFFFFFFFF) * 60_493) & ((1 << _SLOTS) - 1)

    def keys_of(self, text: str, document: int, units: int) -> np.ndarray:
        """The keys of a text's units."""
        start = (zlib.crc32(text.encode("utf-8", "surrogatepass")) << 32) ^ (document * 7_919) ^ (self.seed * 1_000_003)
        with np.errstate(over="ignore"):
            return _mix(_mix(np.full(units, start & (2**64 - 1), np.uint64)) + np.arange(units, dtype=np.uint64) * _M)

    def _symbols(self, unit: str) -> list[int]:
        return [self.pieces.get(c, -1 - ord(c)) for c in unit]

    def _ids(self, symbols: list[int]) -> list[int]:
        out: list[int] = []
        for s in symbols:
            if s >= 0:
                out.append(s)
            else:
                char = chr(-1 - s)
                out += [self.bytes[b] for b in (_SPACE if char == _LITERAL else char).encode("utf-8")]
        return out

    def merge_heap(self, unit: str, key: int) -> list[int]:
        """One unit through a heap agenda."""
        symbols = self._symbols(unit)
        n, held = len(symbols), np.array([key], dtype=np.uint64)
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        agenda: list[tuple[int, int, int, int]] = []

        def offer(left: int) -> None:
            middle = end[left]
            if middle >= n:
                return
            target = self.joins.get(symbols[left] << 32 | symbols[middle]) if symbols[left] >= 0 and symbols[middle] >= 0 else None
            if target is None:
                return
            at = [np.array([x]) for x in (left, middle, end[middle])]
            if not (self.dropout and skipped(held, *at, self.dropout)[0]):
                heapq.heappush(agenda, (int(self.rank[target]), left, middle, target | end[middle] << 32))

        for k in range(n - 1):
            offer(k)
        while agenda:
            _, left, middle, packed = heapq.heappop(agenda)
            stop = packed >> 32
            if not (alive[left] and middle < n and alive[middle] and end[left] == middle and end[middle] == stop):
                continue
            symbols[left], end[left], alive[middle] = packed & 0xFFFFFFFF, stop, False
            if stop < n:
                before[stop] = left
            offer(left)
            if before[left] >= 0:
                offer(before[left])
        return self._ids([s for s, a in zip(symbols, alive, strict=True) if a])

    def _join_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two neighbours join to, or -1."""
        keys = left.astype(np.int64) << 32 | right
        target = np.full(len(keys), -1, np.int32)
        place = self.place.take(self._slot(keys))
        at = np.flatnonzero((place != -1) & (left >= 0) & (right >= 0))
        keys, place = keys[at], place[at]
        if (several := np.flatnonzero(place == -2)).size:
            place[several] = np.minimum(np.searchsorted(self.keys, keys[several]), len(self.keys) - 1)
        hit = self.keys.take(place) == keys
        target[at[hit]] = self.targets.take(place[hit])
        return target

    def _symbols_of(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The characters of units one after the other, and how many each has."""
        return self.symbol_of[np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)], np.fromiter(map(len, units), np.int64, len(units))

    def merge_matrix(self, units: list[str], keys: list[int]) -> list[list[int]]:
        """Short units through the agenda together, each with its own key."""
        flat, sizes = self._matrix(*self._symbols_of(units), np.array(keys, dtype=np.uint64))[:2]
        return [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])]

    def _matrix(self, symbols: np.ndarray, sizes: np.ndarray, keys: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of short units and how many each has; and the candidates offered, packed, and how many for each.

        Row k of each table is the piece that starts at character k of a unit.
        In each round every column's best candidate is merged. ``keys`` None
        skips nothing; else offers are not noted.
        """
        units, height = len(sizes), int(sizes.max(initial=0)) + 1
        column = np.repeat(np.arange(units), sizes)
        row = np.arange(len(symbols)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        piece = np.full(height * units, -(1 << 30), np.int32)
        piece[row * units + column] = symbols
        after = np.repeat(np.arange(1, height + 2, dtype=np.int32), units)
        before = np.repeat(np.arange(-1, height, dtype=np.int32), units)
        target = np.full(height * units, -1, np.int32)
        agenda = np.full((height, units), _NONE, np.int32)
        queue = agenda.ravel()
        noted: list[tuple[np.ndarray, np.ndarray]] = []

        def offer(c: np.ndarray, left: np.ndarray) -> None:
            at = left * units + c
            middle = after.take(at)
            under = middle * units + c
            joined = self._join_of(piece.take(at), piece.take(under))
            target[at] = joined
            put = np.where(joined >= 0, self.rank.take(joined) * 64 + left, _NONE)
            good = np.flatnonzero(joined >= 0)
            if self.dropout and good.size:
                end = after.take(under[good])
                if keys is None:
                    noted.append((c[good], ((left[good] * _BASE + middle[good]) * _BASE + end).astype(np.uint16)))
                else:
                    put[good[skipped(keys.take(c[good]), left[good], middle[good], end, self.dropout)]] = _NONE
            queue[at] = put

        first = np.flatnonzero(row < sizes.take(column) - 1)
        offer(column[first], row[first].astype(np.int32))
        while True:
            best = agenda.min(axis=0)
            c = np.flatnonzero(best < _NONE)
            if not c.size:
                break
            left = best.take(c) & 63
            at = left * units + c
            under = after.take(at) * units + c
            end = after.take(under)
            piece[at], piece[under] = target.take(at), -(1 << 30)
            queue[under] = queue[at] = _NONE
            after[at] = end
            before[end * units + c] = left
            right = end < sizes.take(c)
            offer(c[right], left[right])
            previous = before.take(at)
            linked = previous >= 0
            offer(c[linked], previous[linked])
        held = np.ascontiguousarray(piece.reshape(height, units).T)
        inside = held > -(1 << 30)
        flat, counts = held[inside], inside.sum(axis=1)
        if (bare := np.flatnonzero(flat < 0)).size:
            # Characters without a piece become their bytes.
            spread = [self._ids([s]) for s in flat[bare].tolist()]
            wide = np.ones(len(flat), np.int64)
            wide[bare] = list(map(len, spread))
            sums, ends = np.concatenate(([0], np.cumsum(wide))), np.cumsum(counts)
            counts = sums[ends] - sums[ends - counts]
            byte = np.repeat(flat < 0, wide)
            flat = np.repeat(flat, wide)
            flat[byte] = list(chain.from_iterable(spread))
        if not noted:
            return flat, counts, np.zeros(0, np.uint16), np.zeros(units, np.int64)
        owner, codes = (np.concatenate(x) for x in zip(*noted, strict=True))
        return flat, counts, codes[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=units)

    def _learn(self, new: list[str]) -> None:
        """Put new units into the table, in their order."""
        symbols, sizes = self._symbols_of(new)
        self.symbols.add(symbols, sizes)
        order = np.argsort(sizes, kind="stable")
        parts = [self._matrix(*self.symbols.take(order[at : at + MATRIX_COLUMNS] + len(self.symbols) - len(new)), None) for at in range(0, len(new), MATRIX_COLUMNS)]
        back = np.argsort(order)
        for k, lists in ((0, self.ids), (2, self.offers)):
            made = _Lists(lists.flat.dtype)
            for part in parts:
                made.add(part[k], part[k + 1])
            lists.add(*made.take(back))

    def _skips(self, codes: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Which occurrences have an offered candidate skipped."""
        places, counts = self.offers.take(codes)
        wide = places.astype(np.int64)
        hit = skipped(np.repeat(keys, counts), wide // (_BASE * _BASE), wide // _BASE % _BASE, wide % _BASE, self.dropout)
        return np.bincount(np.repeat(np.arange(len(codes)), counts)[hit], minlength=len(codes)) > 0

    def encode(self, texts: list[str | None], documents: list[int]) -> list[np.ndarray]:
        """The ids of each text, as 32-bit arrays; ``documents`` are numbers that stand for the texts' documents."""
        kept, code = len(self.codes), self.codes.__getitem__
        numbers, keys, long = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], []
        base = 0
        for text, document in zip(texts, documents, strict=True):
            units = UNIT_RE.findall(_SPACE + text.replace(_SPACE, _LITERAL).replace(" ", _SPACE)) if text else []
            keys.append(self.keys_of(text or "", document, len(units)))
            if max(map(len, units), default=0) > MATRIX_CHARS:
                for k, u in enumerate(units):
                    if len(u) > MATRIX_CHARS:
                        long.append((base + k, np.array(self.merge_heap(u, int(keys[-1][k])), np.int32)))
                        units[k] = ""
            numbers.append(np.fromiter(map(code, units), np.int64, len(units)))
            base += len(units)
        counts = [len(n) for n in numbers[1:]]
        codes, key = np.concatenate(numbers), np.concatenate(keys)
        self._learn(list(islice(self.codes, kept, None)))
        lists = _Lists(np.int32)
        lists.add(*self.ids.whole())
        # Where each occurrence's ids stand: with its unit's, or with those of an agenda of its own.
        place = codes.copy()
        moved = np.concatenate([np.zeros(0, np.int64), *(
            at + np.flatnonzero(self._skips(codes[at : at + HASHED_ROWS], key[at : at + HASHED_ROWS])) for at in range(0, len(codes) if self.dropout else 0, HASHED_ROWS)
        )])
        moved = moved[np.argsort(self.symbols.whole()[1][codes[moved]], kind="stable")]
        for at in range(0, len(moved), MATRIX_COLUMNS):
            some = moved[at : at + MATRIX_COLUMNS]
            place[some] = len(lists) + np.arange(len(some))
            lists.add(*self._matrix(*self.symbols.take(codes[some]), key[some])[:2])
        for at, ids in long:
            place[at] = len(lists)
            lists.add(ids, np.array([len(ids)]))
        out, at = [], 0
        for n in counts:
            out.append(lists.take(place[at : at + n])[0])
            at += n
        if len(self.codes) > CACHE_UNITS:
            for unit in list(islice(self.codes, kept, None)):
                del self.codes[unit]
            self.codes.default_factory = count(kept).__next__
            for table in (self.symbols, self.ids, self.offers):
                table.cut(kept)
        return out

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return [self.library.decode(x.tolist()) if len(x) else "" for x in ids]


class _Lists:
    """Lists of numbers, one after the other in ``flat``."""

    def __init__(self, kind: type):
        self.flat, self.sizes, self.starts = np.zeros(0, kind), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._more: list[tuple[np.ndarray, np.ndarray]] = []
        self._n = 0

    def __len__(self) -> int:
        return self._n

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self._more.append((flat, sizes))
        self._n += len(sizes)

    def _settle(self) -> None:
        if self._more:
            flats, sizes = zip(*self._more, strict=True)
            self.flat, self.sizes = np.concatenate((self.flat, *flats)), np.concatenate((self.sizes, *sizes)).astype(np.int64)
            self.starts, self._more = np.cumsum(self.sizes) - self.sizes, []

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        self._settle()
        return self.flat, self.sizes

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists at the given places, one after the other, and their sizes."""
        self._settle()
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        return self.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[at] - (ends - sizes), sizes)], sizes

    def cut(self, n: int) -> None:
        """Keep the first ``n`` lists."""
        self._settle()
        self.sizes, self.starts, self.flat, self._n = self.sizes[:n], self.starts[:n], self.flat[: int(self.sizes[:n].sum())], n


def encode_documents(docs: DataFrame, model_path: str, dropout: float = DROPOUT, seed: int = SEED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids) for every row; ``seed`` picks the segmentation."""

    def run(rows: list[str]) -> tuple[list]:
        return (MergeDropout.of(model_path, dropout, seed).encode(*read_rows(rows)),)

    return map_texts(marked_texts(docs, doc_id, text), ["doc_id"], {"ids": ("array<int>", pa.list_(pa.int32()))}, run)


def marked_texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text), where 16 hexadecimal digits that stand for the document come before each text."""
    digits = F.lpad(F.lower(F.hex(F.xxhash64(doc_id))), 16, "0")
    return docs.select(F.col(doc_id).alias("doc_id"), F.concat(digits, F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text"))


def read_rows(rows: list[str]) -> tuple[list[str], list[int]]:
    return [r[16:] for r in rows], [int(r[:16], 16) for r in rows]


def round_trip(docs: DataFrame, model_path: str, dropout: float = DROPOUT, seed: int = SEED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_ids, ids_crc32, decoded_crc32, decoded_bytes): every text encoded and decoded again in one pass."""

    def run(rows: list[str]) -> tuple[list, list, list, list]:
        coder = MergeDropout.of(model_path, dropout, seed)
        coded = coder.encode(*read_rows(rows))
        raw = [t.encode("utf-8") for t in coder.decode(coded)]
        crcs = [zlib.crc32(ids.astype("<u4").tobytes()) for ids in coded]
        return list(map(len, coded)), crcs, list(map(zlib.crc32, raw)), list(map(len, raw))

    return map_texts(marked_texts(docs, doc_id, text), ["doc_id"], {k: ("long", pa.int64()) for k in ("n_ids", "ids_crc32", "decoded_crc32", "decoded_bytes")}, run)
