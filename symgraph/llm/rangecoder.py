"""An adaptive context-mixing range coder for token ids.

Ids are coded in blocks that start from the same state and share nothing, so
any block can be read alone. A block's ids stand in lanes of ``LANE_IDS``; the
lanes advance in step, each with a range coder of its own, and all of them
predict from, and teach, one model of the block.

Three contexts predict the next id. Order 2 and order 1 hold the id that
followed the two ids or the one id before, with a confidence. One coded event
tells which of the two guesses holds, or that neither does; its probability
mixes three adaptive distributions, chosen by the order-2 confidence, by the
order-1 confidence and by both, with weights that follow how well each did of
late. After a miss the id itself follows by its order-0 frequency among the
block's misses; an id that is new to the block is written out.

The work for each id is a fixed number of numpy operations over the lanes. The
arithmetic is on integers only and gives the same bytes on every machine.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

MAGIC = b"CMR2"
#: Ids of a block, and of a lane in it.
BLOCK_IDS = 1 << 21
LANE_IDS = 512
_ESCAPED = (1 << 16) - 1  # ids from here on are always written out; the model knows them all by this number
_MISS, _HIT, _FAR = np.int32(2), np.int32(_ESCAPED + 2), _ESCAPED + 1
_EVENT_BITS, _ID_BITS = 12, 18
_TABLE2 = 18
_K1, _K2 = np.int32(40_503), np.int32(60_493)
_ONE = np.int32(1)
_TOP, _LOW = 40, (1 << 40) - 1
#: Lanes whose words are put in order at a time.
_TURN = 128
#: Zeros that stand behind a lane's words when it is read.
_PAST = 4
#: Steps between two looks at the statistics; early looks come at every power of two.
_EVERY = 32


def _pick(mask: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """``one`` where the mask is -1 and ``other`` where it is 0; on mixed masks several times as fast as ``where``."""
    return other ^ ((one ^ other) & mask)


class _Model:
    """What a block has taught so far, and what its lanes saw last.

    A guess and its confidence share one number: id * 8 + confidence. Event
    rows are numbered by whether the guesses agree, the order-2 confidence, the
    order-1 confidence and the event before.
    """

    def __init__(self, lanes: int):
        self.table = np.full((1 << 16) + (1 << _TABLE2), -8, np.int32)
        self.one, self.two = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
        self.event = np.full(lanes, _MISS, np.int32)
        self.counts = np.zeros(_HIT + 1, np.int64)
        self.counts[0] = 1
        row = np.arange(2 * 8 * 8 * 3)
        self.parts = [(row // 24, 16), (row % 24 + 24 * (row // 192), 48), (row, 384)]
        self.events = [np.tile(np.array([3, 3, 6], np.int64), (size, 1)) for _, size in self.parts]
        self.weights = np.full((3, 384), 256, np.int64)
        self.seen_ids: list[np.ndarray] = []
        self.seen_events: list[np.ndarray] = []
        self._mix_events(None)
        self._count_ids()

    def _mix_events(self, seen: np.ndarray | None) -> None:
        room = (1 << _EVENT_BITS) - 3
        shares = []
        for (group, _), table in zip(self.parts, self.events, strict=True):
            shares.append((1 + table * room // table.sum(axis=1, keepdims=True))[group])
        if seen is not None:
            credit = np.array([(seen * share).sum(axis=1) for share in shares])
            total = credit.sum(axis=0)
            self.weights = np.where(total > 0, (self.weights * 7 + credit * 768 // np.maximum(total, 1)) // 8 + 1, self.weights)
            for (group, size), table in zip(self.parts, self.events, strict=True):
                for event in range(3):
                    table[:, event] += 16 * np.bincount(group, seen[:, event], size).astype(np.int64)
                full = table.sum(axis=1) > 1 << 20
                table[full] = (table[full] + 1) >> 1
            shares = []
            for (group, _), table in zip(self.parts, self.events, strict=True):
                shares.append((1 + table * room // table.sum(axis=1, keepdims=True))[group])
        mixed = sum(w[:, None] * s for w, s in zip(self.weights, shares, strict=True)) // self.weights.sum(axis=0)[:, None]
        mixed = np.maximum(mixed, 1)
        mixed[:, _MISS] += (1 << _EVENT_BITS) - mixed.sum(axis=1)
        self.event_freq = mixed.ravel()
        sums = np.cumsum(mixed, axis=1)
        self.event_below = (sums - mixed).ravel()
        self.after0, self.after1 = sums[:, 0].copy(), sums[:, 1].copy()

    def _count_ids(self) -> None:
        """Frequencies of the order-0 ids; number 0 stands for an id not seen yet, ``_HIT`` for none to code."""
        known = self.counts > 0
        room = (1 << _ID_BITS) - int(known.sum())
        freq = np.where(known, 1 + self.counts * room // int(self.counts.sum()), 0)
        freq[0] += (1 << _ID_BITS) - int(freq.sum())
        self.id_freq, self.id_below = freq, np.cumsum(freq) - freq
        self.id_freq[_HIT], self.id_below[_HIT] = 1 << _ID_BITS, 0

    def inverse(self) -> np.ndarray:
        return np.repeat(np.arange(_FAR, dtype=np.int32), self.id_freq[:_FAR])

    def look(self, n: int) -> None:
        """Guesses and event rows of the first ``n`` lanes; order 1 stands above order 2."""
        one = self.one[:n]
        self.at = np.empty((2, n), np.intp)
        self.at[0], self.at[1] = one, ((one * _K1 + self.two[:n] * _K2) >> 8 & ((1 << _TABLE2) - 1)) + (1 << 16)
        self.held = self.table.take(self.at, mode="clip")
        self.sure, self.guess = self.held & 7, self.held >> 3
        self.guess1, self.guess2 = self.guess
        row = (self.guess1 == self.guess2).astype(np.int32) * 192 + self.sure[1] * 24 + self.sure[0] * 3 + self.event[:n]
        self.row = row.astype(np.intp)

    def learn(self, n: int, ids: np.ndarray, event: np.ndarray, at: np.ndarray, number: np.ndarray) -> None:
        """``at`` tells the events' rows and ``number`` the ids coded by order 0, each plus one (``_HIT``: none)."""
        # A guess that held grows surer, up to 7; one that failed loses half its confidence, and its place when little is left.
        more = self.sure + 1
        failed = _pick((self.sure - 2) >> 31, (ids << 3) + 1, self.held - (more >> 1))
        self.table[self.at.ravel()] = _pick(-(self.guess == ids).astype(np.int32), self.held + 1 - (more >> 3), failed).ravel()
        self.seen_ids.append(number)
        self.seen_events.append(at)
        self.two[:n] = self.one[:n]
        self.one[:n], self.event[:n] = ids, event

    def review(self, step: int) -> bool:
        """Take in what was seen; true if the order-0 frequencies changed."""
        if step % _EVERY and step & (step - 1):
            return False
        seen = np.bincount(np.concatenate(self.seen_events), minlength=3 * 384).reshape(384, 3)
        ids = np.concatenate(self.seen_ids)
        self.seen_ids, self.seen_events = [], []
        self._mix_events(seen)
        met = np.bincount(ids, minlength=_HIT + 1)
        met[_FAR] = met[_HIT] = 0
        # Number 0 keeps about the share of ids that were new at the last look.
        self.counts[0] = (self.counts[0] + int(((met > 0) & (self.counts == 0)).sum()) + 1) >> 1
        met[0] = 0
        self.counts += met
        self._count_ids()
        return True


def _sizes(n: int) -> tuple[int, int]:
    """Lanes of a block and the ids of its last lane."""
    lanes = -(-n // LANE_IDS)
    return lanes, n - LANE_IDS * (lanes - 1)


def _turned(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows.T)


def encode_block(ids: np.ndarray) -> bytes:
    """The lanes' word counts (16 bits each) and their words."""
    ids = np.asarray(ids)
    lanes, last = _sizes(len(ids))
    padded = np.zeros(lanes * LANE_IDS, np.int32)
    padded[: len(ids)] = np.minimum(ids, _ESCAPED)
    steps = _turned(padded.reshape(lanes, LANE_IDS))
    any_far = bool((padded == _ESCAPED).any())
    model = _Model(lanes)
    low, span = np.zeros(lanes, np.int64), np.full(lanes, 1 << 56, np.int64)
    # A row for each time that lanes give a word: the words of all lanes, and which of them count. Rows whose sizes are powers
    # of two would be slow to read by columns.
    words, given, used = np.empty((3 * LANE_IDS, lanes + 16), np.int32)[:, :lanes], np.zeros((3 * LANE_IDS, lanes + 64), bool)[:, :lanes], 0

    def settle(n: int) -> None:
        nonlocal words, given, used
        while (short := span[:n] <= _LOW).any():
            if used + 1 == len(words):
                words, given = np.concatenate((words, np.empty_like(words))), np.concatenate((given, np.zeros_like(given)))
            words[used, :n], given[used, :n] = low[:n] >> _TOP, short
            used += 1
            one = short.astype(np.int64)
            shift = one << 4
            low[:n] = (low[:n] & ((one - 1) | _LOW)) << shift
            span[:n] <<= shift

    def plain(which: np.ndarray, values: np.ndarray, n: int) -> None:
        """Write 16-bit numbers out."""
        unit = span[which] >> 16
        low[which] += unit * values
        span[which] = unit
        settle(n)

    for t in range(LANE_IDS if lanes > 1 else last):
        n = lanes if t < last else lanes - 1
        now = steps[t, :n]
        model.look(n)
        other = now != model.guess2
        event = other.astype(np.int32) + (other & (now != model.guess1))
        if any_far:
            event[now == _ESCAPED] = _MISS
        at = model.row * 3 + event
        number = met = ((now + _ONE - _HIT) & -(event == _MISS).astype(np.int32)) + _HIT
        freq = model.id_freq.take(number, mode="clip")
        if (fresh := np.flatnonzero(freq == 0)).size:
            number = met.copy()
            number[fresh], freq[fresh] = 0, model.id_freq[0]
        unit = span[:n] >> (_EVENT_BITS + _ID_BITS)
        part = unit * model.event_freq.take(at, mode="clip")
        low[:n] += (unit * model.event_below.take(at, mode="clip") << _ID_BITS) + part * model.id_below.take(number, mode="clip")
        span[:n] = part * freq
        settle(n)
        if fresh.size:
            plain(fresh, now[fresh], n)
            if any_far and (far := fresh[now[fresh] == _ESCAPED]).size:
                for shift in (16, 0):
                    plain(far, ids[far * LANE_IDS + t].astype(np.int64) >> shift & 0xFFFF, n)
        model.learn(n, now, event, at, met)
        model.review(t + 1)
    # One more word, rounded up, lies within what is left of the range whatever follows it.
    words[used], given[used] = -(-low >> _TOP), True
    parts = []
    for at in range(0, lanes, _TURN):
        flat = _turned(words[: used + 1, at : at + _TURN])[_turned(given[: used + 1, at : at + _TURN])]
        # A lane's first word never has a carry, so none goes from lane to lane.
        while (carry := flat >> 16).any():
            flat &= 0xFFFF
            flat[:-1] += carry[1:]
        parts.append(flat.astype("<u2").tobytes())
    return b"".join((given[: used + 1].sum(axis=0, dtype=np.int32).astype("<u2").tobytes(), *parts))


def decode_block(body: bytes, n_ids: int) -> np.ndarray:
    """The ``n_ids`` ids of a block, as unsigned 32-bit integers."""
    lanes, last = _sizes(n_ids)
    counts = np.frombuffer(body, "<u2", lanes).astype(np.int64)
    given = np.frombuffer(body, "<u2", offset=2 * lanes)
    # Past a lane's end come zeros; a lane reads two words there at most.
    starts = np.cumsum(counts + _PAST) - (counts + _PAST)
    words = np.zeros(len(given) + _PAST * lanes + 1, np.int64)
    words[np.arange(len(given)) + _PAST * np.repeat(np.arange(lanes), counts)] = given
    # The range is 56 bits wide, so what is read in runs half a word behind the words.
    halves = (words[:-1] & 0xFF) << 8 | words[1:] >> 8
    code, span = words[starts] << 40 | words[starts + 1] << 24 | words[starts + 2] << 8 | words[starts + 3] >> 8, np.full(lanes, 1 << 56, np.int64)
    place = starts + 3

    def settle(n: int) -> None:
        while (short := span[:n] <= _LOW).any():
            one = short.astype(np.int64)
            shift = one << 4
            code[:n] = code[:n] << shift | halves.take(place[:n], mode="clip") & -one
            place[:n] += one
            span[:n] <<= shift

    def plain(which: np.ndarray, n: int) -> np.ndarray:
        unit = span[which] >> 16
        value = code[which] // unit
        code[which] -= unit * value
        span[which] = unit
        settle(n)
        return value

    model = _Model(lanes)
    inverse = model.inverse()
    steps = np.zeros((LANE_IDS, lanes), np.int32)
    whole: list[tuple[np.ndarray, np.ndarray]] = []
    for t in range(LANE_IDS if lanes > 1 else last):
        n = lanes if t < last else lanes - 1
        model.look(n)
        unit = span[:n] >> (_EVENT_BITS + _ID_BITS)
        event = (code[:n] >= unit * model.after0.take(model.row, mode="clip") << _ID_BITS).astype(np.int32)
        event += code[:n] >= unit * model.after1.take(model.row, mode="clip") << _ID_BITS
        at = model.row * 3 + event
        rest = code[:n] - (unit * model.event_below.take(at, mode="clip") << _ID_BITS)
        part = unit * model.event_freq.take(at, mode="clip")
        miss = -(event == _MISS).astype(np.int32)
        # Division in floating point, which is much faster, may be off by one and is mended.
        value = (rest / part).astype(np.int64)
        left = rest - value * part
        value += left >= part
        value -= left < 0
        number = _pick(miss, inverse.take(value, mode="clip"), _HIT)
        code[:n] = rest - part * model.id_below.take(number, mode="clip")
        span[:n] = part * model.id_freq.take(number, mode="clip")
        settle(n)
        now = _pick(miss, number - _ONE, _pick(-(event & _ONE), model.guess1, model.guess2))
        if (fresh := np.flatnonzero(number == 0)).size:
            now[fresh] = plain(fresh, n)
            number[fresh] = now[fresh] + _ONE
            if (far := fresh[now[fresh] == _ESCAPED]).size:
                upper = plain(far, n) << 16
                whole.append((far * LANE_IDS + t, upper | plain(far, n)))
        steps[t, :n] = now
        model.learn(n, now, event, at, number)
        if model.review(t + 1):
            inverse = model.inverse()
    ids = np.empty(lanes * LANE_IDS, np.uint32)
    for at in range(0, lanes, _TURN):
        ids.reshape(lanes, LANE_IDS)[at : at + _TURN] = steps[:, at : at + _TURN].T
    ids = ids[:n_ids]
    for at, values in whole:
        ids[at] = values
    return ids


_HEAD = struct.Struct("<4sQII")


def pack_frame(ids: np.ndarray, block: int = BLOCK_IDS) -> bytes:
    """A frame: magic, id count, block size and block count, then length and CRC-32 of each block, the CRC-32 of all that, and the blocks."""
    blocks = [encode_block(ids[at : at + block]) for at in range(0, len(ids), block)]
    head = _HEAD.pack(MAGIC, len(ids), block, len(blocks))
    index = b"".join(struct.pack("<II", len(b), zlib.crc32(b)) for b in blocks)
    return head + index + struct.pack("<I", zlib.crc32(head + index)) + b"".join(blocks)


def unpack_blocks(frame: bytes) -> Iterator[np.ndarray]:
    """The ids of a frame block by block, as unsigned 32-bit integers; raises ValueError on a damaged one."""
    if len(frame) < _HEAD.size or frame[:4] != MAGIC:
        raise ValueError("not a frame of coded ids")
    _, n, block, count = _HEAD.unpack_from(frame)
    at = _HEAD.size + 8 * count
    if len(frame) < at + 4 or zlib.crc32(frame[:at]) != int.from_bytes(frame[at : at + 4], "little"):
        raise ValueError("the head's checksum is wrong")
    parts = list(struct.iter_unpack("<II", frame[_HEAD.size : at]))
    at += 4
    if len(frame) != at + sum(size for size, _ in parts):
        raise ValueError("the frame's length is wrong")
    for k, (size, crc) in enumerate(parts):
        part = frame[at : at + size]
        if zlib.crc32(part) != crc:
            raise ValueError("a block's checksum is wrong")
        yield decode_block(part, min(block, n - block * k))
        at += size


def unpack_frame(frame: bytes) -> np.ndarray:
    """All ids of a frame, as unsigned 32-bit integers."""
    return np.concatenate([np.zeros(0, np.uint32), *unpack_blocks(frame)])
