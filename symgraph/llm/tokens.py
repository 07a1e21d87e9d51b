"""Whole-text tokenisation with public byte-level BPE vocabularies.

The tokenizers library does the encoding. A text is first cut before single
spaces, since byte-level BPE never merges across such a place, so the pieces'
ids joined are the text's ids. Pieces repeat, so the distinct ones of a batch
are found by Arrow and cut once more where letters end, which byte-level BPE
does too; each worker keeps a bounded table of the ids of what then is left.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct parts of pieces whose ids a worker keeps, those that most batches held; others are encoded anew in each batch.
CACHE_PIECES = 200_000
#: Parts that are encoded as one text.
JOINED_PIECES = 200
#: White space as Python's \s has it, for RE2.
_SPACE = r"\s\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Where a cut before every space would be wrong (in RE2): the space is followed by white space or the end.
UNEVEN_RE = rf" (?:[{_SPACE}]|$)"
#: There, texts are cut only before a space between visible characters.
CAREFUL_RE = re.compile(r"(?<=\S) (?=\S)")
SPACE_RE = re.compile(r"\s")
#: Cuts within a piece (in RE2), made by spaces: around a line feed between visible characters, and behind a letter before a
#: visible ASCII character that is none. Only letters and visible characters that any Unicode version has as such count.
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
CUTS = [(rf"([!-~{_LETTER}])\n([!-~{_LETTER}])", "\\1 \n \\2"), (rf"([{_LETTER}])([!-@\[-`{{-~])", r"\1 \2")]


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _lists(sizes: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values, pa.int32()))


def _take(lists: pa.ListArray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the lists at ``places``, and their values, joined."""
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    starts = offsets.take(places, mode="clip")
    sizes = offsets.take(places + 1, mode="clip") - starts
    ends = np.cumsum(sizes)
    n = int(ends[-1]) if len(ends) else 0
    return sizes, flat.take(np.arange(n, dtype=np.int32) + np.repeat(starts - (ends - sizes).astype(np.int32), sizes), mode="clip")


class _Known:
    """Ids of the strings that most batches held, up to ``limit``; ``encode`` gives the ids of new strings."""

    def __init__(self, encode, limit: int):
        self.encode, self.limit = encode, limit
        self.strings, self.ids, self.uses = pa.array([], pa.string()), _lists(np.zeros(0, np.int32), np.zeros(0, np.int32)), np.zeros(0, np.int32)

    def find(self, strings: pa.Array) -> tuple[np.ndarray, pa.ListArray]:
        """Places of ``strings`` in the lists of ids that follow."""
        coded = strings.dictionary_encode()
        found = pc.index_in(coded.dictionary, value_set=self.strings)
        new = coded.dictionary.filter(pc.is_null(found))
        kept = len(self.strings)
        places = found.fill_null(-1).to_numpy(zero_copy_only=False).copy()
        places[places < 0] = np.arange(kept, kept + len(new))
        ids = pa.concat_arrays([self.ids, self.encode(new)])
        uses = np.concatenate((self.uses, np.zeros(len(new), np.int32)))
        uses[places] += 1
        every = pa.concat_arrays([self.strings, new])
        if len(every) > self.limit:
            # Half of the room stays for what later batches bring.
            keep = np.sort(np.argpartition(-uses, self.limit // 2)[: self.limit // 2])
            self.strings, self.ids, self.uses = every.take(pa.array(keep)), _lists(*_take(ids, keep)), uses[keep]
        else:
            self.strings, self.ids, self.uses = every, ids, uses
        return places.take(coded.indices.to_numpy()), ids


class Encoder:
    """Encodes batches of texts; one lives in each Python worker and vocabulary."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # Byte-level vocabularies write a space as this letter.
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.spaced = np.zeros(max(names.values()) + 1, dtype=bool)
        self.spaced[[at for name, at in names.items() if name[0] == "Ġ"]] = True
        # Parts that a space stands before, and texts to be encoded by themselves.
        self.after_space = _Known(self._encode_joined, CACHE_PIECES * 4 // 5)
        self.alone = _Known(self._encode_alone, CACHE_PIECES // 5)

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    @property
    def codes(self) -> list[str]:
        """The strings whose ids are kept."""
        return self.after_space.strings.to_pylist() + self.alone.strings.to_pylist()

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each text has, and the ids."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(map(len, found), np.int32, len(found)), np.fromiter(chain.from_iterable(found), np.int32)

    def _encode_alone(self, texts: pa.Array) -> pa.ListArray:
        return _lists(*self._library(texts.to_pylist()))

    def _encode_joined(self, parts: pa.Array) -> pa.ListArray:
        """Ids of the parts, each after a space.

        They begin with a visible character and hold no space, so many of them
        are encoded as one text, in which an id starts a part if and only if
        it starts with a space.
        """
        bounds = pa.array([*range(0, len(parts), JOINED_PIECES), len(parts)], pa.int32())
        joined = pc.binary_join(pa.ListArray.from_arrays(bounds, parts), " ").to_pylist()
        _, flat = self._library([" " + text for text in joined])
        return _lists(np.diff(np.flatnonzero(self.spaced[flat]), append=len(flat)), flat)

    def _encode_pieces(self, pieces: pa.Array, by_itself: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each piece has, and the ids; those not ``by_itself`` stand after a space."""
        coded = pieces.dictionary_encode()
        places = coded.indices.to_numpy()
        used = np.zeros(len(coded.dictionary), dtype=bool)
        used[places[~by_itself]] = True
        texts = pieces.filter(pa.array(by_itself))
        cut = coded.dictionary.filter(pa.array(used))
        for pattern, replacement in CUTS:
            cut = pc.replace_substring_regex(cut, pattern=pattern, replacement=replacement)
        listed = pc.split_pattern(cut, " ")
        bounds, parts = listed.offsets.to_numpy(), listed.flatten()
        first = np.zeros(len(parts), dtype=bool)
        first[bounds[:-1]] = True
        # What a piece's first part leaves is encoded without a space, as are the texts.
        known, ids = self.after_space.find(parts.filter(pa.array(first)))
        others, more = self.alone.find(pa.concat_arrays([parts.filter(pa.array(~first)), texts]))
        n_texts = len(texts)
        of_parts = np.empty(len(parts), np.int32)
        of_parts[first], of_parts[~first] = known, others[: len(others) - n_texts] + len(ids)
        ids = pa.concat_arrays([ids, more])
        sizes, flat = _take(ids, np.concatenate((of_parts, others[len(others) - n_texts :] + (len(ids) - len(more)))))
        # The parts' ids joined are the pieces' ids.
        ends = np.concatenate(([0], np.cumsum(sizes)))
        whole = ends[np.concatenate((bounds, np.arange(len(parts) + 1, len(parts) + n_texts + 1)))]
        places = (np.cumsum(used, dtype=np.int32) - 1).take(places)
        places[by_itself] = np.arange(len(cut), len(cut) + n_texts)
        return _take(_lists(np.diff(whole), flat), places)

    def encode(self, texts: list[str | None] | pa.Array, end_id: int) -> list[np.ndarray]:
        """The ids of each text (none for a null) and ``end_id``, as 32-bit arrays."""
        given = pc.fill_null(texts.cast(pa.string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        uneven = pc.match_substring_regex(given, UNEVEN_RE)
        split = pc.split_pattern(given.filter(pc.invert(uneven)), " ")
        bounds, pieces = split.offsets.to_numpy(), split.flatten()
        by_itself = np.zeros(len(pieces), dtype=bool)
        by_itself[bounds[:-1]] = True
        if careful := [CAREFUL_RE.split(text) for text in given.filter(uneven).to_pylist()]:
            marks = [[not k or bool(SPACE_RE.search(piece)) for k, piece in enumerate(found)] for found in careful]
            more = [" " + piece if k and mark else piece for found, of in zip(careful, marks, strict=True) for k, (piece, mark) in enumerate(zip(found, of, strict=True))]
            pieces = pa.concat_arrays([pieces, pa.array(more, pa.string())])
            by_itself = np.concatenate((by_itself, np.fromiter(chain.from_iterable(marks), bool)))
            bounds = np.concatenate((bounds, bounds[-1] + np.cumsum([len(found) for found in careful])))
        sizes, flat = self._encode_pieces(pieces, by_itself)
        ends = np.concatenate(([0], np.cumsum(sizes)))[bounds]
        out: list[np.ndarray] = [None] * len(given)
        odd = uneven.to_numpy(zero_copy_only=False)
        for k, at in enumerate(np.concatenate((np.flatnonzero(~odd), np.flatnonzero(odd))).tolist()):
            out[at] = np.append(flat[ends[k] : ends[k + 1]], np.int32(end_id))
        return out
