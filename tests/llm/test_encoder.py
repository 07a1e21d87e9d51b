"""The encoder asks the library for little, and gives the ids of whole texts."""

import random
import zlib

import numpy as np
import pyarrow as pa

from symgraph.llm import rangecoder
from symgraph.llm.tokens import Encoder, vocabulary

BITS = ["a", "B", "é", "ɏ", "ɐ", "'s", "'", "'ll", "S", " ", "  ", "\n", "\r\n", " \n", " ", "　", "\x1c", "\x0b", "1", "٣", ",", ".", "|", "中", "。", "\x00", "<|endoftext|>", "´", "ª", "ʰ", "́", "🙂", "~", "[", "×"]


class Counted:
    """A tokenizer that counts the characters it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.seen = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.seen += sum(map(len, texts))
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_words_are_encoded_once_whatever_marks_follow_them():
    encoder = Encoder(vocabulary("byte_bpe_50k.json"))
    plain = encoder.tokenizer
    encoder.tokenizer = Counted(plain)
    words = [f"w{'abcdefghij'[k // 10]}{'klmnopqrst'[k % 10]}é" for k in range(100)]
    marks = ["", ",", ".", "!!", "###", "'s", "?\nThe", ";", ":", "\nof"]
    text = "x " + " ".join(w + m for m in marks for w in words)
    ids = encoder.encode([text, None, text], 7)
    assert [x.tolist() for x in ids] == [[*plain.encode(text, add_special_tokens=False).ids, 7], [7], ids[0].tolist()]
    assert encoder.tokenizer.seen < 1_000
    encoder.encode([text], 7)
    assert encoder.tokenizer.seen < 1_000


def test_ids_are_those_of_whole_texts():
    encoder, rng = Encoder(vocabulary("byte_bpe_50k.json")), random.Random(3)
    for _ in range(5):
        texts = ["".join(rng.choice(BITS[: rng.choice([9, 17, len(BITS)])]) for _ in range(rng.randint(0, 40))) for _ in range(1_000)]
        found = encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        assert [x.tolist() for x in encoder.encode(texts, 7)] == [[*e.ids, 7] for e in found]


def test_batches_without_texts_or_with_odd_ones_alone():
    encoder = Encoder(vocabulary("byte_bpe_50k.json"))
    odd = ["a  b", " ", "x "]
    assert encoder.encode([], 7) == [] and encoder.encode([None], 7)[0].tolist() == [7]
    for texts in (odd, pa.array(odd, pa.large_string()), pa.array(["y", *odd])[1:]):
        assert [x.tolist() for x in encoder.encode(texts, 7)] == [[*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 7] for t in odd]


def test_frames_have_the_bytes_they_had():
    ids = np.arange(40_000) * np.arange(40_000) % 1_009 + 70_000 * (np.arange(40_000) % 97 == 0)
    frame = rangecoder.pack_frame(ids)
    assert (len(frame), zlib.crc32(frame)) == (6_780, 3_823_321_326)
    assert (rangecoder.unpack_frame(frame) == ids).all()
