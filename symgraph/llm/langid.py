"""Language identification by nearest centroid over TF-IDF n-gram vectors.

A text becomes a vector of hashed byte n-grams (1 to 3 bytes of its
lower-cased UTF-8 form, digits and punctuation folded into separators),
weighted by TF-IDF and scaled to length one. Each language is stood for by
several centroids, found by spherical k-means over its training texts. The
language of the nearest centroid by cosine wins; a text farther from it than
almost all training texts of that language are from theirs is flagged as
rejected.

A model of up to ``MODEL_LANGS`` languages is broadcast whole. A larger one
stays a stored table, and texts are compared with one block of languages after
another, each carrying the best so far along with the row; the result is the
same, whatever the number of languages.

Cases: a null text or one without a letter is ``und`` with score 0. Without
any training text everything is ``und``. Texts are read whole, in slices of
bounded memory. Ties between centroids go to the language that sorts first.
Rows that repeat get equal results. An empty table gives no rows. Other columns
play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import numbered
from .common import bounded, cut, held_out, map_texts

#: About this many training texts per language are used.
TRAIN_ROWS_PER_LANG = 1_500
DIMS = 1 << 13
CENTROIDS = 4
#: Languages of a model, or block of one, that is broadcast: at most 32 MB of centroids.
MODEL_LANGS = 256
#: Blocks that are compared with in one pass over the rows.
BLOCKS_A_PASS = 8
#: How fast a language's odds fall with its cosine.
SHARPNESS = 30.0
ROUNDS = 8
#: This share of a language's training texts may lie beyond its rejection distance.
REJECT_SHARE = 0.005
SLICE = 1 << 20

# Bytes of letters stay; ASCII digits, punctuation and white space become one separator.
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:128][[not chr(c).isalpha() for c in range(128)]] = 32


def ngram_counts(text: str) -> np.ndarray:
    """Counts of hashed 1- to 3-grams of a text."""
    raw = _FOLD[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), dtype=np.uint8)]
    total = np.zeros(DIMS, dtype=np.float64)
    for at in range(0, max(1, len(raw) - 2), SLICE):
        piece = raw[at : at + SLICE + 2]
        piece = piece[np.concatenate(([True], (piece[1:] != 32) | (piece[:-1] != 32)))]
        codes = [piece, piece[:-1] * 257 + piece[1:] + 65_537, (piece[:-2] * 257 + piece[1:-1]) * 257 + piece[2:] + 16_777_259]
        for code in codes:
            mixed = (code * np.uint32(2_654_435_761)) >> np.uint32(19)
            total += np.bincount(mixed, minlength=DIMS)
    return total


def unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    vector = np.log1p(counts) * idf
    return vector / max(float(np.linalg.norm(vector)), 1e-12)


@dataclass
class LangModel:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    radius: np.ndarray

    def nearest(self, text: str | None) -> tuple[str, float, float, bool]:
        """(language, cosine, sum of all languages' odds against it, rejected); ``und`` for what has no language."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return "und", -1.0, 0.0, False
        cosines = self.centroids @ unit(ngram_counts(text), self.idf)
        at = int(np.argmax(cosines))
        best = np.full(len(self.langs), -1.0)
        np.maximum.at(best, self.owner, cosines)
        return self.langs[self.owner[at]], float(cosines[at]), float(np.exp((best - best.max()) * SHARPNESS).sum()), bool(cosines[at] < self.radius[at])

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)."""
        lang, _, odds, rejected = self.nearest(text)
        return lang, 1.0 / odds if odds else 0.0, rejected


@dataclass
class LargeModel:
    """Centroids as a stored table (lang, j, centre, radius, block), for more languages than one broadcast holds."""

    centres: DataFrame
    idf: np.ndarray
    blocks: int

    def block(self, number: int) -> LangModel:
        return small_model(self.centres.where(F.col("block") == number).orderBy("lang", "j").collect(), self.idf)


def spherical_kmeans(vectors: np.ndarray, k: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of length one and each vector's cosines to them; starts from evenly spaced vectors."""
    centres = vectors[np.unique(np.linspace(0, len(vectors) - 1, min(k, len(vectors))).astype(int))].copy()
    for _ in range(rounds):
        label = np.argmax(vectors @ centres.T, axis=1)
        for j in range(len(centres)):
            if (label == j).any():
                mean = vectors[label == j].mean(axis=0)
                centres[j] = mean / max(float(np.linalg.norm(mean)), 1e-12)
    return centres, vectors @ centres.T


def training_rows(docs: DataFrame, per_lang: int = TRAIN_ROWS_PER_LANG) -> DataFrame:
    """About ``per_lang`` texts of each language outside the held-out fold: (lang, text)."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    joined = known.select("doc_id", "lang", "text", F.monotonically_increasing_id().alias("__at")).join(bounded(cut(sizes, "lang-sizes")), "lang")
    # Rows are drawn one by one, equal ones by their place in the input, so that a sample is as small as it should be.
    point = F.pmod(F.xxhash64("doc_id", "text", "__at"), F.lit(1 << 20)) / float(1 << 20)
    return joined.where(point < per_lang / F.col("n")).select("lang", "text")


def small_model(found: list, idf: np.ndarray) -> LangModel:
    """A model of rows (lang, j, centre, radius) in order."""
    langs = sorted({r["lang"] for r in found})
    return LangModel(
        langs, idf,
        np.array([np.frombuffer(r["centre"], dtype=np.float32) for r in found]).reshape(len(found), DIMS),
        np.array([langs.index(r["lang"]) for r in found], dtype=int), np.array([r["radius"] for r in found]),
    )


def fit(docs: DataFrame, per_lang: int = TRAIN_ROWS_PER_LANG) -> LangModel | LargeModel:
    train = cut(training_rows(docs, per_lang), "lang-train")

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, n = np.zeros(DIMS), 0
        for pdf in batches:
            for text in pdf["text"]:
                seen += ngram_counts(text) > 0
                n += 1
        yield pd.DataFrame({"dim": np.append(np.arange(DIMS), -1), "n": np.append(seen, n)})

    df = np.zeros(DIMS + 1)
    for row in train.select("text").mapInPandas(frequencies, "dim int, n double").groupBy("dim").agg(F.sum("n").alias("n")).collect():
        df[row["dim"]] = row["n"]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1.0
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        vectors = np.array([unit(ngram_counts(t), shared.value) for t in sorted(pdf["text"])], dtype=np.float32)
        centres, cosines = spherical_kmeans(vectors, CENTROIDS)
        radius = float(np.quantile(cosines.max(axis=1), REJECT_SHARE))
        rows = [(pdf["lang"].iloc[0], j, c.astype(np.float32).tobytes(), radius) for j, c in enumerate(centres)]
        return pd.DataFrame(rows, columns=["lang", "j", "centre", "radius"])

    # A group holds one language's bounded training sample.
    centres = cut(train.groupBy("lang").applyInPandas(cluster, "lang string, j int, centre binary, radius double"), "lang-centres")
    langs = centres.select("lang").distinct()
    n = langs.count()
    if n <= MODEL_LANGS:
        return small_model(centres.orderBy("lang", "j").collect(), idf)
    placed = numbered(langs, "lang", name="at").select("lang", F.floor((F.col("at") - 1) / MODEL_LANGS).cast("int").alias("block"))
    return LargeModel(cut(centres.join(placed, "lang").repartitionByRange("block"), "lang-blocks"), idf, -(-n // MODEL_LANGS))


COLUMNS = {"lang_pred": ("string", pa.string()), "score": ("double", pa.float64()), "rejected": ("boolean", pa.bool_())}


_BEST = {"lang_pred": ("string", pa.string()), "cosine": ("double", pa.float64()), "odds": ("double", pa.float64()), "rejected": ("boolean", pa.bool_())}


def _by_blocks(docs: DataFrame, model: LargeModel) -> DataFrame:
    """(doc_id, lang_pred, score, rejected), block by block; ties go to the earlier one, whose languages sort first."""
    best = docs.select("doc_id", F.col("text").cast("string").alias("text"), *[F.lit(None).cast(kind).alias(f"b_{c}") for c, (kind, _) in _BEST.items()])
    for number in range(model.blocks):
        lookup = docs.sparkSession.sparkContext.broadcast(model.block(number))
        nearest = lambda texts, lookup=lookup: tuple(zip(*map(lookup.value.nearest, texts), strict=True)) or ([], [], [], [])
        both = map_texts(best, best.columns, _BEST, nearest)
        better = F.col("b_cosine").isNull() | (F.col("cosine") > F.col("b_cosine"))
        weight = lambda x, top: F.exp((F.col(x) - top) * SHARPNESS)
        top = F.greatest("cosine", "b_cosine")
        odds = F.col("odds") * weight("cosine", top) + F.coalesce(F.col("b_odds") * weight("b_cosine", top), F.lit(0.0))
        chosen = {c: F.when(better, F.col(c)).otherwise(F.col(f"b_{c}")) for c in ("lang_pred", "cosine", "rejected")} | {"odds": odds}
        best = both.select("doc_id", "text", *[chosen[c].alias(f"b_{c}") for c in _BEST])
        best = cut(best, "lang-best") if number % BLOCKS_A_PASS == BLOCKS_A_PASS - 1 else best
    score = F.when(F.col("b_odds") > 0, 1.0 / F.col("b_odds")).otherwise(F.lit(0.0))
    return best.select("doc_id", F.col("b_lang_pred").alias("lang_pred"), score.alias("score"), F.col("b_rejected").alias("rejected"))


def identify(docs: DataFrame, model: LangModel | LargeModel) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row of ``docs``."""
    if isinstance(model, LargeModel):
        return _by_blocks(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
    lookup = docs.sparkSession.sparkContext.broadcast(model)
    predict = lambda texts: tuple(zip(*map(lookup.value.predict, texts), strict=True)) or ([], [], [])
    scored = map_texts(docs, ["doc_id"], COLUMNS, predict)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
