"""Toxicity by maximum-scoring segment search over token log-odds.

Training counts, for every token, the toxic and clean labelled documents that
hold it. A token's toxic share is smoothed by a Dirichlet prior whose mean is
the share of its six-letter prefix, which in turn has the share of its
five-letter prefix as prior, and so on down to the share of all documents. So
an unseen inflection of a known insult inherits the score of its stem. A
token's score is its log-odds against the base rate less a drift, which makes
the expected score negative.

A linear scan then finds every maximal-scoring segment of a text. Segment
scores follow an extreme-value law: in n tokens, about K n exp(-lambda s)
segments reach score s by chance. Each segment's bits above that chance level
are summed, and the sum is calibrated to a probability on the training rows.

Cases: null and empty texts have no segment and get the lowest score. Null or
repeated labels are ignored beyond the first kept by ``max``; of rows that
repeat a labelled id one is learnt from. Marks belong to the letters that they
combine with, in every script. A corpus without
toxic or without clean labels gives a model under which nothing is toxic.
Rows that repeat get equal scores, and an empty table gives no rows. Texts are
scored whole. Of the input's columns those asked for pass through; a new column
gets underscores added to its name where it would clash with one of them.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut, held_out, map_texts, slices

#: At most about this many labelled documents are learnt from.
TRAIN_ROWS = 20_000
#: Tokens and prefixes found in fewer training documents than this say no more than the next shorter prefix.
LEAST_SUPPORT = 2
#: Scores of tokens that a worker remembers.
MEMO_TOKENS = 100_000
PREFIXES = (3, 4, 5, 6)
PRIOR = 4.0
DRIFT = 1.0
#: Segments with fewer expected chance occurrences than this in their text are significant.
MAX_CHANCE = 0.05
#: Letters, digits and the marks that combine with them; training and scoring take the same tokens.
TOKEN_RE = regex.compile(r"[\p{L}\p{N}\p{M}]+")


@dataclass
class ToxicityModel:
    """Scores by the hash of a token ("idiot") or prefix ("idio*"), and the calibration."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    default: float = -DRIFT
    lam: float = 1.0
    k: float = 0.1
    cut: float = math.inf
    memo: dict[str, float] = field(default_factory=dict)

    @staticmethod
    def hashes(names: Sequence[str]) -> np.ndarray:
        return np.fromiter((xxhash.xxh64_intdigest(n.encode("utf-8", "replace")) for n in names), np.uint64, len(names))

    def learn(self, names: pd.Series, scores: np.ndarray) -> None:
        keys = self.hashes(names)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], scores[order]

    def look_up(self, tokens: list[str]) -> np.ndarray:
        """The score of each token, or of its longest known prefix."""
        out, open_ = np.full(len(tokens), self.default), np.ones(len(tokens), dtype=bool)
        for n in (None, *reversed(PREFIXES)) if len(self.keys) else ():
            at = np.flatnonzero(open_)
            if n:
                at = at[[len(tokens[k]) >= n for k in at.tolist()]] if at.size else at
            found = self.hashes([tokens[k][:n] + "*" if n else tokens[k] for k in at.tolist()])
            place = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
            hit = self.keys[place] == found
            out[at[hit]], open_[at[hit]] = self.values[place[hit]], False
        return out

    def token_scores(self, tokens: list[str]) -> np.ndarray:
        new = [t for t in dict.fromkeys(tokens) if t not in self.memo]
        if len(new) + len(self.memo) > MEMO_TOKENS:
            self.memo.clear()
            new = list(dict.fromkeys(tokens))
        self.memo.update(zip(new, self.look_up(new).tolist(), strict=True))
        return np.fromiter(map(self.memo.__getitem__, tokens), np.float64, len(tokens))

    def probability(self, evidence: float) -> float:
        """0.5 at the calibrated cut; always finite."""
        if math.isinf(self.cut):
            return 0.0
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, evidence - self.cut))))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments as (start, end, score), in linear time.

    Candidates are kept on a stack with their left and right cumulative sums;
    a new candidate merges with the last one that starts lower and ends lower.
    Each has a link to the last one before it that starts lower. Where there is
    none, what is on the stack can merge with nothing more and is put out.
    """
    totals = np.concatenate(([0.0], np.cumsum(scores)))
    out: list[tuple[int, int, float, float, int]] = []
    stack: list[tuple[int, int, float, float, int]] = []
    for at in np.flatnonzero(scores > 0).tolist():
        start, end, left, right = at, at + 1, float(totals[at]), float(totals[at + 1])
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                break
            start, _, left, _, lower = stack[j]
            del stack[j:]
            j = lower
        if j < 0:
            out += stack
            stack.clear()
        stack.append((start, end, left, right, j))
    return [(s, e, r - x) for s, e, x, r, _ in out + stack]


def solve_lambda(values: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of sum(share * exp(lambda * value)) = 1."""
    low, high = 1e-6, 1.0
    f = lambda x: float(np.sum(shares * np.exp(np.minimum(x * values, 700.0)))) - 1.0
    while f(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return high


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Up to ``rows`` labelled documents outside the held-out fold: (doc_id, text, toxic)."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = bounded(cut(chosen.select(F.col("doc_id").alias("label_id"), "toxic"), "labels"))
    joined = docs.join(chosen, docs["doc_id"] == F.col("label_id")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic")
    # Of rows that repeat an id one is learnt from, so the bound holds for rows as well.
    return joined.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic"))


def tokens_by_label(train: DataFrame) -> DataFrame:
    """(token, toxic, n): how many texts of each label hold each token, one row or more for a token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in itertools.chain.from_iterable(slices(b, 0) for b in batches):
            seen: dict[tuple[str, int], int] = {}
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                for token in set(TOKEN_RE.findall(text.lower())):
                    seen[token, toxic] = seen.get((token, toxic), 0) + 1
            columns = [pa.array([t for t, _ in seen], pa.string()), pa.array([y for _, y in seen], pa.int64()), pa.array(seen.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["token", "toxic", "n"])

    return train.select("text", F.col("toxic").cast("long").alias("toxic")).mapInArrow(count, "token string, toxic long, n long")


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> ToxicityModel:
    train = cut(training_rows(docs, labels, rows), "toxic-train")
    n = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_toxic or not n_clean:
        return ToxicityModel()
    by_word = tokens_by_label(train).groupBy("token").agg(F.sum(F.col("toxic") * F.col("n")).alias("t"), F.sum("n").alias("n"))
    by_word = cut(by_word, "toxic-words")
    parts = [by_word.select("token", "t", "n")]
    parts += [
        by_word.where(F.length("token") >= k).groupBy(F.concat(F.substring("token", 1, k), F.lit("*")).alias("token")).agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
        for k in PREFIXES
    ]
    base = n_toxic / (n_toxic + n_clean)
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    # All of them reach the driver; the training rows bound them.
    kept = every.where(F.col("n") >= LEAST_SUPPORT).toArrow()
    names, toxic, held = kept["token"].to_pandas(), *(kept[c].to_numpy().astype(np.float64) for c in ("t", "n"))
    p = np.clip(smoothed_shares(names, toxic, held, base), 1e-4, 1 - 1e-4)
    model = ToxicityModel()
    model.learn(names, np.log(p / (1 - p)) - math.log(base / (1 - base)) - DRIFT)
    return calibrate(model, train)


def smoothed_shares(names: pd.Series, toxic: np.ndarray, held: np.ndarray, base: float) -> np.ndarray:
    """The toxic share of each token and prefix, smoothed by that of its longest shorter prefix, and so on down to ``base``."""
    places, is_prefix = pd.Index(names), names.str.endswith("*").to_numpy(dtype=bool)
    length = names.str.len().to_numpy() - is_prefix
    p = np.full(len(names), base)
    for k in PREFIXES:
        at = np.flatnonzero(length >= k + is_prefix)
        found = places.get_indexer(names.iloc[at].str[:k] + "*") if at.size else at
        known = found >= 0
        at, found = at[known], found[known]
        p[at] = (toxic[found] + PRIOR * p[at]) / (held[found] + PRIOR)
    return (toxic + PRIOR * p) / (held + PRIOR)


def calibrate(model: ToxicityModel, train: DataFrame) -> ToxicityModel:
    """Fit lambda, K and the decision cut on the training rows.

    Lambda makes the mean of exp(lambda * score) over clean tokens one. K is
    the likeliest one given the best segment of each clean row: by the law of
    extreme values a row of n tokens has none above s with probability
    exp(-K n exp(-lambda s)). Only sums and histograms reach the driver: token
    scores in steps of 0.05 on clean rows, and evidence in half-bit steps by
    label.
    """
    lookup = train.sparkSession.sparkContext.broadcast(model)

    def histogram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: dict[int, int] = {}
            for text in pdf["text"]:
                steps, n = np.unique(np.rint(lookup.value.token_scores(TOKEN_RE.findall(text.lower())) * 20).astype(int), return_counts=True)
                for step, times in zip(steps.tolist(), n.tolist(), strict=True):
                    seen[step] = seen.get(step, 0) + times
            yield pd.DataFrame({"step": list(seen), "n": list(seen.values())})

    clean = train.where("toxic = 0").select("text").mapInPandas(histogram, "step long, n long")
    found = clean.groupBy("step").agg(F.sum("n").alias("n")).collect()
    total = sum(r["n"] for r in found)
    if total:
        values, shares = np.array([r["step"] / 20 for r in found]), np.array([r["n"] / total for r in found])
        if (values > 0).any() and float(values @ shares) < 0:
            model.lam = min(4.0, solve_lambda(values, shares))
            model.k = fit_k(train.where("toxic = 0"), model)
    scored = segments(train, model, keep=["toxic"])
    steps = scored.groupBy("toxic", F.least(F.lit(400), F.floor(F.col("evidence") * 2)).alias("step")).agg(F.count("*").alias("n")).collect()
    best, model.cut = None, 0.25
    for at in range(0, 401):
        wrong = sum(r["n"] for r in steps if (r["step"] >= at) != bool(r["toxic"]))
        best, model.cut = (wrong, at / 2) if best is None or wrong <= best else (best, model.cut)
    # Move from the lowest score of the toxic side to the middle of the empty stretch below it.
    below = [r["step"] for r in steps if r["step"] < model.cut * 2]
    if below:
        model.cut = (model.cut + (max(below) + 1) / 2) / 2
    return model


def fit_k(clean: DataFrame, model: ToxicityModel) -> float:
    """The likeliest K: rows over the sum of n exp(-lambda s), for n tokens and best segment s of each row with a token."""
    lookup = clean.sparkSession.sparkContext.broadcast(model)

    def best(texts: list[str | None]) -> tuple[list[int], list[float]]:
        scored = [lookup.value.token_scores(TOKEN_RE.findall((t or "").lower())) for t in texts]
        return list(map(len, scored)), [max((x for _, _, x in maximal_segments(s)), default=0.0) for s in scored]

    rows = map_texts(clean, [], {"n": ("long", pa.int64()), "s": ("double", pa.float64())}, best).where("n > 0")
    n, total = rows.agg(F.count("*"), F.sum(F.col("n") * F.exp(-F.lit(model.lam) * F.col("s")))).first()
    return max(1e-3, n / total) if n else model.k


def score_text(text: str | None, model: ToxicityModel) -> tuple[float, list[tuple[int, int, float]]]:
    """Evidence of a text and its significant passages as character spans with their scores."""
    found = [(m.start(), m.end()) for m in TOKEN_RE.finditer(text or "")]
    if not found:
        return 0.0, []
    lowered = text.lower()
    same = len(lowered) == len(text)
    scores = model.token_scores([lowered[s:e] if same else text[s:e].lower() for s, e in found])
    chance = math.log(max(model.k * len(found), 1e-9) / MAX_CHANCE)
    spans, evidence = [], 0.0
    for start, end, score in maximal_segments(scores):
        bits = model.lam * score - chance
        if bits > 0:
            evidence += bits
            spans.append((found[start][0], found[end - 1][1], score))
    return evidence, spans


PASSAGE = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
COLUMNS = {
    "score": ("double", pa.float64()),
    "evidence": ("double", pa.float64()),
    "passages": ("array<struct<start:int,end:int,score:double>>", pa.list_(PASSAGE)),
}


def segments(docs: DataFrame, model: ToxicityModel, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with score, evidence and the significant toxic passages of each text."""
    lookup = docs.sparkSession.sparkContext.broadcast(model)

    def scan(texts: list[str | None]) -> tuple[list, list, list]:
        found = [score_text(text, lookup.value) for text in texts]
        passages = [[{"start": s, "end": e, "score": x} for s, e, x in spans] for _, spans in found]
        return [lookup.value.probability(e) for e, _ in found], [e for e, _ in found], passages

    return map_texts(docs, keep, COLUMNS, scan)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, held_out, score, predicted, passages) for every row of ``docs``."""
    scored = segments(docs, model, keep=["doc_id"])
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages"
    )
