"""Long lists of the n-gram join: longer combinations and blocks of bounded size."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from symgraph.llm import ngramjoin

from .test_cases import brute_links


@pytest.mark.parametrize("percent, n", [(50, 1), (85, 2)])
def test_ngram_join_with_longer_combinations(spark, monkeypatch, percent, n):
    """Every list of more than three components is replaced by longer combinations, down to small blocks."""
    monkeypatch.setattr(ngramjoin.frequent_tokens, "__defaults__", (2, 1 << 20))
    for name, value in (("LONG", 3), ("HUB_ROUNDS", 1), ("BLOCK", 4), ("BLOCK_SIGNATURES", 2)):
        monkeypatch.setattr(ngramjoin, name, value)
    rng = random.Random(percent)
    passage = [f"p{k}" for k in range(30)]
    docs = []
    for _ in range(40):
        base = passage[: rng.randrange(5, 30)] + [f"w{rng.randrange(12)}" for _ in range(rng.randrange(0, 12))]
        for _ in range(rng.randrange(1, 4)):
            words = list(base)
            for _ in range(rng.randrange(0, 3)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(12)}"
            docs.append((len(docs), " ".join(words)))
    docs += [(len(docs) + k, text) for k, text in enumerate(("p0", "p0 p1", "p0 p1 p2", "p1 p2"))]
    got = ngramjoin.link_documents(spark.createDataFrame(docs, "doc_id long, text string"), n, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_links(docs, n, percent)


def test_ngram_join_splits_one_signature_of_many_unlinked_sets(spark, monkeypatch):
    """20,000 sets under one pair of n-grams, of which 200 are linked by twos: lists get short and no pair of those is lost."""
    monkeypatch.setattr(ngramjoin, "LONG", 1000)
    rng = np.random.default_rng(4)
    words = np.sort(rng.integers(1 << 20, 2**63, 400, dtype=np.int64))
    rows, want = [], set()
    for k in range(0, 20_000, 2):
        own = rng.choice(words[2:], 38, replace=False)
        near = own.copy() if k < 200 else rng.choice(words[2:], 38, replace=False)
        if k < 200:
            near[0] = k
            want.add((k, k + 1))
        rows += [(k + i, 40, np.sort(np.concatenate((words[:2], t)).view(np.uint64)).view(np.int64)) for i, t in enumerate((own, near))]
    schema = "sid long, n long, tokens array<long>, alone array<long>, sketch binary"
    sets = spark.createDataFrame([(s, n, t.tolist(), [], bytearray(ngramjoin.sketch(t.view(np.uint64)))) for s, n, t in rows], schema).repartition(8)
    # All are frequent, and the pair comes first by hash.
    classes = words, words[:0]
    sigs, parts = ngramjoin.named_signatures(rows[-1][2], words[:0], *classes, 85)[1]
    sig = sigs[(parts == words[:2]).all(axis=1)].item()
    split = sets.select(F.lit(sig).alias("sig"), F.lit(0).cast("long").alias("least"), F.lit(1).cast("long").alias("sigs"), "sid", F.col("sid").alias("comp"))
    shorter = ngramjoin.shortened(split, split.select("sid", "comp"), sets, classes, 85)
    assert shorter.where(F.col("sig") == sig).isEmpty()
    assert shorter.groupBy("sig").count().agg(F.max("count")).first()[0] <= 1000
    found = ngramjoin.verify(ngramjoin.block_pairs(shorter, sets, 85), sets, 85)
    assert {tuple(r) for r in found.collect()} == want


def test_ngram_join_blocks_hold_a_bounded_number_of_sets(spark, monkeypatch):
    """One component of 3,000 sets beside 40 others: none of its sets meet, and pairs with the others are all told."""
    monkeypatch.setattr(ngramjoin, "BLOCK", 64)
    sketch = bytearray(ngramjoin.sketch(np.arange(100, dtype=np.uint64)))
    held = spark.range(3040).select(F.col("id").alias("sid"), F.lit(100).cast("long").alias("n"), F.lit(sketch).alias("sketch"))
    comp = F.when(F.col("sid") < 3000, 0).otherwise(F.col("sid")).cast("long")
    split = held.select(F.lit(9).cast("long").alias("sig"), F.lit(0).cast("long").alias("least"), F.lit(1).cast("long").alias("sigs"), "sid", comp.alias("comp"))
    pairs = ngramjoin.block_pairs(split, held, 85).collect()
    assert len(pairs) == len(set(pairs)) == 3000 * 40 + 40 * 39 // 2
