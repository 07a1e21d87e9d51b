"""Best rows for a bag of words by BM25, without scoring every row that holds one of them.

Rows fall into blocks by their keys. For every term and block the greatest part
that the term gives to any row's score there is stored. The sum of these over
the words asked for bounds every score in a block, so once a few promising
blocks have been scored, those whose bound lies below the k-th best score hold
nothing that could matter and are skipped. The result is that of scoring all.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import cut
from .search import K1, LEAST_IDF, B, tasks_for

#: Scores are rounded to so many digits, and equal ones go by key.
DIGITS = 6
#: Blocks that are scored first.
FIRST_BLOCKS = 8


@dataclass(frozen=True)
class Told:
    """How many blocks hold any of the words, and how many of them were scored."""

    blocks: int
    scored: int

    @property
    def skipped(self) -> int:
        return self.blocks - self.scored


def _part(f: Column, d: Column, mean: Column) -> Column:
    """What a term found f times in a row of d terms gives to its score, but for the term's rarity."""
    return f * (K1 + 1) / (f + K1 * (1 - B + B * d / mean))


class Ranked:
    """Stored counts of (term, block, key), and a bound for each term and block."""

    def __init__(self, post: DataFrame, key: str, block_of: Column, name: str = "ranked"):
        """``post`` are :func:`search.postings`; ``block_of`` is a row's block, told by its key."""
        self.key = key
        tasks = tasks_for(post)
        # By key, so that counts and lengths need one shuffle.
        counted = post.select(key, "term").repartition(tasks, key).groupBy(key, "term").agg(F.count("*").alias("f"))
        counted = cut(counted.withColumn("d", F.sum("f").over(Window.partitionBy(key))), f"{name}-counts")
        self.n_terms = counted.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
        rows = counted.withColumn("block", block_of)
        self.rows = cut(rows.repartitionByRange(tasks, "term", "block", key).sortWithinPartitions("term", "block", key), f"{name}-rows")
        # Parts grow with f and fall with d, whatever the mean length is; pairs that no other beats in both bound the block.
        shape = self.rows.groupBy("term", "block").agg(F.count("*").alias("n"), F.max("f").alias("most_f"), F.min("d").alias("least_d"))
        self.blocks = cut(shape.repartitionByRange("term", "block").sortWithinPartitions("term", "block"), f"{name}-blocks")

    def top(self, words: list[str], k: int, n_rows: int) -> tuple[DataFrame, Told]:
        """(key, score) of the ``k`` rows with the greatest scores among those that hold any of the words, of ``n_rows`` in all."""
        mean = F.lit(self.n_terms / max(n_rows, 1))
        asked = sorted(set(words))
        held = self.blocks.where(F.col("term").isin(asked))
        counts = {r["term"]: r["n"] for r in held.groupBy("term").agg(F.sum("n").alias("n")).collect()}
        rare = lambda n: F.ln((F.lit(n_rows) - F.lit(n) + 0.5) / (F.lit(n) + 0.5))
        idf = F.lit(0.0)
        for term, n in counts.items():
            idf = F.when(F.col("term") == term, F.when(rare(n) > 0, rare(n)).otherwise(F.lit(LEAST_IDF))).otherwise(idf)
        # A little more than the bound, since sums are rounded.
        bound = F.sum(idf * _part(F.col("most_f"), F.col("least_d"), mean)) + 10.0**-DIGITS
        bounds = cut(held.groupBy("block").agg(bound.alias("bound")), "ranked-bounds")

        def best(rows: DataFrame) -> DataFrame:
            scored = rows.groupBy(self.key).agg(F.round(F.sum(idf * _part(F.col("f"), F.col("d"), mean)), DIGITS).alias("score"))
            return scored.orderBy(F.desc("score"), self.key).limit(k)

        mine = self.rows.where(F.col("term").isin(asked))
        first = [r["block"] for r in bounds.orderBy(F.desc("bound"), "block").limit(FIRST_BLOCKS).collect()]
        found = cut(best(mine.where(F.col("block").isin(first))), "ranked-first")
        least = found.agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
        left = bounds.where(~F.col("block").isin(first))
        if least["n"] >= k:
            left = left.where(F.col("bound") >= least["least"])
        left = cut(left.select("block"), "ranked-left")
        told = Told(bounds.count(), len(first) + left.count())
        more = best(mine.join(left, "block", "left_semi"))
        return found.unionByName(more).orderBy(F.desc("score"), self.key).limit(k), told


def near(post: DataFrame, key: str, words: list[str], between: int) -> DataFrame:
    """(key, col, least): rows in which all words stand in one column with at most ``between`` other terms from the first to the last.

    ``least`` is the least number of terms that lie between them, of any order.
    A row's places of all words are merged in order; each place completes a
    window with the last places of the other words. Repeated words count once.
    """
    asked = sorted(set(words))
    which = F.array_position(F.array(*map(F.lit, asked)), F.col("term")).cast("int")
    held = post.where(F.col("term").isin(asked)).select(key, "col", F.struct("pos", which.alias("w")).alias("at"))
    rows = held.groupBy(key, "col").agg(F.sort_array(F.collect_set("at")).alias("places")).where(F.size("places") >= len(asked))
    far = F.lit(None).cast("int")
    start = F.struct(F.array(*[far] * len(asked)).alias("last"), far.alias("least"))

    def step(acc: Column, place: Column) -> Column:
        last = F.transform(acc["last"], lambda old, i: F.when(i + 1 == place["w"], place["pos"]).otherwise(old))
        whole = ~F.exists(last, lambda p: p.isNull())
        width = place["pos"] - F.array_min(last) + 1 - len(asked)
        return F.struct(last.alias("last"), F.when(whole, F.least(acc["least"], width)).otherwise(acc["least"]).alias("least"))

    least = F.aggregate("places", start, step, lambda acc: acc["least"])
    return rows.select(key, "col", least.alias("least")).where(F.col("least") <= between)


def search_near(finder, words: list[str], between: int) -> DataFrame:
    """:func:`near` over a searcher's postings, read by term."""
    post = reduce(DataFrame.unionByName, [finder.occurrences(w, False).select(finder.key, "col", "term", "pos") for w in sorted(set(words))])
    return near(post, finder.key, words, between)
