"""Exact top-k inner-product search by term-at-a-time accumulation.

Queries and candidates are dealt into blocks of bounded size, and each pair of
blocks is one group. Within a group every query row scatters its weighted
terms, one after the other, through the candidates' postings into a dense
array of scores; a partial selection keeps the k best. The last step merges
each query's selections from all candidate blocks.

Cases: a vector that is null, empty or holds a null or non-finite component
takes no part. Missing trailing components count as zero. Equal scores go to
the smaller id; rows that repeat an id are separate candidates, but a query
never meets a row with its own id. Scores wrap like 64-bit integers. Empty
tables give no rows. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERY_BLOCK = 16_384
CANDIDATE_BLOCK = 16_384
SCALE = 256


def integer_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, terms): valid vectors with each component x turned into floor(256 * x)."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    terms = F.transform(vector, lambda x: F.floor(F.lit(SCALE) * x.cast("double")))
    return rows.where(F.col(vec_id).isNotNull() & (F.size(vector) > 0) & finite).select(F.col(vec_id).cast("long").alias("id"), terms.alias("terms"))


def dense(terms: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(terms), width), dtype=np.int64)
    for k, t in enumerate(terms):
        out[k, : len(t)] = t
    return out


def accumulate(query: np.ndarray, postings: list[tuple[np.ndarray | None, np.ndarray]], scores: np.ndarray) -> np.ndarray:
    """Scatter a sparse query's weighted postings into ``scores``."""
    scores[:] = 0
    for term in np.flatnonzero(query).tolist():
        rows, weights = postings[term]
        if rows is None:
            scores += query[term] * weights
        else:
            scores[rows] += query[term] * weights
    return scores


def select_best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores, ties to the smaller id."""
    if len(scores) > k:
        bound = np.partition(scores, len(scores) - k)[len(scores) - k]
        over, level = np.flatnonzero(scores > bound), np.flatnonzero(scores == bound)
        need = k - len(over)
        if len(level) > need:
            level = level[np.argpartition(ids[level], need - 1)[:need]]
        at = np.concatenate((over, level))
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))]


def search_block(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    width = max([0, *map(len, queries["terms"]), *map(len, candidates["terms"])])
    table, ids = dense(candidates["terms"], width), candidates["id"].to_numpy()
    postings: list[tuple[np.ndarray | None, np.ndarray]] = []
    for term in range(width):
        rows = np.flatnonzero(table[:, term])
        # A term that most rows hold is stored without row numbers.
        postings.append((None, table[:, term].copy()) if 2 * len(rows) > len(table) else (rows, table[rows, term]))
    del table
    scores = np.zeros(len(ids), dtype=np.int64)
    found = []
    for own, query in zip(queries["id"].to_numpy(), dense(queries["terms"], width), strict=True):
        accumulate(query, postings, scores)
        others = np.flatnonzero(ids != own)
        best = others[select_best(scores[others], ids[others], k)]
        found.append(pd.DataFrame({"query_id": own, "vec_id": ids[best], "score": scores[best]}))
    return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) for (id, terms) frames; exact."""
    query_blocks = -(-max(1, queries.count()) // query_block)
    candidate_blocks = -(-max(1, candidates.count()) // candidate_block)

    def dealt(rows: DataFrame, own: str, own_blocks: int, other: str, other_blocks: int) -> DataFrame:
        # The place in the input takes part, so that rows that repeat are dealt out too; it is read before rows are copied.
        at = F.pmod(F.xxhash64("id", "terms", F.monotonically_increasing_id()), F.lit(own_blocks)).cast("int").alias(own)
        return rows.select("id", "terms", at).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_blocks - 1))))

    left = dealt(queries, "qb", query_blocks, "cb", candidate_blocks).groupBy("qb", "cb")
    right = dealt(candidates, "cb", candidate_blocks, "qb", query_blocks).groupBy("qb", "cb")
    local = left.cogroup(right).applyInPandas(lambda q, c: search_block(q, c, k), "query_id long, vec_id long, score long")

    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("v")))), 1, k)
    # A query has k rows for each block of candidates, so its list is short.
    merged = local.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("at", "hit"))
    return merged.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.v").alias("vec_id"), (-F.col("hit.s")).alias("score"))


def brute_force(rows: Iterator[tuple[int, list[int]]], every: int, k: int) -> list[tuple[int, int, int, int]]:
    """Reference for tests."""
    rows = list(rows)
    out = []
    for q, x in rows:
        if q % every == 0:
            hits = sorted((-sum(a * b for a, b in zip(x, y, strict=False)), v) for v, y in rows if v != q)[:k]
            out += [(q, r + 1, v, -s) for r, (s, v) in enumerate(hits)]
    return out
