"""Best rows without scoring all, and words near one another."""

import math
import random

from pyspark.sql import functions as F

from symgraph.operators import ranked, search
from symgraph.operators.search import Searcher, postings


def made(spark, rng, n):
    common, rare = ["the", "of", "and", "to"], ["zeal", "yarn", "xray"]
    texts = [" ".join(rng.choices(common, k=rng.randrange(1, 30)) + (rng.choices(rare, k=rng.randrange(1, 3)) if rng.random() < 0.03 else [])) for _ in range(n)]
    return texts, spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def test_best_rows_equal_those_of_scoring_all(spark):
    rng = random.Random(2)
    texts, rows = made(spark, rng, 2_000)
    found = ranked.Ranked(postings(rows, "id", ("text",)), "id", F.floor(F.col("id") / 16))
    split = [t.split() for t in texts]
    mean = sum(map(len, split)) / len(split)

    def score(words, d):
        total = 0.0
        for w in words:
            n, f = sum(w in t for t in split), split[d].count(w)
            idf = max(math.log((len(split) - n + 0.5) / (n + 0.5)), 0) or 1e-6
            total += idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(split[d]) / mean))
        return round(total, 6)

    for words, k in ((["zeal", "the"], 5), (["yarn", "xray", "zeal"], 20), (["of"], 3), (["none"], 4), (["zeal"], 1_000)):
        got, told = found.top(words, k, len(texts))
        every = sorted(((-score(words, d), d) for d in range(len(split)) if set(words) & set(split[d])))
        assert [(r["id"], round(r["score"], 6)) for r in got.collect()] == [(d, -s) for s, d in every[:k]], words
        if words == ["zeal", "the"]:
            assert told.skipped > 50 and told.blocks == 125


def test_near_against_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices("abcdefgh", k=rng.randrange(0, 25))) for _ in range(300)]
    rows = spark.createDataFrame([(k, t, t[::2]) for k, t in enumerate(texts)], "id long, text string, other string")
    finder = Searcher(rows, "id", ("text", "other"))
    for words, between in ((["a", "b", "c"], 3), (["d", "a"], 0), (["e"], 0), (["a", "nothing"], 9)):
        got = {(r["id"], r["col"]): r["least"] for r in ranked.search_near(finder, words, between).collect()}
        expected = {}
        for k, text in enumerate(texts):
            for col, t in (("text", text), ("other", text[::2])):
                t = t.split()
                widths = [j - i + 1 for i in range(len(t)) for j in range(i, len(t)) if set(words) <= set(t[i : j + 1])]
                if widths and min(widths) - len(words) <= between:
                    expected[k, col] = min(widths) - len(words)
        assert got == expected, words


def test_more_postings_are_sorted_in_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(search, "TASK_ROWS", 50, raising=False)
    rows = spark.createDataFrame([(k // 2, f"t{k} a") for k in range(400)], "id long, text string")
    post = postings(rows, "id", ("text",))
    laid, lengths = search.stored(post, "id")
    kept = ranked.Ranked(laid, "id", F.floor(F.col("id") / 16))
    for df in (laid, kept.rows):
        assert df.select(F.input_file_name()).distinct().count() > 8
    assert laid.count() == 800 and lengths.where("d <> 4").count() == 0 and kept.n_terms == 800
    assert kept.rows.where("d <> 4 OR f <> IF(term = 'a', 2, 1)").count() == 0 and kept.rows.count() == 600
