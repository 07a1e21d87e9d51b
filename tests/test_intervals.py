"""Interval and as-of joins against plain loops."""

import random
import time

import pytest
from pyspark.sql import functions as F

from symgraph.operators import intervals


@pytest.mark.parametrize("inclusive", [False, True])
def test_next_at_most_over_many_blocks(spark, inclusive):
    rng = random.Random(3)
    rows = [(k % 3 // 2, rng.randrange(-1_000, 300_000), rng.randrange(0, 40)) for k in range(400)]
    rows += [(0, 299_990, -5), (7, 5, 1)]
    stops = spark.createDataFrame(rows, "k int, at long, level int")
    got = intervals.next_at_most(stops, stops, ["k"], "at", "level", "stop", inclusive).collect()
    for k, at, level, stop in got:
        later = [a for j, a, x in rows if j == k and x <= level and (a >= at if inclusive else a > at)]
        assert stop == min(later, default=None)
    assert len(got) == len(rows)
    assert intervals.next_at_most(stops, stops.where("false"), ["k"], "at", "level", "stop").where("stop IS NULL").count() == len(rows)


def test_enclosing_with_a_hot_key(spark):
    rng = random.Random(4)
    spans = [(k % 4 // 3, s, s + rng.choice([-1, 0, 3, 17, 900, 40_000]), f"s{k}") for k, s in enumerate(rng.randrange(0, 50_000) for _ in range(300))]
    points = [(k % 4 // 3, rng.randrange(-5, 60_000)) for k in range(300)] + [(9, 1)]
    found = intervals.enclosing(spark.createDataFrame(points, "k int, at long"), spark.createDataFrame(spans, "k int, first long, last long, v string"), ["k"], "at", "first", "last", "v", "found").collect()
    assert len(found) == len(points)
    for k, at, v in found:
        around = [(s, x) for j, s, e, x in spans if j == k and s <= at <= e]
        assert v == (max(around)[1] if around else None)
    none = intervals.enclosing(spark.createDataFrame(points, "k int, at long"), spark.createDataFrame([], "k int, first long, last long, v string"), ["k"], "at", "first", "last", "v", "found")
    assert none.where("found IS NULL").count() == len(points)


def by_task(df):
    """Rows of each of the tasks that a cut table was written by."""
    return [n for (n,) in df.groupBy("__task").agg({"*": "count"}).select("count(1)").collect()]


@pytest.fixture
def many_tasks(spark):
    """So many tasks that a hot key is cut, and none of them joined again."""
    held = {"spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed", [1, 2])
def test_enclosing_over_many_tasks_against_brute_force(spark, many_tasks, seed):
    rng = random.Random(seed)
    key = lambda: rng.choice(["hot"] * 6 + ["a", None])
    spans = [(key(), s, s + rng.choice([-1, 0, 3, 40, 400]), rng.randrange(5)) for s in (rng.randrange(400) for _ in range(300))] + [("hot", 0, 500, 9), ("hot", 5, None, 1)]
    points = [(key(), rng.choice([rng.randrange(420), None]), k) for k in range(400)]
    got = intervals.enclosing(
        spark.createDataFrame(points, "key string, at int, n int"), spark.createDataFrame(spans, "key string, first int, last int, v int"),
        ["key"], "at", "first", "last", "v", "inner",
    ).collect()

    def inner(k, at):
        held = [(s, v) for kk, s, e, v in spans if kk == k and k is not None and at is not None and e is not None and s <= at <= e]
        return max(held)[1] if held else None

    assert sorted((r["n"], r["inner"]) for r in got) == [(n, inner(k, at)) for k, at, n in points]


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_before_over_many_tasks_against_brute_force(spark, many_tasks, monkeypatch, seed):
    rng = random.Random(seed)
    key = lambda: rng.choice(["hot"] * 6 + ["a", None])
    marks = [(key(), rng.randrange(3_000), rng.randrange(9)) for _ in range(60)] + [("b", 5, None)]
    rows = [(key(), rng.randrange(3_000), k) for k in range(1_500)] + [("b", 5, -1), ("b", 6, -2), ("c", 1, -3)]
    cuts = []
    monkeypatch.setattr(intervals, "cut", lambda df, name, cut=intervals.cut: cuts.append(cut(df, name)) or cuts[-1])
    got = intervals.nearest_before(
        spark.createDataFrame(rows, "key string, at int, n int"), spark.createDataFrame(marks, "key string, at int, v int"), ["key"], "at", "v", "mark"
    ).collect()

    def last(k, at):
        held = [(a, -1 if v is None else v) for kk, a, v in marks if kk == k and a < at]
        return (None if max(held)[1] == -1 else max(held)[1]) if held else None

    assert sorted((r["n"], repr(r["mark"])) for r in got) == sorted((n, repr(last(k, at))) for k, at, n in rows)
    tasks = by_task(cuts[0])
    assert len(tasks) >= 8 and max(tasks) <= 2 * sorted(tasks)[len(tasks) // 2]


def test_places_under_very_many_spans(spark):
    """40,000 places under 4,000 spans each: work grows with events, not with pairs."""
    spans = spark.range(8_000).selectExpr("1 AS key", "id * 5 AS first", "id * 5 + 20000 AS last", "id AS v")
    points = spark.range(40_000).selectExpr("1 AS key", "id AS at")
    began = time.monotonic()
    got = intervals.enclosing(points, spans, ["key"], "at", "first", "last", "v", "inner")
    assert got.where("inner <> at div 5").count() == 0 and got.where("inner IS NULL").count() == 0
    assert time.monotonic() - began < 60


def test_covering_blocks(spark):
    row = spark.sql("SELECT 3 AS a, 13 AS b").select(intervals.covering_blocks(F.col("a"), F.col("b")).alias("x")).first()["x"]
    held = sorted(t for level, place in row for t in range(place << level, (place + 1) << level))
    assert held == list(range(3, 13)) and len(row) <= 6
