"""What queries write and send grows no faster than their tables."""

import os
import random
import time

from pyspark.sql import functions as F

from symgraph.operators import export, intervals, resolve
from symgraph.plans import standin
from symgraph.scratch import cut, shared_dir, temporary
from symgraph.plans.queries import QUERIES


def test_few_held_names_answer_many_calls(spark, monkeypatch):
    """20 files that ask for 200 names each reach 40 files that hold one of them each: 40 names are fetched, not 200 sent 40 times."""
    asked = spark.range(4_000).selectExpr("id % 20 AS file_id", "concat('x.f', id DIV 20) AS callee", "concat('f', id DIV 20) AS name")
    held = spark.range(4_000).selectExpr("100 + id % 40 AS file_id", "concat('f', IF(id < 40, 0, id DIV 40)) AS name", "1L AS n", "id AS pick").where("pick < 40")
    reach = spark.range(800).selectExpr("id % 20 AS file_id", "100 + id DIV 20 AS reach")
    monkeypatch.setattr(resolve, "HELD_BY_MANY", 5)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = resolve._over_reach(asked, held, reach, "name")
        assert sorted(map(tuple, found.collect())) == [(f, "x.f0", 40, 0) for f in range(20)]
        again = resolve._over_reach(asked, held, reach, "name")
        plan = again._jdf.queryExecution().executedPlan()
        again._jdf.collectToPython()
        most, left = 0, [plan]
        while left:
            node = left.pop()
            left += [node.children().apply(k) for k in range(node.children().size())]
            if "Join" in node.nodeName() and node.metrics().contains("numOutputRows"):
                most = max(most, node.metrics().apply("numOutputRows").value())
        assert most <= 4_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def sent(spark):
    """Bytes that shuffles of this application have written so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    return context.statusStore().executorList(True).apply(0).totalShuffleWrite()


def tables(spark):
    folder = os.path.join(shared_dir(spark), "symgraph")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_resolving_sends_calls_once(spark):
    """Where no table is small enough to be sent whole, calls are sent to their answers once, and texts but a few times."""
    n = 60_000
    files = spark.range(300).selectExpr("id", "'python' AS lang", "concat('nation.supplier_number_', id) AS module")
    symbols = spark.range(6_000).selectExpr("id", "id % 300 AS file_id", "concat('name_', id % 64) AS name", "concat('nation.supplier_number_', id % 300, '.name_', id) AS qualname")
    callee = "CASE id % 3 WHEN 0 THEN concat('nation.supplier_number_', id * 7 % 300, '.name_', id * 7 % 6000) WHEN 1 THEN concat('obj.name_', id % 64) ELSE concat('ext', id % 1000) END"
    calls = spark.range(n).selectExpr("id % 300 AS file_id", "concat('nation.supplier_number_', id % 300, '.name_', id % 6000) AS caller_name", "CAST(id AS INT) AS line", f"{callee} AS callee")
    reach = spark.range(3_000).selectExpr("id % 300 AS file_id", "id * 11 % 300 AS reach").distinct()
    given = [cut(df, "given") for df in (calls, symbols, files, reach)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = sent(spark)
        given[0].repartition("file_id").foreach(lambda row: None)
        once = sent(spark) - before
        before, kept = sent(spark), tables(spark)
        found = resolve.resolve_calls(*given)
        assert {t.rsplit("-", 1)[0] for t in tables(spark) - kept} == {"resolve-best", "resolve-callers"}
        found.foreach(lambda row: None)
        assert sent(spark) - before < 6 * once
        assert tuple(found.agg(F.count("*"), F.count("caller_id")).first()) == (n, n)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def shuffle_files(spark):
    folder = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()[0]
    return {f for _, _, names in os.walk(folder) for f in names if f.startswith("shuffle_") and f.endswith(".data")}


def test_shuffles_of_stored_tables_go(spark):
    held = shuffle_files(spark)
    stored = cut(spark.range(1_000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")), "grouped")
    for _ in range(100):
        if not (left := shuffle_files(spark) - held):
            break
        time.sleep(0.1)
    assert not left and stored.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_tables_that_last(spark):
    before = tables(spark)
    with temporary(spark) as lasting:
        gone = cut(spark.range(3), "gone")
        kept = lasting(gone, "kept")
    assert {t.split("-")[0] for t in tables(spark) - before} == {"kept"} and kept.count() == 3


def plainly(calls, symbols, files, reach):
    """The six rules one call at a time."""
    lang, module = {f[0]: f[1] for f in files}, {f[0]: f[2] for f in files}
    found = []
    for file, caller, line, callee in calls:
        name = (callee or "").rsplit("::", 1)[-1].rsplit(".", 1)[-1]
        rules = [[], [], [], [], [], []]
        for i, f, n, q in symbols:
            near, other = f == file, (file, f) in reach
            kin = f != file and lang[file] in resolve.FAMILIES and module[file] is not None and module[f] == module[file]
            for rule, fits in enumerate((near and q == callee, near and n == name, other and q == callee, other and n == name, kin and n == name, n == name)):
                if fits:
                    rules[rule].append(i)
        chosen = [min(ids) for rule, ids in enumerate(rules) if name and (ids if rule in (0, 2) else len(ids) == 1)]
        callers = [i for i, f, _, q in symbols if f == file and q == caller]
        found.append((file, caller, line, callee, chosen[0] if chosen else None, min(callers, default=None)))
    return found


def test_the_six_rules_one_by_one(spark, monkeypatch):
    """Random symbols whose names are held by one file, a few and many, against every rule in turn."""
    monkeypatch.setattr(resolve, "HELD_BY_MANY", 3)
    draw = random.Random(5)
    files = [(f, draw.choice(["python", "java", "go"]), draw.choice(["a", "b", "c", None])) for f in range(12)]
    names = ["x", "y", "z", *(f"n{k}" for k in range(30))]
    symbols = [(100 + i, draw.randrange(12), n := draw.choice([*names, *"xyz"]), draw.choice([n, f"m.{n}", f"m.{draw.choice('xyz')}", f"k::{n}"])) for i in range(90)]
    texts = [*names, *(f"obj.{n}" for n in names), *(s[3] for s in symbols), "", "m.", "none", None]
    calls = [(draw.randrange(12), draw.choice([s[3] for s in symbols] + ["", None]), k, draw.choice([*texts, *"xyz"])) for k in range(1_500)]
    reach = {(draw.randrange(12), draw.randrange(12)) for _ in range(30)}
    made = resolve.resolve_calls(
        spark.createDataFrame(calls, "file_id long, caller_name string, line int, callee string"), spark.createDataFrame(symbols, "id long, file_id long, name string, qualname string"),
        spark.createDataFrame(files, "id long, lang string, module string"), spark.createDataFrame(sorted(reach), "file_id long, reach long"),
    )
    expected = plainly(calls, symbols, files, reach)
    assert sorted(map(repr, map(tuple, made.select("file_id", "caller_name", "line", "callee", "callee_id", "caller_id").collect()))) == sorted(map(repr, expected))


def test_raw_calls_are_those_of_the_view(spark, sf_dir):
    made = standin.view(spark, sf_dir, "raw_calls")
    told = spark.sql(standin.VIEWS["raw_calls"])
    assert made.schema.simpleString() == told.schema.simpleString()
    assert made.exceptAll(told).count() == told.exceptAll(made).count() == 0


def laid_out(index):
    store = index.store
    folder = f"{store.base}/{store.segments[0]['name']}"
    return sorted(f"{t}/{k}" for t in (os.listdir(folder) if os.path.isdir(folder) else []) if os.path.isdir(f"{folder}/{t}") for k in os.listdir(f"{folder}/{t}"))


def test_queries_write_only_the_layouts_they_ask_for(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(standin, "_STORED", {})
    QUERIES["first_by_id"](spark, sf_dir).collect()
    assert laid_out(standin.index(spark, sf_dir)) == []
    QUERIES["callees"](spark, sf_dir).collect()
    assert [x for x in laid_out(standin.index(spark, sf_dir)) if x.startswith(("calls", "imports", "grams", "postings"))] == ["calls/by_caller_id"]


def test_export_rows_are_not_sorted(spark, sf_dir):
    index = standin.index(spark, sf_dir)
    assert "Sort " not in export.json_rows(index)._jdf.queryExecution().optimizedPlan().toString()
    paths = [r["path"] for r in export.json_sections(index)["files"].collect()]
    assert paths == sorted(paths)


def test_more_events_are_swept_by_more_tasks(spark, monkeypatch):
    swept, plain = [], intervals.cut
    monkeypatch.setattr(intervals, "TASK_EVENTS", 100, raising=False)
    monkeypatch.setattr(intervals, "cut", lambda df, name: swept.append(plain(df, name)) or swept[-1] if name == "swept" else plain(df, name))
    points = spark.range(2_000).selectExpr("id % 3 AS k", "id AS at")
    spans = spark.range(2_000).selectExpr("id % 3 AS k", "id AS first", "id + id % 50 AS last", "id AS value")
    found = intervals.enclosing(points, spans, ["k"], "at", "first", "last", "value", "found")
    expected = points.alias("p").join(spans.alias("s"), F.expr("p.k = s.k AND p.at BETWEEN s.first AND s.last")).groupBy("p.k", "p.at").agg(F.max("s.value").alias("found"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))
    assert swept[0].select("__task").distinct().count() >= 40
