"""Segments, keyed lookups, commits, and links settled anew after changes."""

import os
import random

import pytest
from pyspark.sql import functions as F

from symgraph.operators import graph, store as stores
from symgraph.operators.relink import link_all, relink, search_tables
from symgraph.operators.search import search_symbols
from symgraph.operators.snapshot import build, open_index
from symgraph.operators.store import CommitConflict, Store, commit, merged, new_segment, next_version, prune, versions, write_segment
from symgraph.schemas import STORED
from symgraph.scratch import cut
from symgraph.settings import load_settings
from symgraph.sources import files as sources


def rows(df, *columns):
    return sorted(map(repr, df.select(*columns or df.columns).collect()))


def leaf(df):
    """The scan of a plan that has run: its text, and how many files it read."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.collectToPython()
    scan = plan.collectLeaves().head()
    return scan.toString(), scan.metrics().apply("numFiles").value()


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """A segment whose layouts have many files."""
    base = str(tmp_path_factory.mktemp("wide"))
    calls = spark.range(4_000).selectExpr(
        "id % 50 AS caller_id", "'c' AS caller_name", "concat('m.f', id % 97) AS callee", "IF(id % 3 = 0, 7, id % 1000) AS callee_id",
        "id % 10 AS file_id", "CAST(id AS INT) AS line", "concat('f', id % 97) AS name",
    )
    held = pytest.MonkeyPatch()
    held.setattr(stores, "FILE_ROWS", 100)
    segment = write_segment(spark, base, new_segment(0), {"calls": cut(calls, "wide")}, {}, small=False)
    held.undo()
    return Store(spark, base, {"version": 1, "segments": [segment]}), calls


def test_lookups_read_only_files_that_may_hold_their_keys(wide):
    store, calls = wide
    found = store.get("calls", "callee_id", [501])
    text, n_files = leaf(found)
    assert "EqualTo(callee_id,501)" in text and n_files == 1
    assert leaf(store.rows("calls", "callee_id"))[1] >= 40
    assert rows(found) == rows(calls.where("callee_id = 501"), *found.columns)
    hot = store.get("calls", "callee_id", [7])  # a key over many files
    assert leaf(hot)[1] > 10 and rows(hot) == rows(calls.where("callee_id = 7"), *hot.columns)
    several = store.get("calls", "name", ["f3", "f96", "none"])
    assert rows(several) == rows(calls.where("name IN ('f3', 'f96')"), *several.columns)
    begins = store.get("calls", "name", ["f9"], prefix=True)
    assert rows(begins) == rows(calls.where("name LIKE 'f9%'"), *begins.columns)
    assert store.get("calls", "callee_id", [5_000]).count() == store.get("calls", "callee_id", []).count() == 0


def test_graph_queries_push_their_literal(wide, spark):
    store, _ = wide
    idx = graph.Index.of(store)
    _, n_files = leaf(idx.get("calls", "callee_id", 501))
    assert n_files == 1 and idx.get("calls", "callee_id", None).count() == 0


def test_search_over_segments_with_deletions_equals_a_fresh_index(spark, tmp_path):
    """Four segments, each with files that replace or delete older ones, and what merging makes of them."""
    rng, base, now = random.Random(4), str(tmp_path), {}
    told = {"version": 0, "segments": [], "next_file": 1}
    vocabulary = ["alpha", "beta", "gamma", "Delta", "x_1", "naïve"]
    for number in range(4):
        changed = {f: [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 5))) for _ in range(rng.randrange(1, 5))] for f in rng.sample(range(1, 9), 4)}
        gone = [f for f in now if f not in changed and rng.random() < 0.3]
        dead = [f for f in now if f in changed or f in gone]
        now = {f: t for f, t in now.items() if f not in gone} | changed
        symbols = lambda held: spark.createDataFrame(
            [(f * 100 + k, f, "function", t.split()[0], f"m{f}.{t.split()[0]}", "", k, k, "", t) for f, ts in held.items() for k, t in enumerate(ts)], STORED["symbols"]
        )
        files = lambda held: spark.createDataFrame([(f, f"m{f}.py", "python", f"m{f}", 1, 1, "", 1, None) for f in held], STORED["files"])
        made = {"files": files(changed), "symbols": symbols(changed), **search_tables(symbols(changed))}
        touched = spark.createDataFrame([(f,) for f in dead], "file_id long")
        segment = write_segment(spark, base, new_segment(number), made, {t: touched for t in made}, small=number % 2 == 0)
        n_terms = search_tables(symbols(now))["lengths"].agg(F.sum("d")).first()[0]
        told = next_version(Store(spark, base, told), [*told["segments"], segment], n_symbols=symbols(now).count(), n_terms=n_terms)
    store = Store(spark, base, told)
    assert len(store.segments) == 4 and rows(store.rows("symbols")) == rows(symbols(now), *store.rows("symbols").columns)
    plain = graph.Index(files(now), symbols(now), *[spark.createDataFrame([], STORED[t]) for t in ("calls", "imports")])
    stored = graph.Index.of(store)
    for text in ("alpha", "gam*", '"alpha beta"', "beta NOT gamma", "delta OR x_1", "ta ga", "a-", "doc:naive", "ALPHA%GAM"):
        assert [tuple(r) for r in search_symbols(stored, text, -1).collect()] == [tuple(r) for r in search_symbols(plain, text, -1).collect()], text
    both, kept, dead = merged(Store(spark, base, told | {"segments": told["segments"][:3]}), 1, told["segments"][3])
    whole = write_segment(spark, base, new_segment(9), kept, dead, small=True)
    again = Store(spark, base, told | {"segments": [told["segments"][0], whole]})
    for t in ("symbols", "postings", "lengths", "grams"):
        assert rows(again.rows(t)) == rows(store.rows(t))


LANGS = {"py": "python", "js": "javascript", "go": "go"}


def random_file(rng, path):
    """Symbols, calls and imports of one made-up file."""
    suffix = path.rpartition(".")[2]
    module = path.removesuffix(".py").replace("/", ".") if suffix == "py" else path.rpartition(".")[0]
    module = module.removesuffix(".__init__") if suffix == "py" else rng.choice(["one", "two"]) if suffix == "go" else module
    names = rng.choices("abcdefgh", k=rng.randrange(0, 4))
    symbols = [(f"{module}.{n}", n, k + 1) for k, n in enumerate(names)]
    callers = [q for q, _, _ in symbols] + [""]
    calls = [(rng.choice(callers), rng.choice(["a", "b", "x.c", "d", "p.q.a", "pkg.m1.b", "gone"]), k + 1) for k in range(rng.randrange(0, 5))]
    imports = []
    for k in range(rng.randrange(0, 3)):
        if suffix == "py":
            imports.append(rng.choice([("pkg", ["m1", "m2"]), ("pkg.m1", ["a"]), (".m2", ["b"]), (".", ["m3"]), ("m4", [])]) + (k + 1,))
        elif suffix == "js":
            imports.append((rng.choice(["./j1", "./j2.js", "../pkg/j1"]), [], k + 1))
        else:
            imports.append(("pkg", [], k + 1))
    return module, symbols, calls, imports


def test_relinking_equals_linking_everything(spark, tmp_path):
    """Random edits: what is stored after each equals all links settled anew, with the same ids."""
    rng, base = random.Random(11), str(tmp_path)
    paths = [f"pkg/{n}.{s}" for n, s in [("__init__", "py"), ("m1", "py"), ("m2", "py"), ("m3", "py"), ("j1", "js"), ("j2", "js"), ("g1", "go"), ("g2", "go")]] + ["m4.py", "top.js", "g3.go"]
    told, held, ids, next_id = {"version": 0, "segments": [], "next_file": 1}, {}, {}, 1

    def tables(of):
        files = [(ids[p], p, LANGS[p.rpartition(".")[2]], of[p][0], 1, 1, "", 1, None) for p in of]
        symbols = [(ids[p] * (1 << 20) + k, ids[p], "function", n, q, "", line, line, "", "") for p in of for k, (q, n, line) in enumerate(of[p][1])]
        calls = [(ids[p], who, what, line, what.rpartition(".")[2]) for p in of for who, what, line in of[p][2]]
        imports = [(ids[p], m, names, "import", line) for p in of for m, names, line in of[p][3]]
        schemas = (STORED["files"], STORED["symbols"], "file_id long, caller_name string, callee string, line int, name string", "file_id long, module string, names array<string>, kind string, line int")
        return dict(zip(("files", "symbols", "calls", "imports"), [spark.createDataFrame(r, s) for r, s in zip((files, symbols, calls, imports), schemas, strict=True)], strict=True))

    for number in range(4):
        changed = {p: random_file(rng, p) for p in (rng.sample(paths, 8) if not number else rng.sample(paths, 2))}
        gone = [p for p in held if p not in changed and number and rng.random() < 0.2]
        touched = [ids[p] for p in (*changed, *gone) if p in held]
        for p in changed:
            if p not in held:
                ids[p], next_id = next_id, next_id + 1
        held = {p: v for p, v in held.items() if p not in gone} | changed
        store = Store(spark, base, told)
        made, dead = relink(store, tables(changed), spark.createDataFrame([(t,) for t in touched], "file_id long"))
        segment = write_segment(spark, base, new_segment(number), made, dead, small=number != 0)
        told = next_version(store, [*store.segments, segment])
        now, whole = Store(spark, base, told), tables(held)
        calls, imports = link_all(whole["files"], whole["symbols"], whole["calls"], whole["imports"])
        assert rows(now.rows("calls")) == rows(calls, *now.rows("calls").columns)
        assert rows(now.rows("imports")) == rows(imports, *now.rows("imports").columns)
    assert any("NULL" not in r and "callee_id=None" not in r for r in rows(now.rows("calls"), "callee_id"))


def test_one_of_two_builders_wins(spark, tmp_path):
    base = f"{tmp_path}/index"
    told = {"version": 1, "segments": [], "next_file": 1}
    commit(spark, base, told)
    with pytest.raises(CommitConflict):
        commit(spark, base, told | {"next_file": 5})
    assert versions(spark, base) == [1] and stores.describe(spark, base, 1) == told
    # A segment begun from a kept version may belong to a running builder; one begun before all of them does not.
    for name in ("s-000000000000-old", "s-000000000001-held", "s-000000000002-running"):
        os.makedirs(f"{base}/{name}")
    for number in (2, 3):
        commit(spark, base, told | {"version": number, "segments": [{"name": "s-000000000001-held"}] if number == 2 else []})
    prune(spark, base)
    assert versions(spark, base) == [3, 2]
    assert sorted(n for n in os.listdir(base) if n.startswith("s-")) == ["s-000000000001-held", "s-000000000002-running"]


def test_trees_are_listed_in_rounds(spark, tmp_path, monkeypatch):
    deep = tmp_path / "one" / "deep" / "folder"
    expected = set()
    for k in range(12):
        for j in range(3):
            path = deep / f"d{k}" / f"e{j}" / "a.py"
            path.parent.mkdir(parents=True)
            path.write_text("x = 1\n")
            expected.add(str(path.relative_to(tmp_path)))
    (deep / "skip").mkdir()
    (deep / "skip" / "b.py").write_text("")
    (deep / "big.py").write_text("y" * 100)
    for at_once in (5_000, 1):
        monkeypatch.setattr(sources, "LISTED_AT_ONCE", at_once)
        found = sources.list_tree(spark, str(tmp_path), ["^skip$"], [".py"], 50).collect()
        assert {r["path"] for r in found} == expected and all(r["size"] == 6 and r["mtime"] > 0 and r["listed"] for r in found)


def test_files_that_cannot_be_read_keep_their_rows(spark, tmp_path):
    (tmp_path / "a.py").write_text("def a():\n    b()\n")
    (tmp_path / "b.py").write_text("def b():\n    pass\n")
    for name in ("a.py", "b.py"):
        os.utime(tmp_path / name, (1_600_000_000, 1_600_000_000))
    settings = load_settings(str(tmp_path))
    first = build(spark, settings)
    assert (first.files_read, first.files_changed) == (2, 2)
    idle = build(spark, settings)  # nothing changed, so nothing is read
    assert (idle.files_scanned, idle.files_read, idle.files_changed, idle.files_skipped) == (2, 0, 0, 2)
    before = rows(open_index(spark, settings.index_path).symbols)
    (tmp_path / "b.py").unlink()
    (tmp_path / "b.py").symlink_to("/proc/self/mem")  # can be opened, but not read
    held = build(spark, settings)
    assert (held.files_unreadable, held.files_removed, held.files_changed) == (1, 0, 0)
    idx = open_index(spark, settings.index_path)
    assert rows(idx.symbols) == before and graph.callers(idx, "b").count() == 1
