"""Building, refreshing, querying and exporting an index of a real tree."""

import io
import json
import os

import pytest

from symgraph import cli
from symgraph.operators import graph
from symgraph.operators.export import dot_rows, write_dot, write_json
from symgraph.operators.search import NotAQuery, parse, search_symbols
from symgraph.operators.snapshot import NoIndexError, build, open_index
from symgraph.plans import fixtures
from symgraph.scratch import shared_dir
from symgraph.service import Service, ToolError, TTLCache, serve
from symgraph.settings import load_settings, write_starter_config
from symgraph.streaming.reindex import keep_indexed


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, text in fixtures.SOURCES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    (root / "notes.md").write_text("no source")
    (root / "node_modules").mkdir()
    (root / "node_modules" / "x.js").write_text("function x() {}")
    settings = load_settings(str(root))
    with pytest.raises(NoIndexError):
        open_index(spark, settings.index_path)
    return root, settings, build(spark, settings)


def names(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_first_build(built, spark):
    _, _, report = built
    assert (report.files_scanned, report.files_changed, report.files_skipped, report.files_removed) == (13, 13, 0, 0)
    assert (report.symbols, report.calls, report.imports) == (len(fixtures.SYMBOLS), len(fixtures.CALLS), len(fixtures.IMPORTS))
    assert report.languages == {"go": 2, "java": 2, "javascript": 2, "python": 4, "rust": 2, "typescript": 1}


def test_queries_on_the_tree(built, spark):
    idx = open_index(spark, built[1].index_path)
    assert names(graph.callers(idx, "shop.price.rate"), "qualname") == [("shop.basket.Basket.total",), ("shop.price.reduced",)]
    assert names(graph.callees(idx, "make"), "callee", "target") == [("Basket", "shop.basket.Basket")]
    assert names(graph.deps(idx, "web/ui.ts"), "module", "target_path") == [("./dom", "web/dom.js"), ("./side", "")]
    assert names(graph.dependents(idx, "shop.price"), "path") == [("shop/basket.py",)]
    assert names(graph.impact(idx, "shop.price.rate", 3), "depth", "qualname") == [
        (1, "shop.basket.Basket.total"), (1, "shop.price.reduced"), (2, "main.run"),
    ]
    assert graph.callers(idx, "nothing").count() == graph.impact(idx, "nothing").count() == graph.deps(idx, "").count() == 0
    assert graph.stats(idx).first()["languages"]["python"] == 4


def test_search(built, spark):
    idx = open_index(spark, built[1].index_path)
    assert names(search_symbols(idx, "rate"), "qualname")[0] == ("shop.price.rate",)
    assert names(search_symbols(idx, "name:basket"), "qualname") == [("shop.basket.Basket",)]
    assert names(search_symbols(idx, "shop.basket.m"), "qualname") == [("shop.basket.make",)]  # no expression: substring
    assert search_symbols(idx, "  ").count() == 0


@pytest.mark.parametrize("text", ["pkg.cart", "c++", '"open', "foo:bar", "a-b", "a AND", "", "NOT a", "(a"])
def test_texts_that_are_no_expression(text):
    with pytest.raises(NotAQuery):
        parse(text, ("name",))


def test_service_and_protocol(built, spark):
    service = Service(spark, built[1])
    with pytest.raises(ToolError):
        service.call("callers", {})
    with pytest.raises(ToolError):
        service.call("callers", {"symbol": "unknown"})
    assert service.call("dependents", {"module": "unknown"}) == []
    asked = [
        {"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"},
        {"id": 3, "method": "tools/call", "params": {"name": "callers", "arguments": {"symbol": "make"}}},
        {"id": 4, "method": "tools/call", "params": {"name": "nope"}}, {"id": 5, "method": "nope"}, {"id": 6, "method": "ping"},
        {"id": 7, "method": "tools/call", "params": {"name": "impact", "arguments": {"symbol": "unknown"}}},
    ]
    out = io.StringIO()
    serve(service, io.StringIO("".join(json.dumps(a) + "\n" for a in asked) + "broken\n"), out)
    answers = {a["id"]: a for a in map(json.loads, out.getvalue().splitlines())}
    assert sorted(answers) == [1, 2, 3, 4, 5, 6, 7]
    assert len(answers[2]["result"]["tools"]) == 8
    assert json.loads(answers[3]["result"]["content"][1]["text"])[0]["qualname"] == "main.run"
    assert (answers[4]["error"]["code"], answers[5]["error"]["code"], answers[6]["result"]) == (-32602, -32601, {})
    assert answers[7]["result"]["isError"]


def test_exports(built, spark, tmp_path):
    idx = open_index(spark, built[1].index_path)
    write_json(idx, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json" / "symbols")).count() == len(fixtures.SYMBOLS)
    write_dot(idx, str(tmp_path / "dot"))
    lines = [r["line"] for r in dot_rows(idx).orderBy("section", "a", "b", "line").collect()]
    assert lines[0].startswith("digraph") and lines[-1] == "}" and any("style=dashed" in x for x in lines)


def test_command_line(built, capsys):
    root = str(built[0])
    assert cli.main(["callers", "make", "--root", root, "--json"]) == 0
    assert json.loads(capsys.readouterr().out)[0]["qualname"] == "main.run"
    assert cli.main(["callers", "unknown", "--root", root]) == 1
    assert cli.main(["status", "--root", root]) == 0
    assert cli.main(["status", "--root", root, "--index", root + "/none"]) == 1


def test_refresh(built, spark):
    root, settings, _ = built
    same = build(spark, settings)
    assert (same.files_changed, same.files_skipped, same.symbols, same.calls_relinked) == (0, 13, 0, 0)
    (root / "shop" / "price.py").write_text(fixtures.SOURCES["shop/price.py"] + "\n\ndef third(item):\n    return rate(item) / 3\n")
    (root / "web" / "pick.js").unlink()
    changed = build(spark, settings)
    assert (changed.files_changed, changed.files_skipped, changed.files_removed, changed.symbols) == (1, 11, 1, 3)
    assert changed.calls_relinked == 2  # those of the file that lost its import
    idx = open_index(spark, settings.index_path)
    assert names(graph.callers(idx, "shop.price.rate"), "qualname") == [("shop.basket.Basket.total",), ("shop.price.reduced",), ("shop.price.third",)]
    assert names(graph.deps(idx, "web/dom.js"), "module", "target_path")[0] == ("./pick", "")  # the target is gone
    again = build(spark, settings, force=True)
    assert again.files_changed == 12
    fresh = open_index(spark, settings.index_path)
    for name in ("symbols", "calls", "imports"):
        assert sorted(map(repr, getattr(fresh, name).collect())) == sorted(map(repr, getattr(idx, name).collect()))


def test_old_versions_and_scratch_tables_go(spark, tmp_path):
    (tmp_path / "a.py").write_text("def a():\n    pass\n")
    index_path = f"file://{tmp_path}/.symgraph/by-scheme"
    (tmp_path / "symgraph.json").write_text(json.dumps({"index_path": index_path}))
    settings = load_settings(str(tmp_path))
    assert settings.index_path == index_path
    scratch = os.path.join(shared_dir(spark), "symgraph")
    before = set(os.listdir(scratch)) if os.path.isdir(scratch) else set()
    kept = []
    for name in ("a", "b", "c"):
        (tmp_path / "a.py").write_text(f"def {name}():\n    pass\n")
        build(spark, settings)
        kept.append(open_index(spark, index_path))
    assert names(kept[-1].symbols, "qualname") == [("a.c",)] and names(kept[-2].symbols, "qualname") == [("a.b",)]
    left = os.listdir(tmp_path / ".symgraph" / "by-scheme")
    told = [json.loads(p.read_text()) for p in (tmp_path / ".symgraph" / "by-scheme" / "versions").iterdir() if not p.name.startswith(".")]
    assert len(told) == 2 and set(left) == {"versions", *(s["name"] for t in told for s in t["segments"])}
    assert set(os.listdir(scratch)) == before


def test_stream_indexes_arrivals(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    (root / "a.py").write_text("def a():\n    pass\n")
    settings = load_settings(str(root))
    keep_indexed(spark, settings, str(tmp_path / "state"), once=True).awaitTermination(120)
    assert names(open_index(spark, settings.index_path).symbols, "qualname") == [("a.a",)]


def test_settings(tmp_path, monkeypatch):
    path = write_starter_config(str(tmp_path))
    assert load_settings(str(tmp_path)).max_file_kb == 512
    path.write_text(json.dumps({"include": ["src"], "max_file_kb": -1, "engine": "odd", "language_map": {"pyx": "python"}}))
    settings = load_settings(str(tmp_path))
    assert (settings.include, settings.max_file_kb, settings.engine, settings.language_map) == (["src"], 512, "auto", {".pyx": "python"})
    monkeypatch.setenv("SYMGRAPH_MAX_FILE_KB", "7")
    assert load_settings(str(tmp_path)).max_file_kb == 7
    path.write_text(json.dumps({"include": "src"}))
    with pytest.raises(ValueError):
        load_settings(str(tmp_path))
    path.write_text(json.dumps({"language_map": {".x": "cobol"}}))
    with pytest.raises(ValueError):
        load_settings(str(tmp_path))


def test_cache(monkeypatch):
    now = [0.0]
    monkeypatch.setattr("symgraph.service.time.monotonic", lambda: now[0])
    cache = TTLCache(ttl=10, max_size=2)
    cache.put("a", [])
    cache.put("b", 1)
    assert cache.get("a") == []
    cache.put("c", 2)
    assert cache.get("a") is None and len(cache) == 2  # the first put goes first, however often it was read
    now[0] = 10.0
    assert cache.get("b") is None
