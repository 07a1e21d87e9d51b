"""The registered queries of the engine, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import languages as L
from ..functions import text as X
from ..operators import export, graph, intervals, ranked, relink, resolve, scan, snapshot
from ..operators.search import Searcher, parse, postings, search_symbols, stored
from ..scratch import cut, numbered
from ..settings import DEFAULT_EXCLUDES
from ..sources.files import excluded, included
from . import sources
from .standin import index, once, view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The symbol and the files that graph queries ask about.
SYMBOL, MODULE = 7, 3


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _name(idx: graph.Index, number: int, field: str = "qualname") -> str:
    return idx.get("symbols", "id", number).select(field).first()[0]


def _file(idx: graph.Index, number: int, field: str = "path") -> str:
    return idx.get("files", "id", number).select(field).first()[0]


# ---------------------------------------------------------------- graph queries

_CALLERS = """
SELECT s.qualname, s.kind, f.path, s.start_line AS symbol_line, f.path || ':' || CAST(c.line AS VARCHAR) AS call_site, c.callee, c.line
FROM calls c JOIN symbols s ON s.id = c.caller_id JOIN files f ON f.id = c.file_id
WHERE c.callee_id = {symbol} ORDER BY 1, 7, 3, 6 {limit}
"""


@query("callers", with_views(_CALLERS.format(symbol=SYMBOL, limit="LIMIT 100"), "symbols", "calls"))
def callers(spark, sf_dir):
    idx = index(spark, sf_dir)
    return graph.callers(idx, _name(idx, SYMBOL))


_UNIQUE = "(SELECT min(id) FROM symbols WHERE name IN (SELECT name FROM symbols GROUP BY name HAVING count(*) = 1) AND id IN (SELECT callee_id FROM calls))"


@query("callers_by_name", with_views(_CALLERS.format(symbol=_UNIQUE, limit=""), "symbols", "calls"))
def callers_by_name(spark, sf_dir):
    idx = index(spark, sf_dir)
    unique = idx.symbols.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1")
    called = unique.join(idx.calls.select(F.col("callee_id").alias("id")).distinct(), "id", "left_semi")
    first = called.agg(F.min_by("name", "id")).first()[0]
    return graph.callers(idx, first, limit=None)


@query("callees", with_views("""
SELECT c.callee, c.callee_id, c.callee_id IS NOT NULL AS resolved, coalesce(s.qualname, '') AS target, f.path, c.line
FROM calls c JOIN files f ON f.id = c.file_id LEFT JOIN symbols s ON s.id = c.callee_id
WHERE c.caller_id = 7 ORDER BY 1, 6, 5, 4 LIMIT 100""", "symbols", "calls"))
def callees(spark, sf_dir):
    idx = index(spark, sf_dir)
    return graph.callees(idx, _name(idx, SYMBOL))


@query("deps", with_views("""
SELECT i.module, i.kind, coalesce(f.path, '') AS target_path, i.line FROM imports i LEFT JOIN files f ON f.id = i.target_id
WHERE i.file_id = 3 ORDER BY 4, 1, 3, 2 LIMIT 200""", "imports"))
def deps(spark, sf_dir):
    idx = index(spark, sf_dir)
    return graph.deps(idx, _file(idx, MODULE))


_DEPENDENTS = """
, t AS (SELECT id, module, regexp_extract(module, '^(.*)\\.[^.]*$', 1) AS base, regexp_extract(module, '[^.]*$') AS leaf FROM files WHERE id = 3),
whole AS (SELECT f.path, i.module, i.line FROM imports i JOIN files f ON f.id = i.file_id JOIN t ON i.target_id = t.id),
member AS (
  SELECT f.path, i.module, i.line, row_number() OVER (PARTITION BY f.path ORDER BY i.line, i.module) AS r
  FROM imports i JOIN files f ON f.id = i.file_id JOIN t ON list_contains(i.names, t.leaf)
  WHERE i.module = t.base OR (i.module[1:1] = '.' AND starts_with(f.module, t.base))
), both_passes AS (
  SELECT 0 AS pass, * FROM whole UNION ALL
  SELECT 1, path, module, line FROM member WHERE r = 1 AND path NOT IN (SELECT path FROM whole)
)
SELECT path, module, line FROM both_passes ORDER BY pass, path, line, module {limit}
"""


@query("dependents", with_views(_DEPENDENTS.format(limit="LIMIT 200"), "imports").replace(")\n\n, t AS", "),\nt AS"))
def dependents(spark, sf_dir):
    idx = index(spark, sf_dir)
    return graph.dependents(idx, _file(idx, MODULE))


@query("dependents_member", with_views(_DEPENDENTS.format(limit=""), "imports").replace(")\n\n, t AS", "),\nt AS"))
def dependents_member(spark, sf_dir):
    idx = index(spark, sf_dir)
    return graph.dependents(idx, _file(idx, MODULE, "module"), limit=-1)


_IMPACT = """
, walk AS (
  SELECT caller_id AS id, 1 AS depth FROM calls WHERE callee_id = 7
  UNION SELECT c.caller_id, w.depth + 1 FROM walk w JOIN calls c ON c.callee_id = w.id WHERE w.depth < {depth}
), least AS (SELECT id, min(depth) AS depth FROM walk WHERE id <> 7 OR depth = 1 GROUP BY id)
SELECT CAST(l.depth AS INTEGER) AS depth, s.qualname, s.kind, f.path
FROM least l JOIN symbols s ON s.id = l.id JOIN files f ON f.id = s.file_id ORDER BY 1, 2, 4, 3 {limit}
"""


def _impact(depth: int, limit: int | None):
    def run(spark, sf_dir):
        idx = index(spark, sf_dir)
        return graph.impact(idx, _name(idx, SYMBOL), depth, limit)

    return run


for _depth in (1, 2, 3):
    query(f"impact_d{_depth}", with_views(_IMPACT.format(depth=_depth, limit=""), "symbols", "calls").replace(")\n\n, walk AS", "),\nwalk AS"))(_impact(_depth, None))
query("impact_top", with_views(_IMPACT.format(depth=3, limit="LIMIT 200"), "symbols", "calls").replace(")\n\n, walk AS", "),\nwalk AS"))(_impact(3, 200))


@query("stats", with_views("""
SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM calls) AS calls,
  (SELECT count(callee_id) FROM calls) AS calls_resolved, (SELECT count(*) - count(callee_id) FROM calls) AS calls_unresolved,
  (SELECT count(*) FROM imports) AS imports, (SELECT count(target_id) FROM imports) AS imports_resolved,
  (SELECT count(*) - count(target_id) FROM imports) AS imports_unresolved, '/standin' AS root, '2024-01-01T00:00:00+00:00' AS last_indexed""", "symbols", "calls", "imports"))
def stats(spark, sf_dir):
    return graph.stats(index(spark, sf_dir)).drop("languages")


@query("stats_languages", with_views("SELECT lang, count(*) AS n FROM files GROUP BY lang ORDER BY lang"))
def stats_languages(spark, sf_dir):
    return graph.languages(index(spark, sf_dir))


@query("unique_names", with_views("SELECT name, min(id) AS id FROM symbols GROUP BY name HAVING count(*) = 1", "symbols"))
def unique_names(spark, sf_dir):
    counted = index(spark, sf_dir).symbols.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    return counted.where("n = 1").select("name", "id")


@query("first_by_id", with_views("SELECT name, min(id) AS id, arg_min(qualname, id) AS qualname FROM symbols GROUP BY name", "symbols"))
def first_by_id(spark, sf_dir):
    return index(spark, sf_dir).symbols.groupBy("name").agg(F.min("id").alias("id"), F.min_by("qualname", "id").alias("qualname"))


# ---------------------------------------------------------------- resolution

_REACH = """reach AS (
  SELECT DISTINCT file_id, target_id AS reach FROM imports WHERE target_id IS NOT NULL
  UNION
  SELECT DISTINCT i.file_id, m.id FROM (SELECT file_id, module || '.' || unnest(names) AS full_name FROM imports) i
  JOIN (SELECT module, min(id) AS id FROM files GROUP BY module) m ON m.module = i.full_name OR m.module = i.full_name || '.__init__'
)"""


@query("reachable_files", with_views("SELECT file_id, reach FROM reach", "imports").replace("\nSELECT file_id, reach", ",\n" + _REACH + "\nSELECT file_id, reach"))
def reachable_files(spark, sf_dir):
    idx = index(spark, sf_dir)
    return resolve.reachable_files(idx.imports, idx.files)


_RULES = """, asked AS (SELECT DISTINCT r.file_id, r.callee, regexp_extract(r.callee, '[^.]*$') AS name, f.lang, f.module FROM raw_calls r JOIN files f ON f.id = r.file_id),
placed AS (SELECT s.*, f.module FROM symbols s JOIN files f ON f.id = s.file_id),
rules AS (
  SELECT a.file_id, a.callee, 1 AS p, min(s.id) AS pick FROM asked a JOIN symbols s ON s.file_id = a.file_id AND s.qualname = a.callee GROUP BY ALL
  UNION ALL
  SELECT a.file_id, a.callee, 2, min(s.id) FROM asked a JOIN symbols s ON s.file_id = a.file_id AND s.name = a.name GROUP BY ALL HAVING count(*) = 1
  UNION ALL
  SELECT a.file_id, a.callee, 3, min(s.id) FROM asked a JOIN reach r ON r.file_id = a.file_id JOIN symbols s ON s.file_id = r.reach AND s.qualname = a.callee GROUP BY ALL
  UNION ALL
  SELECT a.file_id, a.callee, 4, min(s.id) FROM asked a JOIN reach r ON r.file_id = a.file_id JOIN symbols s ON s.file_id = r.reach AND s.name = a.name GROUP BY ALL HAVING count(*) = 1
  UNION ALL
  SELECT a.file_id, a.callee, 5, min(s.id) FROM asked a JOIN placed s ON s.module = a.module AND s.file_id <> a.file_id AND s.name = a.name
  WHERE a.lang IN ('java', 'go', 'javascript', 'typescript') GROUP BY ALL HAVING count(*) = 1
  UNION ALL
  SELECT a.file_id, a.callee, 6, min(s.id) FROM asked a JOIN symbols s ON s.name = a.name GROUP BY ALL HAVING count(*) = 1
), best AS (SELECT file_id, callee, arg_min(pick, p) AS callee_id FROM rules GROUP BY ALL)
SELECT c.file_id, c.caller_name, c.line, c.callee, b.callee_id, w.caller_id FROM raw_calls c
LEFT JOIN best b ON b.file_id = c.file_id AND b.callee = c.callee
LEFT JOIN (SELECT file_id, qualname, min(id) AS caller_id FROM symbols GROUP BY ALL) w ON w.file_id = c.file_id AND w.qualname = c.caller_name"""


@query("resolve_calls", with_views(_RULES, "symbols", "imports", "raw_calls").replace(")\n, asked AS", "),\n" + _REACH + ",\nasked AS"))
def resolve_calls(spark, sf_dir):
    idx = index(spark, sf_dir)
    calls = view(spark, sf_dir, "raw_calls")
    found = resolve.resolve_calls(calls, idx.symbols, idx.files, resolve.reachable_files(idx.imports, idx.files))
    return found.select("file_id", "caller_name", "line", "callee", "callee_id", "caller_id")


@query("resolve_imports", with_views("""
SELECT i.id, i.file_id, i.module, (
  SELECT arg_min(t.id, k.p) FROM files o, files t, (SELECT unnest([1, 2]) AS p) k
  WHERE o.id = i.file_id AND o.lang = 'python'
    AND t.path = CASE k.p WHEN 1 THEN o.dir || '/' || replace(i.module, '.', '/') || '.py' ELSE replace(i.module, '.', '/') || '.py' END
) AS target_id FROM imports i""", "imports").replace("FROM files o,", "FROM (SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM files) o,"))
def resolve_imports(spark, sf_dir):
    idx = index(spark, sf_dir)
    return resolve.resolve_imports(view(spark, sf_dir, "imports"), idx.files).select("id", "file_id", "module", "target_id")


# ---------------------------------------------------------------- maintenance

@query("snapshot_diff", """
WITH before AS (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS digest FROM documents WHERE doc_id % 5 <> 0),
now AS (SELECT doc_id, sha256(text) AS digest FROM documents WHERE doc_id % 11 <> 0)
SELECT coalesce(b.doc_id, n.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed'
  WHEN b.digest = n.digest THEN 'same' ELSE 'changed' END AS status
FROM before b FULL JOIN now n ON b.doc_id = n.doc_id""")
def snapshot_diff(spark, sf_dir):
    """Two made-up versions of the documents: the older lacks every fifth and differs in every seventh, the newer lacks every eleventh."""
    docs = table(spark, sf_dir, "documents")
    older = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    before = docs.where("doc_id % 5 <> 0").select("doc_id", F.sha2(older, 256).alias("digest"))
    now = docs.where("doc_id % 11 <> 0").select("doc_id", F.sha2("text", 256).alias("digest"))
    return snapshot.diff(before, now, key="doc_id")


@query("snapshot_merge", """
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'new' ELSE 'old' END AS origin, length(text) AS n FROM documents WHERE doc_id % 11 <> 0""")
def snapshot_merge(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = lambda df, origin: df.select("doc_id", F.lit(origin).alias("origin"), F.length("text").cast("long").alias("n"))
    fresh = rows(docs.where("doc_id % 7 = 0 AND doc_id % 11 <> 0"), "new")
    return snapshot.merge(rows(docs, "old"), fresh, docs.where("doc_id % 7 <> 0 AND doc_id % 11 <> 0").select("doc_id"), key="doc_id")


# ---------------------------------------------------------------- text operators

@query("line_split", """
SELECT doc_id, CAST(i AS INTEGER) AS line, l AS text FROM (
  SELECT doc_id, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS i FROM (
    SELECT doc_id, CASE WHEN text[-1:] = chr(10) THEN string_split(text[:-2], chr(10)) ELSE string_split(text, chr(10)) END AS ls FROM documents WHERE text <> ''))""")
def line_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text <> ''")
    return docs.select("doc_id", F.posexplode(X.lines(F.col("text"))).alias("at", "text")).select("doc_id", (F.col("at") + 1).alias("line"), "text")


@query("line_counts", """
SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) + CASE WHEN text[-1:] = chr(10) THEN 0 ELSE 1 END AS INTEGER) AS n_lines,
  sha256(text) AS digest FROM documents WHERE text <> ''""")
def line_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text <> ''")
    return docs.select("doc_id", X.line_count(F.col("text")).alias("n_lines"), F.sha2("text", 256).alias("digest"))


_CHAIN = r"([A-Za-z_$][A-Za-z0-9_$]*(?:(?:::|\.)[A-Za-z_$][A-Za-z0-9_$]*)*)\s*\("


@query("call_sites", f"SELECT page_id, unnest(regexp_extract_all(html, '{_CHAIN}', 1)) AS callee FROM pages")
def call_sites(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(X.call_sites(F.col("html"))).alias("callee"))


_KEYWORDS = ", ".join(f"('{lang}', '{w}')" for lang in sorted(L.NOT_CALLS) for w in sorted(L.NOT_CALLS[lang]))
_LANGS = ", ".join(f"('{lang}')" for lang in sorted(L.NOT_CALLS))


@query("keyword_filter", f"""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z_]+')) AS callee FROM documents),
k AS (SELECT * FROM (VALUES {_KEYWORDS}) v(lang, word))
SELECT l.lang, w.callee || CASE WHEN length(w.callee) % 2 = 0 THEN '.x' ELSE '' END AS callee
FROM w, (VALUES {_LANGS}) l(lang) WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.lang = l.lang AND k.word = w.callee)""")
def keyword_filter(spark, sf_dir):
    """The words of all documents as call targets in every language, half of them as heads of a chain."""
    found = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z_]+"), F.lit(0))).alias("w")).distinct()
    rows = found.select(F.explode(F.array(*map(F.lit, sorted(L.NOT_CALLS)))).alias("lang"), F.concat("w", F.when(F.length("w") % 2 == 0, ".x").otherwise("")).alias("callee"))
    return rows.where(X.is_call(F.col("callee"), F.col("lang")))


@query("import_links", r"""
SELECT page_id, m AS href FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS m FROM pages)""")
def import_links(spark, sf_dir):
    found = scan.located(table(spark, sf_dir, "pages"), ["page_id"], r'href="([^"]+)"', "html")
    return found.select("page_id", F.regexp_extract("match", r'href="([^"]+)"', 1).alias("href"))


@query("located_links", r"""
WITH p AS (SELECT page_id, html, regexp_extract_all(html, 'href="[^"]+"') AS ms, string_split_regex(html, 'href="[^"]+"') AS gs FROM pages),
e AS (SELECT page_id, k, ms[k] AS match, list_sum(list_transform(gs[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:k-1], lambda g: length(g))), 0) AS o, html
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM p))
SELECT page_id, match, CAST(o AS INTEGER) AS "offset", CAST(1 + len(html[1:o]) - len(replace(html[1:o], chr(10), '')) AS INTEGER) AS line FROM e""")
def located_links(spark, sf_dir):
    return scan.located(table(spark, sf_dir, "pages"), ["page_id"], r'href="[^"]+"', "html")


@query("module_ids", r"""
SELECT page_id, path, replace(regexp_replace(regexp_replace(path, '([^/])\.[^./]+$', '\1'), '(^|/)__init__$', ''), '/', '.') AS module FROM (
  SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*/', '') || CASE page_id % 3 WHEN 0 THEN '/__init__.py' ELSE '.py' END AS path FROM pages)""")
def module_ids(spark, sf_dir):
    end = F.when(F.col("page_id") % 3 == 0, "/__init__.py").otherwise(".py")
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_replace("url", "^[a-z]+://[^/]*/", ""), end).alias("path"))
    return pages.select("page_id", "path", L.module_id(F.col("path"), F.lit("python"), F.lit("")).alias("module"))


@query("path_normalize", r"""
SELECT page_id, CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN path WHEN 2 THEN 'up/' || path ELSE path || '/last' END AS folded
FROM (SELECT page_id, rtrim(regexp_replace(url, '^[a-z]+://', ''), '/') AS path FROM pages)""")
def path_normalize(spark, sf_dir):
    """Addresses with steps to here and up put in, which fold to known ones."""
    path = F.regexp_replace("url", "^[a-z]+://", "")
    steps = [F.concat(F.lit("a/../../"), path), F.concat(F.lit("./x/../"), path), F.concat(F.lit("up//./"), path, F.lit("/y/..")), F.concat(path, F.lit("/a/b/../../last/."))]
    made = F.element_at(F.array(*steps), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", X.normalize_path(made).alias("folded"))


@query("last_segments", with_views(
    "SELECT DISTINCT callee, regexp_extract(callee, '[^.]*$') AS name FROM raw_calls", "symbols", "raw_calls"))
def last_segments(spark, sf_dir):
    return view(spark, sf_dir, "raw_calls").select("callee", X.last_segment(F.col("callee")).alias("name")).distinct()


@query("include_exclude_filter", r"""
SELECT page_id, path FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages)
WHERE NOT regexp_matches(path, '(^|/)[^/]*1(/|$)') AND (regexp_matches(path, '^.*[02468]$'))""")
def include_exclude_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    return pages.where(~excluded(F.col("path"), ["*1", *DEFAULT_EXCLUDES]) & included(F.col("path"), ["*[02468]"]))


@query("size_cap", "SELECT doc_id, n_chars FROM documents WHERE n_chars <= 2048")
def size_cap(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.col("n_chars") <= 2 * 1024).select("doc_id", "n_chars")


# ---------------------------------------------------------------- interval and as-of joins

_SPANS = "SELECT user_id, event_id AS span, event_id * 3 AS first, event_id * 3 + CAST(floor(abs(value)) AS BIGINT) % 5000 AS last FROM events"


@query("enclosing_span", f"""
WITH s AS ({_SPANS}), p AS (SELECT user_id, event_id * 3 AS at FROM events)
SELECT p.user_id, p.at, arg_max(s.span, s.first * 1000000 + s.span) AS span FROM p LEFT JOIN s ON s.user_id = p.user_id AND p.at BETWEEN s.first AND s.last GROUP BY ALL""")
def enclosing_span(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    points = spark.sql("SELECT user_id, event_id * 3 AS at FROM events")
    return intervals.enclosing(points, spark.sql(_SPANS), ["user_id"], "at", "first", "last", "span", "found").select("user_id", "at", F.col("found").alias("span"))


@query("nearest_preceding", """
WITH m AS (SELECT user_id, event_id AS at, event_type FROM events WHERE event_type <> 'view')
SELECT e.event_id, e.user_id, (SELECT arg_max(m.at, m.at) FROM m WHERE m.user_id = e.user_id AND m.at < e.event_id) AS mark FROM events e""")
def nearest_preceding(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_id").alias("at"), "event_type")
    marks = events.where("event_type <> 'view'").withColumn("mark", F.col("at")).select("user_id", "at", "mark")
    return intervals.nearest_before(events.select("user_id", "at", "event_id"), marks, ["user_id"], "at", "mark", "mark").select("event_id", "user_id", "mark")


@query("next_at_most", """
WITH v AS (SELECT user_id, event_id AS at, CAST(floor(value) AS BIGINT) AS level FROM events)
SELECT a.user_id, a.at, (SELECT min(b.at) FROM v b WHERE b.user_id = a.user_id AND b.at > a.at AND b.level <= a.level) AS stop FROM v a""")
def next_at_most(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("at"), F.floor("value").cast("long").alias("level"))
    return intervals.next_at_most(rows, rows, ["user_id"], "at", "level", "stop").select("user_id", "at", "stop")


# ---------------------------------------------------------------- search

_POSTINGS = """
WITH post AS (
  SELECT doc_id, col, t[k] AS term, k AS pos FROM (
    SELECT doc_id, col, t, unnest(range(1, len(t) + 1)) AS k FROM (
      SELECT doc_id, 'text' AS col, list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS t FROM documents
      UNION ALL SELECT doc_id, 'source', list_filter(regexp_split_to_array(strip_accents(lower(source)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') FROM documents))
), size AS (SELECT (SELECT count(*) FROM documents) AS n_docs, (SELECT count(*) FROM post) AS n_terms),
d AS (SELECT doc_id, count(*) AS d FROM post GROUP BY doc_id),
"""
_SCORED = """
score AS (
  SELECT doc_id, -sum(CASE WHEN ln((n_docs - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE)) > 0 THEN ln((n_docs - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE)) ELSE 1e-6::DOUBLE END
    * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * d / (n_terms / n_docs)))) AS score
  FROM (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM hits) JOIN d USING (doc_id) CROSS JOIN size GROUP BY doc_id
)
"""


def _hits(*phrases: str) -> str:
    """SQL for (doc_id, k, f) of each phrase given as the SQL of its occurrences."""
    return "hits AS (" + " UNION ALL ".join(f"SELECT doc_id, {k} AS k, count(*) AS f FROM ({p}) GROUP BY doc_id" for k, p in enumerate(phrases)) + "),"


def _word(w: str, test: str = "=", col: str | None = None) -> str:
    return f"SELECT doc_id, col, pos FROM post WHERE term {test} '{w}'" + (f" AND col = '{col}'" if col else "")


_SEARCHES = {
    "search_and": ("with idiot", _hits(_word("with"), _word("idiot")), "SELECT doc_id, round(score, 6) AS score FROM score WHERE doc_id IN (SELECT doc_id FROM hits GROUP BY doc_id HAVING count(*) = 2)"),
    "search_or": ("idiot OR moron", _hits(_word("idiot"), _word("moron")), "SELECT doc_id, round(score, 6) AS score FROM score"),
    "search_not": ("idiot NOT moron", _hits(_word("idiot")), "SELECT doc_id, round(score, 6) AS score FROM score WHERE doc_id NOT IN (SELECT doc_id FROM post WHERE term = 'moron')"),
    "search_phrase": ('"of the"', _hits("SELECT a.doc_id FROM post a JOIN post b ON a.doc_id = b.doc_id AND a.col = b.col AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the'"), "SELECT doc_id, round(score, 6) AS score FROM score"),
    "search_prefix": ("idi*", _hits(_word("idi%", "LIKE")), "SELECT doc_id, round(score, 6) AS score FROM score"),
    "search_column": ("source:src3", _hits(_word("src3", "=", "source")), "SELECT doc_id, round(score, 6) AS score FROM score"),
}


def _search(text: str):
    def run(spark, sf_dir):
        rows = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
        # As with an index, postings are stored once and then asked many times.
        post, lengths = once(spark, sf_dir, "postings", lambda: stored(postings(rows, "doc_id", ("text", "source")), "doc_id"))
        finder = Searcher(rows, "doc_id", ("text", "source"), post, lengths)
        found = finder.scores(parse(text, ("text", "source")))
        return found.select("doc_id", F.round("score", 6).alias("score"))

    return run


for _key, (_text, _found, _select) in _SEARCHES.items():
    query(_key, _POSTINGS + _found + _SCORED + _select)(_search(_text))


@query("search_like", "SELECT doc_id FROM documents WHERE text ILIKE '%c++%' OR text ILIKE '%th_nd,%' OR source ILIKE '%C1_'")
def search_like(spark, sf_dir):
    finder = Searcher(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id", ("text", "source"))
    found = [finder.like("c++", ("text",)), finder.like("th_nd,", ("text",)), finder.like("C1_", ("source",))]
    return found[0].unionByName(found[1]).unionByName(found[2]).select("doc_id").distinct()


# ---------------------------------------------------------------- export

@query("export_json_rows", with_views("""
SELECT 'files' AS section, path AS a, lang AS b, module AS c, CAST(lines AS BIGINT) AS n FROM files
UNION ALL SELECT 'symbols', qualname, kind, name, start_line FROM symbols
UNION ALL SELECT 'calls', caller_name, callee, CAST(callee_id AS VARCHAR), line FROM calls
UNION ALL SELECT 'imports', i.module, i.kind, f.path, i.line FROM imports i LEFT JOIN files f ON f.id = i.target_id""", "symbols", "calls", "imports"))
def export_json_rows(spark, sf_dir):
    """The exported JSON records of all four sections, read back."""
    got = export.json_rows(index(spark, sf_dir))
    told = {"files": ("path", "lang", "module", "lines"), "symbols": ("qualname", "kind", "name", "start_line"), "calls": ("caller", "callee", "callee_id", "line"), "imports": ("module", "kind", "target_path", "line")}
    parts = [got.where(F.col("section") == k).select("section", F.json_tuple("json", *fields).alias(*"abcn")) for k, fields in told.items()]
    return reduce(DataFrame.unionByName, parts).withColumn("n", F.col("n").cast("long"))


@query("export_dot_lines", with_views("""
SELECT 'digraph symgraph {' AS line
UNION ALL SELECT '  subgraph cluster_' || CAST(f.id AS VARCHAR) || ' { label="' || f.path || '";' FROM files f WHERE f.id IN (SELECT file_id FROM symbols)
UNION ALL SELECT '    n' || CAST(id AS VARCHAR) || ' [label="' || qualname || '" kind="' || kind || '"];' FROM symbols
UNION ALL SELECT '  }' FROM (SELECT DISTINCT file_id FROM symbols)
UNION ALL SELECT '  n' || CAST(caller_id AS VARCHAR) || ' -> n' || CAST(callee_id AS VARCHAR) || ';' FROM calls WHERE callee_id IS NOT NULL
UNION ALL SELECT '  n' || CAST(caller_id AS VARCHAR) || ' -> "' || callee || '" [style=dashed];' FROM calls WHERE callee_id IS NULL
UNION ALL SELECT '  f' || CAST(file_id AS VARCHAR) || ' -> f' || CAST(target_id AS VARCHAR) || ' [label="' || module || '" style=dotted];' FROM imports WHERE target_id IS NOT NULL
UNION ALL SELECT '}'""", "symbols", "calls", "imports"))
def export_dot_lines(spark, sf_dir):
    return export.dot_rows(index(spark, sf_dir)).select("line")


# ---------------------------------------------------------------- scanning

@query("scan_symbols", sources.SYMBOLS_SQL)
def scan_symbols(spark, sf_dir):
    return scan.symbols(sources.files(spark, sf_dir))


def _source_files(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The files with ids, and (path, file_id)."""
    files = cut(numbered(sources.files(spark, sf_dir), "path"), "sources")
    return files, files.select("path", F.col("id").alias("file_id"))


@query("scan_calls", sources.CALLS_SQL)
def scan_calls(spark, sf_dir):
    """Calls found in the sources, linked to the symbols found there."""
    files, ids = _source_files(spark, sf_dir)
    found = cut(scan.symbols(files), "source-symbols")
    symbols = cut(relink.symbol_rows(found, ids), "source-ids")
    asked = cut(relink.with_ids(scan.calls(files, found), ids), "source-calls")
    calls, _ = relink.link_all(files.drop("text"), symbols, asked, relink.with_ids(scan.imports(files), ids))
    names = symbols.select(F.col("id").alias("callee_id"), F.col("qualname").alias("target"))
    return calls.join(ids, "file_id").join(names, "callee_id", "left").select("path", "line", "caller_name", "callee", "target")


@query("scan_imports", sources.IMPORTS_SQL)
def scan_imports(spark, sf_dir):
    """Imports found in the sources, linked to the files."""
    files, ids = _source_files(spark, sf_dir)
    imports = resolve.resolve_imports(cut(relink.with_ids(scan.imports(files), ids), "source-imports"), files.drop("text"))
    targets = ids.select(F.col("file_id").alias("target_id"), F.col("path").alias("target"))
    linked = imports.join(ids, "file_id").join(targets, "target_id", "left")
    return linked.select("path", "module", F.array_join("names", ",").alias("names"), "kind", "line", "target")


@query("search_symbols", with_views("SELECT id, qualname FROM symbols WHERE doc = 'SMALL Brand#4'", "symbols"))
def search_symbols_query(spark, sf_dir):
    return search_symbols(index(spark, sf_dir), "doc:small doc:brand doc:4", limit=-1).select("id", "qualname")


@query("search_substring", with_views("SELECT id, qualname FROM symbols WHERE lower(qualname || chr(0) || name || chr(0) || doc) LIKE '%nickel brand#4_%'", "symbols"))
def search_substring(spark, sf_dir):
    """A text that is no expression is sought as a substring, by the letter pieces that it is made of."""
    return search_symbols(index(spark, sf_dir), "nickel Brand#4_", limit=-1).select("id", "qualname")


def _document_postings(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return rows, *once(spark, sf_dir, "postings", lambda: stored(postings(rows, "doc_id", ("text", "source")), "doc_id"))


@query("search_top_k", _POSTINGS + _hits(_word("idiot"), _word("with"), _word("moron")) + _SCORED + "SELECT doc_id, round(-score, 6) AS score FROM score ORDER BY round(-score, 6) DESC, doc_id LIMIT 20")
def search_top_k(spark, sf_dir):
    """The best rows for three words; blocks of rows that cannot hold any of them are skipped."""
    rows, post, _ = _document_postings(spark, sf_dir)
    kept = once(spark, sf_dir, "ranked", lambda: ranked.Ranked(post, "doc_id", F.floor(F.col("doc_id") / 64)))
    return kept.top(["idiot", "with", "moron"], 20, rows.count())[0]


@query("search_near", _POSTINGS.rstrip().rstrip(",") + """
SELECT a.doc_id, a.col, CAST(min(greatest(a.pos, b.pos, c.pos) - least(a.pos, b.pos, c.pos) - 2) AS INTEGER) AS least
FROM post a JOIN post b ON b.doc_id = a.doc_id AND b.col = a.col AND abs(b.pos - a.pos) <= 12 JOIN post c ON c.doc_id = a.doc_id AND c.col = a.col AND abs(c.pos - a.pos) <= 12
WHERE a.term = 'the' AND b.term = 'of' AND c.term = 'with' GROUP BY ALL HAVING min(greatest(a.pos, b.pos, c.pos) - least(a.pos, b.pos, c.pos) - 2) <= 10""")
def search_near(spark, sf_dir):
    """Documents in which three words stand near one another, in any order."""
    rows, post, lengths = _document_postings(spark, sf_dir)
    return ranked.search_near(Searcher(rows, "doc_id", ("text", "source"), post, lengths), ["of", "with", "the"], 10)


# ---------------------------------------------------------------- imports in all languages, and small functions

@query("resolve_imports_languages", sources.LINKED_SQL)
def resolve_imports_languages(spark, sf_dir):
    """Imports of six languages: dotted, relative with and without a suffix, by path, and such as lead nowhere."""
    files, imports = sources.linked(spark, sf_dir)
    return resolve.resolve_imports(imports, cut(files, "linked-files")).select("file_id", "module", "target_id", "line")


@query("dependents_relative", sources.RELATIVE_SQL)
def dependents_relative(spark, sf_dir):
    """Who imports a module by name from its own package, with a relative import."""
    files = cut(sources.linked(spark, sf_dir)[0], "linked-files")
    none = files.where("false")
    first = files.where("lang = 'python'").agg(F.min("id")).first()[0]
    path = files.where(F.col("id") == first + len(sources.TEMPLATES)).select("path").first()
    return graph.dependents(graph.Index(files, none, none, sources.relative_imports(files)), path[0] if path else "", limit=None)


@query("imported_names", with_views("SELECT file_id, module, unnest(names) AS name, line FROM imports", "imports"))
def imported_names(spark, sf_dir):
    return index(spark, sf_dir).store.rows("imported").select("file_id", "module", "name", "line")


@query("stats_map", with_views("""
SELECT '{' || string_agg('"' || lang || '":' || n, ',' ORDER BY lang) || '}' AS languages FROM (SELECT lang, count(*) AS n FROM files GROUP BY lang)"""))
def stats_map(spark, sf_dir):
    return graph.stats(index(spark, sf_dir)).select(F.to_json("languages").alias("languages"))


@query("dot_escape", r"""SELECT page_id, sha256(replace(replace(html, '\', '\\'), '"', '\"')) AS escaped FROM pages WHERE html IS NOT NULL""")
def dot_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").where("html IS NOT NULL").select("page_id", F.sha2(X.dot_escape(F.col("html")), 256).alias("escaped"))
