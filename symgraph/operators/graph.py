"""Structural queries over an index: lazy DataFrames in a fixed order."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import cut
from .store import LITERALS, Store, few_values


@dataclass(frozen=True)
class Index:
    """The four tables and what is known of the run that made them; with a store, lookups read only what they need."""

    files: DataFrame
    symbols: DataFrame
    calls: DataFrame
    imports: DataFrame
    root: str = ""
    last_indexed: str | None = None
    store: Store | None = None

    @classmethod
    def of(cls, store: Store) -> Index:
        return cls(*[store.rows(t) for t in ("files", "symbols", "calls", "imports")], store.told.get("root", ""), store.told.get("last_indexed"), store)

    def get(self, table: str, key: str, *values) -> DataFrame:
        """Rows of a table whose key is one of a few values, which become literals of the plan."""
        if self.store is not None:
            return self.store.get(table, key, list(values))
        return getattr(self, table).where(F.col(key).isin([v for v in values if v is not None]))

    def lookup(self, table: str, key: str, keys: DataFrame) -> DataFrame:
        """At least the rows of a table whose key is in the only column of ``keys``."""
        return self.store.lookup(table, key, keys) if self.store is not None else getattr(self, table)

    def imported(self, name: str) -> DataFrame:
        """(file_id, module, line) of the imports that list a name."""
        if self.store is not None:
            return self.store.get("imported", "name", [name]).select("file_id", "module", "line")
        return self.imports.where(F.array_contains("names", name)).select("file_id", "module", "line")


def top(rows: DataFrame, order: list[str | Column], limit: int | None) -> DataFrame:
    """Rows in order, the first ``limit`` of them; all if it is None or negative."""
    rows = rows.orderBy(*order)
    return rows if limit is None or limit < 0 else rows.limit(limit)


def find_symbol(index: Index, symbol: str) -> int | None:
    """The lowest id of that qualified name, else the id of the only symbol of that name, else None."""
    exact = index.get("symbols", "qualname", symbol).agg(F.min("id").alias("exact"))
    named = index.get("symbols", "name", symbol).agg(F.count("*").alias("n"), F.min("id").alias("only"))
    found = exact.crossJoin(named).first()  # one row each
    return found["exact"] if found["exact"] is not None else found["only"] if found["n"] == 1 else None


def find_module(index: Index, module: str) -> tuple[int, str] | None:
    """(id, module) of the file of a path, of a path less its .py, or of a module id, else None."""
    if not module:
        return None
    by_path = index.get("files", "path", module, module + ".py").select("id", "module", F.when(F.col("path") == module, 0).otherwise(1).alias("rank"))
    by_module = index.get("files", "module", module).select("id", "module", F.lit(2).alias("rank"))
    found = by_path.unionByName(by_module).agg(F.min_by(F.struct("id", "module"), F.struct("rank", "id")).alias("f")).first()["f"]
    return (found["id"], found["module"] or "") if found else None


def _paths(index: Index, keys: DataFrame, key: str, path: str = "path") -> DataFrame:
    return index.lookup("files", "id", keys.select(key)).select(F.col("id").alias(key), F.col("path").alias(path))


def callers(index: Index, symbol: str, limit: int | None = 100) -> DataFrame:
    """One row for each call of the symbol."""
    hit = index.get("calls", "callee_id", find_symbol(index, symbol)).where("caller_id IS NOT NULL").select("caller_id", "file_id", "callee", "line")
    who = index.lookup("symbols", "id", hit.select("caller_id")).select(F.col("id").alias("caller_id"), "qualname", "kind", F.col("start_line").alias("symbol_line"))
    rows = hit.join(who, "caller_id").join(_paths(index, hit, "file_id"), "file_id")
    site = F.concat_ws(":", "path", "line").alias("call_site")
    return top(rows.select("qualname", "kind", "path", "symbol_line", site, "callee", "line"), ["qualname", "line", "path", "callee"], limit)


def callees(index: Index, symbol: str, limit: int | None = 100) -> DataFrame:
    """Everything the symbol calls, resolved or not."""
    hit = index.get("calls", "caller_id", find_symbol(index, symbol)).select("callee", "callee_id", "file_id", "line")
    target = index.lookup("symbols", "id", hit.select("callee_id")).select(F.col("id").alias("callee_id"), F.col("qualname").alias("target"))
    rows = hit.join(target, "callee_id", "left").join(_paths(index, hit, "file_id"), "file_id")
    shown = rows.select("callee", "callee_id", F.col("callee_id").isNotNull().alias("resolved"), F.coalesce("target", F.lit("")).alias("target"), "path", "line")
    return top(shown, ["callee", "line", "path", "target"], limit)


def deps(index: Index, module: str, limit: int | None = 200) -> DataFrame:
    """What a file imports."""
    file, _ = find_module(index, module) or (None, "")
    hit = index.get("imports", "file_id", file).select("module", "kind", "target_id", "line")
    rows = hit.join(_paths(index, hit, "target_id", "target_path"), "target_id", "left")
    return top(rows.select("module", "kind", F.coalesce("target_path", F.lit("")).alias("target_path"), "line"), ["line", "module", "target_path", "kind"], limit)


def dependents(index: Index, module: str, limit: int | None = 200) -> DataFrame:
    """Files that import the module, then files that import it by name as a member of its package."""
    file, module_id = find_module(index, module) or (None, "")
    hit = index.get("imports", "target_id", file).select("file_id", "module", "line")
    whole = hit.join(_paths(index, hit, "file_id"), "file_id").select("path", "module", "line", F.lit(0).alias("rank"))
    base, dot, name = module_id.rpartition(".")
    if not dot:
        return top(whole, ["rank", "path", "line", "module"], limit).select("path", "module", "line")
    member = index.imported(name).where((F.col("module") == base) | F.col("module").startswith("."))
    own = index.lookup("files", "id", member.select("file_id")).select(F.col("id").alias("file_id"), "path", F.col("module").alias("own"))
    member = member.join(own, "file_id").where((F.col("module") == base) | F.col("own").startswith(base))
    first = member.join(whole.select("path").distinct(), "path", "left_anti").groupBy("path").agg(F.min(F.struct("line", "module")).alias("i"))
    both = whole.unionByName(first.select("path", "i.module", "i.line", F.lit(1).alias("rank")))
    return top(both, ["rank", "path", "line", "module"], limit).select("path", "module", "line")


def impact(index: Index, symbol: str, depth: int = 3, limit: int | None = 200) -> DataFrame:
    """Symbols that reach the symbol through at most ``depth`` calls, each at its least depth.

    Every hop looks the frontier up among the calls by their target and drops
    what was seen; it is written out, so a lost executor never costs more than
    one hop. A small frontier reads only the files that hold its calls.
    """
    spark, sym = index.symbols.sparkSession, find_symbol(index, symbol)
    start = spark.createDataFrame([] if sym is None else [(sym,)], "id long")
    # The frontier's ids while they are few enough to be literals.
    frontier, few, seen, hops, found_ids = start, [] if sym is None else [sym], None, [], []
    for hop in range(1, max(1, depth) + 1):
        if few is not None:
            edges = index.get("calls", "callee_id", *few)
        else:
            edges = index.calls.join(frontier.withColumnRenamed("id", "callee_id"), "callee_id", "left_semi")
        reached = edges.where("caller_id IS NOT NULL AND callee_id IS NOT NULL").select(F.col("caller_id").alias("id")).distinct()
        if seen is not None:
            reached = reached.join(seen, "id", "left_anti")
        # From the second hop on, the start itself is no news either.
        frontier = cut(reached.join(start, "id", "left_anti") if hop > 1 else reached, "impact")
        few = few_values(frontier)
        if few == [] and hop > 1:
            break
        found_ids = None if few is None or found_ids is None else found_ids + few
        hops.append(frontier.withColumn("depth", F.lit(hop)))
        seen = frontier if seen is None else seen.unionByName(frontier)
    found = reduce(DataFrame.unionByName, hops)
    known = found_ids is not None and len(found_ids) <= LITERALS
    symbols = (index.get("symbols", "id", *found_ids) if known else index.symbols).select("id", "qualname", "kind", "file_id")
    paths = _paths(index, symbols, "file_id") if known else index.files.select(F.col("id").alias("file_id"), "path")
    rows = found.join(symbols, "id").join(paths, "file_id")
    return top(rows.select("depth", "qualname", "kind", "path"), ["depth", "qualname", "path", "kind"], limit)


def languages(index: Index) -> DataFrame:
    return index.files.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang")


def stats(index: Index) -> DataFrame:
    """One row of counts, with files by language as a map."""
    one = lambda table, **aggs: table.agg(*[a.alias(k) for k, a in aggs.items()])
    files = one(index.files, files=F.count("*"))
    langs = languages(index).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lang", "n")))).alias("languages"))
    symbols = one(index.symbols, symbols=F.count("*"))
    calls = one(index.calls, calls=F.count("*"), calls_resolved=F.count("callee_id"), calls_unresolved=F.count_if(F.col("callee_id").isNull()))
    imports = one(index.imports, imports=F.count("*"), imports_resolved=F.count("target_id"), imports_unresolved=F.count_if(F.col("target_id").isNull()))
    row = files.crossJoin(symbols).crossJoin(calls).crossJoin(imports).crossJoin(langs)  # one row each
    return row.withColumns({"root": F.lit(index.root), "last_indexed": F.lit(index.last_indexed)})
