"""Named tools over an index, a cache of their answers, and a line-based JSON-RPC loop."""

from __future__ import annotations

import json
import sys
import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import asdict, dataclass
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession

from .operators import graph
from .operators.search import search_symbols
from .operators.snapshot import NoIndexError, build, open_index
from .settings import Settings

PROTOCOL = "2024-11-05"


class ToolError(Exception):
    """A failure that the caller of a tool is told about."""


class TTLCache:
    """Values that expire; when full, the value put first goes first."""

    def __init__(self, ttl: float = 30.0, max_size: int = 128):
        self.ttl, self.max_size = ttl, max_size
        self._held: OrderedDict[str, tuple[float, object]] = OrderedDict()

    def get(self, key: str):
        entry = self._held.get(key)
        if entry and time.monotonic() >= entry[0]:
            del self._held[key]
            entry = None
        return entry[1] if entry else None

    def put(self, key: str, value) -> None:
        self._held.pop(key, None)
        self._held[key] = (time.monotonic() + self.ttl, value)
        while len(self._held) > self.max_size:
            self._held.popitem(last=False)

    def clear(self) -> None:
        self._held.clear()

    def __len__(self) -> int:
        return len(self._held)


@dataclass(frozen=True)
class Tool:
    about: str
    run: Callable
    required: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    needs_symbol: bool = False
    cached: bool = True

    def schema(self) -> dict:
        numbers = ("limit", "depth")
        kinds = {k: {"type": "integer" if k in numbers else "boolean" if k == "force" else "string"} for k in (*self.required, *self.optional)}
        return {"type": "object", "properties": kinds, "required": list(self.required)}


#: Rows that a tool tells at most; an answer that would be longer is refused, not cut.
MOST_ROWS = 100_000


def _rows(df: DataFrame) -> list[dict]:
    found = df.limit(MOST_ROWS + 1).collect()
    if len(found) > MOST_ROWS:
        raise ToolError(f"the answer has more than {MOST_ROWS} rows; give a limit, or use the library")
    return [r.asDict(recursive=True) for r in found]


def _limit(args: dict, default: int) -> int:
    return int(args.get("limit", default))


TOOLS: dict[str, Tool] = {
    "callers": Tool("Direct callers of a symbol", lambda s, a: graph.callers(s.index(), a["symbol"], _limit(a, 100)), ("symbol",), ("limit",), True),
    "callees": Tool("What a symbol calls", lambda s, a: graph.callees(s.index(), a["symbol"], _limit(a, 100)), ("symbol",), ("limit",), True),
    "deps": Tool("What a module imports", lambda s, a: graph.deps(s.index(), a["module"], _limit(a, 200)), ("module",), ("limit",)),
    "dependents": Tool("What imports a module", lambda s, a: graph.dependents(s.index(), a["module"], _limit(a, 200)), ("module",), ("limit",)),
    "impact": Tool(
        "Transitive callers of a symbol",
        lambda s, a: graph.impact(s.index(), a["symbol"], int(a.get("depth", 3)), _limit(a, 200)), ("symbol",), ("depth", "limit"), True,
    ),
    "search": Tool("Search names, docs and signatures", lambda s, a: search_symbols(s.index(), a["query"], _limit(a, 20)), ("query",), ("limit",)),
    "overview": Tool("Counts of the index", lambda s, a: graph.stats(s.index())),
    "reindex": Tool("Refresh the index", lambda s, a: s.reindex(bool(a.get("force", False))), (), ("force",), cached=False),
}


class Service:
    """Runs tools by name against one index."""

    def __init__(self, spark: SparkSession, settings: Settings, cache: TTLCache | None = None):
        self.spark, self.settings, self.cache = spark, settings, cache or TTLCache()

    def index(self) -> graph.Index:
        try:
            return open_index(self.spark, self.settings.index_path)
        except NoIndexError as error:
            raise ToolError(f"{error}; index the project root first") from error

    def reindex(self, force: bool) -> dict:
        report = asdict(build(self.spark, self.settings, force))
        self.cache.clear()
        return report

    def call(self, name: str, args: dict | None = None):
        """The value of a tool: a list of rows, or one record."""
        tool, args = TOOLS[name], args or {}
        for key in tool.required:
            if not args.get(key):
                raise ToolError(f"missing required argument {key!r}")
        key = json.dumps([name, args], sort_keys=True, default=str)
        if tool.cached and (held := self.cache.get(key)) is not None:
            return held
        if tool.needs_symbol and graph.find_symbol(self.index(), args["symbol"]) is None:
            raise ToolError(f"unknown symbol: {args['symbol']!r} (try the search tool first)")
        value = tool.run(self, args)
        if isinstance(value, DataFrame):
            value = _rows(value)
            value = value[0] if name == "overview" else value
        if tool.cached:
            self.cache.put(key, value)
        return value


def render(value) -> str:
    """Rows one to a line, or a record one field to a line."""
    if isinstance(value, dict):
        return "\n".join(f"{k}: {v}" for k, v in value.items())
    return "\n".join("  ".join(str(v) for v in row.values()) for row in value) or "no results"


def respond(service: Service, request: dict) -> dict | None:
    """The answer to one JSON-RPC request, None for a notification."""
    if "id" not in request:
        return None
    method, params = request.get("method"), request.get("params") or {}
    answer: dict = {"jsonrpc": "2.0", "id": request["id"]}
    fail = lambda code, text: answer | {"error": {"code": code, "message": text}}
    if method == "initialize":
        return answer | {"result": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "symgraph", "version": "0.1"}}}
    if method == "ping":
        return answer | {"result": {}}
    if method == "tools/list":
        return answer | {"result": {"tools": [{"name": k, "description": t.about, "inputSchema": t.schema()} for k, t in TOOLS.items()]}}
    if method != "tools/call":
        return fail(-32601, f"unknown method: {method}")
    if not isinstance(params, dict) or params.get("name") not in TOOLS:
        return fail(-32602, f"unknown tool: {params.get('name') if isinstance(params, dict) else params}")
    try:
        value = service.call(params["name"], params.get("arguments"))
    except Exception as error:  # noqa: BLE001  a tool's failure must not end the loop
        return answer | {"result": {"content": [{"type": "text", "text": str(error)}], "isError": True}}
    blocks = [render(value), json.dumps(value, default=str, ensure_ascii=False)]
    return answer | {"result": {"content": [{"type": "text", "text": b} for b in blocks], "isError": False}}


def serve(service: Service, lines: TextIO = sys.stdin, out: TextIO = sys.stdout) -> None:
    """Answer newline-delimited requests until the input ends; lines that are no JSON are skipped."""
    for line in lines:
        try:
            request = json.loads(line)
        except ValueError:
            continue
        answer = None
        if isinstance(request, dict):
            try:
                answer = respond(service, request)
            except Exception as error:  # noqa: BLE001
                answer = {"jsonrpc": "2.0", "id": request.get("id"), "error": {"code": -32603, "message": str(error)}}
        if answer is not None:
            out.write(json.dumps(answer, default=str, ensure_ascii=False) + "\n")
            out.flush()
