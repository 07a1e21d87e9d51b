"""Schemas of the index tables and of what is stored beside them for lookups."""

from __future__ import annotations

#: One row for each source file. ``mtime`` is in nanoseconds.
FILES = "id long, path string, lang string, module string, size long, mtime long, digest string, lines int, indexed_at timestamp"
#: Vertices. ``parent`` is the qualified name of the enclosing symbol or ''.
SYMBOLS = "id long, file_id long, kind string, name string, qualname string, parent string, start_line int, end_line int, signature string, doc string"
#: Call edges. A null ``callee_id`` is an unresolved target; ``caller_name`` is '' at module level; ``name`` is the callee's last segment.
CALLS = "caller_id long, caller_name string, callee string, callee_id long, file_id long, line int, name string"
#: Import edges between files.
IMPORTS = "file_id long, module string, target_id long, names array<string>, kind string, line int"

KINDS = ("function", "method", "class", "interface", "type")

STORED = {
    "files": FILES,
    "symbols": SYMBOLS,
    "calls": CALLS,
    "imports": IMPORTS,
    # Names that imports list, one a row.
    "imported": "name string, file_id long, module string, line int",
    # Files that a file can see, paths that its imports may mean, modules that it asks for by name.
    "reach": "file_id long, reach long",
    "tried": "tried string, file_id long",
    "wanted": "wanted string, file_id long",
    # Search: occurrences of terms, terms of each symbol, three-letter pieces of each symbol.
    "postings": "term string, id long, col string, pos int, file_id long",
    "lengths": "id long, d long, file_id long",
    "grams": "gram string, id long, file_id long",
}
