"""Languages by file extension, and the words and patterns of each language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions, in lower case, and the language each one stands for.
EXTENSIONS = {
    ".py": "python", ".pyi": "python",
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript",
    ".go": "go", ".java": "java", ".rs": "rust",
}

# Extensions tried for an import of each language, in this order.
IMPORT_EXTENSIONS = {
    "python": [".py", ".pyi"],
    "javascript": [".js", ".jsx", ".mjs", ".cjs"],
    "typescript": [".ts", ".tsx", ".mts", ".cts", ".js", ".jsx"],
    "go": [".go"],
    "java": [".java"],
    "rust": [".rs"],
}
ALL_EXTENSIONS = sorted({e for own in IMPORT_EXTENSIONS.values() for e in own})

# Words that look like calls but are none, by language.
NOT_CALLS = {
    "python": [
        "def", "class", "if", "elif", "else", "for", "while", "with", "return", "import", "from", "raise", "except", "assert", "yield",
        "lambda", "not", "and", "or", "in", "is", "pass", "break", "continue", "del", "global", "nonlocal", "try", "finally", "match",
        "case", "async", "await", "type",
    ],
    "javascript": [
        "function", "if", "for", "while", "switch", "catch", "return", "typeof", "instanceof", "delete", "void", "import", "require",
        "export", "in", "of", "do", "else", "try", "finally", "throw", "case", "default", "extends", "yield", "await", "async", "class",
        "const", "let", "var", "static", "get", "set", "new", "super", "interface", "type", "enum", "namespace", "declare",
    ],
    "go": [
        "if", "for", "switch", "func", "go", "defer", "return", "case", "select", "range", "var", "const", "type", "import", "package",
        "else", "break", "continue", "fallthrough", "map", "chan", "interface", "struct", "goto", "default",
    ],
    "java": [
        "if", "for", "while", "switch", "return", "new", "try", "catch", "finally", "throw", "import", "package", "class", "interface",
        "extends", "implements", "public", "private", "protected", "static", "void", "super", "this", "assert", "synchronized",
        "instanceof", "do", "else", "case", "default", "break", "continue", "enum", "record", "sealed", "final", "abstract", "native",
        "volatile", "transient", "strictfp",
    ],
    "rust": [
        "if", "for", "while", "fn", "return", "impl", "struct", "enum", "trait", "match", "let", "mut", "use", "mod", "pub", "unsafe",
        "ref", "where", "loop", "else", "move", "const", "static", "async", "await", "dyn", "type", "in", "union", "crate", "super",
        "break", "continue", "extern", "macro_rules",
    ],
}
NOT_CALLS["typescript"] = NOT_CALLS["javascript"]

# Words that never name a method in JavaScript and TypeScript.
NOT_METHODS = [
    "if", "for", "while", "switch", "catch", "return", "function", "class", "import", "export", "const", "let", "var", "new", "delete",
    "typeof", "instanceof", "in", "of", "do", "else", "try", "finally", "throw", "case", "default", "extends", "yield", "await", "async",
    "interface", "type", "enum", "namespace", "declare", "super", "this", "void",
]

# Words that begin a Java statement, never a return type.
NOT_RETURN_TYPES = ["new", "return", "throw", "switch", "if", "for", "while", "catch", "synchronized"]


def extension(path: Column) -> Column:
    """The lower-cased last suffix with its dot; '' for none. A leading dot of a name is no suffix."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]+)$", 1))


def language(path: Column, overrides: dict[str, str] | None = None) -> Column:
    """The language of a path, null if there is none; ``overrides`` win."""
    known = EXTENSIONS | (overrides or {})
    return F.create_map(*[F.lit(x) for pair in known.items() for x in pair])[extension(path)]


def module_id(path: Column, lang: Column, text: Column) -> Column:
    """Dotted path for Python, package for Go and Java if the text begins with one, else the path without its suffix."""
    bare = F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", "")
    dotted = F.replace(F.regexp_replace(bare, r"(^|/)__init__$", ""), F.lit("/"), F.lit("."))
    package = F.regexp_extract(text, r"^(?U)\s*package\s+([\w.]+)\s*;?", 1)
    return F.when(lang == "python", dotted).when(lang.isin("go", "java") & (package != ""), package).otherwise(bare)
