"""Declaration and import patterns by language."""

from __future__ import annotations

from dataclasses import dataclass

from .languages import NOT_METHODS, NOT_RETURN_TYPES


@dataclass(frozen=True)
class Declaration:
    """What a line declares. Groups number the pattern's parts; 0 stands for none."""

    kind: str
    pattern: str
    name: int = 1
    signature: int = 0
    trim: bool = True  # whether the signature is stripped
    owner: int = 0  # group of an explicit receiver
    container: bool = False  # later lines may nest in it
    symbol: bool = True
    nested: bool = False  # counts only inside a container
    reserved: tuple[str, ...] = ()  # names it cannot have
    first_word: int = 0  # group whose first word must not be one of not_first
    not_first: tuple[str, ...] = ()


# Declaration patterns, tried in this order on each line.
_CLASS_JS = r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"
_FUNCTION_JS = r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+(\w+)\s*\(([^)]*)\)"
_ARROW_JS = r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\(([^)]*)\)|\w+)\s*=>"
_INTERFACE_JS = r"^\s*(?:export\s+)?interface\s+(\w+)"
_TYPE_JS = r"^\s*(?:export\s+)?type\s+(\w+)\s*="
_METHOD_JS = r"^\s{2,}(?:(?:public|private|protected|static|readonly|async|get|set|abstract|override|declare)\s+)*(\w+)\s*\(([^)]*)\)[^{]*\{"
_CLASS_PY = r"^[ \t]*class\s+(\w+)\s*(?:\([^)]*\))?\s*:"
_DEF_PY = r"^[ \t]*(?:async\s+)?def\s+(\w+)\s*\(([^)]*)\)[^:]*:"
_FN_RS = r"^\s*(?:pub(?:\s*\([^)]*\))?\s+)?fn\s+(\w+)\s*\(([^)]*)\)"

_JS = (
    Declaration("class", _CLASS_JS, container=True),
    Declaration("interface", _INTERFACE_JS),
    Declaration("type", _TYPE_JS),
    Declaration("method", _METHOD_JS, signature=2, nested=True, reserved=tuple(NOT_METHODS)),
    Declaration("function", _FUNCTION_JS, signature=2, trim=False),
    Declaration("function", _ARROW_JS, signature=2, trim=False),
)
DECLARATIONS: dict[str, tuple[Declaration, ...]] = {
    "python": (Declaration("class", _CLASS_PY, container=True), Declaration("function", _DEF_PY, signature=2, container=True)),
    "javascript": _JS,
    "typescript": _JS,
    "go": (
        Declaration("method", r"^\s*func\s+\((\w+)\s+\*?(\w+)\)\s+(\w+)\s*\(([^)]*)\)", name=3, signature=4, owner=2),
        Declaration("function", r"^\s*func\s+(\w+)\s*\(([^)]*)\)", signature=2),
        Declaration("interface", r"^\s*type\s+(\w+)\s+interface"),
        Declaration("type", r"^\s*type\s+(\w+)\s+struct"),
    ),
    "java": (
        Declaration("class", r"^\s*(?:(?:public|final|abstract|sealed|non-sealed|static|strictfp)\s+)*class\s+(\w+)", container=True),
        Declaration("interface", r"^\s*(?:(?:public|static|sealed)\s+)*interface\s+(\w+)", container=True),
        Declaration(
            "method",
            r"^\s*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|transient|volatile|strictfp)\s+)*"
            r"([\w<>\[\],.?]+(?:\s+[\w<>\[\],.?]+)*)\s+(\w+)\s*\(([^)]*)\)\s*(?:throws\s+[\w.,\s]+)?",
            name=2, signature=3, nested=True, first_word=1, not_first=tuple(NOT_RETURN_TYPES),
        ),
    ),
    "rust": (
        Declaration("type", r"^\s*(?:pub\s+)?(struct|enum)\s+(\w+)", name=2),
        Declaration("interface", r"^\s*(?:pub\s+)?trait\s+(\w+)", container=True),
        Declaration("impl", r"^\s*(?:pub\s+)?(?:unsafe\s+)?impl\s+(?:<\s*[^>]*\s*>)?\s*(\w+)", container=True, symbol=False),
        Declaration("function", _FN_RS, signature=2),
    ),
}

# Headers that are cut off before a line's calls are read.
HEADERS = {
    "python": (_DEF_PY, _CLASS_PY),
    "javascript": (_CLASS_JS, _FUNCTION_JS, _ARROW_JS, _INTERFACE_JS, _TYPE_JS, _METHOD_JS),
    "typescript": (_CLASS_JS, _FUNCTION_JS, _ARROW_JS, _INTERFACE_JS, _TYPE_JS, _METHOD_JS),
    "go": (),
    "java": (),
    "rust": (_FN_RS,),
}

# Import patterns over whole texts; flags make "." and "$" see newlines only.
_FLAGS = "(?Udm)"
IMPORTS = {
    "python_module": _FLAGS + r"^[ \t]*import\s+([\w.]+)",
    "python_from": _FLAGS + r"^[ \t]*from\s+([\w.]+)\s+import\s+(.+)$",
    "js_import": _FLAGS + r"^[ \t]*import\s+(?:([^'\"\n;]+?)\s+from\s+)?['\"]([^'\"]+)['\"]",
    "js_require": _FLAGS + r"require\(\s*['\"]([^'\"]+)['\"]\s*\)",
    "js_binding": _FLAGS + r"(?:const|let|var)\s*\{?\s*([^=\n]*?)\s*\}?\s*=\s*require",
    "js_name": r"(?U)[A-Za-z_$][\w$]*",
    "go_single": _FLAGS + r"^[ \t]*import\s+\"([^\"]+)\"",
    "go_block": _FLAGS + r"import\s*\(([^)]*)\)",
    "go_item": r"\"([^\"]+)\"",
    "java_import": _FLAGS + r"^[ \t]*import\s+(?:static\s+)?([\w.*]+)\s*;",
    "rust_mod": _FLAGS + r"^[ \t]*mod\s+(\w+)\s*;",
    "rust_use": _FLAGS + r"^[ \t]*use\s+([A-Za-z_][\w:]*(?:::\{[^;]*)?\s*;?)",
}
