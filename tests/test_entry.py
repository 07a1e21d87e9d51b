"""The driver entry, with and without the optional subpackage."""

import subprocess
import sys

import __spark_entry__ as entry


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_works_without_the_optional_subpackage():
    code = (
        "import sys; sys.modules['symgraph.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; "
        "assert 'callers' in e.queries() and 'op1_toxicity' not in e.queries() and 'pipeline' not in e.queries()"
    )
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)


def test_core_never_imports_the_optional_subpackage():
    from pathlib import Path

    root = Path(entry.__file__).parent / "symgraph"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "llm" not in path.read_text(), path
