"""The core never imports the optional subpackage."""

import pathlib
import re

ROOT = pathlib.Path(__file__).resolve().parent.parent / "paperloom"


def test_core_does_not_import_llm():
    for p in ROOT.rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"paperloom\.llm|from \.+llm", p.read_text()), p


def test_entry_imports_without_llm():
    import __spark_entry__ as e

    assert e.queries() and e.oracle_sql().keys() <= e.queries().keys()
