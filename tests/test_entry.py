"""The entry point with and without the optional parts."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("missing", ["", "regex", "lagoon.llm", "corpus_pipeline"])
def test_core_queries_do_not_need_the_rest(missing):
    code = f"""
import sys
if {missing!r}:
    sys.modules[{missing!r}] = None  # importing it raises ImportError
import __spark_entry__ as e
from lagoon.plans import registry
q, o = e.queries(), e.oracle_sql()
assert set(registry.QUERIES) <= set(q) and set(registry.ORACLE) <= set(o) and set(o) <= set(q)
if {missing!r}:
    assert "pipeline" not in q
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
