"""The driver's entry without the training-data operators, or without what they need."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("missing", ["pixelsieve.llm", "corpus_pipeline", "ahocorasick", "xxhash", "zstandard"])
def test_engine_queries_stay(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; from pixelsieve.plans import queries as q; found = e.queries(); assert set(q.QUERIES) <= set(found) and set(q.SQL) <= set(e.oracle_sql()); assert 'pipeline' not in found; print(len(found))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
