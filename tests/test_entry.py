"""The entry loads with and without the text operators."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("missing", ["public_tokenizers", "portolan.llm", "corpus_pipeline", "nothing"])
def test_entry_without_a_module(missing):
    code = f"""
import sys
sys.modules[{missing!r}] = None
import __spark_entry__ as entry
names = entry.queries()
print(len(names), sum(n.startswith("op") and n[2].isdigit() for n in names), "pipeline" in names, set(entry.oracle_sql()) <= set(names))
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    total, text, pipeline, fits = int(out[0]), int(out[1]), out[2] == "True", out[3] == "True"
    assert total - text - pipeline > 200 and fits
    if missing in ("public_tokenizers", "portolan.llm"):
        assert text == 0 and not pipeline
    if missing == "corpus_pipeline":
        assert not pipeline
