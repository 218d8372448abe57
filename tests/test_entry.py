"""The driver's three functions, with and without the corpus operators."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
BLOCKED = """
import sys
sys.path.insert(0, {root!r})
class Block:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r} or name.startswith({name!r} + "."):
            raise ModuleNotFoundError("no module named " + name, name=name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as entry
print(len(entry.queries()), sum(n.startswith("op") and n[2].isdigit() for n in entry.queries()), set(entry.oracle_sql()) <= set(entry.queries()))
"""


@pytest.mark.parametrize("name", ["xxhash", "public_tokenizers", "regex", "shelfmark.llm"])
def test_queries_register_without_a_library_of_the_corpus_operators(name):
    out = subprocess.run([sys.executable, "-c", BLOCKED.format(root=str(ROOT), name=name)], capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    total, corpus, sql_fits = out.stdout.split()
    assert int(total) > 140 and corpus == "0" and sql_fits == "True"
