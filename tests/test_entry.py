"""The contract holds without the training-data operators, or without a library that they alone use."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
HIDDEN = """
import sys
for name in {hidden}:
    sys.modules[name] = None
import __spark_entry__ as entry
names = entry.queries()
assert set(entry.oracle_sql()) <= set(names)
print(len(names), sum(name.startswith("op") and name[2].isdigit() or name == "pipeline" for name in names))
"""


def counted(hidden):
    done = subprocess.run([sys.executable, "-c", HIDDEN.format(hidden=hidden)], cwd=ROOT, capture_output=True, text=True, check=True)
    return tuple(map(int, done.stdout.split()))


def test_a_missing_library_costs_its_operators_only():
    for hidden in (["xxhash"], ["plumbline.llm"], ["corpus_pipeline"], ["tokenizers", "sentencepiece", "public_tokenizers"]):
        queries, numbered = counted(hidden)
        assert queries >= 290 and numbered == 0, hidden
