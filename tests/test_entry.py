"""The entry works without the corpus operators, and nothing else imports them."""

import os
import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

BLOCKED = """
import sys

class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in ("gaugeworks.llm", "corpus_pipeline"):
            raise ModuleNotFoundError(name, name=name)

sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = e.queries()
assert len(names) > 100 and "pipeline" not in names and not any(n[:2] == "op" and n[2].isdigit() for n in names)
assert set(e.oracle_sql()) <= set(names)
"""


def test_without_the_corpus_operators():
    subprocess.run([sys.executable, "-c", BLOCKED], cwd=ROOT, check=True, env=os.environ | {"PYTHONPATH": str(ROOT)}, timeout=120)


def test_nothing_else_imports_them():
    for path in (ROOT / "gaugeworks").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"gaugeworks\.llm|corpus_pipeline", path.read_text()), path
