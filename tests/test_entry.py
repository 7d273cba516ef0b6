"""The driver's contract, with and without the subpackage of training-data operators."""

import os
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

REPO = Path(entry.__file__).resolve().parent


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_stands_alone(tmp_path):
    """Without kithgraph/llm and corpus_pipeline.py, all other modules import and the other queries stay."""
    for path in REPO.rglob("*.py"):
        inside = path.relative_to(REPO)
        if inside.parts[:2] != ("kithgraph", "llm") and inside.parts[0] != "tests" and inside.name != "corpus_pipeline.py":
            (tmp_path / inside).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / inside).write_text(path.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(n.startswith('op') or n == 'pipeline' for n in q), q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True, timeout=120)
