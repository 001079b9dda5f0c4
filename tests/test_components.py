"""Components in few rounds, and the entry without the optional folders."""

import random
import shutil
import subprocess
import sys
from pathlib import Path

from unravel.operators import components as comp


def rounds_of(spark, monkeypatch, ids):
    """(rounds, labels) of a path through ``ids``."""
    made = []
    cut = comp.cut
    monkeypatch.setattr(comp, "cut", lambda df: made.append(1) or cut(df))
    v = spark.createDataFrame([(1, i) for i in ids], "graph_id long, id long")
    e = spark.createDataFrame([(1, min(a, b), max(a, b)) for a, b in zip(ids, ids[1:])], "graph_id long, src long, dst long")
    rows = comp.components(v, e).collect()
    return len(made) - 2, {r.id: r.comp for r in rows}


def test_long_path(spark, monkeypatch):
    ids = list(range(10_000))
    random.Random(1).shuffle(ids)
    rounds, labels = rounds_of(spark, monkeypatch, ids)
    assert labels == dict.fromkeys(ids, 0)
    assert rounds <= 20


def test_entry_without_optional_folders(tmp_path):
    repo = Path(__file__).parent.parent
    for name in ("unravel", "__spark_entry__.py", "corpus_pipeline.py"):
        (shutil.copytree if (repo / name).is_dir() else shutil.copy)(repo / name, tmp_path / name) if (repo / name).exists() else None
    shutil.rmtree(tmp_path / "unravel" / "llm", ignore_errors=True)
    for _ in range(2):
        said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"], cwd=tmp_path, capture_output=True, text=True)
        assert said.returncode == 0, said.stderr
        assert "False" in said.stdout
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
