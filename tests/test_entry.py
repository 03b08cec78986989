"""The driver contract in a fresh process without a session, with the corpus operators and without them."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), len(o), sum(n.startswith('op') for n in q))"


def _said(folder) -> list[int]:
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-B", "-c", SAY], cwd=folder, env=env, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr[-2000:]
    return [int(x) for x in run.stdout.split()]


def test_entry_imports_without_a_session():
    n, sql, _ = _said(ROOT)
    assert n >= 80 and sql >= 70


def test_entry_imports_without_the_corpus_operators(tmp_path):
    for name in ("vispark", "__spark_entry__.py"):
        copy = shutil.copytree if os.path.isdir(f"{ROOT}/{name}") else shutil.copy
        copy(f"{ROOT}/{name}", tmp_path / name)
    shutil.rmtree(tmp_path / "vispark" / "llm", ignore_errors=True)
    n, sql, corpus = _said(tmp_path)
    assert n >= 80 and sql >= 70 and corpus == 0


def test_nothing_else_imports_the_corpus_operators():
    for folder, _, names in os.walk(f"{ROOT}/vispark"):
        if folder.endswith("llm") or "/llm/" in folder:
            continue
        for name in names:
            if name.endswith(".py"):
                assert "vispark.llm" not in open(f"{folder}/{name}", encoding="utf-8").read(), name
