"""The driver's entry module, with and without the optional text operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 50; print(sorted(k for k in q if k.startswith('op') or k == 'pipeline'))"


def ask(folder):
    return subprocess.run([sys.executable, "-B", "-c", ASK], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, check=True).stdout.strip()


def test_without_the_text_operators(tmp_path):
    shutil.copytree(os.path.join(ROOT, "cartosieve"), tmp_path / "cartosieve", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    assert ask(tmp_path) == "[]"


def test_nothing_else_imports_the_text_operators():
    for folder, _, names in os.walk(os.path.join(ROOT, "cartosieve")):
        for name in names:
            if name.endswith(".py") and "llm" not in os.path.relpath(folder, ROOT).split(os.sep):
                with open(os.path.join(folder, name)) as f:
                    assert "cartosieve.llm" not in f.read(), name
