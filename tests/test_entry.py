"""The entry without the optional subpackage, in a process and on a copy of its own."""
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

HOME = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("left", [(), ("corpus_pipeline.py",)])
def test_queries_register_without_the_optional_subpackage(tmp_path, left):
    shutil.copytree(HOME / "citeline", tmp_path / "citeline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", *left):
        if (HOME / name).exists():
            shutil.copy(HOME / name, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'hybrid_retrieve' in q and 'pipeline' not in q, sorted(q); assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
