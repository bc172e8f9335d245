"""The rest works, and says nothing of the training-data operators, when their two folders are gone."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_the_rest_without_the_training_data_operators(tmp_path):
    there = tmp_path / "copy"
    shutil.copytree(ROOT, there, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for d in ("tabq/llm", "tests/llm"):
        shutil.rmtree(there / d, ignore_errors=True)
    env = os.environ | {"PYTHONPATH": str(there)}
    for with_pipeline in (True, False):
        if not with_pipeline and (there / "corpus_pipeline.py").exists():
            os.remove(there / "corpus_pipeline.py")
        code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 150 and set(o) <= set(q) and 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q)"
        subprocess.run([sys.executable, "-c", code], cwd=there, env=env, check=True, timeout=120)
    found = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests", "-p", "no:cacheprovider"], cwd=there, env=env, capture_output=True, text=True, timeout=300)
    assert found.returncode == 0 and " error" not in found.stdout.splitlines()[-1], found.stdout[-2000:]
