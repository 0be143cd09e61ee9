import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as contract

ROOT = Path(__file__).resolve().parent.parent


def test_entry_and_oracles(spark):
    assert contract.entry(spark).count() == 20
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_core_stands_without_the_corpus_package(tmp_path):
    code = "import sys; sys.path.insert(0, '.'); import __spark_entry__ as e; print(len([q for q in e.queries() if q.startswith('op') or q == 'pipeline']))"
    shutil.copytree(ROOT / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.strip() == "0"
