"""The driver's contract, with and without the training-data part."""

import importlib
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).parent.parent


def test_flagship_and_names(spark):
    if Path("/root/testdata/sf0.001").is_dir():
        assert entry.entry(spark).columns == ["source", "landed", "parsed_ok", "duplicates", "quarantined", "quarantine_rate"]
    assert set(entry.oracle_sql()) <= set(entry.queries()) and "silver_outcome" in entry.queries()


def test_an_error_inside_a_part_is_not_hidden(monkeypatch):
    def broken(name):
        raise ModuleNotFoundError("no module", name="numpy")

    monkeypatch.setattr(importlib, "import_module", broken)
    with pytest.raises(ModuleNotFoundError):
        entry.queries()
    monkeypatch.setattr(importlib, "import_module", lambda name: (_ for _ in ()).throw(ModuleNotFoundError("gone", name="docstrata.llm")))
    assert entry._part("docstrata.llm.queries") is None


def test_without_the_training_data_part(tmp_path):
    for name in ("docstrata", "tests", "__spark_entry__.py", "bench.py"):
        source = ROOT / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    for name in ("docstrata/llm", "tests/llm"):
        shutil.rmtree(tmp_path / name, ignore_errors=True)
    code = "import __spark_entry__ as e, bench; q = e.queries(); assert 'silver_outcome' in q and not any(n.startswith('op1') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, capture_output=True)
    found = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=tmp_path, capture_output=True, text=True)
    assert found.returncode == 0 and "error" not in found.stdout.lower().splitlines()[-1]
