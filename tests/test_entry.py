"""The driver's contract: no operator goes missing unnoticed."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

REPO = Path(entry.__file__).parent


def test_every_problem_has_a_query():
    assert {n.split("_")[0] for n in entry.queries() if n[0] == "p" and n[1].isdigit()} == {f"p{i}" for i in range(1, 10)}


def test_a_broken_import_is_not_taken_for_a_missing_package(tmp_path):
    (tmp_path / "geoloom" / "plans").mkdir(parents=True)
    (tmp_path / "geoloom" / "llm").mkdir()
    for name, text in (("__init__", ""), ("plans/__init__", "from types import SimpleNamespace\ncore_queries = SimpleNamespace(QUERIES={}, ORACLE_SQL={})"), ("llm/__init__", ""), ("llm/queries", "import geoloom.llm.gone")):
        (tmp_path / "geoloom" / f"{name}.py").write_text(text)
    (tmp_path / "__spark_entry__.py").write_text((REPO / "__spark_entry__.py").read_text())
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(e.queries())"], cwd=tmp_path, capture_output=True, text=True)
    r = run()
    assert r.returncode and "geoloom.llm.gone" in r.stderr
    (tmp_path / "geoloom" / "llm").rename(tmp_path / "away")
    assert run().stdout.strip() == "{}"
