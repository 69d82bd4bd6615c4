"""The driver's contract, and plans without Python where SQL is enough."""

import subprocess
import sys

import __spark_entry__ as entry_module
from hopweave.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert set(ORACLES) <= set(QUERIES)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    assert "Python" not in plan(QUERIES["txt_features"](spark, SF))
    assert "WindowGroupLimit" in plan(QUERIES["vec_topk"](spark, SF))
    assert "LeftAnti" in plan(QUERIES["resume_anti_join"](spark, SF))
    scan = plan(QUERIES["eval_overall"](spark, SF))
    assert "n_chars" not in scan and "Python" not in scan


def test_import_without_session():
    """The driver lists the queries before it has a session."""
    code = "import __spark_entry__ as e; print(len(e.queries()) > 100, set(e.oracle_sql()) <= set(e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=entry_module.__file__.rpartition("/")[0])
    assert said.stdout.split() == ["True", "True"], said.stderr
