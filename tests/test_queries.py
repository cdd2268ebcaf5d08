"""Every registered query on the small tables, against its SQL on DuckDB; plan checks."""

import pytest

import check
from __spark_entry__ import entry
from labelops.plans.catalog import ORACLE, QUERIES

WITHOUT_SQL = {
    "m14_throughput",
    "u1_score_in_batches", "u5_train_classifier", "u6_run_grid", "u7_best_by_ap", "u8_training_history",
}


@pytest.fixture(scope="module")
def duck(small_dir):
    with check.connect(small_dir) as db:
        yield db


def test_registry_is_complete():
    assert set(QUERIES) - set(ORACLE) == WITHOUT_SQL
    assert set(ORACLE) <= set(QUERIES)
    numbers = {"s": 12, "v": 6, "p": 14, "j": 9, "a": 14, "w": 6, "x": 4, "f": 17, "b": 6, "m": 14, "u": 8}
    registered = {part for name in QUERIES for part in name.split("_")}
    assert [f"{k}{i}" for k, n in numbers.items() for i in range(1, n + 1) if f"{k}{i}" not in registered] == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, small_dir, name):
    verdict = check.compare(spark, duck, name, small_dir)
    assert verdict.startswith(("ok", "rows only")) and "TYPES" not in verdict, verdict


def test_entry(spark, small_dir):
    row = entry(spark).first()
    assert 0 < row["f1_h"] < 1 and row["tp"] <= min(row["n_pred"], row["n_gold"])


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n[0] in "apjxmwf" and not n.startswith("m14_")))
def test_plan_has_no_cross_join_or_python(spark, small_dir, name):
    plan = QUERIES[name](spark, small_dir)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "MapInPandas"):
        assert bad not in plan, bad


def test_scan_reads_needed_columns_only(spark, small_dir):
    plan = QUERIES["a1_label_support"](spark, small_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint>" in plan
