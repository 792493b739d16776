"""What the physical plans must, and must not, contain."""

import re

import pytest

from evalmill.operators import ordered
from evalmill.plans.catalog import QUERIES
from evalmill.session import session_conf

SF = "/root/testdata/sf0.01"

# Queries whose functions already run jobs (they write); the rest only build a plan.
WRITES = {"dataset_materialise", "payload_write", "report_write", "run_status_stream", "training_export", "training_export_capped",
          "benchmark_by_subject", "benchmark_running", "benchmark_samples", "benchmark_report",
          "run_to_payloads", "run_path_files", "run_path_rejects", "run_status_rejects", "index_stored", "file_manifest",
          "payload_files", "zip_scores", "file_payload_flags", "eval_report"}
PYTHON = {"batch_predict", "benchmark_eval"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.collect()
    return plan_of(df)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITES))
def test_no_cross_join_no_python_no_global_window(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    python = re.search(r"MapInArrow|MapInPandas|ArrowEvalPython|BatchEvalPython", plan)
    assert (python is not None) == (name in PYTHON)
    if "Window" in plan:
        # Nothing is brought into one task for a window.
        for line in plan.splitlines():
            if "Window [" in line or "Window(" in line:
                assert re.search(r"\], \[[^\]]+\]", line), line


@pytest.mark.parametrize(
    "name", ["accuracy_by_subject", "overall_accuracy", "running_accuracy", "coverage_counts",
             "coverage_listing", "tagged_channels", "batch_plan", "head_n", "dataset_scan"]
)
def test_texts_are_not_read_by_queries_that_do_not_need_them(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas and all("text:" not in s for s in schemas)


def test_split_is_pushed_to_the_scan(spark):
    assert "EqualTo(source,src3)" in plan_of(QUERIES["dataset_scan"](spark, SF))


def test_cap_is_pushed_to_the_scan(spark):
    df = ordered.head_n(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", 5)
    plan = plan_of(df)
    assert re.search(r"PushedFilters: \[[^\]]*LessThanOrEqual\(doc_id", plan) or "ScalarSubquery" in plan
    assert df.count() == 5


def test_running_totals_shuffle_the_rows_once(spark):
    plan = final_plan(QUERIES["running_accuracy"](spark, SF))
    final = plan[: plan.index("== Initial Plan ==")]
    shuffles = [line for line in final.splitlines() if "REPARTITION_BY_COL" in line]
    assert sorted("ReusedExchange" in line for line in shuffles) == [False, True, True]


def test_benchmark_needs_no_join_after_the_predictor(spark):
    plan = plan_of(QUERIES["benchmark_eval"](spark, SF))
    above = plan[: plan.index("MapInArrow")]
    assert "Join" not in above
    assert above.count("Exchange") == 1


def test_rollup_expands_tallies_not_rows(spark):
    plan = plan_of(QUERIES["accuracy_rollup"](spark, SF))
    assert plan.index("Expand") < plan.index("Join")
    between = plan[plan.index("Expand"): plan.index("Join")]
    assert "HashAggregate" in between


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITES))
def test_nothing_is_broadcast_by_hint(spark, name):
    with session_conf(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        plan = plan_of(QUERIES[name](spark, SF))
    assert "BroadcastExchange" not in plan


def test_requests_are_checked_once(spark):
    plan = plan_of(QUERIES["training_requests"](spark, SF))
    assert plan.split("(1)")[0].count("Generate") == 1
    assert len(re.findall(r"Scan parquet[^\n]*\n", plan.split("\n\n")[0])) <= 2


def test_vision_requests_are_decoded_once(spark):
    plan = plan_of(QUERIES["vision_requests"](spark, SF))
    assert len(re.findall("FileScan parquet", plan)) <= 3  # requests, files, and nothing twice


@pytest.mark.parametrize("name", ["param_layering", "training_recipe"])
def test_layers_are_dealt_out_before_they_are_sorted(spark, name):
    """A task that makes rows from a whole file of requests does not sort and combine them as well."""
    lines = plan_of(QUERIES[name](spark, SF)).splitlines()
    partial = [k for k, line in enumerate(lines) if "partial_max_by" in line]
    assert partial
    for k in partial:
        below = [re.sub(r"^[\s:+*()\d-]*", "", line) for line in lines[k + 1 : k + 4]]
        first = next(line for line in below if not line.startswith(("Sort ", "Project ")))
        assert first.startswith("Exchange hashpartitioning"), below
