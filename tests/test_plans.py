"""The shape of the physical plans, and the rules about shared storage."""

import os
import re
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from riskframe.functions.ordering import running_totals
from riskframe.operators import explain, fair, measure, rejects
from riskframe.operators.features import FeatureEncoder
from riskframe.operators.neighbours import distinct_vectors
from riskframe.plans.encoding import SPEC, gaps
from riskframe.plans.fixtures import CARD, table

ROOT = Path(__file__).resolve().parent.parent


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def facts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderkey").alias("app_id"),
        F.col("o_totalprice").alias("amount"),
        (F.col("o_totalprice") / 10).alias("balance"),
        (F.col("o_orderkey") % 2).cast("int").alias("y"),
        (F.col("o_orderkey") % 3 % 2).cast("int").alias("z"),
        (F.col("o_totalprice") / 500000).alias("score"),
    ).withColumn("model", F.lit("m"))


def test_reports_shuffle_partial_aggregates_only(facts):
    text = plan(measure.fairness_report(measure.threshold_predictions(facts)))
    assert text.count("Exchange") == 1 and "partial_" in text
    assert "BatchEvalPython" not in text
    # only the needed columns are read
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>", text)


def test_running_totals_never_order_the_table_in_one_task(facts):
    counts = facts.groupBy("y", "amount").agg(F.count("*").alias("n"))
    bounds = [1e5, 2e5, 3e5]
    text = plan(running_totals(counts, "amount", {"n": "upto"}, ["y"], bounds=bounds))
    assert "SinglePartition" not in text
    # without groups only the bucket totals, a few rows, meet in one task
    counts = facts.groupBy("amount").agg(F.count("*").alias("n"))
    text = plan(running_totals(counts, "amount", {"n": "upto"}, bounds=bounds))
    assert re.search(
        r"Exchange SinglePartition[^\n]*\n[ :+\-]*HashAggregate\(keys=\[__bucket", text
    )
    assert text.count("SinglePartition") == 1
    assert re.search(r"hashpartitioning\(__bucket", text)


def test_threshold_search_reads_the_rows_once(facts):
    text = plan(fair.threshold_search(facts, thresholds=[i / 10 for i in range(10)]))
    assert text.count("FileScan") == 1
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_encoding_is_one_stage(spark, sf_dir):
    encoder = FeatureEncoder(SPEC).fit(gaps(spark, sf_dir))
    raw = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("app_id"),
        F.col("o_totalprice").alias("amount"),
        F.lit(1.0).alias("balance"),
        F.lit("BUILDING").alias("segment"),
        F.col("o_orderpriority").alias("priority"),
        F.lit("FRANCE").alias("nation"),
        F.lit("plant").alias("kind"),
    )
    text = plan(encoder.encode(raw))
    assert "SortMergeJoin" not in text and "hashpartitioning" not in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_weights_and_parcels_do_not_shuffle(facts):
    marked = facts.withColumn("y", F.when(F.col("app_id") % 5 == 0, -1).otherwise(F.col("y")))
    for out in (
        rejects.upward(marked, "score"),
        rejects.downward(marked, "score"),
        rejects.fuzzy_parcels(marked, "score"),
        rejects.extrapolate(marked, "score", "all"),
    ):
        assert "Exchange" not in plan(out)


def test_scorecard_explanations_do_not_shuffle(facts):
    background = explain.background_rows(facts, CARD, "app_id", 5)
    assert "Exchange" not in plan(explain.shapley_values(facts, CARD, "app_id", background))
    curves = explain.individual_curves(facts, CARD, "app_id", "amount", [1.0, 2.0], rebase=True)
    assert "Exchange" not in plan(curves)
    dependence = plan(explain.partial_dependence(facts, CARD, ["amount"], {"amount": [1.0, 2.0]}))
    assert "partial_avg" in dependence


def test_copies_of_a_vector_are_cut_before_the_shuffle(spark):
    df = spark.range(100).select("id", F.array(F.lit(1.0)).alias("v"))
    text = plan(distinct_vectors(df, "id", "v", 5))
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text


def test_sources_follow_the_rules():
    banned = ["localCheckpoint", "crossJoin(", ".rdd.map", "toPandas(", "/tmp"]
    for path in (ROOT / "riskframe").rglob("*.py"):
        text = path.read_text()
        assert not [b for b in banned if b in text], path


def test_shared_folder_is_the_configured_one(spark, monkeypatch):
    from riskframe import session

    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        assert session.shared_folder(spark) == folder
    assert session.scratch_path(spark, "x") != session.scratch_path(spark, "x")

    class Conf:
        def get(self, name, default=None):
            return default

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="share"):
        session.shared_folder(Session())


def test_batch_functions_reach_workers_without_the_package(sf_dir, tmp_path):
    """Python workers start in a folder from which the package cannot be imported."""
    script = tmp_path / "elsewhere.py"
    script.write_text(
        "import sys\n"
        f"sys.path[:0] = [{str(ROOT)!r}, {str(ROOT / 'tests')!r}]\n"
        "from oracle import session\n"
        "from riskframe.plans.catalog import catalog\n"
        "spark = session('2')\n"
        "for key in ('g05_shapley_values', 'g08_local_surrogate', 'g09_minimal_changes',\n"
        "            'g10_diverse_counterfactuals', 'r06_label_spreading'):\n"
        f"    assert catalog()[key][0](spark, {sf_dir!r}).count() > 0, key\n"
        "print('all there')\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    assert "all there" in done.stdout, done.stderr[-2000:]
