import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from riskframe.operators import measure

SCHEMA = "model string, id int, y int, z int, score double"


def scored(spark, rows):
    return spark.createDataFrame([("m", i, *r) for i, r in enumerate(rows)], SCHEMA)


def one(df):
    return df.first().asDict()


def test_all_scores_tied(spark):
    df = scored(spark, [(1, 0, 0.4), (0, 1, 0.4), (1, 1, 0.4), (0, 0, 0.4)])
    assert one(measure.roc_auc(df))["auc"] == 0.5
    best = one(measure.ks_cutoff(df))
    assert best["threshold"] is None and best["ks"] == 0.0
    assert one(measure.fpr_cutoff(df, 0.25))["threshold"] == 0.5
    assert one(measure.fpr_cutoff(df, 1.0))["threshold"] == 0.4


def test_one_class(spark):
    df = scored(spark, [(1, 0, 0.2), (1, 1, 0.8)])
    report = one(measure.comparison_report(df, 0.5))
    assert report["auc"] is None
    assert report["balanced_accuracy"] == 0.5  # recall of the only class
    assert report["precision"] == 1.0 and report["recall"] == 0.5
    assert one(measure.false_positive_rate(measure.threshold_predictions(df)))["fpr"] is None
    # without negatives every score is admissible
    assert one(measure.fpr_cutoff(df, 0.25))["threshold"] == 0.2


def test_no_positive_prediction(spark):
    df = scored(spark, [(1, 0, 0.2), (0, 1, 0.1)])
    report = one(measure.comparison_report(df, 0.9))
    assert (report["precision"], report["recall"], report["f1"]) == (0.0, 0.0, 0.0)


def test_extreme_scores(spark):
    df = scored(spark, [(1, 0, 1.0), (0, 1, 0.0), (1, 1, 1.0), (0, 0, 0.0)])
    assert one(measure.roc_auc(df))["auc"] == 1.0
    assert one(measure.brier_score(df))["brier"] == 0.0
    assert one(measure.ks_cutoff(df)) == {"model": "m", "threshold": 1.0, "ks": 1.0}


def test_empty_group_has_no_gap(spark):
    df = measure.threshold_predictions(scored(spark, [(1, 0, 0.9), (0, 0, 0.1)]))
    report = one(measure.fairness_report(df))
    assert report["dpd"] is None and report["gma"] is None
    assert report["balanced_accuracy"] == 1.0
    assert one(measure.fairness_scorer(0.1)(df))["value"] is None


def test_model_without_scores_keeps_its_predictions(spark):
    rows = [("s", 0, 1, 0, 0.9, None), ("s", 1, 0, 0, 0.2, None)]
    rows += [("p", 0, 1, 0, None, 0), ("p", 1, 0, 0, None, 0)]
    df = spark.createDataFrame(rows, SCHEMA + ", pred int")
    report = {r["model"]: r for r in measure.comparison_report(df).collect()}
    assert report["s"]["auc"] == 1.0 and report["s"]["accuracy"] == 1.0
    assert report["p"]["auc"] is None and report["p"]["brier"] is None
    assert report["p"]["accuracy"] == 0.5


def test_thresholds_as_number_mapping_and_table(spark):
    df = scored(spark, [(1, 0, 0.6), (0, 1, 0.4)])
    table = spark.createDataFrame([("m", 0.7)], "model string, threshold double")
    counts = [
        one(measure.threshold_predictions(df, t).agg(F.sum("pred").alias("n")))["n"]
        for t in (0.5, {"m": 0.3}, {"other": 0.1}, table)
    ]
    assert counts == [1, 2, 1, 0]


def test_benefit_class_swaps_the_roles(spark):
    rows = [(1, 1, 0.9), (0, 1, 0.8), (0, 1, 0.2), (1, 0, 0.7), (0, 0, 0.6), (0, 0, 0.1)]
    df = measure.threshold_predictions(scored(spark, rows))
    bad, good = one(measure.fairness_report(df)), one(measure.fairness_report(df, benefit_class=0))
    assert bad["dpd"] == pytest.approx(-good["dpd"])
    assert bad["gma"] == pytest.approx(good["gma"])


def test_penalised_score(spark):
    rows = [(1, 1, 0.9), (1, 1, 0.8), (0, 1, 0.2), (1, 0, 0.7), (1, 0, 0.4), (0, 0, 0.1)]
    df = measure.threshold_predictions(scored(spark, rows))
    auc = one(measure.roc_auc(df))["auc"]
    eod = one(measure.equal_opportunity(df))["eod"]
    assert eod == 0.5
    assert one(measure.fairness_scorer(0.6)(df))["value"] == pytest.approx(auc)
    assert one(measure.fairness_scorer(0.1)(df))["value"] == pytest.approx(auc - 10 * (eod - 0.1))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.tuples(st.integers(0, 1), st.integers(0, 1), st.sampled_from([0.1, 0.2, 0.5, 0.7])),
        min_size=2,
        max_size=30,
    )
)
def test_auc_by_counting_pairs_and_under_monotone_change(spark, rows):
    df = scored(spark, rows)
    good = [s for y, _, s in rows if y == 0]
    bad = [s for y, _, s in rows if y == 1]
    got = one(measure.roc_auc(df))["auc"]
    if not good or not bad:
        assert got is None
        return
    wins = sum((b > g) + 0.5 * (b == g) for b in bad for g in good)
    assert got == pytest.approx(wins / (len(good) * len(bad)))
    moved = df.withColumn("score", F.exp("score") * 3 - 1)
    assert one(measure.roc_auc(moved))["auc"] == pytest.approx(got)


@pytest.mark.parametrize("partitions", [1, 4, 37])
def test_reports_do_not_depend_on_partitioning(spark, apps, partitions):
    long = measure.scored_long(
        apps.repartition(partitions), ["score_a", "score_b"], ["app_id", "y", "z"]
    )
    got = measure.comparison_report(long, measure.ks_cutoff(long)).orderBy("model").collect()
    base = measure.scored_long(apps, ["score_a", "score_b"], ["app_id", "y", "z"])
    want = measure.comparison_report(base, measure.ks_cutoff(base)).orderBy("model").collect()
    for a, b in zip(got, want):
        assert all(
            x == y or math.isclose(x, y, abs_tol=1e-12) for x, y in zip(a[1:], b[1:])
        ) and a[0] == b[0]


def test_bucketed_curve_gives_the_same_report(spark, apps):
    long = measure.scored_long(apps, ["score_a", "score_b"], ["app_id", "y", "z"])
    bounds = [i / 50 for i in range(1, 50)]
    for metric in (measure.roc_auc, measure.ks_cutoff, measure.fpr_cutoff):
        plain = sorted(metric(long, bounds=[]).collect())
        cut = sorted(metric(long, bounds=bounds).collect())
        for a, b in zip(plain, cut):
            assert a[0] == b[0] and a[1:] == pytest.approx(b[1:])


def test_cutoffs_read_the_facts_once_besides_the_sketch(spark, tmp_path, monkeypatch):
    """Curve and class sizes need one table of counts, whatever the number of buckets."""
    rng = np.random.default_rng(2)
    rows = [(m, float(round(s, 3)), int(rng.random() < s)) for m in "ab" for s in rng.random(400)]
    rows += [("b", None, 1), ("c", 0.5, 1)]
    path = str(tmp_path / "facts")
    spark.createDataFrame(rows, "model string, score double, y int").write.parquet(path)
    facts = spark.read.parquet(path)
    whole = {}
    for keys in (measure.KEYS_PER_BUCKET, 50):
        monkeypatch.setattr(measure, "KEYS_PER_BUCKET", keys)
        sizes, bounds = measure.score_sketch(facts)
        known = [r for r in rows if r[1] is not None]
        assert sizes == {m: tuple(sum(r[0] == m and r[2] == y for r in rows) for y in (1, 0)) for m in "abc"}
        assert (len(bounds) == 0) if keys > 1000 else 10 <= len(bounds) <= len(known) / 50 + 1
        for make in (measure.ks_cutoff, measure.fpr_cutoff, measure.comparison_report):
            found = make(facts)
            result = sorted(tuple(r) for r in found.collect())
            ran = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
            assert "Final Plan" in ran and ran.count("FileScan") <= 1
            assert whole.setdefault(make.__name__, result) == result

