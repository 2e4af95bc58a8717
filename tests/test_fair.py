import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import fair, learn, measure
from riskframe.operators.features import FeatureEncoder
from riskframe.plans import flows
from riskframe.plans.learning import FAIR_SPEC


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)], "id int, z int, y int, score double"
    )


def test_reweighing_makes_label_and_group_independent(apps):
    weighed = fair.reweigh(apps.select("app_id", "z", "y"))
    rates = weighed.groupBy("z").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("r"))
    first, second = [r["r"] for r in rates.collect()]
    assert first == pytest.approx(second)
    assert weighed.agg(F.sum("w")).first()[0] == pytest.approx(apps.count())


def test_reweighing_with_an_empty_cell_and_many_groups(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (2, 1), (2, 0)], "z int, y int")
    got = {(r["z"], r["y"]): r["w"] for r in fair.reweighing_table(df).collect()}
    assert got[(0, 0)] == pytest.approx((2 / 5) * (3 / 5) / (2 / 5))
    assert (0, 1) not in got and len(got) == 4
    assert fair.reweigh(df).filter("w IS NULL").count() == 0


def brute_force(rows, cuts, limit, two_sided, metric):
    best = None
    for (i, a), (j, b) in itertools.product(enumerate(cuts), enumerate(cuts)):
        pred = [s > (a if z == 0 else b) for z, _, s in rows]
        tpr = np.mean([p for p, (_, y, _) in zip(pred, rows) if y == 1])
        tnr = np.mean([not p for p, (_, y, _) in zip(pred, rows) if y == 0])
        acc = np.mean([p == (y == 1) for p, (_, y, _) in zip(pred, rows)])
        share = [np.mean([p for p, (z, _, _) in zip(pred, rows) if z == g]) for g in (0, 1)]
        gap = share[1] - share[0]
        if round(abs(gap) if two_sided else gap, 12) > limit:
            continue
        value = round((tpr + tnr) / 2 if metric == "balanced_accuracy" else acc, 12)
        if best is None or value > best[0]:
            best = (value, a, b)
    return best


@pytest.mark.parametrize("metric", ["balanced_accuracy", "accuracy"])
@pytest.mark.parametrize("two_sided", [True, False])
def test_threshold_search_against_all_pairs(spark, metric, two_sided):
    rng = np.random.default_rng(1)
    z = rng.integers(0, 2, 200)
    score = np.round(np.clip(rng.normal(0.4 + 0.2 * z, 0.2), 0, 1), 2)
    y = (score + rng.normal(0, 0.2, 200) > 0.5).astype(int)
    rows = list(zip(z.tolist(), y.tolist(), score.tolist()))
    df = frame(spark, rows)
    cuts = fair.candidate_thresholds(df, n_thresholds=9)
    got = fair.threshold_search(
        df, metric, constraint=0.05, n_thresholds=9, two_sided=two_sided
    ).first()
    want = brute_force(rows, cuts, 0.05, two_sided, metric)
    assert got["feasible"]
    assert (got[metric], got["threshold_0"], got["threshold_1"]) == pytest.approx(want)


def test_no_admissible_pair(spark):
    df = frame(spark, [(0, 0, 0.1), (0, 1, 0.2), (1, 0, 0.8), (1, 1, 0.9)])
    got = fair.threshold_search(df, constraint=-1.0).first()
    assert not got["feasible"]
    assert got["threshold_0"] is None and got["threshold_1"] is None
    with pytest.raises(ValueError):
        fair.threshold_search(df, perf_metric="auc")
    with pytest.raises(ValueError):
        fair.threshold_search(df, fair_metric="aod")


def test_unknown_groups_use_the_second_threshold(spark):
    df = frame(spark, [(0, 0, 0.5), (1, 0, 0.5), (7, 0, 0.5)])
    pred = [r["pred"] for r in fair.apply_thresholds(df, 0.5, 0.4).orderBy("id").collect()]
    assert pred == [0, 1, 1]


def test_constrained_fit_narrows_the_gap(apps):
    biased = apps.withColumn(
        "y", F.when((F.col("z") == 1) & (F.col("app_id") % 3 == 0), 1).otherwise(F.col("y"))
    ).withColumn("segment", F.col("z").cast("string"))
    encoder = FeatureEncoder(FAIR_SPEC.without("priority", "nation"), crit=9).fit(biased)
    ready = encoder.assemble(biased, ["app_id", "y", "z"]).cache()
    model, history = fair.constrained_fit(
        ready, learn.Classifier("logistic", {"C": 100.0}), tolerance=0.02, rounds=6, step=3.0
    )
    worst = [max(fpr, fnr) for _, fpr, fnr in history]
    assert len(history) > 1 and min(worst) < 0.7 * worst[0]
    flags = learn.hard_labels(learn.score_rows(model, ready)).withColumn("model", F.lit("m"))
    after = measure.fairness_report(flags).first()
    assert abs(after["aod"]) < worst[0]
    with pytest.raises(ValueError, match="constraint"):
        fair.constrained_fit(ready, learn.Classifier("logistic"), constraint="auc")


def test_thresholds_are_sought_on_stored_scores(apps, monkeypatch):
    """The search's passes do not score the training rows again."""
    plans, search = [], fair.threshold_search

    def watched(df, *rest, **more):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return search(df, *rest, **more)

    monkeypatch.setattr(fair, "threshold_search", watched)
    flags = flows.fairness_methods(apps.filter("app_id % 5 > 0"), apps.filter("app_id % 5 = 0"), FAIR_SPEC)
    assert flags.select("model").distinct().count() >= 4
    assert len(plans) == 1 and "UDF" not in plans[0]
