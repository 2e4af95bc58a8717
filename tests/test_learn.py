import random
import warnings

import pytest
from pyspark.sql import functions as F

from riskframe.functions.spec import FeatureSpec
from riskframe.operators import learn, measure, prep
from riskframe.plans.learning import FAIR_SPEC, SMALL_LOGISTIC
from riskframe.session import Shelf

SPEC = FAIR_SPEC
KEEP = ["app_id", "y"]


@pytest.fixture(scope="module")
def parts(apps):
    split = prep.holdout_split(apps, "app_id", seed=1).cache()
    return split.filter("part = 'train'"), split.filter("part = 'valid'")


def auc(flow, df):
    scored = flow.score(df, KEEP).withColumn("model", F.lit("m"))
    return measure.roc_auc(scored).first()["auc"]


@pytest.mark.parametrize(
    "kind,params",
    [
        ("logistic", {"C": 10.0}),
        ("logistic", {"C": 10.0, "penalty": "l1", "class_weight": "balanced"}),
        ("forest", {"n_estimators": 10, "max_depth": 4, "class_weight": "balanced"}),
        ("boosting", {"n_estimators": 5, "max_depth": 3}),
        ("perceptron", {"hidden_layers": [8], "max_iter": 60}),
    ],
)
def test_learners_rank_well(parts, kind, params):
    train, valid = parts
    flow = learn.fit_flow(train, SPEC, learn.Classifier(kind, params, seed=3))
    assert auc(flow, valid) > 0.75


def test_stronger_penalty_shrinks(parts):
    train, _ = parts
    sizes = []
    for c in (10.0, 1e-3):
        model = learn.fit_flow(train, SPEC, learn.Classifier("logistic", {"C": c})).model
        sizes.append(float(sum(abs(v) for v in model.coefficients)))
    assert sizes[1] < 0.5 * sizes[0]


def test_weights_change_the_fit(parts):
    train, _ = parts
    heavy = train.withColumn("w", F.when(F.col("y") == 1, 20.0).otherwise(1.0))
    plain = learn.fit_flow(heavy, SPEC, learn.Classifier("logistic"))
    loaded = learn.fit_flow(heavy, SPEC, learn.Classifier("logistic"), weight="w")
    assert loaded.model.intercept > plain.model.intercept + 1
    net = learn.Classifier("perceptron", {"hidden_layers": [4], "max_iter": 30}, seed=1)
    means = [
        learn.fit_flow(heavy, SPEC, net, weight=w).score(heavy, KEEP).agg(F.avg("score")).first()[0]
        for w in (None, "w")
    ]
    assert means[1] > means[0] + 0.1


def test_balanced_weights_sum_alike(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "y int")
    got = {r["y"]: r["w"] for r in learn.balanced_weights(df).collect()}
    assert got == {0: pytest.approx(4 / 6), 1: 2.0}
    got = {r["y"]: r["w"] for r in learn.balanced_weights(df, rule="one_over_c").collect()}
    assert got == {0: pytest.approx(1 / 3), 1: 1.0}


def test_unknown_kind_and_unused_parameters(parts):
    train, _ = parts
    with pytest.raises(ValueError, match="unknown classifier"):
        learn.Classifier("svm").fit(train)
    with pytest.raises(ValueError, match="no search space"):
        learn.suggest_space("svm")
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        learn.fit_flow(train, SPEC, learn.Classifier("logistic", {"num_leaves": 4}))
    assert any("num_leaves" in str(w.message) for w in caught)


def test_draws_stay_inside_their_space():
    rng = random.Random(0)
    for kind in learn.KINDS:
        space = learn.suggest_space(kind)
        assert set(space) <= learn.ACCEPTED[kind]
        for _ in range(50):
            for name, value in learn.draw(space, rng).items():
                spec = space[name]
                if spec["type"] == "categorical":
                    assert value in spec["choices"]
                else:
                    assert spec["low"] <= value <= spec["high"]
                    assert spec["type"] == "float" or isinstance(value, int)
    logs = [learn.draw({"c": {"type": "float", "low": 1e-3, "high": 1e3, "log": True}}, rng)["c"]
            for _ in range(300)]
    assert 0.35 < sum(v < 1 for v in logs) / 300 < 0.65
    with pytest.raises(ValueError, match="unknown parameter type"):
        learn.draw({"c": {"type": "text"}}, rng)


def test_searches_are_reproducible_and_pick_the_best(parts):
    train, valid = parts
    runs = [
        learn.search_fast("logistic", SMALL_LOGISTIC, train, valid, SPEC, n_trials=3, seed=5,
                          parallelism=p)
        for p in (1, 3)
    ]
    assert runs[0].best_params == runs[1].best_params
    assert runs[0].best_value == max(v for _, v in runs[0].trials) and len(runs[0].trials) == 3
    slow = learn.search_holdout("logistic", SMALL_LOGISTIC, train, valid, SPEC, n_trials=3, seed=5)
    assert slow.best_params == runs[0].best_params
    assert slow.best_value == pytest.approx(runs[0].best_value, abs=1e-6)
    assert auc(slow.flow, valid) == pytest.approx(slow.best_value, abs=1e-6)


def test_search_over_folds_and_with_a_time_limit(parts):
    train, valid = parts
    found = learn.search_folds("logistic", SMALL_LOGISTIC, train, SPEC, folds=2, n_trials=1, seed=2)
    assert found.best_value > 0.75
    with pytest.raises(ValueError, match="validation set"):
        learn.search_folds("logistic", SMALL_LOGISTIC, train, SPEC, weight="w")
    short = learn.search_fast("logistic", SMALL_LOGISTIC, train, valid, SPEC, timeout=0.0)
    assert len(short.trials) == 1


def test_scorers_of_folds_read_stored_scores(parts):
    """A scorer's passes neither encode nor score the held-out rows again."""
    plans = []

    def scorer(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df.agg(F.avg("score").alias("value"))

    found = learn.search_folds("logistic", SMALL_LOGISTIC, parts[0], SPEC, folds=2, n_trials=1, seed=2, scorer=scorer)
    assert 0 < found.best_value < 1
    assert len(plans) == 2 and not any("UDF" in p for p in plans)


def test_folded_encoders_equal_fits_per_fold(spark, apps):
    odd = apps.withColumns({
        "amount": F.when(F.col("app_id") % 7 == 0, None).otherwise(F.col("amount")),
        "balance": F.when(F.col("app_id") % 11 == 0, float("nan")).otherwise(F.col("balance")),
        "segment": F.when(F.col("app_id") % 5 == 0, None).otherwise(F.col("segment")),
        "y": F.when(F.col("app_id") % 13 == 0, -1).otherwise(F.col("y")),
    })
    spec = FeatureSpec("app_id", "y", None, ("amount", "balance"), ("segment", "nation", "kind"))
    odd = odd.withColumn("kind", F.when(F.col("z") == 1, "p").otherwise("o"))
    dealt = prep.stratified_folds(odd, "app_id", "y", 3, seed=1).cache()
    encoder = learn.FeatureEncoder(spec)
    with Shelf(spark, "test") as shelf:
        folded = learn.FoldedFit(encoder, dealt, shelf)
        for number in (0, 1, 2, None):
            part = dealt if number is None else dealt.filter(F.col("fold") != number)
            want, got = encoder.fit(part), folded.without(number)
            assert (got.state.levels, got.state.modes, got.state.target) == (
                want.state.levels, want.state.modes, want.state.target)
            assert got.state.overall == pytest.approx(want.state.overall, rel=1e-12)
            for name in ("means", "scales"):
                assert getattr(got.state, name) == pytest.approx(getattr(want.state, name), rel=1e-12)
            rows = [{r["app_id"]: r["features"] for r in m.assemble(dealt, ["app_id"]).collect()} for m in (want, got)]
            assert rows[0].keys() == rows[1].keys()
            assert all(rows[1][k].toArray() == pytest.approx(v.toArray(), abs=1e-9) for k, v in rows[0].items())
        assert shelf.paths
    assert not shelf.paths


def test_trials_start_as_others_end_and_keep_the_best():
    space = {"v": {"type": "float", "low": 0.0, "high": 1.0}}
    for parallelism in (1, 4):
        trials, best, made = learn._run_trials(
            lambda p: (round(p["v"], 1), p["v"]), space, 30, None, 3, parallelism)
        assert len(trials) == 30 and best == max(range(30), key=lambda i: (trials[i][1], -i))
        assert made == trials[best][0]["v"]


def test_custom_scorer_sees_labels_at_the_ks_cutoff(parts):
    train, valid = parts
    seen = []

    def share_approved(df):
        seen.append(set(df.columns))
        return df.groupBy("model").agg(F.avg(1 - F.col("pred")).alias("value"))

    found = learn.search_fast("logistic", SMALL_LOGISTIC, train, valid, SPEC, n_trials=1,
                              scorer=share_approved)
    assert {"model", "y", "z", "score", "pred"} <= seen[0]
    assert 0 < found.best_value < 1


def test_flow_scorer_and_scorecard_agree_with_the_flow(parts):
    train, valid = parts
    marked = [d.withColumn("kind", F.when(F.col("z") == 1, "p").otherwise("o")) for d in parts]
    spec = FeatureSpec("app_id", "y", None, ("amount", "balance"), ("kind", "segment"))
    flow = learn.fit_flow(marked[0], spec, learn.Classifier("logistic", {"C": 10.0}))
    want = {r["app_id"]: r["score"] for r in flow.score(marked[1], ["app_id"]).collect()}
    for scaled in (True, False):
        scorer = learn.FlowScorer(flow, scaled)
        plain = scorer.encode(marked[1])
        assert scorer.features == ["amount", "balance", "kind", "segment"]
        scored = scorer.score(plain)
        assert scored.columns == [*plain.columns, "score"]
        got = {r["app_id"]: r["score"] for r in scored.collect()}
        assert got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}
    card = learn.scorecard_of(flow)
    rows = card.score(flow.encoder.encode(marked[1], scale=False))
    got = {r["app_id"]: r["score"] for r in rows.collect()}
    assert got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}
