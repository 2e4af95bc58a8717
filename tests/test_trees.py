"""Tree models: exact effects against all coalitions, and boosting under group constraints."""

import math

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from riskframe.functions.scorecard import ModelScorer
from riskframe.functions.spec import FeatureSpec
from riskframe.operators import constrained, explain, fair, learn, trees

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def df(spark):
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=(2, 400)).round(3)
    c = rng.integers(0, 4, 400)
    y = (1.5 * a - b * (c > 1) + rng.normal(size=400) > 0.3).astype(int)
    z = (rng.random(400) < 0.3 + 0.3 * (a > 0)).astype(int)
    rows = [(i, float(a[i]), float(b[i]), float(c[i]), int(y[i]), int(z[i])) for i in range(400)]
    plain = spark.createDataFrame(rows, "id int, a double, b double, c double, y int, z int")
    return VectorAssembler(inputCols=NAMES, outputCol="features").transform(plain).cache()


def value_of(boxes, base, x):
    return base + sum(
        box.value for box in boxes if all(not (x[f] <= low) and (high == math.inf or x[f] <= high) for f, (low, high) in box.sides.items())
    )


def enumerated(boxes, base, x, background):
    """Every coalition of features, averaged over the background rows."""
    k = len(x)
    worth = {}
    for mask in range(1 << k):
        mixed = [[x[j] if mask >> j & 1 else b[j] for j in range(k)] for b in background]
        worth[mask] = np.mean([value_of(boxes, base, m) for m in mixed])
    out = []
    for j in range(k):
        total = 0.0
        for mask in range(1 << k):
            if not mask >> j & 1:
                s = bin(mask).count("1")
                total += math.factorial(s) * math.factorial(k - s - 1) / math.factorial(k) * (worth[mask | 1 << j] - worth[mask])
        out.append(total)
    return out


def models(df):
    yield DecisionTreeClassifier(labelCol="y", maxDepth=4, seed=1).fit(df), False
    yield RandomForestClassifier(labelCol="y", numTrees=6, maxDepth=4, seed=1).fit(df), False
    yield GBTClassifier(labelCol="y", maxIter=4, maxDepth=3, seed=1).fit(df), True
    yield constrained.constrained_boosting(df, rounds=4, max_depth=3, multiplier_step=5.0, tolerance=0.0), True


def test_effects_equal_the_enumeration(df):
    background = [r.asDict() for r in df.filter("id >= 300").select(*NAMES).collect()]  # 100 rows
    points = [[b[n] for n in NAMES] for b in background]
    few = df.filter("id < 12")
    for model, margin in models(df):
        base, boxes, link = trees.boxes_of(model)
        scorer = ModelScorer(model, NAMES)
        scored = model.score(few) if isinstance(model, constrained.ConstrainedBoosting) else scorer.score(few, "score")
        found = trees.tree_effects(few, model, NAMES, "id", background, margin)
        plan = found._jdf.queryExecution().toString()
        assert "Exchange" not in plan
        got = {r["id"]: r for r in found.collect()}
        for r in scored.collect():
            x = [r[n] for n in NAMES]
            total = value_of(boxes, base, x)
            assert r["score"] == pytest.approx(total if link is None else 1 / (1 + math.exp(-link * total)), abs=1e-12)
            want = enumerated(boxes, base, x, points)
            assert [got[r["id"]][n] for n in NAMES] == pytest.approx(want, abs=1e-12)
    with pytest.raises(ValueError, match="margin"):
        trees.tree_effects(few, model, NAMES, "id", background)


def test_effects_equal_those_of_the_general_operator(df):
    model = RandomForestClassifier(labelCol="y", numTrees=3, maxDepth=3, seed=2).fit(df)
    scorer = ModelScorer(model, NAMES)
    background = explain.background_rows(df, scorer, "id", 5)
    few = df.filter("id < 20").select("id", *NAMES)
    plain = {r["id"]: r for r in explain.shapley_values(few, scorer, "id", background).collect()}
    for r in trees.tree_effects(few, model, NAMES, "id", background).collect():
        assert [r[n] for n in NAMES] == pytest.approx([plain[r["id"]][n] for n in NAMES], abs=1e-9)


def test_many_path_features_and_odd_rows(spark, df, monkeypatch):
    model = DecisionTreeClassifier(labelCol="y", maxDepth=5, seed=1).fit(df)
    background = [r.asDict() for r in df.limit(30).select(*NAMES).collect()]
    some = df.select("id", *NAMES).limit(40).unionByName(spark.createDataFrame([(-1, None, 0.0, float("nan"))], "id int, a double, b double, c double"))
    tabled = sorted(tuple(r) for r in trees.tree_effects(some, model, NAMES, "id", background).collect())
    monkeypatch.setattr(trees, "TABLED", 0)
    assert np.allclose(sorted(tuple(r) for r in trees.tree_effects(some, model, NAMES, "id", background).collect()), tabled, atol=1e-12)
    none = trees.tree_effects(some, model, NAMES, "id", []).collect()
    assert len(none) == 41 and all(r["a"] is None for r in none)
    assert trees.tree_effects(some.limit(0), model, NAMES, "id", background).count() == 0


def test_constraints_narrow_the_gap(df):
    biased = df.withColumn("y", F.when((F.col("z") == 1) & (F.col("id") % 3 == 0), 1).otherwise(F.col("y")))
    biased = biased.withColumn("z", F.when(F.col("a") > 0.4, 1).otherwise(F.col("z")))
    options = dict(rounds=30, max_depth=3, learning_rate=0.2)
    free = constrained.constrained_boosting(biased, multiplier_step=0.0, **options)
    bound = constrained.constrained_boosting(biased, multiplier_step=3.0, tolerance=0.02, **options)
    assert len(bound.trees) == 30 and len(bound.history) == 30 and not free.history[-1][3]
    worst = lambda m: np.mean([max(h[1], h[2]) for h in m.history[-5:]])
    assert worst(bound) < 0.6 * worst(free)
    # the fit is one of boosting: it ends below the reweighed logistic model's gap
    flags = []
    weighed = fair.reweigh(biased, "z", "y")
    logistic = learn.Classifier("logistic", {"C": 10.0}).fit(weighed, weight="w", id="id")
    scores = {"bound": bound.score(biased), "reweighed": learn.score_rows(logistic, biased)}
    for name, scored in scores.items():
        rows = scored.select(F.lit(name).alias("model"), "y", "z", "score", (F.col("score") >= 0.5).cast("int").alias("pred"))
        flags.append(rows)
    counts = {n: {(r["z"], r["y"]): r["e"] for r in f.groupBy("z", "y").agg(F.avg((F.col("pred") != F.col("y")).cast("int")).alias("e")).collect()} for n, f in zip(scores, flags)}
    gap = {n: max(abs(c[0, y] - c[1, y]) for y in (0, 1)) for n, c in counts.items()}
    assert gap["bound"] < gap["reweighed"]


def test_constrained_boosting_of_odd_tables(spark, df):
    one = df.filter("y = 1")
    model = constrained.constrained_boosting(one)
    assert not model.trees and {round(r["score"], 3) for r in model.score(one).collect()} == {1.0}
    assert not constrained.constrained_boosting(df.limit(0)).trees
    twice = df.unionByName(df)
    weighed = df.withColumn("w", F.lit(2.0))
    a = constrained.constrained_boosting(twice, rounds=3, max_depth=2).score(df)
    b = constrained.constrained_boosting(weighed, rounds=3, max_depth=2, weight="w").score(df)
    left, right = ({r["id"]: r["score"] for r in s.collect()} for s in (a, b))
    assert all(left[k] == pytest.approx(right[k], abs=1e-9) for k in left)
    with pytest.raises(ValueError, match="constraint"):
        constrained.constrained_boosting(df, constraint="auc")


def test_violations():
    rates = {0: {"fpr": 0.1, "fnr": None}, 1: {"fpr": 0.3, "fnr": 0.5}}
    gaps, over = constrained.error_gaps(rates, {"fpr", "fnr"}, 0.05)
    assert gaps == {"fpr": pytest.approx(0.2), "fnr": 0.0}
    assert over == {(0, 0): pytest.approx(-0.05), (1, 0): pytest.approx(0.15), (1, 1): pytest.approx(-0.05)}


def test_dependence_of_tree_models_equals_brute_force(df, monkeypatch):
    """20 x 20 points and one feature, without a copy of any row."""
    grids = {"a": np.linspace(-2, 2, 20).tolist(), "b": np.linspace(-1.5, 1.5, 20).tolist()}
    x = np.array(df.select(*NAMES).collect(), float)
    for model, _ in models(df):
        scorer = ModelScorer(model, NAMES)
        monkeypatch.setattr(ModelScorer, "score", None)  # not asked
        base, boxes, link = trees.boxes_of(model)

        def chance(rows):
            total = base + sum(b.value * (b.holds(rows) == (1 << len(b.sides)) - 1) for b in boxes)
            return total if link is None else 1 / (1 + np.exp(-link * total))

        got = {(r["a"], r["b"]): r["average"] for r in explain.partial_dependence(df, scorer, ["a", "b"], grids).collect()}
        assert len(got) == 400
        for (a, b), average in got.items():
            moved = x.copy()
            moved[:, 0], moved[:, 1] = a, b
            assert average == pytest.approx(chance(moved).mean(), abs=1e-12)
        monkeypatch.undo()
        at = float(x[7, 2])
        fixed = scorer.score(df.select("a", "b", F.lit(at).alias("c"))).agg(F.avg("score")).first()[0]
        one = explain.partial_dependence(df, scorer, ["c"], {"c": [at, 9.0]}).collect()
        assert {r["c"]: r["average"] for r in one}[at] == pytest.approx(fixed, abs=1e-12)


def test_dependence_of_flows_and_logistic_models(df):
    spec = FeatureSpec("id", "y", None, ("a", "b"), ("c",))
    marked = df.withColumn("c", F.concat(F.lit("k"), F.col("c").cast("int")))
    for kind, params in (("forest", {"n_estimators": 4, "max_depth": 3}), ("logistic", {"C": 1.0})):
        scorer = learn.FlowScorer(learn.fit_flow(marked, spec, learn.Classifier(kind, params)))
        plain = scorer.encode(marked)
        points = explain.partial_dependence(plain, scorer, ["a"], {"a": [-0.5, 0.25, 1.0]}).collect()
        assert len(points) == 3
        for r in points:
            moved = scorer.score(plain.withColumn("a", F.lit(r["a"])))
            assert r["average"] == pytest.approx(moved.agg(F.avg("score")).first()[0], abs=1e-9)
        codes = explain.partial_dependence(plain, scorer, ["c"], {"c": [0.0, 1.0]}).collect()
        assert len(codes) == 2


def test_dependence_of_odd_rows(spark, df):
    """Rows with a missing feature count for no point; without rows the averages are null."""
    card = explain.Scorecard(0.5, {"a": 1.0, "b": -2.0})
    odd = spark.createDataFrame([(1.0, 2.0), (None, 2.0), (3.0, None)], "a double, b double")
    got = {r["a"]: r["average"] for r in explain.partial_dependence(odd, card, ["a"], {"a": [0.0, 1.0]}).collect()}
    assert got == {v: pytest.approx(1 / (1 + math.exp(-(0.5 + v - 4.0)))) for v in (0.0, 1.0)}
    none = explain.partial_dependence(odd.limit(0), card, ["a"], {"a": [0.0, 1.0]}).collect()
    assert none == []


def test_boosting_reads_each_round_from_memory(spark, df, monkeypatch):
    """No pass of a later round runs the trees of the rounds before it; nothing stays in memory."""
    plans, fit = [], constrained.DecisionTreeRegressor.fit

    def watched(self, rows, *rest):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return fit(self, rows, *rest)

    monkeypatch.setattr(constrained.DecisionTreeRegressor, "fit", watched)
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    constrained.constrained_boosting(df, rounds=4, max_depth=2)
    assert len(plans) == 4 and all("InMemoryTableScan" in p for p in plans[1:])
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before
