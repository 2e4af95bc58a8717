"""Queries with fitted classifiers, class weights and hyperparameter search.

Models fitted on many features have no SQL twin: their rows are checked for count
and shape, and ``tests`` checks their quality. On one feature the optimum can be
said in SQL: Newton steps for logistic models, rates for a single split, the rank
statistic for what a search finds. Those queries report fits in a few rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from riskframe.functions.hashing import arithmetic_rank_sql
from riskframe.functions.scorecard import ModelScorer
from riskframe.functions.spec import FeatureSpec
from riskframe.operators import constrained, explain, fair, learn, measure, perceptron, prep, rejects, trees
from riskframe.operators.features import numeric_stats
from riskframe.operators.learn import Classifier
from riskframe.plans.encoding import GAPS, SPEC, gaps
from riskframe.plans.fixtures import CARD, applications, rounded, with_applications

FAIR_SPEC = FeatureSpec(
    id="app_id",
    label="y",
    sensitive="z",
    numeric=("amount", "balance"),
    categorical=("segment", "priority", "nation"),
)
KEEP = ["app_id", "y"]


def _parts(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train and validation rows, and the whole table."""
    df = gaps(spark, sf_dir)
    split = prep.holdout_split(df, "app_id", seed=42)
    return split.filter("part = 'train'"), split.filter("part = 'valid'"), split


def _fair_parts(spark, sf_dir):
    split = prep.holdout_split(applications(spark, sf_dir), "app_id", seed=42)
    return split.filter("part = 'train'"), split.filter("part = 'valid'"), split


def _fitted(kind: str, params: dict):
    def run(spark, sf_dir):
        train, _, everyone = _parts(spark, sf_dir)
        flow = learn.fit_flow(train, SPEC, Classifier(kind, params, seed=7))
        return rounded(flow.score(everyone, KEEP), digits=4)

    return run


def l05(spark, sf_dir):
    df = applications(spark, sf_dir).select("app_id", "y")
    both = learn.balanced_weights(df, "y", "w")
    each = learn.balanced_weights(both, "y", "w_class", rule="one_over_c")
    return rounded(each, digits=9)


def l06(spark, sf_dir):
    """Scores and hard labels of a logistic model, cut at its own KS threshold."""
    train, valid, everyone = _parts(spark, sf_dir)
    flow = learn.fit_flow(train, SPEC, Classifier("logistic", {"C": 10.0}))
    held = flow.score(valid, KEEP).withColumn("model", F.lit("m"))
    cut = measure.ks_cutoff(held).first()["threshold"]
    return rounded(learn.hard_labels(flow.score(everyone, KEEP), cut), digits=4)


def l07(spark, sf_dir):
    df = applications(spark, sf_dir).select("app_id", "amount", "balance")
    return rounded(CARD.score(df).select("app_id", "score"))


SMALL_FOREST = {
    "n_estimators": {"type": "int", "low": 5, "high": 15},
    "max_depth": {"type": "int", "low": 2, "high": 5},
    "class_weight": {"type": "categorical", "choices": [None, "balanced"]},
}
SMALL_LOGISTIC = {
    "C": {"type": "float", "low": 1e-3, "high": 1e3, "log": True},
    "class_weight": {"type": "categorical", "choices": [None, "balanced"]},
}


#: One hidden unit with a bend between the two values of its feature.
UNIT_START = [(np.array([[0.5]]), np.array([-0.1])), (np.array([[0.8]]), np.array([-0.2]))]
UNIT = {"epochs": 40, "learning_rate": 0.1, "decay": 0.5, "l2": 1e-3}


def l04_one(spark, sf_dir):
    """Full-batch steps of one hidden unit on a 0/1 feature, bad rows weighing threefold."""
    sized = applications(spark, sf_dir).withColumn("large", (F.col("amount") > LARGE).cast("double"))
    ready = VectorAssembler(inputCols=["large"], outputCol="features").transform(sized)
    loaded = ready.withColumn("w", 1.0 + 2.0 * F.col("y"))
    net = perceptron.fit_perceptron(loaded, weight="w", id="app_id", start=UNIT_START, **UNIT)
    scored = net.score_vector(ready)
    return rounded(scored.groupBy("large", "y").agg(F.count("*").alias("n"), F.max("score").alias("score")))


def l08(spark, sf_dir):
    train, valid, everyone = _parts(spark, sf_dir)
    found = learn.search_holdout(
        "logistic", SMALL_LOGISTIC, train, valid, SPEC, n_trials=3, seed=1, parallelism=3
    )
    return rounded(found.flow.score(everyone, KEEP), digits=4)


def l09(spark, sf_dir):
    train, _, everyone = _parts(spark, sf_dir)
    found = learn.search_folds(
        "logistic", SMALL_LOGISTIC, train, SPEC, folds=3, n_trials=2, seed=1, parallelism=2
    )
    return rounded(found.flow.score(everyone, KEEP), digits=4)


def l10(spark, sf_dir):
    train, valid, everyone = _parts(spark, sf_dir)
    found = learn.search_fast(
        "forest", SMALL_FOREST, train, valid, SPEC, n_trials=3, seed=1, parallelism=3
    )
    return rounded(found.flow.score(everyone, KEEP), digits=4)


def l12(spark, sf_dir):
    """Search under a fairness-penalised score."""
    train, valid, everyone = _fair_parts(spark, sf_dir)
    found = learn.search_fast(
        "logistic",
        SMALL_LOGISTIC,
        train,
        valid,
        FAIR_SPEC,
        n_trials=3,
        seed=1,
        parallelism=3,
        scorer=measure.fairness_scorer(0.05),
    )
    return rounded(found.flow.score(everyone, KEEP), digits=4)


def e01_fit(spark, sf_dir):
    """Logistic model fitted on reweighed rows."""
    train, _, everyone = _fair_parts(spark, sf_dir)
    flow = learn.fit_flow(
        fair.reweigh(train), FAIR_SPEC, Classifier("logistic", {"C": 10.0}), weight="w"
    )
    return rounded(flow.score(everyone, ["app_id", "y", "z"]), digits=4)


def e02(spark, sf_dir):
    """Logistic model whose error rates are pulled together between the groups."""
    train, _, everyone = _fair_parts(spark, sf_dir)
    encoder = learn.FeatureEncoder(FAIR_SPEC).fit(train)
    keep = ["app_id", "y", "z"]
    ready = learn.training_table(encoder.assemble(train, keep), "app_id")
    model, _ = fair.constrained_fit(
        ready, Classifier("logistic", {"C": 10.0}), tolerance=0.02, rounds=4, step=4.0
    )
    scored = learn.score_rows(model, encoder.assemble(everyone, keep)).drop("features")
    return rounded(scored, digits=4)


def e02_boosting(spark, sf_dir):
    """Boosted trees whose error rates are pulled together between the groups."""
    train, _, everyone = _fair_parts(spark, sf_dir)
    encoder = learn.FeatureEncoder(FAIR_SPEC).fit(train)
    keep = ["app_id", "y", "z"]
    ready = learn.training_table(encoder.assemble(train, keep), "app_id")
    model = constrained.constrained_boosting(ready, rounds=20, max_depth=3, tolerance=0.02, multiplier_step=2.0)
    scored = model.score(encoder.assemble(everyone, keep)).drop("features")
    return rounded(scored, digits=4)


def _sized(df: DataFrame) -> DataFrame:
    """One 0/1 feature, and a group that takes part of the large amounts."""
    large = F.when(F.col("amount") > LARGE, 1.0).otherwise(0.0)
    group = F.when((F.col("amount") > LARGE) & (F.col("app_id") % 3 == 0), 1).otherwise(F.col("z"))
    return df.withColumns({"large": large, "z": group})


BOOST_ROUNDS, BOOST_RATE, BOOST_STEP = 4, 0.8, 3.0


def e02_boosting_one(spark, sf_dir):
    """Margin and multipliers' effect on one 0/1 feature, after a few rounds."""
    ready = VectorAssembler(inputCols=["large"], outputCol="features").transform(_sized(applications(spark, sf_dir)))
    model = constrained.constrained_boosting(
        ready, rounds=BOOST_ROUNDS, max_depth=1, learning_rate=BOOST_RATE, tolerance=0.0, multiplier_step=BOOST_STEP
    )
    scored = model.score(ready).groupBy("large", "z", "y").agg(F.count("*").alias("n"), F.max("score").alias("score"))
    return rounded(scored)


def g05_boosting(spark, sf_dir):
    """Shapley values of a boosted tree's margin on two 0/1 features, 100 background rows."""
    apps = _sized(applications(spark, sf_dir)).withColumn("z", F.col("z").cast("double"))
    ready = VectorAssembler(inputCols=["large", "z"], outputCol="features").transform(apps)
    model = constrained.constrained_boosting(ready, rounds=1, max_depth=2, learning_rate=1.0)
    background = explain.background_rows(apps, ModelScorer(model, ["large", "z"]), "app_id", 100, 5)
    return rounded(trees.tree_effects(apps, model, ["large", "z"], "app_id", background, margin=True))


def g01_boosting(spark, sf_dir):
    """Dependence of a boosted tree's probability on one of two 0/1 features."""
    apps = _sized(applications(spark, sf_dir)).withColumn("z", F.col("z").cast("double"))
    ready = VectorAssembler(inputCols=["large", "z"], outputCol="features").transform(apps)
    model = constrained.constrained_boosting(ready, rounds=1, max_depth=2, learning_rate=1.0)
    return rounded(explain.partial_dependence(apps, ModelScorer(model, ["large", "z"]), ["large"]))


def g05_forest(spark, sf_dir):
    """Shapley values of a fitted forest on encoded columns, 100 background rows."""
    train, _, everyone = _fair_parts(spark, sf_dir)
    flow = learn.fit_flow(train, FAIR_SPEC, Classifier("forest", {"n_estimators": 20, "max_depth": 5}, seed=7))
    plain = flow.encoder.encode(everyone, ["app_id"])
    scorer = ModelScorer(flow.model, flow.encoder.output_names)
    background = explain.background_rows(plain, scorer, "app_id", 100, 5)
    return rounded(trees.tree_effects(plain, flow.model, scorer.features, "app_id", background), digits=4)


def accept_scored(spark, sf_dir) -> DataFrame:
    """Applications with hidden labels and a fitted accept model's P(accept)."""
    apps = applications(spark, sf_dir).withColumn(
        "y", F.when(F.col("rejected") == 1, -1).otherwise(F.col("y"))
    )
    marked = rejects.accept_labels(apps)
    spec = FeatureSpec(
        id="app_id", label="accepted", numeric=("amount", "balance"), categorical=("segment",)
    )
    flow = learn.fit_flow(marked, spec, Classifier("logistic", {"C": 10.0}))
    return flow.score(marked, ["app_id", "y", "accepted"], out="p_accept")


def r00_fit(spark, sf_dir):
    return rounded(accept_scored(spark, sf_dir), digits=4)


def r01_fit(spark, sf_dir):
    """Upward weights from a fitted accept model, then the weighted final model."""
    apps = applications(spark, sf_dir)
    weights = rejects.upward(accept_scored(spark, sf_dir), floor=1e-6).select("app_id", "w")
    train = apps.join(weights, "app_id")
    flow = learn.fit_flow(train, FAIR_SPEC, Classifier("logistic", {"C": 10.0}), weight="w")
    return rounded(flow.score(apps, ["app_id", "rejected"]), digits=4)


def _explained(spark, sf_dir) -> tuple[learn.FlowScorer, DataFrame]:
    """A fitted forest as a scorer, and all applications in the space it reads."""
    train, _, everyone = _parts(spark, sf_dir)
    forest = Classifier("forest", {"n_estimators": 10, "max_depth": 4}, seed=7)
    scorer = learn.FlowScorer(learn.fit_flow(train, SPEC, forest))
    return scorer, scorer.encode(everyone)


def g01_model(spark, sf_dir):
    """Partial dependence of a fitted forest, on the feature's original scale."""
    scorer, plain = _explained(spark, sf_dir)
    curve = explain.partial_dependence(plain, scorer, ["amount"])
    return rounded(scorer.flow.encoder.unscale(curve, ["amount"]), digits=4)


def g08_model(spark, sf_dir):
    """Local surrogates of a fitted forest around every application."""
    scorer, plain = _explained(spark, sf_dir)
    encoder = scorer.flow.encoder
    codes = [*encoder.state.onehot, *encoder.state.target]
    background = explain.background_rows(plain, scorer, "app_id", 100, seed=3)
    stats = numeric_stats(plain, encoder.state.numeric)
    local = explain.LocalSurrogate(scorer, stats, background, categorical=codes, seed=3)
    return rounded(local.explain(plain, "app_id"), digits=4)


# -- fits of one feature, with their SQL twins -------------------------------------

AMOUNT = FeatureSpec(id="app_id", label="y", numeric=("amount",))
KIND = FeatureSpec(id="app_id", label="y", categorical=("kind",))
#: Amounts above this are mostly risky: a forest keeps a split only if its leaves disagree.
LARGE = 400_000
#: Run to the optimum, which is unique.
EXACT = {"C": 1.0, "tol": 1e-12, "max_iter": 500}
ONE_C = {"C": {"type": "float", "low": 1e-2, "high": 1e2, "log": True}}


def _by_segment(scored: DataFrame, apps: DataFrame, *more: str) -> DataFrame:
    """Rows and mean score per segment and label."""
    named = scored.join(apps.select("app_id", "segment"), "app_id")
    return rounded(
        named.groupBy("segment", "y", *more).agg(
            F.count("*").alias("n"), F.avg("score").alias("mean_score")
        ),
        digits=4,
    )


def l01_one(spark, sf_dir):
    train, _, everyone = _parts(spark, sf_dir)
    flow = learn.fit_flow(train, AMOUNT, Classifier("logistic", EXACT))
    return _by_segment(flow.score(everyone, KEEP), everyone)


def l06_one(spark, sf_dir):
    """Hard labels at one half, counted."""
    train, _, everyone = _parts(spark, sf_dir)
    flow = learn.fit_flow(train, AMOUNT, Classifier("logistic", EXACT))
    labelled = learn.hard_labels(flow.score(everyone, KEEP), 0.5)
    return _by_segment(labelled, everyone, "pred")


def e01_fit_one(spark, sf_dir):
    train, _, everyone = _fair_parts(spark, sf_dir)
    flow = learn.fit_flow(fair.reweigh(train), AMOUNT, Classifier("logistic", EXACT), weight="w")
    return _by_segment(flow.score(everyone, KEEP), everyone)


def _mean_of_fit(scored: DataFrame) -> DataFrame:
    """At the optimum, the weighted mean score of the fit rows is their weighted rate of label 1."""
    weighed = [(F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(out) for c, out in (("y", "rate"), ("score", "mean_score"))]
    return rounded(scored.agg(F.count("*").alias("n"), *weighed), digits=5)


def l01_mean(spark, sf_dir):
    train, _, _ = _parts(spark, sf_dir)
    flow = learn.fit_flow(train, SPEC, Classifier("logistic", EXACT))
    return _mean_of_fit(flow.score(train, KEEP).withColumn("w", F.lit(1.0)))


def e01_mean(spark, sf_dir):
    train, _, _ = _fair_parts(spark, sf_dir)
    weighed = fair.reweigh(train)
    flow = learn.fit_flow(weighed, FAIR_SPEC, Classifier("logistic", EXACT), weight="w")
    return _mean_of_fit(flow.score(weighed, [*KEEP, "w"]))


def r00_fit_one(spark, sf_dir):
    """An accept model of one feature, fitted on all applications."""
    apps = applications(spark, sf_dir)
    marked = rejects.accept_labels(
        apps.withColumn("y", F.when(F.col("rejected") == 1, -1).otherwise(F.col("y")))
    )
    spec = FeatureSpec(id="app_id", label="accepted", numeric=("amount",))
    flow = learn.fit_flow(marked, spec, Classifier("logistic", EXACT))
    return _by_segment(flow.score(marked, KEEP), apps)


def _split_once(kind: str, params: dict):
    """A learner allowed one split, on a column of two categories."""

    def run(spark, sf_dir):
        size = F.when(F.col("amount") > LARGE, "large").otherwise("small")
        train, _, everyone = (part.withColumn("kind", size) for part in _parts(spark, sf_dir))
        flow = learn.fit_flow(train, KIND, Classifier(kind, params, seed=7))
        scored = flow.score(everyone, KEEP).join(everyone.select("app_id", "kind"), "app_id")
        return rounded(scored.groupBy("kind", "y").agg(F.count("*").alias("n"), F.max("score").alias("score")))

    return run


def _found(spark, found: learn.SearchResult) -> DataFrame:
    rows = [(len(found.trials), found.best_value, max(value for _, value in found.trials))]
    return rounded(spark.createDataFrame(rows, "n_trials bigint, best_value double, highest double"))


def l08_one(spark, sf_dir):
    """Any penalty ranks one feature alike, so the best area under the curve is known."""
    train, valid, _ = _parts(spark, sf_dir)
    return _found(spark, learn.search_holdout("logistic", ONE_C, train, valid, AMOUNT, n_trials=2, seed=1, parallelism=2))


def l09_one(spark, sf_dir):
    train, _, _ = _parts(spark, sf_dir)
    return _found(spark, learn.search_folds("logistic", ONE_C, train, AMOUNT, folds=3, n_trials=2, seed=1, parallelism=2))


def l10_one(spark, sf_dir):
    train, valid, _ = _parts(spark, sf_dir)
    return _found(spark, learn.search_fast("logistic", ONE_C, train, valid, AMOUNT, n_trials=2, seed=1, parallelism=2))


PARTS = f"""
parts AS (
  SELECT *, CASE WHEN draw < 2000 THEN 'test' WHEN draw < 4000 THEN 'valid' ELSE 'train' END AS part
  FROM (SELECT *, {arithmetic_rank_sql('app_id', 42)} % 10000 AS draw FROM gaps) t
)"""


def _logistic_sql(rows: str, target: str = "y", weight: str = "1.0", select: str = "", group: str = "segment, y") -> str:
    """Newton steps on (1, scaled amount), ridge 1 on the slope, from the fit rows."""
    steps = with_applications(
        GAPS,
        PARTS,
        f"""
fitted AS (SELECT * FROM ({rows}) r),
scale AS (SELECT avg(amount) AS m, stddev_pop(amount) AS s FROM fitted),
d AS (SELECT (amount - m) / s AS x, CAST({target} AS DOUBLE) AS t, CAST({weight} AS DOUBLE) AS w FROM fitted, scale),
newton AS (
  SELECT 0 AS step, CAST(0 AS DOUBLE) AS b0, CAST(0 AS DOUBLE) AS b1
  UNION ALL
  SELECT step + 1, b0 - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01),
    b1 - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
  FROM (
    SELECT step, b0, b1, sum(w * (p - t)) AS g0, sum(w * (p - t) * x) + b1 AS g1,
      sum(w * p * (1 - p)) AS h00, sum(w * p * (1 - p) * x) AS h01, sum(w * p * (1 - p) * x * x) + 1 AS h11
    FROM (SELECT step, b0, b1, x, t, w, 1 / (1 + exp(-(b0 + b1 * x))) AS p
          FROM newton, d WHERE step < 25) a
    GROUP BY step, b0, b1) b
),
scored AS (
  SELECT a.*, 1 / (1 + exp(-(b0 + b1 * (amount - m) / s))) AS score
  FROM applications a, scale, (SELECT b0, b1 FROM newton WHERE step = 25) f
)""",
        select=f"""SELECT segment, {select or 'y'}, count(*) AS n, round(avg(score), 4) AS mean_score
FROM scored GROUP BY {group}""",
    )
    return "WITH RECURSIVE" + steps.removeprefix("WITH")


TRAIN = "SELECT * FROM parts WHERE part = 'train'"
REWEIGHED = """SELECT p.app_id, p.amount, p.y, cz.n * 1.0 * cy.n / (ca.n * 1.0 * cc.n) AS w
  FROM (SELECT p.*, a.z FROM parts p JOIN applications a ON a.app_id = p.app_id WHERE part = 'train') p
  JOIN (SELECT z, count(*) AS n FROM parts q JOIN applications a USING (app_id) WHERE part = 'train' GROUP BY z) cz ON cz.z = p.z
  JOIN (SELECT y, count(*) AS n FROM parts WHERE part = 'train' GROUP BY y) cy ON cy.y = p.y
  JOIN (SELECT a.z, a.y, count(*) AS n FROM parts q JOIN applications a ON a.app_id = q.app_id
        WHERE part = 'train' GROUP BY a.z, a.y) cc ON cc.z = p.z AND cc.y = p.y,
  (SELECT count(*) AS n FROM parts WHERE part = 'train') ca"""


def _one_split_sql(score: str) -> str:
    return with_applications(
        GAPS,
        PARTS,
        f"sized AS (SELECT y, part, CASE WHEN amount > {LARGE} THEN 'large' ELSE 'small' END AS kind FROM parts)",
        "rates AS (SELECT kind, avg(CAST(y AS DOUBLE)) AS rate FROM sized WHERE part = 'train' GROUP BY kind)",
        select=f"""SELECT kind, y, count(*) AS n, round(max({score}), 6) AS score
FROM sized JOIN rates USING (kind) GROUP BY kind, y""",
    )


def _search_sql(held: str) -> str:
    """Mean over ``held`` (fold, amount, y) of the area under the curve; the slope is
    positive, as larger amounts are riskier."""
    return with_applications(
        GAPS,
        PARTS,
        f"""
held AS ({held}),
ranked AS (
  SELECT fold, y, rank() OVER (PARTITION BY fold ORDER BY amount)
    + (count(*) OVER (PARTITION BY fold, amount) - 1) / 2.0 AS place
  FROM held
),
areas AS (
  SELECT fold, (sum(CASE WHEN y = 1 THEN place ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0)
    / (sum(y) * 1.0 * (count(*) - sum(y))) AS area
  FROM ranked GROUP BY fold
)""",
        select="""SELECT CAST(2 AS BIGINT) AS n_trials, round(CAST(avg(area) AS DOUBLE), 6) AS best_value,
  round(CAST(avg(area) AS DOUBLE), 6) AS highest FROM areas""",
    )


SIZED = f"""
sized AS (
  SELECT app_id, y, CASE WHEN amount > {LARGE} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS large,
    CASE WHEN amount > {LARGE} AND app_id % 3 = 0 THEN 1 ELSE z END AS z
  FROM applications
)"""


def _boosting_sql() -> str:
    """Newton steps per feature value under multipliers of (group, label), round by round."""
    parts = [
        SIZED,
        "cells AS (SELECT large, z, y, CAST(count(*) AS DOUBLE) AS n FROM sized GROUP BY large, z, y)",
        """f0 AS (SELECT large, ln(share / (1 - share)) AS f FROM (SELECT DISTINCT large FROM cells) c,
  (SELECT sum(n) FILTER (y = 1) / sum(n) AS share FROM cells) s)""",
        "m0 AS (SELECT DISTINCT z, y, CAST(0 AS DOUBLE) AS m FROM cells)",
    ]
    for k in range(BOOST_ROUNDS):
        parts += [
            f"""f{k + 1} AS (
  SELECT large, any_value(f) + {BOOST_RATE} * sum(n * (1 + m) * (y - p)) / sum(n * (1 + m) * p * (1 - p)) AS f
  FROM (SELECT c.*, f, m, 1 / (1 + exp(-f)) AS p FROM cells c JOIN f{k} USING (large) JOIN m{k} USING (z, y)) t
  GROUP BY large
)""",
            f"""r{k + 1} AS (
  SELECT z, y, sum(n) FILTER ((CASE WHEN f >= 0 THEN 1 ELSE 0 END) <> y) / sum(n) AS rate
  FROM cells JOIN f{k + 1} USING (large) GROUP BY z, y
)""",
            f"""m{k + 1} AS (
  SELECT z, y, greatest(0, m + {BOOST_STEP} * (coalesce(rate, 0) - min(coalesce(rate, 0)) OVER (PARTITION BY y))) AS m
  FROM m{k} JOIN r{k + 1} USING (z, y)
)""",
        ]
    return with_applications(
        *parts,
        select=f"""SELECT large, z, y, CAST(n AS BIGINT) AS n, round(1 / (1 + exp(-f)), 6) AS score
FROM cells JOIN f{BOOST_ROUNDS} USING (large)""",
    )


def _unit_sql() -> str:
    """Adam steps of one ReLU unit (u, a) below a sigmoid (v, c), from the counts of four cells."""
    (u, a), (v, c) = [(float(w[0, 0]), float(b[0])) for w, b in UNIT_START]
    names = "uavc"
    moved = ", ".join(
        f"{x} - rate * sqrt(1 - pow(0.999, k + 1)) / (1 - pow(0.9, k + 1)) * (0.9 * m{x} + 0.1 * g{x})"
        f" / (sqrt(0.999 * s{x} + 0.001 * g{x} * g{x}) + 1e-7)"
        for x in names
    )
    first = ", ".join(f"0.9 * m{x} + 0.1 * g{x}" for x in names)
    second = ", ".join(f"0.999 * s{x} + 0.001 * g{x} * g{x}" for x in names)
    start = ", ".join(f"CAST({value!r} AS DOUBLE) AS {x}" for x, value in zip(names, (u, a, v, c)))
    zeros = ", ".join(f"CAST(0 AS DOUBLE) AS {kind}{x}" for kind in "ms" for x in names)
    text = with_applications(
        SIZED,
        """cells AS (
  SELECT CAST(sum(w) AS DOUBLE) AS n, CAST(sum(w) FILTER (large = 0) AS DOUBLE) AS n0, CAST(sum(w) FILTER (large = 1) AS DOUBLE) AS n1,
    CAST(sum(w * y) FILTER (large = 0) AS DOUBLE) AS y0, CAST(sum(w * y) FILTER (large = 1) AS DOUBLE) AS y1
  FROM (SELECT *, 1 + 2 * y AS w FROM sized) t
)""",
        f"""steps AS (
  SELECT 0 AS k, {start}, {zeros}
  UNION ALL
  SELECT k + 1, {moved}, {first}, {second}
  FROM (
    SELECT *, v * d1 * b1 / n + 2 * {UNIT['l2']} * u AS gu, v * (d0 * b0 + d1 * b1) / n AS ga,
      (d0 * h0 + d1 * h1) / n AS gv, (d0 + d1) / n AS gc,
      {UNIT['learning_rate']} / (1 + {UNIT['decay']} * k / {float(UNIT['epochs'])}) AS rate
    FROM (
      SELECT *, n0 / (1 + exp(-(v * h0 + c))) - y0 AS d0, n1 / (1 + exp(-(v * h1 + c))) - y1 AS d1
      FROM (
        SELECT *, greatest(a, 0) AS h0, greatest(u + a, 0) AS h1,
          CASE WHEN a > 0 THEN 1 ELSE 0 END AS b0, CASE WHEN u + a > 0 THEN 1 ELSE 0 END AS b1
        FROM steps, cells WHERE k < {UNIT['epochs']}
      ) h
    ) d
  ) g
)""",
        select=f"""SELECT large, y, count(*) AS n, round(max(1 / (1 + exp(-(v * greatest(u * large + a, 0) + c)))), 6) AS score
FROM sized, steps WHERE k = {UNIT['epochs']} GROUP BY large, y""",
    )
    return "WITH RECURSIVE" + text.removeprefix("WITH")


#: Two features: the mean of both orders, over the background rows. A leaf holds the Newton step of its cell.
TREE_EFFECTS_SQL = with_applications(
    SIZED,
    """rates AS (
  SELECT large, z, (avg(CAST(y AS DOUBLE)) - any_value(share)) / any_value(share * (1 - share)) AS p
  FROM sized, (SELECT avg(CAST(y AS DOUBLE)) AS share FROM sized) s GROUP BY large, z
)""",
    f"""background AS (
  SELECT large, z FROM (SELECT large, z, row_number() OVER (ORDER BY {arithmetic_rank_sql('app_id', 5)}, app_id) AS place FROM sized) t
  WHERE place <= 100
)""",
    """effects AS (
  SELECT a.large, a.z, avg((xx.p - bx.p) + (xb.p - bb.p)) / 2 AS fl, avg((xx.p - xb.p) + (bx.p - bb.p)) / 2 AS fz
  FROM (SELECT DISTINCT large, z FROM sized) a, background b
  JOIN rates bb ON bb.large = b.large AND bb.z = b.z
  JOIN rates xx ON xx.large = a.large AND xx.z = a.z
  JOIN rates xb ON xb.large = a.large AND xb.z = b.z
  JOIN rates bx ON bx.large = b.large AND bx.z = a.z
  GROUP BY a.large, a.z
)""",
    select="""SELECT app_id, round(fl, 6) + 0.0 AS large, round(fz, 6) + 0.0 AS z
FROM sized JOIN effects USING (large, z)""",
)


TREE_DEPENDENCE_SQL = with_applications(
    SIZED,
    """margins AS (
  SELECT large, z, any_value(ln(share / (1 - share)))
    + (avg(CAST(y AS DOUBLE)) - any_value(share)) / any_value(share * (1 - share)) AS m
  FROM sized, (SELECT avg(CAST(y AS DOUBLE)) AS share FROM sized) s GROUP BY large, z
)""",
    select="""SELECT CAST(large AS DOUBLE) AS large, round(sum(n / (1 + exp(-m))) / sum(n), 6) AS average
FROM margins JOIN (SELECT z, count(*) AS n FROM sized GROUP BY z) c USING (z) GROUP BY large""",
)


def _mean_sql(rows: str, weight: str = "1.0") -> str:
    rate = f"round(sum({weight} * y) / sum({weight}), 5)"
    return with_applications(
        GAPS, PARTS, select=f"SELECT count(*) AS n, {rate} AS rate, {rate} AS mean_score FROM ({rows}) r"
    )


VALID = "SELECT 0 AS fold, amount, y FROM parts WHERE part = 'valid'"
FOLDS = f"""SELECT (row_number() OVER (PARTITION BY y
    ORDER BY {arithmetic_rank_sql('app_id', 1)}, app_id) - 1) % 3 AS fold, amount, y
  FROM parts WHERE part = 'train'"""


QUERIES = {
    "l01_logistic_regression_one_feature": (l01_one, _logistic_sql(TRAIN)),
    "l02_random_forest_one_split": (
        _split_once("forest", {"n_estimators": 1, "max_depth": 1, "max_features": 1.0, "bootstrap": False}),
        _one_split_sql("rate"),
    ),
    # a first tree predicts the mean of labels -1 and 1, the score is its sigmoid at twice that
    "l03_gradient_boosting_one_split": (
        _split_once("boosting", {"n_estimators": 1, "max_depth": 1, "max_features": 1.0}),
        _one_split_sql("1 / (1 + exp(-2 * (2 * rate - 1)))"),
    ),
    "l06_score_and_label_one_feature": (
        l06_one,
        _logistic_sql(
            TRAIN,
            select="y, CAST(score >= 0.5 AS INTEGER) AS pred",
            group="segment, y, CAST(score >= 0.5 AS INTEGER)",
        ),
    ),
    "l08_search_holdout_one_feature": (l08_one, _search_sql(VALID)),
    "l09_search_folds_one_feature": (l09_one, _search_sql(FOLDS)),
    "l10_search_fast_one_feature": (l10_one, _search_sql(VALID)),
    "e01_reweighed_fit_one_feature": (e01_fit_one, _logistic_sql(REWEIGHED, weight="w")),
    "l01_logistic_mean_of_fit": (l01_mean, _mean_sql(TRAIN)),
    "e01_reweighed_mean_of_fit": (e01_mean, _mean_sql(REWEIGHED, "w")),
    "g01_partial_dependence_of_boosting": (g01_boosting, TREE_DEPENDENCE_SQL),
    "r00_fitted_accept_model_one_feature": (
        r00_fit_one,
        _logistic_sql(
            "SELECT amount, 1 - rejected AS accepted FROM applications",
            target="accepted",
            select="CASE WHEN rejected = 1 THEN -1 ELSE y END AS y",
            group="segment, CASE WHEN rejected = 1 THEN -1 ELSE y END",
        ),
    ),
    "l01_logistic_regression": (_fitted("logistic", {"C": 1.0}), None),
    "l02_random_forest": (_fitted("forest", {"n_estimators": 20, "max_depth": 5}), None),
    "l03_gradient_boosting": (_fitted("boosting", {"n_estimators": 8, "max_depth": 3}), None),
    "l04_perceptron": (
        _fitted("perceptron", {"hidden_layers": [16], "max_iter": 100, "class_weight": "balanced"}),
        None,
    ),
    "l04_perceptron_one_unit": (l04_one, _unit_sql()),
    "l05_balanced_weights": (
        l05,
        with_applications(
            select="""SELECT a.app_id, a.y,
  round((SELECT count(*) FROM applications) / (2.0 * n), 9) AS w,
  round(1.0 / n, 9) AS w_class
FROM applications a JOIN (SELECT y, count(*) AS n FROM applications GROUP BY y) c ON a.y = c.y"""
        ),
    ),
    "l06_score_and_label": (l06, None),
    "l07_scorecard": (
        l07,
        with_applications(
            select=f"SELECT app_id, round({CARD.sql()}, 6) AS score FROM applications"
        ),
    ),
    "l08_search_holdout": (l08, None),
    "l09_search_folds": (l09, None),
    "l10_search_fast": (l10, None),
    "l12_search_custom_scorer": (l12, None),
    "e01_reweighed_fit": (e01_fit, None),
    "e02_constrained_fit": (e02, None),
    "e02_constrained_boosting": (e02_boosting, None),
    "e02_constrained_boosting_one_feature": (e02_boosting_one, _boosting_sql()),
    "g05_shapley_values_of_boosting": (g05_boosting, TREE_EFFECTS_SQL),
    "g05_shapley_values_of_forest": (g05_forest, None),
    "g01_partial_dependence_of_model": (g01_model, None),
    "g08_local_surrogate_of_model": (g08_model, None),
    "r00_fitted_accept_model": (r00_fit, None),
    "r01_upward_fit": (r01_fit, None),
}
