"""Classifiers, class weights, scoring and hyperparameter search."""

from __future__ import annotations

import math
import random
import time
import warnings
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass

from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from riskframe.functions.scorecard import Scorecard, score_vector
from riskframe.functions.spec import FeatureSpec
from riskframe.operators.features import FeatureEncoder, FeatureEncoderModel, FoldedFit
from riskframe.operators.measure import auc_scorer, ks_cutoff
from riskframe.operators.perceptron import fit_perceptron
from riskframe.operators.prep import stratified_folds
from riskframe.session import Shelf, cut_lineage

KINDS = ("logistic", "forest", "boosting", "perceptron")

# Default search ranges per family. Parameters that the Spark
# learners lack (leaf count, split size, L1/L2 of boosting, batch size) are not
# listed; a caller's own space may name them and gets a warning.
SEARCH_SPACES = {
    "logistic": {
        "C": {"type": "float", "low": 1e-3, "high": 1e3, "log": True},
        "tol": {"type": "float", "low": 1e-6, "high": 1e-3, "log": True},
        "class_weight": {"type": "categorical", "choices": [None, "balanced"]},
        "max_iter": {"type": "int", "low": 1000, "high": 1000},
        "penalty": {"type": "categorical", "choices": ["l1", "l2"]},
    },
    "forest": {
        "n_estimators": {"type": "int", "low": 5, "high": 250},
        "max_depth": {"type": "int", "low": 2, "high": 12},
        "criterion": {"type": "categorical", "choices": ["gini", "entropy"]},
        "min_samples_leaf": {"type": "int", "low": 1, "high": 256},
        "max_features": {"type": "float", "low": 0.1, "high": 1.0},
        "class_weight": {"type": "categorical", "choices": [None, "balanced"]},
    },
    "boosting": {
        "n_estimators": {"type": "int", "low": 5, "high": 250},
        "learning_rate": {"type": "float", "low": 0.05, "high": 1.0},
        "max_depth": {"type": "int", "low": 2, "high": 12},
        "min_samples_leaf": {"type": "int", "low": 1, "high": 256},
        "max_features": {"type": "float", "low": 0.1, "high": 1.0},
        "class_weight": {"type": "categorical", "choices": [None, "balanced"]},
    },
    "perceptron": {
        "hidden_layers": {
            "type": "categorical",
            "choices": [[32], [64], [128], [32, 16], [64, 32], [64, 32, 16]],
        },
        "learning_rate_init": {"type": "float", "low": 0.001, "high": 0.1, "log": True},
        "max_iter": {"type": "int", "low": 10, "high": 100, "step": 10},
        "class_weight": {"type": "categorical", "choices": [None, "balanced"]},
    },
}

ACCEPTED = {
    "logistic": {"C", "tol", "max_iter", "penalty", "class_weight"},
    "forest": {
        "n_estimators", "max_depth", "criterion", "min_samples_leaf", "max_features",
        "class_weight", "bootstrap",
    },
    "boosting": {
        "n_estimators", "learning_rate", "max_depth", "min_samples_leaf", "max_features",
        "class_weight",
    },
    "perceptron": {
        "hidden_layers", "learning_rate_init", "learning_rate_decay_rate", "alpha", "max_iter",
        "batches", "class_weight",
    },
}


def suggest_space(kind: str) -> dict:
    if kind not in SEARCH_SPACES:
        raise ValueError(f"no search space for {kind!r}; known: {sorted(SEARCH_SPACES)}")
    return SEARCH_SPACES[kind]


def draw(space: Mapping[str, Mapping], rng: random.Random) -> dict:
    """One point of a search space: uniform, log-uniform, stepped or a choice."""
    point = {}
    for name, spec in space.items():
        kind = spec["type"]
        if kind == "categorical":
            point[name] = spec["choices"][rng.randrange(len(spec["choices"]))]
        elif kind == "int":
            step = spec.get("step", 1)
            point[name] = spec["low"] + step * rng.randint(0, (spec["high"] - spec["low"]) // step)
        elif kind == "float":
            low, high = spec["low"], spec["high"]
            if spec.get("log"):
                point[name] = math.exp(rng.uniform(math.log(low), math.log(high)))
            else:
                point[name] = rng.uniform(low, high)
        else:
            raise ValueError(f"unknown parameter type {kind!r} for {name}")
    return point


# -- weights -------------------------------------------------------------------


def class_sizes(df: DataFrame, label: str = "y") -> dict:
    return {r[0]: r[1] for r in df.groupBy(label).count().collect()}


def balanced_weights(
    df: DataFrame, label: str = "y", out: str = "w", rule: str = "n_over_2c"
) -> DataFrame:
    """Weight ``n / (2 n_c)`` per row, or ``1 / n_c`` with ``rule="one_over_c"``."""
    sizes = class_sizes(df, label)
    total = sum(sizes.values())
    weight = F.lit(None).cast("double")
    for value, size in sizes.items():
        each = total / (2.0 * size) if rule == "n_over_2c" else 1.0 / size
        weight = F.when(F.col(label) == F.lit(value), F.lit(each)).otherwise(weight)
    return df.withColumn(out, weight)


#: Below this many rows per task a training pass is mostly task overhead.
ROWS_PER_TASK = 20_000


def training_table(df: DataFrame, id: str, shelf: Shelf | None = None) -> DataFrame:
    """A table ready for the many small jobs of an iterative learner, on ``shelf`` if given.

    It is written to the shared folder once, so that every iteration ships a short
    plan, and spread over the cores where that pays: a small input read as one
    file would train on a single core, a large one is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    keep = shelf.keep if shelf else cut_lineage
    kept = keep(df)
    have = kept.rdd.getNumPartitions()
    wanted = max(1, min(cores, math.ceil(kept.count() / ROWS_PER_TASK)))
    if have < wanted:
        return keep(kept.repartition(wanted, id))
    # many near-empty partitions; a large table has more rows than that in each
    return kept.coalesce(wanted) if wanted < cores and have > wanted else kept


# -- learners --------------------------------------------------------------------


@dataclass
class Classifier:
    """A learner family with its parameters, fitted on an assembled table."""

    kind: str
    params: Mapping | None = None
    seed: int = 0

    def fit(
        self,
        df: DataFrame,
        features: str = "features",
        label: str = "y",
        weight: str | None = None,
        id: str | None = None,
    ):
        """The fitted model. ``weight`` overrides a balanced class weight; by ``id``
        the perceptron deals rows to its batches."""
        if self.kind not in KINDS:
            raise ValueError(f"unknown classifier {self.kind!r}; known: {KINDS}")
        params = dict(self.params or {})
        dropped = sorted(set(params) - ACCEPTED[self.kind])
        if dropped:
            warnings.warn(f"{self.kind} has no parameter {dropped}; ignored", stacklevel=2)
        balanced = params.get("class_weight") == "balanced" and weight is None
        if balanced:
            rule = "one_over_c" if self.kind == "perceptron" else "n_over_2c"
            df, weight = balanced_weights(df, label, "__class_weight", rule), "__class_weight"
        build = {
            "logistic": self._logistic,
            "forest": self._forest,
            "boosting": self._boosting,
            "perceptron": self._perceptron,
        }[self.kind]
        return build(df, params, features, label, weight, id)

    def _logistic(self, df, params, features, label, weight, id):
        size = F.sum(weight) if weight else F.count("*").cast("double")
        total = df.agg(size).first()[0]
        learner = LogisticRegression(
            featuresCol=features,
            labelCol=label,
            regParam=1.0 / (float(params.get("C", 1.0)) * float(total)),
            elasticNetParam=1.0 if params.get("penalty", "l2") == "l1" else 0.0,
            tol=float(params.get("tol", 1e-4)),
            maxIter=int(params.get("max_iter", 100)),
            standardization=False,
        )
        return (learner.setWeightCol(weight) if weight else learner).fit(df)

    def _forest(self, df, params, features, label, weight, id):
        learner = RandomForestClassifier(
            featuresCol=features,
            labelCol=label,
            numTrees=int(params.get("n_estimators", 100)),
            maxDepth=int(params.get("max_depth", 5)),
            impurity=params.get("criterion", "gini"),
            minInstancesPerNode=int(params.get("min_samples_leaf", 1)),
            featureSubsetStrategy=_subset(params.get("max_features", "sqrt")),
            bootstrap=bool(params.get("bootstrap", True)),
            seed=self.seed,
        )
        return (learner.setWeightCol(weight) if weight else learner).fit(df)

    def _boosting(self, df, params, features, label, weight, id):
        learner = GBTClassifier(
            featuresCol=features,
            labelCol=label,
            maxIter=int(params.get("n_estimators", 20)),
            stepSize=float(params.get("learning_rate", 0.1)),
            maxDepth=int(params.get("max_depth", 5)),
            minInstancesPerNode=int(params.get("min_samples_leaf", 1)),
            featureSubsetStrategy=_subset(params.get("max_features", "all")),
            seed=self.seed,
        )
        return (learner.setWeightCol(weight) if weight else learner).fit(df)

    def _perceptron(self, df, params, features, label, weight, id):
        return fit_perceptron(
            df,
            features,
            label,
            weight,
            id,
            hidden=params.get("hidden_layers", [64]),
            epochs=int(params.get("max_iter", 100)),
            batches=int(params.get("batches", 1)),
            learning_rate=float(params.get("learning_rate_init", 0.03)),
            decay=float(params.get("learning_rate_decay_rate", 0.1)),
            l2=float(params.get("alpha", 1e-4)),
            seed=self.seed,
        )


def _subset(value) -> str:
    """Share of features per split, as the text Spark expects."""
    if isinstance(value, str):
        return value
    return "all" if value >= 1.0 else repr(float(value))


def score_rows(model, df: DataFrame, features: str = "features", out: str = "score") -> DataFrame:
    """Add P(y=1)."""
    return score_vector(model, df, features, out)


def hard_labels(df: DataFrame, threshold: float | None = 0.5, score: str = "score") -> DataFrame:
    """Add ``pred``; without a threshold, as a cut-off of one class may be, it is null."""
    if threshold is None:
        return df.withColumn("pred", F.lit(None).cast("int"))
    return df.withColumn("pred", (F.col(score) >= F.lit(float(threshold))).cast("int"))


@dataclass
class FittedFlow:
    """Encoder and classifier fitted together; scores raw applicant tables."""

    encoder: FeatureEncoderModel
    model: object

    def score(self, df: DataFrame, keep: Sequence[str], out: str = "score") -> DataFrame:
        return score_rows(self.model, self.encoder.assemble(df, keep), out=out).drop("features")


@dataclass
class FlowScorer:
    """A fitted flow as a scorer of its plain space, where each raw feature is
    one column: numeric, ordinal code or target rate."""

    flow: FittedFlow
    scaled: bool = True

    @property
    def features(self) -> list[str]:
        return self.flow.encoder.plain_names

    def encode(self, df: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
        """Raw rows in the space this scorer reads."""
        scale = None if self.scaled else False
        return self.flow.encoder.encode(df, keep, scale=scale, onehot=False)

    def ready(self, df: DataFrame, replaced: Sequence[str]) -> tuple[DataFrame, object, list[str]]:
        """Rows, model and the number columns that the model reads, ``replaced`` among them.

        The model is None where a replaced feature is not one of those columns as it
        stands: spread over several, scaled on the way, or beside a sparse one.
        """
        encoder = self.flow.encoder
        names = list(encoder.output_names)
        if not self.scaled or encoder.state.wide or not set(replaced) <= set(names):
            return df, None, []
        return encoder.finish(df, True), self.flow.model, names

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        encoder = self.flow.encoder
        # the plain columns come back unchanged next to the score
        plain = {c: f"__plain_{c}" for c in self.features}
        kept = df.withColumns({p: F.col(c) for c, p in plain.items()})
        vector = VectorAssembler(inputCols=encoder.output_names, outputCol="__vector")
        ready = vector.transform(encoder.finish(kept, self.scaled)).drop(*encoder.output_names)
        scored = score_rows(self.flow.model, ready, "__vector", out).drop("__vector")
        return scored.withColumnsRenamed({p: c for c, p in plain.items()}).select(*df.columns, out)


def scorecard_of(flow: FittedFlow) -> Scorecard:
    """A logistic flow as a scorecard over ``encode(df, scale=False)``."""
    state = flow.encoder.state
    if state.wide and state.use_onehot:
        raise ValueError(f"no scorecard over sparse columns: {sorted(state.wide)}")
    intercept, weights = float(flow.model.intercept), {}
    for name, weight in zip(flow.encoder.output_names, flow.model.coefficients):
        weight = float(weight)
        if state.normalize and name in state.scales:
            weight /= state.scales[name]
            intercept -= weight * state.means[name]
        weights[name] = weight
    return Scorecard(intercept, weights)


def fit_flow(
    train: DataFrame,
    spec: FeatureSpec,
    classifier: Classifier,
    weight: str | None = None,
    encoder_options: Mapping | None = None,
) -> FittedFlow:
    """Fit the encoder, then the classifier on the encoded rows.

    Learners pass over the data many times, so they read the assembled table
    from storage instead of encoding it again.
    """
    encoder = FeatureEncoder(spec, **dict(encoder_options or {})).fit(train)
    keep = [spec.id, spec.label, *([weight] if weight else [])]
    with Shelf(train.sparkSession, "fit") as shelf:
        ready = training_table(encoder.assemble(train, keep), spec.id, shelf)
        model = classifier.fit(ready, label=spec.label, weight=weight, id=spec.id)
    return FittedFlow(encoder, model)


# -- search ----------------------------------------------------------------------

Scorer = Callable[[DataFrame], DataFrame]


@dataclass
class SearchResult:
    best_params: dict
    best_value: float
    trials: list[tuple[dict, float]]
    flow: FittedFlow


def _value(scored: DataFrame, scorer: Scorer | str, threshold: str = "half") -> float:
    """One number from a scored table (score, y and the columns the scorer uses)."""
    long = scored.withColumn("model", F.lit("trial"))
    if scorer == "roc_auc":
        scorer = auc_scorer
    else:
        cut = 0.5
        if threshold == "ks":
            best = ks_cutoff(long).first()["threshold"]
            # no separation: nobody is above the cut-off
            cut = math.inf if best is None else float(best)
        over = F.col("score") > F.lit(cut) if threshold == "ks" else F.col("score") >= F.lit(cut)
        long = long.withColumn("pred", over.cast("int"))
    row = scorer(long).first()
    value = row["value"] if row else None
    return float("-inf") if value is None or math.isnan(value) else float(value)


def _run_trials(
    trial: Callable[[dict], tuple[float, object]],
    space: Mapping,
    n_trials: int | None,
    timeout: float | None,
    seed: int,
    parallelism: int,
) -> tuple[list[tuple[dict, float]], int, object]:
    """All trials, the place of the best one (the first of equals) and what it made.

    Points are drawn from one seed in one order. ``parallelism`` trials run as
    concurrent Spark jobs, a new one as soon as one ends; the model of a trial is
    dropped once a better one is known.
    """
    if n_trials is None and timeout is None:
        n_trials = 100
    rng = random.Random(seed)
    started = time.monotonic()
    points: list[dict] = []
    values: dict[int, float] = {}
    best, made = None, None
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        running: dict = {}
        while True:
            while len(running) < max(1, parallelism):
                if n_trials is not None and len(points) >= n_trials:
                    break
                if timeout is not None and points and time.monotonic() - started > timeout:
                    break
                points.append(draw(space, rng))
                running[pool.submit(trial, points[-1])] = len(points) - 1
            if not running:
                break
            for done in wait(running, return_when=FIRST_COMPLETED).done:
                i = running.pop(done)
                values[i], model = done.result()
                if best is None or (values[i], -i) > (values[best], -best):
                    best, made = i, model
    return [(p, values[i]) for i, p in enumerate(points)], best, made


def _search_encoded(
    kind, space, train, valid, spec, n_trials, timeout, seed, parallelism, scorer, weight,
    encoder_options, threshold,
) -> SearchResult:
    """Trials on rows encoded once; the best trial's model is the result's."""
    space = suggest_space(kind) if space == "suggest" else space
    encoder = FeatureEncoder(spec, **dict(encoder_options or {})).fit(train)
    keep = [spec.id, spec.label, *([spec.sensitive] if spec.sensitive else [])]
    extra = [weight] if weight else []
    with Shelf(train.sparkSession, "search") as shelf:
        fitted = training_table(encoder.assemble(train, [*keep, *extra]), spec.id, shelf)
        checked = training_table(encoder.assemble(valid, keep), spec.id, shelf)

        def trial(params: dict) -> tuple[float, object]:
            model = Classifier(kind, params, seed).fit(fitted, label=spec.label, weight=weight, id=spec.id)
            scored = score_rows(model, checked).drop("features")
            return _value(_named(scored, spec), scorer, threshold), model

        trials, best, model = _run_trials(trial, space, n_trials, timeout, seed, parallelism)
    return SearchResult(*trials[best], trials, FittedFlow(encoder, model))


def search_holdout(
    kind: str,
    space: Mapping | str,
    train: DataFrame,
    valid: DataFrame,
    spec: FeatureSpec,
    n_trials: int | None = None,
    timeout: float | None = None,
    seed: int = 0,
    parallelism: int = 1,
    scorer: Scorer | str = "roc_auc",
    weight: str | None = None,
    encoder_options: Mapping | None = None,
) -> SearchResult:
    """Each trial is fitted on ``train`` and scored on ``valid``.

    What the encoder learns depends on no trial, so it is fitted once. A custom
    scorer sees ``pred`` cut at one half.
    """
    return _search_encoded(
        kind, space, train, valid, spec, n_trials, timeout, seed, parallelism, scorer, weight,
        encoder_options, "half",
    )


def search_folds(
    kind: str,
    space: Mapping | str,
    train: DataFrame,
    spec: FeatureSpec,
    folds: int = 5,
    n_trials: int | None = None,
    timeout: float | None = None,
    seed: int = 0,
    parallelism: int = 1,
    scorer: Scorer | str = "roc_auc",
    weight: str | None = None,
    encoder_options: Mapping | None = None,
) -> SearchResult:
    """Mean score over stratified folds, each encoded by what the others taught.

    The raw rows are stored once with their fold, and the encoders come from counts
    per fold (:class:`FoldedFit`). Learners keep their own copy of what they read, so
    a fit encodes its rows as it reads them.
    """
    if weight is not None:
        raise ValueError("row weights need a validation set; use search_holdout")
    space = suggest_space(kind) if space == "suggest" else space
    keep = [spec.id, spec.label, *([spec.sensitive] if spec.sensitive else [])]
    used = list(dict.fromkeys([*keep, *spec.numeric, *spec.categorical]))
    with Shelf(train.sparkSession, "folds") as shelf:
        dealt = training_table(
            stratified_folds(train.select(*used), spec.id, spec.label, folds, seed), spec.id, shelf
        )
        learned = FoldedFit(FeatureEncoder(spec, **dict(encoder_options or {})), dealt, shelf)
        # folds of a trial run side by side once trials do
        with ThreadPoolExecutor(max_workers=folds if parallelism > 1 else 1) as pool:
            encoders = list(pool.map(learned.without, [*range(folds), None]))

            def fold_value(params: dict, i: int) -> float:
                inside = encoders[i].assemble(dealt.filter(F.col("fold") != i), keep)
                model = Classifier(kind, params, seed).fit(inside, label=spec.label, id=spec.id)
                held = encoders[i].assemble(dealt.filter(F.col("fold") == i), keep)
                # a scorer passes over the scores several times
                scored = shelf.keep(_named(score_rows(model, held).drop("features"), spec))
                return _value(scored, scorer)

            def trial(params: dict) -> tuple[float, object]:
                values = list(pool.map(lambda i: fold_value(params, i), range(folds)))
                return sum(values) / len(values), None

            trials, best, _ = _run_trials(trial, space, n_trials, timeout, seed, parallelism)
        params, value = trials[best]
        ready = training_table(encoders[-1].assemble(dealt, keep), spec.id, shelf)
        model = Classifier(kind, params, seed).fit(ready, label=spec.label, id=spec.id)
    return SearchResult(params, value, trials, FittedFlow(encoders[-1], model))


def search_fast(
    kind: str,
    space: Mapping | str,
    train: DataFrame,
    valid: DataFrame,
    spec: FeatureSpec,
    n_trials: int | None = None,
    timeout: float | None = None,
    seed: int = 0,
    parallelism: int = 1,
    scorer: Scorer | str = "roc_auc",
    weight: str | None = None,
    encoder_options: Mapping | None = None,
) -> SearchResult:
    """As :func:`search_holdout`, but a custom scorer sees ``pred`` cut at the trial's
    own KS threshold."""
    return _search_encoded(
        kind, space, train, valid, spec, n_trials, timeout, seed, parallelism, scorer, weight,
        encoder_options, "ks",
    )


def _named(scored: DataFrame, spec: FeatureSpec) -> DataFrame:
    """The column names scorers expect."""
    names = {spec.label: "y"}
    if spec.sensitive:
        names[spec.sensitive] = "z"
    return scored.withColumnsRenamed(names)
