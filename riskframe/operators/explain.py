"""Global and local explanations of a scorer, for all rows of a table at once.

A scorer is a :class:`Scorecard` or a :class:`ModelScorer`. Every operator widens
the rows with the points to evaluate, scores them in one pass and folds them back.
A scorecard is evaluated row by row in vectorised batches, without any shuffle.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Iterator, Mapping, Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from riskframe.functions.ordering import exact_quantiles, feature_quantiles
from riskframe.functions.scorecard import Scorecard
from riskframe.operators.prep import hash_sample
from riskframe.operators.trees import TREE_MODELS, tree_on_points

MAX_BACKGROUND = 10_000


def _check_size(df: DataFrame, factor: int, max_rows: int | None) -> None:
    """Refuse an expansion beyond ``max_rows`` rather than thin it out."""
    if max_rows is not None:
        n = df.count()
        if n * factor > max_rows:
            raise ValueError(f"{n} rows x {factor} points exceed max_rows={max_rows}")


# -- partial dependence ----------------------------------------------------------


def feature_grid(
    df: DataFrame,
    feature: str,
    resolution: int = 20,
    low: float = 0.05,
    high: float = 0.95,
) -> list[float]:
    """The distinct values when there are fewer than ``resolution``, else evenly
    spaced points between two outer quantiles.

    The outer quantiles are the approximately unbiased ones with plotting position
    (i - 0.4) / (n + 0.2).
    """
    values = df.select(F.col(feature).cast("double").alias("v")).filter("v IS NOT NULL")
    n, about = values.agg(F.count("*"), F.approx_count_distinct("v")).first()
    if about < 4 * resolution:
        few = values.distinct().limit(resolution).collect()
        if len(few) < resolution:
            return sorted(r["v"] for r in few)
    spots = []
    for p in (low, high):
        place = n * p + 0.4 + 0.2 * p
        spots.append(min(max((place - 1) / (n - 1), 0.0), 1.0))
    first, last = exact_quantiles(values, "v", spots)[None]
    gap = (last - first) / (resolution - 1)
    return [first + gap * i for i in range(resolution - 1)] + [last]


def _on_grid(df: DataFrame, scorer, overrides: Sequence[Mapping[str, float]]) -> DataFrame:
    """Mean score per point as (point, average).

    Of a scorecard or a tree model no row is copied: a task adds up its rows' scores
    at every point. Any other model scores each row once per point.
    """
    if isinstance(scorer, Scorecard):
        return _summed(df, scorer.features, _card_on_points(scorer, overrides))
    rows, model, names = scorer.ready(df, list(overrides[0]))
    if isinstance(model, LogisticRegressionModel) and model.numClasses == 2:
        return _summed(rows, names, _card_on_points(Scorecard.from_logistic(model, names), overrides))
    if isinstance(model, TREE_MODELS):
        return _summed(rows, names, tree_on_points(model, names, overrides))
    points = F.array(
        *[
            F.struct(
                F.lit(i).alias("point"),
                *[F.lit(float(v)).alias(f) for f, v in point.items()],
            )
            for i, point in enumerate(overrides)
        ]
    )
    spread = df.select(*scorer.features).withColumn("__p", F.explode(points))
    moved = spread.withColumns({f: F.col(f"__p.{f}") for f in overrides[0]})
    scored = scorer.score(moved, "__score")
    return scored.groupBy(F.col("__p.point").alias("point")).agg(
        F.avg("__score").alias("average")
    )


def _card_on_points(card: Scorecard, overrides: Sequence[Mapping[str, float]]):
    """A function from rows to their scores at every point, as a matrix."""
    names, fixed = card.features, set(overrides[0])
    moved = np.array([sum(card.weights[f] * float(v) for f, v in p.items()) for p in overrides])
    own = np.array([0.0 if f in fixed else card.weights[f] for f in names])
    kept = own != 0.0
    start = card.intercept

    def scores(x: np.ndarray) -> np.ndarray:
        rest = start + x[:, kept] @ own[kept]
        return 1.0 / (1.0 + np.exp(-(rest[:, None] + moved[None, :])))

    return scores


def _summed(df: DataFrame, features: Sequence[str], scores) -> DataFrame:
    """(point, average) from a function that gives a block of rows' scores at every point.

    A batch leaves one sum and one count per point. A row whose score is not a number
    counts nowhere, as in an average that skips nulls.
    """
    names = list(features)

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = batch[names].to_numpy(dtype=float)
            for i in range(0, len(x), 1024):
                found = scores(x[i : i + 1024])
                known = ~np.isnan(found)
                yield pd.DataFrame(
                    {
                        "point": np.arange(found.shape[1], dtype=np.int32),
                        "total": np.where(known, found, 0.0).sum(axis=0),
                        "n": known.sum(axis=0).astype(np.int64),
                    }
                )

    plain = df.select(*[F.col(f).cast("double").alias(f) for f in names])
    sums = plain.mapInPandas(add_up, "point int, total double, n long")
    # the batches' averages have the ratio of the sums
    whole = sums.groupBy("point").agg(F.avg("total").alias("total"), F.avg("n").alias("n"))
    return whole.select("point", F.try_divide("total", "n").alias("average"))


def partial_dependence(
    df: DataFrame,
    scorer,
    features: Sequence[str],
    grids: Mapping[str, Sequence[float]] | None = None,
    resolution: int = 20,
) -> DataFrame:
    """Average score with one or two numeric features fixed at each grid point.

    Returns one row per point: the feature values and ``average``.
    """
    if not 1 <= len(features) <= 2:
        raise ValueError("one or two features")
    grids = dict(grids or {})
    for f in features:
        grids.setdefault(f, feature_grid(df, f, resolution))
    overrides = [dict(zip(features, p)) for p in itertools.product(*[grids[f] for f in features])]
    means = _on_grid(df, scorer, overrides)
    table = F.array(
        *[F.struct(*[F.lit(float(o[f])).alias(f) for f in features]) for o in overrides]
    )
    return means.withColumn("__at", F.get(table, F.col("point"))).select(
        *[F.col(f"__at.{f}").alias(f) for f in features], "average"
    )


def individual_curves(
    df: DataFrame,
    scorer,
    id: str,
    feature: str,
    grid: Sequence[float] | None = None,
    resolution: int = 20,
    rebase: bool = False,
) -> DataFrame:
    """One curve per row: (id, value, score); ``rebase`` starts each curve at 0."""
    grid = feature_grid(df, feature, resolution) if grid is None else list(grid)
    base = df.select(id, *scorer.features)
    if rebase:
        at_start = scorer.score(base.withColumn(feature, F.lit(float(grid[0]))), "__start")
        base = at_start
    points = F.array(*[F.lit(float(v)) for v in grid])
    moved = base.withColumn(feature, F.explode(points))
    scored = scorer.score(moved, "__score")
    start = F.col("__start") if rebase else F.lit(0.0)
    return scored.select(id, F.col(feature).alias("value"), (F.col("__score") - start).alias("score"))


def quantile_rug(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Percentiles 4, 6, ..., 92 of each feature as (feature, percentile, value)."""
    percents = list(range(4, 94, 2))
    found = feature_quantiles(df, features, [p / 100 for p in percents])
    rows = [(f, p, v) for f in features for p, v in zip(percents, found[f])]
    return df.sparkSession.createDataFrame(rows, "feature string, percentile int, value double")


# -- Shapley values ----------------------------------------------------------------


def coalition_plan(
    k: int, permutations: int | None = None, seed: int = 0
) -> dict[int, list[float]]:
    """Weight of each coalition (bit mask) in each feature's Shapley value.

    All coalitions when ``permutations`` is None; else the prefixes of that many
    seeded orders, each walked forwards and backwards.
    """
    plan: dict[int, list[float]] = {}

    def add(mask: int, feature: int, weight: float) -> None:
        plan.setdefault(mask, [0.0] * k)[feature] += weight

    if permutations is None:
        for mask in range(1 << k):
            size = bin(mask).count("1")
            for j in range(k):
                if not mask >> j & 1:
                    weight = math.factorial(size) * math.factorial(k - size - 1) / math.factorial(k)
                    add(mask | 1 << j, j, weight)
                    add(mask, j, -weight)
        return plan
    rng = random.Random(seed)
    for _ in range(permutations):
        order = list(range(k))
        rng.shuffle(order)
        for walk in (order, order[::-1]):
            mask = 0
            for j in walk:
                add(mask | 1 << j, j, 0.5 / permutations)
                add(mask, j, -0.5 / permutations)
                mask |= 1 << j
    return plan


def background_rows(df: DataFrame, scorer, id: str, n: int = 100, seed: int = 0) -> list[dict]:
    """A small reproducible sample that stands for an absent feature."""
    if n > MAX_BACKGROUND:
        raise ValueError(f"a background of more than {MAX_BACKGROUND} rows is not a sample")
    picked = hash_sample(df, id, n, seed).select(*scorer.features).collect()
    return [r.asDict() for r in picked]


def shapley_values(
    df: DataFrame,
    scorer,
    id: str,
    background: Sequence[Mapping[str, float]],
    method: str = "prob",
    threshold: float = 0.5,
    permutations: int | None = None,
    seed: int = 0,
    max_rows: int | None = None,
) -> DataFrame:
    """(id, one column per feature): each feature's share of score minus mean score.

    ``method="pred"`` explains the 0/1 prediction ``score > threshold``. Every
    coalition is evaluated, ``2 ** features`` vector steps per batch, unless
    ``permutations`` asks for that many seeded orders instead.
    """
    if method not in ("prob", "pred"):
        raise ValueError("method must be 'prob' or 'pred'")
    names = list(scorer.features)
    k = len(names)
    plan = coalition_plan(k, permutations, seed)
    masks = sorted(plan)

    if isinstance(scorer, Scorecard):
        # the background's part of the linear predictor is known beforehand
        rest = {
            m: np.array(
                [
                    scorer.logit_of(r, [n for j, n in enumerate(names) if not m >> j & 1])
                    for r in background
                ]
            )
            for m in masks
        }
        shares = partial(
            _effects_of_batches,
            card=scorer,
            id=id,
            names=names,
            plan=plan,
            rest=rest,
            cut=None if method == "prob" else threshold,
        )
        schema = StructType([df.schema[id], *[StructField(n, DoubleType()) for n in names]])
        return df.select(id, *names).mapInPandas(shares, schema)

    def target(score: Column) -> Column:
        return score if method == "prob" else (score > F.lit(float(threshold))).cast("double")

    _check_size(df, len(masks) * len(background), max_rows)
    staged = _coalition_worth_by_model(df, scorer, id, names, masks, background, target)
    phis = []
    for j, name in enumerate(names):
        total: Column = F.lit(0.0)
        for m in masks:
            if plan[m][j]:
                total = total + F.lit(plan[m][j]) * F.col(f"__v{m}")
        phis.append(total.alias(name))
    return staged.select(id, *phis)


def _effects_of_batches(
    batches: Iterator[pd.DataFrame], card, id, names, plan, rest, cut
) -> Iterator[pd.DataFrame]:
    """Shapley values of a batch: the mean over the background per coalition."""
    for batch in batches:
        parts = {n: card.weights[n] * batch[n].to_numpy(dtype=float) for n in names}
        effects = {n: np.zeros(len(batch)) for n in names}
        for mask, weights in plan.items():
            own = card.intercept + sum(
                (parts[n] for j, n in enumerate(names) if mask >> j & 1), np.zeros(len(batch))
            )
            worth = np.empty(len(batch))
            for start in range(0, len(batch), 4096):
                logit = own[start : start + 4096, None] + rest[mask][None, :]
                score = 1.0 / (1.0 + np.exp(-logit))
                told = score if cut is None else (score > cut).astype(float)
                worth[start : start + 4096] = told.mean(axis=1)
            for j, n in enumerate(names):
                effects[n] += weights[j] * worth
        yield pd.DataFrame({id: batch[id].to_numpy(), **effects})


def _coalition_worth_by_model(df, scorer, id, names, masks, background, target) -> DataFrame:
    rows = F.array(
        *[F.struct(*[F.lit(float(r[n])).alias(n) for n in names]) for r in background]
    )
    spread = (
        df.select(id, *names)
        .withColumn("__m", F.explode(F.array(*[F.lit(m) for m in masks])))
        .withColumn("__b", F.explode(rows))
    )
    mixed = spread.select(
        id,
        "__m",
        *[
            F.when(F.col("__m").bitwiseAND(1 << j) != 0, F.col(n).cast("double"))
            .otherwise(F.col(f"__b.{n}"))
            .alias(n)
            for j, n in enumerate(names)
        ],
    )
    scored = scorer.score(mixed, "__score").withColumn("__t", target(F.col("__score")))
    return scored.groupBy(id).agg(
        *[F.avg(F.when(F.col("__m") == m, F.col("__t"))).alias(f"__v{m}") for m in masks]
    )


def to_long(wide: DataFrame, id: str, value: str = "phi") -> DataFrame:
    """(id, feature, value) from one column per feature."""
    return wide.unpivot([id], [c for c in wide.columns if c != id], "feature", value)


def global_importance(wide: DataFrame, id: str, top: int | None = None, by: str = "mean") -> DataFrame:
    """(feature, mean_abs, median_abs): all features, or the ``top`` by mean or median.

    The median is an exact distributed quantile over all rows.
    """
    if by not in ("mean", "median"):
        raise ValueError("by must be 'mean' or 'median'")
    # read several times, and costly to recompute
    kept = wide.persist(StorageLevel.MEMORY_AND_DISK)
    sizes = to_long(kept, id).select("feature", F.abs("phi").alias("size"))
    try:
        means = {r[0]: r[1] for r in sizes.groupBy("feature").agg(F.avg("size")).collect()}
        medians = exact_quantiles(sizes, "size", [0.5], group="feature")
    finally:
        kept.unpersist()
    # one row per feature
    rows = [(f, mean, medians[f][0]) for f, mean in means.items()]
    if top is not None:
        rows = sorted(rows, key=lambda r: (-r[1 if by == "mean" else 2], r[0]))[:top]
    return wide.sparkSession.createDataFrame(
        rows, "feature string, mean_abs double, median_abs double"
    )


def local_factors(
    wide: DataFrame,
    id: str,
    top: int = 7,
    numeric: Mapping[str, Column] | None = None,
    labels: Mapping[str, Column] | None = None,
    width: int = 10,
) -> DataFrame:
    """The ``top`` features of each row by size of effect, with readable values.

    ``wide`` holds the effects and the columns used by ``numeric`` (on the
    original scale) and ``labels`` (category texts, cut at ``width``). Returns
    (id, place, feature, phi, value, label).
    """
    numeric, labels = dict(numeric or {}), dict(labels or {})
    features = [*numeric, *labels]
    entries = []
    for f in features:
        text = labels.get(f, F.lit(None).cast("string"))
        cut = F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("...")))
        number = numeric.get(f, F.lit(None).cast("double")).cast("double")
        entries.append(
            F.struct(
                # rounded so that equal effects keep the order of their names
                (-F.round(F.abs(F.col(f)), 9)).alias("rank"),
                F.lit(f).alias("feature"),
                F.col(f).alias("phi"),
                F.round(number, 2).alias("value"),
                F.coalesce(cut, text).alias("label"),
            )
        )
    best = F.slice(F.sort_array(F.array(*entries)), 1, top)
    return wide.select(id, F.posexplode(best).alias("pos", "e")).select(
        id,
        (F.col("pos") + 1).alias("place"),
        "e.feature",
        "e.phi",
        "e.value",
        "e.label",
    )


# -- local linear surrogates ----------------------------------------------------------


class LocalSurrogate:
    """Weighted ridge regression around each row, in standardised space.

    Perturbed points are drawn once from the background's mean and spread
    (category codes from its frequencies) and scored once; what differs between
    rows is only the kernel weight of each point, so explaining a row costs no
    further scoring and no shuffle.
    """

    def __init__(
        self,
        scorer,
        stats: Mapping[str, tuple[float, float]],
        background: Sequence[Mapping[str, float]] = (),
        categorical: Sequence[str] = (),
        n_samples: int = 1000,
        seed: int = 0,
        kernel_width: float | None = None,
        ridge: float = 1.0,
        method: str = "prob",
        threshold: float = 0.5,
    ):
        if method not in ("prob", "pred"):
            raise ValueError("method must be 'prob' or 'pred'")
        self.scorer = scorer
        self.features = list(scorer.features)
        self.categorical = [f for f in self.features if f in set(categorical)]
        self.stats = {f: stats[f] for f in self.features if f not in self.categorical}
        self.width = kernel_width or 0.75 * math.sqrt(len(self.features))
        self.ridge = ridge
        self.method, self.threshold = method, threshold
        rng = np.random.default_rng(seed)
        self.points = np.empty((n_samples, len(self.features)))
        for j, f in enumerate(self.features):
            if f in self.categorical:
                pool = np.array([float(r[f]) for r in background])
                self.points[:, j] = rng.choice(pool, n_samples)
            else:
                # rounded so that the same points can be written down elsewhere
                self.points[:, j] = np.round(rng.standard_normal(n_samples), 6)

    def _original(self) -> np.ndarray:
        """The points as the scorer sees them."""
        out = self.points.copy()
        for j, f in enumerate(self.features):
            if f in self.stats:
                mean, spread = self.stats[f]
                out[:, j] = out[:, j] * spread + mean
        return out

    def _score_points(self, spark) -> np.ndarray:
        rows = [(i, *map(float, p)) for i, p in enumerate(self._original())]
        schema = ", ".join(["__i int", *[f"`{f}` double" for f in self.features]])
        scored = self.scorer.score(spark.createDataFrame(rows, schema), "__score")
        found = {r["__i"]: r["__score"] for r in scored.select("__i", "__score").collect()}
        scores = np.array([found[i] for i in range(len(rows))])
        return _target(scores, self.method, self.threshold)

    def explain(self, df: DataFrame, id: str) -> DataFrame:
        """(id, intercept, one coefficient per feature)."""
        answers = self._score_points(df.sparkSession)
        features, stats, categorical = self.features, self.stats, set(self.categorical)
        points, width, ridge = self.points, self.width, self.ridge
        # not the bound method: it would carry the scorer to the tasks
        to_target = partial(_target, method=self.method, threshold=self.threshold)
        scored = self.scorer.score(df.select(id, *features), "__score")

        def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                parts = [
                    _ridge_rows(batch.iloc[i : i + 256], features, stats, categorical, points,
                                answers, to_target, width, ridge)
                    for i in range(0, len(batch), 256)
                ]
                for part, start in zip(parts, range(0, len(batch), 256)):
                    out = pd.DataFrame(part, columns=["intercept", *features])
                    out.insert(0, id, batch[id].to_numpy()[start : start + 256])
                    yield out

        schema = StructType(
            [
                df.schema[id],
                StructField("intercept", DoubleType()),
                *[StructField(f, DoubleType()) for f in features],
            ]
        )
        return scored.mapInPandas(solve, schema)


def _target(score: np.ndarray, method: str, threshold: float) -> np.ndarray:
    return score if method == "prob" else (score > threshold).astype(float)


def _ridge_rows(rows, features, stats, categorical, points, answers, to_target, width, ridge):
    """Intercept and coefficients of every row of a batch.

    The weighted moments are products of kernel weights (rows x points) and the points'
    outer products. A category column is 1 where a point has the row's code, so its
    moments are the same products with the weights of those points alone.
    """
    n, d = len(rows), len(features)
    coded = [j for j, f in enumerate(features) if f in categorical]
    plain = [j for j in range(d) if j not in coded]
    raw = rows[features].to_numpy(dtype=float)
    mean, spread = (np.array([stats[features[j]][k] for j in plain]) for k in (0, 1))
    own, drawn = (raw[:, plain] - mean) / spread, points[:, plain]
    here = to_target(rows["__score"].to_numpy(dtype=float))
    gap = (own * own).sum(axis=1)[:, None] - 2.0 * own @ drawn.T + (drawn * drawn).sum(axis=1)[None, :]
    weight = np.exp(-np.maximum(gap, 0.0) / (2.0 * width**2))
    same = [(raw[:, j, None] == points[None, :, j]).astype(float) for j in coded]
    other = math.exp(-1.0 / (2.0 * width**2))  # what a point of another code weighs
    for match in same:
        weight *= other + (1.0 - other) * match

    k = len(plain)
    upper = np.triu_indices(k)
    first = np.column_stack([np.ones(len(points)), answers, drawn])
    second = np.column_stack([drawn * answers[:, None], drawn[:, upper[0]] * drawn[:, upper[1]]])
    # a row weighs its own point with 1, which has its own codes
    mine = np.column_stack([np.ones(n), here, own])
    one = weight @ first + mine
    two = weight @ second + np.column_stack([own * here[:, None], own[:, upper[0]] * own[:, upper[1]]])
    total, sum_y = one[:, 0], one[:, 1]
    sum_x, sum_xy, gram = np.empty((n, d)), np.empty((n, d)), np.empty((n, d, d))
    sum_x[:, plain], sum_xy[:, plain] = one[:, 2:], two[:, :k]
    places = np.array(plain, int)
    gram[:, places[upper[0]], places[upper[1]]] = gram[:, places[upper[1]], places[upper[0]]] = two[:, k:]
    for i, j in enumerate(coded):
        matched = weight * same[i]
        part = matched @ first + mine
        sum_x[:, j], sum_xy[:, j] = part[:, 0], part[:, 1]
        gram[:, j, j] = part[:, 0]
        gram[:, j, plain] = gram[:, plain, j] = part[:, 2:]
        for h in range(i):
            gram[:, j, coded[h]] = gram[:, coded[h], j] = np.einsum("nm,nm->n", matched, same[h]) + 1.0
    x_mean, y_mean = sum_x / total[:, None], sum_y / total
    moment = sum_xy - sum_x * y_mean[:, None]
    gram += ridge * np.eye(d) - sum_x[:, :, None] * x_mean[:, None, :]
    beta = np.linalg.solve(gram, moment[:, :, None])[:, :, 0]
    return np.column_stack([y_mean - (beta * x_mean).sum(axis=1), beta])
