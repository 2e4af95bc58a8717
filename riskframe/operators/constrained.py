"""Boosting whose every round weighs its errors by the groups' constraints."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, functions as F

from riskframe.operators.measure import confusion_counts
from riskframe.session import cut_lineage

#: Rounds between two writes of the margins, which keep a round's plan short.
CUT_EVERY = 10
#: A chance this near 0 or 1 counts as that far away, so that a curvature never vanishes.
EDGE = 1e-6


@dataclass
class ConstrainedBoosting:
    """Regression trees on the margin; ``history`` has (round, fpr gap, fnr gap, multipliers)."""

    base: float
    rate: float
    trees: list = field(default_factory=list)
    history: list = field(default_factory=list)

    def margin(self, df: DataFrame, features: str = "features", out: str = "margin") -> DataFrame:
        total: Column = F.lit(self.base)
        kept = df
        for i, tree in enumerate(self.trees):
            kept = _predicted(tree, kept, features, f"__t{i}")
            total = total + F.lit(self.rate) * F.col(f"__t{i}")
        return kept.select(*df.columns, total.alias(out))

    def score(self, df: DataFrame, features: str = "features", out: str = "score") -> DataFrame:
        """``df`` with P(y=1)."""
        scored = self.margin(df, features, "__margin")
        return scored.withColumn(out, _chance(F.col("__margin"))).drop("__margin")

    def score_vector(self, df: DataFrame, vector: str, out: str = "score") -> DataFrame:
        """Like ``score``, as a scorer of any feature columns asks for it."""
        return self.score(df, vector, out)


def _predicted(tree, df: DataFrame, features: str, out: str) -> DataFrame:
    return tree.copy({tree.featuresCol: features, tree.predictionCol: out}).transform(df)


def _chance(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def error_gaps(rates: dict, watched: set[str], tolerance: float) -> tuple[dict, dict]:
    """(gap per rate, violation per cell (group, label)): how far a group's rate lies
    above the lowest group's, less the tolerance; negative where it is kept."""
    gaps, over = {}, {}
    for name, y in (("fpr", 0), ("fnr", 1)):
        known = {g: r[name] for g, r in rates.items() if r[name] is not None}
        floor = min(known.values(), default=0.0)
        gaps[name] = max(known.values(), default=0.0) - floor
        if name in watched:
            over |= {(g, y): rate - floor - tolerance for g, rate in known.items()}
    return gaps, over


def constrained_boosting(
    df: DataFrame,
    features: str = "features",
    label: str = "y",
    group: str = "z",
    constraint: str = "fnr,fpr",
    tolerance: float = 0.02,
    rounds: int = 100,
    learning_rate: float = 0.1,
    max_depth: int = 5,
    min_samples_leaf: int = 1,
    multiplier_step: float = 1.0,
    threshold: float = 0.5,
    weight: str | None = None,
    seed: int = 0,
) -> ConstrainedBoosting:
    """Boosted trees under bounds on the groups' false-positive and false-negative rates.

    A two-player descent: each round fits one regression tree to the gradient of the
    logistic loss plus, for every cell (group, label) whose bound is violated, its
    multiplier times the gradient of the cell's smooth stand-in for the error rate
    (cross entropy, so both gradients point the same way and a row's is scaled by
    1 + multiplier). Leaves hold Newton steps: the tree sees gradient over curvature,
    weighted by the curvature. Then one aggregate per round measures the true rates
    at ``threshold`` and moves the multipliers by ``multiplier_step`` times the
    violation, never below zero. No round fits anything anew; margins are a column
    of the table, written every ``CUT_EVERY`` rounds.

    ``label`` is 0 or 1; rows with a null label, group or weight are left out; an
    empty table or one class gives the constant model. Groups are few values.
    """
    watched = {name.strip() for name in constraint.split(",")}
    if not watched <= {"fpr", "fnr"} or not watched:
        raise ValueError("constraint must name fpr, fnr or both")
    columns = [F.col(features).alias("x"), F.col(label).cast("int").alias("y"), F.col(group).alias("z")]
    mass = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(*columns, mass.alias("w")).filter("y IS NOT NULL AND z IS NOT NULL AND w > 0")
    share = rows.agg(F.sum(F.col("y") * F.col("w")) / F.sum("w")).first()[0]
    share = 0.0 if share is None else float(share)
    edged = min(max(share, EDGE), 1 - EDGE)
    model = ConstrainedBoosting(math.log(edged / (1 - edged)), float(learning_rate))
    if share in (0.0, 1.0):
        return model
    state = cut_lineage(rows.withColumn("f", F.lit(model.base)))
    multipliers: dict[tuple, float] = {}
    held = None
    for turn in range(rounds):
        pull = F.lit(1.0)
        for (g, y), value in multipliers.items():
            pull = F.when((F.col("z") == F.lit(g)) & (F.col("y") == y), F.lit(1.0 + value)).otherwise(pull)
        p = F.least(F.greatest(_chance(F.col("f")), F.lit(EDGE)), F.lit(1 - EDGE))
        curvature = p * (1 - p)
        ready = state.select("x", ((F.col("y") - p) / curvature).alias("step"), (F.col("w") * pull * curvature).alias("mass"))
        tree = DecisionTreeRegressor(
            featuresCol="x", labelCol="step", weightCol="mass", maxDepth=max_depth,
            minInstancesPerNode=min_samples_leaf, seed=seed + turn,
        ).fit(ready)
        model.trees.append(tree)
        moved = _predicted(tree, state, "x", "__t")
        state = moved.select("x", "y", "z", "w", (F.col("f") + F.lit(model.rate) * F.col("__t")).alias("f"))
        if (turn + 1) % CUT_EVERY == 0:
            state = cut_lineage(state)
        # read by the rates and, several times, by the next fit: no pass runs earlier trees again
        held, before = state.persist(StorageLevel.MEMORY_AND_DISK), held
        flags = state.withColumn("pred", (_chance(F.col("f")) >= threshold).cast("int"))
        rates = {}
        for r in confusion_counts(flags, ["z"], label="y").collect():  # one row per group
            negatives, positives = r["fp"] + r["tn"], r["tp"] + r["fn"]
            rates[r["z"]] = {
                "fpr": r["fp"] / negatives if negatives else None,
                "fnr": r["fn"] / positives if positives else None,
            }
        if before is not None:
            before.unpersist()
        gaps, over = error_gaps(rates, watched, tolerance)
        for cell, excess in over.items():
            multipliers[cell] = max(0.0, multipliers.get(cell, 0.0) + multiplier_step * excess)
        multipliers = {cell: value for cell, value in multipliers.items() if value > 0}
        model.history.append((turn, gaps["fpr"], gaps["fnr"], dict(multipliers)))
    if held is not None:
        held.unpersist()
    return model
