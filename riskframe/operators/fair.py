"""Fairness interventions before, during and after training."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from riskframe.functions.lookup import fits_broadcast
from riskframe.functions.ordering import exact_quantiles
from riskframe.functions.scorecard import score_vector
from riskframe.operators.measure import (
    accuracy_of,
    balanced_accuracy_of,
    confusion_counts,
    ratio,
)

# -- before training: reweighing ----------------------------------------------


def reweighing_table(df: DataFrame, group: str = "z", label: str = "y") -> DataFrame:
    """Weight P(group) P(label) / P(group, label) of each occurring cell."""
    cells = df.groupBy(group, label).agg(F.count("*").alias("n_cell"))
    # the classes of the label: two rows for a credit table
    sizes = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    n_label = F.lit(None).cast("double")
    for value, size in sizes.items():
        same = F.col(label).eqNullSafe(F.lit(value))
        n_label = F.when(same, F.lit(float(size))).otherwise(n_label)
    n_group = F.sum("n_cell").over(W.partitionBy(group)).cast("double")
    n_all = F.lit(float(sum(sizes.values())))
    return cells.select(
        group, label, (n_group * n_label / (n_all * F.col("n_cell").cast("double"))).alias("w")
    )


def reweigh(df: DataFrame, group: str = "z", label: str = "y", out: str = "w") -> DataFrame:
    """Attach the reweighing weight; a cell that never occurs has no rows to weigh."""
    weights = reweighing_table(df, group, label).select(
        F.col(group).alias("__g"), F.col(label).alias("__l"), F.col("w").alias(out)
    )
    side = F.broadcast(weights) if fits_broadcast(weights, "__g") else weights
    same = F.col(group).eqNullSafe(F.col("__g")) & F.col(label).eqNullSafe(F.col("__l"))
    return df.join(side, same, "left").drop("__g", "__l")


# -- after training: one threshold per group ----------------------------------


def candidate_thresholds(
    df: DataFrame, score: str = "score", n_thresholds: int = 25, digits: int = 6
) -> list[float]:
    """Evenly spaced quantiles of the score, rounded so that the last bits of an
    interpolation cannot flip a comparison."""
    steps = [i / (n_thresholds - 1) for i in range(n_thresholds)]
    return [round(v, digits) for v in exact_quantiles(df, score, steps)[None]]


def threshold_search(
    df: DataFrame,
    perf_metric: str = "balanced_accuracy",
    fair_metric: str = "demographic_parity",
    constraint: float = 0.05,
    n_thresholds: int = 25,
    two_sided: bool = True,
    thresholds: Sequence[float] | None = None,
) -> DataFrame:
    """Best pair of group thresholds under a fairness constraint, as one row.

    Each row falls between two candidate thresholds, so a single aggregate per
    (group, slot) yields the confusion counts of every candidate. The pairs are
    then formed from that table of at most ``2 * (n_thresholds + 1)`` rows.
    ``two_sided=False`` constrains the signed gap only. Without an admissible
    pair the thresholds are null and ``feasible`` is false.
    """
    if perf_metric not in ("balanced_accuracy", "accuracy"):
        raise ValueError(f"unknown performance metric {perf_metric!r}")
    if fair_metric not in ("demographic_parity", "equal_opportunity"):
        raise ValueError(f"unknown fairness metric {fair_metric!r}")
    cuts = list(thresholds) if thresholds is not None else candidate_thresholds(
        df, "score", n_thresholds
    )
    # number of candidates the score exceeds
    slot = sum((F.when(F.col("score") > F.lit(t), 1).otherwise(0) for t in cuts), F.lit(0))
    side = F.when(F.col("z") == 0, 0).otherwise(1)
    slots = df.groupBy(side.alias("side"), slot.alias("slot")).agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")
    )
    above = (
        slots.select("side", "slot", "pos", "neg", F.explode(F.sequence(F.lit(0), F.lit(len(cuts) - 1))).alias("t"))
        .groupBy("side", "t")
        .agg(
            F.sum(F.when(F.col("slot") > F.col("t"), F.col("pos")).otherwise(0)).alias("tp"),
            F.sum(F.when(F.col("slot") > F.col("t"), F.col("neg")).otherwise(0)).alias("fp"),
            F.sum("pos").alias("p"),
            F.sum("neg").alias("n"),
        )
    )
    both = above.groupBy().agg(
        F.collect_list(F.when(F.col("side") == 0, F.struct("t", "tp", "fp", "p", "n"))).alias("c0"),
        F.collect_list(F.when(F.col("side") == 1, F.struct("t", "tp", "fp", "p", "n"))).alias("c1"),
    )
    pairs = both.select(F.explode("c0").alias("a"), "c1").select("a", F.explode("c1").alias("b"))
    tp, fp = F.col("a.tp") + F.col("b.tp"), F.col("a.fp") + F.col("b.fp")
    fn = F.col("a.p") + F.col("b.p") - tp
    tn = F.col("a.n") + F.col("b.n") - fp
    perf = (balanced_accuracy_of if perf_metric == "balanced_accuracy" else accuracy_of)(
        tp, fp, tn, fn
    )
    if fair_metric == "demographic_parity":
        gap = ratio(F.col("b.tp") + F.col("b.fp"), F.col("b.p") + F.col("b.n")) - ratio(
            F.col("a.tp") + F.col("a.fp"), F.col("a.p") + F.col("a.n")
        )
    else:
        gap = ratio(F.col("b.tp"), F.col("b.p")) - ratio(F.col("a.tp"), F.col("a.p"))
    limited = F.round(F.abs(gap) if two_sided else gap, 12)
    grid = pairs.select(
        F.col("a.t").alias("i0"),
        F.col("b.t").alias("i1"),
        F.round(perf, 12).alias("perf"),
        gap.alias("gap"),
        (limited <= F.lit(float(constraint))).alias("ok"),
    )
    values = F.array(*[F.lit(float(t)) for t in cuts])
    best = grid.agg(
        F.min(
            F.when(F.col("ok"), F.struct((-F.col("perf")).alias("rank"), "i0", "i1", "gap"))
        ).alias("top")
    )
    return best.select(
        F.get(values, F.col("top.i0")).alias("threshold_0"),
        F.get(values, F.col("top.i1")).alias("threshold_1"),
        (-F.col("top.rank")).alias(perf_metric),
        F.col("top.gap").alias("gap"),
        F.col("top").isNotNull().alias("feasible"),
    )


def apply_thresholds(df: DataFrame, threshold_0: float, threshold_1: float) -> DataFrame:
    """``pred = score > threshold`` of the row's group; anything but 0 is group 1."""
    over = F.when(F.col("z") == 0, F.col("score") > F.lit(float(threshold_0))).otherwise(
        F.col("score") > F.lit(float(threshold_1))
    )
    return df.withColumn("pred", over.cast("int"))


# -- during training: group-constrained fitting ---------------------------------


def constrained_fit(
    df: DataFrame,
    classifier,
    features: str = "features",
    label: str = "y",
    group: str = "z",
    id: str = "app_id",
    constraint: str = "fnr,fpr",
    tolerance: float = 0.05,
    rounds: int = 10,
    step: float = 1.0,
    threshold: float = 0.5,
):
    """Weighted fits that narrow the gap in error rates between the groups.

    Each round measures the false-positive and false-negative rate of every
    group; cells (group, label) whose rate exceeds the lowest group's by more
    than ``tolerance`` get a heavier weight, and the learner is fitted again.
    Returns the model of the round with the smallest excess and the history
    [(round, fpr gap, fnr gap)]. ``df`` is read twice per round; see ``learn.training_table``.
    """
    watched = {name.strip() for name in constraint.split(",")}
    if not watched <= {"fpr", "fnr"} or not watched:
        raise ValueError("constraint must name fpr, fnr or both")
    weights: dict[tuple, float] = {}
    history, best = [], None
    for turn in range(rounds + 1):
        weight = F.lit(1.0)
        for (g, y), value in weights.items():
            hit = (F.col(group) == F.lit(g)) & (F.col(label) == y)
            weight = F.when(hit, F.lit(float(value))).otherwise(weight)
        model = classifier.fit(
            df.withColumn("__dual", weight), features, label, "__dual" if weights else None, id
        )
        scored = score_vector(model, df.select(group, label, features), features)
        flags = scored.withColumn("pred", (F.col("score") >= threshold).cast("int"))
        counts = confusion_counts(flags, [group], label=label).collect()
        rates = {}
        for row in counts:
            negatives, positives = row["fp"] + row["tn"], row["tp"] + row["fn"]
            rates[row[group]] = {
                "fpr": row["fp"] / negatives if negatives else None,
                "fnr": row["fn"] / positives if positives else None,
            }
        gaps, excess = {}, 0.0
        for name, y in (("fpr", 0), ("fnr", 1)):
            known = {g: r[name] for g, r in rates.items() if r[name] is not None}
            floor = min(known.values(), default=0.0)
            gaps[name] = max(known.values(), default=0.0) - floor
            if name not in watched:
                continue
            for g, rate in known.items():
                over = rate - floor - tolerance
                excess = max(excess, over)
                if over > 0:
                    weights[(g, y)] = weights.get((g, y), 1.0) * math.exp(step * over)
        history.append((turn, gaps["fpr"], gaps["fnr"]))
        if best is None or excess < best[0]:
            best = (excess, model)
        if excess <= 0:
            break
    return best[1], history
