"""Performance metrics, cut-offs and group-fairness metrics.

Input is a long scored table, one row per (model, applicant), with columns
``model``, ``score`` and/or ``pred``, label ``y`` and sensitive attribute ``z``.
All models are measured in the same pass. Label 1 means default (bad).
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from riskframe.functions.ordering import KEYS_PER_BUCKET, MAX_BUCKETS, range_bounds, running_totals
from riskframe.session import cut_lineage


# -- building blocks ---------------------------------------------------------


def scored_long(
    df: DataFrame, scores: Sequence[str], keep: Sequence[str], value: str = "score"
) -> DataFrame:
    """Wide score columns to one row per (model, applicant)."""
    return df.unpivot(list(keep), list(scores), "model", value)


def ratio(top: Column, bottom: Column) -> Column:
    """Division as double, null when the denominator is 0."""
    return F.when(bottom != 0, top.cast("double") / bottom.cast("double"))


def confusion_counts(
    df: DataFrame, by: Sequence[str] = ("model",), pred: str = "pred", label: str = "y"
) -> DataFrame:
    """tp, fp, tn, fn per group: one partial and one final aggregate."""
    p, y = F.col(pred), F.col(label)
    return df.groupBy(*by).agg(
        F.count_if((p == 1) & (y == 1)).alias("tp"),
        F.count_if((p == 1) & (y == 0)).alias("fp"),
        F.count_if((p == 0) & (y == 0)).alias("tn"),
        F.count_if((p == 0) & (y == 1)).alias("fn"),
    )


def threshold_predictions(
    df: DataFrame,
    thresholds: float | Mapping[str, float] | DataFrame = 0.5,
    default: float = 0.5,
) -> DataFrame:
    """``pred = score >= threshold``; a number, one per model, or a (model,
    threshold) table with a row per model."""
    if isinstance(thresholds, DataFrame):
        side = thresholds.select("model", F.col("threshold").alias("__t"))
        joined = df.join(side, "model", "left")
        cut = F.coalesce(F.col("__t"), F.lit(float(default)))
        return joined.withColumn("pred", (F.col("score") >= cut).cast("int")).drop("__t")
    if isinstance(thresholds, Mapping):
        cut = F.lit(float(default))
        for name, value in thresholds.items():
            cut = F.when(F.col("model") == name, F.lit(float(value))).otherwise(cut)
    else:
        cut = F.lit(float(thresholds))
    return df.withColumn("pred", (F.col("score") >= cut).cast("int"))


def balanced_accuracy_of(tp: Column, fp: Column, tn: Column, fn: Column) -> Column:
    """Mean of the per-class recalls over the classes that occur."""
    tpr, tnr = ratio(tp, tp + fn), ratio(tn, tn + fp)
    return F.coalesce((tpr + tnr) / F.lit(2.0), tpr, tnr)


def accuracy_of(tp: Column, fp: Column, tn: Column, fn: Column) -> Column:
    return ratio(tp + tn, tp + fp + tn + fn)


def precision_of(tp: Column, fp: Column) -> Column:
    return F.coalesce(ratio(tp, tp + fp), F.lit(0.0))


def recall_of(tp: Column, fn: Column) -> Column:
    return F.coalesce(ratio(tp, tp + fn), F.lit(0.0))


def f1_of(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0))


def _quad() -> tuple[Column, Column, Column, Column]:
    return F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn")


# -- single metrics ----------------------------------------------------------


def balanced_accuracy(df: DataFrame) -> DataFrame:
    return confusion_counts(df).select(
        "model", balanced_accuracy_of(*_quad()).alias("balanced_accuracy")
    )


def accuracy(df: DataFrame) -> DataFrame:
    return confusion_counts(df).select("model", accuracy_of(*_quad()).alias("accuracy"))


def precision(df: DataFrame) -> DataFrame:
    return confusion_counts(df).select(
        "model", precision_of(F.col("tp"), F.col("fp")).alias("precision")
    )


def recall(df: DataFrame) -> DataFrame:
    return confusion_counts(df).select(
        "model", recall_of(F.col("tp"), F.col("fn")).alias("recall")
    )


def f1(df: DataFrame) -> DataFrame:
    return confusion_counts(df).select(
        "model", f1_of(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1")
    )


def false_positive_rate(df: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """FP / (FP + TN); null without negatives."""
    counts = confusion_counts(df, by)
    return counts.select(*by, ratio(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"))


def brier_score(df: DataFrame) -> DataFrame:
    gap = F.col("score") - F.col("y")
    return df.groupBy("model").agg(F.avg(gap * gap).alias("brier"))


# -- rank metrics ------------------------------------------------------------


def score_counts(df: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Positives and negatives per distinct score: the map side collapses ties,
    so a score held by a third of the rows costs one row per task."""
    return df.groupBy(*by, "score").agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")
    )


def score_sketch(df: DataFrame) -> tuple[dict, list[float]]:
    """({model: (positives, negatives)}, cut points of the score range) in one pass.

    One row per model reaches the driver: its exact class sizes and quantiles of a
    share of its scores, from which the cut points of all rows are put together.
    """
    looked_at = F.when(F.rand(17) < min(1.0, 10_000 / KEYS_PER_BUCKET), F.col("score").cast("double"))
    probes = [i / MAX_BUCKETS for i in range(1, MAX_BUCKETS)]
    seen = df.select("model", "y", "score", looked_at.alias("__seen"))
    rows = seen.groupBy("model").agg(
        F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n"),
        F.count("score").alias("rows"), F.percentile_approx("__seen", probes, 5 * MAX_BUCKETS).alias("q"),
    ).collect()
    sizes = {r["model"]: (r["p"], r["n"]) for r in rows}
    wanted = min(MAX_BUCKETS, math.ceil(sum(r["rows"] for r in rows) / KEYS_PER_BUCKET))
    steps = sorted((q, r["rows"] / len(r["q"])) for r in rows for q in r["q"] or [])
    bounds, passed, total = [], 0.0, sum(mass for _, mass in steps)
    for q, mass in steps:
        passed += mass
        if len(bounds) + 1 < wanted and passed >= total * (len(bounds) + 1) / wanted:
            bounds.append(q)
    return sizes, sorted(set(bounds))


def _size_of(sizes: Mapping, place: int) -> Column:
    """A model's class size; models are few."""
    out = F.lit(None).cast("long")
    for model, found in sizes.items():
        out = F.when(F.col("model").eqNullSafe(F.lit(model)), F.lit(found[place])).otherwise(out)
    return out


def _curve(df: DataFrame, bounds: Sequence[float] | None) -> tuple[DataFrame, dict]:
    """Running class counts from the highest score down, and class sizes per model."""
    sizes, found = score_sketch(df)
    curve = running_totals(
        score_counts(df),
        "score",
        {"pos": "pos_above", "neg": "neg_above"},
        group=["model"],
        descending=True,
        bounds=found if bounds is None else bounds,
    )
    return curve, sizes


def score_curve(df: DataFrame, bounds: Sequence[float] | None = None) -> DataFrame:
    """Per model and distinct score: rows of each class at or above that score.

    ``bounds`` are optional cut points of the score range, as found by
    :func:`riskframe.functions.ordering.range_bounds`.
    """
    if bounds is None:
        bounds, _ = range_bounds(df, "score")
    return running_totals(
        score_counts(df), "score", {"pos": "pos_above", "neg": "neg_above"}, group=["model"], descending=True, bounds=bounds
    )


def _auc_of(curve: DataFrame) -> DataFrame:
    # negatives strictly above this score lose the pair, tied ones share it
    lost = F.col("pos").cast("double") * (
        F.col("neg_above").cast("double") - F.col("neg").cast("double") / 2
    )
    totals = curve.groupBy("model").agg(
        F.sum(lost).alias("lost"), F.sum("pos").alias("p"), F.sum("neg").alias("n")
    )
    pairs = F.col("p").cast("double") * F.col("n").cast("double")
    return totals.select("model", (1 - ratio(F.col("lost"), pairs)).alias("auc"))


def roc_auc(df: DataFrame, bounds: Sequence[float] | None = None) -> DataFrame:
    """Exact area under the ROC curve; ties count one half. Null for one class."""
    return _auc_of(score_curve(df, bounds))


def ks_cutoff(df: DataFrame, bounds: Sequence[float] | None = None) -> DataFrame:
    """The score that maximises TPR - FPR, and that maximum (KS).

    Ties go to the highest score. When no score separates the classes the
    threshold is null.
    """
    curve, sizes = _curve(df, bounds)
    gaps = curve.select(
        "model",
        "score",
        F.round(
            ratio(F.col("pos_above"), _size_of(sizes, 0)) - ratio(F.col("neg_above"), _size_of(sizes, 1)), 12
        ).alias("gap"),
    )
    best = gaps.groupBy("model").agg(
        F.max(F.struct(F.col("gap").alias("ks"), "score")).alias("top")
    )
    return best.select(
        "model",
        F.when(F.col("top.ks") > 0, F.col("top.score")).alias("threshold"),
        F.greatest(F.col("top.ks"), F.lit(0.0)).alias("ks"),
    )


def fpr_cutoff(
    df: DataFrame, bad_rate: float = 0.25, bounds: Sequence[float] | None = None
) -> DataFrame:
    """Lowest score whose false-positive rate stays within ``bad_rate``.

    A tied score counts as a whole, so the rate of ``score >= threshold`` never
    exceeds the limit. No admissible score gives 0.5.
    """
    curve, sizes = _curve(df, bounds)
    negatives = _size_of(sizes, 1)
    rate = F.when(negatives > 0, ratio(F.col("neg_above"), negatives)).otherwise(0.0)
    return curve.withColumn("rate", rate).groupBy("model").agg(
        F.coalesce(
            F.min(F.when(F.col("rate") <= bad_rate, F.col("score"))), F.lit(0.5)
        ).alias("threshold")
    )


# -- reports -----------------------------------------------------------------


def comparison_report(
    df: DataFrame,
    thresholds: float | Mapping[str, float] | DataFrame = 0.5,
    default: float = 0.5,
    bounds: Sequence[float] | None = None,
) -> DataFrame:
    """AUC, Brier score and the five label metrics per model.

    A model whose rows have no score but a ``pred`` keeps its predictions and
    gets null AUC and Brier score.
    """
    known = ["pred"] if "pred" in df.columns else []
    # rows meet once: all metrics follow from the class counts per score, which are
    # written because two branches read them
    counts = cut_lineage(
        df.groupBy("model", "score", *known).agg(
            F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")
        )
    )
    cut = threshold_predictions(counts.withColumnRenamed("pred", "__given"), thresholds, default)
    if known:
        cut = cut.withColumn("pred", F.coalesce("pred", "__given"))
    p, pos, neg = F.col("pred"), F.col("pos"), F.col("neg")
    score = F.col("score")
    labels = cut.groupBy("model").agg(
        F.sum(F.when(p == 1, pos).otherwise(0)).alias("tp"),
        F.sum(F.when(p == 1, neg).otherwise(0)).alias("fp"),
        F.sum(F.when(p == 0, neg).otherwise(0)).alias("tn"),
        F.sum(F.when(p == 0, pos).otherwise(0)).alias("fn"),
        (F.sum(pos * (1 - score) * (1 - score) + neg * score * score) / F.sum(
            F.when(score.isNotNull(), pos + neg)
        )).alias("brier"),
    )
    if bounds is None:
        bounds, _ = range_bounds(counts, "score")
    scored = counts.filter(score.isNotNull())
    if known:
        scored = scored.groupBy("model", "score").agg(
            F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
        )
    curve = running_totals(
        scored,
        "score",
        {"pos": "pos_above", "neg": "neg_above"},
        group=["model"],
        descending=True,
        bounds=bounds,
    )
    ranks = _auc_of(curve)
    tp, fp, tn, fn = _quad()
    return labels.join(ranks, "model", "left").select(
        "model",
        "auc",
        "brier",
        balanced_accuracy_of(tp, fp, tn, fn).alias("balanced_accuracy"),
        accuracy_of(tp, fp, tn, fn).alias("accuracy"),
        precision_of(tp, fp).alias("precision"),
        recall_of(tp, fn).alias("recall"),
        f1_of(tp, fp, fn).alias("f1"),
    )


# -- group fairness ----------------------------------------------------------


def group_counts(df: DataFrame, by: Sequence[str] = ("model",), benefit_class: int = 1) -> DataFrame:
    """Confusion counts of both sensitive groups side by side, in one pass.

    ``y`` and ``pred`` are first mapped to ``== benefit_class``.
    """
    p = F.col("pred") == benefit_class
    y = F.col("y") == benefit_class
    cells = []
    for group in (0, 1):
        inside = F.col("z") == group
        cells += [
            F.count_if(inside & p & y).alias(f"tp{group}"),
            F.count_if(inside & p & ~y).alias(f"fp{group}"),
            F.count_if(inside & ~p & ~y).alias(f"tn{group}"),
            F.count_if(inside & ~p & y).alias(f"fn{group}"),
        ]
    # rows of any other group still count for the overall balanced accuracy
    cells += [
        F.count_if(p & y).alias("tp"),
        F.count_if(p & ~y).alias("fp"),
        F.count_if(~p & ~y).alias("tn"),
        F.count_if(~p & y).alias("fn"),
    ]
    return df.groupBy(*by).agg(*cells)


def _gap(top: str, bottom: Sequence[str]) -> Column:
    def rate(group: int) -> Column:
        below = F.lit(0)
        for name in bottom:
            below = below + F.col(f"{name}{group}")
        return ratio(F.col(f"{top}{group}"), below)

    return rate(1) - rate(0)


def _positive_share(group: int) -> Column:
    tp, fp, tn, fn = (F.col(f"{c}{group}") for c in ("tp", "fp", "tn", "fn"))
    return ratio(tp + fp, tp + fp + tn + fn)


def _group_accuracy(group: int) -> Column:
    return accuracy_of(*(F.col(f"{c}{group}") for c in ("tp", "fp", "tn", "fn")))


def demographic_parity_of() -> Column:
    return _positive_share(1) - _positive_share(0)


def equal_opportunity_of() -> Column:
    return _gap("tp", ["tp", "fn"])


def average_odds_of() -> Column:
    return (_gap("tp", ["tp", "fn"]) + _gap("fp", ["fp", "tn"])) / 2


def average_predictive_value_of() -> Column:
    return (_gap("tp", ["tp", "fp"]) + _gap("fn", ["fn", "tn"])) / 2


def geometric_mean_accuracy_of() -> Column:
    return F.sqrt(_group_accuracy(1) * _group_accuracy(0))


def demographic_parity(df: DataFrame, benefit_class: int = 1) -> DataFrame:
    """P(pred | z=1) - P(pred | z=0)."""
    counts = group_counts(df, benefit_class=benefit_class)
    return counts.select("model", demographic_parity_of().alias("dpd"))


def equal_opportunity(df: DataFrame, benefit_class: int = 1) -> DataFrame:
    """Gap in true-positive rate."""
    counts = group_counts(df, benefit_class=benefit_class)
    return counts.select("model", equal_opportunity_of().alias("eod"))


def average_odds(df: DataFrame, benefit_class: int = 1) -> DataFrame:
    """Mean of the gaps in true- and false-positive rate."""
    counts = group_counts(df, benefit_class=benefit_class)
    return counts.select("model", average_odds_of().alias("aod"))


def average_predictive_value(df: DataFrame, benefit_class: int = 1) -> DataFrame:
    """Mean of the gaps in precision and in false-omission rate."""
    counts = group_counts(df, benefit_class=benefit_class)
    return counts.select("model", average_predictive_value_of().alias("apvd"))


def geometric_mean_accuracy(df: DataFrame, benefit_class: int = 1) -> DataFrame:
    """Geometric mean of the two groups' accuracies."""
    counts = group_counts(df, benefit_class=benefit_class)
    return counts.select("model", geometric_mean_accuracy_of().alias("gma"))


def fairness_report(df: DataFrame, benefit_class: int = 1) -> DataFrame:
    """All fairness metrics per model from one aggregate."""
    return group_counts(df, benefit_class=benefit_class).select(
        "model",
        demographic_parity_of().alias("dpd"),
        equal_opportunity_of().alias("eod"),
        average_odds_of().alias("aod"),
        average_predictive_value_of().alias("apvd"),
        geometric_mean_accuracy_of().alias("gma"),
        balanced_accuracy_of(*_quad()).alias("balanced_accuracy"),
    )


# -- scorers for tuning ------------------------------------------------------
# A scorer takes a scored table (model, score, pred, y, z) and returns one row
# per model with a column ``value``; larger is better in a search.


def auc_scorer(df: DataFrame) -> DataFrame:
    return roc_auc(df).withColumnRenamed("auc", "value")


def eod_scorer(benefit_class: int = 1):
    """Signed equal-opportunity gap."""

    def scorer(df: DataFrame) -> DataFrame:
        return equal_opportunity(df, benefit_class).withColumnRenamed("eod", "value")

    return scorer


def fairness_scorer(goal: float, penalty: float = 10.0, benefit_class: int = 1):
    """AUC, lowered by ``penalty`` times the excess of the absolute
    equal-opportunity gap over ``goal``."""

    def scorer(df: DataFrame) -> DataFrame:
        gap = F.abs(F.col("eod"))
        over = F.when(gap > goal, F.lit(float(penalty)) * (gap - F.lit(goal))).otherwise(0.0)
        joined = roc_auc(df).join(equal_opportunity(df, benefit_class), "model")
        # an undefined gap is not a reached goal
        return joined.select(
            "model", F.when(F.col("eod").isNotNull(), F.col("auc") - over).alias("value")
        )

    return scorer
