"""Reject inference: turn unlabeled applicants into weighted training rows.

Input is one table in which ``y = -1`` marks a rejected applicant. Each method
returns the augmented table: the input columns with a usable label ``y`` and a
weight ``w``, ready for any weighted learner.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskframe.functions.lookup import HOT_PARTS, attach_state, fits_broadcast
from riskframe.functions.ordering import exact_quantiles, with_bucket
from riskframe.operators.measure import balanced_accuracy_of, fpr_cutoff, ratio
from riskframe.operators.neighbours import nearest_neighbours
from riskframe.operators.spreading import spread_in_blocks
from riskframe.session import cut_lineage

UNLABELED = -1
#: Pieces of the list of a crowded end of the spreading graph.
PIECES = 4096
#: Rows beyond which labels are spread in blocks.
BLOCKS_FROM = 200_000


def accept_labels(df: DataFrame, label: str = "y", out: str = "accepted") -> DataFrame:
    """1 for an applicant with a known label, 0 for a rejected one: the target
    of the accept model."""
    return df.withColumn(out, F.when(F.col(label) == UNLABELED, 0).otherwise(1))


def upward(df: DataFrame, p_accept: str = "p_accept", floor: float = 0.0) -> DataFrame:
    """Accepted rows weighted by 1 / P(accept); ``floor`` clips tiny probabilities.
    A probability of 0 without a floor gives a null weight."""
    p = F.greatest(F.col(p_accept), F.lit(float(floor)))
    return df.filter(F.col("y") != UNLABELED).withColumn("w", ratio(F.lit(1.0), p))


def downward(df: DataFrame, p_accept: str = "p_accept") -> DataFrame:
    """Accepted rows weighted by 1 - P(accept)."""
    kept = df.filter(F.col("y") != UNLABELED)
    return kept.withColumn("w", F.lit(1.0) - F.col(p_accept))


def soft_cutoff(
    df: DataFrame,
    p_accept: str = "p_accept",
    points: int = 100,
    digits: int = 6,
    close_last_bin: bool = False,
) -> DataFrame:
    """Accepted rows weighted by 1 / (accept share of their score bin).

    Bins are cut at ``points`` evenly spaced percentiles of P(accept) over all
    rows and are half open, so rows at the maximum keep weight 1 unless
    ``close_last_bin``.
    """
    steps = [i / (points - 1) for i in range(points)]
    cuts = exact_quantiles(df, p_accept, steps)[None]
    edges = sorted({round(v, digits) for v in cuts})
    if close_last_bin:
        edges = edges[:-1] or edges
    binned = with_bucket(df, p_accept, edges, "__bin")
    share = binned.groupBy(F.col("__bin").alias("__b")).agg(
        F.avg((F.col("y") != UNLABELED).cast("double")).alias("__share")
    )
    last = len(edges) if not close_last_bin else len(edges) + 1
    inside = (F.col("__bin") >= 1) & (F.col("__bin") < last)
    # at most ``points`` rows
    joined = binned.filter(F.col("y") != UNLABELED).join(
        F.broadcast(share), F.col("__bin") == F.col("__b"), "left"
    )
    weight = F.when(inside & (F.col("__share") > 0), F.lit(1.0) / F.col("__share")).otherwise(1.0)
    return joined.withColumn("w", weight).drop("__bin", "__b", "__share")


def fuzzy_parcels(df: DataFrame, p_bad: str = "p_bad") -> DataFrame:
    """Every rejected row twice: as good with 1 - P(bad), as bad with P(bad)."""
    kind = df.schema["y"].dataType
    p = F.col(p_bad)
    known = F.array(F.struct(F.col("y").alias("y"), F.lit(1.0).alias("w")))
    both = F.array(
        F.struct(F.lit(0).cast(kind).alias("y"), (F.lit(1.0) - p).alias("w")),
        F.struct(F.lit(1).cast(kind).alias("y"), p.cast("double").alias("w")),
    )
    parcels = F.when(F.col("y") == UNLABELED, both).otherwise(known)
    spread = df.withColumn("__parcel", F.explode(parcels))
    return spread.withColumns({"y": F.col("__parcel.y"), "w": F.col("__parcel.w")}).drop("__parcel")


def extrapolate(
    df: DataFrame,
    p_bad: str = "p_bad",
    mode: str = "positive",
    cut: float = 0.5,
    high: float = 0.8,
    low: float = 0.15,
) -> DataFrame:
    """Rejected rows labelled by P(bad) > 0.5 and appended with weight 1.

    ``positive`` keeps the ones labelled bad, ``confident`` those above 0.8 or
    below 0.15, ``all`` keeps every one.
    """
    p = F.col(p_bad)
    chosen = {
        "positive": p > cut,
        "all": F.lit(True),
        "confident": (p > high) | (p < low),
    }
    if mode not in chosen:
        raise ValueError(f"unknown mode {mode!r}; use one of {sorted(chosen)}")
    unlabeled = F.col("y") == UNLABELED
    kept = df.filter(~unlabeled | chosen[mode])
    inferred = (p > cut).cast(df.schema["y"].dataType)
    return kept.withColumns({"y": F.when(unlabeled, inferred).otherwise(F.col("y")), "w": F.lit(1.0)})


# -- label spreading -----------------------------------------------------------


def spreading_lists(neighbours: DataFrame, hot: bool) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The graph without self loops by the ends that edges point at, the degrees, and crowded ends.

    ``neighbours`` lists each row's nearest neighbours. The degree of a row is the number
    of others that list it. Returns (dst, srcs, root) with the rows that list ``dst`` and the
    root of their number, (node, root), and with ``hot`` (dst): the few ends that hold
    more than ``1 / HOT_PARTS`` of the edges, whose lists are cut into pieces.
    """
    edges = neighbours.filter(F.col("src") != F.col("dst")).select("src", "dst")
    if not hot:
        lists = cut_lineage(edges.groupBy("dst").agg(F.collect_list("src").alias("srcs"), F.sqrt(F.count("*").cast("double")).alias("root")))
        return lists, lists.select(F.col("dst").alias("node"), "root"), None
    edges = cut_lineage(edges)  # read several times
    counts = cut_lineage(edges.groupBy("dst").agg(F.count("*").alias("degree")))
    total = counts.agg(F.sum("degree")).first()[0] or 0
    root = F.sqrt(F.col("degree").cast("double"))
    crowds = cut_lineage(counts.filter(F.col("degree") > F.lit(total / HOT_PARTS)).select("dst", root.alias("__root")))
    dealt = edges.join(F.broadcast(crowds), "dst", "left")
    piece = F.when(F.col("__root").isNotNull(), F.pmod(F.xxhash64("src"), F.lit(PIECES))).otherwise(0)
    lists = dealt.groupBy("dst", piece.alias("__piece")).agg(F.collect_list("src").alias("srcs"), F.first("__root").alias("__root"))
    whole = F.coalesce("__root", F.sqrt(F.size("srcs").cast("double"))).alias("root")
    return cut_lineage(lists.select("dst", "srcs", whole)), counts.select(F.col("dst").alias("node"), root.alias("root")), crowds.select("dst")


def label_spreading(
    df: DataFrame,
    id: str,
    vector: str,
    k: int = 7,
    alpha: float = 0.2,
    max_iter: int = 30,
    tol: float = 1e-3,
    neighbours: DataFrame | None = None,
    recall: float | None = None,
) -> DataFrame:
    """Labels (id, y, w) for all rows, spread over the nearest-neighbour graph.

    ``recall`` asks for neighbours from projection trees that find at least that share
    of the true ones; without it they are exact, at a cost that nears all pairs in
    many dimensions.

    The graph is directed: each row points at its ``k`` nearest rows, itself
    included. A round is ``F = alpha * S * F + (1 - alpha) * Y``; rounds stop
    when the total change falls below ``tol``, or after ``max_iter``.
    """
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")
    if neighbours is None:
        neighbours = nearest_neighbours(df, id, vector, k, recall=recall)
    given = df.select(
        F.col(id).alias("node"),
        (F.col("y") == 0).cast("double").alias("y0"),
        (F.col("y") == 1).cast("double").alias("y1"),
    )
    given = cut_lineage(given)
    small = fits_broadcast(given, "node")
    if not small and given.count() > BLOCKS_FROM:
        told = spread_in_blocks(given, neighbours, alpha, max_iter, tol)
        return told.select(F.col("node").alias(id), F.col("label").alias("y"), F.lit(1.0).alias("w"))
    # a weight is 1 / (root of the degree of src * root of the degree of dst)
    lists, roots, hot = spreading_lists(neighbours, not small)
    own = attach_state(given, roots, "node", "node", ["root"], small=small, hot_keys=None if small else given.select("node").limit(0))
    state = cut_lineage(
        own.select("node", "y0", "y1", F.coalesce("root", F.lit(1.0)).alias("root"), F.col("y0").alias("f0"), F.col("y1").alias("f1"))
    )
    for _ in range(max_iter):
        side = state.select("node", F.col("f0").alias("n0"), F.col("f1").alias("n1"))
        pulled = (
            attach_state(lists, side, "dst", "node", ["n0", "n1"], small=small, hot_keys=hot)
            .select(F.explode("srcs").alias("__src"), (F.col("n0") / F.col("root")).alias("n0"), (F.col("n1") / F.col("root")).alias("n1"))
            .groupBy("__src")
            .agg(F.sum("n0").alias("s0"), F.sum("n1").alias("s1"))
        )
        fresh = state.join(pulled, F.col("node") == F.col("__src"), "left")
        for c in ("0", "1"):
            moved = F.coalesce(F.col(f"s{c}"), F.lit(0.0)) / F.col("root") * F.lit(alpha)
            fresh = fresh.withColumn(f"g{c}", moved + F.col(f"y{c}") * F.lit(1.0 - alpha))
        change = F.abs(F.col("g0") - F.col("f0")) + F.abs(F.col("g1") - F.col("f1"))
        fresh = fresh.select(
            "node", "y0", "y1", "root", F.col("g0").alias("f0"), F.col("g1").alias("f1"), change.alias("move")
        )
        # a round reads the previous one twice: keep its result, not its plan
        fresh = cut_lineage(fresh)
        state = fresh.drop("move")
        if tol > 0 and fresh.agg(F.sum("move")).first()[0] < tol:
            break
    label = F.when(F.col("f1") > F.col("f0"), 1).otherwise(0)
    return state.select(F.col("node").alias(id), label.alias("y"), F.lit(1.0).alias("w"))


# -- measures ------------------------------------------------------------------


def kickout(df: DataFrame, base: str = "base") -> DataFrame:
    """Per model, among applicants the base model approves: share of bad ones now
    rejected minus share of good ones now rejected.

    Input: (model, id, y, pred, base_pred), where ``base_pred`` is the base
    model's prediction for the same applicant.
    """
    approved = F.col("base_pred") == 0
    pred = F.col("pred").cast("double")
    return df.groupBy("model").agg(
        (
            F.avg(F.when(approved & (F.col("y") == 1), pred))
            - F.avg(F.when(approved & (F.col("y") == 0), pred))
        ).alias("kickout")
    )


def reject_report(wide: DataFrame, models: list[str], base: str, bad_rate: float = 0.5) -> DataFrame:
    """Approval rate, balanced accuracy and kickout per model.

    ``wide`` has one row per applicant with ``y`` (-1 for rejected) and one score
    column per model. Each model is cut at its own highest admissible
    false-positive rate on the labeled rows. ``approval_rate`` is the share
    predicted good, ``positive_rate`` the share predicted bad.
    """
    if base not in models:
        raise ValueError(f"the base model {base!r} must be among the models")
    labeled = wide.filter(F.col("y") != UNLABELED).select("y", *models)
    long = labeled.unpivot(["y"], models, "model", "score")
    # one number per model
    cuts = {r["model"]: r["threshold"] for r in fpr_cutoff(long, bad_rate).collect()}
    flags = wide.select(
        "y",
        F.when(F.col(base) >= F.lit(cuts[base]), 1).otherwise(0).alias("base_pred"),
        *[F.when(F.col(m) >= F.lit(cuts[m]), 1).otherwise(0).alias(m) for m in models],
    )
    rows = flags.select("y", "base_pred", *[F.col(m).alias(f"__{m}") for m in models]).unpivot(
        ["y", "base_pred"], [f"__{m}" for m in models], "model", "pred"
    )
    p, y, approved = F.col("pred"), F.col("y"), F.col("base_pred") == 0
    counts = rows.withColumn("model", F.expr("substring(model, 3)")).groupBy("model").agg(
        F.count("*").alias("n"),
        F.count_if(p == 1).alias("n_bad"),
        F.count_if((p == 1) & (y == 1)).alias("tp"),
        F.count_if((p == 1) & (y == 0)).alias("fp"),
        F.count_if((p == 0) & (y == 0)).alias("tn"),
        F.count_if((p == 0) & (y == 1)).alias("fn"),
        F.avg(F.when(approved & (y == 1), p.cast("double"))).alias("kb"),
        F.avg(F.when(approved & (y == 0), p.cast("double"))).alias("kg"),
    )
    cut = F.lit(None).cast("double")
    for name, value in cuts.items():
        cut = F.when(F.col("model") == name, F.lit(float(value))).otherwise(cut)
    return counts.select(
        "model",
        cut.alias("threshold"),
        ratio(F.col("n") - F.col("n_bad"), F.col("n")).alias("approval_rate"),
        ratio(F.col("n_bad"), F.col("n")).alias("positive_rate"),
        balanced_accuracy_of(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn")).alias(
            "balanced_accuracy"
        ),
        (F.col("kb") - F.col("kg")).alias("kickout"),
    )
