"""Running totals and exact quantiles over a globally ordered key.

A window without ``partitionBy`` sends the table to one task. Here the key's
range is cut into buckets of bounded size, each bucket runs its own window, and
the totals of the lower buckets are added from a small offset table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

KEYS_PER_BUCKET = 1_000_000
MAX_BUCKETS = 2000


def range_bounds(
    df: DataFrame,
    key: str,
    keys_per_bucket: int | None = None,
    max_buckets: int = MAX_BUCKETS,
) -> tuple[list[float], int]:
    """Cut points that leave at most about ``keys_per_bucket`` keys per bucket,
    and the number of non-null keys. One pass that shuffles one sketch per task.

    The sketch looks at one row in ``KEYS_PER_BUCKET / 10_000``: some ten thousand
    per bucket. Where the cuts fall changes the size of the buckets only, never
    what is computed from them.
    """
    keys_per_bucket = keys_per_bucket or KEYS_PER_BUCKET
    value = F.col(key).cast("double")
    looked_at = F.when(F.rand(17) < min(1.0, 10_000 / keys_per_bucket), F.col("v"))
    valid = df.select(value.alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    probes = [i / max_buckets for i in range(1, max_buckets)]
    row = (
        valid.withColumn("seen", looked_at)
        .agg(F.count("*").alias("n"), F.percentile_approx("seen", probes, 5 * max_buckets).alias("q"))
        .first()
    )
    wanted = min(max_buckets, math.ceil(row["n"] / keys_per_bucket))
    if math.ceil(row["n"] / keys_per_bucket) > max_buckets:  # look again, finer
        return range_bounds(df, key, keys_per_bucket, math.ceil(row["n"] / keys_per_bucket))
    if wanted <= 1 or row["q"] is None:
        return [], row["n"]
    chosen = {row["q"][round(i * max_buckets / wanted) - 1] for i in range(1, wanted)}
    return sorted(chosen), row["n"]


def with_bucket(df: DataFrame, key: str, bounds: Sequence[float], out: str) -> DataFrame:
    """Number of bounds at or below the key. Equal keys always share a bucket."""
    if not bounds:
        return df.withColumn(out, F.lit(0))
    if len(bounds) <= 32:
        hits = [F.when(F.col(key) >= F.lit(float(b)), 1).otherwise(0) for b in bounds]
        total: Column = hits[0]
        for hit in hits[1:]:
            total = total + hit
        return df.withColumn(out, total)
    splits = [-math.inf, *[float(b) for b in bounds], math.inf]
    cut = Bucketizer(splits=splits, inputCol="__split_key", outputCol="__split")
    staged = df.withColumn("__split_key", F.col(key).cast("double"))
    return (
        cut.transform(staged)
        .withColumn(out, F.col("__split").cast("int"))
        .drop("__split_key", "__split")
    )


def running_totals(
    counts: DataFrame,
    key: str,
    totals: dict[str, str],
    group: Sequence[str] = (),
    descending: bool = False,
    bounds: Sequence[float] | None = None,
) -> DataFrame:
    """Add inclusive running sums ``totals`` ({source: output}) in key order.

    ``counts`` must hold one row per (group, key). ``bounds`` may come from an
    earlier :func:`range_bounds` on the raw rows; the number of groups is meant
    to be small (models, features).
    """
    group = list(group)
    if bounds is None:
        bounds, _ = range_bounds(counts, key)
    staged = with_bucket(counts, key, bounds, "__bucket")
    order = F.col(key).desc() if descending else F.col(key).asc()
    inside = (
        W.partitionBy(*group, "__bucket")
        .orderBy(order)
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    local = staged.withColumns({out: F.sum(src).over(inside) for src, out in totals.items()})
    if not bounds:
        return local.drop("__bucket")

    bucket_order = F.col("__bucket").desc() if descending else F.col("__bucket").asc()
    before = (
        W.partitionBy(*(group or [F.lit(0)]))
        .orderBy(bucket_order)
        .rowsBetween(W.unboundedPreceding, -1)
    )
    offsets = (
        staged.groupBy(*group, "__bucket")
        .agg(*[F.sum(src).alias(f"__sum_{src}") for src in totals])
        .select(
            *[F.col(g).alias(f"__g_{g}") for g in group],
            F.col("__bucket").alias("__b"),
            *[
                F.coalesce(F.sum(f"__sum_{src}").over(before), F.lit(0)).alias(f"__off_{src}")
                for src in totals
            ],
        )
    )
    same = F.col("__bucket") == F.col("__b")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    joined = local.join(offsets, same, "left")
    return joined.select(
        *counts.columns,
        *[(F.col(out) + F.col(f"__off_{src}")).alias(out) for src, out in totals.items()],
    )


def _keys_at(staged: DataFrame, places: DataFrame) -> DataFrame:
    """(__g, __v, rank): the key at each wanted rank of rows (__g, __bucket, __v).

    ``places`` (t_g, t_bucket, t_ranks) holds at most two ranks per probability and
    group: a bounded broadcast. The keys are counted before they meet the ranks, so
    that no row of the table carries a list of them.
    """
    here = F.col("__g").eqNullSafe(F.col("t_g")) & (F.col("__bucket") == F.col("t_bucket"))
    ordered = W.partitionBy("__g", "__bucket").orderBy("__v")
    return (
        staged.join(F.broadcast(places.select("t_g", "t_bucket")), here, "left_semi")
        .groupBy("__g", "__bucket", "__v")
        .agg(F.count("*").alias("__n"))
        .withColumn("__upto", F.sum("__n").over(ordered))
        .join(F.broadcast(places), here)
        .select("__g", "__v", "__n", "__upto", F.explode("t_ranks").alias("t"))
        .filter("t.t_inner < __upto AND t.t_inner >= __upto - __n")
        .select("__g", "__v", F.col("t.t_rank").alias("rank"))
    )


def exact_quantiles(
    df: DataFrame,
    key: str,
    probabilities: Sequence[float],
    group: str | None = None,
    keys_per_bucket: int | None = None,
) -> dict:
    """Linearly interpolated quantiles as ``{group: [value, ...]}``.

    Small tables use the built-in ``percentile``. Beyond that it is a distributed
    selection: bucket counts tell which buckets hold the wanted ranks, and only
    the keys of those buckets are shuffled and ordered.
    """
    wanted = [float(p) for p in probabilities]
    rows = df.select(
        (F.col(group) if group else F.lit(None).cast("string")).alias("__g"),
        F.col(key).cast("double").alias("__v"),
    ).filter(F.col("__v").isNotNull() & ~F.isnan("__v"))
    bounds, n = range_bounds(rows, "__v", keys_per_bucket)
    if n == 0:
        return {} if group else {None: [None] * len(wanted)}
    if not bounds:
        picked = rows.groupBy("__g").agg(
            F.percentile("__v", F.array(*[F.lit(p) for p in wanted])).alias("q")
        )
        return {r["__g"]: list(r["q"]) for r in picked.collect()}

    staged = with_bucket(rows, "__v", bounds, "__bucket")
    sizes: dict = {}
    for row in staged.groupBy("__g", "__bucket").count().collect():
        sizes.setdefault(row["__g"], {})[row["__bucket"]] = row["count"]

    ranks = []  # (group, bucket, rank inside the bucket, rank in the group)
    places = {}
    for g, by_bucket in sizes.items():
        size = sum(by_bucket.values())
        places[g] = [(math.floor(p * (size - 1)), p * (size - 1)) for p in wanted]
        needed = {lo for lo, _ in places[g]} | {min(lo + 1, size - 1) for lo, _ in places[g]}
        start = 0
        for bucket in sorted(by_bucket):
            stop = start + by_bucket[bucket]
            ranks += [(g, bucket, r - start, r) for r in needed if start <= r < stop]
            start = stop
    spark = df.sparkSession
    g_type = rows.schema["__g"].dataType.simpleString()
    targets = spark.createDataFrame(
        ranks, f"t_g {g_type}, t_bucket int, t_inner bigint, t_rank bigint"
    )
    places_df = targets.groupBy("t_g", "t_bucket").agg(
        F.collect_list(F.struct("t_inner", "t_rank")).alias("t_ranks")
    )
    picked = _keys_at(staged, places_df)
    at = {(r["__g"], r["rank"]): r["__v"] for r in picked.collect()}
    result = {}
    for g, spots in places.items():
        size = sum(sizes[g].values())
        values = []
        for lo, exact in spots:
            low, high = at[(g, lo)], at[(g, min(lo + 1, size - 1))]
            values.append(low + (high - low) * (exact - lo))
        result[g] = values
    return result


def feature_quantiles(
    df: DataFrame, features: Sequence[str], probabilities: Sequence[float]
) -> dict[str, list]:
    """:func:`exact_quantiles` of several columns from the same passes."""
    values = df.select(*[F.col(f).cast("double").alias(f) for f in features])
    long = values.unpivot([], list(features), "feature", "value")
    found = exact_quantiles(long, "value", probabilities, group="feature")
    return {f: found.get(f, [None] * len(list(probabilities))) for f in features}
