"""Near-duplicate vectors by PCA-ordered tiled comparison."""

from __future__ import annotations

import math
import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from riskframe.llm.common import Workspace, components, smallest_reachable

#: Vectors per tile, leading dimensions that bound a tile, dimensions added per step.
TILE, BOX, STEP = 1024, 8, 8
#: Room for rounding: a pair is given up only this far below the threshold.
SLACK = 1e-9


def _usable(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(rows: np.ndarray) -> np.ndarray:
    # the scale first: squares of tiny or huge components would leave the doubles
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def principal_axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """Per vector length, an orthogonal basis ordered by the variance along it.

    From the exact second moments of all unit vectors, added up per task: d x d
    numbers reach the driver for each length, whatever the number of vectors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            by_size = defaultdict(list)
            for vector in batch.column(0).to_pylist():
                by_size[len(vector)].append(vector)
            for d, rows in by_size.items():
                x = np.column_stack([_unit(np.array(rows, np.float64)), np.ones(len(rows))])
                sums[d] = sums.get(d, 0) + x.T @ x
        for d, total in sums.items():
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"d": [d], "m": [total.tobytes()]}))

    totals: dict[int, np.ndarray] = {}
    for row in classes.select("v").mapInArrow(run, "d long, m binary").toLocalIterator():
        d = row["d"]
        totals[d] = totals.get(d, 0) + np.frombuffer(row["m"], np.float64).reshape(d + 1, d + 1)
    axes = {}
    for d, total in totals.items():
        n, mean = total[-1, -1], total[-1, :-1] / total[-1, -1]
        values, vectors = np.linalg.eigh(total[:-1, :-1] / n - np.outer(mean, mean))
        axes[d] = vectors[:, np.argsort(-values)]
    return axes


def linked_pairs(a: np.ndarray, b: np.ndarray, same: bool, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two tiles of rotated unit vectors whose cosine may reach the threshold.

    Products of the leading dimensions are accumulated; what the rest can still add
    is bounded by the product of the suffix norms; a pair is dropped as soon as
    even that falls short. Survivors are few after the first steps and go on as a list.
    """
    d = a.shape[1]
    tail_a = np.sqrt(np.maximum(np.cumsum((a * a)[:, ::-1], axis=1)[:, ::-1], 0))
    tail_b = np.sqrt(np.maximum(np.cumsum((b * b)[:, ::-1], axis=1)[:, ::-1], 0))
    first = min(STEP, d)
    dots = a[:, :first] @ b[:, :first].T
    bound = dots + (np.outer(tail_a[:, first], tail_b[:, first]) if first < d else 0)
    hit = bound >= cosine - SLACK
    if same:
        hit = np.triu(hit, 1)
    i, j = np.nonzero(hit)
    partial = dots[i, j]
    for start in range(first, d, STEP):
        end = min(start + STEP, d)
        partial = partial + np.einsum("ij,ij->i", a[i, start:end], b[j, start:end])
        rest = tail_a[i, end] * tail_b[j, end] if end < d else 0.0
        keep = partial + rest >= cosine - SLACK
        i, j, partial = i[keep], j[keep], partial[keep]
    return i, j


def near_vectors(
    vectors: DataFrame, cosine: float, key: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """Links of vectors with equal labels and cosine >= ``cosine``, in double precision.

    Returns (key, n_links, component_id, kept) per row: how many other rows are
    linked directly, the smallest key reachable, and whether it is the row's own.

    Equal vectors of a label are one class. Classes are sorted along the first
    principal axis into tiles; tile pairs whose boxes of leading coordinates lie
    too far apart are never formed; each other pair is compared in one task, which
    returns per class the number of linked rows and the smallest class its links
    reach inside the pair - never the links themselves. Vectors of different length
    link with nothing, nor do null, zero or non-finite vectors and null labels or
    keys (0 links, themselves as component; a null key has none and is kept). Rows
    repeating a key count as rows. Other columns are ignored; no rows give none.
    """
    spark = vectors.sparkSession
    space = Workspace(spark, "near-vectors")
    rows = vectors.select(
        F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.col(label).cast("string").alias("label")
    )
    good = F.col("id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("v"))
    rows = rows.withColumn("good", good)
    stamp = [F.xxhash64("label", "v", F.lit(seed)).alias(f"h{seed}") for seed in (1, 2)]
    usable = rows.filter("good").select("id", "label", "v", *stamp)
    classes = space.settle(
        usable.groupBy("h1", "h2").agg(
            F.min("id").alias("c"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("v").alias("v")
        ),
        "classes",
    )
    axes = principal_axes(classes)
    basis = spark.sparkContext.broadcast(pickle.dumps(axes))  # d x d numbers per length

    def first_axis(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = pickle.loads(basis.value)
        for batch in batches:
            out = [float((_unit(np.array([v], np.float64)) @ turn[len(v)][:, :1])[0, 0]) for v in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, "x"])

    placed = classes.select("c", "n", "v", F.concat("label", F.lit("|"), F.size("v")).alias("g")).mapInArrow(
        first_axis, f"c long, n long, v {dict(classes.dtypes)['v']}, g string, x double"
    )

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = pickle.loads(basis.value)
        held: list[tuple] = []

        def tile() -> pa.RecordBatch:
            group = held[0][3]
            x = _unit(np.array([r[2] for r in held], np.float64))
            lead = x @ turn[x.shape[1]][:, :BOX]
            pad = np.zeros((len(held), BOX - lead.shape[1]))
            lead = np.column_stack([lead, pad])
            frame = {
                "g": [group], "tile": [int(held[0][0])], "low": [lead.min(0).tolist()], "high": [lead.max(0).tolist()],
                "c": [[r[0] for r in held]], "n": [[r[1] for r in held]], "x": [x.tobytes()],
            }
            return pa.RecordBatch.from_pydict(frame)

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if held and (row[3] != held[0][3] or len(held) == TILE):
                    yield tile()
                    held.clear()
                held.append(row)
        if held:
            yield tile()

    # few rows per task would make small tiles, and their pairs many
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-classes.count() // (4 * TILE))))
    ordered = placed.repartitionByRange(parts, "g", "x").sortWithinPartitions("g", "x")
    table = space.settle(
        ordered.mapInArrow(
            tiles,
            "g string, tile long, low array<double>, high array<double>, c array<long>, n array<long>, x binary",
        ),
        "tiles",
    )
    # unit vectors with this cosine lie at most so far apart, along every axis
    reach = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-6
    bounds = table.select("g", "tile", "low", "high")

    def bins(low: Column, high: Column) -> Column:
        return F.explode(F.sequence(F.floor(low / reach).cast("int"), F.floor(high / reach).cast("int")))

    left = bounds.select("g", F.col("tile").alias("a"), F.col("low").alias("la"), F.col("high").alias("ha")).withColumn(
        "bin", bins(F.col("la")[0], F.col("ha")[0] + reach)
    )
    right = bounds.select("g", F.col("tile").alias("b"), F.col("low").alias("lb"), F.col("high").alias("hb")).withColumn(
        "bin", bins(F.col("lb")[0], F.col("hb")[0])
    )
    apart = F.lit(0.0)
    for k in range(BOX):
        gap = F.greatest(F.lit(0.0), F.col("lb")[k] - F.col("ha")[k], F.col("la")[k] - F.col("hb")[k])
        apart = apart + gap * gap
    ahead = (F.col("la")[0] < F.col("lb")[0]) | ((F.col("la")[0] == F.col("lb")[0]) & (F.col("a") <= F.col("b")))
    pairs = space.settle(
        left.join(right, ["g", "bin"]).filter(ahead).filter(apart <= reach * reach).select("a", "b").distinct(), "pairs"
    )
    side = table.select("tile", "c", "n", "x")
    work = pairs.join(side.select(F.col("tile").alias("a"), F.col("c").alias("ca"), F.col("n").alias("na"), F.col("x").alias("xa")), "a").join(
        side.select(F.col("tile").alias("b"), F.col("c").alias("cb"), F.col("n").alias("nb"), F.col("x").alias("xb")), "b"
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = pickle.loads(basis.value)
        for batch in batches:
            for k in range(batch.num_rows):
                tile_a, tile_b, ca, na, xa, cb, nb, xb = (
                    batch.column(name)[k].as_py() for name in ("a", "b", "ca", "na", "xa", "cb", "nb", "xb")
                )
                same = tile_a == tile_b
                a = np.frombuffer(xa, np.float64).reshape(len(ca), -1)
                b = a if same else np.frombuffer(xb, np.float64).reshape(len(cb), -1)
                ra, rb = a @ turn[a.shape[1]], b @ turn[a.shape[1]]
                heads, tails = [], []
                step = 512  # strips, so that a matrix of products stays small
                for s in range(0, len(ra), step):
                    for t in range(s if same else 0, len(rb), step):
                        i, j = linked_pairs(ra[s : s + step], rb[t : t + step], same and s == t, cosine)
                        exact = np.einsum("ij,ij->i", a[s + i], b[t + j]) >= cosine
                        heads.append(s + i[exact])
                        tails.append(t + j[exact])
                i, j = np.concatenate(heads), np.concatenate(tails)
                if not len(i):
                    continue
                ids = np.array(ca if same else [*ca, *cb], np.int64)
                many = np.array(na if same else [*na, *nb], np.int64)
                j = j if same else j + len(ca)
                order = np.argsort(ids, kind="stable")  # the smallest class first
                place = np.empty(len(ids), np.int64)
                place[order] = np.arange(len(ids))
                root = ids[order][smallest_reachable(len(ids), place[i], place[j])][place]
                links = np.bincount(i, many[j], len(ids)) + np.bincount(j, many[i], len(ids))
                touched = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[touched]), pa.array(links[touched].astype(np.int64)), pa.array(root[touched])],
                    names=["c", "links", "root"],
                )

    found = space.settle(work.mapInArrow(compare, "c long, links long, root long"), "found")
    reached = components(found.select(F.col("c").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("c").agg(F.sum("links").alias("links"))
    finished = space.settle(
        classes.select("h1", "h2", "c", "n").join(counts, "c", "left")
        .join(reached.select(F.col("node").alias("c"), "root"), "c", "left")
        .select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                F.coalesce("root", "c").alias("component_id")),
        "finished",
    )
    member = usable.select("id", "h1", "h2").join(finished, ["h1", "h2"]).select("id", "n_links", "component_id")
    alone = rows.filter(~F.col("good")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    space.release("finished")
    return member.union(alone).select(
        F.col("id").alias(key), "n_links", "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )
