"""Whitening of vectors by principal components with refined eigenvectors."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskframe.llm.common import Workspace
from riskframe.llm.eigen import eigen
from riskframe.llm.limbs import exact_products
from riskframe.llm.vectors import STEP_ROWS, first_length, matrix, vector_rows

#: Integers larger than this are no vectors: sums of their products could leave int64 within a step.
LIMIT = 1 << 24
#: An eigenvalue below this share of the largest one counts as zero.
FLAT = 1e-14


def covariance(n: int, rest: list[int], gram: dict[tuple[int, int], int]) -> np.ndarray:
    """Covariance in extended precision from exact sums.

    ``gram`` has the sums of products of rows centred at the integer below the mean,
    ``rest`` what those rows sum up to. The quotient is rounded once, at the end.
    """
    d = len(rest)
    out = np.zeros((d, d), np.longdouble)
    for (i, j), total in gram.items():
        exact = Fraction(n * total - rest[i] * rest[j], n * n)
        high = float(exact)
        out[i, j] = out[j, i] = np.longdouble(high) + np.longdouble(float(exact - Fraction(high)))
    return out


def deviations(dx: np.ndarray, n: int, rest: np.ndarray) -> list[int | None]:
    """Exact sum of (n * dx - rest)^2 of each row, null beyond a long.

    int64 arithmetic is exact modulo 2^64, so a float estimate tells whether it can
    be taken as it is; only sums next to 2^63 are added up in big integers.
    """
    gap = np.int64(n) * dx - rest
    total = (gap * gap).sum(axis=1)
    size = ((n * dx.astype(np.float64) - rest) ** 2).sum(axis=1) / 2.0**63
    out: list[int | None] = total.tolist()
    for k in np.flatnonzero(size > 1 - 1e-9):
        exact = sum((n * int(a) - int(b)) ** 2 for a, b in zip(dx[k], rest))
        out[k] = exact if exact < 1 << 63 else None
    return out


def whiten_vectors(
    vectors: DataFrame,
    components: int = 16,
    scale: int = 64,
    shift: int = 1_000_000,
    key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """Whitened principal components of ``vectors``, one row per (vector, component).

    Entries become integers x = floor(scale * c) + shift. Each distinct x vector
    counts once for the mean and the covariance V (divisor n). Returns (key,
    component, n, deviation, whitened, explained, identity_error): the exact squared
    distance from the mean times n^2, the projection on the unit eigenvector of V
    over the root of its eigenvalue, that eigenvalue's share of the trace, and how
    far the covariance of the whitened vectors is from the identity.

    Sums are exact: rows are centred at the integer below the mean before they are
    multiplied, products go through limbs, the remainder of the mean is taken off
    in integers. d x d sums reach the driver, which solves for the eigenvectors.

    Rows whose vector is null or holds null or non-finite entries are dropped. The
    length of the smallest key's vector holds for all; a vector of another length, or
    with an entry so large that scale * c is beyond 2^24, keeps one row with a null
    component and takes no part. A component without variance has null whitened
    values and takes no part in identity_error. Null keys and rows repeating a key
    stay as rows. Other columns are ignored; no rows give no rows.
    """
    space = Workspace(vectors.sparkSession, "whitening")
    rows = vector_rows(vectors, key, vector)
    d = first_length(rows)
    fits = (F.size("v") == F.lit(d)) & ~F.exists("v", lambda c: F.abs(c * F.lit(float(scale))) >= F.lit(float(LIMIT)))
    fits = F.coalesce(fits, F.lit(False))
    whole = F.transform("v", lambda c: F.floor(c * F.lit(float(scale))).cast("int") + F.lit(shift)).alias("x")
    usable = rows.filter(fits).select("id", whole)
    blank = rows.filter(~fits).select(
        F.col("id").alias(key), F.lit(None).cast("int").alias("component"), F.lit(None).cast("long").alias("n"),
        F.lit(None).cast("long").alias("deviation"),
        *[F.lit(None).cast("double").alias(c) for c in ("whitened", "explained", "identity_error")],
    )
    fit = space.settle(usable.select("x").distinct(), "fit")

    sums = {
        r["at"]: r
        for r in fit.select(F.posexplode("x").alias("at", "x"))
        .groupBy("at").agg(F.count("*").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("s")).collect()
    }
    if not sums:
        return blank
    n = sums[0]["n"]
    centre = [int(sums[i]["s"]) // n for i in range(d)]
    rest = [int(sums[i]["s"]) - n * c for i, c in enumerate(centre)]
    middle, over = np.array(centre, np.int64), np.array(rest, np.int64)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, j = np.triu_indices(d)

        def told(total: np.ndarray) -> pa.RecordBatch:
            columns = [i.astype(np.int32), j.astype(np.int32), total[i, j]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["i", "j", "p"])

        total, bound = np.zeros((d, d), np.int64), 0
        for batch in batches:
            for start in range(0, batch.num_rows, STEP_ROWS):
                dx = matrix(batch.column(0).slice(start, STEP_ROWS), d).astype(np.int64) - middle
                most = len(dx) * int(np.abs(dx).max(initial=0)) ** 2
                if bound + most >= 1 << 62:  # before a sum could leave int64
                    yield told(total)
                    total, bound = np.zeros((d, d), np.int64), 0
                total += exact_products(np.ascontiguousarray(dx.T), dx)
                bound += most
        if bound:
            yield told(total)

    gram = {
        (r["i"], r["j"]): int(r["p"])
        for r in fit.mapInArrow(products, "i int, j int, p long")
        .groupBy("i", "j").agg(F.sum(F.col("p").cast("decimal(38,0)")).alias("p")).collect()
    }
    spread = covariance(n, rest, gram)
    values, axes = eigen(spread)
    trace = float(np.trace(spread))
    kept = min(components, d)
    solid = values[:kept] > FLAT * max(values[0], 0.0)
    turn = axes[:, :kept] / np.sqrt(np.where(solid, values[:kept], 1.0))
    share = values[:kept] / trace if trace > 0 else np.zeros(kept)
    lag = over / n

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, plain = np.zeros((kept, kept)), np.zeros(kept)
        for batch in batches:
            for start in range(0, batch.num_rows, STEP_ROWS):
                y = (matrix(batch.column(0).slice(start, STEP_ROWS), d) - middle - lag) @ turn
                total += y.T @ y
                plain += y.sum(axis=0)
        flat = np.concatenate([total.ravel(), plain])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["at", "s"])

    found = {r["at"]: r["s"] for r in fit.mapInArrow(squares, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()}
    flat = np.array([found[k] for k in range(kept * kept + kept)]) / n
    mean = flat[kept * kept :]
    off = np.abs(flat[: kept * kept].reshape(kept, kept) - np.outer(mean, mean) - np.eye(kept))[np.ix_(solid, solid)]
    error = float(off.max()) if off.size else None

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, STEP_ROWS):
                part = batch.slice(start, STEP_ROWS)
                dx = matrix(part.column(1), d).astype(np.int64) - middle
                y, size = (dx - lag) @ turn, len(dx)
                each = np.repeat(np.arange(size), kept)
                dull = np.tile(~solid, size)
                columns = [
                    part.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), size)),
                    pa.array(np.full(size * kept, n, np.int64)),
                    pa.array(deviations(dx, n, over), pa.int64()).take(pa.array(each)),
                    pa.array(y.ravel(), mask=dull),
                    pa.array(np.tile(share, size)),
                    pa.array([error] * (size * kept), pa.float64()),
                ]
                names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    done = usable.mapInArrow(project, schema).withColumnRenamed("id", key)
    return done.union(blank)
