"""Vectors compressed to codes of their nearest codebook entries, in exact integer arithmetic."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskframe.functions.lookup import attach_state
from riskframe.llm.common import Workspace
from riskframe.llm.limbs import exact_products
from riskframe.llm.vectors import STEP_ROWS, first_length, matrix, vector_rows


def integers(v: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(v * scale).astype(np.int64)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of each row; ties to the lower index."""
    gaps = (entries * entries).sum(axis=1)[None, :] - 2 * exact_products(x, np.ascontiguousarray(entries.T))
    best = gaps.argmin(axis=1)  # the first of equal ones
    return best, gaps[np.arange(len(x)), best] + (x * x).sum(axis=1)


def moved(entries: np.ndarray, sums: dict[int, tuple[int, list[int]]]) -> np.ndarray:
    """Entries replaced by floor(sum / count) of their parts; unused ones stay."""
    out = entries.copy()
    for entry, (count, total) in sums.items():
        out[entry] = [s // count for s in total]
    return out


def compress_vectors(
    vectors: DataFrame,
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    scale: int = 1024,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """Product codes of ``vectors``: (key, code, error, label_error, codebooks_sha256).

    Components become floor(scale * x). Vectors are cut into ``parts`` equal parts;
    each part's codebook starts with that part of the ``entries`` smallest keys and
    is moved ``rounds`` times to the floored means of what is nearest to it. ``code``
    has two or more hex digits per part, ``error`` the squared distances, and
    ``label_error`` their sum over equal labels (nulls together; null beyond a long).

    A round is one pass: tasks add up their rows per entry, Spark adds the tasks'
    sums, and ``parts * entries`` vectors reach the driver, whatever the number of
    rows. Distances are exact: products come from limbs, everything else is int64.

    Rows whose vector is null or holds null or non-finite components are dropped.
    The length of the smallest key's vector holds for all; a vector of another
    length, or with components so large that a squared distance leaves a long, keeps
    its row with null code and error. Null keys come last among the first entries
    and are coded; rows repeating a key are rows of their own, ordered by their
    vectors. Other columns are ignored; no rows give no rows.
    """
    space = Workspace(vectors.sparkSession, "vector-codes")
    rows = vector_rows(vectors, key, vector, label)
    d = first_length(rows)
    cuts = [(d or 0) * p // parts for p in range(parts + 1)]
    spans = list(zip(cuts, cuts[1:]))
    # twice this, squared and added up over a part, stays below 2^62
    reach = math.isqrt((1 << 62) // max(1, *[b - a for a, b in spans])) // 2
    fits = (F.size("v") == F.lit(d)) & ~F.exists("v", lambda x: F.abs(x * F.lit(float(scale))) >= F.lit(float(reach)))
    usable = rows.filter(fits)

    first = usable.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    start = integers(np.array([r["v"] for r in first], np.float64).reshape(len(first), d or 0), scale)
    books = [start[:, a:b] for a, b in spans]

    def sums_of(books: list[np.ndarray]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = [np.zeros(len(b), np.int64) for b in books]
            totals = [np.zeros(b.shape, np.int64) for b in books]
            for batch in batches:
                for start in range(0, batch.num_rows, STEP_ROWS):
                    x = integers(matrix(batch.column(0).slice(start, STEP_ROWS), d), scale)
                    for (a, b), book, count, total in zip(spans, books, counts, totals):
                        code, _ = nearest(x[:, a:b], book)
                        count += np.bincount(code, minlength=len(book))
                        np.add.at(total, code, x[:, a:b])
            for p, (count, total) in enumerate(zip(counts, totals)):
                used = np.flatnonzero(count)
                yield pa.RecordBatch.from_pydict(
                    {"part": [p] * len(used), "entry": used.tolist(), "n": count[used].tolist(), "s": total[used].tolist()},
                    schema=pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))]),
                )

        return run

    for _ in range(rounds if len(first) else 0):
        partial = usable.select("v").mapInArrow(sums_of(books), "part int, entry int, n long, s array<long>")
        added = (
            partial.select("part", "entry", "n", F.posexplode_outer("s").alias("at", "s"))
            .groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
            .groupBy("part", "entry").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "s"))).alias("s"))
        )
        found: list[dict] = [{} for _ in spans]
        for r in added.collect():  # at most parts * entries rows
            found[r["part"]][r["entry"]] = (r["n"], [e["s"] for e in r["s"] if e["s"] is not None])
        books = [moved(book, sums) for book, sums in zip(books, found)]

    digits = max(2, len(f"{max(entries - 1, 0):x}"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, STEP_ROWS):
                part = batch.slice(start, STEP_ROWS)
                x = integers(matrix(part.column(1), d), scale)
                text, error = [""] * len(x), np.zeros(len(x), np.int64)
                for (a, b), book in zip(spans, books):
                    code, gap = nearest(x[:, a:b], book)
                    error += gap
                    text = [t + f"{c:0{digits}x}" for t, c in zip(text, code.tolist())]
                columns = [part.column(0), part.column(2), pa.array(text, pa.string()), pa.array(error)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "code", "error"])

    kind = rows.schema[label].dataType.simpleString()
    coded = usable.select("id", "v", F.col(label).alias("label")).mapInArrow(
        encode, f"id long, label {kind}, code string, error long"
    )
    blank = rows.filter(~F.coalesce(fits, F.lit(False))).select(
        "id", F.col(label).alias("label"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")
    )
    table = space.settle(coded.union(blank) if len(first) else blank, "coded")
    total = F.expr("try_cast(sum(CAST(error AS DECIMAL(38,0))) AS BIGINT)")
    labels = space.settle(table.groupBy("label").agg(total.alias("label_error")), "labels")
    spelled = ",".join(str(c) for book in books for entry in book.tolist() for c in entry)
    return attach_state(table, labels, "label", "label", ["label_error"]).select(
        F.col("id").alias(key), "code", "error", "label_error",
        F.lit(hashlib.sha256(spelled.encode()).hexdigest()).alias("codebooks_sha256"),
    )
