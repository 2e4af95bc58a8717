"""Helpers shared by the operators: intermediate tables and components."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from riskframe.session import scratch_path, small_batches


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Edges that one task contracts on its own.
LOCAL_EDGES = 200_000
#: Texts handed to a kernel at once, which bounds what one call returns.
TEXTS_PER_CALL = 256


def map_texts(
    df: DataFrame, key: str, text: str, schema: str, make: Callable[[], Callable], carry: Sequence[str] = ()
) -> DataFrame:
    """Run a kernel over whole texts, batch by batch, without a shuffle.

    ``make()`` is called once per task and returns ``kernel(texts) -> (rows,
    columns)``: for each output row the number of its text in the call (None: one
    row per text, in order), and one list per column. Result: the key column as it
    came (nulls and all 64 bits), the columns ``carry``, then those of ``schema``.
    """
    kept = [df.schema[c] for c in carry]
    extra = StructType.fromDDL(schema)
    full = StructType([*StructType.fromDDL(f"{key} long"), *kept, *extra])
    kinds = to_arrow_schema(extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS_PER_CALL):
                part = batch.slice(start, TEXTS_PER_CALL)
                rows, columns = kernel(part.column(1).to_pylist())
                came = [part.column(0), *part.columns[2:]]
                if rows is not None:
                    taken = pa.array(rows, pa.int64())
                    came = [c.take(taken) for c in came]
                yield pa.RecordBatch.from_arrays(
                    [*came, *[pa.array(c, type=k.type) for c, k in zip(columns, kinds)]], names=full.names
                )

    return df.select(
        F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("__text"), *carry
    ).mapInArrow(run, full)


def text_function(kind: str, make: Callable[[], Callable]) -> Callable[[Column], Column]:
    """A column function over whole texts: ``make()`` gives ``kernel(texts) -> values`` once per task.

    The texts of a batch become Python objects a few at a time, and their values go
    out as they come: no second copy of the batch is gathered.
    """
    values = to_arrow_schema(StructType.fromDDL(f"v {kind}"))[0].type

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kernel = make()
        for batch in batches:
            for start in range(0, len(batch), TEXTS_PER_CALL):
                yield pa.array(kernel(batch.slice(start, TEXTS_PER_CALL).to_pylist()), type=values)

    return run


class Workspace:
    """Tables written in passing under the folder all executors share.

    A table written and read again cuts the lineage, so a lost executor costs a
    re-read, not a re-run; and a join that reads it has exchanges on both sides,
    which lets adaptive execution split hot keys. ``release`` deletes every
    table but those named, once their content has moved on. While it is written,
    Python workers get a few megabytes of rows at once.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self.paths = spark, label, {}

    def settle(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, f"{self.label}-{name}")
        with small_batches(self.spark):
            df.write.parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self, *keep: str) -> None:
        for name in [n for n in self.paths if n not in keep]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b): one row (node, root) per
    node that has an edge, root being the smallest node reachable.

    Tasks of at most about ``LOCAL_EDGES`` edges first reduce their own edges to
    stars; one such task is all a small graph needs. Then alternating star
    contraction: neighbourhoods are never gathered, each half round takes a minimum
    per node (combined on the map side), writes it, and joins it back, so a hub's
    edges can be split over tasks. Null ends and loops are ignored; no edges give
    no rows.
    """
    spark = edges.sparkSession
    space = Workspace(spark, "components")
    pairs = edges.filter("a <> b").select(
        F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")
    ).distinct()
    whole = space.settle(pairs, "whole")
    parts = max(1, -(-whole.count() // LOCAL_EDGES))

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if ends:
            u, v = (np.concatenate(x) for x in zip(*ends))
            nodes, where = np.unique(np.concatenate([u, v]), return_inverse=True)
            root = smallest_reachable(len(nodes), where[: len(u)], where[len(u) :])
            moved = np.flatnonzero(root != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], names=["u", "v"])

    current = space.settle(whole.coalesce(parts).mapInArrow(contract, "u long, v long"), "edges0")
    if parts == 1:
        space.release("edges0")
        return _rooted(current)
    signature = _fingerprint(current)
    for step in range(1, max_rounds + 1):
        both = current.select("u", "v").union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = space.settle(
            both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low")),
            f"large{step}",
        )
        # every larger neighbour of u moves to u's lowest
        large = space.settle(
            both.join(lowest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct(),
            f"wide{step}",
        )
        lowest = space.settle(large.groupBy("u").agg(F.min("v").alias("low")), f"small{step}")
        joined = large.join(lowest, "u")
        small = joined.filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).union(
            lowest.select("u", F.col("low").alias("v"))
        )
        current = space.settle(small.distinct(), f"edges{step}")
        space.release(f"edges{step}")
        found = _fingerprint(current)
        if found == signature:
            break
        signature = found
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return _rooted(current)


def _rooted(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def smallest_reachable(size: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest position reachable by the links, for each position."""
    root = np.arange(size)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.select(
        F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
    ).first()
    return row["n"], row["h"]
