"""A weighted perceptron: Adam on gradient sums of the tasks, rows never copied."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, functions as F

from riskframe.functions.hashing import hash_unit
from riskframe.session import drop_table, scratch_path

Layers = list[tuple[np.ndarray, np.ndarray]]

# Fixed values of the optimiser: decay of both moments and the term that keeps a step finite.
FIRST, SECOND, TINY = 0.9, 0.999, 1e-7
#: Gradient sums that one reducer adds up; more tasks than that get another level.
FAN_IN = 64
#: Numbers of one layer's output that a task holds at a time.
CELLS = 2_000_000
#: Numbers in one stored block of rows.
BLOCK = 200_000


@dataclass
class Perceptron:
    """ReLU layers and a sigmoid output; ``losses`` has the mean weighted loss before each step."""

    layers: Layers
    losses: list[float] = field(default_factory=list)

    def score_vector(self, df: DataFrame, features: str = "features", out: str = "score") -> DataFrame:
        """``df`` with P(y=1); a null vector scores null."""
        layers = self.layers

        @F.pandas_udf("double")
        def chance(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                result, known = np.full(len(batch), np.nan), batch.notna().to_numpy()
                rows, step = np.flatnonzero(known), slice_rows(layers)
                for start in range(0, len(rows), step):
                    here = rows[start : start + step]
                    result[here] = sigmoid(forward(layers, np.stack(batch.to_numpy()[here]))[-1][:, 0])
                yield pd.Series(result).astype("Float64").where(known, None)

        return df.withColumn(out, chance(dense(df, features)))


def dense(df: DataFrame, features: str) -> Column:
    """A vector or array column as an array of doubles."""
    if isinstance(df.schema[features].dataType, VectorUDT):
        return F.when(F.col(features).isNotNull(), vector_to_array(F.col(features)))
    return F.col(features).cast("array<double>")


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def forward(layers: Layers, x: np.ndarray) -> list[np.ndarray]:
    """The input of every layer and, last, the margin."""
    seen = [x]
    for i, (weights, bias) in enumerate(layers):
        z = seen[-1] @ weights + bias
        seen.append(np.maximum(z, 0.0) if i < len(layers) - 1 else z)
    return seen


def slice_rows(layers: Layers) -> int:
    return max(1, CELLS // max(max(w.shape) for w, _ in layers))


def gradient_sums(layers: Layers, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted sums over rows: every partial derivative, then the loss, then the weight."""
    seen = forward(layers, x)
    margin = seen[-1][:, 0]
    # log(1 + exp(m)) - y m, without overflow
    loss = np.maximum(margin, 0.0) - y * margin + np.log1p(np.exp(-np.abs(margin)))
    back = (w * (sigmoid(margin) - y))[:, None]
    parts: list[np.ndarray] = []
    for i in range(len(layers) - 1, -1, -1):
        parts[:0] = [(seen[i].T @ back).ravel(), back.sum(axis=0)]
        if i:
            back = (back @ layers[i][0].T) * (seen[i] > 0)
    return np.concatenate([*parts, [(w * loss).sum(), w.sum()]])


def start_layers(width: int, hidden: Sequence[int], seed: int = 0) -> Layers:
    """Uniform weights within the root of 6 / (inputs + outputs), no bias."""
    rng = np.random.default_rng(seed)
    sizes = [width, *hidden, 1]
    made = []
    for inputs, outputs in zip(sizes, sizes[1:]):
        edge = (6.0 / (inputs + outputs)) ** 0.5
        made.append((rng.uniform(-edge, edge, (inputs, outputs)), np.zeros(outputs)))
    return made


def _flat(layers: Layers) -> np.ndarray:
    return np.concatenate([part.ravel() for pair in layers for part in pair])


def _shaped(flat: np.ndarray, like: Layers) -> Layers:
    made, at = [], 0
    for pair in like:
        parts = []
        for part in pair:
            parts.append(flat[at : at + part.size].reshape(part.shape))
            at += part.size
        made.append(tuple(parts))
    return made


def blocks_of(rows: DataFrame) -> DataFrame:
    """(x, y, w, batch) as blocks of bounded size, each of one batch, so that a step
    moves a few byte strings to Python instead of a number at a time."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for came in batches:
            at = 0
            while at < came.num_rows:
                width = max(1, len(came.column(0)[at]))
                part = came.slice(at, max(1, BLOCK // width))
                at += part.num_rows
                x, y, w, deal = part.columns
                x = x.flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
                y, w, deal = (c.to_numpy(zero_copy_only=False) for c in (y, w, deal))
                made = []
                for number in np.unique(deal):
                    here = deal == number
                    made.append((x[here].tobytes(), y[here].tobytes(), w[here].tobytes(), int(number)))
                kinds = (pa.binary(), pa.binary(), pa.binary(), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*made), kinds)], names=["x", "y", "w", "batch"]
                )

    return rows.select("x", "y", "w", "batch").mapInArrow(pack, "x binary, y binary, w binary, batch int")


def _sums(rows: DataFrame, layers: Layers, tasks: int) -> np.ndarray:
    """``gradient_sums`` over all blocks: one vector per task, added up in a tree."""
    size = sum(part.size for pair in layers for part in pair) + 2

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, step = np.zeros(size), slice_rows(layers)
        for batch in batches:
            for block in zip(*batch.columns):
                x, y, w = (np.frombuffer(part.as_buffer(), "f8") for part in block)
                x = x.reshape(len(y), -1)
                for k in range(0, len(y), step):
                    total += gradient_sums(layers, x[k : k + step], y[k : k + step], w[k : k + step])
        yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for value in batch.column(0):
                total += np.frombuffer(value.as_buffer(), "f8")
        yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary())})

    parts = rows.mapInArrow(per_task, "sums binary")
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        parts = parts.repartition(tasks).mapInArrow(add, "sums binary")
    got = sorted(bytes(r[0]) for r in parts.collect())  # at most FAN_IN rows, in one order
    return np.sum([np.frombuffer(b, "f8") for b in got], axis=0) if got else np.zeros(size)


def fit_perceptron(
    df: DataFrame,
    features: str = "features",
    label: str = "y",
    weight: str | None = None,
    id: str | None = None,
    hidden: Sequence[int] = (64,),
    epochs: int = 100,
    batches: int = 1,
    learning_rate: float = 0.03,
    decay: float = 0.1,
    l2: float = 1e-4,
    seed: int = 0,
    start: Layers | None = None,
) -> Perceptron:
    """Minimise the weighted mean cross entropy plus ``l2`` times the squared weights of
    the hidden layers.

    An epoch takes ``batches`` steps. Rows are dealt to batches by a hash of ``id``
    (without one, of the row), written once, partitioned by batch, so an epoch reads
    the table once. A step is one job: each task returns one vector of gradient sums,
    a tree of reducers adds them, the driver takes the Adam step with rate
    ``learning_rate / (1 + decay * step / epochs)``. A row of weight k counts as k
    copies of it. ``start`` overrides the seeded first weights.

    Rows with a null label, vector or weight, or no positive weight, are left out;
    a batch without rows makes no step; other columns are ignored. A table without
    any usable row is an error, one class alone is learned as a constant.
    """
    spark = df.sparkSession
    mass = F.col(weight).cast("double") if weight else F.lit(1.0)
    deal = F.col(id) if id else F.xxhash64(dense(df, features), F.col(label))
    rows = df.select(
        dense(df, features).alias("x"),
        F.col(label).cast("double").alias("y"),
        mass.alias("w"),
        F.floor(hash_unit(deal, seed) * batches).cast("int").alias("batch"),
        F.floor(hash_unit(deal, seed + 1) * spark.sparkContext.defaultParallelism).alias("slot"),
    ).filter("x IS NOT NULL AND y IS NOT NULL AND w > 0")
    path = scratch_path(spark, "perceptron")
    if batches > 1:
        # by batch and slot, so that no task holds a whole batch
        blocks_of(rows.repartition("batch", "slot")).write.partitionBy("batch").parquet(path)
    else:
        blocks_of(rows).write.parquet(path)
    try:
        table = spark.read.schema("x binary, y binary, w binary, batch int").parquet(path)
        first = table.select((F.length("x") / F.length("y")).cast("int")).first()
        if first is None:
            raise ValueError("no row has a label, a vector and a positive weight")
        layers = start_layers(first[0], hidden, seed) if start is None else start
        model = Perceptron(_shaped(_flat(layers).astype(float), layers))
        shrink = np.concatenate(
            [np.full(part.size, 2.0 * l2 if k == 0 and i < len(layers) - 1 else 0.0)
             for i, pair in enumerate(layers) for k, part in enumerate(pair)]
        )
        parts = [table.filter(F.col("batch") == b).select("x", "y", "w") for b in range(batches)]
        tasks = [part.rdd.getNumPartitions() for part in parts]
        m, s, taken = np.zeros(len(shrink)), np.zeros(len(shrink)), 0
        for _ in range(epochs):
            for part, number in zip(parts, tasks):
                sums = _sums(part, model.layers, number)
                if sums[-1] <= 0:
                    continue
                now = _flat(model.layers)
                slope = sums[:-2] / sums[-1] + shrink * now
                rate = learning_rate / (1.0 + decay * taken / epochs)
                taken += 1
                m = FIRST * m + (1 - FIRST) * slope
                s = SECOND * s + (1 - SECOND) * slope * slope
                scale = rate * (1 - SECOND**taken) ** 0.5 / (1 - FIRST**taken)
                model.layers = _shaped(now - scale * m / (np.sqrt(s) + TINY), layers)
                model.losses.append(float(sums[-2] / sums[-1]))
    finally:
        drop_table(spark, path)
    return model
