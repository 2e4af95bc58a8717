"""The weighted perceptron against plain numpy and against copied rows."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from riskframe.functions.scorecard import score_vector
from riskframe.operators import perceptron


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    made = [(i, *map(float, rng.standard_normal(3)), float(1 + i % 3)) for i in range(300)]
    df = spark.createDataFrame(made, "id int, a double, b double, c double, w double")
    return df.select(
        "id", F.array("a", "b", "c").alias("features"), (F.col("a") * F.col("b") > 0).cast("int").alias("y"), "w"
    ).cache()


def plain_fit(x, y, w, layers, epochs, rate, decay, l2):
    """Steps by numerical derivatives' exact form, on the whole table at once."""
    params = [p.copy() for pair in layers for p in pair]
    m, s = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for k in range(epochs):
        w1, b1, w2, b2 = params
        z = x @ w1 + b1
        h = np.where(z > 0, z, 0)
        p = 1 / (1 + np.exp(-(h @ w2 + b2)[:, 0]))
        d = (w * (p - y) / w.sum())[:, None]
        back = d @ w2.T * (z > 0)
        grads = [x.T @ back + 2 * l2 * w1, back.sum(0), h.T @ d, d.sum(0)]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            s[i] = 0.999 * s[i] + 0.001 * g * g
            step = rate / (1 + decay * k / epochs) * np.sqrt(1 - 0.999 ** (k + 1)) / (1 - 0.9 ** (k + 1))
            params[i] = params[i] - step * m[i] / (np.sqrt(s[i]) + 1e-7)
    return params


def weights_of(model):
    return np.concatenate([p.ravel() for pair in model.layers for p in pair])


def test_steps_equal_plain_numpy(rows):
    start = perceptron.start_layers(3, [4], seed=2)
    model = perceptron.fit_perceptron(rows, weight="w", epochs=25, learning_rate=0.05, l2=1e-2, start=start)
    table = rows.collect()
    x, y, w = (np.array([r[c] for r in table], float) for c in ("features", "y", "w"))
    want = np.concatenate([p.ravel() for p in plain_fit(x, y, w, start, 25, 0.05, 0.1, 1e-2)])
    assert np.allclose(weights_of(model), want, atol=1e-9)
    assert len(model.losses) == 25 and model.losses[-1] < model.losses[0]


@pytest.mark.parametrize("batches", [1, 3])
def test_weight_counts_as_copies(rows, batches):
    copied = rows.withColumn("w", F.explode(F.sequence(F.lit(1), F.col("w").cast("int"))))
    options = {"id": "id", "hidden": [5, 3], "epochs": 15, "batches": batches, "seed": 4}
    heavy = perceptron.fit_perceptron(rows, weight="w", **options)
    many = perceptron.fit_perceptron(copied, **options)
    assert np.abs(weights_of(heavy) - weights_of(many)).max() < 1e-6
    assert len(heavy.losses) == 15 * batches
    again = perceptron.fit_perceptron(rows.repartition(7), weight="w", **options)
    assert np.allclose(weights_of(again), weights_of(heavy), atol=1e-9)


def test_sums_through_a_tree_of_reducers(rows, monkeypatch):
    layers = perceptron.start_layers(3, [4])
    named = rows.select(F.col("features").alias("x"), F.col("y").cast("double"), "w", F.lit(0).alias("batch"))
    ready = perceptron.blocks_of(named.repartition(9)).select("x", "y", "w")
    want = perceptron._sums(ready, layers, 9)
    assert want[-1] == rows.agg(F.sum("w")).first()[0]
    monkeypatch.setattr(perceptron, "FAN_IN", 2)
    assert np.allclose(perceptron._sums(ready, layers, 9), want)


def test_rows_without_values(spark):
    kept = [(1, Vectors.dense([1.0, 0.0]), 1, 1.0), (2, Vectors.dense([0.0, 1.0]), 0, 2.0)]
    odd = [(3, None, 1, 1.0), (4, Vectors.sparse(2, {0: 3.0}), None, 1.0), (5, Vectors.dense([5.0, 5.0]), 1, None),
           (6, Vectors.dense([5.0, 5.0]), 1, 0.0), (7, Vectors.dense([5.0, 5.0]), 1, -1.0)]
    schema = spark.createDataFrame(kept).schema
    names = ["id", "features", "y", "w"]
    clean, all_rows = (spark.createDataFrame(r, schema).toDF(*names) for r in (kept, kept + odd))
    fits = [perceptron.fit_perceptron(df, weight="w", hidden=[3], epochs=5) for df in (clean, all_rows)]
    assert np.allclose(weights_of(fits[0]), weights_of(fits[1]))
    got = {r["id"]: r["score"] for r in score_vector(fits[1], all_rows, "features").collect()}
    assert got[3] is None and all(0 < got[i] < 1 for i in (1, 2, 4, 5, 6, 7))
    with pytest.raises(ValueError, match="no row"):
        perceptron.fit_perceptron(all_rows.filter("id > 2"), weight="w")
    one = perceptron.fit_perceptron(clean.filter("id = 1"), hidden=[2], epochs=60)
    assert score_vector(one, clean, "features").filter("id = 1").first()["score"] > 0.6
