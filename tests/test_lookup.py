import pytest
from pyspark.sql import functions as F

from riskframe.functions.lookup import attach_state, fits_broadcast


@pytest.mark.parametrize("small", [True, False])
def test_hot_cold_and_null_keys_all_find_their_state(spark, small):
    # one key holds a third of the rows, one is null, one is unknown
    rows = [(i, "hot" if i % 3 == 0 else None if i % 7 == 0 else f"k{i % 50}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, key string")
    state = spark.createDataFrame(
        [("hot", 1.0, None), *[(f"k{i}", float(i), f"t{i}") for i in range(49)]],
        "key string, value double, text string",
    )
    got = attach_state(df, state, "key", "key", ["value", "text"], small=small, hot_parts=20)
    assert got.columns == ["id", "key", "value", "text"]
    want = df.join(state, "key", "left").select("id", "key", "value", "text")
    assert sorted(got.collect(), key=lambda r: r["id"]) == sorted(
        want.collect(), key=lambda r: r["id"]
    )


def test_the_large_path_does_not_broadcast_the_state(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10).cast("string").alias("key"))
    state = df.groupBy("key").agg(F.sum("id").alias("value"))
    plan = attach_state(df, state, "key", "key", ["value"], small=False)
    text = plan._jdf.queryExecution().simpleString()
    assert "s:" in text and "k:" in text


def test_size_is_measured(spark):
    state = spark.range(100).select(F.col("id").cast("string").alias("key"))
    assert fits_broadcast(state, "key")
    assert not fits_broadcast(state, "key", max_rows=99)
    wide = state.select(F.repeat(F.col("key"), 1 << 20).alias("key"))
    assert not fits_broadcast(wide, "key")


def test_large_values_are_measured_too(spark):
    state = spark.range(3000).select(
        F.col("id").alias("key"), F.array(F.repeat(F.lit("v"), 15_000), F.repeat(F.lit("w"), 15_000)).alias("value")
    )
    assert not fits_broadcast(state, "key")
    assert fits_broadcast(state.limit(100), "key")
