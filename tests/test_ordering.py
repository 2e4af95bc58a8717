import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.functions import ordering
from riskframe.functions.ordering import exact_quantiles, range_bounds, running_totals


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one key."""
    rng = np.random.default_rng(3)
    values = np.round(rng.normal(size=4000), 2).tolist() + [0.5] * 2000
    rows = [(i, v, "ab"[i % 2]) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "id int, v double, g string")


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("group", [[], ["g"]])
def test_buckets_give_the_same_running_totals(skewed, group, descending):
    counts = skewed.groupBy(*group, "v").agg(F.count("*").alias("n"))
    bounds, n = range_bounds(skewed, "v", keys_per_bucket=150)
    assert n == 6000 and len(bounds) > 10
    got = running_totals(counts, "v", {"n": "upto"}, group, descending, bounds).toPandas()
    plain = running_totals(counts, "v", {"n": "upto"}, group, descending, []).toPandas()
    order = [*group, "v"]
    got = got.sort_values(order).reset_index(drop=True)
    plain = plain.sort_values(order).reset_index(drop=True)
    assert got.equals(plain[got.columns])
    for _, part in got.groupby(group or (lambda i: 0)):
        totals = part["n"].iloc[::-1].cumsum().iloc[::-1] if descending else part["n"].cumsum()
        assert (part["upto"] == totals).all()


@pytest.mark.parametrize("partitions", [1, 4, 37])
@pytest.mark.parametrize("per_bucket", [None, 100])
def test_exact_quantiles(skewed, partitions, per_bucket):
    probabilities = [0.0, 0.013, 0.25, 0.5, 0.9, 1.0]
    df = skewed.repartition(partitions)
    got = exact_quantiles(df, "v", probabilities, keys_per_bucket=per_bucket)[None]
    values = np.array([r["v"] for r in skewed.collect()])
    assert got == pytest.approx(np.quantile(values, probabilities).tolist(), abs=1e-12)
    by_group = exact_quantiles(df, "v", probabilities, group="g", keys_per_bucket=per_bucket)
    for g in "ab":
        inside = np.array([r["v"] for r in skewed.filter(F.col("g") == g).collect()])
        assert by_group[g] == pytest.approx(np.quantile(inside, probabilities).tolist(), abs=1e-12)


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([], "v double")
    assert exact_quantiles(empty, "v", [0.5]) == {None: [None]}
    nulls = spark.createDataFrame([(None,), (float("nan"),), (2.0,)], "v double")
    assert exact_quantiles(nulls, "v", [0.5]) == {None: [2.0]}


@pytest.mark.parametrize("per_bucket", [None, 90])
def test_features_of_different_scale_share_the_passes(spark, monkeypatch, per_bucket):
    from riskframe.functions import ordering

    if per_bucket:
        monkeypatch.setattr(ordering, "KEYS_PER_BUCKET", per_bucket)
    rng = np.random.default_rng(8)
    wide, narrow = rng.normal(size=700) * 1e6, rng.random(700).round(2)
    rows = [(float(a), float(b), None) for a, b in zip(wide, narrow)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = ordering.feature_quantiles(df, ["a", "b", "c"], [0.1, 0.5])
    assert got["a"] == pytest.approx(np.quantile(wide, [0.1, 0.5]).tolist())
    assert got["b"] == pytest.approx(np.quantile(narrow, [0.1, 0.5]).tolist())
    assert got["c"] == [None, None]


def test_ranks_meet_counted_keys_only(spark, skewed):
    """No row carries the list of wanted ranks: keys are counted by hashing, without a sort of the rows."""
    staged = skewed.select(F.col("g").alias("__g"), F.col("v").alias("__v"), F.lit(0).alias("__bucket"))
    places = spark.createDataFrame(
        [("a", 0, [(0, 0), (2999, 2999)])], "t_g string, t_bucket int, t_ranks array<struct<t_inner:bigint,t_rank:bigint>>"
    )
    picked = ordering._keys_at(staged, places)
    assert "SortAggregate" not in picked._jdf.queryExecution().executedPlan().toString()
    values = sorted(r["v"] for r in skewed.filter("g = 'a'").collect())
    assert sorted(tuple(r) for r in picked.collect()) == [("a", values[0], 0), ("a", values[-1], 2999)]
