import math

import pytest
from pyspark.sql import functions as F

from riskframe.functions.spec import FeatureSpec
from riskframe.operators import features, learn
from riskframe.operators.features import FeatureEncoder, FeatureEncoderModel
from riskframe.session import scratch_path

SCHEMA = "id int, y int, a double, b double, two string, three string, code int"
ROWS = [
    (1, 0, 1.0, 5.0, "x", "r", 1),
    (2, 1, 2.0, 5.0, "y", "s", 2),
    (3, 1, None, 5.0, "x", "t", 2),
    (4, 0, 3.0, 5.0, None, "t", None),
    (5, 1, float("nan"), 5.0, "x", None, 1),
]
SPEC = FeatureSpec("id", "y", numeric=("a", "b"), categorical=("two", "three", "code"))


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def rows(frame):
    return {r["id"]: r.asDict() for r in frame.collect()}


def test_scaling_uses_the_population_deviation_after_filling(df):
    stats = features.numeric_stats(df, ["a", "b"])
    assert stats["a"] == pytest.approx((2.0, math.sqrt(2 / 5)))
    assert stats["b"] == (5.0, 1.0)  # no spread: scale 1
    got = rows(FeatureEncoder(SPEC).fit(df).encode(df))
    assert got[1]["a"] == pytest.approx(-1 / math.sqrt(0.4))
    assert got[3]["a"] == got[5]["a"] == 0.0 and got[4]["b"] == 0.0


def test_routing_counts_categories_without_null(df):
    state = FeatureEncoder(SPEC).fit(df).state
    # exactly ``crit`` categories are target-encoded
    assert state.target == ["three"] and state.onehot == ["two", "code"]
    assert FeatureEncoder(SPEC, crit=2).fit(df).state.onehot == []
    assert FeatureEncoder(SPEC, crit=4).fit(df).state.target == []
    assert FeatureEncoder(SPEC, target_encode=False).fit(df).state.target == []


def test_numeric_categories_are_ordered_as_numbers(spark):
    codes = [-2, -1, 0, 2, 10, 10, 2, None]
    table = spark.createDataFrame(
        [(i, i % 2, v, None if v is None else float(v)) for i, v in enumerate(codes)],
        "id int, y int, code int, part double",
    )
    spec = FeatureSpec("id", "y", categorical=("code", "part"))
    state = FeatureEncoder(spec, target_encode=False).fit(table).state
    assert state.levels["code"] == ["-2", "-1", "0", "2", "10"]
    assert state.levels["part"] == ["-2.0", "-1.0", "0.0", "2.0", "10.0"]
    assert state.modes == {"code": "2", "part": "2.0"}
    assert features.sorted_levels(["NaN", "1.0E10", "Infinity", "-3.5"], True) == [
        "-3.5", "1.0E10", "Infinity", "NaN"
    ]


def test_mode_ties_go_to_the_smallest_value(df):
    modes = FeatureEncoder(SPEC).fit(df).state.modes
    assert modes == {"two": "x", "three": "t", "code": "1"}


def test_names_and_their_order(df):
    assert FeatureEncoder(SPEC).fit(df).output_names == [
        "two_0", "two_1", "code_0", "code_1", "a", "b", "three",
    ]
    assert FeatureEncoder(SPEC, onehot=False).fit(df).output_names == [
        "a", "b", "two", "code", "three",
    ]
    assert FeatureEncoder(SPEC, onehot_drop=True).fit(df).output_names == [
        "two_1", "code_1", "a", "b", "three",
    ]
    wide = FeatureEncoder(SPEC, onehot_drop=True, target_encode=False).fit(df)
    assert wide.output_names[:4] == ["two_1", "three_0", "three_1", "three_2"]


def test_target_rates_shrink_to_the_overall_mean(spark, df):
    model = FeatureEncoder(SPEC, k=1).fit(df)
    got = rows(model.encode(df))
    assert got[1]["three"] == pytest.approx((0 + 0.6) / 2)
    # the null of row 5 was filled with the mode
    assert got[5]["three"] == pytest.approx((2 + 0.6) / 4)
    fresh = spark.createDataFrame([(9, 0, 1.0, 5.0, "z", "new", 7)], SCHEMA)
    unseen = rows(model.encode(fresh))[9]
    assert unseen["three"] == pytest.approx(0.6)
    assert [unseen[c] for c in ("two_0", "two_1", "code_0", "code_1")] == [0.0] * 4
    with pytest.raises(ValueError, match="positive"):
        FeatureEncoder(SPEC, k=0)


def test_ordinal_codes(spark, df):
    model = FeatureEncoder(SPEC, onehot=False).fit(df)
    fresh = spark.createDataFrame([(9, 0, 1.0, 5.0, "z", "r", 2)], SCHEMA)
    got = rows(model.encode(fresh))[9]
    assert got["two"] == -1 and got["code"] == 1
    assert rows(model.encode(df))[4]["two"] == 0  # filled with the mode
    code = features.ordinal_code(F.col("two"), ["x", "y"])
    assert [r[0] for r in df.orderBy("id").select(code).collect()] == [0, 1, 0, -1, 0]


def test_unlabeled_rows_stay_out_of_the_rates(df):
    marked = df.withColumn("y", F.when(F.col("id") == 2, -1).otherwise(F.col("y")))
    model = FeatureEncoder(SPEC).fit(marked)
    assert model.state.overall == 0.5
    assert rows(model.encode(df))[2]["three"] == pytest.approx(0.5)  # its category lost its row
    everyone = FeatureEncoder(SPEC, labeled_only=False).fit(marked)
    assert everyone.state.overall == pytest.approx(0.2)
    assert rows(everyone.encode(df))[2]["three"] == pytest.approx((-1 + 0.2) / 2)


def test_inverse_scaling(df):
    model = FeatureEncoder(SPEC).fit(df)
    back = rows(model.unscale(model.encode(df)))
    assert back[1]["a"] == pytest.approx(1.0) and back[3]["a"] == pytest.approx(2.0)
    plain = FeatureEncoder(SPEC, normalize=False).fit(df)
    assert rows(plain.encode(df))[4]["a"] == 3.0
    assert rows(plain.unscale(plain.encode(df)))[4]["a"] == 3.0


def test_finish_completes_the_plain_space(df):
    model = FeatureEncoder(SPEC).fit(df)
    want = rows(model.encode(df))
    for scaled in (True, False):
        plain = model.encode(df, scale=None if scaled else False, onehot=False)
        assert plain.columns == ["id", "a", "b", "two", "code", "three"]
        got = rows(model.finish(plain, scaled))
        assert {k: pytest.approx(v) for k, v in got.items()} == want


def test_saved_state_encodes_alike(spark, df):
    model = FeatureEncoder(SPEC).fit(df)
    path = scratch_path(spark, "encoder")
    model.save(path)
    again = FeatureEncoderModel.load(spark, path)
    assert rows(again.encode(df)) == rows(model.encode(df))
    assert again.output_names == model.output_names


def test_works_inside_an_ml_pipeline(df):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    names = FeatureEncoder(SPEC).fit(df).output_names
    flow = Pipeline(
        stages=[
            FeatureEncoder(SPEC),
            VectorAssembler(inputCols=names, outputCol="features"),
            LogisticRegression(labelCol="y"),
        ]
    )
    assert flow.fit(df).transform(df).count() == 5


def test_kept_columns_may_not_collide(df):
    with pytest.raises(ValueError, match="collide"):
        FeatureEncoder(SPEC).fit(df).encode(df, ["id", "a"])


def test_no_categories_and_only_nulls(spark):
    df = spark.createDataFrame([(1, 0, None, None), (2, 1, None, None)], "id int, y int, a double, c string")
    numeric = FeatureEncoder(FeatureSpec("id", "y", numeric=("a",))).fit(df)
    assert [r["a"] for r in numeric.encode(df).collect()] == [0.0, 0.0]
    empty = FeatureEncoder(FeatureSpec("id", "y", categorical=("c",))).fit(df)
    assert empty.encode(df).count() == 2


@pytest.mark.parametrize("partitions", [1, 4, 37])
def test_fit_does_not_depend_on_partitioning(apps, partitions):
    spec = FeatureSpec("app_id", "y", None, ("amount", "balance"), ("segment", "nation"))
    base = FeatureEncoder(spec).fit(apps)
    other = FeatureEncoder(spec).fit(apps.repartition(partitions))
    assert other.state.means == pytest.approx(base.state.means)
    assert other.state.modes == base.state.modes
    assert sorted(other.rates.collect()) == sorted(base.rates.collect())


def test_large_rates_take_the_shuffled_way(apps, monkeypatch):
    spec = FeatureSpec("app_id", "y", categorical=("segment", "nation"))
    small = FeatureEncoder(spec).fit(apps)
    want = sorted(small.encode(apps).collect())
    large = FeatureEncoder(spec).fit(apps)
    monkeypatch.setattr(large, "_small", False)
    assert sorted(large.encode(apps).collect()) == want


@pytest.mark.parametrize("small", [True, False])
def test_many_levels_become_a_sparse_vector(spark, small):
    """Codes follow the levels' order, numbers as numbers; unknown levels have no entry."""
    codes = [100, -2, -1, 0, 2, 10, 10, 2, 10, None]
    table = spark.createDataFrame(
        [(i, i % 2, v, f"t{v}", "u" if i % 3 else "v") for i, v in enumerate(codes)],
        "id int, y int, code int, text string, two string",
    ).repartition(3)
    spec = FeatureSpec("id", "y", categorical=("code", "two", "text"))
    narrow = FeatureEncoder(spec, target_encode=False).fit(table)
    wide = FeatureEncoder(spec, target_encode=False, max_levels=3).fit(table)
    assert wide.state.wide == {"code": 6, "text": 7}
    assert wide.output_names == ["code", "two_0", "two_1", "text"]
    wide._small = small
    fresh = spark.createDataFrame(
        [(20, 0, 7, "other", "u"), (21, 0, None, None, None)], table.schema
    )
    for df in (table, fresh):
        want, got = rows(narrow.encode(df)), rows(wide.encode(df))
        for id_, row in want.items():
            assert got[id_]["code"].toArray().tolist() == [row[f"code_{i}"] for i in range(6)]
            assert got[id_]["text"].toArray().tolist() == [row[f"text_{i}"] for i in range(7)]
            assert got[id_]["two_0"] == row["two_0"]
        # the plain space holds codes, and finishing it gives the vectors
        plain = wide.encode(df, onehot=False)
        assert rows(plain) == rows(narrow.encode(df, onehot=False))
        assert rows(wide.finish(plain)) == got
    vector = wide.assemble(table).first()["features"]
    assert vector.size == 15
    path = scratch_path(spark, "wide-encoder")
    wide.save(path)
    assert rows(FeatureEncoderModel.load(spark, path).encode(table)) == rows(wide.encode(table))
    flow = learn.FittedFlow(wide, None)
    with pytest.raises(ValueError, match="sparse"):
        learn.scorecard_of(flow)


def test_encoding_counts_nothing(spark, apps, monkeypatch):
    """The frequent categories come from the fit, whatever the size of the rates."""
    spec = FeatureSpec("app_id", "y", categorical=("segment", "nation"))
    encoder = FeatureEncoder(spec).fit(apps)
    monkeypatch.setattr(encoder, "_small", False)
    encoder._measured()
    monkeypatch.setattr(type(apps), "count", lambda self: pytest.fail("rows were counted"))
    plan = encoder.encode(apps)._jdf.queryExecution().toString()
    assert "count(1)" not in plan.split("== Physical Plan ==")[-1]
