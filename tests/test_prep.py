import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from riskframe.functions.spec import FeatureSpec
from riskframe.operators import prep
from riskframe.session import scratch_path
from riskframe.sources import datasets
from riskframe.sources.tables import read_csv, write_prepared


def test_cast_raises_or_counts(spark):
    df = spark.createDataFrame([("1", "1.5"), ("2", "x"), ("3", None)], "id string, v string")
    with pytest.raises(PySparkException, match="not a double"):
        prep.cast_all(df).collect()
    assert prep.count_bad_casts(df).first().asDict() == {"id": 0, "v": 1}
    good = prep.cast_all(df.filter("id <> '2'"), keep=["id"]).collect()
    assert [r["v"] for r in good] == [1.5, None]


def test_recode_small_large_and_table(spark):
    df = spark.createDataFrame([(1, 5), (2, 9), (3, None), (4, 250)], "id int, code int")
    small = prep.recode(df, "code", {5: "five", 250: "many"}, "label").orderBy("id")
    assert [r["label"] for r in small.collect()] == ["five", None, None, "many"]
    large = {i: f"n{i}" for i in range(300) if i != 9}
    got = prep.recode(df, "code", large, "label").orderBy("id")
    assert [r["label"] for r in got.collect()] == ["n5", None, None, "n250"]


def test_binary_recode_treats_null_as_no_match(spark):
    df = spark.createDataFrame([(2,), (1,), (None,)], "v int")
    assert [r["v"] for r in prep.recode_binary(df, "v", 2).collect()] == [1, 0, 0]


@pytest.mark.parametrize("partitions", [1, 4, 37])
def test_splits_folds_and_samples_do_not_depend_on_partitioning(spark, apps, partitions):
    base = apps.select("app_id", "y", "z")
    moved = base.repartition(partitions)
    for make in (
        lambda d: prep.holdout_split(d, "app_id", seed=1),
        lambda d: prep.stratified_folds(d, "app_id", "y", 4, seed=2),
        lambda d: prep.quota_sample(d, "app_id", "z", {0: 100, 1: 37}, seed=3),
        lambda d: prep.hash_sample(d, "app_id", 25, seed=4),
    ):
        assert sorted(make(base).collect()) == sorted(make(moved).collect())


def test_folds_keep_the_label_mix(spark, apps):
    folds = prep.stratified_folds(apps.select("app_id", "y"), "app_id", "y", 5)
    sizes = [r["count"] for r in folds.groupBy("y", "fold").count().collect()]
    assert len(sizes) == 10
    by_label = {}
    for r in folds.groupBy("y", "fold").count().collect():
        by_label.setdefault(r["y"], []).append(r["count"])
    assert all(max(v) - min(v) <= 1 for v in by_label.values())


def test_folds_and_quotas_do_not_depend_on_the_slots(spark, apps, monkeypatch):
    df = apps.select("app_id", "y", "z")
    folds = sorted(prep.stratified_folds(df, "app_id", "y", 5, seed=9).collect())
    picks = sorted(prep.quota_sample(df, "app_id", "z", {0: 40, 1: 60}).collect())
    for slots in (1, 3):
        monkeypatch.setattr(prep, "SLOTS", slots)
        assert sorted(prep.stratified_folds(df, "app_id", "y", 5, seed=9).collect()) == folds
        assert sorted(prep.quota_sample(df, "app_id", "z", {0: 40, 1: 60}).collect()) == picks


def test_quota_edges(spark, apps):
    df = apps.select("app_id", "z")
    sizes = {r["z"]: r["count"] for r in df.groupBy("z").count().collect()}
    quotas = {0: sizes[0] + 10, 1: 0}
    picked = prep.quota_sample(df, "app_id", "z", quotas).filter("picked")
    assert {r["z"]: r["count"] for r in picked.groupBy("z").count().collect()} == {0: sizes[0]}
    cut = prep.quota_sample(df, "app_id", "z", {0: 40, 1: 60})
    got = {r["z"]: r["count"] for r in cut.filter("picked").groupBy("z").count().collect()}
    assert got == {0: 40, 1: 60}
    # groups without a quota are left out
    some = prep.quota_sample(df, "app_id", "z", {1: 5}).filter("picked")
    assert some.count() == 5 and some.filter("z = 0").count() == 0


def test_roles():
    from pyspark.sql.types import StructType

    class Table:
        schema = StructType.fromDDL("id bigint, b string, a int, c double, f boolean, y int, z int")
        columns = schema.names

    spec = FeatureSpec.infer(Table, "id", "y", "z")
    assert spec.numeric == ("a", "c", "f") and spec.categorical == ("b",)
    coded = FeatureSpec.infer(Table, "id", "y", categorical=["b", "a"])
    assert coded.numeric == ("c", "f", "z") and coded.categorical == ("b", "a")
    assert coded.without("a").features == ["c", "f", "z", "b"]
    with pytest.raises(ValueError, match="listed as categorical"):
        FeatureSpec.infer(Table, "id", "y", categorical=["a"])
    with pytest.raises(ValueError, match="no such columns"):
        FeatureSpec.infer(Table, "id", "y", categorical=["b", "nope"])


def test_german_table(spark):
    row = ("A11", 6.0, "A34", "A410", 1169.0, "A65", "A75", 4.0, "A92", "A101", 4.0, "A121",
           67.0, "A143", "A152", 2.0, "A173", 1.0, "A192", "A201", 2)
    odd = ("A99", *row[1:8], "A91", *row[9:-1], 1)
    raw = spark.createDataFrame([row, odd], datasets.GERMAN_SCHEMA)
    first, second = datasets.prepare_german(raw).collect()
    assert first["DEFAULT"] == 1 and second["DEFAULT"] == 0
    assert first["CheckingAccount"] == "< 0" and second["CheckingAccount"] is None
    assert first["Gender"] == "Female" and second["Gender"] == "Male"
    assert first["Purpose"] == "Others" and first["Telephone"] == 1 and first["ForeignWorker"] == 1
    assert "PersonalStatus" not in datasets.prepare_german(raw).columns


def test_taiwan_table(spark):
    titles = ["ID", "SEX", "EDUCATION", "MARRIAGE", "LIMIT_BAL", "default payment next month"]
    rows = [tuple(titles), ("1", "2", "-1", "0", "20000", "1"), ("2", "1", "2", "9", "500", "0")]
    schema = ", ".join(f"X{i} string" for i in range(len(titles)))
    raw = spark.createDataFrame(rows, schema)
    header = {f"X{i}": t for i, t in enumerate(titles)}
    got = datasets.prepare_taiwan(raw, header).collect()
    assert got[0].asDict() == {
        "SEX": "Female", "EDUCATION": "Unknown", "MARRIAGE": "Others", "LIMIT_BAL": 20000.0,
        "DEFAULT": 1.0,
    }
    assert got[1]["MARRIAGE"] is None and got[1]["EDUCATION"] == "University"
    kept = datasets.prepare_taiwan(raw, header, keep=("ID",))
    assert [r["ID"] for r in kept.collect()] == [1.0, 2.0]


def test_homecredit_table(spark):
    raw = spark.createDataFrame(
        [(7, 1, "a", "b", 3.5)],
        "SK_ID_CURR int, TARGET int, OCCUPATION_TYPE string, ORGANIZATION_TYPE string, X double",
    )
    assert datasets.prepare_homecredit(raw).columns == ["DEFAULT", "X"]


@pytest.mark.parametrize("format", ["parquet", "csv"])
def test_registry(spark, format):
    df = spark.createDataFrame([(1, 0.5, "a", 1, 0)], "id int, v double, c string, DEFAULT int, s int")
    registry = datasets.Registry()
    path = scratch_path(spark, "test")
    registry.store("mini", df, path, id="id", sensitive="s", format=format)
    back, spec = registry.load(spark, "mini")
    assert back.collect() == df.collect()
    assert spec.numeric == ("v",) and spec.categorical == ("c",) and spec.sensitive == "s"
    with pytest.raises(ValueError, match="unknown dataset 'maxi'"):
        registry.load(spark, "maxi")


def test_csv_encoding_and_strictness(spark):
    df = spark.createDataFrame([(1, "é"), (2, "ß")], "id int, t string")
    path = write_prepared(df, scratch_path(spark, "enc"), "csv", encoding="ISO-8859-1")
    back = read_csv(spark, path, "id int, t string", encoding="ISO-8859-1")
    assert sorted(back.collect()) == sorted(df.collect())
    with pytest.raises(Exception, match="MALFORMED"):
        read_csv(spark, path, "id int, t int", encoding="ISO-8859-1").collect()
    with pytest.raises(ValueError, match="unknown format"):
        write_prepared(df, path, "xlsx")


def test_append_unlabeled(spark):
    accepted = spark.createDataFrame([(1, 0)], "id int, y int")
    rejected = spark.createDataFrame([(2, 1)], "id int, y int")
    both = prep.append_unlabeled(accepted, rejected)
    assert sorted(both.collect()) == [(1, 0), (2, -1)]
    assert both.schema["y"].dataType == accepted.schema["y"].dataType


def test_hash_is_uniform(spark):
    from riskframe.functions.hashing import MODULUS, arithmetic_rank, hash_unit

    df = spark.range(20000).select(
        (arithmetic_rank("id", 5) / F.lit(float(MODULUS))).alias("a"), hash_unit("id", 5).alias("b")
    )
    for c in "ab":
        low, mean, high = df.agg(F.min(c), F.avg(c), F.max(c)).first()
        assert 0 <= low < 0.01 and 0.99 < high < 1 and abs(mean - 0.5) < 0.02


def test_split_shares_hold_for_any_kind_of_id(spark):
    ids = spark.range(20_000)
    kinds = {
        "negative": -F.col("id") - 1,
        "huge": F.lit((1 << 63) - 1) - F.col("id"),
        "hashed": F.xxhash64("id"),
        "text": F.concat(F.lit("a"), F.col("id").cast("string")),
    }
    for column in kinds.values():
        parts = prep.holdout_split(ids.select(column.alias("k")), "k", test=0.2, valid=0.25, seed=4)
        shares = {r["part"]: r["count"] / 20_000 for r in parts.groupBy("part").count().collect()}
        assert abs(shares["test"] - 0.2) < 0.02 and abs(shares["valid"] - 0.2) < 0.02
    signed = ids.select((F.col("id") - 10_000).alias("k"))
    drawn = prep.hash_sample(signed, "k", 400).filter("k < 0").count()
    assert 140 < drawn < 260


def test_null_codes_have_one_rule(spark):
    from riskframe.functions import lookup

    df = spark.createDataFrame([(1, "a"), (2, None), (3, "z")], "id int, c string")
    mapping = {"a": "A", None: "none"}
    table = spark.createDataFrame(list(mapping.items()), "code string, label string")
    want = {1: "A", 2: "none", 3: None}
    side = table.select("code", F.col("label").alias("l"))
    assert {r["id"]: r["c"] for r in prep.recode(df, "c", mapping).collect()} == want
    assert {r["id"]: r["c"] for r in prep.recode(df, "c", table).collect()} == want
    for small in (True, False):
        got = lookup.attach_state(df, side, "c", "code", ["l"], small=small)
        assert {r["id"]: r["l"] for r in got.collect()} == want


def test_unmapped_codes_are_not_privileged(spark):
    df = spark.createDataFrame([("a",), ("q",), (None,)], "c string")
    got = prep.derive_sensitive(df, "c", {"a": "Yes", "b": "No"}, "Yes", label="l")
    assert sorted(r["z"] for r in got.collect()) == [0, 0, 1]
