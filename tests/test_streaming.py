import pytest

from riskframe.operators import learn
from riskframe.operators.features import FeatureEncoder
from riskframe.plans.learning import FAIR_SPEC
from riskframe.session import scratch_path
from riskframe.streaming import scoring


def test_a_stream_gets_the_scores_of_the_batch(spark, apps):
    flow = learn.fit_flow(apps, FAIR_SPEC, learn.Classifier("logistic"))
    path = scratch_path(spark, "stream-test")
    apps.repartition(3).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(apps.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    scored = scoring.score_stream(stream, flow, ["app_id"])
    scoring.append_to(scored, f"{path}/out", f"{path}/log").awaitTermination()
    got = {r["app_id"]: r["score"] for r in spark.read.parquet(f"{path}/out").collect()}
    want = {r["app_id"]: r["score"] for r in flow.score(apps, ["app_id"]).collect()}
    assert got == {k: pytest.approx(v, abs=1e-12) for k, v in want.items()}


def test_encoding_a_stream(spark, apps):
    encoder = FeatureEncoder(FAIR_SPEC).fit(apps)
    path = scratch_path(spark, "encode-test")
    apps.write.parquet(f"{path}/in")
    stream = spark.readStream.schema(apps.schema).parquet(f"{path}/in")
    encoded = scoring.encode_stream(stream, encoder)
    scoring.append_to(encoded, f"{path}/out", f"{path}/log").awaitTermination()
    back = spark.read.parquet(f"{path}/out").select(encoded.columns)
    assert sorted(back.collect()) == sorted(encoder.encode(apps).collect())


def test_large_state_meets_a_stream_in_a_shuffle(spark, apps):
    """Nothing is broadcast but the categories that were frequent in the fit."""
    want = FeatureEncoder(FAIR_SPEC).fit(apps)
    encoder = FeatureEncoder(FAIR_SPEC).fit(apps)
    encoder._small = False
    path = scratch_path(spark, "large-test")
    apps.repartition(2).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(apps.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    encoded = scoring.encode_stream(stream, encoder)
    scoring.append_to(encoded, f"{path}/out", f"{path}/log").awaitTermination()
    back = spark.read.parquet(f"{path}/out").select(encoded.columns)
    assert sorted(back.collect()) == sorted(want.encode(apps).collect())
