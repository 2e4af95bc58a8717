"""Whole workflows: train and compare, fairness methods, reject inference, streams."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, functions as F

from riskframe.functions.spec import FeatureSpec
from riskframe.operators import constrained, fair, learn, measure, prep, rejects
from riskframe.operators.features import FeatureEncoder
from riskframe.operators.learn import Classifier, FittedFlow
from riskframe.plans.fixtures import (
    CARD,
    applications,
    rounded,
    table,
    with_applications,
)
from riskframe.plans.learning import FAIR_SPEC, SMALL_FOREST
from riskframe.session import Shelf, cut_lineage, scratch_path
from riskframe.streaming import scoring

LOGISTIC = Classifier("logistic", {"C": 10.0})
#: Reject-inference methods that are fitted side by side.
METHODS_AT_ONCE = 3


def compare_models(
    flows: Mapping[str, FittedFlow], test: DataFrame, spec: FeatureSpec, threshold: float = 0.5
) -> DataFrame:
    """The comparison report of several fitted flows on the same rows."""
    parts = None
    for name, flow in flows.items():
        scored = flow.score(test, [spec.id, spec.label]).select(
            F.lit(name).alias("model"), F.col(spec.label).alias("y"), "score"
        )
        parts = scored if parts is None else parts.unionByName(scored)
    return measure.comparison_report(parts, threshold)


def train_and_compare(spark, sf_dir):
    """A default forest against a tuned one, on the test part."""
    split = prep.holdout_split(applications(spark, sf_dir), "app_id", seed=42)
    train, valid, test = (split.filter(F.col("part") == p) for p in ("train", "valid", "test"))
    base = learn.fit_flow(train, FAIR_SPEC, Classifier("forest", {"n_estimators": 20}))
    tuned = learn.search_fast(
        "forest", SMALL_FOREST, train, valid, FAIR_SPEC, n_trials=3, seed=0, parallelism=3
    )
    report = compare_models({"baseline": base, "optimized": tuned.flow}, test, FAIR_SPEC)
    return rounded(report, digits=4)


def fairness_methods(
    train: DataFrame, test: DataFrame, spec: FeatureSpec, classifier: Classifier = LOGISTIC
) -> DataFrame:
    """Predictions (model, id, y, z, pred) on ``test`` without intervention, with
    reweighing, with constrained training (refitted and in-loop boosting) and with group
    thresholds."""
    keep = [spec.id, spec.label, spec.sensitive]
    encoder = FeatureEncoder(spec).fit(train)
    weighed = fair.reweigh(train, spec.sensitive, spec.label)
    ready = learn.training_table(encoder.assemble(weighed, [*keep, "w"]), spec.id)
    encoded = cut_lineage(encoder.assemble(test, keep))
    base = classifier.fit(ready, label=spec.label, id=spec.id)
    reweighed = classifier.fit(ready, label=spec.label, weight="w", id=spec.id)
    refitted, _ = fair.constrained_fit(
        ready, classifier, label=spec.label, group=spec.sensitive, id=spec.id,
        tolerance=0.02, rounds=4, step=4.0,
    )
    boosted = constrained.constrained_boosting(
        ready, label=spec.label, group=spec.sensitive, rounds=20, max_depth=3, tolerance=0.02, multiplier_step=2.0
    )
    names = {spec.label: "y", spec.sensitive: "z"}
    # the search passes over the scores several times
    fitted = cut_lineage(learn.score_rows(base, ready).withColumnsRenamed(names).select("y", "z", "score"))
    best = fair.threshold_search(fitted).first()
    parts = []
    for name, model in (("baseline", base), ("reweighing", reweighed), ("constrained", refitted)):
        scored = learn.score_rows(model, encoded).drop("features")
        parts.append(learn.hard_labels(scored).withColumn("model", F.lit(name)))
    scored = boosted.score(encoded).drop("features")
    parts.append(learn.hard_labels(scored).withColumn("model", F.lit("constrained_boosting")))
    if best["feasible"]:
        scored = learn.score_rows(base, encoded).drop("features").withColumnsRenamed(names)
        cut = fair.apply_thresholds(scored, best["threshold_0"], best["threshold_1"])
        back = {"y": spec.label, "z": spec.sensitive}
        parts.append(cut.withColumnsRenamed(back).withColumn("model", F.lit("thresholds")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumnsRenamed(names)


def compare_fairness(spark, sf_dir):
    split = prep.holdout_split(applications(spark, sf_dir), "app_id", seed=42)
    with Shelf(spark, "parts") as shelf:  # joined and split once, not in every pass
        train, test = shelf.keep(split.filter("part <> 'test'")), shelf.keep(split.filter("part = 'test'"))
        flags = fairness_methods(train, test, FAIR_SPEC)
    return rounded(measure.fairness_report(flags), digits=4)


def reject_methods(
    labeled: DataFrame, spec: FeatureSpec, methods: Sequence[str], classifier: Classifier = LOGISTIC
) -> dict[str, FittedFlow]:
    """One fitted flow per reject-inference method, and ``base`` without any.

    ``labeled`` marks rejected rows with label -1. The accept model supplies
    P(accept), the base model P(bad).
    """
    y = spec.label
    accepted = labeled.filter(F.col(y) != rejects.UNLABELED)
    marked = rejects.accept_labels(labeled, y)
    accept_spec = FeatureSpec(spec.id, "accepted", None, spec.numeric, spec.categorical)
    with ThreadPoolExecutor(max_workers=2) as pool:
        fits = [pool.submit(learn.fit_flow, accepted, spec, classifier), pool.submit(learn.fit_flow, marked, accept_spec, classifier)]
        base, accept = (f.result() for f in fits)
    p_accept = accept.score(labeled, [spec.id], out="p_accept")
    p_bad = base.score(labeled, [spec.id], out="p_bad")
    # read by every method
    rows = cut_lineage(
        labeled.withColumnRenamed(y, "y").join(p_accept, spec.id).join(p_bad, spec.id)
    )
    makers = {
        "upward": lambda: rejects.upward(rows, floor=1e-6),
        "downward": lambda: rejects.downward(rows),
        "softcutoff": lambda: rejects.soft_cutoff(rows),
        "fuzzyparcelling": lambda: rejects.fuzzy_parcels(rows),
        "extrapolation_positive": lambda: rejects.extrapolate(rows, mode="positive"),
        "extrapolation_all": lambda: rejects.extrapolate(rows, mode="all"),
        "extrapolation_confident": lambda: rejects.extrapolate(rows, mode="confident"),
        "spreading": lambda: _spread(rows, accept, spec),
    }
    unknown = sorted(set(methods) - set(makers))
    if unknown:
        raise ValueError(f"unknown methods {unknown}; known: {sorted(makers)}")

    def fitted(name: str) -> FittedFlow:
        weighted = makers[name]().withColumnRenamed("y", y)
        return learn.fit_flow(weighted, spec, classifier, weight="w")

    # small jobs of one method run beside the others'; the longest method begins first
    with ThreadPoolExecutor(max_workers=METHODS_AT_ONCE) as pool:
        running = {name: pool.submit(fitted, name) for name in sorted(set(methods), key=lambda m: (m != "spreading", m))}
        return {"base": base, **{name: running[name].result() for name in methods}}


def _spread(rows: DataFrame, accept: FittedFlow, spec: FeatureSpec) -> DataFrame:
    """Labels spread over the neighbours in the encoded feature space."""
    encoder = accept.encoder
    vectors = encoder.encode(rows, [spec.id, "y"]).select(
        spec.id, "y", F.array(*encoder.output_names).alias("__v")
    )
    fresh = rejects.label_spreading(vectors, spec.id, "__v", recall=0.9)
    return rows.drop("y").join(fresh, spec.id)


def compare_rejects(spark, sf_dir):
    """All methods on applications whose rejected labels are hidden."""
    apps = applications(spark, sf_dir).withColumn(
        "y", F.when(F.col("rejected") == 1, -1).otherwise(F.col("y"))
    )
    split = prep.holdout_split(apps, "app_id", seed=42)
    methods = [
        "upward", "downward", "softcutoff", "fuzzyparcelling", "extrapolation_positive",
        "extrapolation_all", "extrapolation_confident", "spreading",
    ]
    with Shelf(spark, "parts") as shelf:  # joined and split once, not in every pass
        train, test = shelf.keep(split.filter("part <> 'test'")), shelf.keep(split.filter("part = 'test'"))
        flows = reject_methods(train, FAIR_SPEC, methods)
        wide = None
        for name, flow in flows.items():
            keep = ["app_id", "y"] if wide is None else ["app_id"]
            scored = flow.score(test, keep, out=name)
            wide = scored if wide is None else wide.join(scored, "app_id")
        wide = cut_lineage(wide)
    return rounded(rejects.reject_report(wide, list(flows), "base", bad_rate=0.25), digits=4)


def stream_scores(spark, sf_dir):
    """Orders arrive as a stream, meet their customer and get a score."""
    orders = table(spark, sf_dir, "orders")
    stream = spark.readStream.schema(orders.schema).parquet(f"{sf_dir}/orders*.parquet")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    arrived = stream.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("app_id"),
        F.col("o_totalprice").alias("amount"),
        F.col("c_acctbal").alias("balance"),
    )
    path = scratch_path(spark, "stream")
    query = scoring.append_to(
        scoring.score_stream(arrived, CARD, ["app_id"]), f"{path}/rows", f"{path}/log"
    )
    query.awaitTermination()
    return rounded(spark.read.schema("app_id bigint, score double").parquet(f"{path}/rows"))


QUERIES = {
    "x02_streamed_scores": (
        stream_scores,
        with_applications(
            select=f"SELECT app_id, round({CARD.sql()}, 6) AS score FROM applications"
        ),
    ),
    "x03_train_and_compare": (train_and_compare, None),
    "x04_fairness_methods": (compare_fairness, None),
    "x05_reject_methods": (compare_rejects, None),
}
