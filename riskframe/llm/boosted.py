"""Gradient-boosted trees on a bounded sample of labelled rows (Spark ML)."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

#: A classifier is fitted on about this many labelled rows at most; the sample
#: depends on the rows' ids only.
MAX_LABELLED = 20_000


def bounded_sample(labelled: DataFrame, key: str, limit: int = MAX_LABELLED, seed: int = 11) -> DataFrame:
    """About ``limit`` rows at most, chosen by a hash of the key."""
    total = labelled.count()
    if total <= limit:
        return labelled
    cut = int((1 << 31) * (limit / total))
    return labelled.filter(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 31)) < cut)


class Trees:
    """A fitted scorer; without rows of both classes it gives one constant."""

    def __init__(self, rows: DataFrame, features: str, label: str, rounds: int = 20, depth: int = 3):
        counts = {int(r[label]): r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}
        self.constant = None if len(counts) == 2 else float(bool(counts.get(1)))
        self.model = None
        if self.constant is None:
            vectors = rows.select(array_to_vector(F.col(features)).alias("__x"), F.col(label).cast("double").alias("__y"))
            self.model = GBTClassifier(
                featuresCol="__x", labelCol="__y", maxIter=rounds, maxDepth=depth, stepSize=0.2, seed=7, maxBins=64
            ).fit(vectors)

    def score(self, df: DataFrame, features: str, out: str) -> DataFrame:
        """``df`` with the chance of label 1 in ``out``."""
        if self.model is None:
            return df.withColumn(out, F.lit(self.constant))
        vectors = df.withColumn("__x", array_to_vector(F.col(features)))
        scored = self.model.transform(vectors)
        chance: Column = vector_to_array(F.col("probability"))[1]
        return scored.withColumn(out, chance).select(*df.columns, out)
