"""Scorers: a closed-form scorecard, or any fitted ``pyspark.ml`` classifier."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Scorecard:
    """``1 / (1 + exp(-(intercept + sum(weight * feature))))`` as one expression."""

    intercept: float
    weights: Mapping[str, float]

    @property
    def features(self) -> list[str]:
        return list(self.weights)

    def expr(self, values: Mapping[str, Column] | None = None) -> Column:
        """The score; ``values`` replaces the column of some features."""
        values = values or {}
        logit: Column = F.lit(float(self.intercept))
        for name, weight in self.weights.items():
            logit = logit + F.lit(float(weight)) * values.get(name, F.col(name))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        return df.withColumn(out, self.expr())

    def logit_of(self, row: Mapping[str, float], names: Sequence[str]) -> float:
        """Part of the linear predictor that a known row adds through ``names``."""
        return sum(self.weights[n] * float(row[n]) for n in names)

    def sql(self, values: Mapping[str, str] | None = None) -> str:
        """The same expression as SQL text."""
        values = values or {}
        logit = f"CAST({self.intercept!r} AS DOUBLE)"
        for name, weight in self.weights.items():
            logit += f" + CAST({float(weight)!r} AS DOUBLE) * ({values.get(name, name)})"
        return f"(1.0 / (1.0 + exp(-({logit}))))"

    @classmethod
    def from_logistic(cls, model, features: Sequence[str]) -> "Scorecard":
        """Read the coefficients of a fitted ``LogisticRegressionModel``."""
        weights = dict(zip(features, (float(v) for v in model.coefficients)))
        return cls(float(model.intercept), weights)


@dataclass(frozen=True)
class ModelScorer:
    """P(y=1) of a fitted classifier on the given feature columns."""

    model: object
    features: Sequence[str]

    def ready(self, df: DataFrame, replaced: Sequence[str]) -> tuple[DataFrame, object, list[str]]:
        """Rows, model and the number columns that the model reads, ``replaced`` among them."""
        return df, self.model, list(self.features)

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        vector = f"__vec_{out}"
        assembled = VectorAssembler(inputCols=list(self.features), outputCol=vector)
        return score_vector(self.model, assembled.transform(df), vector, out).drop(vector)


def score_vector(model, df: DataFrame, vector: str, out: str = "score") -> DataFrame:
    """Apply a fitted classifier to an assembled vector column."""
    if hasattr(model, "score_vector"):  # a learner of this library
        return model.score_vector(df, vector, out)
    probe = model.copy({model.featuresCol: vector})
    scored = probe.transform(df)
    scored = scored.withColumn(out, vector_to_array(F.col(probe.getProbabilityCol()))[1])
    extra = {probe.getProbabilityCol(), probe.getRawPredictionCol(), probe.getPredictionCol()}
    return scored.drop(*(extra - set(df.columns)))
