"""Impute, encode, scale and one-hot applicant features.

A fit is two aggregates whatever the number of columns: one over the numeric
columns, one ``groupBy(feature, category)`` over the unpivoted categorical
columns. A transform is a projection plus one lookup per target-encoded column and
per one-hot column with many levels; it counts nothing, so it works on streams.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark import StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import NumericType

from riskframe.functions.lookup import HOT_PARTS, attach_state, held_bytes, within_limits
from riskframe.functions.spec import FeatureSpec
from riskframe.session import Shelf, cut_lineage

#: Up to this many levels a one-hot column becomes one column per level, its levels
#: literals in the plan; beyond it, a sparse vector column with its levels in a table.
MAX_LEVELS = 1000


# -- aggregates shared by the fit and by single-purpose callers ---------------


def numeric_stats(
    df: DataFrame, columns: Sequence[str], extra: Sequence[Column] = ()
) -> dict[str, tuple[float, float]]:
    """Mean and population deviation after mean imputation, for all columns in
    one pass. A column without any value gets mean 0, without spread scale 1.

    ``extra`` named aggregates ride along and come back under their own names.
    """
    cells = [F.count("*").alias("n"), *extra]
    for i, c in enumerate(columns):
        value = F.col(c).cast("double")
        value = F.when(~F.isnan(value), value)
        cells += [
            F.avg(value).alias(f"m{i}"),
            F.stddev_pop(value).alias(f"s{i}"),
            F.count(value).alias(f"k{i}"),
        ]
    row = df.agg(*cells).first()
    stats = {}
    for i, c in enumerate(columns):
        stats[c] = _centre_and_scale(row[f"m{i}"], row[f"s{i}"], row[f"k{i}"], row["n"])
    named = set(row.__fields__) - {"n"} - {f"{k}{i}" for k in "msk" for i in range(len(columns))}
    stats.update({name: row[name] for name in named})
    return stats


def _centre_and_scale(mean, spread, known: int, n: int) -> tuple[float, float]:
    # imputed rows sit on the mean and only widen the denominator
    filled = (spread or 0.0) * (known / n) ** 0.5 if n else 0.0
    return float(mean or 0.0), float(filled) if filled > 0 else 1.0


def category_counts(
    df: DataFrame,
    columns: Sequence[str],
    label: str | None = None,
    unlabeled: int | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """(*by, feature, category, n, n_labeled, positives) for all categorical columns.

    Partial aggregation collapses each category on the map side, so one frequent
    category costs one row per task. Null is kept as a category of its own; rows
    whose label is ``unlabeled`` count in ``n`` only.
    """
    texts = [F.col(c).cast("string").alias(c) for c in columns]
    target = F.col(label).cast("double") if label else F.lit(None).cast("double")
    if label and unlabeled is not None:
        target = F.when(F.col(label) != unlabeled, target)
    long = df.select(*by, target.alias("__y"), *texts).unpivot(
        [*by, "__y"], list(columns), "feature", "category"
    )
    return long.groupBy(*by, "feature", "category").agg(
        F.count("*").alias("n"),
        F.count("__y").alias("n_labeled"),
        F.coalesce(F.sum("__y"), F.lit(0.0)).alias("positives"),
    )


def cardinalities(counts: DataFrame) -> DataFrame:
    """Distinct non-null categories per feature."""
    return counts.groupBy("feature").agg(F.count("category").alias("n_categories"))


def numeric_categories(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """The columns whose categories are numbers, and are ordered as such."""
    return [c for c in columns if isinstance(df.schema[c].dataType, NumericType)]


def modes(counts: DataFrame, numeric: Sequence[str] = ()) -> DataFrame:
    """Most frequent category per feature; ties go to the smallest value.

    ``numeric`` names the features whose categories compare as numbers.
    """
    known = counts.filter(F.col("category").isNotNull())
    listed = F.col("feature").isin(list(numeric))
    value = F.when(listed, F.expr("try_cast(category AS double)")).alias("value")
    # tells integers apart that are equal as doubles
    exact = F.when(listed, F.expr("try_cast(category AS decimal(38, 10))")).alias("exact")
    return known.groupBy("feature").agg(
        F.min(F.struct((-F.col("n")).alias("rank"), value, exact, F.col("category"))).alias("top")
    ).select("feature", F.col("top.category").alias("mode"))


def sorted_levels(values: Sequence[str], numeric: bool) -> list[str]:
    """Categories written as text, in the order of the values they stand for; NaN last."""
    if not numeric:
        return sorted(values)
    return sorted(values, key=lambda v: (v == "NaN", Decimal(0 if v == "NaN" else v)))


def impute_numeric(df: DataFrame, means: dict[str, float]) -> DataFrame:
    """Null and NaN become the given mean."""
    return df.withColumns({c: _filled_number(c, m) for c, m in means.items()})


def impute_category(df: DataFrame, modes: dict[str, str]) -> DataFrame:
    return df.withColumns(
        {c: F.coalesce(F.col(c).cast("string"), F.lit(m)) for c, m in modes.items()}
    )


def _filled_number(column: str, mean: float) -> Column:
    value = F.col(column).cast("double")
    return F.coalesce(F.when(~F.isnan(value), value), F.lit(float(mean)))


def smoothed_rate(positives: Column, n: Column, overall: Column, k: float) -> Column:
    """Category mean pulled towards the overall mean with strength ``k``."""
    n = F.coalesce(n, F.lit(0)).cast("double")
    return (F.coalesce(positives, F.lit(0.0)) + F.lit(float(k)) * overall) / (n + F.lit(float(k)))


def ordinal_code(column: Column, levels: Sequence[str]) -> Column:
    """Position in the sorted levels; unknown and null give -1."""
    if not levels:
        return F.lit(-1).cast("bigint")
    known = F.array(*[F.lit(v) for v in levels])
    return F.coalesce(F.array_position(known, column) - 1, F.lit(-1)).cast("bigint")


# -- the composite encoder -----------------------------------------------------


@dataclass
class EncoderState:
    """Everything a fit learned, but the target-encoding table."""

    id: str
    numeric: list[str] = field(default_factory=list)
    onehot: list[str] = field(default_factory=list)
    target: list[str] = field(default_factory=list)
    means: dict[str, float] = field(default_factory=dict)
    scales: dict[str, float] = field(default_factory=dict)
    modes: dict[str, str] = field(default_factory=dict)
    levels: dict[str, list[str]] = field(default_factory=dict)
    overall: float = 0.0
    k: float = 1.0
    normalize: bool = True
    use_onehot: bool = True
    onehot_drop: bool = False
    #: Number of levels of the one-hot columns whose levels are a table.
    wide: dict[str, int] = field(default_factory=dict)


class FeatureEncoder(Estimator):
    """Fill, encode, scale and one-hot in the order a credit model needs.

    Categorical columns with at least ``crit`` categories are target-encoded,
    the others one-hot encoded. Rows whose label is ``unlabeled`` take no part
    in the target means unless ``labeled_only`` is off.

    A one-hot column with more than ``max_levels`` levels is encoded as one sparse
    vector column under its own name, of one entry per level in their order; a
    level that the fit has not seen is all zeros.
    """

    def __init__(
        self,
        spec: FeatureSpec,
        onehot: bool = True,
        onehot_drop: bool = False,
        normalize: bool = True,
        target_encode: bool = True,
        crit: int = 3,
        k: float = 1.0,
        labeled_only: bool = True,
        unlabeled: int = -1,
        max_levels: int = MAX_LEVELS,
    ):
        super().__init__()
        if k <= 0:
            raise ValueError("the smoothing strength k must be positive")
        self.spec = spec
        self.onehot = onehot
        self.onehot_drop = onehot_drop
        self.normalize = normalize
        self.target_encode = target_encode
        self.crit = crit
        self.k = k
        self.labeled_only = labeled_only
        self.unlabeled = unlabeled
        self.max_levels = max(2, max_levels)

    def target(self) -> Column:
        """The label as a number, null where a row takes no part in target means."""
        if not self.spec.label:
            return F.lit(None).cast("double")
        value = F.col(self.spec.label).cast("double")
        return F.when(F.col(self.spec.label) != self.unlabeled, value) if self.labeled_only else value

    def counts(self, df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        unlabeled = self.unlabeled if self.labeled_only else None
        return category_counts(df, self.spec.categorical, self.spec.label, unlabeled, by)

    def _fit(self, df: DataFrame) -> "FeatureEncoderModel":
        stats = numeric_stats(df, self.spec.numeric, [F.avg(self.target()).alias("__overall")])
        overall = stats.pop("__overall")
        if not self.spec.categorical:
            return self.learned(df, stats, overall, None)
        counts = self.counts(df).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return self.learned(df, stats, overall, counts)
        finally:
            counts.unpersist()

    def learned(
        self, df: DataFrame, stats: dict, overall: float | None, counts: DataFrame | None
    ) -> "FeatureEncoderModel":
        """The model that these aggregates give; ``df`` is only asked for its types."""
        spec, spark = self.spec, df.sparkSession
        state = EncoderState(
            id=spec.id,
            numeric=list(spec.numeric),
            means={c: m for c, (m, _) in stats.items()},
            scales={c: s for c, (_, s) in stats.items()},
            k=self.k,
            normalize=self.normalize,
            use_onehot=self.onehot,
            onehot_drop=self.onehot_drop,
        )
        if counts is None:
            return FeatureEncoderModel(state, _no_rates(spark))
        sizes = {r["feature"]: r["n_categories"] for r in cardinalities(counts).collect()}
        numeric = numeric_categories(df, spec.categorical)
        state.modes = {r["feature"]: r["mode"] for r in modes(counts, numeric).collect()}
        for c in spec.categorical:
            state.modes.setdefault(c, "")
            wide = self.target_encode and sizes.get(c, 0) >= self.crit
            (state.target if wide else state.onehot).append(c)
        state.wide = {c: sizes[c] for c in state.onehot if sizes.get(c, 0) > self.max_levels}
        codes = None
        if state.wide:
            codes = cut_lineage(numbered_levels(counts, list(state.wide), numeric))
        narrow = [c for c in state.onehot if c not in state.wide]
        if narrow:
            known = counts.filter(
                F.col("feature").isin(narrow) & F.col("category").isNotNull()
            ).select("feature", "category")
            found: dict[str, list[str]] = {c: [] for c in narrow}
            for row in known.collect():
                found[row["feature"]].append(row["category"])
            state.levels = {
                c: sorted_levels(values, c in numeric) or [state.modes[c]]
                for c, values in found.items()
            }
        if not state.target:
            return FeatureEncoderModel(state, _no_rates(spark), codes)
        if overall is None:
            raise ValueError("target encoding needs a label column with labeled rows")
        state.overall = float(overall)
        # fitted state: kept as a table of its own, not as the plan that made it
        rates = cut_lineage(_filled_rates(counts, {c: state.modes[c] for c in state.target}))
        return FeatureEncoderModel(state, rates, codes)


class FoldedFit:
    """An encoder fitted without each fold in turn, from aggregates counted once.

    Two passes over ``df``, whose column ``fold`` numbers the parts: moments per
    (fold, column) and counts per (fold, feature, category), the latter kept on
    ``shelf``. What a fit without a fold needs is the sum over the other folds, so
    no fit reads a row.
    """

    def __init__(self, encoder: FeatureEncoder, df: DataFrame, shelf: Shelf, fold: str = "fold"):
        self.encoder, self.df, self.fold = encoder, df, fold
        cells = [F.count("*").alias("n"), F.avg(encoder.target()).alias("ym"), F.count(encoder.target()).alias("yk")]
        for i, c in enumerate(encoder.spec.numeric):
            value = F.col(c).cast("double")
            value = F.when(~F.isnan(value), value)
            cells += [F.avg(value).alias(f"m{i}"), F.var_pop(value).alias(f"v{i}"), F.count(value).alias(f"k{i}")]
        self.moments = df.groupBy(fold).agg(*cells).collect()  # one row per fold
        self.counts = shelf.keep(encoder.counts(df, [fold])) if encoder.spec.categorical else None

    def without(self, number: int | None) -> "FeatureEncoderModel":
        """The model of all folds but ``number``; of all of them for None."""
        used = [r for r in self.moments if number is None or r[self.fold] != number]
        n = sum(r["n"] for r in used)
        stats = {}
        for i, c in enumerate(self.encoder.spec.numeric):
            known = [(r[f"k{i}"], r[f"m{i}"], r[f"v{i}"]) for r in used if r[f"k{i}"]]
            size = sum(k for k, _, _ in known)
            mean = sum(k * m for k, m, _ in known) / size if size else 0.0
            square = sum(k * (v + (m - mean) ** 2) for k, m, v in known)
            stats[c] = _centre_and_scale(mean, (square / size) ** 0.5 if size else 0.0, size, n)
        labeled = sum(r["yk"] for r in used)
        overall = sum(r["yk"] * r["ym"] for r in used if r["yk"]) / labeled if labeled else None
        counts = self.counts
        if counts is not None:
            if number is not None:
                counts = counts.filter(F.col(self.fold) != number)
            sums = [F.sum(c).alias(c) for c in ("n", "n_labeled", "positives")]
            counts = counts.groupBy("feature", "category").agg(*sums)
        return self.encoder.learned(self.df, stats, overall, counts)


def numbered_levels(counts: DataFrame, columns: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """(feature, category, code, n): each category's position among those of its feature.

    Sorted in ranges over all tasks; a range's codes start where the ranges below
    it end, so no feature's levels meet in one task.
    """
    listed = F.col("feature").isin(list(numeric))
    order = ["feature", "__value", "__exact", "category"]
    sorted_ = (
        counts.filter(F.col("feature").isin(list(columns)) & F.col("category").isNotNull())
        .select(
            "feature",
            "category",
            "n",
            F.when(listed, F.expr("try_cast(category AS double)")).alias("__value"),
            F.when(listed, F.expr("try_cast(category AS decimal(38, 10))")).alias("__exact"),
        )
        .repartitionByRange(*order)
        .withColumn("__range", F.spark_partition_id())
    )
    # the cuts come from a sample, so they are kept before anything is counted in them
    sorted_ = cut_lineage(sorted_)
    before = W.partitionBy("feature").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    starts = sorted_.groupBy("feature", "__range").agg(F.count("*").alias("__size")).select(
        "feature", "__range", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start")
    )
    inside = W.partitionBy("feature", "__range").orderBy(*order[1:])
    ranked = sorted_.withColumn("__rank", F.row_number().over(inside))
    return ranked.join(starts, ["feature", "__range"]).select(
        "feature", "category", (F.col("__start") + F.col("__rank") - 1).alias("code"), "n"
    )


def _filled_rates(counts: DataFrame, modes: dict[str, str]) -> DataFrame:
    """(feature, category, n, positives) with missing values counted as the mode."""
    mode = F.lit(None).cast("string")
    for feature, value in modes.items():
        mode = F.when(F.col("feature") == feature, F.lit(value)).otherwise(mode)
    return (
        counts.filter(F.col("feature").isin(list(modes)))
        .groupBy("feature", F.coalesce("category", mode).alias("category"))
        .agg(F.sum("n_labeled").alias("n"), F.sum("positives").alias("positives"))
        .filter("n > 0")
    )


def _no_rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "feature string, category string, n bigint, positives double")


class FeatureEncoderModel(Model):
    """Fitted encoder: ``transform`` adds the encoded columns to the id column."""

    def __init__(self, state: EncoderState, rates: DataFrame, codes: DataFrame | None = None):
        super().__init__()
        self.state = state
        self.rates = rates
        self.codes = codes
        self._small: bool | None = None
        self._sizes: dict[str, tuple[int, int, int]] | None = None

    @property
    def output_names(self) -> list[str]:
        """Names in order: dummies, numeric, target-encoded; without one-hot the
        ordinal codes follow the numeric columns. A wide one-hot column is one name."""
        s = self.state
        if not s.use_onehot:
            return self.plain_names
        dummies: dict[str, list[str]] = {c: [c] if c in s.wide else [] for c in s.onehot}
        for name, c, _ in self._dummies():
            dummies[c].append(name)
        return [*[name for c in s.onehot for name in dummies[c]], *s.numeric, *s.target]

    @property
    def plain_names(self) -> list[str]:
        """Names before one-hot: numeric, ordinal codes, target-encoded."""
        s = self.state
        return [*s.numeric, *s.onehot, *s.target]

    def _dummies(self) -> list[tuple[str, str, int]]:
        out = []
        for c in self.state.onehot:
            if c in self.state.wide:
                continue
            codes = list(range(len(self.state.levels[c])))
            if self.state.onehot_drop and len(codes) == 2:
                codes = codes[1:]
            out += [(f"{c}_{code}", c, code) for code in codes]
        return out

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.encode(df, keep=[c for c in df.columns if c not in self._inputs()])

    def _inputs(self) -> set[str]:
        s = self.state
        return {*s.numeric, *s.onehot, *s.target}

    def encode(
        self,
        df: DataFrame,
        keep: Sequence[str] | None = None,
        scale: bool | None = None,
        onehot: bool | None = None,
    ) -> DataFrame:
        """``keep`` columns (the id by default) plus the encoded features.

        ``scale=False`` leaves the numeric columns on their original scale,
        ``onehot=False`` leaves ordinal codes: the spaces in which explanations
        and counterfactuals work.
        """
        s = self.state
        onehot = s.use_onehot if onehot is None else onehot
        names = self.output_names if onehot else self.plain_names
        keep = [s.id] if keep is None else list(keep)
        clash = set(keep) & set(names)
        if clash:
            raise ValueError(f"kept columns would collide with encoded ones: {sorted(clash)}")
        scale = s.normalize if scale is None else scale
        looked_up = [*s.target, *s.wide]
        staged = df
        # broadcast sides first: rows are still where they were read
        for c in sorted(looked_up, key=lambda c: not self.small_rates(c)):
            i = looked_up.index(c)
            filled = F.coalesce(F.col(c).cast("string"), F.lit(s.modes[c]))
            table = (self.codes if c in s.wide else self.rates).filter(F.col("feature") == c)
            values = {f"__k{i}": "code"} if c in s.wide else {f"__n{i}": "n", f"__p{i}": "positives"}
            staged = attach_state(
                staged.withColumn(f"__c{i}", filled),
                table.select(F.col("category").alias("__cat"), *[F.col(v).alias(k) for k, v in values.items()]),
                f"__c{i}",
                "__cat",
                list(values),
                small=self.small_rates(c),
                # the fit has counted them
                hot_keys=table.filter(F.col("n") > F.lit(self._measured()[c][2] / HOT_PARTS)).select("category"),
            )
        columns: dict[str, Column] = {}
        for c in s.numeric:
            value = _filled_number(c, s.means[c])
            if scale:
                value = (value - F.lit(s.means[c])) / F.lit(s.scales[c])
            columns[c] = value
        codes = {
            c: ordinal_code(F.coalesce(F.col(c).cast("string"), F.lit(s.modes[c])), s.levels[c])
            for c in s.onehot
            if c not in s.wide
        }
        for c in s.wide:
            codes[c] = F.coalesce(F.col(f"__k{looked_up.index(c)}"), F.lit(-1)).cast("bigint")
        if onehot:
            for name, c, code in self._dummies():
                columns[name] = F.when(codes[c] == code, 1.0).otherwise(0.0)
            columns.update({c: codes[c] for c in s.wide})
        else:
            columns.update(codes)
        for i, c in enumerate(s.target):
            columns[c] = smoothed_rate(
                F.col(f"__p{i}"), F.col(f"__n{i}"), F.lit(s.overall), s.k
            )
        encoded = staged.select(
            *[F.col(c) for c in keep], *[columns[c].alias(c) for c in names]
        )
        return self._spread(encoded) if onehot else encoded

    def _spread(self, df: DataFrame) -> DataFrame:
        """Codes of the wide one-hot columns as sparse vectors; -1 gives no entry."""
        if not self.state.wide:
            return df
        staged = df
        for c, n in self.state.wide.items():
            # with the number of values at hand nothing is counted
            known = {"ml_attr": {"type": "nominal", "num_vals": n}}
            code = F.when(F.col(c) < 0, F.lit(n)).otherwise(F.col(c)).cast("double")
            staged = staged.withColumn(f"__code_{c}", code).withMetadata(f"__code_{c}", known)
        spread = OneHotEncoder(
            inputCols=[f"__code_{c}" for c in self.state.wide],
            outputCols=[f"__hot_{c}" for c in self.state.wide],
            # the entry for unknown levels is the last one, and dropped
            handleInvalid="keep",
            dropLast=True,
        )
        done = spread.fit(staged).transform(staged)
        return done.select(*[F.col(f"__hot_{c}").alias(c) if c in self.state.wide else F.col(c) for c in df.columns])

    def finish(self, df: DataFrame, scaled: bool = True) -> DataFrame:
        """From the plain space (``encode(onehot=False)``) to the model's columns."""
        s = self.state
        columns = {c: F.col(c) for c in self.plain_names}
        if s.normalize and not scaled:
            for c in s.numeric:
                columns[c] = (F.col(c) - F.lit(s.means[c])) / F.lit(s.scales[c])
        if s.use_onehot:
            for name, c, code in self._dummies():
                columns[name] = F.when(F.col(c) == code, 1.0).otherwise(0.0)
        others = [c for c in df.columns if c not in self.plain_names]
        finished = df.select(*others, *[columns[c].alias(c) for c in self.output_names])
        return self._spread(finished) if s.use_onehot else finished

    def _measured(self) -> dict[str, tuple[int, int, int]]:
        """Levels, their bytes and the rows that the fit counted, per looked-up column."""
        if self._sizes is None:
            self._sizes = {c: (0, 0, 0) for c in [*self.state.target, *self.state.wide]}
            tables = [self.rates] * bool(self.state.target) + [self.codes] * bool(self.state.wide)
            for table in tables:
                found = table.groupBy("feature").agg(
                    F.count("*").alias("levels"), held_bytes("category").alias("held"), F.sum("n").alias("rows")
                )
                self._sizes |= {r["feature"]: (r["levels"], r["held"], r["rows"]) for r in found.collect()}
        return self._sizes

    def small_rates(self, column: str | None = None) -> bool:
        """Whether the table of one looked-up column, or of each, may be broadcast; measured once."""
        if self._small is not None:
            return self._small
        sizes = self._measured()
        return all(within_limits(*sizes[c][:2]) for c in ([column] if column else sizes))

    def assemble(
        self, df: DataFrame, keep: Sequence[str] | None = None, out: str = "features"
    ) -> DataFrame:
        """Encoded features as one vector column."""
        encoded = self.encode(df, keep)
        kept = [self.state.id] if keep is None else list(keep)
        vector = VectorAssembler(inputCols=self.output_names, outputCol=out)
        return vector.transform(encoded).select(*kept, out)

    def unscale(self, df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
        """Scaled numeric columns back on their original scale; others unchanged."""
        s = self.state
        wanted = s.numeric if columns is None else [c for c in columns if c in s.numeric]
        if not s.normalize:
            return df
        return df.withColumns(
            {c: F.col(c) * F.lit(s.scales[c]) + F.lit(s.means[c]) for c in wanted}
        )

    # persistence -----------------------------------------------------------

    def save(self, path: str) -> None:
        spark = self.rates.sparkSession
        self.rates.write.mode("overwrite").parquet(f"{path}/rates")
        if self.state.wide:
            self.codes.write.mode("overwrite").parquet(f"{path}/codes")
        text = json.dumps(self.state.__dict__)
        spark.createDataFrame([(text,)], "state string").coalesce(1).write.mode(
            "overwrite"
        ).parquet(f"{path}/state")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "FeatureEncoderModel":
        text = spark.read.parquet(f"{path}/state").first()["state"]
        state = EncoderState(**json.loads(text))
        codes = spark.read.parquet(f"{path}/codes") if state.wide else None
        return cls(state, spark.read.parquet(f"{path}/rates"), codes)
