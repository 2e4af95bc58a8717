"""Row preparation: recode, cast, split, sample and append applicant tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from riskframe.functions.hashing import MODULUS, arithmetic_rank
from riskframe.functions.lookup import attach_state

#: Dictionaries up to this size become a literal map, larger ones a join.
MAP_LIMIT = 200


def drop_and_rename(
    df: DataFrame, drop: Sequence[str] = (), rename: Mapping[str, str] | None = None
) -> DataFrame:
    return df.drop(*drop).withColumnsRenamed(dict(rename or {}))


def promote_header(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename position columns and drop the row that repeats the real header.

    ``names`` maps the read column to the header text found in that row.
    """
    is_header = F.lit(True)
    for column, title in names.items():
        is_header = is_header & F.col(column).eqNullSafe(F.lit(title))
    return df.filter(~is_header).withColumnsRenamed(dict(names))


def cast_all(df: DataFrame, keep: Sequence[str] = (), to: str = "double") -> DataFrame:
    """Cast every other column; a value that does not parse raises."""
    return df.select(
        *[
            F.col(c) if c in keep else _strict_cast(F.col(c), c, to).alias(c)
            for c in df.columns
        ]
    )


def _strict_cast(column: Column, name: str, to: str) -> Column:
    parsed = column.try_cast(to)
    message = F.concat(F.lit(f"column {name}: not a {to}: "), column.cast("string"))
    return F.when(column.isNotNull() & parsed.isNull(), F.raise_error(message)).otherwise(parsed)


def count_bad_casts(df: DataFrame, keep: Sequence[str] = (), to: str = "double") -> DataFrame:
    """How many values per column would not parse, in one aggregate."""
    return df.agg(
        *[
            F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(to).isNull()).alias(c)
            for c in df.columns
            if c not in keep
        ]
    )


def recode(
    df: DataFrame, column: str, mapping: Mapping | DataFrame, out: str | None = None
) -> DataFrame:
    """Replace codes by labels; a code without a label becomes null, and so does a
    null unless the mapping has a label for it.

    ``mapping`` is a dictionary, or a table with columns ``code`` and ``label``
    when it is too large for a literal.
    """
    out = out or column
    if isinstance(mapping, DataFrame):
        side = mapping.select("code", F.col("label").alias("__label"))
        joined = attach_state(df, side, column, "code", ["__label"])
        return joined.withColumn(out, F.col("__label")).drop("__label")
    if len(mapping) > MAP_LIMIT:
        spark = df.sparkSession
        rows = [(code, label) for code, label in mapping.items()]
        return recode(df, column, spark.createDataFrame(rows, ["code", "label"]), out)
    known = {code: label for code, label in mapping.items() if code is not None}
    if not known:
        return df.withColumn(out, F.when(F.col(column).isNull(), F.lit(mapping.get(None))))
    pairs = F.create_map(*[F.lit(v) for v in chain.from_iterable(known.items())])
    found = F.try_element_at(pairs, F.col(column))
    if None in mapping:
        found = F.when(F.col(column).isNull(), F.lit(mapping[None])).otherwise(found)
    return df.withColumn(out, found)


def recode_binary(df: DataFrame, column: str, match, out: str | None = None) -> DataFrame:
    """1 where the column equals ``match``, else 0, also for null."""
    return df.withColumn(out or column, F.when(F.col(column) == F.lit(match), 1).otherwise(0))


def derive_sensitive(
    df: DataFrame, column: str, mapping: Mapping, privileged: str, label: str, out: str = "z"
) -> DataFrame:
    """A readable group label and its 0/1 flag from a coded column; 0 for unmapped codes."""
    labelled = recode(df.withColumn(label, F.col(column)), label, mapping)
    member = F.coalesce(F.col(label) == privileged, F.lit(False))
    return labelled.withColumn(out, member.cast("int"))


# -- splits ------------------------------------------------------------------


def holdout_split(
    df: DataFrame, key: str, test: float = 0.2, valid: float = 0.25, seed: int = 0
) -> DataFrame:
    """Column ``part``: test, then valid as a share of the rest, else train.

    The draw depends only on the id, so it is the same for any partitioning.
    """
    size = 10_000
    draw = arithmetic_rank(key, seed) % size
    cut = int(round(test * size))
    second = cut + int(round((size - cut) * valid))
    return df.withColumn(
        "part",
        F.when(draw < cut, "test").when(draw < second, "valid").otherwise("train"),
    )


#: Hash positions are grouped into this many slots; rows spread evenly over them.
SLOTS = 1 << 16


def _with_slot(df: DataFrame, key: str, seed: int) -> DataFrame:
    order = arithmetic_rank(key, seed)
    return df.withColumn("__order", order).withColumn(
        "__slot", F.floor(F.col("__order") / F.lit(MODULUS / SLOTS)).cast("int")
    )


def stratified_folds(
    df: DataFrame, key: str, label: str, folds: int = 5, seed: int = 0
) -> DataFrame:
    """Column ``fold``: rows dealt round-robin within each label in hash order.

    A label may hold most of the rows, so it is not ranked as a whole: rows are
    ranked inside small hash slots, and each slot starts where the ones before it
    ended. The rows are shuffled once.
    """
    ranked = _with_slot(df, key, seed)
    sizes = ranked.groupBy(F.col(label).alias("__y"), F.col("__slot").alias("__s")).agg(
        F.count("*").alias("__size")
    )
    before = W.partitionBy("__y").orderBy("__s").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(
        "__y", "__s", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start")
    )
    inside = W.partitionBy(label, "__slot").orderBy("__order", key)
    # up to SLOTS rows per label value: left to the planner, which knows their size
    dealt = ranked.withColumn("__rank", F.row_number().over(inside)).join(
        starts,
        F.col(label).eqNullSafe(F.col("__y")) & (F.col("__slot") == F.col("__s")),
    )
    place = F.col("__start") + F.col("__rank") - 1
    return dealt.select(*df.columns, F.pmod(place, F.lit(folds)).cast("int").alias("fold"))


def quota_sample(
    df: DataFrame, key: str, group: str, quotas: Mapping[str, int], seed: int = 0
) -> DataFrame:
    """Column ``picked``: exactly ``n`` rows of each group, the lowest by hash.

    Counts per hash slot tell in which slot a group's quota is filled; only that
    slot's rows are ordered, to find the last row picked. Everything else is a
    comparison with that row, so the table is not shuffled.
    """
    ranked = _with_slot(df, key, seed)
    wanted = {g: int(n) for g, n in quotas.items() if n > 0}
    if not wanted:
        return df.withColumn("picked", F.lit(False))
    upto = W.partitionBy("__g").orderBy("__slot")
    slots = (
        ranked.filter(F.col(group).isin(list(wanted)))
        .groupBy(F.col(group).alias("__g"), "__slot")
        .agg(F.count("*").alias("__n"))
        .withColumn("__upto", F.sum("__n").over(upto))
    )
    quota = _by_value(F.col("__g"), wanted)
    # one row per group
    filled = slots.filter(
        (F.col("__upto") >= quota) & (F.col("__upto") - F.col("__n") < quota)
    ).collect()
    left = {r["__g"]: wanted[r["__g"]] - (r["__upto"] - r["__n"]) for r in filled}
    at = {r["__g"]: r["__slot"] for r in filled}
    last = {}
    if left:
        edge = ranked.filter(F.col("__slot") == _by_value(F.col(group), at))
        place = F.row_number().over(W.partitionBy(group).orderBy("__order", key))
        ends = edge.select(group, "__order", key, place.alias("__place")).filter(
            F.col("__place") == _by_value(F.col(group), left)
        )
        last = {r[0]: (r[1], r[2]) for r in ends.collect()}
    picked = F.lit(False)
    for g in wanted:
        if g in last:
            order, name = last[g]
            inside = (F.col("__order") < order) | (
                (F.col("__order") == order) & (F.col(key) <= F.lit(name))
            )
        else:
            # fewer rows than the quota: all of them
            inside = F.lit(True)
        picked = F.when(F.col(group) == F.lit(g), inside).otherwise(picked)
    return ranked.withColumn("picked", picked).drop("__order", "__slot")


def _by_value(column: Column, values: Mapping) -> Column:
    out = F.lit(None).cast("bigint")
    for name, value in values.items():
        out = F.when(column == F.lit(name), F.lit(int(value)).cast("bigint")).otherwise(out)
    return out


def append_unlabeled(accepted: DataFrame, rejected: DataFrame, label: str = "y") -> DataFrame:
    """Accepted rows followed by rejected ones carrying the marker -1."""
    marked = rejected.withColumn(label, F.lit(-1).cast(accepted.schema[label].dataType))
    return accepted.unionByName(marked)


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """The ``n`` rows with the smallest hash: each task keeps only its best ``n``."""
    ranked = df.withColumn("__order", arithmetic_rank(key, seed))
    return ranked.orderBy("__order", key).limit(n).drop("__order")
