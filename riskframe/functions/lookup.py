"""Attach fitted per-key state to a table without trusting its size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: A lookup side is broadcast only below both of these measured limits.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
#: A key is hot when it holds more than 1/HOT_PARTS of the rows; there can be
#: at most HOT_PARTS such keys, so their state is always small.
HOT_PARTS = 1000
#: Types of keys that meet as they are, not as texts.
PLAIN_KEYS = {"byte", "short", "integer", "long"}


def fits_broadcast(state: DataFrame, key: str, max_rows: int | None = None) -> bool:
    """Measure a lookup side: row count and bytes held by its key and its values."""
    values = [c for c in state.columns if c != key]
    row = state.select(F.count("*").alias("n"), held_bytes(key, *values).alias("b")).first()
    return within_limits(row["n"], row["b"], max_rows)


def held_bytes(*columns: str) -> Column:
    """Aggregate: bytes of the columns written as text, whatever their types."""
    text = F.to_json(F.struct(*[F.col(c) for c in columns]))
    return F.coalesce(F.sum(F.octet_length(text)), F.lit(0))


def within_limits(rows: int, held: int, max_rows: int | None = None) -> bool:
    """Whether a side of that many rows and bytes may be broadcast."""
    max_rows = BROADCAST_ROWS if max_rows is None else max_rows
    return rows <= max_rows and held + 64 * rows <= BROADCAST_BYTES


def attach_state(
    df: DataFrame,
    state: DataFrame,
    key: str,
    state_key: str,
    values: list[str],
    small: bool | None = None,
    hot_parts: int = HOT_PARTS,
    salts: int = 4096,
    hot_keys: DataFrame | None = None,
) -> DataFrame:
    """Left join ``values`` of ``state`` onto ``df``; unmatched rows get nulls.

    A null key meets the state's row with a null key, whatever the sizes.

    ``state`` holds one row per key. When it is too big to broadcast, the few
    keys that dominate ``df`` are served by a broadcast of at most
    ``hot_parts`` rows, and only the others meet ``state`` in a shuffle. Hot and
    null keys take a salted key that matches nothing, so they spread evenly.

    ``hot_keys`` (one column, at most some ``hot_parts`` rows) names those keys when
    a fit has counted them already. Then ``df`` is not counted and may be a stream.
    """
    side = state.select(F.col(state_key).alias("__key"), *values)
    if small is None:
        small = fits_broadcast(side, "__key")
    if small:
        joined = df.join(F.broadcast(side), F.col(key).eqNullSafe(F.col("__key")), "left")
        return joined.drop("__key")

    if hot_keys is None:
        total = df.count()
        hot_keys = (
            df.filter(F.col(key).isNotNull())
            .groupBy(F.col(key).alias("__hot"))
            .count()
            .filter(F.col("count") > F.lit(total / hot_parts))
            .select("__hot")
        )
    hot = hot_keys.toDF("__hot").join(side, F.col("__hot") == F.col("__key"), "left").select(
        "__hot", *[F.col(v).alias(f"__hot_{v}") for v in values]
    )
    hot = hot.union(
        side.filter(F.col("__key").isNull()).select(
            F.lit(None).cast(hot.schema["__hot"].dataType), *[F.col(v) for v in values]
        )
    )
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int")
    kind = df.select(F.col(key)).schema[0].dataType
    if kind == side.schema["__key"].dataType and kind.typeName() in PLAIN_KEYS:
        # keys meet as they are; those served already bring a salt that the state lacks
        served = df.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("__hot")), "left").withColumn(
            "__salt", F.when(F.col(key).isNull() | F.col("__hot").isNotNull(), salt + 1).otherwise(0)
        )
        cold = side.filter(F.col("__key").isNotNull()).withColumn("__none", F.lit(0))
        joined = served.join(cold, (F.col(key) == F.col("__key")) & (F.col("__salt") == F.col("__none")), "left")
        return joined.select(
            *df.columns,
            *[F.coalesce(F.col(f"__hot_{v}"), F.col(v)).alias(v) for v in values],
        )
    spread = F.concat(F.lit("s:"), salt.cast("string"))
    served = df.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("__hot")), "left").withColumn(
        "__probe",
        F.when(F.col(key).isNull() | F.col("__hot").isNotNull(), spread).otherwise(
            F.concat(F.lit("k:"), F.col(key).cast("string"))
        ),
    )
    cold = side.filter(F.col("__key").isNotNull()).withColumn(
        "__build", F.concat(F.lit("k:"), F.col("__key").cast("string"))
    )
    joined = served.join(cold.drop("__key"), F.col("__probe") == F.col("__build"), "left")
    return joined.select(
        *df.columns,
        *[F.coalesce(F.col(f"__hot_{v}"), F.col(v)).alias(v) for v in values],
    )
