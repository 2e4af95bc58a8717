"""Reproducible pseudo-random numbers computed from the row's own id.

The same id gives the same number whatever the partitioning, so a split or a
sample survives a re-run after an executor is lost. Two generators: one on
``xxhash64`` for any key type, one on plain integer arithmetic that any SQL
engine can repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed values of the arithmetic generator: a prime modulus below 2**31, so
#: that every product stays inside a 64-bit integer.
MODULUS = 2147483647
MULTIPLIER = 48271
INCREMENT = 12345


def hash_unit(key: str | Column, seed: int = 0) -> Column:
    """Uniform double in [0, 1) from any key."""
    column = F.col(key) if isinstance(key, str) else key
    bits = F.pmod(F.xxhash64(column, F.lit(seed)), F.lit(1 << 53))
    return bits.cast("double") / F.lit(float(1 << 53))


def arithmetic_rank(key: str | Column, seed: int = 0) -> Column:
    """Integer in [0, MODULUS): two rounds of a Lehmer generator on the key.

    Integers, also negative and huge ones, are first brought into the range; keys
    that are no integers (and null) enter by their hash.
    """
    column = F.col(key) if isinstance(key, str) else key
    hashed = F.pmod(F.xxhash64(column.cast("string")), F.lit(MODULUS))
    start = F.coalesce(F.pmod(column.try_cast("bigint"), F.lit(MODULUS)), hashed)
    first = ((start + F.lit(seed + 1)) % MODULUS * MULTIPLIER + INCREMENT) % MODULUS
    return (first * MULTIPLIER + INCREMENT) % MODULUS


def arithmetic_rank_sql(key: str, seed: int = 0) -> str:
    """SQL text of :func:`arithmetic_rank` for an integer key."""
    start = f"((({key}) % {MODULUS} + {MODULUS}) % {MODULUS})"
    first = f"(({start} + {seed + 1}) % {MODULUS} * {MULTIPLIER} + {INCREMENT}) % {MODULUS}"
    return f"(({first}) * {MULTIPLIER} + {INCREMENT}) % {MODULUS}"
