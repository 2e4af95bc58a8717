"""CSV and Parquet applicant tables with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_csv(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    encoding: str = "UTF-8",
    header: bool = True,
    strict: bool = True,
    null_value: str = "",
) -> DataFrame:
    """Read a CSV in the given encoding; no inference and no index column.

    ``strict`` raises on a row that does not fit the schema instead of reading
    nulls.
    """
    return (
        spark.read.schema(schema)
        .option("header", header)
        .option("encoding", encoding)
        .option("mode", "FAILFAST" if strict else "PERMISSIVE")
        .option("nullValue", null_value)
        .csv(path)
    )


def write_prepared(df: DataFrame, path: str, format: str = "parquet", encoding: str = "UTF-8") -> str:
    """Write a prepared table without an index column."""
    writer = df.write.mode("overwrite")
    if format == "csv":
        writer.option("header", True).option("encoding", encoding).csv(path)
    elif format == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format {format!r}")
    return path
