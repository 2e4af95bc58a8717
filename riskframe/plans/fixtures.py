"""The shared inputs: the ``applications`` view and its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskframe.functions.scorecard import Scorecard


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order seen as a loan application."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    base = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").alias("app_id"),
            F.col("o_custkey").alias("cust_id"),
            F.col("o_totalprice").alias("amount"),
            F.col("c_acctbal").alias("balance"),
            F.col("c_mktsegment").alias("segment"),
            F.col("o_orderpriority").alias("priority"),
            F.col("n_name").alias("nation"),
            F.col("o_orderdate").alias("app_date"),
            F.when(F.col("c_mktsegment").isin("AUTOMOBILE", "MACHINERY"), 1)
            .otherwise(0)
            .alias("z"),
            (((F.col("o_orderkey") * 7919) % 1000).cast("double") / F.lit(1000.0)).alias("noise"),
        )
    )
    amount, noise, z = F.col("amount"), F.col("noise"), F.col("z")
    risk = F.lit(0.5) * amount / 500000 + F.lit(0.4) * noise + F.lit(0.05) * z
    return base.select(
        "app_id",
        "cust_id",
        "amount",
        "balance",
        "segment",
        "priority",
        "nation",
        "app_date",
        "z",
        F.when(risk > 0.55, 1).otherwise(0).alias("y"),
        F.when((F.col("app_id") * 31) % 10 >= 8, 1).otherwise(0).alias("rejected"),
        F.round(1 / (1 + F.exp(-(4 * amount / 500000 - 2.2 + F.lit(0.3) * z))), 4).alias("score_a"),
        F.round(
            1 / (1 + F.exp(-(3 * amount / 500000 - F.col("balance") / 20000 - 1.5))), 4
        ).alias("score_b"),
    )


APPLICATIONS = """
applications AS (
  SELECT app_id, cust_id, amount, balance, segment, priority, nation, app_date, z,
    CASE WHEN CAST(0.5 AS DOUBLE)*amount/500000 + CAST(0.4 AS DOUBLE)*noise
              + CAST(0.05 AS DOUBLE)*z > 0.55 THEN 1 ELSE 0 END AS y,
    CASE WHEN (app_id*31) % 10 >= 8 THEN 1 ELSE 0 END AS rejected,
    round(1/(1+exp(-(4*amount/500000 - 2.2 + 0.3*z))),4) AS score_a,
    round(1/(1+exp(-(3*amount/500000 - balance/20000 - 1.5))),4) AS score_b
  FROM (
    SELECT o_orderkey AS app_id, o_custkey AS cust_id, o_totalprice AS amount,
      c_acctbal AS balance, c_mktsegment AS segment, o_orderpriority AS priority,
      n_name AS nation, o_orderdate AS app_date,
      CASE WHEN c_mktsegment IN ('AUTOMOBILE','MACHINERY') THEN 1 ELSE 0 END AS z,
      CAST((o_orderkey*7919) % 1000 AS DOUBLE)/CAST(1000 AS DOUBLE) AS noise
    FROM orders JOIN customer ON o_custkey = c_custkey
                JOIN nation   ON c_nationkey = n_nationkey) b
)"""

SCORED = """
scored AS (
  SELECT 'score_a' AS model, app_id, y, z, score_a AS score FROM applications
  UNION ALL
  SELECT 'score_b' AS model, app_id, y, z, score_b AS score FROM applications
)"""


def with_applications(*ctes: str, select: str) -> str:
    """A query over ``applications`` and further common table expressions."""
    return "WITH " + ",".join([APPLICATIONS, *ctes]) + "\n" + select


def with_scored(*ctes: str, select: str) -> str:
    return with_applications(SCORED, *ctes, select=select)


def quantile_list(points: int) -> str:
    """SQL list of evenly spaced probabilities from 0 to 1."""
    return "[" + ", ".join(repr(i / (points - 1)) for i in range(points)) + "]"


def rounded(df: DataFrame, *keep: str, digits: int = 6) -> DataFrame:
    """Round every double outside ``keep`` and drop the sign of zero."""
    out = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if field.dataType.simpleString() == "double" and field.name not in keep:
            column = (F.round(column, digits) + F.lit(0.0)).alias(field.name)
        out.append(column)
    return df.select(*out)


#: Scorecards of the explanation queries.
CARD = Scorecard(-1.5, {"amount": 3 / 500000, "balance": -1 / 20000})
CARD_Z = Scorecard(-1.7, {"amount": 3 / 500000, "balance": -1 / 20000, "z": 0.4})
