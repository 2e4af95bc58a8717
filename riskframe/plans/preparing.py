"""Queries for reading, recoding, splitting and sampling applicant tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.functions.hashing import arithmetic_rank_sql
from riskframe.operators import prep
from riskframe.plans.fixtures import applications, table, with_applications
from riskframe.session import scratch_path
from riskframe.sources.datasets import Registry
from riskframe.sources.tables import read_csv, write_prepared

CUSTOMER_CSV = "c_custkey bigint, c_label string, c_acctbal double, c_mktsegment string"
ACCENTED = "Crédit "
GRADES = {"1-URGENT": "High", "2-HIGH": "High", "3-MEDIUM": "Medium", "5-LOW": "Low"}
SEGMENT_KIND = {"AUTOMOBILE": "Industry", "MACHINERY": "Industry", "BUILDING": "Construction"}
QUOTAS = {0: 1200, 1: 1800}


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.concat(F.lit(ACCENTED), F.col("c_name")).alias("c_label"),
        "c_acctbal",
        "c_mktsegment",
    )


def s01(spark, sf_dir):
    path = scratch_path(spark, "latin1")
    write_prepared(_customers(spark, sf_dir), path, "csv", encoding="ISO-8859-1")
    return read_csv(spark, path, CUSTOMER_CSV, encoding="ISO-8859-1")


def s02(spark, sf_dir):
    path = scratch_path(spark, "titled")
    write_prepared(_customers(spark, sf_dir), path, "csv")
    raw = read_csv(spark, path, "X0 string, X1 string, X2 string, X3 string", header=False)
    titles = ["c_custkey", "c_label", "c_acctbal", "c_mktsegment"]
    named = prep.promote_header(raw, {f"X{i}": t for i, t in enumerate(titles)})
    return named.select(
        F.col("c_custkey").cast("bigint"),
        "c_label",
        F.col("c_acctbal").cast("double"),
        "c_mktsegment",
    )


def s03(spark, sf_dir):
    return prep.drop_and_rename(
        applications(spark, sf_dir),
        ["cust_id", "nation", "app_date", "score_a", "score_b"],
        {"y": "DEFAULT", "segment": "sector"},
    )


def s04(spark, sf_dir):
    apps = applications(spark, sf_dir).select("app_id", "amount", "balance", "z", "y")
    texts = apps.select("app_id", *[F.col(c).cast("string").alias(c) for c in apps.columns[1:]])
    return prep.cast_all(texts, keep=["app_id"])


def s05(spark, sf_dir):
    apps = applications(spark, sf_dir).select("app_id", "priority")
    return prep.recode(apps, "priority", GRADES, out="grade")


def s06(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return prep.recode_binary(orders, "o_orderstatus", "F", out="closed")


def s07(spark, sf_dir):
    apps = applications(spark, sf_dir).select("app_id", "segment")
    return prep.derive_sensitive(apps, "segment", SEGMENT_KIND, "Industry", label="kind", out="a")


def s09(spark, sf_dir):
    path = scratch_path(spark, "prepared")
    apps = applications(spark, sf_dir).select("app_id", "amount", "segment", "y")
    write_prepared(apps, path, "csv")
    return read_csv(spark, path, "app_id bigint, amount double, segment string, y int")


def s10(spark, sf_dir):
    apps = applications(spark, sf_dir).select(
        "app_id", "amount", "balance", "segment", "z", F.col("y").alias("DEFAULT")
    )
    registry = Registry()
    path = scratch_path(spark, "registered")
    registry.store("applications", apps, path, id="app_id", sensitive="z")
    df, spec = registry.load(spark, "applications")
    return df.select(spec.id, *spec.features, spec.sensitive, spec.label)


def s11(spark, sf_dir):
    apps = applications(spark, sf_dir).select("app_id", "y")
    return prep.holdout_split(apps, "app_id", test=0.2, valid=0.25, seed=42)


def s12(spark, sf_dir):
    apps = applications(spark, sf_dir).select("app_id", "y")
    return prep.stratified_folds(apps, "app_id", "y", folds=5, seed=7)


def s13(spark, sf_dir):
    apps = applications(spark, sf_dir).select("app_id", "z")
    return prep.quota_sample(apps, "app_id", "z", QUOTAS, seed=3)


def s14(spark, sf_dir):
    apps = applications(spark, sf_dir).select("app_id", "amount", "y", "rejected")
    accepted = apps.filter("rejected = 0").drop("rejected")
    return prep.append_unlabeled(accepted, apps.filter("rejected = 1").drop("rejected"))


def s11_signed(spark, sf_dir):
    """Negative and huge ids."""
    apps = applications(spark, sf_dir).select(F.expr(SIGNED_SQL).alias("app_id"), "y")
    return prep.holdout_split(apps, "app_id", test=0.2, valid=0.25, seed=42)


def s15_signed(spark, sf_dir):
    apps = applications(spark, sf_dir).select(F.expr(SIGNED_SQL).alias("app_id"), "amount", "balance")
    return prep.hash_sample(apps, "app_id", 100, seed=11)


def s15(spark, sf_dir):
    apps = applications(spark, sf_dir).select("app_id", "amount", "balance")
    return prep.hash_sample(apps, "app_id", 100, seed=11)


def _case(column: str, mapping: dict) -> str:
    arms = " ".join(f"WHEN {column} = '{code}' THEN '{label}'" for code, label in mapping.items())
    return f"CASE {arms} END"


SIGNED_SQL = "CASE WHEN app_id % 2 = 0 THEN -app_id ELSE 9223372036854775807 - app_id END"

CUSTOMER_SQL = (
    f"SELECT c_custkey, '{ACCENTED}' || c_name AS c_label, c_acctbal, c_mktsegment FROM customer"
)

QUERIES = {
    "s01_read_csv": (s01, CUSTOMER_SQL),
    "s02_promote_header": (s02, CUSTOMER_SQL),
    "s03_drop_rename": (
        s03,
        with_applications(
            select='SELECT app_id, amount, balance, segment AS sector, priority, z, '
            'y AS "DEFAULT", rejected FROM applications'
        ),
    ),
    "s04_cast_all": (
        s04,
        with_applications(
            select="SELECT app_id, amount, balance, CAST(z AS DOUBLE) AS z, "
            "CAST(y AS DOUBLE) AS y FROM applications"
        ),
    ),
    "s05_recode": (
        s05,
        with_applications(
            select=f"SELECT app_id, priority, {_case('priority', GRADES)} AS grade "
            "FROM applications"
        ),
    ),
    "s06_recode_binary": (
        s06,
        "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END "
        "AS closed FROM orders",
    ),
    "s07_sensitive_attribute": (
        s07,
        with_applications(
            select=f"""SELECT app_id, segment, kind,
  CAST(CASE WHEN kind = 'Industry' THEN 1 ELSE 0 END AS INTEGER) AS a
FROM (SELECT app_id, segment, {_case('segment', SEGMENT_KIND)} AS kind FROM applications) t"""
        ),
    ),
    "s09_write_prepared": (
        s09,
        with_applications(select="SELECT app_id, amount, segment, y FROM applications"),
    ),
    "s10_load_by_name": (
        s10,
        with_applications(
            select='SELECT app_id, amount, balance, segment, z, y AS "DEFAULT" FROM applications'
        ),
    ),
    "s11_holdout_split": (
        s11,
        with_applications(
            select=f"""SELECT app_id, y,
  CASE WHEN draw < 2000 THEN 'test' WHEN draw < 4000 THEN 'valid' ELSE 'train' END AS part
FROM (SELECT app_id, y, ({arithmetic_rank_sql('app_id', 42)}) % 10000 AS draw
      FROM applications) t"""
        ),
    ),
    "s12_stratified_folds": (
        s12,
        with_applications(
            select=f"""SELECT app_id, y, CAST((row_number() OVER (PARTITION BY y
    ORDER BY {arithmetic_rank_sql('app_id', 7)}, app_id) - 1) % 5 AS INTEGER) AS fold
FROM applications"""
        ),
    ),
    "s13_quota_sample": (
        s13,
        with_applications(
            select=f"""SELECT app_id, z, row_number() OVER (PARTITION BY z
    ORDER BY {arithmetic_rank_sql('app_id', 3)}, app_id)
  <= CASE WHEN z = 0 THEN {QUOTAS[0]} ELSE {QUOTAS[1]} END AS picked
FROM applications"""
        ),
    ),
    "s14_append_unlabeled": (
        s14,
        with_applications(
            select="SELECT app_id, amount, CASE WHEN rejected = 1 THEN -1 ELSE y END AS y "
            "FROM applications"
        ),
    ),
    "s11_holdout_split_signed": (
        s11_signed,
        with_applications(
            select=f"""SELECT app_id, y,
  CASE WHEN draw < 2000 THEN 'test' WHEN draw < 4000 THEN 'valid' ELSE 'train' END AS part
FROM (SELECT app_id, y, ({arithmetic_rank_sql('app_id', 42)}) % 10000 AS draw
      FROM (SELECT {SIGNED_SQL} AS app_id, y FROM applications) s) t"""
        ),
    ),
    "s15_hash_sample_signed": (
        s15_signed,
        with_applications(
            select=f"""SELECT app_id, amount, balance
FROM (SELECT {SIGNED_SQL} AS app_id, amount, balance FROM applications) t
ORDER BY {arithmetic_rank_sql('app_id', 11)}, app_id LIMIT 100"""
        ),
    ),
    "s15_hash_sample": (
        s15,
        with_applications(
            select=f"""SELECT app_id, amount, balance FROM applications
ORDER BY {arithmetic_rank_sql('app_id', 11)}, app_id LIMIT 100"""
        ),
    ),
}
