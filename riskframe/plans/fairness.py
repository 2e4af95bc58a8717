"""Queries for the fairness interventions."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import fair
from riskframe.plans.fixtures import applications, quantile_list, rounded, with_applications


def _scored(spark, sf_dir):
    return applications(spark, sf_dir).select("app_id", "y", "z", F.col("score_a").alias("score"))


def e01(spark, sf_dir):
    apps = applications(spark, sf_dir).select("app_id", "z", "y")
    return rounded(fair.reweigh(apps))


def e03(spark, sf_dir):
    return rounded(fair.threshold_search(_scored(spark, sf_dir)))


def e03_signed(spark, sf_dir):
    """Accuracy under a one-sided bound on the equal-opportunity gap."""
    found = fair.threshold_search(
        _scored(spark, sf_dir),
        perf_metric="accuracy",
        fair_metric="equal_opportunity",
        constraint=0.02,
        two_sided=False,
    )
    return rounded(found)


def e04(spark, sf_dir):
    scored = _scored(spark, sf_dir)
    best = fair.threshold_search(scored).first()
    return fair.apply_thresholds(scored, best["threshold_0"], best["threshold_1"])


def _search_sql(perf: str, gap: str) -> str:
    """The grid of threshold pairs, straight from its definition."""
    return f"""
points AS (
  SELECT unnest(range(0, 25)) AS t, round(unnest(cuts), 6) AS cut
  FROM (SELECT quantile_cont(score_a, {quantile_list(25)}) AS cuts FROM applications) q
),
side AS (
  SELECT z, t, any_value(cut) AS cut,
    count(*) FILTER (score_a > cut AND y = 1) AS tp, count(*) FILTER (score_a > cut AND y = 0) AS fp,
    count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n
  FROM applications, points GROUP BY z, t
),
pairs AS (
  SELECT a.cut AS threshold_0, b.cut AS threshold_1, a.t AS i0, b.t AS i1,
    round({perf}, 12) AS perf, {gap} AS gap
  FROM side a, side b WHERE a.z = 0 AND b.z = 1
)"""


BALANCED = "((a.tp + b.tp) * 1.0 / (a.p + b.p) + (a.n + b.n - a.fp - b.fp) * 1.0 / (a.n + b.n)) / 2"
PLAIN = "(a.tp + b.tp + a.n + b.n - a.fp - b.fp) * 1.0 / (a.p + b.p + a.n + b.n)"
DPD = "(b.tp + b.fp) * 1.0 / (b.p + b.n) - (a.tp + a.fp) * 1.0 / (a.p + a.n)"
EOD = "b.tp * 1.0 / b.p - a.tp * 1.0 / a.p"

BEST = _search_sql(BALANCED, DPD) + """,
best AS (
  SELECT * FROM pairs WHERE round(abs(gap), 12) <= 0.05 ORDER BY perf DESC, i0, i1 LIMIT 1
)"""

QUERIES = {
    "e01_reweighing": (
        e01,
        with_applications(
            select="""SELECT app_id, a.z, a.y, round(
  (SELECT count(*) FROM applications b WHERE b.z = a.z) * 1.0
  * (SELECT count(*) FROM applications b WHERE b.y = a.y)
  / (CAST((SELECT count(*) FROM applications) AS DOUBLE) * c.n), 6) AS w
FROM applications a
JOIN (SELECT z, y, count(*) AS n FROM applications GROUP BY z, y) c ON a.z = c.z AND a.y = c.y"""
        ),
    ),
    "e03_group_thresholds": (
        e03,
        with_applications(
            BEST,
            select="SELECT threshold_0, threshold_1, round(perf, 6) AS balanced_accuracy, "
            "round(gap, 6) AS gap, true AS feasible FROM best",
        ),
    ),
    "e03_group_thresholds_signed": (
        e03_signed,
        with_applications(
            _search_sql(PLAIN, EOD),
            select="""SELECT threshold_0, threshold_1, round(perf, 6) AS accuracy,
  round(gap, 6) AS gap, true AS feasible
FROM pairs WHERE round(gap, 12) <= 0.02 ORDER BY perf DESC, i0, i1 LIMIT 1""",
        ),
    ),
    "e04_apply_thresholds": (
        e04,
        with_applications(
            BEST,
            select="""SELECT app_id, y, z, score_a AS score,
  CAST(CASE WHEN z = 0 THEN score_a > threshold_0 ELSE score_a > threshold_1 END AS INTEGER) AS pred
FROM applications, best""",
        ),
    ),
}
