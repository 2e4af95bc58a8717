"""Queries for metrics, cut-offs and fairness reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskframe.functions.ordering import range_bounds, running_totals
from riskframe.operators import measure
from riskframe.plans.fixtures import applications, rounded, with_scored


def scored(spark, sf_dir) -> DataFrame:
    """Both scorecards over all applications, one row per (model, application)."""
    apps = applications(spark, sf_dir)
    return measure.scored_long(apps, ["score_a", "score_b"], ["app_id", "y", "z"])


def predicted(spark, sf_dir) -> DataFrame:
    return measure.threshold_predictions(scored(spark, sf_dir), 0.5)


CELLS = """
cells AS (
  SELECT model,
    CAST(count(*) FILTER (score >= 0.5 AND y = 1) AS BIGINT) AS tp,
    CAST(count(*) FILTER (score >= 0.5 AND y = 0) AS BIGINT) AS fp,
    CAST(count(*) FILTER (score < 0.5 AND y = 0) AS BIGINT) AS tn,
    CAST(count(*) FILTER (score < 0.5 AND y = 1) AS BIGINT) AS fn
  FROM scored GROUP BY model
)"""

GROUPS = """
groups AS (
  SELECT model,
    avg(CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END) FILTER (z = 1) AS share1,
    avg(CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END) FILTER (z = 0) AS share0,
    avg(CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END) FILTER (z = 1 AND y = 1) AS tpr1,
    avg(CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END) FILTER (z = 0 AND y = 1) AS tpr0,
    avg(CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END) FILTER (z = 1 AND y = 0) AS fpr1,
    avg(CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END) FILTER (z = 0 AND y = 0) AS fpr0,
    avg(CAST(y AS DOUBLE)) FILTER (z = 1 AND score >= 0.5) AS ppv1,
    avg(CAST(y AS DOUBLE)) FILTER (z = 0 AND score >= 0.5) AS ppv0,
    avg(CAST(y AS DOUBLE)) FILTER (z = 1 AND score < 0.5) AS fom1,
    avg(CAST(y AS DOUBLE)) FILTER (z = 0 AND score < 0.5) AS fom0,
    avg(CASE WHEN (score >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) FILTER (z = 1) AS acc1,
    avg(CASE WHEN (score >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) FILTER (z = 0) AS acc0
  FROM scored GROUP BY model
)"""

CURVE = """
steps AS (
  SELECT model, score,
    CAST(count(*) FILTER (y = 1) AS BIGINT) AS pos,
    CAST(count(*) FILTER (y = 0) AS BIGINT) AS neg
  FROM scored GROUP BY model, score
),
curve AS (
  SELECT model, score, pos, neg,
    CAST(sum(pos) OVER w AS BIGINT) AS pos_above,
    CAST(sum(neg) OVER w AS BIGINT) AS neg_above
  FROM steps
  WINDOW w AS (PARTITION BY model ORDER BY score DESC
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
sizes AS (
  SELECT model, CAST(sum(pos) AS DOUBLE) AS p, CAST(sum(neg) AS DOUBLE) AS n
  FROM steps GROUP BY model
)"""

AUC = """
aucs AS (
  SELECT c.model, 1 - sum(pos * (neg_above - neg / 2.0)) / (any_value(p) * any_value(n)) AS auc
  FROM curve c JOIN sizes s ON c.model = s.model GROUP BY c.model
)"""

KS = """
ks AS (
  SELECT model, score AS threshold, gap AS ks FROM (
    SELECT c.model, score, round(pos_above / p - neg_above / n, 12) AS gap,
      row_number() OVER (PARTITION BY c.model
        ORDER BY round(pos_above / p - neg_above / n, 12) DESC, score DESC) AS place
    FROM curve c JOIN sizes s ON c.model = s.model) ranked
  WHERE place = 1
)"""

LABEL_METRICS = """
    round((tp * 1.0 / (tp + fn) + tn * 1.0 / (tn + fp)) / 2, 6) AS balanced_accuracy,
    round((tp + tn) * 1.0 / (tp + fp + tn + fn), 6) AS accuracy,
    round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp * 1.0 / (tp + fp) END, 6) AS precision,
    round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp * 1.0 / (tp + fn) END, 6) AS recall,
    round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0
               ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1"""


def _from_cells(expression: str, name: str) -> str:
    return with_scored(CELLS, select=f"SELECT model, round({expression}, 6) AS {name} FROM cells")


def _from_groups(expression: str, name: str) -> str:
    return with_scored(
        GROUPS, select=f"SELECT model, round({expression}, 6) + 0.0 AS {name} FROM groups"
    )


def m00(spark, sf_dir):
    return measure.confusion_counts(predicted(spark, sf_dir), ["model", "z"])


def m01(spark, sf_dir):
    return rounded(measure.roc_auc(scored(spark, sf_dir)))


def m02(spark, sf_dir):
    return rounded(measure.brier_score(scored(spark, sf_dir)))


def m03(spark, sf_dir):
    return rounded(measure.balanced_accuracy(predicted(spark, sf_dir)))


def m04(spark, sf_dir):
    return rounded(measure.accuracy(predicted(spark, sf_dir)))


def m05(spark, sf_dir):
    return rounded(measure.precision(predicted(spark, sf_dir)))


def m06(spark, sf_dir):
    return rounded(measure.recall(predicted(spark, sf_dir)))


def m07(spark, sf_dir):
    return rounded(measure.f1(predicted(spark, sf_dir)))


def m08(spark, sf_dir):
    rows = scored(spark, sf_dir)
    bounds, _ = range_bounds(rows, "score")
    cutoffs = measure.ks_cutoff(rows, bounds)
    return rounded(measure.comparison_report(rows, cutoffs, bounds=bounds))


def m09(spark, sf_dir):
    return rounded(measure.ks_cutoff(scored(spark, sf_dir)))


def m10(spark, sf_dir):
    return rounded(measure.fpr_cutoff(scored(spark, sf_dir), 0.25))


def m11(spark, sf_dir):
    return rounded(measure.false_positive_rate(predicted(spark, sf_dir), ["model", "z"]))


def m12(spark, sf_dir):
    return rounded(measure.demographic_parity(predicted(spark, sf_dir)))


def m13(spark, sf_dir):
    return rounded(measure.equal_opportunity(predicted(spark, sf_dir)))


def m14(spark, sf_dir):
    return rounded(measure.average_odds(predicted(spark, sf_dir)))


def m15(spark, sf_dir):
    return rounded(measure.average_predictive_value(predicted(spark, sf_dir)))


def m16(spark, sf_dir):
    return rounded(measure.geometric_mean_accuracy(predicted(spark, sf_dir)))


def m17(spark, sf_dir):
    return rounded(measure.fairness_report(predicted(spark, sf_dir)))


def m18(spark, sf_dir):
    return rounded(measure.eod_scorer(benefit_class=0)(predicted(spark, sf_dir)))


def m19(spark, sf_dir):
    return rounded(measure.fairness_scorer(0.05)(predicted(spark, sf_dir)))


def x01(spark, sf_dir):
    """Running count and running bad count over the exact amount."""
    apps = applications(spark, sf_dir)
    counts = apps.groupBy("amount").agg(
        F.count("*").alias("n"), F.sum("y").alias("bad")
    )
    bounds, _ = range_bounds(apps, "amount")
    return running_totals(counts, "amount", {"n": "n_upto", "bad": "bad_upto"}, bounds=bounds)


QUERIES = {
    "m00_confusion_counts": (
        m00,
        with_scored(
            select="""SELECT model, z,
  CAST(count(*) FILTER (score >= 0.5 AND y = 1) AS BIGINT) AS tp,
  CAST(count(*) FILTER (score >= 0.5 AND y = 0) AS BIGINT) AS fp,
  CAST(count(*) FILTER (score < 0.5 AND y = 0) AS BIGINT) AS tn,
  CAST(count(*) FILTER (score < 0.5 AND y = 1) AS BIGINT) AS fn
FROM scored GROUP BY model, z"""
        ),
    ),
    "m01_auc": (m01, with_scored(CURVE, AUC, select="SELECT model, round(auc, 6) AS auc FROM aucs")),
    "m02_brier": (
        m02,
        with_scored(
            select="SELECT model, round(avg((score - y) * (score - y)), 6) AS brier "
            "FROM scored GROUP BY model"
        ),
    ),
    "m03_balanced_accuracy": (
        m03,
        _from_cells("(tp * 1.0 / (tp + fn) + tn * 1.0 / (tn + fp)) / 2", "balanced_accuracy"),
    ),
    "m04_accuracy": (m04, _from_cells("(tp + tn) * 1.0 / (tp + fp + tn + fn)", "accuracy")),
    "m05_precision": (
        m05,
        _from_cells("CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp * 1.0 / (tp + fp) END", "precision"),
    ),
    "m06_recall": (
        m06,
        _from_cells("CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp * 1.0 / (tp + fn) END", "recall"),
    ),
    "m07_f1": (m07, _from_cells("2.0 * tp / (2 * tp + fp + fn)", "f1")),
    "m08_comparison_report": (
        m08,
        with_scored(
            CURVE,
            AUC,
            KS,
            """
cut AS (
  SELECT s.model, s.y, s.score, CASE WHEN s.score >= k.threshold THEN 1 ELSE 0 END AS pred
  FROM scored s JOIN ks k ON s.model = k.model
),
quads AS (
  SELECT model,
    count(*) FILTER (pred = 1 AND y = 1) AS tp, count(*) FILTER (pred = 1 AND y = 0) AS fp,
    count(*) FILTER (pred = 0 AND y = 0) AS tn, count(*) FILTER (pred = 0 AND y = 1) AS fn,
    avg((score - y) * (score - y)) AS brier
  FROM cut GROUP BY model
)""",
            select=f"""SELECT q.model, round(auc, 6) AS auc, round(brier, 6) AS brier,{LABEL_METRICS}
FROM quads q JOIN aucs a ON q.model = a.model""",
        ),
    ),
    "m09_ks_cutoff": (
        m09,
        with_scored(
            CURVE, KS, select="SELECT model, threshold, round(ks, 6) AS ks FROM ks"
        ),
    ),
    "m10_fpr_cutoff": (
        m10,
        with_scored(
            CURVE,
            select="""SELECT c.model,
  coalesce(min(CASE WHEN neg_above / n <= 0.25 THEN score END), 0.5) AS threshold
FROM curve c JOIN sizes s ON c.model = s.model GROUP BY c.model""",
        ),
    ),
    "m11_false_positive_rate": (
        m11,
        with_scored(
            select="""SELECT model, z,
  round(count(*) FILTER (score >= 0.5 AND y = 0) * 1.0 / count(*) FILTER (y = 0), 6) AS fpr
FROM scored GROUP BY model, z"""
        ),
    ),
    "m12_demographic_parity": (m12, _from_groups("share1 - share0", "dpd")),
    "m13_equal_opportunity": (m13, _from_groups("tpr1 - tpr0", "eod")),
    "m14_average_odds": (m14, _from_groups("((tpr1 - tpr0) + (fpr1 - fpr0)) / 2", "aod")),
    "m15_average_predictive_value": (
        m15,
        _from_groups("((ppv1 - ppv0) + (fom1 - fom0)) / 2", "apvd"),
    ),
    "m16_geometric_mean_accuracy": (m16, _from_groups("sqrt(acc1 * acc0)", "gma")),
    "m17_fairness_report": (
        m17,
        with_scored(
            CELLS,
            GROUPS,
            select="""SELECT g.model,
  round(share1 - share0, 6) + 0.0 AS dpd,
  round(tpr1 - tpr0, 6) + 0.0 AS eod,
  round(((tpr1 - tpr0) + (fpr1 - fpr0)) / 2, 6) + 0.0 AS aod,
  round(((ppv1 - ppv0) + (fom1 - fom0)) / 2, 6) + 0.0 AS apvd,
  round(sqrt(acc1 * acc0), 6) AS gma,
  round((tp * 1.0 / (tp + fn) + tn * 1.0 / (tn + fp)) / 2, 6) AS balanced_accuracy
FROM groups g JOIN cells c ON g.model = c.model""",
        ),
    ),
    "m18_equal_opportunity_scorer": (
        m18,
        with_scored(
            select="""SELECT model, round(
  avg(CASE WHEN score < 0.5 THEN 1.0 ELSE 0.0 END) FILTER (z = 1 AND y = 0)
  - avg(CASE WHEN score < 0.5 THEN 1.0 ELSE 0.0 END) FILTER (z = 0 AND y = 0), 6) + 0.0 AS value
FROM scored GROUP BY model"""
        ),
    ),
    "m19_fairness_scorer": (
        m19,
        with_scored(
            CURVE,
            AUC,
            GROUPS,
            select="""SELECT a.model, round(CASE WHEN abs(tpr1 - tpr0) <= 0.05 THEN auc
  ELSE auc - 10 * (abs(tpr1 - tpr0) - 0.05) END, 6) AS value
FROM aucs a JOIN groups g ON a.model = g.model""",
        ),
    ),
    "x01_running_totals": (
        x01,
        with_scored(
            select="""SELECT amount, CAST(n AS BIGINT) AS n, CAST(bad AS BIGINT) AS bad,
  CAST(sum(n) OVER (ORDER BY amount) AS BIGINT) AS n_upto,
  CAST(sum(bad) OVER (ORDER BY amount) AS BIGINT) AS bad_upto
FROM (SELECT amount, count(*) AS n, sum(y) AS bad FROM applications GROUP BY amount) t"""
        ),
    ),
}
