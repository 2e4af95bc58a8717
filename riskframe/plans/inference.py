"""Queries for reject inference.

The accept model is a closed-form scorecard here, so that every weight can be
checked; ``learning`` holds the queries with fitted models.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskframe.functions.scorecard import Scorecard
from riskframe.operators import measure, neighbours, rejects
from riskframe.session import cut_lineage
from riskframe.plans.fixtures import (
    applications,
    quantile_list,
    rounded,
    table,
    with_applications,
    with_scored,
)

ACCEPT = Scorecard(1.6, {"amount": -2 / 500000, "balance": 1 / 20000})
ROUNDS = 6


def marked(spark, sf_dir) -> DataFrame:
    """Applications with the label of rejected ones hidden, P(accept) and P(bad)."""
    apps = applications(spark, sf_dir)
    return apps.select(
        "app_id",
        F.when(F.col("rejected") == 1, -1).otherwise(F.col("y")).alias("y"),
        F.round(ACCEPT.expr(), 4).alias("p_accept"),
        F.col("score_a").alias("p_bad"),
        "score_a",
        "score_b",
    )


MARKED = f"""
marked AS (
  SELECT app_id, CASE WHEN rejected = 1 THEN -1 ELSE y END AS y,
    round({ACCEPT.sql()}, 4) AS p_accept, score_a AS p_bad, score_a, score_b
  FROM applications
)"""


def r00(spark, sf_dir):
    """The accept model's target and score for every application."""
    df = marked(spark, sf_dir).select("app_id", "y", "p_accept")
    return rejects.accept_labels(df)


def r01(spark, sf_dir):
    df = marked(spark, sf_dir).select("app_id", "y", "p_accept")
    return rounded(rejects.upward(df), "p_accept")


def r02(spark, sf_dir):
    df = marked(spark, sf_dir).select("app_id", "y", "p_accept")
    return rounded(rejects.downward(df), "p_accept")


def r03(spark, sf_dir):
    df = marked(spark, sf_dir).select("app_id", "y", "p_accept")
    return rounded(rejects.soft_cutoff(df), "p_accept")


def r04(spark, sf_dir):
    df = marked(spark, sf_dir).select("app_id", "y", "p_bad")
    return rounded(rejects.fuzzy_parcels(df), "p_bad")


def r05(mode: str):
    def run(spark, sf_dir):
        df = marked(spark, sf_dir).select("app_id", "y", "p_bad")
        return rejects.extrapolate(df, mode=mode)

    return run


def vectors(spark, sf_dir) -> DataFrame:
    """Embeddings with a binary label known for one row in five."""
    known = F.col("vec_id") % 5 == 0
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        "embedding",
        F.when(known, F.col("label") % 2).otherwise(-1).cast("int").alias("y"),
    )


def r06(spark, sf_dir):
    spread = rejects.label_spreading(
        vectors(spark, sf_dir), "vec_id", "embedding", max_iter=ROUNDS, tol=0.0
    )
    return spread.select("vec_id", "y", "w")


def r06_trees(spark, sf_dir):
    """Thirty rounds at most, over neighbours from projection trees."""
    spread = rejects.label_spreading(vectors(spark, sf_dir), "vec_id", "embedding", recall=0.9)
    return spread.select("vec_id", "y", "w")


def r06_recall(spark, sf_dir):
    """What the trees find of the true neighbours, as properties that hold or not."""
    vecs = vectors(spark, sf_dir)
    distinct = cut_lineage(neighbours.distinct_vectors(vecs, "vec_id", "embedding", 7))
    found, share = neighbours.tree_neighbours(distinct, distinct.count(), 6, 0.9)
    rows = found.groupBy("rep").agg(F.count("*").alias("n"), F.count_if(F.col("rep") == F.col("other")).alias("own"))
    return rows.agg(
        F.lit(share >= 0.9).alias("nine_in_ten_found"),
        (F.count("*") == distinct.count()).alias("each_has_some"),
        (F.max("n") <= 6).alias("six_at_most"),
        (F.sum("own") == 0).alias("none_is_its_own"),
    )


def r07(spark, sf_dir):
    """Kickout of both scorecards at 0.5 against the first one."""
    apps = applications(spark, sf_dir)
    long = measure.scored_long(
        apps.withColumn("base_score", F.col("score_a")),
        ["score_a", "score_b"],
        ["app_id", "y", "base_score"],
    )
    flags = measure.threshold_predictions(long, 0.5).withColumn(
        "base_pred", (F.col("base_score") >= 0.5).cast("int")
    )
    return rounded(rejects.kickout(flags))


def r08(spark, sf_dir):
    df = marked(spark, sf_dir)
    return rounded(rejects.reject_report(df, ["score_a", "score_b"], "score_a", bad_rate=0.25))


def _extrapolated(condition: str) -> str:
    return with_applications(
        MARKED,
        select=f"""SELECT app_id, CASE WHEN y = -1 THEN CAST(p_bad > 0.5 AS INTEGER) ELSE y END AS y,
  p_bad, CAST(1 AS DOUBLE) AS w
FROM marked WHERE y <> -1 OR {condition}""",
    )


def _spreading_sql(rounds: int) -> str:
    steps = []
    for i in range(rounds):
        steps.append(
            f"""
f{i + 1} AS MATERIALIZED (
  SELECT g.id, g.y0, g.y1,
    coalesce(sum(e.weight * f.f0), 0) * 0.2 + g.y0 * 0.8 AS f0,
    coalesce(sum(e.weight * f.f1), 0) * 0.2 + g.y1 * 0.8 AS f1
  FROM given g LEFT JOIN edges e ON e.src = g.id LEFT JOIN f{i} f ON f.id = e.dst
  GROUP BY g.id, g.y0, g.y1
)"""
        )
    return f"""WITH points AS (
  SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v,
    CASE WHEN vec_id % 5 = 0 THEN label % 2 ELSE -1 END AS y
  FROM embeddings
),
ranked AS MATERIALIZED (
  SELECT a.id AS src, b.id AS dst, row_number() OVER (PARTITION BY a.id
    ORDER BY round(list_distance(a.v, b.v), 9), b.id) AS place
  FROM points a, points b WHERE a.id <> b.id
),
listed AS MATERIALIZED (SELECT src, dst FROM ranked WHERE place <= 6),
degree AS (SELECT dst AS id, count(*) AS d FROM listed GROUP BY dst),
edges AS MATERIALIZED (
  SELECT l.src, l.dst, 1.0 / (sqrt(CAST(coalesce(s.d, 1) AS DOUBLE)) * sqrt(CAST(t.d AS DOUBLE))) AS weight
  FROM listed l LEFT JOIN degree s ON s.id = l.src JOIN degree t ON t.id = l.dst
),
given AS MATERIALIZED (
  SELECT id, CASE WHEN y = 0 THEN 1.0 ELSE 0.0 END AS y0, CASE WHEN y = 1 THEN 1.0 ELSE 0.0 END AS y1
  FROM points
),
f0 AS (SELECT id, y0, y1, CAST(y0 AS DOUBLE) AS f0, CAST(y1 AS DOUBLE) AS f1 FROM given),{",".join(steps)}
SELECT id AS vec_id, CASE WHEN f1 > f0 THEN 1 ELSE 0 END AS y, CAST(1 AS DOUBLE) AS w
FROM f{rounds}"""


QUERIES = {
    "r00_accept_model": (
        r00,
        with_applications(
            MARKED,
            select="SELECT app_id, y, p_accept, CASE WHEN y = -1 THEN 0 ELSE 1 END AS accepted "
            "FROM marked",
        ),
    ),
    "r01_upward": (
        r01,
        with_applications(
            MARKED,
            select="SELECT app_id, y, p_accept, round(1.0 / p_accept, 6) AS w FROM marked "
            "WHERE y <> -1",
        ),
    ),
    "r02_downward": (
        r02,
        with_applications(
            MARKED,
            select="SELECT app_id, y, p_accept, round(1.0 - p_accept, 6) AS w FROM marked "
            "WHERE y <> -1",
        ),
    ),
    "r03_soft_cutoff": (
        r03,
        with_applications(
            MARKED,
            f"""
points AS (
  SELECT unnest(range(0, 100)) AS i, round(unnest(cuts), 6) AS low
  FROM (SELECT quantile_cont(p_accept, {quantile_list(100)}) AS cuts FROM marked) q
),
bins AS (SELECT i, low, lead(low) OVER (ORDER BY i) AS high FROM points),
placed AS (
  SELECT m.app_id, b.i, m.y
  FROM marked m JOIN bins b ON m.p_accept >= b.low AND m.p_accept < b.high
),
shares AS (
  SELECT i, avg(CASE WHEN y <> -1 THEN 1.0 ELSE 0.0 END) AS share FROM placed GROUP BY i
)""",
            select="""SELECT m.app_id, m.y, m.p_accept,
  round(coalesce(1.0 / nullif(s.share, 0), 1.0), 6) AS w
FROM marked m LEFT JOIN placed p ON m.app_id = p.app_id LEFT JOIN shares s ON p.i = s.i
WHERE m.y <> -1""",
        ),
    ),
    "r04_fuzzy_parcels": (
        r04,
        with_applications(
            MARKED,
            select="""SELECT app_id, y, p_bad, CAST(1 AS DOUBLE) AS w FROM marked WHERE y <> -1
UNION ALL SELECT app_id, 0, p_bad, round(1.0 - p_bad, 6) FROM marked WHERE y = -1
UNION ALL SELECT app_id, 1, p_bad, round(p_bad, 6) FROM marked WHERE y = -1""",
        ),
    ),
    "r05_extrapolation_positive": (r05("positive"), _extrapolated("p_bad > 0.5")),
    "r05_extrapolation_all": (r05("all"), _extrapolated("true")),
    "r05_extrapolation_confident": (
        r05("confident"),
        _extrapolated("p_bad > 0.8 OR p_bad < 0.15"),
    ),
    "r06_label_spreading": (r06, _spreading_sql(ROUNDS)),
    "r06_label_spreading_by_trees": (r06_trees, None),
    "r06_neighbours_by_trees": (
        r06_recall,
        "SELECT true AS nine_in_ten_found, true AS each_has_some, true AS six_at_most, true AS none_is_its_own",
    ),
    "r07_kickout": (
        r07,
        with_scored(
            select="""SELECT s.model, round(
  avg(CASE WHEN s.score >= 0.5 THEN 1.0 ELSE 0.0 END) FILTER (a.score_a < 0.5 AND s.y = 1)
  - avg(CASE WHEN s.score >= 0.5 THEN 1.0 ELSE 0.0 END) FILTER (a.score_a < 0.5 AND s.y = 0),
  6) + 0.0 AS kickout
FROM scored s JOIN applications a ON s.app_id = a.app_id GROUP BY s.model"""
        ),
    ),
    "r08_reject_report": (
        r08,
        with_applications(
            MARKED,
            """
long AS (
  SELECT 'score_a' AS model, app_id, y, score_a AS score FROM marked
  UNION ALL SELECT 'score_b', app_id, y, score_b FROM marked
),
rates AS (
  SELECT model, score, sum(count(*) FILTER (y = 0)) OVER w * 1.0
    / sum(count(*) FILTER (y = 0)) OVER (PARTITION BY model) AS fpr
  FROM long WHERE y <> -1 GROUP BY model, score
  WINDOW w AS (PARTITION BY model ORDER BY score DESC)
),
cuts AS (
  SELECT model, coalesce(min(score) FILTER (fpr <= 0.25), 0.5) AS threshold
  FROM rates GROUP BY model
),
flagged AS (
  SELECT l.model, l.app_id, l.y, CASE WHEN score >= threshold THEN 1.0 ELSE 0.0 END AS pred
  FROM long l JOIN cuts c ON l.model = c.model
),
based AS (
  SELECT f.*, b.pred AS base_pred
  FROM flagged f JOIN flagged b ON b.model = 'score_a' AND b.app_id = f.app_id
)""",
            select="""SELECT b.model, any_value(threshold) AS threshold,
  round(avg(1.0 - pred), 6) AS approval_rate, round(avg(pred), 6) AS positive_rate,
  round((avg(pred) FILTER (y = 1) + avg(1.0 - pred) FILTER (y = 0)) / 2, 6) AS balanced_accuracy,
  round(avg(pred) FILTER (base_pred = 0 AND y = 1)
        - avg(pred) FILTER (base_pred = 0 AND y = 0), 6) + 0.0 AS kickout
FROM based b JOIN cuts c ON b.model = c.model GROUP BY b.model""",
        ),
    ),
}
