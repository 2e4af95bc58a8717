"""Queries for explanations and counterfactuals of closed-form scorecards."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, functions as F

from riskframe.functions.hashing import arithmetic_rank_sql
from riskframe.functions.scorecard import Scorecard
from riskframe.operators import counterfactual, donors, explain
from riskframe.operators.explain import LocalSurrogate
from riskframe.operators.features import numeric_stats
from riskframe.plans.fixtures import CARD, CARD_Z, applications, rounded, with_applications

BACKGROUND = 100
SEED = 5
STEP = 0.05
#: Mean scaled distance between two counterfactuals of a row, at least.
APART = 0.25
#: Rows with z = 1 are bad by far, whatever they borrow.
CARD_FAR = Scorecard(-1.7, {"amount": 3 / 500000, "balance": -1 / 20000, "z": 9.0})


def _apps(spark, sf_dir) -> DataFrame:
    return applications(spark, sf_dir).select("app_id", "amount", "balance", "z", "segment")


def g01(spark, sf_dir):
    return rounded(explain.partial_dependence(_apps(spark, sf_dir), CARD, ["amount"]))


def g01_levels(spark, sf_dir):
    """A feature with few values is evaluated at exactly those."""
    return rounded(explain.partial_dependence(_apps(spark, sf_dir), CARD_Z, ["z"]))


def g02(spark, sf_dir):
    return rounded(explain.partial_dependence(_apps(spark, sf_dir), CARD, ["amount", "balance"]))


def g03(spark, sf_dir):
    curves = explain.individual_curves(_apps(spark, sf_dir), CARD, "app_id", "amount", rebase=True)
    return rounded(curves)


def g04(spark, sf_dir):
    return rounded(explain.quantile_rug(_apps(spark, sf_dir), ["amount", "balance"]))


def effects(spark, sf_dir, method: str = "prob") -> DataFrame:
    apps = _apps(spark, sf_dir)
    background = explain.background_rows(apps, CARD_Z, "app_id", BACKGROUND, SEED)
    return explain.shapley_values(apps, CARD_Z, "app_id", background, method=method)


def g05(spark, sf_dir):
    return rounded(effects(spark, sf_dir))


def g05_pred(spark, sf_dir):
    return rounded(effects(spark, sf_dir, method="pred"))


def g06(spark, sf_dir):
    return rounded(explain.global_importance(effects(spark, sf_dir), "app_id"))


def g06_top(spark, sf_dir):
    return rounded(explain.global_importance(effects(spark, sf_dir), "app_id", top=2, by="median"))


def g07(spark, sf_dir):
    apps = _apps(spark, sf_dir).select(
        "app_id",
        F.col("amount").alias("raw_amount"),
        F.col("balance").alias("raw_balance"),
        F.when(F.col("z") == 1, "industrial buyer").otherwise("household").alias("raw_z"),
    )
    wide = effects(spark, sf_dir).join(apps, "app_id")
    best = explain.local_factors(
        wide,
        "app_id",
        top=2,
        numeric={"amount": F.col("raw_amount"), "balance": F.col("raw_balance")},
        labels={"z": F.col("raw_z")},
    )
    return rounded(best)


def surrogate(apps: DataFrame) -> LocalSurrogate:
    stats = numeric_stats(apps, CARD.features)
    return LocalSurrogate(CARD, stats, n_samples=1000, seed=SEED)


def g08(spark, sf_dir):
    apps = _apps(spark, sf_dir)
    return rounded(surrogate(apps).explain(apps, "app_id"))


def _changes(criterion: str, step: float, max_changes: int = 2):
    def run(spark, sf_dir):
        apps = _apps(spark, sf_dir)
        grid = counterfactual.action_grid(apps, ["amount", "balance"], step)
        found = counterfactual.minimal_changes(
            apps,
            CARD,
            "app_id",
            grid,
            target=0,
            max_changes=max_changes,
            criterion=criterion,
            step_size=step,
        )
        return rounded(found)

    return run


def borrowed(spark, sf_dir, scorer=CARD_Z) -> DataFrame:
    """Diverse counterfactuals of every fiftieth application, from all applications."""
    apps = _apps(spark, sf_dir)
    features = ["amount", "balance"]
    scales = counterfactual.median_deviations(apps, features)
    asked = apps.filter(F.col("app_id") % 50 == 0)
    return donors.search_counterfactuals(apps, scorer, "app_id", features, scales, n_cfs=3, apart=APART, queries=asked)


def g10(spark, sf_dir):
    return rounded(borrowed(spark, sf_dir))


def g10_unsolved(spark, sf_dir):
    """A scorecard under which no application of one group can be flipped."""
    return rounded(borrowed(spark, sf_dir, CARD_FAR))


def g12(spark, sf_dir):
    """Copies ranked by cost alone: any two different donors are far enough apart."""
    apps = _apps(spark, sf_dir)
    scales = counterfactual.median_deviations(apps, ["amount", "balance"])
    asked = apps.filter(F.col("app_id") % 50 == 0)
    found = donors.search_counterfactuals(
        apps, CARD_Z, "app_id", ["amount", "balance"], scales, n_cfs=3, apart=0.0, queries=asked
    )
    return rounded(found)


def g11(spark, sf_dir):
    apps = _apps(spark, sf_dir)
    table = counterfactual.comparison_table(
        apps, borrowed(spark, sf_dir).filter("cf_rank > 0"), "app_id", "cf_rank", ["amount", "balance"]
    )
    return rounded(table)


# -- SQL twins ---------------------------------------------------------------------


def _grid_sql(feature: str, resolution: int) -> str:
    """Evenly spaced points between the two outer quantiles of a feature."""
    return f"""
ordered_{feature} AS (
  SELECT {feature} AS v, row_number() OVER (ORDER BY {feature}) AS i,
    count(*) OVER () AS n FROM applications
),
outer_{feature} AS (
  SELECT any_value(n * 0.05 + 0.4 + 0.2 * 0.05) AS low, any_value(n * 0.95 + 0.4 + 0.2 * 0.95) AS high
  FROM ordered_{feature}
),
ends_{feature} AS (
  SELECT
    sum(v * (1 - (low - floor(low)))) FILTER (i = floor(low))
      + sum(v * (low - floor(low))) FILTER (i = floor(low) + 1) AS first,
    sum(v * (1 - (high - floor(high)))) FILTER (i = floor(high))
      + sum(v * (high - floor(high))) FILTER (i = floor(high) + 1) AS last
  FROM ordered_{feature}, outer_{feature}
),
grid_{feature} AS (
  SELECT k, first + (last - first) / {resolution - 1} * k AS g
  FROM ends_{feature}, (SELECT unnest(range(0, {resolution})) AS k) r
)"""


def _effects_sql(threshold: float | None = None) -> str:
    """Exact Shapley values of three features against the background sample."""
    def worth(own: tuple[str, ...]) -> str:
        score = CARD_Z.sql({f: (f"a.{f}" if f in own else f"b.{f}") for f in CARD_Z.features})
        if threshold is not None:
            score = f"CASE WHEN {score} > {threshold} THEN 1.0 ELSE 0.0 END"
        return f"avg({score})"

    names = ("amount", "balance", "z")
    cells = []
    for size in range(4):
        for own in itertools.combinations(names, size):
            cells.append(f"{worth(own)} AS v_{''.join(f[0] for f in own)}")

    def phi(f: str) -> str:
        g, h = [n[0] for n in names if n != f]
        both = "".join(n[0] for n in names if n != f)
        one = f[0]
        pair_g = "".join(sorted([one, g], key="abz".index))
        pair_h = "".join(sorted([one, h], key="abz".index))
        return (
            f"(v_{one} - v_) / 3 + (v_{pair_g} - v_{g}) / 6 + (v_{pair_h} - v_{h}) / 6 "
            f"+ (v_abz - v_{both}) / 3 AS {f}"
        )

    return f"""
background AS (
  SELECT amount, balance, z FROM applications
  ORDER BY {arithmetic_rank_sql('app_id', SEED)}, app_id LIMIT {BACKGROUND}
),
worth AS (
  SELECT a.app_id, {", ".join(cells)}
  FROM applications a, background b GROUP BY a.app_id
),
effects AS (
  SELECT app_id, {", ".join(phi(f) for f in names)} FROM worth
),
effects_long AS (
  SELECT app_id, 'amount' AS feature, amount AS phi FROM effects
  UNION ALL SELECT app_id, 'balance', balance FROM effects
  UNION ALL SELECT app_id, 'z', z FROM effects
),
importance AS (
  SELECT feature, round(avg(abs(phi)), 6) AS mean_abs,
    round(quantile_cont(abs(phi), 0.5), 6) AS median_abs
  FROM effects_long GROUP BY feature
)"""


EFFECT_COLUMNS = (
    "round(amount, 6) + 0.0 AS amount, round(balance, 6) + 0.0 AS balance, round(z, 6) + 0.0 AS z"
)


def _surrogate_sql() -> str:
    """Two-feature weighted ridge regression, solved by Cramer's rule."""
    points = LocalSurrogate(
        CARD, {f: (0.0, 1.0) for f in CARD.features}, n_samples=1000, seed=SEED
    ).points
    values = ", ".join(f"({i}, CAST({a!r} AS DOUBLE), CAST({b!r} AS DOUBLE))"
                       for i, (a, b) in enumerate(points.tolist()))
    score = CARD.sql({"amount": "u * sa + ma", "balance": "w * sb + mb"})
    return f"""
stats AS (
  SELECT avg(amount) AS ma, stddev_pop(amount) AS sa, avg(balance) AS mb, stddev_pop(balance) AS sb
  FROM applications
),
drawn AS (SELECT * FROM (VALUES {values}) t(i, u, w)),
scored_points AS (SELECT i, u, w, {score} AS s FROM drawn, stats),
rows_ AS (
  SELECT app_id, (amount - ma) / sa AS xu, (balance - mb) / sb AS xw, {CARD.sql()} AS s
  FROM applications, stats
),
cloud AS (
  SELECT r.app_id, p.u, p.w, p.s,
    sqrt(exp(-((p.u - r.xu) * (p.u - r.xu) + (p.w - r.xw) * (p.w - r.xw)) / (0.5625 * 2))) AS k
  FROM rows_ r, scored_points p
  UNION ALL SELECT app_id, xu, xw, s, CAST(1 AS DOUBLE) FROM rows_
),
means AS (
  SELECT app_id, sum(k * u) / sum(k) AS um, sum(k * w) / sum(k) AS wm, sum(k * s) / sum(k) AS sm
  FROM cloud GROUP BY app_id
),
moments AS (
  SELECT c.app_id, any_value(um) AS um, any_value(wm) AS wm, any_value(sm) AS sm,
    sum(k * (u - um) * (u - um)) + 1 AS uu, sum(k * (w - wm) * (w - wm)) + 1 AS ww,
    sum(k * (u - um) * (w - wm)) AS uw,
    sum(k * (u - um) * (s - sm)) AS us, sum(k * (w - wm) * (s - sm)) AS ws
  FROM cloud c JOIN means m ON c.app_id = m.app_id GROUP BY c.app_id
),
solved AS (
  SELECT app_id, um, wm, sm, (us * ww - ws * uw) / (uu * ww - uw * uw) AS amount,
    (ws * uu - us * uw) / (uu * ww - uw * uw) AS balance
  FROM moments
)"""


def _moves_sql(step: float) -> str:
    """Every grid move of one or two features, priced and scored."""
    n = round(1 / step) - 1
    probabilities = "[" + ", ".join(repr(step * (i + 1)) for i in range(n)) + "]"
    return f"""
grids AS (
  SELECT unnest(range(1, {n + 1})) AS i, round(unnest(qa), 6) AS a, round(unnest(qb), 6) AS b
  FROM (SELECT quantile_cont(amount, {probabilities}) AS qa,
               quantile_cont(balance, {probabilities}) AS qb FROM applications) q
),
open_rows AS (
  SELECT app_id, amount, balance FROM applications WHERE NOT (1.0 - {CARD.sql()} >= 0.5)
),
placed AS (
  SELECT o.app_id, any_value(o.amount) AS amount, any_value(o.balance) AS balance,
    (count(*) FILTER (g.a < o.amount) + count(*) FILTER (g.a <= o.amount) + 1) / 2.0 AS pa,
    (count(*) FILTER (g.b < o.balance) + count(*) FILTER (g.b <= o.balance) + 1) / 2.0 AS pb
  FROM open_rows o, grids g GROUP BY o.app_id
),
moves AS (
  SELECT app_id, amount, balance, pa, pb, g.i AS ia, g.a AS na, NULL AS ib, NULL AS nb, 1 AS n
  FROM placed, grids g WHERE g.a <> amount
  UNION ALL
  SELECT app_id, amount, balance, pa, pb, NULL, NULL, g.i, g.b, 1
  FROM placed, grids g WHERE g.b <> balance
  UNION ALL
  SELECT app_id, amount, balance, pa, pb, g.i, g.a, h.i, h.b, 2
  FROM placed, grids g, grids h WHERE g.a <> amount AND h.b <> balance
),
priced AS (
  SELECT app_id, n, na, nb, ia, ib,
    coalesce(abs(ia - pa), 0) * {step} AS da, coalesce(abs(ib - pb), 0) * {step} AS db,
    {CARD.sql({"amount": "coalesce(na, amount)", "balance": "coalesce(nb, balance)"})} AS score
  FROM moves
),
solutions AS (
  SELECT *, round(greatest(da, db), 9) AS cost, round(da + db, 9) AS total FROM priced WHERE 1.0 - score >= 0.5
)
"""


MOVE_COLUMNS = (
    "app_id, n AS n_changes, round(cost, 6) AS cost, round(score, 6) AS score, "
    "round(na, 6) AS new_amount, round(nb, 6) AS new_balance"
)

def _borrowed_sql(card=CARD_Z, apart: float | None = None) -> str:
    """Three picks, each over all donors: the cheapest copy that is far enough from those before."""
    apart = APART if apart is None else apart

    def far(pick: str) -> str:
        gap = f"(abs(f.da - {pick}.da) / sa + abs(f.db - {pick}.db) / sb)"
        return f"{gap} > 0 AND round({gap} / 2, 9) >= CAST({apart!r} AS DOUBLE)"

    def picked(name: str, source: str) -> str:
        return f"""
{name} AS (
  SELECT * EXCLUDE (place) FROM (
    SELECT f.*, row_number() OVER (PARTITION BY f.app_id ORDER BY f.cost, f.n, f.da, f.db) AS place FROM {source}) t
  WHERE place = 1
)"""

    return f"""
classed AS (
  SELECT app_id, amount, balance, z, CASE WHEN {card.sql()} >= 0.5 THEN 1 ELSE 0 END AS cls FROM applications
),
donors AS (SELECT DISTINCT cls, amount AS da, balance AS db FROM classed),
centres AS (
  SELECT quantile_cont(amount, 0.5) AS ca, quantile_cont(balance, 0.5) AS cb FROM applications
),
deviations AS (
  SELECT quantile_cont(abs(amount - ca), 0.5) AS sa, quantile_cont(abs(balance - cb), 0.5) AS sb
  FROM applications, centres
),
copies AS (
  SELECT c.app_id, c.cls, c.amount, c.balance, d.da, d.db,
    {card.sql({"amount": "d.da", "balance": "d.db", "z": "c.z"})} AS score,
    CASE WHEN da <> amount THEN 1 ELSE 0 END + CASE WHEN db <> balance THEN 1 ELSE 0 END AS n
  FROM classed c JOIN donors d ON d.cls <> c.cls WHERE c.app_id % 50 = 0
),
flipped AS MATERIALIZED (
  SELECT app_id, amount, balance, da, db, score, n, sa, sb, round((abs(da - amount) / sa + abs(db - balance) / sb
      + CAST(0.2 AS DOUBLE) * n) / 2, 9) AS cost
  FROM copies, deviations WHERE CASE WHEN score >= 0.5 THEN 1 ELSE 0 END <> cls
),{picked("p1", "flipped f")},{picked("p2", f"flipped f JOIN p1 ON p1.app_id = f.app_id WHERE {far('p1')}".replace("sa +", "f.sa +").replace("/ sb", "/ f.sb"))},
{picked("p3", f"flipped f JOIN p1 ON p1.app_id = f.app_id JOIN p2 ON p2.app_id = f.app_id WHERE {far('p1')} AND {far('p2')}".replace("sa +", "f.sa +").replace("/ sb", "/ f.sb"))},
borrowed AS (
  SELECT 1 AS place, * FROM p1 UNION ALL SELECT 2, * FROM p2 UNION ALL SELECT 3, * FROM p3
)"""


BORROWED = _borrowed_sql()
#: Every asked application: its picks, or one row of rank 0.
PICKS_SELECT = """SELECT a.app_id, coalesce(place, 0) AS cf_rank, round(cost, 6) AS cost, n AS n_changes,
  round(score, 6) AS score, da AS new_amount, db AS new_balance
FROM (SELECT app_id FROM applications WHERE app_id % 50 = 0) a LEFT JOIN borrowed b ON b.app_id = a.app_id"""


QUERIES = {
    "g01_partial_dependence": (
        g01,
        with_applications(
            _grid_sql("amount", 20),
            select=f"""SELECT round(g, 6) AS amount, round(avg({CARD.sql({"amount": "g"})}), 6) AS average
FROM applications, grid_amount GROUP BY g""",
        ),
    ),
    "g01_partial_dependence_levels": (
        g01_levels,
        with_applications(
            select=f"""SELECT CAST(g AS DOUBLE) AS z, round(avg({CARD_Z.sql({"z": "g"})}), 6) AS average
FROM applications, (SELECT DISTINCT z AS g FROM applications) levels GROUP BY g"""
        ),
    ),
    "g02_two_feature_dependence": (
        g02,
        with_applications(
            _grid_sql("amount", 20),
            _grid_sql("balance", 20),
            select=f"""SELECT round(a.g, 6) AS amount, round(b.g, 6) + 0.0 AS balance,
  round(avg({CARD.sql({"amount": "a.g", "balance": "b.g"})}), 6) AS average
FROM applications, grid_amount a, grid_balance b GROUP BY a.g, b.g""",
        ),
    ),
    "g03_individual_curves": (
        g03,
        with_applications(
            _grid_sql("amount", 20),
            select=f"""SELECT app_id, round(p.g, 6) AS value,
  round({CARD.sql({"amount": "p.g"})} - {CARD.sql({"amount": "s.g"})}, 6) + 0.0 AS score
FROM applications, grid_amount p, grid_amount s WHERE s.k = 0""",
        ),
    ),
    "g04_quantile_rug": (
        g04,
        with_applications(
            select="\nUNION ALL ".join(
                f"""SELECT '{f}' AS feature, CAST(unnest(range(4, 94, 2)) AS INTEGER) AS percentile,
  round(unnest(q), 6) + 0.0 AS value
FROM (SELECT quantile_cont({f}, [{", ".join(repr(p / 100) for p in range(4, 94, 2))}]) AS q
      FROM applications) t"""
                for f in ("amount", "balance")
            )
        ),
    ),
    "g05_shapley_values": (
        g05,
        with_applications(_effects_sql(), select=f"SELECT app_id, {EFFECT_COLUMNS} FROM effects"),
    ),
    "g05_shapley_values_of_label": (
        g05_pred,
        with_applications(
            _effects_sql(0.5), select=f"SELECT app_id, {EFFECT_COLUMNS} FROM effects"
        ),
    ),
    "g06_global_importance": (
        g06,
        with_applications(_effects_sql(), select="SELECT * FROM importance"),
    ),
    "g06_top_features": (
        g06_top,
        with_applications(
            _effects_sql(),
            select="SELECT * FROM importance ORDER BY median_abs DESC, feature LIMIT 2",
        ),
    ),
    "g07_local_factors": (
        g07,
        with_applications(
            _effects_sql(),
            """
ranked AS (
  SELECT app_id, feature, phi, CAST(row_number() OVER (PARTITION BY app_id
    ORDER BY round(abs(phi), 9) DESC, feature) AS INTEGER) AS place
  FROM effects_long
)""",
            select="""SELECT r.app_id, place, feature, round(phi, 6) + 0.0 AS phi,
  CASE feature WHEN 'amount' THEN round(a.amount, 2) WHEN 'balance' THEN round(a.balance, 2) END AS value,
  CASE WHEN feature = 'z' THEN CASE WHEN a.z = 1 THEN 'industrial...' ELSE 'household' END END AS label
FROM ranked r JOIN applications a ON r.app_id = a.app_id WHERE place <= 2""",
        ),
    ),
    "g08_local_surrogate": (
        g08,
        with_applications(
            _surrogate_sql(),
            select="""SELECT app_id, round(sm - amount * um - balance * wm, 6) + 0.0 AS intercept,
  round(amount, 6) + 0.0 AS amount, round(balance, 6) + 0.0 AS balance FROM solved""",
        ),
    ),
    "g09_minimal_changes": (
        _changes("percentile", STEP),
        with_applications(
            _moves_sql(STEP),
            select=f"""SELECT {MOVE_COLUMNS} FROM (
  SELECT *, row_number() OVER (PARTITION BY app_id
    ORDER BY cost, n, total, na NULLS FIRST, nb NULLS FIRST) AS pick FROM solutions) t
WHERE pick = 1""",
        ),
    ),
    "g09_minimal_changes_at_defaults": (
        _changes("percentile", 0.01, max_changes=3),
        with_applications(
            _moves_sql(0.01),
            select=f"""SELECT {MOVE_COLUMNS} FROM (
  SELECT *, row_number() OVER (PARTITION BY app_id
    ORDER BY cost, n, total, na NULLS FIRST, nb NULLS FIRST) AS pick FROM solutions) t
WHERE pick = 1""",
        ),
    ),
    "g09_minimal_changes_by_count": (
        _changes("percentile_changes", STEP),
        with_applications(
            _moves_sql(STEP),
            """
per_count AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY app_id, n
      ORDER BY cost, total, na NULLS FIRST, nb NULLS FIRST) AS pick FROM solutions) t
  WHERE pick = 1
)""",
            select=f"""SELECT {MOVE_COLUMNS} FROM per_count p
WHERE n = 1 OR NOT EXISTS (
  SELECT 1 FROM per_count o WHERE o.app_id = p.app_id AND o.n = 1 AND o.cost <= p.cost)""",
        ),
    ),
    "g09_minimal_changes_undominated": (
        _changes("non_dom", 0.2),
        with_applications(
            _moves_sql(0.2),
            select=f"""SELECT {MOVE_COLUMNS} FROM solutions s WHERE NOT EXISTS (
  SELECT 1 FROM solutions o WHERE o.app_id = s.app_id
    AND o.da <= s.da + 1e-12 AND o.db <= s.db + 1e-12
    AND (o.da < s.da - 1e-12 OR o.db < s.db - 1e-12))""",
        ),
    ),
    "g10_diverse_counterfactuals": (g10, with_applications(BORROWED, select=PICKS_SELECT)),
    "g10_unsolved_rows": (g10_unsolved, with_applications(_borrowed_sql(CARD_FAR), select=PICKS_SELECT)),
    "g11_comparison_table": (
        g11,
        with_applications(
            BORROWED,
            """
cells AS (
  SELECT app_id, place, n, 'amount' AS feature, amount AS old, da AS new FROM borrowed
  UNION ALL SELECT app_id, place, n, 'balance', balance, db FROM borrowed
),
sized AS (
  SELECT *, max(CASE WHEN old <> new THEN 1 ELSE 0 END) OVER w AS altered,
    CASE WHEN greatest(max(old) OVER w, max(new) OVER w) < 10 THEN 3 ELSE 0 END AS places
  FROM cells WINDOW w AS (PARTITION BY app_id, feature)
)""",
            select="""SELECT app_id, place AS cf_rank, n AS n_changes, feature,
  (CASE WHEN places = 3 THEN round(old, 3) ELSE round(old, 0) END) + 0.0 AS old,
  (CASE WHEN places = 3 THEN round(new, 3) ELSE round(new, 0) END) + 0.0 AS new,
  (CASE WHEN places = 3 THEN round(new - old, 3) ELSE round(new - old, 0) END) + 0.0 AS delta,
  CASE WHEN new > old THEN '+' WHEN new < old THEN '-' ELSE '---' END AS sign
FROM sized WHERE altered = 1""",
        ),
    ),
    "g12_searched_counterfactuals": (g12, with_applications(_borrowed_sql(CARD_Z, 0.0), select=PICKS_SELECT)),
}
