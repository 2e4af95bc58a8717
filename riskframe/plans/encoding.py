"""Queries for imputation, encoding and scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskframe.functions.spec import FeatureSpec
from riskframe.operators import features
from riskframe.operators.features import FeatureEncoder
from riskframe.plans.fixtures import applications, rounded, table, with_applications

CATEGORIES = ["segment", "priority", "nation", "kind"]
SPEC = FeatureSpec(
    id="app_id", label="y", numeric=("amount", "balance"), categorical=tuple(CATEGORIES)
)


def gaps(spark, sf_dir) -> DataFrame:
    """Applications with missing balances and priorities, and a two-level category."""
    apps = applications(spark, sf_dir)
    return apps.select(
        "app_id",
        "y",
        "amount",
        F.when(F.col("app_id") % 11 != 0, F.col("balance")).alias("balance"),
        "segment",
        F.when(F.col("app_id") % 13 != 0, F.col("priority")).alias("priority"),
        "nation",
        F.when(F.col("z") == 1, "plant").otherwise("other").alias("kind"),
        "rejected",
    )


GAPS = """
gaps AS (
  SELECT app_id, y, amount, CASE WHEN app_id % 11 = 0 THEN NULL ELSE balance END AS balance,
    segment, CASE WHEN app_id % 13 = 0 THEN NULL ELSE priority END AS priority, nation,
    CASE WHEN z = 1 THEN 'plant' ELSE 'other' END AS kind, rejected
  FROM applications
)"""

LONG = """
long AS (
  SELECT 'segment' AS feature, segment AS category, y, app_id, rejected FROM gaps
  UNION ALL SELECT 'priority', priority, y, app_id, rejected FROM gaps
  UNION ALL SELECT 'nation', nation, y, app_id, rejected FROM gaps
  UNION ALL SELECT 'kind', kind, y, app_id, rejected FROM gaps
)"""

MODES = """
modes AS (
  SELECT feature, category AS mode FROM (
    SELECT feature, category,
      row_number() OVER (PARTITION BY feature ORDER BY count(*) DESC, category) AS place
    FROM long WHERE category IS NOT NULL GROUP BY feature, category) t
  WHERE place = 1
)"""

FILLED = """
filled AS (
  SELECT l.feature, coalesce(l.category, m.mode) AS category, y, app_id, rejected
  FROM long l JOIN modes m ON l.feature = m.feature
)"""

STATS = """
stats AS (
  SELECT avg(amount) AS m_amount, avg(balance) AS m_balance FROM gaps
),
spread AS (
  SELECT stddev_pop(amount) AS s_amount, stddev_pop(coalesce(balance, m_balance)) AS s_balance
  FROM gaps, stats
)"""

RATES = """
overall AS (SELECT avg(CAST(y AS DOUBLE)) AS mean FROM gaps),
rates AS (
  SELECT feature, category, CAST(sum(y) AS DOUBLE) AS positives, count(*) AS n
  FROM filled GROUP BY feature, category
),
encoded AS (
  SELECT f.app_id, f.feature, (coalesce(positives, 0) + mean) / (coalesce(n, 0) + 1) AS value
  FROM filled f LEFT JOIN rates r ON f.feature = r.feature AND f.category = r.category, overall
)"""


def f02(spark, sf_dir):
    counts = features.category_counts(gaps(spark, sf_dir), CATEGORIES)
    return features.cardinalities(counts).withColumn(
        "route", F.when(F.col("n_categories") >= 3, "target").otherwise("onehot")
    )


def f03(spark, sf_dir):
    df = gaps(spark, sf_dir).select("app_id", "amount", "balance")
    stats = features.numeric_stats(df, ["amount", "balance"])
    return rounded(features.impute_numeric(df, {c: m for c, (m, _) in stats.items()}))


def f04(spark, sf_dir):
    df = gaps(spark, sf_dir).select("app_id", *CATEGORIES)
    found = features.modes(features.category_counts(df, CATEGORIES))
    # one row per feature
    return features.impute_category(df, {r["feature"]: r["mode"] for r in found.collect()})


def f05(spark, sf_dir):
    """Codes learned on rows outside one segment; that segment becomes unknown."""
    df = gaps(spark, sf_dir)
    counts = features.category_counts(
        df.filter(F.col("segment") != "HOUSEHOLD"), ["segment", "priority"]
    )
    levels: dict[str, list[str]] = {"segment": [], "priority": []}
    for row in counts.filter("category IS NOT NULL").collect():
        levels[row["feature"]].append(row["category"])
    return df.select(
        "app_id",
        *[
            features.ordinal_code(F.col(c), sorted(found)).alias(f"{c}_code")
            for c, found in levels.items()
        ],
    )


def f06(spark, sf_dir):
    encoder = FeatureEncoder(SPEC).fit(gaps(spark, sf_dir))
    rate = F.col("positives") / F.col("n")
    return rounded(encoder.rates.select("feature", "category", "n", rate.alias("mean")))


def f07(spark, sf_dir):
    """Rates learned on accepted rows outside one segment, applied to all rows."""
    df = gaps(spark, sf_dir)
    seen = df.filter((F.col("rejected") == 0) & (F.col("segment") != "HOUSEHOLD"))
    spec = FeatureSpec(id="app_id", label="y", categorical=("segment", "nation"))
    return rounded(FeatureEncoder(spec).fit(seen).encode(df))


def documents(spark, sf_dir) -> DataFrame:
    """Documents with a bad-quality label where one is known, else -1."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    joined = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    return joined.select(
        "doc_id",
        F.coalesce(1 - F.col("quality"), F.lit(-1)).alias("y"),
        F.col("n_chars").cast("double").alias("n_chars"),
        "lang",
        "source",
    )


def f07_partly(spark, sf_dir):
    """Unlabeled rows shape the imputation and the scale, but not the rates."""
    df = documents(spark, sf_dir)
    spec = FeatureSpec("doc_id", "y", numeric=("n_chars",), categorical=("lang", "source"))
    return rounded(FeatureEncoder(spec, k=2.0).fit(df).encode(df, ["doc_id", "y"]))


def f08(spark, sf_dir):
    spec = FeatureSpec(id="app_id", label="y", numeric=("amount", "balance"))
    df = gaps(spark, sf_dir)
    return rounded(FeatureEncoder(spec).fit(df).encode(df))


def f09(spark, sf_dir):
    """Every category one-hot encoded; the first of two levels is dropped."""
    df = gaps(spark, sf_dir)
    seen = df.filter(F.col("segment") != "HOUSEHOLD")
    spec = FeatureSpec(id="app_id", label="y", categorical=("segment", "kind"))
    encoder = FeatureEncoder(spec, target_encode=False, onehot_drop=True).fit(seen)
    return encoder.encode(df)


def coded(spark, sf_dir) -> DataFrame:
    """Categories that are integers: negative and two-digit codes, and a tie for the mode."""
    return applications(spark, sf_dir).select(
        "app_id",
        "y",
        F.when(F.col("app_id") % 7 != 0, F.col("app_id") % 7 * 4 - 14).cast("int").alias("status"),
        (F.col("app_id") % 2 * 8 + 2).cast("int").alias("plan"),
    )


CODED = """
coded AS (
  SELECT app_id, y, CASE WHEN app_id % 7 <> 0 THEN app_id % 7 * 4 - 14 END AS status,
    app_id % 2 * 8 + 2 AS plan
  FROM applications
)"""


def coded_spec() -> FeatureSpec:
    return FeatureSpec(id="app_id", label="y", categorical=("status", "plan"))


def f04_numbers(spark, sf_dir):
    df = coded(spark, sf_dir)
    columns = ["status", "plan"]
    counts = features.category_counts(df, columns)
    found = features.modes(counts, features.numeric_categories(df, columns))
    return features.impute_category(
        df.select("app_id", *columns), {r["feature"]: r["mode"] for r in found.collect()}
    )


def f05_numbers(spark, sf_dir):
    df = coded(spark, sf_dir)
    encoder = FeatureEncoder(coded_spec(), onehot=False, target_encode=False).fit(df)
    return encoder.encode(df, onehot=False)


def f09_numbers(spark, sf_dir):
    """Of a two-level column the dummy of the larger number stays."""
    df = coded(spark, sf_dir)
    return FeatureEncoder(coded_spec(), target_encode=False, onehot_drop=True).fit(df).encode(df)


def f09_wide(spark, sf_dir):
    """Customers and nations as sparse vectors: the place of each row's only entry."""
    df = applications(spark, sf_dir).select("app_id", "y", "cust_id", "nation")
    spec = FeatureSpec(id="app_id", label="y", categorical=("cust_id", "nation"))
    seen = df.filter(F.col("nation") != "FRANCE")
    encoder = FeatureEncoder(spec, target_encode=False, max_levels=20).fit(seen)
    out = encoder.encode(df)
    for c in ("cust_id", "nation"):
        vector = F.unwrap_udt(F.col(c))
        out = out.withColumn(f"{c}_size", vector["size"]).withColumn(
            f"{c}_place", F.try_element_at(vector["indices"], F.lit(1))
        )
    return out.drop("cust_id", "nation")


def f10(spark, sf_dir):
    df = gaps(spark, sf_dir)
    return rounded(FeatureEncoder(SPEC).fit(df).encode(df))


def f12(spark, sf_dir):
    df = gaps(spark, sf_dir)
    encoder = FeatureEncoder(SPEC).fit(df)
    back = encoder.unscale(encoder.encode(df))
    return rounded(back.select("app_id", "amount", "balance"))


SEGMENTS = "('AUTOMOBILE','BUILDING','FURNITURE','MACHINERY')"

QUERIES = {
    "f02_cardinality_routing": (
        f02,
        with_applications(
            GAPS,
            LONG,
            select="""SELECT feature, count(DISTINCT category) AS n_categories,
  CASE WHEN count(DISTINCT category) >= 3 THEN 'target' ELSE 'onehot' END AS route
FROM long GROUP BY feature""",
        ),
    ),
    "f03_mean_imputation": (
        f03,
        with_applications(
            GAPS,
            STATS,
            select="SELECT app_id, round(amount, 6) AS amount, "
            "round(coalesce(balance, m_balance), 6) AS balance FROM gaps, stats",
        ),
    ),
    "f04_mode_imputation": (
        f04,
        with_applications(
            GAPS,
            LONG,
            MODES,
            select="""SELECT app_id, segment,
  coalesce(priority, (SELECT mode FROM modes WHERE feature = 'priority')) AS priority,
  nation, kind
FROM gaps""",
        ),
    ),
    "f04_mode_imputation_of_numbers": (
        f04_numbers,
        with_applications(
            CODED,
            """
top AS (
  SELECT status FROM coded WHERE status IS NOT NULL
  GROUP BY status ORDER BY count(*) DESC, status LIMIT 1
)""",
            select="""SELECT app_id, CAST(coalesce(c.status, top.status) AS VARCHAR) AS status,
  CAST(plan AS VARCHAR) AS plan FROM coded c, top""",
        ),
    ),
    "f05_ordinal_encoding_of_numbers": (
        f05_numbers,
        with_applications(
            CODED,
            """
top AS (
  SELECT status FROM coded WHERE status IS NOT NULL
  GROUP BY status ORDER BY count(*) DESC, status LIMIT 1
),
levels AS (
  SELECT status, row_number() OVER (ORDER BY status) - 1 AS code
  FROM (SELECT DISTINCT status FROM coded WHERE status IS NOT NULL) t
)""",
            select="""SELECT app_id, l.code AS status, CAST(plan > 2 AS BIGINT) AS plan
FROM coded c, top JOIN levels l ON l.status = coalesce(c.status, top.status)""",
        ),
    ),
    "f05_ordinal_encoding": (
        f05,
        with_applications(
            GAPS,
            """
segment_codes AS (
  SELECT segment, row_number() OVER (ORDER BY segment) - 1 AS code
  FROM (SELECT DISTINCT segment FROM gaps WHERE segment <> 'HOUSEHOLD') t
),
priority_codes AS (
  SELECT priority, row_number() OVER (ORDER BY priority) - 1 AS code
  FROM (SELECT DISTINCT priority FROM gaps
        WHERE segment <> 'HOUSEHOLD' AND priority IS NOT NULL) t
)""",
            select="""SELECT app_id, coalesce(s.code, -1) AS segment_code,
  coalesce(p.code, -1) AS priority_code
FROM gaps g LEFT JOIN segment_codes s ON g.segment = s.segment
            LEFT JOIN priority_codes p ON g.priority = p.priority""",
        ),
    ),
    "f06_target_rates": (
        f06,
        with_applications(
            GAPS,
            LONG,
            MODES,
            FILLED,
            RATES,
            select="SELECT feature, category, n, round(positives / n, 6) AS mean FROM rates "
            "WHERE feature <> 'kind'",
        ),
    ),
    "f07_target_encoding": (
        f07,
        with_applications(
            GAPS,
            """
seen AS (SELECT * FROM gaps WHERE rejected = 0 AND segment <> 'HOUSEHOLD'),
overall AS (SELECT avg(CAST(y AS DOUBLE)) AS mean FROM seen),
by_segment AS (SELECT segment, sum(y) AS p, count(*) AS n FROM seen GROUP BY segment),
by_nation AS (SELECT nation, sum(y) AS p, count(*) AS n FROM seen GROUP BY nation)""",
            select="""SELECT app_id,
  round((coalesce(s.p, 0) + mean) / (coalesce(s.n, 0) + 1), 6) AS segment,
  round((coalesce(t.p, 0) + mean) / (coalesce(t.n, 0) + 1), 6) AS nation
FROM gaps g LEFT JOIN by_segment s ON g.segment = s.segment
            LEFT JOIN by_nation t ON g.nation = t.nation, overall""",
        ),
    ),
    "f07_target_encoding_partly_labeled": (
        f07_partly,
        """
WITH docs AS (
  SELECT d.doc_id, coalesce(1 - l.quality, -1) AS y, CAST(n_chars AS DOUBLE) AS n_chars, lang, source
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
),
overall AS (SELECT avg(CAST(y AS DOUBLE)) AS mean FROM docs WHERE y <> -1),
stats AS (SELECT avg(n_chars) AS m, stddev_pop(n_chars) AS s FROM docs),
by_lang AS (SELECT lang, sum(y) AS p, count(*) AS n FROM docs WHERE y <> -1 GROUP BY lang),
by_source AS (SELECT source, sum(y) AS p, count(*) AS n FROM docs WHERE y <> -1 GROUP BY source)
SELECT doc_id, y, round((n_chars - m) / s, 6) + 0.0 AS n_chars,
  round((coalesce(a.p, 0) + 2 * mean) / (coalesce(a.n, 0) + 2), 6) AS lang,
  round((coalesce(b.p, 0) + 2 * mean) / (coalesce(b.n, 0) + 2), 6) AS source
FROM docs d LEFT JOIN by_lang a ON d.lang = a.lang LEFT JOIN by_source b ON d.source = b.source,
  overall, stats""",
    ),
    "f08_standard_scaling": (
        f08,
        with_applications(
            GAPS,
            STATS,
            select="""SELECT app_id, round((amount - m_amount) / s_amount, 6) + 0.0 AS amount,
  round((coalesce(balance, m_balance) - m_balance) / s_balance, 6) + 0.0 AS balance
FROM gaps, stats, spread""",
        ),
    ),
    "f09_one_hot": (
        f09,
        with_applications(
            GAPS,
            select="SELECT app_id, "
            + ", ".join(
                f"CASE WHEN segment = '{s}' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END "
                f"AS segment_{i}"
                for i, s in enumerate(["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY"])
            )
            + ", CASE WHEN kind = 'plant' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END "
            "AS kind_1 FROM gaps",
        ),
    ),
    "f09_one_hot_of_numbers": (
        f09_numbers,
        with_applications(
            CODED,
            """
top AS (
  SELECT status FROM coded WHERE status IS NOT NULL
  GROUP BY status ORDER BY count(*) DESC, status LIMIT 1
)""",
            select="SELECT app_id, "
            + ", ".join(
                f"CAST(coalesce(c.status, top.status) = {code} AS DOUBLE) AS status_{i}"
                for i, code in enumerate([-10, -6, -2, 2, 6, 10])
            )
            + ", CAST(plan = 10 AS DOUBLE) AS plan_1 FROM coded c, top",
        ),
    ),
    "f09_one_hot_of_many_levels": (
        f09_wide,
        with_applications(
            """
customers AS (
  SELECT cust_id, row_number() OVER (ORDER BY cust_id) - 1 AS place
  FROM (SELECT DISTINCT cust_id FROM applications WHERE nation <> 'FRANCE') t
),
nations AS (
  SELECT nation, row_number() OVER (ORDER BY nation) - 1 AS place
  FROM (SELECT DISTINCT nation FROM applications WHERE nation <> 'FRANCE') t
)""",
            select="""SELECT app_id, CAST((SELECT count(*) FROM customers) AS INTEGER) AS cust_id_size,
  CAST(c.place AS INTEGER) AS cust_id_place,
  CAST((SELECT count(*) FROM nations) AS INTEGER) AS nation_size, CAST(n.place AS INTEGER) AS nation_place
FROM applications a LEFT JOIN customers c ON a.cust_id = c.cust_id LEFT JOIN nations n ON a.nation = n.nation""",
        ),
    ),
    "f10_encoded_table": (
        f10,
        with_applications(
            GAPS,
            LONG,
            MODES,
            FILLED,
            STATS,
            RATES,
            select="""SELECT g.app_id,
  CASE WHEN kind = 'other' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS kind_0,
  CASE WHEN kind = 'plant' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS kind_1,
  round((amount - m_amount) / s_amount, 6) + 0.0 AS amount,
  round((coalesce(balance, m_balance) - m_balance) / s_balance, 6) + 0.0 AS balance,
  round(es.value, 6) AS segment, round(ep.value, 6) AS priority, round(en.value, 6) AS nation
FROM gaps g
JOIN encoded es ON g.app_id = es.app_id AND es.feature = 'segment'
JOIN encoded ep ON g.app_id = ep.app_id AND ep.feature = 'priority'
JOIN encoded en ON g.app_id = en.app_id AND en.feature = 'nation', stats, spread""",
        ),
    ),
    "f12_inverse_scaling": (
        f12,
        with_applications(
            GAPS,
            STATS,
            select="SELECT app_id, round(amount, 6) AS amount, "
            "round(coalesce(balance, m_balance), 6) AS balance FROM gaps, stats",
        ),
    ),
}
