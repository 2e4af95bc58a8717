"""URL verdicts: rules by host and path, gradient-boosted trees for the rest; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskframe.functions.lookup import attach_state, fits_broadcast
from riskframe.llm.boosted import Trees, bounded_sample
from riskframe.llm.common import Workspace

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows a suffix statistic is drawn towards the overall share with.
PULL = 20.0
#: Parts of the labelled urls: each is described by the rates of the others.
FOLDS, FOLD_SEED = 5, 31
Rule = tuple[str, str, str]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    known = F.coalesce(url.contains("://"), F.lit(False))
    rest = F.substr(url, F.instr(url, "://") + F.lit(3))
    host = F.regexp_extract(rest, "(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)
    return (
        F.when(known, F.translate(host, UPPER, LOWER)).otherwise(F.lit("")),
        F.when(known, path).otherwise(F.lit("")),
    )


def matched_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    found = None
    for action, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        hit = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(action).alias("verdict"))
        found = F.when(fits, hit) if found is None else found.when(fits, hit)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if found is None else found


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def entropy(text: Column) -> Column:
    """Bits per character; 0 for an empty text."""
    size = F.length(text)
    return F.aggregate(
        F.array_distinct(F.split(text, "")),
        F.lit(0.0),
        lambda total, c: total - F.when(
            F.length(c) > 0,
            ((size - F.length(F.replace(text, c, F.lit("")))) / size)
            * F.log2((size - F.length(F.replace(text, c, F.lit("")))) / size),
        ).otherwise(0.0),
    )


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    digits = F.length(F.regexp_replace(url, "[^0-9]", ""))
    query = F.regexp_extract(url, "(?s)\\?([^#]*)", 1)
    size = F.greatest(F.length(url), F.lit(1))
    return {
        "length": F.length(url), "host_length": F.length(host), "path_length": F.length(path),
        "depth": _count(path, "/"), "labels": _count(host, "."), "hyphens": _count(url, "-"),
        "digit_ratio": digits / size, "entropy": entropy(url),
        "parameters": F.when(F.length(query) > 0, _count(query, "&") + 1).otherwise(0),
        "encoded": _count(url, "%"), "secure": F.startswith(url, F.lit("https:")).cast("int"),
        "fragment": url.contains("#").cast("int"), "dotted_path": path.contains(".").cast("int"),
        "trailing": F.endswith(path, F.lit("/")).cast("int"),
        "number": F.least(F.length(F.regexp_extract(path, "([0-9]+)", 1)), F.lit(12)),
        "first_size": F.length(F.regexp_extract(path, "(?s)^/([^/]*)", 1)),
    }


def _rates(labelled: DataFrame, part: str, overall: float, space: Workspace) -> tuple[DataFrame, DataFrame]:
    """((part, rate), (fold and part, rate)): block rates of every value among all labelled
    rows, and among those outside one fold, drawn towards the overall one."""

    def drawn(bad: Column, n: Column) -> Column:
        return (bad + F.lit(PULL * overall)) / (n + F.lit(PULL))

    name = part.strip("_")
    counts = space.settle(
        labelled.groupBy(part, "__fold").agg(F.sum("y").alias("bad"), F.count("*").alias("n")), f"{name}-counts"
    )
    # FOLDS rows per value at most
    total = Window.partitionBy(part)
    outside = counts.select(
        F.concat_ws("|", "__fold", part).alias("__at"),
        drawn(F.sum("bad").over(total) - F.col("bad"), F.sum("n").over(total) - F.col("n")).alias(f"{part}_rate"),
    )
    whole = counts.groupBy(part).agg(drawn(F.sum("bad"), F.sum("n")).alias(f"{part}_rate"))
    return space.settle(whole, name), space.settle(outside, f"{name}-outside")


def judge_urls(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url") -> DataFrame:
    """Verdict of each url, one row per page.

    Returns the key, host, path, rule (null where none fits), verdict (allow or
    block: the rule's, else block where the trees see a chance of at least one
    half) and block_chance. The trees learn from the urls the rules have judged, a
    bounded sample of them by key, on lexical features and on block rates of the top and
    second-level suffix and of the first path part, counted for every value over all
    of these urls and joined back; the trees see each labelled url with the rates of the
    urls outside its own fold, so that no rate holds its own verdict. Without labelled
    urls of both verdicts the rest takes the one verdict seen, or allow. A null url
    has empty host and path; repeated rows and null keys stay; other columns are
    ignored; no rows give no rows.
    """
    rows = pages.select(F.col(key).alias(key), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("__url"))
    host, path = host_and_path(F.col("__url"))
    rows = rows.withColumns({"host": host, "path": path})
    rows = rows.withColumn("__hit", matched_rule(F.col("host"), F.col("path"), rules))
    rows = rows.withColumns(
        {
            "__top": F.substring_index("host", ".", -1),
            "__second": F.substring_index("host", ".", -2),
            "__first": F.regexp_extract("path", "(?s)^/([^/]*)", 1),
        }
    )
    labelled = rows.filter("__hit IS NOT NULL").withColumn("y", (F.col("__hit.verdict") == "block").cast("int"))
    overall = labelled.agg(F.avg("y")).first()[0]
    overall = 0.0 if overall is None else float(overall)
    space = Workspace(pages.sparkSession, "url-rates")
    labelled = labelled.withColumn("__fold", F.pmod(F.xxhash64(F.lit(FOLD_SEED), key), F.lit(FOLDS)))
    rates = {p: _rates(labelled, p, overall, space) for p in ("__top", "__second", "__first")}
    small = {p: (fits_broadcast(whole, p), fits_broadcast(outside, "__at")) for p, (whole, outside) in rates.items()}

    def featured(df: DataFrame, learning: bool = False) -> DataFrame:
        for part, tables in rates.items():
            at = "__at" if learning else part
            if learning:
                df = df.withColumn("__at", F.concat_ws("|", "__fold", part))
            df = attach_state(df, tables[learning], at, at, [f"{part}_rate"], small=small[part][learning])
        values = [c.cast("double") for c in lexical(F.col("__url"), F.col("host"), F.col("path")).values()]
        values += [F.coalesce(f"{part}_rate", F.lit(overall)) for part in rates]
        return df.withColumn("__features", F.array(*values))

    sample = bounded_sample(labelled, key)
    trees = Trees(featured(sample, learning=True).select("__features", "y"), "__features", "y")
    scored = trees.score(featured(rows), "__features", "block_chance")
    chosen = F.when(F.col("block_chance") >= 0.5, "block").otherwise("allow")
    return scored.select(
        key, "host", "path", F.col("__hit.rule").alias("rule"),
        F.coalesce(F.col("__hit.verdict"), chosen).alias("verdict"), "block_chance",
    )
