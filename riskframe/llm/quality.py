"""Quality rules that vote or abstain, weighed by expectation-maximisation; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskframe.llm.common import Workspace
from riskframe.llm.labelling import ABSTAIN, BAD, GOOD, fit_votes

BLANKS = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_capitals", "n_shouts", "n_stops", "n_noise",
)
#: A word without a letter or digit, or two symbols behind a letter.
NOISE = "(?<!\\S)[^\\p{L}\\p{N}\\s]+(?!\\S)|\\p{L}[#*$%&|<>]{2}"


def _occurrences(text: Column, marks: str) -> Column:
    """Characters of ``text`` among ``marks``; a plain search per mark."""
    found = F.lit(0)
    for mark in marks:
        found = found + F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))
    return found


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also when used inside a lambda."""
    return F.transform(F.array(value), body)[0]


def _covered(hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more: sort windows by hash, keep
    the places of those equal to a neighbour, add up the stretches they cover."""
    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        last = F.size(s) - 1
        twice = F.filter(
            F.sequence(F.lit(0), last),
            lambda k: ((k > 0) & (s[k]["h"] == F.get(s, k - 1)["h"])) | ((k < last) & (s[k]["h"] == F.get(s, k + 1)["h"])),
        )
        return F.sort_array(F.transform(twice, lambda k: s[k]["i"]))

    def total(p: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(0), F.size(p) - 1),
            F.lit(0),
            lambda sum_, k: sum_ + F.when(k == F.size(p) - 1, F.lit(WINDOW)).otherwise(
                F.least(F.lit(WINDOW), F.get(p, k + 1) - p[k])
            ),
        )

    return _let(_let(ordered, places), total)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measures of each whole text; a null text counts as empty.

    Windows are compared by 64-bit hashes of their five words. Each step goes
    through a generator of one row, below which neither filters nor later
    expressions are pushed: words and windows are computed once.
    """
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    out = docs.withColumn("__t", value)
    out = out.select("*", F.explode_outer(F.array(F.array_remove(F.split("__t", BLANKS, -1), ""))).alias("__w"))
    n = F.size("__w")
    windows = F.when(
        n >= WINDOW,
        F.transform(
            F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.col("__w")[i + k] for k in range(WINDOW)])
        ),
    )
    lines = F.filter(F.split("__t", "\n", -1), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    out = out.select("*", F.inline_outer(F.array(F.struct(windows.alias("__h"), lines.alias("__l")))))
    repeats = F.when(
        F.size("__h") > F.size(F.array_distinct("__h")), _covered(F.col("__h"))
    ).otherwise(F.lit(0))
    measures = {
        "n_words": n,
        "word_chars": F.length(F.array_join("__w", "")),
        "n_symbols": _occurrences(F.col("__t"), SYMBOLS),
        "n_dup_lines": F.size("__l") - F.size(F.array_distinct("__l")),
        "n_repeat_words": repeats,
        "n_lines": F.size("__l"),
        "n_capitals": F.regexp_count("__t", F.lit("[A-Z]{2,}")),
        "n_shouts": _occurrences(F.col("__t"), "!?"),
        "n_stops": _occurrences(F.col("__t"), "."),
        "n_noise": F.regexp_count("__t", F.lit(NOISE)),
    }
    row = F.struct(*[measures[m].cast("long").alias(m) for m in MEASURES])
    return out.select(*docs.columns, F.inline_outer(F.array(row)))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def votes() -> dict[str, Column]:
    """Each rule says 1 (good), 0 (bad) or -1 (abstains) from the measures."""
    words = F.greatest(F.col("n_words"), F.lit(1))

    def rule(good: Column, bad: Column) -> Column:
        return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)

    mean = F.col("word_chars") / words
    return {
        "length": rule(F.col("n_words").between(25, 200_000), F.col("n_words") < 10),
        "word_size": rule(mean.between(2.5, 9.0), (mean < 2.0) | (mean > 14.0)),
        "symbols": rule(F.col("n_symbols") * 100 <= words * 2, F.col("n_symbols") * 10 > words),
        "noise": rule(F.col("n_noise") * 100 <= words * 2, F.col("n_noise") * 10 > words),
        "lines": rule(F.col("n_dup_lines") == 0, F.col("n_dup_lines") * 10 > F.col("n_lines") * 3),
        "repeats": rule(F.col("n_repeat_words") * 100 <= words * 3, F.col("n_repeat_words") * 100 > words * 15),
        "capitals": rule(F.col("n_capitals") * 100 <= words * 5, F.col("n_capitals") * 100 > words * 30),
        "shouting": rule(F.col("n_shouts") * 100 <= words * 5, F.col("n_shouts") * 100 > words * 20),
        "sentences": rule(F.col("n_stops") * 100 >= words * 2, (F.col("n_stops") == 0) & (F.col("n_words") > 40)),
    }


def fit_rules(measures: DataFrame) -> Column:
    """Posterior chance of good quality as an expression on the measures.

    Spark counts the vote patterns (at most 3 ** 9); only those reach the driver.
    """
    said = votes()
    rows = measures.select(*[c.alias(n) for n, c in said.items()]).groupBy(*said).count().collect()
    patterns = sorted((tuple(r[n] for n in said), float(r["count"])) for r in rows)
    constant, weights = fit_votes(patterns)
    odds = F.lit(constant)
    for (_, vote), weight in zip(said.items(), weights):
        odds = odds + F.when(vote == GOOD, weight[GOOD]).when(vote == BAD, weight[BAD]).otherwise(weight[ABSTAIN])
    return 1 / (1 + F.exp(-odds))


def judge_quality(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Measures and verdict of each whole text, one row per document.

    Returns the key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, quality (the posterior) and kept (false if base_failed, else
    quality >= 0.5). Null and empty texts have zeros and are not kept. Repeated
    rows and null keys stay; other columns are ignored; no rows give no rows.
    """
    space = Workspace(docs.sparkSession, "quality")
    plain = docs.select(F.col(key).alias(key), F.col(text).alias("__text"))
    table = space.settle(measured(plain, "__text").select(key, *MEASURES), "measures")
    quality = fit_rules(table)
    return table.select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), quality.alias("quality"),
        (~base_failed() & (quality >= 0.5)).alias("kept"),
    )


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` worth keeping, all columns as they were.

    Texts are measured twice, once for the vote patterns and once to filter, so
    that they never have to be shuffled.
    """
    names = {c: f"__in{i}" for i, c in enumerate(docs.columns)}  # no clash with the measures
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    table = measured(renamed, names[text])
    quality = fit_rules(table.select(*MEASURES))
    return table.filter(~base_failed() & (quality >= 0.5)).select(*[F.col(n).alias(c) for c, n in names.items()])
