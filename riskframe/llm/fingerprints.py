"""Document fingerprints by threshold-scaled sketches; DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from riskframe.functions.ordering import with_bucket
from riskframe.llm.common import Workspace

BLANKS = "[\\x20\\x09-\\x0D]+"
#: Words per shingle, hexadecimal digits kept of a shingle's hash.
SIZE, DIGITS = 5, 16
#: Hashes below this value, as hexadecimal digits, are kept: one in eight.
THRESHOLD = "2"


def words_of(text: Column) -> Column:
    """Runs without ASCII white space, A-Z lower-cased."""
    low = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, BLANKS, -1), "")


def sketch_of(words: Column, threshold: str = THRESHOLD, size: int = SIZE) -> Column:
    """Sorted distinct shingle hashes below the threshold, which leaves them within a long.

    The threshold is the same for every text, so the sketch of a union is the
    union of the sketches, and a share of the kept hashes estimates the share of
    the shingles, however unequal two texts are. A text with fewer than ``size``
    words has its whole sequence as one shingle, one without words has none.
    """
    n = F.size(words)

    def kept(text: Column) -> Column:
        return F.substring(F.md5(text.cast("binary")), 1, DIGITS)

    hashes = F.when(
        n >= size,
        F.transform(
            F.sequence(F.lit(0), n - size), lambda i: kept(F.concat_ws(" ", *[F.get(words, i + k) for k in range(size)]))
        ),
    ).otherwise(F.when(n > 0, F.array(kept(F.array_join(words, " ")))).otherwise(F.array().cast("array<string>")))
    small = F.filter(hashes, lambda h: h < F.lit(threshold))
    return F.array_sort(F.array_distinct(F.transform(small, lambda h: F.conv(h, 16, 10).cast("long"))))


def fingerprint_of(n_words: Column, sketch: Column) -> Column:
    """Number of words, then the kept hashes in hexadecimal: equal texts have equal ones."""
    shown = F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), DIGITS, "0")))
    return F.concat(n_words.cast("string"), F.lit(":"), F.array_join(shown, ","))


def likeness(n: Column, a: Column, m: Column, b: Column) -> Column:
    """Share of the smaller sketch that the other one holds.

    Sketches that kept nothing tell nothing: two of them are alike where the texts
    have the same number of words, else, and against any other sketch, unlike.
    """
    least = F.least(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b)).cast("double") / least.cast("double")
    both = (F.size(a) == 0) & (F.size(b) == 0) & (n == m)
    return F.when(least > 0, shared).otherwise(F.when(both, 1.0).otherwise(0.0))


def once(df: DataFrame, **values: Column) -> DataFrame:
    """``df`` with columns that later steps read without computing them again."""
    row = F.struct(*[value.alias(name) for name, value in values.items()])
    return df.select("*", F.inline(F.array(row)))


def successors(ids: DataFrame, parts: int) -> DataFrame:
    """(id, next): the next smaller id, after the smallest the largest.

    ``ids`` holds each id once. They are cut into ranges, each range is a window,
    and the largest id of every range follows the range above it.
    """
    probes = [i / parts for i in range(1, parts)]
    cuts = ids.agg(F.percentile_approx("id", probes, 50 * parts)).first()[0] if probes else None
    ranged = with_bucket(ids, "id", sorted(set(cuts or [])), "range")
    heads = {r["range"]: r["head"] for r in ranged.groupBy("range").agg(F.max("id").alias("head")).collect()}
    order = sorted(heads, reverse=True)
    follow = [(r, heads[after]) for r, after in zip(order, [*order[1:], *order[:1]])]
    first = ids.sparkSession.createDataFrame(follow, "range int, head long")  # one row per range
    down = F.lead("id").over(W.partitionBy("range").orderBy(F.desc("id")))
    return ranged.withColumn("down", down).join(F.broadcast(first), "range").select(
        "id", F.coalesce("down", "head").alias("next")
    )


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of whole texts and of edited ones, with their likeness.

    Returns (key, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next). The edited text has its last floor(n_chars / 3) code
    points replaced by the first as many of the next document by falling key.

    Null texts count as empty. Of rows repeating a key, the text with the smallest
    SHA-256 is the one that the document before them borrows from; all of them have
    the same next document. A null key has no next one: its edited text is the
    text, near_next is null. One document alone follows itself. Other columns are
    ignored; no rows give no rows.

    A text is shuffled once, next to its own key, with its sketch; the same exchange
    serves as lender and as borrower. What is lent is a third of the borrower long.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "fingerprints")
    rows = docs.select(
        F.col(key).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")
    )
    third = lambda t: F.floor(F.length(t) / 3).cast("int")
    sizes = space.settle(
        rows.filter("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n"), F.max(third("t")).alias("need")), "sizes"
    )
    seen = sizes.agg(F.max("n").alias("n")).first()["n"]
    result = ["id", "t", "words", "sketch"]
    base = once(once(rows, w=words_of(F.col("t"))), words=F.size("w"), sketch=sketch_of(F.col("w"))).select(*result)
    none = base.filter("id IS NULL").select(
        *result, F.lit(None).cast("string").alias("lent"), F.lit(None).cast("int").alias("m"),
        F.lit(None).cast("array<long>").alias("other"),
    )
    known = none
    if seen is not None:
        chain = space.settle(successors(sizes.select("id"), int(spark.conf.get("spark.sql.shuffle.partitions"))), "chain")
        loans = space.settle(
            chain.join(sizes.select("id", "need"), "id").select(
                F.col("id").alias("borrower"), F.col("next").alias("lender"), "need"
            ),
            "loans",
        )
        own = base.filter("id IS NOT NULL")
        lent = own.join(loans.hint("merge"), F.col("id") == F.col("lender")).select(
            "borrower", F.substring("t", F.lit(1), F.col("need")).alias("lent"),
            F.col("words").alias("m"), F.col("sketch").alias("other"),
            *([F.sha2("t", 256).alias("h")] if seen > 1 else []),
        )
        if seen > 1:
            best = F.min(F.struct("h", "lent", "m", "other")).alias("s")
            lent = space.settle(lent.groupBy("borrower").agg(best).select("borrower", "s.lent", "s.m", "s.other"), "lent")
        known = own.join(lent.hint("merge"), F.col("id") == F.col("borrower")).select(*result, "lent", "m", "other").union(none)
    length = F.length("t")
    edited = F.when(F.col("lent").isNull(), F.col("t")).otherwise(
        F.concat(F.substring("t", F.lit(1), length - third("t")), F.substring("lent", F.lit(1), third("t")))
    )
    done = once(known, e=edited)
    done = once(done, ew=words_of(F.col("e")))
    done = once(done, ewords=F.size("ew"), esketch=sketch_of(F.col("ew")))
    return done.select(
        F.col("id").alias(key), length.cast("long").alias("n_chars"), F.sha2("e", 256).alias("edited_sha256"),
        fingerprint_of(F.col("words"), F.col("sketch")).alias("fingerprint"),
        fingerprint_of(F.col("ewords"), F.col("esketch")).alias("edited_fingerprint"),
        likeness(F.col("words"), F.col("sketch"), F.col("ewords"), F.col("esketch")).alias("near_edited"),
        F.when(F.col("other").isNotNull(), likeness(F.col("words"), F.col("sketch"), F.col("m"), F.col("other"))).alias("near_next"),
    )
