"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression."""

from __future__ import annotations

import math
import re

from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F

from riskframe.llm.boosted import Trees, bounded_sample
from riskframe.llm.common import map_texts, text_function

#: A small lexicon of insults and the second person, in four languages.
INSULTS = frozenset(
    """idiot idiots moron stupid dumb loser losers pathetic worthless scum trash garbage clown fool disgusting
    hate kill jerk freak ugly filthy vermin coward liar pig rat imbecile dimwit creep sucker
    dumm dummkopf arschloch trottel depp versager abschaum müll widerlich hasse
    imbécile connard débile nul minable ordure déchet dégoûtant crétin salaud
    idiota estúpido imbécil basura asqueroso tonto inútil cerdo patético escoria payaso""".split()
)
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre tú ti tus usted ustedes vosotros".split()
)
NEAR = 5
#: Words learned from labelled texts: how much commoner they must be in toxic ones, and how many at most.
LEARNED_ODDS, LEARNED_WORDS = 6.0, 1000
BREAKS = ".,;:!?\"()[]|&%#\n\t"
SWAPS = str.maketrans("@4301!$57", "aaeoiisst")
MASKED = re.compile(r"[^\W\d_]+[@$*!013457]+[^\W\d_]+", re.UNICODE)
STRETCHED = re.compile(r"([^\W\d_])\1\1+")
CAPITALS, DIGITS, LOUD, MARKS = (bytes(range(65, 91)), bytes(range(48, 58)), b"!?", b"#*$%&|<>@^~_=+")
FEATURES = 16
#: Share of the trees' own chance in the score, so that scores inside one calibrated step keep their order.
ORDER = 0.02


def _words(text: str) -> list[str]:
    for mark in BREAKS:
        text = text.replace(mark, " ")
    return text.split()


def _fits(word: str, lexicon: frozenset) -> bool:
    """A masked or stretched spelling of a lexicon word?"""
    plain = word.translate(SWAPS)
    if plain in lexicon or STRETCHED.sub(r"\1", plain) in lexicon or STRETCHED.sub(r"\1\1", plain) in lexicon:
        return True
    if "*" not in word:
        return False
    shape = re.compile(re.escape(plain).replace(r"\*", "."))
    return any(len(w) == len(plain) and shape.fullmatch(w) for w in lexicon)


def text_features(text: str, learned: dict[str, float]) -> list[float]:
    """Densities and rates of one whole text; all zero for an empty one."""
    if not text:
        return [0.0] * FEATURES
    low = text.lower()
    words = _words(low)
    n = max(1, len(words))
    raw = text.encode("utf-8", "surrogatepass")
    size = len(raw)
    hits = [] if INSULTS.isdisjoint(words) else [i for i, w in enumerate(words) if w in INSULTS]
    found = [] if learned.keys().isdisjoint(words) else [learned[w] for w in words if w in learned]
    near = second = 0
    if not SECOND_PERSON.isdisjoint(words):
        second = sum(w in SECOND_PERSON for w in words)
        near = sum(any(w in SECOND_PERSON for w in words[max(0, i - NEAR) : i + NEAR + 1]) for i in hits)
    masked = [m.group() for m in MASKED.finditer(low)]
    stretched = [m.start() for m in STRETCHED.finditer(low)] if STRETCHED.search(low) else []
    hidden = sum(_fits(w, INSULTS) for w in masked)
    if stretched:
        hidden += sum(_fits(w, INSULTS) for w in words if STRETCHED.search(w))

    def share(chars: bytes) -> float:
        return (size - len(raw.translate(None, chars))) / size

    return [
        math.log1p(len(words)), math.log1p(len(hits)), 100 * len(hits) / n, float(len({words[i] for i in hits})),
        math.log1p(hidden), math.log1p(near), 100 * second / n,
        math.log1p(len(found)), sum(found) / n * 100, max(found, default=0.0), float(len(set(found))),
        share(CAPITALS), share(LOUD), share(MARKS), share(DIGITS), 100 * (len(masked) + len(stretched)) / n,
    ]


def featured(docs: DataFrame, learned: dict[str, float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, features array<double>) of each whole text; a null text counts as empty."""

    def make():
        return lambda texts: (None, [[text_features(t or "", learned) for t in texts]])

    return map_texts(docs, key, text, "features array<double>", make)


def fold(key: str = "doc_id") -> Column:
    """crc32 of the key as text, modulo 5; a null key belongs to fold 1."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5, F.lit(1)).cast("int")


def learn_lexicon(texts: DataFrame) -> dict[str, float]:
    """Log-odds of the words that mark toxic texts among (text, y); counts in Spark."""
    marks = "[" + re.escape(BREAKS).replace("\\ ", " ") + "\\s]+"
    words = texts.select(
        "y", F.explode(F.array_distinct(F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), marks))).alias("word")
    ).filter("word <> ''")
    total = {int(r["y"]): r["n"] for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(total) < 2:
        return {}
    rate = lambda c, n: (F.col(c) + 0.5) / F.lit(n + 1.0)
    counted = words.groupBy("word").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("fine"))
    odds = F.log(rate("bad", total[1]) / rate("fine", total[0]))
    rows = (
        counted.filter(F.col("bad") >= max(3, math.ceil(0.005 * total[1])))
        .withColumn("odds", odds).filter(F.col("odds") >= math.log(LEARNED_ODDS))
        .orderBy(F.desc(F.col("odds") * F.sqrt("bad")), "word").limit(LEARNED_WORDS).collect()
    )
    return {r["word"]: float(r["odds"]) for r in rows}


class ToxicityModel:
    """Lexicon, trees and calibration, learned from documents with labels (key, toxic).

    Only rows outside fold 0 are used, about ``MAX_LABELLED`` of them at most. Folds
    2 to 4 give the lexicon and the trees, fold 1 the calibration. Labels that are
    null or contradict each other by half count as clean. Without labelled rows of
    both classes every score is that of the one class, 0 without any.
    """

    def __init__(self, docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic"):
        known = (
            labels.select(F.col(key).cast("long").alias("doc_id"), F.col(toxic).cast("double").alias("y"))
            .dropna().groupBy("doc_id").agg((F.avg("y") > 0.5).cast("int").alias("y")).filter(fold() != 0)
        )
        sample = bounded_sample(known, "doc_id")  # so it may be broadcast
        texts = (
            docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
            .join(F.broadcast(sample), "doc_id").select("doc_id", "text", "y", fold().alias("fold")).persist()
        )
        self.learned = learn_lexicon(texts.filter("fold <> 1").select("text", "y"))
        rows = featured(texts, self.learned).withColumn("fold", fold()).join(F.broadcast(sample), "doc_id").persist()
        self.trees = Trees(rows.filter("fold <> 1"), "features", "y")
        held = self.trees.score(rows.filter("fold = 1"), "features", "raw").select("raw", F.col("y").cast("double"))
        self.steps = None
        if self.trees.model is not None and not held.isEmpty():
            self.steps = IsotonicRegression(featuresCol="raw", labelCol="y", predictionCol="level").fit(held)
        texts.unpersist()
        rows.unpersist()

    def score(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """(key, score) of each whole text."""
        scored = self.trees.score(featured(docs, self.learned, key, text), "features", "raw").drop("features")
        if self.steps is None:
            return scored.select(key, F.col("raw").alias("score"))
        level = self.steps.transform(scored)
        return level.select(key, (F.col("level") * (1 - ORDER) + F.col("raw") * ORDER).alias("score"))

    def filter(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """The rows of ``docs`` scored below one half, all columns as they were.

        Texts stay where they are: features are attached to each row, not joined by a
        key. Null and empty texts are scored as empty ones; repeated rows and null
        keys are judged like others; no rows give no rows.
        """
        learned = self.learned
        features = text_function("array<double>", lambda: lambda texts: [text_features(t or "", learned) for t in texts])
        names = {c: f"__in{i}" for i, c in enumerate(docs.columns)}
        rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
        rows = rows.withColumn("features", features(F.col(names[text]).cast("string")))
        scored = self.trees.score(rows, "features", "raw")
        if self.steps is None:
            scored = scored.withColumn("__score", F.col("raw"))
        else:
            scored = self.steps.transform(scored).withColumn(
                "__score", F.col("level") * (1 - ORDER) + F.col("raw") * ORDER
            )
        return scored.filter("__score < 0.5").select(*[F.col(n).alias(c) for c, n in names.items()])


def score_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) for each row of ``docs``.

    held_out tells fold 0, whose labels are never seen; predicted is 1 from a score
    of one half. Null and empty texts are scored as empty ones; repeated rows and
    null keys stay; other columns are ignored; no rows give no rows.
    """
    model = ToxicityModel(docs, labels, key, text)
    return model.score(docs, key, text).select(
        key, (fold(key) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
