"""Fingerprints against a plain version; order, ties and texts that take no part."""

import hashlib
import random

import pytest

pytest.importorskip("riskframe.llm")
from pyspark.sql import functions as F  # noqa: E402

from riskframe.llm import fingerprints  # noqa: E402

BLANKS = " \t\n\x0b\f\r"


def sketch(text, limit="2"):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    for c in BLANKS[1:]:
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    shingles = [words[i : i + 5] for i in range(len(words) - 4)] or ([words] if words else [])
    hashes = {hashlib.md5(" ".join(s).encode()).hexdigest()[:16] for s in shingles}
    return len(words), sorted(h for h in hashes if h < limit)


def alike(a, b):
    (n, x), (m, y) = a, b
    if min(len(x), len(y)):
        return len(set(x) & set(y)) / min(len(x), len(y))
    return 1.0 if not x and not y and n == m else 0.0


def plain(rows):
    first = {}
    for k, t in rows:
        if k is not None:
            first[k] = min(first.get(k, t or ""), t or "", key=lambda x: hashlib.sha256(x.encode()).hexdigest())
    order = sorted(first, reverse=True)
    after = dict(zip(order, [*order[1:], *order[:1]]))
    out = []
    for k, t in rows:
        t = t or ""
        follow = first[after[k]] if k is not None else None
        cut = len(t) // 3
        edited = t if follow is None else t[: len(t) - cut] + follow[:cut]
        a, b = sketch(t), sketch(edited)
        shown = [f"{n}:{','.join(s)}" for n, s in (a, b)]
        near = None if follow is None else alike(a, sketch(follow))
        out.append((k, len(t), hashlib.sha256(edited.encode()).hexdigest(), *shown, alike(a, b), near))
    return out


def key(row):
    return tuple(str(x) for x in row)


def run(spark, rows):
    df = spark.createDataFrame([(k, t, 3, "x") for k, t in rows], "doc_id long, text string, words int, t string")
    return sorted((tuple(r) for r in fingerprints.fingerprint_documents(df.repartition(5)).collect()), key=key)


def test_against_a_plain_version(spark):
    draw = random.Random(4)
    words = [f"Wört{i}" for i in range(50)] + ["ÄÖ", "naïve", "İ", "𝔘𝔫𝔦", "x\x0by"]
    texts = [draw.choice(" \t\n").join(draw.choice(words) for _ in range(draw.choice([0, 1, 3, 4, 5, 6, 30, 300]))) for _ in range(60)]
    rows = [(draw.randrange(-(2**60), 2**60), t) for t in texts]
    rows += [(10**6, None), (10**6 + 1, ""), (10**6 + 2, " \n"), (10**6 + 3, "a " * 40_000), (10**6 + 4, texts[7])]
    assert run(spark, rows) == sorted(plain(rows), key=key)


def test_repeated_and_null_keys(spark):
    rows = [(5, "one two three four five six"), (5, "one two three four five six"), (5, "another text of it"), (3, "z " * 9)]
    rows += [(None, "without a key this text has no next one"), (None, None), (9, "the last one borrows " * 30)]
    assert run(spark, rows) == sorted(plain(rows), key=key)
    assert run(spark, [(1, "alone in the table")]) == plain([(1, "alone in the table")])
    assert run(spark, [(None, "no key")]) == plain([(None, "no key")])
    assert run(spark, []) == []


def test_equal_texts_and_unions(spark):
    text = " ".join(f"w{i}" for i in range(400))
    df = spark.createDataFrame([(text, " ".join(text.split()[:100]))], "a string, b string")
    row = df.select(
        fingerprints.sketch_of(fingerprints.words_of(F.col("a"))).alias("a"),
        fingerprints.sketch_of(fingerprints.words_of(F.col("b"))).alias("b"),
    ).first()
    assert set(row["b"]) < set(row["a"]) and 20 < len(row["a"]) < 80  # a part is wholly contained


def test_successors_over_ranges(spark):
    ids = [1, 2, 3, 10, 2**60, 2**60 + 1, 2**60 + 2, -5, *range(1000, 1500)]
    table = spark.createDataFrame([(i,) for i in ids], "id long")
    order = sorted(ids, reverse=True)
    for parts in (1, 4, 60):
        got = {r["id"]: r["next"] for r in fingerprints.successors(table, parts).collect()}
        assert got == dict(zip(order, [*order[1:], *order[:1]]))


def test_no_python_in_the_plan(spark, sf_dir):
    found = fingerprints.fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
