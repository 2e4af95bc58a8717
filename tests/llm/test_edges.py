"""Odd rows through the operators that judge texts and through the pipeline's stages."""

from collections import Counter

import pytest

pytest.importorskip("riskframe.llm")
import corpus_pipeline  # noqa: E402
from riskframe.llm import personal, quality, toxicity  # noqa: E402

LONG = "plain words about rivers and towns, written by nobody. " * 4000
GOOD = "The old harbour town keeps a small museum, where visitors read letters of sailors and see maps of distant coasts."


@pytest.fixture(scope="module")
def odd(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [
        (None, GOOD, "en", "s", len(GOOD)), (-1, None, None, None, None), (-2, "", "en", "s", 0),
        (-3, GOOD + " Again.", "en", "s", 0), (-3, GOOD + " Again.", "en", "s", 0), (-4, LONG, "en", "s", len(LONG)),
    ]
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(more).cache()


def keyed_ids(df):
    return Counter(r["doc_id"] for r in df.collect())


def keyed(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_toxicity_keeps_every_row_and_takes_empty_tables(spark, odd, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = toxicity.score_toxicity(odd, labels)
    assert keyed(got, "doc_id") == keyed(odd, "doc_id")
    twice = {r["score"] for r in got.collect() if r["doc_id"] == -3}
    assert len(twice) == 1
    assert toxicity.score_toxicity(odd.limit(0), labels).count() == 0


def test_quality_judges_repeated_rows_alike(odd):
    rows = quality.judge_quality(odd).collect()
    assert Counter(r["doc_id"] for r in rows) == keyed_ids(odd)
    pair = [tuple(r) for r in rows if r["doc_id"] == -3]
    assert len(pair) == 2 and pair[0] == pair[1]
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[-1]["n_words"] == by_id[-2]["n_words"] == 0 and not by_id[-2]["kept"]


def test_personal_data_of_long_texts_and_clashing_columns(spark):
    text = LONG + "write to a.b@c.de or +49 30 1234567."
    df = spark.createDataFrame([(1, text, 5, "k"), (1, text, 5, "k"), (2, None, 5, "k")], "doc_id long, text string, n_email int, spans string")
    rows = personal.personal_spans(df).collect()
    assert Counter((r["doc_id"], r["n_email"], r["n_phone"]) for r in rows) == Counter({(1, 1, 1): 2, (2, 0, 0): 1})
    start = text.index("a.b@c.de")
    assert all(f"email:{start}:{start + 8}" in r["spans"] for r in rows if r["doc_id"] == 1)


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows_and_empty_tables(spark, odd, sf_dir, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    got = run(spark, odd, sf_dir)
    none = run(spark, odd.limit(0), sf_dir)
    assert none.count() == 0 and none.columns == got.columns
    if stage == "packing":
        assert set(keyed_ids(got)) == set(keyed_ids(odd))
        whole = Counter()
        for r in got.collect():
            whole[r["sequence_id"]] += r["length"]
        assert max(whole.values()) <= 2048
        return
    assert got.columns == odd.columns
    kept, given = keyed_ids(got), keyed_ids(odd)
    assert not kept - given and kept[None] == 1  # a clean document without an id stays
    if stage in ("toxicity", "personal_data"):
        assert kept[-3] == 2
    if stage == "toxicity":
        toxic = {r["doc_id"] for r in toxicity.score_toxicity(odd, spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("predicted = 1").collect()}
        assert set(kept) == set(given) - toxic
    if stage == "personal_data":
        assert kept == given
        assert keyed(got.filter("doc_id = -4"), "text")[(LONG,)] == 1
    if stage == "near_duplicates":
        assert kept[-3] <= 1
    if stage == "quality_rules":
        good = {r["doc_id"] for r in quality.judge_quality(odd).filter("kept").collect()}
        assert set(kept) == good and -2 not in kept
