"""Encoding, decoding and packing against the tokenizers library and plain checks."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("riskframe.llm")
tokenizers = pytest.importorskip("tokenizers")
from riskframe.llm import bpe, packing  # noqa: E402
from riskframe.llm.common import TEXTS_PER_CALL, Workspace, text_function  # noqa: E402
from riskframe.llm.queries import tokenizer_path  # noqa: E402
from riskframe.session import BATCH_BYTES  # noqa: E402

PARTS = [" ", "  ", "\n", "\t", "a", "'s", "é", "1", "!", "<|endoftext|>", " ", "hello", "\x1c", "\u0085", "😀", "٣", "foo.", "'"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(tokenizer_path())


def texts(n=400):
    draw = random.Random(3)
    return ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 25))) for _ in range(n)] + ["word " * 6000, "x" * 50_000]


def test_ids_and_round_trip_equal_the_library(spark, library):
    rows = list(enumerate(texts())) + [(None, None), (7, "again hello"), (7, "again hello")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter()
    for key, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        whole = library.decode(ids, skip_special_tokens=False)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[(key, len(ids), digest(",".join(map(str, ids))), digest(whole))] += 1
    assert Counter(tuple(r) for r in bpe.round_trip(df, tokenizer_path()).collect()) == want
    assert bpe.round_trip(df.limit(0), tokenizer_path()).count() == 0


def test_pieces_fill_sequences_without_gaps(spark, library):
    rows = list(enumerate(texts(300))) + [(None, None), (1, "twice"), (1, "twice")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, offset int")
    got = packing.pack_documents(df, tokenizer_path(), capacity=64).collect()
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    total = 0
    for filled in bins.values():
        place = 0
        for offset, length in sorted(filled):
            assert offset == place
            place += length
        assert place <= 64
        total += place
    assert len(bins) <= 1.02 * total / 64 + 2
    lengths = Counter()
    for r in got:
        lengths[r["doc_id"]] += r["length"]
    ids = {key: library.encode(text or "", add_special_tokens=False).ids + [0] for key, text in rows if key != 1}
    assert all(lengths[key] == len(v) for key, v in ids.items())
    for r in got:
        if r["doc_id"] in ids:
            part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
            assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
    assert packing.pack_documents(df.limit(0), tokenizer_path()).count() == 0


def test_plan_uses_few_bins_and_places_every_rank():
    draw = random.Random(1)
    counts = Counter(min(128, max(1, int(draw.lognormvariate(3.5, 1)))) for _ in range(5000))
    placed = packing.plan(counts, 128)
    for length, number in counts.items():
        ranks = sorted((first, first + n) for first, n, _, _ in placed[length])
        assert ranks[0][0] == 0 and ranks[-1][1] == number
        assert all(a[1] == b[0] for a, b in zip(ranks, ranks[1:]))
    used = max(start + n for runs in placed.values() for _, n, start, _ in runs)
    assert used <= 1.01 * sum(k * v for k, v in counts.items()) / 128 + 1


def plain_bins(pieces, capacity):
    """Longest first, one by one: the gap that leaves the smallest sum of squares, a bin only where none has room."""
    gaps, used = Counter(), 0
    for length in sorted(pieces, reverse=True):
        def after(gap):
            moved = gaps.copy()
            moved[gap] -= 1
            if gap > length:
                moved[gap - length] += 1
            return sum(n * n for n in moved.values()) - sum(n * n for n in gaps.values())

        fits = [g for g, n in gaps.items() if n > 0 and g >= length]
        if not fits:
            used += 1
            gaps[capacity] += 1
            fits = [capacity]
        gap = min(sorted(fits), key=after)
        gaps[gap] -= 1
        if gap > length:
            gaps[gap - length] += 1
    return used


def bins_of(counts, capacity):
    placed = packing.plan(counts, capacity)
    return max(start + n for runs in placed.values() for _, n, start, _ in runs)


def test_plan_takes_as_many_bins_as_the_rule_piece_by_piece():
    draw = random.Random(4)
    adverse = Counter({70: 300, 50: 300, 30: 300})
    thirds = Counter({69: 200, 68: 200, 102: 150, 35: 100})
    mixed = Counter(draw.randint(1, 204) for _ in range(1500))
    for counts in (adverse, thirds, mixed):
        assert bins_of(counts, 204) <= 1.01 * plain_bins(list(counts.elements()), 204)
    # steps do not grow with the counts, nor does the share of bins above the least possible
    large = Counter({k: 1000 * n for k, n in mixed.items()})
    assert bins_of(large, 204) <= 1001 * bins_of(mixed, 204)
    assert sum(map(len, packing.plan(large, 204).values())) < 200_000


def test_clashing_columns_of_encoding_and_packing(spark, library):
    df = spark.createDataFrame([(1, "hello", 9, "x"), (2, None, 9, "x")], "doc_id long, text string, n_tokens int, sequence_id string")
    got = {r["doc_id"]: r["n_tokens"] for r in bpe.round_trip(df, tokenizer_path()).collect()}
    assert got == {1: len(library.encode("hello").ids), 2: 0}
    packed = packing.pack_documents(df, tokenizer_path(), capacity=8).collect()
    assert sorted((r["doc_id"], r["length"]) for r in packed) == [(1, got[1] + 1), (2, 1)]


def test_remembered_words_are_bounded_in_bytes(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 60_000)
    draw = random.Random(5)
    rows = [" ".join(f"w{draw.randrange(10**9)}" for _ in range(40)) for _ in range(600)] + texts(100) + ["é😀" * 9000 + " a"]
    encoder = bpe.Encoder(tokenizer_path())
    most = 0
    for start in range(0, len(rows), 64):
        part = rows[start : start + 64]
        for text, ids in zip(part, encoder.encode(part), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        most = max(most, len(encoder.words))
    # one lookup's words may come on top
    assert most * bpe.PER_WORD <= 60_000 + bpe.TEXTS_AT_ONCE * 60 * (bpe.PER_WORD + 40)
    assert encoder.encode([]) == []


def test_a_table_written_in_passing_reaches_python_in_small_batches(spark, tmp_path):
    name = BATCH_BYTES[0]
    before = spark.conf.get(name, None)
    docs = spark.range(4000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("abc "), 2000).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    rows = Workspace(spark, "test").settle(docs.mapInArrow(sizes, "n long"), "sizes").collect()
    assert sum(r["n"] for r in rows) >= 4000 * 8000 and max(r["n"] for r in rows) <= 12 << 20
    assert spark.conf.get(name, None) == before


def test_a_text_function_gives_its_values_as_they_come(spark):
    sent = []
    upper = text_function("string", lambda: lambda part: [t and t.upper() for t in part])
    values = [None, "", *(f"x{i}" for i in range(1000))]
    for out in upper.func(iter([pa.array(values), pa.array([], pa.string())])):
        sent.append(out)
    assert [v for out in sent for v in out.to_pylist()] == [v and v.upper() for v in values]
    assert max(map(len, sent)) <= TEXTS_PER_CALL
    df = spark.createDataFrame(list(enumerate(values)), "i long, t string").coalesce(1)
    assert {r["i"]: r["u"] for r in df.select("i", upper("t").alias("u")).collect()} == {
        i: v and v.upper() for i, v in enumerate(values)
    }
