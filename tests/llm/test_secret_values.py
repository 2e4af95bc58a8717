"""Guess-cost spans next to and across the spans of the fixed patterns."""

import itertools
import math
import random

import pytest

pytest.importorskip("riskframe.llm")
from riskframe.llm import guesses, secret_spans  # noqa: E402
from riskframe.llm.queries import tokenizer_path  # noqa: E402


def spans(text):
    base = secret_spans.base_spans(text)
    return base, secret_spans.guessed_spans(text, base)


def test_values_that_run_beyond_a_base_span_are_costed():
    text = "password=Tr0ub4dor&3xYz end"
    assert spans(text) == ([(0, 0, 18)], [(9, 3, 23)])
    text = "token: " + "0f" * 12 + "!Zq9#"
    base, found = spans(text)
    assert base == [(0, 0, 31), (7, 2, 31)] and found == [(7, 3, 36)]
    # an access key inside a value, and a base span that begins inside it
    text = "secret is x&AKIA" + "Q1" * 8
    base, found = spans(text)
    assert base == [(12, 1, 32)] and found == [(10, 3, 32)]


def test_values_covered_by_one_base_span_and_cheap_ones_add_nothing():
    assert spans("password=Tr0ub4dor3xYz.")[1] == [] and spans("token=abcdef12, x")[1] == []
    assert spans("password=changeme! x")[1] == []
    text = "password=Tr0ub4dor&3xYz " * 20_000
    base, found = spans(text)
    assert len(base) == len(found) == 20_000


def test_base_columns_and_digest_stay(spark):
    texts = ["password=Tr0ub4dor&3xYz", "password=Tr0ub4dor"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    a, b = sorted(secret_spans.secret_spans(df).collect())
    assert a["base_sha256"] == b["base_sha256"] and a["n_assign"] == b["n_assign"] == 1
    assert a["spans"] == "assign:0:18,guess:9:23" and b["spans"] == "assign:0:18"


ROWS = ["1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz"]


def plain_piece(value, i, j, ranks):
    """Cheapest single reading of value[i:j], or infinity; written for clarity only."""
    piece, low, costs = value[i:j], value[i:j].lower(), []
    swapped = low.translate(str.maketrans("@4301!$57", "aaeoiisst"))
    if j - i == 1:
        joined = piece in "-_./:" and 0 < i < len(value) - 1 and value[i - 1].isalnum() and value[j].isalnum()
        return math.log10(5 if joined else 10 if piece.isdigit() else 26 if piece.isalpha() else 33)
    if j - i >= 3 and (low in ranks or swapped in ranks):
        rank = min(ranks.get(low, 10**9), ranks.get(swapped, 10**9))
        costs.append(math.log10(rank + 1) + 0.3 * (piece != low) + 0.3 * (swapped != low))
    if len(piece) == 4 and piece.isdigit() and piece[:2] in ("19", "20"):
        costs.append(math.log10(120))
    for row in ROWS:
        for line in (row, row[::-1]):
            for more in (value[j : j + 1].lower(),):
                if j - i >= 3 and low in line and not (more and low + more in line):
                    costs.append(math.log10(40 * (j - i)))
    if j - i >= 4 and low.isalpha() and not value[j : j + 1].isalpha() and sum(low.count(v) for v in "aeiouy") >= 0.2 * (j - i):
        costs.append(0.6 * (j - i))
    for size in range(1, (j - i) // 2 + 1):
        number = (j - i) // size
        block = piece[:size]
        if block * number == piece and number >= (3 if size == 1 else 2) and value[j : j + size] != block:
            costs.append(plain_guesses(block, ranks) + math.log10(number))
    return min(costs, default=math.inf) + 0.3


def plain_guesses(value, ranks):
    """Every way to cut the value."""
    best = math.inf if value else 0.0
    for cuts in itertools.product([0, 1], repeat=max(len(value) - 1, 0)):
        ends = [0, *[k + 1 for k, c in enumerate(cuts) if c], len(value)]
        best = min(best, sum(plain_piece(value, a, b, ranks) for a, b in zip(ends, ends[1:])))
    return best


def test_costs_equal_every_segmentation():
    draw = random.Random(5)
    parts = ["ab", "12", "P4ss", "test", "Xy9", "_", "1999", "zzz", "qwe", "!", "9", "lemon", "cba"]
    ranks = guesses.Ranks(["test", "pass", "lemon"], ["zzz", "ab", "nine", "test"])
    values = {"".join(draw.choice(parts) for _ in range(draw.randint(1, 4)))[:9] for _ in range(120)}
    for value in values:
        assert guesses.log_guesses(value, ranks) == pytest.approx(plain_guesses(value, ranks.of)), value


def test_settings_stamps_and_repeats_are_cheap_and_random_values_dear():
    ranks = guesses.with_vocabulary(tokenizer_path())
    for value in ["process.env.SECRET", "configuration_manager", "${DB_PASSWORD}", "20240131120000", "2024-01-31T12:05:09Z",
                  "Xy9Xy9Xy9Xy9!", "correct-token", "abc" * 40_000, "x" * 100_000]:
        assert guesses.log_guesses(value, ranks) < secret_spans.COSTLY, value
    for value in ["Tr0ub4dor&3xYz", "kJ8#vQ2!zR5p", "xK9mQ2vL8pR4tW", "p@9Zr!7Lq&2Vx"]:
        assert guesses.log_guesses(value, ranks) >= secret_spans.COSTLY, value
    long = "".join(chr(33 + k * k % 90) for k in range(200_000))
    assert guesses.log_guesses(long + long, ranks) < guesses.log_guesses(long, ranks) + 2


def test_null_keys_repeats_and_clashing_columns(spark):
    rows = [(None, "token is kJ8#vQ2!zR5p", 1), (3, None, 2), (3, "", 2), (5, "token is kJ8#vQ2!zR5p", 3), (5, "token is kJ8#vQ2!zR5p", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_hex int")
    got = secret_spans.secret_spans(df, vocabulary=tokenizer_path()).collect()
    assert sorted((r["doc_id"] or 0, r["spans"], r["n_hex"]) for r in got) == [
        (0, "guess:9:21", 0), (3, "", 0), (3, "", 0), (5, "guess:9:21", 0), (5, "guess:9:21", 0)
    ]
    assert secret_spans.secret_spans(df.limit(0)).count() == 0
