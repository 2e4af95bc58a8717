"""Exact products, codes and whitening against plain versions; vectors that take no part."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

pytest.importorskip("riskframe.llm")
from riskframe.llm import eigen, limbs, vector_codes, whitening  # noqa: E402

SCHEMA = "vec_id long, embedding array<float>, label int, code string, n int"


def table(spark, rows, parts=4):
    return spark.createDataFrame([(k, v, lab, "clash", 7) for k, v, lab in rows], SCHEMA).repartition(parts)


def draws(n, d, seed=3, wide=1.0):
    rng = np.random.default_rng(seed)
    return [[float(np.float32(x)) for x in row] for row in rng.normal(0, wide, (n, d))]


@pytest.mark.parametrize("size", [1, 2**11, 2**25, 2**28])
@pytest.mark.parametrize("inner", [1, 3, 16, 200])
def test_products_are_exact(size, inner):
    rng = np.random.default_rng(size + inner)
    reach = min(size, math.isqrt(2**62 // inner))
    a, b = rng.integers(-reach, reach + 1, (7, inner)), rng.integers(-reach, reach + 1, (inner, 5))
    assert limbs.exact_products(a, b).tolist() == (a.astype(object) @ b.astype(object)).tolist()
    bits = limbs.limb_bits(inner)
    for part in limbs.split_limbs(a, bits):
        assert np.abs(part).max() <= 2**bits and inner * 4**bits <= 2**53
    if size >= 2**25:
        assert len(limbs.split_limbs(a, bits)) >= 2 or reach <= 2**bits


def plain_codes(rows, entries=256, rounds=4, parts=4):
    kept = sorted((k, [math.floor(1024 * x) for x in v], lab) for k, v, lab in rows)
    width = len(kept[0][1]) // parts
    cut = [[x[p * width : (p + 1) * width] for _, x, _ in kept] for p in range(parts)]
    books = [c[:entries] for c in cut]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for step in range(rounds + 1):
        hits = [[near(x, book) for x in c] for c, book in zip(cut, books)]
        if step == rounds:
            break
        for c, book, found in zip(cut, books, hits):
            for i in range(len(book)):
                mine = [x for x, (_, j) in zip(c, found) if j == i]
                if mine:
                    book[i] = [sum(col) // len(mine) for col in zip(*mine)]
    flat = ",".join(str(x) for book in books for e in book for x in e)
    error = [sum(h[r][0] for h in hits) for r in range(len(kept))]
    by_label = {}
    for (_, _, lab), e in zip(kept, error):
        by_label[lab] = by_label.get(lab, 0) + e
    return [
        (k, "".join(f"{h[r][1]:02x}" for h in hits), error[r], by_label[lab], hashlib.sha256(flat.encode()).hexdigest())
        for r, (k, _, lab) in enumerate(kept)
    ]


def test_codes_against_a_plain_version(spark):
    vectors = draws(330, 8) + draws(5, 8, 4, 60_000.0)  # limbs are split for the large ones
    rows = [(1000 - i, v, i % 3 if i % 7 else None) for i, v in enumerate(vectors)]
    rows += [(2000 + i, rows[i][1], 1) for i in range(20)]  # copies
    bad = [(1, None, 0), (2, [1.0] * 7 + [None], 0), (3, [float("nan")] + [0.0] * 7, 0), (4, [float("inf")] * 8, 0)]
    got = vector_codes.compress_vectors(table(spark, rows + bad)).collect()
    assert sorted(tuple(r) for r in got) == sorted(plain_codes(rows))
    few = rows[:9]
    got = vector_codes.compress_vectors(table(spark, few)).collect()
    assert sorted(tuple(r) for r in got) == sorted(plain_codes(few))


def test_codes_of_odd_tables(spark):
    empty = vector_codes.compress_vectors(table(spark, []))
    assert empty.count() == 0 and empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    rows = [(5, [1.0] * 8, 0), (6, [1.0] * 4, 0), (None, [2.0] * 8, None), (7, [3e38] * 8, 0), (5, [1.0] * 8, 0), (8, [], 1)]
    got = vector_codes.compress_vectors(table(spark, rows)).collect()
    found = sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"]) for r in got if r["code"])
    assert found == [("5", "00" * 4, 0, 0), ("5", "00" * 4, 0, 0), ("None", "02" * 4, 0, 0)]
    assert sorted(r["vec_id"] for r in got if r["code"] is None) == [6, 7, 8]
    assert vector_codes.compress_vectors(table(spark, [(1, None, 0)])).count() == 0


@pytest.mark.parametrize("gap", [0, 1e-15, 1e-12, 1e-9, 1e-6, 1e-3])
def test_eigenvectors_of_clusters(gap):
    rng = np.random.default_rng(5)
    turn, _ = np.linalg.qr(rng.normal(size=(40, 40)))
    values = np.concatenate([1 + gap * np.arange(10), 5 + gap * np.arange(4), np.linspace(8, 20, 26)])
    a = (turn * values) @ turn.T
    a = (a + a.T) / 2
    found, x = eigen.eigen(a)
    assert np.abs(found - np.linalg.eigvalsh(a)[::-1]).max() < 1e-14 * 20
    assert np.abs(x.T @ x - np.eye(40)).max() < 1e-14
    wide = a.astype(np.longdouble)
    assert np.abs(wide @ x - x * found).max() < 1e-14 * 20
    if gap >= 1e-6:  # far enough apart to be known one by one
        assert np.abs(np.abs(np.linalg.eigh(a)[1][:, ::-1].T @ x) - np.eye(40)).max() < 1e-6


def test_eigenvectors_of_plain_matrices():
    for a in (np.zeros((3, 3)), np.eye(4) * 7, np.array([[2.0]]), np.diag([1e-20, 1.0, 5.0]), np.diag([3e-300, 1e-300])):
        values, x = eigen.eigen(a)
        assert np.allclose(values, np.sort(np.diag(a))[::-1], rtol=1e-14, atol=0) and np.allclose(np.abs(x).sum(axis=0), 1)
    low = np.eye(5) + np.ones((5, 5))
    assert np.allclose(eigen.eigen(low)[0], [6, 1, 1, 1, 1])


def plain_whitening(rows, components=16):
    xs = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v, _ in rows]
    fit = sorted({tuple(x) for x in xs})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[i] for x in fit) for i in range(d)]
    centred = [[Fraction(x[i] * n - sums[i], n) for i in range(d)] for x in fit]
    cov = [[float(sum(c[i] * c[j] for c in centred) / n) for j in range(d)] for i in range(d)]
    values, axes = np.linalg.eigh(np.array(cov))
    values, axes = values[::-1], axes[:, ::-1]
    out = {}
    for (k, _, _), x in zip(rows, xs):
        dev = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        gap = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums)])
        for c in range(min(components, d)):
            out[k, c + 1] = (n, dev, gap @ axes[:, c] / math.sqrt(values[c]), values[c] / np.trace(np.array(cov)))
    return out


def test_whitening_against_a_plain_version(spark):
    vectors = [[x * (1 + i / 4) for i, x in enumerate(v)] for v in draws(120, 20)]
    vectors = [[float(np.float32(x)) for x in v] for v in vectors]
    rows = [(i, v, 0) for i, v in enumerate(vectors)] + [(900 + i, vectors[0], 1) for i in range(60)]  # copies count once
    bad = [(-1, None, 0), (-2, [None] * 20, 0), (-3, [float("inf")] * 20, 0)]
    got = whitening.whiten_vectors(table(spark, rows + bad)).collect()
    want = plain_whitening(rows)
    assert len(got) == len(want)
    sign = {}
    for r in got:
        n, dev, white, share = want[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, dev) and abs(r["explained"] - share) < 1e-12
        assert r["identity_error"] < 1e-10
        turn = sign.setdefault(r["component"], 1 if white * r["whitened"] >= 0 else -1)
        assert abs(turn * r["whitened"] - white) < 1e-8


def test_whitening_of_odd_tables(spark):
    empty = whitening.whiten_vectors(table(spark, []))
    assert empty.count() == 0
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert empty.columns == names
    one = whitening.whiten_vectors(table(spark, [(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0)])).collect()
    assert sorted(tuple(r) for r in one) == [(1, c, 1, 0, None, 0.0, None) for c in (1, 1, 2, 2)]
    rows = [(1, [1.0, 0.0], 0), (None, [3.0, 0.0], 0), (2, [1.0], 0), (3, [1e30, 0.0], 0), (4, [], 0)]
    got = whitening.whiten_vectors(table(spark, rows)).collect()
    assert sorted(r["vec_id"] for r in got if r["component"] is None) == [2, 3, 4]
    found = {(r["vec_id"], r["component"]): r["whitened"] for r in got if r["component"]}
    assert {k: v and abs(v) for k, v in found.items()} == {(1, 1): 1.0, (1, 2): None, (None, 1): 1.0, (None, 2): None}


def test_deviations_next_to_the_largest_long():
    dx = np.array([[3_037_000_499, 0], [3_037_000_500, 0], [2_147_483_648, 2_147_483_647]], np.int64)
    rest = np.zeros(2, np.int64)
    assert whitening.deviations(dx, 1, rest) == [3_037_000_499**2, None, 2_147_483_648**2 + 2_147_483_647**2]
