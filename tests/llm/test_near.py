"""Near-duplicate texts and vectors against all pairs; components against union-find."""

import random

import numpy as np
import pytest

pytest.importorskip("riskframe.llm")
from riskframe.llm import common, near_text, near_vectors  # noqa: E402


def roots(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components_with_and_without_rounds(spark, monkeypatch):
    draw = random.Random(2)
    links = [(i, i + 1) for i in range(0, 300)] + [(draw.randint(400, 900), draw.randint(400, 900)) for _ in range(300)]
    edges = spark.createDataFrame(links + [(5, 5), (None, 3)], "a long, b long").repartition(6)
    want = roots({x for e in links for x in e}, links)
    touched = {x for a, b in links if a != b for x in (a, b)}
    for bound in (common.LOCAL_EDGES, 40):
        monkeypatch.setattr(common, "LOCAL_EDGES", bound)
        got = {r["node"]: r["root"] for r in common.components(edges).collect()}
        assert got == {x: want[x] for x in touched}
    assert common.components(edges.limit(0)).count() == 0


def test_texts_against_all_pairs(spark):
    draw = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    base = [draw.choice(words) for _ in range(120)]
    texts = []
    for i in range(150):  # one large group around the threshold
        copy = list(base)
        for _ in range(draw.randint(0, 6)):
            copy[draw.randrange(len(copy))] = draw.choice(words)
        texts.append(" ".join(copy))
    texts += [" ".join(draw.choice(words) for _ in range(n)) for n in (1, 2, 3, 5, 9, 40, 700, 3000)]
    texts += [texts[3], texts[3].upper(), "a b", "A  b\n", "", " \t", None, "only one"] + ["tiny set of six words"] * 3
    rows = [(10 + i, t, 0) for i, t in enumerate(texts)] + [(None, texts[0], 0), (10, "other text of a repeated id", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_shingles int").repartition(5)

    def shingles(text):
        found = (text or "").encode().lower().split()
        return frozenset(tuple(found[i : i + 3]) for i in range(max(1, len(found) - 2))) if found else frozenset()

    sets = [(k, shingles(t)) for k, t, _ in rows if k is not None]
    links = [
        (a, b) for i, (a, x) in enumerate(sets) for b, y in sets[i + 1 :]
        if x and y and a != b and 100 * len(x & y) >= 85 * len(x | y)
    ]
    want = roots([k for k, _ in sets], links)
    got = near_text.near_duplicates(df, 3, 85).collect()
    assert len(got) == len(rows)
    assert all(r["component_id"] == want.get(r["doc_id"]) for r in got)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert near_text.near_duplicates(df.limit(0), 3, 85).count() == 0


def test_unlike_texts_under_one_id_all_stay(spark):
    import corpus_pipeline

    draw = random.Random(3)
    x, y, z = (" ".join(f"{c}{draw.randrange(10_000)}" for _ in range(120)) for c in "xyz")
    near_y = y + " tail"
    rows = [(5, x, "a"), (5, y, "b"), (9, near_y, "c"), (7, z, "d"), (3, z.upper(), "e"), (5, y, "f"), (5, y, "b")]
    rows += [(5, z + " end", "g"), (None, x, "h"), (4, None, "i"), (4, " ", "j"), (4, "", "k")]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string")
    seen = set()
    for parts in (1, 4):
        kept = corpus_pipeline.drop_copies(spark, df.repartition(parts), "")
        assert kept.columns == df.columns and kept.schema["doc_id"].dataType == df.schema["doc_id"].dataType
        found = sorted((r["doc_id"] or 0, str(r["text"]), r["source"]) for r in kept.collect())
        assert [(k, t) for k, t, _ in found] == sorted(
            [(5, x), (5, y), (3, z.upper()), (0, x), (4, "None"), (4, " "), (4, "")]
        )
        seen.add(str(found))
    assert len(seen) == 1  # the same row each time, however the rows are dealt
    whole = df.selectExpr("CAST(doc_id AS long) AS doc_id", "text", "source")
    crowd = whole.unionByName(whole.limit(0)).unionByName(whole).unionByName(whole)  # every row three times
    again = corpus_pipeline.drop_copies(spark, crowd, "").filter("doc_id IN (3, 5)").collect()
    assert sorted((r["doc_id"], r["text"]) for r in again) == sorted([(5, x), (5, y), (3, z.upper())])
    plan = kept._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "Python" not in plan and "Arrow" not in plan  # texts meet the keepers by name, none is shingled again
    assert corpus_pipeline.drop_copies(spark, df.limit(0), "").count() == 0


def test_vectors_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "TILE", 16)
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(12, 20))
    rows = []
    for i in range(220):
        v = centres[i % 12] + 0.12 * draw.normal(size=20)
        rows.append((1000 - i, [float(x) for x in v], i % 3))
    rows += [(2000 + i, rows[5][1], rows[5][2]) for i in range(4)] + [(7, rows[0][1], None), (8, None, 1), (9, [0.0] * 20, 1)]
    rows += [(11, [float("nan")] * 20, 1), (12, [1.0, None], 1), (13, [1.0, 0.0], 1), (14, [2.0, 0.0], 1), (None, rows[2][1], 2)]
    rows += [(15, [], 1), (16, [3e300, 0.0], 1), (17, [1e-300, 0.0], 1)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int, n_links int")
    usable = [
        (k, np.array(v), label) for k, v, label in rows
        if k is not None and label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)
    ]
    unit = [v / np.abs(v).max() for _, v, _ in usable]
    unit = [v / np.linalg.norm(v) for v in unit]
    count, links = {k: 0 for k, *_ in rows if k is not None}, []
    for i, (a, _, la) in enumerate(usable):
        for j in range(i + 1, len(usable)):
            b, _, lb = usable[j]
            if la == lb and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98:
                count[a] += 1
                count[b] += 1
                links.append((a, b))
    want = roots(count, links)
    got = near_vectors.near_vectors(df, 0.98).collect()
    assert len(got) == len(rows) and len(links) > 50
    for r in got:
        if r["vec_id"] is not None:
            assert (r["n_links"], r["component_id"]) == (count[r["vec_id"]], want[r["vec_id"]]), r
    assert near_vectors.near_vectors(df.limit(0), 0.98).count() == 0
