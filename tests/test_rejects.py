import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import rejects
from riskframe.operators.neighbours import nearest_neighbours

ROWS = [(1, 0, 0.9), (2, 1, 0.5), (3, -1, 0.25), (4, -1, 0.9)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "id int, y int, p double")


def weights(frame):
    return {(r["id"], r["y"]): r["w"] for r in frame.collect()}


def test_upward_and_downward_keep_accepted_rows_only(spark, df):
    assert weights(rejects.upward(df, "p")) == {(1, 0): pytest.approx(1 / 0.9), (2, 1): 2.0}
    assert weights(rejects.downward(df, "p")) == {(1, 0): pytest.approx(0.1), (2, 1): 0.5}
    zero = spark.createDataFrame([(1, 0, 0.0)], "id int, y int, p double")
    assert weights(rejects.upward(zero, "p")) == {(1, 0): None}
    assert weights(rejects.upward(zero, "p", floor=0.1)) == {(1, 0): 10.0}


def test_parcels_share_each_rejected_row(df):
    got = rejects.fuzzy_parcels(df, "p")
    assert weights(got) == {
        (1, 0): 1.0, (2, 1): 1.0, (3, 0): 0.75, (3, 1): 0.25,
        (4, 0): pytest.approx(0.1), (4, 1): 0.9,
    }
    sums = got.groupBy("id").agg(F.sum("w").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1.0) for r in sums)


def test_extrapolation_modes(df):
    assert set(weights(rejects.extrapolate(df, "p", "positive"))) == {(1, 0), (2, 1), (4, 1)}
    assert set(weights(rejects.extrapolate(df, "p", "all"))) == {(1, 0), (2, 1), (3, 0), (4, 1)}
    assert set(weights(rejects.extrapolate(df, "p", "confident"))) == {(1, 0), (2, 1), (4, 1)}
    with pytest.raises(ValueError, match="unknown mode"):
        rejects.extrapolate(df, "p", "sure")


def reference_soft_cutoff(p, accepted, points, close):
    edges = np.round(np.quantile(p, np.linspace(0, 1, points)), 6)
    w = np.ones(len(p))
    for low, high in zip(edges[:-1], edges[1:]):
        inside = (p >= low) & (p < high)
        if close and high == edges[-1]:
            inside |= p == high
        if inside.any() and accepted[inside].mean() > 0:
            w[inside] = 1 / accepted[inside].mean()
    return w


@pytest.mark.parametrize("points", [5, 40])
def test_soft_cutoff_against_its_definition(spark, points):
    rng = np.random.default_rng(2)
    p = np.round(np.concatenate([rng.random(300), np.full(150, 0.3)]), 3)
    accepted = rng.random(450) < 0.7
    rows = [(i, 0 if a else -1, float(v)) for i, (v, a) in enumerate(zip(p, accepted))]
    df = spark.createDataFrame(rows, "id int, y int, p double")
    want = reference_soft_cutoff(p, accepted, points, False)
    got = {r["id"]: r["w"] for r in rejects.soft_cutoff(df, "p", points).collect()}
    assert set(got) == set(np.flatnonzero(accepted).tolist())
    assert all(got[i] == pytest.approx(want[i]) for i in got)


def test_soft_cutoff_of_the_maximum(spark):
    rows = [(0, 0, 0.1), (1, -1, 0.1), (2, 0, 0.9), (3, -1, 0.9)]
    df = spark.createDataFrame(rows, "id int, y int, p double")
    assert weights(rejects.soft_cutoff(df, "p", 2)) == {(0, 0): 2.0, (2, 0): 1.0}
    closed = rejects.soft_cutoff(df, "p", 2, close_last_bin=True)
    assert weights(closed) == {(0, 0): 2.0, (2, 0): 2.0}
    same = spark.createDataFrame([(0, 0, 0.4), (1, -1, 0.4)], "id int, y int, p double")
    assert weights(rejects.soft_cutoff(same, "p", 10)) == {(0, 0): 1.0}


def brute_neighbours(ids, vectors, k):
    out = set()
    for i, v in zip(ids, vectors):
        gaps = np.round(np.sqrt(((vectors - v) ** 2).sum(axis=1)), 9)
        order = sorted((g, j) for g, j in zip(gaps, ids) if j != i)[: k - 1]
        out |= {(i, i, 0.0), *((i, j, float(g)) for g, j in order)}
    return out


@pytest.fixture(scope="module")
def crowd(spark):
    """Clusters, near copies, ties on a lattice, and a third of equal vectors."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 3)) * 8
    loose = centres[rng.integers(0, 6, 180)] + rng.normal(size=(180, 3))
    lattice = np.array([[x, y, 0.0] for x in range(6) for y in range(5)])
    copies = np.tile([1.5, -2.0, 0.25], (100, 1))
    vectors = np.concatenate([loose, lattice, copies])
    ids = list(rng.permutation(len(vectors)) + 1000)
    rows = [(int(i), v.tolist()) for i, v in zip(ids, vectors)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    return df, [int(i) for i in ids], vectors


@pytest.mark.parametrize("block_rows,k", [(1000, 7), (40, 7), (16, 3), (40, 1)])
def test_neighbours_against_brute_force(crowd, block_rows, k):
    df, ids, vectors = crowd
    found = nearest_neighbours(df, "id", "v", k, block_rows=block_rows)
    got = {(r["src"], r["dst"], r["distance"]) for r in found.collect()}
    assert got == brute_neighbours(ids, vectors, k)


def spread_by_matrix(ids, vectors, y, k, alpha, max_iter, tol):
    place = {i: n for n, i in enumerate(ids)}
    n = len(ids)
    graph = np.zeros((n, n))
    for src, dst, _ in brute_neighbours(ids, vectors, k):
        graph[place[src], place[dst]] = 1.0
    np.fill_diagonal(graph, 0.0)
    degree = graph.sum(axis=0)
    root = np.where(degree == 0, 1.0, np.sqrt(degree))
    graph /= root[:, None] * root[None, :]
    given = np.stack([y == 0, y == 1], axis=1).astype(float)
    state = given.copy()
    for _ in range(max_iter):
        fresh = alpha * graph @ state + (1 - alpha) * given
        change = np.abs(fresh - state).sum()
        state = fresh
        if tol and change < tol:
            break
    return (state[:, 1] > state[:, 0]).astype(int)


def test_exact_neighbours_are_compared_once(spark, monkeypatch):
    """Vectors in many dimensions, where every block meets every other: each travels once per tile,
    and the joins that follow read the result."""
    vectors = np.random.default_rng(6).normal(size=(400, 24))
    ids = list(range(400))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, vectors)], "id bigint, v array<double>")
    probes = []
    plain = type(df).mapInPandas

    def counted(self, func, schema, *rest, **more):
        out = plain(self, func, schema, *rest, **more)
        if "target" in str(schema):
            probes.append(out)
        return out

    monkeypatch.setattr(type(df), "mapInPandas", counted)
    found = nearest_neighbours(df, "id", "v", 7, block_rows=16)
    assert "FlatMapCoGroups" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r["src"], r["dst"], r["distance"]) for r in found.collect()} == brute_neighbours(ids, vectors, 7)
    assert len(probes) == 1 and probes[0].count() <= 400 * 13  # a row visited up to some 25 blocks


def test_crowded_ends_are_counted_once(crowd, monkeypatch):
    """Where the labels are too many to broadcast, no round counts the edges again."""
    df, _, _ = crowd
    attach, rounds = rejects.attach_state, []

    def watched(rows, side, key, state_key, values, **more):
        if values == ["n0", "n1"]:
            rounds.append(more["hot_keys"])
        return attach(rows, side, key, state_key, values, **more)

    monkeypatch.setattr(rejects, "fits_broadcast", lambda *a, **k: False)
    monkeypatch.setattr(rejects, "attach_state", watched)
    labels = df.withColumn("y", F.when(F.col("id") % 4 == 0, F.col("id") % 8 / 4).otherwise(-1).cast("int"))
    rejects.label_spreading(labels, "id", "v", max_iter=2, tol=0.0).count()
    assert len(rounds) == 2 and rounds[0] is not None and rounds[0] is rounds[1]


@pytest.mark.parametrize("small", [True, False])
def test_label_spreading_against_matrices(spark, crowd, monkeypatch, small):
    df, ids, vectors = crowd
    y = np.array([-1 if i % 4 else int(v[0] > 0) for i, v in zip(ids, vectors)])
    labels = spark.createDataFrame(list(zip(ids, y.tolist())), "id bigint, y int")
    if not small:
        monkeypatch.setattr(rejects, "fits_broadcast", lambda *a, **k: False)
    got = rejects.label_spreading(
        df.join(labels, "id"), "id", "v", max_iter=30 if small else 2, tol=1e-3 if small else 0.0
    )
    want = spread_by_matrix(ids, vectors, y, 7, 0.2, 30 if small else 2, 1e-3 if small else 0)
    assert {r["id"]: r["y"] for r in got.collect()} == dict(zip(ids, want.tolist()))
    with pytest.raises(ValueError, match="alpha"):
        rejects.label_spreading(df, "id", "v", alpha=1.0)


def test_report_needs_the_base_model(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.9), (-1, 0.5)], "y int, a double")
    with pytest.raises(ValueError, match="base"):
        rejects.reject_report(df, ["a"], "base")
    row = rejects.reject_report(df, ["a"], "a", bad_rate=0.5).first()
    # the cut-off is the lowest score above the only good one
    assert row["threshold"] == 0.9 and row["balanced_accuracy"] == 1.0
    assert row["approval_rate"] == pytest.approx(2 / 3)
    assert row["positive_rate"] == pytest.approx(1 / 3)
    assert row["kickout"] is None  # the base model approves no bad applicant


@pytest.mark.parametrize("deep", [False, True])
def test_trees_find_the_neighbours(spark, monkeypatch, deep):
    """Against a scan of all rows: enough true neighbours, exact distances, nothing that depends on the dealing."""
    from riskframe.operators import neighbours

    if deep:  # several cells per tree, small leaves, and few trees: more are grown
        monkeypatch.setattr(neighbours, "CELL_ROWS", 200)
        monkeypatch.setattr(neighbours, "TREES_PER_ROUND", 2)
    rng = np.random.default_rng(6)
    points = rng.normal(size=(900, 12)).round(4)
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)] + [(2000 + i, [float(x) for x in points[0]]) for i in range(9)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    everything = np.array([v for _, v in rows])
    ids = np.array([i for i, _ in rows])
    found = []
    for parts in (2, 5):
        distinct = neighbours.distinct_vectors(df.repartition(parts), "id", "v", 6).cache()
        pairs, share = neighbours.tree_neighbours(distinct, 900, 5, 0.9, leaf_rows=64)
        assert share >= 0.9
        found.append(sorted((r["rep"], r["other"], r["distance"]) for r in pairs.collect()))
    assert found[0] == found[1]
    true = hits = 0
    by_rep = {}
    for a, b, gap in found[0]:
        by_rep.setdefault(a, set()).add(b)
        assert gap == pytest.approx(np.linalg.norm(points[a] - points[b]), abs=1e-8)
    for a in range(0, 900, 7):
        gaps = np.linalg.norm(points - points[a], axis=1)
        gaps[a] = np.inf
        want = set(np.argsort(gaps)[:5].tolist())
        true, hits = true + 5, hits + len(want & by_rep[a])
    assert hits >= 0.85 * true
    listed = neighbours.nearest_neighbours(df, "id", "v", 6, recall=0.9).collect()
    copies = [r for r in listed if r["src"] == 2003]
    assert len(copies) == 6 and all(r["distance"] == 0 for r in copies)
    assert {r["src"] for r in listed} == set(ids.tolist()) and len(everything) == 909
    none = neighbours.nearest_neighbours(df.limit(1), "id", "v", 6, recall=0.9).collect()
    assert len(none) == 1


def test_spreading_in_blocks_against_matrices(crowd, monkeypatch):
    """Large graphs are spread in blocks; nodes come twice or without a name, and a round sends numbers once per block."""
    from riskframe.operators import spreading

    df, ids, vectors = crowd
    y = {i: -1 if i % 4 else int(v[0] > 0) for i, v in zip(ids, vectors)}
    spark = df.sparkSession
    edges = [(a, b) for a, b, _ in brute_neighbours(ids, vectors, 7)]
    neighbours = spark.createDataFrame(edges, "src bigint, dst bigint")
    rows = [(i, float(v == 0), float(v == 1)) for i, v in y.items()]
    given = spark.createDataFrame([*rows, (None, 0.0, 1.0)], "node bigint, y0 double, y1 double")
    got = spreading.spread_in_blocks(given, neighbours, 0.2, 30, 1e-3, nodes=50).collect()
    want = spread_by_matrix(ids, vectors, np.array([y[i] for i in ids]), 7, 0.2, 30, 1e-3)
    assert {r["node"]: r["label"] for r in got} == {**dict(zip(ids, want.tolist())), None: 1}
    twice = given.unionByName(given)
    again = spreading.spread_in_blocks(twice, neighbours, 0.2, 2, 0.0, nodes=50).collect()
    assert len(again) == 2 * len(got)
    # the rows beyond a size take that way
    calls = []
    plain = rejects.spread_in_blocks
    monkeypatch.setattr(rejects, "spread_in_blocks", lambda *a: calls.append(1) or plain(*a))
    monkeypatch.setattr(rejects, "fits_broadcast", lambda *a, **k: False)
    monkeypatch.setattr(rejects, "BLOCKS_FROM", 100)
    labels = spark.createDataFrame(list(y.items()), "id bigint, y int")
    found = rejects.label_spreading(df.join(labels, "id"), "id", "v", neighbours=neighbours)
    assert {r["id"]: r["y"] for r in found.collect()} == dict(zip(ids, want.tolist())) and calls


def test_trees_along_axes_deal_a_row_once(spark, monkeypatch):
    """In few dimensions one dealing finds the neighbours: no tree of projections is grown."""
    from riskframe.operators import neighbours

    monkeypatch.setattr(neighbours, "AXIS_ROWS", 600)
    monkeypatch.setattr(neighbours, "CELL_ROWS", 600)
    monkeypatch.setattr(neighbours, "upper_cuts", None)
    points = np.random.default_rng(4).normal(size=(3000, 2)).round(5)
    points = np.column_stack([points, np.arange(3000) % 3])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id bigint, v array<double>")
    distinct = neighbours.distinct_vectors(df, "id", "v", 7).cache()
    pairs, share = neighbours.tree_neighbours(distinct, 3000, 6, 0.9)
    assert share >= 0.9
    found = pairs.groupBy("rep").count().agg(F.count("*"), F.min("count"), F.max("count")).first()
    assert tuple(found) == (3000, 6, 6)
