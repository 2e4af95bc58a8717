import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from riskframe.functions.scorecard import ModelScorer, Scorecard
from riskframe.operators import counterfactual, donors, explain, learn
from riskframe.operators.explain import LocalSurrogate
from riskframe.operators.features import numeric_stats

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def df(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(2, 240)).round(3)
    c = rng.integers(0, 3, 240)
    y = (1.5 * a - b + 0.5 * c + rng.normal(size=240) > 0.5).astype(int)
    rows = [(i, float(a[i]), float(b[i]), float(c[i]), int(y[i])) for i in range(240)]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, y int").cache()


@pytest.fixture(scope="module")
def scorers(df):
    """The same logistic model as a fitted classifier and as a scorecard."""
    ready = VectorAssembler(inputCols=NAMES, outputCol="features").transform(df)
    model = LogisticRegression(labelCol="y", regParam=0.01).fit(ready)
    return Scorecard.from_logistic(model, NAMES), ModelScorer(model, NAMES)


def rows(frame, *key):
    return {tuple(r[k] for k in key): r.asDict() for r in frame.collect()}


def close(left, right):
    assert set(left) == set(right)
    for key in left:
        assert set(left[key]) == set(right[key])
        for name, value in left[key].items():
            other = right[key][name]
            same = value == other or value == pytest.approx(other, abs=1e-7)
            assert same, (key, name, value, other)


def test_partial_dependence_both_ways(df, scorers):
    card, model = scorers
    for features in (["a"], ["c"], ["a", "b"], ["a", "c"]):
        grids = {f: explain.feature_grid(df, f, 5) for f in features}
        first = explain.partial_dependence(df, card, features, grids)
        second = explain.partial_dependence(df, model, features, grids)
        assert first.count() == np.prod([len(g) for g in grids.values()])
        key = [f for f in features]
        rounded = lambda t: t.withColumns({f: F.round(f, 9) for f in key})
        close(rows(rounded(first), *key), rows(rounded(second), *key))
    with pytest.raises(ValueError):
        explain.partial_dependence(df, card, NAMES)


def test_grid(df):
    assert explain.feature_grid(df, "c") == [0.0, 1.0, 2.0]
    grid = explain.feature_grid(df, "a", 20)
    values = np.sort([r["a"] for r in df.collect()])
    place = 240 * 0.05 + 0.4 + 0.2 * 0.05
    low = values[int(place) - 1] + (place - int(place)) * (values[int(place)] - values[int(place) - 1])
    assert len(grid) == 20 and grid[0] == pytest.approx(low)
    assert np.allclose(np.diff(grid), grid[1] - grid[0])


def test_curves_average_to_the_dependence(df, scorers):
    card, model = scorers
    grid = [-1.0, 0.0, 1.0]
    curves = explain.individual_curves(df, card, "id", "a", grid)
    close(rows(curves, "id", "value"), rows(explain.individual_curves(df, model, "id", "a", grid), "id", "value"))
    means = rows(curves.groupBy("value").agg(F.avg("score").alias("s")), "value")
    pdp = rows(explain.partial_dependence(df, card, ["a"], {"a": grid}), "a")
    assert all(means[k]["s"] == pytest.approx(pdp[k]["average"]) for k in pdp)
    based = explain.individual_curves(df, model, "id", "a", grid, rebase=True)
    assert all(r["score"] == pytest.approx(0) for r in based.filter("value = -1").collect())


def test_rug(df):
    got = explain.quantile_rug(df, ["a"]).collect()
    values = [r["a"] for r in df.collect()]
    assert [r["percentile"] for r in got] == list(range(4, 94, 2))
    assert [r["value"] for r in got] == pytest.approx(np.percentile(values, range(4, 94, 2)).tolist())


@pytest.mark.parametrize("method", ["prob", "pred"])
@pytest.mark.parametrize("permutations", [None, 3])
def test_shapley_values_add_up_both_ways(df, scorers, method, permutations):
    card, model = scorers
    background = explain.background_rows(df, card, "id", 12, seed=1)
    assert len(background) == 12
    options = dict(method=method, permutations=permutations, seed=2)
    first = explain.shapley_values(df, card, "id", background, **options)
    second = explain.shapley_values(df, model, "id", background, **options)
    close(rows(first, "id"), rows(second, "id"))
    base = df.sparkSession.createDataFrame(background)
    told = F.col("score") if method == "prob" else (F.col("score") > 0.5).cast("double")
    mean = card.score(base).agg(F.avg(told)).first()[0]
    scores = rows(card.score(df).select("id", told.alias("s")), "id")
    for key, row in rows(first, "id").items():
        assert sum(row[n] for n in NAMES) == pytest.approx(scores[key]["s"] - mean)


def test_shapley_values_against_the_definition(df, scorers):
    card, _ = scorers
    background = explain.background_rows(df, card, "id", 5)
    w = [card.weights[n] for n in NAMES]
    bg = np.array([[r[n] for n in NAMES] for r in background])

    def worth(x, own):
        mixed = bg.copy()
        mixed[:, list(own)] = x[list(own)]
        return (1 / (1 + np.exp(-(card.intercept + mixed @ w)))).mean()

    got = rows(explain.shapley_values(df, card, "id", background), "id")
    for r in df.limit(10).collect():
        x = np.array([r[n] for n in NAMES])
        for j, name in enumerate(NAMES):
            phi = np.mean([
                worth(x, order[: order.index(j) + 1]) - worth(x, order[: order.index(j)])
                for order in itertools.permutations(range(3))
            ])
            assert got[(r["id"],)][name] == pytest.approx(phi)


def test_shapley_guards(df, scorers):
    card, model = scorers
    background = explain.background_rows(df, card, "id", 5)
    with pytest.raises(ValueError, match="max_rows"):
        explain.shapley_values(df, model, "id", background, max_rows=1000)
    with pytest.raises(ValueError, match="method"):
        explain.shapley_values(df, card, "id", background, method="logit")
    with pytest.raises(ValueError, match="sample"):
        explain.background_rows(df, card, "id", 10**6)
    plan = explain.coalition_plan(10, 4, seed=1)
    assert len(plan) <= 2 * 4 * 11
    assert all(sum(w[j] for w in plan.values()) == pytest.approx(0) for j in range(10))


def test_importance_and_local_factors(spark):
    wide = spark.createDataFrame(
        [(1, 0.1, -0.5, 0.2), (2, -0.3, 0.1, 0.2), (3, 0.2, 0.0, -0.9)],
        "id int, a double, b double, c double",
    )
    table = rows(explain.global_importance(wide, "id"), "feature")
    assert table[("a",)]["mean_abs"] == pytest.approx(0.2)
    assert table[("c",)]["median_abs"] == pytest.approx(0.2)
    assert [r["feature"] for r in explain.global_importance(wide, "id", top=2).collect()] == ["c", "a"]
    top = explain.global_importance(wide, "id", top=1, by="median").collect()
    assert [r["feature"] for r in top] == ["a"]  # tied with c: name order
    with pytest.raises(ValueError):
        explain.global_importance(wide, "id", by="max")
    readable = wide.withColumn("raw", F.lit(12.3456)).withColumn("text", F.lit("a long category"))
    best = explain.local_factors(
        readable, "id", top=2, numeric={"a": F.col("raw"), "b": F.col("raw")},
        labels={"c": F.col("text")},
    )
    first = rows(best, "id", "place")
    assert first[(1, 1)]["feature"] == "b" and first[(1, 1)]["value"] == 12.35
    assert first[(1, 2)]["feature"] == "c" and first[(1, 2)]["label"] == "a long cat..."
    assert first[(2, 2)]["feature"] == "c" and (2, 3) not in first


def test_surrogate_against_a_plain_ridge(df, scorers):
    card, model = scorers
    stats = numeric_stats(df, NAMES)
    background = explain.background_rows(df, card, "id", 50)
    for scorer in (card, model):
        local = LocalSurrogate(
            scorer, stats, background, categorical=["c"], n_samples=80, seed=3
        )
        got = rows(local.explain(df, "id"), "id")
        assert len(got) == 240
    answers = local._score_points(df.sparkSession)
    w = [card.weights[n] for n in NAMES]
    for r in df.limit(5).collect():
        own = np.array([(r[n] - stats[n][0]) / stats[n][1] for n in "ab"] + [1.0])
        x = np.column_stack([local.points[:, :2], local.points[:, 2] == r["c"]])
        x = np.vstack([own, x])
        here = 1 / (1 + np.exp(-(card.intercept + np.dot(w, [r[n] for n in NAMES]))))
        y = np.concatenate([[here], answers])
        k = np.sqrt(np.exp(-((x - own) ** 2).sum(axis=1) / (0.75**2 * 3)))
        xm, ym = k @ x / k.sum(), k @ y / k.sum()
        gram = (x - xm).T @ ((x - xm) * k[:, None]) + np.eye(3)
        beta = np.linalg.solve(gram, (x - xm).T @ (k * (y - ym)))
        row = got[(r["id"],)]
        assert [row[n] for n in NAMES] == pytest.approx(beta.tolist())
        assert row["intercept"] == pytest.approx(ym - xm @ beta)
    with pytest.raises(ValueError):
        LocalSurrogate(card, stats, method="logit")


def plain_moves(df, card, grid, target, max_changes, step):
    """Every accepted move of every open row, one by one."""
    out = {}
    for r in df.collect():
        here = {n: r[n] for n in NAMES}

        def p_target(values):
            p = 1 / (1 + np.exp(-(card.intercept + sum(card.weights[n] * values[n] for n in NAMES))))
            return p if target == 1 else 1 - p

        if p_target(here) >= 0.5:
            continue
        place = {f: (sum(v < r[f] for v in g) + sum(v <= r[f] for v in g) + 1) / 2 for f, g in grid.items()}
        for n in range(1, max_changes + 1):
            for chosen in itertools.combinations(grid, n):
                for at in itertools.product(*[range(len(grid[f])) for f in chosen]):
                    new = {f: grid[f][k] for f, k in zip(chosen, at)}
                    if any(new[f] == r[f] for f in chosen) or p_target({**here, **new}) < 0.5:
                        continue
                    shift = [abs(at[chosen.index(f)] + 1 - place[f]) if f in chosen else 0.0 for f in grid]
                    values = [(f in new, new.get(f, 0.0)) for f in grid]
                    out.setdefault(r["id"], []).append((max(shift), n, sum(shift), values, shift))
    return out


@pytest.mark.parametrize("criterion", ["percentile", "percentile_changes", "non_dom"])
@pytest.mark.parametrize("target", [0, 1])
def test_minimal_changes_against_every_move(df, scorers, criterion, target):
    grid = counterfactual.action_grid(df, ["a", "b"], 0.1)
    # equal grid points are no change for a row that already stands there
    grid["b"] = sorted([*grid["b"], grid["b"][3], grid["b"][3]])
    options = dict(target=target, max_changes=2, criterion=criterion, step_size=0.1)
    expected = set()
    for id_, moves in plain_moves(df, scorers[0], grid, target, 2, 0.1).items():
        moves.sort(key=lambda m: m[:4])
        chosen, floor = moves[:1], np.inf
        if criterion == "percentile_changes":
            chosen = []
            for n in (1, 2):
                best = [m for m in moves if m[1] == n][:1]
                chosen += [m for m in best if m[0] < floor]
                floor = min([floor, *[m[0] for m in best]])
        elif criterion == "non_dom":
            chosen = [
                m for m in moves
                if not any(o[4] != m[4] and all(x <= y for x, y in zip(o[4], m[4])) for o in moves)
            ]
        for cost, n, _, values, _ in chosen:
            expected.add((id_, n, round(cost * 0.1, 6), *[v if used else None for used, v in values]))
    assert expected
    for scorer in scorers:
        found = counterfactual.minimal_changes(df, scorer, "id", grid, **options).collect()
        got = [(r["id"], r["n_changes"], round(r["cost"], 6), r["new_a"], r["new_b"]) for r in found]
        assert len(got) == len(set(got)) and set(got) == expected


def test_three_changes_by_scan_and_by_bands(df, scorers):
    grid = counterfactual.action_grid(df, NAMES, 0.1)
    some = df.filter("id < 60")
    for criterion in counterfactual.CRITERIA:
        first, second = (
            rows(
                counterfactual.minimal_changes(some, s, "id", grid, criterion=criterion, step_size=0.1),
                "id", *[f"new_{n}" for n in NAMES],
            )
            for s in scorers
        )
        assert first
        close(first, second)


def test_minimal_changes_edges(spark, scorers):
    card, _ = scorers
    empty = spark.createDataFrame([], "id int, a double, b double, c double")
    gaps = spark.createDataFrame([(1, None, 1.0, 0.0)], "id int, a double, b double, c double")
    for frame in (empty, gaps):
        assert counterfactual.minimal_changes(frame, card, "id", {"a": [0.0], "b": [1.0]}).count() == 0


def test_counterfactuals_really_flip(df, scorers):
    card, _ = scorers
    grid = counterfactual.action_grid(df, NAMES[:2], 0.05)
    found = counterfactual.minimal_changes(df, card, "id", grid, target=0, step_size=0.05)
    moved = df.join(found.drop("score"), "id").withColumns(
        {f: F.coalesce(f"new_{f}", f) for f in "ab"}
    )
    assert card.score(moved).filter("score > 0.5").count() == 0
    # only rows that needed a change appear
    assert card.score(df).join(found.select("id"), "id", "left_semi").filter("score <= 0.5").count() == 0


def test_undominated_changes(df, scorers):
    card, model = scorers
    grid = counterfactual.action_grid(df, ["a", "b"], 0.25)
    options = dict(criterion="non_dom", max_changes=2, step_size=0.25)
    first = counterfactual.minimal_changes(df, card, "id", grid, **options)
    second = counterfactual.minimal_changes(df, model, "id", grid, **options)
    key = ["id", "new_a", "new_b"]
    close(rows(first, *key), rows(second, *key))
    best = counterfactual.minimal_changes(df, card, "id", grid, max_changes=2, step_size=0.25)
    floor = {r["id"]: r["c"] for r in first.groupBy("id").agg(F.min("cost").alias("c")).collect()}
    assert floor == {r["id"]: pytest.approx(r["cost"]) for r in best.collect()}


def test_counterfactual_guards(df, scorers):
    card, model = scorers
    grid = counterfactual.action_grid(df, ["a"], 0.5)
    for bad in (dict(criterion="cheap"), dict(target=2)):
        with pytest.raises(ValueError):
            counterfactual.minimal_changes(df, card, "id", grid, **bad)
    with pytest.raises(ValueError, match="not features"):
        counterfactual.minimal_changes(df, card, "id", {"z": [1.0]})
    # 160,000 moves per row: no limit on them
    wide = {f: [float(i) for i in range(400)] for f in "ab"}
    assert "cost" in counterfactual.minimal_changes(df, card, "id", wide).columns
    with pytest.raises(ValueError, match="donors"):
        counterfactual.donor_rows(df, card, "id", n=5000)


def test_donors_both_ways(df, scorers):
    card, model = scorers
    donors = counterfactual.donor_rows(df, card, "id", 15, seed=2)
    scales = counterfactual.median_deviations(df, ["a", "b"])
    args = ("id", ["a", "b"], donors, scales)
    first = rows(counterfactual.diverse_counterfactuals(df, card, *args, n_cfs=2), "id", "cf_rank")
    second = rows(counterfactual.diverse_counterfactuals(df, model, *args, n_cfs=2), "id", "cf_rank")
    close(first, second)
    assert {k for k, _ in first} and max(rank for _, rank in first) == 2
    scores = rows(card.score(df), "id")
    for (id_, _), row in first.items():
        assert (row["score"] >= 0.5) != (scores[(id_,)]["score"] >= 0.5)
    none = counterfactual.diverse_counterfactuals(df, card, "id", ["a"], {0: [], 1: []}, {"a": 1.0})
    assert none.count() == 0
    none = counterfactual.diverse_counterfactuals(df, model, "id", ["a"], {0: [], 1: []}, {"a": 1.0})
    assert none.count() == 0
    with pytest.raises(ValueError, match="not features"):
        counterfactual.diverse_counterfactuals(df, card, "id", ["y"], donors, scales)


def test_deviations(spark):
    df = spark.createDataFrame([(float(v), 1.0) for v in (1, 2, 4, 9)], "a double, b double")
    assert counterfactual.median_deviations(df, ["a", "b"]) == {"a": 1.5, "b": 1.0}


def test_comparison_table(spark):
    df = spark.createDataFrame([(1, 100.0, 2.0, 5.0)], "id int, a double, b double, c double")
    cfs = spark.createDataFrame(
        [(1, 1, 150.4, None, None), (1, 2, 120.0, 2.25, None)],
        "id int, rank int, new_a double, new_b double, new_c double",
    )
    table = counterfactual.comparison_table(df, cfs, "id", "rank", ["a", "b", "c"])
    got = rows(table, "rank", "feature")
    assert set(got) == {(1, "a"), (1, "b"), (2, "a"), (2, "b")}  # c never changes
    assert got[(1, "a")]["new"] == 150.0 and got[(1, "a")]["sign"] == "+"
    assert got[(1, "b")]["sign"] == "---" and got[(1, "b")]["delta"] == 0.0
    assert got[(2, "b")]["new"] == 2.25 and got[(2, "b")]["n_changes"] == 2
    wide = counterfactual.comparison_of_one(table, "id", "rank", 1)
    assert wide.columns == ["feature", "Original", "CF 1", "CF 2"]
    assert [tuple(r) for r in wide.collect()] == [
        ("a", "100.0", "150.0 (+50.0)", "120.0 (+20.0)"),
        ("b", "2.0", "---", "2.25 (+0.25)"),
    ]


def test_explaining_a_fitted_flow(apps):
    from riskframe.functions.spec import FeatureSpec

    marked = apps.withColumn("kind", F.when(F.col("z") == 1, "p").otherwise("o"))
    spec = FeatureSpec("app_id", "y", None, ("amount", "balance"), ("kind", "segment"))
    flow = learn.fit_flow(marked, spec, learn.Classifier("forest", {"n_estimators": 5}))
    scorer = learn.FlowScorer(flow)
    plain = scorer.encode(marked)
    sample = plain.limit(20)
    background = explain.background_rows(plain, scorer, "app_id", 4)
    effects = explain.shapley_values(sample, scorer, "app_id", background)
    assert effects.columns == ["app_id", "amount", "balance", "kind", "segment"]
    base = plain.sparkSession.createDataFrame(background)
    mean = scorer.score(base).agg(F.avg("score")).first()[0]
    scores = rows(scorer.score(sample), "app_id")
    for key, row in rows(effects, "app_id").items():
        assert sum(row[n] for n in scorer.features) == pytest.approx(scores[key]["score"] - mean)
    # partial dependence in encoded space, read on the original scale
    curve = flow.encoder.unscale(explain.partial_dependence(plain, scorer, ["amount"]), ["amount"])
    low, high = curve.agg(F.min("amount"), F.max("amount")).first()
    assert 1000 < low < high < 500000


@pytest.mark.parametrize("apart", [0.0, 0.4])
def test_search_gives_what_all_donors_give(df, scorers, apart):
    """Every row is answered as a plain scan of all donors answers it; rows that nothing flips are marked."""
    card, model = scorers
    scales = counterfactual.median_deviations(df, ["a", "b"])
    odd = df.limit(1).select(F.lit(None).cast("long").alias("id"), *[F.col(c) for c in df.columns if c != "id"])
    for scorer in (card, model):
        for mutable in (["b"], ["a", "b"]):
            every = counterfactual.donor_rows(df, scorer, "id", 1000)
            copies = counterfactual.diverse_counterfactuals(df, scorer, "id", mutable, every, scales, n_cfs=10_000)
            names = [f for f in scorer.features if f in mutable]
            want = {}
            for r in sorted(copies.collect(), key=lambda r: (r["id"], r["cf_rank"])):
                chosen = want.setdefault(r["id"], [])
                gaps = [sum(abs(r[f"new_{n}"] - c[f"new_{n}"]) / scales[n] for n in names) for c in chosen]
                if len(chosen) < 3 and all(g > 0 and round(g / len(names), 9) >= apart for g in gaps):
                    chosen.append(r)
            got = donors.search_counterfactuals(
                df.unionByName(odd.select(df.columns)), scorer, "id", mutable, scales, apart=apart, block_rows=8
            ).collect()
            key = lambda r: (r["cost"], r["n_changes"], *[r[f"new_{n}"] for n in names])
            found = {}
            for r in got:
                found.setdefault(r["id"], {})[r["cf_rank"]] = r
            assert set(found) == {r["id"] for r in df.collect()} | {None}
            for k, answers in found.items():
                plain = {i + 1: key(r) for i, r in enumerate(want.get(k, []))}
                if plain:
                    assert {i: key(r) for i, r in answers.items()} == plain
                else:
                    assert set(answers) == {0} and answers[0]["cost"] is None


def test_blocks_hand_on_few_copies(spark):
    """Of a visited block only the copies that may be the cheapest are scored, not one row per donor."""
    seen = []

    class Counting(Scorecard):
        def score(self, df, out="score"):
            if "__rest" in df.columns:
                seen.append(df.count())
            return super().score(df, out)

    draw = np.random.default_rng(8).normal(size=(1500, 2)).round(4).tolist()
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(draw)], "id bigint, a double, b double")
    asked = df.filter("id % 30 = 0")
    card = Counting(0.1, {"a": 1.0, "b": -0.7})
    got = donors.search_counterfactuals(df, card, "id", ["a", "b"], {"a": 1.0, "b": 1.0}, n_cfs=2, queries=asked)
    assert got.filter("cf_rank > 0").count() == 100
    assert seen and max(seen) <= 50 * 20


def test_blocks_are_bounded_from_below():
    draw = np.random.default_rng(3)
    points = draw.normal(size=(500, 3))
    tree = donors.median_tree(points, 4)
    leaf = donors.leaf_of(points, tree, 4)
    assert np.bincount(leaf, minlength=16).max() < 40
    ranges = pd.DataFrame(
        [{f"{e}_{i}": f(points[leaf == k, i]) for e, f in (("low", min), ("high", max)) for i in range(3)} for k in range(16)]
    )
    old, scales = draw.normal(size=(20, 3)), np.array([1.0, 2.0, 0.5])
    bound = donors.block_bounds(old, ranges, scales, 0.2)
    cost = (np.abs(points[None] - old[:, None]) / scales + 0.2 * (points[None] != old[:, None])).sum(axis=2) / 3
    assert all((bound[:, k] <= cost[:, leaf == k].min(axis=1) + 1e-12).all() for k in range(16))


def test_small_boxes_inside_a_block_change_no_answer(spark):
    """One block of all donors: its boxes hold each donor once, and answers are those of small blocks."""
    draw = np.random.default_rng(12).normal(size=(1200, 2)).round(3)
    boxes = donors.small_boxes(draw, 64)
    assert sorted(boxes[boxes >= 0].tolist()) == list(range(1200)) and boxes.shape[1] <= 64 and len(boxes) >= 19
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(draw.tolist())], "id bigint, a double, b double")
    card, asked = Scorecard(0.2, {"a": 1.0, "b": -0.6}), df.filter("id % 20 = 0")
    found = []
    for rows in (32, 5000):
        got = donors.search_counterfactuals(df, card, "id", ["a", "b"], {"a": 1.0, "b": 1.0}, queries=asked, block_rows=rows)
        found.append(sorted(map(tuple, got.collect())))
    assert found[0] == found[1] and len(found[0]) == 180
