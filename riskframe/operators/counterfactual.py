"""Counterfactuals: the changes that would turn a decision, for all rows at once."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Mapping, Sequence
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from riskframe.functions.ordering import feature_quantiles
from riskframe.functions.scorecard import Scorecard
from riskframe.operators.prep import hash_sample
from riskframe.session import cut_lineage

CRITERIA = ("percentile", "percentile_changes", "non_dom")


def action_grid(
    df: DataFrame, features: Sequence[str], step_size: float = 0.01
) -> dict[str, list[float]]:
    """Quantiles of each feature at step_size, 2 step_size, ... below 1."""
    points = round(1 / step_size) - 1
    steps = [step_size * (i + 1) for i in range(points)]
    found = feature_quantiles(df, features, steps)
    return {f: [round(v, 6) for v in found[f]] for f in features}


def grid_place(column: Column, grid: Sequence[float]) -> Column:
    """Position on the grid, 1-based; halfway between two points if in between."""
    points = F.array(*[F.lit(float(v)) for v in grid])
    below = F.size(F.filter(points, lambda g: g < column))
    upto = F.size(F.filter(points, lambda g: g <= column))
    return (below + upto + F.lit(1)).cast("double") / 2


def accepted(score: Column, target: int, threshold: float) -> Column:
    """P(target) reaches the threshold."""
    p = score if target == 1 else F.lit(1.0) - score
    return p >= F.lit(float(threshold))


def minimal_changes(
    df: DataFrame,
    scorer,
    id: str,
    grid: Mapping[str, Sequence[float]],
    target: int = 0,
    max_changes: int = 3,
    criterion: str = "percentile",
    threshold: float = 0.5,
    step_size: float = 0.01,
) -> DataFrame:
    """Cheapest grid moves that bring P(target) to the threshold.

    Rows already there are left out. A move's price is the largest percentile
    shift among the changed features; at the same price and number of changes the
    smallest total shift wins, then the smallest new values.

    * ``percentile``: the cheapest counterfactual of each row.
    * ``percentile_changes``: the cheapest one for each number of changes, as
      long as more changes make it cheaper.
    * ``non_dom``: all that no other one beats in every feature's shift.

    Returns (id, n_changes, cost, score, new_<feature> ...); a feature that keeps
    its value has null, and a null feature cannot be moved. A scorecard is searched
    in batches without any shuffle. Other scorers are searched in price bands that
    double in width; only rows that a dearer move may still improve go on to the
    next band. ``non_dom`` needs every move of such a scorer: per row the product
    of the grid sizes of ``max_changes`` features.
    """
    if criterion not in CRITERIA:
        raise ValueError(f"criterion must be one of {CRITERIA}")
    if target not in (0, 1):
        raise ValueError("target must be 0 or 1")
    missing = [f for f in grid if f not in scorer.features]
    if missing:
        raise ValueError(f"not features of the scorer: {missing}")
    base = df.select(id, *scorer.features)
    open_rows = scorer.score(base, "__score").filter(~accepted(F.col("__score"), target, threshold))
    if isinstance(scorer, Scorecard):
        return _monotone(
            open_rows, scorer, id, grid, target, max_changes, criterion, threshold, step_size
        )
    options = (scorer, id, grid, target, max_changes, threshold, step_size)
    if criterion == "non_dom":
        return _undominated_moves(open_rows, *options)
    found = _by_bands(open_rows, criterion, *options)
    return _by_price(found, id, grid, criterion, max_changes)


def _subsets(features: Sequence[str], max_changes: int) -> list[tuple[str, ...]]:
    return [
        s
        for size in range(1, min(max_changes, len(features)) + 1)
        for s in itertools.combinations(features, size)
    ]


def _move_schema(rows: DataFrame, id: str, grid) -> StructType:
    return StructType(
        [
            rows.schema[id],
            StructField("n_changes", IntegerType()),
            StructField("cost", DoubleType()),
            StructField("score", DoubleType()),
            *[StructField(f"new_{f}", DoubleType()) for f in grid],
        ]
    )


def _monotone(
    rows, card, id, grid, target, max_changes, criterion, threshold, step_size
) -> DataFrame:
    """Search the moves of a scorecard in batches of rows.

    Each feature acts in one known direction, so moving every chosen feature as
    far as a price allows tells whether that price suffices.
    """
    search = partial(
        _scan_moves,
        card=card,
        id=id,
        grid={f: np.array(points, dtype=float) for f, points in grid.items()},
        sets=_subsets([f for f in grid if card.weights[f] != 0], max_changes),
        target=target,
        criterion=criterion,
        threshold=threshold,
        step_size=step_size,
    )
    return rows.drop("__score").mapInPandas(search, _move_schema(rows, id, grid))


#: Combinations of moves that are looked at together.
CELLS = 2_000_000
SCAN_ROWS = 4096


def _scan_moves(
    batches: Iterator[pd.DataFrame], card, id, grid, sets, target, criterion, threshold, step_size
) -> Iterator[pd.DataFrame]:
    """Rows of a batch together: one set of features after the other, as arrays."""
    names = list(grid)
    fields = [id, "n_changes", "cost", "score", *[f"new_{f}" for f in names]]
    down = {f: (card.weights[f] > 0) == (target == 0) for f in grid}

    def scores(values: Mapping) -> np.ndarray:
        logit = float(card.intercept)
        for f in card.features:
            logit = logit + card.weights[f] * values[f]
        return 1.0 / (1.0 + np.exp(-logit))

    def accept(values: Mapping) -> np.ndarray:
        score = scores(values)
        return (score if target == 1 else 1.0 - score) >= threshold

    for batch in batches:
        for start in range(0, len(batch), SCAN_ROWS):
            part = batch.iloc[start : start + SCAN_ROWS].reset_index(drop=True)
            own = {f: part[f].to_numpy(dtype=float) for f in card.features}
            place = {}
            for f, points in grid.items():
                below, upto = (np.searchsorted(points, own[f], side) for side in ("left", "right"))
                place[f] = (below + upto + 1) / 2
            if criterion == "non_dom":
                reach = np.full((len(part), len(sets)), np.inf)
                wanted = np.ones_like(reach, dtype=bool)
            else:
                reach = _price_levels(own, place, grid, down, sets, accept)
                wanted = _worth_refining(reach, sets, criterion)
            found = []
            for k, chosen in enumerate(sets):
                rows = np.flatnonzero(wanted[:, k])
                rows = rows[np.argsort(reach[rows, k], kind="stable")]  # alike in the number of moves
                for piece in _pieces(rows, reach[rows, k], place, grid, chosen):
                    row, shifts, values = _moves_of_set(
                        piece, reach[piece, k], own, place, grid, down, chosen, accept, criterion != "non_dom"
                    )
                    if not len(row):
                        continue
                    score = scores({**{f: own[f][row] for f in own}, **dict(zip(chosen, values.T))})
                    wide = np.zeros((len(row), 2 * len(names)))
                    wide[:, len(names) :] = np.nan
                    for j, f in enumerate(chosen):
                        wide[:, names.index(f)] = shifts[:, j]
                        wide[:, len(names) + names.index(f)] = values[:, j]
                    found.append(np.column_stack([row, np.full(len(row), len(chosen)), score, wide]))
            if not found:
                continue
            cells = np.concatenate(found)
            if criterion == "non_dom":
                cells = cells[undominated(cells[:, 3 : 3 + len(names)], cells[:, 0])]
            shifts = cells[:, 3 : 3 + len(names)]
            best = pd.DataFrame(cells[:, 3 + len(names) :], columns=[f"new_{f}" for f in names])
            best["row"], best["n_changes"] = cells[:, 0].astype(int), cells[:, 1].astype(int)
            best["cost"] = np.round(shifts.max(axis=1) * step_size, 9)
            best["total"], best["score"] = shifts.sum(axis=1), cells[:, 2]
            if criterion != "non_dom":
                best = _cheapest(best, names, criterion)
            best[id] = part[id].to_numpy()[best["row"]]
            yield best[fields]


def _pieces(rows: np.ndarray, reach: np.ndarray, place, grid, chosen) -> Iterator[np.ndarray]:
    """Rows in runs whose combinations of moves stay within ``CELLS``."""
    start = 0
    while start < len(rows):
        size = len(rows) - start
        while True:  # the last of a run has the largest reach
            most = reach[start + size - 1]
            each = 1
            for f in chosen[:-1]:
                each *= int(min(len(grid[f]), most + 1))
            if size == 1 or size * each <= CELLS:
                break
            size = max(1, min(size // 2, CELLS // max(each, 1)))
        yield rows[start : start + size]
        start += size


def _helpful(rows: np.ndarray, reach: np.ndarray, x: np.ndarray, place: np.ndarray, points: np.ndarray, down: bool):
    """(counts, shifts, values): per row its helpful moves of one feature within a price,
    nearest first, padded to the longest."""
    x, place = x[rows], place[rows]
    if down:
        below = np.searchsorted(points, x, "left")
        first, room = place - below, below
    else:
        upto = np.searchsorted(points, x, "right")
        first, room = upto + 1 - place, len(points) - upto
    within = np.floor(np.minimum(reach, 2 * len(points)) - first) + 1
    counts = np.where(np.isnan(x), 0, np.clip(within, 0, room)).astype(int)
    step = np.arange(max(1, counts.max(initial=0)))
    at = below[:, None] - 1 - step if down else upto[:, None] + step
    return counts, first[:, None] + step, points[np.clip(at, 0, len(points) - 1)]


def _moves_of_set(rows, reach, own, place, grid, down, chosen, accept, only_best: bool):
    """Accepted moves of one set of features: (row, shifts, values), one entry per move.

    For all moves of the first features, the nearest accepted move of the last one:
    its moves help the more the farther they go, so it is found by bisection, for all
    rows and combinations at once. ``only_best`` keeps a row's smallest total shift,
    then its smallest values.
    """
    options = [_helpful(rows, reach, own[f], place[f], grid[f], down[f]) for f in chosen]
    *head, (last_count, last_shift, last_value) = options
    sizes = [shift.shape[1] for _, shift, _ in head]
    combos = [w.ravel() for w in np.meshgrid(*[np.arange(n) for n in sizes], indexing="ij")] if head else []
    width = len(combos[0]) if combos else 1
    possible = np.broadcast_to((last_count > 0)[:, None], (len(rows), width)).copy()
    for (count, _, _), w in zip(head, combos):
        possible &= w[None, :] < count[:, None]
    r, c = np.nonzero(possible)
    fixed = {f: own[f][rows[r]] for f in own}
    for f, (_, _, value), w in zip(chosen, head, combos):
        fixed[f] = value[r, w[c]]
    far = last_count[r] - 1
    solved = accept({**fixed, chosen[-1]: last_value[r, far]})
    r, c, far = r[solved], c[solved], far[solved]
    fixed = {f: v[solved] for f, v in fixed.items()}
    low = np.zeros(len(r), int)
    while (low < far).any():
        middle = (low + far) // 2
        good = accept({**fixed, chosen[-1]: last_value[r, middle]})
        far = np.where(good, middle, far)
        low = np.where(good, low, np.minimum(middle + 1, far))
    shifts = np.column_stack([*[s[r, w[c]] for (_, s, _), w in zip(head, combos)], last_shift[r, far]])
    values = np.column_stack([*[v[r, w[c]] for (_, _, v), w in zip(head, combos)], last_value[r, far]])
    if only_best and len(r):
        order = np.lexsort((*values.T[::-1], shifts.sum(axis=1), r))
        first = order[np.unique(r[order], return_index=True)[1]]
        r, shifts, values = r[first], shifts[first], values[first]
    return rows[r], shifts, values


def _price_levels(own, place, grid, down, sets, accept) -> np.ndarray:
    """Cheapest sufficient price in grid steps, per row and set of features; inf if none."""
    reach = np.arange(1, 2 * max(len(points) for points in grid.values()) + 1) / 2
    moved, ahead = {}, {}
    for f, points in grid.items():
        spot = place[f][:, None]
        if down[f]:
            at = np.clip(np.ceil(spot - reach), 1, len(points))
        else:
            at = np.clip(np.floor(spot + reach), 1, len(points))
        moved[f] = points[at.astype(int) - 1]
        # not yet past equal grid points: no change
        ahead[f] = moved[f] < own[f][:, None] if down[f] else moved[f] > own[f][:, None]
    out = np.full((len(next(iter(own.values()))), len(sets)), np.inf)
    for k, chosen in enumerate(sets):
        good = accept({f: moved[f] if f in chosen else own[f][:, None] for f in own})
        for f in chosen:
            good = good & ahead[f]
        good = np.broadcast_to(good, (len(out), len(reach)))
        solved = good.any(axis=1)
        out[solved, k] = reach[good[solved].argmax(axis=1)]
    return out


def _worth_refining(levels: np.ndarray, sets, criterion: str) -> np.ndarray:
    """Rows x sets: those that share the lowest price of their row and size."""
    out = np.zeros(levels.shape, bool)
    if not len(sets):
        return out
    sizes = np.array([len(chosen) for chosen in sets])
    floor, done = np.full(len(levels), np.inf), np.zeros(len(levels), bool)
    lowest = levels.min(axis=1)
    for n in np.unique(sizes):
        group = sizes == n
        low = levels[:, group].min(axis=1)
        if criterion == "percentile":  # only the fewest changes that reach the lowest price
            go = ~done & (low == lowest) & np.isfinite(low)
            done |= go
        else:
            go = low < floor
            floor = np.minimum(floor, low)
        out |= go[:, None] & group[None, :] & (levels == low[:, None])
    return out


def undominated(shifts: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
    """Numbers of the moves that no other one of the same row beats: nowhere larger and
    somewhere smaller.

    Moves are sorted by total; a move can only be beaten by one before it. Each sweep
    keeps the first move left of every row and strikes out what it beats.
    """
    rows = np.zeros(len(shifts)) if rows is None else rows
    left = np.lexsort((*shifts.T, shifts.sum(axis=1), rows))
    kept = []
    while len(left):
        _, first, where = np.unique(rows[left], return_index=True, return_inverse=True)
        best = left[first]
        kept.append(best)
        gap = shifts[left] - shifts[best[where]]
        beaten = (gap >= 0).all(axis=1) & (gap > 0).any(axis=1)
        beaten[first] = True
        left = left[~beaten]
    return np.sort(np.concatenate(kept)) if kept else np.empty(0, int)


def _cheapest(found: pd.DataFrame, names: Sequence[str], criterion: str) -> pd.DataFrame:
    """Choose among each row's solutions: by price, number of changes, total, then values."""
    values = ["total", *[f"new_{f}" for f in names]]
    if criterion == "percentile":
        order = ["row", "cost", "n_changes", *values]
        return found.sort_values(order, na_position="first").drop_duplicates("row").copy()
    order = ["row", "n_changes", "cost", *values]
    best = found.sort_values(order, na_position="first").drop_duplicates(["row", "n_changes"])
    floor = best.groupby("row")["cost"].cummin().groupby(best["row"]).shift()
    return best[floor.isna() | (best["cost"] < floor)].copy()


def _accepted_moves(
    staged: DataFrame, scorer, id, grid, target, max_changes, threshold, step_size, low, high
) -> DataFrame:
    """Accepted moves of more than ``low`` and at most ``high`` grid steps.

    Rows bring their places on the grids and ``__most``, the number of changes they
    may make. Returns (id, __set, __n, __i, __ups, solution): per feature the new place
    (0: unmoved) and whether it lies above the old one.
    """
    names = list(grid)
    masks = [sum(1 << names.index(f) for f in chosen) for chosen in _subsets(names, max_changes)]
    allowed = F.filter(F.array(*[F.lit(m) for m in masks]), lambda m: F.bit_count(m) <= F.col("__most"))
    moved = staged.withColumn("__set", F.explode(allowed)).withColumn("__n", F.bit_count("__set"))
    for j, f in enumerate(names):
        place = F.col(f"__place_{f}")
        first = F.greatest(F.lit(1), F.ceil(place - F.lit(high))).cast("int")
        last = F.least(F.lit(len(grid[f])), F.floor(place + F.lit(high))).cast("int")
        spots = F.when(F.col("__set").bitwiseAND(1 << j) != 0, F.sequence(first, last)).otherwise(
            F.array(F.lit(0))
        )
        points = F.array(*[F.lit(float(v)) for v in grid[f]])
        moved = (
            moved.withColumn(f"__i_{f}", F.explode(spots))
            .withColumn(f"__i_{f}", F.when(F.col(f"__i_{f}") > 0, F.col(f"__i_{f}")))
            .withColumn(f"__new_{f}", F.get(points, F.col(f"__i_{f}") - 1))
            # a move must change the value of every chosen feature
            .filter(F.col(f"__i_{f}").isNull() | (F.col(f"__new_{f}") != F.col(f)))
        )
    shift = [
        F.coalesce(F.abs(F.col(f"__i_{f}").cast("double") - F.col(f"__place_{f}")), F.lit(0.0))
        for f in names
    ]
    worst = F.greatest(*shift) if len(names) > 1 else shift[0]
    moved = moved.filter(worst > F.lit(low)).withColumns(
        {f: F.coalesce(f"__new_{f}", F.col(f).cast("double")) for f in names}
    )
    scored = scorer.score(moved, "score").filter(accepted(F.col("score"), target, threshold))
    solution = F.struct(
        F.round(worst * F.lit(step_size), 9).alias("cost"),
        F.col("__n").cast("int").alias("n_changes"),
        sum(shift, F.lit(0.0)).alias("total"),
        *[F.col(f"__new_{f}").alias(f"new_{f}") for f in names],
        F.col("score"),
        F.array(*shift).alias("shifts"),
    )
    at = F.array(*[F.coalesce(f"__i_{f}", F.lit(0)) for f in names])
    ups = F.array(*[F.col(f"__i_{f}") > F.col(f"__place_{f}") for f in names])
    return scored.select(
        id, "__set", "__n", at.alias("__i"), ups.alias("__ups"), solution.alias("solution")
    )


def _staged(rows: DataFrame, grid, max_changes: int) -> DataFrame:
    return rows.drop("__score").withColumns(
        {
            **{f"__place_{f}": grid_place(F.col(f), points) for f, points in grid.items()},
            "__most": F.lit(max_changes),
        }
    )


def _by_bands(
    rows, criterion, scorer, id, grid, target, max_changes, threshold, step_size
) -> DataFrame:
    """The cheapest moves per number of changes, price band by price band.

    A row that is solved with n changes goes on only where fewer may be worth a
    higher price: with sets of less than n features, and not at all for the plain
    price criterion. At most about ``log2(1 / step_size)`` bands.
    """
    options = (scorer, id, grid, target, max_changes, threshold, step_size)
    widest = max(len(points) for points in grid.values())
    pending = cut_lineage(_staged(rows, grid, max_changes))
    low, high, pieces = 0.0, 1.0, []
    while True:
        moves = _accepted_moves(pending, *options, low, high)
        best = cut_lineage(moves.groupBy(id, "__n").agg(F.min("solution").alias("s")))
        pieces.append(best)
        if high >= widest:
            break
        solved = best.groupBy(id).agg((F.min("__n") - 1).alias("__fewer"))
        if criterion == "percentile":
            solved = solved.withColumn("__fewer", F.lit(0))
        pending = cut_lineage(
            pending.join(solved, id, "left")
            .withColumn("__most", F.coalesce("__fewer", "__most"))
            .drop("__fewer")
            .filter("__most > 0")
        )
        if pending.isEmpty():
            break
        low, high = high, 2 * high
    plain = F.struct("s.cost", "s.n_changes", "s.total", *[f"s.new_{f}" for f in grid], "s.score")
    found = reduce(DataFrame.unionByName, pieces)
    return found.groupBy(id).agg(F.collect_list(plain).alias("__found"))


def _undominated_moves(
    rows, scorer, id, grid, target, max_changes, threshold, step_size
) -> DataFrame:
    """All accepted moves that no other one beats.

    Of moves that differ only in how far the last changed feature goes one way,
    the nearest is kept on the map side; the rest is swept per id.
    """
    options = (scorer, id, grid, target, max_changes, threshold, step_size)
    widest = float(max(len(points) for points in grid.values()) + 1)
    last = F.floor(F.log2("__set")).cast("int")
    moves = _accepted_moves(_staged(rows, grid, max_changes), *options, 0.0, widest).select(
        id,
        "__set",
        F.transform("__i", lambda i, j: F.when(j != last, i)).alias("__head"),
        (F.get("__ups", last)).alias("__up"),
        F.get("solution.shifts", last).alias("__tail"),
        "solution",
    )
    nearest = moves.groupBy(id, "__set", "__head", "__up").agg(F.min_by("solution", "__tail").alias("s"))
    table = nearest.select(
        id, "s.n_changes", "s.cost", "s.score", *[f"s.new_{f}" for f in grid], "s.shifts"
    )

    def sweep(found: pd.DataFrame) -> pd.DataFrame:
        return found.iloc[undominated(np.stack(found["shifts"].to_numpy()))].drop(columns="shifts")

    return table.groupBy(id).applyInPandas(sweep, _move_schema(rows, id, grid))


def _by_price(found: DataFrame, id: str, grid, criterion: str, max_changes: int) -> DataFrame:
    """Choose among each row's solutions: by price, number of changes, then values."""
    if criterion == "percentile":
        kept = F.array(F.array_min("__found"))
    else:
        chosen, floor = [], F.lit(None).cast("double")
        for n in range(1, min(max_changes, len(grid)) + 1):
            best = F.array_min(F.filter("__found", _with_changes(n)))
            cheaper = floor.isNull() | (best["cost"] < floor)
            chosen.append(F.when(cheaper, best))
            floor = F.least(floor, best["cost"])
        kept = F.array_compact(F.array(*chosen))
    fields = ["n_changes", "cost", "score", *[f"new_{f}" for f in grid]]
    return found.filter(F.size("__found") > 0).select(id, F.explode(kept).alias("s")).select(
        id, *[F.col(f"s.{c}").alias(c) for c in fields]
    )


def _with_changes(n: int):
    return lambda s: s["n_changes"] == n


# -- counterfactuals from donors ---------------------------------------------------

#: Donors travel with the tasks, so their number is bounded.
MAX_DONORS = 1000


def median_deviations(df: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """Median absolute deviation from the median; 1 for a constant feature."""
    centres = {f: v[0] for f, v in feature_quantiles(df, features, [0.5]).items()}
    gaps = df.select(*[F.abs(F.col(f) - F.lit(centres[f])).alias(f) for f in features])
    return {f: v[0] or 1.0 for f, v in feature_quantiles(gaps, features, [0.5]).items()}


def donor_rows(
    df: DataFrame, scorer, id: str, n: int = 50, threshold: float = 0.5, seed: int = 0
) -> dict[int, list[dict]]:
    """Per predicted class a reproducible sample of at most ``n`` rows (n <= 1000)."""
    if n > MAX_DONORS:
        raise ValueError(f"at most {MAX_DONORS} donors per class")
    scored = scorer.score(df.select(id, *scorer.features), "__score").withColumn(
        "__class", (F.col("__score") >= F.lit(float(threshold))).cast("int")
    )
    pools = {}
    for cls in (0, 1):
        picked = hash_sample(scored.filter(F.col("__class") == cls), id, n, seed).collect()
        pools[cls] = [r.asDict() for r in picked]
    return pools


def diverse_counterfactuals(
    df: DataFrame,
    scorer,
    id: str,
    mutable: Sequence[str],
    donors: Mapping[int, Sequence[Mapping]],
    scales: Mapping[str, float],
    n_cfs: int = 3,
    sparsity_weight: float = 0.2,
    threshold: float = 0.5,
) -> DataFrame:
    """Up to ``n_cfs`` changed copies of each row that get the opposite decision.

    Every donor of the opposite class lends its mutable features; copies that
    flip are ranked by mean scaled distance plus ``sparsity_weight`` times the
    share of changed features. Returns (id, cf_rank, cost, n_changes, score,
    new_<feature> ...).
    """
    names = [f for f in scorer.features if f in set(mutable)]
    unknown = sorted(set(mutable) - set(names))
    if unknown:
        raise ValueError(f"not features of the scorer: {unknown}")
    scored = scorer.score(df.select(id, *scorer.features), "__score").withColumn(
        "__class", (F.col("__score") >= F.lit(float(threshold))).cast("int")
    )
    # equal donors give equal copies
    pools = {
        cls: sorted({tuple(float(d[f]) for f in names) for d in donors[cls]}) for cls in (0, 1)
    }
    if isinstance(scorer, Scorecard):
        lend = partial(
            _lend,
            card=scorer,
            id=id,
            names=names,
            pools={cls: np.array(rows).reshape(-1, len(names)) for cls, rows in pools.items()},
            scales=np.array([float(scales[f]) for f in names]),
            n_cfs=n_cfs,
            sparsity_weight=sparsity_weight,
            threshold=threshold,
        )
        schema = StructType(
            [
                df.schema[id],
                StructField("cf_rank", IntegerType()),
                StructField("cost", DoubleType()),
                StructField("n_changes", IntegerType()),
                StructField("score", DoubleType()),
                *[StructField(f"new_{f}", DoubleType()) for f in names],
            ]
        )
        return scored.drop("__class").mapInPandas(lend, schema)

    kind = "array<struct<" + ",".join(f"`{f}`:double" for f in names) + ">>"

    def pool(cls: int) -> Column:
        rows = [
            F.struct(*[F.lit(v).alias(f) for f, v in zip(names, row)]) for row in pools[cls]
        ]
        return F.array(*rows).cast(kind)

    lenders = F.when(F.col("__class") == 1, pool(0)).otherwise(pool(1))
    staged = scored.withColumns({f"__old_{f}": F.col(f).cast("double") for f in names})
    spread = staged.drop("__score").withColumn("__d", F.explode(lenders))
    again, copy = _flipped(spread, scorer, names, scales, sparsity_weight, threshold)
    # at most one entry per donor
    best = again.groupBy(id).agg(
        F.slice(F.sort_array(F.collect_list(copy)), 1, n_cfs).alias("best")
    )
    return _by_rank(best, id, names)


def _flipped(
    spread: DataFrame, scorer, names: Sequence[str], scales: Mapping[str, float], sparsity_weight: float, threshold: float
) -> tuple[DataFrame, Column]:
    """The copies with a donor's values (``__d``) that get the opposite decision, and their ranked struct."""
    copies = spread.withColumns({f: F.col(f"__d.{f}") for f in names})
    again = scorer.score(copies, "__score").filter(
        (F.col("__score") >= F.lit(float(threshold))).cast("int") == F.lit(1) - F.col("__class")
    )
    gaps = [F.abs(F.col(f"__d.{f}") - F.col(f"__old_{f}")) / F.lit(float(scales[f])) for f in names]
    n_changes = sum(
        (F.when(F.col(f"__d.{f}") != F.col(f"__old_{f}"), 1).otherwise(0) for f in names), F.lit(0)
    )
    cost = (sum(gaps, F.lit(0.0)) + F.lit(sparsity_weight) * n_changes.cast("double")) / F.lit(
        float(len(names))
    )
    copy = F.struct(
        F.round(cost, 9).alias("cost"),
        n_changes.alias("n_changes"),
        *[F.col(f"__d.{f}").alias(f"new_{f}") for f in names],
        F.col("__score").alias("score"),
    )
    return again, copy


def _by_rank(best: DataFrame, id: str, names: Sequence[str]) -> DataFrame:
    """One row per entry of ``best``, in order."""
    return best.select(id, F.posexplode("best").alias("pos", "s")).select(
        id,
        (F.col("pos") + 1).alias("cf_rank"),
        "s.cost",
        "s.n_changes",
        "s.score",
        *[F.col(f"s.new_{f}").alias(f"new_{f}") for f in names],
    )


def _lend(
    batches: Iterator[pd.DataFrame], card, id, names, pools, scales, n_cfs, sparsity_weight, threshold
) -> Iterator[pd.DataFrame]:
    """Rank the donors of the opposite class for a batch of rows."""
    fields = [id, "cf_rank", "cost", "n_changes", "score", *[f"new_{f}" for f in names]]
    for batch in batches:
        for start in range(0, len(batch), 4096):
            part = batch.iloc[start : start + 4096]
            cls = (part["__score"].to_numpy(dtype=float) >= threshold).astype(int)
            chunks = []
            for own in (0, 1):
                pool, mine = pools[1 - own], part[cls == own]
                if not len(mine) or not len(pool):
                    continue
                old = mine[names].to_numpy(dtype=float)
                logit = np.full((len(mine), len(pool)), float(card.intercept))
                for f in card.features:
                    if f in names:
                        logit = logit + card.weights[f] * pool[:, names.index(f)][None, :]
                    else:
                        logit = logit + card.weights[f] * mine[f].to_numpy(dtype=float)[:, None]
                score = 1.0 / (1.0 + np.exp(-logit))
                flips = (score >= threshold).astype(int) != own
                gap = np.abs(pool[None, :, :] - old[:, None, :])
                changes = (gap != 0).sum(axis=2)
                total = (gap / scales).sum(axis=2) + sparsity_weight * changes
                cost = np.where(flips, np.round(total / len(names), 9), np.inf)
                order = np.lexsort((changes, cost), axis=-1)[:, :n_cfs]
                price = np.take_along_axis(cost, order, axis=1)
                row, rank = np.nonzero(np.isfinite(price))
                donor = order[row, rank]
                out = pd.DataFrame(
                    {
                        id: mine[id].to_numpy()[row],
                        "cf_rank": (rank + 1).astype("int32"),
                        "cost": price[row, rank],
                        "n_changes": changes[row, donor].astype("int32"),
                        "score": score[row, donor],
                    }
                )
                for j, f in enumerate(names):
                    out[f"new_{f}"] = pool[donor, j]
                chunks.append(out[fields])
            if chunks:
                yield pd.concat(chunks, ignore_index=True)


# -- comparison table --------------------------------------------------------------


def comparison_table(
    df: DataFrame, cfs: DataFrame, id: str, rank: str, features: Sequence[str]
) -> DataFrame:
    """What each counterfactual changes: one row per (id, rank, altered feature).

    ``cfs`` has ``new_<feature>`` columns, null where nothing changes. A feature
    altered by any counterfactual of an id appears for all of that id's
    counterfactuals, with sign ``---`` where it keeps its value. Values are
    rounded to 3 places when the largest is below 10, else to whole numbers.
    """
    old = df.select(F.col(id).alias("__id"), *[F.col(f).cast("double").alias(f"old_{f}") for f in features])
    paired = cfs.join(old, F.col(id) == F.col("__id")).drop("__id")
    cells = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                F.col(f"old_{f}").alias("old"),
                F.coalesce(F.col(f"new_{f}"), F.col(f"old_{f}")).alias("new"),
            )
            for f in features
        ]
    )
    changed = sum(
        (
            F.when(F.coalesce(F.col(f"new_{f}") != F.col(f"old_{f}"), F.lit(False)), 1).otherwise(0)
            for f in features
        ),
        F.lit(0),
    )
    # an id's few counterfactuals, gathered to know what any of them alters
    per_id = paired.groupBy(id).agg(
        F.collect_list(F.struct(F.col(rank), changed.alias("n_changes"), cells.alias("cells"))).alias("cfs")
    )
    spread = per_id.select(
        id,
        F.explode("cfs").alias("cf"),
        *[
            F.exists("cfs", _altered(i)).alias(f"__any_{f}")
            for i, f in enumerate(features)
        ],
        *[
            F.greatest(
                F.array_max(F.transform("cfs", _cell(i, "new"))),
                F.array_max(F.transform("cfs", _cell(i, "old"))),
            ).alias(f"__max_{f}")
            for i, f in enumerate(features)
        ],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                F.col("cf.cells")[i]["old"].alias("old"),
                F.col("cf.cells")[i]["new"].alias("new"),
                F.col(f"__any_{f}").alias("altered"),
                F.when(F.col(f"__max_{f}") < 10, 3).otherwise(0).alias("places"),
            )
            for i, f in enumerate(features)
        ]
    )
    long = spread.select(
        id, F.col(f"cf.{rank}").alias(rank), F.col("cf.n_changes").alias("n_changes"), F.explode(rows).alias("e")
    ).filter("e.altered")

    def shown(column: Column) -> Column:
        return F.when(F.col("e.places") == 3, F.round(column, 3)).otherwise(F.round(column, 0))

    delta = F.col("e.new") - F.col("e.old")
    return long.select(
        id,
        rank,
        "n_changes",
        "e.feature",
        shown(F.col("e.old")).alias("old"),
        shown(F.col("e.new")).alias("new"),
        (shown(delta) + F.lit(0.0)).alias("delta"),
        F.when(delta > 0, "+").when(delta < 0, "-").otherwise("---").alias("sign"),
    )


def _cell(i: int, side: str):
    return lambda c: c["cells"][i][side]


def _altered(i: int):
    return lambda c: c["cells"][i]["new"] != c["cells"][i]["old"]


def comparison_of_one(table: DataFrame, id: str, rank: str, value) -> DataFrame:
    """One id's comparison as a wide table: a row per feature, a column per
    counterfactual in order of its number of changes."""
    one = table.filter(F.col(id) == F.lit(value))
    order = [
        r[rank]
        for r in one.select(rank, "n_changes").distinct().orderBy("n_changes", rank).collect()
    ]
    text = F.when(F.col("sign") == "---", F.lit("---")).otherwise(
        F.concat(
            F.col("new").cast("string"), F.lit(" ("), F.when(F.col("delta") > 0, "+").otherwise(""),
            F.col("delta").cast("string"), F.lit(")"),
        )
    )
    return (
        one.withColumn("__text", text)
        .groupBy("feature", F.col("old").cast("string").alias("Original"))
        .pivot(rank, order)
        .agg(F.first("__text"))
        .withColumnsRenamed({str(r): f"CF {r}" for r in order})
        .orderBy("feature")
    )
