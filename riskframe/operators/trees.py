"""Fitted trees as boxes, and exact Shapley values of tree models against a background."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import (
    DecisionTreeClassificationModel, GBTClassificationModel, RandomForestClassificationModel,
)
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

from riskframe.operators.constrained import ConstrainedBoosting

#: Path features up to which a leaf's answers for all patterns are tabled beforehand.
TABLED = 10


TREE_MODELS = (
    DecisionTreeClassificationModel, GBTClassificationModel, RandomForestClassificationModel, ConstrainedBoosting,
)


@dataclass
class Box:
    """A leaf: its value and, per feature on its path, the interval (low, high] it asks for."""

    value: float
    sides: dict[int, tuple[float, float]]

    def holds(self, x: np.ndarray) -> np.ndarray:
        """Bit j is set where row i lies in the interval of the j-th path feature."""
        bits = np.zeros(len(x), np.int64)
        for j, (feature, (low, high)) in enumerate(sorted(self.sides.items())):
            column = x[:, feature]  # a tree sends NaN to the right
            inside = ~(column <= low) if high == math.inf else ~(column <= low) & (column <= high)
            bits |= inside.astype(np.int64) << j
        return bits


def _leaves(node, value_of, sides: dict) -> Iterator[Box]:
    if "LeafNode" in node.getClass().getName():
        yield Box(float(value_of(node)), dict(sides))
        return
    split = node.split()
    if "ContinuousSplit" not in split.getClass().getName():
        raise ValueError("a tree with categorical splits has no boxes; encode categories as numbers")
    feature, cut = split.featureIndex(), float(split.threshold())
    low, high = sides.get(feature, (-math.inf, math.inf))
    yield from _leaves(node.leftChild(), value_of, {**sides, feature: (low, min(high, cut))})
    yield from _leaves(node.rightChild(), value_of, {**sides, feature: (max(low, cut), high)})


def boxes_of(model) -> tuple[float, list[Box], float | None]:
    """(constant, boxes, link): a row's sum over the boxes it lies in.

    Decision trees and forests sum to P(y=1) (link None). Boosted trees sum to the
    margin, whose P(y=1) is the logistic function at ``link`` times the margin.
    """

    def chance(node) -> float:
        counts = list(node.impurityStats().stats())
        return counts[1] / sum(counts)

    found: list[Box] = []

    def add(trees: Sequence, value_of, factors: Sequence[float]) -> None:
        for tree, factor in zip(trees, factors):
            root = tree._java_obj.rootNode()
            found.extend(Box(b.value * factor, b.sides) for b in _leaves(root, value_of, {}))

    if isinstance(model, DecisionTreeClassificationModel):
        add([model], chance, [1.0])
        return 0.0, found, None
    if isinstance(model, RandomForestClassificationModel):
        add(model.trees, chance, [1.0 / len(model.trees)] * len(model.trees))
        return 0.0, found, None
    if isinstance(model, GBTClassificationModel):
        add(model.trees, lambda n: n.prediction(), model.treeWeights)
        return 0.0, found, 2.0
    if isinstance(model, ConstrainedBoosting):
        add(model.trees, lambda n: n.prediction(), [model.rate] * len(model.trees))
        return model.base, found, 1.0
    raise ValueError(f"no tree model: {type(model).__name__}")


def shares(box: Box, patterns: np.ndarray, seen: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Effects of the path features for rows with these patterns, mean over the background.

    ``seen`` and ``mass`` are the background's patterns and their shares. A box is
    reached by a mix of row and background row if each path feature fits in one of
    them. Where only the row's value fits, having it counts for the box; where only
    the background's does, against it; both by the share of orders that decide it.
    """
    d = len(box.sides)
    full = (1 << d) - 1
    out = np.zeros((len(patterns), d))
    fact = [math.factorial(i) for i in range(d + 1)]
    gain = np.zeros((d + 1, d + 1))
    loss = np.zeros((d + 1, d + 1))
    for u in range(d + 1):
        for v in range(d + 1 - u):
            gain[u, v] = fact[u - 1] * fact[v] / fact[u + v] if u else 0.0
            loss[u, v] = fact[u] * fact[v - 1] / fact[u + v] if v else 0.0
    for other, part in zip(seen.tolist(), mass.tolist()):
        alive = (patterns | other) == full
        mine, theirs = patterns & ~other, other & ~patterns
        u, v = np.bitwise_count(mine), np.bitwise_count(theirs & full)
        plus, minus = part * alive * gain[np.minimum(u, d), v], part * alive * loss[np.minimum(u, d), v]
        for j in range(d):
            out[:, j] += (mine >> j & 1) * plus - (theirs >> j & 1) * minus
    return out * box.value


def tree_effects(
    df: DataFrame, model, features: Sequence[str], id: str, background: Sequence[Mapping[str, float]], margin: bool = False
) -> DataFrame:
    """(id, one column per feature): exact Shapley values of a tree model, against ``background``.

    The target is P(y=1) of a decision tree or forest; for boosted trees it is the
    margin, in which alone they are a sum, and ``margin=True`` must say so. The work
    per row is a walk over the leaves, whatever the number of background rows or
    features: per leaf, rows and background rows only matter by which of its
    intervals they lie in, and the effects of every pattern are worked out once.
    Batches of rows, no shuffle. A null feature counts as NaN, which trees send to
    the right; an empty background gives null effects.
    """
    _, boxes, link = boxes_of(model)
    if (link is not None) != margin:
        raise ValueError("boosted trees are explained by their margin, other trees by their probability")
    names = list(features)
    others = np.array([[float(r[n]) for n in names] for r in background], float).reshape(-1, len(names))
    leaves = []
    for box in boxes:
        if not box.sides or not len(others):
            continue
        seen, count = np.unique(box.holds(others), return_counts=True)
        mass = count / len(others)
        d = len(box.sides)
        table = shares(box, np.arange(1 << d), seen, mass) if d <= TABLED else None
        leaves.append((box, sorted(box.sides), seen, mass, table))
    empty = not len(others)

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = batch[names].to_numpy(dtype=float)
            out = np.full((len(x), len(names)), np.nan) if empty else np.zeros((len(x), len(names)))
            for box, path, seen, mass, table in leaves:
                bits = box.holds(x)
                if table is None:
                    some, where = np.unique(bits, return_inverse=True)
                    out[:, path] += shares(box, some, seen, mass)[where]
                else:
                    out[:, path] += table[bits]
            effects = pd.DataFrame(out, columns=names).astype(object).where(~np.isnan(out), None)
            effects.insert(0, id, batch[id].to_numpy())
            yield effects

    schema = StructType([df.schema[id], *[StructField(n, DoubleType()) for n in names]])
    return df.select(id, *names).mapInPandas(explain, schema)


def tree_on_points(model, features: Sequence[str], overrides: Sequence[Mapping[str, float]]):
    """A function from rows to P(y=1) at every point, some features replaced by the point's values.

    A row reaches a leaf box by its other features, a point by the replaced ones. Points
    that lie in the same boxes share one column, so rows are multiplied with the distinct
    patterns of points, however fine the grid. NaN goes to the right, as in the trees.
    """
    base, boxes, link = boxes_of(model)
    place = {f: j for j, f in enumerate(features)}
    at = np.full((len(overrides), len(place)), np.nan)
    for i, point in enumerate(overrides):
        for f, v in point.items():
            at[i, place[f]] = float(v)
    replaced = {place[f] for f in overrides[0]}

    def side(box: Box, mine: bool) -> Box:
        return Box(box.value, {j: span for j, span in box.sides.items() if (j in replaced) == mine})

    def inside(parts: list[Box], x: np.ndarray) -> np.ndarray:
        hits = [part.holds(x) == (1 << len(part.sides)) - 1 for part in parts]
        return np.array(hits, bool).reshape(len(parts), len(x))

    values = np.array([box.value for box in boxes])
    patterns, which = np.unique(inside([side(b, True) for b in boxes], at).T, axis=0, return_inverse=True)
    worth = (patterns * values).T  # boxes x patterns
    which = np.ravel(which)
    rest = [side(b, False) for b in boxes]

    def scores(x: np.ndarray) -> np.ndarray:
        summed = base + inside(rest, x).T.astype(float) @ worth
        chance = summed if link is None else 1.0 / (1.0 + np.exp(-link * summed))
        return chance[:, which]

    return scores
