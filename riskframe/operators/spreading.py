"""Label spreading over a large graph, in blocks of nodes and arrays of numbers.

Nodes are dealt to blocks by a hash. What a block needs of another one in every
round is always the same list of nodes, so it is agreed upon once, and a round sends
bare numbers in that order: a node travels once to each block that lists it, however
many rows list it there. A block's share of the graph stays what it is and is read
from the shared folder in every round.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from riskframe.session import Shelf, cut_lineage

#: Nodes of a block, more or less.
NODES = 100_000
PLAN = "block int, y binary, row binary, root binary, send binary, sizes binary"
MOVE = "block int, sender int, numbers binary, moved double"


def _array(blob: bytes, kind=np.float64) -> np.ndarray:
    return np.frombuffer(blob, kind)


def _placed(names: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of ``wanted`` in sorted ``names``; one behind the last where it is none of them."""
    if not len(names):
        return np.zeros(len(wanted), np.int32)
    at = np.searchsorted(names, wanted)
    at = np.where(at < len(names), at, 0)
    return np.where(names[at] == wanted, at, len(names)).astype(np.int32)


def _in_order(nodes: pd.DataFrame) -> pd.DataFrame:
    """A block's rows in the order of its arrays."""
    return nodes.sort_values(["node", "y0", "y1"], kind="stable", ignore_index=True)


def _senders(nodes: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
    """What a block knows of its rows, and which of its nodes each other block asks for."""
    block = int((nodes if len(nodes) else ends)["block"].iloc[0])
    nodes = _in_order(nodes)
    names, row = np.unique(nodes["node"].to_numpy(), return_inverse=True)
    ends = ends.sort_values(["asker", "dst"], kind="stable")
    at, asker = _placed(names, ends["dst"].to_numpy()), ends["asker"].to_numpy()
    degree = np.bincount(at, weights=ends["listed"].to_numpy(dtype=float), minlength=len(names) + 1)
    root = np.sqrt(np.where(degree[: len(names)] > 0, degree[: len(names)], 1.0))
    askers, counts = np.unique(asker, return_counts=True)
    return pd.DataFrame(
        {
            "block": [block],
            "y": [nodes[["y0", "y1"]].to_numpy(dtype=float).T.tobytes()],
            "row": [row.astype(np.int32).tobytes()],
            "root": [root.tobytes()],
            "send": [at.tobytes()],
            "sizes": [np.stack([askers, counts]).astype(np.int64).tobytes()],
        }
    )


def _receivers(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """Per edge of a block's nodes: the node, and the place of its end in what arrives, by sender."""
    block = int((nodes if len(nodes) else edges)["block"].iloc[0])
    names = np.unique(nodes["node"].to_numpy())
    edges = edges.sort_values(["holder", "dst"], kind="stable")
    holder, dst = edges["holder"].to_numpy(), edges["dst"].to_numpy()
    fresh = np.ones(len(edges), bool)
    fresh[1:] = (holder[1:] != holder[:-1]) | (dst[1:] != dst[:-1])
    place = (np.cumsum(fresh) - 1).astype(np.int32)
    src = _placed(names, edges["src"].to_numpy())
    known = src < len(names)
    return pd.DataFrame({"block": [block], "src": [src[known].tobytes()], "place": [place[known].tobytes()]})


def _sent(block: int, plan, state: np.ndarray, moved: float) -> pd.DataFrame:
    """A block's state and what the others ask of it, each beside its receiver's number."""
    row, root = _array(plan["row"], np.int32), _array(plan["root"])
    send, (askers, counts) = _array(plan["send"], np.int32), _array(plan["sizes"], np.int64).reshape(2, -1)
    known = [np.bincount(row, weights=np.nan_to_num(side), minlength=len(root)) / root for side in state]
    asked = np.stack([np.append(side, 0.0)[send] for side in known])
    stops = np.cumsum(counts)
    numbers = [asked[:, stop - n : stop].tobytes() for stop, n in zip(stops, counts)]
    return pd.DataFrame(
        {
            "block": np.append(askers, block).astype("int32"),
            "sender": np.append(np.full(len(askers), block), -1).astype("int32"),
            "numbers": [*numbers, state.tobytes()],
            "moved": [*[0.0] * len(askers), moved],
        }
    )


def _hashed(column: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(blocks)).cast("int")


def spread_in_blocks(given: DataFrame, neighbours: DataFrame, alpha: float, max_iter: int, tol: float, nodes: int = NODES) -> DataFrame:
    """(node, label) from nodes (node, y0, y1) and neighbours (src, dst): rounds of
    ``F = alpha * S * F + (1 - alpha) * Y`` until the total change falls below ``tol``.

    A node that is given more than once counts as often; one without a name has no edges.
    """
    spark, kind = given.sparkSession, given.schema["node"].dataType.simpleString()
    unnamed = given.filter("node IS NULL")
    given = given.filter("node IS NOT NULL")
    lonely = unnamed.agg(F.coalesce(F.sum(F.col("y0") + F.col("y1")), F.lit(0.0))).first()[0] * alpha
    blocks = max(1, math.ceil(given.count() / nodes))
    with Shelf(spark, "spread") as shelf, Shelf(spark, "round") as last:
        edges = shelf.keep(
            neighbours.filter(F.col("src") != F.col("dst")).select("src", "dst")
            .withColumns({"block": _hashed("src", blocks), "holder": _hashed("dst", blocks)})
        )
        dealt = shelf.keep(given.withColumn("block", _hashed("node", blocks)))
        # an end that very many rows list is one row per block that asks for it
        ends = edges.groupBy("dst", F.col("block").alias("asker"), F.col("holder").alias("block")).agg(F.count("*").alias("listed"))
        mine = dealt.groupBy("block")
        sending = mine.cogroup(ends.groupBy("block")).applyInPandas(lambda a, b: _senders(a, b), PLAN)
        receiving = mine.cogroup(edges.groupBy("block")).applyInPandas(lambda a, b: _receivers(a, b), "block int, src binary, place binary")
        plan = shelf.keep(sending.join(receiving, "block", "left"))

        def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for _, p in batch.iterrows():
                    yield _sent(int(p["block"]), p, _array(p["y"]).reshape(2, -1), 0.0)

        def step(plans: pd.DataFrame, came: pd.DataFrame) -> pd.DataFrame:
            if not len(plans):  # asked by a block that holds nothing
                return pd.DataFrame({"block": [], "sender": [], "numbers": [], "moved": []})
            p = plans.iloc[0]
            came = came.sort_values("sender")
            arrays = [_array(blob).reshape(2, -1) for blob in came["numbers"]]
            state, y = arrays[0], _array(p["y"]).reshape(2, -1)
            row, root = _array(p["row"], np.int32), _array(p["root"])
            fresh = (1.0 - alpha) * y
            if len(arrays) > 1 and p["src"] is not None:
                src, place = _array(p["src"], np.int32), _array(p["place"], np.int32)
                arrived = np.concatenate(arrays[1:], axis=1)
                pulled = np.stack([np.bincount(src, weights=side[place], minlength=len(root)) / root for side in arrived])
                fresh = alpha * pulled[:, row] + fresh
            return _sent(int(p["block"]), p, fresh, float(np.nansum(np.abs(fresh - state))))

        rounds = last.keep(plan.drop("src", "place").mapInPandas(begin, MOVE))
        for number in range(max_iter):
            stepped = plan.groupBy("block").cogroup(rounds.groupBy("block")).applyInPandas(step, MOVE)
            old, rounds = len(last.paths), last.keep(stepped)
            last.drop(old)
            moved = rounds.agg(F.sum("moved")).first()[0] or 0.0
            if tol > 0 and moved + (lonely if number == 0 else 0.0) < tol:
                break

        def label(rows: pd.DataFrame, came: pd.DataFrame) -> pd.DataFrame:
            state = _array(came["numbers"].iloc[0]).reshape(2, -1)
            return pd.DataFrame({"node": _in_order(rows)["node"], "label": (state[1] > state[0]).astype("int32")})

        states = rounds.filter("sender = -1").groupBy("block")
        told = cut_lineage(dealt.groupBy("block").cogroup(states).applyInPandas(label, f"node {kind}, label int"))
    return told.unionByName(unnamed.select("node", F.when(F.col("y1") > F.col("y0"), 1).otherwise(0).alias("label")))
