"""Sum-of-squares packing of token pieces into sequences of fixed length."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from riskframe.llm.bpe import Encoder
from riskframe.llm.common import Workspace, map_texts

#: Pieces of one length that one task ranks, about.
SLOT = 20_000
#: Of the pieces of one length still to be placed, this share is placed per step.
CHUNKS = 16


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only longer ones are cut, the first piece takes the rest."""
    first = length % capacity or capacity
    if length <= capacity:
        return [(0, length)]
    return [(0, first), *((start, capacity) for start in range(first, length, capacity))]


def token_pieces(docs: DataFrame, path: str, capacity: int, end: int, key: str = "doc_id", text: str = "text"):
    """(key, piece, start, length, ids_crc32) of every document's ids plus ``end``."""
    tail = np.array([end], "<u4").tobytes()

    def make():
        encoder = Encoder(path)

        def kernel(texts: list) -> tuple:
            rows, piece, starts, lengths, sums = [], [], [], [], []
            for i, raw in enumerate(encoder.encode(texts)):
                raw += tail
                view = memoryview(raw)
                for k, (start, length) in enumerate(cut(len(raw) // 4, capacity)):
                    rows.append(i)
                    piece.append(k)
                    starts.append(start)
                    lengths.append(length)
                    sums.append(zlib.crc32(view[4 * start : 4 * (start + length)]))
            return rows, [piece, starts, lengths, sums]

        return kernel

    return map_texts(docs, key, text, "piece int, start long, length long, ids_crc32 long", make)


def plan(counts: dict[int, int], capacity: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """Where pieces go, from the number of pieces of each length alone.

    Longest first; each piece goes to the open bin whose choice makes the sum over
    gaps of (open bins with that gap) squared smallest, the tightest one on ties; a
    bin is opened only where none has room. Pieces of one length are placed in
    steps of a ``CHUNKS``-th of those left, one by one at the end, so work and
    result depend on the capacity and the logarithm of the counts, not on the
    number of pieces.

    Returns per length a list of (first rank, number, first sequence, offset): the
    pieces of these ranks go to that many sequences, one each, at the offset.
    """
    open_ = np.zeros(capacity + 1, np.int64)  # by gap
    groups: dict[int, list[list[int]]] = defaultdict(list)  # gap: [first sequence, number]
    placed: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    used = 0

    def put(length: int, gap: int, number: int, rank: int) -> int:
        while number:
            first, have = groups[gap][-1]
            take = min(number, have)
            start = first + have - take
            if take == have:
                groups[gap].pop()
            else:
                groups[gap][-1][1] -= take
            placed[length].append((rank, take, start, capacity - gap))
            if gap > length:
                groups[gap - length].append([start, take])
            open_[gap] -= take
            open_[gap - length] += take
            open_[0] = 0
            rank, number = rank + take, number - take
        return rank

    for length in sorted((n for n in counts if n > 0), reverse=True):
        left, rank = int(counts[length]), 0
        while left:
            have = open_[length:].copy()  # bins by gap length, length + 1, ...
            if not have.any():
                # as many bins as these pieces need when they share them
                each = capacity // length
                number = -(-left // each)
                groups[capacity].append([used, number])
                open_[capacity] += number
                used += number
                for k in range(each):
                    gap, take = capacity - k * length, min(left, number)
                    if take:
                        rank = put(length, gap, take, rank)
                        left -= take
                open_[capacity] = 0
                continue
            after = open_[: capacity + 1 - length]  # by the gap that remains
            gain = np.where(have > 0, have - after, np.iinfo(np.int64).min)
            best = int(gain.argmax())
            number = max(1, min(int(have[best]), left // CHUNKS))
            rank = put(length, best + length, number, rank)
            left -= number
    return placed


def pack_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to pieces with a ``length`` from 1 to ``capacity``.

    The driver sees one number per length. Equal pieces are ranked in slots of
    bounded size (their order among themselves is arbitrary), and a rank finds
    its place in the broadcast plan, whose size the capacity bounds.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    where = {}
    for length, runs in plan(counts, capacity).items():
        rows = np.array(sorted(runs), np.int64)
        where[length] = rows
    sent = spark.sparkContext.broadcast(where)

    slots = F.create_map(*[F.lit(x) for n, c in counts.items() for x in (n, -(-c // SLOT))]) if counts else None
    columns = pieces.columns
    if slots is None:
        return pieces.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    dealt = pieces.withColumn("__slot", F.pmod(F.xxhash64(*columns), slots[F.col("length")]).cast("int"))
    sizes = dealt.groupBy("length", "__slot").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    floors = sizes.withColumn("__floor", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    floors = Workspace(spark, "packing").settle(floors.drop("__n"), "floors")
    inside = Window.partitionBy("length", "__slot").orderBy(*[c for c in columns if c != "length"])
    ranked = dealt.join(floors, ["length", "__slot"]).withColumn(
        "__rank", F.col("__floor") + F.row_number().over(inside) - 1
    )

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths, ranks):
        import pandas as pd

        length, rank = lengths.to_numpy(np.int64), ranks.to_numpy(np.int64)
        out = np.zeros((len(length), 2), np.int64)
        for n in np.unique(length):
            rows, here = sent.value[int(n)], length == n
            k = np.searchsorted(rows[:, 0], rank[here], "right") - 1
            out[here, 0] = rows[k, 2] + rank[here] - rows[k, 0]
            out[here, 1] = rows[k, 3]
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    return ranked.withColumn("__place", place("length", "__rank")).select(
        *columns, "__place.sequence_id", "__place.offset"
    )


def pack_documents(
    docs: DataFrame, path: str, capacity: int = 2048, end: int = 0, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pack all documents into as few sequences of ``capacity`` tokens as the rule finds.

    Returns per piece: the key, piece, start, length, ids_crc32, sequence_id and
    offset. Null and empty texts are one piece of the end id alone. Repeated rows
    are packed each; null keys stay; other columns are ignored; no rows give none.
    """
    pieces = Workspace(docs.sparkSession, "packing").settle(
        token_pieces(docs, path, capacity, end, key, text), "pieces"
    )
    return pack_pieces(pieces, capacity)
