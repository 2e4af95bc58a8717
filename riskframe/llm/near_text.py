"""Near-duplicate texts by HyperMinHash registers, verified on full shingle sets."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskframe.llm.common import Workspace, components, map_texts, smallest_reachable
from riskframe.llm.shingles import WordHashes, mix, shingle_set

#: Registers per band: four of 16 bits make one 64-bit band value.
ROWS = 4
#: A register holds the count of leading zeros (6 bits) and the mantissa bits after them.
MANTISSA = 10
#: Chance that two unrelated registers are equal, by the published estimate 0.169919 / 2^r.
COLLISION = 0.169919 / 2**MANTISSA
#: Chance of missing a pair at the threshold, which fixes the number of bands.
MISS = 1e-7
#: Texts and shingles per tile of the second step, shared hashes per product.
TILE_TEXTS, TILE_SHINGLES, COLUMNS = 256, 300_000, 4096


def band_count(percent: int) -> int:
    match = (percent / 100) ** ROWS
    return math.ceil(math.log(MISS) / math.log(1 - match)) if match < 1 else 1


def set_digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def registers(hashes: np.ndarray, count: int) -> np.ndarray:
    """HyperMinHash registers (uint16) of one set of shingle hashes.

    Each hash falls into one bucket, the bucket keeps its smallest value as
    leading-zero count plus mantissa bits. An empty bucket takes the smallest
    value of the whole set under a hash function of its own, so that registers
    of small sets agree with the same chance as those of large ones.
    """
    n = np.uint64(count)
    bucket = ((hashes >> np.uint64(32)) % n).astype(np.int64)
    values = mix(hashes ^ np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(bucket, kind="stable")
    filled, starts = np.unique(bucket[order], return_index=True)
    lowest = np.zeros(count, np.uint64)
    lowest[filled] = np.minimum.reduceat(values[order], starts)
    if len(filled) < count:
        empty = np.setdiff1d(np.arange(count), filled, assume_unique=True)
        seeds = mix(empty.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
        # in strips, so that a register matrix never outgrows a few megabytes
        step = max(1, 1_000_000 // max(1, len(hashes)))
        for i in range(0, len(empty), step):
            lowest[empty[i : i + step]] = mix(hashes[None, :] ^ seeds[i : i + step, None]).min(axis=1)
    bits = np.clip(np.frexp(lowest.astype(np.float64))[1], 1, 64).astype(np.uint64)
    zeros = np.uint64(64) - bits
    # drop the leading one, keep the bits after it
    mantissa = ((lowest << zeros) << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    return ((zeros << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key per band: its four registers, mixed with the band's number."""
    packed = np.ascontiguousarray(regs).view(np.uint64)
    return mix(packed + mix(np.arange(1, len(packed) + 1, dtype=np.uint64))).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates of register rows."""
    share = (a == b).mean(axis=1)
    return (share - COLLISION) / (1 - COLLISION)


def signatures(docs: DataFrame, size: int, percent: int, carry: Sequence[str] = ()) -> DataFrame:
    """One compact row per document, with the columns ``carry``; the sets themselves are not kept."""
    count = ROWS * band_count(percent)

    def make():
        cache = WordHashes()

        def kernel(texts: list) -> tuple:
            out = []
            for text in texts:
                hashes = shingle_set(text, size, cache)
                if len(hashes):
                    regs = registers(hashes, count)
                    out.append((len(hashes), set_digest(hashes), regs.tobytes(), band_keys(regs)))
                else:
                    out.append((0, None, None, None))
            return None, list(zip(*out))

        return kernel

    return map_texts(docs, "doc_id", "text", "n_shingles long, digest binary, regs binary, bands array<long>", make, carry)


def set_bytes(size: int) -> Callable:
    """Kernel maker: the sorted shingle hashes of each text as bytes."""

    def make():
        cache = WordHashes()
        return lambda texts: (None, [[shingle_set(t, size, cache).tobytes() for t in texts]])

    return make


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """(id, sorted shingle hashes as bytes) of each given document."""
    return map_texts(docs, "doc_id", "text", "hashes binary", set_bytes(size)).withColumnRenamed("doc_id", "id")


def plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and estimated similarity allow the threshold.

    The estimate may fall short by five standard deviations before a pair is
    given up, a chance of about 1e-6 at the threshold.
    """
    t = percent / 100
    floor = t - 5 * math.sqrt(t * (1 - t) / (ROWS * band_count(percent)))

    @F.pandas_udf("double")
    def estimated(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="float64")
        left = np.frombuffer(b"".join(x), np.uint16).reshape(len(x), -1)
        right = np.frombuffer(b"".join(y), np.uint16).reshape(len(y), -1)
        return pd.Series(estimate(left, right))

    side = classes.select("id", F.col("n_shingles").alias("n"), "regs").hint("merge")
    return (
        pairs.join(side.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra")), "a")
        .join(side.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb")), "b")
        .filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
        .filter(estimated("ra", "rb") >= floor)
        .select("a", "b")
    )


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union on the full sets."""

    @F.pandas_udf("boolean")
    def linked(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for left, right in zip(x, y):
            a, b = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
            common = len(np.intersect1d(a, b, assume_unique=True))
            out.append(100 * common >= percent * (len(a) + len(b) - common))
        return pd.Series(out, dtype="bool")

    return (
        pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha")).hint("merge"), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("hb")).hint("merge"), "b")
        .filter(linked("ha", "hb"))
        .select("a", "b")
    )


def tile_links(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the sets that reach the threshold, all compared with all, exactly.

    Intersections are counted as products of 0/1 blocks over the shared hashes,
    some thousand of them at a time.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    owner, code = owner[shared[code]], (np.cumsum(shared) - 1)[code[shared[code]]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    common = np.zeros((len(sets), len(sets)), np.float64)
    for base in range(0, int(shared.sum()), COLUMNS):
        low, high = np.searchsorted(code, (base, base + COLUMNS))
        block = np.zeros((len(sets), COLUMNS), np.float32)
        block[owner[low:high], code[low:high] - base] = 1
        common += block @ block.T
    reach = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    return np.nonzero(np.triu(reach, 1))


def mixed_links(
    crowd: DataFrame, first: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, space: Workspace
) -> DataFrame:
    """Links (a, b) that join classes of buckets which still hold several components.

    Components that meet in a bucket form a zone; a zone's classes are dealt into
    tiles of bounded size; tiles that share such a bucket are compared as a whole,
    set against set, and only the smallest class each one reaches comes back. So
    every pair of such a bucket is tested, and none is written out.
    """
    placed = space.settle(
        crowd.join(first, crowd["id"] == first["node"], "left").select(
            "k", "id", F.coalesce("root", "id").alias("root")
        ),
        "placed",
    )
    ends = placed.groupBy("k").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    inside = space.settle(placed.join(space.settle(ends, "ends").hint("merge"), "k"), "inside")
    zones = components(inside.select(F.col("root").alias("a"), F.col("low").alias("b")).distinct())
    zones = zones.select(F.col("node").alias("root"), F.col("root").alias("zone"))
    zoned = inside.select("id", "root").distinct().join(zones, "root").select("id", "zone")
    zoned = space.settle(zoned.join(classes.select("id", "n_shingles"), "id"), "zoned")
    sizes = zoned.groupBy("zone").agg(
        F.greatest(F.ceil(F.count("*") / TILE_TEXTS), F.ceil(F.sum("n_shingles") / TILE_SHINGLES)).alias("parts")
    )
    tiled = space.settle(
        zoned.join(space.settle(sizes, "sizes"), "zone").select(
            "id", F.concat_ws("|", "zone", F.pmod(F.xxhash64("id"), F.col("parts"))).alias("tile")
        ),
        "tiled",
    )
    tiles = space.settle(
        tiled.join(sets, "id").groupBy("tile").agg(F.collect_list(F.struct("id", "hashes")).alias("texts")), "tiles"
    )
    where = space.settle(inside.select("k", "id").join(tiled, "id").select("k", "tile").distinct(), "where")
    pairs = (
        where.select("k", F.col("tile").alias("x")).join(where.select("k", F.col("tile").alias("y")), "k")
        .filter("x <= y").select("x", "y").distinct()
    )
    work = pairs.join(tiles.select(F.col("tile").alias("x"), F.col("texts").alias("p")), "x").join(
        tiles.select(F.col("tile").alias("y"), F.col("texts").alias("q")), "y"
    ).select((F.col("x") == F.col("y")).alias("same"), "p", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                texts = batch.column(1)[k].as_py()
                if not batch.column(0)[k].as_py():
                    texts += batch.column(2)[k].as_py()
                texts.sort(key=lambda t: t["id"])
                i, j = tile_links([np.frombuffer(t["hashes"], np.uint64) for t in texts], percent)
                if len(i):
                    ids = np.array([t["id"] for t in texts], np.int64)
                    root = smallest_reachable(len(ids), i, j)
                    moved = np.flatnonzero(root != np.arange(len(ids)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[moved]), pa.array(ids[root[moved]])], names=["a", "b"]
                    )

    return work.mapInArrow(run, "a long, b long").distinct()


def class_links(
    classes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, space: Workspace
) -> DataFrame:
    """Links (a, b) that join all classes (id, n_shingles, regs, bands) of a component.

    ``sets_of`` gives (id, hashes) for a table of ids. Band buckets are searched in
    two steps: first every class against its bucket's smallest one; then, where a
    bucket still holds several components, all its classes, tile against tile.
    """
    banded = classes.select("id", F.explode("bands").alias("k"))
    hubs = space.settle(
        banded.groupBy("k").agg(F.min("id").alias("hub"), F.count("*").alias("n")).filter("n > 1").drop("n"), "hubs"
    )
    crowd = space.settle(banded.join(hubs.hint("merge"), "k").select("k", "id", "hub"), "crowd")
    stars = crowd.filter("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    tested = space.settle(plausible(stars, classes, percent), "tested")
    sets = space.settle(sets_of(crowd.select("id").distinct()), "sets")
    links = space.settle(verified(tested, sets, percent), "links")
    first = space.settle(components(links), "first")
    more = space.settle(mixed_links(crowd, first, classes, sets, percent, space), "more")
    return first.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Component of each document under links of Jaccard >= percent / 100.

    Returns (doc_id, n_shingles, component_id, kept) for each row of ``docs``
    (doc_id, text; other columns are ignored). Documents with equal sets are one
    class, whose smallest doc_id stands for it. Band buckets are searched in two
    steps: first every class against its bucket's smallest one; then, where a
    bucket still holds several components, all its classes, tile against tile. A
    pair sharing a bucket is thus either tested or already connected, and no
    group's pairs are ever written out. Null and word-less texts have no shingles and link with
    nothing; a null doc_id keeps its row, without a component; rows repeating a
    doc_id belong to one component. No rows give no rows.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "near-text")
    signed = space.settle(signatures(docs, size, percent), "signed")
    usable = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = space.settle(
        usable.groupBy("digest").agg(
            F.min("doc_id").alias("id"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("regs").alias("regs"),
            F.first("bands").alias("bands"),
        ),
        "classes",
    )
    # rows that repeat a doc_id with another text belong together by their id
    twice = usable.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).filter("x <> y")
    repeated = (
        usable.join(twice.select("doc_id"), "doc_id", "left_semi")
        .join(classes.select("digest", "id"), "digest")
        .select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
        .filter("a <> b")
    )
    def sets_of(near: DataFrame) -> DataFrame:
        ids = near.withColumnRenamed("id", "doc_id")
        return full_sets(docs.join(ids.hint("merge"), "doc_id", "left_semi"), size).distinct()

    joined = class_links(classes, sets_of, percent, space).union(repeated)
    final = space.settle(components(joined), "final")
    roots = space.settle(
        classes.join(final, classes["id"] == final["node"], "left").select(
            F.col("digest"), F.coalesce("root", "id").alias("root")
        ),
        "roots",
    )
    member = usable.join(roots.hint("merge"), "digest").select("doc_id", "n_shingles", F.col("root").alias("component_id"))
    alone = signed.filter("n_shingles = 0 OR doc_id IS NULL").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id")
    )
    space.release("signed", "roots")
    return member.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_texts(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for each group of texts linked by Jaccard >= percent / 100.

    Classes are the distinct shingle sets, whatever ids they stand under: rows that
    share an id are linked by their texts only, so unlike texts under one id all
    stay. A component keeps its smallest (id, set digest); of rows equal in both, the
    one with the smallest hash of all columns; of rows equal in all columns, one.
    Rows without an id and texts without words are all kept. All columns stay as they
    were. No rows give no rows.

    A text is shingled once for its signature, and once more where a bucket needs
    the whole set. Everything in between works on small rows named by (id, 128-bit
    hash of all columns); the documents meet the keepers' names in one join.
    """
    space = Workspace(docs.sparkSession, "near-kept")
    worded = F.coalesce(F.col(text).cast("string").rlike(r"[^ \t\n\x0B\f\r]"), F.lit(False))
    nulls = F.concat(*[F.col(f"`{c}`").isNull().cast("int").cast("string") for c in docs.columns])
    named = docs.withColumns(
        {
            "__id": F.col(key).cast("long"),
            "__h1": F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]),
            "__h2": F.xxhash64(nulls, *[F.col(f"`{c}`") for c in reversed(docs.columns)]),
        }
    ).filter(F.col(key).isNotNull() & worded)
    name = ["__id", "__h1", "__h2"]
    texts = named.select(F.col("__id").alias("doc_id"), F.col(text).alias("text"), "__h1", "__h2")
    signed = space.settle(signatures(texts, size, percent, ["__h1", "__h2"]).withColumnRenamed("doc_id", "__id"), "signed")
    # numbered once and written, so that every later read sees the same number
    classes = space.settle(
        signed.groupBy("digest")
        .agg(
            F.min(F.struct(*name)).alias("row"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("regs").alias("regs"),
            F.first("bands").alias("bands"),
        )
        .withColumn("id", F.monotonically_increasing_id()),
        "classes",
    )

    def sets_of(near: DataFrame) -> DataFrame:
        wanted = space.settle(classes.select("id", "row.*").join(near.hint("merge"), "id"), "wanted")
        some = named.select(*name, F.col(text).alias("text")).join(wanted.hint("merge"), name)
        found = map_texts(some, "id", "text", "hashes binary", set_bytes(size))
        return found.groupBy("id").agg(F.first("hashes").alias("hashes"))  # rows equal in all columns

    final = space.settle(components(class_links(classes, sets_of, percent, space)), "final")
    copies = signed.groupBy(*name).agg((F.count("*") > 1).alias("several")).filter("several")
    first = (
        classes.join(final, classes["id"] == final["node"], "left")
        .groupBy(F.coalesce("root", "id").alias("root"))
        .agg(F.min(F.struct("row.__id", "digest", "row.__h1", "row.__h2")).alias("f"))
        .select("f.__id", "f.__h1", "f.__h2")
    )
    keepers = space.settle(
        first.join(copies, name, "left").select(*name, F.coalesce("several", F.lit(False)).alias("__several")), "keepers"
    )
    space.release("keepers")
    met = named.join(keepers.hint("merge"), name)
    kept = met.filter("NOT __several").select(*docs.columns)
    if not keepers.filter("__several").isEmpty():
        kept = kept.unionByName(met.filter("__several").dropDuplicates(name).select(*docs.columns))
    return kept.unionByName(docs.filter(F.col(key).isNull() | ~worded))
