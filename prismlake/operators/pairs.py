"""Pairs of 64-bit hashes within a few bits, found by segments of the hashes, and kept up to date.

Equal hashes are one class, and only classes are compared. Where d + 1 is dealt to four
segments of 16 bits as evenly as can be, a pair within d bits is, in one segment at
least, within one bit less than that segment's share.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismlake.functions.values import hamming
from prismlake.session import durable

#: Distinct hashes of a block; blocks meet in tasks where an index of rows would meet too many. Two of them are compared in about half a second.
BLOCK_HASHES = 1 << 14
#: Pairs of hashes up to which a task compares all instead of going by segments.
COMPARE_ALL = 1_000_000_000
#: Segments of a hash, and their bits.
SEGMENTS, WIDTH = 4, 16
#: Up to this distance an index of rows is worth its probes: two bits of a segment may differ.
INDEX_DISTANCE = 11
#: Hashes that share a segment's value and stay together; more are dealt to chunks.
CHUNK_HASHES = 4096
#: Versions of kept pairs after which they are written as one.
MOST_VERSIONS = 20

PAIRS = "a long, b long, distance int"


def hash_classes(hashes: DataFrame) -> DataFrame:
    """(phash, rep, n) of rows (asset_id, phash): each distinct hash with its least asset and how many have it. Null hashes are in no class."""
    return hashes.where("phash is not null and asset_id is not null").groupBy("phash").agg(F.min("asset_id").alias("rep"), F.count("*").alias("n"))


def similar_pairs(hashes: DataFrame, distance: int) -> DataFrame:
    """(a, b, distance) with a < b: pairs of classes of rows (asset_id, phash) within so many bits, named by their least assets.

    The members of a class are in hash_classes(); pairs within a class have distance 0
    and are not listed.
    """
    return near(hash_classes(hashes), distance)


def radii(distance: int) -> list[int]:
    """How many bits each segment may differ in; one of them at least does so in any pair within distance. -1: the segment need not be looked at."""
    share, more = divmod(distance + 1, SEGMENTS)
    return [share + (i < more) - 1 for i in range(SEGMENTS)]


def masks(radius: int) -> np.ndarray:
    """All values of a segment with so many bits or fewer."""
    return np.array([sum(1 << x for x in chosen) for r in range(radius + 1) for chosen in combinations(range(WIDTH), r)], np.int64)


def near(classes: DataFrame, distance: int, others: DataFrame | None = None) -> DataFrame:
    """Pairs within distance of rows (phash, rep): a < b of the rows themselves, or a of them and b of the others.

    Up to INDEX_DISTANCE hashes look up the values near their segments' own among rows
    dealt by segment and value; lists of a value that many hashes share are dealt to
    chunks. Beyond, lists would be long and probes many; blocks of hashes meet in
    tasks, which go by the same segments in memory, and only pairs leave a task. At 16
    bits a task compares about a fourteenth of the pairs of random hashes.
    """
    rows = durable(classes.select("rep", "phash"))
    right = durable(others.select("rep", "phash")) if others is not None else rows
    if distance <= INDEX_DISTANCE:
        return _near_by_index(rows, right, distance, others is None)
    return _near_by_blocks(rows, right, distance, others is None)


def near_codes(left: np.ndarray, right: np.ndarray, distance: int, tally: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in left, places in right, distances) of all pairs within distance; tally gets the number of comparisons."""
    left, right = left.view(np.uint64), right.view(np.uint64)
    if len(left) * len(right) <= COMPARE_ALL:
        # What is compared at once stays in a core's cache.
        step = max(1, (1 << 18) // max(1, len(right)))
        for i in range(0, len(left), step):
            d = np.bitwise_count(left[i : i + step, None] ^ right[None, :])
            x, y = divmod(np.flatnonzero(d <= distance), max(1, len(right)))
            yield x + i, y, d[x, y]
        if tally is not None:
            tally.append(len(left) * len(right))
        return
    reach = radii(distance)
    part = lambda h, s: (h >> np.uint64(WIDTH * s) & np.uint64((1 << WIDTH) - 1)).astype(np.int64)
    for s in range(SEGMENTS):
        if reach[s] < 0:
            continue
        order, own = (np.argsort(part(x, s), kind="stable") for x in (right, left))
        codes, mine = right[order], left[own]
        starts = np.searchsorted(part(codes, s), np.arange((1 << WIDTH) + 1))
        values, first = np.unique(part(mine, s), return_index=True)
        steps = masks(reach[s])
        for v, i, j in zip(values, first, [*first[1:], len(mine)], strict=True):
            w = v ^ steps
            size = starts[w + 1] - starts[w]
            at = np.repeat(starts[w] - np.cumsum(size) + size, size) + np.arange(size.sum())
            met = codes[at]
            for k in range(i, j, max(1, (1 << 22) // max(1, len(met)))):
                chunk = mine[k : min(j, k + max(1, (1 << 22) // max(1, len(met))))]
                d = np.bitwise_count(chunk[:, None] ^ met[None, :])
                if tally is not None:
                    tally.append(d.size)
                x, y = np.nonzero(d <= distance)
                if not len(x):
                    continue
                # The first segment that is near finds the pair, the others pass it by.
                differ = chunk[x] ^ met[y]
                new = np.ones(len(x), bool)
                for before in range(s):
                    new &= np.bitwise_count(part(differ, before)) > reach[before]
                x, y = x[new], y[new]
                yield own[k + x], order[at[y]], d[x, y]


def _near_by_blocks(left: DataFrame, right: DataFrame, distance: int, same: bool) -> DataFrame:
    blocks = [max(1, -(-t.count() // BLOCK_HASHES)) for t in ([left] * 2 if same else [left, right])]
    block = lambda n: F.pmod(F.xxhash64("phash"), F.lit(n)).cast("int")
    mine = left.withColumn("i", block(blocks[0])).withColumn("j", F.explode(F.sequence(F.col("i") if same else F.lit(0), F.lit(blocks[1] - 1))))
    theirs = right.withColumn("j", block(blocks[1])).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("j") if same else F.lit(blocks[0] - 1))))
    tiles = mine.withColumn("side", F.lit(0)).unionByName(theirs.withColumn("side", F.lit(1)))

    def near_in_tile(tile: pa.Table) -> pa.Table:
        side = tile["side"].to_numpy()
        ids, codes = ([tile[c].to_numpy()[side == k] for k in (0, 1)] for c in ("rep", "phash"))
        own = same and tile["i"][0].as_py() == tile["j"][0].as_py()
        out = [np.zeros((3, 0), np.int64)]
        for x, y, d in near_codes(*codes, distance):
            pairs = np.stack([ids[0][x], ids[1][y], d.astype(np.int64)])
            if same:
                pairs[:2].sort(axis=0)
            out.append(pairs[:, ids[0][x] < ids[1][y]] if own else pairs)
        a, b, d = np.concatenate(out, axis=1)
        return pa.table({"a": a, "b": b, "distance": d.astype(np.int32)})

    return tiles.groupBy("i", "j").applyInArrow(near_in_tile, PAIRS)


def _near_by_index(left: DataFrame, right: DataFrame, distance: int, same: bool) -> DataFrame:
    reach = radii(distance)
    used = [i for i in range(SEGMENTS) if reach[i] >= 0]
    value = lambda h, i: F.shiftrightunsigned(h, WIDTH * i).bitwiseAND(F.lit((1 << WIDTH) - 1))
    by_segment = lambda t: t.withColumn("s", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), value("phash", i).alias("v")) for i in used]))).select("rep", "phash", "s.*")
    theirs = by_segment(right)
    # At most SEGMENTS times 65,536 rows.
    lists = F.broadcast(durable(theirs.groupBy("i", "v").agg(F.ceil(F.count("*") / CHUNK_HASHES).cast("int").alias("chunks"))))
    index = theirs.join(lists, ["i", "v"]).select("i", "v", F.pmod(F.xxhash64("phash"), F.col("chunks")).cast("int").alias("chunk"), F.col("rep").alias("b"), F.col("phash").alias("theirs"))
    steps = F.array(*[F.lit(masks(r).tolist() if r >= 0 else [0]) for r in reach])
    asked = by_segment(left).select(F.col("rep").alias("a"), F.col("phash").alias("mine"), "i", F.explode(F.transform(F.get(steps, "i"), lambda m: F.col("v").bitwiseXOR(m.cast("long")))).alias("v"))
    probes = asked.join(lists, ["i", "v"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    met = probes.join(index, ["i", "v", "chunk"])
    differ = F.col("mine").bitwiseXOR(F.col("theirs"))
    # The first segment that is near finds the pair, the others pass it by.
    first = F.coalesce(*[F.when(F.bit_count(value(differ, i)) <= reach[i], F.lit(i)) for i in used])
    found = met.where((first == F.col("i")) & (F.bit_count(differ) <= distance))
    return (found.where("a < b") if same else found).select("a", "b", F.bit_count(differ).alias("distance"))


def widest(rows: DataFrame) -> DataFrame:
    """(key, most): the greatest distance between any two hashes of a key, of rows (key, phash); 0 for a single hash.

    Held against one hash, the greatest distance is at least the farthest one's; it is
    at most the number of bits that differ at all. Only where these leave it open do
    blocks of a key's hashes meet in tasks, which give one number each.
    """
    codes = durable(rows.where("phash is not null").select("key", "phash").distinct())
    bounds = codes.groupBy("key").agg(F.count("*").alias("n"), F.min("phash").alias("anchor"), F.bit_count(F.bit_or("phash").bitwiseXOR(F.bit_and("phash"))).alias("bound"))
    held = codes.join(bounds, "key").groupBy("key").agg(F.max(hamming(F.col("phash"), F.col("anchor"))).alias("far"), F.first("n").alias("n"), F.first("bound").alias("bound"))
    held = durable(held)
    is_open = (F.col("n") > 2) & (F.col("far") < F.col("bound"))
    left = codes.join(held.where(is_open).select("key", F.ceil(F.col("n") / BLOCK_HASHES).cast("int").alias("blocks")), "key")
    dealt = left.withColumn("block", F.pmod(F.xxhash64("phash"), F.col("blocks")).cast("int"))
    mine = dealt.select("key", "phash", F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("j"), F.lit(0).alias("side"))
    theirs = dealt.select("key", "phash", F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"))

    def widest_in_tile(tile: pa.Table) -> pa.Table:
        side, codes = tile["side"].to_numpy(), tile["phash"].to_numpy().view(np.uint64)
        a, b = codes[side == 0], codes[side == 1]
        return pa.table({"key": tile["key"].slice(0, 1), "most": pa.array([max((int(np.bitwise_count(b ^ c).max()) for c in a), default=0) if len(b) else 0], pa.int32())})

    kind = codes.schema["key"].dataType.simpleString()
    tiles = mine.unionByName(theirs).groupBy("key", "i", "j").applyInArrow(widest_in_tile, f"key {kind}, most int")
    return held.where(~is_open).select("key", F.col("far").alias("most")).unionByName(tiles.groupBy("key").agg(F.max("most").alias("most")))


def _log(spark: SparkSession, folder: str) -> tuple[DataFrame | None, int]:
    """(rows of the hashes' log since its last whole version, that version), or (None, 0)."""
    try:
        log = spark.read.parquet(f"{folder}/hashes")
    except Exception as error:  # noqa: BLE001  readers name the missing path in one of several errors
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None, 0
    base = log.where("whole").agg(F.max("version")).first()[0]
    return log.where(F.col("version") >= base), base


def _alive(log: DataFrame) -> DataFrame:
    return log.groupBy("phash").agg(F.max_by("alive", "version").alias("alive")).where("alive").select("phash")


def update_pairs(hashes: DataFrame, distance: int, folder: str) -> DataFrame:
    """Bring the pairs kept in folder up to date with rows (phash), and return them: (a, b, distance) of hashes, a < b.

    A version holds what changed: hashes that came or went, and pairs of those that came
    with all that are there. Pairs of hashes that went are passed by when read, and drop
    out when, after MOST_VERSIONS, all is written as one version. The hashes of a
    version are written last, so a run that stops leaves the former state. One folder
    belongs to one distance and one writer.
    """
    spark = hashes.sparkSession
    now = durable(hashes.where("phash is not null").select("phash").distinct())
    log, base = _log(spark, folder)
    if log is None:
        came, gone, there, version = now, now.limit(0), None, 0
    else:
        there = durable(_alive(log))
        came, gone = durable(now.join(there, "phash", "left_anti")), durable(there.join(now, "phash", "left_anti"))
        version = log.agg(F.max("version")).first()[0] + 1
        if came.isEmpty() and gone.isEmpty():
            return kept_pairs(spark, folder)
    as_class = lambda t: t.select("phash", F.col("phash").alias("rep"))
    new = near(as_class(came), distance)
    if there is not None:
        across = near(as_class(came), distance, as_class(there.join(gone, "phash", "left_anti")))
        new = new.unionByName(across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance"))
    new.write.mode("overwrite").parquet(f"{folder}/pairs/version={version}")
    change = came.withColumn("alive", F.lit(True)).unionByName(gone.withColumn("alive", F.lit(False)))
    change.withColumn("whole", F.lit(version == 0)).write.mode("overwrite").parquet(f"{folder}/hashes/version={version}")
    if version - base >= MOST_VERSIONS:
        kept_pairs(spark, folder).write.mode("overwrite").parquet(f"{folder}/pairs/version={version + 1}")
        now.withColumn("alive", F.lit(True)).withColumn("whole", F.lit(True)).write.mode("overwrite").parquet(f"{folder}/hashes/version={version + 1}")
    return kept_pairs(spark, folder)


def kept_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs of the last complete version in folder."""
    log, base = _log(spark, folder)
    last = log.agg(F.max("version")).first()[0]
    alive = durable(_alive(log))
    pairs = spark.read.schema(f"{PAIRS}, version int").parquet(f"{folder}/pairs").where(F.col("version").between(base, last)).select("a", "b", "distance").distinct()
    return reduce(lambda t, end: t.join(alive.select(F.col("phash").alias(end)), end, "left_semi"), ("a", "b"), pairs).select("a", "b", "distance")
