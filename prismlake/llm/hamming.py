"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into segments; a table for each segment lists the codes by its value, as
rows dealt by segment and value. For a query, all values within radius 0, 1, 2, ... of
its segments are looked up and the codes found are verified. After radius r in all of m
segments every code within m * (r + 1) - 1 bits has been found, so a query ends once its
k-th verified distance is no greater; the others go on to the next radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismlake.llm.memory import lean
from prismlake.session import discard, durable

BITS = 64
SEGMENTS = 4
WIDTH = BITS // SEGMENTS
#: Codes that a list of a segment's value holds; those of a value that more codes share are dealt to chunks.
CHUNK_CODES = 4096
SALTS = 64


@lean
def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sign bits of vectors; those of another length than BITS are first projected by a fixed random matrix."""
    matrices: dict[int, np.ndarray] = {}
    for batch in batches:
        out = []
        for vector in batch.column("embedding").to_pylist():
            if not vector:
                out.append(None)
                continue
            x = np.nan_to_num(np.array([0.0 if v is None else v for v in vector]))
            if len(x) != BITS:
                x = x @ matrices.setdefault(len(x), np.random.default_rng(len(x)).standard_normal((len(x), BITS)))
            out.append(int(np.packbits(x > 0, bitorder="little").view(np.int64)[0]))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.int64())], names=["id", "code"])


def sign_codes(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, code); null and empty vectors have a null code, null and NaN elements count as 0."""
    return vectors.select(F.col(id_column).cast("long").alias("id"), F.col(column).alias("embedding")).mapInArrow(_codes, "id long, code long")


def _first_ids(codes: DataFrame, n: int) -> DataFrame:
    """(code, ids): each distinct code with its n smallest ids; no answer of n neighbours needs more. Hot codes are cut in salted parts first."""
    salted = codes.distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    part = Window.partitionBy("code", "salt").orderBy("id")
    some = salted.withColumn("nth", F.row_number().over(part)).where(F.col("nth") <= n)
    whole = some.withColumn("nth", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("nth") <= n)
    return whole.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def _segment(code: Column, i: int) -> Column:
    return F.shiftrightunsigned(code, WIDTH * i).bitwiseAND(F.lit((1 << WIDTH) - 1)).cast("int")


def _lists(codes: DataFrame) -> DataFrame:
    """Rows (code, s, v): the value of each of a code's segments."""
    return codes.withColumn("at", F.explode(F.array(*[F.struct(F.lit(i).alias("s"), _segment(F.col("code"), i).alias("v")) for i in range(SEGMENTS)]))).select(*codes.columns, "at.*")


def _probe(held: np.ndarray, radius: int):
    """(query, s, v, chunk): the lists that a query's segments reach at exactly this radius; held: chunks of each list, 0 for none."""
    schema = pa.schema([("query", pa.int64()), ("s", pa.int32()), ("v", pa.int32()), ("chunk", pa.int32())])
    masks = np.array([sum(1 << b for b in chosen) for chosen in combinations(range(WIDTH), radius)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for code in batch.column("query").to_numpy():
                out = []
                for s in range(SEGMENTS):
                    values = int(code.view(np.uint64) >> np.uint64(s * WIDTH)) & ((1 << WIDTH) - 1) ^ masks
                    chunks = held[s, values]
                    values = np.repeat(values, chunks)
                    first = np.cumsum(chunks) - chunks
                    out.append((np.full(len(values), s), values, np.arange(len(values)) - np.repeat(first, chunks)))
                at, values, chunk = (np.concatenate(x).astype(np.int32) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), code)), pa.array(at), pa.array(values), pa.array(chunk)], schema=schema)

    return lean(run), "query long, s int, v int, chunk int"


def hamming_top_k(codes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k rows of codes nearest to each query: query_id, neighbor_id, distance, rank.

    codes and queries: (id, code). Order is distance, then id; a row is no neighbour of
    itself (equal id). Null ids and codes neither ask nor answer; repeated rows count
    once; fewer than k others give as many as there are; empty tables give none.
    Queries of equal code are searched once. Only queries whose answer is not yet
    proven go on to a larger radius; the number of lists that hold anything is bounded
    by the segments' values, so tasks know them and ask for no others.
    """
    index = durable(_first_ids(codes.where("id is not null and code is not null").select("id", "code"), k + 1))
    asked = durable(queries.where("id is not null and code is not null").select("id", "code").distinct())
    counted = _lists(index.select("code")).groupBy("s", "v").agg(F.ceil(F.count("*") / CHUNK_CODES).cast("int").alias("chunks"))
    # At most SEGMENTS times 65,536 rows.
    rows = counted.toArrow()
    held = np.zeros((SEGMENTS, 1 << WIDTH), np.int64)
    held[rows["s"].to_numpy(), rows["v"].to_numpy()] = rows["chunks"].to_numpy()
    chunks = F.broadcast(counted)
    lists = durable(_lists(index).join(chunks, ["s", "v"]).withColumn("chunk", F.pmod(F.xxhash64("code"), F.col("chunks")).cast("int")).select("s", "v", "chunk", "code", "ids"))
    enough = min(k + 1, index.agg(F.sum(F.size("ids"))).first()[0] or 0)
    open_ = asked.select(F.col("code").alias("query")).distinct()
    best = None
    for radius in range(WIDTH + 1):
        probes = open_.mapInArrow(*_probe(held, radius))
        # Merged, as probes are small on disk but not in memory.
        met = probes.join(lists.hint("merge"), ["s", "v", "chunk"]).withColumn("differ", F.col("query").bitwiseXOR(F.col("code")))
        # A code is met once for each of its near segments; only the nearest, the first of equals, counts.
        far = F.array(*[F.bit_count(_segment(F.col("differ"), i)) for i in range(SEGMENTS)])
        met = met.where((F.array_min(far) == radius) & (F.array_position(far, F.lit(radius)) == F.col("s") + 1))
        found = met.select("query", F.bit_count("differ").alias("distance"), F.explode("ids").alias("neighbor_id"))
        found = found.unionByName(best.join(open_, "query", "left_semi")) if best is not None else found
        nearest = F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbor_id"))
        now = durable(found.withColumn("nth", nearest).where(F.col("nth") <= k + 1).drop("nth"))
        proven = F.count_if(F.col("distance") <= SEGMENTS * (radius + 1) - 1) >= enough
        done = now.groupBy("query").agg(proven.alias("done")).where("done").select("query")
        settled = best.join(open_, "query", "left_anti") if best is not None else None
        best = durable(now.unionByName(settled)) if settled is not None else now
        open_ = durable(open_.join(done, "query", "left_anti"))
        if open_.isEmpty():
            break
    own = asked.withColumnRenamed("id", "query_id").join(best.withColumnRenamed("query", "code"), "code").where("neighbor_id <> query_id")
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbor_id")))
    discard(lists)
    return ranked.where(F.col("rank") <= k).select("query_id", "neighbor_id", "distance", "rank")
