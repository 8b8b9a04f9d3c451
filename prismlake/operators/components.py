"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake.session import discard, durable

#: Edges that one task holds at a time while it contracts its own part.
CONTRACT_ROWS = 500_000


def _contract(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Replace the edges that a task sees by stars around the smallest vertex."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.get(root, root) != root:
            root = parent[root]
        while parent.get(x, x) != root:
            parent[x], x = root, parent[x]
        return root

    def flush() -> pd.DataFrame:
        rows = [(v, find(v)) for v in list(parent)]
        parent.clear()
        return pd.DataFrame([r for r in rows if r[0] != r[1]], columns=["u", "v"], dtype="int64")

    for part in parts:
        for a, b in zip(part["u"].tolist(), part["v"].tolist(), strict=True):
            ra, rb = find(a), find(b)
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                parent.setdefault(min(ra, rb), min(ra, rb))
        if len(parent) > CONTRACT_ROWS:
            yield flush()
    yield flush()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(vertex, component) for every vertex of the edges; component is its smallest vertex.

    Vertices are longs. Self-loops and repeated edges are fine, edges with a null
    end are no edges, an empty table gives an empty table. Each round is two
    aggregations and joins on the vertex (partial sums first, so a hub costs no
    single task its whole neighbourhood) and is written to the shared folder. Rounds
    grow about as the logarithm of the longest path; if they run out before nothing
    changes any more, that is an error, as components would be torn.
    """
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    stars = durable(pairs.mapInPandas(_contract, "u long, v long").distinct())
    before = _state(stars)
    for _ in range(rounds if before[0] else 0):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        shrunk = durable(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v")).where("u <> v").distinct()
        )
        discard(stars)
        stars = shrunk
        after = _state(stars)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components are not settled after {rounds} rounds")
    found = stars.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("vertex"), "component").distinct())
