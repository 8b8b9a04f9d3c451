"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures.

Texts become sorted arrays of hashed word shingles; texts with equal arrays are one
node. Nodes that can be similar share one of their first shingles in a common global
order (the prefix principle), so a tile holds the nodes that share such shingles with
its least node, in one band of set sizes: only equal or neighbouring bands are compared. Within a tile the population counts of XORed parity
bitmaps bound the overlap from above; pairs that pass are verified by exact
intersection of their arrays. Tiles first try one edge from each node to the least
one; what that connects needs no further comparison, so that copies of one text cost
their number and not its square.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake.llm.memory import lean
from prismlake.llm.words import mix, word_slices
from prismlake.operators.components import connected_components
from prismlake.session import discard, durable

#: Counters of the shingle-frequency sketch, fixed in size; it only steers the global order.
SKETCH = 1 << 18
#: Bits, as a power of two, of the filter of shared shingles: 4 MB, fixed in size.
FILTER_BITS = 25
#: Rows of a tile that one task compares as a block; larger tiles are split.
BLOCK = 512
#: Node ids that a filter is broadcast for; beyond, the join is shuffled.
BROADCAST_IDS = 1_000_000
#: Nodes or texts that a task remembers, to give a copied one once.
REMEMBERED = 200_000

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of a text's k-word shingles in order; of the whole sequence if it is shorter."""
    n = len(words)
    width = min(k, n)
    if not width:
        return np.zeros(0, np.uint64)
    total = np.full(n - width + 1, np.uint64(width) * _C, np.uint64)
    for i in range(width):
        total = (total ^ words[i : n - width + 1 + i]) * _A + _B
        total ^= total >> np.uint64(29)
    return mix(total)


def _bitmap(array: np.ndarray) -> bytes:
    """Parity of the hashes in each of a power of two of bits, one or two for a shingle."""
    bits = max(64, 1 << (len(array) - 1).bit_length())
    counts = np.bincount((array >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits)
    return np.packbits((counts & 1).astype(bool), bitorder="little").tobytes()


def _node(array: np.ndarray) -> int:
    return int.from_bytes(blake2b(array.tobytes(), digest_size=8).digest(), "little", signed=True)


class _Seen(set):
    """The keys that a task has met, forgotten when they are too many."""

    def new(self, key: int) -> bool:
        if key in self:
            return False
        if len(self) >= REMEMBERED:
            self.clear()
        self.add(key)
        return True


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(schema.types)], schema=schema)


def _sketch(k: int):
    """(counter, n) of the counters that stand out in a task's part, and the sum of all under counter -1; a text's copies count once."""
    schema = pa.schema([("counter", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        sketch = np.zeros(SKETCH, np.int64)
        for batch in batches:
            keys = batch.column("key").to_pylist()
            for part in word_slices(batch.column("text")):
                hashes = [shingle_hashes(part.words[part.offsets[r] : part.offsets[r + 1]], k) for r in range(part.last - part.first) if seen.new(keys[part.first + r])]
                if hashes:
                    sketch += np.bincount((np.concatenate(hashes) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
        heavy = np.flatnonzero(sketch > max(3, 3 * sketch.mean()))
        if total := int(sketch.sum()):
            yield _batch([(-1, total), *zip(heavy.tolist(), sketch[heavy].tolist(), strict=True)], schema)

    return lean(run), "counter long, n long"


def _featurize(k: int, num: int, den: int, classes: np.ndarray):
    """A row per document; a node's bitmap and prefix (its first shingles in the global order of class and hash) once per task."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("key", pa.int64()), ("prefix", pa.binary()), ("bits", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in batches:
            ids, keys = batch.column("doc_id").to_pylist(), batch.column("key").to_pylist()
            for part in word_slices(batch.column("text")):
                rows = []
                for r in range(part.last - part.first):
                    doc, key = ids[part.first + r], keys[part.first + r]
                    array = np.unique(shingle_hashes(part.words[part.offsets[r] : part.offsets[r + 1]], k))
                    n = len(array)
                    node = _node(array) if n else None
                    if not n or not seen.new(node):
                        rows.append((doc, n, node, key, None, None))
                        continue
                    rank = classes[(array & np.uint64(SKETCH - 1)).astype(np.int64)]
                    first = array[np.argsort(rank, kind="stable")[: n - -(-num * n // den) + 1]]
                    rows.append((doc, n, node, key, first.tobytes(), _bitmap(array)))
                yield _batch(rows, schema)

    return lean(run), "doc_id long, n long, node long, key long, prefix binary, bits binary"


def _arrays(k: int):
    """(node, n, arr) of texts, each text once per task."""
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("arr", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in batches:
            new = batch.filter(pa.array([seen.new(x) for x in batch.column("key").to_pylist()], pa.bool_()))
            for part in word_slices(new.column("text")):
                arrays = [np.unique(shingle_hashes(part.words[part.offsets[r] : part.offsets[r + 1]], k)) for r in range(part.last - part.first)]
                yield _batch([(_node(x), len(x), x.tobytes()) for x in arrays if len(x)], schema)

    return lean(run), "node long, n long, arr binary"


def _classes(texts: DataFrame, k: int) -> np.ndarray:
    """Log-frequency classes of the sketch's counters, 0 for ordinary ones; at most SKETCH rows are collected."""
    rows = texts.select("text", "key").mapInArrow(*_sketch(k)).groupBy("counter").agg(F.sum("n").alias("n")).collect()
    counts = {r["counter"]: r["n"] for r in rows}
    mean = max(1.0, counts.pop(-1, 0) / SKETCH)
    classes = np.zeros(SKETCH, np.uint8)
    for counter, n in counts.items():
        classes[counter] = max(0, min(40, int(math.log2(n / mean))))
    return classes


def min_overlap(na: int, nb: int, num: int, den: int) -> int:
    """Least overlap with den * overlap >= num * union."""
    return -(-num * (na + nb) // (den + num))


def _entries(shared: np.ndarray | None = None):
    """(shingle, node, n) of prefixes; with shared, only the shingles that its bits let pass."""
    schema = pa.schema([("shingle", pa.int64()), ("node", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for raw in batch.column("prefix"):
                first = np.frombuffer(raw.as_buffer(), np.uint64)
                if shared is not None:
                    slot = first >> np.uint64(64 - FILTER_BITS)
                    first = first[(shared[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0]
                keys.append(first)
            counts = [len(x) for x in keys]
            if sum(counts):
                own = [pa.array(np.repeat(batch.column(c).to_numpy(), counts)) for c in ("node", "n")]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), *own], schema=schema)

    return lean(run), "shingle long, node long, n long"


def _filter_of(shingles: DataFrame) -> np.ndarray:
    """A bitmap of fixed size of shingles' first bits; what it lets pass wrongly, the join after it drops."""
    slot = F.shiftrightunsigned("shingle", 64 - FILTER_BITS)
    words = shingles.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(shingle, {64 - FILTER_BITS}) & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return bits


def _fold(words: np.ndarray, width: int) -> np.ndarray:
    """A parity bitmap at a smaller power of two, halves XORed."""
    while len(words) > width:
        half = len(words) // 2
        words = words[:half] ^ words[half:]
    return words


def _may_match(na, nb, distance, num: int, den: int):
    """overlap <= (na + nb - distance) / 2, as differing bits are at most the differing shingles."""
    overlap = np.minimum((na + nb - distance) // 2, np.minimum(na, nb))
    return overlap * (den + num) >= num * (na + nb)


def _bounded(num: int, den: int):
    """Pairs whose bitmaps allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, nb, x, y in zip(batch.column("na").to_pylist(), batch.column("nb").to_pylist(), batch.column("bits_a"), batch.column("bits_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                width = min(len(x), len(y))
                keep.append(bool(_may_match(na, nb, int(np.bitwise_count(_fold(x, width) ^ _fold(y, width)).sum()), num, den)))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return lean(run), "a long, b long"


def _exact(num: int, den: int):
    """Pairs whose sorted arrays intersect enough."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("overlap", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b, x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("arr_a"), batch.column("arr_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                overlap = len(np.intersect1d(x, y, assume_unique=True))
                if den * overlap >= num * (len(x) + len(y) - overlap):
                    rows.append((a, b, overlap))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], schema=schema)

    return lean(run), "a long, b long, overlap long"


def _tiles(num: int, den: int, forest: bool):
    """Pairs of a tile that the bitmaps allow, between different roots; rows come sorted by tile.

    forest: only as many as would connect the tile's roots, the likeliest first; where
    there are more, a row without a and b names the tile.
    """
    schema = pa.schema([(c, pa.int64()) for c in ("low", "band", "a", "b")])
    tile = ["low", "band", "i", "j"]

    def pairs(rows: list[dict]) -> list[tuple]:
        at = rows[0]["low"], rows[0]["band"]
        i, j = rows[0]["i"], rows[0]["j"]
        homes = [r for r in rows if not r["visits"]]
        if not homes:
            return []
        width = min(len(r["bits"]) for r in rows) // 8
        maps = {id(r): _fold(np.frombuffer(r["bits"], np.uint64), width) for r in rows}
        matrix = np.stack([maps[id(r)] for r in homes])
        sizes = np.array([r["n"] for r in homes])
        nodes, roots, chunks = (np.array([r[c] for r in homes]) for c in ("node", "root", "chunk"))
        found = []
        for r in rows:
            distance = np.bitwise_count(matrix ^ maps[id(r)]).sum(axis=1, dtype=np.int64)
            fits = _may_match(sizes, r["n"], distance, num, den) & (roots != r["root"])
            if i != j:
                fits &= chunks != r["chunk"]
            if not r["visits"]:
                fits &= nodes < r["node"]
            found += [(distance[x] / (sizes[x] + r["n"]), int(nodes[x]), r["node"], int(roots[x]), r["root"]) for x in np.flatnonzero(fits)]
        if not forest:
            return [(*at, min(a, b), max(a, b)) for _, a, b, _, _ in found]
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        chosen = []
        for _, a, b, ra, rb in sorted(found):
            if find(ra) != find(rb):
                parent[find(ra)] = find(rb)
                chosen.append((*at, min(a, b), max(a, b)))
        return chosen + [(*at, None, None)] if len(found) > len(chosen) else chosen

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        now, rows = None, []
        for batch in batches:
            for r in batch.to_pylist():
                key = tuple(r[c] for c in tile)
                if key != now:
                    if len(rows) > 1:
                        found += pairs(rows)
                    now, rows = key, []
                rows.append(r)
            if len(found) > 10_000:
                yield _batch(found, schema)
                found = []
        if len(rows) > 1:
            found += pairs(rows)
        yield _batch(found, schema)

    return lean(run), "low long, band long, a long, b long"


def _semi(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """rows whose column is in ids, which are distinct."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, column, "left_semi")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def _bitmaps(features: DataFrame, ids: DataFrame) -> DataFrame:
    """node, n and bits of the nodes in ids, one row each."""
    kept = _semi(features.where("bits is not null").select("node", "n", "bits"), ids, "node")
    return kept.groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))


def _sets(texts: DataFrame, features: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """node, n and arr of the nodes in ids, one row each, made again from the texts, so that no table holds all arrays."""
    keys = durable(_semi(features.select("node", "key"), ids, "node").groupBy("node").agg(F.min("key").alias("key")).select("key").distinct())
    made = _semi(texts.select("text", "key"), keys, "key").mapInArrow(*_arrays(k))
    return made.groupBy("node").agg(F.first("n").alias("n"), F.first("arr").alias("arr"))


def _joined(pairs: DataFrame, of: DataFrame, column: str) -> DataFrame:
    for end in ("a", "b"):
        pairs = pairs.join(of.select(F.col("node").alias(end), F.col("n").alias(f"n{end}"), F.col(column).alias(f"{column}_{end}")), end)
    return pairs


def _verify(texts: DataFrame, features: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links among candidate pairs (a, b), by exact intersection."""
    of = durable(_sets(texts, features, _ends(pairs), k))
    found = durable(_joined(pairs, of, "arr").mapInArrow(*_exact(num, den)))
    discard(of)
    return found


def _tile_pairs(features: DataFrame, members: DataFrame, roots: DataFrame, num: int, den: int, forest: bool) -> DataFrame:
    """_tiles() of the members (low, band, node, n, visits) whose roots (vertex, component) differ; tiles of two are done, as each node has met the least one."""
    rooted = members.join(roots.select(F.col("vertex").alias("node"), F.col("component").alias("root")), "node", "left")
    rooted = durable(rooted.withColumn("root", F.coalesce("root", "node")))
    spread = [F.count("*").alias("rows"), F.sum((~F.col("visits")).cast("int")).alias("homes"), F.min("root").alias("lo"), F.max("root").alias("hi")]
    tiles = rooted.groupBy("low", "band").agg(*spread).where("rows > 2 and homes > 0 and lo <> hi").select("low", "band", F.ceil(F.col("rows") / BLOCK).cast("long").alias("chunks"))
    written = durable(rooted.join(tiles, ["low", "band"]))
    split = written.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")))
    signed = _bitmaps(features, written.select("node").distinct())
    # Rows of a large tile meet chunk by chunk.
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other"))
    tile = ["low", "band", "i", "j"]
    signed = split.join(signed.select("node", "bits"), "node").select(*tile, "node", "n", "root", "chunk", "visits", "bits")
    found = durable(signed.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(*_tiles(num, den, forest)).distinct())
    discard(rooted, written)
    return found


def links(texts: DataFrame, features: DataFrame, k: int, num: int, den: int) -> list[DataFrame]:
    """Verified links (a, b, overlap) among _featurize()d rows of texts (text, key), in tables that together connect all similar nodes.

    First each node with the least of its tile, then a likely forest of each tile, and
    last all pairs that are still in different components.
    """
    prefixes = features.where("prefix is not null").select("node", "n", "prefix")
    groups = prefixes.mapInArrow(*_entries()).groupBy("shingle").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    shared = durable(groups.where("low <> high").select("shingle"))
    entries = prefixes.mapInArrow(*_entries(_filter_of(shared))).join(shared, "shingle")
    # A set is at home in the band of its size and visits the next, so that similar ones meet where the larger is at home.
    step = math.log(den / num) * (1 + 1e-9)
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(step)).cast("long")
    bands = F.array(F.struct(band.alias("band"), F.lit(False).alias("visits")), F.struct((band + 1).alias("band"), F.lit(True).alias("visits")))
    housed = durable(entries.select("shingle", "node", "n", F.inline(bands)))
    # A tile is a node and all of a band that share a shingle with it as the least of the shingle's nodes there.
    least = housed.groupBy("shingle", "band").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.min("visits").alias("empty")).where("low <> high and not empty")
    members = durable(housed.join(least, ["shingle", "band"]).select("low", "band", "node", "n", "visits").distinct())
    stars = durable(members.select(F.col("low").alias("a"), F.col("node").alias("b")).where("a <> b").distinct())
    likely = durable(_joined(stars, _bitmaps(features, _ends(stars)), "bits").mapInArrow(*_bounded(num, den)))
    discard(shared, housed, stars)
    found = [_verify(texts, features, likely, k, num, den)]
    discard(likely)
    for forest in (True, False):
        edges = found[0].select("a", "b")
        for more in found[1:]:
            edges = edges.unionByName(more.select("a", "b"))
        roots = connected_components(edges, "a", "b")
        met = _tile_pairs(features, members, roots, num, den, forest)
        found.append(_verify(texts, features, met.where("a is not null").select("a", "b").distinct(), k, num, den))
        if forest:
            # Only tiles in which the bitmaps allow more pairs than the forest took can hold further links.
            further = durable(members.join(met.where("a is null").select("low", "band").distinct(), ["low", "band"], "left_semi"))
            discard(members)
            members = further
        discard(met)
    discard(members)
    return found


def _linked(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n, node, key) of docs, and the verified links (a, b) of their nodes."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key"))
    features = durable(texts.mapInArrow(*_featurize(k, num, den, _classes(texts, k))))
    rows = durable(features.select("doc_id", "n", "node", "key"))
    if num < den:
        first, *more = links(texts, features, k, num, den)
        edges = first.select("a", "b")
        for x in more:
            edges = edges.unionByName(x.select("a", "b"))
    else:  # only equal sets are alike, and those are one node
        edges = rows.select(F.col("node").alias("a"), F.col("node").alias("b")).where("false")
    discard(features)
    return rows, edges


def jaccard_components(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    Texts link when den * intersection >= num * union of their sets of k-word
    shingles (A-Z lower-cased; a shorter text is one shingle). component_id is the
    smallest doc_id reachable by links. Null and empty texts have an empty set and
    link with nothing. Rows of one doc_id count as one document, which links through
    each of its texts; rows without a doc_id are kept, and a component without any
    doc_id has none. Shingles and texts count as equal when their 64-bit hashes do.
    Extra columns are left out. docs is read more than once (its arrays are made again
    for candidates instead of being kept), so what is costly or differs between
    readings should be written first.
    """
    rows, edges = _linked(docs, k, num, den)
    # Documents with several texts, or with empty ones beside others; few, if any.
    nodes_of = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z"), F.count("node").alias("some"), F.count("*").alias("every"))
    odd = durable(nodes_of.where("a <> z or (some > 0 and some < every)"))
    edges = edges.unionByName(rows.where("node is not null").join(odd.where("a <> z").select("doc_id", "a"), "doc_id").select("a", F.col("node").alias("b")))
    groups = connected_components(edges, "a", "b").withColumnRenamed("vertex", "node")
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least")).join(groups, "node", "left")
    nodes = durable(nodes.select("node", "least", F.coalesce("component", "node").alias("component")))
    # Components are named by their least node so far; their own name is the least document's.
    named = nodes.join(nodes.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("node", "component_id")
    own = odd.where("some < every").select("doc_id", F.col("a").alias("node")).join(named, "node").select("doc_id", F.col("component_id").alias("own"))
    found = rows.join(named, "node", "left").join(own, "doc_id", "left")
    component = F.when(F.col("node").isNull(), F.coalesce("own", "doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """docs with one text of each group of linked ones: that of the smallest doc_id, whatever else has this id.

    Groups are of texts, not of ids: a second, different text under the same id has a
    group of its own, and is not lost. Of repeated rows one stays; rows without a
    doc_id all stay; of null or empty texts one for each doc_id stays, as they link
    with nothing. Extra columns stay, under any names; an empty table gives an empty one.
    """
    rows, edges = _linked(docs, k, num, den)
    owned = rows.where("doc_id is not null")
    groups = connected_components(edges, "a", "b").withColumnRenamed("vertex", "node")
    grouped = owned.where("node is not null").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # Null texts hash to a constant, so that their key is one like any other.
    first = grouped.groupBy("component").agg(F.min(F.struct("doc_id", "key")).alias("first")).select("first.doc_id", "first.key")
    kept = durable(first.unionByName(owned.where("node is null").select("doc_id", "key")).distinct())
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    hidden = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), whole.alias("row"))
    found = hidden.where("doc_id is not null").join(kept, ["doc_id", "key"], "left_semi").dropDuplicates(["doc_id", "key"])
    return found.unionByName(hidden.where("doc_id is null")).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
