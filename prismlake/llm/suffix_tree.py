"""Language-model scoring by a probabilistic suffix tree over words.

Contexts are runs of whole words before a token (the start of a text counts as one).
They grow word by word: those of n + 1 words are counted only where their last n words
are a state, and become states if their next-word distribution differs from their
parent's (the context without its oldest word) by a fixed number of nats. Growth ends
when no context passes. Each token is scored in its longest context that is a state.

Distributions are smoothed by absolute discounting: one occurrence of each next word of
a state counts for its parent. So next words that a state has met once need no row, and
a text is not predicted from itself.

Contexts are counted in parts of their hashes, one part at a time, so that the disk
holds a part of them only. Tasks send packed arrays instead of rows, routed by context;
contexts of very common words alone are routed by next word, so none meets in one task.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismlake.llm.memory import give_back, lean
from prismlake.llm.words import BASE, GOLDEN, M1, Slice, mix, quick_slices
from prismlake.session import discard, durable, partitions

#: Words whose counts every task holds, at most; the rest are asked for.
COMMON = 1 << 18
#: Values of states and of their next words that every task may hold; the rest are asked for.
COMMON_VALUES = 1 << 20
#: Nats that a state must gain over its parent, each occurrence being predicted from the others.
LEAST_NATS = 10.0
#: Most bits of the filters of states and of their next words, which every stage sends to all executors. Their false hits cost work only, as what is counted or scored is joined with the states.
FILTER_BITS = 1 << 26
#: Parts in which all places of the corpus are counted, one after the other, and in which the texts are scored.
PARTS, SCORE_PARTS = 2, 3
#: Where fewer than one of so many places can still grow, contexts of so many lengths are counted at once.
FEW, AT_ONCE = 8, 3
#: Words of more than this share of all tokens are very common, and with them those that share their bits in a filter of this size: their own contexts are spread by next word.
HOT_SHARE, HOT_BITS = 1 / 4096, 1 << 18
#: Places that a task collects before it sends them, and that a task receives, about.
SENT, RECEIVED = 1 << 19, 1 << 19
#: Buckets of what may become states, at least, if there are as many partitions.
GROWN_BUCKETS = 24
#: Bytes of text that a task works on at a time: each word takes some hundred bytes of arrays.
LOT = 1 << 19
#: Texts that a task remembers, to score a copied one once.
REMEMBERED = 200_000
PSEUDO = 0.1
#: The end token's key among word hashes; as a context's oldest word it is the start of a text.
END_KEY = -(2**62) + 12345
#: Where a key's two bits in a word of a filter are taken from; its low bits choose the word.
FILTER_SHIFTS = (26, 32)
ROOT = np.uint64(0x632BE59BD9B4E019)
BLOBS = "bucket int, kind int, src long, data binary"
_BLOBS = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("src", pa.int64()), ("data", pa.binary())])
_KEY, _COUNT, _VALUE = np.dtype("<u8"), np.dtype("<u4"), np.dtype("<f8")
GROWN = "key long, context long, parent long, size long, kinds long, c long, p double, v double"
# Kinds of blobs of counts: next words met twice or more, sizes of contexts, the parents' entries, next words whose parent is a state.
ROWS, TOTALS, PARENTS, KNOWN = range(4)
# Kinds of blobs: words and values asked for, a task's texts, known words, known values; words and values answered.
ASK_WORD, ASK_VALUE, TEXTS, WORDS, VALUES, WORD_SUMS, VALUE_SUMS = range(7)


def is_training(doc_id: int | None, folds: int) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds != 0


def _training(batch: pa.RecordBatch, folds: int) -> pa.RecordBatch:
    return batch.filter(pa.array([is_training(x, folds) for x in batch.column("doc_id").to_pylist()], pa.bool_()))


def _pack(*columns: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def _unpack(blobs: list, types: tuple[np.dtype, ...]) -> list[np.ndarray]:
    """The columns of packed blobs, one after the other."""
    width = sum(t.itemsize for t in types)
    found: list[list[np.ndarray]] = [[] for _ in types]
    for blob in blobs:
        data = np.frombuffer(blob.as_buffer(), np.uint8)
        n, at = len(data) // width, 0
        for i, t in enumerate(types):
            found[i].append(data[at : at + n * t.itemsize].view(t))
            at += n * t.itemsize
    return [np.concatenate([np.zeros(0, t), *x]) for x, t in zip(found, types, strict=True)]


def _send(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 4, _BLOBS, strict=True)], schema=_BLOBS)


def _pack_counts(context: np.ndarray, prior: np.ndarray, counts: np.ndarray) -> bytes:
    """Counts of 1, which most are, take no place: those above come first, and how many they are last."""
    order = np.argsort(counts == 1, kind="stable")
    more = int(np.count_nonzero(counts > 1))
    return _pack(context[order], prior[order], counts[order[:more]].astype(_COUNT), np.array([more], _COUNT))


def _unpack_counts(blobs: list) -> list[np.ndarray]:
    """(context, prior, c) of blobs of _pack_counts(), one after the other."""
    found: list[list[np.ndarray]] = [[np.zeros(0, _KEY)], [np.zeros(0, _KEY)], [np.zeros(0, _COUNT)]]
    for blob in blobs:
        data = np.frombuffer(blob.as_buffer(), np.uint8)
        more = int(data[-4:].view(_COUNT)[0])
        n = (len(data) - 4 * (more + 1)) // 16
        counts = np.ones(n, _COUNT)
        counts[:more] = data[16 * n : -4].view(_COUNT)
        for column, values in zip(found, (data[: 8 * n].view(_KEY), data[8 * n : 16 * n].view(_KEY), counts), strict=True):
            column.append(values)
    return [np.concatenate(x) for x in found]


def _deal(route: np.ndarray, buckets: int, kind: int, src: int, *columns: np.ndarray, pack=_pack) -> list[tuple]:
    """Rows of BLOBS: the columns dealt to buckets by mixed hashes."""
    bucket = (route % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    columns = tuple(c[order] for c in columns)
    return [(b, kind, src, pack(*(c[cuts[b] : cuts[b + 1]] for c in columns))) for b in np.flatnonzero(np.diff(cuts)).tolist()]


def _mine(keys: np.ndarray, part: int, parts: int) -> np.ndarray:
    """Whether keys, which are mixed hashes, are of a part; _in_part() is the same for columns."""
    return (keys >> np.uint64(40)) % np.uint64(parts) == part


def _in_part(key: str, part: int, parts: int) -> Column:
    return F.shiftrightunsigned(key, 40) % parts == part


def _unique(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order that sorts keys, where in it each distinct one begins, how often it is there); much faster than a stable sort."""
    low = np.uint64((1 << max(1, len(keys).bit_length())) - 1)
    # Sorting values is several times as fast as ordering them, so the place stands in the low bits.
    order = (np.sort((keys & ~low) | np.arange(len(keys), dtype=np.uint64)) & low).astype(np.int64)
    ranked = keys[order]
    differ = ranked[1:] ^ ranked[:-1]
    if np.any((differ <= low) & (differ > 0)):
        order = np.argsort(keys)
        ranked = keys[order]
    begin = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(keys) else order
    return order, begin, np.diff(np.append(begin, len(keys)))


def _count_words(folds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, held = 0, []

        def counted() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held).view(np.int64), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts.astype(np.int64))], names=["word", "c"])

        for batch in batches:
            batch = _training(batch, folds)
            texts += len(batch)
            for part in quick_slices(batch.column("text")):
                held.append(part.words)
                if sum(map(len, held)) >= SENT:
                    yield counted()
        if held:
            yield counted()
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([END_KEY]), pa.array([texts])], names=["word", "c"])

    return lean(run)


class Vocabulary(NamedTuple):
    """Sorted hashes of the commonest words and their counts; tokens, distinct ones and ends of all training texts; a filter of very common words."""

    words: np.ndarray
    counts: np.ndarray
    tokens: int
    distinct: int
    ends: int
    hot: np.ndarray


class Table:
    """Values of sorted mixed hashes; a search begins where the first bits of a key do, which is next to it."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(1, len(keys).bit_length())
        self.shift = np.uint64(64 - bits)
        self.begin = np.cumsum(np.bincount((keys >> self.shift).astype(np.int64) + 1, minlength=(1 << bits) + 1)[: 1 << bits])
        # Behind the last key no search goes on.
        self.keys, self.values, self.n = np.append(keys, ~np.uint64(0)), np.append(values, values.dtype.type(0)), len(keys)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value or 0, is known)."""
        at = self.begin[wanted >> self.shift]
        low = np.flatnonzero(self.keys[at] < wanted)
        while len(low):
            at[low] += 1
            low = low[self.keys[at[low]] < wanted[low]]
        known = (self.keys[at] == wanted) & (at < self.n)
        return np.where(known, self.values[at], 0), known


def _extend(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The key of context with one more word before it."""
    return mix(context * BASE + word)


def _entry(context: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """The key of a next word in a context, from its key in the parent (the word itself in the empty one)."""
    return mix((context ^ GOLDEN) * M1 + prior)


def _may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether a filter holds keys: two bits of one word each."""
    one, (first, second) = np.uint64(1), FILTER_SHIFTS
    own = one << (keys >> np.uint64(first) & np.uint64(63)) | one << (keys >> np.uint64(second) & np.uint64(63))
    return bits[keys & np.uint64(len(bits) - 1)] & own == own


def _levels(part: Slice, states: np.ndarray, depth: int, hot: np.ndarray, known: int = 1 << 30) -> Iterator[tuple[np.ndarray, ...]]:
    """(place, context, prior, entry, salted, may be a state) for contexts of 1 to depth words whose parents may be states; the filter holds those shorter than `known` words.

    Places count each text's words and its end; prior is the entry in the parent;
    salted are contexts of words alone that the filter takes as very common.
    """
    texts = len(part.offsets) - 1
    sizes = np.diff(part.offsets) + 1
    line = np.full(len(part.words) + texts + 1, np.int64(END_KEY).view(np.uint64), np.uint64)
    line[1 + np.arange(len(part.words)) + np.repeat(np.arange(texts), sizes - 1)] = part.words
    common = _may_hold(hot, line)
    begin = np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    place = np.arange(len(begin))
    context, entry, salted = np.full(len(begin), ROOT), line[1:], np.ones(len(begin), bool)
    kept = salted
    for n in range(1, depth + 1):
        more = kept & (place + 1 - n >= begin[place])
        place, prior = place[more], entry[more]
        context = _extend(context[more], line[place + 1 - n])
        salted = salted[more] & common[place + 1 - n]
        entry = _entry(context, prior)
        kept = _may_hold(states, context) if n < known else np.ones(len(context), bool)
        yield place, context, prior, entry, salted, kept


def _send_contexts(states: np.ndarray, levels: range, folds: int, hot: np.ndarray, part: int, parts: int, buckets: int):
    """Counts of next words in contexts of these lengths and this part, as blobs of (context, prior, c); src is the length, kind 1 for salted ones.

    Contexts longer than the first length are taken below all that are counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, ...]]] = {n: [] for n in levels}

        def packed(n: int) -> pa.RecordBatch:
            context, prior, entry, salted = (np.concatenate(x) for x in zip(*held[n], strict=True))
            held[n].clear()
            order, begin, counts = _unique(entry)
            first, rows = order[begin], []
            for kind in (0, 1):
                own = salted[first] == bool(kind)
                at = first[own]
                rows += _deal(mix(entry[at] if kind else context[at]), buckets, kind, n, context[at], prior[at], counts[own].astype(_COUNT), pack=_pack_counts)
            return _send(rows)

        for batch in batches:
            for texts in quick_slices(_training(batch, folds).column("text"), size=LOT):
                for n, (_, context, prior, entry, salted, _) in enumerate(_levels(texts, states, levels.stop - 1, hot, levels.start), 1):
                    if n not in held:
                        continue
                    mine = _mine(context, part, parts)
                    held[n].append(tuple(x[mine] for x in (context, prior, entry, salted)))
                    if sum(len(x[0]) for x in held[n]) >= SENT:
                        yield packed(n)
        for n in levels:
            if held[n]:
                yield packed(n)

    return lean(run)


def _sum_contexts(buckets: int):
    """Next words met twice or more as blobs of (context, prior, c), dealt by prior, and the size and kinds of their contexts, dealt by context; src is the length. Salted contexts have next words elsewhere, and so several sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[tuple[int, int], list] = {}
        for batch in batches:
            for n, kind, blob in zip(batch.column("src").to_pylist(), batch.column("kind").to_pylist(), batch.column("data"), strict=True):
                sent.setdefault((n, kind), []).append(blob)
        for (level, salted), blobs in sent.items():
            context, prior, c = _unpack_counts(blobs)
            blobs.clear()
            order, begin, _ = _unique(_entry(context, prior))
            c = np.add.reduceat(c[order].astype(_KEY), begin)
            at = order[begin]
            context, prior = context[at], prior[at]
            by, begin, kinds = _unique(context)
            size, twice = np.add.reduceat(c[by], begin), c > 1
            # Where each next word was met once there is no row, and the context cannot pass.
            own = np.full(len(begin), True) if salted else np.add.reduceat(twice[by], begin, dtype=np.int64) > 0
            first = context[by[begin[own]]]
            yield _send(_deal(mix(first), buckets, TOTALS, level, first, size[own], kinds[own].astype(_KEY)) + _deal(mix(prior[twice]), buckets, ROWS, level, context[twice], prior[twice], c[twice]))

    return lean(run)


def _send_parents(buckets: int):
    """Rows (prior, before, parent) as blobs, dealt by prior."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def packed() -> pa.RecordBatch:
            prior, before, parent = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            return _send(_deal(mix(prior), buckets, PARENTS, 0, prior, before, parent))

        for batch in batches:
            held.append((batch.column("prior").to_numpy().view(np.uint64), batch.column("before").to_numpy(), batch.column("parent").to_numpy().view(np.uint64)))
            if sum(len(x[0]) for x in held) >= SENT:
                yield packed()
        if held:
            yield packed()

    return lean(run)


def _join_parents(buckets: int):
    """(context, key, c, before, parent) of the next words whose parent is a state, dealt by context; sizes are passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[int, list] = {ROWS: [], TOTALS: [], PARENTS: []}
        for batch in batches:
            for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("data"), strict=True):
                sent[kind].append(blob)
        sizes = _unpack(sent.pop(TOTALS), (_KEY, _KEY, _KEY))
        if len(sizes[0]):
            yield _send(_deal(mix(sizes[0]), buckets, TOTALS, 0, *sizes))
        keys, before, parent = _unpack(sent[PARENTS], (_KEY, _VALUE, _KEY))
        context, prior, c = _unpack(sent[ROWS], (_KEY, _KEY, _KEY))
        sent.clear()
        order = np.argsort(keys)
        at, known = Table(keys[order], order).find(prior)
        context, prior, c, at = (x[known] for x in (context, prior, c, at))
        if len(context):
            yield _send(_deal(mix(context), buckets, KNOWN, 0, context, _entry(context, prior), c, before[at], parent[at]))

    return lean(run)


@lean
def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states (rows without a key) and their next words among the contexts of a bucket."""
    sent: dict[int, list] = {TOTALS: [], KNOWN: []}
    for batch in batches:
        for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("data"), strict=True):
            sent[kind].append(blob)
    context, size, kinds = _unpack(sent[TOTALS], (_KEY, _KEY, _KEY))
    order, begin, _ = _unique(context)
    totals = context[order[begin]]
    if not sent[KNOWN]:
        return
    size, kinds = (np.add.reduceat(x[order], begin) for x in (size, kinds))
    context, key, c, before, parent = _unpack(sent[KNOWN], (_KEY, _KEY, _KEY, _VALUE, _KEY))
    sent.clear()
    order, begin, twice = _unique(context)
    context, key, c, before, parent = (x[order] for x in (context, key, c, before, parent))
    at, _ = Table(totals, np.arange(len(totals))).find(context[begin])
    size, kinds = size[at], kinds[at]
    n, k, m = np.repeat(size, twice).astype(float), np.repeat(kinds, twice).astype(float), c.astype(float)
    # Each occurrence is predicted from the others, with as much weight for the parent as there are different next words.
    gain = np.add.reduceat(m * np.log((m - 1 + k * before) / (n - 1 + k) / before), begin)
    gain += (kinds.astype(float) - twice) * np.log(kinds / (size.astype(float) - 1 + kinds))
    kept = gain >= LEAST_NATS
    signed = lambda x: pa.array(np.ascontiguousarray(x).view(np.int64))
    none = lambda x, kind: pa.nulls(len(x), kind)
    names = [x.split()[0] for x in GROWN.split(", ")]
    first = begin[kept]
    yield pa.RecordBatch.from_arrays([none(first, pa.int64()), signed(context[first]), signed(parent[first]), signed(size[kept]), signed(kinds[kept]), none(first, pa.int64()), none(first, pa.float64()), none(first, pa.float64())], names=names)
    own = np.repeat(kept, twice)
    context, key, c, before, n, k, m = (x[own] for x in (context, key, c, before, n, k, m))
    p = (m - 1 + k * before) / n
    yield pa.RecordBatch.from_arrays([signed(key), signed(context), none(key, pa.int64()), none(key, pa.int64()), none(key, pa.int64()), signed(c), pa.array(p), pa.array(np.log10(p / before) - np.log10(k / n))], names=names)


class Level(NamedTuple):
    """States of one length (context, parent, size, kinds), and their next words met twice or more (key, context, c, p, v); v is what one adds to log10 P. grown holds both, states without a key."""

    states: DataFrame
    entries: DataFrame
    grown: DataFrame


class Tree(NamedTuple):
    """Levels from one word on, the filters of all states' contexts and of their next words, the table of all training words and how many tokens and words it has."""

    levels: list[Level]
    filter: np.ndarray
    entry_filter: np.ndarray
    counted: DataFrame
    tokens: int
    distinct: int

    @property
    def log10(self) -> np.ndarray:
        """log10 P(next | state), row 0 the root's, over all training words and one unknown; dense, so for small tables only."""
        table = self.counted.toArrow()
        words = table["word"].to_numpy().view(np.uint64)
        base = self.tokens + PSEUDO * (self.distinct + 1)
        rows = [(np.append(table["c"].to_numpy(), 0) + PSEUDO) / base]
        known = {int(ROOT.view(np.int64)): (rows[0], words)}
        for level in self.levels:
            counts = {e["key"]: e["c"] for e in level.entries.toArrow().to_pylist()}
            for s in level.states.toArrow().to_pylist():
                before, prior = known[s["parent"]]
                keys = _entry(np.full(len(words), np.int64(s["context"]).view(np.uint64)), prior)
                own = np.array([*(max(0, counts.get(k, 0) - 1) for k in keys.view(np.int64).tolist()), 0])
                rows.append((own + s["kinds"] * before) / s["size"])
                known[s["context"]] = rows[-1], keys
        return np.log10(np.stack(rows))


def _buckets(df: DataFrame, places: int) -> int:
    """Buckets, which are partitions, of about RECEIVED places; as few as that, since a task sends each a row of its own."""
    return max(partitions(df.sparkSession), -(-places // RECEIVED))


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _grown_buckets(texts: DataFrame, places: int) -> int:
    """Buckets of what _sum_contexts() sends, which is far less than all places; few where these are few, since each task sends each a row."""
    return max(min(GROWN_BUCKETS, partitions(texts.sparkSession)), -(-places // (4 * RECEIVED)))


def _count(texts: DataFrame, states: np.ndarray, levels: range, folds: int, hot: np.ndarray, part: int, parts: int, places: int) -> DataFrame:
    """Counts of a part of the contexts of these lengths, which have so many places in all, as _sum_contexts() has them."""
    buckets = _buckets(texts, -(-places // parts))
    sent = texts.mapInArrow(_send_contexts(states, levels, folds, hot, part, parts, buckets), BLOBS)
    return durable(sent.repartitionById(buckets, "bucket").mapInArrow(_sum_contexts(_grown_buckets(texts, places // parts)), BLOBS))


def _grow(counts: DataFrame, level: int, parent: DataFrame, places: int) -> Level:
    """The states of so many words among counted contexts of so many places, from the parent's probabilities (prior, before, parent)."""
    buckets = _grown_buckets(counts, places)
    # Contexts below what is no state have no prior among the states' entries and go here.
    sent = counts.where(F.col("src") == level).unionByName(parent.mapInArrow(_send_parents(buckets), BLOBS))
    known = sent.repartitionById(buckets, "bucket").mapInArrow(_join_parents(buckets), BLOBS)
    grown = durable(known.repartitionById(buckets, "bucket").mapInArrow(_decide, GROWN))
    return Level(grown.where("key is null").select("context", "parent", "size", "kinds"), grown.where("key is not null").select("key", "context", "c", "p", "v"), grown)


def _mark(bits: np.ndarray, keys: DataFrame, column: str) -> np.ndarray:
    """The filter with further keys; what is collected is bounded by FILTER_BITS."""
    own = " | ".join(f"shiftleft(1L, cast(shiftrightunsigned({column}, {n}) & 63L as int))" for n in FILTER_SHIFTS)
    words = keys.groupBy(F.col(column).bitwiseAND(F.lit(len(bits) - 1)).alias("at")).agg(F.expr(f"bit_or({own})").alias("bits")).toArrow()
    bits = bits.copy()
    bits[words["at"].to_numpy()] |= words["bits"].to_numpy().view(np.uint64)
    return bits


def _commonest(rows: DataFrame, key: str, value: str, n: str, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted keys and values of the rows of greatest n, at most so many, and the n from which they are in."""
    sizes = rows.groupBy(F.least(n, F.lit(100_000)).alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("n")).toArrow()
    fits = np.cumsum(sizes["rows"].to_numpy()) <= most
    if not fits.any():
        return np.zeros(0, np.uint64), np.zeros(0), 2**62
    least = int(sizes["n"].to_numpy()[fits].min())
    top = rows.where(F.col(n) >= least).select(F.col(key).alias("key"), F.col(value).alias("value")).toArrow()
    keys = top["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], top["value"].to_numpy()[order], least


def learn(docs: DataFrame, folds: int = 10) -> tuple[Vocabulary, Tree, DataFrame]:
    """Vocabulary, tree and the table of all training words (word, c), from rows whose crc32(doc_id as text) mod folds is not 0.

    Counts cover all training texts and are summed by shuffles; what is collected is
    bounded: COMMON words and the filters.
    """
    texts = docs.select("doc_id", "text")
    counted = durable(texts.mapInArrow(_count_words(folds), "word long, c long").groupBy("word").agg(F.sum("c").alias("c")))
    whole = counted.agg(F.sum("c"), F.count("*"), F.sum(F.when(F.col("word") == END_KEY, F.col("c")))).first()
    total, distinct, ends = (int(x or 0) for x in whole)
    words, counts, _ = _commonest(counted.where(F.col("word") != END_KEY), "word", "c", "c", COMMON)
    common = counted.where(F.col("c") > total * HOT_SHARE).select("word")
    hot = _mark(np.zeros(HOT_BITS >> 6, np.uint64), common, "word")
    bits = min(FILTER_BITS, 1 << max(12, (2 * total).bit_length()))
    states, entries, levels = np.zeros(bits >> 6, np.uint64), np.zeros(bits >> 6, np.uint64), []
    root = F.lit(int(ROOT.view(np.int64)))
    # A next word met twice in a context was met twice at all.
    parent = counted.where("c > 1").select(F.col("word").alias("prior"), ((F.col("c") + PSEUDO) / (total + PSEUDO * (distinct + 1))).alias("before"), root.alias("parent"))
    places = total
    while places:
        # What few places can still grow is counted for several lengths at once.
        lengths = range(len(levels) + 1, len(levels) + (1 + AT_ONCE if places * FEW < total else 2))
        parts = -(-PARTS * places // total)
        sent = places * len(lengths)
        counted_parts = [_count(texts, states, lengths, folds, hot, i, parts, sent) for i in range(parts)]
        for n in lengths:
            # One part after the other, as the disk holds what is dealt of one only.
            grown = [_grow(x, n, parent, sent // parts) for x in counted_parts]
            level = Level(*(_union(list(x)) for x in zip(*grown, strict=True)))
            places = int(level.states.agg(F.sum("size")).first()[0] or 0)
            if not places:
                break
            levels.append(level)
            states, entries = _mark(states, level.states, "context"), _mark(entries, level.entries, "key")
            parent = level.entries.select(F.col("key").alias("prior"), F.col("p").alias("before"), F.col("context").alias("parent"))
        discard(*counted_parts)
        give_back()
    return Vocabulary(words, counts, total, distinct, ends, hot), Tree(levels, states, entries, counted, total, distinct), counted


def _values(tree: Tree) -> DataFrame:
    """(key, v, n): what a state as such (by context) and a next word met twice in it (by entry) add to log10 P; n orders by frequency."""
    own = [F.coalesce(*x) for x in (("key", "context"), ("v", F.log10(F.col("kinds") / F.col("size"))), ("c", "size"))]
    return _union([x.grown.select(*(c.alias(n) for c, n in zip(own, ("key", "v", "n"), strict=True))) for x in tree.levels])


def _send_values(kind: int, buckets: int):
    """Rows (key, value) as blobs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def packed() -> pa.RecordBatch:
            route, keys, values = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            return _send(_deal(route, buckets, kind, 0, keys, values))

        for batch in batches:
            keys = batch.column(0).to_numpy().view(np.uint64)
            held.append((mix(keys), keys, batch.column(1).to_numpy().astype(_VALUE)))
            if sum(len(x[0]) for x in held) >= SENT:
                yield packed()
        if held:
            yield packed()

    return lean(run)


#: A task's texts: key, n_tokens, n_known, base, gain, number.
_TEXT_COLUMNS = (_KEY, _VALUE, _VALUE, _VALUE, _VALUE, _COUNT)


def _ask(vocabulary: Vocabulary, tree: Tree, common: tuple[np.ndarray, np.ndarray], buckets: int):
    """A task's texts (key, n_tokens, n_known, base, gain) as far as it knows, and the words and values that it must ask for, with the text's number."""
    v, depth = vocabulary, len(tree.levels)
    base, states, entry_filter = v.tokens + PSEUDO * (v.distinct + 1), tree.filter, tree.entry_filter

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, done, seen = TaskContext.get().partitionId(), 0, set()
        words, values = Table(v.words, v.counts), Table(*common)
        asked: list[tuple[list, list]] = [([], []), ([], [])]

        def packed(kind: int) -> list[tuple]:
            keys, at = (np.concatenate(x) for x in asked[kind])
            asked[kind] = [], []
            return _deal(mix(keys), buckets, kind, src, keys, at)

        for batch in batches:
            fresh = []
            for key in batch.column("key").to_pylist():
                if len(seen) >= REMEMBERED:
                    seen.clear()
                fresh.append(key not in seen)
                seen.add(key)
            batch = batch.filter(pa.array(fresh, pa.bool_()))
            text_keys = batch.column("key").to_numpy().view(np.uint64)
            for texts in quick_slices(batch.column("text"), size=LOT):
                n = texts.last - texts.first
                sizes = np.diff(texts.offsets) + 1
                owner = np.repeat(np.arange(n), sizes)

                def look(kind: int, table: Table, keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
                    """(value, is known, text) of keys; the others are asked for."""
                    value, known = table.find(keys)
                    asked[kind][0].append(keys[~known])
                    asked[kind][1].append(at[~known].astype(_COUNT) + np.uint32(done))
                    return value, known, at

                counts, known, at = look(ASK_WORD, words, texts.words, np.repeat(np.arange(n), sizes - 1))
                flat = np.bincount(at, np.where(known, np.log10(counts + PSEUDO), math.log10(PSEUDO)), n)
                n_known = np.bincount(at[known], minlength=n).astype(float)
                gain = np.zeros(n)
                n_known += v.ends > 0
                flat += math.log10(v.ends + PSEUDO) - sizes * math.log10(base)
                for place, context, _, entry, _, kept in _levels(texts, states, depth, v.hot):
                    for keys, hit in ((context, kept), (entry, _may_hold(entry_filter, entry))):
                        value, _, at = look(ASK_VALUE, values, keys[hit], owner[place[hit]])
                        gain += np.bincount(at, value, n)
                rows = [(src % buckets, TEXTS, src, _pack(text_keys[texts.first : texts.last], sizes.astype(_VALUE), n_known, flat, gain, np.arange(done, done + n, dtype=_COUNT)))]
                for kind in (ASK_WORD, ASK_VALUE):
                    if sum(map(len, asked[kind][0])) >= SENT:
                        rows += packed(kind)
                done += n
                yield _send(rows)
        rows = [row for kind in (ASK_WORD, ASK_VALUE) if asked[kind][0] for row in packed(kind)]
        if rows:
            yield _send(rows)

    return lean(run)


@lean
def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by text of what was asked for, to the tasks that asked; their texts are passed on."""
    sent: dict[int, list] = {kind: [] for kind in range(7)}
    asked: dict[tuple[int, int], list] = {}
    for batch in batches:
        for kind, src, blob in zip(batch.column("kind").to_pylist(), batch.column("src").to_pylist(), batch.column("data"), strict=True):
            if kind == TEXTS:
                yield _send([(0, kind, src, blob.as_py())])
            elif kind in (ASK_WORD, ASK_VALUE):
                asked.setdefault((kind, src), []).append(blob)
            else:
                sent[kind].append(blob)
    tables = {}
    for ask, kind in ((ASK_WORD, WORDS), (ASK_VALUE, VALUES)):
        keys, values = _unpack(sent[kind], (_KEY, _VALUE))
        order = np.argsort(keys)
        tables[ask] = Table(keys[order], values[order])
    for (kind, src), blobs in asked.items():
        keys, at = _unpack(blobs, (_KEY, _COUNT))
        value, known = tables[kind].find(keys)
        keys, value, at = keys[known], value[known], at[known]
        if len(at):
            texts, back = np.unique(at, return_inverse=True)
            if kind == ASK_WORD:
                # A word was taken as unknown before.
                value = np.log10(value + PSEUDO) - math.log10(PSEUDO)
            yield _send([(0, kind + WORD_SUMS, src, _pack(texts.astype(_COUNT), np.bincount(back).astype(_VALUE), np.bincount(back, value)))])


@lean
def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n_tokens, n_known, base, gain) of the texts of tasks."""
    tasks: dict[int, dict[int, list]] = {}
    for batch in batches:
        for kind, src, blob in zip(batch.column("kind").to_pylist(), batch.column("src").to_pylist(), batch.column("data"), strict=True):
            tasks.setdefault(src, {}).setdefault(kind, []).append(blob)
    for found in tasks.values():
        *columns, number = _unpack(found.get(TEXTS, []), _TEXT_COLUMNS)
        order = np.argsort(number)
        keys, tokens, known, base, gain = (c[order] for c in columns)
        for kind in (WORD_SUMS, VALUE_SUMS):
            at, n, value = _unpack(found.get(kind, []), (_COUNT, _VALUE, _VALUE))
            total = np.bincount(at, value, len(keys))
            if kind == WORD_SUMS:
                known, base = known + np.bincount(at, n, len(keys)), base + total
            else:
                gain = gain + total
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(tokens.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(gain)], names=["key", "n_tokens", "n_known", "base", "gain"])


def suffix_tree_scores(docs: DataFrame, folds: int = 10, learned: tuple[Vocabulary, Tree, DataFrame] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words (A-Z lower-cased) and an end. Null and empty texts are an end
    alone; a null doc_id counts as the empty text, whose remainder is 0. A text is
    scored once however many rows have it (texts are equal when their 64-bit hashes
    are), and each row gets its own. learned: what learn() gave for these or other
    texts; without it docs are learnt from. Without training rows every token is unknown and
    the scores are those of an empty count. Extra columns are left out; an empty table
    gives an empty one.
    """
    vocabulary, tree, counted = learned or learn(docs, folds)
    texts = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), "text")
    places = -(-vocabulary.tokens // SCORE_PARTS)
    buckets = _buckets(docs, places)
    values = _values(tree) if tree.levels else None
    keys, own, least = (np.zeros(0, np.uint64), np.zeros(0), 0) if values is None else _commonest(values, "key", "v", "n", COMMON_VALUES)
    sums = []
    for part in range(SCORE_PARTS):
        sent = [texts.where(_in_part("key", part, SCORE_PARTS)).mapInArrow(_ask(vocabulary, tree, (keys, own), buckets), BLOBS), counted.where(F.col("word") != END_KEY).select("word", F.col("c").cast("double")).mapInArrow(_send_values(WORDS, buckets), BLOBS)]
        if values is not None:
            sent.append(values.where(F.col("n") < least).select("key", "v").mapInArrow(_send_values(VALUES, buckets), BLOBS))
        answered = _union(sent).repartitionById(buckets, "bucket").mapInArrow(_answer, BLOBS)
        found = answered.repartition(partitions(docs.sparkSession), "src").mapInArrow(_add_up, "key long, n_tokens long, n_known long, base double, gain double")
        # Several tasks may have scored a copied text, all alike.
        sums.append(durable(found.groupBy("key").agg(*[F.max(c).alias(c) for c in ("n_tokens", "n_known", "base", "gain")])))
    scored = _union(sums)
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(folds)) == 0
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key")).join(scored, "key")
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(vocabulary.tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), (F.col("base") + F.col("gain")).alias("score"))
