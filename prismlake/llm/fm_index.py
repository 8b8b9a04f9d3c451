"""Benchmark decontamination with an FM-index for each training shard.

A task indexes its documents shard by shard. A shard's words become symbols, the
numbers of words that the benchmark has; what cannot be part of a phrase is a
separator. Its suffixes are sorted, the symbol before each gives the Burrows-Wheeler
transform, and a wavelet matrix over that answers rank. All phrases are searched
backwards at once; sampled suffix positions locate the occurrences; their spans are
merged document by document.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismlake.llm.memory import lean
from prismlake.llm.words import Vocabulary, term_places, term_slices
from prismlake.session import durable

#: Words of a window; an item of fewer is one window.
WINDOW = 10
#: Every so manieth position of a text is kept with the suffixes.
SAMPLE = 16
#: Words of a shard; a longer document is a shard of its own.
SHARD_WORDS = 1 << 21
#: Bytes of benchmark text that a task holds at a time; more is searched in blocks.
BLOCK_BYTES = 32 << 20
FOUND = "n_words long, spans array<struct<begin:long,end:long>>, items array<string>"


class Bits:
    """A bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.counts = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.counts[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[block] + np.bitwise_count(self.words[block] & mask)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class Wavelet:
    """A wavelet matrix: a bit vector for each bit of the symbols, the highest first; zeros go before ones."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.depth = max(1, int(size - 1).bit_length())
        self.levels: list[tuple[Bits, int]] = []
        for d in reversed(range(self.depth)):
            bits = (symbols >> d & 1).astype(bool)
            self.levels.append((Bits(bits), int(len(bits) - bits.sum())))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])

    def rank(self, symbol: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """Where each symbol's run begins in the last order, and the places that `places` have after it."""
        out = [np.zeros(len(symbol), np.int64), *places]
        for d, (bits, zeros) in zip(reversed(range(self.depth)), self.levels, strict=True):
            one = (symbol >> d & 1).astype(bool)
            for k, i in enumerate(out):
                r = bits.rank(i)
                out[k] = np.where(one, zeros + r, i - r)
        return out

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at each place, where the place is in the last order)."""
        symbol = np.zeros(len(i), np.int64)
        for bits, zeros in self.levels:
            one, r = bits[i], bits.rank(i)
            i = np.where(one, zeros + r, i - r)
            symbol = symbol << 1 | one
        return symbol, i


def sorted_suffixes(text: np.ndarray, separator: int) -> np.ndarray:
    """Positions of text's suffixes in order; each separator is a symbol of its own above all others, later ones greater. The last symbol is one."""
    n = len(text)
    width = max(1, int(separator).bit_length())
    known = min(62 // width, n)
    key = np.zeros(n, np.int64)
    ended = np.zeros(n, bool)
    for k in range(known):
        symbol = np.full(n, separator, np.int64)
        symbol[: n - k] = text[k:]
        key = key << width | np.where(ended, 0, symbol)
        ended |= symbol == separator
    order = np.argsort(key)
    change = np.ones(n, bool)
    change[1:] = key[order[1:]] != key[order[:-1]]
    first = np.flatnonzero(change)
    group = np.repeat(first, np.diff(np.append(first, n)))
    # Suffixes that meet a separator before they differ are in order of position.
    tied = np.flatnonzero((np.diff(np.append(first, n)) > 1)[np.cumsum(change) - 1])
    over = tied[ended[order[tied]]]
    order[over] = np.sort(group[over] << 31 | order[over]) & ((1 << 31) - 1)
    rank = np.empty(n, np.int64)
    rank[order] = group
    rank[order[over]] = over
    # The others by doubling: what follows `known` symbols later has a rank already.
    open_ = tied[~ended[order[tied]]]
    while len(open_):
        at = order[open_]
        by = np.lexsort((rank[at + known], rank[at]))
        at = at[by]
        order[open_] = at
        own, after = rank[at], rank[at + known]
        new = np.ones(len(at), bool)
        new[1:] = (own[1:] != own[:-1]) | (after[1:] != after[:-1])
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(at)))
        rank[at] = np.repeat(open_[first], sizes)
        open_ = open_[np.repeat(sizes, sizes) > 1]
        known *= 2
    return order


class FMIndex:
    """Backward search over a text of symbols 0 .. separator; the text ends with a separator."""

    def __init__(self, text: np.ndarray, separator: int, sample: int = SAMPLE):
        suffixes = sorted_suffixes(text, separator)
        self.before = np.zeros(separator + 2, np.int64)
        np.cumsum(np.bincount(text, minlength=separator + 1), out=self.before[1:])
        self.wavelet = Wavelet(text[suffixes - 1], separator + 1)
        self.base = self.wavelet.rank(np.arange(separator + 1))[0]
        # Beginnings after a separator are kept too, so that no walk passes one.
        kept = (suffixes % sample == 0) | (text[suffixes - 1] == separator)
        self.sampled, self.positions = Bits(kept), suffixes[kept]

    def ranges(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of symbols the suffixes that begin with it: from, to."""
        last = phrases[:, -1]
        low, high = self.before[last], self.before[last + 1]
        for k in reversed(range(phrases.shape[1] - 1)):
            alive = np.flatnonzero(low < high)
            if not len(alive):
                break
            symbol = phrases[alive, k]
            base, i, j = self.wavelet.rank(symbol, low[alive], high[alive])
            low[alive], high[alive] = self.before[symbol] + i - base, self.before[symbol] + j - base
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The positions of suffixes: steps back in the text until a kept one."""
        found = np.empty(len(rows), np.int64)
        walking, steps = np.arange(len(rows)), 0
        while len(walking):
            there = self.sampled[rows]
            found[walking[there]] = self.positions[self.sampled.rank(rows[there])] + steps
            walking, rows = walking[~there], rows[~there]
            symbol, i = self.wavelet.access(rows)
            rows, steps = self.before[symbol] + i - self.base[symbol], steps + 1
        return found


class Phrases(NamedTuple):
    """The windows of a benchmark: its words, its item ids in order, and by length distinct rows of word numbers and the items that have each.

    The items of window w of a length are items[starts[w]:starts[w + 1]], as numbers of ids.
    """

    vocabulary: Vocabulary
    ids: pa.Array
    windows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def phrases(texts: pa.ChunkedArray, item_ids: list[str | None], window: int = WINDOW) -> Phrases:
    """All windows of items; an item without an id has windows but no number."""
    ids = sorted({x for x in item_ids if x is not None})
    place = {x: i for i, x in enumerate(ids)}
    label = np.array([place.get(x, -1) for x in item_ids], np.int64)
    words, offsets = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for s in term_slices(texts):
        words.append(s.words)
        offsets.append(s.offsets[1:] + offsets[-1][-1])
    words_, offsets_ = np.concatenate(words), np.concatenate(offsets)
    vocabulary = Vocabulary(words_)
    numbers, sizes = vocabulary.find(words_), np.diff(offsets_)
    out = []
    for length in np.unique(np.minimum(sizes[sizes > 0], window)):
        items = np.flatnonzero(np.minimum(sizes, window) == length)
        each = sizes[items] - length + 1
        item = np.repeat(items, each)
        begin = offsets_[item] + np.arange(len(item)) - np.repeat(np.cumsum(each) - each, each)
        rows, which = np.unique(numbers[begin[:, None] + np.arange(length)], axis=0, return_inverse=True)
        named = label[item] >= 0
        pairs = np.unique(which.ravel()[named] * len(sizes) + label[item[named]])
        out.append((rows, np.searchsorted(pairs, np.arange(len(rows) + 1) * len(sizes)), pairs % len(sizes)))
    return Phrases(vocabulary, pa.array(ids, pa.string()), out)


def _sequence(numbers: np.ndarray, offsets: np.ndarray, separator: int, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, the word that each is): runs of benchmark words within a document, those that are long enough for a phrase, a separator after each."""
    known = numbers >= 0
    begin = known.copy()
    begin[1:] &= ~known[:-1]
    starts = offsets[:-1][offsets[:-1] < len(known)]
    begin[starts] = known[starts]
    run = np.cumsum(begin) - 1
    words = np.flatnonzero(known)
    sizes = np.bincount(run[words], minlength=int(begin.sum())) if len(words) else np.zeros(0, np.int64)
    words = words[sizes[run[words]] >= shortest]
    ends = np.flatnonzero(np.append(run[words][1:] != run[words][:-1], True)) + 1 if len(words) else np.zeros(0, np.int64)
    return np.insert(numbers[words].astype(np.int64), ends, separator), np.insert(words, ends, -1)


def occurrences(numbers: np.ndarray, offsets: np.ndarray, wanted: Phrases) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(first words, windows, length, number of the length) of all places of a shard where a window occurs, from an index of the shard."""
    if not wanted.windows:
        return
    separator = len(wanted.vocabulary)
    text, word = _sequence(numbers, offsets, separator, min(rows.shape[1] for rows, *_ in wanted.windows))
    if not len(text):
        return
    index = FMIndex(text, separator)
    for k, (rows, *_) in enumerate(wanted.windows):
        low, high = index.ranges(rows)
        times = high - low
        which = np.repeat(np.arange(len(rows)), times)
        at = index.locate(low[which] + np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times))
        yield word[at], which, rows.shape[1], k


def _found(numbers: np.ndarray, offsets: np.ndarray, wanted: Phrases) -> list[pa.Array]:
    """n_words, spans and items of a shard's documents."""
    n = len(offsets) - 1
    covered = np.zeros(len(numbers) + 1, np.int64)
    pairs = [np.zeros(0, np.int64)]
    n_items = max(1, len(wanted.ids))
    for first, which, length, k in occurrences(numbers, offsets, wanted):
        covered += np.bincount(first, minlength=len(covered)) - np.bincount(first + length, minlength=len(covered))
        _, starts, items = wanted.windows[k]
        doc = np.searchsorted(offsets, first, "right") - 1
        doc, window = np.divmod(np.unique(doc * len(starts) + which), len(starts))
        each = starts[window + 1] - starts[window]
        item = items[np.repeat(starts[window], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)]
        pairs.append(np.unique(np.repeat(doc, each) * n_items + item))
    hit = np.cumsum(covered)[:-1] > 0
    begin, end = hit.copy(), hit.copy()
    begin[1:] &= ~hit[:-1]
    end[:-1] &= ~hit[1:]
    starts = offsets[:-1][offsets[:-1] < len(hit)]
    begin[starts] = hit[starts]
    end[starts[starts > 0] - 1] = hit[starts[starts > 0] - 1]
    begins, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    doc = np.searchsorted(offsets, begins, "right") - 1
    spans = pa.StructArray.from_arrays([pa.array(begins - offsets[doc]), pa.array(ends - offsets[doc])], names=["begin", "end"])
    found = np.unique(np.concatenate(pairs))
    places = lambda d: pa.array(np.searchsorted(d, np.arange(n + 1)).astype(np.int32))
    return [pa.array(np.diff(offsets)), pa.ListArray.from_arrays(places(doc), spans), pa.ListArray.from_arrays(places(found // n_items), wanted.ids.take(pa.array(found % n_items)))]


def _search(wanted: Phrases):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(o) for _, _, o in held]))])
            columns = [pa.concat_arrays([x for x, _, _ in held]), *_found(np.concatenate([x for _, x, _ in held]), offsets, wanted)]
            return pa.RecordBatch.from_arrays(columns, names=["key", "n_words", "spans", "items"])

        for batch in batches:
            for s in term_slices(batch.column("text")):
                if held and size + len(s.words) > SHARD_WORDS:
                    yield flush()
                    held, size = [], 0
                held.append((batch.column("key").slice(s.first, s.last - s.first), wanted.vocabulary.find(s.words), s.offsets))
                size += len(s.words)
        if held:
            yield flush()

    return lean(run)


def _merged(spans: Column) -> Column:
    """Sorted spans, those that meet or overlap as one."""
    kind = "array<struct<begin:long,end:long>>"

    def step(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["begin"].alias("begin"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (s["begin"] <= F.get(done, F.size(done) - 1)["end"]), longer).otherwise(F.concat(done, F.array(s))).cast(kind)

    return F.aggregate(F.array_sort(spans), F.array().cast(kind), step)


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Where documents (doc_id, text) hold passages of benchmark items (item_id, text): one row for each row of docs.

    Columns: doc_id, n_words, spans (merged, begin and end as numbers of words from 0),
    items (ids of items of which a window occurs, distinct, sorted as strings). Null and
    empty texts have no words and no windows; items without an id count for spans but
    are not listed; repeated rows count each, repeated items as one; extra columns are
    left out; an empty table gives an empty one. A benchmark of more than block_bytes is
    searched in blocks of about that size, whose results are merged by row.
    """
    slim = benchmark.select("item_id", "text")
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    name = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.col("doc_id").alias("key"), "text")
    if blocks > 1:
        # Rows get numbers of their own, by which blocks' results meet.
        numbered = durable(rows.withColumn("row_id", F.monotonically_increasing_id()))
        rows, name = numbered.select(F.col("row_id").alias("key"), "text"), "bigint"
    found = None
    for b in range(blocks):
        table = (slim.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else slim).toArrow()
        ids = [None if x is None else str(x) for x in table["item_id"].to_pylist()]
        part = rows.mapInArrow(_search(phrases(table["text"], ids, window)), f"key {name}, {FOUND}")
        found = part if found is None else found.unionByName(part)
    if blocks == 1:
        return found.withColumnRenamed("key", "doc_id")
    # At most a row a block meets for each document.
    met = found.groupBy("key").agg(F.max("n_words").alias("n_words"), _merged(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return numbered.select(F.col("key").alias("doc_id"), F.col("row_id").alias("key")).join(met, "key").select("doc_id", "n_words", "spans", "items")


def digested(found: DataFrame) -> DataFrame:
    """leaks() as counts and a checksum: doc_id, n_words, n_hit, n_items, items_sha256 (of no items: of the empty text), contaminated."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the terms of their spans and what stands between those."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        spans, out = batch.column("spans").to_pylist(), []
        for text, own in zip(texts, spans, strict=True):
            if own:
                data = text.encode()
                (s,) = term_slices(pa.array([text]))
                at = term_places(s.data)
                kept, begin = [], 0
                for x in own:
                    kept.append(data[begin : at[0][x["begin"]]])
                    begin = at[1][x["end"] - 1]
                text = (b"".join(kept) + data[begin:]).decode()
            out.append(text)
        yield batch.set_column(batch.schema.names.index("text"), "text", pa.array(out, pa.string())).drop_columns(["spans"])


def without_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the removal spans cut out of their texts; all other columns stay. Rows are joined by numbers of their own, so ids may repeat or be null."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    held = durable(docs.select(whole).withColumn("row_id", F.monotonically_increasing_id()))
    found = leaks(held.select(F.col("row_id").alias("doc_id"), F.col("row.text").alias("text")), benchmark, window)
    marked = found.where(F.size("spans") > 0).select(F.col("doc_id").alias("row_id"), "spans")
    joined = held.join(marked, "row_id", "left").select("row", F.col("row.text").alias("text"), "spans")
    cut = joined.mapInArrow(lean(_cut), joined.drop("spans").schema)
    return cut.select(*[(F.col("text") if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])
