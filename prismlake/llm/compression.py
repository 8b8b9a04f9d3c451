"""Quality rules by compression bands.

zstandard ratios (compressed size / size) of the whole text and of its fixed chunks,
the last shorter one included, are held against limits that depend on the length: below
them a text repeats itself or is full of marks, above them it is not language (random or
encoded data). Limits are fitted to labelled good texts: a cubic in the logarithm of the
length, and bands of an octave for the tails of what differs from it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from prismlake.llm.memory import lean
from prismlake.llm.words import _IS_SPACE, mix, word_slices
from prismlake.session import discard, durable

#: Without labels: (from so many bytes, least ratio, greatest ratio); shorter texts are not judged by ratio.
BANDS = ((256, 0.30, 0.78), (512, 0.28, 0.72), (1024, 0.26, 0.62), (2048, 0.26, 0.528), (2560, 0.26, 0.515), (4096, 0.24, 0.51), (16384, 0.22, 0.50))
#: With labels: good texts that limits are fitted to at least, else BANDS hold.
LEAST_LABELLED = 200
#: Labelled ids up to which their texts are found by a broadcast; beyond, all texts are measured and the measures joined.
BROADCAST_IDS = 1_000_000
#: Lengths are told apart by so many leading bits, distances from the curve by such steps; so what is counted has a bounded size.
LENGTH_BITS, STEP = 16, 1e-5
#: Share of good texts that may lie beyond a limit, and what is left free beyond that.
TAIL, MARGIN = 0.001, 0.01
#: More room for each octave that a text is longer than the good ones.
FARTHER = 0.02
#: More room for chunks, of which a text has many.
CHUNK_MARGIN = 0.015
CHUNK = 4096
#: A text fails when more than this share of its chunks is outside the limits for their bytes.
CHUNK_SHARE = 0.1
LEVEL = 3
WINDOW = 8
FEWEST_WORDS = 20
#: Percent of words in repeated windows above which a text fails.
MOST_REPEATED = 30
SYMBOLS = b"#*$%&|<>"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def limits(size: int, bands=BANDS) -> tuple[float, float]:
    """Least and greatest ratio for a text of so many bytes."""
    found = (0.0, float("inf"))
    for start, low, high in bands:
        if size >= start:
            found = (low, high)
    return found


class Fitted(NamedTuple):
    """Limits around a curve of ratios by length: coefficients over log2 of bytes, the lengths (as log2) it was fitted between, and for each octave from the first how far a ratio may lie below and above."""

    curve: tuple[float, ...]
    first: float
    last: float
    tails: tuple[tuple[float, float], ...]

    def __call__(self, size: int) -> tuple[float, float]:
        if size < BANDS[0][0]:
            return 0.0, float("inf")
        at = np.log2(size)
        inside = min(max(at, self.first), self.last)
        low, high = self.tails[min(max(int(inside) - int(self.first), 0), len(self.tails) - 1)]
        middle, room = float(np.polyval(self.curve, inside)), FARTHER * max(0.0, at - self.last)
        return middle + low - room, middle + high + room


def quantile(values: np.ndarray, counts: np.ndarray, q: float) -> float:
    """The quantile of ascending values that each stand for so many, interpolated as numpy does."""
    upto = np.cumsum(counts)
    place = q * (upto[-1] - 1)
    low, high = (values[np.searchsorted(upto, k, side="right")] for k in (np.floor(place), np.ceil(place)))
    return float(low + (high - low) * (place - np.floor(place)))


def fit(rows: DataFrame) -> Fitted | None:
    """Limits for all texts of rows (n_bytes, whole_ratio); None for too few. An octave's tails are those of it and its neighbours together.

    Two aggregations over all rows: sums by length for the curve, then counts by octave
    and distance from it for the tails. Only these, of a bounded number, are collected;
    sums are of whole numbers, so that runs agree.
    """
    long = rows.where(F.col("n_bytes") >= BANDS[0][0])
    drop = F.greatest(F.floor(F.log2("n_bytes")).cast("int") - (LENGTH_BITS - 1), F.lit(0))
    length = F.call_function("shiftleft", F.call_function("shiftright", F.col("n_bytes"), drop), drop)
    sums = long.groupBy(length.alias("length")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("whole_ratio") * 1e9).cast("long")).alias("total")).orderBy("length").toArrow()
    n = sums["n"].to_numpy()
    if n.sum() < LEAST_LABELLED:
        return None
    at = np.log2(sums["length"].to_numpy())
    curve = np.polyfit(at, sums["total"].to_numpy() / 1e9 / n, 3, w=np.sqrt(n))
    size, middle = F.log2("n_bytes"), F.lit(0.0)
    for c in map(float, curve):
        middle = middle * size + F.lit(c)
    steps = F.round((F.col("whole_ratio") - middle) / STEP).cast("long")
    found = long.groupBy(F.floor(size).cast("int").alias("octave"), steps.alias("step")).agg(F.count("*").alias("n")).orderBy("step").toArrow()
    octave, step, n = (found[c].to_numpy() for c in ("octave", "step", "n"))
    tails = []
    for k in range(octave.min(), octave.max() + 1):
        near = np.abs(octave - k) <= 1
        tails.append((quantile(step[near] * STEP, n[near], TAIL) - MARGIN, quantile(step[near] * STEP, n[near], 1 - TAIL) + MARGIN))
    return Fitted(tuple(map(float, curve)), float(at.min()), float(at.max()), tuple(tails))


def repeated_words(words: np.ndarray, window: int = WINDOW) -> int:
    """Words in windows of so many words that occur twice or more, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    grams = np.zeros(n, np.uint64)
    for i in range(window):
        grams = grams * np.uint64(0xD6E8FEB86659FD93) + words[i : i + n]
    grams = mix(grams)
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    edge[at] += 1
    edge[at + window] -= 1
    return int((np.cumsum(edge) > 0).sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


SCHEMA = pa.schema(
    [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("n_bytes", pa.int64()), ("whole_ratio", pa.float64()), ("bad_chunks", pa.int64()), ("n_chunks", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_())]
)
DDL = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_bytes long, whole_ratio double, bad_chunks long, n_chunks long, base_failed boolean, kept boolean"


def _judge(held: Callable[[int], tuple[float, float]], room: float = 0.0):
    """held: limits by length; room: more for chunks."""
    return lean(lambda batches: _judged(batches, held, room))


def _judged(batches: Iterator[pa.RecordBatch], held: Callable[[int], tuple[float, float]], room: float) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=LEVEL)
    for batch in batches:
        rows = []
        # keep_clean() has the text in its row only, so that it is not sent twice.
        texts = batch.column("text") if "text" in batch.schema.names else batch.column("row").field("text")
        for part in word_slices(texts, fold=False):
            for r in range(part.last - part.first):
                a, b = int(part.starts[r]), int(part.starts[r + 1])
                data = part.data[a:b]
                text = data.tobytes()
                inside = np.count_nonzero(~_IS_SPACE[data] & ((data & 0xC0) != 0x80))
                words = part.words[part.offsets[r] : part.offsets[r + 1]]
                repeats = repeated_words(words)
                failed = len(words) < FEWEST_WORDS or 100 * repeats > MOST_REPEATED * len(words)
                ratio = len(pack.compress(text)) / len(text) if text else None
                # A text of less than a chunk is judged as a whole, a rest that is too short for any band with the whole.
                chunks = [x for i in range(0, len(text), CHUNK) if len(x := text[i : i + CHUNK]) >= BANDS[0][0]] if len(text) >= CHUNK else []
                bad = sum(not low - room <= len(pack.compress(x)) / len(x) <= high + room for x in chunks for low, high in [held(len(x))])
                least, most = held(len(text))
                fits = ratio is None or least <= ratio <= most
                rows.append((len(words), inside, np.count_nonzero(_SYMBOL[data]), repeated_lines(text), repeats, len(text), ratio, bad, len(chunks), failed, not failed and fits and bad <= CHUNK_SHARE * len(chunks)))
        others = [(c, batch.column(c)) for c in batch.schema.names if c != "text"]
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in SCHEMA]
        yield pa.RecordBatch.from_arrays([*[x for _, x in others], *[pa.array(c, f.type) for c, f in zip(columns, SCHEMA, strict=True)]], names=[*[n for n, _ in others], *SCHEMA.names])


def fitted(docs: DataFrame, labels: DataFrame | None, hold_out: bool = True):
    """A judge of texts by limits fitted to all good ones that labels (doc_id, quality) mark.

    With hold_out, rows whose crc32(doc_id) mod 3 is 1 are not fitted to. Texts that fail the base rules
    are not fitted to. With too few good texts, or without labels, BANDS hold. Where
    labels are many, all texts are measured, so that their measures meet the labels and
    not they themselves.
    """
    if labels is None:
        return _judge(limits)
    rated = labels.where("quality = 1 and doc_id is not null")
    if hold_out:
        rated = rated.where("crc32(cast(doc_id as string)) % 3 <> 1")
    good = rated.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    good = durable(good)
    few = good.count() <= BROADCAST_IDS
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    if few:
        texts = texts.join(F.broadcast(good), "doc_id", "left_semi")
    rows = texts.mapInArrow(_judge(limits), "doc_id long, " + DDL).where("not base_failed").select("doc_id", "n_bytes", "whole_ratio")
    rows = durable(rows if few else rows.join(good, "doc_id", "left_semi"))
    found = fit(rows)
    discard(rows, good)
    return _judge(limits) if found is None else _judge(found, CHUNK_MARGIN)


def compression_rules(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """One row per row of docs: doc_id, the base counts, ratios, base_failed and kept, by limits fitted to the labelled good ones (see fitted()).

    A map over rows: no text is shuffled. Null and empty texts have no words, no
    ratio, and fail as too short. Repeated rows are judged alike, null ids are kept
    as null, extra columns are left out, an empty table gives an empty one.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(fitted(docs, labels), "doc_id long, " + DDL)


def keep_clean(docs: DataFrame, labels: DataFrame | None = None, hold_out: bool = True) -> DataFrame:
    """The rows of docs that pass, with docs' columns, whatever their names; hold_out as for fitted().

    Null and empty texts go as too short; repeated rows and null ids stay or go by
    their text; an empty table gives an empty one.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    hidden = docs.select(whole.alias("row"))
    schema = StructType([hidden.schema["row"], *[StructField(f.name, {pa.int64(): LongType(), pa.float64(): DoubleType(), pa.bool_(): BooleanType()}[f.type]) for f in SCHEMA]])
    kept = hidden.mapInArrow(fitted(docs, labels, hold_out), schema).where("kept")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
