"""Best-fit packing of token sequences with exact complements.

Pieces are counted by length. From the longest down, what fills a sequence exactly (one
piece, or two or three whose lengths sum to the gap) is taken as often as all its
lengths last; the rest is packed best fit, longest first. All this works on the
counts of at most `capacity` lengths, so it is small whatever the corpus; pieces get
their places by their distributed rank among those of their length.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from prismlake.llm.memory import lean
from prismlake.operators.running import running_before

CAPACITY = 2048
TOKENIZER = "byte_bpe_50k.json"
#: The same vocabulary as ranks: encodes single words about five times as fast.
RANKS = "byte_bpe_50k.tiktoken"
END_ID = 0
#: Encoded chunks that a worker remembers at most, and how many of the first ones, which hold the common words, it never forgets.
REMEMBERED, CORE = 250_000, 100_000
#: Longer chunks (in signs) are not remembered, so that the memory is bounded: under 100 MB.
LONGEST_REMEMBERED = 64
#: White space of ASCII other than space and line feed, as Python and the tokenizer see it.
OTHER_SPACES = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"

# Where a text may be cut so that byte-level BPE gives the same tokens: before a lone space or line feed between other signs.
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
_UNEVEN = re.compile(r"\s\s|\A\s|\s\Z")


class Memory(dict):
    """Ids of chunks after a space, by the chunk without it, or of chunks that begin with a line feed, by themselves; what is missing is encoded."""

    def __init__(self, encode: Callable[[str], bytes]):
        self.encode = encode
        self.core: dict[str, bytes] | None = None

    def __missing__(self, key: str) -> bytes:
        ids = self.encode(key if key[:1] == "\n" else " " + key)
        if len(key) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
                self.update(self.core or {})
            self[key] = ids
            if self.core is None and len(self) >= CORE:
                self.core = dict(self)
        return ids


class Encoder:
    """Token ids as little-endian 32-bit bytes; equal chunks are encoded once."""

    def __init__(self, path: str):
        self.path = path
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = None
        if path == public_tokenizers.path(TOKENIZER):
            with open(public_tokenizers.path(RANKS), "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.words = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            del self.tokenizer  # made again for a text that needs it
        self.memory = Memory(self._chunk)

    @functools.cached_property
    def tokenizer(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def _chunk(self, chunk: str) -> bytes:
        if self.words:
            return array("I", self.words.encode_ordinary(chunk)).tobytes()
        return self._whole(chunk)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text; special tokens' strings are found as the tokenizer finds them."""
        known = self.memory.__getitem__
        for text in texts:
            if any(s in text for s in self.special):
                yield self._whole(text)
            elif not text:
                yield b""
            elif _is_even(text):
                # The cuts of _CUT, faster: chunks after a space lose it, those after a line feed keep that.
                first, *rest = text.replace("\n", " \n").split(" ")
                yield self._chunk(first) + b"".join(map(known, rest))
            else:
                first, *rest = _CUT.split(text)
                yield self._chunk(first) + b"".join(known(c[1:] if c[0] == " " else c) for c in rest)


def _is_even(text: str) -> bool:
    """Whether white space in a text is single and inside."""
    if text.isascii() and not any(c in text for c in OTHER_SPACES):
        return not (text[0] in " \n" or text[-1] in " \n" or "  " in text or " \n" in text or "\n " in text or "\n\n" in text)
    return not _UNEVEN.search(text)


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _cut(path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(["" if t is None else t for t in batch.column("text").to_pylist()]), strict=True):
                ids += end
                n = len(ids) // 4
                start, piece, length = 0, 0, n % capacity or capacity
                while start < n:
                    own = ids[4 * start : 4 * (start + length)]
                    rows.append((doc, piece, start, length, zlib.crc32(own), *([own] if with_ids else [])))
                    start, piece, length = start + length, piece + 1, capacity
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.binary()] if with_ids else [])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)], names=names)

    return lean(run)


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of at most capacity tokens: doc_id, piece, start, length, ids_crc32, and ids as bytes if asked for. Only the first may be shorter.

    Null and empty texts are one piece, the end; repeated rows and null ids give pieces
    of their own; extra columns are left out; an empty table gives an empty one.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_cut(path, capacity, with_ids), ddl)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, number of such sequences) that hold counts[length] pieces of each length."""
    have = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        have[length] = n
    made: list[tuple[tuple[int, ...], int]] = []
    bits = sum(1 << int(x) for x in np.flatnonzero(have))
    # Bit capacity - x for length x, to find partners of a sum by one shift.
    mirror = sum(1 << (capacity - int(x)) for x in np.flatnonzero(have))

    def take(pattern: tuple[int, ...]) -> bool:
        nonlocal bits, mirror
        need = Counter(pattern)
        times = min(int(have[x]) // m for x, m in need.items())
        if not times:
            return False
        made.append((pattern, times))
        for x, m in need.items():
            have[x] -= m * times
            if not have[x]:
                bits &= ~(1 << x)
                mirror &= ~(1 << (capacity - x))
        return True

    def pair(total: int, most: int, before: tuple[int, ...]) -> bool:
        """Take before and two lengths of this sum, the longer of them at most `most` and as long as may be."""
        found = bits & (mirror >> (capacity - total)) & ((1 << (min(most, total - 1) + 1)) - 1)
        while found:
            a = found.bit_length() - 1
            if 2 * a < total:
                return False
            if take((*before, a, total - a)):
                return True
            found ^= 1 << a
        return False

    for length in range(capacity, 0, -1):
        gap = capacity - length
        while have[length]:
            if not gap:
                took = take((length,))
            else:
                took = bool(bits >> gap & 1) and take((length, gap))
                took = took or pair(gap, length, (length,))
                if not took:
                    first = bits & ((1 << min(gap, length + 1)) - 1)
                    while first and not took:
                        a = first.bit_length() - 1
                        if 3 * a < gap:
                            break
                        took = pair(gap - a, a, (length, a))
                        first ^= 1 << a
            if not took:
                break
    # Best fit, longest first; open sequences by gap.
    gaps: dict[int, list[list]] = {}
    open_bits = 0

    def put(pattern: tuple[int, ...], n: int) -> None:
        nonlocal open_bits
        gap = capacity - sum(pattern)
        if gap:
            gaps.setdefault(gap, []).append([pattern, n])
            open_bits |= 1 << gap
        else:
            made.append((pattern, n))

    for length in np.flatnonzero(have)[::-1].tolist():
        left = int(have[length])
        while left and (fit := open_bits >> length):
            gap = length + (fit & -fit).bit_length() - 1
            pattern, n = gaps[gap].pop()
            if not gaps[gap]:
                open_bits &= ~(1 << gap)
            times = min(n, left)
            left -= times
            if n > times:
                gaps[gap].append([pattern, n - times])
                open_bits |= 1 << gap
            put((*pattern, length), times)
        each = capacity // length
        if left >= each:
            put((length,) * each, left // each)
        if left % each:
            put((length,) * (left % each), 1)
    made += [(pattern, n) for rows in gaps.values() for pattern, n in rows]
    return made


def _places(made: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: ranks from there on stand in consecutive sequences."""
    used: Counter[int] = Counter()
    rows, sequence = [], 0
    for pattern, n in made:
        offset = 0
        for length in pattern:
            rows.append((length, used[length], sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def _assign(places: np.ndarray):
    keys = (places[:, 0] << 44) + places[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(zero_copy_only=False), batch.column("rank").to_numpy(zero_copy_only=False)
            row = places[np.searchsorted(keys, (length << 44) + rank, "right") - 1]
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(row[:, 2] + rank - row[:, 1]), pa.array(row[:, 3])], names=[*names, "sequence_id", "offset"])

    return lean(run)


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and then id 0. Null and empty texts are that end alone;
    repeated rows and null ids are packed each for itself; extra columns are left out;
    an empty table gives an empty one. Offsets in a sequence are gapless from 0.
    """
    ranked = running_before(pieces(docs, capacity, tokenizer), ["length"], [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], F.lit(1), "rank")
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank"))
    # At most `capacity` rows.
    counts = {r["length"]: r["count"] for r in ranked.groupBy("length").count().collect()}
    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(_assign(_places(plan(counts, capacity))), ddl)


def sequences(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (little-endian unsigned 32-bit), n_tokens. A group is one sequence, at most capacity tokens.

    Pieces are joined to their places by doc_id (null ones too), number and checksum, so
    that each of several equal pieces finds the same ids. Extra columns are left out; an
    empty table gives an empty one.
    """
    key = ["doc_id", "piece", "ids_crc32"]
    own = pieces(docs, capacity, tokenizer, with_ids=True).select(*key, "ids").dropDuplicates(key)
    placed = pack(docs, capacity, tokenizer)
    on = placed["doc_id"].eqNullSafe(own["doc_id"]) & (placed["piece"] == own["piece"]) & (placed["ids_crc32"] == own["ids_crc32"])
    rows = placed.join(own, on).select("sequence_id", "offset", "ids", "length")
    grouped = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("n_tokens"))
    return grouped.select("sequence_id", F.expr("aggregate(parts, cast('' as binary), (x, p) -> concat(x, p.ids))").alias("ids"), "n_tokens")
