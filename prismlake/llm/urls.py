"""URL filters: a blocked Bloom filter before an exact hash join.

Listed entries are canonical: a host without upper-case letters, then a path. An entry
fits a url if its host is the url's or a parent domain and its path begins the url's.
All host suffixes and path beginnings of a url that the list could hold are probed in
the filter (one block of eight words each); hits go to an exact join with the list,
which removes false positives, and the longest entry wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismlake.llm.memory import lean

#: Bits for each listed entry; over 10 keep false positives under 1 %.
BITS_PER_ENTRY = 16
#: A filter has at most so many blocks of 64 bytes (64 MB); a longer list means more false positives, which the join removes.
MOST_BLOCKS = 1 << 20
PROBES = 8
#: Lists of at most so many entries are broadcast for the exact join, longer ones are shuffled.
BROADCAST_ENTRIES = 100_000


def host_of(url: str) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; empty without one."""
    host = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _positions(entries: list[str], blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each entry, and the bits in its eight words (n, 8)."""
    h = np.array([xxhash.xxh3_64_intdigest(e) for e in entries], np.uint64)
    block = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    salts = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint64)
    bits = ((h & np.uint64(0xFFFFFFFF))[:, None] * salts & np.uint64(0xFFFFFFFF)) >> np.uint64(26)
    return block.astype(np.int64), np.uint64(1) << bits


def build_filter(listed: DataFrame, column: str = "entry") -> np.ndarray:
    """The filter (blocks, 8) of 64-bit words: bits are set by tasks and merged by word before they are collected."""
    n = listed.count()
    blocks = int(min(MOST_BLOCKS, max(1, n * BITS_PER_ENTRY // 512 + 1)))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            block, bits = _positions(part[column].tolist(), blocks)
            yield pd.DataFrame({"word": (block[:, None] * PROBES + np.arange(PROBES)).ravel(), "bits": bits.view(np.int64).ravel()})

    words = np.zeros(blocks * PROBES, np.uint64)
    merged = listed.select(column).mapInPandas(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words[merged["word"].to_numpy()] = merged["bits"].to_numpy().view(np.uint64)
    return words.reshape(blocks, PROBES)


def _probe(words: np.ndarray, lengths: list[int]):
    """(url, entry) for the filter's hits; lengths: those of the listed paths, the only beginnings worth a probe."""
    blocks = len(words)

    def candidates(host: str, path: str) -> Iterator[str]:
        starts = [path[:n] for n in lengths if n <= len(path)]
        at = 0
        while host:
            for start in starts:
                yield host[at:] + start
            if (at := host.find(".", at) + 1) == 0:
                return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls, entries = [], []
            for url, host, path in zip(*(batch.column(c).to_pylist() for c in ("url", "host", "path")), strict=True):
                for entry in candidates(host, path):
                    urls.append(url)
                    entries.append(entry)
            if entries:
                block, bits = _positions(entries, blocks)
                hit = ((words[block] & bits) == bits).all(axis=1)
                urls, entries = ([x for x, keep in zip(xs, hit, strict=True) if keep] for xs in (urls, entries))
            yield pa.RecordBatch.from_arrays([pa.array(urls, pa.string()), pa.array(entries, pa.string())], names=["url", "entry"])

    return lean(run)


def judge_urls(pages: DataFrame, listed: DataFrame, default: str = "allow") -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict.

    listed: entry (host and path, as `example.net/en/`; a path begins with /), verdict.
    rule is the longest entry that fits, verdict its own; without one rule is null and
    verdict is the default. Entries listed twice take the smaller verdict; null and
    empty entries are no entries, an empty list gives the default to all. Null urls and
    those without :// have an empty host and path, which no entry fits. A url is judged
    once however often it is on the pages; repeated and null-id rows are kept as they
    are, extra columns are left out.
    """
    rules = listed.where("entry is not null and entry <> ''").groupBy("entry").agg(F.min("verdict").alias("verdict"))
    shapes = rules.select(F.length(F.regexp_extract("entry", r"(?s)\A[^/]*(.*)", 1)).alias("n")).distinct().collect()
    lengths = sorted(r["n"] for r in shapes)
    urls = pages.where("url is not null").select("url").distinct().withColumn("host", host_of("url")).withColumn("path", path_of("url")).where("host <> ''")
    hits = urls.mapInArrow(_probe(build_filter(rules), lengths), "url string, entry string")
    few = rules.count() <= BROADCAST_ENTRIES
    exact = hits.join(F.broadcast(rules) if few else rules, "entry")
    best = exact.groupBy("url").agg(F.max_by(F.struct("entry", "verdict"), F.struct(F.length("entry"), "entry")).alias("best"))
    judged = pages.select("page_id", "url").join(best, "url", "left")
    return judged.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"), F.col("best.entry").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
