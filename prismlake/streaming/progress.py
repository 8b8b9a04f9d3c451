"""Rolling windows over progress, segments of equal neighbours, and incremental streams."""

from __future__ import annotations

import math
import os
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from prismlake.functions.paths import cache_key, folder_path
from prismlake.operators.caching import fold, load_values, save_values
from prismlake.operators.running import offsets, ranges
from prismlake.session import durable
from prismlake.sources import media


def rolling_progress(rows: DataFrame, key: str, at: str, span: int) -> DataFrame:
    """rows with n (rows of the key in the last span, this one and its equals included) and since (the first of them).

    Each row sets a mark at the beginning of its span. Rows and marks are sorted in
    ranges, so that a key of any size spreads; sums within ranges, and of those before,
    count the rows up to each row and before each mark, and the row after a mark is
    found by its number. Rows without key or time have null n and since.
    """
    held = durable(rows.withColumn("_row", F.monotonically_increasing_id()))
    known = held.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    own = known.select(F.col(key).alias("_key"), F.col(at).alias("_at"), "_row", F.lit(1).alias("_n"))
    marks = known.select(F.col(key).alias("_key"), (F.col(at) - span).alias("_at"), "_row", F.lit(0).alias("_n"))
    ordered = ranges(own.unionByName(marks), ["_key"], ["_at"])
    before = offsets(ordered.groupBy("_part", "_key").agg(F.sum("_n").alias("_total")), ["_key"], "_total")
    # Marks come before rows of their time, rows of one time count together.
    local = F.sum("_n").over(Window.partitionBy("_part", "_key").orderBy("_at", "_n"))
    summed = ordered.withColumn("_sum", local).join(before, ["_part", "_key"]).withColumn("_sum", F.col("_sum") + F.col("_before"))
    summed = durable(summed.select("_key", "_at", "_row", "_n", "_sum"))
    # Of rows of one time all have the last one's number, so a mark's next row is the first number above its own.
    counts = summed.groupBy("_key", "_row").agg(F.max(F.when(F.col("_n") == 1, F.col("_sum"))).alias("_upto"), F.max(F.when(F.col("_n") == 0, F.col("_sum"))).alias("_past"))
    times = summed.where("_n = 1").groupBy("_key", "_at", "_sum").agg(F.count("*").alias("_same")).select("_key", (F.col("_sum") - F.col("_same")).alias("_past"), F.col("_at").alias("since"))
    found = counts.join(times, ["_key", "_past"]).select("_row", (F.col("_upto") - F.col("_past")).alias("n"), "since")
    return held.join(found, "_row", "left").select(*rows.columns, "n", "since")


def eta_seconds(scanned_first: Column, scanned_last: Column, seconds: Column, total: Column) -> Column:
    """Remaining seconds at a window's rate, rounded; null for windows under a second or without progress, with nothing left, and for less than 2 or more than 3600 left."""
    left = F.round((total - scanned_last) * seconds / F.nullif(scanned_last - scanned_first, F.lit(0))).cast("long")
    return F.when((seconds >= 1) & (scanned_last > scanned_first) & (total > scanned_last) & left.between(2, 3600), left)


def segments(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """rows with segment: the number, within keys and by order, of the run of equal values that a row is in.

    Rows are sorted in ranges, so that one key may hold all of them. Each range begins
    with what the one before it ended with, and its runs are numbered after all those of
    the ranges before. A null value is a run of its own for each row, as it equals
    nothing; null keys are one key. Rows equal in order count in any order.
    """
    names = {k: f"_key{i}" for i, k in enumerate(keys)}
    held = rows.select("*", *[F.coalesce(F.col(k).cast("string"), F.lit("\0")).alias(n) for k, n in names.items()])
    own = list(names.values())
    ordered = ranges(held, own, [order])
    window = Window.partitionBy("_part", *own).orderBy(order)
    marked = ordered.withColumn("_nth", F.row_number().over(window)).withColumn("_new", (F.col("_nth") > 1) & ~F.coalesce(F.col(value) == F.lag(value).over(window), F.lit(False)))
    ends = marked.groupBy("_part", *own).agg(F.min_by(F.struct(value), "_nth").alias("_first"), F.max_by(F.struct(value), "_nth").alias("_last"), F.sum(F.col("_new").cast("long")).alias("_runs"))
    # A row for each range and key.
    last = F.lag("_last").over(Window.partitionBy(*own).orderBy("_part"))
    goes_on = F.coalesce(last[value] == F.col("_first")[value], F.lit(False))
    carried = ends.withColumn("_begins", (~goes_on).cast("long")).withColumn("_runs", F.col("_runs") + F.col("_begins"))
    before = offsets(carried.select("_part", *own, "_begins", "_runs"), own, "_runs")
    local = F.sum(F.col("_new").cast("long")).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marked.withColumn("segment", local).join(before, ["_part", *own]).select(*rows.columns, (F.col("segment") + F.col("_before") + F.col("_begins")).alias("segment"))


class RollingEta(StatefulProcessor):
    """Per key a ring of the samples of the last span: each batch gives the remaining time at their rate; a timer forgets keys that have been silent."""

    def __init__(self, span: float, silence_ms: int):
        self.span, self.silence_ms = span, silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.samples = handle.getListState("samples", "at double, scanned long")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        ring = sorted({(float(a), int(s)) for a, s in self.samples.get()} | set(zip(new["at"].astype(float), new["scanned"].astype(int), strict=True)))
        last, total = ring[-1][0], int(new["total"].max())
        ring = [(a, s) for a, s in ring if a >= last - self.span]
        self.samples.put(ring)
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        at = int(timerValues.getCurrentProcessingTimeInMs()) + self.silence_ms
        self.timer.update((at,))
        self.handle.registerTimer(at)
        yield pd.DataFrame({"key": [key[0]], "at": [last], "samples": [len(ring)], "eta": pd.array([remaining_seconds(ring, total)], dtype="Int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.samples.clear()
        self.timer.clear()
        return iter(())

    def close(self) -> None:
        pass


def remaining_seconds(ring: list[tuple[float, int]], total: int) -> int | None:
    """eta_seconds() of samples (at, scanned) in order."""
    (began, first), (ended, last) = ring[0], ring[-1]
    seconds = ended - began
    if seconds < 1 or last <= first or total <= last:
        return None
    left = math.floor((total - last) * seconds / (last - first) + 0.5)
    return left if 2 <= left <= 3600 else None


def progress_stream(stream: DataFrame, span: float = 10, silence_ms: int = 60_000) -> DataFrame:
    """(key, at, samples, eta) of a stream (key, at in seconds, scanned, total): after each batch, the remaining seconds of each of its keys at the rate of the last span.

    Samples are kept per key as state, whatever batch they came in; late ones count as
    long as they are within the span of the newest. Runs on the RocksDB state store. Timers make Spark go on with batches
    without data; for a run that shall end with its input, switch those off.
    """
    return stream.groupBy("key").transformWithStateInPandas(RollingEta(span, silence_ms), "key string, at double, samples long, eta long", "update", "processingTime")


def windowed_counts(stream: DataFrame, at: str, key: str, width: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Counts by key and window of a stream with late rows."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count("*").alias("n"))


def maintain_cache(stream: DataFrame, cache_dir: str, checkpoint: str):
    """A query that folds each batch of asset rows into a cache of buckets (see caching.fold); a repeated batch changes nothing."""

    def fold_batch(batch: DataFrame, number: int) -> None:
        fold(batch, cache_dir, number)

    return stream.writeStream.foreachBatch(fold_batch).option("checkpointLocation", checkpoint)


def scan_by_segments(spark: SparkSession, folders: list[str], cache_dir: str, tag: str = "scan", stopped: Callable[[], bool] = lambda: False) -> bool:
    """Scan pictures below folders into a cache, a first-level folder after the other; whether all are done.

    Each segment's features are folded into the cache (caching.fold) and then noted, so
    a run that stops, by stopped() between segments or by spark.interruptTag(tag) at any
    time, leaves the whole segments that it has done. The next run passes those by and
    ends with the full result. clear() of the notes begins anew.
    """
    parts = []
    for folder in folders:
        with os.scandir(folder) as entries:
            parts += [f"{e.path}/" for e in entries if e.is_dir(follow_symlinks=False)]
        parts.append(folder)
    noted = {r["key"] for r in load_values(spark, f"{cache_dir}/done").collect()}
    for part in sorted(set(parts)):
        if part in noted:
            continue
        if stopped():
            return False
        spark.addTag(tag)
        try:
            rows = media.features(spark, [part], decode=False)
            if not part.endswith("/"):  # a root's own files
                rows = rows.where(folder_path(F.col("path")) == part.rstrip("/"))
            found = rows.withColumn("cache_key", cache_key(F.col("path")))
            fold(found, f"{cache_dir}/files", time.time_ns())
            save_values(spark.createDataFrame([(part, "true")], "key string, value string"), f"{cache_dir}/done")
        except Exception as error:  # noqa: BLE001  interrupted jobs fail in one of several ways
            if "cancel" in str(error).lower() or "interrupt" in str(error).lower():
                return False
            raise
        finally:
            spark.removeTag(tag)
    return True
