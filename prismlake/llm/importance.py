"""Quality classifier by importance resampling.

Hashed bags of uni- and bigrams give two generative models, one of target texts and
one of all raw texts. A document's log importance weight is the log ratio of the two;
Gumbel noise on it and the k largest sums are a sample without replacement.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake.llm.memory import lean
from prismlake.llm.words import _FOLD, _IS_SPACE, _VALUE, hash_runs, mix, raw_slices, runs
from prismlake.operators.running import running_before
from prismlake.session import durable

#: Buckets that n-grams are hashed to: both models' size, whatever the input.
BUCKETS = 10_000
#: Labelled targets up to which their ids are sent to all tasks; beyond, texts are joined with them by a shuffle.
BROADCAST_IDS = 1_000_000
#: Mean count that the raw model adds to a bucket of the target's, a quarter of the target's at most.
PRIOR = 20.0
SEED = 7

# Tokens are runs of letters, digits and bytes over 127, or runs of other signs.
_CLASS = np.full(256, 2, np.uint8)
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[_IS_SPACE] = 0


def gram_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, buckets, bounds): hashed uni- and bigrams of slices of texts, in text order."""
    for i, j, data, starts in raw_slices(column):
        classes = _CLASS[data]
        at = runs(classes, starts)
        tokens = hash_runs(np.where(classes > 0, _VALUE[_FOLD[data]], np.uint64(0)), at)
        bounds = np.searchsorted(at, starts)
        pairs = mix(tokens[:-1] * np.uint64(0x9E3779B97F4A7C15) + tokens[1:]) if len(tokens) else tokens
        crosses = np.zeros(max(0, len(tokens) - 1), bool)
        crosses[[b - 1 for b in bounds[1:-1] if 0 < b < len(tokens)]] = True
        grams = np.stack([tokens, np.append(np.where(crosses, tokens[:-1], pairs), tokens[-1:])], axis=1).ravel() if len(tokens) else tokens
        yield i, j, (grams % np.uint64(BUCKETS)).astype(np.int32), bounds * 2


@lean
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of buckets in this task's raw and target texts."""
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        chosen = np.array(batch.column("is_target").to_pylist(), bool)
        for i, j, grams, bounds in gram_slices(batch.column("text")):
            raw += np.bincount(grams, minlength=BUCKETS)
            mask = np.repeat(chosen[i:j], np.diff(bounds))
            target += np.bincount(grams[mask], minlength=BUCKETS)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(raw), pa.array(target)], names=["bucket", "raw", "target"])


def fit(docs: DataFrame, labels: DataFrame, most_targets: int | None = None) -> tuple[np.ndarray, int, int]:
    """(log ratio of each bucket, labelled documents of quality 1, labelled documents).

    Raw counts cover all of docs, the target's all documents with quality 1, or with
    most_targets at most so many. BUCKETS rows are collected.
    """
    rated = labels.where("doc_id is not null and quality is not null")
    good, every = rated.agg(F.count_if(F.col("quality") == 1), F.count("*")).first()
    targets = rated.where("quality = 1").select("doc_id").distinct().withColumn("is_target", F.lit(True))
    if most_targets is not None:
        targets = targets.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_targets)
    flagged = docs.select("doc_id", "text").join(F.broadcast(targets) if good <= BROADCAST_IDS else targets, "doc_id", "left").select("text", F.coalesce("is_target", F.lit(False)).alias("is_target"))
    rows = flagged.mapInArrow(_count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in rows:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.sum():
        return np.zeros(BUCKETS), 1, 1
    p_raw = (raw + 1) / (raw + 1).sum()
    weight = min(PRIOR * BUCKETS, target.sum() / 4)
    p_target = (target + weight * p_raw) / (target.sum() + weight)
    return np.log(p_target) - np.log(p_raw), good, every


def _score(ratio: np.ndarray):
    schema = pa.schema([("log_weight", pa.float64()), ("n_grams", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, counts = np.zeros(len(batch)), np.zeros(len(batch), np.int64)
            for i, j, grams, bounds in gram_slices(batch.column("text")):
                total = np.concatenate([[0.0], np.cumsum(ratio[grams])])
                sums[i:j] = total[bounds[1:]] - total[bounds[:-1]]
                counts[i:j] = np.diff(bounds)
            kept = [batch.column(c) for c in batch.schema.names if c != "text"]
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.round(sums, 6)), pa.array(counts)], names=[*names, *schema.names])

    return lean(run)


def resample(docs: DataFrame, labels: DataFrame, most_targets: int | None = None, seed: int = SEED) -> DataFrame:
    """One row per row of docs: doc_id, n_grams, log_weight, gumbel_key, kept.

    k, the number kept, is the labelled share of quality 1 times the number of rows,
    rounded. Gumbel noise is a hash of doc_id and the text's, so reruns agree; ties
    go to the smaller doc_id. Texts without tokens, null ones included, have weight
    1. Without target labels every weight is 1 and all are kept. Repeated rows are
    sampled each for itself with equal keys; null ids hash as -1; extra columns are
    left out.
    """
    ratio, good, every = fit(docs, labels, most_targets)
    slim = docs.select("doc_id", F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1)), F.coalesce("text", F.lit(""))).alias("noise"), "text")
    scored = durable(slim.mapInArrow(_score(ratio), "doc_id long, noise long, log_weight double, n_grams long"))
    uniform = (F.shiftrightunsigned("noise", 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    keyed = scored.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform)))
    k = (2 * good * keyed.count() + every) // (2 * every)
    ranked = running_before(keyed.withColumn("one", F.lit(0)), ["one"], [F.desc("gumbel_key"), F.asc("doc_id")], F.lit(1), "rank")
    return ranked.select("doc_id", "n_grams", "log_weight", "gumbel_key", (F.col("rank") < k).alias("kept"))


def keep_sampled(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that the sample keeps, with docs' columns, whatever their names.

    Rows that share an id, null ones included, are kept if one of them is; null and
    empty texts are sampled with weight 1; an empty table gives an empty one.
    """
    kept = resample(docs, labels, **options).where("kept").select(F.col("doc_id").alias("sampled")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["sampled"]), "left_semi")
