"""Toxic spans by a linear-chain conditional random field.

Two labels (clean, toxic) a token. Features are the token's hash and those of its
first letters. Documents' labels become token labels: in toxic training documents, the
tokens whose word or beginning is found in them and hardly ever in clean ones. The
chain is trained on all tokens of the sampled documents, by gradient ascent on the
conditional likelihood whose sums Spark's tasks make; forward-backward marginals of all
tokens give spans, offsets and, through a logistic curve fitted on the training
documents, a document's score.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake.llm.importance import _CLASS
from prismlake.llm.memory import lean
from prismlake.llm.words import _FOLD, _VALUE, hash_runs, mix, raw_slices, runs
from prismlake.session import discard, durable

#: Labelled documents to learn from at most, those of the smallest hashes.
MOST_LABELLED = 12_000
FEATURE_BITS = 18
#: Tasks that make the sums of the training documents.
TASKS = 8
#: Lengths of the beginnings that are features, 0 for the whole token.
PREFIXES = (0, 4, 5, 6)
#: A word or beginning marks toxic tokens if at most this share of the documents that have it are clean ...
MOST_CLEAN = 0.05
#: ... and chance would hardly give it to so many toxic ones: nats against the share of toxic documents.
LEAST_NATS = 11.0
STEPS = 40
#: While training, tasks get weights in steps of one in so many.
SCALE = 1024
RATE = 0.5
RIDGE = 1e-4
SPAN = 0.5
PREDICT_AT = 0.7


def token_features(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens (runs of letters, digits and bytes over 127; A-Z folded): where they begin and end, texts' bounds, features by token."""
    classes = (_CLASS[data] == 1).astype(np.uint8)
    at = runs(classes, starts)
    if not len(at):
        return at, at, np.zeros(len(starts), np.int64), np.zeros((0, len(PREFIXES)), np.int32)
    values = np.where(classes > 0, _VALUE[_FOLD[data]], np.uint64(0))
    lengths = np.diff(np.append(at, len(data)))
    place = np.arange(at[0], len(data)) - np.repeat(at, lengths)
    inside = np.add.reduceat(classes[at[0] :].astype(np.int64), at - at[0])
    columns = []
    for k in PREFIXES:
        part = values if not k else np.concatenate([values[: at[0]], np.where(place < k, values[at[0] :], np.uint64(0))])
        columns.append(mix(hash_runs(part, at) + np.uint64(k)) & np.uint64((1 << FEATURE_BITS) - 1))
    return at, at + inside, np.searchsorted(at, starts), np.stack(columns, axis=1).astype(np.int32)


class Model(NamedTuple):
    """Weights of features, bias, gains of clean-toxic, toxic-clean and toxic-toxic steps over clean-clean, and the score's curve."""

    weights: np.ndarray
    bias: float
    steps: tuple[float, float, float]
    curve: tuple[float, float]


def _messages(odds: np.ndarray, fresh: np.ndarray, up: float, stay: float, down: float) -> np.ndarray:
    """What all tokens before each one say, as toxic over clean; odds are ratios too, and a token that is fresh follows a clean end.

    m' = (up + m o stay) / (1 + m o down) is a linear map of (m, 1), so blocks of tokens
    are first multiplied out side by side, then chained, then gone through once more.
    """
    n = len(odds)
    width = max(1, int(np.sqrt(n)))
    rows = -(-n // width)
    # Blocks are columns here; what pads the last one says nothing.
    last = np.append(1.0, odds[:-1])
    grid = lambda x, pad: np.concatenate([x, np.full(rows * width - n, pad)]).reshape(rows, width).T.copy()
    before, new = grid(last, 0.0), grid(fresh, True)
    # A fresh token's map gives `up` whatever comes in.
    a, c, d = np.where(new, 0.0, stay * before), np.where(new, 0.0, down * before), 1.0
    b = up
    p, q, r, s = np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)
    for t in range(width):
        p, q, r, s = a[t] * p + b * r, a[t] * q + b * s, c[t] * p + d * r, c[t] * q + d * s
        scale = 1 / (p + q + r + s)
        p, q, r, s = p * scale, q * scale, r * scale, s * scale
    entry = np.zeros(rows)
    now = up
    for k, (w, x, y, z) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist(), strict=True)):
        entry[k] = now
        now = (w * now + x) / (y * now + z)
    out = np.empty((width, rows))
    m = entry
    for t in range(width):
        m = (a[t] * m + b) / (c[t] * m + d)
        out[t] = m
    return out.T.ravel()[:n]


def marginals(odds: np.ndarray, bounds: np.ndarray, steps: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """P(toxic) of each token of texts one after the other, by log odds, and the expected (clean-toxic, toxic-clean, toxic-toxic) steps of all.

    Text i has the tokens bounds[i] to bounds[i + 1]; texts have clean ends.
    """
    n = len(odds)
    if not n:
        return np.zeros(0), np.zeros(3)
    up, down, stay = np.exp(steps)
    o = np.exp(np.clip(odds, -30, 30))
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    some = np.diff(bounds) > 0
    first[bounds[:-1][some]] = True
    last[bounds[1:][some] - 1] = True
    forward = _messages(o, first, up, stay, down)
    backward = _messages(o[::-1], last[::-1], down, stay, up)[::-1]
    total = forward * o * backward
    p = total / (1 + total)
    # Steps from each token to the next, or to its text's end, and those from a text's beginning.
    a = forward * o
    b = np.where(last, 0.0, np.append((o * backward)[1:], 0.0))
    weights = 1 + up * b + a * down + a * b * stay
    begin = up * (o * backward)[first]
    expected = np.array([(up * b / weights).sum() + (begin / (1 + begin)).sum(), (a * down / weights).sum(), (a * b * stay / weights).sum()])
    return p, expected


class Texts(NamedTuple):
    """Some texts' tokens: features (n, kinds), where texts begin and end in them, whether each text is toxic."""

    features: np.ndarray
    bounds: np.ndarray
    toxic: np.ndarray


def _truth(texts: Texts, marks: np.ndarray) -> np.ndarray:
    return marks[texts.features].any(axis=1) & np.repeat(texts.toxic.astype(bool), np.diff(texts.bounds))


def slope(texts: Texts, marks: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """The likelihood's gradient: weights of features, bias, steps."""
    truth = _truth(texts, marks).astype(float)
    odds = theta[:-4][texts.features].sum(axis=1) + theta[-4]
    p, expected = marginals(odds, texts.bounds, tuple(theta[-3:]))
    error = truth - p
    first = np.zeros(len(truth), bool)
    first[texts.bounds[:-1][np.diff(texts.bounds) > 0]] = True
    before = np.where(first, 0.0, np.append(0.0, truth[:-1]))
    after_last = truth[texts.bounds[1:][np.diff(texts.bounds) > 0] - 1].sum()
    seen = np.array([((1 - before) * truth).sum(), (before * (1 - truth)).sum() + after_last, (before * truth).sum()])
    out = np.zeros(len(theta))
    for column in range(texts.features.shape[1]):
        out[:-4] += np.bincount(texts.features[:, column], error, len(theta) - 4)
    out[-4] = error.sum()
    out[-3:] = seen - expected
    return out


def ascend(gradient, n: int) -> np.ndarray:
    """Weights from a function that gives the gradient at weights, over n texts."""
    theta, squares = np.zeros((1 << FEATURE_BITS) + 4), np.full((1 << FEATURE_BITS) + 4, 1e-8)
    theta[-4] = -4.0
    for _ in range(STEPS):
        way = gradient(theta) - RIDGE * n * theta
        squares += way**2
        theta += RATE * way / np.sqrt(squares)
    return theta


def _most(p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Log odds of the highest marginal of each text, lifted for more than one; a floor without tokens."""
    most, total = np.full(len(bounds) - 1, 1e-6), np.zeros(len(bounds) - 1)
    some = np.flatnonzero(np.diff(bounds) > 0)
    if len(some):
        most[some] = np.maximum.reduceat(p, bounds[some])
        total[some] = np.add.reduceat(np.where(p > 0.2, p, 0.0), bounds[some])
    most = np.clip(most, 1e-6, 1 - 1e-6)
    return np.log(most / (1 - most)) + np.log1p(np.maximum(total - 1, 0))


def peaks(model: Model, features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """P(toxic) of every token."""
    return marginals(model.weights[features].sum(axis=1, dtype=np.float64) + model.bias, bounds, model.steps)[0]


def _curve(x: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """The logistic curve from a text's log odds to its score."""
    curve = np.array([1.0, 0.0])
    for _ in range(50):  # Newton's method with a ridge towards the identity
        p = 1 / (1 + np.exp(-(curve[0] * x + curve[1])))
        way = np.array([((toxic - p) * x).sum(), (toxic - p).sum()]) - (curve - [1.0, 0.0])
        w = p * (1 - p)
        bend = np.array([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum() + 1]])
        curve = curve + np.clip(np.linalg.solve(bend, way), -1, 1)
    return float(max(curve[0], 0.05)), float(curve[1])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[Texts]:
    """Rows (features, toxic) as Texts, a batch at a time."""
    for batch in batches:
        own = [np.frombuffer(x.as_buffer(), np.int32).reshape(-1, len(PREFIXES)) for x in batch.column("features")]
        if own:
            yield Texts(np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])]), batch.column("toxic").to_numpy())


@lean
def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic = batch.column("toxic")
        for i, j, data, starts in raw_slices(batch.column("text")):
            _, _, bounds, features = token_features(data, starts)
            own = [features[bounds[r] : bounds[r + 1]].tobytes() for r in range(j - i)]
            yield pa.RecordBatch.from_arrays([toxic.slice(i, j - i), pa.array(own, pa.binary())], names=["toxic", "features"])


@lean
def _rates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many clean and toxic texts each feature is; those of a task in one row, and the texts."""
    counts = np.zeros((2, (1 << FEATURE_BITS) + 1), np.int64)
    for texts in _read(batches):
        for r, toxic in enumerate(texts.toxic.tolist()):
            counts[int(toxic > 0), np.unique(texts.features[texts.bounds[r] : texts.bounds[r + 1]])] += 1
            counts[int(toxic > 0), -1] += 1
    yield pa.RecordBatch.from_arrays([pa.array([counts.tobytes()], pa.binary())], names=["sums"])


def _slopes(marks: np.ndarray, theta: np.ndarray):
    # Small enough (under a megabyte) that Spark sends it with the task and leaves no broadcast files of each step.
    rounded, rest = np.round(np.clip(theta[:-4], -31, 31) * SCALE).astype(np.int16), theta[-4:]
    packed = np.packbits(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        theta, marks = np.append(rounded / SCALE, rest), np.unpackbits(packed).astype(bool)
        total = np.zeros(len(theta))
        for texts in _read(batches):
            total += slope(texts, marks, theta)
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["sums"])

    return lean(run)


def _heights(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _read(batches):
            x = _most(peaks(model, texts.features, texts.bounds), texts.bounds)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(texts.toxic.astype(np.int64))], names=["x", "toxic"])

    return lean(run)


def _add(rows: DataFrame, kind: type) -> np.ndarray:
    """The sum of the tasks' arrays, in one order, so that reruns agree."""
    arrays = [np.frombuffer(r["sums"], kind) for r in rows.collect()]
    return np.sum(arrays, axis=0, dtype=np.float64 if kind is np.float32 else None)


def fit(docs: DataFrame, labels: DataFrame, folds: tuple[int, int] = (3, 1), most: int = MOST_LABELLED) -> Model:
    """Learn from at most `most` labelled documents with crc32(doc_id as text) mod folds[0] other than folds[1].

    Whole texts are read, by tasks, and equal texts of a label count once; the driver
    gets sums of fixed size from TASKS tasks, and one number a text for the curve.
    """
    rated = labels.where("doc_id is not null and toxic is not null").where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds[0])) != folds[1])
    chosen = rated.groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").select("text", "toxic").dropDuplicates(["text", "toxic"])
    learned = durable(rows.mapInArrow(_featurize, "toxic long, features binary").repartition(TASKS, F.xxhash64("features")).sortWithinPartitions(F.xxhash64("features"), "toxic"))
    size = 1 << FEATURE_BITS
    empty = Model(np.zeros(size, np.float32), -12.0, (0.0, 0.0, 0.0), (1.0, 0.0))
    parts = learned.coalesce(TASKS)
    rates = _add(parts.mapInArrow(_rates, "sums binary"), np.int64)
    if not np.ndim(rates):
        return empty
    rates = rates.reshape(2, -1)
    (n_clean, n_toxic), rates = rates[:, -1], rates[:, :-1]
    if not n_toxic or not n_clean:
        return empty
    chance = np.log((n_toxic + n_clean) / n_toxic)
    marks = (rates[1] * chance >= LEAST_NATS) & (rates[0] <= MOST_CLEAN * (rates[0] + rates[1]))
    theta = ascend(lambda at: _add(parts.mapInArrow(_slopes(marks, at), "sums binary"), np.float32), int(n_toxic + n_clean))
    model = Model(theta[:-4].astype(np.float32), float(theta[-4]), tuple(float(x) for x in theta[-3:]), (1.0, 0.0))
    heights = parts.mapInArrow(_heights(model), "x double, toxic long").toArrow().sort_by([("x", "ascending"), ("toxic", "ascending")])
    discard(learned)
    return model._replace(curve=_curve(heights["x"].to_numpy(), heights["toxic"].to_numpy()))


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))


def _tag(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, spans = np.zeros(len(batch)), []
            for i, j, data, starts in raw_slices(batch.column("text")):
                at, end, bounds, features = token_features(data, starts)
                p = peaks(model, features, bounds)
                scores[i:j] = 1 / (1 + np.exp(-(model.curve[0] * _most(p, bounds) + model.curve[1])))
                hot = np.flatnonzero(p >= SPAN)
                of = np.searchsorted(bounds, hot, "right") - 1
                found: list[list] = [[] for _ in range(j - i)]
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)]) if len(hot) else None
                for t, r in zip(hot, of, strict=True):
                    a, b = int(chars[at[t]] - chars[starts[r]]), int(chars[end[t]] - chars[starts[r]])
                    if found[r] and t - 1 == found[r][-1]["last"]:
                        found[r][-1] |= {"end": b, "last": t, "marginal": max(found[r][-1]["marginal"], float(p[t]))}
                    else:
                        found[r].append({"start": a, "end": b, "marginal": float(p[t]), "last": t})
                spans += [[{k: s[k] for k in ("start", "end", "marginal")} for s in row] for row in found]
            others = [(c, batch.column(c)) for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[x for _, x in others], pa.array(scores), pa.array(spans, SPANS)], names=[*[n for n, _ in others], "score", "spans"])

    return lean(run)


def toxicity(docs: DataFrame, labels: DataFrame, folds: tuple[int, int] = (3, 1), most: int = MOST_LABELLED) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1), predicted (score >= 0.7), spans (start, end in code points; marginal).

    A map over rows with the fixed-size model; nothing is shuffled. Null and empty
    texts have no tokens and the lowest score. Without labelled documents of both
    kinds nothing is toxic. Null ids count as held out; repeated rows score alike;
    extra columns are left out; an empty table gives an empty one.
    """
    model = fit(docs, labels, folds, most)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds[0])) == folds[1], F.lit(True))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    scored = slim.mapInArrow(_tag(model), "doc_id long, held_out boolean, score double, spans array<struct<start: long, end: long, marginal: double>>")
    return scored.withColumn("predicted", (F.col("score") >= PREDICT_AT).cast("int"))
