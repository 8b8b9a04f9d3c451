"""Ranked lexical search over document shards.

A shard holds some thousands of documents as postings in CSR form: for each term the
documents that hold it and how often. Once the corpus statistics are summed, each
posting has an integer impact. A query adds the impacts of its terms, one term at a
time, to a dense array with a place for each document of the shard, and takes the
shard's best; the best of shards are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismlake.llm.memory import lean
from prismlake.llm.words import Vocabulary, term_slices
from prismlake.session import durable, partitions

#: Documents of a shard, and words that are kept in mind for one, at most; a longer document is a shard of its own.
SHARD_DOCS, SHARD_WORDS = 1 << 14, 1 << 22
#: Bytes of queries that are asked at a time; more are asked in blocks.
BLOCK_BYTES = 32 << 20
#: Scores: parts in a thousand of a term's weight, saturation (1.2) and length (0.75) as whole numbers.
UNIT = 1_000_000_000
INDEX = "ids array<long>, lengths array<long>, terms array<long>, starts array<int>, docs array<int>, times array<int>"


def _list(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind) if isinstance(values, np.ndarray) else values.cast(kind))


def _postings(ids: list[pa.Array], lengths: list[np.ndarray], words: list[np.ndarray], docs: list[np.ndarray]) -> pa.RecordBatch:
    terms, term = np.unique(np.concatenate(words), return_inverse=True)
    lengths_ = np.concatenate(lengths)
    pairs, times = np.unique(term.astype(np.int64) * len(lengths_) + np.concatenate(docs), return_counts=True)
    starts = np.searchsorted(pairs, np.arange(len(terms) + 1) * len(lengths_))
    columns = [_list(pa.concat_arrays(ids), pa.int64()), _list(lengths_, pa.int64()), _list(terms.view(np.int64), pa.int64())]
    columns += [_list(x.astype(np.int32), pa.int32()) for x in (starts, pairs % max(1, len(lengths_)), times)]
    return pa.RecordBatch.from_arrays(columns, names=["ids", "lengths", "terms", "starts", "docs", "times"])


def _index(vocabulary: Vocabulary | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, ...] = ([], [], [], [])
        n_docs = n_words = 0
        for batch in batches:
            for s in term_slices(batch.column("text")):
                lengths = np.diff(s.offsets)
                doc, words = np.repeat(np.arange(len(lengths)), lengths), s.words
                if vocabulary is not None:
                    known = np.flatnonzero(vocabulary.find(words) >= 0)
                    doc, words = doc[known], words[known]
                # Where a shard ends inside a slice: after so many of its documents.
                begin = 0
                while begin < len(lengths):
                    end = min(len(lengths), begin + SHARD_DOCS - n_docs)
                    i, j = np.searchsorted(doc, [begin, end])
                    for x, part in zip(held, (batch.column("doc_id").slice(s.first + begin, end - begin), lengths[begin:end], words[i:j], doc[i:j] - begin + n_docs), strict=True):
                        x.append(part)
                    n_docs, n_words, begin = n_docs + end - begin, n_words + int(j - i), end
                    if n_docs >= SHARD_DOCS or n_words >= SHARD_WORDS:
                        yield _postings(*held)
                        held, n_docs, n_words = ([], [], [], []), 0, 0
        if n_docs:
            yield _postings(*held)

    return lean(run)


def build_index(docs: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """Shards of documents (doc_id, text) as CSR postings; with a vocabulary, only of its terms. Lengths count all terms.

    ids and lengths have a place for each document; terms are 64-bit hashes in order,
    and the documents (by place) of term i, with how often they hold it, are docs and
    times from starts[i] to starts[i + 1]. Null texts have no terms; rows are documents
    each, whatever their ids; an empty table has no shards.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_index(vocabulary), INDEX)


def _holding(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for terms, starts in zip(batch.column("terms"), batch.column("starts"), strict=True):
                own = vocabulary.find(terms.values.to_numpy().view(np.uint64))
                held[own[own >= 0]] += np.diff(starts.values.to_numpy())[own >= 0]
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(held[some])], names=["term", "n"])

    return lean(run)


def statistics(index: DataFrame, vocabulary: Vocabulary) -> tuple[int, int, np.ndarray]:
    """(documents with a term, all terms, documents that hold each term of the vocabulary). The driver gets a row for each term of the vocabulary at most."""
    total = index.select(F.expr("size(filter(lengths, x -> x > 0))").alias("n"), F.expr("aggregate(lengths, 0L, (s, x) -> s + x)").alias("l")).agg(F.sum("n"), F.sum("l")).first()
    rows = index.select("terms", "starts").mapInArrow(_holding(vocabulary), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    found = np.zeros(len(vocabulary), np.int64)
    found[rows["term"].to_numpy()] = rows["n"].to_numpy()
    return total[0] or 0, total[1] or 0, found


def term_weights(n_docs: int, holding: np.ndarray) -> np.ndarray:
    """The integer weight of terms that so many of n_docs documents hold."""
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * holding + 1))).astype(np.int64)


def impacts(times: np.ndarray, lengths: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What postings add to scores: of terms that occur so many times in documents of these lengths."""
    m = 100 - 25 + 25 * lengths * n_docs // max(1, n_terms)
    return weights * (UNIT * times // (1000 * times + 12 * m))


def _best(scores: np.ndarray, places: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Which of scores are the k highest, equal ones by order."""
    if len(scores) > k:
        least = scores[np.argpartition(scores, len(scores) - k)[-k:]].min()
        sure, tied = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
        tied = tied[np.argsort(order[places[tied]], kind="stable")[: k - len(sure)]]
        return np.concatenate([sure, tied])
    return np.arange(len(scores))


def _search(vocabulary: Vocabulary, weights: np.ndarray, n_docs: int, n_terms: int, queries: list[tuple[np.ndarray, np.ndarray]], k: int):
    schema = pa.schema([("query", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                lists = [batch.column(c)[row].values for c in ("ids", "lengths", "terms", "starts", "docs", "times")]
                ids = lists[0]
                lengths, terms, starts, docs, times = (x.to_numpy().astype(np.int64) for x in lists[1:])
                # Order of ids, null last.
                order = np.empty(len(ids), np.int64)
                order[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
                own = vocabulary.find(terms.view(np.uint64))
                at = np.full((2, len(vocabulary)), 0)
                at[:, own[own >= 0]] = np.stack([starts[:-1], starts[1:]])[:, own >= 0]
                weight = np.repeat(np.where(own >= 0, weights[own], 0), np.diff(starts))
                impact = impacts(times, lengths[docs], weight, n_docs, n_terms)
                sums = np.zeros(len(ids), np.int64)
                out: list[tuple[int, np.ndarray, np.ndarray]] = []
                for q, (asked, repeats) in enumerate(queries):
                    sums[:] = 0
                    for t, r in zip(asked, repeats, strict=True):
                        i, j = at[0, t], at[1, t]
                        sums[docs[i:j]] += impact[i:j] * r
                    some = np.flatnonzero(sums)
                    best = some[_best(sums[some], some, order, k)]
                    if len(best):
                        out.append((q, best, sums[best]))
                if out:
                    places = np.concatenate([b for _, b, _ in out])
                    asked_ = np.repeat([q for q, _, _ in out], [len(b) for _, b, _ in out])
                    yield pa.RecordBatch.from_arrays([pa.array(asked_, pa.int32()), ids.take(pa.array(places)), pa.array(np.concatenate([s for _, _, s in out]))], schema=schema)

    return lean(run), "query int, doc_id long, score long"


def _asked(table: pa.Table) -> tuple[Vocabulary, list[tuple[np.ndarray, np.ndarray]]]:
    words, offsets = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for s in term_slices(table["text"]):
        words.append(s.words)
        offsets.append(s.offsets[1:] + offsets[-1][-1])
    words_, offsets_ = np.concatenate(words), np.concatenate(offsets)
    vocabulary = Vocabulary(words_)
    numbers = vocabulary.find(words_)
    return vocabulary, [np.unique(numbers[i:j], return_counts=True) for i, j in zip(offsets_[:-1], offsets_[1:], strict=True)]


def search(docs: DataFrame, queries: DataFrame, k: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The k documents (doc_id, text) of highest score above 0 for each query (item_id, text): item_id, rank, doc_id, score.

    Equal scores are ranked by ascending doc_id, null last. Each row of queries asks for
    itself, each row of docs answers for itself, repeated ones included; null and empty
    texts neither ask nor answer; other columns are left out; empty tables give none.
    Queries are asked in blocks of about block_bytes, which is what the driver and each
    task hold of them; the postings of a block are those of its terms.
    """
    spark = docs.sparkSession
    slim = queries.select("item_id", "text")
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    kind = queries.schema["item_id"].dataType.simpleString()
    found = None
    for b in range(max(1, blocks)):
        block = slim.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else slim
        table = block.toArrow()
        vocabulary, asked = _asked(table)
        index = durable(build_index(docs, vocabulary))
        n_docs, n_terms, holding = statistics(index, vocabulary)
        run, ddl = _search(vocabulary, term_weights(n_docs, holding), n_docs, n_terms, asked, k)
        # Shards are few and heavy, so they are dealt anew.
        met = index.withColumn("shard", F.monotonically_increasing_id()).repartition(partitions(spark), F.hash("shard")).drop("shard").mapInArrow(run, ddl)
        place = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = met.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(q, i) for q, i in enumerate(table["item_id"].to_pylist())], f"query int, item_id {kind}")
        part = best.join(names, "query").select("item_id", "rank", "doc_id", "score")
        found = part if found is None else found.unionByName(part)
    return found
