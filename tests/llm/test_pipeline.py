"""The pipeline's stages on a small corpus, each against its own operator and against brute force."""

import os
import random

import pytest

import corpus_pipeline
from prismlake import session

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `my col` string, part int, size long, row string, kept boolean"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    draw = random.Random(21)
    good = ["".join(draw.choices("etaoinshrdlu", k=draw.randrange(2, 9))) for _ in range(300)]
    rows = []
    for i in range(120):
        words = draw.choices(good, k=draw.choice((30, 80, 200)))
        if i % 6 == 0:  # junk that labels call bad
            words = [f"b{draw.randrange(60)}%%%" for _ in range(60)]
        rows.append((i, " ".join(words), "en", f"s{i % 3}", 0, "m", i, 1, "x", False))
    near = rows[7][1].split()
    near[5] = "other"
    rows += [(200, rows[7][1], "en", "s1", 0, "m", 200, 1, "x", False), (201, " ".join(near), "en", "s2", 0, "m", 201, 1, "x", False), rows[8], (300, None, *[None] * 8), (None, rows[9][1] + " more", "en", None, 0, None, None, None, None, None)]
    folder = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.withColumns({"n_chars": docs["n_chars"]}).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 > 0), 0) for i in range(72)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows


def test_stages_take_effect(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [r.asDict() for r in docs.collect()]
        docs = session.durable(stage(spark, docs, folder))
        after = [r.asDict() for r in docs.collect()]
        assert docs.columns == list(before[0]), name
        ids = {r["doc_id"] for r in after}
        if name == "quality classifier":
            assert not any(i in ids for i in range(0, 120, 6)) and sum(i in ids for i in range(120) if i % 6) > 85
        elif name == "quality rules":
            assert all(r["text"] for r in after) and len(after) >= len(before) - 2
        elif name == "n-gram jaccard join":
            assert 200 not in ids and 201 not in ids and {r["doc_id"] for r in before} - ids <= {200, 201}
            assert len([r for r in after if r["doc_id"] == 8]) == 1
            shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
            sets = [shingles(r["text"]) for r in after if r["doc_id"] is not None]
            assert all(100 * len(a & b) < 80 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
        else:
            assert len(after) >= len(before) and {(r["doc_id"], r["part"]) for r in after} <= {(r["doc_id"], r["part"]) for r in before}


def test_run_packs_what_stages_keep_and_leaves_no_tables(spark, corpus):
    folder, _ = corpus
    before = set(session._written)
    found = corpus_pipeline.run(spark, folder).collect()
    places: dict = {}
    for r in found:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    # The last stage's own tables and its input remain, as its rows are read from them.
    assert len(set(session._written) - before) <= 3 and all(os.path.exists(p.removeprefix("file:")) for p in session._written)


def test_empty_corpus(spark, corpus, tmp_path):
    folder, _ = corpus
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
