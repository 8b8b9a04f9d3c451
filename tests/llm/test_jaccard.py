"""The similarity join against brute force on texts with edits, copies and odd cases."""

import random

import pytest

from prismlake.llm.jaccard import jaccard_components, keep_one, min_overlap


def brute(rows, k, num, den):
    sets = {}
    for doc, text in rows:
        w = (text or "").encode().lower().split()
        own = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        sets.setdefault(doc, []).append(own)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[:i]:
            if any(x and y and den * len(x & y) >= num * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in docs}, sets


def edited(words, draw, edits, vocabulary):
    words = list(words)
    for _ in range(edits):
        i = draw.randrange(len(words) + 1)
        words[i : i + draw.choice((0, 1))] = [draw.choice(vocabulary)] * draw.choice((0, 1, 1))
    return words


def make(seed, families):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    shared = [draw.choice(vocabulary) for _ in range(60)]
    rows = []
    for _ in range(families):
        base = [draw.choice(vocabulary) for _ in range(draw.choice((1, 2, 4, 12, 40, 150, 400)))]
        if draw.random() < 0.3:
            base += shared
        for _ in range(draw.choice((1, 1, 2, 6))):
            rows.append((len(rows), " ".join(edited(base, draw, draw.choice((0, 0, 1, 2, 5, 12)), vocabulary)).replace("w1", "W1")))
    for _ in range(60):  # a chain: each differs a little from the last
        rows.append((len(rows), " ".join(base := edited(base if len(base) > 100 else [draw.choice(vocabulary) for _ in range(300)], draw, 3, vocabulary))))
    return [*rows, (len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, " \n\t")]


@pytest.mark.parametrize(("seed", "k", "num"), [(1, 3, 90), (2, 5, 80)])
def test_equals_brute_force(spark, seed, k, num):
    rows = make(seed, 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "doc_id")
    expected, sets = brute(rows, k, num, 100)
    found = jaccard_components(docs.selectExpr("*", "'x' as node", "1 as n"), k, num, 100).collect()
    assert len(found) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in found} == expected
    assert {r["doc_id"]: r["n_shingles"] for r in found} == {d: len(s[0]) for d, s in sets.items()}
    kept = keep_one(docs, k, num, 100)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(expected.values()))


def test_large_group_and_split_tiles(spark, monkeypatch):
    from prismlake.llm import jaccard

    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rows = make(5, 60)
    draw = random.Random(9)
    base = [f"q{i}" for i in range(120)]
    rows = [(i, t) for i, (_, t) in enumerate(rows + [(0, " ".join(edited(base, draw, draw.choice((1, 3, 8)), base))) for _ in range(120)])]
    expected, _ = brute(rows, 3, 90, 100)
    found = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == expected


def test_odd_tables(spark):
    schema = "doc_id long, text string"
    assert jaccard_components(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (3, "a B c d"), (None, None)]
    found = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in jaccard_components(spark.createDataFrame(rows, schema)).collect())
    assert found == [(0, 0), (0, 1), (1, 1), (1, 1), (3, 1)]


def test_min_overlap():
    for a in range(1, 40):
        for b in range(1, 40):
            o = min_overlap(a, b, 90, 100)
            assert 100 * o >= 90 * (a + b - o) and not 100 * (o - 1) >= 90 * (a + b - o + 1)


def test_several_texts_under_one_id_and_none(spark):
    a, b, c = "a b c d e f", "k l m n o p", "r s t u v w x"
    rows = [(1, a), (5, a), (5, b), (7, b), (7, None), (None, c), (9, c), (None, b + " z"), (None, ""), (8, None)]
    docs = spark.createDataFrame([(d, t, i, "x") for i, (d, t) in enumerate(rows)], "doc_id long, text string, `a b.c` int, key string")
    found = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(docs).collect()]
    assert sorted((x for x in found if x[0] is not None)) == [(1, 4, 1), (5, 4, 1), (5, 4, 1), (7, 0, 1), (7, 4, 1), (8, 0, 8), (9, 5, 9)]
    # Texts without an id that resemble different documents do not join these.
    assert sorted(((x[1], x[2]) for x in found if x[0] is None), key=str) == [(0, None), (5, 9), (5, None)]
    # No text goes: each group keeps that of its least id, and rows without an id stay.
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(1, a), (5, b), (7, None), (None, c), (9, c), (None, b + " z"), (None, ""), (8, None)], key=str)
    assert keep_one(docs.limit(0)).count() == 0


def test_equal_sets_only(spark):
    rows = [(3, "a b c d"), (2, "A b c D"), (4, "a b c d e"), (1, None)]
    found = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 100, 100).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {1: 1, 2: 2, 3: 2, 4: 4}
