"""Lexical search, decontamination and quantile summaries against brute force, odd cases included."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

DOCS = "doc_id long, text string, rank int, score string, item_id string, key string, spans int, row string, row_id int, n long"
ITEMS = "item_id long, text string, query int, doc_id int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
EXTRA = (1, "x", "y", "z", 7, "w", 3, 2)


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    words = [f"w{i}" for i in range(30)] + ["Of", "THE", "ünï", "É9"]
    phrase = "of the w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"
    texts = ["-".join(draw.choices(words, k=draw.choice((0, 1, 3, 40, 150)))) for _ in range(80)]
    texts += [None, "", " .,;\n", phrase, phrase.upper() + "!" + phrase, "a " * 3000 + phrase, "the " * 5000, "w5 w6", "w1 w2 w3", *[" ".join(f"w{i % 30}" for i in range(k, k + 60)) for k in range(5)]]
    texts += texts[3:6] * 4
    ids = [*range(len(texts) - 3), None, None, 7]
    return list(zip(ids, texts, strict=True))


@pytest.fixture(scope="module")
def items():
    long = " ".join(f"w{i}" for i in range(30))
    found = [(1, "Of the w1 w2 w3 w4 w5 w6 w7 w8 w9 w10"), (10, long), (2, "w5, w6"), (3, "the"), (4, None), (5, " - "), (6, "nowhere to be found"), (None, "w1 w2 w3"), (9, "the the the the the the the the the the the"), (11, "ünï w1")]
    return [*found, (2, "w5, w6")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def benchmark(spark, items):
    return spark.createDataFrame([(*r, 1, 2) for r in items], ITEMS)


def ranked(rows, items, k):
    sets = [(i, collections.Counter(terms(t)), len(terms(t))) for i, t in rows]
    held = [s for s in sets if s[2]]
    n, length = len(held), sum(s[2] for s in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, count, size in held:
            m = 75 + 25 * size * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * count[t] // (1000 * count[t] + 12 * m)) for t in terms(text) if count[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scored)[:k])]
    return collections.Counter(out)


@pytest.mark.parametrize(("shard", "block"), [(16384, 32 << 20), (16384, 40), (7, 32 << 20)])
def test_lexical_search(docs, benchmark, rows, items, shard, block, monkeypatch):
    from prismlake.llm import lexical

    run = lexical._index
    monkeypatch.setattr(lexical, "SHARD_DOCS", shard)
    # Workers read the module's own setting; shards that small are made on the driver.
    if shard == 7:
        batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows])})
        shards = list(run(None)(iter([batch])))
        assert len(shards) == -(-len(rows) // 7)
        index = docs.sparkSession.createDataFrame(pa.Table.from_batches(shards), lexical.INDEX)
        monkeypatch.setattr(lexical, "build_index", lambda *a: index)
    found = lexical.search(docs, benchmark, 5, block)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert collections.Counter(map(tuple, found.collect())) == ranked(rows, items, 5)


def test_search_of_empty_tables(docs, benchmark):
    from prismlake.llm.lexical import search

    assert search(docs.limit(0), benchmark).count() == 0
    assert search(docs, benchmark.limit(0)).count() == 0
    assert search(docs.where("text is null"), benchmark).count() == 0


def covered(text, items, window):
    words, hit, met = terms(text), set(), set()
    for item, phrase in items:
        own = terms(phrase)
        size = min(window, len(own))
        for i in range(len(own) - size + 1) if own else ():
            for j in range(len(words) - size + 1):
                if words[j : j + size] == own[i : i + size]:
                    hit |= set(range(j, j + size))
                    met |= {item} - {None}
    return len(words), hit, sorted(map(str, met))


@pytest.mark.parametrize("block", [32 << 20, 60])
def test_decontamination(docs, benchmark, rows, items, block):
    from prismlake.llm.fm_index import digested, leaks

    leaked = leaks(docs, benchmark, 10, block).cache()
    want, spans = [], []
    for doc, text in rows:
        n, hit, met = covered(text, items, 10)
        want.append((doc, n, len(hit), len(met), hashlib.sha256(",".join(met).encode()).hexdigest(), bool(hit)))
        spans.append((doc, tuple(sorted(hit)), tuple(met)))
    assert collections.Counter(map(tuple, digested(leaked).collect())) == collections.Counter(want)
    got = [(r["doc_id"], tuple(i for s in r["spans"] for i in range(s["begin"], s["end"])), tuple(r["items"])) for r in leaked.collect()]
    assert collections.Counter(got) == collections.Counter(spans)


def test_leaks_are_cut_out(docs, benchmark, rows, items):
    from prismlake.llm.fm_index import leaks, without_leaks

    cut = without_leaks(docs, benchmark)
    assert cut.columns == docs.columns
    found = collections.Counter((r["doc_id"], tuple(terms(r["text"]))) for r in cut.collect())
    want = collections.Counter()
    for doc, text in rows:
        _, hit, _ = covered(text, items, 10)
        want[doc, tuple(w for i, w in enumerate(terms(text)) if i not in hit)] += 1
    assert found == want
    assert all(r["text"] == t for r, t in zip(cut.where("doc_id = 81").collect(), [dict(rows)[81]], strict=True))
    assert leaks(docs.limit(0), benchmark).count() == 0 and without_leaks(docs.limit(0), benchmark).count() == 0
    assert leaks(docs, benchmark.limit(0)).where("size(spans) > 0").count() == 0


def test_fm_index_finds_all_occurrences():
    from prismlake.llm.fm_index import FMIndex, sorted_suffixes

    draw = random.Random(1)
    for size, n in ((1, 50), (2, 300), (5, 400), (40, 500), (3, 1)):
        text = np.array([draw.randrange(size + (draw.random() < 0.1)) for _ in range(n)] + [size])
        if size == 2:
            text[100:200] = text[:100] = 1
        unique = [x if x < size else size + p for p, x in enumerate(text.tolist())]
        assert sorted_suffixes(text, size).tolist() == sorted(range(len(text)), key=lambda p: unique[p:])
        index = FMIndex(text, size, 4)
        for length in (1, 2, 5, 13):
            asked = np.array([draw.choices(range(size), k=length) for _ in range(20)] + [text[i : i + length].tolist() for i in range(len(text) - length) if (text[i : i + length] < size).all()][:40])
            low, high = index.ranges(asked)
            for row, i, j in zip(asked.tolist(), low, high, strict=True):
                assert sorted(index.locate(np.arange(i, j)).tolist()) == [p for p in range(len(text) - length + 1) if text[p : p + length].tolist() == row]


def summary_error(x, digest):
    from prismlake.llm.quantiles import _answers

    n, answers = _answers(*digest, 10)
    assert n[0] == len(x)
    ranks = np.array([-(-i * len(x) // 10) for i in range(1, 10)])
    assert (np.diff(answers[0]) >= 0).all() and answers[0].min() >= x[0] and answers[0].max() <= x[-1]
    return np.maximum(0, np.maximum(np.searchsorted(x, answers[0]) + 1 - ranks, ranks - np.searchsorted(x, answers[0], "right"))).max() / len(x)


@pytest.mark.parametrize("shape", ["even", "steep", "heavy", "negative", "huge", "lone"])
def test_digests_are_small_close_and_the_same_however_rows_are_split(shape):
    from prismlake.llm.quantiles import LEAST_POINTS, MOST_POINTS, ROOM, _digests

    draw = np.random.default_rng(2)
    x = {
        "even": draw.integers(0, 10**6, 20000),
        "steep": np.exp(draw.normal(8, 3, 20000)).astype(np.int64),
        "heavy": np.where(draw.random(20000) < 0.6, 777, draw.integers(0, 5000, 20000)),
        "negative": draw.integers(-(10**5), 10**5, 20000),
        "huge": draw.integers(-(2**62), 2**62, 20000),
        "lone": np.concatenate([np.zeros(10**5, np.int64), np.arange(1024, 1624), [4096]]),
    }[shape]
    x = np.sort(x)
    value, count = np.unique(x, return_counts=True)
    leaf = np.zeros(len(value), np.int64)
    whole = _digests(leaf, leaf, value, count, MOST_POINTS)
    assert min(LEAST_POINTS, len(value)) <= len(whole[0]) <= MOST_POINTS
    assert summary_error(x, whole) <= 0.02
    cuts = np.sort(draw.choice(len(value), 9, replace=False))
    parts = [_digests(leaf[i:j], leaf[i:j], value[i:j], count[i:j], MOST_POINTS + ROOM) for i, j in zip([0, *cuts], [*cuts, len(value)], strict=True) if i < j]
    merged = _digests(*[np.concatenate(p) for p in zip(*parts, strict=True)], MOST_POINTS)
    assert all((a == b).all() for a, b in zip(whole, merged, strict=True))
    # Parts whose values interleave are merged node by node.
    mixed = [_digests(leaf[k::4], leaf[k::4], value[k::4], count[k::4], MOST_POINTS) for k in range(4)]
    merged = _digests(*[np.concatenate(p) for p in zip(*mixed, strict=True)], MOST_POINTS)
    assert len(merged[0]) <= MOST_POINTS and merged[3].sum() == len(x) and summary_error(x, merged) <= 0.05


@pytest.mark.parametrize("fan", [128, 2])
def test_quantiles(spark, fan, monkeypatch):
    from prismlake.llm import quantiles as q

    monkeypatch.setattr(q, "FAN", fan)
    draw = random.Random(4)
    rows = [("s", "hot", draw.randrange(8), draw.randrange(10**6)) for _ in range(9000)] + [("s", f"g{draw.randrange(9)}", draw.randrange(3), draw.randrange(30)) for _ in range(900)] + [("t", "hot", 0, 5)] * 40 + [("t", "few", 0, x) for x in range(19)]
    bad = [(None, "g1", 0, 1), ("s", None, 0, 1), ("s", "g1", None, 1), ("s", "g1", 0, None)]
    table = spark.createDataFrame([(*r, "e", 1) for r in rows + bad], "stream string, grp string, batch int, x long, part string, answer int").repartition(5)
    found = collections.defaultdict(dict)
    for r in q.quantiles(table).collect():
        found[r["stream"], r["grp"], r["batch"]][r["i"]] = r
    held = collections.defaultdict(list)
    for s, g, b, x in rows:
        held[s, g, b].append(x)
        held[s, g, -1].append(x)
    assert set(found) == {k for k, v in held.items() if len(v) >= 20}
    for key, own in found.items():
        x = sorted(held[key])
        assert sorted(own) == list(range(1, 10))
        for i, r in own.items():
            below, upto = (sum(v < r["answer"] for v in x), sum(v <= r["answer"] for v in x))
            target = -(-i * len(x) // 10)
            error = max(0, below + 1 - target, target - upto)
            assert (r["n"], r["target"], r["exact_x"], r["n_below"], r["n_upto"], r["rank_error"]) == (len(x), target, x[target - 1], below, upto, error)
            assert min(4, len(set(x))) <= r["points"] <= min(len(x), 400) and r["within"] and (error == 0 or r["points"] > 100)
    assert q.quantiles(table.limit(0)).count() == 0


def test_money_streams(spark):
    import zlib

    from prismlake.llm.quantiles import money_streams

    clicks = spark.createDataFrame([(1, 5, 1.005), (1, 5, 1.005), (2, None, 3.0), (3, 5, None), (4, 6, -2.5), (None, 6, 1.0), (None, 6, 1.0), (5, 7, math.nan)], "click_id long, client_id long, value double")
    lines = spark.createDataFrame([(1, 9), (1, 9), (1, None), (None, 3), (8, 3), (2, 3)], "item_id long, vendor_id long")
    items = spark.createDataFrame([(1, "B", 10.0), (2, None, 1.0), (3, "C", 1.0)], "item_id long, brand string, price double")
    batch = lambda k: zlib.crc32(str(k).encode() if k is not None else b"") % 8
    x = lambda v, b: math.floor(100 * v + 0.5) + 1000 * b
    want = [("value", "5", batch(1), x(1.005, batch(1)), 1), ("value", "6", batch(4), x(-2.5, batch(4)), 1), *[("value", "6", batch(None), x(1.0, batch(None)), 1)] * 2, ("price", "B", batch(9), x(10.0, batch(9)), 2), ("price", "B", batch(None), x(10.0, batch(None)), 1)]
    got = [(r["stream"], r["grp"], r["batch"], r["x"], r["n"]) for r in money_streams(clicks, lines, items).collect()]
    assert collections.Counter(got) == collections.Counter(want)


def test_limits_are_fitted_to_labelled_good_texts(spark):
    import zlib

    import zstandard

    from prismlake.llm.compression import BANDS, CHUNK, CHUNK_MARGIN, CHUNK_SHARE, FARTHER, LEVEL, MARGIN, TAIL, compression_rules, keep_clean

    draw = random.Random(8)
    letters = ["".join(draw.choices("etaoinshrdlu", k=draw.randrange(2, 9))) for _ in range(3000)]
    texts = [" ".join(draw.choices(letters, k=draw.choice((30, 90, 400, 1500)))) for _ in range(500)]
    junk = [" ".join(w + draw.choice(("$$$", "***", "%%%")) for w in draw.choices(letters[:300], k=1500)) for _ in range(20)] + ["%030x" % draw.getrandbits(120) + " " + " ".join("%016x" % draw.getrandbits(64) for _ in range(600)) for _ in range(20)]
    rows = list(enumerate(texts + junk)) + [(None, texts[0]), (900, None), (901, "")]
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, n_bytes int, kept string")
    labels = spark.createDataFrame([(i, int(i < 500), 3) for i in range(540)] + [(None, 1, 0)], "doc_id long, quality int, kept int")
    held_out = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    pack = zstandard.ZstdCompressor(level=LEVEL)
    ratio = lambda t: len(pack.compress(t)) / len(t)
    fit_on = [t.encode() for i, t in enumerate(texts) if not held_out(i) and len(t) >= BANDS[0][0]]
    at, ratios = np.log2([len(t) for t in fit_on]), np.array([ratio(t) for t in fit_on])
    curve = np.polyfit(at, ratios, 3)

    def held(size):
        if size < BANDS[0][0]:
            return 0, 9
        x = min(max(np.log2(size), at.min()), at.max())
        near = (ratios - np.polyval(curve, at))[np.abs(at.astype(int) - int(x)) <= 1]
        room = FARTHER * max(0, np.log2(size) - at.max())
        return np.polyval(curve, x) + np.quantile(near, TAIL) - MARGIN - room, np.polyval(curve, x) + np.quantile(near, 1 - TAIL) + MARGIN + room

    def kept(text):
        t = (text or "").encode()
        if len(t.split()) < 20:
            return False
        low, high = held(len(t))
        chunks = [t[i : i + CHUNK] for i in range(0, len(t), CHUNK)] if len(t) >= CHUNK else []
        chunks = [c for c in chunks if len(c) >= BANDS[0][0]]
        bad = sum(not held(len(c))[0] - CHUNK_MARGIN <= ratio(c) <= held(len(c))[1] + CHUNK_MARGIN for c in chunks)
        return low <= ratio(t) <= high and bad <= CHUNK_SHARE * len(chunks)

    got = [(r["doc_id"], r["kept"]) for r in compression_rules(docs, labels).where("n_repeat_words = 0").collect()]
    assert collections.Counter(got) == collections.Counter((i, kept(t)) for i, t in rows)
    assert not any(k for i, k in got if i is not None and 500 <= i < 540) and sum(not k for i, k in got if i is not None and i < 500) < 25
    assert keep_clean(docs, labels).count() == sum(k for _, k in got) and keep_clean(docs, labels).columns == docs.columns
    assert compression_rules(docs, labels.limit(0)).count() == len(rows) and compression_rules(docs.limit(0), labels).count() == 0


def test_class_names_of_furniture():
    from prismlake.llm.templates import _named

    marked = ("ad", "ad-slot-2", "Site-Footer", "comments_list", "newsletter-box", "x breadcrumb", "promo")
    kept = ("ad-hoc", "comment-on-war", "popup-culture", "post", "", "nav-by-stars", "modal-logic")
    assert all(map(_named, marked)) and not any(map(_named, kept))
