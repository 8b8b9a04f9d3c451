"""The other operators against brute force on small tables, odd cases included."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, row int, rank int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(3)
    words = [f"w{i}" for i in range(200)] + ["The", "of", "a#b", "ünï", "x|y"]
    out = []
    for i in range(60):
        text = " ".join(draw.choices(words, k=draw.choice((0, 1, 5, 30, 120))))
        out.append((i, text, "en", f"s{i % 4}", len(text), "x", 1, 1))
    out += [(60, None, None, None, None, None, None, None), (None, "a b c", "en", None, 5, "x", 1, 1), (61, " \n\t ", "en", "s1", 4, "x", 1, 1), (62, "word " * 3000, "en", "s0", 15000, "x", 1, 1)]
    return [*out, out[3], out[3]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_mixing(docs, rows, empty):
    from prismlake.llm.mixing import mix, mixed_texts

    found = mix(docs).collect()
    assert len(found) == len(rows)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, free, rest = {}, set(names), sum(sizes.values())
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 3 * sizes[s]
            rest -= target[s]
            free.remove(s)
    target |= share
    taken = collections.Counter()
    for r in found:
        taken[r["source"]] += r["taken"]
        assert r["taken"] <= 3 * r["size"] and math.isclose(r["target"], target[r["source"]])
    assert all(taken[s] == math.floor(target[s] + 1e-9) for s in names)
    words = sum(len(WORD.findall(r["text"])) for r in mixed_texts(docs).collect())
    assert words == sum(taken.values()) and mixed_texts(docs).columns == docs.columns
    assert mix(empty).count() == 0


def test_mixed_texts_take_any_columns_and_rows(spark):
    from prismlake.llm.compression import keep_clean
    from prismlake.llm.mixing import mix, mixed_texts

    schema = "doc_id long, text string, source string, n_chars int, part string, epochs double, row_id int, `my col` string, `a-b.c` int, _size int"
    rows = [(None if i % 3 else i, " ".join(f"w{j}" for j in range(30 + i % 7)), f"s{i % 2}", 7, f"p{i}", 0.5, i, "m", i, -i) for i in range(40)]
    docs = spark.createDataFrame([*rows, *rows[:3], (50, None, "s0", 0, None, None, None, None, None, None)], schema)
    found = mixed_texts(docs).collect()
    assert sum(len(r["text"].split()) for r in found) == sum(r["taken"] for r in mix(docs).collect())
    assert mixed_texts(docs).columns == docs.columns and all(r["part"] == f"p{r['row_id']}" and r["_size"] == -r["row_id"] for r in found)
    assert mixed_texts(docs.limit(0)).count() == 0
    assert keep_clean(docs).columns == docs.columns and keep_clean(docs).count() == 43


def test_quality_classifier(spark, empty):
    from prismlake.llm.importance import keep_sampled, resample

    draw = random.Random(4)
    good, bad = [f"g{i}" for i in range(80)], [f"b{i}%%%" for i in range(80)]
    rows = [(i, " ".join(draw.choices(bad if i % 5 == 0 else good, k=100)), "en", "s", 1, "", 0, 0) for i in range(200)] + [(None, None, None, None, None, None, None, None)]
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(100)] + [(None, 1), (3, None)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, DOCS)
    found = {r["doc_id"]: r["kept"] for r in resample(docs, labels).collect()}
    assert len(found) == 201 and all(found[i] == (i % 5 > 0) for i in range(200))
    assert sorted(found.items(), key=str) == sorted(((r["doc_id"], r["kept"]) for r in resample(docs, labels).collect()), key=str)
    assert keep_sampled(docs, labels).columns == docs.columns
    clashing = docs.selectExpr("*", "1 as sampled", "2 as `my col`", "3 as kept")
    assert keep_sampled(clashing, labels).columns == clashing.columns
    assert resample(docs, labels.limit(0)).where("not kept").count() == 0 and resample(empty, labels).count() == 0


def test_importance_weights_and_sample_are_exact(spark):
    import pyarrow as pa

    from prismlake.llm import importance

    draw = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(draw.choices(words[: 100 + i], k=draw.choice((0, 3, 40))))) for i in range(150)]
    labels = [(i, int(i % 3 > 0)) for i in range(0, 150, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = importance.resample(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    # Tokens of letters and digits, and pairs of them, one after the other; the last token stands for its pair.
    grams = {i: [g for _, _, grams, _ in importance.gram_slices(pa.array([text])) for g in grams.tolist()] for i, text in rows}
    assert all(len(grams[i]) == 2 * len(text.split()) for i, text in rows)
    raw, target = collections.Counter(g for x in grams.values() for g in x), collections.Counter(g for i, q in labels if q for g in grams[i])
    n_raw, n_target = sum(raw.values()) + importance.BUCKETS, sum(target.values())
    prior = min(importance.PRIOR * importance.BUCKETS, n_target / 4)
    p = lambda g: (raw[g] + 1) / n_raw
    weight = {i: sum(math.log((target[g] + prior * p(g)) / (n_target + prior) / p(g)) for g in x) for i, x in grams.items()}
    assert all(math.isclose(r["log_weight"], weight[r["doc_id"]], abs_tol=1e-5) and r["n_grams"] == len(grams[r["doc_id"]]) for r in found)
    k = round(sum(q for _, q in labels) / len(labels) * len(rows))
    best = sorted(found, key=lambda r: (-r["gumbel_key"], r["doc_id"]))[:k]
    assert {r["doc_id"] for r in found if r["kept"]} == {r["doc_id"] for r in best}
    # The noise is Gumbel's: mean 0.577, variance pi ** 2 / 6.
    noise = np.array([r["gumbel_key"] - r["log_weight"] for r in importance.resample(spark.range(4000).selectExpr("id as doc_id", "'' as text"), spark.createDataFrame([], "doc_id long, quality int")).collect()])
    assert abs(noise.mean() - 0.5772) < 0.07 and abs(noise.var() - math.pi**2 / 6) < 0.2


def test_lm_scoring(docs, rows, empty):
    from prismlake.llm.suffix_tree import is_training, suffix_tree_scores

    counts = collections.Counter()
    tokens = [((r[1] or "").encode().lower().split() + [None]) for r in rows]
    for r, t in zip(rows, tokens, strict=True):
        if is_training(r[0], 10):
            counts.update(t)
    n, v = sum(counts.values()), len(counts)
    expected = sorted((r[0] or -1, len(t), sum(counts[w] > 0 for w in t), round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 4)) for r, t in zip(rows, tokens, strict=True))
    found = suffix_tree_scores(docs).collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in found) == expected
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in found)
    assert all(r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 10 == 0) for r in found)
    assert suffix_tree_scores(empty).count() == 0


def test_suffix_tree_distributions_sum_to_one(docs):
    from prismlake.llm.suffix_tree import learn

    _, tree, _ = learn(docs)
    assert np.allclose((10 ** tree.log10.astype(float)).sum(axis=1), 1, atol=1e-4)


def test_suffix_tree_grows_with_the_corpus(spark):
    from prismlake.llm.suffix_tree import learn, suffix_tree_scores

    draw = random.Random(9)
    common = [f"c{i}" for i in range(1500)]

    def corpus(n):
        # Each ten documents have a phrase of their own, whose words are all rarer than the 1,500 common ones.
        return [(i, " ".join(draw.choices(common, k=40) + [f"p{i // 10}x{j}" for j in range(4)] + draw.choices(common, k=40))) for i in range(n)]

    states = [sum(x.states.count() for x in learn(spark.createDataFrame(corpus(n), "doc_id long, text string"))[1].levels) for n in (300, 3000)]
    assert states[1] > 5 * states[0] >= 5 * 80
    # The word after "a b" is another than after "c b", and depends on the word before "a b".
    rows = [(i, " ".join(f"{x} a b {x}{x} c b z" for x in draw.choices("klmnopqr", k=12))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    learned = learn(docs)
    tree = learned[1]
    assert len(tree.levels) >= 3 and np.allclose((10**tree.log10).sum(axis=1), 1)
    assert all(r["score"] > r["base_score"] for r in suffix_tree_scores(docs, learned=learned).collect())


def test_suffix_tree_scores_equal_brute_force(spark):
    from prismlake.llm import suffix_tree

    draw = random.Random(10)
    rows = [(i, " ".join([f"{x} a b {x}{x} c b z" for x in draw.choices("klmn", k=8)] + draw.choices("uvwxyzab", k=5))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lines = {i: ["^", *text.split(), "$"] for i, text in rows}
    ends = lambda line, n: [(tuple(line[i - n : i]), line[i]) for i in range(n, len(line))]
    train = [x for i, x in lines.items() if suffix_tree.is_training(i, 10)]
    words = collections.Counter(w for x in train for w in x[1:])
    base = sum(words.values()) + 0.1 * (len(words) + 1)
    states, n = {(): None}, 0

    def p(context, w):
        if not context:
            return (words[w] + 0.1) / base
        if context not in states:
            return p(context[1:], w)
        c = states[context]
        return (max(0, c[w] - 1) + len(c) * p(context[1:], w)) / c.total()

    while True:
        n += 1
        tables = collections.defaultdict(collections.Counter)
        for line in train:
            for context, w in ends(line, n):
                if context[1:] in states:
                    tables[context][w] += 1
        gain = lambda t, c: sum(m * math.log((m - 1 + len(c) * p(t[1:], w)) / (c.total() - 1 + len(c)) / p(t[1:], w)) for w, m in c.items())
        kept = {t: c for t, c in tables.items() if c.total() > 1 and gain(t, c) >= suffix_tree.LEAST_NATS}
        if not kept:
            break
        states |= kept

    def score(line):
        total = 0.0
        for i in range(1, len(line)):
            context = ()
            while len(context) < i and (line[i - len(context) - 1], *context) in states:
                context = (line[i - len(context) - 1], *context)
            total += math.log10(p(context, line[i]))
        return total

    assert n > 3
    learned = suffix_tree.learn(docs)
    for most in (suffix_tree.COMMON_VALUES, 40, 0):
        suffix_tree.COMMON_VALUES, before = most, suffix_tree.COMMON_VALUES
        try:
            found = {r["doc_id"]: r["score"] for r in suffix_tree.suffix_tree_scores(docs, learned=learned).collect()}
        finally:
            suffix_tree.COMMON_VALUES = before
        assert all(math.isclose(found[i], score(x), abs_tol=1e-6) for i, x in lines.items())


def test_url_filter(spark):
    from prismlake.llm.queries import URL_RULES
    from prismlake.llm.urls import judge_urls

    urls = ["http://A.Example.net/en/x", "https://example.net/de/#f", "http://x.org/fr/?q", "http://example.com/de", "http://example.com/de/", "ftp://net", "net/", None, "", "http://my.net?x=/", "http://planet/", "http://my.net/", "http://my.net/"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, entry string")
    listed = spark.createDataFrame([*URL_RULES, (None, "block"), ("", "block")], "entry string, verdict string")
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(pages, listed).collect()}
    assert found[0] == ("a.example.net", "/en/x", "example.net/en/", "allow") and found[1] == ("example.net", "/de/", "net/", "block")
    assert found[2] == ("x.org", "/fr/", "org/fr/", "allow") and found[3] == ("example.com", "/de", None, "allow") and found[4][3] == "block"
    assert found[5] == ("net", "", None, "allow") and found[6][:2] == ("", "") and found[7] == found[8] == ("", "", None, "allow")
    assert found[9] == ("my.net", "", None, "allow") and found[10][2] is None and found[11] == found[12] == ("my.net", "/", "net/", "block")
    many = spark.range(3000).selectExpr("concat('h', id, '.com/') as entry", "'block' as verdict")
    shown = judge_urls(spark.range(6000).selectExpr("id as page_id", "concat('http://www.h', id, '.com/p') as url"), many)
    assert shown.where("(verdict = 'block') <> (page_id < 3000)").count() == 0
    assert judge_urls(pages, listed.limit(0)).where("verdict <> 'allow'").count() == 0
    assert judge_urls(pages.limit(0), listed).count() == 0
    clashing = pages.unionByName(pages).selectExpr("*", "'x' as host", "1 as rule", "2 as best", "3 as verdict")
    again = judge_urls(clashing, listed).collect()
    assert len(again) == 2 * len(urls) and all(found[r["page_id"]] == (r["host"], r["path"], r["rule"], r["verdict"]) for r in again)
    long = spark.createDataFrame([(1, "http://net/" + "a" * 300_000), (2, "http://" + "a." * 2000 + "org/fr/x"), (None, "http://net/")], "page_id long, url string")
    assert sorted((r["page_id"] or 0, r["rule"]) for r in judge_urls(long, listed).collect()) == [(0, "net/"), (1, "net/"), (2, "org/fr/")]


def test_html_extraction(spark):
    from prismlake.llm import templates

    shared = "<div><p>Subscribe to <b>us</b></p></div>"
    pages = [(i, f"http://h.com/{i}", f"<body>{shared}<div><p>Text {i} &amp;lt; x<br>y\n z</p></div><script>if(a<b)</script><nav>m</nav></body>") for i in range(8)]
    pages += [(8, "http://g.com/", "<body><article><h1>T</h1><p><b>a<br><p>b<aside>no</aside></article><footer>f"), (9, None, None), (10, "http://h.com/z", "<div class='site comments'>c</div><p>only"), (11, "http://h.com/q", "<div>" * 3000 + "deep")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumnRenamed("x", "y")
    expected = {**{i: f"Text {i} &lt; x y z" for i in range(8)}, 8: "T\na\nb", 9: "", 10: "only", 11: "deep"}
    for limit in (templates.BROADCAST_TEMPLATES, 0):
        templates.BROADCAST_TEMPLATES, before = limit, templates.BROADCAST_TEMPLATES
        try:
            found = templates.extract_pages(table).collect()
        finally:
            templates.BROADCAST_TEMPLATES = before
        assert {r["page_id"]: r["text"] for r in found} == expected and all(r["n_chars"] == len(r["text"]) for r in found)


def test_html_extraction_counts_inside_and_beside_articles(spark):
    from prismlake.llm import templates

    box = "<div><p>Join our list</p></div>"
    long = "<h1>Same</h1><p>Copied text that stands on many pages as a whole</p>"
    pages = [(i, f"http://h.com/{i}", f"<body><div>Bar</div><article><p>Text {i} is longer than the box</p>{box}</article><main><p>Beside {i}</p></main></body>") for i in range(8)]
    pages += [(i, f"http://c.com/{i}", f"<body><article>{long}</article></body>") for i in range(8, 16)]
    # Near copies: all but a last word is the same.
    pages += [(i, f"http://n.com/{i}", f"<body><article>{long}<p>{i}</p></article></body>") for i in range(16, 24)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    copy = "Same\nCopied text that stands on many pages as a whole"
    expected = {i: f"Text {i} is longer than the box\nBeside {i}" for i in range(8)} | dict.fromkeys(range(8, 16), copy) | {i: f"{copy}\n{i}" for i in range(16, 24)}
    for limit in (templates.BROADCAST_TEMPLATES, 0):
        templates.BROADCAST_TEMPLATES, before = limit, templates.BROADCAST_TEMPLATES
        try:
            found = {r["page_id"]: r["text"] for r in templates.extract_pages(table).collect()}
        finally:
            templates.BROADCAST_TEMPLATES = before
        assert found == expected


def test_html_extraction_of_odd_pages(spark):
    import time

    from prismlake.llm.templates import extract_pages, main_text, read

    cases = {
        "<p title=it's>Hello</p><p>World</p>": "Hello\nWorld",
        "<article><p>A<div class='social share-price notice'>Share price rose by a tenth, and more</div><p>B</article>": "A\nShare price rose by a tenth, and more\nB",
        "<article><p>A long enough paragraph of the text</p><div class=\"x notice\">Mind this</div><div id=comment-list><p>First!</p></div><p class=share-price>Up</p></article>": "A long enough paragraph of the text\nUp",
        "<article><p title='the hidden gem'>Seen</p><p hidden>Not</p><p data-x=hidden>Too</p></article>": "Seen\nToo",
        "<article>a < b &amp;lt; c <b>d</i></b> e</article>": "a < b &lt; c d e",
        "<p>unclosed <a href='x": "unclosed",
        "": "",
        "<!-- only -->": "",
    }
    pages = [(i, f"http://h{i}.com/", page) for i, page in enumerate(cases)]
    table = spark.createDataFrame(pages + pages[:2], "page_id long, url string, html string").selectExpr("*", "'x' as host", "1 as own")
    found = extract_pages(table).collect()
    assert len(found) == len(pages) + 2 and {r["page_id"]: r["text"] for r in found} == dict(enumerate(cases.values()))
    assert extract_pages(table.limit(0)).count() == 0
    took = []
    for n in (2000, 16000):
        began = time.process_time()
        for page in ("<div>" * n + "</i>" * n, "<b>" * n + "</i>" * n + "<hr>" * n, "<p>x" * n + "<li>" * n, "<i><div>" * n + "</i>" * n):
            main_text(read(page))
        took.append(time.process_time() - began)
    assert took[1] < 30 * took[0]


def test_html_template_counts_equal_brute_force(spark):
    from prismlake.llm import templates

    draw = random.Random(13)
    boxes = [f"<div><p>Box {i}</p></div>" for i in range(12)]
    pages = [(f"h{i % 3}", "<body>" + "".join(draw.sample(boxes, 3)) + f"<article><p>Own {i}</p>{draw.choice(boxes)}</article></body>") for i in range(60)]
    found = {(r["host"], r["hash"] % 2**64) for r in templates.site_templates(spark.createDataFrame(pages, "host string, html string")).collect()}
    outside, inside, bodies = collections.Counter(), collections.defaultdict(set), collections.defaultdict(set)
    for host, page in pages:
        for digest, body in set(templates.subtrees(templates.read(page))):
            if digest == templates.BODIES:
                bodies[host].add(body)
            elif body:
                inside[host, digest].add(body)
            else:
                outside[host, digest] += 1
    every = collections.Counter(host for host, _ in pages)
    expected = {x for x, n in outside.items() if n >= 5 and n >= 0.2 * every[x[0]]} | {x for x, b in inside.items() if len(b) >= 5 and len(b) >= 0.2 * len(bodies[x[0]])}
    assert found == expected and len(found) > 10


def test_quality_rules(docs, rows, empty):
    from prismlake.llm.compression import compression_rules, keep_clean

    def brute(text):
        w = WORD.findall(text or "")
        grams = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        inside = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)

    found = compression_rules(docs).collect()
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted((key((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])) for r in found)) == sorted(key((r[0], *brute(r[1]))) for r in rows)
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in found)
    kept = keep_clean(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in found) and keep_clean(empty).count() == 0


def test_quality_rules_find_encoded_and_looped_parts(spark):
    import base64

    from prismlake.llm.compression import compression_rules

    draw = random.Random(8)
    letters = "etaoinshrdlucmfwypvbgk"
    words = ["".join(draw.choices(letters, weights=range(len(letters), 0, -1), k=draw.randrange(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(draw.choices(words, k=n))[:n].ljust(n, "x")
    split = lambda x, n: " ".join(x[i : i + 8] for i in range(0, len(x), 8))[:n]
    coded = lambda n: split(base64.b64encode(draw.randbytes(n)).decode(), n)
    hexed = lambda n: split(draw.randbytes(n).hex(), n)
    clean = [prose(n) for n in (300, 700, 1500, 3000, 6000, 20000)]
    loop = "over and over again we say this "
    bad = [coded(n) for n in (300, 700, 1500, 3000, 6000, 20000)] + [hexed(n) for n in (3000, 6000, 20000)]
    # Parts of long texts: one chunk of five, and the rest after the last full chunk.
    bad += [prose(8192) + x + prose(8192) for x in (coded(4096), hexed(4096), loop * 128)] + [prose(16384) + x for x in (coded(3000), hexed(3000), loop * 60)]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(clean + bad)], "doc_id long, text string")
    found = {r["doc_id"]: r["kept"] for r in compression_rules(docs).collect()}
    assert [found[i] for i in range(len(found))] == [True] * len(clean) + [False] * len(bad)


def test_search(spark):
    from prismlake.llm import hamming

    draw = np.random.default_rng(1)
    vectors = draw.standard_normal((400, 64))
    vectors[100:180] = vectors[5]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(500, None), (None, [1.0]), (3, vectors[3].tolist())], "vec_id long, embedding array<double>")
    codes = hamming.sign_codes(table)
    own = {r["id"]: r["code"] for r in codes.collect() if r["id"] is not None and r["code"] is not None}
    for size in (hamming.CHUNK_CODES, 1):
        hamming.CHUNK_CODES, before = size, hamming.CHUNK_CODES
        found = collections.defaultdict(list)
        for r in hamming.hamming_top_k(codes, codes.where("id % 50 = 0"), 7).collect():
            found[r["query_id"]].append((r["rank"], r["distance"], r["neighbor_id"]))
        hamming.CHUNK_CODES = before
        for q in range(0, 400, 50):
            near = sorted((bin((own[q] ^ c) & (2**64 - 1)).count("1"), i) for i, c in own.items() if i != q)[:7]
            assert [x[1:] for x in sorted(found[q])] == near
    assert hamming.hamming_top_k(codes.limit(0), codes, 7).count() == 0
    # Fewer codes than are asked for, and clashing names.
    few = codes.where("id < 3 or id = 101").selectExpr("*", "'x' as query", "1 as s", "2 as rank")
    assert sorted(r["rank"] for r in hamming.hamming_top_k(few, few.where("id = 0"), 7).collect()) == [1, 2, 3]


def test_toxicity(spark, empty):
    from prismlake.llm.crf import toxicity

    draw = random.Random(5)
    clean = [f"c{i}" for i in range(300)]
    rows = []
    for i in range(400):
        words = draw.choices(clean, k=60)
        if i % 4 == 0:
            words[draw.randrange(60)] = draw.choice(["Scoundrel,", "scoundrels!"])
        rows.append((i, " ".join(words), "en", "s", 1, "", 0, 0))
    docs = spark.createDataFrame([*rows, (None, None, None, None, None, None, None, None)], DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (2, None)], "doc_id long, toxic int")
    found = {r["doc_id"]: r for r in toxicity(docs, labels).collect()}
    assert all(found[i]["predicted"] == (i % 4 == 0) for i in range(400)) and 0 <= found[None]["score"] < 0.5
    for i in range(0, 400, 4):
        assert [rows[i][1][s["start"] : s["end"]].lower()[:9] for s in found[i]["spans"]] == ["scoundrel"]
    assert toxicity(docs, labels.limit(0)).where("predicted = 1").count() == 0 and toxicity(empty, labels).count() == 0
    # A word far into a long text, repeated rows, ids and names that clash.
    odd = [(1000, " ".join(draw.choices(clean, k=40_000)) + " scoundrels!"), (1000, " ".join(draw.choices(clean, k=40_000))), (0, rows[0][1]), (0, rows[0][1]), (1001, ""), (1002, " ,;")]
    table = spark.createDataFrame(odd, "doc_id long, text string").selectExpr("*", "1 as toxic", "2.0 as score", "3 as spans")
    told = toxicity(docs.select("doc_id", "text").unionByName(table.select("doc_id", "text")).selectExpr("*", "1 as toxic", "2.0 as score", "3 as features"), labels).where("doc_id >= 1000 or doc_id = 0").collect()
    marked = sorted((r["doc_id"], r["predicted"]) for r in told)
    assert marked == [(0, 1), (0, 1), (0, 1), (1000, 0), (1000, 1), (1001, 0), (1002, 0)]


def test_crf_marginals_equal_enumeration():
    from itertools import product

    from prismlake.llm.crf import Texts, marginals, slope

    draw = np.random.default_rng(4)
    odds, steps = draw.normal(0, 2, 11), (-0.7, 0.3, 0.9)
    # Texts of 3, 0, 1 and 7 tokens.
    bounds = np.array([0, 3, 3, 4, 11])
    gain = {(0, 0): 0.0, (0, 1): steps[0], (1, 0): steps[1], (1, 1): steps[2]}
    expected, moved = np.zeros(11), np.zeros(3)
    for a, b in zip(bounds, bounds[1:], strict=False):
        total, own, went = 0.0, np.zeros(b - a), np.zeros(3)
        for y in product((0, 1), repeat=int(b - a)):
            line = (0, *y, 0)
            pairs = list(zip(line, line[1:], strict=False))
            w = math.exp(sum(o for o, t in zip(odds[a:b], y, strict=True) if t) + sum(gain[x] for x in pairs))
            total, own = total + w, own + w * np.array(y)
            went += w * np.array([pairs.count((0, 1)), pairs.count((1, 0)), pairs.count((1, 1))])
        expected[a:b], moved = own / total, moved + went / total
    p, found = marginals(odds, bounds, steps)
    assert np.allclose(p, expected) and np.allclose(found, moved)
    # The gradient against differences of the log likelihood, with one mark and a toxic text.
    features = draw.integers(0, 1 << 18, (11, 4)).astype(np.int32)
    marks = np.zeros(1 << 18, bool)
    marks[features[[1, 5, 6, 9], 0]] = True
    texts = Texts(features, bounds, np.array([1, 0, 0, 1]))
    truth = marks[features].any(axis=1) & np.repeat([True, False, False, True], np.diff(bounds))

    def likelihood(theta):
        own, at = theta[:-4][features].sum(axis=1) + theta[-4], tuple(theta[-3:])
        step = {(0, 0): 0.0, (0, 1): at[0], (1, 0): at[1], (1, 1): at[2]}
        value = lambda y, a, b: sum(o for o, t in zip(own[a:b], y, strict=True) if t) + sum(step[x] for x in zip((0, *y), (*y, 0), strict=True))
        return sum(value(tuple(truth[a:b].astype(int)), a, b) - math.log(sum(math.exp(value(y, a, b)) for y in product((0, 1), repeat=int(b - a)))) for a, b in zip(bounds, bounds[1:], strict=False))

    theta = np.zeros((1 << 18) + 4)
    theta[-4:] = (-1.0, -0.7, 0.3, 0.9)
    way = slope(texts, marks, theta)
    for i in (features[1, 0], features[7, 2], -4, -3, -2, -1):
        other = theta.copy()
        other[i] += 1e-5
        assert math.isclose((likelihood(other) - likelihood(theta)) / 1e-5, way[i], abs_tol=1e-3)


def test_packing(docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    from prismlake.llm.packing import Encoder, pack, plan, sequences

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = collections.defaultdict(list)
    for r in rows:
        ids[r[0]].append(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0])
    found = pack(docs).collect()
    assert sum(r["length"] for r in found) == sum(len(x) for xs in ids.values() for x in xs)
    places = collections.defaultdict(list)
    for r in found:
        own = ids[r["doc_id"]][0][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes()) and (r["piece"] == 0 or r["length"] == 2048)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert sequences(docs).count() == len(places) and pack(empty).count() == 0
    encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ["", " a", "a  b", "a\n\nb", "\n", "a \n b ", "é à\tb", "<|endoftext|> x", "a\r\nb c", "  ", "it's 12 3,4!!", "x y  z", "日本 語\x1c q"]:
        assert list(encoder.encode([text]))[0] == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text
    import prismlake.llm.packing as packing

    alphabet = ["a", "Wörd", "x1", "\n", "\n", " ", " ", " ", "\t", "é", "'s", "日本", "\x1c", "!!", "\u2003", "0"]
    draw = random.Random(14)
    odd = ["".join(draw.choices(alphabet, k=draw.randrange(1, 40))) for _ in range(400)]
    packing.REMEMBERED, packing.CORE, packing.LONGEST_REMEMBERED, before = 30, 10, 5, (packing.REMEMBERED, packing.CORE, packing.LONGEST_REMEMBERED)
    try:
        small = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
        for text, own in zip(odd, small.encode(odd), strict=True):
            assert own == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text
        assert len(small.memory) <= 30 and len(small.memory.core) == 10
    finally:
        packing.REMEMBERED, packing.CORE, packing.LONGEST_REMEMBERED = before
    # Whole ids are read back from the packed sequences, and no packing can use fewer than all ids need.
    told = {r["sequence_id"]: r["ids"] for r in sequences(docs).collect()}
    assert all(zlib.crc32(told[r["sequence_id"]][4 * r["offset"] : 4 * (r["offset"] + r["length"])]) == r["ids_crc32"] for r in found)
    every = [x for xs in ids.values() for x in xs]
    assert sum(map(len, told.values())) == 4 * sum(map(len, every))
    assert len(told) <= -(-sum(map(len, every)) // 2048) + 1
    draw = random.Random(6)
    for capacity in (8, 50, 300):
        counts = collections.Counter(draw.randrange(1, capacity + 1) for _ in range(500))
        made = collections.Counter()
        for pattern, n in plan(counts, capacity):
            assert sum(pattern) <= capacity
            for x in pattern:
                made[x] += n
        assert made == counts


def test_suffix_tree_sends_a_row_for_each_partition_at_most(spark):
    import pyarrow as pa

    from prismlake.llm import suffix_tree
    from prismlake.session import partitions

    tasks, n = 3, partitions(spark)
    texts = spark.createDataFrame([(i, " ".join(f"w{i * 31 + k} x{k}" for k in range(40))) for i in range(300)], "doc_id long, text string").repartition(tasks)
    none = np.zeros(64, np.uint64)
    sent = texts.mapInArrow(suffix_tree._send_contexts(none, range(1, 2), 10, none, 0, 1, suffix_tree._buckets(texts, 24_000)), suffix_tree.BLOBS).collect()
    assert 0 < len(sent) <= tasks * n
    # What is sent is whole: each training token once.
    blobs = [pa.scalar(bytes(r["data"]), pa.binary()) for r in sent]
    context, prior, c = suffix_tree._unpack_counts(blobs)
    assert len(context) == len(prior) == len(c) and int(c.sum()) == 81 * sum(suffix_tree.is_training(i, 10) for i in range(300)) and c.max() > 1


def test_quick_slices_tell_the_same_words_apart():
    import pyarrow as pa

    from prismlake.llm.words import quick_slices, word_slices

    draw = random.Random(11)
    long = ["x" * n + y for n in (7, 8, 9, 15, 16, 17, 63, 64, 65, 200) for y in ("", "a", "B", "\x00")]
    texts = ["a B\x0bc", "", "d", " ", " e ", "f\x00", "f", "f\x00\x00", "É é", None, "ends", "begins", " ".join(long), *(" ".join(draw.choices(long, k=9)).upper() for _ in range(9))]
    for size in (1, 7, 1 << 20):
        old, new = list(word_slices(pa.array(texts), size=size)), list(quick_slices(pa.array(texts), size=size))
        assert all((x.first, x.last) == (y.first, y.last) and np.array_equal(x.offsets, y.offsets) for x, y in zip(old, new, strict=True))
        a, b = (np.concatenate([x.words for x in part]) for part in (old, new))
        assert len(a) == len(b) > 100 and np.array_equal(a[:, None] == a, b[:, None] == b)


def test_suffix_tree_tables_and_groups_are_exact():
    from prismlake.llm import suffix_tree

    draw = np.random.default_rng(12)
    for n in (0, 1, 2, 1000):
        keys = np.unique(draw.integers(0, 1 << 64, n, np.uint64))
        if n == 1000:
            # The ends of the range, and keys that lie close together.
            keys = np.unique(np.concatenate([keys, np.uint64(1 << 40) + np.arange(99, dtype=np.uint64), np.array([0, (1 << 64) - 1], np.uint64)]))
        known = {k: i + 1 for i, k in enumerate(keys.tolist())}
        wanted = np.concatenate([keys, keys + np.uint64(1), keys - np.uint64(1), np.array([0, 5, (1 << 64) - 1], np.uint64)])
        value, found = suffix_tree.Table(keys, np.arange(1, len(keys) + 1)).find(wanted)
        assert value.tolist() == [known.get(k, 0) for k in wanted.tolist()] and found.tolist() == [k in known for k in wanted.tolist()]
    # Keys that differ in their low bits only, mixed.
    keys = draw.permutation(np.repeat(np.array([3, 2, 1 << 60, (1 << 60) + 1, 0, (1 << 64) - 1], np.uint64), 50))
    for x in (keys, keys[:0], np.sort(keys), np.full(9, 7, np.uint64)):
        order, begin, counts = suffix_tree._unique(x)
        assert sorted(order.tolist()) == list(range(len(x)))
        assert list(zip(x[order][begin].tolist(), counts.tolist(), strict=True)) == sorted(collections.Counter(x.tolist()).items())


def test_suffix_tree_is_the_same_in_any_number_of_parts(spark):
    from prismlake.llm import suffix_tree

    # States and next words of a level are what its growth has written.
    draw = random.Random(13)
    docs = spark.createDataFrame([(i, " ".join(f"{x} a b {x}{x} c b z" for x in draw.choices("klmn", k=8))) for i in range(80)], "doc_id long, text string")
    _, tree, _ = suffix_tree.learn(docs)
    assert len(tree.levels) >= 2
    for level in tree.levels:
        states, entries = level.states.collect(), level.entries.collect()
        assert level.grown.count() == len(states) + len(entries) and len({r["context"] for r in states}) == len(states) and len({r["key"] for r in entries}) == len(entries)
        assert {r["context"] for r in entries} <= {r["context"] for r in states} and all(r["c"] > 1 for r in entries)
    suffix_tree.PARTS, before = 5, suffix_tree.PARTS
    try:
        again = suffix_tree.learn(docs)[1]
    finally:
        suffix_tree.PARTS = before
    assert [sorted(map(tuple, x.states.collect())) for x in again.levels] == [sorted(map(tuple, x.states.collect())) for x in tree.levels]
    assert [sorted((r["key"], r["c"], round(r["v"], 9)) for r in x.entries.collect()) for x in again.levels] == [sorted((r["key"], r["c"], round(r["v"], 9)) for r in x.entries.collect()) for x in tree.levels]
