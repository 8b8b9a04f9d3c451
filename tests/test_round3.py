"""Cases of the third round's findings."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from prismlake.functions import values
from prismlake.operators import caching, clusters, duplicates, pairs, views
from prismlake.plans import organize, registry


def test_percentages_are_exact_halves(spark):
    rows = spark.createDataFrame([(14500, 15), (28500, 29), (56500, 57), (57500, 58), (1, 0)], "done long, want int")
    got = rows.select("want", values.progress_percent(F.col("done"), F.lit(100000)).alias("got")).collect()
    assert all(r["got"] == r["want"] for r in got)


def test_files_of_one_path_keep_their_own_dates(spark):
    files = spark.createDataFrame([(0, "/a/IMG_20210828_132900.jpg"), (1, "/a/IMG_20210828_132900.jpg"), (2, "/a/IMG_20210828_132900.jpg")], "ord long, path string")
    tags = spark.createDataFrame([(1, "\\a\\IMG_20210828_132900.jpg", "2020:01:01 00:00:00", None, None), (2, "/a/IMG_20210828_132900.jpg", None, "2019:01:01 00:00:00", None)], "ord long, source_file string, original string, created string, file_modified string")
    got = {r["ord"]: (r["date_taken"], r["date_source"]) for r in organize.media_list(files, tags, by=("ord",)).collect()}
    assert got == {0: (None, None), 1: ("2020:01:01 00:00:00", "exif"), 2: ("2019:01:01 00:00:00", "create")}
    assert {r["date_taken"] for r in organize.media_list(files, tags).collect()} == {"2019:01:01 00:00:00"}


def test_previews_of_one_path_keep_their_own_dates(spark):
    files = spark.createDataFrame([(i, "/a/b.jpg") for i in range(3)], "ord long, path string")
    plan = spark.createDataFrame([(i, "\\a\\b.jpg", "n", "p", f"202{i}:01:01 00:00:00") for i in (0, 2)], "ord long, original_path string, new_filename string, new_path string, date_used string")
    got = {r["ord"]: r["date_used"] for r in organize.preview_of(files, plan, ("ord",)).collect()}
    assert got == {0: "2020:01:01 00:00:00", 1: None, 2: "2022:01:01 00:00:00"}
    assert {r["date_used"] for r in organize.preview_of(files, plan).collect()} == {"2020:01:01 00:00:00"}


def test_laplacian_rounds_as_sql_does(spark, tmp_path):
    # 0.285 as a float is below 0.285, but its float product with 100 is 28.5.
    near = [float(np.float32(k + 0.5) / np.float32(100)) for k in range(-300, 300)]
    draw = np.random.default_rng(3)
    rows = [(i, [float(x) for x in draw.choice(near, 64)]) for i in range(300)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = duck.execute(registry.ORACLE_SQL["m6_laplacian"]).fetchall()
    got = registry.QUERIES["m6_laplacian"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_rows_of_one_path_are_placed_by_their_ids(spark):
    draw = np.random.default_rng(5)
    rows = [(int(i), "/a/b.jpg", None, None, None, None, None) for i in draw.permutation(400)]
    assets = spark.createDataFrame(rows, "asset_id long, path string, date_taken string, modified string, location string, gps_latitude double, device string").repartition(7)
    ties = ("asset_id",)
    found = [views.order_assets(assets, by, down, ties) for by, down in (("date", True), ("location", False), ("device", True))]
    found += [organize.media_order(assets, ties), organize.organizer_order(assets, "type", ties=ties), organize.organizer_order(assets, "date", True, ties)]
    found.append(duplicates.number_assets(assets.withColumnRenamed("asset_id", "id"), ("id",)).select(F.col("id").alias("asset_id"), (F.col("asset_id") + 1).alias("place")))
    for t in found:
        assert all(r["place"] == r["asset_id"] + 1 for r in t.collect())


def test_failed_files_by_number_or_by_text(spark):
    rows = [("a", 13, None), ("b", 5, "corrupt"), ("c", None, "Corrupt JPEG data"), ("d", None, "unsupported"), ("e", None, "no such file"), ("f", None, "?"), ("g", None, None)]
    found = {r["path"]: r["kind"] for r in caching.failed_files(spark.createDataFrame(rows, "path string, errno int, error string")).collect()}
    assert found == {"a": "PERMISSION_DENIED", "b": "IO_ERROR", "c": "CORRUPTED_FILE", "d": "UNSUPPORTED_FORMAT", "e": "NOT_FOUND", "f": "IO_ERROR"}
    assert registry.QUERIES["g23_failed_files"](spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def test_tags_are_parsed_once_and_not_made_twice(spark):
    from prismlake.plans import metadata

    made = spark.range(3).select(F.concat(F.lit('{"SourceFile":"/in/'), F.col("id").cast("string"), F.lit('","Make":" Mk ","ISO":"200 x","FNumber":1.8,"ImageWidth":7}')).alias("tags"))
    assets = spark.createDataFrame([(f"/in/{i}", 5) for i in range(4)], "path string, size_bytes long")
    found = metadata.read_metadata(assets, made)
    got = sorted((r["path"], r["make"], r["iso_speed"], r["f_number"], r["width"], r["height"]) for r in found.collect())
    assert got == [*[(f"/in/{i}", "Mk", 200, "1.8", 7, 0) for i in range(3)], ("/in/3", None, None, None, 0, 0)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object" not in plan and plan.count("json_tuple") == 2


def test_limits_are_fitted_to_all_labelled_texts(spark, monkeypatch):
    from prismlake.llm import compression

    assert not hasattr(compression, "MOST_LABELLED")
    draw = np.random.default_rng(9)
    sizes = draw.integers(256, 200_000, 25_000)
    # The tail lies in the last rows, which a bounded number of rows would have missed.
    ratios = 0.6 - 0.02 * np.log2(sizes) + draw.normal(0, 0.01, 25_000) + (np.arange(25_000) >= 24_000) * 0.2
    found = compression.fit(spark.createDataFrame([(int(n), float(r)) for n, r in zip(sizes, ratios, strict=True)], "n_bytes long, whole_ratio double"))
    at = np.log2(sizes)
    curve = np.polyfit(at, ratios, 3)
    for size in (300, 5000, 150_000):
        near = (ratios - np.polyval(curve, at))[np.abs(at.astype(int) - int(np.log2(size))) <= 1]
        want = [np.polyval(curve, np.log2(size)) + np.quantile(near, q) + m for q, m in ((compression.TAIL, -compression.MARGIN), (1 - compression.TAIL, compression.MARGIN))]
        assert np.allclose(found(size), want, atol=3e-5)
    words = ["".join(draw.choice(list("etaoinshrdlu"), 6)) for _ in range(2000)]
    texts = [(i, " ".join(draw.choice(words, int(draw.integers(60, 400))))) for i in range(450)]
    docs, labels = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(i, 1) for i, _ in texts], "doc_id long, quality int")
    before = compression.compression_rules(docs, labels).collect()
    monkeypatch.setattr(compression, "BROADCAST_IDS", 10)
    assert sorted(compression.compression_rules(docs, labels).collect()) == sorted(before)


def test_plans_of_dated_files_are_those_of_files(spark):
    files = registry.files(spark, "/root/testdata/sf0.001").where("ord < 60")
    dated = organize.dated_files(files, registry.CONFIG)
    assert "original" not in dated.columns
    existing = organize.plan_dated(dated, registry.CONFIG).where("ord in (0, 20)").select(F.col("new_path").alias("path"))
    assert sorted(organize.plan_dated(dated, registry.CONFIG, existing).collect()) == sorted(organize.plan_organize(files, registry.CONFIG, existing).collect())


def test_dense_clusters_are_those_of_a_scan_in_few_rounds(spark, monkeypatch):
    draw = np.random.default_rng(11)
    codes = draw.choice(1 << 14, 700, replace=False).tolist()
    near = lambda x, y: (x ^ y).bit_count()
    taken, want = set(), set()
    for seed in range(700):
        members, most = [seed], 0
        for c in range(seed + 1, 700) if seed not in taken else ():
            if c in taken or near(codes[seed], codes[c]) > 4:
                continue
            for m in members:
                if near(codes[m], codes[c]) > 4:
                    break
                most = max(most, near(codes[m], codes[c]))
            else:
                members.append(c)
        if len(members) > 1:
            taken.update(members)
            want |= {(seed, most, m) for m in members}
    classes = spark.createDataFrame(list(enumerate(codes)), "rep long, phash long")
    found = pairs.near(classes, 4).localCheckpoint()
    rounds, without = [], clusters._without
    monkeypatch.setattr(clusters, "_without", lambda *tables: rounds.append(1) or without(*tables))
    for task_rows in (10**9, found.count() // 8):
        rounds.clear()
        got = [tuple(r) for r in clusters.complete_clusters(found, classes, 4, task_rows).collect()]
        assert len(got) == len(want) and set(got) == want
        # Ranges settle one by one at worst.
        assert len(rounds) <= 9


def test_the_pipeline_fits_limits_to_every_labelled_good_text(spark, tmp_path, monkeypatch):
    import corpus_pipeline
    from prismlake.llm import compression

    docs = spark.createDataFrame([(i, " ".join(f"word{i * 37 + k * k}" for k in range(60))) for i in range(300)], "doc_id long, text string")
    spark.createDataFrame([(i, int(i < 240)) for i in range(300)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    seen, fit = [], compression.fit
    monkeypatch.setattr(compression, "fit", lambda rows: seen.append(rows.count()) or fit(rows))
    corpus_pipeline.apply_rules(spark, docs, str(tmp_path))
    assert seen == [240]


def test_the_classifier_fits_to_every_labelled_target(spark, monkeypatch):
    from prismlake.llm import importance

    assert not hasattr(importance, "MOST_TARGETS")
    docs = spark.createDataFrame([(i, f"word{i % 9} other{i % 5} more{i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(150)], "doc_id long, quality int")
    whole = importance.fit(docs, labels)
    monkeypatch.setattr(importance, "BROADCAST_IDS", 10)
    joined, part = importance.fit(docs, labels), importance.fit(docs, labels, 40)
    assert (whole[0] == joined[0]).all() and whole[1:] == joined[1:] == (100, 150) and (whole[0] != part[0]).any()


def test_many_small_components_are_scanned_in_few_calls(spark, tmp_path, monkeypatch):
    scan = clusters._scan_stars

    def seen(mine, theirs):
        (tmp_path / str(mine["component"].min())).touch()
        return scan(mine, theirs)

    monkeypatch.setattr(clusters, "_scan_stars", seen)
    # Components of two near classes, whose members are of three groups.
    members = spark.createDataFrame([(f"t{i % 7}", i * 4 + k, i * 3 + k % 3, i * 4 + k % 2) for i in range(400) for k in range(4)], "tag string, asset_id long, group_id long, rep long")
    pairs = spark.createDataFrame([(i * 4, i * 4 + 1) for i in range(400)], "a long, b long")
    got = [tuple(r) for r in clusters.stars(members, pairs).collect()]
    # A component's last member is of its seed's group and stays.
    assert sorted(got) == sorted((i * 4, i * 4 + k, at) for i in range(400) for at, k in enumerate((0, 1, 2)))
    assert len(list(tmp_path.iterdir())) <= clusters.STAR_CALLS
