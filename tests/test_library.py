"""The library's queries against their SQL, and scalar, cluster and file cases."""

import struct

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from prismlake.functions import dates, imaging, paths, values
from prismlake.operators import caching, clusters, duplicates, pairs, retention, views
from prismlake.operators.components import connected_components
from prismlake.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    found = duckdb.connect()
    for t in TABLES:
        found.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return found


def plain(rows):
    return sorted(tuple("" if v is None else str(round(float(v), 6)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    result = duck.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain(df.select(*[f"`{c}`" for c in columns]).collect()) == plain(result.fetchall())


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_scalars(spark):
    lit = F.lit
    cases = [
        (dates.timestamp_tag(lit("PXL_20210828_132922123")), "20210828_132922"),
        (dates.timestamp_tag(lit("IMG_20210828")), None),
        (dates.compact_datetime(lit("x20210230_121212")), None),
        (dates.dashed_datetime(lit("Shot 2021-08-28-13-29-22.png")), "2021:08:28 13:29:22"),
        (dates.compact_without_seconds(lit("20210828_1329.jpg")), "2021:08:28 13:29:00"),
        (dates.exif_to_iso(lit("2023:06:15 14:30:00")), "2023-06-15T14:30:00"),
        # Only + and Z begin a zone, and ISO dates have neither zone nor fraction.
        (dates.parse_exif_date(lit("2023-06-15T14:30:00.25+02:00")), None),
        (dates.parse_exif_date(lit("2023-06-15T14:30:00")), "2023:06:15 14:30:00"),
        (dates.parse_exif_date(lit("2023:06:15 14:30:00+02:00")), "2023:06:15 14:30:00"),
        (dates.parse_exif_date(lit(" 2023:06:15 14:30:00Z ")), "2023:06:15 14:30:00"),
        (dates.parse_exif_date(lit("2023:06:15 14:30:00-05:00")), None),
        (dates.parse_exif_date(lit("1850:06:15 14:30:00")), None),
        (dates.file_date(lit("1850:06:15 14:30:00+01:00")), "1850:06:15 14:30:00"),
        (dates.format_date(lit("2023-06-15T14:30:00Z")), "15/06/2023 14:30:00"),
        (dates.format_date(lit("1970-01-01T00:00:00Z")), None),
        (dates.format_date(lit("soon")), None),
        (dates.datetime_local(lit("2023-06-15T14:30Z")), "2023-06-15T14:30:00"),
        (dates.datetime_local(lit(None).cast("string")), ""),
        (dates.datetime_local_to_iso(lit("2023-06-15T14:30")), "2023-06-15T14:30:00"),
        (dates.datetime_local_to_iso(lit("")), None),
        (dates.iso_to_exif(lit("2023-06-15T14:30:00Z")), "2023:06:15 14:30:00"),
        (dates.iso_to_exif(lit("2023")), "2023"),
        (dates.capture_date(lit("20210828_132922"), lit("x"), lit("y")), "2021-08-28T13:29:22Z"),
        (dates.capture_date(lit(None).cast("string"), lit(None).cast("string"), lit("y")), "y"),
        (dates.format_duration(lit(120000)), "2m"),
        (dates.format_duration(lit(7200000)), "2h"),
        (dates.format_duration(lit(59600)), "1m"),
        (values.device_of(lit(" "), lit("Prod"), lit(None).cast("string"), lit("a.jpg")), "PROD"),
        (values.device_of(lit(None).cast("string"), lit(""), lit(" "), lit("IMG-20210828-wa0001.jpg")), "WHATSAPP"),
        (values.geo_cell(lit(1.115), lit(-0.001))["geo_cell"], "1.11,-0.00"),
        (values.geo_cell(lit(0.125), lit(-0.375))["geo_cell"], "0.13,-0.38"),
        (values.geo_cell(lit(39.465), lit(179.995))["geo_cell"], f"{39.465:.2f},{179.995:.2f}"),
        (F.round(values.parse_position(lit("40d26'46\"N")), 6), 40.446111),
        (F.round(values.parse_position(lit("40°26'46\"")), 6), 40.446111),
        (values.parse_position(lit("40°46\"N")), None),
        (F.round(values.parse_pair(lit("0°25'29.1\"W 39°48'43.1\"N"))["latitude"], 6), 39.811972),
        (F.round(values.parse_pair(lit("0°25'29.1\"W 39°48'43.1\"N"))["longitude"], 6), -0.424750),
        (values.parse_pair(lit("1°N 2°N 3°E"))["latitude"], 2.0),
        (values.parse_pair(lit("1°N 2°S")), None),
        (values.parse_pair(lit("40.5; -3.7")), None),
        (values.parse_pair(lit("95, 3")), None),
        (values.gps_text(lit(39.5), lit(-0.25)), "39.50000° N, 0.25000° W"),
        (values.valid_position(lit(1.0), lit(None).cast("double")), False),
        (values.valid_position(lit(None).cast("double"), lit(None).cast("double")), None),
        (paths.short_path(lit("/a/b/c/d/e.jpg")), "a/…/c/d/e.jpg"),
        (paths.short_path(lit("N:\\x\\FOTOS\\G\\2019")), "N:\\…\\FOTOS\\G\\2019"),
        (paths.short_path(lit("\\\\nas\\x\\a\\b\\c")), "\\\\nas\\…\\a\\b\\c"),
        (paths.short_path(lit("/a/b/c")), "/a/b/c"),
        (paths.data_uri(lit("image/png"), F.unbase64(lit("AAEC"))), "data:image/png;base64,AAEC"),
        (values.hash_for_mode(lit("p"), lit("f"), True), "f"),
        (values.place_name(*[lit(x).cast("string") for x in (None, None, "V", "M", "C", "Land")]), "V, Land"),
        (values.place_name(*[lit(None).cast("string")] * 6), None),
        (views.kind_label(lit("sameDate")), "Same date"),
        (views.kind_label(lit("other")), "other"),
        (views.failure_label(lit("X")), "Unknown error"),
        (views.error_message(lit(None).cast("string"), lit("t")), "t"),
        (views.error_message(lit(None).cast("string"), lit(None).cast("string")), "Unknown error"),
        (dates.format_duration(lit(-1)), "cancelled"),
        (dates.format_duration(lit(499)), None),
        (dates.format_duration(lit(80000)), "1m 20s"),
        (dates.format_duration(lit(7500000)), "2h 5m"),
        (paths.is_canonical_name(lit("IMG_20210828_132922_A23C")), True),
        (paths.is_canonical_name(lit("img_20210828_132922_A23C")), False),
        (paths.glob_match(lit("IMG_2021"), "IMG_*"), True),
        (paths.format_size(lit(1023)), "1023 B"),
        (paths.format_size(lit(1048576)), "1.0 MB"),
        (paths.stem(lit("/a/.hidden")), ".hidden"),
        (paths.cache_key(lit("/A/É.JPG")), "/a/é.jpg"),
        (F.round(values.parse_position(lit("40°26'46\"N")), 6), 40.446111),
        (values.parse_position(lit("-3.7")), -3.7),
        (values.parse_position(lit("abc")), None),
        (values.parse_pair(lit("40.5, -3.7"))["longitude"], -3.7),
        (values.hash_from_hex(lit("ffffffffffffffff")), -1),
        (values.hash_to_hex(lit(-1).cast("long")), "f" * 16),
    ]
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cases)]).first()
    assert list(row) == [e for _, e in cases]
    assert [values.hash_threshold(s) for s in (100, 95, 90, 85, 80, 75)] == [0, 3, 6, 10, 13, 16]
    assert [one(spark, values.similarity_percent(lit(d))) for d in (0, 1, 6, 8, 16)] == [100, 98, 91, 88, 75]


@pytest.mark.parametrize(("hashes", "expected"), [([0, 0], [("exact", 100, [0, 1])]), ([0, 0x3F, 0xFFF], [("similar", 91, [0, 1])]), ([0, 1, 0x7E], [("similar", 91, [0, 1])])])
def test_clusters(spark, hashes, expected):
    rows = spark.createDataFrame(list(enumerate(hashes)), "asset_id long, phash long")
    found = {}
    for r in duplicates.similar_groups(rows, 6).collect():
        found.setdefault((r["group_id"], r["kind"], r["similarity"]), []).append(r["asset_id"])
    assert [(k, s, sorted(m)) for (_, k, s), m in sorted(found.items())] == expected


def test_cross_groups(spark):
    rows = spark.createDataFrame([(0, "t1", 0), (1, "t1", 2**40 - 1), (2, "t2", 0x3FF), (3, "t2", -1)], "asset_id long, ts_tag string, phash long")
    found = duplicates.cross_groups(duplicates.same_time_groups(rows), rows).collect()
    assert sorted(r["asset_id"] for r in found) == [0, 2] and {r["kind"] for r in found} == {"sameDate"}


def test_pairs_by_bands_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK_HASHES", 20)
    monkeypatch.setattr(pairs, "CHUNK_HASHES", 2)
    draw = np.random.default_rng(2)
    codes = draw.integers(-(2**63), 2**63, 60)
    codes[30:] = codes[:30] ^ np.array([(1 << int(i)) | (1 << int(j)) for i, j in draw.integers(0, 62, (30, 2))])
    rows = spark.createDataFrame([(i, int(c)) for i, c in enumerate(codes)], "asset_id long, phash long")
    for distance in (0, 3, 7, 11, 30):
        brute = sorted((i, j, int(np.bitwise_count((codes[i] ^ codes[j]).view(np.uint64)))) for j in range(60) for i in range(j) if np.bitwise_count((codes[i] ^ codes[j]).view(np.uint64)) <= distance)
        assert sorted(map(tuple, pairs.similar_pairs(rows, distance).collect())) == brute


def test_hashes_are_compared_by_segments(monkeypatch):
    draw = np.random.default_rng(7)
    codes = draw.integers(-(2**63), 2**63, 6000)
    codes[3000:] = codes[:3000] ^ (np.int64(1) << draw.integers(0, 63, 3000)) ^ (np.int64(1) << draw.integers(0, 63, 3000))
    for distance in (0, 2, 5, 12, 13, 14, 15, 16):
        found = []
        for limit, tally in ((10**12, None), (0, [])):
            monkeypatch.setattr(pairs, "COMPARE_ALL", limit)
            parts = [np.stack([x, y, d.astype(np.int64)]) for x, y, d in pairs.near_codes(codes[:3500], codes[2500:], distance, tally)]
            rows = np.concatenate([np.zeros((3, 0), np.int64), *parts], axis=1).T.tolist()
            assert len({tuple(r) for r in rows}) == len(rows)
            found.append(sorted(rows))
        assert found[0] == found[1] and sum(tally) < 3500 * 3500 / 10
    assert [pairs.radii(d) for d in (0, 3, 8, 11, 16)] == [[0, -1, -1, -1], [0, 0, 0, 0], [2, 1, 1, 1], [2, 2, 2, 2], [4, 3, 3, 3]]


@pytest.mark.parametrize("distance", [6, 14])
def test_pairs_are_kept_up_to_date(spark, tmp_path, distance, monkeypatch):
    monkeypatch.setattr(pairs, "MOST_VERSIONS", 3)
    draw = np.random.default_rng(3)
    base = draw.integers(-(2**63), 2**63, 10)
    pool = [int(base[i % 10] ^ np.bitwise_or.reduce(np.int64(1) << draw.integers(0, 63, 4))) for i in range(80)]
    folder = str(tmp_path / "pairs")
    for step, chosen in enumerate((pool[:40], pool[:40], pool[10:60], [], pool[5:30], pool[:80], pool[40:])):
        rows = spark.createDataFrame([(c,) for c in [*chosen, *chosen[:3], None]], "phash long")
        if step == 2:  # a run that stopped before its hashes were written
            spark.createDataFrame([(1, 2, 0)], pairs.PAIRS).write.parquet(f"{folder}/pairs/version=1")
        got = sorted(map(tuple, pairs.update_pairs(rows, distance, folder).collect()))
        whole = sorted(set(chosen))
        want = [(a, b, int(np.bitwise_count(np.uint64((a ^ b) & (2**64 - 1))))) for i, a in enumerate(whole) for b in whole[i + 1 :]]
        assert got == [w for w in want if w[2] <= distance], step
        assert got == sorted(map(tuple, pairs.kept_pairs(spark, folder).collect()))


def test_widest(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK_HASHES", 3)
    draw = np.random.default_rng(5)
    rows = [(f"k{k}", int(c)) for k in range(8) for c in draw.integers(-(2**63), 2**63, 1 + k * 2)] + [("one", 5), ("one", 5), ("none", None)]
    got = {r["key"]: r["most"] for r in pairs.widest(spark.createDataFrame(rows, "key string, phash long")).collect()}
    of = {k: [c for key, c in rows if key == k and c is not None] for k in {k for k, c in rows if c is not None}}
    assert got == {k: max(bin((a ^ b) & (2**64 - 1)).count("1") for a in own for b in own) for k, own in of.items()}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 10] + [(5, 5), (100, 3), (None, 1)], "a long, b long")
    found = {r["vertex"]: r["component"] for r in connected_components(edges, "a", "b").collect()}
    assert found == {i: max(1, (i - 1) // 10 * 10 + 1) for i in range(1, 41) if i <= 40} | {100: 1}
    assert connected_components(edges.limit(0), "a", "b").count() == 0


def test_files(spark, tmp_path):
    from prismlake.sources import media

    text = b"2020:01:02 03:04:05\0"
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 2) + struct.pack("<HHIHH", 0x0112, 3, 1, 6, 0) + struct.pack("<HHII", 0x8769, 4, 1, 38) + struct.pack("<I", 0)
    tiff += struct.pack("<H", 1) + struct.pack("<HHII", 0x9003, 2, 20, 56) + struct.pack("<I", 0) + text
    app1 = b"Exif\0\0" + tiff
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app1) + 2) + app1 + b"\xff\xda"
    assert imaging.exif_of(jpeg) == {"orientation": 6, "date_taken": "2020-01-02T03:04:05Z"}
    assert imaging.exif_of(jpeg[:30]) == imaging.exif_of(b"") == imaging.exif_of(None) == {}
    assert "date_taken" not in imaging.exif_of(jpeg.replace(b"2020:01:02", b"0000:00:00"))
    (tmp_path / "d").mkdir()
    for name in ("d/IMG_20200102_030405.jpg", "a.PNG", "b.txt", "v.mp4"):
        (tmp_path / name).write_bytes(jpeg)
    assert media.collect_images(spark, [str(tmp_path)]).count() == 2 and media.collect_media(spark, [str(tmp_path)]).count() == 3
    row = media.features(spark, [str(tmp_path)]).where("ts_tag is not null").first()
    assert row["date_taken"] == "2020-01-02T03:04:05Z" and row["orientation"] == 6


def heic(width, height, turned, tiff, big=False):
    """A HEIC file of boxes: a primary item with sizes and a turn, and an EXIF item at its end."""
    box = lambda kind, body: (struct.pack(">I4sQ", 1, kind, 16 + len(body)) if big else struct.pack(">I4s", 8 + len(body), kind)) + body
    full = lambda kind, version, body, flags=0: box(kind, struct.pack(">I", version << 24 | flags) + body)
    infe = lambda own, name: full(b"infe", 2, struct.pack(">HH4s", own, 0, name) + b"\0")
    block = struct.pack(">I", 6) + b"Exif\0\0" + tiff
    items = full(b"iinf", 0, struct.pack(">H", 2) + infe(1, b"hvc1") + infe(2, b"Exif"))
    properties = box(b"iprp", box(b"ipco", full(b"ispe", 0, struct.pack(">II", 7, 7)) + full(b"ispe", 0, struct.pack(">II", width, height)) + box(b"irot", bytes([turned]))) + full(b"ipma", 0, struct.pack(">IHBBB", 1, 1, 2, 2, 0x83)))

    def whole(at):
        places = full(b"iloc", 1, struct.pack(">BBH", 0x44, 0, 1) + struct.pack(">HHHHII", 2, 0, 0, 1, at, len(block)))
        meta = full(b"meta", 0, full(b"pitm", 0, struct.pack(">H", 1)) + items + places + properties)
        return box(b"ftyp", b"heic\0\0\0\0mif1") + meta + box(b"mdat", block)

    return whole(len(whole(0)) - len(block))


def tiff_of(order, date=b"2021:03:04 05:06:07\0", orientation=6, size=None):
    pack = lambda f, *x: struct.pack(order + f, *x)
    entries = [(0x0100, 4, 1, pack("I", size[0])), (0x0101, 3, 1, pack("HH", size[1], 0))] if size else []
    entries += [(0x0112, 3, 1, pack("HH", orientation, 0)), (0x8769, 4, 1, None)]
    end = 8 + 2 + 12 * len(entries) + 4
    head = (b"II*\0" if order == "<" else b"MM\0*") + pack("I", 8) + pack("H", len(entries))
    for tag, kind, n, value in entries:
        head += pack("HHI", tag, kind, n) + (pack("I", end) if value is None else value)
    return head + pack("I", 0) + pack("H", 1) + pack("HHII", 0x9003, 2, 20, end + 18) + pack("I", 0) + date


def test_headers_of_boxes_and_tiff():
    for big in (False, True):
        for order in "<>":
            assert imaging.boxed_facts(heic(4032, 3024, 0, tiff_of(order), big)) == ((4032, 3024), {"orientation": 6, "date_taken": "2021-03-04T05:06:07Z"})
    assert imaging.dimensions_of(heic(4032, 3024, 1, b"")) == (3024, 4032) and imaging.exif_of(heic(1, 2, 0, b"II")) == {}
    file = heic(40, 30, 0, tiff_of("<"))
    for n in range(len(file)):
        imaging.boxed_facts(file[:n]), imaging.exif_of(file[:n])
    assert imaging.boxed_facts(file[:-20])[0] == (40, 30)
    for order in "<>":
        assert imaging.dimensions_of(tiff_of(order, size=(70000, 300))) == (70000, 300)
        assert imaging.exif_of(tiff_of(order, size=(7, 3))) == {"orientation": 6, "date_taken": "2021-03-04T05:06:07Z"}


def test_files_that_cannot_be_read_are_rows(spark, tmp_path, monkeypatch):
    from prismlake.sources import heads, media

    for name, content in {"a/b/c.heic": heic(40, 30, 0, tiff_of("<")), "a/x.tif": tiff_of(">", size=(9, 8)), "a/empty.jpg": b"", "note.txt": b"n", "big.png": b"p" * 9000}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    (tmp_path / "link.png").symlink_to(tmp_path / "big.png")
    scanned = media.scan(spark, [str(tmp_path), str(tmp_path / "a"), str(tmp_path / "none")])
    rows = {r["path"].removeprefix(str(tmp_path)): r for r in scanned.collect()}
    assert set(rows) == {"/a/b/c.heic", "/a/x.tif", "/a/empty.jpg", "/big.png", "/none"}
    assert (rows["/a/b/c.heic"]["width"], rows["/a/b/c.heic"]["date_taken"], rows["/a/x.tif"]["height"]) == (40, "2021-03-04T05:06:07Z", 8)
    assert rows["/a/empty.jpg"]["size_bytes"] == 0 and rows["/a/empty.jpg"]["kind"] is None and rows["/a/empty.jpg"]["width"] == 0
    assert [tuple(r) for r in media.failed(scanned).collect()] == [(str(tmp_path / "none"), "NOT_FOUND")]
    assert [tuple(r)[1:] for r in media.corrections(scanned).collect()] == [(40, 30, "2021-03-04T05:06:07Z")]
    from prismlake.plans import metadata

    tags = spark.createDataFrame([(f'{{"SourceFile":"{tmp_path}/big.png","ImageWidth":5,"Make":"M"}}',)], "tags string")
    found, failed = metadata.scan_folders(spark, [str(tmp_path), str(tmp_path / "none")], tags)
    seen = {r["path"].rsplit("/", 1)[1]: (r["width"], r["device"], r["date_taken"]) for r in found.collect()}
    assert seen == {"big.png": (5, "M", None), "c.heic": (40, None, "2021-03-04T05:06:07Z"), "x.tif": (0, None, None), "empty.jpg": (0, None, None)} and failed.count() == 1
    chosen = heads.file_heads(spark, paths=[str(tmp_path / n) for n in ("gone.jpg", "a", "big.png")], facts=False)
    assert sorted((r["path"].rsplit("/", 1)[1], r["kind"]) for r in chosen.collect()) == [("a", "IO_ERROR"), ("big.png", None), ("gone.jpg", "NOT_FOUND")]
    found = {r["path"].rsplit("/", 1)[1]: r["header_hash"] for r in media.header_hashes(spark, [str(tmp_path)]).collect()}
    import builtins
    import hashlib

    assert found["big.png"] == hashlib.sha256(b"p" * 4096).hexdigest() and len(found) == 4
    asked = []

    class Counted:
        def __init__(self, file):
            self.file = file

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

        def read(self, n):
            asked.append(n)
            return self.file.read(n)

    monkeypatch.setattr(heads, "open", lambda p, m: Counted(builtins.open(p, m)), raising=False)
    heads.facts_of(str(tmp_path / "big.png"), False, False)
    assert asked == [4096]

    def denied(*_):
        raise PermissionError(13, "no")

    monkeypatch.setattr(heads, "open", denied, raising=False)
    assert heads.facts_of(str(tmp_path / "big.png"), True)["kind"] == "PERMISSION_DENIED"
    reader = heads.HeadReader({"folders": f'["{tmp_path}"]', "slices": "5"})
    parts = reader.partitions()
    assert sum(isinstance(p, heads.Walk) for p in parts) + sum(isinstance(p, heads.Own) for p in parts) >= 3
    names = [n for p in parts for n, _ in reader._names(p)]
    assert len(names) == len(set(names)) == 5
    monkeypatch.setattr(heads.os, "scandir", denied)
    assert [kind for p in parts for _, e in reader._names(p) for kind in [heads.kind_of(e)]][0] == "PERMISSION_DENIED"


def test_orientation():
    p = np.arange(6).reshape(2, 3)
    turned = {1: p, 2: p[:, ::-1], 3: p[::-1, ::-1], 4: p[::-1], 5: p.T, 6: p[::-1].T, 7: p[::-1, ::-1].T, 8: p.T[::-1]}
    for orientation, expected in turned.items():
        assert imaging.orient(p, orientation).tolist() == expected.tolist(), orientation


def test_thumbnails_and_tags(spark, tmp_path):
    import base64
    import json

    from prismlake.plans import metadata
    from prismlake.sources import media

    wide = np.zeros((90, 360, 3), np.uint8)
    wide[:, :180] = (255, 0, 9)
    (tmp_path / "a.png").write_bytes(imaging.png_of(wide))
    (tmp_path / "b.png").write_bytes(b"none")
    (row,) = media.thumbnails(spark, [str(tmp_path)]).collect()
    content = base64.b64decode(row["uri"].removeprefix("data:image/png;base64,"))
    assert imaging.dimensions_of(content) == (180, 45) and len(row["key"]) == 16
    assert imaging.thumbnail_of(wide[:, :, ::-1].tobytes(), 90, 360, 3, 6) == imaging.png_of(imaging.nearest(np.rot90(wide, -1), 180, 45))
    objects = [{"SourceFile": "/x\\a.png", "Make": " M ", "GPSLatitude": 1.5, "ISO": "100 x"}, {"Make": "none"}, {"SourceFile": "/x/b.jpg", "Nested": {"k": [1]}}]
    (tmp_path / "t1.json").write_text(json.dumps(objects[:2], indent=1))
    (tmp_path / "t2.json").write_text(json.dumps(objects[2]) + "\n")
    tags = media.read_tags(spark, str(tmp_path / "*.json"))
    assert sorted((json.loads(r["tags"]) for r in tags.collect()), key=str) == sorted(objects, key=str)
    assets = spark.createDataFrame([("/x/a.png", 7), ("/x/c.gif", 8)], "path string, size_bytes long")
    read = {r["path"]: r for r in metadata.read_metadata(assets, tags).collect()}
    assert (read["/x/a.png"]["make"], read["/x/a.png"]["iso_speed"], read["/x/a.png"]["gps_latitude"], read["/x/a.png"]["format"]) == ("M", 100, 1.5, "PNG")
    assert (read["/x/c.gif"]["make"], read["/x/c.gif"]["file_size"], read["/x/c.gif"]["width"]) == (None, 8, 0)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_every_group_has_a_place(spark):
    import __spark_entry__ as entry
    from prismlake.plans.registry import _kinds

    name, folder = "o4_order_groups", "/root/testdata/sf0.01"
    found = sorted(entry.queries()[name](spark, folder).collect(), key=lambda r: r["place"])
    rank = lambda r: {"exact": 0, "similar": 1}.get(r["kind"], 3 if r["similarity"] is None else 2)
    rows = sorted(_kinds(spark, folder).collect(), key=lambda r: (rank(r), -r["similarity"] if rank(r) in (1, 2) else 0, r["group_id"]))
    assert len(rows) > 100 and [tuple(r) for r in found] == [(r["group_id"], i + 1) for i, r in enumerate(rows)]
    assert "limit" not in entry.oracle_sql()[name]


def sequential_groups(assets, distance, across=True):
    """A plain sequential model: {frozenset of members: (kind, similarity)} of assets (id, content, tag, hash) in order."""
    apart = lambda x, y: bin((x ^ y) & (2**64 - 1)).count("1")
    percent = lambda d: int((64 - d) / 64 * 100 + 0.5)
    groups, done = {}, set()
    for content in {a[1] for a in assets}:
        own = [a[0] for a in assets if a[1] == content]
        if len(own) > 1:
            groups[frozenset(own)] = ("exact", 100)
            done |= set(own)
    rest = [a for a in assets if a[0] not in done and a[3] is not None]
    for i, seed in enumerate(rest):
        if seed[0] in done:
            continue
        cluster, most = [seed], 0
        for other in rest[i + 1 :]:
            if other[0] in done or apart(seed[3], other[3]) > distance:
                continue
            for x in cluster:
                d = apart(x[3], other[3])
                if d > distance:
                    break
                most = max(most, d)
            else:
                cluster.append(other)
        if len(cluster) > 1:
            done |= {x[0] for x in cluster}
            groups[frozenset(x[0] for x in cluster)] = ("exact", 100) if not most else ("similar", percent(most))
    timed = {}
    for a in assets:
        if a[0] not in done and a[2] is not None:
            timed.setdefault(a[2], []).append(a)
    timed = {t: own for t, own in timed.items() if len(own) > 1}
    shown = {}
    for t, own in timed.items():
        far = max((apart(x[3], y[3]) for x in own for y in own), default=0) if all(x[3] is not None for x in own) else 99
        shown[t] = percent(far) if far <= 16 else None
    taken = set()
    flat = [(t, a) for t in sorted(timed) for a in timed[t]]
    for i, (t, seed) in enumerate(flat if across else []):
        if seed[0] in taken or seed[3] is None:
            continue
        star = [seed] + [a for u, a in flat[i + 1 :] if u != t and a[0] not in taken and a[3] is not None and apart(seed[3], a[3]) <= 16]
        if len(star) > 1:
            taken |= {x[0] for x in star}
            groups[frozenset(x[0] for x in star)] = ("sameDate", percent(max(apart(x[3], y[3]) for x in star for y in star)))
    for t, own in timed.items():
        left = [x[0] for x in own if x[0] not in taken]
        if len(left) > 1:
            groups[frozenset(left)] = ("sameDate", shown[t])
    return groups


@pytest.mark.parametrize(("distance", "task_rows"), [(0, 200_000), (3, 200_000), (6, 200_000), (7, 200_000), (10, 200_000), (16, 200_000), (6, 0), (16, 4)])
def test_all_phases_equal_a_sequential_scan(spark, distance, task_rows, monkeypatch):
    # Without room in tasks all components go by rounds.
    monkeypatch.setattr(clusters, "TASK_ROWS", task_rows)
    draw = np.random.default_rng(distance)
    base = draw.integers(-(2**63), 2**63, 12)
    assets = []
    for i in range(150):
        code = int(base[draw.integers(12)])
        for bit in draw.choice(64, draw.integers(0, 9), replace=False):
            code ^= 1 << int(bit) if bit < 63 else -(2**63)
        assets.append((i, f"c{draw.integers(140)}" if i % 5 else f"own{i}", f"20210828_{draw.integers(60):06d}" if i % 3 else None, code if i % 13 else None))
    rows = [(i, f"/p/{tag or 'x'}_{i}.jpg" if tag else f"/p/name{i}.jpg", c, h, f"2020-01-{1 + i % 28:02d}", i % 7, 10, 10) for i, c, tag, h in assets]
    found = duplicates.find_duplicates(spark.createDataFrame(rows, "asset_id long, path string, content_hash string, phash long, modified string, size_bytes long, width int, height int").withColumn("date_taken", F.lit(None).cast("string")).withColumn("blur_score", F.lit(None).cast("double")), distance).collect()
    groups = {}
    for r in found:
        groups.setdefault((r["group_id"], r["kind"], r["similarity"]), []).append(r)
    made = {frozenset(r["asset_id"] for r in own): key[1:] for key, own in groups.items()}
    assert made == sequential_groups(assets, distance) and len(groups) == len(made)
    assert all(sum(r["is_original"] for r in own) == 1 for own in groups.values())
    firsts = []
    for own in groups.values():
        own.sort(key=lambda r: r["place"])
        assert [r["place"] for r in own] == list(range(1, len(own) + 1)) and [r["modified"] for r in own] == sorted(r["modified"] for r in own)
        firsts.append((own[0]["group_place"], own[0]["modified"]))
    assert [p for p, _ in sorted(firsts)] == list(range(1, len(firsts) + 1)) and [m for _, m in sorted(firsts)] == sorted(m for _, m in firsts)


def test_a_hash_that_many_have_is_one_class(spark):
    many = spark.range(200_000).select(F.col("id").alias("asset_id"), F.when(F.col("id") % 3 == 0, F.lit(5).cast("long")).otherwise(F.xxhash64("id")).alias("phash"))
    assert pairs.similar_pairs(many, 6).count() < 1000
    groups = duplicates.similar_groups(many, 6).groupBy("group_id", "kind").count().orderBy(F.desc("count")).first()
    assert tuple(groups) == (0, "exact", 66_667)
    tagged = many.limit(20_000).withColumn("ts_tag", F.lit("20210828_132922"))
    assert duplicates.same_time_groups(tagged).where("similarity is not null").count() == 0


def test_components_that_do_not_settle_are_an_error(spark):
    path = spark.range(3000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).repartition(40)
    with pytest.raises(RuntimeError):
        connected_components(path, "a", "b", rounds=1)
    assert connected_components(path, "a", "b").select("component").distinct().count() == 1


def plan_rows(spark, files, config, existing=None):
    from prismlake.plans import organize

    columns = "ord long, path string, original string, created string, media_created string, file_modified string, make string, model string, product string, android string"
    rows = [(i, path, date, *[None] * 7) for i, (path, date) in enumerate(files)]
    plan = organize.plan_organize(spark.createDataFrame(rows, columns), organize.OrganizerConfig(**config), existing)
    return {r["original_path"]: (r["new_filename"], r["new_path"]) for r in plan.collect()}


def test_names_of_plans(spark):
    day = "2021:08:28 13:29:22"
    files = [("/i/a.jpeg", day), ("/i/b.mp4", day), ("/i/c.txt", day), ("/i/d.PNG", day)]
    one = plan_rows(spark, files, {"rename_template": "{40hex_uid}-{2hex_uid}{x}"})
    assert one["/i/a.jpeg"][0] == "0" * 32 + "-01{X}.jpg" and one["/i/b.mp4"][0] == "0" * 31 + "2-03{X}.mp4" and one["/i/d.PNG"][0].endswith("4-05{X}.png") and "/i/c.txt" not in one
    assert plan_rows(spark, files, {"rename_template": "", "folder_template": ""})["/i/a.jpeg"] == ("IMG_20210828_132922_0000.jpg", "/out/2021/DESCONOCIDO/08 - AGOSTO/IMG_20210828_132922_0000.jpg")
    assert plan_rows(spark, files, {"output_directory": ""})["/i/a.jpeg"] == ("IMG_20210828_132922_0000.jpg",) * 2
    assert plan_rows(spark, files, {"only_rename": True, "rename_template": "{year}"})["/i/b.mp4"] == ("2021.mp4", "/i/2021.mp4")
    # A month that is none gives no folder.
    assert plan_rows(spark, [("/i/IMG_20211399_x.jpg", None)], {})["/i/IMG_20211399_x.jpg"][1].startswith("IMG_20211399_000000_")
    # Two files of one second: without a number only the first keeps the name.
    assert list(plan_rows(spark, files[:1] + [("/i/z.jpg", day)], {"rename_template": "{date}_{time}"})) == ["/i/a.jpeg"]
    names = plan_rows(spark, files, {"rename_template": "{9crypto_uid}"})
    assert len({n for n, _ in names.values()}) == 3 and all(len(n.split(".")[0]) == 9 and n.split(".")[0].isalnum() for n, _ in names.values())


def sequential_names(files, existing, name, step):
    """One file after the other: up to 16 tries, each of which takes the next numbers."""
    counter, taken, out = 0, set(existing), {}
    for i, (path, date) in enumerate(files):
        for _ in range(16):
            made = name(date, counter)
            counter += step
            if made not in taken:
                taken.add(made)
                out[path] = made
                break
    return out


def test_names_that_exist_are_tried_again(spark):
    day, folder = "2021:08:28 13:29:22", "/out/2021/DESCONOCIDO/08 - AGOSTO/IMG_20210828_132922_"
    files = [(f"/i/{i}.jpg", day) for i in range(4)]
    existing = spark.createDataFrame([(f"{folder}{n:04X}.jpg",) for n in (1, 2, 4)], "path string")
    found = plan_rows(spark, files, {}, existing)
    assert {k: v[1] for k, v in found.items()} == {f"/i/{i}.jpg": f"{folder}{n:04X}.jpg" for i, n in ((0, 0), (1, 3), (2, 5), (3, 6))}
    every = spark.createDataFrame([(f"{folder}{n:04X}.jpg",) for n in range(64)], "path string")
    assert plan_rows(spark, files[:1], {}, every) == {}


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_taken_names_move_later_numbers(spark, seed):
    import random

    draw = random.Random(seed)
    # One digit of the number only, so that names also meet within the plan: 1 and the next part's 1 make what 11 makes.
    template = ["{4hex_uid}", "{day}{1hex_uid}", "{1hex_uid}{1hex_uid}"][seed]
    step = template.count("uid")
    files = [(f"/i/{i}.jpg", f"2021:08:{draw.choice((1, 11)):02d} 13:29:22") for i in range(12)]
    digits = lambda n, w: f"{n:0{w}X}"
    name = {0: lambda d, n: digits(n, 4), 1: lambda d, n: d[8:10] + digits(n, 1), 2: lambda d, n: digits(n, 1) + digits(n + 1, 1)}[seed]
    path = lambda d, n: f"/o/X/{name(d, n)}.jpg"
    existing = sorted({path(f"2021:08:{draw.choice((1, 11)):02d} 0", n) for n in draw.sample(range(20), 4)} | {path("2021:08:01 0", n) for n in range(6, 23)})
    found = plan_rows(spark, files, {"rename_template": template, "output_directory": "/o", "folder_template": "x"}, spark.createDataFrame([(p,) for p in existing], "path string"))
    assert {k: v[1] for k, v in found.items()} == sequential_names(files, existing, path, step)


def test_pictures(spark, tmp_path):
    import zlib

    from prismlake.sources import media

    def png(rows):
        chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        raw = b"".join(b"\0" + bytes(v for x in row for v in (x, x, x)) for row in rows)
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")

    ramp = [[10 * x for x in range(18)] for _ in range(16)]
    (tmp_path / "IMG_20200102_030405_A23C.png").write_bytes(png(ramp))
    (tmp_path / "flat.png").write_bytes(png([[7] * 20] * 5))
    (tmp_path / "broken.png").write_bytes(b"no picture")
    found = {r["path"].rsplit("/")[-1]: r for r in media.features(spark, [str(tmp_path)]).collect()}
    first, flat, broken = found["IMG_20200102_030405_A23C.png"], found["flat.png"], found["broken.png"]
    assert (first["width"], first["height"], first["phash"], first["modified"]) == (18, 16, -1, "2020-01-02T03:04:05Z")
    assert (flat["width"], flat["height"], flat["phash"], flat["blur_score"]) == (20, 5, 0, 0.0)
    assert (broken["width"], broken["phash"], broken["blur_score"]) == (0, None, None) and broken["content_hash"]
    assert {r["header_hash"] for r in media.header_hashes(spark, [str(tmp_path)]).collect()} == {r["header_hash"] for r in found.values()}
    listing = media.list_files(spark, [str(tmp_path)])
    chosen = spark.createDataFrame([(0, f"{tmp_path}/flat.png"), (1, str(tmp_path))], "ord int, path string")
    assert [r["path"].rsplit("/")[-1] for r in media.in_given_order(listing, chosen).collect()] == ["flat.png", "IMG_20200102_030405_A23C.png", "broken.png"]
    asked = spark.createDataFrame([(f"{tmp_path}/flat.png",), ("/none",)], "path string")
    assert {r["path"]: r["there"] for r in media.paths_exist(asked, listing).collect()} == {f"{tmp_path}/flat.png": True, "/none": False}


def test_picture_sizes_from_headers():
    sof = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc2\0\x0b\x08" + struct.pack(">HH", 33, 44) + b"\x03"
    heads = {
        b"GIF89a" + struct.pack("<HH", 3, 4): (3, 4),
        b"BM" + b"\0" * 16 + struct.pack("<ii", 5, -6): (5, 6),
        sof: (44, 33),
        b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little"): (100, 50),
        b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 2) + struct.pack("<HHIHH", 0x100, 3, 1, 7, 0) + struct.pack("<HHII", 0x101, 4, 1, 8) + b"\0\0\0\0": (7, 8),
        b"": (0, 0),
        b"\x89PNG\r\n\x1a\n": (0, 0),
    }
    assert {k: imaging.dimensions_of(k) for k in heads} == heads
    # Small pictures are enlarged to three pixels a side.
    assert imaging.sharpness(np.array([[1.0, 200.0]])) == imaging.laplacian(imaging.nearest(np.array([[1.0, 200.0]]), 3, 3))
    assert imaging.nearest(np.zeros((300, 500)), 3, 4).shape == (3, 4)


def test_caches_on_disk(spark, tmp_path):
    pairs = spark.createDataFrame([(1, 2, 3)], "a long, b long, distance int")
    assert caching.load_pairs(spark, "f", True, str(tmp_path / "c")) is None
    for _ in range(2):
        caching.save_pairs(pairs, "f", True, str(tmp_path / "c"))
    assert caching.load_pairs(spark, "f", True, str(tmp_path / "c")).count() == 1 and caching.load_pairs(spark, "f", False, str(tmp_path / "c")) is None
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x").write_bytes(b"12345")
    assert tuple(caching.stored_bytes(spark, str(tmp_path / "d")).first()) == (1, 5)
    assert caching.clear(spark, str(tmp_path / "d")) and not (tmp_path / "d").exists() and not caching.clear(spark, str(tmp_path / "d"))
    cache = spark.createDataFrame([("k", "p", "f")], "cache_key string, phash string, fast_phash string")
    assert tuple(caching.keep_slot(cache, True, F.lit("n")).first()) == ("k", "p", "n") and tuple(caching.keep_slot(cache, False, F.lit(None).cast("string")).first()) == ("k", "p", "f")


def test_streams(spark, tmp_path):
    from prismlake.streaming import progress

    schema = "cache_key string, at timestamp, n int"
    for i, rows in enumerate([[("a", "2020-01-01 00:00:01", 1), ("b", "2020-01-01 00:00:02", 1)], [("a", "2020-01-01 00:05:00", 2)], [("c", "2020-01-01 00:00:03", 3)]]):
        spark.createDataFrame(rows, "cache_key string, at string, n int").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        progress.maintain_cache(stream, str(tmp_path / "cache"), str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
        # A row that comes later than the watermark allows is not counted.
        counts = progress.windowed_counts(stream, "at", "cache_key").writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "counts")).option("checkpointLocation", str(tmp_path / "counting"))
        counts.trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["cache_key"], r["n"]) for r in spark.read.parquet(str(tmp_path / "counts")).collect()) == [("a", 1), ("b", 1)]
    kept = caching.stored_cache(spark, str(tmp_path / "cache"))
    assert sorted((r["cache_key"], r["n"]) for r in kept.collect()) == [("a", 2), ("b", 1), ("c", 3)]


def test_a_cache_of_buckets(spark, tmp_path):
    folder, held = str(tmp_path / "cache"), {}
    draw = np.random.default_rng(1)
    assert caching.stored_cache(spark, folder) is None
    for batch in range(6):
        new = {f"k{i}": batch * 100 + int(i) for i in draw.choice(200, 40 if batch else 150, replace=False)}
        gone = [f"k{i}" for i in range(batch, 200, 37)] if batch % 2 else []
        rows = spark.createDataFrame(list(new.items()), "cache_key string, n long")
        deleted = spark.createDataFrame([(g,) for g in gone], "cache_key string") if gone else None
        for _ in range(2):  # a repeated batch changes nothing
            caching.fold(rows, folder, batch, deleted=deleted)
        held |= new
        held = {k: v for k, v in held.items() if k not in gone}
        assert {r["cache_key"]: r["n"] for r in caching.stored_cache(spark, folder).select("cache_key", "n").collect()} == held
    one = spark.createDataFrame([("k1", 7)], "cache_key string, n long")
    caching.fold(one, folder, 6)
    assert len(list((tmp_path / "cache" / "data" / "version=6").glob("bucket=*"))) == 1 and len(list((tmp_path / "cache" / "manifest").iterdir())) == 3
    caching.fold(one.limit(0), folder, 7, deleted=spark.createDataFrame([(k,) for k in [*held, "k1"]], "cache_key string"))
    assert caching.stored_cache(spark, folder) is None
    caching.fold(one, folder, 8)
    assert [tuple(r)[:2] for r in caching.stored_cache(spark, folder).select("cache_key", "n").collect()] == [("k1", 7)]


def test_windows_over_one_key_of_all_rows(spark):
    from prismlake.streaming import progress

    draw = np.random.default_rng(4)
    rows = [(i, "hot" if i % 5 else None, int(draw.integers(0, 400)), ["a", "b", None][int(draw.choice(3, p=[0.6, 0.3, 0.1]))]) for i in range(600)] + [(900, "few", 3, "a"), (901, "few", None, "a")]
    table = spark.createDataFrame(rows, "id long, k string, at long, v string")
    got = {r["id"]: (r["n"], r["since"]) for r in progress.rolling_progress(table, "k", "at", 10).collect()}
    for i, k, at, _ in rows:
        span = [a for _, other, a, _ in rows if other == k and a is not None and at is not None and at - 10 <= a <= at]
        assert got[i] == ((len(span), min(span)) if k and at is not None else (None, None))
    got = {r["id"]: r["segment"] for r in progress.segments(table, ["k"], "id", "v").collect()}
    for key in {r[1] for r in rows}:
        last, n = object(), 0
        for i, _, _, v in sorted(r for r in rows if r[1] == key):
            n += v is None or v != last
            last = v
            assert got[i] == n
    spread = progress.ranges(table.where("k = 'hot'"), ["k"], ["id"]).groupBy("_part").count().count()
    assert spread == 4
    assert progress.segments(table.limit(0), ["k"], "id", "v").count() == progress.rolling_progress(table.limit(0), "k", "at", 10).count() == 0


def test_progress_is_kept_as_state(spark, tmp_path):
    from prismlake.streaming import progress

    # Timers ask for batches without data, which would go on for ever here.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    samples = [[("a", 0.0, 0, 1000), ("a", 2.0, 100, 1000), ("b", 0.0, 5, 9)], [("a", 14.0, 400, 1000), ("a", 6.0, 200, 1000)], [("a", 11.0, 350, 1000), ("b", 0.5, 6, 9)]]
    ring, want = {}, []
    for i, batch in enumerate(samples):
        spark.createDataFrame(batch, "key string, at double, scanned long, total long").coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
        stream = spark.readStream.schema("key string, at double, scanned long, total long").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        out = []
        query = progress.progress_stream(stream).writeStream.outputMode("update").foreachBatch(lambda rows, _, out=out: out.extend(rows.collect()))
        query.option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination(60)
        for key in sorted({r[0] for r in batch}):
            ring[key] = sorted(set(ring.get(key, [])) | {(at, n) for k, at, n, _ in batch if k == key})
            ring[key] = [x for x in ring[key] if x[0] >= ring[key][-1][0] - 10]
            total = batch[0][3] if key == "a" else 9
            want.append((key, ring[key][-1][0], len(ring[key]), progress.remaining_seconds(ring[key], total if key == "b" else 1000)))
        assert sorted(map(tuple, out)) == want[-len({r[0] for r in batch}) :]
    assert [w[3] for w in want if w[0] == "a"] == [18, 24, 24]
    windows = spark.createDataFrame([(ring[k][0][1], ring[k][-1][1], ring[k][-1][0] - ring[k][0][0], t) for k, t in (("a", 1000), ("b", 9))], "f long, l long, s double, t long")
    assert [r[0] for r in windows.select(progress.eta_seconds(F.col("f"), F.col("l"), F.col("s"), F.col("t"))).collect()] == [want[-2][3], None]


def test_nearest_places(spark):
    from prismlake.operators.places import RADIUS, nearest_places

    draw = np.random.default_rng(6)
    known = [(f"p{i}", float(a), float(o)) for i, (a, o) in enumerate(zip(draw.uniform(-90, 90, 60), draw.uniform(-180, 180, 60), strict=True))]
    known += [(f"c{i}", float(48 + a), float(2 + o)) for i, (a, o) in enumerate(draw.uniform(0, 0.3, (60, 2)))] + [("pole", 90.0, 0.0), ("line", 0.0, 180.0), ("b", 10.0, 10.0), ("a", 10.0, 10.0)]
    asked = [(i, float(a), float(o)) for i, (a, o) in enumerate(zip(draw.uniform(-90, 90, 80), draw.uniform(-180, 180, 80), strict=True))]
    asked += [(100, 89.9, -120.0), (101, 0.1, -179.95), (102, 48.1, 2.1), (103, 10.0, 10.0), (104, None, 1.0), (105, 95.0, 0.0), (106, 48.1, 2.1), (107, -90.0, 5.0)]
    places_ = spark.createDataFrame([*known, ("none", None, 1.0), ("out", 91.0, 0.0)], "name string, latitude double, longitude double")
    points = spark.createDataFrame(asked, "id int, latitude double, longitude double")

    def far(a, b, c, d):
        a, b, c, d = map(np.radians, (a, b, c, d))
        chord = np.array([np.cos(a) * np.cos(b) - np.cos(c) * np.cos(d), np.cos(a) * np.sin(b) - np.cos(c) * np.sin(d), np.sin(a) - np.sin(c)])
        return 2 * RADIUS * np.arcsin(min(1, np.sqrt((chord**2).sum()) / 2))

    got = {r["id"]: r for r in nearest_places(points, places_).collect()}
    for i, a, o in asked:
        if a is None or a > 90:
            assert got[i]["place"] is None and got[i]["km"] is None
            continue
        km, name = min((far(a, o, x, y), n) for n, x, y in known)
        assert got[i]["place"] == name and abs(got[i]["km"] - km) < 1e-6
    assert nearest_places(points, places_.limit(0)).where("place is not null").count() == 0 and nearest_places(points.limit(0), places_).count() == 0
    one = nearest_places(points, places_.where("name = 'pole'")).where("place = 'pole'")
    assert one.count() == 86


def test_values_and_histories_are_kept(spark, tmp_path):
    folder = str(tmp_path / "values")
    assert caching.load_values(spark, folder).count() == 0
    for at, key in enumerate("abcdefab"):
        entry = spark.createDataFrame([(key, at, at * 10, None, f"r{at}")], "key string, id long, at long, duration long, found string")
        caching.save_history(entry, folder, "duplicates", 3)
    caching.save_values(spark.createDataFrame([("settings", '{"n":1}'), ("gone", "1")], "key string, value string"), folder)
    caching.save_values(spark.createDataFrame([("settings", '{"n":2}')], "key string, value string"), folder, spark.createDataFrame([("gone",)], "key string"))
    assert [tuple(r) for r in caching.load_values(spark, folder, ["settings", "gone"]).collect()] == [("settings", '{"n":2}')]
    kept = caching.load_history(spark, folder, "duplicates", entry.schema).orderBy("at").collect()
    assert [(r["key"], r["id"], r["found"]) for r in kept] == [("f", 5, "r5"), ("a", 6, "r6"), ("b", 7, "r7")]


def test_values_are_removed_everywhere(spark):
    lists = [spark.createDataFrame([("Rome",), ("Oslo",), (None,)], "location string")]
    rows = spark.createDataFrame([(1, "Rome", "Cam"), (2, None, "Cam 2"), (3, "Oslo", None)], "id int, location string, device string")
    names = spark.createDataFrame([("1,1", "Rome"), ("2,2", ""), ("3,3", "Oslo")], "geo_cell string, name string")
    (found,), left, cache = views.remove_location("Rome", lists, rows, names)
    assert found.count() == 2 and cache.count() == 2 and [r["location"] for r in left.orderBy("id").collect()] == [None, None, "Oslo"]
    aliases = spark.createDataFrame([("Cam", "x"), ("Cam 2", "y")], "device string, alias string")
    _, left, kept = views.remove_device("Cam", [], rows, aliases)
    assert [r["device"] for r in left.orderBy("id").collect()] == [None, "Cam 2", None] and [r["alias"] for r in kept.collect()] == ["y"]


def test_a_stopped_scan_goes_on(spark, tmp_path):
    from prismlake.streaming.progress import scan_by_segments

    for i in range(4):
        (tmp_path / "in" / f"d{i}" / "deep").mkdir(parents=True)
        (tmp_path / "in" / f"d{i}" / "deep" / "a.png").write_bytes(bytes([i]) * 10)
    (tmp_path / "in" / "own.jpg").write_bytes(b"x")
    asked, cache = [], str(tmp_path / "cache")
    assert not scan_by_segments(spark, [str(tmp_path / "in")], cache, stopped=lambda: len(asked) == 2 or asked.append(1))
    part = caching.stored_cache(spark, f"{cache}/files").select("cache_key").collect()
    assert len(part) == 2
    scanned = []
    assert scan_by_segments(spark, [str(tmp_path / "in")], cache, stopped=lambda: bool(scanned.append(1)))
    assert len(scanned) == 3 and caching.stored_cache(spark, f"{cache}/files").select("cache_key").distinct().count() == 5
    assert scan_by_segments(spark, [str(tmp_path / "in")], cache, stopped=lambda: True)


def test_nulls_ties_and_empty_tables(spark):
    assets = spark.createDataFrame([(1, None, None, None, None, None, None), (2, "/a.jpg", "", "", None, None, "x")], "asset_id long, path string, location string, device string, gps_latitude double, gps_longitude double, modified string").withColumn("date_taken", F.lit(None).cast("string"))
    for by in ("date", "location", "device"):
        for down in (False, True):
            assert sorted(r["place"] for r in views.order_assets(assets, by, down).collect()) == [1, 2]
            assert views.order_assets(assets.limit(0), by, down).count() == 0
    members = assets.select(F.lit(1).alias("group_id"), F.lit("exact").alias("kind"), F.lit(False).alias("is_original"), "path", "modified", F.col("asset_id").alias("ord"))
    assert sorted(r["place"] for r in views.original_first(members).collect()) == [1, 2]
    twice = [caching.fingerprint(x, ["asset_id", "path"]).first()["fingerprint"] for x in (assets, assets.orderBy(F.desc("asset_id")), assets.where("asset_id = 1"))]
    assert twice[0] == twice[1] != twice[2]
    names = spark.createDataFrame([("Cam 10",), ("cám 9",), ("CAM 9b",), ("Cam 2",)], "device string")
    assert [r["device"] for r in names.orderBy(views.natural_key(F.col("device"))).collect()] == ["Cam 2", "cám 9", "CAM 9b", "Cam 10"]
    shown = retention.prune_deleted(members.withColumn("width", F.lit(1)).withColumn("height", F.lit(1)), members.where("path = '/a.jpg'"))
    assert shown.count() == 0


def test_tables_are_swept(spark):
    import os

    from prismlake import session

    made = session.settled(lambda: session.durable(spark.range(3)).where("id > 0"))
    path = made.durable_path.removeprefix("file:")
    assert made.count() == 2 and os.path.exists(path)
    session.sweep()
    assert not os.path.exists(path) and not session._written


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from prismlake import session

    fake = lambda master, found: SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: None), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: found))
    with pytest.raises(RuntimeError):
        session.shared_dir(fake("spark://host:7077", None))
    assert session.shared_dir(fake("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y"
    assert session.shared_dir(fake("local[2]", None)).startswith("file:")
