"""Incremental work: what a cache of features saves, and how it is kept."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from prismlake.session import discard, durable
from prismlake.sources.heads import KINDS

# What the texts of errors without a number hold, in capitals; decoders give such for pictures.
ERROR_TEXTS = {"PERMISSION_DENIED": "PERMISSION|ACCESS DENIED", "NOT_FOUND": "NOT.?FOUND|NO SUCH FILE", "UNSUPPORTED_FORMAT": "UNSUPPORTED", "CORRUPTED_FILE": "CORRUPT"}


def usable(fast: bool) -> Column:
    """A cached row serves if it has the mode's hash, or was never hashed in either mode."""
    own = F.col("fast_phash" if fast else "phash")
    return own.isNotNull() | (F.col("phash").isNull() & F.col("fast_phash").isNull())


def match_cache(assets: DataFrame, cache: DataFrame, fast: bool = False) -> DataFrame:
    """assets (cache_key, size_bytes, header_hash, mtime) with `hit` and the cached content_hash.

    A row is valid if its size is equal and its header hash too, or, where none was
    stored, its time. Each key is in the cache once.
    """
    c = cache.select("cache_key", F.col("size_bytes").alias("c_size"), F.col("header_hash").alias("c_header"), F.col("mtime").alias("c_mtime"), "content_hash", "phash", "fast_phash", F.lit(True).alias("c_there"))
    same = F.when(F.col("c_header").isNotNull(), F.col("c_header") == F.col("header_hash")).otherwise(F.col("c_mtime") == F.col("mtime"))
    hit = F.coalesce(F.col("c_there") & (F.col("c_size") == F.col("size_bytes")) & same & usable(fast), F.lit(False))
    joined = assets.join(c, "cache_key", "left").withColumn("hit", hit)
    return joined.select(*assets.columns, "hit", F.when(F.col("hit"), F.col("content_hash")).alias("content_hash"))


def cache_count(cache: DataFrame) -> DataFrame:
    """n: the entries of a cache; rows without a key are none."""
    return cache.agg(F.count("cache_key").alias("n"))


def hit_stats(matched: DataFrame) -> DataFrame:
    n = F.count("*")
    hits = F.count_if(F.col("hit"))
    return matched.agg(hits.alias("hits"), (n - hits).alias("misses"), F.when(n > 0, F.round(hits * 100 / n).cast("int")).otherwise(0).alias("hit_percent"))


def upsert(cache: DataFrame, new: DataFrame, key: str = "cache_key") -> DataFrame:
    """new rows and those of cache that no new row replaces; columns that one lacks are null."""
    return new.unionByName(cache.join(new.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def evict(cache: DataFrame, deleted: DataFrame, key: str = "cache_key") -> DataFrame:
    return cache.join(deleted.select(key).distinct(), key, "left_anti")


#: Buckets of a cache on disk, and manifests that are kept.
BUCKETS, MANIFESTS = 64, 3


def _manifests(spark: SparkSession, folder: str) -> DataFrame | None:
    """Rows (version, batch, bucket, place) of all manifests, or None without one."""
    try:
        return spark.read.schema("batch long, bucket int, place int, version int").parquet(f"{folder}/manifest")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None


def _current(spark: SparkSession, folder: str) -> tuple[int, int, dict[int, int]]:
    """(version, batch, the version that holds each bucket) of the last manifest: at most BUCKETS rows."""
    known = _manifests(spark, folder)
    last = None if known is None else known.agg(F.max("version")).first()[0]
    if last is None:
        return -1, -1, {}
    rows = known.where(F.col("version") == last).collect()
    return last, rows[0]["batch"], {r["bucket"]: r["place"] for r in rows if r["bucket"] is not None}


def stored_cache(spark: SparkSession, folder: str, only: list[int] | None = None) -> DataFrame | None:
    """The rows of a cache of buckets, or of some of them; None where there are none yet."""
    _, _, places = _current(spark, folder)
    paths = [f"{folder}/data/version={v}/bucket={b}" for b, v in sorted(places.items()) if only is None or b in only]
    return spark.read.parquet(*paths) if paths else None


def fold(new: DataFrame, folder: str, batch: int, key: str = "cache_key", deleted: DataFrame | None = None) -> None:
    """Put rows into a cache of buckets by key, replacing those of equal keys, and take the deleted keys out.

    Only buckets that a row or a deleted key falls into are read and written; a manifest
    then says which version holds each bucket, so readers see all of a batch or none of
    it. A batch number that has been folded already changes nothing. Of several new rows
    of one key one stands. Versions that the last manifests do not name are deleted.
    """
    spark = new.sparkSession
    version, done, places = _current(spark, folder)
    if batch <= done:
        return
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
    rows = durable(new.dropDuplicates([key]))
    gone = durable(deleted.select(key).distinct()) if deleted is not None else None
    keys = rows.select(key) if gone is None else rows.select(key).unionByName(gone)
    touched = sorted(r["b"] for r in keys.select(bucket.alias("b")).distinct().collect())
    old = stored_cache(spark, folder, touched)
    whole = rows if old is None else upsert(old, rows, key)
    whole = whole if gone is None else evict(whole, gone, key)
    now = version + 1
    whole.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/data/version={now}")
    full = {r["bucket"] for r in spark.read.parquet(f"{folder}/data/version={now}").select("bucket").distinct().collect()} if touched and not whole.isEmpty() else set()
    places = {b: v for b, v in places.items() if b not in touched} | dict.fromkeys(full, now)
    manifest = spark.createDataFrame([(batch, b, v) for b, v in sorted(places.items())] or [(batch, None, None)], "batch long, bucket int, place int")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/version={now}")
    discard(*[t for t in (rows, gone) if t is not None])
    _forget(spark, folder, now)


def _forget(spark: SparkSession, folder: str, now: int) -> None:
    """Delete what the last manifests do not name."""
    # At most BUCKETS rows for each manifest that is kept, and those of the one that goes.
    rows = _manifests(spark, folder).collect()
    kept = {r["place"] for r in rows if r["version"] > now - MANIFESTS}
    old = [r for r in rows if r["version"] <= now - MANIFESTS]
    for version in {r["version"] for r in old}:
        clear(spark, f"{folder}/manifest/version={version}")
    for place in {r["place"] for r in old} - kept - {None}:
        clear(spark, f"{folder}/data/version={place}")


def save_values(new: DataFrame, folder: str, deleted: DataFrame | None = None) -> None:
    """Keep values (key, value as JSON text): histories, lists, settings; new ones replace those of equal keys, and deleted keys go."""
    _, done, _ = _current(new.sparkSession, folder)
    fold(new.select("key", "value"), folder, done + 1, "key", deleted)


def load_values(spark: SparkSession, folder: str, keys: list[str] | None = None) -> DataFrame:
    """(key, value) of what is kept, or of some keys; none where nothing is kept."""
    if keys is None:
        only = None
    else:
        asked = spark.createDataFrame([(k,) for k in keys], "key string")
        only = [r[0] for r in asked.select(F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int")).distinct().collect()]
    found = stored_cache(spark, folder, only)
    if found is None:
        return spark.createDataFrame([], "key string, value string")
    return found.select("key", "value") if keys is None else found.where(F.col("key").isin(keys)).select("key", "value")


def save_history(entry: DataFrame, folder: str, name: str, cap: int = 5) -> None:
    """Put an entry (key, id, at, duration, ...) into the history of that name, by recent(); a history is one value, of at most cap entries."""
    kept = load_history(entry.sparkSession, folder, name, entry.schema)
    whole = recent(kept, entry, cap).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*entry.columns)))).alias("value"))
    save_values(whole.select(F.lit(name).alias("key"), "value"), folder)


def load_history(spark: SparkSession, folder: str, name: str, schema: StructType) -> DataFrame:
    """The entries of the history of that name, as rows of this schema, in no order."""
    rows = load_values(spark, folder, [name]).select(F.explode(F.from_json("value", ArrayType(schema))).alias("x"))
    return rows.select("x.*")


def keep_slot(cache: DataFrame, fast: bool, new_hash: Column) -> DataFrame:
    """cache with the mode's hash set and the other mode's kept."""
    return cache.withColumn("fast_phash" if fast else "phash", F.coalesce(new_hash, F.col("fast_phash" if fast else "phash")))


#: The columns of the cache of features, and its layout's number.
CACHE_COLUMNS = {"cache_key": "string", "size_bytes": "long", "mtime": "string", "content_hash": "string", "phash": "string", "fast_phash": "string", "header_hash": "string", "width": "int", "height": "int", "modified": "string", "blur_score": "double"}
LAYOUT = 5


def migrated(cache: DataFrame, layout: int) -> DataFrame:
    """cache in the present layout: columns that an older one lacks are null, sizes 0 and times empty; hashes from before layout 5 are dropped, as they were made otherwise."""
    empty = {"width": F.lit(0), "height": F.lit(0), "modified": F.lit("")}
    columns = []
    for name, kind in CACHE_COLUMNS.items():
        value = F.col(name) if name in cache.columns else F.lit(None)
        value = F.coalesce(value, empty[name]) if name in empty else value
        columns.append((F.lit(None) if layout < LAYOUT and name in ("phash", "fast_phash") else value).cast(kind).alias(name))
    return cache.select(*columns)


def stored_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """files and bytes of all that is below a folder; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("length")
    return rows.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def clear(spark: SparkSession, folder: str) -> bool:
    """Delete a cache's folder; whether there was one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def save_pairs(pairs: DataFrame, fingerprint: str, fast: bool, folder: str) -> None:
    """Keep the pairs of a set of hashes under its fingerprint and mode; saved again, they replace the former ones."""
    pairs.write.mode("overwrite").parquet(f"{folder}/{fingerprint}/{'fast' if fast else 'precise'}")


def load_pairs(spark: SparkSession, fingerprint: str, fast: bool, folder: str) -> DataFrame | None:
    """Pairs that were kept for this set and mode, else None."""
    place = f"{folder}/{fingerprint}/{'fast' if fast else 'precise'}"
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return spark.read.parquet(place) if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else None


def fingerprint(rows: DataFrame, by: list[str], group: list[str] | None = None) -> DataFrame:
    """A hash over the set of rows, one for each group, whatever their order.

    Rows are hashed each for itself and dealt by the first three digits of their hash;
    each of the 4,096 parts is hashed in the order of its rows' hashes, and so are the
    parts. So no task holds more than a part of a group, however large it is.
    """
    group = group or []
    line = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in by]))
    lines = rows.select(*group, line.alias("line"))
    parts = lines.groupBy(*group, F.substring("line", 1, 3).alias("part")).agg(F.md5(F.array_join(F.array_sort(F.collect_list("line")), "")).alias("digest"))
    whole = F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "digest"))), lambda x: x["digest"]), ""))
    return parts.groupBy(*group).agg(whole.alias("fingerprint"))


def recent(history: DataFrame, entry: DataFrame, cap: int = 5) -> DataFrame:
    """history (key, id, at, duration, ...) after an entry, the newest first, `cap` of them.

    An entry of a known key replaces that, but keeps its id, its time and, if it has
    one, its duration: they tell of the first run. So it keeps its place too; a new key
    comes first, and the oldest goes. Both tables have each key once.
    """
    old = history.select("key", *[F.col(c).alias(f"_{c}") for c in ("id", "at", "duration")])
    kept = [F.coalesce(f"_{c}", c).alias(c) if c in ("id", "at", "duration") else F.col(c) for c in history.columns]
    new = entry.join(old, "key", "left").select(*kept)
    rest = history.join(entry.select("key"), "key", "left_anti")
    return rest.unionByName(new).orderBy(F.desc("at"), "key").limit(cap)


def cached_result(results: DataFrame, key: str, fingerprint: str, version: int | None = None) -> DataFrame:
    """The entry of results (key, fingerprint, rows, version) that may stand for a new run: same key and fingerprint, not empty, and of this version if one is asked for."""
    found = results.where((F.col("key") == key) & (F.col("fingerprint") == fingerprint) & (F.col("rows") > 0))
    return found if version is None else found.where(F.col("version") == version)


def place_cache_stats(names: DataFrame) -> DataFrame:
    """entries and bytes, as one JSON object, of a cache (geo_cell, name)."""
    pair = F.octet_length(F.to_json(F.create_map("geo_cell", F.coalesce("name", F.lit(""))))) - 2
    n = F.count("*")
    return names.agg(n.alias("entries"), (F.coalesce(F.sum(pair), F.lit(0)) + F.greatest(n - 1, F.lit(0)) + 2).alias("bytes"))


def failed_files(results: DataFrame) -> DataFrame:
    """(path, kind) of rows (path, errno, perhaps error) that failed: the system's number of the error says the kind, where there is none the error's text; null in both is no failure. What says nothing is an IO_ERROR."""
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    number, text = F.col("errno"), F.upper("error") if "error" in results.columns else F.lit(None).cast("string")
    told = F.coalesce(*[F.when(text.rlike(pattern), F.lit(name)) for name, pattern in ERROR_TEXTS.items()])
    kind = F.when(number.isNotNull(), F.try_element_at(kinds, number.cast("int"))).otherwise(told)
    return results.where(number.isNotNull() | text.isNotNull()).select("path", F.coalesce(kind, F.lit("IO_ERROR")).alias("kind"))


def patch(rows: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with the updates' non-null values."""
    new = updates.select(key, *[F.col(c).alias(f"new_{c}") for c in columns])
    joined = rows.join(new, key, "left")
    return joined.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def folder_status(folders: DataFrame) -> DataFrame:
    """Per history key: ok, missing (its only folder is) or partial, from rows (key, folder, there)."""
    missing = F.count_if(~F.col("there"))
    return folders.groupBy("key").agg(F.when(missing == 0, "ok").when(F.count("*") == 1, "missing").otherwise("partial").alias("status"))
