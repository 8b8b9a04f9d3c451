"""Files as rows: listings, contents, pictures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismlake.functions import dates, paths
from prismlake.functions.imaging import exif, picture_features, thumbnail
from prismlake.sources.heads import file_heads


def _plain(path: str) -> Column:
    return F.regexp_replace(path, "^file:/+", "/")


def list_files(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(path, size_bytes, modified) of all files below folders, each once; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folders).select("path", "length", "modificationTime")
    return rows.select(_plain("path").alias("path"), F.col("length").alias("size_bytes"), dates.modified_text(F.col("modificationTime")).alias("modified")).dropDuplicates(["path"])


def collect_images(spark: SparkSession, folders: list[str]) -> DataFrame:
    return list_files(spark, folders).where(paths.is_image(F.col("path")))


def collect_media(spark: SparkSession, folders: list[str]) -> DataFrame:
    """Pictures and films, with file_kind."""
    return list_files(spark, folders).withColumn("file_kind", paths.media_kind(F.col("path"))).where("file_kind is not null")


def in_given_order(listing: DataFrame, chosen: DataFrame) -> DataFrame:
    """Listed files that were chosen (ord, path), a chosen folder standing for what is below it; each keeps its first place."""
    files = listing.alias("f").join(chosen.alias("c"), F.col("f.path") == F.col("c.path")).select("c.ord", "f.*")
    parents = listing.withColumn("_parts", F.split("path", "/")).withColumn("_n", F.explode(F.sequence(F.lit(1), F.size("_parts") - 1)))
    below = parents.withColumn("_dir", F.array_join(F.slice("_parts", F.lit(1), F.col("_n")), "/")).join(chosen.select(F.col("path").alias("_dir"), "ord"), "_dir")
    both = files.unionByName(below.select("ord", *listing.columns))
    return both.groupBy(*listing.columns).agg(F.min("ord").alias("ord")).orderBy("ord", F.split("path", "/"))


def scan(spark: SparkSession, folders: list[str], hashed: bool = True) -> DataFrame:
    """file_heads() of pictures, each once: what could be read, and of what could not its path, kind and error."""
    return file_heads(spark, folders, extensions=[f".{e}" for e in paths.IMAGE_EXTENSIONS], hashed=hashed).where(paths.is_image(F.col("path")) | F.col("kind").isNotNull()).dropDuplicates(["path"])


def failed(scanned: DataFrame) -> DataFrame:
    """(path, kind) of a scan's rows that could not be read."""
    return scanned.where("kind is not null").select("path", "kind")


def corrections(scanned: DataFrame) -> DataFrame:
    """(path, width, height, date_taken) of HEIC and its like, by their boxes: what late corrections say, without a converter."""
    return scanned.where(paths.is_heic(F.col("path")) & F.col("kind").isNull()).select("path", "width", "height", "date_taken")


def features(spark: SparkSession, folders: list[str], decode: bool = True) -> DataFrame:
    """Records of pictures: sizes, hashes of content and header, name tags, dates, and, with decode, phash and blur_score.

    Files that cannot be read are left out; failed() of a scan() has them. Contents are
    read once for hashes and headers, and once more by the image source, which decodes
    what the JVM knows (JPEG, PNG, GIF, BMP); others have null hashes. modified is the
    name's date, else the embedded one, else the file's time.
    """
    scanned = scan(spark, folders).where("kind is null").withColumn("ts_tag", dates.timestamp_tag(paths.stem(F.col("path"))))
    found = scanned.select(
        "path", "size_bytes", "content_hash", "header_hash", "ts_tag",
        dates.capture_date(F.col("ts_tag"), F.col("date_taken"), F.col("mtime")).alias("modified"), "mtime", "date_taken", "orientation", "width", "height",
    )
    if not decode:
        return found
    seen = _pictures(spark, folders).select("path", picture_features(F.col("image")).alias("_seen")).dropDuplicates(["path"])
    return found.join(seen, "path", "left").select(*found.columns, "_seen.*")


def _pictures(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(path, image) of what the image source decodes; files that vanish or break meanwhile are passed by."""
    options = {"recursiveFileLookup": "true", "dropInvalid": "true", "ignoreMissingFiles": "true", "ignoreCorruptFiles": "true"}
    return spark.read.format("image").options(**options).load(folders).select(_plain("image.origin").alias("path"), "image")


def header_hashes(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(path, header_hash) of pictures; of each file its first 4 KiB are read."""
    rows = file_heads(spark, folders, extensions=[f".{e}" for e in paths.IMAGE_EXTENSIONS], facts=False)
    return rows.where("kind is null").select("path", "header_hash").dropDuplicates(["path"])


def paths_exist(chosen: DataFrame, listing: DataFrame) -> DataFrame:
    """chosen (path) with `there`."""
    seen = listing.select("path").distinct().withColumn("there", F.lit(True))
    return chosen.join(seen, "path", "left").withColumn("there", F.coalesce("there", F.lit(False)))


def thumbnails(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(path, key, uri): small upright pictures as data URIs, in PNG; key is the first 16 digits of the content's hash, under which a cache may keep them. Pictures that cannot be decoded have none."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folders).select(_plain("path").alias("path"), "content")
    known = rows.where(paths.is_image(F.col("path"))).select("path", F.substring(F.sha2("content", 256), 1, 16).alias("key"), exif(F.col("content"))["orientation"].alias("orientation"))
    made = _pictures(spark, folders).join(known, "path").select("path", "key", thumbnail(F.col("image"), F.col("orientation")).alias("png"))
    return made.select("path", "key", paths.data_uri(F.lit("image/png"), F.col("png")).alias("uri"))


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """(tags): the objects of JSON files as a tag reader writes them, each file an array or a line an object; each as its own text."""
    texts = spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")
    arrays = texts.where(F.trim("text").startswith("[")).select(F.explode(F.from_json("text", "array<string>")).alias("tags"))
    lines = texts.where(~F.trim("text").startswith("[")).select(F.explode(F.split("text", "\n")).alias("tags"))
    return arrays.unionByName(lines.where(F.trim("tags") != ""))
