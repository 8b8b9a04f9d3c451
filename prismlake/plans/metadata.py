"""Metadata of pictures from their tags, one JSON object a file, as a tag reader gives them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismlake.functions import dates
from prismlake.functions.paths import extension, path_order
from prismlake.functions.values import first_number, join_device
from prismlake.operators.running import numbered
from prismlake.sources import media

# Tags of a picture that are shown as texts, by the fields' names.
TEXTS = {
    "make": "Make", "model": "Model", "software": "Software", "exposure_time": "ExposureTime", "f_number": "FNumber", "focal_length": "FocalLength", "flash": "Flash", "white_balance": "WhiteBalance", "exposure_mode": "ExposureMode",
    "exposure_program": "ExposureProgram", "metering_mode": "MeteringMode", "lens_make": "LensMake", "lens_model": "LensModel", "image_description": "ImageDescription", "artist": "Artist", "copyright": "Copyright",
}
NUMBERS = {"gps_latitude": "GPSLatitude", "gps_longitude": "GPSLongitude", "gps_altitude": "GPSAltitude"}
#: Formats whose sizes and dates a tag reader may get wrong; corrections replace them.
CORRECTED = ("heic", "heif", "avif")
# What an exposure panel shows, in its order.
EXPOSURE = {"Shutter": "exposure_time", "Aperture": "f_number", "ISO": "iso_speed", "Focal length": "focal_length", "Flash": "flash", "White balance": "white_balance", "Exp. mode": "exposure_mode", "Metering": "metering_mode"}


# All tags that a field is read from.
READ = ("FileSize", "ImageWidth", "ImageHeight", "ExifImageWidth", "ExifImageHeight", "FileTypeExtension", "DateTimeOriginal", "ModifyDate", "ISO", "Orientation", *NUMBERS.values(), *TEXTS.values())


def parsed(rows: DataFrame) -> DataFrame:
    """rows with `t`: the tags that are READ, as texts; each object is parsed once."""
    rest = [c for c in rows.columns if c != "tags"]
    texts = rows.select(*rest, F.json_tuple("tags", *READ).alias(*[f"_t{i}" for i in range(len(READ))]))
    return texts.select(*rest, F.struct(*[F.col(f"_t{i}").alias(name) for i, name in enumerate(READ)]).alias("t"))


def _text(tags: Column, name: str) -> Column:
    """A tag as trimmed text, empty is null."""
    return F.nullif(F.trim(tags[name]), F.lit(""))


def _number(tags: Column, name: str, kind: str = "double") -> Column:
    return first_number(tags[name], kind)


def _side(tags: Column, name: str) -> Column:
    return F.coalesce(_number(tags, f"Image{name}", "long"), _number(tags, f"ExifImage{name}", "long"), F.lit(0)).cast("int")


def by_source(tags: DataFrame) -> DataFrame:
    """(source_file, tags) of tag objects, each file once, separators as slashes; objects without a SourceFile are none."""
    # By a generator, so that the test for null is not moved down to where tags are made, which would be worked out twice.
    named = tags.select("tags", F.json_tuple("tags", "SourceFile").alias("_source")).where("_source is not null")
    return named.select(F.replace("_source", F.lit("\\"), F.lit("/")).alias("source_file"), "tags").groupBy("source_file").agg(F.min("tags").alias("tags"))


def with_tags(assets: DataFrame, tags: DataFrame) -> DataFrame:
    """assets (path, ...) with their `tags`, null where there are none."""
    return assets.withColumn("_key", F.replace("path", F.lit("\\"), F.lit("/"))).join(by_source(tags).withColumnRenamed("source_file", "_key"), "_key", "left").drop("_key")


def _late(rows: DataFrame, corrections: DataFrame | None) -> DataFrame:
    """rows with late_width, late_height, late_date and `late` of files whose format is corrected."""
    if corrections is None:
        return rows.select("*", F.lit(0).alias("late_width"), F.lit(0).alias("late_height"), F.lit(None).cast("string").alias("late_date"), F.lit(False).alias("late"))
    known = corrections.select("path", F.col("width").alias("late_width"), F.col("height").alias("late_height"), F.col("date_taken").alias("late_date"), F.lit(True).alias("_late"))
    joined = rows.join(known, "path", "left")
    return joined.withColumn("late", F.coalesce("_late", F.lit(False)) & extension(F.col("path")).isin(*CORRECTED)).drop("_late")


def scan_for_metadata(assets: DataFrame, tags: DataFrame, corrections: DataFrame | None = None) -> DataFrame:
    """What a metadata view lists: path, size_bytes, width, height, modified, date_taken, position, device, place (by path).

    assets: path, size_bytes, modified; tags: JSON objects with a SourceFile;
    corrections: path, width, height, date_taken of HEIC and its like. A correction
    replaces the date, and the sizes if it has any; one that knows neither counts for
    nothing. Files without tags are listed with sizes of 0 and nulls.
    """
    rows = parsed(_late(with_tags(assets, tags), corrections))
    t, w = F.col("t"), F.col("late_width")
    known = F.col("late") & ((w > 0) | F.col("late_date").isNotNull())
    date = dates.exif_to_iso(_text(t, "DateTimeOriginal"))
    found = rows.select(
        "path", "size_bytes",
        F.when(known & (w > 0), w).otherwise(_side(t, "Width")).cast("int").alias("width"),
        F.when(known & (w > 0), F.col("late_height")).otherwise(_side(t, "Height")).cast("int").alias("height"),
        "modified",
        F.when(known, F.col("late_date")).otherwise(date).alias("date_taken"),
        *[_number(t, tag).alias(name) for name, tag in NUMBERS.items() if name != "gps_altitude"],
        join_device(_text(t, "Make"), _text(t, "Model")).alias("device"),
    )
    return numbered(found, [path_order(F.col("path"))], "place")


def scan_folders(spark: SparkSession, folders: list[str], tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scan_for_metadata() of the pictures below folders, what could not be read as path and kind). Sizes and dates of HEIC and its like come from their own boxes; no content is read whole."""
    scanned = media.scan(spark, folders, hashed=False)
    good = scanned.where("kind is null").select("path", "size_bytes", F.col("mtime").alias("modified"))
    return scan_for_metadata(good, tags, media.corrections(scanned)), media.failed(scanned)


def read_metadata(assets: DataFrame, tags: DataFrame, corrections: DataFrame | None = None) -> DataFrame:
    """All fields of each file (path, size_bytes): sizes, format, dates, device, exposure, lens, position, texts, orientation.

    Texts are trimmed, empty ones null; numbers may be texts with a unit. Corrections
    (path, width, height, date_taken) of HEIC and its like replace the date even by
    null, and the sizes if they have any.
    """
    rows = parsed(_late(with_tags(assets, tags), corrections))
    t, w = F.col("t"), F.col("late_width")
    iso = lambda name: dates.exif_to_iso(_text(t, name))
    return rows.select(
        "path",
        F.coalesce(_number(t, "FileSize", "long"), F.col("size_bytes"), F.lit(0)).alias("file_size"),
        F.when(F.col("late") & (w > 0), w).otherwise(_side(t, "Width")).cast("int").alias("width"),
        F.when(F.col("late") & (w > 0), F.col("late_height")).otherwise(_side(t, "Height")).cast("int").alias("height"),
        F.upper(F.coalesce(_text(t, "FileTypeExtension"), extension(F.col("path")))).alias("format"),
        F.when(F.col("late"), F.col("late_date")).otherwise(iso("DateTimeOriginal")).alias("date_time_original"),
        iso("ModifyDate").alias("date_time"),
        _number(t, "ISO", "long").cast("int").alias("iso_speed"),
        _number(t, "Orientation", "long").cast("int").alias("orientation"),
        *[_number(t, tag).alias(name) for name, tag in NUMBERS.items()],
        *[_text(t, tag).alias(name) for name, tag in TEXTS.items()],
    )


def exposure_rows(metadata: DataFrame) -> DataFrame:
    """(path, label, value): the exposure fields that a file has, as a panel lists them."""
    rows = F.array(*[F.struct(F.lit(label).alias("label"), F.col(name).cast("string").alias("value")) for label, name in EXPOSURE.items()])
    return metadata.select("path", F.explode(rows).alias("r")).where("r.value is not null and r.value not in ('', '0')").select("path", "r.label", "r.value")
