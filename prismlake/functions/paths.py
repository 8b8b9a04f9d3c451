"""Column functions over paths and file names."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions.
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "webp", "bmp", "gif", "tiff", "tif", "heic", "heif", "avif"]
ORGANIZER_IMAGE_EXTENSIONS = [*IMAGE_EXTENSIONS, "cr2", "dng"]
VIDEO_EXTENSIONS = ["mp4", "mov", "avi", "mpg", "mpeg", "mkv"]
HEIC_EXTENSIONS = ["heic", "heif"]


def file_name(path: Column) -> Column:
    """What follows the last / or backslash."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def folder_path(path: Column) -> Column:
    """What precedes the last / or backslash; empty without one."""
    return F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1)


def display_extension(path: Column) -> Column:
    """What follows the last dot of the path, lower case; the whole path without a dot."""
    return F.lower(F.regexp_extract(path, r"([^.]*)$", 1))


def extension(path: Column) -> Column:
    """The file name's extension in lower case, empty if it has none; a name's leading dot begins no extension."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1))


def stem(path: Column) -> Column:
    """The file name without its last extension; dot files keep their name."""
    return F.regexp_replace(file_name(path), r"^(.+)\.[^.]*$", "$1")


def normal_extension(ext: Column) -> Column:
    return F.when(F.lower(ext) == "jpeg", F.lit("jpg")).otherwise(F.lower(ext))


def is_image(path: Column) -> Column:
    return extension(path).isin(IMAGE_EXTENSIONS)


def is_heic(path: Column) -> Column:
    return extension(path).isin(HEIC_EXTENSIONS)


def media_kind(path: Column) -> Column:
    """video, image or null, by the organizer's wider lists."""
    ext = extension(path)
    return F.when(ext.isin(VIDEO_EXTENSIONS), "video").when(ext.isin(ORGANIZER_IMAGE_EXTENSIONS), "image")


def path_order(path: Column) -> Column:
    """Sort key that compares paths component by component."""
    return F.split(path, "/")


def short_path(path: Column) -> Column:
    """First and last three parts of a path of more than four, with its own separators; a network path keeps its two leading ones."""
    parts = F.filter(F.split(path, r"[/\\]"), lambda p: p != "")
    sep = F.when(path.contains("\\"), "\\").otherwise("/")
    lead = F.when(path.startswith("\\\\") | path.startswith("//"), F.concat(sep, sep)).otherwise("")
    shown = F.concat(lead, F.get(parts, F.lit(0)), sep, F.lit("…"), sep, F.array_join(F.zip_with(F.slice(parts, -3, 3), F.array(F.lit(""), sep, sep), lambda p, s: F.concat(s, p)), ""))
    return F.when(F.size(parts) <= 4, path).otherwise(shown)


def is_canonical_name(name_stem: Column) -> Column:
    return name_stem.rlike(r"^IMG_[0-9]{8}_[0-9]{6}_[A-Za-z0-9]{4}$")


def is_copy_name(name_stem: Column) -> Column:
    """Names that do not look like originals."""
    low = F.lower(name_stem)
    return low.contains("copy") | low.contains("copia") | ~is_canonical_name(name_stem)


def glob_match(name_stem: Column, pattern: str) -> Column:
    """* any run, ? any one sign, case ignored, over the whole stem."""
    special = set(r"\.[]{}()+-^$|&~#")
    regex = "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if c in special else c for c in pattern.lower())
    return F.lower(name_stem).rlike(f"(?s)^{regex}$")


def under_root(path: Column, roots: list[str]) -> Column:
    """Whether a path begins with any root."""
    return F.exists(F.array(*[F.lit(r) for r in roots]).cast("array<string>"), lambda r: path.startswith(r))


def cache_key(path: Column) -> Column:
    """NFC and lower case."""

    @F.pandas_udf("string")
    def nfc(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v).lower())

    ascii_only = ~path.rlike(r"[^\x00-\x7F]")
    return F.when(ascii_only, F.lower(path)).otherwise(nfc(path))


def format_size(size: Column) -> Column:
    """B below 1024, else KB or MB with one decimal."""
    mb = size / F.lit(1048576.0)
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1048576, F.format_string("%.1f KB", size / F.lit(1024.0))).otherwise(F.format_string("%.1f MB", mb))


def data_uri(mime: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content))


def mime_type(path: Column) -> Column:
    ext = extension(path)
    return F.when(ext.isin("jpg", "jpeg"), "image/jpeg").when(ext.isin("tif", "tiff"), "image/tiff").otherwise(F.concat(F.lit("image/"), ext))


def history_key(folders: Column, *extra: Column) -> Column:
    """Folders sorted and joined by |, then the parameters after @@."""
    return F.concat_ws("@@", F.array_join(F.sort_array(folders), "|"), *[e.cast("string") for e in extra])
