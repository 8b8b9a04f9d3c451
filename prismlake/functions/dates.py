"""Dates from tags and names. Dates are texts `yyyy:MM:dd HH:mm:ss` of local wall time and are never moved between zones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE_FORMAT = "yyyy:MM:dd HH:mm:ss"
FIRST_YEAR, LAST_YEAR = 1900, 2100


def timestamp_tag(name_stem: Column) -> Column:
    """The leftmost eight digits, underscore, six digits of a stem; not validated."""
    return F.nullif(F.regexp_extract(name_stem, r"([0-9]{8}_[0-9]{6})", 1), F.lit(""))


def valid_date(text: Column, pattern: str) -> Column:
    """The date of a text in a pattern as DATE_FORMAT; null if it is none or its year is out of range."""
    at = F.try_to_timestamp(text, F.lit(pattern))
    return F.when(F.year(at).between(FIRST_YEAR, LAST_YEAR), F.date_format(at, DATE_FORMAT))


def parse_exif_date(text: Column) -> Column:
    """Tag dates: `Y:m:d H:M:S` up to a + or Z, or plain `Y-m-dTH:M:S`; zeros are none, and so is any other rest."""
    trimmed = F.trim(text)
    plain = F.trim(F.regexp_extract(trimmed, r"^([^+Z]*)", 1))
    colons = F.when(plain.rlike(r"^[0-9]{4}:[0-9]{1,2}:[0-9]{1,2} [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}$"), plain)
    dashes = F.when(trimmed.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}T[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}$"), trimmed)
    found = F.coalesce(valid_date(colons, "yyyy:M:d H:m:s"), valid_date(dashes, "yyyy-M-d'T'H:m:s"))
    return F.when(~trimmed.startswith("0000"), found)


def file_date(text: Column) -> Column:
    """A file's own time tag: its first 19 signs as a date of any year."""
    first = F.substring(text, 1, 19)
    at = F.try_to_timestamp(F.when(first.rlike(r"^[0-9]{4}:[0-9]{1,2}:[0-9]{1,2} [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}$"), first), F.lit("yyyy:M:d H:m:s"))
    return F.date_format(at, DATE_FORMAT)


def oldest_of(*texts: Column) -> Column:
    """The least of tag dates, nulls aside."""
    return F.least(*[parse_exif_date(t) for t in texts])


def _first_valid(name: Column, lookahead: str, pattern: str, keep: str | None = None) -> Column:
    """The first match at any place, overlaps included, that is a date."""
    found = F.regexp_extract_all(name, F.lit(f"(?=({lookahead}))" + (keep or "")), F.lit(1))
    return F.get(F.filter(F.transform(found, lambda t: valid_date(t, pattern)), lambda d: d.isNotNull()), F.lit(0))


def dashed_datetime(name: Column) -> Column:
    return _first_valid(name, "[0-9]{4}-[0-9]{2}-[0-9]{2}-[0-9]{2}-[0-9]{2}-[0-9]{2}", "yyyy-MM-dd-HH-mm-ss")


def compact_datetime(name: Column) -> Column:
    return _first_valid(name, "[0-9]{8}_[0-9]{6}", "yyyyMMdd_HHmmss")


def compact_without_seconds(name: Column) -> Column:
    """Eight digits, underscore, four, unless two more digits follow."""
    return _first_valid(name, "[0-9]{8}_[0-9]{4}", "yyyyMMdd_HHmm", keep="(?![0-9]{8}_[0-9]{4}[0-9]{2})")


def filename_date(name: Column) -> Column:
    return F.coalesce(dashed_datetime(name), compact_datetime(name), compact_without_seconds(name))


def img_date_key(name: Column) -> Column:
    """Eight digits after the first IMG_, if an underscore follows."""
    return F.nullif(F.regexp_extract(F.upper(name), r"(?s)^(?:(?!IMG_).)*IMG_([0-9]{8})_", 1), F.lit(""))


def messenger_date_key(name: Column) -> Column:
    """Eight digits between a dash and -WA."""
    return F.nullif(F.regexp_extract(F.upper(name), r"-([0-9]{8})-WA", 1), F.lit(""))


def key_date(key: Column, counter: Column) -> Column:
    """A key's date at the counter's minute of the day."""
    minute = F.pmod(counter, F.lit(1440))
    time = F.concat(F.lpad(F.floor(minute / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((minute % 60).cast("string"), 2, "0"), F.lit(":00"))
    return F.concat(F.substring(key, 1, 4), F.lit(":"), F.substring(key, 5, 2), F.lit(":"), F.substring(key, 7, 2), F.lit(" "), time)


def override_year(date: Column, year: int) -> Column:
    """Dates of 2025 get the year given; others stay."""
    return F.when(date.startswith("2025"), F.concat(F.lit(str(year)), F.substring(date, 5, 100))).otherwise(date)


def exif_to_iso(text: Column) -> Column:
    """`Y:m:d H...` with dashes and a T; other texts stay."""
    return F.regexp_replace(text, r"^(.{4}):(..):(..) (.{8,})$", "$1-$2-$3T$4")


def iso_to_exif(text: Column) -> Column:
    """`Y-m-dTH:M:S`, zone marks Z and what follows the seconds cut; other texts stay."""
    plain = F.regexp_replace(text, r"Z+$", "")
    return F.regexp_replace(plain, r"^(.{4})-(..).(..).(.{8}).*$", "$1:$2:$3 $4")


def capture_date(tag: Column, embedded: Column, modified: Column) -> Column:
    """When a picture was taken: its name's timestamp tag, its embedded date, or the file's time."""
    own = F.regexp_replace(tag, r"^(....)(..)(..)_(..)(..)(..)$", "$1-$2-$3T$4:$5:$6Z")
    return F.coalesce(own, embedded, modified)


def listed_date(name: Column, original: Column, created: Column, modified: Column, priority: str = "exif") -> Column:
    """(date, source) of a media list by priority: tags (exif or create), then the file's time, then the name; or the name first. Null if none."""
    tags = F.struct(F.coalesce(original, created).alias("date"), F.when(original.isNotNull(), "exif").otherwise("create").alias("source"))
    choices = {"tags": tags, "modify": F.struct(modified.alias("date"), F.lit("modify").alias("source")), "name": F.struct(filename_date(name).alias("date"), F.lit("filename").alias("source"))}
    order = ["name", "tags", "modify"] if priority == "filename" else ["tags", "modify", "name"]
    return F.coalesce(*[F.when(choices[n]["date"].isNotNull(), choices[n]) for n in order])


def datetime_local(text: Column) -> Column:
    """An ISO date for an input field: to the second, seconds added where there are none; empty for none."""
    plain = F.regexp_replace(text, "^([^Z]*)Z", "$1")
    return F.when(F.coalesce(text, F.lit("")) == "", "").when(F.length(plain) >= 19, F.substring(plain, 1, 19)).otherwise(F.concat(F.substring(plain, 1, 16), F.lit(":00")))


def datetime_local_to_iso(value: Column) -> Column:
    """An input field's date with seconds; null for none."""
    return F.when(F.length(value) == 16, F.concat(value, F.lit(":00"))).when(value != "", value)


def modified_text(at: Column) -> Column:
    """A file time as text with its offset, seconds only."""
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def format_date(text: Column) -> Column:
    """Day first; null for dates of 1970, which stand for none, and for texts that begin with no date."""
    pattern = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})T([0-9]{2}:[0-9]{2}:[0-9]{2})"
    part = lambda i: F.regexp_extract(text, pattern, i)
    return F.when(text.rlike(pattern) & ~text.startswith("1970"), F.concat(part(3), F.lit("/"), part(2), F.lit("/"), part(1), F.lit(" "), part(4)))


def format_duration(ms: Column) -> Column:
    """Milliseconds for people: seconds, minutes and seconds, hours and minutes, zero parts left out; -1 is cancelled, less than 500 is null."""
    s = F.floor(F.round(ms / F.lit(1000.0))).cast("long")
    text = lambda n, unit: F.concat(F.floor(n).cast("string"), F.lit(unit))
    rest = lambda n, unit: F.when(n > 0, F.concat(F.lit(" "), text(n, unit))).otherwise("")
    minutes = F.concat(text(s / 60, "m"), rest(s % 60, "s"))
    hours = F.concat(text(s / 3600, "h"), rest(F.floor(s % 3600 / 60), "m"))
    return F.when(ms == -1, "cancelled").when(ms < 500, F.lit(None)).when(s < 60, text(s, "s")).when(s < 3600, minutes).otherwise(hours)
