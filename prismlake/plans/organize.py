"""Rename and move plans: best dates, templates, counters, reserved names."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismlake.functions import dates
from prismlake.functions.paths import VIDEO_EXTENSIONS, extension, file_name, media_kind, normal_extension
from prismlake.functions.values import MIXED, device_of, fixed_text, join_device, parse_pair, split_device
from prismlake.operators.running import numbered, running_before
from prismlake.session import durable

# Names of months, signs that paths may not hold, default templates, tags.
MONTHS = ["ENERO", "FEBRERO", "MARZO", "ABRIL", "MAYO", "JUNIO", "JULIO", "AGOSTO", "SEPTIEMBRE", "OCTUBRE", "NOVIEMBRE", "DICIEMBRE"]
RESERVED_SIGNS = '\\:*?"<>|'
DEFAULT_RENAME = "{type}_{date}_{time}_{4hex_uid}"
DEFAULT_FOLDER = "{year}/{device}/{month_dir}"
DATE_TAGS = ("DateTimeOriginal", "CreateDate", "DateTimeDigitized")
TEXT_TAGS = {"description": ("ImageDescription", "XMP:Description"), "artist": ("Artist", "XMP:Creator"), "copyright": ("Copyright", "XMP:Rights")}
DEVICE_TAGS = ("All:Make", "All:Model", "IFD0:Make", "IFD0:Model", "IFD1:Make", "IFD1:Model", "EXIF:Make", "EXIF:Model", "XMP:Make", "XMP:Model", "XMP-tiff:Make", "XMP-tiff:Model", "UserData:Make", "UserData:Model", "Keys:Make", "Keys:Model")
#: Names that a file is tried under.
ATTEMPTS = 16


@dataclass(frozen=True)
class OrganizerConfig:
    """How files are renamed and where they go; `now` stands for the time of the run (MM:dd HH:mm:ss)."""

    only_rename: bool = False
    date_priority: str = "exif"
    override_year: bool = False
    year_if_not_date: int = 2024
    output_directory: str | None = "/out"
    rename_template: str = DEFAULT_RENAME
    folder_template: str = DEFAULT_FOLDER
    device_aliases: dict[str, str] = field(default_factory=dict)
    now: str = "01:01 00:00:00"


def resolve_dates(files: DataFrame, config: OrganizerConfig) -> DataFrame:
    """files (ord, path, original, created, media_created, file_modified) with date_used and date_source.

    By the priority exif: the tags' oldest, the file's own time, then a full date in the
    name; by filename the name first. Then a date without seconds in the name and the
    day keys in names, each with a minute of its own by order among the rows that get
    so far; all these count as filename. Last the fallback year at the run's time.
    What names and tags say is worked out once, written, and only rows with a day key
    are ranked, by ranges, so a day that many rows share is no single task.
    """
    name = file_name(F.col("path"))
    tags = dates.oldest_of(F.col("original"), F.col("created"), F.col("media_created"))
    own = F.coalesce(dates.dashed_datetime(name), dates.compact_datetime(name))
    # A text of the source's first letter and the date, null where there is none: later ones are worked out only where earlier ones are null.
    choice = lambda date, source: F.concat(F.lit(source[0]), date)
    named, modified = choice(own, "filename"), choice(dates.file_date(F.col("file_modified")), "modify")
    order = [choice(tags, "exif"), modified, named] if config.date_priority == "exif" else [named, choice(tags, "exif"), modified]
    order.append(choice(dates.compact_without_seconds(name), "filename"))
    columns = files.columns
    found = files.withColumn("_found", F.coalesce(*order))
    key = F.coalesce(dates.img_date_key(name), dates.messenger_date_key(name))
    found = durable(found.withColumn("_key", F.when(F.col("_found").isNull(), key)))
    keyed = running_before(found.where("_key is not null"), ["_key"], [F.col("ord")], F.lit(1), "_n")
    whole = keyed.select(*found.columns, F.col("_n").cast("long").alias("_n")).unionByName(found.where("_key is null").withColumn("_n", F.lit(0).cast("long")))
    fallback = F.lit(f"{config.year_if_not_date:04d}:{config.now}")
    used = F.coalesce(F.substring("_found", 2, 100), F.when(F.col("_key").isNotNull(), dates.key_date(F.col("_key"), F.col("_n"))))
    used = F.coalesce(dates.override_year(used, config.year_if_not_date) if config.override_year else used, fallback)
    told = F.substring("_found", 1, 1)
    source = F.coalesce(F.when(told == "e", "exif").when(told == "m", "modify").when(told == "f", "filename"), F.when(F.col("_key").isNotNull(), "filename"), F.lit("fallback"))
    return whole.select(*columns, used.alias("date_used"), source.alias("date_source"))


_TOKEN = re.compile(r"(\{[^{}]*\})")
_HEX = re.compile(r"\{([0-9]*)hex_uid\}")
_CRYPTO = re.compile(r"\{([0-9]+)crypto_uid\}")
#: Numbers of digits in templates that are too large to be read count as this.
UNREAD, LARGEST = 4, 2**64


def _digits(text: str, most: int) -> int:
    n = int(text) if text else UNREAD
    return min(max(n if n < LARGEST else UNREAD, 1), most)


def uid_tokens(template: str) -> int:
    """How many counted numbers a name by this template takes."""
    return len(_HEX.findall(template or DEFAULT_RENAME))


def rename(template: str, date: Column, kind: Column, uid: Column) -> Column:
    """A template's stem in capitals; null without a full date. uid is the first of its numbers; each further token takes the next."""
    parts = {"{type}": F.when(kind == "video", "VID").otherwise("IMG"), "{date}": F.translate(F.substring(date, 1, 10), ":", ""), "{time}": F.translate(F.substring(date, 12, 8), ":", "")}
    parts |= {"{" + n + "}": F.substring(date, i, k) for n, i, k in (("year", 1, 4), ("month", 6, 2), ("day", 9, 2), ("hour", 12, 2), ("min", 15, 2), ("sec", 18, 2))}
    pieces: list[Column] = []
    taken = 0
    for text in _TOKEN.split(template or DEFAULT_RENAME):
        if text in parts:
            pieces.append(parts[text])
        elif m := _HEX.fullmatch(text):
            width, digits = _digits(m[1], 32), F.hex(uid + F.lit(taken))
            pieces.append(F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0")))
            taken += 1
        elif m := _CRYPTO.fullmatch(text):
            pieces.append(F.upper(F.randstr(_digits(m[1], 64))))
        elif text:
            pieces.append(F.lit(text))
    return F.when(F.length(date) >= 19, F.upper(F.concat(*pieces)))


def folder(config: OrganizerConfig, date: Column, device: Column) -> Column:
    """The target folder; blank segments go, others are trimmed; null without an output directory or a month."""
    if not config.output_directory:
        return F.lit(None).cast("string")
    number = F.substring(date, 6, 2).try_cast("int")
    month = F.lpad(number.cast("string"), 2, "0")
    name = F.get(F.array(*[F.lit(m) for m in MONTHS]), number - 1)
    safe = F.translate(device, RESERVED_SIGNS, "_" * len(RESERVED_SIGNS))
    text: Column = F.lit(config.folder_template or DEFAULT_FOLDER)
    for token, value in {"year": F.substring(date, 1, 4), "month": month, "month_name": name, "month_dir": F.concat(month, F.lit(" - "), name), "device": safe, "day": F.substring(date, 9, 2)}.items():
        text = F.replace(text, F.lit("{" + token + "}"), value)
    parts = F.filter(F.transform(F.split(F.upper(text), "/"), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(number.between(1, 12), F.concat_ws("/", F.lit(config.output_directory), F.array_join(parts, "/")))


def resolve_device(files: DataFrame, config: OrganizerConfig) -> Column:
    """A file's device: the alias of its make and model, either alone if the other is blank, else what device_of() says."""
    raw = device_of(F.col("model"), F.col("product"), F.col("android"), file_name(F.col("path")))
    if not config.device_aliases:
        return raw
    wanted = F.lower(join_device(F.col("make"), F.col("model")))
    aliases: dict[str, str] = {}
    for name, alias in config.device_aliases.items():
        aliases.setdefault(name.lower(), alias)
    chosen = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(chosen, wanted), raw)


def plan_organize(files: DataFrame, config: OrganizerConfig, existing: DataFrame | None = None) -> DataFrame:
    """One row per file that gets a name: ord, original_path, new_filename, new_path, date_used, date_source, device, file_kind.

    files: ord, path, original, created, media_created, file_modified, make, model,
    product, android. Names count up in input order. A target that exists already
    (existing: path) or that an earlier file has taken is tried again, ATTEMPTS times in
    all; each try takes the next numbers, so those of all later files move on. A file
    without a free name has no row, but its tries count too. Names without numbers stay
    as they are, so of equal targets the first file keeps it. Without an output
    directory or a month a file's new path is its name alone.

    Files do not wait for one another: all are numbered by running sums over the tries
    that each took, and named; where a name is taken the tries change, and all are
    numbered again until nothing does. Each round settles one more file that has to try
    again at least; mostly few rounds are enough, as numbers that have moved are free.
    Random tokens have no such order: files whose names are taken draw again after all others.
    """
    return plan_dated(dated_files(files, config), config, existing)


def dated_files(files: DataFrame, config: OrganizerConfig) -> DataFrame:
    """What a plan needs of files (as plan_organize() takes them), written: ord, path, date_used, date_source, device, file_kind of those that can be named. For several plans of the same files."""
    dated = resolve_dates(files, config).withColumn("file_kind", media_kind(F.col("path"))).where("file_kind is not null").where(F.length("date_used") >= 19)
    return durable(dated.select("ord", "path", "date_used", "date_source", resolve_device(files, config).alias("device"), "file_kind"))


def plan_dated(rows: DataFrame, config: OrganizerConfig, existing: DataFrame | None = None) -> DataFrame:
    """plan_organize() of dated_files()."""
    step = uid_tokens(config.rename_template)
    base = F.regexp_extract("path", r"^(.*)[/\\][^/\\]*$", 1)
    target = base if config.only_rename else folder(config, F.col("date_used"), F.col("device"))
    output = ["ord", F.col("path").alias("original_path"), "new_filename", "new_path", "date_used", "date_source", "device", "file_kind"]
    random = bool(_CRYPTO.search(config.rename_template or ""))

    def numbered_by(rows: DataFrame, each: Column, written: bool = False) -> DataFrame:
        # One counter over all files, by distributed ranks.
        counted = running_before(rows.withColumn("_all", F.lit(0)), ["_all"], [F.col("ord")], each, "_uid", written).drop("_all")
        return counted.withColumn("_uid", F.col("_uid").cast("long"))

    def placed(rows: DataFrame) -> DataFrame:
        stem = rename(config.rename_template, F.col("date_used"), F.col("file_kind"), F.col("_uid"))
        named = rows.withColumn("new_filename", F.concat(stem, F.lit("."), normal_extension(extension(F.col("path")))))
        return named.withColumn("new_path", F.when(target.isNotNull(), F.concat_ws("/", target, "new_filename")).otherwise(F.col("new_filename")))

    def first_of_each(rows: DataFrame) -> DataFrame:
        return rows.join(rows.groupBy("new_path").agg(F.min("ord").alias("ord")), ["new_path", "ord"], "left_semi")

    there = None if existing is None else existing.select(F.col("path").alias("new_path")).distinct()
    if random or not step:
        # Written, as names may be random and are read more than once.
        tried = durable(placed(numbered_by(rows, F.lit(step), True)))
        free = tried if there is None else tried.join(there, "new_path", "left_anti")
        done = durable(first_of_each(free))
        left = tried.join(done.select("ord"), "ord", "left_anti")
        if not random or left.isEmpty():
            return done.select(*output)
        most = tried.agg(F.max("_uid")).first()[0]
        again = numbered_by(left.drop("_uid", "new_filename", "new_path"), F.lit(step * (ATTEMPTS - 1)))
        again = again.withColumn("_try", F.explode(F.sequence(F.lit(0), F.lit(ATTEMPTS - 2)))).withColumn("_uid", F.col("_uid") + most + step + F.col("_try") * step)
        further = durable(placed(again)).join(done.select("new_path"), "new_path", "left_anti")
        further = durable(further if there is None else further.join(there, "new_path", "left_anti"))
        found = durable(further.join(further.groupBy("ord").agg(F.min("_try").alias("_try")), ["ord", "_try"], "left_semi"))
        return done.select(*output).unionByName(first_of_each(found).select(*output))
    taken, tries, before = there, None, None
    while True:
        each = rows if tries is None else rows.join(tries, "ord", "left")
        counted = numbered_by(each, F.lit(step) if tries is None else step * (1 + F.coalesce("_more", F.lit(0))), tries is None)
        first = durable(placed(counted.select(*rows.columns, "_uid")))
        open_ = first if taken is None else first.join(_blocked(first, taken).select("ord"), "ord", "left_anti")
        again = None
        if taken is not None:
            late = first.join(_blocked(first, taken).select("ord"), "ord", "left_semi").withColumn("_try", F.explode(F.sequence(F.lit(1), F.lit(ATTEMPTS - 1))))
            more = durable(placed(late.withColumn("_uid", F.col("_uid") + F.col("_try") * step)))
            fit = more.join(_blocked(more, taken).select("ord", "_try"), ["ord", "_try"], "left_anti")
            again = durable(more.join(fit.groupBy("ord").agg(F.min("_try").alias("_try")), ["ord", "_try"], "left_semi"))
            every = more.select("ord").distinct().join(again.select("ord", "_try"), "ord", "left")
            tries = durable(every.select("ord", F.coalesce("_try", F.lit(ATTEMPTS - 1)).alias("_more")))
        chosen = first if again is None else durable(open_.unionByName(again.drop("_try")))
        state = chosen.agg(F.count("*"), F.sum(F.xxhash64("ord", "new_path").cast("decimal(38,0)"))).first()
        if before == state or (before is None and (tries is None or tries.isEmpty()) and chosen.groupBy("new_path").count().where("count > 1").isEmpty()):
            return chosen.select(*output)
        before = state
        # Names count as taken by the first file that has chosen them, for those after it.
        own = chosen.groupBy("new_path").agg(F.min("ord").alias("_by"))
        taken = own if there is None else own.join(there, "new_path", "left_anti").unionByName(there.withColumn("_by", F.lit(None).cast(own.schema["_by"].dataType)))
        taken = durable(taken)


def _blocked(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """Rows whose new_path exists, or was chosen by an earlier file."""
    by = taken if "_by" in taken.columns else taken.withColumn("_by", F.lit(None).cast("long"))
    return rows.join(by, "new_path").where(F.col("_by").isNull() | (F.col("_by") < F.col("ord")))


def preview_of(files: DataFrame, plan: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """files (path, ...) with new_filename, new_path and date_used of a plan, nulls where it has none; separators count as equal. Of several actions of one path the least new_path stands.

    Where a path is listed more than once, `by` names columns of both tables that tell its files apart.
    """
    norm = lambda c: F.replace(c, F.lit("\\"), F.lit("/"))
    rows = plan.select(norm(F.col("original_path")).alias("_path"), *by, "new_filename", "new_path", "date_used")
    rows = rows.groupBy("_path", *by).agg(F.min(F.struct("new_path", "new_filename", "date_used")).alias("_row")).select("_path", *by, "_row.new_filename", "_row.new_path", "_row.date_used")
    return files.withColumn("_path", norm(F.col("path"))).join(rows, ["_path", *by], "left").select(*files.columns, "new_filename", "new_path", "date_used")


def organizer_order(files: DataFrame, by: str = "name", descending: bool = False, ties: tuple[str, ...] = ()) -> DataFrame:
    """Files (path, date_taken) with `place`: by type (image before video) or date, then by name, case aside, then paths and the columns of ties; by ranges, so no task sorts all."""
    name = file_name(F.col("path"))
    kind = F.when(F.lower(F.regexp_extract(name, r"([^.]*)$", 1)).isin(VIDEO_EXTENSIONS), "video").otherwise("image")
    keys = {"name": [], "type": [kind], "date": [F.coalesce("date_taken", F.lit(""))]}[by] + [F.lower(name)]
    return numbered(files, [k.desc() if descending else k.asc() for k in keys] + [F.col(c).asc() for c in ("path", *ties)], "place")


def media_order(files: DataFrame, ties: tuple[str, ...] = ()) -> DataFrame:
    """A media list with `place`: by names, case aside, then paths, then the columns of ties."""
    return numbered(files, [F.lower(file_name(F.col("path"))).asc(), *[F.col(c).asc() for c in ("path", *ties)]], "place")


def media_list(files: DataFrame, tags: DataFrame, priority: str = "exif", by: tuple[str, ...] = ()) -> DataFrame:
    """files (path) with date_taken, date_source and place: what their tags (source_file, original, created, file_modified) or names say. Files without tags have no date; of several dates of one file the earliest stands.

    Where a path is listed more than once, `by` names columns of both tables that tell
    its files apart; equal paths then also go by these.
    """
    norm = lambda c: F.replace(c, F.lit("\\"), F.lit("/"))
    at = dates.listed_date(file_name(F.col("_key")), F.col("original"), F.col("created"), F.col("file_modified"), priority)
    known = tags.withColumn("_key", norm(F.col("source_file"))).select("_key", *by, at.alias("_date")).where("_date is not null").groupBy("_key", *by).agg(F.min("_date").alias("_date"))
    dated = files.withColumn("_key", norm(F.col("path"))).join(known, ["_key", *by], "left")
    return media_order(dated.select(*files.columns, F.col("_date.date").alias("date_taken"), F.col("_date.source").alias("date_source")), by)


def plan_date_rewrite(dated: DataFrame) -> DataFrame:
    """The three date tags of each file as rows (path, tag, value)."""
    return dated.select("path", F.explode(F.array(*[F.struct(F.lit(t).alias("tag"), F.col("date_used").alias("value")) for t in DATE_TAGS])).alias("t")).select("path", "t.tag", "t.value")


def summary(done: DataFrame) -> DataFrame:
    """total, succeeded, failed of rows (path, ok). The failed paths are failures() of the same rows, a table of their own, as there may be any number."""
    return done.agg(F.count("*").alias("total"), F.count_if(F.col("ok")).alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"))


def failures(done: DataFrame) -> DataFrame:
    """The paths of rows (path, ok) that failed."""
    return done.where(~F.col("ok")).select("path")


def media_counts(files: DataFrame) -> DataFrame:
    """(file_kind, ext, n) with totals by kind (null ext) and in all."""
    known = files.withColumn("file_kind", media_kind(F.col("path"))).where("file_kind is not null")
    return known.withColumn("ext", extension(F.col("path"))).rollup("file_kind", "ext").agg(F.count("*").alias("n"))


def metadata_tags(updates: DataFrame) -> DataFrame:
    """(path, tag, value): what is written for each non-null field of a patch.

    Fields: date_taken (ISO), description, artist, copyright, make, model,
    delete_device, gps_latitude, gps_longitude; those that the patch lacks are null.
    Dates are written in the tags' notation, positions signed with their reference;
    delete_device empties a device's tags in all their places instead of setting them.
    """
    has = lambda c: F.col(c) if c in updates.columns else F.lit(None)
    gone = F.coalesce(has("delete_device").cast("boolean"), F.lit(False))
    tag = lambda name, value: F.struct(F.lit(name).alias("tag"), value.cast("string").alias("value"))
    taken = dates.iso_to_exif(has("date_taken").cast("string"))
    rows = [tag(t, taken) for t in ("DateTimeOriginal", "CreateDate")]
    rows += [tag(t, has(c)) for c, tags in TEXT_TAGS.items() for t in tags]
    rows += [tag(t, F.when(gone, "")) for t in DEVICE_TAGS]
    rows += [tag(t, F.when(~gone, has(t.lower()))) for t in ("Make", "Model")]
    for c, name, plus, minus in (("gps_latitude", "GPSLatitude", "N", "S"), ("gps_longitude", "GPSLongitude", "E", "W")):
        value = has(c).cast("double")
        rows.append(tag(name, F.when(value.isNotNull(), fixed_text(value, 8, even=True))))
        rows.append(tag(name + "Ref", F.when(value >= 0, plus).when(value < 0, minus)))
    return updates.select("path", F.explode(F.array(*rows)).alias("t")).where("t.value is not null").select("path", "t.tag", "t.value")


def patch_of_form(forms: DataFrame) -> DataFrame:
    """Patches as metadata_tags() takes them, from an edit form's texts and the selection's shared values.

    forms: path, date_taken, description, artist, copyright, device, position (texts),
    shared_make, shared_model (MIXED where the selection differs). Empty texts change
    nothing. A null device, or one equal to the shared one, changes nothing; an empty
    one deletes it; others are split at the first space. position that is no pair of
    coordinates makes the form invalid, and it gives no row.
    """
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    mixed = (F.coalesce("shared_make", F.lit("")) == MIXED) | (F.coalesce("shared_model", F.lit("")) == MIXED)
    shared = F.when(~mixed, F.concat_ws(" ", text("shared_make"), text("shared_model")))
    changed = F.col("device").isNotNull() & ~F.col("device").eqNullSafe(shared)
    split = split_device(F.col("device"))
    new = F.when(changed & (F.col("device") != ""), split)
    at = parse_pair(F.col("position"))
    given = F.trim(F.coalesce("position", F.lit(""))) != ""
    return forms.where(~given | at.isNotNull()).select(
        "path",
        *[text(c).alias(c) for c in ("date_taken", "description", "artist", "copyright")],
        F.nullif(new["make"], F.lit("")).alias("make"),
        F.nullif(new["model"], F.lit("")).alias("model"),
        (changed & (F.col("device") == "")).alias("delete_device"),
        F.when(given, at["latitude"]).alias("gps_latitude"),
        F.when(given, at["longitude"]).alias("gps_longitude"),
    )
