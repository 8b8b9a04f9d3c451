"""Filters, orders and facets of groups and assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismlake.functions.paths import display_extension, file_name, path_order, under_root
from prismlake.functions.values import NO_LOCATION, geo_cell, mixed_value
from prismlake.operators.running import numbered, running_before

# Why files are passed over, and what is shown for it.
FAILURES = {"PERMISSION_DENIED": "Permission denied", "NOT_FOUND": "File not found", "UNSUPPORTED_FORMAT": "Unsupported format", "CORRUPTED_FILE": "Corrupted file", "IO_ERROR": "I/O error"}


def with_kind(groups: DataFrame, kind: str) -> DataFrame:
    """all, exact, similar (with same-date groups that have a similarity) or sameDate (those without)."""
    shown = {
        "all": F.lit(True),
        "exact": F.col("kind") == "exact",
        "similar": (F.col("kind") == "similar") | ((F.col("kind") == "sameDate") & F.col("similarity").isNotNull()),
        "sameDate": (F.col("kind") == "sameDate") & F.col("similarity").isNull(),
    }
    return groups.where(shown[kind])


def _with_member(members: DataFrame, test: Column) -> DataFrame:
    return members.join(members.where(test).select("group_id").distinct(), "group_id", "left_semi")


def with_extension(members: DataFrame, ext: str) -> DataFrame:
    """Groups of which a member has the extension, with all their members."""
    return _with_member(members, display_extension(F.col("path")) == ext)


def with_name(members: DataFrame, text: str) -> DataFrame:
    """Groups of which a member's name contains the text, case and outer spaces aside."""
    return _with_member(members, F.lower(file_name(F.col("path"))).contains(text.strip().lower()))


def copies(members: DataFrame) -> DataFrame:
    return members.where(~F.col("is_original"))


def filter_assets(assets: DataFrame, search: str = "", first: str | None = None, last: str | None = None, location: str | None = None, device: str | None = None) -> DataFrame:
    """Assets by name, date (texts, inclusive), place name (or none) and device."""
    found = assets
    if search.strip():
        found = found.where(F.lower(file_name(F.col("path"))).contains(search.strip().lower()))
    day = F.substring(F.coalesce("date_taken", "modified"), 1, 10)
    if first:
        found = found.where(day >= first)
    if last:
        found = found.where(day <= last)
    if location == NO_LOCATION:
        found = found.where(F.coalesce("location", F.lit("")) == "")
    elif location:
        found = found.where(F.col("location") == location)
    if device:
        found = found.where(F.coalesce("device", F.lit("")) == device)
    return found


def kind_rank() -> Column:
    return F.when(F.col("kind") == "exact", 0).when(F.col("kind") == "similar", 1).when(F.col("similarity").isNotNull(), 2).otherwise(3)


def order_groups(groups: DataFrame, by: str = "kind", descending: bool = False) -> DataFrame:
    """Groups (kind, similarity, title, date) with `place` by kind, title or date; by ranges, so no task sees all groups.

    Kinds go exact, similar, same date with a similarity, same date; descending turns
    this round, but within a kind the more similar come first either way. Groups
    without a title or date count as empty ones; equal groups go by group_id.
    """
    way = (lambda c: c.desc()) if descending else (lambda c: c.asc())
    closest = F.desc_nulls_last(F.when(kind_rank().isin(1, 2), F.col("similarity")))
    text = lambda c: F.coalesce(c, F.lit(""))
    keys = {"kind": lambda: [way(kind_rank()), closest], "title": lambda: [way(text(F.lower("title")))], "date": lambda: [way(text(F.col("date")))]}
    return numbered(groups, [*keys[by](), F.asc("group_id")], "place")


def natural_key(text: Column) -> Column:
    """A key that compares texts without regard to case and accents, and runs of digits as numbers."""
    parts = F.regexp_extract_all(text, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    # A number's key begins with its length, so that numbers of any length compare by size.
    plain = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
    padded = F.transform(parts, lambda x: F.when(x.rlike("^[0-9]"), F.concat(F.lpad(F.length(plain(x)).cast("string"), 9, "0"), plain(x))).otherwise(x))
    return F.collate(F.array_join(padded, ""), "UNICODE_CI_AI")


def order_assets(assets: DataFrame, by: str = "date", descending: bool = False, ties: tuple[str, ...] = ()) -> DataFrame:
    """Assets with `place` by date, location or device, by ranges; equal ones go by path, and those of one path by the columns of ties.

    Without a location (null without a position, or empty) or a device an asset comes
    last either way; a position without a name yet comes before names when ascending.
    Names compare without case and accents, their digits as numbers. No date counts as
    an empty text.
    """
    way = (lambda c: c.desc()) if descending else (lambda c: c.asc())
    if by == "location":
        unnamed = F.col("gps_latitude").isNotNull() & F.col("location").isNull()
        rank = F.when(unnamed, 2 if descending else 0).when(F.coalesce("location", F.lit("")) != "", 1).otherwise(3)
        keys = [rank.asc(), way(natural_key(F.when(rank == 1, F.col("location"))))]
    elif by == "device":
        none = F.coalesce("device", F.lit("")) == ""
        keys = [none.asc(), way(natural_key(F.when(~none, F.col("device"))))]
    else:
        keys = [way(F.coalesce("date_taken", "modified", F.lit("")))]
    return numbered(assets, [*keys, *[F.asc(c) for c in ("path", *ties)]], "place")


def original_first(members: DataFrame) -> DataFrame:
    """Members with `place` in their group: the original, then copies by name (case and accents aside) in exact groups and by date in others; equal ones by date and their former order. By ranges, so a group may have any size."""
    name = F.collate(F.when((F.col("kind") == "exact") & ~F.col("is_original"), file_name(F.col("path"))).otherwise(F.lit("")), "UNICODE_CI_AI")
    placed = running_before(members, ["group_id"], [F.desc("is_original"), name.asc(), F.asc("modified"), F.asc("ord")], F.lit(1), "place")
    return placed.withColumn("place", F.col("place").cast("int") + 1)


def kind_counts(groups: DataFrame) -> DataFrame:
    """One row: groups in all and by kind as with_kind shows them."""
    similar = (F.col("kind") == "similar") | ((F.col("kind") == "sameDate") & F.col("similarity").isNotNull())
    return groups.agg(F.count("*").alias("all"), F.count_if(F.col("kind") == "exact").alias("exact"), F.count_if(similar).alias("similar"), F.count_if((F.col("kind") == "sameDate") & F.col("similarity").isNull()).alias("sameDate"))


def extension_histogram(assets: DataFrame) -> DataFrame:
    return assets.groupBy(display_extension(F.col("path")).alias("ext")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ext")


def facet(rows: DataFrame, column: str) -> DataFrame:
    """Distinct values with `place`, case and accents aside and digits as numbers, equal ones by code points; nulls and empty ones are left out. By ranges, so no task sorts all."""
    values = rows.where(F.coalesce(F.col(column), F.lit("")) != "").select(column).distinct()
    return numbered(values, [natural_key(F.col(column)).asc(), F.col(column).asc()], "place")


def location_counts(assets: DataFrame) -> DataFrame:
    """(location, n): how many assets each location has; those without one, or an empty one, count under NO_LOCATION."""
    return assets.groupBy(F.coalesce(F.nullif("location", F.lit("")), F.lit(NO_LOCATION)).alias("location")).agg(F.count("*").alias("n"))


def with_custom(found: DataFrame, custom: DataFrame, column: str) -> DataFrame:
    """Distinct values of found and of custom (both: column), each with is_custom, where it was not found but added by hand."""
    values = found.select(column, F.lit(0).alias("custom")).unionByName(custom.select(F.trim(column).alias(column), F.lit(1).alias("custom")))
    return values.where(F.coalesce(F.col(column), F.lit("")) != "").groupBy(column).agg((F.min("custom") == 1).alias("is_custom"))


def place_names(assets: DataFrame, names: DataFrame) -> DataFrame:
    """assets with location: the name of their cell in a cache (geo_cell, name), null where they have no position or the cache no name yet."""
    cell = geo_cell(F.col("gps_latitude"), F.col("gps_longitude"))["geo_cell"]
    known = names.select(F.col("geo_cell").alias("_cell"), F.col("name").alias("_name"))
    columns = [c for c in assets.columns if c != "location"]
    return assets.select(*columns, cell.alias("_cell")).join(known, "_cell", "left").select(*columns, F.col("_name").alias("location"))


def cells(assets: DataFrame) -> DataFrame:
    """(geo_cell, latitude, longitude, n): the cells of assets with a position, with that of their first asset by path; paths stay with the assets, where the cell finds them again."""
    at = assets.where("gps_latitude is not null and gps_longitude is not null")
    cell = geo_cell(F.col("gps_latitude"), F.col("gps_longitude"))["geo_cell"]
    first = F.min_by(F.struct("gps_latitude", "gps_longitude"), F.struct("path", "gps_latitude", "gps_longitude"))
    return at.groupBy(cell.alias("geo_cell")).agg(first.alias("at"), F.count("*").alias("n")).select("geo_cell", F.col("at.gps_latitude").alias("latitude"), F.col("at.gps_longitude").alias("longitude"), "n")


def pending_cells(assets: DataFrame, names: DataFrame) -> DataFrame:
    """cells() that a cache (geo_cell, name) does not know."""
    return cells(assets).join(names.select("geo_cell").distinct(), "geo_cell", "left_anti")


def selected(assets: DataFrame, paths: DataFrame) -> DataFrame:
    """The shown assets that are selected, by path."""
    return assets.join(paths.select("path").distinct(), "path", "left_semi")


def without_value(rows: DataFrame, column: str, value: str) -> DataFrame:
    """rows with a value taken out of a column: the rows stay, without it."""
    return rows.withColumn(column, F.when(~F.col(column).eqNullSafe(F.lit(value)), F.col(column)))


def remove_location(name: str, lists: list[DataFrame], assets: DataFrame, names: DataFrame) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """A location taken out everywhere: of lists (location) of found and of custom ones, of assets' location, and of the place cache (geo_cell, name), whose cells are to be looked up again."""
    return [t.where(~F.col("location").eqNullSafe(F.lit(name))) for t in lists], without_value(assets, "location", name), names.where(~F.col("name").eqNullSafe(F.lit(name)))


def remove_device(name: str, lists: list[DataFrame], assets: DataFrame, aliases: DataFrame) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """A device taken out everywhere: of lists (device) of found and of custom ones, of assets' device, and its alias of aliases (device, alias)."""
    return [t.where(~F.col("device").eqNullSafe(F.lit(name))) for t in lists], without_value(assets, "device", name), aliases.where(~F.col("device").eqNullSafe(F.lit(name)))


def newest(assets: DataFrame, n: int = 3) -> DataFrame:
    """The n assets modified last (path, mtime), ties by path."""
    return assets.orderBy(F.desc("mtime"), "path").limit(n)


def deletion_plan(assets: DataFrame, roots: list[str]) -> DataFrame:
    """(path, network): what is to be deleted, blank paths aside, each once; network says that a path is under one of the roots, where there is no bin."""
    path = F.trim("path")
    return assets.where(F.coalesce(path, F.lit("")) != "").select(path.alias("path")).distinct().withColumn("network", under_root(F.col("path"), roots))


def deletion_preview(plan: DataFrame, n: int = 10) -> DataFrame:
    """The first n paths of a deletion plan, and how many there are in all."""
    return plan.orderBy(path_order(F.col("path"))).limit(n).crossJoin(F.broadcast(plan.agg(F.count("*").alias("total"))))


def kind_label(kind: Column) -> Column:
    # Labels of kinds.
    labels = {"exact": "Exact duplicate", "similar": "Similar", "sameDate": "Same date"}
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in labels.items() for x in p]), kind), kind)


def failure_label(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in FAILURES.items() for x in p]), kind), F.lit("Unknown error"))


def common_values(rows: DataFrame, keys: list[str], columns: list[str], zero_is_none: tuple[str, ...] = ()) -> DataFrame:
    """Per key, each column's one value, or a mark where rows differ."""
    value = lambda c: F.nullif(F.col(c), F.lit(0)) if c in zero_is_none else F.col(c)
    return rows.groupBy(*keys).agg(*[mixed_value(value(c)).alias(c) for c in columns])


def error_message(message: Column, text: Column) -> Column:
    """What is shown of an error: its message, else its text, else that it is unknown."""
    return F.coalesce(message, text, F.lit("Unknown error"))
