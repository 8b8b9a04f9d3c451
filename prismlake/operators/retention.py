"""Choosing the original of each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismlake.functions.paths import glob_match, is_copy_name, stem
from prismlake.operators.running import running_before

RULES = ("highestResolution", "oldestDate", "newestDate", "filenamePattern", "highestSharpness")


def _rank(rule: str, pattern: str | None) -> Column:
    """A struct by which the original is the greatest of its group; ord makes it unique."""
    named = ~is_copy_name(stem(F.col("path")))
    place = F.col("ord").cast("long")
    resolution = [F.col("size_bytes"), F.col("width").cast("long") * F.col("height"), place]
    date = F.coalesce("date_taken", "modified")
    if rule == "highestResolution":
        return _struct(named, *resolution)
    if rule == "newestDate":
        return _struct(named, date, place)
    if rule == "filenamePattern":
        hit = glob_match(stem(F.col("path")), pattern or "*")
        return _struct(named, hit, F.when(hit, -place), *resolution)
    if rule == "highestSharpness":
        known = F.col("blur_score").isNotNull()
        return _struct(named, known, F.col("blur_score"), F.when(known, place), *resolution)
    raise ValueError(f"no such rule: {rule}")


def _struct(*parts: Column) -> Column:
    return F.struct(*[c.alias(f"k{i}") for i, c in enumerate(parts)])


def elect(members: DataFrame, rule: str = "highestResolution", pattern: str | None = None) -> DataFrame:
    """members (group_id, path, size_bytes, width, height, date_taken, modified, blur_score, ord, ...) with is_original.

    Members with a canonical name go before others if a group has any; ties go by ord
    as the rule says, so exactly one member of each group is chosen. The best of each
    group is found by partial aggregates and joined back, so that a group of any size
    is no single task.
    """
    if rule == "oldestDate":
        # The one rule whose dates go up; names still go first.
        key, best = _struct(is_copy_name(stem(F.col("path"))), F.coalesce("date_taken", "modified"), F.col("ord").cast("long")), F.min
    else:
        key, best = _rank(rule, pattern), F.max
    keyed = members.withColumn("_key", key)
    chosen = keyed.groupBy("group_id").agg(best("_key").alias("_best"))
    joined = keyed.join(chosen, "group_id")
    return joined.select(*members.columns, F.col("_key").eqNullSafe(F.col("_best")).alias("is_original"))


def reapply(members: DataFrame, rule: str, pattern: str | None = None) -> DataFrame:
    """Elect anew among shown groups, whose order is by modified and then the former one."""
    shown = running_before(members, ["group_id"], [F.asc("modified"), F.asc("ord")], F.lit(1), "_shown")
    renumbered = shown.withColumn("ord", F.col("_shown").cast("long")).select(*[c for c in members.columns if c != "is_original"])
    return elect(renumbered, rule, pattern)


def prune_deleted(members: DataFrame, deleted: DataFrame) -> DataFrame:
    """Members without the deleted paths; groups below two go; one without an original gets that of the largest area, the first of equals."""
    left = members.join(deleted.select("path").distinct(), "path", "left_anti")
    area = _struct(F.col("width").cast("long") * F.col("height"), -F.col("ord").cast("long"))
    keyed = left.withColumn("_key", area)
    groups = keyed.groupBy("group_id").agg(F.count("*").alias("_n"), F.max(F.col("is_original").cast("int")).alias("_has"), F.max("_key").alias("_best")).where("_n >= 2")
    joined = keyed.join(groups, "group_id")
    chosen = F.when(F.col("_has") == 1, F.col("is_original")).otherwise(F.col("_key").eqNullSafe(F.col("_best")))
    return joined.select(*[chosen.alias(c) if c == "is_original" else F.col(c) for c in members.columns])
