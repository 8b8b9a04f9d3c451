"""Groups of duplicates: equal content, similar hashes, equal timestamps, and groups across those.

Assets of equal hash are one class, and only classes are compared: blank pictures, of
which there may be millions, cost their number and not its square.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake.functions.dates import timestamp_tag
from prismlake.functions.paths import path_order, stem
from prismlake.functions.values import hamming, similarity_percent
from prismlake.operators.clusters import complete_clusters, stars, windowed_clusters
from prismlake.operators.pairs import INDEX_DISTANCE, hash_classes, near, widest
from prismlake.operators.retention import elect
from prismlake.operators.running import numbered, running_before
from prismlake.session import durable

CROSS_DISTANCE = 16


def number_assets(assets: DataFrame, ties: tuple[str, ...] = ()) -> DataFrame:
    """assets with asset_id: their place in component-wise path order, by distributed ranks; those of one path go by the columns of ties."""
    ranked = running_before(assets.withColumn("_all", F.lit(0)), ["_all"], [path_order(F.col("path")), *[F.col(c) for c in ties]], F.lit(1), "asset_id")
    return ranked.drop("_all").withColumn("asset_id", F.col("asset_id").cast("long"))


def exact_groups(assets: DataFrame) -> DataFrame:
    """(group_id, kind, similarity, asset_id, ord): assets of equal content, two or more. The group is its least asset."""
    counts = assets.where("content_hash is not null").groupBy("content_hash").agg(F.count("*").alias("n"), F.min("asset_id").alias("group_id")).where("n >= 2")
    found = assets.join(counts, "content_hash")
    return found.select("group_id", F.lit("exact").alias("kind"), F.lit(100).alias("similarity"), "asset_id", F.col("asset_id").alias("ord"))


def similar_groups(hashes: DataFrame, distance: int) -> DataFrame:
    """(group_id, kind, similarity, asset_id, ord): complete-linkage clusters, seeds in ascending order.

    Classes are clustered as one sequential scan of all would; a class of two or more
    assets that is in no cluster is one. All assets of a class share one fate, as they
    are equally far from any other. Clusters whose greatest distance is 0 count as
    exact. Null hashes are in no group.
    """
    hashes = durable(hashes.where("phash is not null").select("asset_id", "phash"))
    classes = durable(hash_classes(hashes))
    made = durable(complete_clusters(near(classes, distance), classes, distance) if distance <= INDEX_DISTANCE else windowed_clusters(classes, distance))
    alone = classes.where("n > 1").join(made.select("rep"), "rep", "left_anti").select(F.col("rep").alias("group_id"), F.lit(0).alias("most"), "rep")
    whole = classes.join(made.unionByName(alone), "rep").select("phash", "group_id", "most")
    rows = hashes.join(whole, "phash")
    return rows.select("group_id", F.when(F.col("most") == 0, "exact").otherwise("similar").alias("kind"), similarity_percent(F.col("most")).alias("similarity"), "asset_id", F.col("asset_id").alias("ord"))


def same_time_groups(assets: DataFrame, distance: int = CROSS_DISTANCE) -> DataFrame:
    """(group_id, kind, similarity, asset_id, ord, ts_tag): assets of one timestamp tag, two or more.

    similarity is null unless all members have hashes within distance of one another.
    Of a tag's distinct hashes all are first held against one: where one is farther, so
    is a pair, and the tag's greatest distance need not be known.
    """
    tagged = assets.where("ts_tag is not null").select("ts_tag", "asset_id", "phash")
    sizes = tagged.groupBy("ts_tag").agg(F.count("*").alias("n"), F.count("phash").alias("hashed"), F.min("asset_id").alias("group_id"), F.min("phash").alias("anchor")).where("n >= 2")
    members = durable(tagged.join(sizes, "ts_tag"))
    distinct = members.where("n = hashed").select("ts_tag", "phash", "anchor").distinct()
    far = distinct.groupBy("ts_tag").agg(F.max(hamming(F.col("phash"), F.col("anchor"))).alias("far")).where(F.col("far") <= distance)
    known = widest(distinct.join(far, "ts_tag").select(F.col("ts_tag").alias("key"), "phash")).withColumnRenamed("key", "ts_tag")
    shown = members.join(known, "ts_tag", "left")
    similarity = F.when(F.col("most") <= distance, similarity_percent(F.col("most")))
    return shown.select("group_id", F.lit("sameDate").alias("kind"), similarity.alias("similarity"), "asset_id", F.col("asset_id").alias("ord"), "ts_tag")


def cross_groups(groups: DataFrame, hashes: DataFrame, distance: int = CROSS_DISTANCE) -> DataFrame:
    """groups (of equal timestamps) after stars across them have taken members out; groups left below two go, others keep their similarity and are named by their least asset.

    Stars are sameDate groups with a similarity, named by their seed, whose members come
    in its order. Seeds go by tag and asset.
    """
    members = groups.join(hashes.select("asset_id", "phash"), "asset_id", "left")
    hashed = durable(members.where("phash is not null").select(F.coalesce("ts_tag", F.lit("")).alias("tag"), "asset_id", "phash", "group_id"))
    classes = durable(hash_classes(hashed))
    rows = durable(hashed.join(classes.select("phash", "rep"), "phash"))
    made = durable(stars(rows.select("tag", "asset_id", "group_id", "rep"), near(classes, distance)))
    spread = widest(made.join(rows.select("asset_id", "phash"), "asset_id").select(F.col("seed").alias("key"), "phash")).withColumnRenamed("key", "seed")
    left = durable(groups.join(made.select("asset_id"), "asset_id", "left_anti"))
    whole = left.groupBy("group_id").agg(F.count("*").alias("n"), F.min("asset_id").alias("least")).where("n >= 2")
    new = made.join(spread, "seed").select(F.col("seed").alias("group_id"), F.lit("sameDate").alias("kind"), similarity_percent(F.col("most")).alias("similarity"), "asset_id", "ord")
    # A seed may have named its old group, so what is left of groups is named by its own least asset.
    return left.join(whole, "group_id").select(F.col("least").alias("group_id"), "kind", "similarity", "asset_id", "ord").unionByName(new)


def corrected(assets: DataFrame, corrections: DataFrame) -> DataFrame:
    """assets with late corrections (asset_id, width, height, modified): sizes above 0 and times that are given replace an asset's own."""
    late = corrections.select("asset_id", *[F.col(c).alias(f"new_{c}") for c in ("width", "height", "modified")])
    better = {c: F.when(F.col(f"new_{c}") > 0, F.col(f"new_{c}")).otherwise(F.col(c)).cast(assets.schema[c].dataType) for c in ("width", "height")}
    better["modified"] = F.coalesce("new_modified", "modified")
    return assets.join(late, "asset_id", "left").select(*[better[c].alias(c) if c in better else F.col(c) for c in assets.columns])


def resolved_hashes(assets: DataFrame, corrections: DataFrame, decoded: DataFrame) -> DataFrame:
    """assets (asset_id, phash, ...) with null hashes filled from corrections, then from pictures decoded on demand (both: asset_id, phash)."""
    late, last = (t.select("asset_id", F.col("phash").alias(n)) for t, n in ((corrections, "_late"), (decoded, "_last")))
    joined = assets.join(late, "asset_id", "left").join(last, "asset_id", "left")
    return joined.select(*[F.coalesce("phash", "_late", "_last").alias("phash") if c == "phash" else F.col(c) for c in assets.columns])


def final_order(members: DataFrame) -> DataFrame:
    """members (group_id, modified, ord, ...) with `place` in their group, by time, and `group_place`, their group's by its first member's time; both by ranges."""
    placed = running_before(members, ["group_id"], [F.asc("modified"), F.asc("ord")], F.lit(1), "place")
    placed = durable(placed.withColumn("place", F.col("place").cast("long") + 1))
    firsts = numbered(placed.where("place = 1").select("group_id", F.col("modified").alias("first")), [F.asc("first"), F.asc("group_id")], "group_place")
    return placed.join(firsts.drop("first"), "group_id")


def find_duplicates(assets: DataFrame, distance: int = 6, across: bool = True, rule: str = "highestResolution", pattern: str | None = None, corrections: DataFrame | None = None) -> DataFrame:
    """All groups of assets (asset_id, path, content_hash, phash, modified and what the rule needs): one row per member, with is_original, place and group_place.

    Each asset is in one group at most: equal content first, then similar hashes, then
    equal timestamps in names, and last stars across the latter. Originals are elected
    among the members as corrected, in the order of assets; then members come by time,
    and groups by their first member's time.
    """
    tagged = assets.withColumn("ts_tag", timestamp_tag(stem(F.col("path"))))
    exact = durable(exact_groups(tagged))
    rest = tagged.join(exact.select("asset_id"), "asset_id", "left_anti")
    similar = durable(similar_groups(rest, distance))
    rest = rest.join(similar.select("asset_id"), "asset_id", "left_anti")
    timed = durable(same_time_groups(rest))
    last = cross_groups(timed, rest) if across else timed.drop("ts_tag")
    groups = exact.unionByName(similar).unionByName(last.select(*exact.columns))
    shown = corrected(assets, corrections) if corrections is not None else assets
    return final_order(elect(groups.join(shown, "asset_id"), rule, pattern))
