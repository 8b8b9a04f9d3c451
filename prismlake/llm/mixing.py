"""Mixing sources to target weights.

Rows get hash-random keys and are range-sorted within their source; distributed
prefix sums of their sizes give each row's place, and each source is cut at its
exact budget: whole epochs first, then the rows before the cut once more, the row
at the cut for as many words as remain.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismlake.operators.running import running_before
from prismlake.session import durable

#: A source is repeated so many times at most.
MOST_EPOCHS = 3
#: Source weights by rank in code point order (null last), repeating.
WEIGHTS = (1, 2, 3)
#: Prefix of the hashed key, the seed of the mix.
SEED = "mix:"


def word_count(text: str) -> Column:
    return F.coalesce(F.expr(rf"regexp_count({text}, '[^\\x20\\x09-\\x0D]+')"), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Targets of sources, from their sizes (src, src_null, source_size): one row a source.

    Shares 100 % of all sizes by weight; where a share is above `most` times the
    source's size, it stops there and the excess goes to the others by weight, until
    none is above. In order of size / weight the capped sources are a prefix, so
    running sums over the sources settle it without iteration. One task sorts the
    sources (one short row each); documents never meet in it.
    """
    everything = Window.orderBy("src_null", "src")
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(F.row_number().over(everything) - 1, F.lit(n)) + 1).cast("int")).cast("long")
    ranked = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "src_null", "src").rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy()
    rest = ranked.withColumn("rest", F.sum("source_size").over(total) - F.coalesce(F.sum("cap").over(order), F.lit(0))).withColumn(
        "rest_weight", F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(order), F.lit(0))
    )
    wide = lambda x, y: F.col(x).cast("decimal(19,0)") * F.col(y).cast("decimal(19,0)")  # noqa: E731  products pass 64 bits
    capped = rest.withColumn("capped", wide("rest", "weight") > wide("cap", "rest_weight"))
    free = capped.withColumn("at", F.min(F.when(~F.col("capped"), F.struct(F.col("source_size") / F.col("weight"), "src_null", "src", "rest", "rest_weight"))).over(total))
    share = F.col("at.rest") * F.col("weight") / F.col("at.rest_weight")
    return free.select("src", "src_null", "source_size", "weight", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share.cast("double")).alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_EPOCHS, seed: str = SEED) -> DataFrame:
    """What a mix of all documents takes of each: one row per row of docs.

    Columns: doc_id, source, size (words of the text), source_size, target (of its
    source), taken (words, repeats counted), epochs (times it is taken whole), part
    (words of one more, cut copy). taken of a source sums to its target, rounded down.
    Null and empty texts have size 0 and take 0; a null source is a source of its own
    and comes last; null ids hash as the empty string; repeated rows share a key and
    each takes its own place, so which of two equal rows comes first makes no
    difference; an empty table gives an empty one. Other columns are left out.
    """
    return _mix(docs.select("doc_id", "source", word_count("text").alias("size")), weights, most, seed).drop("row_id")


def _mix(sized: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_EPOCHS, seed: str = SEED) -> DataFrame:
    """mix() of rows (doc_id, source, size), with their row_id if they have one."""
    named = sized if "row_id" in sized.columns else sized.withColumn("row_id", F.lit(None).cast("long"))
    slim = named.select(
        "row_id",
        "doc_id",
        "source",
        "size",
        F.coalesce("source", F.lit("")).alias("src"),
        F.col("source").isNull().alias("src_null"),
        F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("key"),
    )
    placed = running_before(slim, ["src_null", "src"], [F.col("key"), F.col("doc_id"), F.col("size")], F.col("size"), "before")
    targets = source_targets(placed.groupBy("src", "src_null").agg(F.sum("size").alias("source_size")), weights, most)
    # One row a source: Catalyst broadcasts it only if its size at run time allows, else it splits skewed keys.
    joined = placed.join(targets, ["src_null", "src"])
    budget = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    left = F.least(F.greatest(budget - F.col("whole") * F.col("source_size") - F.col("before"), F.lit(0)), F.col("size"))
    cut = joined.withColumn("whole", whole).withColumn("left", left)
    again = (F.col("size") > 0) & (F.col("left") == F.col("size"))
    return cut.select(
        "row_id",
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("whole") * F.col("size") + F.col("left")).alias("taken"),
        F.when(F.col("size") > 0, F.col("whole") + again.cast("long")).otherwise(0).alias("epochs"),
        F.when(again, 0).otherwise(F.col("left")).alias("part"),
    )


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: docs' columns, a row for each time that a document is taken.

    A cut copy is its first words joined by spaces; n_chars follows where docs has it.
    Documents without words, null texts included, carry nothing and are not in it.
    Rows get a number of their own when they are written, so repeated rows and null
    ids are taken each for its own place and columns may have any names; what is taken
    is joined by that number, and no text is sorted. An empty table gives an empty one.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    held = durable(docs.select(whole.alias("row")).withColumn("row_id", F.monotonically_increasing_id()))
    takes = _mix(held.select("row_id", F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), word_count("row.text").alias("size")), **options)
    times = (F.col("epochs") + (F.col("part") > 0).cast("long")).cast("int")
    some = takes.select("row_id", "epochs", "part", times.alias("times")).where("times > 0")
    copies = held.join(some, "row_id").select("row", "epochs", "part", F.explode(F.sequence(F.lit(1), "times")).alias("copy"))
    cut = F.col("copy") > F.col("epochs")
    first = F.expr(rf"array_join(slice(regexp_extract_all(row.text, '([^\\x20\\x09-\\x0D]+)', 1), 1, cast(part as int)), ' ')")
    changed = {c: F.col("row").getField(c) for c in docs.columns}
    changed["text"] = F.when(cut, first).otherwise(changed["text"])
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(cut, F.length(first)).otherwise(changed["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return copies.select(*[x.alias(c) for c, x in changed.items()])
