"""Mergeable quantile summaries: q-digests of integers.

A digest is a set of nodes of the dyadic trie over the integers: node (height, prefix)
stands for the values from prefix * 2**height on, 2**height of them, and has a count.
It begins as leaves. From the bottom up, the nodes below a common one are folded into
the smallest node that holds them while their rank interval, so the sum of their
counts, stays within a width; the width doubles until the digest fits its budget. The
leaves of the smallest and the largest value are points of their own that are never
folded, so a digest knows its range and answers are clamped to it. Digests merge by
adding counts node by node, and are pruned again.

What is folded depends only on the rows, not on how they were split: a part's two
boundary leaves keep it from folding a node that rows outside it may share, and parts
have room for the unfolded nodes along their boundaries.

Rows are range-sorted once. Tasks digest stretches of equal group; stretches of a group
meet in rounds of bounded fan-in, whatever share of all rows a group has. The exact
check counts by running sums over the same ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismlake.llm.memory import lean
from prismlake.session import durable, partitions

#: Points of a digest at most, and at least where there are as many values.
MOST_POINTS, LEAST_POINTS = 400, 4
#: More points for a part of a digest: the unfolded nodes along both boundary paths.
ROOM = 2 * 64
#: Batches that a group's rows are dealt to, quantiles that are asked for, and rows that a summary needs for an answer.
BATCHES = 8
PARTS = 10
LEAST_ROWS = 20
#: Parts of a group that meet in one task.
FAN = 48
#: Rows or nodes that a task works on at a time.
LOT = 1 << 18
#: The batch of a group's merged summary.
WHOLE = -1

NODES = "height array<byte>, prefix array<long>, count array<long>"


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    change = np.zeros(len(keys[0]), bool)
    change[0] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(change)


def _added(group: np.ndarray, height: np.ndarray, prefix: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """Node-wise addition; nodes are then in order of group, first value and descending height."""
    order = np.lexsort((-height, prefix << height, group))
    group, height, prefix, count = (x[order] for x in (group, height, prefix, count))
    at = _runs(group, height, prefix)
    return group[at], height[at], prefix[at], np.add.reduceat(count, at) if len(at) else count


def _fold(height: np.ndarray, prefix: np.ndarray, count: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One digest's nodes, in order of first value, folded to rank intervals of at most `width` rows."""
    first = prefix << height
    last = first + (np.int64(1) << height) - 1
    low, high = first[height == 0].min(), first[height == 0].max()
    up = height.copy()
    for h in range(1, int(low ^ high).bit_length() if (low < 0) == (high < 0) else 64):
        inside = np.flatnonzero(height <= h)
        node = first[inside] >> h
        at = _runs(node)
        total = np.add.reduceat(count[inside], at)
        small = (total <= width) & (node[at] != low >> h) & (node[at] != high >> h)
        if len(inside) == len(height) and total.min() > width:
            break
        fits = np.repeat(small, np.diff(np.append(at, len(node))))
        up[inside[fits]] = h
    at = _runs(first >> up, up)
    begins, ends = first[at], np.maximum.reduceat(last, at)
    tight = np.zeros(len(at), np.int64)
    apart = begins ^ ends
    while (wide := (apart >> tight) != 0).any():
        tight[wide] += 1
    return tight, begins >> tight, np.add.reduceat(count, at)


def _pruned(group: np.ndarray, height: np.ndarray, prefix: np.ndarray, count: np.ndarray, budget: int) -> tuple[np.ndarray, ...]:
    """Digests, in order, with at most `budget` nodes each."""
    at = _runs(group)
    sizes = np.diff(np.append(at, len(group)))
    if not (sizes > budget).any():
        return group, height, prefix, count
    out, begin = [], 0
    for k in np.flatnonzero(sizes > budget):
        i, j = int(at[k]), int(at[k] + sizes[k])
        h, p, c = height[i:j], prefix[i:j], count[i:j]
        width = 1
        while len(h) > budget:
            width *= 2
            h, p, c = _fold(h, p, c, width)
        out += [(group[begin:i], height[begin:i], prefix[begin:i], count[begin:i]), (np.full(len(h), group[i]), h, p, c)]
        begin = j
    out.append((group[begin:], height[begin:], prefix[begin:], count[begin:]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _digests(group: np.ndarray, height: np.ndarray, prefix: np.ndarray, count: np.ndarray, budget: int) -> tuple[np.ndarray, ...]:
    """Any nodes of any groups as one digest a group; groups ascend."""
    return _pruned(*_added(group, height, prefix, count), budget)


def _answers(group: np.ndarray, height: np.ndarray, prefix: np.ndarray, count: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, answers) of each digest: for i = 1 .. parts - 1 the value of rank ceil(i * rows / parts).

    A value's rank lies between the counts of the nodes that end up to it and of those
    that begin before it; of all nodes' ends the one that misses the rank least is taken.
    """
    at = _runs(group)
    sizes = np.diff(np.append(at, len(group)))
    leaf = height == 0
    first = prefix << height
    low, high = (f.reduceat(np.where(leaf, first, other), at) for f, other in ((np.minimum, np.iinfo(np.int64).max), (np.maximum, np.iinfo(np.int64).min)))
    digest = np.repeat(np.arange(len(at)), sizes)
    first = np.maximum(first, low[digest])
    last = np.minimum((prefix << height) + (np.int64(1) << height) - 1, high[digest])
    order = np.lexsort((last, digest))
    ends, ended = last[order], np.cumsum(count[order])
    # Ends that are equal have one rank, the last of them.
    final = np.append(_runs(digest, ends)[1:], len(ends)) - 1
    ends, ended, owner = ends[final], ended[final], digest[final]
    # Counts of nodes that begin before an end: ends sort before beginnings of the same value.
    both = np.lexsort((np.concatenate([np.zeros(len(ends), np.int8), np.ones(len(first), np.int8)]), np.concatenate([ends, first]), np.concatenate([owner, digest])))
    begun = np.cumsum(np.concatenate([np.zeros(len(ends), np.int64), count])[both])
    before = np.empty(len(ends), np.int64)
    is_end = both < len(ends)
    before[both[is_end]] = begun[is_end]
    rows = np.add.reduceat(count, at)
    base = np.cumsum(rows) - rows
    i = np.arange(1, parts)
    target = (i[None, :] * rows[:, None] + parts - 1) // parts + base[:, None]
    # ended and before go on over all digests, so they are sorted as a whole.
    crossing = np.searchsorted(ended + before + 1, 2 * target.ravel())
    begin, stop = np.searchsorted(owner, np.arange(len(at))), np.searchsorted(owner, np.arange(len(at)), "right") - 1
    d = np.repeat(np.arange(len(at)), parts - 1)
    right = np.clip(crossing, begin[d], stop[d])
    left = np.clip(crossing - 1, begin[d], stop[d])
    miss = lambda v: np.maximum(0, np.maximum(before[v] + 1 - target.ravel(), target.ravel() - ended[v]))
    found = ends[np.where(miss(left) <= miss(right), left, right)].reshape(len(at), parts - 1)
    return rows, np.maximum.accumulate(found, axis=1)


def _lists(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)), pa.array(values, kind))


def _columns(group: np.ndarray, height: np.ndarray, prefix: np.ndarray, count: np.ndarray) -> list[pa.Array]:
    at = _runs(group)
    return [_lists(height, at, pa.int8()), _lists(prefix, at, pa.int64()), _lists(count, at, pa.int64())]


def _codes(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Where the named columns differ from the row before."""
    change = np.zeros(batch.num_rows, bool)
    change[0] = True
    for name in names:
        c = batch.column(name)
        change[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return change


def _lots(batches: Iterator[pa.RecordBatch], key: list[str], whole: bool) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, where runs of key begin) of about LOT nodes; with whole, a run is never cut."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows if "x" in batch.schema.names else len(batch.column("count").flatten())
        if size < LOT:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        at = np.flatnonzero(_codes(table.to_batches()[0], key))
        cut = int(at[-1]) if whole else table.num_rows
        if cut:
            yield table.slice(0, cut), at[:-1] if whole else at
        rest = table.slice(cut)
        held, size = rest.to_batches() if rest.num_rows else [], 0
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, np.flatnonzero(_codes(table.to_batches()[0], key))


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of a task's rows (stream, grp, batch, part, x, n), one for each stretch of one group and part, and batch."""
    for table, at in _lots(batches, ["stream", "grp", "part"], whole=False):
        stretch = np.repeat(np.arange(len(at)), np.diff(np.append(at, table.num_rows)))
        batch = table["batch"].to_numpy().astype(np.int64)
        spread = int(batch.max()) + 1
        x = table["x"].to_numpy()
        group, height, prefix, count = _digests(stretch * spread + batch, np.zeros(len(x), np.int64), x, table["n"].to_numpy(), MOST_POINTS + ROOM)
        rows = table.select(["stream", "grp", "part"]).take(pa.array(at[group[_runs(group)] // spread]))
        own = pa.array((group[_runs(group)] % spread).astype(np.int32))
        yield from pa.table([*rows.columns, own, *_columns(group, height, prefix, count)], names=["stream", "grp", "part", "batch", "height", "prefix", "count"]).to_batches()


def _nodes(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, height, prefix, count) of all nodes of rows of digests."""
    lists = table["count"].combine_chunks()
    row = np.repeat(np.arange(table.num_rows), lists.value_lengths().to_numpy())
    flat = [table[c].combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("height", "prefix")]
    return row, *flat, lists.flatten().to_numpy()


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of one group, batch and slot merged into one part of a digest."""
    for table, at in _lots(batches, ["stream", "grp", "part", "batch"], whole=True):
        row, *nodes = _nodes(table)
        merged = _digests(np.searchsorted(at, row, "right") - 1, *nodes, MOST_POINTS + ROOM)
        rows = table.select(["stream", "grp", "part", "batch"]).take(pa.array(at))
        yield from pa.table([*rows.columns, *_columns(*merged)], names=[*rows.column_names, "height", "prefix", "count"]).to_batches()


def _final(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each batch's digest from its parts, and each group's from its batches' digests, with answers."""
        for table, at in _lots(batches, ["stream", "grp"], whole=True):
            own = np.flatnonzero(_codes(table.combine_chunks().to_batches()[0], ["stream", "grp", "batch"]))
            row, *nodes = _nodes(table)
            digests = _digests(np.searchsorted(own, row, "right") - 1, *nodes, MOST_POINTS)
            # A group is the run of key that its batch's first row lies in.
            group = np.searchsorted(at, own, "right") - 1
            wholes = _digests(group[digests[0]], *digests[1:], MOST_POINTS)
            for (g, *summary), rows, is_whole in ((digests, own, False), (wholes, at, True)):
                n, answers = _answers(g, *summary, parts)
                keys = table.select(["stream", "grp"]).take(pa.array(rows))
                batch = pa.array(np.full(len(rows), WHOLE, np.int32)) if is_whole else table["batch"].take(pa.array(rows))
                flat = pa.array(answers.ravel())
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * (parts - 1)), flat)
                sizes = np.diff(np.append(_runs(g), len(g)))
                columns = [*keys.columns, batch, pa.array(n), pa.array(sizes), *_columns(g, *summary), listed]
                yield from pa.table(columns, names=["stream", "grp", "batch", "n", "points", "height", "prefix", "count", "answers"]).to_batches()

    return lean(run)


def ranged(rows: DataFrame) -> DataFrame:
    """Rows (stream, grp, batch, x, n), n times each, as sums of equal ones, in order of stream, grp and x over parts; written."""
    counts = durable(rows.groupBy("stream", "grp", "batch", "x").agg(F.sum("n").alias("n")))
    order = ["stream", "grp", "x"]
    return durable(counts.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order, "batch").withColumn("part", F.spark_partition_id()))


def summaries(ordered: DataFrame, parts: int = PARTS) -> DataFrame:
    """A digest for every batch of every group of ranged() rows, and one, batch -1, merged from a group's batches.

    Columns: stream, grp, batch, n (rows), points (nodes kept), the nodes as height,
    prefix and count, and answers, the values of rank ceil(i * n / parts). Of all that
    a group has, only digests leave the tasks that read its rows.
    """
    names = ["stream", "grp", "batch"]
    ddl = f"stream string, grp string, part int, batch int, {NODES}"
    found = ordered.select("stream", "grp", "batch", "part", "x", "n").mapInArrow(lean(_stretches), ddl)
    spark, left = ordered.sparkSession, partitions(ordered.sparkSession)
    while left > FAN:
        slots = found.withColumn("part", F.floor(F.col("part") / FAN).cast("int"))
        dealt = slots.repartition(partitions(spark), "stream", "grp", "part").sortWithinPartitions("stream", "grp", "part", "batch")
        found = dealt.mapInArrow(lean(_meet), ddl)
        left = -(-left // FAN)
    dealt = found.repartition(partitions(spark), "stream", "grp").sortWithinPartitions(*names)
    return dealt.mapInArrow(_final(parts), f"stream string, grp string, batch int, n long, points long, {NODES}, answers array<long>")


def checked(ordered: DataFrame, digests: DataFrame, parts: int = PARTS, batches: int = BATCHES, least: int = LEAST_ROWS) -> DataFrame:
    """The answers of summaries() held against all rows: one row for each digest of at least `least` rows, and i.

    Answers are dealt to the parts that they fall into and sorted among the rows as
    marks before and after the rows of their value; running sums within parts, and sums
    of the parts before, give the marks' ranks and the value at each exact rank.
    """
    asked = digests.where(F.col("n") >= least).select("stream", "grp", "batch", "n", "points", F.posexplode("answers").alias("i", "answer")).withColumn("i", F.col("i") + 1)
    asked = durable(asked)
    # One row for each group and part: rows before it and in all, of each batch and, last, of all batches.
    each = [F.coalesce(F.sum(F.when(F.col("batch") == b, F.col("n"))), F.lit(0)).alias(f"n{b}") for b in range(batches)]
    own = ordered.groupBy("part", "stream", "grp").agg(*each, F.sum("n").alias(f"n{batches}"), F.max("x").alias("last"))
    by = Window.partitionBy("stream", "grp")
    earlier = by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = range(batches + 1)
    placed = own.select(
        "part",
        "stream",
        "grp",
        "last",
        F.lag("last").over(by.orderBy("part")).alias("after"),
        F.array(*[F.coalesce(F.sum(f"n{b}").over(earlier), F.lit(0)) for b in sums]).alias("before"),
        F.array(*[F.sum(f"n{b}").over(by) for b in sums]).alias("total"),
    )
    placed = durable(placed)
    falls = (F.col("answer") <= F.col("last")) & (F.col("after").isNull() | (F.col("answer") > F.col("after")))
    marks = asked.join(placed.select("part", "stream", "grp", "last", "after"), ["stream", "grp"]).where(falls)
    marks = marks.withColumn("place", F.explode(F.array(F.lit(0), F.lit(2))))
    none = lambda kind: F.lit(None).cast(kind)
    key = ["part", "stream", "grp"]
    rows = ordered.select(*key, "batch", "x", "n", F.lit(1).alias("place"), none("int").alias("i"))
    marks = marks.select(*key, "batch", F.col("answer").alias("x"), F.lit(0).cast("long").alias("n"), "place", "i")
    # One shuffle by key serves both sums, and the join.
    up_to = lambda *k: Window.partitionBy(*key, *k).orderBy("x", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.unionByName(marks).withColumn("of_all", F.sum("n").over(up_to())).withColumn("of_batch", F.sum("n").over(up_to("batch")))
    # The parts' sums are a row for each group and part, joined on the key that the rows are dealt by.
    met = summed.join(placed.select(*key, "before", "total"), key)
    at = F.when(F.col("batch") == WHOLE, F.lit(batches)).otherwise(F.col("batch"))
    pick = lambda column, k: F.element_at(F.col(column), (k + 1).cast("int"))

    def hits(label: Column, local: Column, k: Column) -> Column:
        """The i whose exact rank a row of value x holds, as (batch, i)."""
        n, upto = pick("total", k), local + pick("before", k)
        passed = lambda rows: F.call_function("div", rows * parts, n).cast("int")
        done, now = passed(upto - F.col("n")), F.least(passed(upto), F.lit(parts - 1))
        held = F.transform(F.sequence(done + 1, now), lambda i: F.struct(label.alias("batch"), i.alias("i")))
        return F.when((n >= least) & (now > done), held).otherwise(F.array().cast("array<struct<batch:int,i:int>>"))

    is_row = F.col("place") == 1
    whole = F.lit(batches)
    exact = met.where(is_row).withColumn("hit", F.explode(F.concat(hits(F.col("batch"), F.col("of_batch"), F.col("batch")), hits(F.lit(WHOLE), F.col("of_all"), whole))))
    exact = exact.select("stream", "grp", "hit.batch", "hit.i", F.col("x").alias("exact_x"), none("long").alias("n_below"), none("long").alias("n_upto"))
    rank = F.when(F.col("batch") == WHOLE, F.col("of_all")).otherwise(F.col("of_batch")) + pick("before", at)
    marked = met.where(~is_row).select("stream", "grp", "batch", "i", none("long").alias("exact_x"), F.when(F.col("place") == 0, rank).alias("n_below"), F.when(F.col("place") == 2, rank).alias("n_upto"))
    names = ["stream", "grp", "batch", "i"]
    held = exact.unionByName(marked).unionByName(asked.select(*names, *[none("long").alias(c) for c in ("exact_x", "n_below", "n_upto")], "n", "points", "answer"), allowMissingColumns=True)
    found = held.groupBy(*names).agg(*[F.max(c).alias(c) for c in ("n", "exact_x", "points", "answer", "n_below", "n_upto")])
    target = F.expr(f"(i * n + {parts - 1}) div {parts}")
    error = F.greatest(F.lit(0), F.col("n_below") + 1 - F.col("target"), F.col("target") - F.col("n_upto"))
    return found.withColumn("target", target).withColumn("rank_error", error.cast("long")).select(*names, "n", "target", "exact_x", "points", "answer", "n_below", "n_upto", "rank_error")


def batch_of(key: Column, batches: int = BATCHES) -> Column:
    """The batch of an id: the checksum of its decimals; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(batches)).cast("int")


def shifted(money: Column, batch: Column) -> Column:
    """The integer that stands for an amount of money in a batch: hundredths, rounded half up, and 1000 for each batch before."""
    return (F.floor(100 * money + 0.5) + 1000 * batch).cast("long")


def quantiles(rows: DataFrame, parts: int = PARTS, batches: int = BATCHES, least: int = LEAST_ROWS, percent: int = 5) -> DataFrame:
    """Quantiles of integers x of rows (stream, grp, batch, x), each n times if they have n, from digests, with their exact ranks.

    One row for each summary of at least `least` rows, batch -1 being the group's whole,
    and i = 1 .. parts - 1: stream, grp, batch, i, n, target, exact_x, points, answer,
    n_below, n_upto, rank_error, within (the error is at most percent of n). Rows without
    stream, grp, batch or x are left out; repeated rows count each; equal values are one
    point; extra columns are dropped; an empty table gives an empty one.
    """
    n = F.col("n") if "n" in rows.columns else F.lit(1)
    kept = rows.where("stream is not null and grp is not null and batch is not null and x is not null").select("stream", "grp", "batch", "x", n.cast("long").alias("n")).where("n > 0")
    ordered = ranged(kept)
    found = checked(ordered, summaries(ordered, parts), parts, batches, least)
    return found.withColumn("within", 100 * F.col("rank_error") <= percent * F.col("n"))


def money_streams(clicks: DataFrame, lines: DataFrame, items: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Rows (stream, grp, batch, x) of the money of clicks by client, and of sale lines' prices by brand.

    Clicks count once an id, those without one each; of different rows of one id the
    greatest (client, value) stands. Lines meet items after they are counted by item and
    batch, so an item of a third of all lines is a few rows. NaN is no money; repeated
    items each meet their lines.
    """
    with_id = clicks.where("click_id is not null").groupBy("click_id").agg(F.max(F.struct("client_id", "value")).alias("row")).select("click_id", "row.*")
    single = with_id.unionByName(clicks.where("click_id is null").select("click_id", "client_id", "value"))
    good = single.where("client_id is not null and value is not null and not isnan(value)")
    value = good.select(F.lit("value").alias("stream"), F.col("client_id").cast("string").alias("grp"), batch_of(F.col("click_id"), batches).alias("batch"), "value")
    value = value.select("stream", "grp", "batch", shifted(F.col("value"), F.col("batch")).alias("x"), F.lit(1).cast("long").alias("n"))
    counted = lines.where("item_id is not null").groupBy("item_id", batch_of(F.col("vendor_id"), batches).alias("batch")).agg(F.count("*").alias("n"))
    priced = items.where("item_id is not null and brand is not null and price is not null and not isnan(price)").select("item_id", F.col("brand").alias("grp"), "price")
    price = counted.join(priced, "item_id").select(F.lit("price").alias("stream"), "grp", "batch", shifted(F.col("price"), F.col("batch")).alias("x"), "n")
    return value.unionByName(price)
