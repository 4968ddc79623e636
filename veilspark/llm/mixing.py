"""Mixing sources to target weights: exact quotas of blocks, dealt to output shards by a tree.

Every source's documents stand in a seeded random order, cut into blocks.  A source's target says
how many passes over all its blocks the mix takes and how far a last pass goes; these draws are
its quota.  A tree halves the range of shards level by level; at each node the quotas of the left
half are one multivariate-hypergeometric draw from the node's quotas, so any shard is a uniform
sample of the whole mix without any row being moved to decide it.  A shard then takes consecutive,
hence disjoint, draws of each source and shuffles them locally by a hash.

Everything is DataFrame and SQL expressions.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .quality import WORD, let, times

#: Weights of the sources in code-point order, repeating, and the most passes over a source.
WEIGHTS = (1.0, 2.0, 3.0)
MOST_PASSES = 3
SHARDS = 32
#: Documents that are chosen to fill what the last pass's order leaves open, before all others that fit.
FILLS = 4
#: Documents about the last pass's end, at least, that it chooses from.
CUT_DOCS = 64


def size_of(text: Column) -> Column:
    """Words of a text (null: 0)."""
    return F.coalesce(times(text, WORD + "+"), F.lit(0).cast("long"))


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """source, source_size -> the same with weight and target (double).

    Sources by code point, null last, weigh `weights` in turn and share all words; a target stops
    at `most` times its source's size, and the excess is shared by weight among the others until
    none is above.  A round is one sum over the sources: the words left for each unit of weight of
    those that have not stopped; it ends when no further one stops.
    """
    held = stored(weighed(sources, weights).withColumn("cap", F.col("source_size") * float(most)))
    level = None
    while True:
        # The level only rises, and a source that has stopped stays so.
        open_ = F.lit(True) if level is None else F.col("weight") * level <= F.col("cap")
        whole = held.agg(F.sum("source_size").alias("all"), F.sum(F.when(~open_, F.col("cap"))).alias("stopped"), F.sum(F.when(open_, F.col("weight"))).alias("open"), F.count_if(open_).alias("n")).first()
        if not whole["open"]:
            return held.select("source", "source_size", "weight", F.col("cap").alias("target"))
        before, level = level, (whole["all"] - (whole["stopped"] or 0.0)) / whole["open"]
        if before is not None and level <= before:
            return held.select("source", "source_size", "weight", F.least("cap", F.col("weight") * level).alias("target"))


def weighed(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """sources with weight, by their place in code-point order, null last: sorted ranges are numbered
    within, and each range begins where the ranges before it end."""
    ranges = max(1, min(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), 64))
    rows = stored(sources.withColumn("absent", F.col("source").isNull()).repartitionByRange(ranges, "absent", "source").withColumn("range", F.spark_partition_id()))
    # As many rows as there are ranges.
    starts = rows.groupBy("range").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    nth = F.row_number().over(Window.partitionBy("range").orderBy("absent", "source")) - 1
    ranked = rows.withColumn("nth", nth).join(F.broadcast(starts.select("range", "before")), "range")
    return ranked.withColumn("weight", F.get(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("nth") + F.col("before")) % len(weights)).cast("int"))).select(*sources.columns, "weight")


def placed(docs: DataFrame, blocks: int, seed: int) -> DataFrame:
    """A row for each document: row (all its columns), doc_id, source, size, at (place in its source's
    random order) and block."""
    at = F.xxhash64(F.lit(seed), F.col("doc_id"), F.xxhash64("text"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source", size_of(F.col("text")).alias("size"), at.alias("at"))
    return rows.withColumn("block", F.shiftrightunsigned(F.col("at"), 33) % blocks)


def quotas(rows: DataFrame, blocks: int, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """One row for each source: its size and target, how many whole passes the mix takes, and where
    a last pass ends: it takes blocks before `low` whole, and of those from `low` to `high` (`cut`;
    about CUT_DOCS documents either side of its end) single documents of `part` words together.
    `n` is the source's quota of block draws."""
    by_block = stored(rows.groupBy("source", "block").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs")))
    sources = targets(by_block.groupBy("source").agg(F.sum("words").alias("source_size")), weights)
    all_of = Window.partitionBy("source")
    found = by_block.alias("b").join(sources.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source"))).select("b.source", "block", "words", "docs", "source_size", "target")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    found = (
        found.withColumn("passes", passes)
        .withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
        .withColumn("upto", F.sum("words").over(all_of.orderBy("block")))
        .withColumn("end", F.coalesce(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("block") + 1)).over(all_of), F.lit(0)))
        .withColumn("near", F.ceil(CUT_DOCS * blocks / F.sum("docs").over(all_of)))
    )
    one = found.groupBy("source").agg(
        *[F.max(c).alias(c) for c in ("source_size", "target", "passes", "rest")],
        F.max(F.col("end") - F.col("near")).alias("low"),
        F.max(F.least(F.col("end") + F.col("near"), F.lit(blocks - 1))).alias("high"),
        F.sum(F.when(F.col("block") < F.col("end") - F.col("near"), F.col("words")).otherwise(F.lit(0))).alias("before"),
    )
    ends = F.col("rest") > 0
    return one.select(
        "source", "source_size", "target", "passes", F.when(ends, F.col("low")).otherwise(F.lit(0)).alias("low"), F.when(ends, F.col("high")).otherwise(F.lit(-1)).alias("high"),
        (F.col("rest") - F.col("before")).alias("part"), (F.col("passes") * blocks + F.when(ends, F.col("high") + 1).otherwise(F.lit(0))).cast("long").alias("n"),
    )


def hypergeometric(total: Column, own: Column, taken: Column, u: Column) -> Column:
    """How many of `own` marked units are among `taken` drawn from `total`, by inversion: the odds
    of all outcomes relative to the likeliest, upwards from it and then downwards."""
    low, high = F.greatest(F.lit(0).cast("long"), taken - (total - own)), F.least(own, taken)

    def from_mode(mode: Column) -> Column:
        up = F.when(high > mode, F.sequence(mode + 1, high)).otherwise(F.array().cast("array<bigint>"))
        down = F.when(low < mode, F.sequence(mode - 1, low, F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
        rise = lambda k: ((own - k + 1) * (taken - k + 1)) / (k * (total - own - taken + k)).cast("double")
        fall = lambda k: ((k + 1) * (total - own - taken + k + 1)) / ((own - k) * (taken - k)).cast("double")
        state = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))

        def add(ratio):
            def step(a: Column, k: Column) -> Column:
                return let(a["w"] * ratio(k), lambda w: F.struct(w.alias("w"), (a["sum"] + w).alias("sum")))
            return step

        above = F.aggregate(up, state, add(rise), lambda a: a["sum"])
        below = F.aggregate(down, state, add(fall), lambda a: a["sum"])

        def pick(goal: Column) -> Column:
            start = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("sum"), F.when(goal <= 1.0, mode).alias("at"))

            def seek(ratio):
                def step(a: Column, k: Column) -> Column:
                    return F.when(a["at"].isNotNull(), a).otherwise(
                        let(a["w"] * ratio(k), lambda w: F.struct(w.alias("w"), (a["sum"] + w).alias("sum"), F.when(goal <= a["sum"] + w, k).alias("at")))
                    )
                return step

            after_up = F.aggregate(up, start, seek(rise), lambda a: F.struct(F.lit(1.0).alias("w"), a["sum"].alias("sum"), a["at"].alias("at")))
            return F.coalesce(F.aggregate(down, after_up, seek(fall), lambda a: a["at"]), mode)

        return let(u * (1.0 + above + below), pick)

    mode = F.greatest(low, F.least(high, F.floor((taken + 1) * (own + 1) / (total + 2).cast("double")).cast("long")))
    return let(mode, from_mode)


#: Sources that a node's quotas are listed for at once; more of them are first drawn by group.
GROUP = 512


def shard_quotas(share: DataFrame, shards: int, seed: int) -> DataFrame:
    """shard, source -> how many draws before it (`first`) and up to its end (`last`).

    Sources are dealt to groups of about GROUP.  The tree first draws what each shard has of every
    group, and then, in each group, what of that is whose: the same law as one draw, but no row
    lists more than the groups or the sources of one."""
    groups = max(1, math.ceil(share.count() / GROUP))
    keyed = share.select("source", "n", F.pmod(F.xxhash64("source"), F.lit(groups)).alias("group"))
    whole = F.array_sort(F.collect_list(F.struct(F.col("group").isNull().alias("absent"), F.col("group").alias("source"), "n")))
    tree = keyed.groupBy("group").agg(F.sum("n").alias("n")).agg(whole.alias("quota"))
    tree = tree.select(F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), "quota").where(F.size("quota") > 0)
    levels = math.ceil(math.log2(shards)) if shards > 1 else 0
    for _ in range(levels):
        tree = tree.select(F.explode(split_node(F.col("lo"), F.col("hi"), F.col("quota"), seed)).alias("node")).select("node.*")
    by_shard = stored(tree.select("lo", F.explode("quota").alias("q")).select(F.col("lo").alias("shard"), F.col("q.source").alias("group"), "q.n"))
    # What the left half of any range of shards has of a group: the difference of two running sums.
    upto = by_shard.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("per"))
    sums = F.aggregate("per", F.array(F.lit(0).cast("long")), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + p["n"])))
    own = keyed.groupBy("group").agg(F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("absent"), "source", "n"))).alias("quota"))
    inner = own.join(upto.select("group", sums.alias("upto")), "group").select("group", "upto", F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), "quota")
    for _ in range(levels):
        at = lambda k: F.get(F.col("upto"), k.cast("int"))
        halves = split_node(F.col("lo"), F.col("hi"), F.col("quota"), seed, lambda lo, mid: at(mid) - at(lo))
        inner = inner.select("group", "upto", F.explode(halves).alias("node")).select("group", "upto", "node.*")
    leaves = inner.select("lo", F.explode("quota").alias("q")).select(F.col("lo").alias("shard"), "q.source", "q.n")
    order = Window.partitionBy("source").orderBy("shard")
    return leaves.withColumn("last", F.sum("n").over(order)).withColumn("first", F.col("last") - F.col("n")).where("n > 0").select("shard", "source", "first", "last")


def split_node(lo: Column, hi: Column, quota: Column, seed: int, left: Callable[[Column, Column], Column] | None = None) -> Column:
    """A node's two halves as an array; a single shard stays one node.  left(lo, mid) says how many
    draws the left half has; without it, its share by shards."""

    def halves(mid: Column) -> Column:
        total = F.aggregate(quota, F.lit(0).cast("long"), lambda a, q: a + q["n"])
        left_total = left(lo, mid) if left else let(total, lambda t: F.floor(t * ((mid - lo) / (hi - lo))).cast("long"))

        def draw(t: Column) -> Column:
            start = F.struct(t["total"].alias("total"), t["left"].alias("left"), F.array().cast("array<bigint>").alias("got"))

            def step(a: Column, q: Column) -> Column:
                u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), lo, hi, q["source"]), 11) / F.lit(float(2**53))
                taken = F.when(q["n"] == 0, F.lit(0).cast("long")).otherwise(hypergeometric(a["total"], q["n"], a["left"], u))
                return let(taken, lambda k: F.struct((a["total"] - q["n"]).alias("total"), (a["left"] - k).alias("left"), F.concat(a["got"], F.array(k)).alias("got")))

            return F.aggregate(quota, start, step, lambda a: a["got"])

        def both(got: Column) -> Column:
            part = lambda sign: F.transform(quota, lambda q, i: F.struct(q["absent"].alias("absent"), q["source"].alias("source"), (F.get(got, i) if sign else q["n"] - F.get(got, i)).alias("n")))
            return F.array(F.struct(lo.alias("lo"), mid.alias("hi"), part(True).alias("quota")), F.struct(mid.alias("lo"), hi.alias("hi"), part(False).alias("quota")))

        return let(let(F.struct(total.alias("total"), left_total.alias("left")), draw), both)

    one = F.array(F.struct(lo.alias("lo"), hi.alias("hi"), quota.alias("quota")))
    return F.when(hi - lo < 2, one).otherwise(let(F.floor((lo + hi) / 2).cast("long"), halves))


def fillers(gap: Column, docs: Column) -> Column:
    """Which documents (_nth, size; in order) go into the gap: each that still fits, then the one, if
    any, that comes nearer though it is longer than what is left."""
    start = F.struct(gap.cast("double").alias("gap"), F.array().cast("array<int>").alias("got"))

    def step(a: Column, d: Column) -> Column:
        taken = F.struct((a["gap"] - d["size"]).alias("gap"), F.concat(a["got"], F.array(d["_nth"])).alias("got"))
        return F.when(d["size"] <= a["gap"], taken).otherwise(a)

    def last(a: Column) -> Column:
        near = F.filter(docs, lambda d: ~F.array_contains(a["got"], d["_nth"]) & (F.abs(a["gap"] - d["size"]) < a["gap"]))
        best = F.array_min(F.transform(near, lambda d: F.struct(F.abs(a["gap"] - d["size"]).alias("off"), d["_nth"].alias("nth"))))
        return F.when(F.size(near) > 0, F.concat(a["got"], F.array(best["nth"]))).otherwise(a["got"])

    return let(F.aggregate(docs, start, step), last)


def mix(docs: DataFrame, shards: int = SHARDS, seed: int = 1, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """A row for each document: row (a struct of its columns), source, size, source_size, target and
    draws, one struct<shard, place> for each time that the mix takes it (empty: left out).

    Documents are taken whole, MOST_PASSES times at most.  Null texts have size 0, null sources are
    one source, repeated rows are documents of their own, no documents give no rows; other columns
    may have any names.
    """
    blocks = blocks_for(docs)
    return draw(placed(docs, blocks, seed), stored(quotas(placed(docs.select("doc_id", "source", "text"), blocks, seed), blocks, weights)), blocks, shards, seed)


def blocks_for(docs: DataFrame) -> int:
    """Blocks of each source: the root of the number of documents, so that neither the blocks of a
    source nor the documents of a block outgrow a task."""
    return max(1, math.isqrt(docs.count()))


def draw(rows: DataFrame, share: DataFrame, blocks: int, shards: int, seed: int) -> DataFrame:
    """rows (of placed) with what the mix takes of them, given the sources' shares (of quotas)."""
    # Draw k of a source: pass after pass over its blocks in order; shards own ranges of draws.
    ranges = shard_quotas(share, shards, seed).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("last", "shard"))).alias("ranges"))
    of = stored(share.alias("s").join(ranges.alias("r"), F.col("s.source").eqNullSafe(F.col("r.source")), "left").select("s.*", "ranges").withColumnRenamed("source", "of"))
    spread = rows.join(of, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    cut = F.col("block").between(F.col("low"), F.col("high"))
    # Only blocks about the end of a source's last pass look at their documents' order: whole
    # documents while they fit, then, a few times, the one that comes nearest to what is missing,
    # then all others that still fit, in order, and one that comes nearer.
    inside = Window.partitionBy("source")
    order = inside.orderBy("block", "at", "doc_id", "size")
    part = spread.where(cut).withColumn("_nth", F.row_number().over(order)).withColumn("_upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    part = part.withColumn("_more", F.col("_upto") <= F.col("part"))
    part = part.withColumn("_gap", F.col("part") - F.coalesce(F.max(F.when(F.col("_more"), F.col("_upto"))).over(inside), F.lit(0)))
    for _ in range(FILLS):
        off = F.abs(F.col("_gap") - F.col("size"))
        part = part.withColumn("_near", F.when(~F.col("_more") & (off < F.abs("_gap")), F.struct(off.alias("off"), "_nth", "size")))
        part = part.withColumn("_best", F.min("_near").over(inside))
        part = part.withColumn("_more", F.col("_more") | F.coalesce(F.col("_best._nth") == F.col("_nth"), F.lit(False)))
        part = part.withColumn("_gap", F.col("_gap") - F.coalesce(F.col("_best.size"), F.lit(0)))
    part = part.drop("_near", "_best")
    open_ = part.where(~F.col("_more") & (F.col("size") > 0) & (F.col("_gap") > 0))
    open_ = open_.groupBy(F.col("source").alias("of")).agg(F.max("_gap").alias("gap"), F.array_sort(F.collect_list(F.struct("_nth", "size"))).alias("docs"))
    open_ = open_.select("of", fillers(F.col("gap"), F.col("docs")).alias("_fill"))
    part = part.join(open_, F.col("source").eqNullSafe(F.col("of")), "left")
    part = part.withColumn("_more", F.col("_more") | F.coalesce(F.array_contains("_fill", F.col("_nth")), F.lit(False)))
    part = part.drop("_nth", "_upto", "_gap", "of", "_fill")
    whole = spread.where(~cut).withColumn("_more", F.col("block") < F.col("low"))
    taken = whole.unionByName(part)
    passes = F.col("passes") + F.col("_more").cast("long")
    nth = lambda p: p * blocks + F.col("block")
    shard = lambda p: F.get(F.filter("ranges", lambda r: r["last"] > nth(p)), F.lit(0))["shard"]
    place = lambda p: F.xxhash64(F.lit(seed), F.lit("place"), p, "at", "doc_id")
    draws = F.when(passes > 0, F.transform(F.sequence(F.lit(0).cast("long"), passes - 1), lambda p: F.struct(shard(p).alias("shard"), place(p).alias("place"))))
    return taken.select("row", "source", "size", "source_size", "target", F.coalesce(draws, F.array().cast("array<struct<shard:bigint,place:bigint>>")).alias("draws"))


def mix_report(docs: DataFrame, shards: int = SHARDS, seed: int = 1) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the shards that take it (array, a number for each time)."""
    # Texts are read once; what is kept of them is their size and place.
    blocks = blocks_for(docs)
    rows = placed(docs.select("doc_id", "source", "text"), blocks, seed).withColumn("row", F.struct("doc_id"))
    rows = stored(rows)
    m = draw(rows, stored(quotas(rows, blocks)), blocks, shards, seed)
    drawn = F.transform("draws", lambda d: d["shard"])
    return m.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.size(drawn)).cast("long").alias("taken"), drawn.alias("shards"))


def mixed(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """The mix itself: a document's row for each time it is taken, dealt to shards and shuffled in
    each.  Without a number of shards there is one for every 100,000 documents, SHARDS at least."""
    shards = shards or max(SHARDS, docs.count() // 100_000)
    m = mix(docs, shards).withColumn("one", F.explode("draws"))
    return m.repartition(min(shards, 1024), F.col("one.shard")).sortWithinPartitions("one.shard", "one.place").select("row.*")
