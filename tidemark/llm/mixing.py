"""Mixing sources to target weights by Pfair scheduling.

The rows of each source, in the order of a hash of their ids, form blocks of `BLOCK` rows. A source of weight m / Q gets its
k-th block (from 0) released in slot floor(k Q / m), to be placed before slot ceil((k + 1) Q / m); of the released
blocks the one with the earliest deadline takes the next slot. Every prefix of the slots then holds less than one
block more or less of a source than its weight says.

Weights are whole parts, so the schedule repeats after Q = sum of parts slots, a cycle, in which each source places as many
blocks as it has parts. A source that runs out takes its last blocks in a cycle with fewer of its parts, and later cycles go
without it, at the weights of those that are left; nothing is dropped. As only a source's end changes the cycle, there are at most
two kinds of cycle for each target besides the first, and each kind is scheduled once, by a fold over its slots.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, checkpointed, met, ranked, row_hashes, width

BLOCK = 16
#: Parts of named sources; all other sources together have the parts REST.
TARGETS, REST = {"src0": 6, "src1": 3, "src2": 3, "src3": 2, "src4": 2}, 14


def _earliest_deadline_first(tasks: Column, slots: Column) -> Column:
    """For each of `slots` slots the place in `tasks` (array of structs with m, blocks to place) of the task that takes it."""

    def step(state: Column, slot: Column) -> Column:
        open_ = F.transform(
            F.filter(
                F.transform(tasks, lambda t, i: F.struct(i.alias("i"), t["m"].alias("m"), F.get(state["done"], i).alias("k"))),
                lambda t: (t["k"] < t["m"]) & (F.floor(t["k"] * slots / t["m"]) <= slot),
            ),
            lambda t: F.struct(F.ceil((t["k"] + 1) * slots / t["m"]).alias("deadline"), t["i"].alias("i")),
        )
        return F.transform(
            F.array(F.array_min(open_)["i"]),  # an array of one value binds it
            lambda i: F.struct(F.transform(state["done"], lambda k, j: F.when(j == i, k + 1).otherwise(k)).alias("done"), F.concat(state["out"], F.array(i)).alias("out")),
        )[0]

    start = F.struct(F.transform(tasks, lambda t: F.lit(0)).alias("done"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), slots - 1), start, step)["out"]


def schedule(blocks: DataFrame) -> DataFrame:
    """Slots for targets (target, parts, blocks): target, part, first, last, slot, slots, m, start.

    Block b of a target is in cycle b div parts; in the cycles from `first` to `last` - 1 its block of number `part` = b mod parts is in slot
    start + (cycle - first) * slots + slot, the target having m blocks in a cycle of `slots` slots. A row for each part of each kind of cycle.
    """
    told = blocks.select("target", "parts", F.expr("blocks div parts").alias("full"), F.expr("cast(blocks % parts as int)").alias("over"))
    ends = told.select(F.explode(F.array(F.lit(0).cast("long"), F.col("full"), F.col("full") + 1)).alias("first")).distinct()
    kinds = ends.select("first", F.lead("first").over(Window.orderBy("first")).alias("last"))  # two for each target at most, and one
    # one row for each target and kind of cycle: targets are given as a parameter
    each = kinds.filter("last is not null").crossJoin(F.broadcast(told)).withColumn(
        "m", F.when(F.col("full") > F.col("first"), F.col("parts")).when(F.col("full") == F.col("first"), F.col("over")).otherwise(0)
    )
    cycles = each.filter("m > 0").groupBy("first", "last").agg(F.sort_array(F.collect_list(F.struct("target", "m"))).alias("tasks"), F.sum("m").cast("int").alias("slots"))
    cycles = cycles.withColumn("start", F.expr("sum((last - first) * slots) over (order by first) - (last - first) * slots"))
    placed = cycles.select("*", F.posexplode(_earliest_deadline_first(F.col("tasks"), F.col("slots"))).alias("slot", "who"))
    taken = placed.select("first", "last", "start", "slots", "slot", F.get("tasks", F.col("who")).alias("t"))
    taken = taken.select("first", "last", "start", "slots", "slot", "t.target", "t.m")
    return taken.withColumn("part", F.row_number().over(Window.partitionBy("first", "target").orderBy("slot")) - 1)


def _in_turns(told: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Rows (target, _source, rank) with block and _at for blocks of one source each, and (target, base, blocks).

    The sources of a target take turns until they run out: its blocks are in the order of their numbers within their sources. Of n sources each is then
    within (n - 1) / n blocks of its share of the target's blocks, and as those are within one of theirs, within one block of its weight.
    """
    begins = told.groupBy("target", "_source").agg(F.min("rank").alias("_begin"))
    told = told.join(begins, ["target", "_source"]).withColumn("_at", F.col("rank") - F.col("_begin")).withColumn("_k", F.expr(f"_at div {block}")).drop("_begin", "rank")
    heads = told.filter(f"_at % {block} = 0").select("target", "_source", "_k")  # a row for each block
    turns, _ = ranked(heads, F.col("target"), F.col("_k"), F.col("_source"))
    sizes = turns.groupBy("target").agg(F.min("rank").alias("base"), F.count(F.lit(1)).alias("blocks"))
    turns = turns.join(F.broadcast(sizes.drop("blocks")), "target").select("target", "_source", "_k", (F.col("rank") - F.col("base")).alias("block"))
    return told.join(turns, ["target", "_source", "_k"]), sizes


def mix(df: DataFrame, targets: dict[str, int] | None = None, rest: int = REST, block: int = BLOCK, keys: tuple[str, ...] = ("doc_id",), each: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Keys of all rows of documents (doc_id, source) with target, block, slot, place, release and deadline, and the columns `carry` as they are.

    Reading by (slot, place) gives the mix; slots are gapless from 0, and release <= slot < deadline. `target` is the source if it is one of
    `targets`, else null: unnamed sources and a null source share the parts `rest`. Null and repeated ids are placed like others; rows whose keys are all null are
    dealt by their number, so they do not fill one task.
    With `each` the sources that share `rest` form blocks of their own and take turns in its slots, so each has an equal share of `rest` as its weight.
    Each row of `df` is in the result once, so a source larger than its weight ends with what is left of the others used up.
    """
    named = TARGETS if targets is None else targets
    parts = F.lit(rest)
    for source, n in named.items():
        parts = F.when(F.col("target") == source, n).otherwise(parts)
    target = F.when(F.col("source").isin(*named), F.col("source")) if named else F.lit(None).cast("string")
    own_source = [F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_source")] if each else []
    none = reduce(and_, (F.col(k).isNull() for k in keys))
    rows = df.select(*keys, *carry, target.alias("target"), *own_source, F.when(none, F.monotonically_increasing_id()).alias("_salt"))
    mixed = F.md5(F.concat_ws(":", *(F.col(k).cast("string") for k in keys)))
    within = ["target", "_source"] if each else ["target"]
    told, _ = ranked(rows.withColumn("_h", mixed), *(F.col(c) for c in within), F.col("_h"), *(F.col(k) for k in keys), F.col("_salt"))
    told = told.drop("_h", "_salt")
    told = told.withColumn("target", F.coalesce("target", F.lit("")))  # joined by equality; no row has "" unless it is named
    if each:
        told, sizes = _in_turns(told, block)
    else:
        sizes = told.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("base"))
        sizes = sizes.withColumn("blocks", F.expr(f"(n + {block - 1}) div {block}"))
    sizes = sizes.withColumn("parts", parts)
    slots = schedule(sizes.select("target", "parts", "blocks"))
    own = told.join(F.broadcast(sizes.select("target", "parts", "base")), "target")  # a row for each target
    if not each:
        own = own.withColumn("_at", F.col("rank") - F.col("base")).withColumn("block", F.expr(f"_at div {block}"))
    own = own.withColumn("_cycle", F.expr("block div parts")).withColumn("part", F.expr("cast(block % parts as int)"))
    taken = own.join(F.broadcast(slots), ["target", "part"]).filter("_cycle >= first and _cycle < last")
    begin = F.col("start") + (F.col("_cycle") - F.col("first")) * F.col("slots")
    return taken.select(
        *keys,
        *carry,
        F.when(F.col("target") != "", F.col("target")).alias("target"),
        "block",
        (begin + F.col("slot")).alias("slot"),
        F.expr(f"cast(_at % {block} as int)").alias("place"),
        (begin + F.floor(F.col("part") * F.col("slots") / F.col("m"))).alias("release"),
        (begin + F.ceil((F.col("part") + 1) * F.col("slots") / F.col("m"))).alias("deadline"),
    )


def keyed(df: DataFrame) -> list[Column]:
    """`_id`, which only orders, of any type and null as it is, and the columns ROW."""
    return [F.col("doc_id").alias("_id"), *row_hashes(df)]


def places(df: DataFrame, **options) -> DataFrame:
    """(_row, _more, slot, place) of all rows of documents, computed once; a place for each of the rows that agree in all columns."""
    found = mix(df.select(*keyed(df), "source"), keys=("_id", "_row"), carry=("_more",), **options)
    return checkpointed(found.select(*ROW, "slot", "place"))


def in_mixed_order(df: DataFrame, **options) -> DataFrame:
    """All rows of documents with all their columns, sorted by (slot, place) over the partitions.

    Rows are matched with their places by hashes of the whole row, so ids may have any type, be null or repeat. Rows that agree in all columns
    are folded to one before they meet their places, so any number of them moves as one text for each task. Where there are none, which one
    look at the narrow places tells, the texts are moved only for the match and for the order. An empty table is returned as it is; other columns may have any names.
    """
    found = places(df, **options)
    times = found.groupBy(*ROW).agg(F.count(F.lit(1)).alias("_times"), F.max("slot").alias("_last"))
    last, most = times.agg(F.max("_last"), F.max("_times")).first()
    if last is None:
        return df  # there are no rows
    # slots are gapless, so equal runs of them are known without the look at the rows that a range partitioning takes
    n = width(df.sparkSession)
    return met(df, found, most > 1).repartitionById(n, F.expr(f"cast(slot * {n} div {last + 1} as int)")).sortWithinPartitions("slot", "place").select("_all.*")
