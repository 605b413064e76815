"""Shards of equal row counts along a Hilbert curve over several metadata dimensions.

Every dimension is quantised to `BITS` bits, a row's cell gets its index on the Hilbert curve, rows are ranked by
curve index (ties by text checksum, size and id, so equal texts lie side by side) and the ranking is cut into runs
whose row counts differ by one at most. A run covers few values of each dimension, so a reader that filters by any of
them skips most shards by their minima and maxima.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, met, ranked, repeats, row_hashes

BITS, SHARDS = 5, 16


def _gray(x: int) -> int:
    return x ^ (x >> 1)


def hilbert_steps(dims: int) -> tuple[list[int], list[int]]:
    """(digit, next state) for state * 2^dims + bits: the curve as an automaton that reads one bit of each dimension a step.

    A state is the entry corner and the direction of the sub-cube: corner * dims + direction.
    """
    side, digits, nexts = 1 << dims, [], []
    turn = lambda x, n: ((x << n % dims) | (x >> (dims - n % dims))) & (side - 1)  # noqa: E731  rotates to the left
    inverse = {_gray(i): i for i in range(side)}

    def entry(w: int) -> int:
        return 0 if w == 0 else _gray(2 * ((w - 1) // 2))

    def direction(w: int) -> int:
        v = w if w % 2 else w - 1
        return 0 if w == 0 else ((v ^ (v + 1)).bit_length() - 1) % dims  # ones at the low end of v

    for corner in range(side):
        for towards in range(dims):
            for bits in range(side):
                w = inverse[turn(bits ^ corner, dims - (towards + 1) % dims)]
                digits.append(w)
                nexts.append((corner ^ turn(entry(w), towards + 1)) * dims + (towards + direction(w) + 1) % dims)
    return digits, nexts


def hilbert(*dims: Column, bits: int = BITS) -> Column:
    """Index on the Hilbert curve of cells given by `dims`, each an int from 0 to 2^bits - 1."""
    n = len(dims)
    digits, nexts = hilbert_steps(n)
    digit, following = F.array(*map(F.lit, digits)), F.array(*map(F.lit, nexts))
    read = F.lit(0).cast("bigint")
    # the bits of one level side by side, levels from high to low
    levels = F.array(*(sum((F.shiftright(d, b).bitwiseAND(F.lit(1)) * (1 << i) for i, d in enumerate(dims)), F.lit(0)) for b in range(bits - 1, -1, -1)))

    def step(state: Column, level: Column) -> Column:
        at = state["s"] * (1 << n) + level
        return F.struct((state["h"] * (1 << n) + F.get(digit, at)).alias("h"), F.get(following, at).alias("s"))

    return F.aggregate(levels, F.struct(read.alias("h"), F.lit(0).alias("s")), step)["h"]


def documents_cell(df: DataFrame) -> list[Column]:
    """Dimensions of documents: source and language by checksum, binary digits of the size. Missing columns or nulls count as 0."""
    side = 1 << BITS

    def named(c: str) -> Column:
        return F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(side)).cast("int") if c in df.columns else F.lit(0)

    digits = F.length(F.bin("size"))
    return [F.coalesce(named("source"), F.lit(0)), F.coalesce(named("lang"), F.lit(0)), F.least(digits, F.lit(side - 1))]


def shard(df: DataFrame, shards: int = SHARDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, curve and the columns `carry` for every row of documents (doc_id, text[, source, lang]).

    Law `rows`: shard s holds the ranks from ceil(s * n / shards) on. A null text has no bytes, so size 1 and checksum 0; null and
    repeated ids are placed like others (rows that agree in all that is ranked may swap places); rows without an id are dealt by their number, so those of one text
    do not fill one task. grown_shard is null. An empty table has an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    told = df.withColumn("size", F.octet_length(text).cast("long") + 1)
    cell = documents_cell(told)
    salt = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).alias("_salt")
    told = told.select("doc_id", *carry, salt, "size", F.crc32(text.cast("binary")).alias("text_crc32"), hilbert(*cell).alias("curve"))
    out, sizes = ranked(told, F.col("curve"), F.col("text_crc32"), F.col("size"), F.col("doc_id"), F.col("_salt"), once=True)  # texts are read once
    out = out.crossJoin(F.broadcast(sizes.agg(F.sum("_n").alias("_all"))))  # one row
    out = out.withColumn("shard", F.expr(f"(rank * {shards}) div _all").cast("int"))
    first = F.expr(f"(shard * _all + {shards - 1}) div {shards}")
    return out.select(
        "doc_id", *carry, "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("rank") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve"
    )


def write_shards(df: DataFrame, path: str, shards: int = SHARDS) -> str:
    """Writes documents in curve order, one folder for each shard, with all rows and columns of `df`; the name of the column that the folders stand for.

    That is `shard`, followed by as many `_` as it takes to clash with no column of `df`. Rows are matched with their shards by hashes of the whole row, so ids may have
    any type, be null or repeat; rows that agree in all columns are each written.
    """
    taken, name = {c.lower() for c in df.columns}, "shard"
    while name in taken:
        name += "_"
    whole = df.select(*(c for c in ("doc_id", "text", "source", "lang") if c in df.columns), *row_hashes(df))
    places = shard(whole, shards, tuple(ROW)).select(*ROW, F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    rows = met(df, places, repeats(places)).repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot")
    rows.select("_all.*", F.col("_shard").alias(name)).write.partitionBy(name).mode("overwrite").parquet(path)
    return name
