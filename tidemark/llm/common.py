"""What the corpus operators share: reading, checkpoint folder, global ranks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_folder

#: Spark's option to remove shuffle files when a query has ended; ASCII white space, the only separators of the word contracts.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(spark: SparkSession) -> int:
    """Number of shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` computed once and cut from its lineage, in the folder that the cluster shares (see `shared_folder`).

    With `spark.cleaner.referenceTracking.cleanCheckpoints` its files go when nothing refers to them any more. The shuffle files that it took
    to compute go at once, as nothing reads them again.
    """
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # planned anew, with the option
    finally:
        spark.conf.set(CLEAN_UP, before)


#: What tells rows apart when they are matched: two hashes of all columns, 96 bits together.
ROW = ["_row", "_more"]
#: Narrow rows of one key that a task takes in any case.
FEW = 1_000_000


def row_hashes(df: DataFrame) -> list[Column]:
    """The columns ROW."""
    whole = [F.col(f"`{c}`") for c in df.columns]
    return [F.xxhash64(*whole).alias("_row"), F.hash(*whole).alias("_more")]


def only(df: DataFrame, stay: DataFrame, repeated: bool) -> DataFrame:
    """The rows of `df` whose hashes are in `stay` (_row, _more), with all their columns; of rows that agree in all columns one.

    With `repeated` rows that agree are folded in their tasks before they are moved, so any number of them moves as one row for each task.
    """
    own = df.select(*row_hashes(df), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_all"))
    if repeated:
        own = own.groupBy(*ROW).agg(F.first("_all").alias("_all"))
    return own.join(stay.select(*ROW), ROW).select("_all.*")


def met(df: DataFrame, found: DataFrame, repeated: bool) -> DataFrame:
    """`found` (_row, _more, ...), which has a row for each row of `df`, with that row's columns as the struct `_all`.

    With `repeated` rows that agree in all columns are folded in their tasks before they meet theirs in `found`, so any number of them moves as one row for each task.
    """
    whole = df.select(*row_hashes(df), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_all"))
    if not repeated:
        return whole.join(found, ROW)
    again = found.groupBy(*ROW).count().filter("count > 1").select(*ROW)
    folded = whole.join(again, ROW, "left_semi").groupBy(*ROW).agg(F.first("_all").alias("_all"))
    return whole.join(found.join(again, ROW, "left_anti"), ROW).unionByName(folded.join(found, ROW))


def repeats(rows: DataFrame) -> bool:
    """Whether any of `rows` (_row, _more, ...) agree in their hashes."""
    return rows.groupBy(*ROW).count().filter("count > 1").limit(1).count() > 0


def joined(rows: DataFrame, per_key: DataFrame, key: str, total: int, few: int | None = None) -> DataFrame:
    """`rows` joined by `key` with `per_key`, which has a row for each key and in `n` at least the number of its rows; `total` is the sum of all n; `few` is FEW unless rows are wide.

    Keys of more rows than a quarter of what a task takes on average are not moved: there are at most four for each task, so their rows of `per_key` are broadcast,
    whatever the data. All others are joined by a shuffle in which no key can fill a task.
    """
    most = max(FEW if few is None else few, total // (4 * width(rows.sparkSession)))
    if total <= most:  # no key can have more
        return rows.join(per_key.drop("n"), key)
    hot = F.broadcast(per_key.filter(F.col("n") > most).drop("n"))
    rest = rows.join(hot.select(key), key, "left_anti").join(per_key.filter(F.col("n") <= most).drop("n"), key)
    return rows.join(hot, key).unionByName(rest)


def slices(lengths: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Runs of rows whose lengths add up to `most` at most, or single rows; what is held as Python objects stays small."""
    ends = np.cumsum(lengths)
    begin = 0
    while begin < len(lengths):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + most, "right")))
        yield begin, end
        begin = end


def in_slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of a few MB of the string column each."""
    for batch in batches:
        for begin, end in slices(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)):
            yield batch.slice(begin, end - begin)


def ranked(df: DataFrame, *order: Column, once: bool = False) -> tuple[DataFrame, DataFrame]:
    """`df` with `rank` (long, gapless from 0) in the total order `order`, and its per-partition counts.

    Rows are dealt by range, so no key can fill one task as long as `order` ends in something that tells
    rows apart; a row's rank is its place in its partition plus the sizes of the partitions before, of
    which there are as many as shuffle partitions. Give it narrow rows: it checkpoints them once, so that
    counts and places come from one and the same dealing even after executors are lost. Dealing by range looks at the rows twice, for
    the bounds and for the rows; with `once` rows that are dear to compute are checkpointed before.
    """
    spark = df.sparkSession
    if once:
        df = checkpointed(df)
    dealt = checkpointed(df.repartitionByRange(width(spark), *order).sortWithinPartitions(*order))
    placed = dealt.select(
        "*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")
    )
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(F.col("_part"), F.expr("sum(_n) over (order by _part) - _n").alias("_before"))
    out = placed.join(F.broadcast(before), "_part").withColumn("rank", F.col("_before") + F.col("_at"))
    return out.drop("_part", "_at", "_before"), sizes
