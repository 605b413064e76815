"""Exact top-k inner products over norm-sorted blocks.

All vectors are ranked by descending length and packed into blocks, queries into larger stripes, both as integers of as few bytes as hold them. Each
stripe first meets the block of the longest vectors, which gives every query a lower bound of its k-th score. A block then goes to
a stripe only if the product of lengths can reach that bound for one of its queries. It goes there once: a task holds one stripe and is
given blocks in the order of their lengths, one at a time, so bounds grow from block to block. Blocks of a stripe are dealt to as many lanes
as it takes to keep all tasks busy.

Inside a meeting, vectors are rotated to the directions of an SVD (of the Gram matrix, summed over all vectors), so the first
coordinates hold most of the length; the partial sum over these plus the product of the lengths of the rest (Cauchy-Schwarz) bounds each
score. Only pairs whose bound reaches the k-th score so far can enter a result; they are scored in whole numbers, one by one where they are few, as a
product of the rows and columns that hold them where they are many. Nothing is dropped by an estimate: bounds are widened by more than
the rounding of floating point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, ranked, width

K, EVERY, UNITS = 20, 20, 64
#: Vectors of up to 64 components in a block of candidates and in a stripe of queries, fewer of longer ones.
BLOCK, QUERY_BLOCK = 2_048, 32_768
#: Pairs looked at at once, rotated coordinates summed before pruning, and the share of pairs up to which they are scored one by one.
PAIRS, LEADING, SPARSE = 1 << 21, 16, 0.02


def whole(vector: Column, units: int = UNITS) -> Column:
    """floor(units * x) of every component, as longs."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * units).cast("long"))


def usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return vector.isNotNull() & F.forall(vector, finite)


def gram(vectors: DataFrame) -> DataFrame:
    """(dim, i, j, g): sums of v_i * v_j over all vectors v of `vectors` (dim, v), added up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            v = batch.column("v")
            for dim in np.unique(dims[dims > 0]).tolist():
                rows = v.filter(pa.array(dims == dim)).flatten().to_numpy().astype(np.float64).reshape(-1, dim)
                sums[dim] = sums.get(dim, 0) + rows.T @ rows
        for dim, g in sums.items():
            i, j = np.indices(g.shape)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(g.size, dim, np.int32)), pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(g.ravel())], names=["dim", "i", "j", "g"])

    return vectors.select("dim", "v").mapInArrow(run, "dim int, i int, j int, g double").groupBy("dim", "i", "j").agg(F.sum("g").alias("g"))


def rotations(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Orthonormal directions by descending singular value for each number of dimensions; dim * dim numbers reach the driver."""
    out = {}
    for dim, some in gram(vectors).toPandas().groupby("dim"):
        g = np.zeros((dim, dim))
        g[some["i"], some["j"]] = some["g"]
        out[int(dim)] = np.linalg.svd(g, hermitian=True)[0]
    return out


def _narrow(v: np.ndarray) -> np.ndarray:
    """The same integers in as few bytes as hold them."""
    least, most = v.min(initial=0), v.max(initial=0)
    return v.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= least and most <= np.iinfo(t).max))


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("rank")
    v = _narrow(np.array(pdf["v"].tolist(), np.int64).reshape(len(pdf), -1))
    longs = lambda c: pdf[c].to_numpy(np.int64).tobytes()
    return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], "block": [pdf["block"].iloc[0]], "longest": [float(np.sqrt(pdf["square"].max()))], "ranks": [longs("rank")], "ids": [longs("vec_id")], "bytes": [v.itemsize], "data": [v.tobytes()]})


def packed(rows: DataFrame, size: int) -> DataFrame:
    """One row for each block of `size` places, or fewer of vectors of over 64 components: dim, block, longest, ranks and ids as bytes of longs, data as bytes of integers of `bytes` bytes."""
    block = F.expr(f"place div greatest(1, {size * 64} div greatest(64, dim))")
    schema = "dim int, block bigint, longest double, ranks binary, ids binary, bytes int, data binary"
    return rows.withColumn("block", block).groupBy("dim", "block").applyInPandas(_pack, schema)


class Best:
    """The k best vectors of each query among those met so far."""

    def __init__(self, queries: np.ndarray, own: np.ndarray, bound: np.ndarray, rotation: np.ndarray, k: int = K, leading: int = LEADING):
        self.queries, self.k, self.leading, self.rotation = queries, k, leading, rotation
        self.big, self.best = int(np.abs(queries).max(initial=0)), bound.astype(np.float64).copy()
        self.by_rank, self.own = np.argsort(own, kind="stable"), np.sort(own)
        turned = queries @ rotation
        self.head, self.rest = turned[:, :leading], np.linalg.norm(turned[:, leading:], axis=1)
        self.slack = 1e-9 * (1 + np.linalg.norm(turned, axis=1))[:, None]
        self.found, self.waiting = [(np.empty(0, np.int64),) * 3], 0
        self.kinds: dict[type, np.ndarray] = {}

    def _as(self, kind: type) -> np.ndarray:
        if kind not in self.kinds:
            self.kinds[kind] = self.queries.astype(kind)
        return self.kinds[kind]

    def meet(self, vectors: np.ndarray, ranks: np.ndarray, ids: np.ndarray, step: int | None = None) -> None:
        """`ranks` tell the queries' own vectors, which are no candidates of theirs."""
        sums = self.big * int(np.abs(vectors).max(initial=0)) * self.queries.shape[1]
        kind = np.float32 if sums < 2**24 else np.float64 if sums < 2**53 else np.int64  # floating point holds the sums exactly below that
        q, c = self._as(kind), vectors.astype(kind)
        turned = vectors @ self.rotation
        rest, lengths = np.linalg.norm(turned[:, self.leading :], axis=1), 1 + np.linalg.norm(turned, axis=1)
        step = step or max(16, PAIRS // max(1, len(q)))
        for i in range(0, len(c), step):
            part = slice(i, i + step)
            can = self.head @ turned[part, : self.leading].T + np.outer(self.rest, rest[part]) + self.slack * lengths[part] >= self.best[:, None]
            at = np.minimum(np.searchsorted(self.own, ranks[part]), len(self.own) - 1)
            same = np.flatnonzero(self.own[at] == ranks[part])
            can[self.by_rank[at[same]], same] = False
            n = np.count_nonzero(can)
            if n <= SPARSE * can.size:
                a, b = np.nonzero(can)
                score = np.concatenate([np.einsum("ij,ij->i", q[a[j : j + 65_536]], c[part][b[j : j + 65_536]]) for j in range(0, len(a), 65_536)] or [np.empty(0)])
                keep = score >= self.best[a]
                a, b, score = a[keep], b[keep], score[keep]
            else:
                rows, columns = np.flatnonzero(can.any(axis=1)), np.flatnonzero(can.any(axis=0))
                scores = q[rows] @ c[part][columns].T
                a, b = np.nonzero((scores >= self.best[rows, None]) & can[np.ix_(rows, columns)])
                score, a, b = scores[a, b], rows[a], columns[b]
            self.found.append((a, ids[part][b], score.astype(np.int64)))
            self.waiting += len(a)
            if self.waiting > self.k * len(q):
                self.sift()

    def sift(self) -> None:
        """Leaves the k best of each query, ties to the smaller id, and raises the bounds to the k-th scores."""
        q, v, s = (np.concatenate(x) for x in zip(*self.found, strict=True))
        order = np.lexsort((v, -s, q))
        q, v, s = q[order], v[order], s[order]
        nth = np.arange(len(q)) - np.searchsorted(q, np.arange(len(self.queries)))[q]
        last, stay = nth == self.k - 1, nth < self.k
        self.best[q[last]] = np.maximum(self.best[q[last]], s[last])
        self.found, self.waiting = [(q[stay], v[stay], s[stay])], 0

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of the k best; those below the bounds given may be missing."""
        self.sift()
        return self.found[0]


def _longs(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.int64)


def _vectors(row: dict) -> np.ndarray:
    n = len(row["ids"]) // 8
    return np.frombuffer(row["data"], f"i{row['bytes']}").astype(np.int64).reshape(n, -1 if n and row["dim"] else row["dim"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _seed(rotation: dict[int, np.ndarray], k: int):
    """The k-th scores that a stripe's queries have among the longest vectors, and the least length that a vector needs to matter for any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            stripe, block = ({n: row[p + n] for n in ("ranks", "ids", "bytes", "data")} | {"dim": row["dim"]} for p in ("", "b_"))
            queries = _vectors(stripe)
            found = Best(queries, _longs(stripe["ranks"]), np.full(len(queries), -np.inf), rotation.get(row["dim"], np.zeros((0, 0))), k)
            found.meet(_vectors(block), _longs(block["ranks"]), _longs(block["ids"]))
            found.sift()
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where(found.best <= 0, 0.0, found.best / np.linalg.norm(queries, axis=1))  # a score of 0 is reached by a vector of any length
            least = float(need.min(initial=np.inf)) * (1 - 1e-9)
            yield pa.RecordBatch.from_pylist([{"dim": row["dim"], "stripe": row["stripe"], "bounds": found.best.tobytes(), "least": least}], pa.schema([("dim", pa.int32()), ("stripe", pa.int64()), ("bounds", pa.binary()), ("least", pa.float64())]))

    return run


_MET = "query bigint, query_id bigint, vec_id bigint, score bigint"


def _meet(rotation: dict[int, np.ndarray], k: int):
    """Rows sorted by (dim, stripe, lane, nr): of each lane the stripe, then blocks. One stripe and one block are held at a time."""

    def told(now: Best, row: dict) -> pa.RecordBatch:
        q, v, s = now.result()
        return pa.RecordBatch.from_arrays([pa.array(_longs(row["ranks"])[q]), pa.array(_longs(row["ids"])[q]), pa.array(v), pa.array(s)], names=["query", "query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stripe = None, {}
        for row in _rows(batches):
            if row["nr"] < 0:
                if now:
                    yield told(now, stripe)
                stripe = row
                now = Best(_vectors(row), _longs(row["ranks"]), np.frombuffer(row["bounds"], np.float64), rotation.get(row["dim"], np.zeros((0, 0))), k)
            else:
                now.meet(_vectors(row), _longs(row["ranks"]), _longs(row["ids"]))
        if now:
            yield told(now, stripe)

    return run


def top_k(df: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every` its k highest integer inner products.

    Vectors that are null or hold null or non-finite components take no part; vectors of different lengths never meet; a null id is no query
    and sorts before others on ties. Every row but the query's own is a candidate, so repeated rows meet each other. An empty table
    has an empty result. Other columns are not read.
    """
    n = width(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("e")).filter(usable(F.col("e")))
    rows = rows.select("vec_id", F.size("e").alias("dim"), whole(F.col("e")).alias("v"))
    rows = rows.withColumn("square", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).withColumn("vec_id", F.coalesce("vec_id", F.lit(-(1 << 63))))
    told, _ = ranked(rows, F.col("dim"), F.col("square").desc(), F.col("vec_id"))
    first = told.groupBy("dim").agg(F.min("rank").alias("base"))  # a row for each number of dimensions
    placed = told.join(F.broadcast(first), "dim").withColumn("place", F.col("rank") - F.col("base")).drop("base")
    turned = rotations(told)
    blocks = checkpointed(packed(placed, BLOCK))
    stripes = checkpointed(packed(placed.filter(F.col("vec_id") % every == 0), QUERY_BLOCK * every).drop("longest").withColumnRenamed("block", "stripe"))
    longest = blocks.filter("block = 0").select("dim", *(F.col(c).alias(f"b_{c}") for c in ("ranks", "ids", "bytes", "data")))
    seeds = checkpointed(stripes.join(longest, "dim").repartition(n, "dim", "stripe").mapInArrow(_seed(turned, k), "dim int, stripe bigint, bounds binary, least double"))

    # which blocks matter for which stripe: blocks are split by a salt, as there may be one number of dimensions only
    salted = seeds.select("dim", "stripe", "least", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("salt"))
    narrow = blocks.select("dim", "block", "longest", F.pmod("block", F.lit(n)).cast("int").alias("salt"))
    n_stripes, n_blocks = max(1, stripes.count()), max(1, blocks.count())
    lanes = max(1, min(n_blocks, 3 * n // n_stripes))
    pairs = narrow.join(salted, ["dim", "salt"]).filter("longest >= least").select("dim", "stripe", "block")
    columns = ["dim", "stripe", "lane", "nr", "bounds", "ranks", "ids", "bytes", "data"]
    sent = pairs.join(blocks, ["dim", "block"]).select("dim", "stripe", (F.col("block") % lanes).cast("int").alias("lane"), F.col("block").alias("nr"), F.lit(None).cast("binary").alias("bounds"), *columns[5:])
    asked = stripes.join(seeds.drop("least"), ["dim", "stripe"]).select("*", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(-1).cast("long").alias("nr"))
    dealt = asked.select(*columns).unionByName(sent).repartition(max(n, lanes * n_stripes), "dim", "stripe", "lane").sortWithinPartitions("dim", "stripe", "lane", "nr")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    out = dealt.mapInArrow(_meet(turned, k), _MET).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", F.nullif("vec_id", F.lit(-(1 << 63))).alias("vec_id"), "score")
