"""Byte-level BPE encoding and decoding of whole texts, long ones in overlapping chunks.

The table is read once: texts of up to `chunk` code points are encoded where they are read, longer ones are only marked, and both are
kept in the shared folder. A marked text is cut into chunks that overlap by `overlap`. Chunks are separate
rows, dealt over the cluster, and each is pre-tokenised from its own start. The pattern never looks back, so
once two neighbours share a pre-token boundary inside their overlap both go on alike from there: the text is
cut at the first such boundary, and the pieces between cuts are encoded independently. Neighbours without a
common boundary (one pre-token longer than the overlap) are joined again before encoding, so the ids are
those of the whole text whatever the input. Decoding concatenates the raw bytes of the ids.

The library looks ahead in a run of white space with a stack as deep as the run, which ends at about a million characters. Texts with
runs of over `RUN` are split into pre-tokens by a linear matcher, and each is encoded as it is.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, slices, width

CHUNK, OVERLAP, RUN = 32_768, 1_024, 50_000


@lru_cache(maxsize=4)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})


@lru_cache(maxsize=4)
def _whole(path: str):
    """An encoding that takes its input as one pre-token."""
    return _encoding(path, r"(?s:.+)")


@lru_cache(maxsize=4)
def _linear(pattern: str):
    """The pattern with \\s spelled out, as libraries differ over what else is white space than Unicode says."""
    import regex

    spelled = {r"\s": r"\p{White_Space}", r"\S": r"\P{White_Space}"}
    return regex.compile(re.sub(r"\\.", lambda m: spelled.get(m[0], m[0]), pattern, flags=re.DOTALL))


def _long_run(text: str) -> bool:
    return any(m.end() - m.start() > RUN for m in re.finditer(r"\s+", text))


def encoded(text: str, path: str, pattern: str) -> np.ndarray:
    """Ids of a text, as the library gives them."""
    if len(text) <= RUN or not _long_run(text):
        return _encoding(path, pattern).encode_to_numpy(text, disallowed_special=())
    pieces = [_whole(path).encode_to_numpy(m[0], disallowed_special=()) for m in _linear(pattern).finditer(text)]
    return np.concatenate(pieces) if pieces else np.empty(0, np.uint32)


@lru_cache(maxsize=4)
def _vocabulary(path: str) -> tuple[list[bytes], list[bytes]]:
    """Bytes of each id, and its decimal digits."""
    ranks = _ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out, [b"%d" % i for i in range(len(out))]


def boundaries(text: str, pattern: str) -> list[int]:
    """Ends of pre-tokens after a character that is not white space.

    Cutting after white space could change how the run before the cut is split, as the pattern looks ahead.
    """
    return [m.end() for m in _linear(pattern).finditer(text) if not text[m.end() - 1].isspace()]


def _cut(chunk: int, overlap: int):
    """(row, id, piece) to (row, id, last, k, piece), a row for each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column("piece")[i].as_py()
                n = max(1, -(-(len(text) - overlap) // chunk))
                for some in range(0, n, 64):
                    k = np.arange(some, min(n, some + 64), dtype=np.int32)
                    pieces = pa.array([text[j * chunk : j * chunk + chunk + overlap] for j in k.tolist()], pa.string())
                    same = pa.array(np.full(len(k), i))
                    last = pa.array(np.full(len(k), n - 1, np.int32))
                    yield pa.RecordBatch.from_arrays([batch.column("row").take(same), batch.column("id").take(same), last, pa.array(k), pieces], names=["row", "id", "last", "k", "piece"])

    return run


def _pretokenise(pattern: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = batch.to_pydict()
            heads, tails = [], []
            for k, piece, last in zip(cols["k"], cols["piece"], cols["last"], strict=True):
                ends = boundaries(piece, pattern)
                heads.append([k * chunk + e for e in ends if e <= overlap] if k else [])
                # the last pre-token touches the chunk's end and may go on behind it
                tails.append([] if k == last else [k * chunk + e for e in ends if chunk <= e < len(piece)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))],
                names=[*batch.schema.names, "head", "tail"],
            )

    return run


def _listed(ids: list[np.ndarray | None]) -> pa.Array:
    """Arrays of ids as a list column, null for None."""
    offsets = np.r_[0, np.cumsum([0 if x is None else len(x) for x in ids])].astype(np.int32)
    flat = np.concatenate([x for x in ids if x is not None] or [np.empty(0)]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(flat), mask=pa.array([x is None for x in ids]))


def _digest(path: str) -> Callable[[list[np.ndarray | None]], list[pa.Array]]:
    raw, digits = _vocabulary(path)
    sha = lambda parts: hashlib.sha256(parts).digest()

    def run(ids: list[np.ndarray | None]) -> list[pa.Array]:
        own = [None if x is None else x.tolist() for x in ids]
        return [
            pa.array([None if x is None else len(x) for x in own], pa.int64()),
            pa.array([None if x is None else sha(b",".join(map(digits.__getitem__, x))) for x in own], pa.binary()),
            pa.array([None if x is None else sha(b"".join(map(raw.__getitem__, x))) for x in own], pa.binary()),
        ]

    return run


#: What is kept of a text's ids: the columns, and what makes them from the ids of some texts.
IDS = "ids array<int>", lambda path: lambda ids: [_listed(ids)]
DIGESTS = "n_tokens bigint, ids_sha binary, decoded_sha binary", _digest


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _read_once(path: str, pattern: str, chunk: int, kept: tuple):
    """(id, piece) to id, piece of long texts alone, and what is kept of the ids of all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = kept[1](path)
        for whole in batches:
            for begin, end in slices(pc.binary_length(whole.column("piece")).to_numpy(zero_copy_only=False)):
                batch = whole.slice(begin, end - begin)
                texts = batch.column("piece").to_pylist()
                long = [len(t) > chunk for t in texts]
                ids = [None if cut else encoded(t, path, pattern) for t, cut in zip(texts, long, strict=True)]
                aside = pa.array([t if cut else None for t, cut in zip(texts, long, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("id"), aside, *made(ids)], names=["id", "piece", *_names(kept[0])])

    return run


def _encode(path: str, pattern: str):
    """(row, part, piece) to (row, part, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin, end in slices(pc.binary_length(whole.column("piece")).to_numpy(zero_copy_only=False)):
                batch = whole.slice(begin, end - begin)
                ids = _listed([encoded(x.as_py(), path, pattern) for x in batch.column("piece")])
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("part"), ids], names=["row", "part", "ids"])

    return run


def _keep(path: str, kept: tuple):
    """(id, ids) to id and what is kept of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = kept[1](path)
        for whole in batches:
            for begin, end in slices(pc.fill_null(pc.list_value_length(whole.column("ids")), 0).to_numpy(zero_copy_only=False), 1 << 19):
                batch = whole.slice(begin, end - begin)
                ids = [x.values.to_numpy() for x in batch.column("ids")]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *made(ids)], names=["id", *_names(kept[0])])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, _ = _vocabulary(path)
        for whole in batches:
            at = whole.schema.get_field_index("ids")
            keep = [i for i in range(whole.num_columns) if i != at]
            for begin, end in slices(pc.fill_null(pc.list_value_length(whole.column(at)), 0).to_numpy(zero_copy_only=False), 1 << 19):
                batch = whole.slice(begin, end - begin)
                out = [b"".join(map(raw.__getitem__, x or ())) for x in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(out, pa.binary())], names=[*(batch.schema.names[i] for i in keep), "decoded"])

    return run


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, kept: tuple = IDS) -> DataFrame:
    """One row (id, ids array<int>) per row of `df`, or with what else is `kept` of the ids (DIGESTS).

    A null text counts as empty and has no ids; a null or repeated id is carried as it is, repeated rows
    give repeated results; other columns are not read, whatever their names. Texts of any length are encoded whole. An empty table has an empty result.
    """
    spark = df.sparkSession
    columns = _names(kept[0])
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("piece"))
    id_type = rows.schema["id"].dataType.simpleString()
    once = checkpointed(rows.mapInArrow(_read_once(path, pattern, chunk, kept), f"id {id_type}, piece string, {kept[0]}"))
    short = once.filter(F.col("piece").isNull()).select("id", *columns)

    # numbers of rows of a checkpoint, which are the same however often it is read
    aside = once.filter(F.col("piece").isNotNull()).select(F.monotonically_increasing_id().alias("row"), "id", "piece")
    cut = aside.mapInArrow(_cut(chunk, overlap), f"row bigint, id {id_type}, last int, k int, piece string")
    seen = cut.repartition(width(spark), "row", "k").mapInArrow(
        _pretokenise(pattern, chunk, overlap), f"row bigint, id {id_type}, last int, k int, piece string, head array<bigint>, tail array<bigint>"
    )

    w = Window.partitionBy("row").orderBy("k")
    met = seen.withColumn("cut", F.array_min(F.array_intersect("tail", F.lead("head").over(w))))
    met = met.withColumn("from", F.lag("cut").over(w)).withColumn(
        "part", F.sum(F.when(F.lag("cut").over(w).isNotNull(), 1).otherwise(0)).over(w)
    )
    begin = F.coalesce("from", F.col("k").cast("long") * chunk)
    end = F.when(F.col("k") == F.col("last"), F.col("k").cast("long") * chunk + chunk + overlap).otherwise(F.coalesce("cut", (F.col("k").cast("long") + 1) * chunk))
    own = met.select("row", "id", "part", "k", begin.alias("begin"), (end - begin).alias("size"), "piece")
    own = own.select("row", "id", "part", "k", F.expr(f"substring(piece, cast(begin - k * {chunk} as int) + 1, cast(size as int))").alias("piece"))
    joined = own.groupBy("row", "part").agg(F.first("id").alias("id"), F.sort_array(F.collect_list(F.struct("k", "piece"))).alias("p"))
    pieces = joined.select(F.struct("row", "id").alias("row"), "part", F.array_join("p.piece", "").alias("piece")).repartition(width(spark), "row.row", "part")
    coded = pieces.mapInArrow(_encode(path, pattern), f"row struct<row: bigint, id: {id_type}>, part bigint, ids array<int>")
    whole = coded.groupBy("row.row").agg(F.first("row.id").alias("id"), F.sort_array(F.collect_list(F.struct("part", "ids"))).alias("p"))
    long = whole.select("id", F.flatten("p.ids").alias("ids")).mapInArrow(_keep(path, kept), f"id {id_type}, {kept[0]}")
    return short.unionByName(long).withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """`df` with `decoded` (binary, raw bytes of the ids one after the other) for `ids_col`; a null list gives no bytes.

    The other columns are kept, save one already called `decoded`, which it replaces.
    """
    rest = [f for f in df.schema.fields if f.name not in (ids_col, "decoded")]
    rows = df.select(*(F.col(f"`{f.name}`") for f in rest), F.col(ids_col).alias("ids"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + ["decoded binary"])
    return rows.mapInArrow(_decode(path), schema)


def digests(df: DataFrame, path: str, pattern: str, **options) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for documents (doc_id, text): of what `encode` gives and `decode` makes of it.

    A null text counts as empty: no tokens, and the digests of nothing. Null and repeated ids and repeated rows are carried as they are; other columns are not read.
    """
    both = encode(df, path, pattern, kept=DIGESTS, **options)
    return both.select("doc_id", "n_tokens", F.lower(F.hex("ids_sha")).alias("ids_sha256"), F.lower(F.hex("decoded_sha")).alias("decoded_sha256"))
