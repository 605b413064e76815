"""SimHash near-duplicates by anchor-point covering.

A fingerprint's 64 bits are split into blocks of 23, 23 and 18 bits. The anchors are the triples of codewords
of the binary Golay code of length 23, which covers every word of a block within radius 3 by exactly one
codeword. A fingerprint lives at its own anchor, and is replicated to every anchor at which a fingerprint of
at most `THRESHOLD` differing bits can live: codewords within radius 3 + i of a block, the i adding up to the
threshold. So any two that close meet where either lives, and are compared there; 2^36 anchors keep the meetings few
however many fingerprints there are. Only distinct fingerprints take part: copies are folded
before, and get their class by a join at the end.

Links are contracted to components by alternating large-star and small-star rounds, whose number grows with the
logarithm of a component's size; nothing is collected and each round is checkpointed in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, checkpointed, in_slices, joined, only, repeats, row_hashes, width

THRESHOLD, SHINGLE, SEED = 2, 3, 42
BLOCKS = ((0, 23), (23, 23), (46, 18))
#: Anchors of a fingerprint on average, and replicas that a task makes.
REPLICAS, TASK_ROWS = 119, 1 << 22
#: Generator polynomial of the binary Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101


# ---- fingerprints


def split(text: str | None) -> list[bytes]:
    """A text's words, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space alone


def shingles(words: list[bytes], size: int = SHINGLE) -> Iterable[bytes]:
    """Every run of `size` words; the whole sequence if it has fewer; none of no words."""
    if len(words) < size:
        return [b" ".join(words)] if words else []
    return map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))


def hashed(some: Iterable[bytes]) -> np.ndarray:
    """XXH64 (seed 42) of each."""
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, some, repeat(SEED)), np.uint64)


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of the shingles of a text's words, A-Z in lower case; the whole sequence if it has fewer words."""
    return hashed(shingles(split(text), size))


def fingerprint(hashes: np.ndarray, block: int = 1 << 16) -> int:
    """A bit is 1 if it is set in over half of `hashes`; 0 for none."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), block):
        counts += np.unpackbits(hashes[i : i + block].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint as a signed long) for every row; a null text counts as empty."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text"):
            prints = np.array([fingerprint(shingle_hashes(t)) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(prints.view(np.int64))], names=["id", "print"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, print bigint")


# ---- anchors


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


@lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, np.ndarray, list[list[np.ndarray]]]:
    """Syndrome of each 23-bit word's low bits by table; coset leaders; for each leader the codewords near it by radius."""
    words = np.arange(1 << 12, dtype=np.int64)
    codewords = np.zeros(1 << 12, np.int64)
    for i in range(12):
        codewords ^= np.where(words >> i & 1, GOLAY << i, 0)
    errors = [0] + [sum(1 << b for b in bits) for n in (1, 2, 3) for bits in _choices(23, n)]
    leaders = np.zeros(1 << 11, np.int64)
    errors = np.array(errors, np.int64)
    leaders[_syndrome(errors)] = errors
    near = []
    for leader in leaders:
        distance = _popcount(codewords ^ leader)
        near.append([codewords[distance == 0] if r < 0 else codewords[(distance <= 3 + r) & (distance > (3 + r - 1 if r else -1))] for r in range(THRESHOLD + 1)])
    return codewords, leaders, near


def _choices(n: int, k: int):
    from itertools import combinations

    return combinations(range(n), k)


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words divided by the generator."""
    rest = words.copy()
    for i in range(22, 10, -1):
        rest ^= np.where(rest >> i & 1, GOLAY << (i - 11), 0)
    return rest


def _message(words: np.ndarray) -> np.ndarray:
    """A codeword's 12 high bits, which tell it from the others."""
    return words >> 11


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Leaders by syndrome, and for each further radius the offsets and messages of the codewords there, flat."""
    _, leaders, near = _golay()
    flat = []
    for r in range(1, THRESHOLD + 1):
        sizes = np.array([len(x[r]) for x in near], np.int64)
        flat.append((np.r_[0, np.cumsum(sizes)], _message(np.concatenate([x[r] for x in near]))))
    return leaders, flat


def _split(prints: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Syndrome and own codeword's message of every block."""
    leaders, _ = _tables()
    out = []
    for at, size in BLOCKS:
        word = (prints >> np.uint64(at) & np.uint64((1 << size) - 1)).astype(np.int64)
        syndrome = _syndrome(word)
        out.append((syndrome, _message(word ^ leaders[syndrome])))
    return out


def _ring(syndrome: np.ndarray, own: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, message) of the codewords that a block reaches with r changed bits and not with fewer."""
    offsets, messages = _tables()[1][r - 1]
    begin, size = offsets[syndrome], offsets[syndrome + 1] - offsets[syndrome]
    row = np.repeat(np.arange(len(syndrome)), size)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    return row, messages[np.repeat(begin, size) + nth] ^ own[row]


def own_anchor(prints: np.ndarray) -> np.ndarray:
    """The one anchor within the covering radius in every block, as 36 bits."""
    return sum(own << (12 * i) for i, (_, own) in enumerate(_split(prints)))


def anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of every anchor at which a fingerprint within the threshold of `prints[row]` can live, each once."""
    blocks = _split(prints)
    base = sum(own << (12 * i) for i, (_, own) in enumerate(blocks))
    rows, found = [np.arange(len(prints))], [base]
    single = []
    for i, (syndrome, own) in enumerate(blocks):
        for r in range(1, THRESHOLD + 1):
            row, message = _ring(syndrome, own, r)
            other = (message ^ own[row]) << (12 * i)  # what changes in the anchor
            rows.append(row)
            found.append(base[row] ^ other)
            if r == 1:
                single.append((row, other))
    for i in range(len(blocks)):  # one changed bit in each of two blocks
        for j in range(i + 1, len(blocks)):
            (row, a), (row_b, b) = single[i], single[j]
            size = np.bincount(row_b, minlength=len(prints))
            begin = np.cumsum(size) - size
            many = np.repeat(row, size[row])
            nth = np.arange(len(many)) - np.repeat(np.cumsum(size[row]) - size[row], size[row])
            rows.append(many)
            found.append(base[many] ^ np.repeat(a, size[row]) ^ b[begin[many] + nth])
    return np.concatenate(rows), np.concatenate(found)


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column("print").to_numpy(zero_copy_only=False).view(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(own_anchor(prints)), batch.column("print")], names=["anchor", "a"])


def _replicas(batches: Iterator[pa.RecordBatch], block: int = 2_000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        signed = batch.column("print").to_numpy(zero_copy_only=False)
        for i in range(0, len(signed), block):
            some = signed[i : i + block]
            row, anchor = anchors(some.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(some[row])], names=["anchor", "b"])


def links(prints: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Every pair a < b of the distinct fingerprints `prints` (print) that differ in at most `threshold` bits, once."""
    if threshold > THRESHOLD:
        raise ValueError(f"the anchors are laid out for at most {THRESHOLD} differing bits")
    prints = checkpointed(prints.select("print"))
    own = prints.mapInArrow(_own, "anchor bigint, a bigint")
    # dealt by the size after replication: a checkpoint may hold its rows in a few partitions
    n = max(width(prints.sparkSession), -(-prints.count() * REPLICAS // TASK_ROWS))
    all_ = prints.repartition(n, "print").mapInArrow(_replicas, "anchor bigint, b bigint")
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)
    return all_.join(own.hint("shuffle_hash"), (own["anchor"] == all_["anchor"]) & close).select("a", "b")


# ---- components


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b), root being the smallest node that can be reached."""

    def told(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    # larger node first
    now = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    state = told(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = joined(both.filter("b > a"), least, "a", 2 * state[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        moved = joined(large, least, "a", 2 * state[0])
        small = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(moved.select("a", F.col("m").alias("b")))
        now = checkpointed(small.filter("a <> b").distinct())
        before, state = state, told(now)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id, the smallest id reachable over links, for every row.

    A null text counts as empty; texts without words have fingerprint zero and link like any other. Repeated rows
    give repeated results; a null id is no candidate for component_id, which is null where a component has null
    ids only. Other columns are not read.
    """
    prints = checkpointed(fingerprints(df, id_col, text_col))
    found = classes(prints, F.min("id"), threshold)
    known = found.select("print", F.col("least").alias("component_id"), "n")
    total = found.agg(F.sum("n")).first()[0] or 0
    return joined(prints, known, "print", total).select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def classes(prints: DataFrame, least: Column, threshold: int = THRESHOLD) -> DataFrame:
    """(print, root, n, least) for each distinct fingerprint of `prints` (id, print): its class, its rows, and the least `least` of the class."""
    distinct = checkpointed(prints.groupBy("print").agg(least.alias("own"), F.count(F.lit(1)).alias("n")))
    roots = components(links(distinct, threshold))
    placed = distinct.join(roots, distinct["print"] == roots["node"], "left").select("print", "own", "n", F.coalesce("root", "print").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("own").alias("least"), F.count(F.lit(1)).alias("_prints"))
    total = F.col("_prints").alias("n")
    placed = placed.withColumnRenamed("n", "_n")
    many = distinct.count()
    return checkpointed(joined(placed, smallest.select("root", "least", total), "root", many).select("print", "root", F.col("_n").alias("n"), "least"))


def one_of_each(df: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of `df` (doc_id, text, ...) without all but one of each group of near-duplicates.

    The row of the smallest doc_id stays (null last), of those the one of the smallest hash of its text, then of all its columns; of rows that agree
    in all columns one. Ids may have any type, be null or repeat; a null text counts as empty; other columns may have any names.
    """
    ranks = F.struct(F.col("doc_id").isNull().alias("_none"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_said"), *row_hashes(df)).alias("id")
    prints = checkpointed(fingerprints(df.select(ranks, "text"), "id", "text"))
    stay = classes(prints, F.min("id"), threshold).groupBy("root").agg(F.first("least").alias("least"))
    return only(df, stay.select(*(F.col(f"least.{c}").alias(c) for c in ROW)), repeats(prints.select(*(F.col(f"id.{c}").alias(c) for c in ROW))))
