"""Token counts by rank-synchronous merging of ragged numpy arrays.

Pre-tokens of a batch are held in one flat array of symbols with the start of each. In every round each
sequence that still has a known pair finds its pair of lowest rank and merges all its occurrences at once, all
sequences together; sequences without a known pair leave the array. What survives are the tokens. A merged
symbol only occurs in pairs of higher rank than the merge that made it, so merging all occurrences of one pair
in a round gives what merging them one by one gives; in a run of one symbol, every second pair is taken from
the left.

A sequence of over `LONG` symbols would keep the rounds going for all of its ranks, each over all of its symbols. Such sequences go together
through their ranks in ascending order instead, and a round touches only the places whose pair has the round's rank and their neighbours.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pre-token pattern of byte-level BPE; \s is spelled out, as libraries differ over U+001C to U+001F.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Pre-tokens merged at once, and symbols at most; counts kept per worker before the memory starts anew.
BATCH, BATCH_BYTES, REMEMBERED = 20_000, 1 << 20, 400_000
#: Symbols from which on a sequence is swept rank by rank; it is counted anew wherever it occurs.
LONG = 256


class Merges:
    """Symbols of single bytes, and ranks and results of pairs, from a byte-level BPE model's JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocabulary = model["model"]["vocab"]
        self.special = [t["content"] for t in model["added_tokens"] if t["special"]]
        # the printable bytes stand for themselves, the others for the characters from U+0100 on, in order
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        others = iter(range(256, 512))
        self.byte = np.array([vocabulary[chr(b if b in plain else next(others))] for b in range(256)], np.int64)
        self.size = max(vocabulary.values()) + 1
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["model"]["merges"]]
        keys = np.array([vocabulary[a] * self.size + vocabulary[b] for a, b in pairs], np.int64)
        made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; the number of merges if there is none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], len(self.rank))


def _second(run: np.ndarray) -> np.ndarray:
    """Which of some hits count: of hits that follow each other (`run`: one follows the one before) every second one, from the left."""
    at = np.arange(len(run))
    return (at - np.maximum.accumulate(np.where(run, 0, at))) % 2 == 0


def sweep(symbols: np.ndarray, lengths: np.ndarray, merges: Merges) -> np.ndarray:
    """Number of tokens of each of the sequences that lie in `symbols` one after the other, all of them merged rank by rank."""
    n, none = len(symbols), len(merges.rank)
    symbols, starts = np.r_[symbols, 0], np.cumsum(lengths) - lengths
    after, before = np.arange(1, n + 2), np.arange(-1, n)  # n stands for no symbol
    after[starts + lengths - 1], before[starts] = n, n
    rank = np.full(n + 1, none, np.int64)
    rank[: n - 1] = merges.ranks(symbols[: n - 1], symbols[1:n])
    rank[starts + lengths - 1] = none
    gone = np.zeros(n + 1, bool)
    waiting: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def wait(places: np.ndarray) -> None:
        places = places[rank[places] < none]
        places = places[np.argsort(rank[places], kind="stable")]
        own = rank[places]
        cuts = np.flatnonzero(own[1:] != own[:-1]) + 1
        for some in np.split(places, cuts) if len(places) else ():
            r = int(rank[some[0]])
            if r not in waiting:
                heapq.heappush(heap, r)
                waiting[r] = []
            waiting[r].append(some)

    wait(np.arange(n))
    while heap:
        r = heapq.heappop(heap)
        at = np.unique(np.concatenate(waiting.pop(r)))
        at = at[rank[at] == r]
        if not len(at):
            continue
        at = at[_second(np.r_[False, after[at[:-1]] == at[1:]])]
        right = after[at]
        symbols[at], rank[right], gone[right] = merges.made[r], none, True
        after[at] = after[right]
        before[after[at]] = at
        touched = np.r_[at, before[at]]
        touched = touched[touched < n]
        next_ = after[touched]
        rank[touched] = np.where(next_ < n, merges.ranks(symbols[touched], symbols[next_]), none)
        wait(touched)
    return lengths - np.add.reduceat(gone[:n].astype(np.int64), starts)


def count_symbols(pieces: list[bytes], merges: Merges) -> np.ndarray:
    """Number of tokens of each of `pieces`; 0 for an empty one."""
    lengths = np.array([len(p) for p in pieces], np.int64)
    counts = lengths.copy()
    if len(far := np.flatnonzero(lengths > LONG)):
        counts[far] = sweep(merges.byte[np.frombuffer(b"".join(pieces[i] for i in far), np.uint8)], lengths[far], merges)
    who = np.flatnonzero((lengths > 1) & (lengths <= LONG))  # sequences still in the array
    lengths = lengths[who]
    symbols = merges.byte[np.frombuffer(b"".join(pieces[i] for i in who), np.uint8)]
    none = len(merges.rank)
    while len(who):
        starts = np.cumsum(lengths) - lengths
        rank = np.full(len(symbols), none, np.int64)  # of the pair that begins at each symbol
        rank[:-1] = merges.ranks(symbols[:-1], symbols[1:])
        rank[starts + lengths - 1] = none
        best = np.minimum.reduceat(rank, starts)
        alive = best < none
        if not alive.all():
            counts[who] = lengths
            keep = np.repeat(alive, lengths)
            symbols, rank, who, lengths, best = symbols[keep], rank[keep], who[alive], lengths[alive], best[alive]
            if not len(who):
                break
        hit = rank == np.repeat(best, lengths)
        at = np.flatnonzero(hit)
        at = at[_second(np.r_[False, at[1:] == at[:-1] + 1])]  # of neighbouring hits (one symbol repeated)
        symbols[at] = merges.made[rank[at]]
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        owner = np.repeat(np.arange(len(who)), lengths)
        lengths = lengths - np.bincount(owner[at], minlength=len(who))
        symbols = symbols[stay]
    return counts


@lru_cache(maxsize=2)
def _merges(path: str) -> Merges:
    return Merges(path)


class Counter:
    """Token counts of texts; remembers the counts of pre-tokens that it has seen, up to a bound."""

    def __init__(self, path: str):
        import regex

        self.merges, self.pattern, self.known = _merges(path), regex.compile(PRETOKEN), {}
        self.special = regex.compile("|".join(regex.escape(s) for s in self.merges.special)) if self.merges.special else None

    def learn(self, new: list[str]) -> None:
        raw, size = [], 0
        done = 0
        for i, piece in enumerate(new):
            raw.append(piece.encode("utf-8", "surrogatepass"))
            size += len(raw[-1])
            if len(raw) >= BATCH or size >= BATCH_BYTES or i + 1 == len(new):
                self.known.update(zip(new[done : i + 1], count_symbols(raw, self.merges).tolist(), strict=True))
                raw, size, done = [], 0, i + 1

    def texts(self, texts: list[str]) -> list[int]:
        out = []
        for some in _groups(texts):
            split, pending = [], set()
            for text in some:
                parts = self.special.split(text) if self.special else [text]
                pieces = [p for part in parts for p in self.pattern.findall(part)]
                split.append((len(parts) - 1, pieces))
                pending |= set(pieces).difference(self.known)
            self.learn(list(pending))
            known = self.known
            out += [special + sum(map(known.__getitem__, pieces)) for special, pieces in split]
            for p in pending:
                if len(p) > LONG:
                    del known[p]
            if len(known) > REMEMBERED:
                known.clear()
        return out


def _groups(texts: list[str], most: int = 4 << 20) -> Iterator[list[str]]:
    some, size = [], 0
    for text in texts:
        some.append(text)
        size += len(text)
        if size >= most:
            yield some
            some, size = [], 0
    if some:
        yield some


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit (more than `limit` tokens) for every row.

    A null text counts as empty: 0 bytes, 0 tokens. Null and repeated ids are carried as they are; other columns
    are not read. A special token's string inside a text is that one token. Texts are counted whole.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in batches:
            counts = counter.texts(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    counted = rows.withColumn("n_bytes", F.octet_length("text").cast("long")).mapInArrow(
        run, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint"
    )
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
