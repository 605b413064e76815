"""The mix in the pipeline's result."""

import collections
import random

import pyarrow.parquet as pq

import corpus_pipeline
from tests.llm.test_corpus import docs, plain_mix
from tidemark.llm import mixing

DATA = "/root/testdata/sf0.001"


def test_result_follows_the_plain_schedule(spark):
    source = {r["doc_id"]: r["source"] for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()}
    got = sorted(corpus_pipeline.run(spark, DATA).collect(), key=lambda r: (r["slot"], r["place"]))
    target = lambda r: s if (s := source[r["doc_id"]]) in mixing.TARGETS else ""
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["slot"]].append(r)
    assert all([r["place"] for r in some] == list(range(len(some))) and len({target(r) for r in some}) == 1 for some in slots.values())
    blocks = collections.Counter(target(some[0]) for some in slots.values())
    assert [target(slots[i][0]) for i in range(len(slots))] == plain_mix(blocks, {t: mixing.TARGETS.get(t, mixing.REST) for t in blocks})


def test_slots_of_tokens_are_those_of_the_mixed_order(spark):
    rows = [(i or None, f"text {i} " * (9000 if i == 7 else 1), f"src{i % 9}", "en") for i in range(300)]  # one text in chunks
    frame = docs(spark, rows + rows[:3])
    mixed = [r["doc_id"] for r in corpus_pipeline.mixing_sources(spark, frame, DATA).collect()]
    got = corpus_pipeline.tokens(spark, frame.orderBy("text"), DATA).collect()
    assert [r["doc_id"] for r in sorted(got, key=lambda r: (r["slot"], r["place"]))] == mixed
    assert len(mixed) == 303


def test_every_source_keeps_its_weight(spark):
    rnd = random.Random(2)
    names = ["src0"] * 300 + ["src1"] * 40 + ["hot"] * 200 + [*"abcdefg", None, ""] * 8
    source = [rnd.choice(names) for _ in range(6000)]
    frame = docs(spark, [(i, f"text {i}", s, "en") for i, s in enumerate(source)])
    mixed = [source[r["doc_id"]] for r in corpus_pipeline.mixing_sources(spark, frame, DATA).collect()]
    got = sorted(mixing.mix(frame, each=True).collect(), key=lambda r: (r["slot"], r["place"]))
    assert sorted(r["doc_id"] for r in got) == list(range(6000))
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in got)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["slot"]].append(source[r["doc_id"]])
    assert sorted(slots) == list(range(len(slots))) and all(len(set(s)) == 1 for s in slots.values())
    order = [slots[i][0] for i in range(len(slots))]
    others = set(source) - set(mixing.TARGETS)
    parts = {s: mixing.TARGETS.get(s, mixing.REST / len(others)) for s in set(source)}
    assert len(others) == 10
    blocks = collections.Counter(order)
    whole = min(blocks[s] / parts[s] for s in parts) * sum(parts.values())
    for end in range(1, int(whole) - sum(mixing.TARGETS.values())):  # while no source has run out
        for s in parts:
            assert abs(order[:end].count(s) - end * parts[s] / sum(parts.values())) < 1, (s, end)
    assert whole > 60
    for end in range(1, 16 * (int(whole) - sum(mixing.TARGETS.values()))):  # the stage's own order, in rows
        for s in parts:
            assert abs(mixed[:end].count(s) - end * parts[s] / sum(parts.values())) < 32, (s, end)
