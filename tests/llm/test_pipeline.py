"""The pipeline and the registered queries on the smallest tables."""

import base64
import collections
import hashlib
import math
import random

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken

import __spark_entry__
import corpus_pipeline
from tests.llm.test_confirmed import LEGACY, RSA, TOKEN, b64, plain_added
from tests.llm.test_corpus import plain_base, plain_buckets, plain_mix
from tests.llm.test_minhash import plain_groups
from tests.llm.test_texts import plain_base as plain_secrets
from tests.llm.test_texts import plain_ids
from tidemark.llm import mixing, quality

DATA = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def plain_kept(rows, labels):
    """Places of the rows that the quality rules keep."""
    raw, good = collections.Counter(), collections.Counter()
    trusted = {r["doc_id"] for r in labels if r["quality"] == 1 and r["doc_id"] is not None}
    grams = [plain_buckets(r["text"]) for r in rows]
    for r, g in zip(rows, grams, strict=True):
        raw.update(g)
        good.update(g if r["doc_id"] in trusted else [])
    total, n = sum(raw.values()), sum(good.values())
    ratio = {b: round((math.log((good[b] + 1) / (n + quality.BUCKETS)) - math.log((raw[b] + 1) / (total + quality.BUCKETS))) * quality.SCALE) for b in raw} if n else collections.Counter()
    score = [sum(ratio[b] for b in g) / len(g) / quality.SCALE if g else 0 for g in grams]
    return [i for i, r in enumerate(rows) if not plain_base(r["text"])[-1] and score[i] >= quality.THRESHOLD]


def plain_redacted(text):
    covered = set()
    for start, _, end in plain_secrets(text) + plain_added(text):
        covered |= set(range(start, end))
    spans = sorted(plain_secrets(text) + plain_added(text))
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], "[secret]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def plain_run(rows, labels):
    """(doc_id, text, source) of what is left, each row once."""
    kept = [rows[i] for i in plain_kept(rows, labels)]
    out = []
    for g in plain_groups([r["text"] for r in kept]):
        least = min(((kept[i]["doc_id"] is None, kept[i]["doc_id"] or "") for i in g), key=str if any(isinstance(kept[i]["doc_id"], str) for i in g) else None)
        out.append([kept[i] for i in g if (kept[i]["doc_id"] is None, kept[i]["doc_id"] or "") == least])
    return out


def held(spark, path, rows, labels, got):
    """Whether the result is that of the plain stages: a row of each group, its digests, and the plain schedule in (slot, place)."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    groups = plain_run(rows, labels)
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def told(r):
        text = plain_redacted(r["text"])
        ids = plain_ids(text, ranks)
        return r["doc_id"], len(ids), sha(",".join(map(str, ids)).encode()), sha(text.encode())

    want = {}
    for k, g in enumerate(groups):
        for r in g:
            want.setdefault(told(r), []).append((k, r["source"]))
    assert len(got) == len(groups)
    got = sorted(got, key=lambda r: (r["slot"], r["place"]))
    found, sources = set(), []
    for r in got:
        k, source = next((k, s) for k, s in want[(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"])] if k not in found)
        found.add(k)
        sources.append(source)
    target = lambda s: s if s in mixing.TARGETS else ""
    slots = collections.defaultdict(list)
    for r, s in zip(got, sources, strict=True):
        slots[r["slot"]].append((r["place"], s))
    assert all([p for p, _ in some] == list(range(len(some))) and len({s for _, s in some}) == 1 for some in slots.values())
    order = [target(slots[i][0][1]) for i in range(len(slots))]
    blocks = collections.Counter(order)
    assert order == plain_mix(blocks, {t: mixing.TARGETS.get(t, mixing.REST) for t in blocks})


def test_run_against_plain_stages(spark):
    rows = pq.read_table(f"{DATA}/documents.parquet").to_pylist()
    got = corpus_pipeline.run(spark, DATA).collect()
    assert len(got) < len(plain_kept(rows, pq.read_table(f"{DATA}/labels.parquet").to_pylist())) < len(rows)
    held(spark, DATA, rows, pq.read_table(f"{DATA}/labels.parquet").to_pylist(), got)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_run_over_odd_rows_against_plain_stages(spark, tmp_path, kind):
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    texts = [prose(rnd.randint(5, 120)) for _ in range(60)]
    texts += [texts[0], texts[0] + " end", texts[1].upper(), None, "", " \n ", "one", "again and again it says the same words " * 20]
    texts += [prose(20) + f"\n{LEGACY}\n" + prose(9), prose(30) + " password = hunter2hunter2 and " + TOKEN, prose(15) + " key_" + b64(RSA)]
    texts += [prose(12) + " " + "x" * 40_000 + " " + prose(12), prose(12) + " " * 70_000 + prose(12)]
    rows = [{"doc_id": i, "text": t, "source": rnd.choice(["src0", "src1", "hot", "hot", None, ""]), "lang": "en", "n_chars": len(t) if t else None} for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], rows[5] | {"source": "src1"}, {**rows[7], "doc_id": 3}, {**rows[8], "doc_id": None}, {**rows[9], "text": prose(25), "doc_id": None}, {**rows[9], "text": prose(25), "doc_id": None}, {**rows[9], "text": prose(25), "doc_id": -1}]
    rows = [r | {"doc_id": None if r["doc_id"] is None else f"d{r['doc_id']}" if kind == "string" else r["doc_id"]} for r in rows]
    clash = {"_row": "a", "slot": 5, "row": "b", "_id": 1, "key": None, "verdict": 2.0, "place": "p", "_all": True}
    schema = f"doc_id {kind}, text string, source string, lang string, n_chars long, _row string, slot int, row string, _id int, key string, verdict double, place string, _all boolean"
    spark.createDataFrame([tuple((r | clash).values()) for r in rows], schema).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [{"doc_id": rows[i]["doc_id"], "quality": int(i < 40), "toxic": 0} for i in range(60)] + [{"doc_id": None, "quality": 1, "toxic": 0}]
    spark.createDataFrame([tuple(x.values()) for x in labels], f"doc_id {kind}, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    held(spark, tmp_path, rows, labels, corpus_pipeline.run(spark, str(tmp_path)).collect())


def test_stages_return_documents_columns_and_handle_empty_input(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, DATA)
        assert out.count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns


@pytest.mark.parametrize("name", [f"op{n}" for n in range(1, 11)])
def test_every_operator_has_a_query_over_its_whole_table(spark, name):
    (found,) = [q for q in __spark_entry__.queries() if q.startswith(name + "_")]
    df = __spark_entry__.queries()[found](spark, DATA)
    rows = df.count()
    whole = {"op2": "pages", "op6": None, "op8": None}.get(name, "documents")
    assert rows > 0 and (whole is None or rows == spark.read.parquet(f"{DATA}/{whole}.parquet").count())
