"""Operators on single texts: encoding, counts, secrets, pages."""

import base64
import hashlib
import json
import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from tidemark.llm import bpe, html_text, secrets, token_counts

RANKS, MODEL = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, ids string, k int, piece string, n_tokens string"


def documents():
    rnd = random.Random(5)
    atoms = ["a", "the ", "  ", "\n", "\n\n", "'s", "é", "漢字", "😀", "12", "\u0085", "\x1c", "!?", "<|endoftext|>", "ing", "\t", "Straße "]
    texts = [None, "", " ", "x" * 700, " " * 700, "\n" * 500 + "a", "ab" * 400, "😀" * 300] + ["".join(rnd.choice(atoms) for _ in range(rnd.randint(0, 400))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, "no id " * 90), (None, None)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "other", 7, "piece", "many") for r in rows], SCHEMA)


@pytest.mark.parametrize(("chunk", "overlap"), [(bpe.CHUNK, bpe.OVERLAP), (100, 20), (37, 5), (64, 64)])
def test_encoding_equals_the_library_however_texts_are_cut(spark, chunk, overlap):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def told(doc_id, text):
        ids = library.encode_ordinary(text or "")
        return doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    got = bpe.digests(frame(spark, documents()), RANKS, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((told(*r) for r in documents()), key=str)


def plain_ids(text, ranks):
    """Pre-tokens by a linear matcher, each encoded as one piece."""
    one = tiktoken.Encoding("one", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
    pattern = regex.compile(public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
    return [i for m in pattern.finditer(text) for i in one.encode_ordinary(m[0])]


def test_very_long_runs(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    rnd = random.Random(4)
    letters = "".join(rnd.choices("abcdefgh", k=1_000_000))
    texts = [" " * 5_000_000, "x" + " \n" * 600_000 + "y", letters, "end " + "\t" * 60_000 + "it's " * 100, "\x1c" * 70_000 + " " * 70_000 + "\u2028"]
    began = time.monotonic()
    got = {r["doc_id"]: r for r in bpe.digests(frame(spark, list(enumerate(texts))), RANKS, public_tokenizers.PATTERN).collect()}
    assert time.monotonic() - began < 60
    for i, t in enumerate(texts):
        ids = plain_ids(t, ranks)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for t in (letters, texts[3], texts[4]):  # what the library can do
        assert plain_ids(t, ranks) == library.encode_ordinary(t) == bpe.encoded(t, RANKS, public_tokenizers.PATTERN).tolist()


def test_texts_are_read_once(spark, tmp_path):
    frame(spark, documents()).write.parquet(str(tmp_path / "d"))
    seen = spark.sparkContext.accumulator(0)
    rows = spark.read.parquet(str(tmp_path / "d"))
    counted = rows.mapInArrow(lambda batches: (seen.add(b.num_rows) or b for b in batches), rows.schema)
    assert bpe.digests(counted, RANKS, public_tokenizers.PATTERN, chunk=100, overlap=20).count() == len(documents()) == seen.value


def test_decoding_keeps_other_columns(spark):
    ids = bpe.encode(spark.createDataFrame([(1, "héllo wörld")], "doc_id long, text string"), RANKS, public_tokenizers.PATTERN)
    row = bpe.decode(ids.selectExpr("doc_id", "ids", "'x' as tag", "1 as decoded"), RANKS).first()
    assert (row["doc_id"], row["tag"], bytes(row["decoded"]).decode()) == (1, "x", "héllo wörld")


def test_empty_tables(spark):
    none = frame(spark, [])
    assert bpe.digests(none, RANKS, public_tokenizers.PATTERN).count() == 0
    assert token_counts.count_tokens(none, MODEL).count() == 0
    assert secrets.digests(none).count() == 0
    assert html_text.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_counts_equal_the_library(spark):
    library = Tokenizer.from_file(MODEL)
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in documents()]
    got = token_counts.count_tokens(frame(spark, documents()), MODEL)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_merging_takes_every_second_pair_of_a_run_and_lowest_ranks_first():
    merges = token_counts.Merges(MODEL)
    library = Tokenizer.from_file(MODEL)
    rnd = random.Random(1)
    words = ["a" * n for n in range(1, 40)] + ["".join(rnd.choice("abcer ") for _ in range(rnd.randint(1, 30))).replace(" ", "") or "x" for _ in range(500)]
    assert token_counts.count_symbols([w.encode() for w in words], merges).tolist() == [len(library.encode(w, add_special_tokens=False).ids) for w in words]
    assert token_counts.count_symbols([b"", b"a", b""], merges).tolist() == [0, 1, 0]


def test_long_pre_tokens_are_counted_in_seconds(spark):
    library = Tokenizer.from_file(MODEL)
    rnd = random.Random(9)
    words = [rnd.choice(["a", "ab", "é", "漢", "the", "ing"]) * rnd.randint(100, 600) for _ in range(40)] + ["".join(rnd.choices("etaoinsh", k=rnd.randint(200, 2000))) for _ in range(40)]
    merges = token_counts.Merges(MODEL)
    want = [len(library.encode(w, add_special_tokens=False).ids) for w in words]
    assert token_counts.count_symbols([w.encode() for w in words], merges).tolist() == want
    pieces = [w.encode() for w in words]
    assert token_counts.sweep(merges.byte[np.frombuffer(b"".join(pieces), np.uint8)], np.array(list(map(len, pieces))), merges).tolist() == want
    texts = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000)), "x" * 1_000_000, " " * 5_000_000, "1" * 300_000 + "!" * 300_000, "漢字" * 150_000]
    began = time.monotonic()
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(frame(spark, list(enumerate(texts))), MODEL).collect()}
    assert time.monotonic() - began < 60
    assert [got[i] for i in range(len(texts))] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_memory_of_counts_is_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 10)
    counter = token_counts.Counter(MODEL)
    texts = [f"word{i} other{i}" for i in range(50)]
    library = Tokenizer.from_file(MODEL)
    assert [counter.texts([t])[0] for t in texts] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert len(counter.known) <= 20


# ---- secrets


def der(tag: int, content: bytes) -> bytes:
    n = len(content)
    size = bytes([n]) if n < 128 else bytes([0x80 | (m := (n.bit_length() + 7) // 8)]) + n.to_bytes(m, "big")
    return bytes([tag]) + size + content


def rsa_key() -> bytes:
    whole = lambda n: der(2, n.to_bytes(n.bit_length() // 8 + 1, "big"))
    return der(48, whole(0) + b"".join(whole((1 << 1023) + 12345 + i) for i in range(8)))


def token(header: dict, body: object, signature: bytes = b"s" * 32) -> str:
    part = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
    return ".".join([part(json.dumps(header).encode()), part(json.dumps(body).encode()), part(signature)])


def kinds(text: str) -> list[str]:
    return [secrets.KINDS[k] for _, k, _ in secrets.find(text)]


def test_structures_are_confirmed():
    key = base64.b64encode(rsa_key()).decode()
    assert "key_base64" in kinds(f"a {key} b")
    assert "key_base64" not in kinds("a " + base64.b64encode(rsa_key()[:-1]).decode() + " b")  # lengths do not nest
    assert "key_hex" in kinds("x " + rsa_key().hex() + " y")
    assert "key_hex" not in kinds("30" + "ab" * 60)
    lines = "\n".join(key[i : i + 64] for i in range(0, len(key), 64))
    assert "pem" in kinds(f"-----BEGIN RSA PRIVATE KEY-----\n{lines}\n-----END RSA PRIVATE KEY-----")
    assert "pem" not in kinds("-----BEGIN RSA PRIVATE KEY-----\nnothing here\n-----END RSA PRIVATE KEY-----")
    assert kinds(token({"alg": "HS256", "typ": "JWT"}, {"sub": 1})) == ["jwt"]
    assert kinds(token({"typ": "JWT"}, {"sub": 1})) == []
    assert kinds(token({"alg": "HS256"}, "text")) == []
    assert kinds(token({"alg": "HS256"}, {}, b"short")) == []
    field = lambda b: len(b).to_bytes(4, "big") + b
    ssh = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(b"p" * 51) + field(b"s" * 140)
    assert "key_base64" in kinds(base64.b64encode(ssh).decode())
    assert "key_base64" not in kinds(base64.b64encode(ssh + b"xxx").decode())


def plain_base(text):
    """The base patterns as the contract words them, failing matches dropped."""
    spans = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        spans += [(m.start(), 0, m.end())] if len(m[2]) >= 8 else []
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(spans)


def test_base_spans_against_plain_patterns(spark):
    rnd = random.Random(2)
    atoms = ["token", "Secret", "PASSWD", "api_key", "apikey", "toKen", "ſecret", "=", ": ", '"', "'", " ", "abcdefgh", "AKIA", "ABCDEFGH1234", "0123456789abcdef" * 2, "é", "x", "token=secret:abcdefghijk", "\n"]
    texts = ["".join(rnd.choice(atoms) for _ in range(rnd.randint(0, 25))) for _ in range(400)] + [None, "", "z" * 200_000 + " token = abcdefgh12"]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r for r in secrets.digests(frame(spark, rows)).collect()}
    for i, t in rows:
        base = plain_base(t or "")
        listed = secrets.listed(base)
        assert got[i]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s[1] == k for s in base) for k in range(3)]
        assert set(filter(None, listed.split(","))) <= set(got[i]["spans"].split(","))


def test_redaction_replaces_spans_alone(spark):
    rows = [(1, "héllo token = 'abcdefgh1' end", 9), (2, "clean", 5), (3, None, None), (3, None, None), (None, "", 0)]
    got = secrets.redacted(spark.createDataFrame([(*r, "c", "t") for r in rows], "doc_id long, text string, n_chars long, c0 string, _text string"))
    assert got.columns == ["doc_id", "text", "n_chars", "c0", "_text"]
    found = sorted(map(tuple, got.select("doc_id", "text", "n_chars").collect()), key=str)
    assert found == sorted([(1, "héllo [secret]' end", 19), (2, "clean", 5), (3, None, None), (3, None, None), (None, "", 0)], key=str)
    assert secrets.redact("abcdef", [(1, 0, 4), (2, 1, 3), (3, 2, 5)]) == "a[secret]f"


# ---- pages

ARTICLE = "<h1>A title</h1><p>This is the story of a house that was built on the hill, and of all who lived there.</p><p>Short one.</p><p>It had many rooms &amp; a&nbsp;garden; the people of the town said that it was the best of all the houses.</p>"
TEXT = "A title\nThis is the story of a house that was built on the hill, and of all who lived there.\nShort one.\nIt had many rooms & a garden; the people of the town said that it was the best of all the houses."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><a href=x>Home</a></nav><article>{ARTICLE}</article><footer>&copy; us</footer></body></html>",
        f"<body><div class='top-menu'><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></div><main>{ARTICLE}</main><aside>The best of the week for you and for all of your friends.</aside>",
        f"<body><header>The Daily</header><div id=content class='has-sidebar'>{ARTICLE}</div><div class='sidebar'>This is what the others have read on the site in the last week.</div>",
        f"<body><article>{ARTICLE}<section id='comments'><p>I think that this is the best of all the stories that were on the site.</p></section></article>",
        f"<body><div role=alert>We use cookies on the site, and by the use of it you agree to that.</div><article>{ARTICLE}<div class='ad-slot'>Buy the best of all the houses in the town!</div></article>",
        f"<body><form><p>Give us the name of the town and of the street in which you live.</p></form><article>{ARTICLE}</article><script>var x = '<p>no</p>';</script>",
        f"<BODY><!-- <p>not this one at all, as it is a comment in the page</p> --><ARTICLE>{ARTICLE}</ARTICLE><noscript>Please turn on the scripts for the site.</noscript>",
        f"<body><article>{ARTICLE}</article><div class='cookieBanner'>We use cookies to make the site better for all of you.</div><p style='display:none'>This is not to be seen by the people who read the page.</p>",
    ],
)
def test_article_without_what_is_around_it(page):
    assert html_text.extract(page) == TEXT


def test_comments_as_nested_articles_and_other_languages():
    nested = f"<main><article>{ARTICLE}<section><h2>What readers say</h2><article><p>I think that this is the best of all the stories that were on the site.</p></article></section></article></main>"
    assert html_text.extract(nested) == TEXT
    line = "дом стоит на холме, в нём много комнат и большой сад вокруг него, " * 5
    assert html_text.extract(f"<div class=nav><a href=x>Домой</a></div><div><p>{line}</p><p>Коротко.</p><p>{line}</p></div>") == f"{line.strip()}\nКоротко.\n{line.strip()}"


def test_odd_pages():
    assert html_text.extract(None) == html_text.extract("") == html_text.extract("<html>") == ""
    assert html_text.extract("<p>just one line</p>") == "just one line"
    assert html_text.extract("a < b and c > d") == "a < b and c > d"
    assert html_text.extract("<article><p>one<p>two<br>three</article") == "one\ntwo three"
    assert html_text.extract("<article><p>caf&eacute; &#x41;&#66; &unknown;</p></article>") == "café AB &unknown;"
    assert html_text.extract("<article><p title='a>b'>x</p><p>" + "y " * 50_000 + "</p></article>").count("y") == 50_000
    assert html_text.extract("<" * 2000 + "article>") is not None
    assert html_text.extract("<script>never closed <p>x</p>") == ""


def test_pages_table(spark):
    rows = [(1, "u", f"<article>{ARTICLE}</article>"), (2, None, None), (2, None, None), (None, "v", "")]
    got = html_text.extract_pages(spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, id int"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "u", TEXT, len(TEXT)), (2, None, "", 0), (2, None, "", 0), (None, "v", "", 0)], key=str)
