"""Secret scans with structural confirmation.

Patterns find assignments, access keys and long hex strings. Candidates for encoded keys and tokens are
reported only if their content parses: base64 or hex is decoded, and the DER lengths of a private key must nest
exactly, an encrypted one naming a password-based cipher; an OpenSSH key's length-prefixed fields must fill it; a PEM's body must be such a key, or
whole blocks of the cipher that its headers name; a signed token's header and payload must be JSON objects, the header naming an algorithm.
A candidate may be glued to what stands before it by any sign, `_`, `-` and `/` included.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices

#: Kinds in the order in which spans of one start are listed; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "jwt", "pem", "key_base64", "key_hex")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: The words of ASSIGN; a text without any of them holds no assignment.
WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run of 32 or more is the whole run either way
#: Runs of base64 in the address alphabet with two dots or more between them.
DOTTED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]*")
GLUED = re.compile(r"(?:^|(?<=[_-]))[A-Za-z0-9]")
MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]*PRIVATE KEY)-----")
#: Base64 of a DER sequence begins with M and a length, of an OpenSSH key with its magic string, of a PEM with its dashes.
CODED = re.compile(r"M[A-I]|b3BlbnNzaC1rZXktdjEA|LS0tLS1CRUdJTi")
RUN = re.compile(r"[A-Za-z0-9+/_-]*")
JSON = json.JSONDecoder()
#: Headers of a PEM that its cipher is told by.
ENCRYPTED = re.compile(r"Proc-Type:\s*4,\s*ENCRYPTED")
CIPHER = re.compile(r"DEK-Info:\s*[A-Za-z0-9-]+,\s*([0-9A-Fa-f]+)")
HEADER = re.compile(r"[A-Za-z0-9-]+:[ \t]*[^\s]+")
#: Line ends within a string literal, once or more escaped.
ESCAPED = re.compile(r"\\+[nr]")
HEX_KEY = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{62,}(?![0-9A-Fa-f])")
INTEGER, OCTETS, OID, SEQUENCE = 2, 4, 6, 48
#: Beginnings of the identifiers of password-based encryption (PKCS 5, PKCS 12).
PASSWORD_BASED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def unbase64(text: str, url: bool = True) -> bytes | None:
    """Bytes of base64, also in the address alphabet with `url`, with or without padding; None if it is none."""
    body = text.rstrip("=")
    body = body.replace("-", "+").replace("_", "/") if url else body
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True) if len(body) % 4 != 1 else None
    except (binascii.Error, ValueError):
        return None


def der(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the values that fill `data` exactly; None if lengths are wrong."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size >= 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            size = int.from_bytes(data[at : at + n], "big")
            at += n
        if at + size > len(data):
            return None
        out.append((tag, data[at : at + size]))
        at += size
    return out


def private_der(data: bytes) -> bool:
    """Whether `data` is one DER private key: RSA (nine integers or more), elliptic curve, or PKCS 8, plain or encrypted."""
    top = der(data)
    if not top or len(top) != 1 or top[0][0] != SEQUENCE or not (inner := der(top[0][1])):
        return False
    tags = [tag for tag, _ in inner]
    if tags[:2] == [INTEGER, SEQUENCE] and tags[2:3] == [OCTETS]:  # version, algorithm, key
        return inner[0][1] in (b"\0", b"\1") and bool(algorithm := der(inner[1][1])) and algorithm[0][0] == OID
    if tags == [SEQUENCE, OCTETS]:  # algorithm, encrypted key
        algorithm = der(inner[0][1])
        return bool(algorithm) and [tag for tag, _ in algorithm] == [OID, SEQUENCE] and algorithm[0][1].startswith(PASSWORD_BASED)
    if len(tags) >= 9 and tags[:9] == [INTEGER] * 9:
        return len(inner[1][1]) >= 32 and inner[0][1] in (b"\0", b"\1")
    return tags[:2] == [INTEGER, OCTETS] and inner[0][1] == b"\1" and len(inner[1][1]) >= 16


def private_openssh(data: bytes) -> bool:
    """Whether `data` is an OpenSSH private key: magic, three names, key count, and as many public keys and one private part that fill it."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)

    def field() -> bool:
        nonlocal at
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        return at <= len(data)

    if not (field() and field() and field()) or at + 4 > len(data):
        return False
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    return keys >= 1 and all(field() for _ in range(keys + 1)) and at == len(data)


def signed_token(text: str) -> bool:
    """Whether header.payload.signature holds JSON objects, with an algorithm in the header that fits the signature."""
    header, payload, signature = text.split(".")
    try:
        head, body = (json.loads(unbase64(x) or b"") for x in (header, payload))
    except (ValueError, UnicodeDecodeError, RecursionError):
        return False
    if not (isinstance(head, dict) and isinstance(body, dict) and isinstance(head.get("alg"), str)):
        return False
    raw = unbase64(signature)
    return raw is not None and (len(raw) >= 16 or head["alg"].lower() == "none" and not raw)


def _key(data: bytes | None) -> bool:
    return data is not None and (private_der(data) or private_openssh(data))


def _blocks(headers: str, data: bytes | None) -> bool:
    """Whether `data` is whole blocks of the cipher that a PEM's headers name, whose start value is one block."""
    start = CIPHER.search(headers)
    size = len(start[1]) // 2 if start and ENCRYPTED.search(headers) else 0
    return size in (8, 16) and bool(data) and len(data) % size == 0


def _pems(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the private keys between a BEGIN line and the END line that is the next mark; line ends may be escaped."""
    marks = list(MARK.finditer(text)) if "-----BEGIN " in text else []
    for m, close in zip(marks, marks[1:], strict=False):
        if m[1] == "BEGIN" and close[1] == "END" and m[2] == close[2]:
            body = ESCAPED.sub("\n", text[m.end() : close.start()])
            data = unbase64("".join((HEADER.sub("", body) if ":" in body else body).split()), url=False)
            if _key(data) or ":" in body and _blocks(body, data):
                yield m.start(), close.end()


def _whole_pem(data: bytes | None) -> bool:
    """Whether `data` is text with a private key's PEM."""
    return data is not None and data.startswith(b"-----BEGIN") and any(_pems(data.decode("latin-1")))


def _sequence(text: str, at: int, end: int) -> int:
    """Where the base64 of the DER sequence ends that begins at `at`, by its own length; -1 if it does not fit into the run up to `end`, or what follows is no sign that glues."""
    head = unbase64(text[at : at + 16]) or b""
    if len(head) < 12 or head[0] != SEQUENCE:
        return -1
    n = head[1] & 0x7F if head[1] >= 0x80 else 0
    if n > 4 or head[1] == 0x80 or head[2 + n] not in (INTEGER, SEQUENCE):
        return -1
    size = 2 + n + (int.from_bytes(head[2 : 2 + n], "big") if n else head[1])
    stop = at + -(-size * 4 // 3)
    return stop if stop <= end and (stop == end or text[stop] in "_-/") else -1


def _coded(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of keys in base64, padding included."""
    end = done = 0
    whole: dict[int, bytes] = {}  # what the run from some place on holds, by alignment
    for m in CODED.finditer(text):
        at = m.start()
        if at < done or at and (text[at - 1].isascii() and text[at - 1].isalnum() or text[at - 1] == "+"):
            continue
        if at >= end:
            end, whole = RUN.match(text, at).end(), {}
        if end - at < 32:
            continue
        if m[0][0] == "M":
            stop = _sequence(text, at, end)
            if stop < 0 or not _key(unbase64(text[at:stop])):
                continue
        else:
            stop, shift = end, (end - at) % 4
            known = shift in whole
            data = whole[shift][-((end - at) * 3 // 4) :] if known else unbase64(text[at:end]) or b""
            whole.setdefault(shift, data)
            # of a PEM that begins later the marks are among those looked at before
            if not (private_openssh(data) if m[0][0] == "b" else not known and _whole_pem(data)):
                continue
        done = stop
        while done < min(len(text), stop + 2) and text[done] == "=":
            done += 1
        yield at, done


def _objects(run: str) -> Iterator[int]:
    """Places in a run of base64, at its begin or after a sign that glues, from which on it holds one JSON object and nothing else."""
    known: dict[int, str] = {}
    for g in GLUED.finditer(run):
        shift = g.start() % 4
        if shift not in known:
            known[shift] = (unbase64(run[shift:]) or b"").decode("latin-1")
        text, at = known[shift], (g.start() - shift) // 4 * 3
        while at < len(text) and text[at] in " \t\r\n":
            at += 1
        if text.startswith("{", at):
            try:
                _, end = JSON.raw_decode(text, at)
            except (ValueError, RecursionError):
                continue
            if not text[end:].strip(" \t\r\n"):
                yield g.start()


def _tokens(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of signed tokens: three runs next to each other, the first from its begin or any sign on that may glue it."""
    for m in DOTTED.finditer(text):
        runs, at, done = m[0].split("."), m.start(), 0
        for header, payload, signature in zip(runs, runs[1:], runs[2:], strict=False):
            if at >= done and len(header) >= 8 and payload:
                for g in _objects(header):
                    if signed_token(".".join((header[g:], payload, signature))):
                        done = at + len(header) + len(payload) + len(signature) + 2
                        yield at + g, done
                        break
            at += len(header) + 1


def find(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of all spans of a text, sorted; code points, end exclusive. A null text has none."""
    text = text or ""
    lower = text.lower()
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8] if any(w in lower for w in WORDS) else []
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    spans += [(start, 3, end) for start, end in _tokens(text)]
    spans += [(start, 4, end) for start, end in _pems(text)]
    spans += [(start, 5, end) for start, end in _coded(text)]
    spans += [(m.start(), 6, m.end()) for m in HEX_KEY.finditer(text) if len(m[0]) % 2 == 0 and _key(bytes.fromhex(m[0]))]
    return sorted(spans)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[secret]") -> str:
    """`text` with each stretch that spans cover replaced by `mark`."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def _rows(work, names: list[str], types: list[pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "_text"):
            at = batch.schema.get_field_index("_text")
            made = [work(t) for t in batch.column(at).to_pylist()]
            keep = [i for i in range(batch.num_columns) if i != at]
            new = [pa.array([m[k] for m in made], kind) for k, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *new], names=[*(batch.schema.names[i] for i in keep), *names])

    return run


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and found, array of (kind, start, end), for every row: code points, by start, then kind.

    A null text counts as empty and has no spans; null and repeated ids are carried as they are; other columns are not read.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    work = lambda t: ([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find(t)],)
    found = rows.mapInArrow(_rows(work, ["found"], [pa.list_(span)]), f"id {rows.schema['id'].dataType.simpleString()}, found array<struct<kind: string, start: bigint, end: bigint>>")
    return found.withColumnRenamed("id", id_col)


def digests(df: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans for documents (doc_id, text).

    A null text counts as empty: no spans, the digest of nothing. Null and repeated ids and repeated rows are carried as they are; other columns are not read.
    """
    base = F.filter("found", lambda x: x["kind"].isin(*KINDS[:3]))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(df).select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("found")).alias("spans"))


def redacted(df: DataFrame) -> DataFrame:
    """All rows and columns of documents, each stretch of secrets in text replaced by a mark and n_chars set anew where there is one; a null text stays null."""
    names = df.columns
    numbered = df.toDF(*(f"c{i}" for i in range(len(names))))
    text = names.index("text")
    rows = numbered.withColumnRenamed(f"c{text}", "_text")
    rest = [f for f in rows.schema.fields if f.name != "_text"]
    work = lambda t: ((redact(t, spans) if (spans := find(t)) else t) if t else t,)
    out = rows.mapInArrow(_rows(work, [f"c{text}"], [pa.string()]), ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rest), f"c{text} string"]))
    if "n_chars" in names:
        n = f"c{names.index('n_chars')}"
        out = out.withColumn(n, F.when(F.col(n).isNotNull() & F.col(f"c{text}").isNotNull(), F.length(f"c{text}").cast(df.schema["n_chars"].dataType)).otherwise(F.col(n)))
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))
