"""Private keys inside string literals, and in base64 as a whole."""

import base64
import json

import pytest

from tidemark.llm import secrets


def value(tag, content):
    return bytes([tag, 0x82, *len(content).to_bytes(2, "big")]) + content


def pem(end="\n", kind="RSA PRIVATE KEY"):
    der = value(48, value(2, b"\0") + b"".join(value(2, bytes(range(1, 65))) for _ in range(8)))
    body = base64.b64encode(der).decode()
    return end.join([f"-----BEGIN {kind}-----", *(body[i : i + 64] for i in range(0, len(body), 64)), f"-----END {kind}-----", ""])


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_escaped_line_ends(end):
    for text in (pem(end), json.dumps({"private_key": pem(end)}), json.dumps(json.dumps({"private_key": pem(end)}))):
        assert [secrets.KINDS[k] for _, k, _ in secrets.find(text)] == ["pem"]
        assert "MII" not in secrets.redact(text, secrets.find(text))


def test_base64_of_a_whole_pem():
    coded = base64.b64encode(pem().encode()).decode()
    assert coded.startswith("LS0tLS1CRUdJTi")
    assert secrets.find(f"key: {coded} end") == [(5, 5, 5 + len(coded))]
    public = base64.b64encode(pem(kind="PUBLIC KEY").encode()).decode()
    broken = base64.b64encode(pem().replace("MII", "MIJ").encode()).decode()
    assert secrets.find(f"{public} {broken}") == []
