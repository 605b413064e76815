"""A line server: one session for each connection, replies as length-prefixed JSON.

A request is a line of text, a statement or a `:command`. A reply is four bytes of length and a JSON object: kind ("rows", "done", "error"),
columns and rows as the case may be. A connection's end aborts its open transaction.
"""

from __future__ import annotations

import json
import socket
import socketserver
import struct

from pyspark.sql import SparkSession

from .errors import EngineError
from .session import Session

PORT = 4000


class Server(socketserver.ThreadingTCPServer):
    allow_reuse_address, daemon_threads = True, True

    def __init__(self, spark: SparkSession, warehouse: str, port: int = PORT, host: str = "127.0.0.1"):
        self.spark, self.warehouse = spark, warehouse
        super().__init__((host, port), Handler)


class Handler(socketserver.StreamRequestHandler):
    def handle(self) -> None:
        with Session(self.server.spark, self.server.warehouse) as session:
            for line in self.rfile:
                if text := line.decode(errors="replace").strip():
                    if text.rstrip("; ") == ":stop":
                        self.reply({"kind": "closed"})
                        self.server.shutdown()
                        return
                    self.reply(answer(session, text))

    def reply(self, content: dict) -> None:
        raw = json.dumps(content, default=str).encode()
        self.wfile.write(struct.pack(">I", len(raw)) + raw)


def answer(session: Session, text: str) -> dict:
    from pyspark.errors import PySparkException

    try:
        df = session.execute(text)
        return {"kind": "done"} if df is None else {"kind": "rows", "columns": df.columns, "rows": [list(r) for r in df.toLocalIterator()]}
    except (EngineError, PySparkException) as e:
        return {"kind": "error", "message": str(e)}


class Client:
    def __init__(self, host: str = "127.0.0.1", port: int = PORT):
        self.socket = socket.create_connection((host, port))
        self.replies = self.socket.makefile("rb")

    def send(self, text: str) -> dict:
        self.socket.sendall(" ".join(text.split("\n")).encode() + b"\n")
        (size,) = struct.unpack(">I", self.replies.read(4))
        return json.loads(self.replies.read(size))

    def close(self) -> None:
        self.replies.close()
        self.socket.close()
