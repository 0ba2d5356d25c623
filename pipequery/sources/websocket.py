"""A websocket as a streaming data source, by the standard library: whole messages, pings answered, reconnecting."""

from __future__ import annotations

import base64
import os
import socket
import ssl
import struct
import time
from collections.abc import Iterator
from urllib.parse import urlsplit

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

OPEN_SECONDS, IDLE_SECONDS, MOST_MESSAGES = 10.0, 1.0, 10_000


class Websocket:
    def __init__(self, uri: str):
        at = urlsplit(uri)
        port = at.port or (443 if at.scheme == "wss" else 80)
        self.socket = socket.create_connection((at.hostname, port), OPEN_SECONDS)
        if at.scheme == "wss":
            self.socket = ssl.create_default_context().wrap_socket(self.socket, server_hostname=at.hostname)
        key = base64.b64encode(os.urandom(16)).decode()
        path = (at.path or "/") + (f"?{at.query}" if at.query else "")
        self.socket.sendall(
            f"GET {path} HTTP/1.1\r\nHost: {at.hostname}:{port}\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Key: {key}\r\nSec-WebSocket-Version: 13\r\n\r\n".encode()
        )
        self.buffer, self.parts = b"", b""
        while b"\r\n\r\n" not in self.buffer:
            self._more()
        head, _, self.buffer = self.buffer.partition(b"\r\n\r\n")
        if b" 101 " not in head.split(b"\r\n")[0]:
            raise ConnectionError(head.split(b"\r\n")[0].decode("latin-1"))

    def _more(self) -> None:
        data = self.socket.recv(65536)
        if not data:
            raise ConnectionError("closed")
        self.buffer += data

    def _frame(self) -> tuple[bool, int, bytes] | None:
        b = self.buffer
        if len(b) < 2:
            return None
        n, at = b[1] & 127, 2
        if n > 125:
            size = 2 if n == 126 else 8
            if len(b) < 2 + size:
                return None
            n, at = int.from_bytes(b[2 : 2 + size], "big"), 2 + size
        if len(b) < at + n:
            return None
        self.buffer = b[at + n :]
        return bool(b[0] & 128), b[0] & 15, b[at : at + n]

    def send(self, code: int, data: bytes = b"") -> None:
        mask = os.urandom(4)
        size = struct.pack("!B", 128 | len(data)) if len(data) < 126 else struct.pack("!BH", 128 | 126, len(data)) if len(data) < 65536 else struct.pack("!BQ", 128 | 127, len(data))
        self.socket.sendall(bytes([128 | code]) + size + mask + bytes(c ^ mask[i % 4] for i, c in enumerate(data)))

    def messages(self, seconds: float, most: int) -> Iterator[str]:
        """What arrives within ``seconds``, ``most`` messages at most; fragments are put together."""
        until, n = time.monotonic() + seconds, 0
        while n < most:
            while (frame := self._frame()) is None:
                left = until - time.monotonic()
                if left <= 0:
                    return
                self.socket.settimeout(left)
                try:
                    self._more()
                except TimeoutError:
                    return
            last, code, data = frame
            if code == 8:
                raise ConnectionError("closed")
            if code == 9:
                self.send(10, data)
            elif code in (0, 1, 2):
                self.parts += data
                if last:
                    yield self.parts.decode("utf-8", "replace")
                    self.parts, n = b"", n + 1


class WebsocketReader(SimpleDataSourceStreamReader):
    """Messages are numbered as they come. Those of batches not yet committed are kept for a second reading; a websocket itself can't be asked again."""

    def __init__(self, uri: str):
        self.uri, self.socket, self.kept = uri, None, {}

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict):
        rows = []
        try:
            if self.socket is None:
                self.socket = Websocket(self.uri)
            rows = [(m,) for m in self.socket.messages(IDLE_SECONDS, MOST_MESSAGES)]
        except (ConnectionError, OSError):
            self.socket = None  # the next read connects again
        for i, row in enumerate(rows):
            self.kept[start["n"] + i] = row
        return iter(rows), {"n": start["n"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter([self.kept[i] for i in range(start["n"], end["n"]) if i in self.kept])

    def commit(self, end: dict) -> None:
        self.kept = {i: row for i, row in self.kept.items() if i >= end["n"]}


class WebsocketDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "websocket"

    def schema(self) -> str:
        return "value string"

    def simpleStreamReader(self, schema) -> WebsocketReader:
        return WebsocketReader(self.options["uri"])
