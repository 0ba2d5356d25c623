"""An HTTP endpoint whose messages are files in a spool folder before they are acknowledged."""

from __future__ import annotations

import hashlib
import hmac
import json
import os
import threading
import time
import uuid
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pipequery.config import HMAC


def check_signature(conf: HMAC | None, headers, body: bytes) -> int:
    """200, 400 if the header is missing, 403 if it isn't the body's ``sha256=<HMAC>``."""
    if conf is None:
        return 200
    given = headers.get(conf.header)
    if not given:
        return 400
    wanted = "sha256=" + hmac.new(conf.secret.encode(), body, hashlib.sha256).hexdigest()
    return 200 if hmac.compare_digest(given, wanted) else 403


class Webhook:
    """``POST /events``; each accepted body is one line of one file, renamed into ``spool`` when it is whole and on disk."""

    def __init__(self, spool: str, conf: HMAC | None = None, host: str = "0.0.0.0", port: int = 8001):
        self.spool, self.conf = spool, conf
        self.requests, self.seconds = Counter(), Counter()
        os.makedirs(spool, exist_ok=True)
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):
                began = time.perf_counter()
                body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
                status = 404 if self.path != "/events" else check_signature(outer.conf, self.headers, body)
                if status == 200:
                    outer.store(body)
                reply = json.dumps({"status": "received"} if status == 200 else {"error": {400: "signature missing", 403: "signature invalid", 404: "not found"}[status]}).encode()
                self.send_response(status)
                self.send_header("Content-Type", "application/json")
                self.send_header("Content-Length", str(len(reply)))
                self.end_headers()
                self.wfile.write(reply)
                outer.requests[status] += 1
                outer.seconds[status] += time.perf_counter() - began

            def log_message(self, *args):
                pass

        self.server = ThreadingHTTPServer((host, port), Handler)
        self.port = self.server.server_address[1]

    def store(self, body: bytes) -> None:
        text = body.decode("utf-8", "replace")
        try:
            text = json.dumps(json.loads(text))  # one line
        except ValueError:
            text = " ".join(text.split())  # for the pipeline's error policy
        name = uuid.uuid4().hex
        hidden = os.path.join(self.spool, f".{name}")
        with open(hidden, "w", encoding="utf-8") as f:
            f.write(text + "\n")
            f.flush()
            os.fsync(f.fileno())
        os.rename(hidden, os.path.join(self.spool, f"{name}.json"))

    def start(self) -> Webhook:
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        return self

    def close(self) -> None:
        self.server.shutdown()
        self.server.server_close()
