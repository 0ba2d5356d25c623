"""A local HTTP port for ad-hoc SQL on a running pipeline, and its metrics."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit


class DebugServer:
    """``GET /debug?sql=`` and ``GET /metrics``. It takes any statement, so it listens on this machine only."""

    def __init__(self, engine, port: int = 5000, most_rows: int = 1000):
        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                at = urlsplit(self.path)
                if at.path == "/metrics":
                    return self.reply(200, engine.stats.prometheus(), "text/plain; version=0.0.4")
                if at.path != "/debug":
                    return self.reply(404, json.dumps({"error": "not found"}))
                sql = parse_qs(at.query).get("sql")
                if not sql:
                    return self.reply(400, json.dumps({"error": "Missing SQL query"}))
                try:
                    with engine.lock:
                        rows = engine.runner.run(sql[0])
                        found = [] if rows is None else [list(r) for r in rows.limit(most_rows).collect()]
                    return self.reply(200, json.dumps(found, default=str))
                except Exception as e:
                    return self.reply(500, json.dumps({"error": str(e)}))

            def reply(self, status: int, text: str, kind: str = "application/json"):
                data = text.encode()
                self.send_response(status)
                self.send_header("Content-Type", kind)
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def log_message(self, *args):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", port), Handler)
        self.port = self.server.server_address[1]

    def start(self) -> DebugServer:
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        return self

    def close(self) -> None:
        self.server.shutdown()
        self.server.server_close()
