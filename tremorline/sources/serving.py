"""A thin HTTP server of dashboard documents: read, status and refresh. Refreshes never overlap; a failed one keeps the last."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer


class Board:
    """The last good payload and how the last refresh went."""

    def __init__(self, build: Callable[[], dict]):
        self.build, self.payload, self.error, self.at = build, None, None, None
        self._busy = threading.Lock()

    def refresh(self) -> dict:
        if not self._busy.acquire(blocking=False):
            return {"ok": False, "busy": True}
        try:
            self.payload, self.error = self.build(), None
        except Exception as e:  # the reason is served, the payload stays
            self.error = f"{type(e).__name__}: {e}"
        finally:
            self.at = time.time()
            self._busy.release()
        return {"ok": self.error is None, "error": self.error}

    def status(self) -> dict:
        return {"ready": self.payload is not None, "error": self.error, "refreshed_at": self.at}

    def loop(self, seconds: float, stop: threading.Event) -> threading.Thread:
        def run() -> None:
            while not stop.is_set():
                self.refresh()
                stop.wait(seconds)

        thread = threading.Thread(target=run, daemon=True)
        thread.start()
        return thread


def server(board: Board, port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """GET /api/dashboard and /api/status, POST /api/refresh."""

    class Handler(BaseHTTPRequestHandler):
        def _send(self, code: int, body) -> None:
            raw = json.dumps(body).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:
            if self.path == "/api/status":
                self._send(200, board.status())
            elif self.path in ("/", "/api/dashboard", "/api/dashboard_data"):
                self._send(200, board.payload) if board.payload is not None else self._send(503, board.status())
            else:
                self._send(404, {"error": "not found"})

        def do_POST(self) -> None:
            if self.path != "/api/refresh":
                return self._send(404, {"error": "not found"})
            out = board.refresh()
            self._send(200 if out["ok"] else 409 if out.get("busy") else 500, out)

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
