"""HTTP service: GET / (chat page), GET /api/health, POST /api/ask, POST /api/ask/stream (server-sent events)."""

from __future__ import annotations

import json
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from lodestone import __version__
from lodestone.chat import PAGE
from lodestone.engine import Engine
from lodestone.plans.requests import parse_ask

MAX_BODY = 64 * 1024


def handler(engine: Engine, default_k: int = 5) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        server_version = f"lodestone/{__version__}"

        def log_message(self, *_: object) -> None:
            pass

        def reply(self, status: int, body: dict | str) -> None:
            data = (body if isinstance(body, str) else json.dumps(body, ensure_ascii=False, default=str)).encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/html; charset=utf-8" if isinstance(body, str) else "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.send_header("X-Content-Type-Options", "nosniff")
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            path = self.path.partition("?")[0]
            if path == "/":
                return self.reply(200, PAGE)
            if path != "/api/health":
                return self.reply(404, {"error": "not found"})
            self.reply(200, {"status": "ok", "chunks": engine.store.manifest()["records"], "sources": engine.sources().count(), "llm": engine.answers is not None})

        def body(self) -> dict | None:
            """The checked request, or None after an error was sent."""
            try:
                length = int(self.headers.get("Content-Length", ""))
            except ValueError:
                length = -1
            if length > MAX_BODY:
                return self.reply(413, {"error": f"the body is over {MAX_BODY} bytes"})
            if length < 0:
                return self.reply(400, {"error": "Content-Length is missing or wrong"})
            try:
                got = json.loads(self.rfile.read(length))
            except ValueError:
                return self.reply(400, {"error": "the body is not JSON"})
            if not isinstance(got, dict):
                return self.reply(400, {"error": "the body must be a JSON object"})
            params = parse_ask(got, default_k)
            if isinstance(params, str):
                return self.reply(400, {"error": params})
            return params

        def do_POST(self) -> None:
            path = self.path.partition("?")[0]
            if path not in ("/api/ask", "/api/ask/stream"):
                return self.reply(404, {"error": "not found"})
            p = self.body()
            if p is None:
                return
            options = {"k": p["k"], "mode": p["mode"], "rerank": None if p["rerank"] == "none" else p["rerank"], "sources": p["sources"], "tags": p["tags"], "multi": p["multi_query"], "llm": p["llm"]}
            if path == "/api/ask":
                return self.reply(200, engine.ask(p["question"], p["history"], **options))
            self.events(engine.stream(p["question"], p["history"], **options))

        def events(self, stream: Iterator[tuple[str, dict]]) -> None:
            self.send_response(200)
            for name, value in (("Content-Type", "text/event-stream; charset=utf-8"), ("Cache-Control", "no-cache"), ("X-Accel-Buffering", "no"), ("Connection", "close")):
                self.send_header(name, value)
            self.end_headers()
            try:
                try:
                    for name, data in stream:
                        self.event(name, data)
                except (BrokenPipeError, ConnectionResetError):
                    raise
                except Exception as e:  # headers are out, so errors go into the stream
                    self.event("error", {"error": f"{type(e).__name__}: {e}"})
            except (BrokenPipeError, ConnectionResetError):
                pass  # the client is gone
            self.close_connection = True

        def event(self, name: str, data: dict) -> None:
            self.wfile.write(f"event: {name}\ndata: {json.dumps(data, ensure_ascii=False, default=str)}\n\n".encode())
            self.wfile.flush()

    return Handler


def serve(engine: Engine, host: str = "127.0.0.1", port: int = 8000, k: int = 5) -> None:
    with ThreadingHTTPServer((host, port), handler(engine, k)) as server:
        print(f"listening on http://{host}:{server.server_address[1]}", flush=True)
        try:
            server.serve_forever()
        except KeyboardInterrupt:
            pass
