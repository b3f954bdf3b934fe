"""The service over HTTP: JSON for programs, plain pages for people.  python -m palimpsest PATH serve

POST /api/store, /api/recall, /api/batch; GET /api/stats, /api/health; DELETE
/api/memory/ID; pages /, /memories, /search?q=&tags=, /timeline, /map, and a form
at /store.  Requests change one library, so they are answered one at a time.
"""

from __future__ import annotations

import html
import json
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame

from .service import Api


def rows(df: DataFrame) -> list[dict]:
    return [r.asDict(True) for r in df.collect()]


def table(df: DataFrame) -> str:
    cells = lambda tag, xs: "".join(f"<{tag}>{html.escape(str(x))}</{tag}>" for x in xs)
    body = "".join(f"<tr>{cells('td', r)}</tr>" for r in df.collect())
    return f'<!DOCTYPE html><meta charset="utf-8"><table><tr>{cells("th", df.columns)}</tr>{body}</table>'


def server(api: Api, host: str = "127.0.0.1", port: int = 0, most_bytes: int = 10_000_000) -> HTTPServer:
    """A server that isn't running yet; port 0 is any free one."""
    shown = ("id", "memory_type", "content", "strength")

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args) -> None:
            pass

        def _send(self, what, status: int = 200, kind: str = "application/json") -> None:
            data = (json.dumps(what, default=str) if kind == "application/json" else what).encode()
            self.send_response(status)
            self.send_header("Content-Type", f"{kind}; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _body(self) -> dict | None:
            n = int(self.headers.get("Content-Length") or 0)
            if n > most_bytes:
                return None
            data = self.rfile.read(n).decode()
            if "form" in (self.headers.get("Content-Type") or ""):
                return {k: v[0] for k, v in parse_qs(data).items()}
            try:
                got = json.loads(data or "{}")
            except ValueError:
                return None
            return got if isinstance(got, dict) else None

        def do_GET(self) -> None:
            at = urlsplit(self.path)
            q = {k: v[0] for k, v in parse_qs(at.query).items()}
            if at.path == "/api/health":
                self._send({"status": "ok"})
            elif at.path == "/api/stats":
                self._send(rows(api.stats())[0])
            elif at.path in ("/", "/memories"):
                self._send(table(api.memories_page().select(*shown)), kind="text/html")
            elif at.path == "/search":
                self._send(table(api.results_page(q.get("q", ""), q.get("tags", "")).select("id", "memory_type", "content")), kind="text/html")
            elif at.path == "/timeline":
                self._send(table(api.library.timeline()), kind="text/html")
            elif at.path == "/map":
                self._send(api.library.map(form="html").first()[0], kind="text/html")
            else:
                self._send({"error": "not found"}, 404)

        def do_POST(self) -> None:
            body, path = self._body(), urlsplit(self.path).path
            if body is None:
                self._send({"error": "the body is no JSON object"}, 400)
            elif path == "/api/store" and isinstance(body.get("content"), str):
                self._send(api.store(body["content"], body.get("tags") or (), body.get("context"), body.get("memory_type")))
            elif path == "/api/recall" and isinstance(body.get("query"), str):
                found = api.recall(body["query"], int(body.get("limit") or 5), bool(body.get("use_index")))
                self._send(rows(found if "content" not in found.columns else found.select(*shown, "tags")))
            elif path == "/api/batch" and isinstance(body.get("items"), list):
                self._send([api.store(x["content"], x.get("tags") or (), x.get("context")) for x in body["items"] if isinstance(x, dict) and isinstance(x.get("content"), str)])
            elif path == "/store":
                done = api.submit(body.get("content", ""), body.get("tags", ""), body.get("context"))
                self._send("stored" if done["success"] else "nothing to store", 200 if done["success"] else 400, "text/plain")
            else:
                self._send({"error": "not found, or a field is missing"}, 404)

        def do_DELETE(self) -> None:
            head, _, key = urlsplit(self.path).path.rpartition("/")
            ok = head == "/api/memory" and api.delete(unquote(key))
            self._send({"success": ok}, 200 if ok else 400)

    return HTTPServer((host, port), Handler)
