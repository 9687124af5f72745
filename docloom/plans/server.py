"""A small HTTP server over a built index: a page to ask from, and JSON for programs."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from docloom.plans.engine import Engine
from docloom.sources.artifacts import jsonable

PAGE = """<!doctype html><html lang="en"><head><meta charset="utf-8"><title>docloom</title></head><body>
<h1>Ask the documents</h1>
<form id="f"><input id="q" size="60" minlength="3" required placeholder="Question">
<select id="s"><option>auto</option><option>extractive</option><option>explanatory</option></select>
<input id="t" type="number" min="0" max="1" step="0.01" value="0.01"><button>Ask</button></form>
<h2 id="a"></h2><p id="c"></p><ol id="e"></ol>
<script>
document.getElementById("f").onsubmit = async (event) => {
  event.preventDefault();
  const value = (id) => document.getElementById(id).value;
  const body = JSON.stringify({question: value("q"), style: value("s"), threshold: Number(value("t"))});
  const answer = await (await fetch("/api/ask", {method: "POST", body})).json();
  document.getElementById("a").textContent = answer.error || answer.final_answer || "No answer";
  document.getElementById("c").textContent = answer.error ? "" : `confidence ${answer.confidence}, ${answer.question_style}`;
  document.getElementById("e").replaceChildren(...(answer.evidence || []).map((x) => {
    const row = document.createElement("li"); row.textContent = `${x.title} - ${x.source_url}: ${x.context_preview}`; return row; }));
};
</script></body></html>"""


def make_server(engine: Engine, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """GET /, /api/health and /api/status; POST /api/ask with question, threshold and style. 422 for invalid questions, 503
    without a built index, 500 for failures."""

    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, body: str, kind: str = "application/json") -> None:
            data = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", f"{kind}; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _json(self, status: int, value) -> None:
            self._send(status, json.dumps(jsonable(value), ensure_ascii=False))

        def do_GET(self):
            if self.path == "/":
                self._send(200, PAGE, "text/html")
            elif self.path == "/api/health":
                self._json(200, {"status": "ok"})
            elif self.path == "/api/status":
                self._json(200, engine.status())
            else:
                self._json(404, {"error": "not found"})

        def do_POST(self):
            if self.path != "/api/ask":
                return self._json(404, {"error": "not found"})
            try:
                asked = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)))
                question, threshold, style = str(asked["question"]), float(asked.get("threshold", 0.01)), str(asked.get("style", "auto"))
            except (ValueError, KeyError, TypeError, AttributeError):
                return self._json(422, {"error": "a question is asked as JSON"})
            try:
                self._json(200, engine.ask(question, threshold, style))
            except ValueError as e:
                self._json(422, {"error": str(e)})
            except FileNotFoundError as e:
                self._json(503, {"error": str(e)})
            except Exception as e:
                self._json(500, {"error": f"{type(e).__name__}: {e}"[:500]})

        def log_message(self, *_):
            pass

    return ThreadingHTTPServer((host, port), Handler)
