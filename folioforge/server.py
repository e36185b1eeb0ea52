"""The engine behind HTTP (JSON) and behind a line-based JSON-RPC tool protocol."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import TextIO
from urllib.parse import parse_qs, urlparse

from folioforge.engine import Engine, as_json


def _int(p: dict, name: str) -> int | None:
    return int(p[name]) if p.get(name) not in (None, "") else None


MOST = 10_000  # rows of a list or bibliography in one answer; ``from`` begins later

PAGE = """<!doctype html><meta charset="utf-8"><title>folioforge</title>
<style>body{font:16px sans-serif;max-width:52em;margin:2em auto}li{margin:.7em 0}small{color:#666}</style>
<form id=f><select name=mode><option value=search>by meaning<option value=keyword>by word</select>
<input name=q size=40 autofocus> <input name=k type=number min=1 max=30 value=8 title="hits"> <input name=paper placeholder="file">
<input name=year_min type=number placeholder="from year"> <input name=year_max type=number placeholder="to year"> <button>Search</button></form>
<ol id=r></ol><pre id=p style="white-space:pre-wrap"></pre>
<script>
f.onsubmit=async e=>{e.preventDefault();const d=Object.fromEntries(new FormData(f));const m=d.mode;if(m=='keyword')d.term=d.q;
const a=await(await fetch('/api/'+m+'?'+new URLSearchParams(d))).json();r.replaceChildren(...[].concat(a).map(h=>{const li=document.createElement('li');
li.textContent=h.error||(h.citation||h.filename)+' · '+(h.score??h.hits+' passages')+' · '+(h.text||h.snippet||'');
li.onclick=async()=>{const t=await(await fetch('/api/read?'+new URLSearchParams({ref:h.doc_id,pages:(h.page_start??h.page??1)+''}))).json();p.textContent=t.map(x=>x.text).join('\\n\\n')};return li}))}
</script>"""


def answer(engine: Engine, route: str, p: dict):
    """The result of a route as plain values; KeyError for an unknown one."""
    start, most = _int(p, "from") or 0, min(_int(p, "limit") or MOST, MOST)
    part = lambda df: as_json(df.offset(start), most)
    question = p.get("query", p.get("q", ""))
    routes = {
        "search": lambda: as_json(engine.search(question, _int(p, "k"), p.get("paper"), _int(p, "year_min"), _int(p, "year_max"))),
        "keyword": lambda: as_json(engine.keyword(p.get("term", ""), _int(p, "limit") or 200, p.get("paper"))),
        "read": lambda: as_json(engine.read(p.get("ref", ""), p.get("pages")), most),
        "stats": engine.stats,
        "list": lambda: part(engine.documents().drop("path", "sha256", "abstract", "added_at")),
        "check": lambda: as_json(engine.check(), most),
        "bib": lambda: part(engine.bibliography(p["keys"].split(",") if p.get("keys") else None)),
    }
    return routes[route]()


def handler(engine: Engine):
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            url = urlparse(self.path)
            if url.path == "/":
                return self._send(200, PAGE.encode(), "text/html; charset=utf-8")
            try:
                code, body = 200, answer(engine, url.path.removeprefix("/api/"), {k: v[-1] for k, v in parse_qs(url.query).items()})
            except KeyError:
                code, body = 404, {"error": "not found"}
            except Exception as e:
                code, body = 500, {"error": f"{type(e).__name__}: {e}"}
            self._send(code, json.dumps(body, ensure_ascii=False, default=str).encode(), "application/json; charset=utf-8")

        def _send(self, code: int, data: bytes, kind: str) -> None:
            self.send_response(code)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args) -> None:
            pass

    return Handler


def serve(engine: Engine, port: int) -> int:
    ThreadingHTTPServer(("127.0.0.1", port), handler(engine)).serve_forever()
    return 0


#: name -> what it is for, its arguments with type, meaning and default, and those that must be given.
TOOLS = {
    "search": (
        "Passages of the corpus nearest in meaning to a question, each with citation, year and pages. Ask it for what is known of a subject. It gives the best k only: to list every document that holds a word use keyword.",
        {"query": ("string", "The question.", None), "k": ("integer", "How many passages: 10 for one fact, up to 40 for an overview.", 10), "paper": ("string", "Only files whose name holds this, or fits this pattern of * and ?.", None),
         "year_min": ("integer", "From this year on.", None), "year_max": ("integer", "Up to this year.", None)}, ["query"]),
    "keyword": (
        "All documents that hold a word or a part of one, whatever its case, with the number of passages and a snippet. Ask it for completeness. It looks for letters, not for meaning: a term in another language is another term.",
        {"term": ("string", "The word or a part of it.", None), "paper": ("string", "Only files like this.", None), "limit": ("integer", "Documents at the most.", 200)}, ["term"]),
    "read": (
        "Full text of a document's pages, for the context of a passage found.",
        {"ref": ("string", "Number, citation key or name of the document.", None), "pages": ("string", "Such as 5-8 or 12; all without it.", None)}, ["ref"]),
    "list": ("All documents with number, key, year, title and file.", {"from": ("integer", "Documents to skip.", 0), "limit": ("integer", "Documents at the most.", MOST)}, []),
    "stats": ("How many documents, passages and vectors there are, by year and by status.", {}, []),
    "bib": ("Numbered bibliography of the corpus or of some keys.", {"keys": ("string", "Citation keys with commas between them.", None)}, []),
}


def tool_list() -> list[dict]:
    def argument(kind: str, meaning: str, default) -> dict:
        return {"type": kind, "description": meaning} | ({} if default is None else {"default": default})

    return [
        {"name": name, "description": what, "inputSchema": {"type": "object", "properties": {k: argument(*v) for k, v in arguments.items()}, "required": required}}
        for name, (what, arguments, required) in TOOLS.items()]


def reply(engine: Engine, request: dict) -> dict | None:
    """Answer of one JSON-RPC request; notifications have none."""
    if "id" not in request:
        return None
    method, params = request.get("method"), request.get("params") or {}
    out: dict = {"jsonrpc": "2.0", "id": request["id"]}
    if method == "initialize":
        return out | {"result": {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "folioforge", "version": "0.1.0"}}}
    if method == "ping":
        return out | {"result": {}}
    if method == "tools/list":
        return out | {"result": {"tools": tool_list()}}
    if method == "tools/call" and params.get("name") in TOOLS:
        try:
            given = params.get("arguments") or {}
            if lacking := [a for a in TOOLS[params["name"]][2] if given.get(a) in (None, "")]:
                raise ValueError(f"missing: {', '.join(lacking)}")
            if params["name"] == "search":
                given = {"k": 10} | given
            text, bad = json.dumps(answer(engine, params["name"], given), ensure_ascii=False, default=str), False
        except Exception as e:
            text, bad = f"{type(e).__name__}: {e}", True
        return out | {"result": {"content": [{"type": "text", "text": text}], "isError": bad}}
    return out | {"error": {"code": -32601, "message": f"unknown method {method}"}}


def tools(engine: Engine, source: TextIO, sink: TextIO) -> int:
    for line in source:
        if line.strip():
            try:
                found = reply(engine, json.loads(line))
            except ValueError:
                found = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "parse error"}}
            if found is not None:
                sink.write(json.dumps(found, ensure_ascii=False) + "\n")
                sink.flush()
    return 0
