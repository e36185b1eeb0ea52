"""Command line: python -m folioforge.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys

from folioforge.engine import Engine, as_json
from folioforge.operators import search as S
from folioforge.session import local_session
from folioforge.shared import cut
from folioforge.sources import files, sinks, store
from folioforge.sources.files import Config


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="folioforge")
    p.add_argument("--config")
    p.add_argument("--json", action="store_true", help="plain values instead of lines to read")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("ingest")
    c.add_argument("folder", nargs="?")
    c.add_argument("--prune", action="store_true")
    sub.add_parser("reindex")
    c = sub.add_parser("search")
    c.add_argument("query")
    c.add_argument("-k", type=int)
    c.add_argument("--paper")
    c.add_argument("--year-min", type=int)
    c.add_argument("--year-max", type=int)
    c = sub.add_parser("keyword")
    c.add_argument("term")
    c.add_argument("--limit", type=int)
    c.add_argument("--paper")
    c = sub.add_parser("read")
    c.add_argument("ref")
    c.add_argument("--pages")
    c = sub.add_parser("bib")
    c.add_argument("--keys")
    c.add_argument("--out", help="folder that the bibliography is written to as markdown")
    c = sub.add_parser("journal")
    c.add_argument("--level", choices=["INFO", "WARN", "ERROR"])
    c.add_argument("--tail", type=int, default=40)
    c = sub.add_parser("batch")
    c.add_argument("queries", help="JSON file of tagged questions")
    c = sub.add_parser("add")
    c.add_argument("registry")
    c.add_argument("name")
    c.add_argument("corpus")
    for name in ("list", "stats", "check"):
        sub.add_parser(name)
    c = sub.add_parser("backup")
    c.add_argument("target")
    c = sub.add_parser("restore")
    c.add_argument("folder")
    c.add_argument("--safety")
    c = sub.add_parser("serve")
    c.add_argument("--port", type=int, default=8765)
    sub.add_parser("tools")
    return p


def run(engine: Engine, a: argparse.Namespace):
    """The result of a command as plain values."""
    c = a.command
    if c == "ingest":
        return engine.ingest(a.folder, a.prune)
    if c == "reindex":
        return {"vectors": engine.reindex()}
    if c == "search":
        return as_json(engine.search(a.query, a.k, a.paper, a.year_min, a.year_max))
    if c == "keyword":
        return as_json(engine.keyword(a.term, a.limit, a.paper))
    if c == "read":
        return as_json(engine.read(a.ref, a.pages))
    if c == "journal":
        return as_json(engine.journal(a.level, a.tail))
    if c == "batch":
        return {r["tag"]: json.loads(r["results"]) for r in engine.batch(files.queries(engine.spark, a.queries)).toLocalIterator()}
    if c == "add":
        fresh = engine.spark.createDataFrame([(a.name, a.corpus)], "name string, corpus string")
        every = store.registered(files.registry(engine.spark, a.registry) if engine.store._fs.exists(engine.store._path(a.registry)) else engine.spark.createDataFrame([], "name string, corpus string, data string, port int"), fresh)
        sinks.write_registry(cut(every, "registry"), a.registry)
        return as_json(files.registry(engine.spark, a.registry))
    if c == "bib" and a.out:
        lines = engine.bibliography(a.keys.split(",") if a.keys else None).withColumn("line", S.bibliography_line())
        sinks.write_lines(lines, a.out, ["n"])
        return {"folder": a.out}
    if c == "bib":
        return as_json(engine.bibliography(a.keys.split(",") if a.keys else None))
    if c == "list":
        return as_json(engine.documents())
    if c == "stats":
        return engine.stats()
    if c == "check":
        return as_json(engine.check())
    if c == "backup":
        return {"folder": engine.backup(a.target)}
    if c == "restore":
        return dict(zip(("saved", "vectors"), engine.store.restore(a.folder, a.safety)))
    raise SystemExit(f"unknown command {c}")


def readable(command: str, result) -> str:
    """A result as lines."""
    if command == "search":
        return "\n".join(f"[{h['rank']}] {h['score'] * 100:.0f} % {h['citation']}, {h['filename']}, {h['page_start']}–{h['page_end']}\n    {h['text'] or ''}" for h in result)
    if command == "keyword":
        return "\n".join(f"{h['hits']:>5}  {h['filename']} ({h['year'] or '?'}), {h['page']}: {h['snippet']}" for h in result)
    if command == "read":
        return "\n\n".join(f"--- {p['page']}\n{p['text']}" for p in result)
    if command == "check":
        return "\n".join(f"[{r['status']:^4}] {r['stage']:<22} {r['detail']}" for r in result)
    if command == "bib":
        return "\n".join(f"{r['n']}. {r['authors']} ({r['year']}). {r['title']}. *{r['journal']}*. DOI: {r['doi']}" for r in result)
    if command == "journal":
        return "\n".join(f"{r['ts']} {r['level']:<5} {r['stage']} {r['source'] or ''}: {r['message']}" for r in result)
    return json.dumps(result, ensure_ascii=False, indent=1, default=str)


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    engine = Engine(local_session(), Config.load(a.config))
    if a.command in ("serve", "tools"):
        from folioforge import server

        return server.serve(engine, a.port) if a.command == "serve" else server.tools(engine, sys.stdin, sys.stdout)
    result = run(engine, a)
    plain = a.json or isinstance(result, dict)
    print(json.dumps(result, ensure_ascii=False, indent=1, default=str) if plain else readable(a.command, result))
    return 0


if __name__ == "__main__":
    sys.exit(main())
