import io
import json
import os

import pytest

from folioforge.engine import Engine, as_json
from folioforge.server import answer, reply, tools
from folioforge.sources import files, store
from folioforge.sources.files import Config


@pytest.fixture()
def corpus(tmp_path):
    c = tmp_path / "corpus"
    (c / "sub").mkdir(parents=True)
    (c / "Smith_ash.txt").write_text("Introduction\n\nAsh of straw was measured in 2019, see 10.1234/abc.5.\n\nMethods\n\nWe burned straw.")
    (c / "copy.txt").write_text((c / "Smith_ash.txt").read_text())
    (c / "sub" / "oil.MD").write_bytes("Масло было светлым.".encode("cp1251"))
    (c / "note.rtf").write_text(r"{\rtf1 Hello \par world}")
    (c / "scan.pdf").write_bytes(b"%PDF")
    (c / "skip.bin").write_text("no")
    return c


def test_scan_and_decode(spark, corpus):
    rows = {r["filename"]: r for r in files.scan(spark, str(corpus)).collect()}
    assert set(rows) == {"Smith_ash.txt", "copy.txt", "oil.MD", "note.rtf", "scan.pdf"} and rows["copy.txt"]["sha256"] == rows["Smith_ash.txt"]["sha256"]
    texts = {os.path.basename(r["path"]): r for r in files.texts(files.scan(spark, str(corpus))).collect()}
    assert texts["oil.MD"]["text"] == "Масло было светлым." and texts["scan.pdf"]["error"] and "Hello" in texts["note.rtf"]["text"]
    assert files.decode(b"\xef\xbb\xbfa") == "a" and files.decode(b"\x98") == "\x98" and files.decode(None) is None
    pages = files.pages(files.scan(spark, str(corpus)), lambda raw: [(1, [(0.0, 1.0, "ab", 0)])]).collect()
    assert next(r for r in pages if r["path"].endswith("pdf"))["ocr_needed"]


def test_blocks_and_recognition(spark, corpus):
    """Blocks in reading order, images left out; pages without text recognised one by one, a failing page alone."""
    def read(raw):
        return [(1, [(5.0, 90.0, "second", 0), (0.0, 10.0, "first bro-\nken", 0), (0.0, 0.0, "image", 1), (0.0, 95.0, "x", 0), (1.0, 99.0, "long enough for a page", 0)]), (2, []), (3, []), (4, [])]

    def recognise(raw, page):
        if page == 3:
            raise RuntimeError("no")
        return "" if page == 4 else "seen here\n\n1\n\nand there"

    scan = files.scan(spark, str(corpus)).filter("extension = 'pdf'")
    rows = {r["page"]: r for r in files.pages(scan, read, 30, recognise).collect()}
    assert rows[1]["blocks"] == ["first broken", "second", "long enough for a page"] and not rows[1]["used_ocr"]
    assert rows[2]["blocks"] == ["seen here", "and there"] and rows[2]["used_ocr"] and not rows[2]["ocr_needed"]
    assert rows[3]["ocr_needed"] and rows[3]["blocks"] == [] and not rows[4]["ocr_needed"] and not rows[4]["used_ocr"]
    alone = files.pages(scan, read, 30).collect()
    assert {r["page"] for r in alone if r["ocr_needed"]} == {2, 3, 4}
    info = files.document_info(scan, lambda raw: ("untitled", "Adobe", [(20.0, 10.0, 800.0, "A title of some length"), (9.0, 50.0, 800.0, "body")])).first()
    assert (info["title"], info["authors"]) == ("A title of some length", None)


def test_engine(spark, corpus, tmp_path):
    e = Engine(spark, Config(corpus_dir=str(corpus), data_dir=str(tmp_path / "data")))
    assert e.search("ash").count() == 0
    assert e.ingest() == {"added": 4, "removed": 0, "errors": 1, "failed": ["scan.pdf"], "in_step": True}
    assert {(r["stage"], r["source"]) for r in e.journal("ERROR").collect()} == {("extract", "scan.pdf"), ("chunk", "scan.pdf")}
    assert e.journal(last=1).count() == 1
    assert e.stats()["documents"] == 4 and e.search("straw ash").first()["filename"] == "Smith_ash.txt" and as_json(e.keyword("МАСЛО"))[0]["filename"] == "oil.MD"
    assert e.search(" ").count() == 0 and e.keyword("").count() == 0
    (corpus / "note.rtf").unlink()
    (corpus / "sub" / "oil.MD").write_text("Other oil now.")
    (corpus / "scan.pdf").unlink()
    done = e.ingest(prune=True)
    assert done["added"] == 1 and done["removed"] == 3 and e.stats()["documents"] == 2
    assert [tuple(r) for r in e.read("oil").select("page", "text").collect()] == [(1, "Other oil now.")]
    tags = spark.createDataFrame([("a", "straw", 1), ("a", "oil now", 1)], "tag string, query string, k int")
    assert [(r["tag"], json.loads(r["results"])[0]["filename"]) for r in e.batch(tags).collect()] == [("a", "oil.MD")]
    assert e.read("nothing").count() == 0
    folder = e.backup(str(tmp_path / "backups"))
    e.store.delete(e.documents())
    assert e.stats()["documents"] == 0
    saved, vectors = e.store.restore(folder, str(tmp_path / "safety"))
    assert saved and vectors and e.stats()["documents"] == 2 and e.reindex() == 2
    assert {r["stage"]: r["status"] for r in e.check().collect() if r["status"] != "OK"}.keys() <= {"recognition"}
    assert e.store.tables_missing() == [] and e.store.count("documents") == 2
    e.store.set_status(1, "partial")
    assert {r["status"] for r in e.documents().collect()} == {"ok", "partial"}
    assert answer(e, "stats", {})["chunks"] == 2 and answer(e, "keyword", {"term": "straw"})[0]["hits"] == 1
    with pytest.raises(KeyError):
        answer(e, "nope", {})
    out = io.StringIO()
    asked = [{"jsonrpc": "2.0", "id": 1, "method": "initialize"}, {"jsonrpc": "2.0", "method": "note"}, {"jsonrpc": "2.0", "id": 2, "method": "tools/call", "params": {"name": "read", "arguments": {"ref": "oil"}}}, {"jsonrpc": "2.0", "id": 3, "method": "x"}]
    tools(e, io.StringIO("\n".join(map(json.dumps, asked)) + "\nnot json\n"), out)
    answers = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [a["id"] for a in answers] == [1, 2, 3, None] and "Other oil now." in answers[1]["result"]["content"][0]["text"] and "error" in answers[2]
    listed = {t["name"]: t for t in reply(e, {"id": 1, "method": "tools/list"})["result"]["tools"]}
    assert len(listed) == 6 and listed["search"]["inputSchema"]["required"] == ["query"] and listed["keyword"]["inputSchema"]["properties"]["limit"]["default"] == 200
    called = reply(e, {"id": 5, "method": "tools/call", "params": {"name": "search", "arguments": {}}})["result"]
    assert called["isError"] and "query" in called["content"][0]["text"]
    assert answer(e, "list", {"from": "1"})[0]["doc_id"] and "path" not in answer(e, "list", {})[0] and len(answer(e, "list", {"from": "1"})) == 1
    assert answer(e, "search", {"q": "straw", "k": "1"})[0]["rank"] == 1


def test_commands(spark, corpus, tmp_path, capsys):
    from folioforge import cli

    config = tmp_path / "c.toml"
    config.write_text(f'[x]\ncorpus_dir = "{corpus}"\ndata_dir = "{tmp_path / "data"}"\n')

    def said(*args):
        assert cli.main(["--config", str(config), *args]) == 0
        return capsys.readouterr().out

    assert json.loads(said("ingest"))["added"] == 4
    assert "[1]" in said("search", "straw", "-k", "1") and "Smith_ash.txt" in said("keyword", "STRAW") and "--- 1" in said("read", "Smith_ash.txt")
    assert json.loads(said("--json", "keyword", "straw"))[0]["hits"] == 1 and "config.corpus" in said("check") and "scan.pdf" in said("journal", "--level", "ERROR")
    assert "1. " in said("bib") and json.loads(said("bib", "--out", str(tmp_path / "bib")))["folder"]
    q = tmp_path / "q.json"
    q.write_text('[["a", "straw", 1], ["a", "oil", 1]]')
    assert list(json.loads(said("batch", str(q)))) == ["a"]
    r = str(tmp_path / "corpora.json")
    said("add", r, "main", "/data/x/")
    again = json.loads(said("--json", "add", r, "other", "/DATA/X"))
    assert [(c["name"], c["port"]) for c in again] == [("main", 8765)]


def test_json_of_few_keys(spark, tmp_path):
    from folioforge.sources.sinks import put_key

    f = tmp_path / "c.json"
    f.write_text('{"servers": {"a": {"x": 1}}, "other": 2}')
    assert put_key(spark, str(f), "servers", "b", {"y": 2}, dry_run=True)["servers"]["b"] == {"y": 2} and "b" not in json.loads(f.read_text())["servers"]
    put_key(spark, str(f), "servers", "b", {"y": 2})
    put_key(spark, str(f), "servers", "a", None)
    assert json.loads(f.read_text()) == {"servers": {"b": {"y": 2}}, "other": 2} and list(tmp_path.glob("c.json.backup-*"))


def test_states_of_a_table(spark, tmp_path):
    """A reader of an older state keeps its files; states beyond those kept are removed; a closed store does nothing."""
    with store.Store(spark, str(tmp_path / "s")) as s:
        rows = lambda n: spark.createDataFrame([(n, 0, "t", 1, 1, "")], store.CHUNKS)
        s.replace("chunks", rows(1))
        old = s.read("chunks")
        s.append("chunks", rows(2))
        assert old.count() == 1 and s.read("chunks").count() == 2
        for n in range(6):
            s.replace("chunks", rows(n))
        assert s.read("chunks").first()["doc_id"] == 5 and len(s._states("chunks")) == store.Store.KEPT + 1
        assert len(list((tmp_path / "s" / "chunks").glob("v-*"))) == store.Store.KEPT + 1
    with pytest.raises(RuntimeError):
        s.read("chunks")


def test_last_lines(spark, tmp_path):
    f = tmp_path / "log.txt"
    f.write_text("\n".join(f"line {i}" for i in range(50)))
    assert [r["line"] for r in files.tail_lines(spark, str(f), 2).collect()] == ["line 48", "line 49"]


def test_lists_and_journal(spark, tmp_path):
    q = tmp_path / "q.json"
    q.write_text('[["a", "first", 5], ["b", "other"], ["a", "second", 7]]')
    assert {tuple(r) for r in files.queries(spark, str(q)).collect()} == {("a", "second", 7), ("b", "other", 8)}
    q.write_text('{"a": ["text", 3]}')
    assert [tuple(r) for r in files.queries(spark, str(q)).collect()] == [("a", "text", 3)]
    j = tmp_path / "j.jsonl"
    j.write_text('{"ts":"2024-01-01T00:00:00Z","session":"s","stage":"scan","level":"WARN","source":"f","message":"m"}\n\nbroken\n')
    assert files.journal(spark, str(j)).count() == 1
    t = tmp_path / "t.txt"
    t.write_text("## A\nx\n")
    assert [r["line"] for r in files.lines(spark, str(t)).orderBy("line_no").collect()] == ["## A", "x", ""]


def test_config(tmp_path):
    f = tmp_path / "c.toml"
    f.write_bytes("﻿[chunk]\nchunk_tokens = 100\noverlap_tokens = 10\n[x]\nother = 1\n".encode())
    c = Config.load(str(f), {"FOLIOFORGE_DEFAULT_K": "3"})
    assert (c.chunk_tokens, c.overlap_tokens, c.default_k, c.extra) == (100, 10, 3, {"other": 1}) and c.problems() == []
    assert Config(chunk_tokens=5, overlap_tokens=5).problems()


def test_snapshots(spark):
    s = spark.createDataFrame([("backup-20240105-101500",), ("backup-20240107-080000",), ("notes",)], "name string")
    assert store.find_snapshot(s, "latest").first()["name"].endswith("080000") and store.find_snapshot(s, "2024").first()["name"].endswith("101500")
    import datetime as dt

    now = dt.datetime(2024, 1, 7, 9, tzinfo=dt.timezone.utc)
    assert not store.due(s, now, 12).first()["due"] and store.due(s, now, 0.5).first()["due"] and store.due(s.limit(0), now, 5).first()["due"]


def test_titles(spark):
    spans = spark.createDataFrame([(1, 20.0, 10.0, 800.0, "A long title"), (1, 19.8, 30.0, 800.0, "on two lines"), (1, 9.0, 50.0, 800.0, "body"), (1, 40.0, 700.0, 800.0, "foot")], "doc_id int, size double, y double, height double, text string")
    assert files.layout_title(spans).first()["title"] == "A long title on two lines"
    docs = spark.createDataFrame([("10.1/A", "t", "a", None, "j")], "doi string, title string, authors string, year int, journal string")
    works = spark.createDataFrame([("10.1/a", "T", "", 2001, None)], "doi string, title string, authors string, year int, journal string")
    assert tuple(files.enrich(docs, works).first()) == ("10.1/A", "T", "a", 2001, "j")


def test_program_is_looked_for(tmp_path):
    program = tmp_path / "reader"
    program.write_text("#!/bin/sh\n")
    assert files.find_program(str(program)) is None
    program.chmod(0o755)
    files.find_program.cache_clear()
    assert files.find_program(str(program)) == str(program) and files.find_program("", "reader", (str(tmp_path),)) == str(program)
    assert files.find_program("", "no-such-program-here", ()) is None
