"""Files and stored tables as named queries: what is written is read back."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import analysis as A
from folioforge.operators import journal as J
from folioforge.operators import vectors as V
from folioforge.plans import markup as PM
from folioforge.plans.search import strip
from folioforge.plans.texts import clean
from folioforge.session import table
from folioforge.shared import cut, new_path
from folioforge.sources import files, sinks, store

BATCH_FILE = '[["a", "first", 5], ["b", "other"], ["a", "second", 7]]'
CORPORA = '[{"name": "main", "corpus": "/data/main", "data": "data-main", "port": 8765}, {"name": "oils", "corpus": "/data/oils", "data": "data-oils", "port": 8766}]'
RECTANGLES = [("a.pdf", 1, 10.0, 10.0, 200.0, 300.0, 600.0, 800.0), ("a.pdf", 1, 0.0, 0.0, 50.0, 50.0, 600.0, 800.0), ("a.pdf", 2, 300.0, 500.0, 599.0, 790.0, 600.0, 800.0), ("b.pdf", 7, 100.0, 100.0, 200.0, 200.0, 500.0, 500.0)]


def _file(spark: SparkSession, name: str, text: str) -> str:
    path = f"{new_path(spark, 'given')}/{name}"
    sinks._write(spark, path, text)
    return path


def store_cycle(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the three tables as they are stored, after documents in error are deleted, after a snapshot is restored, and of it."""
    root = new_path(spark, "store")
    docs, chunks, vectors = table(spark, d, "documents"), table(spark, d, "chunks"), table(spark, d, "vectors")
    rows = []
    with store.Store(spark, f"{root}/tables") as s:
        for name, df in (("documents", docs), ("chunks", chunks), ("vectors", vectors)):
            s.append(name, df)
        count = lambda step: rows.append((step, s.count("documents"), s.count("chunks"), s.count("vectors")))
        count("stored")
        saved = s.snapshot(f"{root}/backups", ("documents", "chunks", "vectors"))
        s.set_status(1, "partial")
        s.delete(s.read("documents").filter("status = 'error'"))
        count("deleted")
        s.restore(saved)
        count("restored")
        rows.append(("snapshots", s.snapshots(f"{root}/backups").count(), len(s.tables_missing()), s.next_id()))
    return spark.createDataFrame(rows, "step string, documents bigint, chunks bigint, vectors bigint")


def journal_written(spark: SparkSession, d: str) -> DataFrame:
    """Warnings of a journal that was written as lines and read again."""
    path = new_path(spark, "journal")
    files.append_journal(table(spark, d, "journal").select("ts", "session", "stage", "level", "source", "message"), path)
    return J.at_least(files.journal(spark, path), "WARN").groupBy("stage", "level").agg(F.count("*").alias("n"))


def works_enriched(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one DOI with the title and year that most rows, then the smallest value, give it."""
    docs = table(spark, d, "documents")
    named = docs.filter("doi IS NOT NULL AND doi != ''").groupBy(F.lower("doi").alias("doi"))
    works = named.agg(F.min("title").alias("title"), F.min("authors").alias("authors"), F.min("year").alias("year"), F.min("journal").alias("journal"))
    return files.enrich(docs.select("doc_id", "doi", "title", "authors", "year", "journal"), works)


def files_scanned(spark: SparkSession, d: str) -> DataFrame:
    """The texts of all documents as files of the formats, scanned, hashed and decoded again."""
    import pyarrow as pa
    from pyarrow import fs

    folder = new_path(spark, "files")

    def write(batches):
        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                system.create_dir(f"{root}/{i % 100}", recursive=True)
                with system.open_output_stream(f"{root}/{i % 100}/{i}.{('txt', 'MD', 'bin')[i % 3]}") as f:
                    f.write(t.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    table(spark, d, "documents").filter("text != ''").select("doc_id", "text").mapInArrow(write, "n bigint").agg(F.sum("n")).collect()
    scan = cut(files.scan(spark, folder), "scan")
    texts = files.texts(scan).select("path", F.length("text").alias("characters"))
    return scan.join(texts, "path").select("filename", "extension", F.col("length").alias("bytes"), "sha256", "characters")


def batch_file(spark: SparkSession, d: str) -> DataFrame:
    return files.queries(spark, _file(spark, "batch.json", BATCH_FILE))


def corpora_file(spark: SparkSession, d: str) -> DataFrame:
    return files.registry(spark, _file(spark, "corpora.json", CORPORA))


def topics_file(spark: SparkSession, d: str) -> DataFrame:
    return A.carried_sections(files.lines(spark, _file(spark, "topics.txt", "\n".join(PM.TOPICS))))


def embedding_lengths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_id", V.embedding_tokens(F.col("text")).alias("tokens"))


def crop_rectangles(spark: SparkSession, d: str) -> DataFrame:
    return A.crop_rectangles(spark.createDataFrame(RECTANGLES, "file string, page int, x0 double, y0 double, x1 double, y1 double, width double, height double"))


def coverage_of_wordings(spark: SparkSession, d: str) -> DataFrame:
    """Topics asked for in all their wordings, embedded as the passages are."""
    stored = table(spark, d, "chunks").join(table(spark, d, "documents").select("doc_id", "filename"), "doc_id").select("chunk_id", "filename", "text")
    stored = cut(V.embed(stored, "text").select("chunk_id", "filename", "embedding"), "passages")
    topics = table(spark, d, "benchmark").select(F.col("item_id").alias("topic"), F.substring_index("text", ".", 1).alias("title"))
    wordings = topics.select("topic", F.posexplode(T.topic_variants(F.col("title"))).alias("variant", "wording")).withColumn("w", F.concat_ws("/", "topic", "variant"))
    found = V.batch_top_k(stored, "embedding", "chunk_id", V.embed(wordings.select("w", "wording"), "wording", prefix="query: "), "w", "embedding", A.DEPTH)
    hits = found.join(stored.select("chunk_id", "filename"), "chunk_id").select(
        F.substring_index("w", "/", 1).cast("bigint").alias("topic"), F.substring_index("w", "/", -1).cast("int").alias("variant"), "score", "filename")
    keywords = topics.select("topic", F.explode(T.topic_keywords(F.col("title"))).alias("keyword")).distinct()
    return A.coverage(hits, keywords, A.documents_with_keywords(table(spark, d, "documents"), "doc_id", "text", keywords.select("keyword")))


def _read_pages(raw: bytes) -> list:
    """Pages parted by empty lines; their lines stand from bottom to top, with an image before them."""
    return [(i, [(0.0, -1e9, "image", 1), *[(0.0, float(-k), line, 0) for k, line in enumerate(page.split("\n"))]]) for i, page in enumerate(raw.decode().split("\n\n"), 1)]


def _recognise(raw: bytes, page: int) -> str:
    if page % 3 == 0:
        raise ValueError("illegible")
    return f"recognised page {page}\n\n?"


def _read_info(raw: bytes) -> tuple:
    told = json.loads(raw)
    return told.get("title"), told.get("authors"), [(10.0 + len(line) % 4, 100.0 * k, 800.0, line) for k, line in enumerate((told.get("text") or "").split("\n")[:7], 1)]


def pdf_pages(spark: SparkSession, d: str) -> DataFrame:
    """The texts of all documents as if they were files to be read page by page, with recognition where a page holds little."""
    docs = table(spark, d, "documents").filter("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("path"), F.lit("pdf").alias("extension"), F.col("text").cast("binary").alias("content"))
    pages = files.pages(docs, _read_pages, 30, _recognise)
    return pages.select(F.col("path").cast("bigint").alias("doc_id"), "page", F.array_join("blocks", "\n\n").alias("text"), "used_ocr", "ocr_needed")


def pdf_info(spark: SparkSession, d: str) -> DataFrame:
    """Titles and authors as files tell them, else from the largest of the first lines."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.lit("pdf").alias("extension"), F.to_json(F.struct("title", "authors", "text")).cast("binary").alias("content"))
    return files.document_info(docs, _read_info).select(F.col("path").cast("bigint").alias("doc_id"), "title", "authors")


QUERIES = {f.__name__: f for f in (
    store_cycle, journal_written, works_enriched, files_scanned, batch_file, corpora_file, topics_file, embedding_lengths, crop_rectangles, coverage_of_wordings, pdf_pages, pdf_info)}

_counts = lambda step, where: f"""SELECT '{step}' AS step, (SELECT count(*) FROM documents d WHERE {where}) AS documents, (SELECT count(*) FROM chunks JOIN documents d USING (doc_id) WHERE {where}) + (SELECT count(*) FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS chunks,
 (SELECT count(*) FROM vectors JOIN documents d USING (doc_id) WHERE {where}) + (SELECT count(*) FROM vectors WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS vectors"""  # noqa: E731

_junk = "|".join(files.JUNK_AUTHORS)
ORACLE = {
    "pdf_pages": f"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS p, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS page FROM documents WHERE text IS NOT NULL),
 b AS (SELECT doc_id, page, array_to_string(list_reverse(list_filter(list_transform(string_split(p, chr(10)), lambda x: {clean('x')}), lambda x: length(x) >= 2)), chr(10) || chr(10)) AS t FROM p)
 SELECT doc_id, CAST(page AS INTEGER) AS page, CASE WHEN length(t) < 30 AND page % 3 <> 0 THEN 'recognised page ' || page ELSE t END AS text, length(t) < 30 AND page % 3 <> 0 AS used_ocr, length(t) < 30 AND page % 3 = 0 AS ocr_needed FROM b""",
    "pdf_info": f"""WITH l AS (SELECT doc_id, title, authors, string_split(coalesce(text, ''), chr(10))[1:5] AS w FROM documents), m AS (SELECT *, list_max(list_transform(w, lambda x: length(x) % 4)) AS top FROM l),
 t AS (SELECT *, regexp_replace({strip("array_to_string(list_filter(w, lambda x: length(x) % 4 = top), ' ')")}, '{T.W}+', ' ', 'g') AS layout FROM m)
 SELECT doc_id, coalesce(CASE WHEN length({strip('title')}) >= 8 AND NOT regexp_matches(lower(title), '^(untitled|microsoft word|document[0-9]*)') THEN {strip('title')} END, CASE WHEN length(layout) BETWEEN 12 AND 400 THEN layout END) AS title,
 CASE WHEN NOT regexp_matches(lower(authors), '{_junk}') AND {strip('authors')} <> '' THEN {strip('authors')} END AS authors FROM t""",
    "store_cycle": " UNION ALL ".join([_counts("stored", "true"), _counts("deleted", "d.status <> 'error' OR d.doc_id = 1"), _counts("restored", "true"), "SELECT 'snapshots', 1, 0, (SELECT max(doc_id) + 1 FROM documents)"]),
    "journal_written": "SELECT stage, level, count(*) AS n FROM journal WHERE upper(level) IN ('WARN', 'ERROR') GROUP BY 1, 2",
    "works_enriched": """WITH w AS (SELECT lower(doi) AS k, min(title) AS t, min(authors) AS a, min(year) AS y, min(journal) AS j FROM documents WHERE doi IS NOT NULL AND doi <> '' GROUP BY 1)
 SELECT doc_id, doi, coalesce(nullif(t, ''), title) AS title, coalesce(nullif(a, ''), authors) AS authors, coalesce(y, year) AS year, coalesce(nullif(j, ''), journal) AS journal FROM documents LEFT JOIN w ON lower(doi) = k""",
    "files_scanned": """SELECT doc_id || CASE doc_id % 3 WHEN 0 THEN '.txt' ELSE '.MD' END AS filename, CASE doc_id % 3 WHEN 0 THEN 'txt' ELSE 'md' END AS extension, CAST(strlen(text) AS BIGINT) AS bytes, sha256(text) AS sha256, CAST(length(text) AS INTEGER) AS characters
 FROM documents WHERE text <> '' AND doc_id % 3 < 2""",
    "batch_file": "SELECT * FROM (VALUES ('a', 'second', 7), ('b', 'other', 8)) t(tag, query, k)",
    "corpora_file": "SELECT * FROM (VALUES ('main', '/data/main', 'data-main', 8765), ('oils', '/data/oils', 'data-oils', 8766)) t(name, corpus, data, port)",
    "topics_file": PM.ORACLE["topics_parsed"],
    "embedding_lengths": f"SELECT chunk_id, CAST(len(regexp_split_to_array(regexp_replace('passage: ' || coalesce(text, ''), '^{T.W}+|{T.W}+$', '', 'g'), '{T.W}+')) + 2 AS INTEGER) AS tokens FROM chunks",
    "crop_rectangles": "SELECT * FROM (VALUES ('a.pdf', 1, 0.0, 0.0, 212.0, 316.0), ('a.pdf', 2, 288.0, 484.0, 600.0, 800.0), ('b.pdf', 7, 90.0, 90.0, 210.0, 210.0)) t(file, page, x0, y0, x1, y1)",
}
