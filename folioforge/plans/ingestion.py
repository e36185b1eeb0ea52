"""Ingestion bookkeeping, checks, journal and analyses as named queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import analysis as A
from folioforge.operators import ingest as I
from folioforge.operators import journal as J
from folioforge.operators import quality as Q
from folioforge.operators import search as S
from folioforge.operators import vectors as V
from folioforge.plans.search import VALID
from folioforge.plans.texts import _capital, _plain, _word
from folioforge.plans.search import first_author, strip
from folioforge.session import table


def _stamp(column: str) -> Column:
    """A time as text, so that no reader turns it into another zone."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def content_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return I.content_duplicates(table(spark, d, "documents"), "doc_id", "text")


def doi_classes(spark: SparkSession, d: str) -> DataFrame:
    return I.doi_classes(table(spark, d, "documents"))


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """What was known by the end of 2023, and the files delivered since."""
    docs = table(spark, d, "documents")
    return docs.filter("added_at < TIMESTAMP '2024-01-01 00:00:00Z'"), docs.filter("added_at >= TIMESTAMP '2024-01-01 00:00:00Z'")


def new_files(spark: SparkSession, d: str) -> DataFrame:
    known, files = _snapshots(spark, d)
    return I.new_files(files.select("path", "sha256").distinct(), known)


def replaced_documents(spark: SparkSession, d: str) -> DataFrame:
    """As if the files of partial documents had been delivered anew, with other content."""
    docs = table(spark, d, "documents")
    files = docs.select("path", F.when(F.col("status") == "partial", F.reverse("sha256")).otherwise(F.col("sha256")).alias("sha256"))
    return I.replaced(docs, files).select("doc_id", "path")


def missing_documents(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "journal").select(F.col("source").alias("filename"))
    return I.missing_files(table(spark, d, "documents"), seen, "filename").select("doc_id", "filename")


def pruned_counts(spark: SparkSession, d: str) -> DataFrame:
    docs, chunks, vectors = table(spark, d, "documents"), table(spark, d, "chunks"), table(spark, d, "vectors")
    left = I.remove(docs, chunks, vectors, docs.filter("status = 'error'"))
    return S.totals(*left)


def distinct_keys(spark: SparkSession, d: str) -> DataFrame:
    return I.disambiguated_keys(table(spark, d, "documents"))


def dense_ids(spark: SparkSession, d: str) -> DataFrame:
    return S.numbered(table(spark, d, "documents").select("path", "doc_id"), [F.asc("path"), F.asc("doc_id")], "id")


def document_status(spark: SparkSession, d: str) -> DataFrame:
    return I.document_status(table(spark, d, "documents"), table(spark, d, "chunks"))


def ingest_report(spark: SparkSession, d: str) -> DataFrame:
    return I.report(table(spark, d, "documents")).withColumn("last_added", _stamp("last_added"))


def vector_rows(spark: SparkSession, d: str) -> DataFrame:
    """What the vector store holds of each chunk: unknown year 0, no nulls in texts."""
    docs = table(spark, d, "documents").select("doc_id", "cite_key", "filename", "year")
    return table(spark, d, "chunks").join(docs, "doc_id").select(
        F.concat_ws(":", "doc_id", "chunk_index").alias("vector_id"), F.coalesce("cite_key", F.lit("")).alias("cite_key"), "filename", F.coalesce("year", F.lit(0)).alias("year"),
        "page_start", "page_end", F.coalesce("section", F.lit("")).alias("section"))


def embedded_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk embedded anew."""
    return V.embed(table(spark, d, "chunks").select("chunk_id", "text"), "text").select("chunk_id", F.size("embedding").alias("dim"))


def vector_problems(spark: SparkSession, d: str) -> DataFrame:
    return Q.vector_problems(table(spark, d, "vectors"))


def stores_out_of_step(spark: SparkSession, d: str) -> DataFrame:
    return Q.out_of_step(table(spark, d, "chunks"), table(spark, d, "vectors"))


def documents_without_chunks(spark: SparkSession, d: str) -> DataFrame:
    return Q.without_chunks(table(spark, d, "documents"), table(spark, d, "chunks"))


def chunk_sizes(spark: SparkSession, d: str) -> DataFrame:
    return Q.chunk_sizes(table(spark, d, "chunks"))


def index_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Once chunks without a page are taken out."""
    return Q.index_gaps(table(spark, d, "chunks").filter("page_start IS NOT NULL"))


def check_report(spark: SparkSession, d: str) -> DataFrame:
    return Q.report(table(spark, d, "documents"), table(spark, d, "chunks"), table(spark, d, "vectors"))


def journal_counts(spark: SparkSession, d: str) -> DataFrame:
    return J.counts(table(spark, d, "journal"))


def journal_by_stage(spark: SparkSession, d: str) -> DataFrame:
    return J.counts(table(spark, d, "journal"), ["stage"])


def journal_warnings(spark: SparkSession, d: str) -> DataFrame:
    return J.at_least(table(spark, d, "journal"), "WARN").select(_stamp("ts").alias("ts"), "session", "stage", "level", "source", "message")


def journal_tail(spark: SparkSession, d: str) -> DataFrame:
    return J.tail(table(spark, d, "journal")).drop("ts")


def journal_sessions(spark: SparkSession, d: str) -> DataFrame:
    return J.sessions(table(spark, d, "journal")).withColumn("start", _stamp("start"))


def journal_stream(spark: SparkSession, d: str) -> DataFrame:
    from folioforge.streaming.journal import hourly_counts

    return hourly_counts(spark, f"{d}/journal*.parquet", table(spark, d, "journal").schema).withColumn("start", _stamp("start"))


def topic_keyword_documents(spark: SparkSession, d: str) -> DataFrame:
    topics = table(spark, d, "benchmark").select(F.explode(T.topic_keywords(F.col("text"))).alias("keyword"))
    return A.documents_with_keywords(table(spark, d, "documents"), "doc_id", "text", topics)


def _topic_hits(spark: SparkSession, d: str) -> DataFrame:
    """Each item is a topic asked for in two wordings: vectors 2 item - 2 and 2 item - 1 stand for the embedded ones."""
    wordings = table(spark, d, "embeddings").select(F.col("vec_id").alias("wording"), F.col("embedding").alias("q"))
    stored = table(spark, d, "vectors")
    found = V.batch_top_k(stored, "embedding", "chunk_id", wordings, "wording", "q", A.DEPTH)
    names = stored.select("chunk_id", "filename", "page_start").distinct()
    return found.join(names, "chunk_id").select(
        (F.floor(F.col("wording") / 2) + 1).cast("bigint").alias("topic"), (F.col("wording") % 2).cast("int").alias("variant"), "chunk_id", "score", "rank", "filename", "page_start")


def coverage_verdicts(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("topic"), F.explode(T.topic_keywords(F.col("text"))).alias("keyword")).distinct()
    return A.coverage(_topic_hits(spark, d), items, topic_keyword_documents(spark, d))


def evidence_digest(spark: SparkSession, d: str) -> DataFrame:
    return A.digest(_topic_hits(spark, d), least=0.3)


def robustness(spark: SparkSession, d: str) -> DataFrame:
    stored = table(spark, d, "embeddings")
    queries = stored.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), "embedding")
    bent = queries.select("query", F.zip_with("embedding", F.reverse("embedding"), lambda a, b: (a * F.lit(0.8) + b * F.lit(0.3)).cast("float")).alias("embedding"))
    top = lambda q: V.batch_top_k(stored, "embedding", "vec_id", q, "query", "embedding", 10).withColumnRenamed("vec_id", "hit")
    return A.robustness(A.overlap(top(queries), top(bent)))


QUERIES = {f.__name__: f for f in (
    content_duplicates, doi_classes, new_files, replaced_documents, missing_documents, pruned_counts, distinct_keys, dense_ids, document_status, ingest_report, vector_rows, embedded_chunks,
    vector_problems, stores_out_of_step, documents_without_chunks, chunk_sizes, index_gaps, check_report, journal_counts, journal_by_stage, journal_warnings, journal_tail, journal_sessions, journal_stream,
    topic_keyword_documents, coverage_verdicts, evidence_digest, robustness)}

_text = lambda ts: f"strftime({ts} AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S.%f')"
_known, _files = "(SELECT * FROM documents WHERE added_at < TIMESTAMPTZ '2024-01-01 00:00:00+00')", "(SELECT * FROM documents WHERE added_at >= TIMESTAMPTZ '2024-01-01 00:00:00+00')"
_base = f"""CASE WHEN {first_author('authors')} <> '' THEN {_capital(first_author('authors'))} WHEN {_word} <> '' THEN {_capital(_word)} WHEN {_plain} <> '' THEN {_plain} ELSE 'Doc' END || coalesce(CAST(nullif(year, 0) AS VARCHAR), 'ND')"""
_severity = "CASE upper(level) WHEN 'INFO' THEN 1 WHEN 'WARN' THEN 2 WHEN 'ERROR' THEN 3 ELSE 0 END"
_counts = f"count_if({_severity} = 1) AS info, count_if({_severity} = 2) AS warn, count_if({_severity} = 3) AS error"
_problem = """CASE WHEN embedding IS NULL THEN 'null' WHEN len(embedding) <> 64 THEN 'dimension' WHEN len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0 THEN 'not_finite'
 WHEN len(list_filter(embedding, lambda x: x <> 0)) = 0 THEN 'zero' ELSE 'ok' END"""
_step = """SELECT doc_id, coalesce(c.n, 0) AS chunks, coalesce(v.n, 0) AS vectors FROM (SELECT doc_id, count(*) AS n FROM chunks GROUP BY 1) c
 FULL JOIN (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, chunk_index FROM vectors) GROUP BY 1) v USING (doc_id) WHERE coalesce(c.n, 0) <> coalesce(v.n, 0)"""
_without = "SELECT doc_id, filename FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM chunks)"
_sizes = "SELECT doc_id, count_if(length(text) > 4000) AS over, CAST(max(length(text)) AS INTEGER) AS worst FROM chunks GROUP BY 1 HAVING count_if(length(text) > 4000) > 0"
_gaps = "SELECT doc_id, count(*) AS n FROM chunks GROUP BY 1 HAVING min(chunk_index) <> 0 OR max(chunk_index) <> count(*) - 1 OR count(DISTINCT chunk_index) <> count(*)"
_row = lambda i, stage, sql, bad: f"SELECT {i} AS ord, '{stage}' AS stage, CASE WHEN count(*) = 0 THEN 'OK' ELSE '{bad}' END AS status, count(*) AS n FROM ({sql})"
_stop = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_keywords = f"list_transform(list_filter(list_transform(regexp_extract_all(text, '[{T.NAME_LETTERS}]{{6,}}'), lambda w: lower(w)), lambda w: w NOT IN ({_stop})), lambda w: left(w, 7))[1:4]"
_kd = f"""kd AS (SELECT keyword, count(*) AS documents FROM (SELECT DISTINCT unnest({_keywords}) AS keyword FROM benchmark) JOIN documents ON contains(lower(text), keyword) GROUP BY 1)"""
_hits = f"""v AS (SELECT DISTINCT chunk_id, filename, page_start, CAST(embedding AS DOUBLE[]) AS e FROM vectors WHERE {VALID}), w AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE {VALID}),
 s AS (SELECT vec_id, chunk_id, filename, page_start, round(list_cosine_similarity(q, e), 4) AS score FROM w, v),
 h AS (SELECT vec_id // 2 + 1 AS topic, CAST(vec_id % 2 AS INTEGER) AS variant, chunk_id, score, rank, filename, page_start FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 14)"""
_top = lambda q: f"SELECT query, vec_id AS hit, rank FROM (SELECT query, vec_id, row_number() OVER (PARTITION BY query ORDER BY round(list_cosine_similarity(q, CAST(embedding AS DOUBLE[])), 4) DESC, vec_id) AS rank FROM {q}, embeddings WHERE {VALID}) WHERE rank <= 10"

ORACLE = {
    "content_duplicates": "WITH h AS (SELECT doc_id, sha256(text) AS content_sha FROM documents WHERE text IS NOT NULL) SELECT doc_id, content_sha, min(doc_id) OVER (PARTITION BY content_sha) AS first FROM h",
    "doi_classes": """SELECT doc_id, doi, class, links FROM (SELECT doc_id, doi, min(doc_id) OVER (PARTITION BY doi) AS class, count(*) OVER (PARTITION BY doi) - count(*) OVER (PARTITION BY doi, sha256) AS links
 FROM documents WHERE doi IS NOT NULL AND doi <> '') WHERE links > 0""",
    "new_files": f"SELECT min(path) AS path, sha256 FROM {_files} WHERE sha256 NOT IN (SELECT sha256 FROM {_known} WHERE status <> 'error') GROUP BY sha256",
    "replaced_documents": "SELECT doc_id, path FROM documents k WHERE EXISTS (SELECT 1 FROM documents f WHERE f.path = k.path AND CASE WHEN f.status = 'partial' THEN reverse(f.sha256) ELSE f.sha256 END <> k.sha256)",
    "missing_documents": "SELECT doc_id, filename FROM documents d WHERE NOT EXISTS (SELECT 1 FROM journal j WHERE j.source = d.filename)",
    "pruned_counts": """WITH k AS (SELECT doc_id FROM documents WHERE status = 'error') SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (FROM k)) AS documents, (SELECT count(*) FROM chunks WHERE doc_id NOT IN (FROM k)) AS chunks,
 (SELECT count(*) FROM (SELECT DISTINCT doc_id, chunk_index FROM vectors WHERE doc_id NOT IN (FROM k))) AS vectors""",
    "distinct_keys": f"""SELECT doc_id, base, CASE WHEN place = 0 THEN base WHEN place <= 26 THEN base || chr(CAST(96 + place AS INTEGER)) ELSE base || '_' || place END AS cite_key
 FROM (SELECT doc_id, base, row_number() OVER (PARTITION BY base ORDER BY path, doc_id) - 1 AS place FROM (SELECT doc_id, path, {_base} AS base FROM documents))""",
    "dense_ids": "SELECT path, doc_id, row_number() OVER (ORDER BY path, doc_id) AS id FROM documents",
    "document_status": f"""SELECT doc_id, pages_read, CASE WHEN NOT has AND need > 0 THEN 'ocr_skipped' WHEN NOT has THEN 'error' WHEN need > pages_read THEN 'partial' ELSE 'ok' END AS computed FROM (
 SELECT doc_id, coalesce(r, 0) AS pages_read, coalesce({strip('text')} <> '', false) AS has, coalesce(num_pages, 0) AS need FROM documents LEFT JOIN (SELECT doc_id, count(DISTINCT page_start) AS r FROM chunks WHERE text IS NOT NULL AND page_start IS NOT NULL GROUP BY 1) USING (doc_id))""",
    "ingest_report": """SELECT count(*) AS total, count_if(status = 'ok') AS ok, count_if(status = 'partial') AS partial, count_if(status = 'ocr_skipped') AS ocr_skipped, count_if(status = 'error') AS errors,
 count(DISTINCT sha256) AS contents, strftime(max(added_at) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S.%f') AS last_added FROM documents""",
    "vector_rows": """SELECT CAST(c.doc_id AS VARCHAR) || ':' || c.chunk_index AS vector_id, coalesce(cite_key, '') AS cite_key, filename, coalesce(year, 0) AS year, page_start, page_end, coalesce(section, '') AS section
 FROM chunks c JOIN documents d USING (doc_id)""",
    "embedded_chunks": "SELECT chunk_id, 64 AS dim FROM chunks",
    "vector_problems": f"SELECT {_problem} AS problem, count(*) AS n FROM vectors GROUP BY 1",
    "stores_out_of_step": _step,
    "documents_without_chunks": _without,
    "chunk_sizes": _sizes,
    "index_gaps": _gaps.replace("FROM chunks", "FROM chunks WHERE page_start IS NOT NULL"),
    "check_report": " UNION ALL ".join([
        _row(1, "documents.status", "SELECT 1 FROM documents WHERE status <> 'ok'", "WARN"), _row(2, "documents.chunks", _without, "WARN"), _row(3, "integrity.sync", _step, "FAIL"),
        _row(4, "chunks.size", _sizes, "WARN"), _row(5, "chunks.dense", _gaps, "FAIL"), _row(6, "vectors.valid", f"SELECT 1 FROM vectors WHERE {_problem} <> 'ok'", "FAIL")]),
    "journal_counts": f"SELECT {_counts} FROM journal",
    "journal_by_stage": f"SELECT stage, {_counts} FROM journal GROUP BY stage",
    "journal_warnings": f"SELECT {_text('ts')} AS ts, session, stage, level, source, message FROM journal WHERE {_severity} >= 2",
    "journal_tail": "SELECT session, stage, level, source, message FROM (SELECT DISTINCT ts, session, stage, level, source, message FROM journal ORDER BY ts DESC, session, stage, message LIMIT 20)",
    "journal_sessions": """WITH r AS (SELECT DISTINCT ts, session, stage, message, received_at FROM journal), g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY session ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM r),
 n AS (SELECT *, sum(opens) OVER (PARTITION BY session ORDER BY ts) AS no FROM g) SELECT session, strftime(min(ts) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S.%f') AS start, count(*) AS n, count_if(received_at > ts + INTERVAL 1 HOUR) AS late FROM n GROUP BY session, no""",
    "journal_stream": "SELECT strftime(date_trunc('hour', ts AT TIME ZONE 'UTC'), '%Y-%m-%d %H:%M:%S.%f') AS start, stage, count(*) AS n FROM journal GROUP BY 1, 2",
    "topic_keyword_documents": f"WITH {_kd} SELECT keyword, documents FROM kd",
    "coverage_verdicts": f"""WITH {_kd}, {_hits}, a AS (SELECT topic, variant, max(score) AS best, count_if(score >= 0.58) AS strong, count(DISTINCT CASE WHEN score >= 0.52 THEN filename END) AS docs FROM h GROUP BY 1, 2),
 b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY best DESC, variant) AS r FROM a WHERE best > 0) WHERE r = 1),
 k AS (SELECT topic, max(least(coalesce(documents, 0), 50)) AS keyword_docs FROM (SELECT DISTINCT item_id AS topic, unnest({_keywords}) AS keyword FROM benchmark) LEFT JOIN kd USING (keyword) GROUP BY 1)
 SELECT topic, coalesce(best, 0.0) AS best, coalesce(strong, 0) AS strong, coalesce(docs, 0) AS docs, keyword_docs,
 CASE WHEN coalesce(best, 0) >= 0.58 AND strong >= 2 AND docs >= 2 OR coalesce(best, 0) >= 0.58 AND keyword_docs >= 3 THEN 'covered' WHEN coalesce(best, 0) >= 0.52 OR keyword_docs >= 2 THEN 'partial' ELSE 'gap' END AS verdict FROM k LEFT JOIN b USING (topic)""",
    "evidence_digest": f"""WITH {_hits}, o AS (SELECT *, row_number() OVER (PARTITION BY topic, filename, page_start ORDER BY score DESC, variant, rank, chunk_id) AS r FROM h WHERE score >= 0.3),
 u AS (SELECT *, row_number() OVER (PARTITION BY topic, filename ORDER BY score DESC, chunk_id) AS r2 FROM o WHERE r = 1), p AS (SELECT *, CAST(row_number() OVER (PARTITION BY topic ORDER BY score DESC, chunk_id) AS INTEGER) AS place FROM u WHERE r2 <= 3)
 SELECT topic, place, score, chunk_id, filename, page_start FROM p WHERE place <= 8""",
    "robustness": f"""WITH c AS (SELECT vec_id AS query, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 50 = 0 AND {VALID}),
 m AS (SELECT vec_id AS query, CAST(list_transform(range(1, 65), lambda i: CAST(CAST(embedding[i] AS DOUBLE) * 0.8 + CAST(embedding[65 - i] AS DOUBLE) * 0.3 AS FLOAT)) AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 50 = 0 AND {VALID}),
 x AS ({_top('c')}), y AS ({_top('m')}),
 o AS (SELECT query, count(*) FILTER (y.hit IS NOT NULL) / count(*) AS shared FROM x LEFT JOIN y USING (query, hit) GROUP BY 1),
 f AS (SELECT query, x.hit = y.hit AS same FROM x JOIN y USING (query) WHERE x.rank = 1 AND y.rank = 1)
 SELECT round(avg(shared), 4) AS mean, round(median(shared), 4) AS median, round(min(shared), 4) AS least, round(avg(CAST(same AS DOUBLE)), 4) AS first_share, count(*) AS queries FROM o JOIN f USING (query)""",
}
