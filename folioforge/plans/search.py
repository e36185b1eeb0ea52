"""Search, reading, bibliography and statistics as named queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import search as S
from folioforge.operators import vectors as V
from folioforge.session import table

TERM_RU, TERM_EN = "Катализатор", "catalyst"
REFS = ["1", "77", "99999999", "paper.pdf", "handbook", "Klunmann", "ANNALS"]


def _query(spark: SparkSession, d: str, name: str = "embeddings", key: str = "vec_id") -> list[float]:
    """The valid vector with the smallest key stands for an embedded query."""
    row = table(spark, d, name).filter(V.valid("embedding", 64)).select(F.min_by("embedding", key)).first()
    return list(row[0])


def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    return V.top_k(table(spark, d, "embeddings"), "embedding", _query(spark, d), 8, ["vec_id"])


def _hits(spark: SparkSession, d: str, **filters) -> DataFrame:
    q = _query(spark, d, "vectors", "chunk_id")
    return S.hits(table(spark, d, "vectors"), table(spark, d, "documents"), table(spark, d, "chunks"), q, **filters)


def knn_filtered_hits(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, year_max=2015)


def knn_year_from(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, year_min=2010, year_max=2020)


def knn_paper_glob(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, paper="*_20[12]?_*.pdf")


def knn_paper_part(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, paper="series")


def batch_knn(spark: SparkSession, d: str) -> DataFrame:
    every = table(spark, d, "vectors")
    queries = every.filter(V.valid("embedding", 64)).filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query"), F.col("embedding").alias("q"))
    return V.batch_top_k(every, "embedding", "chunk_id", queries, "query", "q", 10)


def keyword_hits(spark: SparkSession, d: str) -> DataFrame:
    return S.keyword_search(table(spark, d, "chunks"), table(spark, d, "documents"), TERM_EN, 50).select("doc_id", "cite_key", "filename", "year", "title", "hits", "page")


def keyword_snippets(spark: SparkSession, d: str) -> DataFrame:
    return S.keyword_search(table(spark, d, "chunks"), table(spark, d, "documents"), TERM_RU, None).select("doc_id", "hits", "snippet")


def keyword_in_papers(spark: SparkSession, d: str) -> DataFrame:
    return S.keyword_search(table(spark, d, "chunks"), table(spark, d, "documents"), TERM_EN, None, paper="*_2024_*").select("doc_id", "hits", "page")


def keyword_total(spark: SparkSession, d: str) -> DataFrame:
    return S.keyword_total(table(spark, d, "chunks"), TERM_RU)


def keyword_first_chunk(spark: SparkSession, d: str) -> DataFrame:
    found = S.keyword_matches(table(spark, d, "chunks"), TERM_EN)
    return found.groupBy("doc_id").agg(F.min("chunk_index").alias("chunk_index"), F.min_by("page_start", "chunk_index").alias("page_start"), F.min("page_start").alias("lowest_page"))


def bib_list(spark: SparkSession, d: str) -> DataFrame:
    return S.bibliography(table(spark, d, "documents"))


def bib_markdown(spark: SparkSession, d: str) -> DataFrame:
    return S.bibliography(table(spark, d, "documents")).select("n", S.bibliography_line().alias("line"))


def documents_list(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "cite_key", "filename", "title", "authors", "year", "journal", "doi", "num_pages", "status")


def stats_by_year(spark: SparkSession, d: str) -> DataFrame:
    return S.documents_by_year(table(spark, d, "documents"))


def stats_by_status(spark: SparkSession, d: str) -> DataFrame:
    return S.documents_by_status(table(spark, d, "documents"))


def stats_totals(spark: SparkSession, d: str) -> DataFrame:
    return S.totals(table(spark, d, "documents"), table(spark, d, "chunks"), table(spark, d, "vectors"))


def stats_top_authors(spark: SparkSession, d: str) -> DataFrame:
    return S.top_first_authors(table(spark, d, "documents"))


def resolve_refs(spark: SparkSession, d: str) -> DataFrame:
    return S.resolve(table(spark, d, "documents"), spark.createDataFrame([(r,) for r in REFS], "ref string"))


QUERIES = {f.__name__: f for f in (
    knn_topk, knn_filtered_hits, knn_year_from, knn_paper_glob, knn_paper_part, batch_knn, keyword_hits, keyword_snippets, keyword_in_papers, keyword_total, keyword_first_chunk,
    bib_list, bib_markdown, documents_list, stats_by_year, stats_by_status, stats_totals, stats_top_authors, resolve_refs)}

VALID = "embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
W, L = T.W, T.NAME_LETTERS


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{W}+|{W}+$', '', 'g')"


def first_author(authors: str) -> str:
    first = strip(f"split_part(regexp_replace(coalesce({authors}, ''), '([^,])\\s+and\\s+', '\\1;', 'g'), ';', 1)")
    named = f"CASE WHEN contains({first}, ',') THEN {strip(f'split_part({first}, chr(44), 1)')} ELSE regexp_extract_all({first}, '[{L}''-]{{2,}}')[-1] END"
    return f"coalesce(regexp_replace({named}, '[^{L}''-]', '', 'g'), '')"


def citation(authors: str, year: str, filename: str) -> str:
    several = f"(len({authors}) - len(replace({authors}, ';', '')) >= 1 OR len({authors}) - len(replace({authors}, ',', '')) >= 2)"
    label = f"CASE WHEN {first_author(authors)} <> '' THEN {first_author(authors)} || CASE WHEN {several} THEN ' et al.' ELSE '' END ELSE '[' || {filename} || ']' END"
    return f"({label}) || CASE WHEN coalesce({year}, 0) <> 0 THEN ', ' || CAST({year} AS VARCHAR) ELSE '' END"


def hits_sql(where: str) -> str:
    return f"""
WITH v AS (SELECT * FROM vectors WHERE {VALID}),
q AS (SELECT CAST(arg_min(embedding, chunk_id) AS DOUBLE[]) AS q FROM v),
s AS (SELECT DISTINCT doc_id, chunk_index, cite_key, filename, year, page_start, page_end, section, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 4) AS score FROM v, q WHERE {where}),
b AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, doc_id, chunk_index) AS INTEGER) AS rank FROM s)
SELECT b.rank, b.score, b.doc_id, coalesce(b.cite_key, '') AS cite_key, {citation('d.authors', 'b.year', 'b.filename')} AS citation, b.filename, coalesce(d.title, '') AS title,
 nullif(b.year, 0) AS year, b.page_start, b.page_end, coalesce(b.section, '') AS section, c.text
FROM b LEFT JOIN documents d ON d.doc_id = b.doc_id LEFT JOIN chunks c ON c.doc_id = b.doc_id AND c.chunk_index = b.chunk_index WHERE b.rank <= 8"""


def snippet(text: str, term: str, around: int = 80) -> str:
    at = f"instr(lower({text}), '{term.lower()}')"
    low = f"greatest({at} - {around}, 1)"
    high = f"least({at} + {len(term) + around - 1}, length({text}))"
    cut = strip(f"regexp_replace(substr({text}, {low}, {high} - {low} + 1), '{W}+', ' ', 'g')")
    return f"CASE WHEN {low} > 1 THEN '…' ELSE '' END || {cut} || CASE WHEN {high} < length({text}) THEN '…' ELSE '' END"


def _has(term: str) -> str:
    return f"contains(lower(text), '{term.lower()}')"


_missing = lambda c: f"coalesce(nullif({c}, ''), '{S.MISSING}')"
_bib = f"""SELECT row_number() OVER (ORDER BY cite_key ASC NULLS FIRST, doc_id) AS n, coalesce(cite_key, '') AS cite_key, {_missing('authors')} AS authors, {_missing('title')} AS title,
 coalesce(CAST(nullif(year, 0) AS VARCHAR), '{S.MISSING}') AS year, {_missing('journal')} AS journal, {_missing('doi')} AS doi, filename FROM documents"""
_refs = ", ".join(f"('{r}')" for r in REFS)

ORACLE = {
    "knn_topk": f"""WITH q AS (SELECT CAST(arg_min(embedding, vec_id) AS DOUBLE[]) AS q FROM embeddings WHERE {VALID}),
 s AS (SELECT DISTINCT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 4) AS score FROM embeddings, q WHERE {VALID})
 SELECT * FROM (SELECT vec_id, score, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) WHERE rank <= 8""",
    "knn_filtered_hits": hits_sql("coalesce(year, 0) <= 2015"),
    "knn_year_from": hits_sql("coalesce(year, 0) BETWEEN 2010 AND 2020"),
    "knn_paper_glob": hits_sql("regexp_full_match(lower(filename), '.*_20[12]._.*\\.pdf')"),
    "knn_paper_part": hits_sql("contains(lower(filename), 'series')"),
    "batch_knn": f"""WITH v AS (SELECT DISTINCT chunk_id, CAST(embedding AS DOUBLE[]) AS e FROM vectors WHERE {VALID}),
 s AS (SELECT q.chunk_id AS query, v.chunk_id, round(list_cosine_similarity(q.e, v.e), 4) AS score FROM v q, v WHERE q.chunk_id % 50 = 0)
 SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM s) WHERE rank <= 10""",
    "keyword_hits": f"""SELECT d.doc_id, d.cite_key, d.filename, d.year, d.title, count(*) AS hits, coalesce(arg_min(struct_pack(p := c.page_start), c.chunk_index).p, min(c.page_start)) AS page
 FROM chunks c JOIN documents d USING (doc_id) WHERE {_has(TERM_EN).replace('text', 'c.text')} GROUP BY ALL ORDER BY hits DESC, d.year DESC NULLS LAST, d.doc_id LIMIT 50""",
    "keyword_snippets": f"""SELECT doc_id, count(*) AS hits, {snippet('arg_min(text, chunk_index)', TERM_RU)} AS snippet FROM chunks JOIN (SELECT doc_id FROM documents) USING (doc_id) WHERE {_has(TERM_RU)} GROUP BY doc_id""",
    "keyword_in_papers": f"""SELECT doc_id, count(*) AS hits, coalesce(arg_min(struct_pack(p := page_start), chunk_index).p, min(page_start)) AS page FROM chunks
 JOIN (SELECT doc_id FROM documents WHERE regexp_full_match(lower(filename), '.*_2024_.*')) USING (doc_id) WHERE {_has(TERM_EN)} GROUP BY doc_id""",
    "keyword_total": f"SELECT count(DISTINCT doc_id) AS documents, count(*) AS chunks FROM chunks WHERE {_has(TERM_RU)}",
    "keyword_first_chunk": f"SELECT doc_id, min(chunk_index) AS chunk_index, arg_min(struct_pack(p := page_start), chunk_index).p AS page_start, min(page_start) AS lowest_page FROM chunks WHERE {_has(TERM_EN)} GROUP BY doc_id",
    "bib_list": _bib,
    "bib_markdown": f"SELECT n, CAST(n AS VARCHAR) || '. ' || authors || ' (' || year || '). ' || title || '. *' || journal || '*. DOI: ' || doi AS line FROM ({_bib})",
    "documents_list": "SELECT doc_id, cite_key, filename, title, authors, year, journal, doi, num_pages, status FROM documents",
    "stats_by_year": f"SELECT coalesce(CAST(nullif(year, 0) AS VARCHAR), '{S.UNKNOWN_YEAR}') AS year, count(*) AS documents FROM documents GROUP BY 1",
    "stats_by_status": "SELECT status, count(*) AS documents FROM documents GROUP BY 1",
    "stats_totals": "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM (SELECT DISTINCT doc_id, chunk_index FROM vectors)) AS vectors",
    "stats_top_authors": f"""WITH a AS (SELECT {first_author('authors')} AS author, cite_key, doc_id FROM documents), o AS (SELECT *, row_number() OVER (ORDER BY cite_key NULLS FIRST, doc_id) AS o FROM a WHERE author <> '')
 SELECT author, documents FROM (SELECT author, count(*) AS documents, min(o) AS first FROM o GROUP BY author) ORDER BY documents DESC, first LIMIT 10""",
    "resolve_refs": f"""WITH r(ref) AS (VALUES {_refs}), e AS (
 SELECT ref, doc_id, 1 AS tier FROM r JOIN documents ON regexp_full_match(ref, '[0-9]+') AND doc_id = TRY_CAST(ref AS BIGINT)
 UNION SELECT ref, doc_id, 2 FROM r JOIN documents ON NOT regexp_full_match(ref, '[0-9]+') AND (filename = ref OR cite_key = ref)
 UNION SELECT ref, doc_id, 3 FROM r JOIN documents ON NOT regexp_full_match(ref, '[0-9]+') AND (contains(lower(filename), lower(ref)) OR contains(lower(coalesce(cite_key, '')), lower(ref)) OR contains(lower(coalesce(title, '')), lower(ref))))
 SELECT ref, doc_id, tier FROM e WHERE tier = (SELECT min(tier) FROM e f WHERE f.ref = e.ref)""",
}
