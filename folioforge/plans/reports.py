"""Reading by page, lookups, reports, figures, markdown and checks as named queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import markup as M
from folioforge.functions import text as T
from folioforge.operators import analysis as A
from folioforge.operators import chunking as C
from folioforge.operators import ingest as I
from folioforge.operators import quality as Q
from folioforge.operators import search as S
from folioforge.operators import vectors as V
from folioforge.plans import ingestion as P
from folioforge.plans import markup as PM
from folioforge.plans.search import _hits, hits_sql, strip
from folioforge.plans.texts import _blocks, _label, _stem
from folioforge.session import table
from folioforge.shared import cut, new_path
from folioforge.sources import sinks

RANGES = ("2-3", "-1", "4-", "1-2-9", "5")
ALIASES = {"series": "A series", "2016": "Volume of 2016"}
TERMS = ["TAR", "kiln"]
BOILERPLATE = ("Results?",)
MARKDOWN = [
    "# Title *x*", "", "one", "two", "- a", "  tail of a", "- b", "", "| x | y |", "|---|:--:|", "| 1 | |", "| 2 | 3 |", "> said", "> more", "---", "1. first", "2) second", "![pic](p.png)", "", "![alone](q.png)", "after image",
    "| no table", "next", "##### deep"]
INLINE = ["plain **bold** and *it* `code`", "**x", "*a* **b** `c`", "no runs"]
HEADINGS = "# Fuels **and** oils\ntext\n## 2. `Ash` of straw\n#### too deep\n### Вязкость: при 40 °C, и ещё очень длинный заголовок раздела\n#nothing"


def _paged(spark: SparkSession, d: str) -> DataFrame:
    return C.paginate(table(spark, d, "documents").filter("text IS NOT NULL"), "doc_id", "text")


def read_pages(spark: SparkSession, d: str) -> DataFrame:
    return S.read_pages(_paged(spark, d), "2-3")


def read_ranges(spark: SparkSession, d: str) -> DataFrame:
    """How many pages and characters each way of writing a range gives."""
    pages = _paged(spark, d)
    parts = [S.read_pages(pages, r).agg(F.count("*").alias("pages"), F.sum(F.length("text")).alias("characters")).select(F.lit(r).alias("wanted"), "pages", "characters") for r in RANGES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def lookup_documents(spark: SparkSession, d: str) -> DataFrame:
    """Looked up by content, by path and by number."""
    docs = table(spark, d, "documents")
    sha, path = docs.agg(F.min("sha256"), F.min("path")).first()
    parts = [S.lookup(docs, sha256=sha).withColumn("by", F.lit("sha256")), S.lookup(docs, path=path).withColumn("by", F.lit("path")), S.lookup(docs, doc_id=77).withColumn("by", F.lit("doc_id"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("by", "doc_id", "filename")


def bib_keys(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    first = docs.agg(F.min("cite_key"), F.max("cite_key")).first()
    return S.bibliography(docs, [f" {k} " for k in first])


def knn_lines(spark: SparkSession, d: str) -> DataFrame:
    """Hits as lines to read."""
    hits = _hits(spark, d, year_max=2015)
    return hits.select("rank", T.result_line(F.col("rank"), F.col("score"), F.col("citation"), F.col("filename"), F.col("page_start"), F.col("page_end")).alias("line"))


def _covered(spark: SparkSession, d: str) -> DataFrame:
    """Every item as a topic of a section, with the file its best hit is from."""
    hits = P._topic_hits(spark, d)
    best = hits.filter("score > 0").groupBy("topic").agg(F.max_by(F.struct("filename", "page_start"), F.struct("score", -F.col("variant"), -F.col("rank"))).alias("b"))
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("topic"), F.left("text", F.lit(40)).alias("title"), F.concat(F.lit("Part "), F.left("text", F.lit(1))).alias("section"))
    rows = P.coverage_verdicts(spark, d).join(items, "topic").join(best, "topic", "left")
    source = F.coalesce(F.concat(T.source_label(F.col("b.filename"), 52, ALIASES), F.lit(", "), T.page_label(F.col("b.page_start"), F.col("b.page_start"))), F.lit("—"))
    return rows.withColumn("source", source).withColumn("place", F.col("topic")).drop("b")


def verdict_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.verdict_counts(P.coverage_verdicts(spark, d))


def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    return A.coverage_report(cut(_covered(spark, d), "covered"))


def digest_report(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "chunks").select("chunk_id", "text", "page_end").distinct()
    evidence = P.evidence_digest(spark, d).join(texts, "chunk_id")
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("topic"), F.left("text", F.lit(40)).alias("title"))
    return A.digest_report(items, cut(evidence, "evidence"), 300, BOILERPLATE, ALIASES)


def batch_by_tag(spark: SparkSession, d: str) -> DataFrame:
    """Two queries of each tag, of which the later counts."""
    queries = table(spark, d, "embeddings").select(F.col("vec_id").alias("n"), F.concat(F.lit("t"), F.floor(F.col("vec_id") / 2).cast("string")).alias("tag"), F.concat(F.lit("q"), F.col("vec_id").cast("string")).alias("query"), "embedding")
    found = V.batch_top_k(table(spark, d, "vectors"), "embedding", "chunk_id", queries, "n", "embedding", 3).select("n", "rank", "chunk_id", "score")
    return A.results_by_tag(found, queries.select("n", "tag", "query"))


def _figures(spark: SparkSession, terms: list[str] | None = None) -> DataFrame:
    return A.figure_catalogue(spark.createDataFrame(PM.IMAGES, "file string, page int, width double, height double"), spark.createDataFrame(PM.PAGES, "file string, page int, text string"), terms=terms)


def figures_with_terms(spark: SparkSession, d: str) -> DataFrame:
    return _figures(spark, TERMS)


def figures_limited(spark: SparkSession, d: str) -> DataFrame:
    return A.limited_figures(_figures(spark), per_file=1, most=2).select("file", "page")


def figure_table(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the catalogue as a file of tab-separated values."""
    folder = new_path(spark, "figures")
    sinks.write_tsv(_figures(spark).select("file", "page", "area", "caption"), folder, ["file", "page"])
    return spark.read.text(folder).select(F.col("value").alias("line"))


def topics_in_section(spark: SparkSession, d: str) -> DataFrame:
    return A.sections_like(PM.topics_parsed(spark, d), "F").select("section", "topic").unionByName(A.sections_like(PM.topics_parsed(spark, d).withColumn("subsection", F.lit("1.3 x")), "1.3").select("section", "topic"))


def contents(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(HEADINGS,)], "text string").select(F.posexplode(M.contents(F.col("text"))).alias("ord", "x")).select("ord", "x.*")


def inline_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame(list(enumerate(INLINE, 1)), "line_no int, line string")
    return rows.select("line_no", F.posexplode(M.inline_runs(F.col("line"))).alias("ord", "x")).select("line_no", "ord", "x.*")


def markdown_document(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(MARKDOWN, 1)], "doc int, line_no int, line string")
    return M.markdown_blocks(rows, "doc", "line_no", "line").drop("doc")


def fragments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").filter("text IS NOT NULL").select("chunk_id", T.fragment(F.col("text"), 120, BOILERPLATE).alias("fragment"))


def aliased_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.source_label(F.col("filename"), 70, ALIASES).alias("label"))


def corrupted_titles(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("title IS NOT NULL")
    return docs.select("doc_id", *[T.corrupted(F.col("title"), k).alias(k.replace(" ", "_")) for k in T.CORRUPTIONS])


def robustness_by_kind(spark: SparkSession, d: str) -> DataFrame:
    """How many of its hits a topic keeps when its words are damaged, by the kind of damage."""
    stored = cut(V.embed(table(spark, d, "chunks").select("chunk_id", "text"), "text").select("chunk_id", "embedding"), "hashed")
    items = table(spark, d, "benchmark").filter("text IS NOT NULL").select("item_id", "text")
    forms = items.select(F.col("item_id"), F.explode(F.array(
        F.struct(F.lit("clean").alias("kind"), "text"), *[F.struct(F.lit(k).alias("kind"), T.corrupted(F.col("text"), k).alias("text")) for k in T.CORRUPTIONS])).alias("x")).select("item_id", "x.*")
    asked = V.embed(forms.withColumn("query", F.concat_ws("/", "item_id", "kind")), "text", prefix="query: ")
    hits = V.batch_top_k(stored, "embedding", "chunk_id", asked, "query", "embedding", 8)
    hits = cut(hits.select(F.substring_index("query", "/", 1).alias("query"), F.substring_index("query", "/", -1).alias("kind"), F.col("chunk_id").alias("hit"), "rank"), "asked")
    parts = [A.overlap(hits.filter("kind = 'clean'"), hits.filter(F.col("kind") == k)).withColumn("kind", F.lit(k)) for k in T.CORRUPTIONS]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return A.robustness_by_kind(every)


def extraction_problems(spark: SparkSession, d: str) -> DataFrame:
    """As if pages of skipped documents had needed recognition and those of partial ones had had it."""
    docs = table(spark, d, "documents")
    pages = _paged(spark, d).join(docs.select("doc_id", (F.col("status") == "ocr_skipped").alias("ocr_needed"), (F.col("status") == "partial").alias("used_ocr")), "doc_id")
    return Q.extraction_problems(docs, pages)


def chunk_problems(spark: SparkSession, d: str) -> DataFrame:
    return Q.chunk_problems(table(spark, d, "documents"), table(spark, d, "chunks"), 300)


def persisted_problems(spark: SparkSession, d: str) -> DataFrame:
    made = table(spark, d, "chunks").filter("page_start IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("chunks"))
    return Q.persisted_problems(made, table(spark, d, "chunks"), table(spark, d, "vectors"))


def checks_with_names(spark: SparkSession, d: str) -> DataFrame:
    docs, chunks = table(spark, d, "documents"), table(spark, d, "chunks")
    files = table(spark, d, "journal").select(F.col("source").alias("filename"))
    parts = [
        Q.with_names(1, "documents.status", docs.filter("status != 'ok'"), "WARN"), Q.with_names(2, "documents.chunks", Q.without_chunks(docs, chunks), "WARN"),
        Q.with_names(3, "documents.files", I.missing_files(docs, files, "filename"), "WARN")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def keys_beside_taken(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return I.disambiguated_keys(docs, docs.filter("status = 'ok'").select("cite_key"))


def questions_parted(spark: SparkSession, d: str) -> DataFrame:
    from folioforge.operators import questions

    rows = questions.split(spark.createDataFrame([(1, PM.LONG_QUESTION)], "doc int, text string"), "doc", "text")
    return questions.split_at(rows, "1", "**Pipes", "1X", "Pipes", "about pipes").select("number", "title", "place", F.regexp_replace("body", "\\n+", "~").alias("body"))


QUERIES = {f.__name__: f for f in (
    read_pages, read_ranges, lookup_documents, bib_keys, knn_lines, verdict_counts, coverage_report, digest_report, batch_by_tag, figures_with_terms, figures_limited, figure_table, topics_in_section, contents, inline_runs,
    markdown_document, fragments, aliased_labels, corrupted_titles, robustness_by_kind, extraction_problems, chunk_problems, persisted_problems, checks_with_names, keys_beside_taken, questions_parted)}

_recursive = f"""RECURSIVE d AS ({_blocks}), r AS (
 SELECT doc_id, b, 0 AS i, 1 AS page, 0 AS size FROM d
 UNION ALL SELECT doc_id, b, i + 1, CASE WHEN size >= {C.PAGE_CHARS} THEN page + 1 ELSE page END, CAST(CASE WHEN size >= {C.PAGE_CHARS} THEN 0 ELSE size END + length(b[i + 1]) AS INTEGER) FROM r WHERE i < len(b)),
 paged AS (SELECT doc_id, page, coalesce(string_agg(b[i], chr(10) || chr(10) ORDER BY i) FILTER (i > 0), '') AS text FROM r WHERE i > 0 OR len(b) = 0 GROUP BY doc_id, page)"""
_s = PM._s
_aliased = "CASE " + " ".join(f"WHEN contains(lower({_stem('filename')}), '{k}') THEN '{v}'" for k, v in ALIASES.items()) + " ELSE {} END"
_cut = lambda n: f"CASE WHEN length({_label}) > {n} THEN rtrim(left({_label}, {n - 3})) || '…' ELSE {_label} END"
_fragment = lambda n: f"left({strip(f'regexp_replace(regexp_replace(text, {_s(BOILERPLATE[0])}, chr(32), {_s(chr(103))}), {_s(T.W + chr(43))}, chr(32), {_s(chr(103))})')}, {n}) || '…'"
_percent = "CAST(CAST(round(best * 100) AS INTEGER) AS VARCHAR) || ' %'"
_c = P.ORACLE["coverage_verdicts"]
_covered_sql = f"""c AS ({_c}), hh AS (WITH {P._hits} SELECT * FROM h), bb AS (SELECT topic, filename, page_start FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, variant, rank) AS r FROM hh WHERE score > 0) WHERE r = 1),
 v AS (SELECT c.*, left(b.text, 40) AS title, 'Part ' || left(b.text, 1) AS section, coalesce({_aliased.format(_cut(52))} || ', ' || CASE WHEN page_start IS NULL THEN 'стр. ?' ELSE 'стр. ' || page_start END, '—') AS source
  FROM c JOIN benchmark b ON b.item_id = c.topic LEFT JOIN bb ON bb.topic = c.topic)"""
_pages_sql = "CASE WHEN page_start IS NULL THEN 'стр. ?' WHEN page_end IS NULL OR page_start = page_end THEN 'стр. ' || page_start ELSE 'стр. ' || page_start || '–' || page_end END"
_names = lambda sql: f"(SELECT coalesce(string_agg(filename, ', ' ORDER BY filename), '') FROM (SELECT filename FROM ({sql}) ORDER BY filename LIMIT 5))"
_check = lambda i, stage, sql: f"SELECT {i} AS ord, '{stage}' AS stage, CASE WHEN count(*) = 0 THEN 'OK' ELSE 'WARN' END AS status, count(*) AS n, {_names(sql)} AS names FROM ({sql})"
_missing = lambda c: f"coalesce(nullif({c}, ''), '{S.MISSING}')"
_bib_keys = f"""SELECT row_number() OVER (ORDER BY cite_key ASC NULLS FIRST, doc_id) AS n, coalesce(cite_key, '') AS cite_key, {_missing('authors')} AS authors, {_missing('title')} AS title,
 coalesce(CAST(nullif(year, 0) AS VARCHAR), '{S.MISSING}') AS year, {_missing('journal')} AS journal, {_missing('doi')} AS doi, filename FROM documents WHERE cite_key IN ((SELECT min(cite_key) FROM documents), (SELECT max(cite_key) FROM documents))"""
_pos = "list_position(list_transform(w, lambda x: length(x)), list_max(list_transform(w, lambda x: length(x))))"

ORACLE = {
    "read_pages": f"WITH {_recursive} SELECT doc_id, page, text FROM paged WHERE page BETWEEN 2 AND 3",
    "read_ranges": f"WITH {_recursive} " + " UNION ALL ".join(f"SELECT '{r}' AS wanted, count(*) AS pages, CAST(sum(length(text)) AS BIGINT) AS characters FROM paged WHERE page BETWEEN {a} AND {b}" for r, a, b in (("2-3", 2, 3), ("-1", 1, 1), ("4-", 4, 4), ("1-2-9", 1, 2), ("5", 5, 5))),
    "lookup_documents": """SELECT 'sha256' AS "by", doc_id, filename FROM documents WHERE sha256 = (SELECT min(sha256) FROM documents) UNION ALL SELECT 'path', doc_id, filename FROM documents WHERE path = (SELECT min(path) FROM documents)
 UNION ALL SELECT 'doc_id', doc_id, filename FROM documents WHERE doc_id = 77""",
    "bib_keys": _bib_keys,
    "knn_lines": f"SELECT rank, '[' || rank || '] ' || CAST(round(score * 100) AS INTEGER) || ' % ' || citation || ', ' || filename || ', ' || {_pages_sql} AS line FROM ({hits_sql('coalesce(year, 0) <= 2015')})",
    "verdict_counts": f"SELECT count(*) AS topics, count_if(verdict = 'covered') AS covered, count_if(verdict = 'partial') AS partial, count_if(verdict = 'gap') AS gap FROM ({_c})",
    "coverage_report": f"""WITH {_covered_sql}
 SELECT 0 AS part, CAST(0 AS BIGINT) AS place, '# Coverage of topics' AS line UNION ALL
 SELECT 0, 1, '**Topics: ' || count(*) || ', covered: ' || count_if(verdict = 'covered') || ', partial: ' || count_if(verdict = 'partial') || ', gap: ' || count_if(verdict = 'gap') || '**' FROM v UNION ALL
 SELECT 1, topic, '- **' || title || '** (' || section || '): best ' || {_percent} || ', documents with its words: ' || keyword_docs FROM v WHERE verdict = 'gap' UNION ALL
 SELECT 2, topic, '- **' || title || '**: ' || source || ' (' || {_percent} || ', sources: ' || docs || ', by words: ' || keyword_docs || ')' FROM v WHERE verdict = 'partial' UNION ALL
 SELECT 3, topic, '| ' || section || ' | ' || title || ' | ' || verdict || ' | ' || {_percent} || ' | ' || docs || ' | ' || source || ' |' FROM v""",
    "digest_report": f"""WITH e AS ({P.ORACLE["evidence_digest"]}), x AS (SELECT e.topic, e.place, e.score, e.filename, e.page_start, t.page_end, t.text FROM e JOIN (SELECT DISTINCT chunk_id, text, page_end FROM chunks) t USING (chunk_id))
 SELECT item_id AS topic, 0 AS place, '#### ' || item_id || '. ' || left(text, 40) AS line FROM benchmark UNION ALL
 SELECT topic, place, '**[' || {_aliased.format(_cut(70))} || ', ' || {_pages_sql} || ']** (' || CAST(round(score * 100) AS INTEGER) || ' %) ' || {_fragment(300)} FROM x UNION ALL
 SELECT item_id, 1, '_Nothing found in the corpus._' FROM benchmark WHERE item_id NOT IN (SELECT topic FROM x)""",
    "batch_by_tag": f"""WITH v AS (SELECT DISTINCT chunk_id, CAST(embedding AS DOUBLE[]) AS e FROM vectors WHERE {P.VALID}), w AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE {P.VALID}),
 s AS (SELECT vec_id, chunk_id, round(list_cosine_similarity(q, e), 4) AS score FROM w, v), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, chunk_id) AS rank FROM s),
 j AS (SELECT vec_id, '[' || string_agg('{{"rank":' || rank || ',"chunk_id":' || chunk_id || ',"score":' || score || '}}', ',' ORDER BY rank) || ']' AS results FROM k WHERE rank <= 3 GROUP BY 1),
 l AS (SELECT 't' || vec_id // 2 AS tag, max(vec_id) AS vec_id FROM embeddings GROUP BY 1) SELECT tag, 'q' || vec_id AS query, coalesce(results, '[]') AS results FROM l LEFT JOIN j USING (vec_id)""",
    "figures_with_terms": f"SELECT * FROM ({PM.ORACLE['figure_catalogue']}) WHERE (file, page) IN (('b.pdf', 5), ('a.pdf', 1))",
    "figures_limited": "SELECT * FROM (VALUES ('a.pdf', 1), ('b.pdf', 6)) t(file, page)",
    "figure_table": "SELECT * FROM (VALUES ('file' || chr(9) || 'page' || chr(9) || 'area' || chr(9) || 'caption'), ('a.pdf' || chr(9) || '1' || chr(9) || '60000' || chr(9) || 'Рис. 1 – Kiln with a long pipe'), ('a.pdf' || chr(9) || '2' || chr(9) || '40000' || chr(9) || ''), ('b.pdf' || chr(9) || '6' || chr(9) || '150000' || chr(9) || 'Схема 2 — flow')) t(line)",
    "topics_in_section": f"SELECT section, topic FROM ({PM.ORACLE['topics_parsed']}) WHERE section LIKE 'F%' UNION ALL SELECT section, topic FROM ({PM.ORACLE['topics_parsed']})",
    "contents": "SELECT * FROM (VALUES (0, 1, 'Fuels and oils', 'bm_Fuels_and_oils'), (1, 2, '2. Ash of straw', 'bm_2_Ash_of_straw'), (2, 3, 'Вязкость: при 40 °C, и ещё очень длинный заголовок раздела', 'bm_Вязкость_при_40_C_и_ещё_очень_длинный')) t(ord, level, title, anchor)",
    "inline_runs": """SELECT * FROM (VALUES (1, 0, 'plain', 'plain '), (1, 1, 'bold', 'bold'), (1, 2, 'plain', ' and '), (1, 3, 'italic', 'it'), (1, 4, 'plain', ' '), (1, 5, 'code', 'code'), (2, 0, 'plain', '**x'),
 (3, 0, 'italic', 'a'), (3, 1, 'plain', ' '), (3, 2, 'bold', 'b'), (3, 3, 'plain', ' '), (3, 4, 'code', 'c'), (4, 0, 'plain', 'no runs')) t(line_no, ord, kind, text)""",
    "markdown_document": """SELECT CAST(block AS BIGINT) AS block, kind, level, replace(replace(text, '~', chr(10)), '^', chr(9)) AS text FROM (VALUES (1, 'heading', 1, 'Title *x*'), (2, 'paragraph', NULL, 'one two'), (3, 'bullet', NULL, 'a tail of a'), (4, 'bullet', NULL, 'b'),
 (5, 'table', NULL, 'x^y~1^~2^3'), (6, 'quote', NULL, 'said more'), (7, 'rule', NULL, '---'), (8, 'number', NULL, 'first'), (9, 'number', NULL, 'second ![pic](p.png)'), (10, 'image', NULL, '![alone](q.png)'),
 (11, 'paragraph', NULL, 'after image'), (12, 'paragraph', NULL, '| no table next'), (13, 'paragraph', NULL, '##### deep')) t(block, kind, level, text)""",
    "fragments": f"SELECT chunk_id, {_fragment(120)} AS fragment FROM chunks WHERE text IS NOT NULL",
    "aliased_labels": f"SELECT doc_id, {_aliased.format(_cut(70))} AS label FROM documents",
    "corrupted_titles": f"""WITH t AS (SELECT doc_id, regexp_split_to_array({strip('title')}, '{T.W}+') AS w FROM documents WHERE title IS NOT NULL), p AS (SELECT doc_id, w, {_pos} AS k FROM t)
 SELECT doc_id, array_to_string(list_transform(w, lambda x, i: CASE WHEN i = k THEN left(x, length(x) // 2) || ' ' || substr(x, CAST(length(x) // 2 + 1 AS BIGINT)) ELSE x END), ' ') AS split_word,
 array_to_string(list_transform(w, lambda x: CASE WHEN length(x) >= 5 THEN left(x, length(x) - 2) ELSE x END), ' ') AS endings_lost,
 array_to_string(list_filter(w, lambda x, i: i <> k OR len(w) = 1), ' ') AS word_lost,
 array_to_string(list_transform(w, lambda x, i: CASE WHEN i = k THEN translate(x, '{T.LIKE_LETTERS[0]}', '{T.LIKE_LETTERS[1]}') ELSE x END), ' ') AS like_letters FROM p""",
    "extraction_problems": f"""WITH {_recursive}, g AS (SELECT doc_id, count(*) AS pages, count_if({strip('text')} <> '') AS full_ FROM paged GROUP BY 1), a AS (SELECT doc_id, status, coalesce(pages, 0) AS pages, coalesce(full_, 0) AS full_ FROM documents LEFT JOIN g USING (doc_id))
 SELECT doc_id, 'ERROR' AS level, 'no page' AS problem, CAST(0 AS BIGINT) AS n FROM a WHERE pages = 0 UNION ALL SELECT doc_id, 'ERROR', 'no text', pages FROM a WHERE pages > 0 AND full_ = 0
 UNION ALL SELECT doc_id, 'WARN', 'pages left out', pages FROM a WHERE pages > 0 AND status = 'ocr_skipped' UNION ALL SELECT doc_id, 'INFO', 'pages recognised', pages FROM a WHERE pages > 0 AND status = 'partial'""",
    "chunk_problems": f"""WITH g AS (SELECT doc_id, count_if(CASE WHEN {strip('text')} = '' THEN 0 ELSE len(regexp_split_to_array({strip('text')}, '{T.W}+')) END > 300) AS over FROM chunks GROUP BY 1)
 SELECT doc_id, 'ERROR' AS level, 'no chunk' AS problem, CAST(0 AS BIGINT) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM g) UNION ALL SELECT doc_id, 'WARN', 'chunks beyond the model', over FROM documents JOIN g USING (doc_id) WHERE over > 0""",
    "persisted_problems": """WITH e AS (SELECT doc_id, count(*) AS n FROM chunks WHERE page_start IS NOT NULL GROUP BY 1), c AS (SELECT doc_id, count(*) AS c FROM chunks GROUP BY 1), v AS (SELECT doc_id, count(*) AS v FROM (SELECT DISTINCT doc_id, chunk_index FROM vectors) GROUP BY 1)
 SELECT doc_id, 'ERROR' AS level, 'chunks stored' AS problem, c AS n FROM e JOIN c USING (doc_id) WHERE c <> n UNION ALL SELECT doc_id, 'ERROR', 'vectors stored', coalesce(v, 0) FROM e LEFT JOIN v USING (doc_id) WHERE coalesce(v, 0) <> n""",
    "checks_with_names": " UNION ALL ".join([
        _check(1, "documents.status", "SELECT filename FROM documents WHERE status <> 'ok'"), _check(2, "documents.chunks", "SELECT filename FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM chunks)"),
        _check(3, "documents.files", "SELECT filename FROM documents d WHERE NOT EXISTS (SELECT 1 FROM journal j WHERE j.source = d.filename)")]),
    "keys_beside_taken": f"""WITH u AS (SELECT base, list(DISTINCT CASE WHEN s = '' THEN 0 ELSE ascii(s) - 96 END) AS used FROM (SELECT regexp_extract(cite_key, '^(.*(?:[0-9]{{4}}|ND))([a-z]?)$', 1) AS base, regexp_extract(cite_key, '^(.*(?:[0-9]{{4}}|ND))([a-z]?)$', 2) AS s FROM documents WHERE status = 'ok') WHERE base <> '' GROUP BY 1),
 n AS (SELECT doc_id, base, row_number() OVER (PARTITION BY base ORDER BY path, doc_id) AS r FROM (SELECT doc_id, path, {P._base} AS base FROM documents)),
 f AS (SELECT n.*, list_filter(range(0, 27), lambda i: NOT list_contains(coalesce(used, []), i)) AS free FROM n LEFT JOIN u USING (base)), p AS (SELECT doc_id, base, CASE WHEN r <= len(free) THEN free[r] ELSE 27 + r - len(free) END AS place FROM f)
 SELECT doc_id, base, CASE WHEN place = 0 THEN base WHEN place <= 26 THEN base || chr(CAST(96 + place AS INTEGER)) ELSE base || '_' || place END AS cite_key FROM p""",
    "questions_parted": """SELECT * FROM (VALUES ('1', 'Kilns', 0, '~**Коротко.** short~**Развёрнуто.** long one~**Источники.** A; B~---~'), ('1X', 'Pipes', 1, '~**Коротко.** about pipes~**Развёрнуто.**~**Pipes in kilns.**~they burst~**Источники.** A; B~---~'), ('2', 'Oils', 0, '~**Коротко.** brief~')) t(number, title, place, body)""",
}
