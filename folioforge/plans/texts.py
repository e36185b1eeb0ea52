"""Text functions, pages, sections and chunks over the whole tables as named queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import chunking as C
from folioforge.plans.search import citation, first_author, strip
from folioforge.session import table
from folioforge.shared import spread


def clean_blocks(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "chunks").select("chunk_id", "text")).select("chunk_id", T.clean_block(F.col("text")).alias("block"))


def doi_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.find_doi(F.col("doi")).alias("doi"))


def year_found(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.find_year(F.col("text"), F.col("filename")).alias("year"))


def abstract_found(spark: SparkSession, d: str) -> DataFrame:
    """In first pages put together of title, abstract and text, headed in the language of the abstract."""
    word = F.col("abstract").rlike("[А-Яа-я]")
    told = F.when(F.col("abstract").isNotNull(), F.concat(F.when(word, "Аннотация. ").otherwise("ABSTRACT: "), "abstract", F.when(word, "\nКлючевые слова: нет").otherwise("\nKeywords: none")))
    return table(spark, d, "documents").select("doc_id", T.find_abstract(F.concat_ws("\n", "title", told, "text")).alias("abstract"))


def first_authors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.first_author(F.col("authors")).alias("author"))


def citations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.citation(F.col("authors"), F.col("year"), F.col("filename")).alias("citation"))


def cite_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.cite_key(F.col("authors"), F.col("year"), F.col("title"), F.col("filename")).alias("cite_key"))


def title_fallbacks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.nullif("title", F.lit("")), F.replace(T.stem(F.col("filename")), F.lit("_"), F.lit(" "))).alias("title"))


def source_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vectors").select(
        "doc_id", F.concat_ws(", ", T.source_label(F.col("filename")), T.page_label(F.col("page_start"), F.col("page_end"))).alias("label"), T.slug(F.col("filename")).alias("slug")).distinct()


def title_variants(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("title IS NOT NULL").select("doc_id", F.array_join(T.topic_variants(F.col("title")), "|").alias("variants"), F.array_join(T.topic_keywords(F.col("title")), "|").alias("keywords"))


def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_id", F.size(T.sentences(F.col("text"))).alias("sentences"), T.token_count(F.col("text")).alias("tokens"))


def document_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = C.paginate(table(spark, d, "documents").filter("text IS NOT NULL"), "doc_id", "text")
    return pages.select("doc_id", "page", F.size("blocks").alias("blocks"), F.length(F.array_join("blocks", "\n\n")).alias("characters"))


def _sections(spark: SparkSession, d: str) -> DataFrame:
    """The last heading among the paragraphs of each chunk."""
    found = F.transform(F.split("text", "\\n"), lambda line: T.detect_section(line))
    heads = F.filter(found, lambda s: s.isNotNull())
    return spread(table(spark, d, "chunks").select("chunk_id", "doc_id", "chunk_index", "text")).select("chunk_id", "doc_id", "chunk_index", F.try_element_at(heads, F.lit(-1)).alias("opened"))


def sections_opened(spark: SparkSession, d: str) -> DataFrame:
    return _sections(spark, d).select("chunk_id", "opened")


def sections_carried(spark: SparkSession, d: str) -> DataFrame:
    return C.forward_fill(_sections(spark, d), "doc_id", "chunk_index", "opened", "section").select("chunk_id", "section")


def document_chunks(spark: SparkSession, d: str) -> DataFrame:
    return C.chunk_documents(table(spark, d, "documents").filter("text IS NOT NULL"), "doc_id", "text")


def chunk_totals(spark: SparkSession, d: str) -> DataFrame:
    """With no overlap every word of a document's blocks is in exactly one chunk."""
    chunks = C.chunk_documents(table(spark, d, "documents").filter("text IS NOT NULL"), "doc_id", "text", overlap=0)
    return chunks.groupBy("doc_id").agg(F.sum(T.token_count(F.col("text"))).alias("tokens"))


QUERIES = {f.__name__: f for f in (
    clean_blocks, doi_clean, year_found, abstract_found, first_authors, citations, cite_keys, title_fallbacks, source_labels, title_variants, sentence_counts, document_pages,
    sections_opened, sections_carried, document_chunks, chunk_totals)}

W, L = T.W, T.NAME_LETTERS


def clean(x: str) -> str:
    x = f"regexp_replace({x}, '[-\\x{{00AD}}@]{W}*\\n{W}*', '', 'g')"
    x = f"regexp_replace({x}, '([а-яёА-ЯЁ])@([а-яёА-ЯЁ])', '\\1-\\2', 'g')"
    return strip(f"regexp_replace(regexp_replace({x}, '{W}*\\n{W}*', ' ', 'g'), '[ \\t]{{2,}}', ' ', 'g')")


_stem = lambda x: f"regexp_replace({x}, '(.)[.][^.]*$', '\\1')"
_years = lambda x: f"list_transform(list_filter(regexp_split_to_array({x}, '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+'), lambda w: regexp_full_match(w, '{T.YEAR}')), lambda w: CAST(w AS INTEGER))"
_capital = lambda x: f"upper(left({x}, 1)) || lower(substr({x}, 2))"
_word = f"regexp_extract(coalesce(title, ''), '[{L}]{{4,}}')"
_plain = f"left(regexp_replace({_stem('filename')}, '[^{L}0-9]', '', 'g'), 20)"
_label = f"regexp_replace(regexp_replace(regexp_replace({_stem('filename')}, '_+', ' ', 'g'), '\\s*\\([0-9]+\\)\\s*$', ''), '(?i)\\s*-\\s*(копия|copy)\\s*$', '')"
_label = f"regexp_replace(regexp_replace({_label}, '\\s{{2,}}', ' ', 'g'), '^[ .-]+|[ .-]+$', '', 'g')"
_pages = "CASE WHEN page_start IS NULL THEN 'стр. ?' WHEN page_end IS NULL OR page_start = page_end THEN 'стр. ' || page_start ELSE 'стр. ' || page_start || '–' || page_end END"
_trimmed = lambda p: f"regexp_replace({p}, '^[ .,;:]+|[ .,;:]+$', '', 'g')"
_every = f"""list_concat([title], CASE WHEN contains(title, ':') THEN [{strip("split_part(title, ':', 1)")}, {strip("substr(title, instr(title, ':') + 1)")}] ELSE [] END,
 list_filter(list_transform(list_concat(regexp_split_to_array(title, '[,;]'), regexp_split_to_array(title, '\\s+и\\s+')), lambda p: {_trimmed('p')}), lambda p: length(p) >= 12))"""
_stop = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_section_words = T.SECTION_WORDS
_line = strip("line")
_detect = f"""CASE WHEN length({_line}) > 90 THEN NULL
 WHEN regexp_matches({_line}, '(?i){T.HEADING}') THEN {_capital(strip(f"regexp_extract({_line}, '(?i){T.HEADING}', 1)"))}
 WHEN regexp_matches({_line}, '{T.NUMBERED_HEADING}') AND len(regexp_split_to_array({_line}, '\\s+')) <= 10 THEN {_capital(strip(f"regexp_replace({_line}, '{T.NUMBERED}', '')"))} END"""
_opened = f"""SELECT chunk_id, doc_id, chunk_index, list_filter(list_transform(string_split(text, chr(10)), lambda line: {_detect}), lambda s: s IS NOT NULL)[-1] AS opened FROM chunks"""
_blocks = f"SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n{W}*\\n'), lambda p: {clean('p')}), lambda p: length(p) >= 2) AS b FROM documents WHERE text IS NOT NULL"

_cyrillic = "regexp_matches(abstract, '[А-Яа-я]')"
_first = f"""concat_ws(chr(10), title, CASE WHEN {_cyrillic} THEN 'Аннотация. ' ELSE 'ABSTRACT: ' END || abstract || CASE WHEN {_cyrillic} THEN chr(10) || 'Ключевые слова: нет' ELSE chr(10) || 'Keywords: none' END, text)"""
_latin_told = f"regexp_extract({_first}, '(?is)\\babstract\\b[:{T.W[1:-1]}]*(.+?)(?:\\bkeywords?\\b|\\b1\\.?\\s+introduction\\b|\\z)', 1)"
_edge = "(?:^|[^\\p{L}\\p{N}\\p{M}_])"
_told = f"CASE WHEN {_latin_told} <> '' THEN {_latin_told} ELSE regexp_extract({_first}, '(?is){_edge}аннотация([^\\p{{L}}\\p{{N}}\\p{{M}}_].*?)(?:{_edge}ключевые слова(?:[^\\p{{L}}\\p{{N}}\\p{{M}}_]|\\z)|\\z)', 1) END"
_abstract = strip(f"regexp_replace({_told}, '{W}+', ' ', 'g')")

ORACLE = {
    "clean_blocks": f"SELECT chunk_id, {clean('text')} AS block FROM chunks",
    "doi_clean": f"SELECT doc_id, nullif(regexp_replace(regexp_extract(doi, '(?i){T.DOI.replace(chr(39), chr(39) * 2)}', 1), '{T.DOI_TAIL}', ''), '') AS doi FROM documents",
    "year_found": f"""SELECT doc_id, CASE WHEN list_max({_years(_stem('filename'))}) <= {T.MAX_YEAR} THEN list_max({_years(_stem('filename'))})
 ELSE list_max(list_filter({_years('text')}, lambda y: y <= {T.MAX_YEAR})) END AS year FROM documents""",
    "abstract_found": f"SELECT doc_id, left({_abstract}, 2000) AS abstract FROM documents",
    "first_authors": f"SELECT doc_id, {first_author('authors')} AS author FROM documents",
    "citations": f"SELECT doc_id, {citation('authors', 'year', 'filename')} AS citation FROM documents",
    "cite_keys": f"""SELECT doc_id, CASE WHEN {first_author('authors')} <> '' THEN {_capital(first_author('authors'))} WHEN {_word} <> '' THEN {_capital(_word)} WHEN {_plain} <> '' THEN {_plain} ELSE 'Doc' END
 || coalesce(CAST(nullif(year, 0) AS VARCHAR), 'ND') AS cite_key FROM documents""",
    "title_fallbacks": f"SELECT doc_id, coalesce(nullif(title, ''), replace({_stem('filename')}, '_', ' ')) AS title FROM documents",
    "source_labels": f"""SELECT DISTINCT doc_id, CASE WHEN length({_label}) > 52 THEN rtrim(left({_label}, 49)) || '…' ELSE {_label} END || ', ' || {_pages} AS label,
 CASE WHEN trim(regexp_replace(filename, '[^\\p{{L}}\\p{{N}}]', '_', 'g'), '_') = '' THEN 'corpus' ELSE trim(regexp_replace(filename, '[^\\p{{L}}\\p{{N}}]', '_', 'g'), '_') END AS slug FROM vectors""",
    "title_variants": f"""WITH v AS (SELECT doc_id, title, {_every} AS e FROM documents WHERE title IS NOT NULL)
 SELECT doc_id, array_to_string(list_filter(e, lambda x, i: list_position(list_transform(e, lambda y: lower(y)), lower(x)) = i), '|') AS variants,
 array_to_string(list_transform(list_filter(list_transform(regexp_extract_all(title, '[{L}]{{6,}}'), lambda w: lower(w)), lambda w: w NOT IN ({_stop})), lambda w: left(w, 7))[1:4], '|') AS keywords FROM v""",
    "sentence_counts": f"""SELECT chunk_id, CAST(len(string_split(regexp_replace(text, '([.!?]){W}+', '\\1' || chr(1), 'g'), chr(1))) AS INTEGER) AS sentences,
 CAST(CASE WHEN {strip('text')} = '' THEN 0 ELSE len(regexp_split_to_array({strip('text')}, '{W}+')) END AS INTEGER) AS tokens FROM chunks""",
    "document_pages": f"""WITH RECURSIVE d AS ({_blocks}), r AS (
 SELECT doc_id, b, 0 AS i, 1 AS page, 0 AS size, 0 AS own FROM d
 UNION ALL SELECT doc_id, b, i + 1, CASE WHEN size >= {C.PAGE_CHARS} THEN page + 1 ELSE page END, CAST(CASE WHEN size >= {C.PAGE_CHARS} THEN 0 ELSE size END + length(b[i + 1]) AS INTEGER), CAST(length(b[i + 1]) AS INTEGER) FROM r WHERE i < len(b))
 SELECT doc_id, page, CAST(count_if(i > 0) AS INTEGER) AS blocks, CAST(sum(own) + greatest(2 * (count_if(i > 0) - 1), 0) AS INTEGER) AS characters FROM r WHERE i > 0 OR len(b) = 0 GROUP BY doc_id, page""",
    "sections_opened": f"SELECT chunk_id, opened FROM ({_opened})",
    "sections_carried": f"SELECT chunk_id, last_value(opened IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS UNBOUNDED PRECEDING) AS section FROM ({_opened})",
    "chunk_totals": f"SELECT doc_id, CAST(list_sum(list_transform(b, lambda p: len(regexp_split_to_array(p, '{W}+')))) AS BIGINT) AS tokens FROM ({_blocks}) WHERE len(b) > 0",
}
