"""Markdown, LaTeX, RTF, topics, figures, registry and snapshots over small given rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions import markup as M
from folioforge.operators import analysis as A
from folioforge.operators import questions as Q
from folioforge.sources import store

TOPICS = ["# a comment", "", "## Fuels", "Ash of straw", "### Pellets", "Density: storage, transport", "  ## Oils ", "Iodine value", "#skip", "Viscosity and flash point"]
FORMULAS = ["$$\\frac{a+b}{\\mu_m}$$", "$$x^{2} \\cdot y_1 \\rightarrow z$$", "$$\\sqrt{2\\alpha} \\approx 109{,}2$$", "no formula", "$$\\text{rate} = k^*$$\nand $$S_{max}$$"]
RTF = ["{\\rtf1\\ansi plain \\'ef\\'f0\\par next\\u1078?}", "{\\b bold\\b0  text\\par}", "no markup"]
CAPTIONS = ["*Рисунок 7. First*\ntext\n***Рисунок.** Second*\n**Рисунок 3** third", "nothing here", "*Рисунок one*"]
PAGES = [("a.pdf", 1, "Рис. 1 – Kiln with a long pipe\nmore"), ("a.pdf", 2, "no caption"), ("b.pdf", 5, "ТАБЛИЦА № 3. Yields of tar"), ("b.pdf", 6, "Схема 2 — flow")]
IMAGES = [("a.pdf", 1, 300.0, 200.0), ("a.pdf", 1, 10.0, 10.0), ("a.pdf", 2, 400.0, 100.0), ("b.pdf", 5, 100.0, 100.0), ("b.pdf", 6, 500.0, 300.0)]
MARKDOWN = ["# Title", "", "one", "two", "- a", "- b", "", "| x | y |", "|---|---|", "> said", "---", "1. first", "![pic](p.png)", "tail"]
QUESTIONS = (
    "Preamble\n### Вопрос 1. Kilns\n**Коротко.** short\n**Развёрнуто.** long one\n**Ключевые цифры и имена.**\n| Факт | n |\n|---|---|\n| heat | 5 |\n**Уточняющие вопросы.**\n- *why?*\n**Источники.** A; B\n\n---\n"
    "### Вопрос 2. Pipes\n**Коротко.** brief\n**Развёрнуто.** long two\n**Ключевые цифры и имена.**\n| Факт | n |\n|---|---|\n| bore | 7 |\n**Уточняющие вопросы.**\n- *how?*\n**Источники.** C\n")
LONG_QUESTION = (
    "### Вопрос 1. Kilns\n**Коротко.** short\n**Развёрнуто.** long one\n\n**Pipes in kilns.**\nthey burst\n\n**Источники.** A; B\n\n---\n"
    "### Вопрос 2. Oils\n**Коротко.** brief\n")
SNAPSHOTS = ["backup-20240105-101500", "backup-20240107-080000", "backup-20240106-235959-dbonly", "backup-20231231-000000", "notes"]
REGISTRY = [("main", "/data/Corpus/", "data-main", 8765), ("oils", "/data/oils", "data-oils", 8767)]
ADDED = [("Main again", "/DATA/corpus", ), ("New: fuels", "/data/fuels/"), ("???", "/data/x")]


def _lines(spark: SparkSession, lines: list[str], name: str = "line") -> DataFrame:
    return spark.createDataFrame(list(enumerate(lines, 1)), f"line_no int, {name} string")


def topics_parsed(spark: SparkSession, d: str) -> DataFrame:
    return A.carried_sections(_lines(spark, TOPICS))


def formulas(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, FORMULAS).select("line_no", M.formulas_udf("line").alias("text"))


def rtf_texts(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, RTF).select("line_no", M.rtf_udf("line").alias("text"))


def captions_numbered(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, CAPTIONS).select("line_no", M.numbered_captions(F.col("line")).alias("text"))


def figure_catalogue(spark: SparkSession, d: str) -> DataFrame:
    return A.figure_catalogue(spark.createDataFrame(IMAGES, "file string, page int, width double, height double"), spark.createDataFrame(PAGES, "file string, page int, text string"))


def markdown_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Runs of lines of one kind; headings, rules and images stand alone."""
    w = Window.orderBy("line_no")
    kinds = _lines(spark, MARKDOWN).withColumn("kind", M.block_kind(F.col("line")))
    opens = (F.col("kind") != F.lag("kind", 1, "").over(w)) | F.col("kind").isin("heading", "rule", "image")
    runs = kinds.withColumn("block", F.sum(opens.cast("int")).over(w)).filter("kind != 'blank'")
    return runs.groupBy("block", "kind").agg(F.count("*").alias("lines"), F.min("line_no").alias("first"))


def questions_split(spark: SparkSession, d: str) -> DataFrame:
    return Q.split(spark.createDataFrame([(1, QUESTIONS)], "doc int, text string"), "doc", "text").select("ord", "number", "title", F.length("body").alias("size"))


def questions_merged(spark: SparkSession, d: str) -> DataFrame:
    rows = Q.split(spark.createDataFrame([(1, QUESTIONS)], "doc int, text string"), "doc", "text")
    return Q.merge(rows, "2", "1", "About pipes").select("number", "title", "body")


def snapshots_kept(spark: SparkSession, d: str) -> DataFrame:
    return store.retention(spark.createDataFrame([(s,) for s in SNAPSHOTS], "name string"), keep=3)


def registry_added(spark: SparkSession, d: str) -> DataFrame:
    return store.registered(spark.createDataFrame(REGISTRY, "name string, corpus string, data string, port int"), spark.createDataFrame([(a[0], a[1]) for a in ADDED], "name string, corpus string"))


QUERIES = {f.__name__: f for f in (
    topics_parsed, formulas, rtf_texts, captions_numbered, figure_catalogue, markdown_blocks, questions_split, questions_merged, snapshots_kept, registry_added)}

_s = lambda x: "'" + x.replace("'", "''") + "'"
_values = lambda rows: ", ".join("(" + ", ".join(_s(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
_numbered = lambda lines: _values(list(enumerate(lines, 1)))
_kind = """CASE WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(trim(line), '^#{1,6} ') THEN 'heading' WHEN regexp_matches(trim(line), '^(-{3,}|\\*{3,}|_{3,})$') THEN 'rule'
 WHEN regexp_matches(trim(line), '^!\\[[^\\]]*\\]\\([^)]+\\)') THEN 'image' WHEN line[1] = '|' THEN 'table' WHEN line[1] = '>' THEN 'quote' WHEN regexp_matches(trim(line), '^[-*+] ') THEN 'bullet'
 WHEN regexp_matches(trim(line), '^[0-9]+[.)] ') THEN 'number' ELSE 'paragraph' END"""
_split = f"string_split({_s(QUESTIONS)}, '### Вопрос ')"

ORACLE = {
    "formulas": """SELECT * FROM (VALUES (1, '(a+b)/μₘ'), (2, 'x² · y₁ → z'), (3, '√(2α) ≈ 109,2'), (4, 'no formula'), (5, 'rate = k*' || chr(10) || 'and Sₘₐₓ')) t(line_no, text)""",
    "rtf_texts": """SELECT line_no, replace(text, '~', chr(10)) AS text FROM (VALUES (1, '  plain пр~~ nextж'), (2, ' bold  text~~'), (3, 'no markup')) t(line_no, text)""",
    "captions_numbered": """SELECT line_no, replace(text, '~', chr(10)) AS text FROM (VALUES (1, '*Рисунок 1. First*~text~***Рисунок 2.** ** Second*~**Рисунок 3. ** third'), (2, 'nothing here'), (3, '*Рисунок 1. one*')) t(line_no, text)""",
    "questions_merged": """SELECT number, title, replace(body, '~', chr(10)) AS body FROM (VALUES ('1', 'Kilns', '~**Коротко.** short~**Развёрнуто.** long one~~~**About pipes.**~~long two~~**Ключевые цифры и имена.**~| Факт | n |~|---|---|~| heat | 5 |~| bore | 7 |~~**Уточняющие вопросы.**~- *why?*~- *how?*~~**Источники.** A; B; C~~---~')) t(number, title, body)""",
    "topics_parsed": f"""WITH l(line_no, line) AS (VALUES {_numbered(TOPICS)}), s AS (SELECT line_no, trim(line) AS s FROM l WHERE trim(line) <> ''),
 m AS (SELECT *, CASE WHEN s LIKE '##%' AND s NOT LIKE '###%' THEN trim(ltrim(s, '#')) END AS sec, CASE WHEN s LIKE '###%' THEN trim(ltrim(s, '#')) WHEN s LIKE '##%' THEN '' END AS sub FROM s),
 f AS (SELECT *, last_value(sec IGNORE NULLS) OVER (ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section, last_value(sub IGNORE NULLS) OVER (ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS subsection FROM m)
 SELECT line_no, coalesce(section, 'Без раздела') AS section, coalesce(subsection, '') AS subsection, s AS topic FROM f WHERE s NOT LIKE '#%'""",
    "figure_catalogue": f"""WITH p(file, page, text) AS (VALUES {_values(PAGES)}), i(file, page, w, h) AS (VALUES {_values(IMAGES)}),
 b AS (SELECT file, page, count(*) AS images, max(CAST(w * h AS BIGINT)) AS area FROM i GROUP BY 1, 2 HAVING max(w * h) >= 25000)
 SELECT file, page, images, area, left(trim(regexp_extract(text, '(?i)(?:Рису?н?о?к|Рис\\.|Схема|Таблица)\\s*№?\\s*[0-9]+\\s*[–—.-]?\\s*.{{0,90}}')), 95) AS caption FROM p JOIN b USING (file, page)""",
    "markdown_blocks": f"""WITH l(line_no, line) AS (VALUES {_numbered(MARKDOWN)}), k AS (SELECT line_no, {_kind} AS kind FROM l),
 o AS (SELECT *, sum(CASE WHEN kind IS DISTINCT FROM before OR kind IN ('heading', 'rule', 'image') THEN 1 ELSE 0 END) OVER (ORDER BY line_no) AS block FROM (SELECT *, lag(kind) OVER (ORDER BY line_no) AS before FROM k))
 SELECT CAST(block AS BIGINT) AS block, kind, count(*) AS lines, min(line_no) AS first FROM o WHERE kind <> 'blank' GROUP BY 1, 2""",
    "questions_split": f"""SELECT CAST(i AS INTEGER) AS ord, split_part(p, '. ', 1) AS number, split_part(substr(p, instr(p, '. ') + 2), chr(10), 1) AS title, CAST(length(p) - instr(p, chr(10)) + 1 AS INTEGER) AS size
 FROM (SELECT i, {_split}[i + 1] AS p FROM range(1, len({_split})) r(i))""",
    "snapshots_kept": f"""WITH s(name) AS (VALUES {_values([(s,) for s in SNAPSHOTS])}), t AS (SELECT name, try_strptime(regexp_extract(name, '([0-9]{{8}}-[0-9]{{6}})', 1), '%Y%m%d-%H%M%S') AS taken FROM s)
 SELECT name, strftime(taken, '%Y-%m-%d %H:%M:%S') AS "at", row_number() OVER (ORDER BY name DESC) <= 3 AS kept FROM t WHERE taken IS NOT NULL""",
    "registry_added": f"""WITH r(name, corpus, data, port) AS (VALUES {_values(REGISTRY)}), a(name, corpus) AS (VALUES {_values(ADDED)}),
 n AS (SELECT * FROM a WHERE lower(rtrim(corpus, '/')) NOT IN (SELECT lower(rtrim(corpus, '/')) FROM r)), g AS (SELECT name, trim(regexp_replace(name, '[^\\p{{L}}\\p{{N}}]', '_', 'g'), '_') AS s, corpus FROM n)
 SELECT name, corpus, data, port FROM r UNION ALL SELECT name, corpus, 'data-' || CASE WHEN s = '' THEN 'corpus' ELSE s END, CAST((SELECT max(port) FROM r) + row_number() OVER (ORDER BY name) AS INTEGER) FROM g""",
}
