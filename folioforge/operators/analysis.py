"""Composite analyses: coverage of topics, evidence digests, robustness, figures."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import text as T

FRAGMENTS, PER_DOCUMENT, LEAST_SCORE, DEPTH = 8, 3, 0.45, 14
KEYWORDS_AT_ONCE = 200_000


def documents_with_keywords(documents: DataFrame, key: str, text: str, keywords: DataFrame) -> DataFrame:
    """keyword, documents: in how many documents each keyword stands as a part of the text.

    One pass of an Aho-Corasick automaton per block of keywords over all texts
    instead of a join by containment.
    """
    spark = documents.sparkSession
    result = None

    def scan(block: list[str]) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for i, w in enumerate(sent.value):
                automaton.add_word(w, i)
            automaton.make_automaton()
            counts = [0] * len(sent.value)
            for batch in batches:
                for t in batch.column("t").to_pylist():
                    for i in {i for _, i in automaton.iter(t)}:
                        counts[i] += 1
            found = [i for i, n in enumerate(counts) if n]
            yield pa.RecordBatch.from_arrays([pa.array([sent.value[i] for i in found], pa.string()), pa.array([counts[i] for i in found], pa.int64())], ["keyword", "n"])

        return documents.select(F.lower(text).alias("t")).filter("t IS NOT NULL").mapInArrow(run, "keyword string, n bigint")

    # The driver holds one block at a time.
    name = keywords.columns[0]
    words = keywords.select(name).filter(F.col(name) != "").distinct().orderBy(name).toLocalIterator()
    while block := [r[0] for r in islice(words, KEYWORDS_AT_ONCE)]:
        part = scan(block)
        result = part if result is None else result.unionByName(part)
    if result is None:
        return spark.createDataFrame([], "keyword string, documents bigint")
    return result.groupBy("keyword").agg(F.sum("n").alias("documents"))


def coverage(topic_hits: DataFrame, topic_keywords: DataFrame, keyword_documents: DataFrame) -> DataFrame:
    """topic, best, strong, docs, keyword_docs, verdict.

    ``topic_hits``: topic, variant, score, filename of every variant's hits.
    ``topic_keywords``: topic, keyword.  The best variant (the first of equals)
    speaks for a topic; a topic whose best score is not above 0 has none.
    """
    variants = topic_hits.groupBy("topic", "variant").agg(
        F.max("score").alias("best"), F.count_if(F.col("score") >= 0.58).alias("strong"), F.count_distinct(F.when(F.col("score") >= 0.52, F.col("filename"))).alias("docs"))
    best = variants.filter("best > 0").groupBy("topic").agg(F.max_by(F.struct("best", "strong", "docs"), F.struct("best", -F.col("variant"))).alias("b"))
    known = topic_keywords.join(keyword_documents, "keyword", "left").groupBy("topic").agg(F.max(F.least(F.coalesce("documents", F.lit(0)), F.lit(50))).alias("keyword_docs"))
    rows = known.join(best, "topic", "left").select(
        "topic", F.coalesce("b.best", F.lit(0.0)).alias("best"), F.coalesce("b.strong", F.lit(0)).alias("strong"), F.coalesce("b.docs", F.lit(0)).alias("docs"), F.coalesce("keyword_docs", F.lit(0)).cast("bigint").alias("keyword_docs"))
    return rows.withColumn("verdict", T.verdict(F.col("best"), F.col("strong"), F.col("docs"), F.col("keyword_docs")))


def digest(topic_hits: DataFrame, least: float = LEAST_SCORE, per_document: int = PER_DOCUMENT, fragments: int = FRAGMENTS) -> DataFrame:
    """Evidence per topic: one hit per file and page, a quota per file, the best fragments of what is left."""
    once = Window.partitionBy("topic", "filename", "page_start").orderBy(F.desc("score"), "variant", "rank", "chunk_id")
    quota = Window.partitionBy("topic", "filename").orderBy(F.desc("score"), "chunk_id")
    total = Window.partitionBy("topic").orderBy(F.desc("score"), "chunk_id")
    rows = topic_hits.filter(F.col("score") >= least).withColumn("r", F.row_number().over(once)).filter("r = 1")
    rows = rows.withColumn("r", F.row_number().over(quota)).filter(F.col("r") <= per_document)
    return rows.withColumn("place", F.row_number().over(total)).filter(F.col("place") <= fragments).select("topic", "place", "score", "chunk_id", "filename", "page_start")


def overlap(clean: DataFrame, corrupted: DataFrame) -> DataFrame:
    """query, shared, same_first: hits that a query and its corrupted form have in common."""
    gather = lambda d, n: d.groupBy("query").agg(F.collect_set("hit").alias(n), F.min_by("hit", "rank").alias(n + "_first"))
    both = gather(clean, "a").join(gather(corrupted, "b"), "query")
    return both.select("query", (F.size(F.array_intersect("a", "b")) / F.size("a")).alias("shared"), (F.col("a_first") == F.col("b_first")).alias("same_first"))


def robustness_by_kind(overlaps: DataFrame) -> DataFrame:
    """kind, mean, queries: the mean of ``shared`` for each kind of corruption."""
    return overlaps.groupBy("kind").agg(F.round(F.avg("shared"), 4).alias("mean"), F.count("*").alias("queries"))


def robustness(overlaps: DataFrame) -> DataFrame:
    return overlaps.agg(
        F.round(F.avg("shared"), 4).alias("mean"), F.round(F.median("shared"), 4).alias("median"), F.round(F.min("shared"), 4).alias("least"), F.round(F.avg(F.col("same_first").cast("double")), 4).alias("first_share"), F.count("*").alias("queries"))


def figure_catalogue(images: DataFrame, pages: DataFrame, least_area: int = 25_000, terms: list[str] | None = None) -> DataFrame:
    """file, page, images, area, caption: pages with an image of some size, and the first caption on them."""
    from folioforge.functions.markup import captions

    big = images.groupBy("file", "page").agg(F.count("*").alias("images"), F.max((F.col("width") * F.col("height")).cast("bigint")).alias("area")).filter(F.col("area") >= least_area)
    if terms:
        low = [t.lower() for t in terms]
        pages = pages.filter(F.exists(F.array(*[F.lit(t) for t in low]), lambda t: F.contains(F.lower("text"), t)))
    return pages.join(big, ["file", "page"]).select("file", "page", "images", "area", F.coalesce(F.try_element_at(captions(F.col("text")), F.lit(1)), F.lit("")).alias("caption"))


def carried_sections(lines: DataFrame, default: str = "Без раздела") -> DataFrame:
    """line_no, section, subsection, topic of a topics file: ``##`` opens a section, ``###`` a subsection, ``#`` is a comment."""
    s = lines.select("line_no", T.strip(F.col("line")).alias("s")).filter("s != ''")
    title = T.strip(F.regexp_replace("s", "^#+", ""))
    s = s.withColumn("sec", F.when(F.col("s").rlike("^##(?!#)"), title)).withColumn("sub", F.when(F.col("s").rlike("^###"), title).when(F.col("s").rlike("^##"), ""))
    order = Window.orderBy("line_no")
    s = s.withColumn("section", F.coalesce(F.last("sec", True).over(order), F.lit(default))).withColumn("subsection", F.coalesce(F.last("sub", True).over(order), F.lit("")))
    return s.filter(~F.col("s").startswith("#")).select("line_no", "section", "subsection", F.col("s").alias("topic"))


def sections_like(topics: DataFrame, prefix: str) -> DataFrame:
    """Topics whose section, or subsection where the prefix holds a point, begins with it (``1`` is a beginning of ``10``)."""
    return topics.filter(F.trim("subsection" if "." in prefix else "section").startswith(prefix.strip()))


VERDICTS = ("covered", "partial", "gap")


def verdict_counts(covered: DataFrame) -> DataFrame:
    """topics and the number of each verdict, whichever occur."""
    return covered.agg(F.count("*").alias("topics"), *[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS])


def _percent(score: Column) -> Column:
    return F.concat(F.round(score * 100).cast("int").cast("string"), F.lit(" %"))


def coverage_report(covered: DataFrame) -> DataFrame:
    """part, place, line of a report in markdown: counts, gaps, thin topics, the whole table by section.

    ``covered``: place, section, title, source and the columns of ``coverage``.
    """
    c = F.col
    counts = verdict_counts(covered).select(
        F.explode(F.array(
            F.struct(F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("place"), F.lit("# Coverage of topics").alias("line")),
            F.struct(F.lit(0).alias("part"), F.lit(1).cast("bigint").alias("place"), F.concat(
                F.lit("**Topics: "), c("topics").cast("string"), F.lit(", covered: "), c("covered").cast("string"), F.lit(", partial: "), c("partial").cast("string"), F.lit(", gap: "), c("gap").cast("string"), F.lit("**")).alias("line")))).alias("x")).select("x.*")
    gaps = covered.filter("verdict = 'gap'").select(F.lit(1).alias("part"), c("place").cast("bigint").alias("place"), F.concat(
        F.lit("- **"), c("title"), F.lit("** ("), c("section"), F.lit("): best "), _percent(c("best")), F.lit(", documents with its words: "), c("keyword_docs").cast("string")).alias("line"))
    thin = covered.filter("verdict = 'partial'").select(F.lit(2).alias("part"), c("place").cast("bigint").alias("place"), F.concat(
        F.lit("- **"), c("title"), F.lit("**: "), c("source"), F.lit(" ("), _percent(c("best")), F.lit(", sources: "), c("docs").cast("string"), F.lit(", by words: "), c("keyword_docs").cast("string"), F.lit(")")).alias("line"))
    table = covered.select(F.lit(3).alias("part"), c("place").cast("bigint").alias("place"), F.concat(
        F.lit("| "), c("section"), F.lit(" | "), c("title"), F.lit(" | "), c("verdict"), F.lit(" | "), _percent(c("best")), F.lit(" | "), c("docs").cast("string"), F.lit(" | "), c("source"), F.lit(" |")).alias("line"))
    return counts.unionByName(gaps).unionByName(thin).unionByName(table)


def digest_report(topics: DataFrame, evidence: DataFrame, chars: int = 700, boilerplate: tuple[str, ...] = (), aliases: dict[str, str] | None = None) -> DataFrame:
    """topic, place, line: under every topic (place 0) its passages, or a line that there are none.

    ``topics``: topic, title; ``evidence``: topic, place, score, filename, page_start, page_end, text.
    """
    head = topics.select("topic", F.lit(0).alias("place"), F.concat(F.lit("#### "), F.col("topic").cast("string"), F.lit(". "), F.col("title")).alias("line"))
    passages = evidence.select("topic", "place", F.concat(
        F.lit("**["), T.source_label(F.col("filename"), 70, aliases), F.lit(", "), T.page_label(F.col("page_start"), F.col("page_end")), F.lit("]** ("), _percent(F.col("score")), F.lit(") "),
        T.fragment(F.col("text"), chars, boilerplate)).alias("line"))
    none = topics.join(evidence.select("topic").distinct(), "topic", "left_anti").select("topic", F.lit(1).alias("place"), F.lit("_Nothing found in the corpus._").alias("line"))
    return head.unionByName(passages).unionByName(none)


def results_by_tag(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """tag, query, results: a JSON list of every query's hits in order; of equal tags the last query counts.

    ``queries``: n (their order), tag, query; ``hits``: n, rank and what is to be told of a hit.
    """
    last = queries.groupBy("tag").agg(F.max_by(F.struct("n", "query"), "n").alias("q")).select("tag", "q.n", "q.query")
    told = F.struct("rank", *[c for c in hits.columns if c not in ("n", "rank")])
    found = hits.groupBy("n").agg(F.to_json(F.array_sort(F.collect_list(told))).alias("results"))
    return last.join(found, "n", "left").select("tag", "query", F.coalesce("results", F.lit("[]")).alias("results"))


def limited_figures(figures: DataFrame, per_file: int = 25, most: int = 25) -> DataFrame:
    """Figures in the order of files and pages, no more than some of a file and some in all."""
    own = Window.partitionBy("file").orderBy("page")
    kept = figures.withColumn("_r", F.row_number().over(own)).filter(F.col("_r") <= per_file).drop("_r")
    return kept.orderBy("file", "page").limit(most)


def crop_rectangles(images: DataFrame, pad: float = 0.02) -> DataFrame:
    """file, page, x0, y0, x1, y1: the largest image of each page with a margin, within the page.

    ``images``: file, page, x0, y0, x1, y1, width, height (of the page).
    """
    c = F.col
    area = (c("x1") - c("x0")) * (c("y1") - c("y0"))
    best = images.groupBy("file", "page").agg(F.max_by(F.struct("x0", "y0", "x1", "y1", "width", "height"), F.struct(area, -c("y0"), -c("x0"))).alias("b")).select("file", "page", "b.*")
    return best.select(
        "file", "page", F.greatest(F.lit(0.0), c("x0") - c("width") * pad).alias("x0"), F.greatest(F.lit(0.0), c("y0") - c("height") * pad).alias("y0"),
        F.least(c("width"), c("x1") + c("width") * pad).alias("x1"), F.least(c("height"), c("y1") + c("height") * pad).alias("y1"))
