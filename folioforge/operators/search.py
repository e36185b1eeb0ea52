"""Search, reading, bibliography and statistics over documents, chunks and vectors."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import vectors as V

MISSING = "не найдено"
MOST_REFS = 10_000
UNKNOWN_YEAR = "неизвестен"


def glob_pattern(pattern: str) -> str:
    """Regular expression of a file-name glob (``*``, ``?``, ``[...]``)."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif close > 0:
            body = pattern[i + 1 : close]
            out += "[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]"
            i = close
        else:
            out += re.escape(c)
        i += 1
    return out


def paper_filter(filename: Column, pattern: str | None) -> Column | None:
    """Glob if the pattern has glob signs, else substring; case is ignored, an empty pattern filters nothing."""
    if not pattern:
        return None
    low = pattern.lower()
    return F.lower(filename).rlike(f"^(?s:{glob_pattern(low)})$") if any(c in low for c in "*?[") else F.contains(F.lower(filename), F.lit(low))


def year_filter(year: str, low: int | None = None, high: int | None = None) -> Column | None:
    """Unknown years count as 0: they pass an upper bound and fail a lower one."""
    known = F.coalesce(F.col(year), F.lit(0))
    parts = ([known >= low] if low is not None else []) + ([known <= high] if high is not None else [])
    return parts[0] if len(parts) == 1 else parts[0] & parts[1] if parts else None


def hits(vectors: DataFrame, documents: DataFrame, chunks: DataFrame, query: list[float], k: int = 8, paper: str | None = None, year_min: int | None = None, year_max: int | None = None) -> DataFrame:
    """Ranked passages; filters are applied before ranking, missing documents leave their fields empty.

    The k best are found first; documents and texts are then read by their keys,
    which reach the scans as filters, and no table is shuffled.
    """
    where = None
    for part in (paper_filter(F.col("filename"), paper), year_filter("year", year_min, year_max)):
        where = part if where is None else where & part if part is not None else where
    keep = ["doc_id", "chunk_index", "cite_key", "filename", "year", "page_start", "page_end", "section"]
    best = V.top_k(vectors, "embedding", query, k, ["doc_id", "chunk_index"], where, keep)
    found = best.collect()
    ids = sorted({r["doc_id"] for r in found})
    about = documents.filter(F.col("doc_id").isin(ids)).select("doc_id", "title", "authors")
    texts = chunks.filter(F.col("doc_id").isin(ids) & F.col("chunk_index").isin(sorted({r["chunk_index"] for r in found}))).select("doc_id", "chunk_index", "text")
    rows = vectors.sparkSession.createDataFrame(found, best.schema)
    rows = rows.join(F.broadcast(about), "doc_id", "left").join(F.broadcast(texts), ["doc_id", "chunk_index"], "left")
    return rows.select(
        "rank", "score", "doc_id", F.coalesce("cite_key", F.lit("")).alias("cite_key"), T.citation(F.col("authors"), F.col("year"), F.col("filename")).alias("citation"),
        "filename", F.coalesce("title", F.lit("")).alias("title"), F.nullif("year", F.lit(0)).alias("year"), "page_start", "page_end", F.coalesce("section", F.lit("")).alias("section"), "text")


def keyword_matches(chunks: DataFrame, term: str) -> DataFrame:
    """Chunks that hold the term, whatever its case."""
    return chunks.filter(F.contains(F.lower("text"), F.lit(term.lower())))


def keyword_search(chunks: DataFrame, documents: DataFrame, term: str, limit: int | None = 50, paper: str | None = None) -> DataFrame:
    """doc_id, cite_key, filename, year, title, hits (chunks), page, snippet: documents by hits, then year."""
    matches = keyword_matches(chunks, term).select("doc_id", "chunk_index", "page_start", T.snippet(F.col("text"), term).alias("snippet"))
    found = matches.groupBy("doc_id").agg(F.count("*").alias("hits"), F.min("page_start").alias("low"), F.min_by(F.struct("snippet", "page_start"), "chunk_index").alias("first"))
    docs = documents.select("doc_id", "cite_key", "filename", "year", "title")
    where = paper_filter(F.col("filename"), paper)
    rows = found.join(docs.filter(where) if where is not None else docs, "doc_id").select(
        "doc_id", "cite_key", "filename", "year", "title", "hits", F.coalesce("first.page_start", "low").alias("page"), F.col("first.snippet").alias("snippet"))
    if limit is None:
        return rows
    return rows.orderBy(F.desc("hits"), F.desc_nulls_last("year"), "doc_id").limit(limit)


def keyword_total(chunks: DataFrame, term: str) -> DataFrame:
    """How many documents and chunks hold the term."""
    return keyword_matches(chunks, term).agg(F.count_distinct("doc_id").alias("documents"), F.count("*").alias("chunks"))


def page_range(pages: str) -> tuple[int, int]:
    """First and last page of ``A-B``, ``A`` or ``-B``; ``A-`` is A alone, further parts are ignored."""
    first, *rest = pages.split("-")
    low = int(first) if first.strip() else 1
    return low, int(rest[0]) if rest and rest[0].strip() else low


def read_pages(pages: DataFrame, wanted: str | None = None) -> DataFrame:
    """doc_id, page, text of the pages (doc_id, page, blocks) in a range, one row each."""
    if wanted is not None:
        low, high = page_range(wanted)
        pages = pages.filter(F.col("page").between(low, high))
    return pages.select("doc_id", "page", F.array_join("blocks", "\n\n").alias("text"))


def lookup(documents: DataFrame, doc_id: int | None = None, sha256: str | None = None, path: str | None = None) -> DataFrame:
    """The documents that have all the given identifiers."""
    for name, value in (("doc_id", doc_id), ("sha256", sha256), ("path", path)):
        if value is not None:
            documents = documents.filter(F.col(name) == value)
    return documents


def bibliography(documents: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Numbered entries by cite key (null first) and id, with a placeholder for what is missing."""
    if keys:
        documents = documents.filter(F.col("cite_key").isin(*[k.strip() for k in keys]))
    or_missing = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit(MISSING))
    order = [F.asc_nulls_first("cite_key"), F.asc("doc_id")]
    return numbered(documents, order, "n").select(
        "n", F.coalesce("cite_key", F.lit("")).alias("cite_key"), or_missing("authors").alias("authors"), or_missing("title").alias("title"),
        F.coalesce(F.nullif("year", F.lit(0)).cast("string"), F.lit(MISSING)).alias("year"), or_missing("journal").alias("journal"), or_missing("doi").alias("doi"), "filename")


def bibliography_line() -> Column:
    """One markdown line of an entry."""
    return F.concat(F.col("n").cast("string"), F.lit(". "), F.col("authors"), F.lit(" ("), F.col("year"), F.lit("). "), F.col("title"), F.lit(". *"), F.col("journal"), F.lit("*. DOI: "), F.col("doi"))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Dense numbers from 1 in global order, without moving all rows to one task.

    Rows are range-partitioned; a part's numbers begin after the counts of the
    parts before it, which are the only thing the driver sees.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    from folioforge.shared import cut

    kept = cut(ordered, "ordered")
    before, total = {}, 0
    for row in kept.groupBy("_part").count().orderBy("_part").collect():
        before[row["_part"]] = total
        total += row["count"]
    if not before:
        return kept.withColumn(name, F.lit(0).cast("bigint")).drop("_part", "_at")
    offsets = kept.sparkSession.createDataFrame(list(before.items()), "_part int, _before bigint")
    return kept.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_at") + F.col("_before") + 1).drop("_part", "_at", "_before")


def documents_by_year(documents: DataFrame) -> DataFrame:
    year = F.coalesce(F.nullif("year", F.lit(0)).cast("string"), F.lit(UNKNOWN_YEAR))
    return documents.groupBy(year.alias("year")).agg(F.count("*").alias("documents"))


def documents_by_status(documents: DataFrame) -> DataFrame:
    return documents.groupBy("status").agg(F.count("*").alias("documents"))


def totals(documents: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: documents, chunks, vectors (a chunk's repeated vectors count once)."""
    parts = [documents.agg(F.count("*").alias("documents")), chunks.agg(F.count("*").alias("chunks")), vectors.select("doc_id", "chunk_index").distinct().agg(F.count("*").alias("vectors"))]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])


def top_first_authors(documents: DataFrame, most: int = 10) -> DataFrame:
    """Most frequent first authors; ties keep the order of cite keys."""
    named = documents.select(T.first_author(F.col("authors")).alias("author"), F.struct(F.col("cite_key").isNotNull().alias("known"), "cite_key", "doc_id").alias("at")).filter("author != ''")
    counted = named.groupBy("author").agg(F.count("*").alias("documents"), F.min("at").alias("at"))
    return counted.orderBy(F.desc("documents"), "at").limit(most).select("author", "documents")


def resolve(documents: DataFrame, refs: DataFrame) -> DataFrame:
    """ref, doc_id, tier: by number, else by exact file name or key, else by part of file name, key or title.

    ``refs`` is a table of what users typed, ``MOST_REFS`` at most, as parts of
    names are looked for row by row.  A number that is no document has no candidates.
    """
    if refs.limit(MOST_REFS + 1).count() > MOST_REFS:
        raise ValueError(f"more than {MOST_REFS} references at once")
    docs = documents.select("doc_id", "filename", "cite_key", "title")
    number = F.col("ref").rlike("^[0-9]+$")
    by_number = docs.join(F.broadcast(refs.filter(number)), F.col("doc_id") == F.expr("try_cast(ref as bigint)")).select("ref", "doc_id", F.lit(1).alias("tier"))
    words = F.broadcast(refs.filter(~number))
    exact = docs.join(words, F.col("filename") == F.col("ref")).unionByName(docs.join(words, F.col("cite_key") == F.col("ref"))).select("ref", "doc_id", F.lit(2).alias("tier"))
    has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lower("ref"))
    part = docs.join(words, has("filename") | has("cite_key") | has("title")).select("ref", "doc_id", F.lit(3).alias("tier"))
    every = by_number.unionByName(exact.distinct()).unionByName(part)
    best = every.groupBy("ref").agg(F.min("tier").alias("tier"))
    return every.join(best, ["ref", "tier"]).select("ref", "doc_id", "tier").distinct()
