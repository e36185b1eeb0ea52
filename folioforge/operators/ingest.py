"""Bookkeeping of ingestion: hashes, duplicates, replaced and missing files, keys, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators.search import numbered


def content_duplicates(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, content_sha, first: the smallest key with the same content, of every text that is not null."""
    hashed = df.select(key, F.sha2(F.col(text).cast("binary"), 256).alias("content_sha")).filter("content_sha IS NOT NULL")
    first = hashed.groupBy("content_sha").agg(F.min(key).alias("first"))
    return hashed.join(first, "content_sha").select(key, "content_sha", "first")


def doi_classes(documents: DataFrame) -> DataFrame:
    """doc_id, doi, class, links: rows of one DOI with their class and how many of other content share it."""
    named = documents.filter("doi IS NOT NULL AND doi != ''").select("doc_id", "doi", "sha256")
    by_doi = named.groupBy("doi").agg(F.min("doc_id").alias("class"), F.count("*").alias("n"))
    by_file = named.groupBy("doi", "sha256").agg(F.count("*").alias("same"))
    rows = named.join(by_doi, "doi").join(by_file, ["doi", "sha256"]).withColumn("links", F.col("n") - F.col("same"))
    return rows.filter("links > 0").select("doc_id", "doi", "class", "links")


def new_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose content is not known yet; of equal new ones the first path stays.

    Documents that ended in an error do not count as known, so they are tried again.
    """
    fresh = files.join(known.filter("status != 'error'").select("sha256").distinct(), "sha256", "left_anti")
    first = fresh.groupBy("sha256").agg(F.min("path").alias("path"))
    return fresh.join(first, ["sha256", "path"], "left_semi")


def replaced(known: DataFrame, files: DataFrame) -> DataFrame:
    """Known documents whose path now holds other content."""
    now = files.select("path", F.col("sha256").alias("now")).distinct()
    return known.join(now, (known["path"] == now["path"]) & (known["sha256"] != now["now"]), "left_semi")


def missing_files(known: DataFrame, files: DataFrame, on: str = "path") -> DataFrame:
    """Known documents whose file is gone."""
    return known.join(files.select(on).distinct(), on, "left_anti")


def remove(documents: DataFrame, chunks: DataFrame, vectors: DataFrame, victims: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the documents of ``victims``."""
    ids = victims.select("doc_id").distinct()
    return tuple(t.join(ids, "doc_id", "left_anti") for t in (documents, chunks, vectors))


def disambiguated_keys(documents: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """doc_id, base, cite_key: the base, then with letters a to z, then with a number, by path.

    ``taken`` holds cite_key values in use: their places are skipped.  Places come
    from one global order, so that a base which a third of all rows share stays with no task.
    """
    base = T.cite_key(F.col("authors"), F.col("year"), F.col("title"), F.col("filename"))
    rows = documents.select("doc_id", "path", base.alias("base"))
    rows = numbered(rows, [F.asc("base"), F.asc("path"), F.asc("doc_id")], "at")
    first = rows.groupBy("base").agg(F.min("at").alias("first"))
    rows = rows.join(first, "base").withColumn("place", (F.col("at") - F.col("first")).cast("int")).drop("at", "first", "path")
    if taken is not None:
        used = taken.select(F.regexp_extract("cite_key", "^(.*(?:[0-9]{4}|ND))([a-z]?)$", 1).alias("base"), F.regexp_extract("cite_key", "^(.*(?:[0-9]{4}|ND))([a-z]?)$", 2).alias("s"))
        used = used.filter("base != ''").groupBy("base").agg(F.sort_array(F.collect_set(F.when(F.col("s") == "", 0).otherwise(F.ascii("s") - 96))).alias("used"))
        free = "filter(sequence(0, 26), i -> NOT array_contains(coalesce(used, array()), i))"
        rows = rows.join(used, "base", "left").withColumn("place", F.expr(f"coalesce(try_element_at({free}, place + 1), 27 + place + 1 - size({free}))"))
    key = F.when(F.col("place") == 0, F.col("base")).when(F.col("place") <= 26, F.concat("base", F.char(F.col("place") + 96))).otherwise(F.concat("base", F.lit("_"), F.col("place").cast("string")))
    return rows.select("doc_id", "base", key.alias("cite_key"))


def status_of(has_text: Column, ocr_needed: Column, ocr_done: Column) -> Column:
    """ok; partial where recognition is still missing on some pages; without any text ocr_skipped or error."""
    return (
        F.when(~has_text & (ocr_needed > 0), "ocr_skipped").when(~has_text, "error").when(ocr_needed > ocr_done, "partial").otherwise("ok"))


def document_status(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, pages_read, computed: the status that text and pages read give."""
    read = chunks.filter("text IS NOT NULL AND page_start IS NOT NULL").groupBy("doc_id").agg(F.count_distinct("page_start").alias("pages_read"))
    rows = documents.join(read, "doc_id", "left").withColumn("pages_read", F.coalesce("pages_read", F.lit(0)))
    text = F.coalesce(T.strip(F.col("text")) != "", F.lit(False))
    return rows.select("doc_id", "pages_read", status_of(text, F.coalesce("num_pages", F.lit(0)), F.col("pages_read")).alias("computed"))


def report(documents: DataFrame) -> DataFrame:
    """One row of ingest counters."""
    n = lambda s: F.count_if(F.col("status") == s)
    return documents.agg(
        F.count("*").alias("total"), n("ok").alias("ok"), n("partial").alias("partial"), n("ocr_skipped").alias("ocr_skipped"), n("error").alias("errors"),
        F.count_distinct("sha256").alias("contents"), F.max("added_at").alias("last_added"))


def read_status(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, num_pages, status, ocr_pages, ocr_needed_pages from the pages read."""
    text = F.array_join(F.transform("blocks", lambda b: T.strip(b)), "")
    read = pages.groupBy("doc_id").agg(
        F.count("*").alias("num_pages"), F.count_if(text != "").alias("full"), F.count_if("used_ocr").alias("ocr_pages"), F.count_if("ocr_needed").alias("ocr_needed_pages"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = documents.select("doc_id").join(read, "doc_id", "left")
    return rows.select(
        "doc_id", zero("num_pages").cast("int").alias("num_pages"), status_of(zero("full") > 0, zero("ocr_needed_pages"), F.lit(0)).alias("status"), zero("ocr_pages").alias("ocr_pages"), zero("ocr_needed_pages").alias("ocr_needed_pages"))
