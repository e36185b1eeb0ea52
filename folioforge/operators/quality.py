"""Checks of the corpus tables: every check gives rows of one result frame."""

from __future__ import annotations

import importlib
import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text as T


def vector_problems(vectors: DataFrame, dim: int = 64) -> DataFrame:
    """problem, n over all rows: null, dimension, not_finite, zero, ok."""
    v = F.col("embedding")
    problem = (
        F.when(v.isNull(), "null").when(F.size(v) != dim, "dimension")
        .when(F.expr("exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = float('Infinity'))"), "not_finite")
        .when(F.expr("forall(embedding, x -> x = 0)"), "zero").otherwise("ok"))
    return vectors.groupBy(problem.alias("problem")).agg(F.count("*").alias("n"))


def out_of_step(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """doc_id, chunks, vectors where the two stores disagree."""
    c = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"))
    v = vectors.select("doc_id", "chunk_index").distinct().groupBy("doc_id").agg(F.count("*").alias("vectors"))
    both = c.join(v, "doc_id", "full_outer").select("doc_id", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("vectors", F.lit(0)).alias("vectors"))
    return both.filter("chunks != vectors")


def without_chunks(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    return documents.join(chunks.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "filename")


def chunk_sizes(chunks: DataFrame, limit: int = 4000) -> DataFrame:
    """doc_id, over, worst of documents with chunks beyond the limit."""
    return chunks.groupBy("doc_id").agg(F.count_if(F.length("text") > limit).alias("over"), F.max(F.length("text")).alias("worst")).filter("over > 0")


def index_gaps(chunks: DataFrame) -> DataFrame:
    """doc_id of documents whose chunk indexes are not dense from 0."""
    g = chunks.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("chunk_index").alias("d"), F.min("chunk_index").alias("low"), F.max("chunk_index").alias("high"))
    return g.filter("low != 0 OR high != n - 1 OR d != n").select("doc_id", "n")


def report(documents: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """ord, stage, status, n: all checks in order."""
    def row(order: int, stage: str, counted: DataFrame, bad: str) -> DataFrame:
        return counted.agg(F.count("*").alias("n")).select(F.lit(order).alias("ord"), F.lit(stage).alias("stage"), F.when(F.col("n") == 0, "OK").otherwise(bad).alias("status"), "n")

    checks = [
        row(1, "documents.status", documents.filter("status != 'ok'"), "WARN"), row(2, "documents.chunks", without_chunks(documents, chunks), "WARN"),
        row(3, "integrity.sync", out_of_step(chunks, vectors), "FAIL"), row(4, "chunks.size", chunk_sizes(chunks), "WARN"), row(5, "chunks.dense", index_gaps(chunks), "FAIL"),
        vector_problems(vectors).agg(F.sum(F.when(F.col("problem") == "ok", 0).otherwise(F.col("n"))).alias("n")).select(
            F.lit(6).alias("ord"), F.lit("vectors.valid").alias("stage"), F.when(F.col("n") == 0, "OK").otherwise("FAIL").alias("status"), "n"),
    ]
    return reduce(DataFrame.unionByName, checks)


def _listed(rows: DataFrame, keys: list[str], parts: list) -> DataFrame:
    """level, problem, n of every condition that holds, one row each."""
    found = F.array_compact(F.array(*[F.when(when, F.struct(F.lit(level).alias("level"), F.lit(problem).alias("problem"), n.cast("bigint").alias("n"))) for when, level, problem, n in parts]))
    return rows.select(*keys, F.explode(found).alias("x")).select(*keys, "x.*")


def extraction_problems(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, level, problem, n of what was read: no page, no text on any, pages without text, pages recognised."""
    text = F.array_join(F.transform("blocks", lambda b: T.strip(b)), "")
    read = pages.groupBy("doc_id").agg(
        F.count("*").alias("pages"), F.count_if(text != "").alias("full"), F.count_if("ocr_needed").alias("needed"), F.count_if("used_ocr").alias("recognised"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = documents.select("doc_id").join(read, "doc_id", "left")
    return _listed(rows, ["doc_id"], [
        (zero("pages") == 0, "ERROR", "no page", F.lit(0)), ((zero("pages") > 0) & (zero("full") == 0), "ERROR", "no text", zero("pages")),
        (zero("needed") > 0, "WARN", "pages left out", zero("needed")), (zero("recognised") > 0, "INFO", "pages recognised", zero("recognised"))])


def chunk_problems(documents: DataFrame, chunks: DataFrame, limit: int = 8192, size=T.token_count) -> DataFrame:
    """doc_id, level, problem, n: documents without a chunk, and how many of their chunks a model of ``limit`` tokens would cut."""
    own = chunks.withColumn("_n", size(F.col("text"))).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count_if(F.col("_n") > limit).alias("over"))
    rows = documents.select("doc_id").join(own, "doc_id", "left")
    return _listed(rows, ["doc_id"], [(F.col("chunks").isNull(), "ERROR", "no chunk", F.lit(0)), (F.coalesce("over", F.lit(0)) > 0, "WARN", "chunks beyond the model", F.coalesce("over", F.lit(0)))])


def persisted_problems(expected: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """doc_id, level, problem, n: documents of which other numbers were stored than made (doc_id, chunks)."""
    stored = chunks.groupBy("doc_id").agg(F.count("*").alias("c"))
    indexed = vectors.select("doc_id", "chunk_index").distinct().groupBy("doc_id").agg(F.count("*").alias("v"))
    rows = expected.join(stored, "doc_id", "left").join(indexed, "doc_id", "left")
    c, v = F.coalesce("c", F.lit(0)), F.coalesce("v", F.lit(0))
    return _listed(rows, ["doc_id"], [(c != F.col("chunks"), "ERROR", "chunks stored", c), (v != F.col("chunks"), "ERROR", "vectors stored", v)])


def with_names(order: int, stage: str, found: DataFrame, bad: str, most: int = 5) -> DataFrame:
    """ord, stage, status, n, names: how many files a check found, and the first of their names."""
    first = found.select("filename").orderBy("filename").limit(most).agg(F.array_join(F.sort_array(F.collect_list("filename")), ", ").alias("names"))
    return found.agg(F.count("*").alias("n")).crossJoin(first).select(
        F.lit(order).alias("ord"), F.lit(stage).alias("stage"), F.when(F.col("n") == 0, "OK").otherwise(bad).alias("status"), "n", "names")


def environment(spark: SparkSession) -> list[tuple[str, str, str]]:
    """stage, status, detail of what the engine runs on: interpreter, Spark, Java, packages."""
    found = [("python", "OK" if sys.version_info >= (3, 11) else "WARN", ".".join(map(str, sys.version_info[:3]))), ("spark", "OK", spark.version)]
    found.append(("java", "OK", spark.sparkContext._jvm.System.getProperty("java.version")))
    for name in ("numpy", "pandas", "pyarrow", "duckdb", "ahocorasick"):
        try:
            found.append((f"package.{name}", "OK", str(getattr(importlib.import_module(name), "__version__", "?"))))
        except ImportError as e:
            found.append((f"package.{name}", "FAIL", str(e)))
    return found
