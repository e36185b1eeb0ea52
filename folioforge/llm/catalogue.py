"""Named queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import languages, leakage, lookalikes, names, packing, quality, records, scan_repair, similar, splitting
from folioforge.session import table
from folioforge.shared import new_path


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of chunks of similarity 0.90 or more, one among the other's ten most similar."""
    return similar.similar_pairs(table(spark, d, "vectors"), "chunk_id", "embedding", 0.90)


def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar chunks of every chunk whose id is divisible by 50, against all chunks."""
    return similar.most_similar(table(spark, d, "vectors"), "chunk_id", "embedding", asking=F.col("chunk_id") % 50 == 0)


def _scanned(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks").select("doc_id", "chunk_index", "text")
    return chunks.unionByName(table(spark, d, "documents").select("doc_id", F.lit(-1).alias("chunk_index"), F.col("abstract").alias("text")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks and abstracts that hold scan damage."""
    return scan_repair.damaged_texts(_scanned(spark, d), "text", ["doc_id", "chunk_index"]).distinct()


def p2_text(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk and abstract as continuous paragraphs."""
    return scan_repair.repaired_texts(_scanned(spark, d), "text", ["doc_id", "chunk_index"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks and author lists that hold characters standing for others."""
    chunks = lookalikes.consistent_text(table(spark, d, "chunks"), "text", ["doc_id", "chunk_index"], only_changed=True)
    docs = table(spark, d, "documents").select("doc_id", F.lit(-1).alias("chunk_index"), "authors")
    authors = lookalikes.consistent_text(docs, "authors", ["doc_id", "chunk_index"], names=True, only_changed=True)
    return chunks.unionByName(authors).distinct()


def p3_text(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk's text in its consistent form."""
    return lookalikes.consistent_text(table(spark, d, "chunks"), "text", ["chunk_id"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows of documents that tell of the same paper."""
    return records.duplicate_pairs(table(spark, d, "documents"))


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    """One record per paper."""
    return records.best_records(table(spark, d, "documents"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that had to be cut."""
    return splitting.oversized(table(spark, d, "chunks"), "chunk_id", "text")


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk in pieces within the limit."""
    return splitting.split_items(table(spark, d, "chunks"), "chunk_id", "text")


def p5_file_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The texts of all chunks as files on shared storage, in pieces cut by byte range: file, piece_no, begin, end, section, size."""
    folder = new_path(spark, "p5-files")
    table(spark, d, "chunks").filter("text IS NOT NULL").select(F.concat("text", F.lit("\n")).alias("value")).write.text(folder)
    files = spark.read.format("binaryFile").load(folder).select("path").orderBy("path").toLocalIterator()
    pieces = splitting.split_files(spark, [r["path"] for r in files])
    return pieces.select(F.regexp_extract("path", "part-([0-9]+)", 1).cast("int").alias("file"), "piece_no", "begin", "end", "section", F.length("piece").alias("size"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Different spellings of one person or organisation."""
    return names.variant_pairs(table(spark, d, "documents"), "authors")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Languages that documents hold sentences in and their labels do not name."""
    return languages.unnamed_languages(table(spark, d, "documents"), table(spark, d, "chunks"), table(spark, d, "common_words"))


def p7_languages(spark: SparkSession, d: str) -> DataFrame:
    """The language of every document, with a confidence."""
    return languages.document_languages(table(spark, d, "documents"), table(spark, d, "chunks"), table(spark, d, "common_words"))


def p7_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every stretch of one language in every text, chunk and title."""
    return languages.document_segments(table(spark, d, "documents"), table(spark, d, "chunks"), table(spark, d, "common_words"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text, measured in tokens, in its container."""
    sizes = packing.token_sizes(table(spark, d, "documents"), "doc_id", "text")
    return packing.fill_containers(sizes, "doc_id", "tokens")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that carry evaluation items."""
    return p9_spans(spark, d).select("doc_id", "item_id")


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    """The same with the share carried and the spans to remove."""
    return leakage.leaked_items(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "benchmark"), "item_id", "text")


def _common(spark: SparkSession, d: str) -> list[str]:
    return [r[0] for r in table(spark, d, "common_words").select("word").distinct().collect()]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose text is a list, a table or junk."""
    return p10_kinds(spark, d).filter("kind != 'prose'").select("doc_id").distinct()


def p10_kinds(spark: SparkSession, d: str) -> DataFrame:
    """The kind of every text."""
    return quality.text_kinds(table(spark, d, "documents"), "doc_id", "text", _common(spark, d))


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of every text."""
    return quality.statistics(table(spark, d, "documents"), "doc_id", "text", _common(spark, d))


QUERIES = {f.__name__: f for f in (
    p1_found, p1_neighbours, p2_found, p2_text, p3_found, p3_text, p4_found, p4_records, p5_found, p5_pieces, p5_file_pieces, p6_found, p7_found, p7_languages, p7_segments, p8_containers, p9_found, p9_spans, p10_found, p10_kinds, p10_statistics)}

_p3_chunks = lookalikes.consistent_sql("chunks", "doc_id, chunk_index", "text", False)
_p3_authors = lookalikes.consistent_sql("(SELECT doc_id, CAST(-1 AS INTEGER) AS chunk_index, authors FROM documents)", "doc_id, chunk_index", "authors", True)

ORACLE = {
    "p3_found": f"SELECT DISTINCT doc_id, chunk_index FROM (SELECT * FROM ({_p3_chunks}) UNION ALL SELECT * FROM ({_p3_authors})) WHERE changed",
    "p3_text": lookalikes.consistent_sql("chunks", "chunk_id", "text", False),
    "p10_statistics": quality.statistics_sql("documents", "doc_id", "text", "SELECT word FROM common_words"),
    "p5_found": "SELECT chunk_id FROM chunks WHERE length(text) > 4000",
}
