"""Files of a corpus as rows: scan, hash, decode, text formats, lists and journals."""

from __future__ import annotations

import os
import shutil
import tomllib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import markup as M
from folioforge.functions import text as T
from folioforge.operators import chunking as C
from folioforge.shared import cut

FORMATS = ("pdf", "txt", "md", "rtf")
JOURNAL = "ts timestamp, session string, stage string, level string, source string, message string"


def scan(spark: SparkSession, folder: str, formats: tuple[str, ...] = FORMATS) -> DataFrame:
    """path, filename, extension, length, sha256, content of all files of the formats, whatever their case; empty files are none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    extension = F.lower(F.regexp_extract("path", "[.]([^./]+)$", 1))
    rows = files.withColumn("extension", extension).filter(F.col("extension").isin(*formats))
    return rows.select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("filename"), "extension", "length", F.sha2("content", 256).alias("sha256"), "content")


def decode(raw: bytes | None) -> str | None:
    """UTF-8 with or without mark, else cp1251, else latin-1 (which takes every byte)."""
    if raw is None:
        return None
    for name in ("utf-8-sig", "cp1251"):
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            pass
    return raw.decode("latin-1")


#: Content of a PDF file to its pages: (page, blocks), a block (x, y, text, kind), kind 0 a text.
PageReader = Callable[[bytes], list[tuple[int, list[tuple[float, float, str, int]]]]]
#: Content and page number to the recognised text.
Recogniser = Callable[[bytes, int], str]
#: Content to (title, author, spans of the first page as (size, y, height, text)).
InfoReader = Callable[[bytes], tuple[str | None, str | None, list[tuple[float, float, float, str]]]]
BLOCK = "struct<x: double, y: double, text: string, kind: int>"


@lru_cache(maxsize=None)
def find_program(named: str = "", program: str = "tesseract", places: tuple[str, ...] = ("/usr/bin", "/usr/local/bin", "/opt/homebrew/bin", "C:/Program Files/Tesseract-OCR")) -> str | None:
    """Where a recognition program is: as named in the settings, on the path, or in one of the usual places; looked for once."""
    if named:
        return named if os.access(named, os.X_OK) else shutil.which(named)
    return shutil.which(program) or next((at for p in places for at in (f"{p}/{program}", f"{p}/{program}.exe") if os.access(at, os.X_OK)), None)


def texts(files: DataFrame) -> DataFrame:
    """path, text, error of the text formats.  A failing file fails alone; other formats get an error and no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, errors = [], []
            for kind, raw in zip(batch.column("extension").to_pylist(), batch.column("content").to_pylist()):
                try:
                    if kind not in FORMATS[1:]:
                        raise ValueError(f"no text format: {kind}")
                    out.append(M.rtf_text(decode(raw)) if kind == "rtf" else decode(raw))
                    errors.append(None)
                except Exception as e:
                    out.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(out, pa.string()), pa.array(errors, pa.string())], ["path", "text", "error"])

    return files.select("path", "extension", "content").mapInArrow(run, "path string, text string, error string")


def page_blocks(blocks: Column) -> Column:
    """Paragraphs of a page from its blocks (x, y, text, kind): texts only, from top to bottom, cleaned, of two characters or more."""
    own = F.filter(blocks, lambda b: b["kind"] == 0)
    placed = F.array_sort(F.transform(own, lambda b, i: F.struct(b["y"].alias("y"), b["x"].alias("x"), i.alias("i"), b["text"].alias("text"))))
    return F.filter(F.transform(placed, lambda b: T.clean_block(b["text"])), lambda t: F.length(t) >= 2)


def pages(files: DataFrame, read_pdf: PageReader | None = None, least_chars: int = 30, recognise: Recogniser | None = None) -> DataFrame:
    """path, page, blocks, used_ocr, ocr_needed, error: pages of PDF files and pseudo-pages of texts.

    A page of less than ``least_chars`` characters is recognised where that can be
    done, else it is marked; a page that cannot be recognised fails alone, and so
    does a file that cannot be read (one empty page with the error).
    """
    plain = texts(files.filter("extension != 'pdf'"))
    flags = [F.lit(False).alias("used_ocr"), F.lit(False).alias("ocr_needed")]
    out = C.paginate(plain.filter("text IS NOT NULL"), "path", "text").select("path", "page", "blocks", *flags, F.lit(None).cast("string").alias("error"))
    failed = plain.filter("text IS NULL").select("path", F.lit(1).alias("page"), F.array().cast("array<string>").alias("blocks"), *flags, "error")
    scans = files.filter("extension = 'pdf'").select("path", "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64()), ("text", pa.string()), ("kind", pa.int32())]))
        for batch in batches:
            rows: list[tuple] = []
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    if read_pdf is None:
                        raise ValueError("no reader for PDF files")
                    rows += [(path, n, [{"x": x, "y": y, "text": t, "kind": k} for x, y, t, k in blocks], None) for n, blocks in read_pdf(raw)]
                except Exception as e:
                    rows.append((path, 1, [], f"{type(e).__name__}: {e}"))
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), kind, pa.string()))], ["path", "page", "raw", "error"])

    read_ = cut(scans.mapInArrow(read, f"path string, page int, raw array<{BLOCK}>, error string"), "pdf-pages").withColumn("blocks", page_blocks(F.col("raw")))
    empty = (F.length(F.array_join("blocks", "\n\n")) < least_chars) & F.col("error").isNull()
    columns = ["path", "page", "blocks", "used_ocr", "ocr_needed", "error"]
    if recognise is None:
        return out.unionByName(failed).unionByName(read_.select("path", "page", "blocks", F.lit(False).alias("used_ocr"), empty.alias("ocr_needed"), "error"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said: list[str | None] = []
            for raw, n in zip(batch.column("content").to_pylist(), batch.column("page").to_pylist()):
                try:
                    said.append(recognise(raw, n) or "")
                except Exception:
                    said.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("page"), pa.array(said, pa.string())], ["path", "page", "said"])

    # Pages, not files, are dealt to the tasks.
    todo = read_.filter(empty).select("path", "page").repartition("path", "page").join(scans, "path")
    looked = todo.mapInArrow(look, "path string, page int, said string").withColumn("found", C.paragraphs(F.col("said"))).withColumn("looked", F.lit(True))
    done = read_.join(looked, ["path", "page"], "left").select(
        "path", "page", F.when(F.size("found") > 0, F.col("found")).otherwise(F.col("blocks")).alias("blocks"), F.coalesce(F.size("found") > 0, F.lit(False)).alias("used_ocr"),
        (F.col("looked").isNotNull() & F.col("said").isNull()).alias("ocr_needed"), "error")
    return out.unionByName(failed).unionByName(done.select(*columns))


def document_info(files: DataFrame, read_info: InfoReader | None) -> DataFrame:
    """path, title, authors that PDF files tell of themselves; failing files tell nothing."""
    schema = "path string, title string, authors string, spans array<struct<size: double, y: double, height: double, text: string>>"
    if read_info is None:
        return files.sparkSession.createDataFrame([], "path string, title string, authors string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("size", pa.float64()), ("y", pa.float64()), ("height", pa.float64()), ("text", pa.string())]))
        for batch in batches:
            rows: list[tuple] = []
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    title, author, spans = read_info(raw)
                    rows.append((path, title, author, [dict(zip(("size", "y", "height", "text"), x)) for x in spans]))
                except Exception:
                    rows.append((path, None, None, []))
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.string(), kind))], ["path", "title", "authors", "spans"])

    told = cut(files.filter("extension = 'pdf'").select("path", "content").mapInArrow(run, schema), "info")
    layout = layout_title(told.select(F.col("path").alias("doc_id"), F.explode("spans").alias("s")).select("doc_id", "s.*"))
    rows = told.join(layout.select(F.col("doc_id").alias("path"), F.col("title").alias("_layout")), "path", "left")
    return rows.select("path", F.coalesce(usable_title(F.col("title")), F.col("_layout")).alias("title"), usable_author(F.col("authors")).alias("authors"))


def layout_title(spans: DataFrame) -> DataFrame:
    """doc_id, title of (doc_id, size, y, height, text): the largest lines in the upper two thirds of the first page."""
    from pyspark.sql import Window

    upper = spans.filter(F.col("y") < 0.67 * F.col("height"))
    whole = Window.partitionBy("doc_id")
    lines = upper.withColumn("top", F.max("size").over(whole)).filter(F.col("size") >= F.col("top") - 0.6)
    first = lines.withColumn("r", F.row_number().over(whole.orderBy("y"))).filter("r <= 6")
    joined = first.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "text"))), lambda x: x["text"]), " ").alias("title"))
    return joined.withColumn("title", F.regexp_replace(T.strip(F.col("title")), f"{T.W}+", " ")).filter(F.length("title").between(12, 400))


# Producers that stand in author fields.
JUNK_AUTHORS = ("elsevier", "adobe", "latex", "microsoft", "word", "unknown", "springer", "wiley", "mdpi", "arbortext", "acrobat")


def usable_author(author: Column) -> Column:
    return F.when(~F.lower(author).rlike("|".join(JUNK_AUTHORS)) & (T.strip(author) != ""), T.strip(author))


def usable_title(title: Column) -> Column:
    return F.when((F.length(T.strip(title)) >= 8) & ~F.lower(title).rlike("^(untitled|microsoft word|document[0-9]*)"), T.strip(title))


def enrich(documents: DataFrame, works: DataFrame) -> DataFrame:
    """Fields of a table of known works (doi, title, authors, year, journal) before those found in the file."""
    known = works.select(F.lower("doi").alias("_doi"), *[F.col(c).alias(f"_{c}") for c in ("title", "authors", "year", "journal")])
    rows = documents.join(known, F.lower("doi") == F.col("_doi"), "left")
    for c in ("title", "authors", "journal"):
        rows = rows.withColumn(c, F.coalesce(F.nullif(F.col(f"_{c}"), F.lit("")), F.col(c)))
    return rows.withColumn("year", F.coalesce("_year", "year")).drop("_doi", "_title", "_authors", "_year", "_journal")


def journal(spark: SparkSession, path: str) -> DataFrame:
    """Records of a journal of JSON lines; blank and malformed lines are left out."""
    return spark.read.schema(JOURNAL).option("mode", "DROPMALFORMED").json(path).filter("ts IS NOT NULL OR message IS NOT NULL")


def append_journal(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def tail_lines(spark: SparkSession, path: str, last: int = 40) -> DataFrame:
    """line_no, line of the last lines of a text file."""
    own = spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())
    return own.orderBy(F.desc("line_no")).limit(last).select("line_no", F.col("value").alias("line")).orderBy("line_no")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no, line of one text file."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line")).select((F.col("n") + 1).alias("line_no"), "line")


def queries(spark: SparkSession, path: str) -> DataFrame:
    """tag, query, k of a JSON file in either shape, ``[[tag, query, k], ...]`` or ``{tag: [query, k]}``; of equal tags the last counts."""
    raw = spark.read.text(path, wholetext=True)
    listed = raw.filter(F.trim("value").startswith("[")).select(F.posexplode(F.from_json("value", "array<array<string>>")).alias("i", "x"))
    listed = listed.select("i", F.col("x")[0].alias("tag"), F.col("x")[1].alias("query"), F.try_element_at("x", F.lit(3)).cast("int").alias("k"))
    mapped = raw.filter(F.trim("value").startswith("{")).select(F.posexplode(F.from_json("value", "map<string,array<string>>")).alias("i", "tag", "x"))
    mapped = mapped.select("i", "tag", F.col("x")[0].alias("query"), F.try_element_at("x", F.lit(2)).cast("int").alias("k"))
    every = listed.unionByName(mapped)
    return every.groupBy("tag").agg(F.max_by(F.struct("query", "k"), "i").alias("q")).select("tag", "q.query", F.coalesce("q.k", F.lit(8)).alias("k"))


def registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, corpus string, data string, port int").option("multiLine", "true").json(path)


@dataclass
class Config:
    """Settings of an engine; ``load`` reads them from TOML and the environment."""

    corpus_dir: str = "corpus"
    data_dir: str = "data"
    chunk_tokens: int = C.CHUNK_TOKENS
    overlap_tokens: int = C.OVERLAP_TOKENS
    default_k: int = 8
    keyword_limit: int = 50
    min_chars_per_page: int = 30
    backup_keep: int = 5
    backup_hours: float = 12.0
    batch_size: int = 512
    recogniser: str = ""
    extra: dict = field(default_factory=dict)

    @classmethod
    def load(cls, path: str | None = None, env: dict[str, str] | None = None) -> Config:
        env = dict(os.environ) if env is None else env
        given: dict = {}
        if path:
            with open(path, "rb") as f:
                raw = f.read().decode("utf-8-sig")
            for section in tomllib.loads(raw).values():
                given.update(section if isinstance(section, dict) else {})
        for name in cls.__dataclass_fields__:
            if (value := env.get(f"FOLIOFORGE_{name.upper()}")) is not None:
                given[name] = value
        known = {k: type(getattr(cls(), k))(v) for k, v in given.items() if k in cls.__dataclass_fields__ and k != "extra"}
        return cls(**known, extra={k: v for k, v in given.items() if k not in cls.__dataclass_fields__})

    def problems(self) -> list[str]:
        found = []
        if self.chunk_tokens <= 0:
            found.append("chunk_tokens must be positive")
        if not 0 <= self.overlap_tokens < self.chunk_tokens:
            found.append("overlap_tokens must be below chunk_tokens")
        if self.default_k <= 0:
            found.append("default_k must be positive")
        if self.batch_size <= 0:
            found.append("batch_size must be positive")
        return found

    def checks(self, exists: Callable[[str], bool] = os.path.isdir) -> list[tuple[str, str, str]]:
        """stage, status, detail of the settings and the corpus folder."""
        bad = self.problems()
        found = [("config", "FAIL", b) for b in bad] or [("config", "OK", f"chunk={self.chunk_tokens}, overlap={self.overlap_tokens}, k={self.default_k}, batch={self.batch_size}")]
        there = exists(self.corpus_dir)
        return [*found, ("config.corpus", "OK" if there else "WARN", self.corpus_dir if there else f"no folder {self.corpus_dir}")]
