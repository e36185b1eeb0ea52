"""The engine as one object: ingest, search, read, cite, check, snapshot."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import analysis as A
from folioforge.operators import chunking as C
from folioforge.operators import ingest as I
from folioforge.operators import journal as J
from folioforge.operators import quality as Q
from folioforge.operators import search as S
from folioforge.operators import vectors as V
from folioforge.shared import cut
from folioforge.sources import files as files_
from folioforge.sources.store import Store


class Engine:
    """A corpus below ``config.data_dir``.

    ``model`` embeds texts, by default a hashing vectoriser; ``read_pdf``,
    ``read_info`` and ``recognise`` read PDF files, what they tell of themselves, and
    pages without text.
    """

    def __init__(self, spark: SparkSession, config: files_.Config, model=None, read_pdf=None, read_info=None, recognise=None):
        problems = config.problems()
        if problems:
            raise ValueError("; ".join(problems))
        self.spark, self.config, self.model, self.read_pdf, self.read_info, self.recognise = spark, config, model, read_pdf, read_info, recognise
        self.store = Store(spark, config.data_dir)
        self.journal_path = f"{config.data_dir.rstrip('/')}/journal"

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_) -> None:
        self.store.close()

    def record(self, problems: DataFrame, stage: str, session: str) -> None:
        """Append problems (filename, level, problem, n) to the journal."""
        message = F.concat_ws(": ", "problem", F.col("n").cast("string"))
        rows = problems.select(F.current_timestamp().alias("ts"), F.lit(session).alias("session"), F.lit(stage).alias("stage"), "level", F.col("filename").alias("source"), message.alias("message"))
        files_.append_journal(rows, self.journal_path)

    def journal(self, level: str | None = None, last: int | None = None) -> DataFrame:
        """Records of the ingest journal from a level on, the newest ``last`` if given."""
        if not self.store._fs.exists(self.store._path(self.journal_path)):
            return self.spark.createDataFrame([], files_.JOURNAL)
        rows = files_.journal(self.spark, self.journal_path)
        rows = J.at_least(rows, level) if level else rows
        return rows.orderBy(F.desc("ts")).limit(last) if last else rows

    def ingest(self, folder: str | None = None, prune: bool = False, works: DataFrame | None = None) -> dict:
        """Take new and changed files; returns the counters of the run and the names of files that failed or stand apart.

        Every step is checked: what was read, the chunks, the vectors, what was stored,
        and in the end whether chunks and vectors are in step.  What is found goes to the journal.
        """
        session = datetime.now(timezone.utc).strftime("%Y%m%d-%H%M%S")
        files = files_.scan(self.spark, folder or self.config.corpus_dir)
        known = cut(self.store.read("documents"), "known")
        listed = files.select("path", "sha256")
        gone = I.missing_files(known, listed) if prune else known.limit(0)
        changed = I.replaced(known, listed)
        failed = known.filter("status = 'error'").join(listed.select("sha256").distinct(), "sha256", "left_semi")
        victims = cut(gone.select("doc_id").unionByName(changed.select("doc_id")).unionByName(failed.select("doc_id")).distinct(), "victims")
        removed = victims.count()
        if removed:
            self.store.delete(victims)
        known = cut(self.store.read("documents"), "known")
        fresh = I.new_files(listed, known)
        work = files.join(fresh, ["path", "sha256"], "left_semi")
        names = cut(work.select("path", "filename", "sha256"), "work")
        if names.isEmpty():
            return {"added": 0, "removed": removed, "errors": 0, "failed": [], "in_step": self.in_step()}
        read = cut(files_.pages(work, self.read_pdf, self.config.min_chars_per_page, self.recognise), "pages")
        start = self.store.next_id()
        rows = cut(S.numbered(names, [F.asc("path")], "n").withColumn("doc_id", F.col("n") + start - 1).drop("n"), "numbered")
        pages = cut(read.join(rows.select("path", "doc_id"), "path"), "own-pages")
        first = pages.filter("page <= 2").groupBy("doc_id").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", F.array_join("blocks", "\n\n").alias("t")))), lambda x: x["t"]), "\n").alias("first"))
        told = files_.document_info(work, self.read_info)
        about = rows.join(first, "doc_id", "left").join(I.read_status(rows, pages), "doc_id").join(told, "path", "left").withColumn("first", F.coalesce("first", F.lit("")))
        documents = about.select(
            "doc_id", "filename", "path", "sha256", "title", "authors", T.find_year(F.col("first"), F.col("filename")).alias("year"), F.lit(None).cast("string").alias("journal"),
            T.find_doi(F.col("first")).alias("doi"), T.find_abstract(F.col("first")).alias("abstract"), "num_pages", "status", F.lit(datetime.now(timezone.utc)).alias("added_at"))
        if works is not None:
            documents = files_.enrich(documents, works)
        documents = documents.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), F.replace(T.stem(F.col("filename")), F.lit("_"), F.lit(" "))))
        documents = cut(documents, "documents")
        keys = I.disambiguated_keys(documents, known.select("cite_key"))
        documents = cut(documents.join(keys.select("doc_id", "cite_key"), "doc_id"), "documents")
        ready = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "blocks"))).alias("p"))
        flat = F.flatten(F.transform("p", lambda x: F.transform(x["blocks"], lambda b: F.struct(x["page"].alias("page"), b.alias("block")))))
        ready = ready.withColumn("f", flat).select("doc_id", F.col("f.block").alias("b"), F.col("f.page").alias("n"))
        chunks = cut(C.chunk_blocks(ready, "doc_id", "b", "n", self.config.chunk_tokens, self.config.overlap_tokens), "chunks")
        vectors = cut(self._vectors(chunks, documents), "vectors")
        self.store.append("documents", documents)
        self.store.append("pages", pages)
        self.store.append("chunks", chunks)
        self.store.append("vectors", vectors)

        named = documents.select("doc_id", "filename")
        errors = pages.filter("error IS NOT NULL").select("doc_id", F.lit("ERROR").alias("level"), F.col("error").alias("problem"), F.lit(1).cast("bigint").alias("n"))
        stored = self.store.read("chunks").join(named.select("doc_id"), "doc_id", "left_semi")
        indexed = self.store.read("vectors").join(named.select("doc_id"), "doc_id", "left_semi")
        twins = I.doi_classes(self.store.read("documents")).join(named.select("doc_id"), "doc_id", "left_semi")
        for stage, found in (
            ("extract", errors.unionByName(Q.extraction_problems(documents, pages))), ("chunk", Q.chunk_problems(documents, chunks)),
            ("meta", twins.select("doc_id", F.lit("WARN").alias("level"), F.concat(F.lit("same DOI "), F.col("doi")).alias("problem"), F.col("links").cast("bigint").alias("n"))),
            ("store", Q.persisted_problems(chunks.groupBy("doc_id").agg(F.count("*").alias("chunks")), stored, indexed))):
            self.record(found.join(named, "doc_id"), stage, session)
        bad = documents.filter("status = 'error'")
        in_step = self.in_step()
        if not in_step:
            self.record(self.spark.createDataFrame([("", "ERROR", "chunks and vectors out of step", 1)], "filename string, level string, problem string, n bigint"), "gate", session)
        return {
            "added": documents.count(), "removed": removed, "errors": bad.count(), "failed": [r["filename"] for r in bad.select("filename").orderBy("filename").limit(100).collect()], "in_step": in_step}

    def in_step(self) -> bool:
        """Whether every document has as many vectors as chunks."""
        return Q.out_of_step(self.store.read("chunks"), self.store.read("vectors")).isEmpty()

    def _vectors(self, chunks: DataFrame, documents: DataFrame) -> DataFrame:
        about = documents.select("doc_id", F.coalesce("cite_key", F.lit("")).alias("cite_key"), "filename", F.coalesce("year", F.lit(0)).alias("year"))
        return V.embed(chunks.join(about, "doc_id").withColumn("section", F.coalesce("section", F.lit(""))), "text", model=self.model)

    def reindex(self) -> int:
        """All vectors anew from the stored chunks."""
        self.store.replace("vectors", self._vectors(self.store.read("chunks"), self.store.read("documents")))
        return self.store.count("vectors")

    def query_vector(self, query: str) -> list[float]:
        text = "query: " + query
        return list(map(float, self.model([text])[0] if self.model else V.hashed_vector(text)))

    def search(self, query: str, k: int | None = None, paper: str | None = None, year_min: int | None = None, year_max: int | None = None) -> DataFrame:
        """Hits of a question; a blank one has none."""
        vectors = self.store.read("vectors")
        if not query.strip():
            vectors = vectors.limit(0)
        return S.hits(vectors, self.store.read("documents"), self.store.read("chunks"), self.query_vector(query), k or self.config.default_k, paper, year_min, year_max)

    def keyword(self, term: str, limit: int | None = None, paper: str | None = None) -> DataFrame:
        chunks = self.store.read("chunks")
        return S.keyword_search(chunks if term.strip() else chunks.limit(0), self.store.read("documents"), term, limit or self.config.keyword_limit, paper)

    def resolve(self, ref: str) -> DataFrame:
        return S.resolve(self.store.read("documents"), self.spark.createDataFrame([(ref,)], "ref string"))

    def read(self, ref: str, pages: str | None = None) -> DataFrame:
        """page and text of the document that a reference names, if it names one only."""
        ids = [r["doc_id"] for r in self.resolve(ref).select("doc_id").limit(2).collect()]
        own = self.store.read("pages")
        return S.read_pages(own.filter(F.col("doc_id") == ids[0]) if len(ids) == 1 else own.limit(0), pages).orderBy("page")

    def batch(self, queries: DataFrame) -> DataFrame:
        """tag, query, results of many questions (tag, query, k): embedded at once, of equal tags the last."""
        asked = cut(queries.withColumn("n", F.monotonically_increasing_id()), "asked")
        most = asked.agg(F.max("k")).first()[0] or self.config.default_k
        embedded = V.embed(asked.select("n", "query"), "query", prefix="query: ", model=self.model)
        vectors = self.store.read("vectors").withColumn("id", F.concat_ws(":", "doc_id", "chunk_index"))
        found = V.batch_top_k(vectors, "embedding", "id", embedded, "n", "embedding", most).join(asked.select("n", "k"), "n").filter("rank <= k").drop("k")
        told = vectors.select("id", "cite_key", "filename", "page_start", "page_end", "section").dropDuplicates(["id"])
        return A.results_by_tag(found.join(told, "id"), asked.select("n", "tag", "query"))

    def bibliography(self, keys: list[str] | None = None) -> DataFrame:
        return S.bibliography(self.store.read("documents"), keys)

    def documents(self) -> DataFrame:
        return self.store.read("documents").orderBy(F.asc_nulls_first("cite_key"), "doc_id")

    def stats(self) -> dict:
        docs = self.store.read("documents")
        out = S.totals(docs, self.store.read("chunks"), self.store.read("vectors")).first().asDict()
        out["by_year"] = {r["year"]: r["documents"] for r in S.documents_by_year(docs).orderBy("year").collect()}
        out["by_status"] = {r["status"]: r["documents"] for r in S.documents_by_status(docs).collect()}
        out["top_first_authors"] = [tuple(r) for r in S.top_first_authors(docs).collect()]
        return out

    def check(self) -> DataFrame:
        """ord, stage, status, detail: environment, settings, tables, documents, chunks and vectors."""
        fixed = [*Q.environment(self.spark), *self.config.checks()]
        program = files_.find_program(self.config.recogniser)
        fixed.append(("recognition", "OK" if self.recognise or program else "WARN", "given" if self.recognise else program or "none: pages without text are left out"))
        missing = self.store.tables_missing()
        fixed.append(("storage", "WARN" if missing else "OK", "missing: " + ", ".join(missing) if missing else "all tables there"))
        rows = self.spark.createDataFrame([(i, *f) for i, f in enumerate(fixed)], "ord int, stage string, status string, detail string")
        documents, chunks, vectors = (self.store.read(t) for t in ("documents", "chunks", "vectors"))
        counted = Q.report(documents, chunks, vectors).select((F.col("ord") + 100).alias("ord"), "stage", "status", F.col("n").cast("string").alias("detail"))
        folder = self.config.corpus_dir
        if self.store._fs.exists(self.store._path(folder)):
            there = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
            named = Q.with_names(201, "documents.files", I.missing_files(documents, there), "WARN")
            counted = counted.unionByName(named.select("ord", "stage", "status", F.concat_ws(" ", F.col("n").cast("string"), "names").alias("detail")))
        return rows.unionByName(counted)

    def backup(self, target: str) -> str:
        folder = self.store.snapshot(target)
        self.store.prune(target, self.config.backup_keep)
        return folder


def rows_json(df: DataFrame):
    """Rows as plain values, one after another: the driver holds one partition at a time."""
    for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator():
        yield json.loads(r[0])


def as_json(df: DataFrame, most: int | None = None) -> list[dict]:
    """Rows as a list of plain values, ``most`` at the most."""
    return list(rows_json(df if most is None else df.limit(most)))
