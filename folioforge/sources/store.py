"""The corpus tables on storage: append, publish by swap, snapshots, retention, registry."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text as T

TABLES = ("documents", "pages", "chunks", "vectors")
DOCUMENTS = (
    "doc_id bigint, filename string, path string, sha256 string, cite_key string, title string, authors string, year int, journal string, doi string, abstract string,"
    " num_pages int, status string, added_at timestamp")
CHUNKS = "doc_id bigint, chunk_index int, text string, page_start int, page_end int, section string"
VECTORS = "doc_id bigint, chunk_index int, embedding array<float>, cite_key string, filename string, year int, page_start int, page_end int, section string"
PAGES = "doc_id bigint, page int, blocks array<string>, used_ocr boolean, ocr_needed boolean"
SCHEMAS = {"documents": DOCUMENTS, "pages": PAGES, "chunks": CHUNKS, "vectors": VECTORS}
STAMP = r"(\d{8}-\d{6})"


class Store:
    """The corpus tables below one folder; every table is a series of states, the highest of which is current.

    A state is a numbered file that lists the folders a table is made of.  A new one
    is written whole under another name and then renamed to the next number, so
    readers see the old state or the new one, and of two writers one fails.  Old
    states and folders stay for ``KEPT`` further states, for readers that still use
    them.  A store can be used in a ``with`` statement.
    """

    KEPT = 3

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.open = True

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """No further reading or writing through this object."""
        self.open = False

    def _states(self, table: str) -> list[int]:
        """Numbers of a table's states, the current one last."""
        if not self.open:
            raise RuntimeError("the store is closed")
        folder = self._path(f"{self.root}/{table}")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n[7:]) for n in names if n.startswith("_state-"))

    def _state(self, table: str, number: int) -> list[str]:
        stream = self._fs.open(self._path(f"{self.root}/{table}/_state-{number:09d}"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def folders(self, table: str) -> list[str]:
        """Folders that make up the table's current state."""
        states = self._states(table)
        return self._state(table, states[-1]) if states else []

    def _point(self, table: str, folders: list[str]) -> None:
        states = self._states(table)
        fresh = self._path(f"{self.root}/{table}/_next-{uuid.uuid4().hex}")
        out = self._fs.create(fresh, True)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        number = states[-1] + 1 if states else 1
        if not self._fs.rename(fresh, self._path(f"{self.root}/{table}/_state-{number:09d}")):
            self._fs.delete(fresh, False)
            raise RuntimeError(f"another writer has changed {table}")
        old = states[: -self.KEPT]
        if old:
            used = {f for n in states[-self.KEPT :] for f in self._state(table, n)} | set(folders)
            for n in old:
                for folder in set(self._state(table, n)) - used:
                    self._fs.delete(self._path(folder), True)
                self._fs.delete(self._path(f"{self.root}/{table}/_state-{n:09d}"), False)

    def read(self, table: str) -> DataFrame:
        folders = self.folders(table)
        if not folders:
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.schema(SCHEMAS[table]).parquet(*folders)

    def _write(self, table: str, df: DataFrame) -> str:
        folder = f"{self.root}/{table}/v-{uuid.uuid4().hex}"
        names = [f.split()[0] for f in SCHEMAS[table].replace(", ", ",").split(",")]
        df.select(*names).write.parquet(folder)
        return folder

    def append(self, table: str, df: DataFrame) -> None:
        self._point(table, [*self.folders(table), self._write(table, df)])

    def replace(self, table: str, df: DataFrame) -> None:
        self._point(table, [self._write(table, df)])

    def tables_missing(self) -> list[str]:
        return [t for t in TABLES if not self.folders(t)]

    def count(self, table: str) -> int:
        """Rows of a table, -1 where it cannot be read."""
        try:
            return self.read(table).count()
        except Exception:
            return -1

    def next_id(self) -> int:
        return (self.read("documents").agg(F.max("doc_id")).first()[0] or 0) + 1

    def delete(self, victims: DataFrame) -> None:
        """Remove documents with their chunks and vectors."""
        ids = victims.select("doc_id").distinct()
        for t in TABLES:
            self.replace(t, self.read(t).join(ids, "doc_id", "left_anti"))

    def set_status(self, doc_id: int, status: str) -> None:
        self.replace("documents", self.read("documents").withColumn("status", F.when(F.col("doc_id") == doc_id, status).otherwise(F.col("status"))))

    def snapshot(self, target: str, tables: tuple[str, ...] = TABLES, reason: str = "manual") -> str:
        """Copy the current state to ``target``/backup-<time>; returns the folder."""
        name = "backup-" + datetime.now(timezone.utc).strftime("%Y%m%d-%H%M%S") + ("" if tables == TABLES else "-dbonly")
        folder = f"{target.rstrip('/')}/{name}"
        for t in tables:
            self.read(t).write.mode("overwrite").parquet(f"{folder}/{t}")
        self.spark.createDataFrame([(reason, ",".join(tables))], "reason string, tables string").coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
        return folder

    def restore(self, folder: str, safety: str | None = None) -> tuple[str | None, bool]:
        """Take a snapshot's state; the present one is saved first. Returns that copy and whether vectors came back."""
        saved = self.snapshot(safety, reason="before restore") if safety else None
        for t in TABLES:
            if self._fs.exists(self._path(f"{folder}/{t}")):
                self.replace(t, self.spark.read.schema(SCHEMAS[t]).parquet(f"{folder}/{t}"))
        return saved, bool(self._fs.exists(self._path(f"{folder}/vectors")))

    def snapshots(self, target: str) -> DataFrame:
        path = self._path(target)
        names = [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []
        return self.spark.createDataFrame([(n,) for n in names], "name string")

    def prune(self, target: str, keep: int) -> list[str]:
        """Delete all but the newest snapshots; returns the names gone."""
        gone = [r["name"] for r in retention(self.snapshots(target), keep).filter("NOT kept").collect()]
        for name in gone:
            self._fs.delete(self._path(f"{target}/{name}"), True)
        return gone


def retention(snapshots: DataFrame, keep: int) -> DataFrame:
    """name, at, kept: which snapshots stay, by name; names without a time are none."""
    from pyspark.sql import Window

    at = F.try_to_timestamp(F.regexp_extract("name", STAMP, 1), F.lit("yyyyMMdd-HHmmss"))
    rows = snapshots.select("name", at.alias("at")).filter("at IS NOT NULL")
    kept = F.row_number().over(Window.orderBy(F.desc("name"))) <= keep
    return rows.select("name", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), kept.alias("kept"))


def find_snapshot(snapshots: DataFrame, wanted: str) -> DataFrame:
    """The newest for ``latest``, else the oldest whose name holds what is wanted."""
    rows = snapshots.filter(F.regexp_extract("name", STAMP, 1) != "")
    if wanted == "latest":
        return rows.orderBy(F.desc("name")).limit(1)
    return rows.filter(F.contains("name", F.lit(wanted))).orderBy("name").limit(1)


def due(snapshots: DataFrame, now: datetime, hours: float) -> DataFrame:
    """Whether the newest snapshot is older than ``hours`` (or there is none)."""
    at = F.to_timestamp(F.regexp_extract("name", STAMP, 1), "yyyyMMdd-HHmmss")
    age = (F.unix_seconds(F.lit(now)) - F.unix_seconds(F.max(F.when(F.regexp_extract("name", STAMP, 1) != "", at)))) / 3600.0
    return snapshots.agg(F.coalesce(age >= hours, F.lit(True)).alias("due"))


def registered(registry: DataFrame, added: DataFrame) -> DataFrame:
    """The registry with new corpora: same folders are not taken twice, ports go on from the highest."""
    from pyspark.sql import Window

    plain = lambda c: F.lower(F.regexp_replace(c, "/+$", ""))
    known = registry.select(plain("corpus").alias("k"))
    fresh = added.withColumn("k", plain("corpus")).join(known, "k", "left_anti")
    top = registry.agg(F.coalesce(F.max("port"), F.lit(8764)).alias("top"))
    rows = fresh.crossJoin(F.broadcast(top)).select(
        "name", "corpus", F.concat(F.lit("data-"), T.slug(F.col("name"))).alias("data"), (F.col("top") + F.row_number().over(Window.orderBy("name"))).cast("int").alias("port"))
    return registry.select("name", "corpus", "data", "port").unionByName(rows)
