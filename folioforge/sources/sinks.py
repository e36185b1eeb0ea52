"""Results as files: lines, tables of tab-separated values, JSON of few keys."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_lines(lines: DataFrame, folder: str, order: list[str], line: str = "line") -> None:
    """One line a row, in order over the files of the folder."""
    lines.orderBy(*order).select(F.col(line).alias("value")).write.text(folder)


def write_tsv(rows: DataFrame, folder: str, order: list[str]) -> None:
    """Tab-separated values with a head in every file."""
    rows.repartitionByRange(1 if rows.isEmpty() else max(1, rows.sparkSession.sparkContext.defaultParallelism // 64), *order).sortWithinPartitions(*order).write.option("sep", "\t").option("header", True).option("emptyValue", "").csv(folder)


def _read(spark: SparkSession, path: str) -> str | None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _write(spark: SparkSession, path: str, text: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def put_key(spark: SparkSession, path: str, section: str, key: str, value: dict | None, dry_run: bool = False) -> dict:
    """Set (or, with no value, take out) one key of a section of a JSON file; nothing else in it may change.

    The old file is copied beside it first, and the new one is read again. Returns what the file holds, or would hold.
    """
    before = _read(spark, path)
    data = json.loads(before) if before else {}
    kept = {k: dict(v) if isinstance(v, dict) else v for k, v in data.items()}
    own = dict(data.get(section, {}))
    if value is None:
        own.pop(key, None)
    else:
        own[key] = value
    new = data | {section: own}
    lost = set(kept) - set(new) | set(kept.get(section, {})) - set(own) - {key}
    if lost:
        raise RuntimeError(f"keys would be lost: {sorted(lost)}")
    if dry_run:
        return new
    if before is not None:
        _write(spark, f"{path}.backup-{datetime.now(timezone.utc):%Y%m%d-%H%M%S}", before)
    _write(spark, path, json.dumps(new, ensure_ascii=False, indent=1) + "\n")
    if json.loads(_read(spark, path) or "null") != new:
        raise RuntimeError("the file does not hold what was written")
    return new


def write_registry(registry: DataFrame, path: str) -> None:
    """The registry of corpora, a few rows, as one JSON array."""
    rows = [r.asDict() for r in registry.orderBy("port").limit(10_001).collect()]
    if len(rows) > 10_000:
        raise ValueError("more than 10,000 corpora")
    _write(registry.sparkSession, path, json.dumps(rows, ensure_ascii=False, indent=1) + "\n")
