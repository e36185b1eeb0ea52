"""Tables and files on storage that every executor can reach.

Lineage is cut by writing a table below the folder named by
``spark.checkpoint.dir``.  Only when that setting is absent (tests, notebooks on
one machine) is a temporary folder made.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

_fallback: dict[str, str] = {}
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or one made here where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _fallback[app] = "file://" + tempfile.mkdtemp(prefix="folioforge-")
        _made.append(_fallback[app])
    return _fallback[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing else uses."""
    path = f"{shared_dir(spark)}/folioforge/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends here."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as the cluster has cores.

    Only inputs of fewer partitions (small files of one row group) are dealt out
    again; anything larger is left as it is read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def local_path(path: str) -> str:
    """``file:`` URIs as plain paths, anything else unchanged."""
    parsed = urlparse(path)
    return parsed.path if parsed.scheme == "file" else path


def clean(spark: SparkSession) -> None:
    """Remove every table that this session wrote to the shared folder; frames read from them end with it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)


@atexit.register
def _clean() -> None:
    spark = SparkSession.getActiveSession()
    try:
        if spark is not None and spark.sparkContext._jsc is not None:
            clean(spark)
    except Exception:  # the session ended first
        pass
    for path in _made:
        if urlparse(path).scheme in ("", "file"):
            shutil.rmtree(local_path(path), ignore_errors=True)
