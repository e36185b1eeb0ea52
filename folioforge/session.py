"""Session with the settings this engine expects."""

from __future__ import annotations

import atexit
import os
import shutil
import site
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "folioforge") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers where they could not import it: it is neither installed nor on their path."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parent.parent
    known = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), *site.getsitepackages(), site.getusersitepackages(), os.getcwd()]
    if any(p and Path(p).resolve() == root for p in known):
        return
    folder = tempfile.mkdtemp(prefix="folioforge-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    copy = Path(folder, "tree")
    shutil.copytree(Path(__file__).resolve().parent, copy / "folioforge", ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/folioforge", "zip", copy))


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the corpus tables of a data directory."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
