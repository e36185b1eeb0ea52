"""The journal and the corpus as streams (an extension: the batch operators say the same)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioforge.shared import new_path


def hourly_counts(spark: SparkSession, files: str, schema: StructType, lateness: str = "400 days") -> DataFrame:
    """start, stage, n: records per hour and stage, read as a stream until all present files are taken.

    Rows arriving later than ``lateness`` behind the newest are left out, and hours
    before it leave the state; the default is longer than any delay of the journal.
    Every batch gives the counts that it changed, the last one of an hour stands.
    """
    out, state = new_path(spark, "hourly"), new_path(spark, "hourly-state")
    stream = spark.readStream.schema(schema).parquet(files).withWatermark("ts", lateness)
    counted = stream.groupBy(F.window("ts", "1 hour"), "stage").agg(F.count("*").alias("n"))
    rows = counted.select(F.col("window.start").alias("start"), "stage", "n")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/part-{number}")

    query = rows.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    given = spark.read.schema("start timestamp, stage string, n bigint, batch int").option("recursiveFileLookup", "true").parquet(out)
    return given.groupBy("start", "stage").agg(F.max_by("n", "batch").alias("n"))


def deduplicated(spark: SparkSession, files: str, schema: StructType, lateness: str = "7 days") -> DataFrame:
    """The journal as a stream without repeated records, within the watermark."""
    return spark.readStream.schema(schema).parquet(files).withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["ts", "session", "stage", "message"])


def follow_folder(spark: SparkSession, folder: str, state: str, ingest, glob: str = "*") -> object:
    """Hand each micro-batch of new files (path, content) to ``ingest``; what is known is ``ingest``'s matter."""
    files = (
        spark.readStream.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
        .schema("path string, modificationTime timestamp, length bigint, content binary").load(folder))
    return files.writeStream.foreachBatch(lambda batch, number: ingest(batch)).option("checkpointLocation", state).trigger(availableNow=True).start()
