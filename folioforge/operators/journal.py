"""The ingest journal: severities, counts, tails, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Severity of the levels; an unknown level counts as 0.
SEVERITY = {"INFO": 1, "WARN": 2, "ERROR": 3}


def severity(level: Column) -> Column:
    out = F.lit(0)
    for name, n in SEVERITY.items():
        out = F.when(F.upper(level) == name, n).otherwise(out)
    return out


def at_least(journal: DataFrame, level: str) -> DataFrame:
    return journal.filter(severity(F.col("level")) >= SEVERITY[level.upper()])


def counts(journal: DataFrame, by: list[str] | None = None) -> DataFrame:
    """info, warn and error always, whichever occur."""
    return journal.groupBy(*(by or [])).agg(*[F.count_if(severity(F.col("level")) == n).alias(name.lower()) for name, n in SEVERITY.items()])


def tail(journal: DataFrame, last: int = 20, level: str | None = None) -> DataFrame:
    """The newest records."""
    rows = (at_least(journal, level) if level else journal).select("ts", "session", "stage", "level", "source", "message").distinct()
    return rows.orderBy(F.desc("ts"), "session", "stage", "message").limit(last)


def sessions(journal: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """session, start, n, late: runs of records with pauses below the gap, and how many arrived over an hour late.

    Runs are formed day by day and joined where two days meet, so the records of a
    session that never ends are not in one task.
    """
    pause = F.expr(f"INTERVAL {gap}")
    rows = journal.select("ts", "session", "stage", "message", "received_at").distinct().withColumn("_day", F.to_date("ts"))
    own = Window.partitionBy("session", "_day").orderBy("ts")
    opens = F.coalesce(F.col("ts") >= F.lag("ts").over(own) + pause, F.lit(True)).cast("int")
    runs = rows.withColumn("_o", opens).withColumn("_r", F.sum("_o").over(own)).groupBy("session", "_day", "_r").agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"), F.count_if(F.col("received_at") > F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("late"))
    over = Window.partitionBy("session").orderBy("first")
    parted = F.coalesce(F.col("first") >= F.lag("last").over(over) + pause, F.lit(True)).cast("int")
    joined = runs.withColumn("_o", parted).withColumn("_r", F.sum("_o").over(over)).groupBy("session", "_r")
    return joined.agg(F.min("first").alias("start"), F.sum("n").alias("n"), F.sum("late").alias("late")).select("session", "start", "n", "late")
