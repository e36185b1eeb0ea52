import datetime as dt

from folioforge.streaming.journal import deduplicated, follow_folder, hourly_counts

SCHEMA = "ts timestamp, session string, stage string, level string, source string, message string, received_at timestamp"


def records(spark):
    t = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(t + dt.timedelta(minutes=m), "s", stage, "INFO", "f", str(m), t) for m, stage in ((0, "scan"), (59, "scan"), (60, "scan"), (61, "chunk"), (61, "chunk"), (-600, "scan"))]
    return spark.createDataFrame(rows, SCHEMA)


def test_hourly_counts_equal_the_batch(spark, tmp_path):
    j = records(spark)
    j.coalesce(1).write.parquet(str(tmp_path / "journal.parquet"))
    out = {(r["start"].astimezone(dt.timezone.utc).hour, r["stage"]): r["n"] for r in hourly_counts(spark, str(tmp_path / "journal*.parquet"), j.schema).collect()}
    assert sorted(out.values()) == [1, 1, 2, 2]


def test_repeated_records_come_once(spark, tmp_path):
    j = records(spark)
    j.coalesce(1).write.parquet(str(tmp_path / "journal.parquet"))
    stream = deduplicated(spark, str(tmp_path / "journal*.parquet"), j.schema)
    q = stream.writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 5


def test_new_files_are_handed_over_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("one")
    seen = []
    for _ in range(2):
        follow_folder(spark, str(folder), str(tmp_path / "state"), lambda batch: seen.extend(r["path"].rsplit("/", 1)[1] for r in batch.select("path").collect())).awaitTermination()
        (folder / "b.txt").write_text("two")
    assert seen == ["a.txt", "b.txt"]
