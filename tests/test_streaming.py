import os

import pytest
from pyspark.sql import functions as F

from lumenframe.sources.store import Store
from lumenframe.streaming.incremental import burst_stream, event_stream, keep_up


def run(spark, folder, batches, schema, make, name, mode="append"):
    """Feed batches as files one by one and return what the query gave."""
    os.makedirs(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = make(stream).writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
            q.processAllAvailable()
        q.processAllAvailable()
        return spark.table(name).collect()
    finally:
        q.stop()


def ts(seconds):
    import datetime

    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def test_events(spark, tmp_path):
    batches = [[(ts(0),), (ts(50),)], [(ts(100),), (ts(400),)], [(ts(90_000),)], [(ts(180_000),)]]
    got = run(spark, str(tmp_path / "in"), batches, "ts timestamp", lambda s: event_stream(s, 100, "1 seconds"), "events")
    assert sorted((r.start, r.end, r["count"]) for r in got)[:2] == [(ts(0), ts(100), 3), (ts(400), ts(400), 1)]


def test_bursts(spark, tmp_path):
    batches = [[("a", ts(0)), ("a", ts(2)), ("b", ts(1)), (None, ts(1))], [("a", ts(4)), ("a", ts(50)), ("b", ts(60))], [("c", ts(9000))], [("c", ts(9001)), ("c", ts(20_000))], [("d", ts(40_000))]]
    got = run(spark, str(tmp_path / "in"), batches, "camera string, ts timestamp", lambda s: burst_stream(s, 3, "1 seconds"), "bursts")
    assert sorted((r.camera, r.start, r.end, r.members) for r in got) == [("a", ts(0), ts(4), 3), ("c", ts(9000), ts(9001), 2)]


@pytest.mark.parametrize("second,status", [(("/r/a", 1, 1), "pending"), (("/r/a", 2, 1), "pending")])
def test_catalog_keeps_up(spark, tmp_path, second, status):
    store, folder, schema = Store(spark, str(tmp_path / "db")), str(tmp_path / "in"), "path string, size long, mtime long"
    os.makedirs(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = stream.writeStream.foreachBatch(keep_up(store, "/r")).option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        for rows in ([("/r/a", 1, 1), ("/r/b", 1, 1)], [second]):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
            q.processAllAvailable()
    finally:
        q.stop()
    rows = {r.path: (r.size, r.status) for r in store.table("files").where(F.col("status") != "missing").collect()}
    assert rows == {"/r/a": (second[1], status), "/r/b": (1, "pending")}
