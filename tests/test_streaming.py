from datetime import datetime, timedelta

from lodeweave.streaming import joblog

T0 = datetime(2024, 1, 1)


def test_job_log(spark, tmp_path):
    rows = [(1, 7, "started", None, T0), (1, 7, "started", None, T0), (2, 7, "Error", "", T0 + timedelta(hours=1)), (3, None, "queued", None, T0), (4, 8, None, None, T0)]
    spark.createDataFrame(rows, joblog.EVENTS).write.parquet(str(tmp_path / "in"))
    q = joblog.current_status(joblog.events(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("status_now").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.job_id, r.status, r.events) for r in spark.table("status_now").collect()} == {(7, "failed", 2), (8, "succeeded", 1)}


def test_pending_references(spark, tmp_path):
    schema = "key string, side string, row_id bigint, at timestamp"
    h = lambda n: T0 + timedelta(hours=n)
    spark.createDataFrame([("x", "ref", 1, h(1)), ("x", "parent", 0, h(2)), ("x", "ref", 2, h(3)), ("x", "deleted", 0, h(4)), ("y", "ref", 3, h(1))], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = joblog.pending_references(stream).writeStream.outputMode("append").format("memory").queryName("pending_now").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.table("pending_now").collect()) == [("x", 1, "reopened"), ("x", 1, "resolved"), ("x", 1, "waiting"), ("y", 3, "waiting")]
