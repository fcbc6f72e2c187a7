import datetime as dt

from chronoloom.streaming import ingest as si


def test_streamed_messages_are_ingested_once(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    schema = "uuid string, name string, content string, source string, group_id string, reference timestamp"
    rows = [("m1", "n", "Alice met Robert", "chat", "g", t), ("m2", "n", "Robert left Alice", "chat", "g", t + dt.timedelta(minutes=1))]
    src, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    spark.createDataFrame([*rows, rows[0]], schema).write.parquet(src)
    for _ in range(2):  # the second run finds nothing new
        q = si.start_ingest(spark.readStream.schema(schema).parquet(src), out, mark)
        q.awaitTermination(120)
    assert spark.read.parquet(f"{out}/batch=*/episodes").count() == 2
    assert spark.read.parquet(f"{out}/batch=*/entities").count() == 2


def test_windows_and_sessions_of_a_stream(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(i % 2, t + dt.timedelta(minutes=m), "k", 1.0) for i, m in enumerate([0, 1, 10, 50, 55, 200])]
    src = str(tmp_path / "ev")
    spark.createDataFrame(rows, "user_id long, ts timestamp, event_type string, value double").write.parquet(src)
    batch = spark.read.parquet(src)
    assert sorted((r.window_start.hour, r.n) for r in si.windowed_counts(batch).collect()) == [(0, 5), (3, 1)]
    assert si.sessions(batch, "30 minutes").count() == 5
    stream = spark.readStream.schema(batch.schema).parquet(src)
    q = si.windowed_counts(stream).writeStream.outputMode("append").format("memory").queryName("closed_windows").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(n) from closed_windows").head()[0] >= 5
