from pyspark.sql import functions as F

from spanforge.streaming import events


def test_stream_is_incremental(spark, tmp_path, sf_dir):
    """Files that come later are taken once, and a restart goes on from the checkpoint."""
    src = spark.read.parquet(f"{sf_dir}/events.parquet")
    (tmp_path / "events.parquet").mkdir()
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def step():
        query = events.filtered(events.read_events(spark, str(tmp_path)), 50.0).writeStream.trigger(availableNow=True).option("checkpointLocation", state).format("parquet").start(out)
        query.awaitTermination()
        return spark.read.parquet(out).count()

    src.where("event_id < 500").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    assert step() == src.where("event_id < 500 and value >= 50").count()
    src.where("event_id >= 500").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    assert step() == src.where("value >= 50").count()
    assert step() == src.where("value >= 50").count()


def events_of(spark, rows):
    df = spark.createDataFrame(rows, "event_id long, t string, user_id long, value double")
    return df.select("event_id", F.to_timestamp_ntz("t").alias("ts"), "user_id", F.lit("click").alias("event_type"), "value", F.lit("{}").alias("props"))


def test_late_rows_are_refused_and_state_goes(spark, tmp_path):
    """Tumbling windows in append mode: a window comes once the watermark passed it, and a late row doesn't change it."""
    path, out, state = str(tmp_path / "events.parquet"), str(tmp_path / "out"), str(tmp_path / "state")

    def step(rows):
        events_of(spark, rows).coalesce(1).write.mode("append").parquet(path)
        query = events.tumbling(events.read_events(spark, str(tmp_path))).writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", state).format("parquet").start(out)
        query.awaitTermination()
        return {str(r.start)[:10]: r.n for r in spark.read.parquet(out).collect()}, query

    assert step([(1, "2024-01-01 10:00:00", 1, 1.0), (2, "2024-01-01 23:30:00", 1, 1.0), (3, "2024-01-02 00:30:00", 1, 1.0)])[0] == {}
    got, query = step([(4, "2024-01-01 23:45:00", 1, 1.0), (5, "2024-01-03 12:00:00", 1, 1.0)])
    assert got == {"2024-01-01": 3, "2024-01-02": 1}
    got, query = step([(6, "2024-01-01 12:00:00", 1, 1.0), (7, "2024-01-05 12:00:00", 1, 1.0)])
    assert got == {"2024-01-01": 3, "2024-01-02": 1, "2024-01-03": 1}
    assert sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"]) == 1
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1


def test_tee_and_rows(spark, tmp_path):
    events_of(spark, [(i, "2024-01-01 10:00:00", i % 3, float(i)) for i in range(20)]).write.parquet(str(tmp_path / "events.parquet"))
    a, b = [], str(tmp_path / "b")
    events.tee(events.read_events(spark, str(tmp_path)), "tee", lambda df, n: a.append((n, df.count())), lambda df, n: df.write.mode("overwrite").parquet(f"{b}/batch={n}"))
    assert a == [(0, 20)] and spark.read.parquet(b).count() == 20
    assert sorted(r.event_id for r in events.rows(spark.read.parquet(b))) == list(range(20))
