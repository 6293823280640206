"""Streams that are stopped and started again, and rows that come behind the watermark."""

import datetime

from pyspark.sql import functions as F

from quillspark.streaming import incremental, sessions


def last_by_hand(rows, rounds):
    out = {}
    for conv in {r[0] for r in rows if r[0] is not None}:
        turns = {}
        for c, t, role, text in rows:
            if c == conv and t is not None:
                turns[t] = max(turns.get(t, (role, text or "")), (role, text or ""))
        if turns:
            out[conv] = "\n".join(f"{turns[t][0]}: {turns[t][1]}" for t in sorted(turns)[-rounds:])
    return out


def test_sessions_go_on_after_a_restart(spark, tmp_path):
    sessions.use_rocksdb(spark)
    schema = "conv_id long, turn long, role string, text string"
    lots = [
        [(1, 1, "user", "a"), (1, 2, "bot", "b"), (2, 1, "user", None), (None, 1, "user", "x"), (3, None, "user", "y")],
        [(1, 4, "bot", "d"), (1, 3, "user", "c"), (4, 1, "user", "new")],
        [(1, 3, "user", "c"), (1, 5, "user", "e"), (2, 2, "bot", "again"), (2, 1, "user", "first")],
    ]
    seen, latest = [], {}
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for n, lot in enumerate(lots):
            spark.createDataFrame(lot, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = sessions.sessions(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 3)

            def keep(batch, number):
                latest.update({r.conv_id: r.history for r in batch.collect()})

            # a new query each time, on the checkpoint of the one before
            stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
            seen += lot
            assert latest == last_by_hand(seen, 3)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_late_events_are_dropped_and_counted(spark, tmp_path):
    at = lambda minute: datetime.datetime(2024, 1, 1, 10) + datetime.timedelta(minutes=minute)
    schema = "ts timestamp, event_type string, value double, user_id long"
    lots = [[(at(5), "a", 1.0, 1), (at(20), "a", 2.0, 1)], [(at(200), "a", 4.0, 1)], [(at(6), "a", 8.0, 1), (at(195), "a", 16.0, 2), (at(400), "b", 1.0, 1)], [(at(500), "b", 1.0, 1)]]
    dropped = 0
    for lot in lots:
        spark.createDataFrame(lot, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        events = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        query = incremental.event_counts(events).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        dropped += sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
    rows = {r.start: (r.n, r.total) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    hour = lambda h: datetime.datetime(2024, 1, 1, h)
    # the row of 10:06 came when its hour was closed; that of 13:15 was in time
    assert dropped == 1 and rows == {hour(10): (2, 3.0), hour(13): (2, 20.0), hour(16): (1, 1.0)}


def test_sessions_of_users_by_gaps(spark):
    at = lambda minute: datetime.datetime(2024, 1, 1, 10) + datetime.timedelta(minutes=minute)
    df = spark.createDataFrame([(at(0), "a", 1.0, 1), (at(9), "b", 2.0, 1), (at(30), "a", 4.0, 1), (at(3), "a", 8.0, 2), (None, "a", 1.0, 2), (at(5), "a", None, None)], "ts timestamp, event_type string, value double, user_id long")
    got = sorted((r.user_id or 0, r.start, r.end, r.n, r.total) for r in incremental.user_sessions(df).collect())
    assert got == [(0, at(5), at(15), 1, None), (1, at(0), at(19), 2, 3.0), (1, at(30), at(40), 1, 4.0), (2, at(3), at(13), 1, 8.0)]
