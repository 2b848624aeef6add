from datetime import datetime, timedelta


from parcelwright.streaming import events

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"
START = datetime(2025, 1, 1)


def write(spark, folder, name, rows):
    spark.createDataFrame([(i, START + timedelta(minutes=m), u, t, v) for i, m, u, t, v in rows], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_windows_drop_what_is_too_late(spark, tmp_path):
    source, out, point = (str(tmp_path / n) for n in ("in", "out", "point"))
    stream = lambda: events.windowed_counts(events.event_stream(spark, source, SCHEMA, 1))
    write(spark, source, "a", [(1, 5, 1, "x", 1.0), (2, 50, 1, "x", 2.0), (3, 70, 2, "y", 1.0)])
    events.run_available(stream(), out, point)
    write(spark, source, "b", [(4, 600, 1, "x", 1.0)])
    events.run_available(stream(), out, point)
    write(spark, source, "c", [(5, 10, 1, "x", 99.0), (6, 1200, 1, "x", 1.0)])  # the first is hours late
    events.run_available(stream(), out, point)
    got = {(r.start, r.event_type): (r.events, r.value) for r in spark.read.parquet(out).collect()}
    assert got[START, "x"] == (2, 3.0) and got[START + timedelta(hours=1), "y"] == (1, 1.0)


def test_repeats_and_sessions(spark, tmp_path):
    source = str(tmp_path / "in")
    write(spark, source, "a", [(1, 0, 1, "x", 1.0), (1, 0, 1, "x", 1.0), (2, 10, 1, "x", 1.0), (3, 300, 1, "x", 1.0), (4, 900, 2, "x", 1.0)])
    write(spark, source, "b", [(9, 3000, 9, "x", 1.0)])
    events.run_available(events.without_repeats(events.event_stream(spark, source, SCHEMA)), str(tmp_path / "o1"), str(tmp_path / "p1"))
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "o1")).collect()) == [1, 2, 3, 4, 9]
    events.run_available(events.session_counts(events.event_stream(spark, source, SCHEMA, 1)), str(tmp_path / "o2"), str(tmp_path / "p2"))
    events.run_available(events.session_counts(events.event_stream(spark, source, SCHEMA, 1)), str(tmp_path / "o2"), str(tmp_path / "p2"))
    got = {(r.user_id, r.events) for r in spark.read.parquet(str(tmp_path / "o2")).collect()}
    assert got <= {(1, 3), (1, 1), (2, 1), (9, 1)}


def test_running_states(spark, tmp_path):
    source, seen = str(tmp_path / "in"), []
    write(spark, source, "a", [(1, 0, 1, "x", 1.5), (2, 10, 1, "x", None), (3, 20, 2, "x", 4.0)])
    query = lambda: events.running_states(events.event_stream(spark, source, SCHEMA)).writeStream.outputMode("update").foreachBatch(lambda df, _: seen.append({r.user_id: (r.events, r.total) for r in df.collect()})).option("checkpointLocation", str(tmp_path / "p")).trigger(availableNow=True).start().awaitTermination()
    query()
    write(spark, source, "b", [(4, 30, 1, "x", 2.0)])
    query()
    assert seen[0] == {1: (2, 1.5), 2: (1, 4.0)} and seen[-1] == {1: (3, 3.5)}
