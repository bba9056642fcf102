import datetime as dt

from codeloom.streaming.watch import CHANGES, debounced, latest, watch

T0 = dt.datetime(2024, 1, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def test_debounce_in_batch(spark):
    rows = [("a", at(0)), ("a", at(0.2)), ("a", at(0.9)), ("b", at(0.1))]
    got = debounced(spark.createDataFrame(rows, "path string, ts timestamp"), "path", "ts")
    assert sorted((r.path, r.events) for r in got.collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_last_change_of_a_path_counts(spark):
    rows = [("a", "write", b"1", at(0)), ("a", "delete", None, at(1)), ("b", "write", b"1", at(2)), ("b", "write", b"2", at(3)), ("c", "write", b"x", at(1)), ("c", "delete", None, at(1))]
    got = {r.path: (r.op, r.content) for r in latest(spark.createDataFrame(rows, CHANGES)).collect()}
    assert got == {"a": ("delete", None), "b": ("write", bytearray(b"2")), "c": ("delete", None)}


def test_watch(spark, tmp_path):
    src = f"{tmp_path}/in"
    spark.createDataFrame([("a.py", "write", b"x", at(0)), ("b.py", "delete", None, at(0))], CHANGES).coalesce(1).write.parquet(src)
    seen = []
    stream = spark.readStream.schema(CHANGES).parquet(src)
    q = watch(stream, lambda w, d: seen.append((sorted(r.path for r in w.collect()), sorted(r.path for r in d.collect()))), f"{tmp_path}/cp", available_now=True)
    q.awaitTermination(60)
    assert seen == [(["a.py"], ["b.py"])]


def test_stream_sessions(spark, tmp_path):
    src = f"{tmp_path}/in"
    rows = [("a", at(0)), ("a", at(0.1)), ("b", at(100))]
    spark.createDataFrame(rows, "path string, ts timestamp").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("path string, ts timestamp").parquet(src).withWatermark("ts", "1 second")
    q = debounced(stream, "path", "ts").writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.path, r.events) for r in spark.table("sessions").collect()] == [("a", 2)]


def test_a_watched_graph_follows_changes(spark, tmp_path):
    import base64
    import json

    from codeloom.session import GraphSession

    (tmp_path / "p" / ".codeloom").mkdir(parents=True)
    (tmp_path / "changes").mkdir()
    s = GraphSession(spark, str(tmp_path / "p"), f"file://{tmp_path}/g")

    def change(name, *rows):
        lines = [json.dumps({"path": p, "op": op, "content": base64.b64encode(c.encode()).decode(), "ts": ts}) for p, op, c, ts in rows]
        (tmp_path / "changes" / name).write_text("\n".join(lines))
        s.watch(f"file://{tmp_path}/changes", f"file://{tmp_path}/c", available_now=True).awaitTermination()
        return {(r.qualified_name) for r in s.store.table("nodes").collect()}

    got = change("1.json", ("a.py", "write", "def f():\n    pass\n", "2024-01-01T00:00:00"), ("b.py", "write", "from a import f\ndef g():\n    f()\n", "2024-01-01T00:00:01"), ("x.lock", "write", "x", "2024-01-01T00:00:01"), ("bin.py", "write", "\0", "2024-01-01T00:00:01"))
    assert got == {"a.py", "a.py::f", "b.py", "b.py::g"}
    assert ("b.py::g", "a.py::f") in {(r.source_qualified, r.target_qualified) for r in s.store.table("edges").collect()}
    got = change("2.json", ("a.py", "write", "def h():\n    pass\n", "2024-01-01T00:00:02"), ("b.py", "delete", "", "2024-01-01T00:00:03"))
    assert got == {"a.py", "a.py::h"} and not [r for r in s.store.table("edges").collect() if r.file_path == "b.py"]
