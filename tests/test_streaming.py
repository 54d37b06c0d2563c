import datetime as dt

from gridloom.streaming import monitor
from gridloom.streaming.source import SystemMetrics, sample

T0 = dt.datetime(2024, 1, 1)
METRICS = "ts timestamp, host string, metric string, value double"


def drive(stream, name, mode, spark, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(60), "the stream did not end"
    finally:
        q.stop()
    return spark.sql(f"SELECT * FROM {name}").collect()


def arrive(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
    return monitor.from_files(spark, str(path), schema, maxFilesPerTrigger=1)


def test_alerts_and_windows(spark, tmp_path):
    rows = [(T0 + dt.timedelta(seconds=n), "h", m, v) for n in range(30) for m, v in (("cpu", 50.0 + 2 * n), ("memory", 10.0))]
    stream = arrive(spark, rows, METRICS, tmp_path / "m")
    got = drive(monitor.alerts(stream), "alerts_out", "append", spark, tmp_path)
    assert len(got) == 9 and {r["level"] for r in got} == {"warning"}
    windows = drive(monitor.trailing(stream, late="0 seconds"), "windows_out", "append", spark, tmp_path)
    full = [r for r in windows if r["metric"] == "cpu" and r["n"] == 10]
    assert full and all(abs(r["most"] - r["mean"] - 9.0) < 1e-9 for r in full)


def test_last_values_are_bounded(spark, tmp_path):
    for part in range(2):
        rows = [(T0 + dt.timedelta(seconds=60 * part + n), "h", "cpu", float(60 * part + n)) for n in range(50)]
        stream = arrive(spark, rows, METRICS, tmp_path / "v")
    got = drive(monitor.last_values(stream, keep=20), "kept_out", "update", spark, tmp_path)
    last = max(got, key=lambda r: r["values"][-1])
    assert last["n"] == 20 and last["values"] == [float(x) for x in range(90, 110)]


def test_watch_over_batches(spark, tmp_path):
    schema = "ts timestamp, run_id string, iteration int, residual_norm double"
    batches = [[(T0, "a", n, 0.5**n) for n in range(6)] + [(T0, "b", n, 1.0) for n in range(6)], [(T0, "a", n, 1e6) for n in range(6, 9)] + [(T0, "b", n, 1.0) for n in range(6, 12)]]
    for rows in batches:
        stream = arrive(spark, rows, schema, tmp_path / "r")
    got = drive(monitor.watch(stream), "watch_out", "append", spark, tmp_path)
    a = {r["iteration"]: r for r in got if r["run_id"] == "a"}
    b = {r["iteration"]: r for r in got if r["run_id"] == "b"}
    assert len(got) == 21 and a[8]["diverging"] and a[8]["best_at"] == 5 and not a[5]["diverging"]
    assert b[11]["stagnating"] and not b[8]["stagnating"] and b[11]["best_at"] == 0
    advice = monitor.recommendations(spark.createDataFrame(got, monitor.EVENTS))
    assert {r["run_id"] for r in advice.collect()} == {"a", "b"}


def test_watch_does_not_depend_on_arrival(spark, tmp_path):
    schema = "ts timestamp, run_id string, iteration int, residual_norm double"
    rows = [(T0, "a", n, 4.0 + (-1) ** n * 1e-9 + (n == 7) * -3.0) for n in range(14)]
    for k, batches in enumerate(([rows[:5], rows[5:]], [rows[8:], rows[:8]], [[r for r in rows if r[2] % 2], [r for r in rows if not r[2] % 2]])):
        for batch in batches:
            stream = arrive(spark, batch, schema, tmp_path / f"late{k}")
        got = drive(monitor.watch(stream, 5), f"late_{k}", "append", spark, tmp_path)
        assert len(got) == 14
        more = spark.createDataFrame([(T0, "a", 14, 4.0)], schema)
        more.coalesce(1).write.mode("append").parquet(str(tmp_path / f"late{k}"))
        again = drive(monitor.watch(monitor.from_files(spark, str(tmp_path / f"late{k}"), schema, maxFilesPerTrigger=1)), f"again_{k}", "append", spark, tmp_path)
        last = next(r for r in again if r["iteration"] == 14)
        assert abs(last["best"] - 1.0) < 1e-6 and last["best_at"] == 7 and not last["diverging"]


def test_tables_as_file_and_as_folder_give_the_same(spark, tmp_path):
    from gridloom.plans import streams

    rows = [(n, T0 + dt.timedelta(hours=n), n % 3, ["click", "error", "view"][n % 3], float(n * 37 % 101), None) for n in range(200)]
    events = spark.createDataFrame(rows, streams.EVENTS)
    folder, single = tmp_path / "folder", tmp_path / "single"
    events.repartition(3).write.parquet(str(folder / "events.parquet"))
    events.coalesce(1).write.parquet(str(tmp_path / "one"))
    single.mkdir()
    next((tmp_path / "one").glob("part-*")).rename(single / "events.parquet")
    key = lambda r: str(r)
    for name in ("stream_alerts", "stream_windows", "stream_watch"):
        a, b = (sorted(map(tuple, streams.QUERIES[name](spark, str(p)).collect()), key=key) for p in (folder, single))
        assert a == b and a


def test_callbacks_do_not_stop_each_other(spark, tmp_path):
    stream = arrive(spark, [(T0, "h", "cpu", 1.0)], METRICS, tmp_path / "c")
    seen = []
    q = monitor.with_callbacks(stream, lambda df, n: 1 / 0, lambda df, n: seen.append(df.count()), checkpoint=str(tmp_path / "cc"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert seen == [1] and len(q.failed_callbacks) == 1


def test_system_source(spark, tmp_path):
    assert sample()[0][2] == "load"
    spark.dataSource.register(SystemMetrics)
    stream = spark.readStream.format("system_metrics").load()
    q = stream.writeStream.format("memory").queryName("system_out").option("checkpointLocation", str(tmp_path / "s")).trigger(processingTime="200 milliseconds").start()
    try:
        import time

        for _ in range(100):
            time.sleep(0.2)
            if spark.sql("SELECT * FROM system_out").count() >= 2:
                break
    finally:
        q.stop()
    assert {r["metric"] for r in spark.sql("SELECT * FROM system_out").collect()} & {"load", "cpu", "memory"}
    assert monitor.from_rate(spark).columns == ["ts", "host", "metric", "value"]


def test_last_values_hold_no_whole_batch():
    import weakref

    import pandas as pd

    made = []

    def batches():
        for n in range(40):
            pdf = pd.DataFrame({"ts": pd.to_datetime([(n * 7) % 40, 0, 39], unit="s"), "value": [n, 100 + n, 200 + n]})
            made.append(weakref.ref(pdf))
            assert sum(ref() is not None for ref in made) <= 3
            yield pdf

    assert monitor.newest(batches(), 3)["value"].tolist() == [237, 238, 239]
