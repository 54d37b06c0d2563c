import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridloom.config import Settings
from gridloom.sources import tables


def rows(spark, days, now):
    data = [(now - dt.timedelta(days=d, hours=h), f"b{d}", 1.5) for d in days for h in (0, 5)]
    return spark.createDataFrame(data, "created_at timestamp, benchmark_name string, execution_time_seconds double")


def test_append_read_and_clean_up(spark, tmp_path):
    now, root = dt.datetime(2024, 5, 20, 3), str(tmp_path)
    tables.append(rows(spark, [0, 5, 10, 40], now), root, "benchmark_results")
    got = tables.read(spark, root, "benchmark_results")
    assert got.count() == 8 and got.schema["execution_time_seconds"].dataType.simpleString() == "decimal(12,6)"
    plan = got.where("day = date'2024-05-20'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan
    assert tables.clean_up(spark, root, "benchmark_results", 10, now) == 3
    left = tables.read(spark, root, "benchmark_results")
    assert left.count() == 5 and left.agg(F.min("created_at")).first()[0] == now - dt.timedelta(days=10)
    assert tables.clean_up(spark, root, "benchmark_results", 10, now) == 0
    assert tables.KEEP_DAYS["system_metrics"](90) == 30 and tables.KEEP_DAYS["validation_results"](90) == 180


def test_schemas_parse(spark):
    for name, ddl in tables.SCHEMAS.items():
        frame = spark.createDataFrame([], ddl)
        assert [c.strip().split(" ")[0] for c in tables._columns(ddl)] == frame.columns, name


@pytest.mark.parametrize("kind", ["json", "csv", "parquet"])
def test_export(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, float("nan"), [1, 2]), (2, 0.5, None)], "a int, b double, c array<int>")
    tables.export(df, str(tmp_path / kind), kind)
    back = spark.read.csv(str(tmp_path / kind), header=True) if kind == "csv" else getattr(spark.read, kind)(str(tmp_path / kind))
    assert sorted((int(r["a"]), None if r["b"] is None else float(r["b"])) for r in back.collect()) == [(1, None), (2, 0.5)]
    with pytest.raises(ValueError):
        tables.export(df, str(tmp_path / "x"), "xls")


def test_report(spark):
    text = tables.report(spark.createDataFrame([("a", 0.123456789), ("bb", None)], "k string, v double"), "Title")
    assert text.splitlines()[:3] == ["Title", "=====", "k   v"] and "0.123457" in text


def test_settings(tmp_path):
    s = Settings()
    s.grid.nx, s.solver.method = 33, "W"
    s.validate().write(str(tmp_path / "s.json"))
    assert Settings.read(str(tmp_path / "s.json")) == s
    for part, key, value in [("grid", "nx", 2), ("grid", "dtype", "half"), ("grid", "domain", [1, 0, 0, 1]), ("solver", "method", "magic"), ("solver", "tolerance", 0.0), ("precision", "precision", "octuple"), ("spark", "tile", 1)]:
        with pytest.raises(ValueError):
            Settings.from_dict({part: {key: value}})
    with pytest.raises(ValueError):
        Settings.from_dict({"gpu": {}})
    try:
        import yaml  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError):
            s.write(str(tmp_path / "s.yaml"))
    else:
        s.write(str(tmp_path / "s.yaml"))
        assert Settings.read(str(tmp_path / "s.yaml")) == s


def test_benchmark_and_suite_exports(spark, tmp_path):
    import json

    results = spark.createDataFrame([("a", 1.5), ("b", float("nan"))], "test string, value double")
    summary = results.groupBy().agg(F.count("test").alias("n"), F.max("value").alias("most"))
    tables.export_benchmarks(results, summary, str(tmp_path / "bench"))
    assert spark.read.csv(str(tmp_path / "bench/results"), header=True).count() == 2 and spark.read.csv(str(tmp_path / "bench/summary"), header=True).count() == 1
    (line,) = [json.loads(x) for f in (tmp_path / "bench/benchmark").glob("part-*") for x in f.read_text().splitlines()]
    assert line["results"] == 2 and line["system_info"]["logical_cores"] >= 1 and len(line["summary"]) == 1
    tables.export_suite(results, summary, str(tmp_path / "suite"))
    text = spark.read.text(str(tmp_path / "suite/report")).collect()
    assert any("Validation summary" in r[0] for r in text) and spark.read.json(str(tmp_path / "suite/results")).count() == 2


def test_left_folders_are_removed(spark, tmp_path):
    for name in ("stream-1", "stream-1-progress", "job2-x", "kept"):
        (tmp_path / name).mkdir()
    (tmp_path / "stream-file").write_text("x")
    assert tables.clean_streams(spark, str(tmp_path)) == 3 and sorted(p.name for p in tmp_path.iterdir()) == ["kept", "stream-file"]
    assert tables.clean_streams(spark, str(tmp_path / "nowhere")) == 0
