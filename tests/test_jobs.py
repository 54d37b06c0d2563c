import json
import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import benchmark_release, corpus_monitor, settings

from .conftest import ROOT

HEADS = "o_orderkey long, o_orderpriority string, o_orderdate timestamp_ntz"
RUNS = "l_orderkey long, l_returnflag string, l_linestatus string, l_linenumber int, l_quantity double, l_extendedprice double"


def bench_tables(spark, folder, months=range(1, 7), slow=4):
    """A run a day for a few days of each month; those of month ``slow`` take twice as long."""
    heads = [(100 * m + d, "p", f"2024-{m:02}-{d:02}T06:00:00") for m in months for d in range(1, 10)]
    runs = [(k, "V", "double", 1 + k % 3, 2.0, 9973.0 * (2 if k // 100 == slow else 1) * (1 + k % 3) ** 2) for k, _, _ in heads]
    spark.createDataFrame(heads, "o_orderkey long, o_orderpriority string, o_orderdate string").selectExpr("o_orderkey", "o_orderpriority", "cast(o_orderdate as timestamp_ntz) o_orderdate").write.mode("overwrite").parquet(f"{folder}/heads")
    spark.createDataFrame(runs, RUNS).write.mode("overwrite").parquet(f"{folder}/runs")
    return f"{folder}/runs", f"{folder}/heads"


def rows_of(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_release_finds_the_slow_month_and_reruns_alike(spark, tmp_path):
    runs, heads = bench_tables(spark, tmp_path)
    out = str(tmp_path / "out")
    done = benchmark_release.run(spark, runs, heads, out)
    assert done == {"runs": 54, "rows": 6, "months": 6, "regressions": 1, "baseline": "2024-01"}
    report = {r["month"]: r for r in benchmark_release.read(spark, out).collect()}
    assert [m for m, r in report.items() if r["regressed"]] == ["2024-04"] and report["2024-04"]["ratio"] == pytest.approx(2)
    assert report["2024-01"]["before"] is None and report["2024-01"]["speedup"] == 1 and report["2024-02"]["exponent"] == pytest.approx(2) and report["2024-02"]["label"] == "quadratic"
    first = rows_of(benchmark_release.read(spark, out))
    benchmark_release.run(spark, runs, heads, out)
    assert rows_of(benchmark_release.read(spark, out)) == first


def test_release_of_some_months_touches_no_others(spark, tmp_path):
    runs, heads = bench_tables(spark, tmp_path)
    out = str(tmp_path / "out")
    benchmark_release.run(spark, runs, heads, out)
    before = {m: sorted(os.listdir(f"{out}/month=2024-{m:02}")) for m in range(1, 7)}
    whole = rows_of(benchmark_release.read(spark, out))
    done = benchmark_release.run(spark, runs, heads, out, since="2024-03", until="2024-04")
    assert done["months"] == 2 and done["runs"] == 18
    assert rows_of(benchmark_release.read(spark, out)) == whole  # ratio and speedup as in the whole report
    after = {m: sorted(os.listdir(f"{out}/month=2024-{m:02}")) for m in range(1, 7)}
    assert [m for m in before if before[m] != after[m]] == [3, 4]


def test_release_of_odd_rows(spark, tmp_path):
    spark.createDataFrame([(1, None, None), (2, None, None)], "o_orderkey long, o_orderpriority string, d string").selectExpr("o_orderkey", "o_orderpriority", "timestamp_ntz'2024-05-31 23:59:59' o_orderdate", "'x' month").write.parquet(f"{tmp_path}/heads")
    spark.createDataFrame([(1, None, None, 0, None, None), (1, "V", "d", 2, 1.0, 9973.0), (None, "V", "d", 2, 1.0, 9.0)], RUNS).withColumn("n", F.lit("clash")).write.parquet(f"{tmp_path}/runs")
    benchmark_release.run(spark, f"{tmp_path}/runs", f"{tmp_path}/heads", f"{tmp_path}/out")
    got = sorted(benchmark_release.read(spark, f"{tmp_path}/out").select("month", "solver", "n", "mean").collect(), key=str)
    assert [tuple(r) for r in got] == [("2024-05", "V", 1, 1.0), ("2024-05", None, 0, None)]
    spark.read.parquet(f"{tmp_path}/heads").where("false").write.parquet(f"{tmp_path}/none")
    assert benchmark_release.run(spark, f"{tmp_path}/runs", f"{tmp_path}/none", f"{tmp_path}/nothing")["rows"] == 0


TEXTS = [(1, "one two\none two\none two\n\nx", "s", "en"), (2, "", "s", "en"), (3, None, "s", "en"), (4, "w " * 30000, "", None), (4, "w " * 30000, "", None), (None, "é 🙂", None, "")]
DOCS = "doc_id long, text string, source string, lang string"


def documents(spark, folder, *parts):
    for n, rows in parts:
        spark.createDataFrame(rows, DOCS).withColumn("batch", F.lit("clash")).coalesce(1).write.mode("append").parquet(f"{folder}/part-{n}")
        os.makedirs(f"{folder}/docs", exist_ok=True)
        for f in os.listdir(f"{folder}/part-{n}"):
            if f.endswith(".parquet"):
                shutil.copy(f"{folder}/part-{n}/{f}", f"{folder}/docs/{n}-{f}")
    return f"{folder}/docs"


def test_monitor_measures(spark):
    got = [tuple(r)[3:] for r in corpus_monitor.measured(spark.createDataFrame(TEXTS, DOCS)).collect()]
    assert got == [(0, 26, 7, 4, 2), (0, 0, 0, 0, 0), (1, 0, 0, 0, 0), (0, 60000, 30000, 1, 0), (0, 60000, 30000, 1, 0), (0, 7, 2, 1, 0)]


def test_monitor_takes_only_what_is_new(spark, tmp_path):
    where, out, progress = documents(spark, tmp_path, (1, TEXTS)), f"{tmp_path}/out", f"{tmp_path}/progress"
    done = corpus_monitor.run(spark, where, out, progress)
    assert (done["documents"], done["documents_so_far"], done["alerts"]) == (6, 6, 4)
    assert corpus_monitor.run(spark, where, out, progress)["batches"] == 0
    documents(spark, tmp_path, (2, [(i, f"text {i}", "s", "en") for i in range(10, 30)]), (3, [(40, "b b", "t", "de")]))
    done = corpus_monitor.run(spark, where, out, progress, corpus_monitor.Settings(files_per_batch=1))
    assert (done["batches"], done["documents"], done["documents_so_far"]) == (2, 21, 27)
    again, whole = f"{tmp_path}/again", corpus_monitor.read(spark, out, "summary")
    corpus_monitor.run(spark, where, again, f"{tmp_path}/progress2")
    assert rows_of(whole) == rows_of(corpus_monitor.read(spark, again, "summary"))  # as if all had come at once
    assert rows_of(corpus_monitor.read(spark, out, "alerts").drop("batch")) == rows_of(corpus_monitor.read(spark, again, "alerts").drop("batch"))
    groups = {(r["source"], r["lang"]): r for r in whole.collect()}
    assert groups["s", "en"]["n"] == 23 and groups["s", "en"]["missing"] == 1 and groups["s", "en"]["blank"] == 2 and groups["", None]["most_words"] == 30000 and groups[None, ""]["n"] == 1


def test_monitor_takes_a_batch_again_after_a_failure(spark, tmp_path):
    where, out, progress = documents(spark, tmp_path, (1, TEXTS)), f"{tmp_path}/out", f"{tmp_path}/progress"
    corpus_monitor.run(spark, where, out, progress)
    documents(spark, tmp_path, (2, [(i, "", "s", "en") for i in range(5)]))
    corpus_monitor.run(spark, where, out, progress)
    want = [rows_of(corpus_monitor.read(spark, out, n)) for n in ("summary", "alerts", "partials")]
    for name in os.listdir(f"{progress}/commits"):
        if name.strip(".").startswith("1"):  # written, but the mark was not: the last batch comes again
            os.remove(f"{progress}/commits/{name}")
    assert corpus_monitor.run(spark, where, out, progress)["documents"] == 5
    assert [rows_of(corpus_monitor.read(spark, out, n)) for n in ("summary", "alerts", "partials")] == want


def test_monitor_of_no_documents(spark, tmp_path):
    where = documents(spark, tmp_path, (1, []))
    done = corpus_monitor.run(spark, where, f"{tmp_path}/out", f"{tmp_path}/progress")
    assert done["documents_so_far"] == 0 and corpus_monitor.read(spark, f"{tmp_path}/out", "alerts").count() == 0


def test_settings(tmp_path):
    for kind, name in ((benchmark_release.Settings, "benchmark_release"), (corpus_monitor.Settings, "corpus_monitor")):
        assert settings.read(kind, f"{ROOT}/jobs/{name}.json") == kind()
    for kind, bad in ((corpus_monitor.Settings, {"limits": [["speed", 1, "x"]]}), (corpus_monitor.Settings, {"files_per_batch": 0}), (benchmark_release.Settings, {"most_ratio": 0}), (benchmark_release.Settings, {"baseline_month": "May"}), (benchmark_release.Settings, {"nothing": 1})):
        (tmp_path / "s.json").write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            settings.read(kind, str(tmp_path / "s.json"))


@pytest.mark.parametrize("job", ["benchmark_release", "corpus_monitor"])
def test_command_line(spark, tmp_path, job):
    if job == "benchmark_release":
        runs, heads = bench_tables(spark, tmp_path)
        given = ["--runs", runs, "--heads", heads, "--since", "2024-02"]
    else:
        given = ["--documents", documents(spark, tmp_path, (1, TEXTS)), "--checkpoint", f"{tmp_path}/progress"]
    done = subprocess.run([sys.executable, "-m", f"jobs.{job}", *given, "--out", f"{tmp_path}/out", "--settings", f"{ROOT}/jobs/{job}.json"], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and f"jobs.{job} read " in done.stderr and os.path.isdir(f"{tmp_path}/out")
