import os

import pytest
from pyspark.sql import functions as F

from quarrylight.operators import compare, metrics, resources
from quarrylight.schemas import BENCH_V1, BENCH_V2, FLOW, HOUSE, text_schema
from quarrylight.sources import results, tables

# Published load-test figures of two services, needed for the published speedups. Columns:
# concurrency, rps, latency_avg_ms, latency_p50_ms, latency_p95_ms, latency_p99_ms, cpu_percent, mem_mb.
SLOW = """1,19.17,0.05,0.05,0.07,0.08,73.6,160
5,22.64,0.22,0.22,0.27,0.30,89.2,163
10,22.06,0.45,0.45,0.56,0.61,95.1,166
25,36.94,0.68,0.66,0.89,1.07,97.8,169
50,21.07,2.35,2.39,2.80,3.02,99.5,171"""
SLOW_AGAIN = """1,18.75,0.05,0.05,0.08,0.09,61.9,159
5,24.14,0.21,0.21,0.29,0.35,82.5,163
10,22.74,0.44,0.44,0.59,0.66,89.7,166"""
FAST = """1,3704.95,0.00,0.00,0.00,0.00,48.1,41
5,12599.37,0.00,0.00,0.00,0.00,89.9,42
10,12533.02,0.00,0.00,0.00,0.00,124.2,42
25,16833.51,0.00,0.00,0.00,0.01,143.6,42
50,16797.08,0.00,0.00,0.01,0.01,159.8,42
100,16441.80,0.01,0.01,0.01,0.02,170.1,43"""


def write_run(folder, name, lines, age):
    path = folder / name
    body = []
    for line in lines.splitlines():
        level, rps, avg, p50, p95, p99, cpu, mem = line.split(",")
        body.append(f"1700000000,{level},{rps},{avg},{p50},{p95},{p99},0.00,60.1,,{cpu},{mem}")
    path.write_text("\n".join([BENCH_V2, *body]) + "\n")
    os.utime(path, (1_700_000_000 - age, 1_700_000_000 - age))


def load(spark, folder):
    rows = compare.clean_benchmark(results.read_newest_results(spark, str(folder)), by=["service"])
    return rows.replace({"slow": "Slow", "fast": "Fast"}, subset=["service"])


def test_published_speedup(spark, tmp_path):
    write_run(tmp_path, "slow_benchmark_1.csv", SLOW, 100)
    write_run(tmp_path, "fast_benchmark_1.csv", FAST, 90)
    rows = load(spark, tmp_path)
    overall = compare.overall_speedup(rows, "Slow", "Fast").first()
    assert round(overall["speedup"], 1) == 455.7
    summary = {r["service"]: r for r in compare.service_summary(rows).collect()}
    assert (summary["Slow"]["max_rps"], summary["Slow"]["best_concurrency"]) == ("36.9", "25")
    assert (summary["Fast"]["max_rps"], summary["Fast"]["best_concurrency"]) == ("16833.5", "25")
    assert (summary["Slow"]["latency_avg_ms"], summary["Slow"]["cpu_percent"], summary["Slow"]["mem_mb"]) == ("0.68", "97.8", "169")
    by_level = compare.speedup_by_level(rows.where("service = 'Slow'"), rows.where("service = 'Fast'"))
    found = {int(r["concurrency"]): round(r["speedup"], 1) for r in by_level.collect()}
    assert found == {1: 193.3, 5: 556.5, 10: 568.1, 25: 455.7, 50: 797.2}

    write_run(tmp_path, "slow_benchmark_2.csv", SLOW_AGAIN, 10)
    again = compare.overall_speedup(load(spark, tmp_path), "Slow", "Fast").first()
    assert round(again["speedup"], 1) == 697.3


def test_empty_newest_run_gives_no_row(spark, tmp_path):
    write_run(tmp_path, "slow_benchmark_1.csv", SLOW, 100)
    write_run(tmp_path, "fast_benchmark_1.csv", FAST, 100)
    write_run(tmp_path, "fast_benchmark_2.csv", "", 1)
    rows = load(spark, tmp_path)
    assert [r["service"] for r in compare.best_levels(rows).collect()] == ["Slow"]
    assert compare.overall_speedup(rows, "Fast", "Slow").first()["speedup"] == 0.0


def test_first_layout(spark, tmp_path):
    """The first service pair was measured in another layout, without p50 and timestamps."""
    (tmp_path / "slow.csv").write_text(
        # Published rows of the first layout.
        BENCH_V1 + "\n1,13.4612,0.07,0.09,0.12,0.00,31.67,3180\n10,77.2807,0.13,0.15,0.19,0.00,72.22,3181\n50,74.5410,0.66,0.70,0.76,0.00,73.12,3192\n"
    )
    (tmp_path / "fast.csv").write_text(
        BENCH_V1 + "\n1,984.14,0.00,0.00,0.00,0.00,16.60,2729\n10,3791.77,0.00,0.01,0.01,0.00,13.36,2711\n50,4079.19,0.01,0.03,0.04,0.00,14.50,2705\n"
    )
    slow, fast = (compare.clean_benchmark(results.read_first_layout(spark, str(tmp_path / f"{n}.csv"))) for n in ("slow", "fast"))
    found = {int(r["concurrency"]): round(r["speedup"], 1) for r in compare.speedup_by_level(slow, fast).collect()}
    assert found == {1: 73.1, 10: 49.1, 50: 54.7}
    best = compare.service_summary(compare.combine({"slow": slow, "fast": fast})).collect()
    assert {(r["service"], r["max_rps"], r["best_concurrency"], r["mem_mb"]) for r in best} == {
        ("slow", "77.3", "10", "3181"), ("fast", "4079.2", "50", "2705"),
    }


def test_no_files(spark, tmp_path):
    (tmp_path / "other.csv").write_text("a\n")
    with pytest.raises(FileNotFoundError):
        results.read_newest_results(spark, str(tmp_path))


def test_clean_fills_before_it_filters(spark):
    lines = [("1", "10", "1"), ("2", "bad", "1"), ("3", "30", "-1"), ("4", "0", "2"), ("0", "20", "1"), ("5", "70", None)]
    rows = spark.createDataFrame(lines, "concurrency string, rps string, latency_avg_ms string")
    found = sorted((r["concurrency"], r["rps"], r["latency_avg_ms"]) for r in compare.clean_benchmark(rows).collect())
    assert found == [(1.0, 10.0, 1.0), (2.0, 20.0, 1.0), (5.0, 70.0, 1.0)]


def test_ties_go_to_the_lowest_level(spark):
    rows = spark.createDataFrame([("s", 5, 9.0), ("s", 2, 9.0), ("s", 1, 3.0)], "service string, concurrency int, rps double")
    assert compare.best_levels(rows).first()["best_concurrency"] == 2


def test_melt_and_efficiency(spark):
    rows = spark.createDataFrame([(1, 100.0, 4.0, 1.0, 2.0, 3.0, 4.0)], "concurrency int, rps double, cpu_percent double, latency_avg_ms double, latency_p50_ms double, latency_p95_ms double, latency_p99_ms double")
    long = compare.latency_long(rows, ["concurrency"])
    assert {(r["metric"], r["latency"]) for r in long.collect()} == {("avg", 1.0), ("p50", 2.0), ("p95", 3.0), ("p99", 4.0)}
    assert compare.with_efficiency(rows).first()["efficiency"] == 20.0


REPORT = """
Summary:
  Total:\t60.0343 secs
  Slowest:\t0.1 secs
  Average:\t0.0521 secs
  Requests/sec:\t1,234.567

Latency distribution:
  10% in 0.0100 secs
  50% in 0.0500 secs
  95% in 0.0700 secs
  99% in 0.0800ms secs
Total: 99
"""


def test_report(spark, tmp_path):
    (tmp_path / "a.txt").write_text(REPORT)
    (tmp_path / "b.txt").write_text("Total: 1,000\nSuccess: 995\n")
    found = {r["path"][-5:]: r for r in results.parse_reports(results.read_reports(spark, str(tmp_path))).collect()}
    one, two = found["a.txt"], found["b.txt"]
    assert (one["rps"], one["latency_avg"], one["latency_p50"], one["latency_p95"], one["latency_p99"]) == (1234.57, 0.05, 0.05, 0.07, 0.08)
    assert (one["total_requests"], one["success_requests"], one["error_rate"], one["latency_p75"]) == (60.0343, None, 0.0, 0.0)
    assert (two["rps"], two["error_rate_cut"]) == (0.0, 1.0) and two["error_rate"] == pytest.approx(0.5)


def test_cpu(spark):
    counters = [("r", 1, 100, 0, 50, 1000, 0), ("r", 2, 150, 0, 60, 1040, 0), ("r", 3, 150, 0, 60, 1040, 0), ("q", 1, 1, 1, 1, 1, 1)]
    rows = spark.createDataFrame(counters, "run string, ts int, user long, nice long, system long, idle long, iowait long")
    found = sorted(map(tuple, resources.cpu_deltas(rows, ["run"], ["ts"]).collect()))
    assert found == [("r", 2, 50, 10, 40), ("r", 3, 0, 0, 100)]


def test_usage(spark):
    rows = spark.createDataFrame([("r", 10.0, 1.0, 2048.0), ("r", 20.0, 2.0, 4096.0)], "run string, cpu_user double, cpu_system double, mem_used_kb double")
    assert tuple(resources.resource_usage(rows, ["run"]).first()) == ("r", 16.5, 3)
    none = spark.createDataFrame([("r", None, None)], "run string, cpu_percent double, mem_mb double")
    assert tuple(resources.process_usage(none, ["run"]).first()) == ("r", 0.0, 0)


def test_samples(spark, tmp_path):
    path = tmp_path / "samples.csv"
    path.write_text("timestamp,cpu_percent,mem_mb\n1,12.5,100\n2,x,101\n")
    rows = results.read_samples(spark, str(path)).orderBy("timestamp").collect()
    assert [(r["cpu_percent"], r["mem_mb"]) for r in rows] == [(12.5, 100.0), (None, 101.0)]


def test_append_and_summary_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2.5)], "concurrency int, rps double")
    for _ in range(2):
        tables.append_csv(rows, str(tmp_path / "out"))
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "out")).collect()] == [(1, 2.5), (1, 2.5)]
    tables.write_summary(rows, str(tmp_path / "s"), "csv")
    tables.write_summary(rows, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1


def test_records(spark, tmp_path):
    rows = spark.createDataFrame([(0.75, True, "f", 4)], "prediction double, is_attack boolean, model_version string, features_used int")
    tables.write_records(rows, str(tmp_path / "r"))
    assert tables.read_records(spark, str(tmp_path / "r"), rows.schema).collect() == rows.collect()


def test_schemas():
    assert len(HOUSE) == 9 and len(FLOW) == 45 and len(text_schema(BENCH_V2)) == 12


def test_undefined_ratios_are_zero(spark):
    rows = spark.createDataFrame([(0, 0), (1, 0), (1, 2)], "y int, p int")
    found = {r["class"]: r for r in metrics.classification_report(rows, "y", "p").collect()}
    assert (found["2"]["precision"], found["2"]["recall"], found["2"]["f1"], found["2"]["support"]) == (0, 0, 0, 0)
    assert found["0"]["precision"] == 0.5 and found["accuracy"]["f1"] == pytest.approx(1 / 3)
    assert found["macro avg"]["recall"] == pytest.approx(1 / 3)


def test_r2_of_constant_target(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "y double, p double")
    assert metrics.regression_metrics(rows, "y", "p").first()["r2"] == 1.0
    assert metrics.regression_metrics(rows.withColumn("p", F.lit(2.0)), "y", "p").first()["r2"] == 0.0


def test_service_names_with_digits(spark, tmp_path):
    (tmp_path / "go-1_B_benchmark_1.csv").write_text("concurrency\n1\n")
    assert [r["service"] for r in results.newest_files(spark, str(tmp_path)).collect()] == ["go-1_B"]
