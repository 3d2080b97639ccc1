"""Runs of load levels, samples joined by time, appended runs, sketches and continuing streams."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from quarrylight.operators import loadlog, percentiles, profile, resources, sampling
from quarrylight.session import new_folder
from quarrylight.sources import tables
from quarrylight.streaming import scoring

START = datetime.datetime(2024, 3, 1)


@pytest.fixture(scope="module")
def log(spark):
    draw, rows, at = random.Random(1), [], 0.0
    for i in range(900):
        at += draw.choice([0.5, 1, 3, 9.9, 10, 10.1, 60])
        rows.append((i, draw.choice(["a", "b", None]), START + datetime.timedelta(seconds=at), draw.random() * 100))
    rows.append((900, "a", None, 5.0))
    return spark.createDataFrame(rows, "id long, level string, ts timestamp, latency double")


@pytest.mark.parametrize("gap", [10, 30])
def test_runs_are_session_windows(log, gap):
    found = loadlog.runs(log, ["level"], "ts", gap)
    window = F.session_window("ts", f"{gap} seconds")
    want = log.where("ts IS NOT NULL").groupBy("level", window.alias("w")).agg(F.min("ts"), F.max("ts"))
    got = sorted(map(str, found.select("level", "run_start", "run_end").collect()))
    assert [x.replace("run_start", "").replace("run_end", "") for x in got] == sorted(
        str(r).replace("min(ts)", "").replace("max(ts)", "") for r in want.drop("w").collect()
    )
    numbers = {}
    for r in found.orderBy("run_start").collect():
        numbers.setdefault(r["level"], []).append(r["run"])
    assert all(x == list(range(1, len(x) + 1)) for x in numbers.values())


def test_each_run_warms_up(log):
    marked = loadlog.with_runs(log, ["level"], "ts", 30).collect()
    kept = {r["id"] for r in loadlog.without_warm_up(log, ["level"], "ts", 5, gap=30).collect()}
    assert kept == {r["id"] for r in marked if r["ts"] >= r["run_start"] + datetime.timedelta(seconds=5)}
    once = {r["id"] for r in loadlog.without_warm_up(log, ["level"], "ts", 5).collect()}
    assert kept < once | kept and len(once) > len(kept)


@pytest.mark.parametrize("bucket", [1, 60, 100_000])
def test_samples_meet_runs(spark, log, bucket):
    runs = loadlog.runs(log, ["level"], "ts", 30)
    draw = random.Random(2)
    samples = spark.createDataFrame(
        [(START + datetime.timedelta(seconds=draw.randrange(9000)), float(draw.randrange(100)), draw.randrange(1000)) for _ in range(300)]
        + [(None, 1.0, 1)], "ts timestamp, cpu_percent double, mem_mb int",
    )
    spans, taken = runs.collect(), samples.where("ts IS NOT NULL").collect()
    joined = resources.samples_in_runs(samples, runs, bucket_seconds=bucket)
    assert joined.count() == sum(s["run_start"] <= t["ts"] <= s["run_end"] for s in spans for t in taken)
    got = {(r["level"], r["run"]): r["cpu_percent"] for r in resources.usage_by_run(samples, runs, ["level"], bucket_seconds=bucket).collect()}
    assert len(got) == len(spans)
    for s in spans:
        inside = [t["cpu_percent"] for t in taken if s["run_start"] <= t["ts"] <= s["run_end"]]
        assert abs(got[s["level"], s["run"]] - (sum(inside) / len(inside) if inside else 0)) <= 0.0501
    assert "CartesianProduct" not in joined._jdf.queryExecution().toString() and "BroadcastNestedLoop" not in joined._jdf.queryExecution().toString()


def test_blank_samples(spark):
    rows = spark.createDataFrame([("r", 10.0, 4), ("r", None, None)], "run string, cpu_percent double, mem_mb int")
    assert resources.process_usage(rows, ["run"]).first()[1:] == (10.0, 4)
    assert resources.process_usage(rows, ["run"], blanks_as_zero=True).first()[1:] == (5.0, 2)


def test_append_is_idempotent(spark):
    folder = new_folder(spark, "runs")
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "x")], "n long, run string, tool string")
    later = spark.createDataFrame([(4, "c", "x"), (5, "b", "y")], "n long, run string, tool string")
    for batch in (rows, later, rows, later, rows.where("run = 'a'")):
        tables.append_runs(batch, folder, ["tool", "run"])
    assert sorted(r["n"] for r in spark.read.parquet(folder).collect()) == [1, 2, 3, 4, 5]


def test_merged_latencies(spark):
    draw = random.Random(3)
    rows = [("hot" if i % 3 else f"l{i % 4}", i % 7, float(int(draw.gauss(0, 1) ** 2 * 1000))) for i in range(20_000)] + [("hot", 1, None), ("hot", 1, float("nan"))]
    df = spark.createDataFrame(rows, "level string, run int, latency double").repartition(5)
    folder, wanted = new_folder(spark, "sketches"), [0.99, 0.5, 0.9]
    loadlog.latency_sketches(df, ["level", "run"], "latency").write.parquet(folder)
    merged = loadlog.merge_latencies(spark.read.parquet(folder), ["level"])
    exact = {r["level"]: r for r in percentiles.exact_percentiles(df, ["latency"], wanted, by=["level"]).collect()}
    values = {}
    for level, _, x in rows:
        if x == x and x is not None:
            values.setdefault(level, []).append(x)
    for r in loadlog.sketched_percentiles(merged, ["level"], wanted).collect():
        own = values[r["level"]]
        assert r["n"] == len(own)
        for p in wanted:
            x = r[f"latency_p{round(p * 100)}"]
            below, upto = sum(v < x for v in own) / len(own), sum(v <= x for v in own) / len(own)
            assert below - loadlog.rank_error() <= p <= upto + loadlog.rank_error()
    for limits in ({}, {"settle": 100, "sketch_rows": 2000}):
        brackets = [f"{s}{i}" for i in range(3) for s in ("lo", "hi")]
        margin = 2 * loadlog.rank_error()
        bounds = [F.kll_sketch_get_quantile_double("sketch", F.lit(min(1.0, max(0.0, p + d)))) for p in wanted for d in (-margin, margin)]
        known = merged.select("level", *[b.alias(n) for b, n in zip(bounds, brackets, strict=True)])
        for shift in (0, 500):  # also with brackets that miss
            moved = known.select("level", *[(F.col(c) + shift).alias(c) for c in brackets])
            got = percentiles.bracketed_percentiles(df, "latency", wanted, ["level"], moved, **limits).collect()
            assert {r["level"]: (r["n"], r["percentiles"]) for r in got} == {k: (r["n"], r["percentiles"]) for k, r in exact.items()}
    refined = {r["level"]: r for r in loadlog.refined_percentiles(df, merged, ["level"], "latency", wanted).collect()}
    assert all([refined[k][f"latency_p{round(p * 100)}"] for p in wanted] == r["percentiles"] for k, r in exact.items())


def counted(spark, rows, scans):
    """A table that counts how often each of its partitions is read."""
    def read(batches):
        scans.add(1)
        yield from batches
    return rows.mapInArrow(read, rows.schema)


def test_drop_reasons_take_two_scans(spark):
    n, scans = 3000, spark.sparkContext.accumulator(0)
    wide = {f"c{i}": (F.col("id") * 7919 % (75 * i + 1)).cast("string" if i % 2 else "double") for i in range(40)}
    rows = spark.range(n, numPartitions=1).select("id", *[c.alias(k) for k, c in wide.items()], F.lit(None).cast("int").alias("none"), F.lit(1.0).alias("Attack"))
    reasons = profile.drop_reasons(counted(spark, rows, scans))
    assert scans.value == 2 and len(reasons) == 43
    exact = {r["column"]: r["drop_reason"] for r in profile.profile_columns(rows).collect()}
    assert reasons == exact and set(exact.values()) == {None, "distinct", "nulls", "name"}
    few = spark.accumulator(0) if hasattr(spark, "accumulator") else spark.sparkContext.accumulator(0)
    profile.drop_reasons(counted(spark, rows.select("id", "c3"), few))
    assert few.value == 1  # no sketch lies near the limit


def test_sketches_merge(spark):
    rows = spark.range(5000).select((F.col("id") % 1700).alias("a"), F.when(F.col("id") % 3 > 0, -0.0 * F.col("id")).alias("z"), F.lit(float("nan")).alias("q"))
    parts = [profile.column_sketches(rows.where(f"a % 3 = {i}")) for i in range(3)]
    merged = {r["column"]: r for r in profile.sketched_counts(profile.merge_sketches(parts[0].unionAll(parts[1]).unionAll(parts[2]))).collect()}
    assert abs(merged["a"]["distinct"] - 1700) <= 1700 * profile.MARGIN and merged["a"]["rows"] == 5000
    assert (merged["z"]["distinct"], merged["z"]["nulls"]) == (1, 1667) and (merged["q"]["distinct"], merged["q"]["nulls"]) == (0, 5000)
    exact = {r["column"]: r["distinct"] for r in profile.distinct_together(rows, rows.columns).collect()}
    assert exact == {"a": 1700, "z": 1}
    assert profile.drop_reasons(rows.limit(0)) == {"a": None, "z": None, "q": None}


def test_samples_take_two_scans(spark):
    scans = spark.sparkContext.accumulator(0)
    rows = spark.range(6000, numPartitions=1).select("id", F.when(F.col("id") % 10 < 6, "hot").when(F.col("id") % 10 < 9, "b").alias("k"))
    taken = sampling.balance(counted(spark, rows, scans), ["id"], "k", sample_rows=500, small_class_rows=0)
    got = {r["k"]: r["count"] for r in taken.groupBy("k").count().collect()}
    assert got == {"hot": 300, "b": 150, None: 50} and scans.value == 2
    marked = sampling.stratified_split(rows, ["id"], "k", share=500 / 6000)
    assert {r["id"] for r in taken.collect()} == {r["id"] for r in marked.where("split = 'test'").collect()}
    deep = sampling.balance(rows, ["id"], "k", sample_rows=500, small_class_rows=0, edge_rows=0)
    assert {r["id"] for r in deep.collect()} == {r["id"] for r in taken.collect()}


def event(minute, kind="x", value=1):
    return (START + datetime.timedelta(minutes=minute), kind, value)


def test_counters_go_on_after_a_restart(spark):
    """Two arrivals with a restart between them: late requests count in their stretch, those behind the watermark do not."""
    folder, schema = new_folder(spark, "counters"), "ts timestamp, kind string, value long"

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        query = scoring.start_counters(stream, "ts", "value", ["kind"], f"{folder}/out", f"{folder}/state", "5 minutes", "10 minutes")
        query.awaitTermination()
        found = scoring.current_counters(spark, f"{folder}/out", ["kind"]).collect()
        return {(int((r["begins"] - START).total_seconds() / 60), r["kind"]): (r["requests"], r["duration"], r["slowest"]) for r in found}

    assert arrive([event(0), event(1, value=5), event(7, "y")]) == {(0, "x"): (2, 6, 5), (5, "y"): (1, 1, 1)}
    assert arrive([event(2), event(30), event(31)]) == {(0, "x"): (3, 7, 5), (5, "y"): (1, 1, 1), (30, "x"): (2, 2, 1)}
    after = {(0, "x"): (3, 7, 5), (5, "y"): (1, 1, 1), (25, "x"): (1, 9, 9), (30, "x"): (2, 2, 1)}
    assert arrive([event(3), event(26, value=9)]) == after  # minute 3 is behind the watermark, 26 is late but within it
    merged = scoring.merged_counters(scoring.current_counters(spark, f"{folder}/out", ["kind"]), ["kind"]).collect()
    assert {r["kind"]: (r["requests"], r["slowest"], r["avg_time"]) for r in merged} == {"x": (6, 9, 3.0), "y": (1, 1, 1.0)}


def test_trigger_is_a_parameter(spark):
    folder, schema = new_folder(spark, "running"), "ts timestamp, kind string, value long"
    spark.createDataFrame([event(0), event(1)], schema).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
    query = scoring.start_health(stream, "value", ["kind"], f"{folder}/out", f"{folder}/state", trigger={"processingTime": "1 second"})
    try:
        query.processAllAvailable()
        spark.createDataFrame([event(2)], schema).write.mode("append").parquet(f"{folder}/in")
        query.processAllAvailable()
        assert query.isActive
    finally:
        query.stop()
    assert scoring.newest_state(spark, f"{folder}/out").first()["requests_processed"] == 3
