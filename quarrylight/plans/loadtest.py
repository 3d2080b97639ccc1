"""Request logs, load-test results, resource samples and service comparison, from the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions.times import epoch_seconds
from quarrylight.operators import compare, loadlog, metrics, resources
from quarrylight.session import evaluate_once, new_folder
from quarrylight.sources import results
from quarrylight.sources.tables import append_csv, append_runs, read_csv, read_table, write_summary

LEVEL = ["event_type", "concurrency"]


def _log(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a request log: type as service, user_id % 7 as load level, value as latency."""
    return read_table(spark, sf, "events").select(
        "event_id",
        "event_type",
        (F.col("user_id") % 7).alias("concurrency"),
        "user_id",
        "ts",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def _rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


LOAD_FLOATS = ["seconds", "latency_avg", "latency_p50", "latency_p75", "latency_p90", "latency_p95", "latency_p99", "rps", "error_rate"]


def load_summary(spark: SparkSession, sf: str) -> DataFrame:
    log = loadlog.without_warm_up(_log(spark, sf), LEVEL, "ts")
    return _rounded(loadlog.load_summary(log, LEVEL, "ts", "value", F.col("k") < 95), LOAD_FLOATS)


RUN_GAP, RUN_WARM_UP = 1800, 600


def load_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Levels that were run several times: half an hour without a request ends a run, and each warms up on its own."""
    log = loadlog.without_warm_up(_log(spark, sf), ["event_type"], "ts", RUN_WARM_UP, gap=RUN_GAP)
    out = loadlog.load_summary(log, ["event_type", "run"], "ts", "value", F.col("k") < 95, [0.5, 0.95])
    return _rounded(out, ["seconds", "latency_avg", "latency_p50", "latency_p95", "rps", "error_rate"])


def run_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Mean CPU and memory of one sample log for every run of every level, joined by time."""
    log = _log(spark, sf)
    samples = log.where("user_id % 2 = 0").select("ts", F.col("k").alias("cpu_percent"), (F.col("event_id") + 9000).alias("mem_mb"))
    runs = loadlog.runs(log.where("user_id % 2 = 1"), ["event_type"], "ts", RUN_GAP)
    out = resources.usage_by_run(samples, runs, ["event_type"], bucket_seconds=RUN_GAP)
    return out.select("event_type", "run", F.date_format("run_start", "yyyy-MM-dd HH:mm:ss").alias("run_start"), "cpu_percent", "mem_mb")


def latency_sketch(spark: SparkSession, sf: str) -> DataFrame:
    """Latency sketches stored for every user, merged per type, and refined.

    Whether the rank of each merged figure is within the stated error, and the exact figures.
    """
    log, folder = _log(spark, sf), new_folder(spark, "sketches")
    loadlog.latency_sketches(log, ["event_type", "user_id"], "value").write.parquet(folder)
    merged = loadlog.merge_latencies(spark.read.parquet(folder), ["event_type"])
    wanted = [0.5, 0.95, 0.99]
    near = loadlog.sketched_percentiles(merged, ["event_type"], wanted)
    error = loadlog.rank_error()

    def reached(p: float):
        name = f"latency_p{round(p * 100)}"
        below, upto = (F.avg((op).cast("int")) for op in (F.col("value") < F.col(name), F.col("value") <= F.col(name)))
        return (below <= p + error) & (upto >= p - error)

    checked = log.join(near.drop("n"), "event_type").groupBy("event_type").agg(
        (reached(wanted[0]) & reached(wanted[1]) & reached(wanted[2])).alias("within")
    )
    exact = loadlog.refined_percentiles(log, merged, ["event_type"], "value", wanted)
    return _rounded(exact.join(checked, "event_type"), [f"latency_p{round(p * 100)}" for p in wanted])


def append_retried(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches of runs appended, the first one twice as by a job that was tried again; every row is there once."""
    folder = new_folder(spark, "runs")
    bench = _bench(spark, sf).select("service", "concurrency", "user_id", F.round("rps", 6).alias("rps"))
    first = bench.where("service IN ('view', 'click')")
    append_runs(first, folder, ["service"])
    append_runs(bench.where("service NOT IN ('view', 'click')"), folder, ["service"])
    append_runs(first, folder, ["service"])
    return spark.read.schema(bench.schema).parquet(folder)


def request_sequence(spark: SparkSession, sf: str) -> DataFrame:
    events = read_table(spark, sf, "events").select("event_id", "ts")
    out = loadlog.request_sequence(events, ["ts", "event_id"])
    ts_type = dict(events.dtypes)["ts"]
    return out.select(
        "event_id", F.col("request_no").cast("bigint").alias("request_no"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), F.floor(epoch_seconds(F.col("ts"), ts_type)).cast("bigint").alias("epoch"),
    )


def running_health(spark: SparkSession, sf: str) -> DataFrame:
    events = read_table(spark, sf, "events").select("event_id", "ts", F.col("value").cast("decimal(18,2)").alias("value"))
    out = loadlog.running_health(events, ["ts", "event_id"], "value")
    return out.select(
        "event_id", F.col("requests_processed").cast("bigint").alias("requests_processed"),
        "avg_time",
    )


def health(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(loadlog.health(read_table(spark, sf, "events"), "value", 116, "forest"), ["avg_time"])


def _raw_results(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as one row of a result file, with broken numbers among the text."""
    log = _log(spark, sf)
    text = F.col("value").cast("decimal(12,2)").cast("string")
    return log.select(
        "event_id",
        F.col("event_type").alias("service"),
        F.col("concurrency").cast("string").alias("concurrency"),
        F.when(F.col("k") == 7, "n/a").when(F.col("k") == 8, "0.00").otherwise(text).alias("rps"),
        F.when(F.col("k") == 9, F.concat(F.lit("-"), text)).otherwise(text).alias("latency_avg_ms"),
        F.when(F.col("k") == 10, "").otherwise(F.col("k").cast("string")).alias("cpu_percent"),
    )


def clean_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    out = compare.clean_benchmark(_raw_results(spark, sf), by=["service"])
    return _rounded(out, ["concurrency", "rps", "latency_avg_ms", "cpu_percent"], 4)


def _bench(spark: SparkSession, sf: str) -> DataFrame:
    """A result table: one row per service, load level and user, that is several runs per level."""
    return _log(spark, sf).groupBy(
        F.col("event_type").alias("service"), "concurrency", "user_id"
    ).agg(
        F.count(F.lit(1)).cast("double").alias("rps"),
        (F.sum(F.col("value").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))).alias("latency_avg_ms"),
        F.min("value").alias("latency_p50_ms"),
        F.max("value").alias("latency_p95_ms"),
        F.max("value").alias("latency_p99_ms"),
        F.avg("k").alias("cpu_percent"),
        F.max("k").alias("mem_mb"),
        (F.count_if(F.col("k") >= 95) * 100 / F.count(F.lit(1))).alias("error_rate"),
    ).withColumn("rps", F.col("rps") * 100 + F.col("user_id") / 1000)


def best_level(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(compare.best_levels(_bench(spark, sf)), ["max_rps"])


def speedup_by_level(spark: SparkSession, sf: str) -> DataFrame:
    bench = _bench(spark, sf)
    out = compare.speedup_by_level(bench.where("service = 'click'"), bench.where("service = 'view'"))
    return _rounded(out, ["speedup"])


def overall_speedup(spark: SparkSession, sf: str) -> DataFrame:
    bench = _bench(spark, sf)
    both = compare.combine(
        {"base": bench.where("service = 'click'").drop("service"), "other": bench.where("service = 'view'").drop("service", "mem_mb")}
    )
    return _rounded(compare.overall_speedup(both, "base", "other"), ["base_rps", "other_rps", "speedup"])


def efficiency(spark: SparkSession, sf: str) -> DataFrame:
    return compare.with_efficiency(_bench(spark, sf)).select("service", "concurrency", "user_id", "efficiency")


def latency_long(spark: SparkSession, sf: str) -> DataFrame:
    return compare.latency_long(_bench(spark, sf), ["service", "concurrency", "user_id"])


def service_summary(spark: SparkSession, sf: str) -> DataFrame:
    means = ["max_rps", "latency_avg_ms", "latency_p99_ms", "cpu_percent", "mem_mb", "error_rate"]
    return _rounded(compare.service_means(_bench(spark, sf)), means, 4)


def summary_text(spark: SparkSession, sf: str) -> DataFrame:
    """The whole summary as shown."""
    return compare.service_summary(_bench(spark, sf))


def load_levels(spark: SparkSession, sf: str) -> DataFrame:
    return compare.levels(_bench(spark, sf))


def _counters(spark: SparkSession, sf: str) -> DataFrame:
    log = _log(spark, sf)
    minutes = F.floor(epoch_seconds(F.col("ts"), dict(log.dtypes)["ts"]) / 60).cast("bigint")
    return log.select(
        F.col("event_type").alias("run"),
        "ts",
        "event_id",
        (F.col("event_id") * 2 + F.col("user_id")).alias("user"),
        F.lit(0).cast("bigint").alias("nice"),
        (F.col("event_id") + F.col("k")).alias("system"),
        minutes.alias("idle"),
        (F.col("user_id") % 3).alias("iowait"),
        F.col("k").cast("bigint").alias("irq"),
        F.lit(1).cast("bigint").alias("softirq"),
    )


def cpu_deltas(spark: SparkSession, sf: str) -> DataFrame:
    return resources.cpu_deltas(_counters(spark, sf), ["run"], ["ts", "event_id"]).drop("ts")


def cpu_deltas_with_interrupts(spark: SparkSession, sf: str) -> DataFrame:
    return resources.cpu_deltas(_counters(spark, sf), ["run"], ["ts", "event_id"], interrupts=True).drop("ts")


def resource_usage(spark: SparkSession, sf: str) -> DataFrame:
    samples = _log(spark, sf).select(
        F.col("event_type").alias("run"),
        (F.col("k") / 2).alias("cpu_user"),
        (F.col("user_id") / 10).alias("cpu_system"),
        resources.used_kb(F.col("event_id") * 1024 + 9_000_000, F.col("k") * 1000).alias("mem_used_kb"),
    )
    return _rounded(resources.resource_usage(samples, ["run"]), ["cpu_percent"])


def process_usage(spark: SparkSession, sf: str) -> DataFrame:
    samples = _log(spark, sf).select(
        F.col("event_type").alias("run"),
        F.when(F.col("k") > 3, F.col("k")).alias("cpu_percent"),
        resources.whole_mb(F.col("event_id") * 700 + 9_000_000).alias("mem_mb"),
    )
    return resources.process_usage(samples, ["run"])


def process_usage_blanks(spark: SparkSession, sf: str) -> DataFrame:
    """The same with blank samples counted as 0."""
    samples = _log(spark, sf).select(
        F.col("event_type").alias("run"), F.when(F.col("k") > 30, F.col("k")).alias("cpu_percent"),
        F.when(F.col("k") > 30, F.col("event_id")).alias("mem_mb"),
    )
    return resources.process_usage(samples, ["run"], blanks_as_zero=True)


def _reports(spark: SparkSession, sf: str) -> DataFrame:
    """Every order line as the text report of one load run."""
    lines = read_table(spark, sf, "lineitem")
    number = lambda c: F.col(c).cast("decimal(12,2)").cast("string")
    thousands = F.concat(F.lit("1,"), F.lpad((F.col("l_partkey") % 1000).cast("string"), 3, "0"))
    report = F.concat(
        F.lit("\nSummary:\n  Total:\t"), thousands, F.lit("\n  Average:\t"), number("l_quantity"),
        F.lit("ms\n  Requests/sec:\t"), F.format_number(F.col("l_extendedprice").cast("decimal(12,2)"), 2),
        F.lit("\n\nLatency distribution:\n  50% in "), number("l_discount"), F.lit(" secs\n  75% in "),
        number("l_tax"), F.lit(" secs\n  90% in "), number("l_discount"), F.lit(" secs\n  95% in "), number("l_tax"),
        F.lit(" secs\n  99% in "), number("l_quantity"), F.lit(" secs\n"),
        F.when(F.col("l_linestatus") == "O", F.concat(F.lit("  Success:\t"), (F.col("l_partkey") % 1000).cast("string"), F.lit("\n"))).otherwise(""),
    )
    built = evaluate_once(lines, {"value": report})
    return built.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "value")


def report_text_parse(spark: SparkSession, sf: str) -> DataFrame:
    out = results.parse_reports(_reports(spark, sf))
    return _rounded(out, ["error_rate"])


def report_files(spark: SparkSession, sf: str) -> DataFrame:
    """One report file per service, written, read back whole and parsed."""
    folder = new_folder(spark, "reports")
    text = F.concat(
        F.lit("Summary:\n  Requests/sec:\t"), F.count(F.lit(1)).cast("string"), F.lit("\n  Total:\t"),
        F.max("event_id").cast("string"), F.lit("\n"),
    )
    per_service = read_table(spark, sf, "events").groupBy("event_type").agg(text.alias("value"))
    per_service.repartition("event_type").write.partitionBy("event_type").text(folder)
    found = results.read_reports(spark, f"{folder}/event_type=*")
    parsed = results.parse_reports(found.withColumn("service", F.regexp_extract("path", "event_type=([a-z]+)", 1)))
    return parsed.select("service", "rps", "total_requests", "error_rate")


def benchmark_append(spark: SparkSession, sf: str) -> DataFrame:
    """Summary rows appended per service to a CSV table and read back with inferred types."""
    folder = new_folder(spark, "results")
    bench = _bench(spark, sf).groupBy("service", "concurrency").agg(F.round(F.max("rps"), 3).alias("rps"))
    append_csv(bench.where("service = 'view'"), folder)
    append_csv(bench.where("service <> 'view'"), folder)
    return read_csv(spark, folder).select("service", F.col("concurrency").cast("bigint").alias("concurrency"), "rps")


def samples_from_files(spark: SparkSession, sf: str) -> DataFrame:
    """Resource samples written as CSV, one folder for each run, read back and averaged.

    Blank figures are missing and stay out of the means.
    """
    folder = new_folder(spark, "samples")
    header = results.SAMPLES_V2.split(",")
    log = _log(spark, sf)
    figures = [c for c in header if c != "timestamp"]
    wanted = {c: F.when(F.col("k") % 5 > 0, F.col("k") + i).cast("string") for i, c in enumerate(figures)}
    samples = log.select(F.col("event_type").alias("run"), F.col("ts").cast("string").alias("timestamp"),
                         *[v.alias(c) for c, v in wanted.items()])
    samples.select("run", *header).write.partitionBy("run").option("header", True).csv(folder)
    read = results.read_samples(spark, folder).withColumn("run", F.regexp_extract(F.col("_metadata.file_path"), "/run=([^/]+)/", 1))
    return read.groupBy("run").agg(F.count(F.lit(1)).alias("samples"), *[F.round(F.avg(c), 6).alias(c) for c in figures])


def summary_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The shown summary written as CSV and as Parquet and read back; both hold the same rows."""
    shown = compare.service_summary(_bench(spark, sf))
    names, folder = shown.columns, new_folder(spark, "summary")
    write_summary(shown, f"{folder}/csv", "csv")
    write_summary(shown, f"{folder}/parquet")
    text = spark.read.option("header", True).csv(f"{folder}/csv").withColumn("form", F.lit("csv"))
    table = spark.read.parquet(f"{folder}/parquet").withColumn("form", F.lit("parquet"))
    return text.unionByName(table).select("form", *[F.col(c).cast("string").alias(c) for c in names])


def newest_file(spark: SparkSession, sf: str) -> DataFrame:
    """Two generations of result files per service; the newer ones are found, read and cleaned."""
    folder = new_folder(spark, "generations")
    header = results.BENCH_V2.split(",")
    bench = _bench(spark, sf)
    absent = {c: F.lit(None).cast("string") for c in header if c not in bench.columns}
    rows = bench.withColumns(absent).select("service", *[F.col(c).cast("string").alias(c) for c in header])
    for generation, factor in (("first", 2), ("second", 1)):
        table = rows.withColumn("rps", (F.col("rps").cast("double") * factor).cast("string"))
        named = table.withColumn("run", F.concat("service", F.lit(f"_benchmark_{generation}"))).drop("service")
        named.write.partitionBy("run").option("header", True).csv(f"{folder}/{generation}")
    newest = results.read_newest_results(spark, folder)  # the folders are named run=<service>_benchmark_<generation>
    cleaned = compare.clean_benchmark(newest.withColumn("service", F.replace("service", F.lit("run="))), by=["service"])
    return cleaned.groupBy("service").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.max("rps"), 6).alias("max_rps")
    )


def binary_report(spark: SparkSession, sf: str) -> DataFrame:
    """Toxic as the prediction of quality."""
    out = metrics.classification_report(read_table(spark, sf, "labels"), "quality", "toxic")
    return _rounded(out, ["precision", "recall", "f1"], 9)


def class_report_many(spark: SparkSession, sf: str) -> DataFrame:
    """Three classes: the return flag guessed from the line number."""
    lines = read_table(spark, sf, "lineitem").withColumn(
        "guess", F.when(F.col("l_linenumber") < 3, "A").when(F.col("l_linenumber") < 5, "N").otherwise("X")
    )
    return _rounded(metrics.class_report(lines, "l_returnflag", "guess"), ["precision", "recall", "f1"], 9)


def accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.accuracy(read_table(spark, sf, "labels"), "quality", "toxic"), ["accuracy"], 9)


def regression_metrics(spark: SparkSession, sf: str) -> DataFrame:
    lines = read_table(spark, sf, "lineitem").withColumn("guess", F.col("l_quantity") * 2000)
    return _rounded(metrics.regression_metrics(lines, "l_extendedprice", "guess"), ["rmse", "r2"], 4)


QUERIES = {
    f.__name__: f
    for f in (
        load_summary, request_sequence, running_health, health, clean_benchmark, best_level, speedup_by_level,
        overall_speedup, efficiency, latency_long, service_summary, summary_text, load_levels, cpu_deltas,
        cpu_deltas_with_interrupts, resource_usage, process_usage, report_text_parse, report_files, benchmark_append,
        load_runs, run_usage, latency_sketch, append_retried, process_usage_blanks, samples_from_files, summary_roundtrip, newest_file, binary_report, class_report_many, accuracy, regression_metrics,
    )
}

_LOG = """g AS (SELECT event_id, event_type, user_id % 7 AS concurrency, user_id, ts, value,
    CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)"""
_BENCH = f"""{_LOG}, b AS (SELECT event_type AS service, concurrency, user_id,
    count(*) * 100.0 + user_id / 1000 AS rps, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS latency_avg_ms, min(value) AS latency_p50_ms,
    max(value) AS latency_p95_ms, max(value) AS latency_p99_ms, avg(k) AS cpu_percent, max(k) AS mem_mb,
    count(*) FILTER (k >= 95) * 100 / count(*) AS error_rate
    FROM g GROUP BY event_type, concurrency, user_id)"""
_BEST = "o AS (SELECT service, max(rps) AS max_rps, arg_max(concurrency, rps) AS best_concurrency FROM b GROUP BY 1)"


def _cpu_sql(total: str) -> str:
    return f"""
        WITH {_LOG}, c AS (SELECT event_type AS run, ts, event_id, event_id * 2 + user_id AS u, event_id + k AS s,
            CAST(floor(epoch(ts)) AS BIGINT) // 60 AS i, user_id % 3 AS w, k FROM g),
        d AS (SELECT run, event_id, u - lag(u) OVER w AS du, s - lag(s) OVER w AS ds, {total} - lag({total}) OVER w AS dt
              FROM c WINDOW w AS (PARTITION BY run ORDER BY ts, event_id)),
        p AS (SELECT run, event_id, CASE WHEN dt <= 0 THEN 0 ELSE (du * 100) // dt END AS cpu_user,
              CASE WHEN dt <= 0 THEN 0 ELSE (ds * 100) // dt END AS cpu_system FROM d WHERE dt IS NOT NULL)
        SELECT run, event_id, cpu_user, cpu_system, 100 - cpu_user - cpu_system AS cpu_idle FROM p"""


def _report_sql(table: str, label: str, guess: str) -> str:
    """Per-class figures from conditional sums over the rows themselves."""
    return f"""k AS (SELECT {label} AS class FROM {table} UNION SELECT {guess} FROM {table}),
        s AS (SELECT class, sum(CASE WHEN {label} = class AND {guess} = class THEN 1 ELSE 0 END) AS hits,
                     sum(CASE WHEN {guess} = class THEN 1 ELSE 0 END) AS predicted,
                     sum(CASE WHEN {label} = class THEN 1 ELSE 0 END) AS support FROM {table}, k GROUP BY class),
        x AS (SELECT class, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS precision,
                     CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall, CAST(support AS BIGINT) AS support FROM s),
        y AS (SELECT class, precision, recall, CASE WHEN precision + recall > 0
                     THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1, support FROM x)"""


_SHOWN = f"""
        WITH {_BENCH}, {_BEST} SELECT service, printf('%.1f', CAST(max_rps AS DOUBLE)) AS max_rps,
        CAST(best_concurrency AS VARCHAR) AS best_concurrency, printf('%.2f', CAST(avg(latency_avg_ms) AS DOUBLE)) AS latency_avg_ms,
        printf('%.2f', CAST(avg(latency_p99_ms) AS DOUBLE)) AS latency_p99_ms, printf('%.1f', CAST(avg(cpu_percent) AS DOUBLE)) AS cpu_percent,
        printf('%.0f', CAST(avg(mem_mb) AS DOUBLE)) AS mem_mb, printf('%.2f', CAST(avg(error_rate) AS DOUBLE)) AS error_rate
        FROM b JOIN o USING (service) WHERE concurrency = best_concurrency GROUP BY service, max_rps, best_concurrency"""

_RUNS = f"""
        n AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL {RUN_GAP} SECONDS OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new
              FROM h WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
        r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS BIGINT) AS run FROM n),
        s AS (SELECT event_type, run, min(ts) AS run_start, max(ts) AS run_end FROM r GROUP BY 1, 2)"""

SQL = {
    "load_runs": f"""
        WITH {_LOG}, h AS (SELECT * FROM g), {_RUNS},
        k AS (SELECT r.* FROM r JOIN s USING (event_type, run) WHERE ts >= run_start + INTERVAL {RUN_WARM_UP} SECONDS),
        a AS (SELECT event_type, run, count(*) AS total_requests, count(*) FILTER (k < 95) AS success_requests,
              (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds, avg(value) AS latency_avg,
              quantile_cont(value, [0.5, 0.95]) AS q FROM k GROUP BY 1, 2)
        SELECT event_type, run, total_requests, success_requests, round(seconds, 6) AS seconds,
               round(latency_avg, 6) AS latency_avg, round(q[1], 6) AS latency_p50, round(q[2], 6) AS latency_p95,
               round(CASE WHEN seconds > 0 THEN total_requests / seconds ELSE 0 END, 6) AS rps,
               round((1.0 - success_requests / total_requests) * 100, 6) AS error_rate,
               CAST(100 - (success_requests * 100) // total_requests AS DOUBLE) AS error_rate_cut FROM a""",
    "run_usage": f"""
        WITH {_LOG}, h AS (SELECT * FROM g WHERE user_id % 2 = 1), {_RUNS},
        p AS (SELECT ts, k AS cpu, event_id + 9000 AS mem FROM g WHERE user_id % 2 = 0)
        SELECT event_type, run, strftime(run_start, '%Y-%m-%d %H:%M:%S') AS run_start,
               coalesce(round(avg(cpu), 1), 0) AS cpu_percent, CAST(coalesce(round(avg(mem)), 0) AS BIGINT) AS mem_mb
        FROM s LEFT JOIN p ON p.ts BETWEEN run_start AND run_end GROUP BY event_type, run, s.run_start""",
    "latency_sketch": """
        SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS latency_p50,
               round(quantile_cont(value, 0.95), 6) AS latency_p95, round(quantile_cont(value, 0.99), 6) AS latency_p99, true AS within
        FROM events GROUP BY 1""",
    "append_retried": f"WITH {_BENCH} SELECT service, concurrency, user_id, round(rps, 6) AS rps FROM b",
    "process_usage_blanks": f"""
        WITH {_LOG} SELECT event_type AS run, round(avg(CASE WHEN k > 30 THEN k ELSE 0 END), 1) AS cpu_percent,
        CAST(round(avg(CASE WHEN k > 30 THEN event_id ELSE 0 END)) AS BIGINT) AS mem_mb FROM g GROUP BY 1""",
    "load_summary": f"""
        WITH {_LOG}, s AS (SELECT event_type, concurrency, min(ts) AS start FROM g GROUP BY 1, 2),
        k AS (SELECT g.* FROM g JOIN s USING (event_type, concurrency) WHERE ts >= start + INTERVAL 5 SECONDS),
        a AS (SELECT event_type, concurrency, count(*) AS total_requests, count(*) FILTER (k < 95) AS success_requests,
              (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds, avg(value) AS latency_avg,
              quantile_cont(value, [0.5, 0.75, 0.9, 0.95, 0.99]) AS q FROM k GROUP BY 1, 2)
        SELECT event_type, concurrency, total_requests, success_requests, round(seconds, 6) AS seconds,
               round(latency_avg, 6) AS latency_avg, round(q[1], 6) AS latency_p50, round(q[2], 6) AS latency_p75,
               round(q[3], 6) AS latency_p90, round(q[4], 6) AS latency_p95, round(q[5], 6) AS latency_p99,
               round(CASE WHEN seconds > 0 THEN total_requests / seconds ELSE 0 END, 6) AS rps,
               round((1.0 - success_requests / total_requests) * 100, 6) AS error_rate,
               CAST(100 - (success_requests * 100) // total_requests AS DOUBLE) AS error_rate_cut FROM a""",
    "request_sequence": """
        SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS request_no,
               strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, CAST(floor(epoch(ts)) AS BIGINT) AS epoch FROM events""",
    "running_health": """
        SELECT event_id, row_number() OVER w AS requests_processed,
               CAST(sum(CAST(value AS DECIMAL(18,2))) OVER w AS DOUBLE) / row_number() OVER w AS avg_time
        FROM events WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
    "health": """
        SELECT 'ok' AS status, 'forest' AS model, count(*) AS requests_processed,
               round(coalesce(avg(value), 0), 6) AS avg_time, 116 AS feature_count FROM events""",
    "clean_benchmark": f"""
        WITH {_LOG}, r AS (SELECT event_id, event_type AS service, CAST(concurrency AS DOUBLE) AS concurrency,
            CASE k WHEN 7 THEN NULL WHEN 8 THEN 0 ELSE value END AS rps, CASE k WHEN 9 THEN -value ELSE value END AS latency_avg_ms,
            CASE WHEN k <> 10 THEN CAST(k AS DOUBLE) END AS cpu_percent FROM g),
        m AS (SELECT service, median(rps) AS r, median(cpu_percent) AS c FROM r GROUP BY 1),
        f AS (SELECT event_id, service, concurrency, coalesce(rps, m.r) AS rps, latency_avg_ms, coalesce(cpu_percent, m.c) AS cpu_percent
              FROM r JOIN m USING (service))
        SELECT event_id, service, concurrency, round(rps, 4) AS rps, round(latency_avg_ms, 4) AS latency_avg_ms,
               round(cpu_percent, 4) AS cpu_percent FROM f WHERE rps > 0 AND latency_avg_ms >= 0 AND concurrency > 0""",
    "best_level": f"WITH {_BENCH}, {_BEST} SELECT service, round(max_rps, 6) AS max_rps, best_concurrency FROM o",
    "speedup_by_level": f"""
        WITH {_BENCH}, p AS (SELECT concurrency, avg(rps) AS a FROM b WHERE service = 'click' GROUP BY 1),
        q AS (SELECT concurrency, avg(rps) AS a FROM b WHERE service = 'view' GROUP BY 1)
        SELECT concurrency, round(q.a / p.a, 6) AS speedup FROM p JOIN q USING (concurrency) WHERE p.a > 0""",
    "overall_speedup": f"""
        WITH {_BENCH}, m AS (SELECT max(rps) FILTER (service = 'click') AS x, max(rps) FILTER (service = 'view') AS y FROM b)
        SELECT round(x, 6) AS base_rps, round(y, 6) AS other_rps, round(CASE WHEN x > 0 THEN y / x ELSE 0 END, 6) AS speedup FROM m""",
    "efficiency": f"WITH {_BENCH} SELECT service, concurrency, user_id, rps / (cpu_percent + 1) AS efficiency FROM b",
    "latency_long": f"""
        WITH {_BENCH} SELECT service, concurrency, user_id, 'avg' AS metric, latency_avg_ms AS latency FROM b
        UNION ALL SELECT service, concurrency, user_id, 'p50', latency_p50_ms FROM b
        UNION ALL SELECT service, concurrency, user_id, 'p95', latency_p95_ms FROM b
        UNION ALL SELECT service, concurrency, user_id, 'p99', latency_p99_ms FROM b""",
    "service_summary": f"""
        WITH {_BENCH}, {_BEST}
        SELECT service, round(max_rps, 4) AS max_rps, best_concurrency, round(avg(latency_avg_ms), 4) AS latency_avg_ms,
               round(avg(latency_p99_ms), 4) AS latency_p99_ms, round(avg(cpu_percent), 4) AS cpu_percent,
               round(avg(mem_mb), 4) AS mem_mb, round(avg(error_rate), 4) AS error_rate
        FROM b JOIN o USING (service) WHERE concurrency = best_concurrency GROUP BY service, max_rps, best_concurrency""",
    "summary_text": _SHOWN,
    "summary_roundtrip": f"SELECT * FROM (SELECT unnest(['csv', 'parquet']) AS form), ({_SHOWN})",
    "load_levels": f"WITH {_BENCH} SELECT DISTINCT concurrency FROM b ORDER BY 1",
    "cpu_deltas": _cpu_sql("(u + s + i + w)"),
    "cpu_deltas_with_interrupts": _cpu_sql("(u + s + i + w + k + 1)"),
    "resource_usage": f"""
        WITH {_LOG} SELECT event_type AS run, round(avg(k / 2) + avg(user_id / 10), 6) AS cpu_percent,
        CAST(round(avg(event_id * 1024 + 9000000 - k * 1000)) AS BIGINT) // 1024 AS ram_mb FROM g GROUP BY 1""",
    "process_usage": f"""
        WITH {_LOG} SELECT event_type AS run, round(avg(CASE WHEN k > 3 THEN k END), 1) AS cpu_percent,
        CAST(round(avg((event_id * 700 + 9000000) // 1024)) AS BIGINT) AS mem_mb FROM g GROUP BY 1""",
    "report_text_parse": """
        WITH r AS (SELECT *, 1000.0 + l_partkey % 1000 AS total, CASE WHEN l_linestatus = 'O' THEN CAST(l_partkey % 1000 AS DOUBLE) END AS good FROM lineitem)
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS rps, l_quantity AS latency_avg,
               l_discount AS latency_p50, l_tax AS latency_p75, l_discount AS latency_p90, l_tax AS latency_p95, l_quantity AS latency_p99, CAST(total AS DOUBLE) AS total_requests,
               good AS success_requests, round(CASE WHEN good IS NULL THEN 0 ELSE (1.0 - good / total) * 100 END, 6) AS error_rate,
               CASE WHEN good IS NULL THEN 0.0 ELSE 100 - floor(good * 100 / total) END AS error_rate_cut FROM r""",
    "report_files": """
        SELECT event_type AS service, CAST(count(*) AS DOUBLE) AS rps, CAST(max(event_id) AS DOUBLE) AS total_requests,
               CAST(0 AS DOUBLE) AS error_rate FROM events GROUP BY 1""",
    "samples_from_files": f"""
        WITH {_LOG} SELECT event_type AS run, count(*) AS samples, round(avg(CASE WHEN k % 5 > 0 THEN k END), 6) AS cpu_percent,
        round(avg(CASE WHEN k % 5 > 0 THEN k + 1 END), 6) AS mem_mb FROM g GROUP BY 1""",
    "benchmark_append": f"WITH {_BENCH} SELECT service, concurrency, round(max(rps), 3) AS rps FROM b GROUP BY 1, 2",
    "newest_file": f"""
        WITH {_BENCH} SELECT service, count(*) AS "rows", round(max(rps), 6) AS max_rps FROM b WHERE concurrency > 0 GROUP BY 1""",
    "binary_report": f"""
        WITH {_report_sql('labels', 'quality', 'toxic')}
        SELECT CAST(class AS VARCHAR) AS class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM y
        UNION ALL SELECT 'accuracy', NULL, NULL, (SELECT round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END), 9) FROM labels), CAST(sum(support) AS BIGINT) FROM y
        UNION ALL SELECT 'macro avg', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9), CAST(sum(support) AS BIGINT) FROM y
        UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 9), round(sum(recall * support) / sum(support), 9),
                  round(sum(f1 * support) / sum(support), 9), CAST(sum(support) AS BIGINT) FROM y""",
    "class_report_many": f"""
        WITH l AS (SELECT l_returnflag AS a, CASE WHEN l_linenumber < 3 THEN 'A' WHEN l_linenumber < 5 THEN 'N' ELSE 'X' END AS g FROM lineitem),
        {_report_sql('l', 'a', 'g')}
        SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM y""",
    "accuracy": 'SELECT round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END), 9) AS accuracy, count(*) AS "rows" FROM labels',
    "regression_metrics": """
        WITH m AS (SELECT avg(l_extendedprice) AS mean FROM lineitem)
        SELECT count(*) AS "rows", round(sqrt(avg(pow(l_extendedprice - l_quantity * 2000, 2))), 4) AS rmse,
               round(1 - sum(pow(l_extendedprice - l_quantity * 2000, 2)) / sum(pow(l_extendedprice - mean, 2)), 4) AS r2
        FROM lineitem, m""",
}
