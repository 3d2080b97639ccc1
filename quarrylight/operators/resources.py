"""CPU and memory use from sampled counters."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.numbers import percent_div
from quarrylight.functions.times import epoch_micros
from quarrylight.operators.ordering import ROWS_PER_BUCKET, previous_values
from quarrylight.session import null_safe_join, small_side

# Counters that make up total CPU time; one source also counts the interrupt fields.
COUNTERS = ["user", "nice", "system", "idle", "iowait"]
INTERRUPTS = ["irq", "softirq"]


def cpu_deltas(
    df: DataFrame, run: list[str], order: list[str], interrupts: bool = False, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Whole percent of CPU time spent in user and system mode since the previous sample.

    The first sample of a run has no predecessor and is left out; 0 if no time passed.
    """
    fields = COUNTERS + (INTERRUPTS if interrupts else [])
    total = reduce(add, [F.col(c) for c in fields])
    counted = df.withColumn("_total", total)
    before = previous_values(
        counted, run, order, {"_p_total": "_total", "_p_user": "user", "_p_system": "system"}, rows_per_bucket
    ).where(F.col("_p_total").isNotNull())
    passed = F.col("_total") - F.col("_p_total")
    user = percent_div(F.col("user") - F.col("_p_user"), passed)
    system = percent_div(F.col("system") - F.col("_p_system"), passed)
    return before.select(
        *run, *order, user.alias("cpu_user"), system.alias("cpu_system"), (F.lit(100) - user - system).alias("cpu_idle")
    )


def used_kb(total_kb: Column, available_kb: Column) -> Column:
    return total_kb - available_kb


def whole_mb(kb: Column) -> Column:
    return F.call_function("div", kb.cast("bigint"), F.lit(1024).cast("bigint"))


def resource_usage(df: DataFrame, run: list[str]) -> DataFrame:
    """Mean CPU (user + system) and memory per run; 0 where a run has no samples."""
    return df.groupBy(*run).agg(
        (F.coalesce(F.avg("cpu_user"), F.lit(0.0)) + F.coalesce(F.avg("cpu_system"), F.lit(0.0))).alias("cpu_percent"),
        whole_mb(F.round(F.coalesce(F.avg("mem_used_kb"), F.lit(0.0)))).alias("ram_mb"),
    )


def process_usage(df: DataFrame, run: list[str], blanks_as_zero: bool = False) -> DataFrame:
    """Mean CPU percent (one decimal) and whole MB of sampled process figures per run.

    A blank figure stays out of the mean; tools that add up text columns count it as 0, as blanks_as_zero does.
    """
    figure = lambda c: F.coalesce(c, F.lit(0)) if blanks_as_zero else F.col(c)
    return df.groupBy(*run).agg(
        F.round(F.coalesce(F.avg(figure("cpu_percent")), F.lit(0.0)), 1).alias("cpu_percent"),
        F.round(F.coalesce(F.avg(figure("mem_mb")), F.lit(0.0))).cast("bigint").alias("mem_mb"),
    )


def samples_in_runs(
    samples: DataFrame, runs: DataFrame, ts: str = "ts", start: str = "run_start", end: str = "run_end",
    by: list[str] | None = None, bucket_seconds: int = 60,
) -> DataFrame:
    """Every sample with the columns of the run it was taken in, both ends included; none for samples outside.

    Runs are cut at multiples of `bucket_seconds` and joined on the bucket (and `by`) first, so a sample meets
    only the runs near it. A sample taken while two runs overlap belongs to both.
    """
    by = list(by or [])
    types = dict(runs.dtypes) | dict(samples.dtypes)
    bucket = lambda c: F.floor(epoch_micros(F.col(c), types[c]) / (bucket_seconds * 1_000_000))
    cut = runs.where(F.col(start) <= F.col(end)).withColumn("_bucket", F.explode(F.sequence(bucket(start), bucket(end))))
    spans = cut.withColumnsRenamed({start: "_start", end: "_end"} | ({ts: "_run_ts"} if ts in cut.columns else {}))
    joined = null_safe_join(samples.where(F.col(ts).isNotNull()).withColumn("_bucket", bucket(ts)), small_side(spans), ["_bucket", *by])
    return joined.where(F.col(ts).between(F.col("_start"), F.col("_end"))).withColumnsRenamed({"_start": start, "_end": end}).drop("_bucket")


def usage_by_run(
    samples: DataFrame, runs: DataFrame, level: list[str], ts: str = "ts", by: list[str] | None = None, bucket_seconds: int = 60
) -> DataFrame:
    """Mean CPU percent (one decimal) and whole MB of one sample log for each run of a load level; 0 without samples."""
    taken = samples_in_runs(samples, runs, ts, by=by, bucket_seconds=bucket_seconds)
    used = process_usage(taken, [*level, "run"])
    empty = {"cpu_percent": 0.0, "mem_mb": 0}
    return null_safe_join(runs.select(*level, "run", "run_start", "run_end"), used, [*level, "run"], "left").fillna(empty, list(empty))
