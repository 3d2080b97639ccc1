"""Throughput, latency, errors and running health from a request log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarrylight.functions.numbers import as_number, error_percent, error_percent_truncated, guarded_ratio
from quarrylight.functions.times import epoch_micros, seconds_between
from quarrylight.operators.ordering import ROWS_PER_BUCKET, running_totals
from quarrylight.operators.percentiles import bracketed_percentiles, exact_percentiles
from quarrylight.session import null_safe_join, small_side

# Warm-up seconds and reported latency percentiles.
WARM_UP_SECONDS = 5
LATENCY_PERCENTILES = [0.5, 0.75, 0.9, 0.95, 0.99]
# Items a latency sketch keeps per level; see rank_error.
SKETCH_SIZE = 800


def _cell(df: DataFrame, ts: str, seconds: int) -> Column:
    return F.floor(epoch_micros(F.col(ts), dict(df.dtypes)[ts]) / (seconds * 1_000_000))


def _cells(df: DataFrame, level: list[str], ts: str, gap: int) -> DataFrame:
    """(*level, _cell, run, run_start): the run that each stretch of `gap` seconds belongs to.

    Requests in one stretch are closer than the gap, so a stretch lies in one run, and runs are found among
    stretches: their number follows from the time covered and not from the requests in it.
    """
    cells = df.where(F.col(ts).isNotNull()).groupBy(*level, _cell(df, ts, gap).alias("_cell")).agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"))
    order = W.partitionBy(*level).orderBy("_cell")
    begins = F.col("_first") > F.lag("_last").over(order) + F.expr(f"INTERVAL {int(gap)} SECONDS")
    numbered = cells.withColumn("_new", F.coalesce(begins, F.lit(True)).cast("long")).withColumn("run", F.sum("_new").over(order))
    return numbered.withColumn("run_start", F.min("_first").over(W.partitionBy(*level, "run")))


def with_runs(df: DataFrame, level: list[str], ts: str, gap: int) -> DataFrame:
    """Add `run` and `run_start`: a level's requests are one run until more than `gap` seconds pass without any.

    The runs are those of a session window over the level's requests, numbered from 1 in time order. Requests
    without a time are left out.
    """
    cells = small_side(_cells(df, level, ts, gap).select(*level, "_cell", "run", "run_start"))
    return null_safe_join(df.where(F.col(ts).isNotNull()).withColumn("_cell", _cell(df, ts, gap)), cells, [*level, "_cell"]).drop("_cell")


def runs(df: DataFrame, level: list[str], ts: str, gap: int) -> DataFrame:
    """(*level, run, run_start, run_end): when each run of a load level began and ended."""
    return _cells(df, level, ts, gap).groupBy(*level, "run", "run_start").agg(F.max("_last").alias("run_end"))


def without_warm_up(df: DataFrame, level: list[str], ts: str, seconds: int = WARM_UP_SECONDS, gap: int | None = None) -> DataFrame:
    """Drop the first seconds of every load level, or, with a `gap`, of every run of it (see with_runs)."""
    if gap is not None:
        marked = with_runs(df, level, ts, gap)
        return marked.where(F.col(ts) >= F.col("run_start") + F.expr(f"INTERVAL {int(seconds)} SECONDS")).drop("run_start")
    starts = small_side(df.groupBy(*level).agg(F.min(ts).alias("_start")))
    kept = null_safe_join(df, starts, level)
    return kept.where(F.col(ts) >= F.col("_start") + F.expr(f"INTERVAL {int(seconds)} SECONDS")).drop("_start")


def load_summary(
    df: DataFrame, level: list[str], ts: str, latency: str, success: Column, percentiles: list[float] | None = None
) -> DataFrame:
    """Per load level: requests, rate, mean and exact percentile latency, error percentages."""
    percentiles = percentiles or LATENCY_PERCENTILES
    totals = df.groupBy(*level).agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if(success).alias("success_requests"),
        seconds_between(F.min(ts), F.max(ts)).alias("seconds"),
        F.avg(latency).alias("latency_avg"),
    )
    ranks = exact_percentiles(df, [latency], percentiles, by=level)
    ranks = ranks.select(
        *level, *[F.col("percentiles")[i].alias(f"latency_p{round(p * 100)}") for i, p in enumerate(percentiles)]
    )
    total, good = F.col("total_requests"), F.col("success_requests")
    return null_safe_join(totals, ranks, level, "left").withColumns(
        {
            "rps": guarded_ratio(total, F.col("seconds")),
            "error_rate": error_percent(good, total),
            "error_rate_cut": error_percent_truncated(good, total),
        }
    )


def latency_sketches(df: DataFrame, by: list[str], latency: str, size: int = SKETCH_SIZE) -> DataFrame:
    """(*by, n, sketch): a mergeable sketch of the latencies of each group.

    Store the rows of every run as it arrives; merge_latencies puts runs together without their requests.
    """
    value = as_number(F.col(f"`{latency}`"))
    return df.where(value.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(value, F.lit(size)).alias("sketch")
    )


def merge_latencies(parts: DataFrame, by: list[str], size: int = SKETCH_SIZE) -> DataFrame:
    """The sketches of larger groups from those of their parts."""
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(size)).alias("sketch"))


def rank_error(size: int = SKETCH_SIZE) -> float:
    """Share of the rows by which a sketched percentile's rank may be off, with 99 percent confidence."""
    return 2.296 / size**0.9021


def sketched_percentiles(sketches: DataFrame, by: list[str], percentiles: list[float] | None = None) -> DataFrame:
    """(*by, n, latency_pXX ...) from sketches; the rank of each figure is within rank_error of the wanted one."""
    percentiles = percentiles or LATENCY_PERCENTILES
    return sketches.select(
        *by, "n", *[F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(f"latency_p{round(p * 100)}") for p in percentiles]
    )


def refined_percentiles(
    df: DataFrame, sketches: DataFrame, by: list[str], latency: str, percentiles: list[float] | None = None, size: int = SKETCH_SIZE
) -> DataFrame:
    """Exact percentiles on demand: the sketches bracket each rank, and only the values inside are ranked."""
    percentiles = percentiles or LATENCY_PERCENTILES
    margin = 2 * rank_error(size)
    bounds = lambda p: [F.kll_sketch_get_quantile_double("sketch", F.lit(q)) for q in (max(0.0, p - margin), min(1.0, p + margin))]
    brackets = {f"{name}{i}": c for i, p in enumerate(percentiles) for name, c in zip(("lo", "hi"), bounds(p), strict=True)}
    ranks = bracketed_percentiles(df, latency, percentiles, by, sketches.select(*by, *[c.alias(n) for n, c in brackets.items()]))
    return ranks.select(
        *by, "n", *[F.col("percentiles")[i].alias(f"latency_p{round(p * 100)}") for i, p in enumerate(percentiles)]
    )


def request_sequence(df: DataFrame, order: list[str], output: str = "request_no", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    return running_totals(df, order, number=output, rows_per_bucket=rows_per_bucket)


def running_health(df: DataFrame, order: list[str], duration: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """After each request: how many were served and their mean duration so far.

    A decimal duration gives sums that do not depend on the order of addition.
    """
    out = running_totals(df, order, "requests_processed", {"_total": duration}, rows_per_bucket)
    mean = F.col("_total").cast("double") / F.col("requests_processed")
    return out.withColumn("avg_time", mean).drop("_total")


def health(df: DataFrame, duration: str, feature_count: int, model: str) -> DataFrame:
    """One row of service counters; the mean of no request is 0."""
    return df.agg(
        F.lit("ok").alias("status"),
        F.lit(model).alias("model"),
        F.count(F.lit(1)).alias("requests_processed"),
        F.coalesce(F.avg(duration), F.lit(0.0)).alias("avg_time"),
        F.lit(feature_count).alias("feature_count"),
    )
