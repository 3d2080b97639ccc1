"""Clean load-test results and compare two services."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.numbers import fixed_text, guarded_ratio, to_numeric
from quarrylight.operators.percentiles import exact_medians
from quarrylight.session import null_safe_join, small_side

# Result columns coerced to numbers, and display names of the latency metrics.
NUMERIC_RESULTS = [
    "rps", "latency_avg_ms", "latency_p50_ms", "latency_p95_ms", "latency_p99_ms",
    "error_rate", "cpu_percent", "mem_mb",
]
LATENCY_NAMES = {"latency_avg_ms": "avg", "latency_p50_ms": "p50", "latency_p95_ms": "p95", "latency_p99_ms": "p99"}


def clean_benchmark(df: DataFrame, by: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Coerce result columns to numbers, fill broken ones with the file's median, drop invalid rows.

    `by` names the columns that tell result files apart. The fill comes before the filter, so
    medians see the rows that are dropped later.
    """
    by = list(by or [])
    columns = [c for c in (columns or NUMERIC_RESULTS) if c in df.columns]
    numbers = df.withColumns({c: to_numeric(F.col(c)) for c in columns} | {"concurrency": to_numeric(F.col("concurrency"))})
    ids = by or ["_all"]
    keyed = numbers if by else numbers.withColumn("_all", F.lit(0))
    medians = exact_medians(keyed, columns, by=ids)
    wide = medians.groupBy(*ids).agg(
        *[F.max(F.when(F.col("feature") == c, F.col("median"))).alias(f"_m_{c}") for c in columns]
    )
    filled = null_safe_join(keyed, small_side(wide), ids, "left")
    filled = filled.withColumns({c: F.coalesce(F.col(c), F.col(f"_m_{c}")) for c in columns})
    valid = (F.col("rps") > 0) & (F.col("latency_avg_ms") >= 0) & (F.col("concurrency") > 0)
    return filled.where(valid).select(df.columns)


def combine(tables: dict[str, DataFrame]) -> DataFrame:
    """Stack the tables with their name in `service`; columns only some have become null."""
    out = None
    for name, table in tables.items():
        tagged = table.withColumn("service", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def with_efficiency(df: DataFrame) -> DataFrame:
    return df.withColumn("efficiency", F.col("rps") / (F.col("cpu_percent") + 1))


def latency_long(df: DataFrame, ids: list[str], metrics: dict[str, str] | None = None) -> DataFrame:
    """One row per result and latency metric: (*ids, metric, latency)."""
    metrics = metrics or LATENCY_NAMES
    return df.unpivot(ids, list(metrics), "metric", "latency").replace(metrics, subset=["metric"])


def best_levels(df: DataFrame, by: str = "service", first: Column | None = None) -> DataFrame:
    """(service, max_rps, best_concurrency); among equal rates the first row, by default the lowest level, wins."""
    first = F.col("concurrency") if first is None else first
    return df.groupBy(by).agg(
        F.max("rps").alias("max_rps"), F.max_by("concurrency", F.struct("rps", -first)).alias("best_concurrency")
    )


def service_means(df: DataFrame, by: str = "service") -> DataFrame:
    """Raw numbers of the summary: means over each service's rows at its best level."""
    best = small_side(best_levels(df, by))
    rows = df.join(best, by).where(F.col("concurrency") == F.col("best_concurrency"))
    means = ["latency_avg_ms", "latency_p99_ms", "cpu_percent", "mem_mb", "error_rate"]
    return rows.groupBy(by, "max_rps", "best_concurrency").agg(*[F.avg(c).alias(c) for c in means])


def service_summary(df: DataFrame, by: str = "service") -> DataFrame:
    """The summary as shown: one decimal for rates and CPU, two for latencies and errors."""
    decimals = {"latency_avg_ms": 2, "latency_p99_ms": 2, "cpu_percent": 1, "mem_mb": 0, "error_rate": 2}
    return service_means(df, by).select(
        by,
        fixed_text(F.col("max_rps"), 1).alias("max_rps"),
        F.col("best_concurrency").cast("bigint").cast("string").alias("best_concurrency"),
        *[fixed_text(F.col(c), d).alias(c) for c, d in decimals.items()],
    )


def speedup_by_level(base: DataFrame, other: DataFrame) -> DataFrame:
    """(concurrency, speedup) for levels both services ran, mean rate over mean rate."""
    left = base.groupBy("concurrency").agg(F.avg("rps").alias("base_rps"))
    right = other.groupBy("concurrency").agg(F.avg("rps").alias("other_rps"))
    joined = left.join(right, "concurrency").where("base_rps > 0")
    return joined.select("concurrency", (F.col("other_rps") / F.col("base_rps")).alias("speedup"))


def overall_speedup(df: DataFrame, base: str, other: str) -> DataFrame:
    """Best rate of one service over the best rate of the other, 0 if the base has none."""
    best = df.agg(
        F.max(F.when(F.col("service") == base, F.col("rps"))).alias("base_rps"),
        F.max(F.when(F.col("service") == other, F.col("rps"))).alias("other_rps"),
    )
    return best.select("base_rps", "other_rps", guarded_ratio(F.col("other_rps"), F.col("base_rps")).alias("speedup"))


def levels(df: DataFrame) -> DataFrame:
    return df.select("concurrency").distinct().orderBy("concurrency")
