"""Load-test result files: the newest per service, resource samples and text reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions.numbers import error_percent, error_percent_truncated, leading_digits, rounded_column, to_numeric
from quarrylight.schemas import BENCH_V1, BENCH_V2, SAMPLES_V2, text_schema
from quarrylight.session import evaluate_once


# A result file or folder of files, and the service named in it.
RUN_PATTERN = r"^(.*/([^/]+?)_benchmark_[^/]*)"


def newest_files(spark: SparkSession, folder: str, run_pattern: str = RUN_PATTERN) -> DataFrame:
    """(service, path, modified): the most recently changed run of each service.

    Only lists the files. A run without rows can be the newest one; it then gives no result rows.
    Files without the marker in their name are no results.
    """
    files = spark.read.format("binaryFile").options(pathGlobFilter="*.csv", recursiveFileLookup=True).load(folder)
    runs = files.select(
        F.regexp_extract("path", run_pattern, 2).alias("service"),
        F.regexp_extract("path", run_pattern, 1).alias("path"),
        F.col("modificationTime").alias("modified"),
    )
    return runs.where("service <> ''").groupBy("service").agg(
        F.max_by("path", F.struct("modified", "path")).alias("path"), F.max("modified").alias("modified")
    )


def read_newest_results(
    spark: SparkSession, folder: str, run_pattern: str = RUN_PATTERN, header: str = BENCH_V2
) -> DataFrame:
    """Rows of each service's newest run, tagged with the service."""
    newest = newest_files(spark, folder, run_pattern).select("path").collect()
    if not newest:
        raise FileNotFoundError(f"no result files in {folder}")
    reader = spark.read.schema(text_schema(header)).options(header=True, recursiveFileLookup=True)
    rows = reader.csv([run["path"] for run in newest])
    return rows.withColumn("service", F.regexp_extract(F.col("_metadata.file_path"), run_pattern, 2))


# Names of the first result layout and what the second one calls them.
FIRST_LAYOUT = {
    "avg_latency_ms": "latency_avg_ms",
    "p95_latency_ms": "latency_p95_ms",
    "p99_latency_ms": "latency_p99_ms",
    "ram_mb": "mem_mb",
}


def read_first_layout(spark: SparkSession, path: str) -> DataFrame:
    """Result files of the first layout under the column names of the second."""
    rows = spark.read.schema(text_schema(BENCH_V1)).option("header", True).csv(path)
    return rows.withColumnsRenamed(FIRST_LAYOUT)


def read_samples(spark: SparkSession, path: str, header: str = SAMPLES_V2) -> DataFrame:
    """Resource samples as numbers; `timestamp` stays text."""
    table = spark.read.schema(text_schema(header)).option("header", True).csv(path)
    return table.withColumns({c: to_numeric(F.col(c)) for c in table.columns if c != "timestamp"})


# The text before each figure in a report, and the figure's decimals.
REPORT_FIELDS = {
    "rps": ("Requests/sec", 2),
    "latency_avg": ("Average:", 2),
    "latency_p50": ("50% in", 2),
    "latency_p75": ("75% in", 2),
    "latency_p90": ("90% in", 2),
    "latency_p95": ("95% in", 2),
    "latency_p99": ("99% in", 2),
    "total_requests": ("Total:", None),
    "success_requests": ("Success:", None),
}


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """(value, path): one text report per file."""
    return spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))


def report_field(text: Column, marker: str) -> Column:
    """The word after the first occurrence of the marker; null if there is none in its line.

    The marker is found as plain text, so no pattern has to run over the whole report.
    """
    after = F.split_part(text, F.lit(marker), F.lit(2))
    return _next_word(after)


def _next_word(after: Column) -> Column:
    return F.nullif(F.regexp_extract(after, r"^\S*[ \t]+(\S+)", 1), F.lit(""))


def parse_reports(df: DataFrame, value: str = "value") -> DataFrame:
    """Figures of a load tool's text report as columns, with the error percentages they imply.

    Words are cut out, then read as numbers, then rounded, each step bound to a column of its own, so that
    nothing is computed twice and the rounding runs in generated code.
    """
    words = evaluate_once(df, {f"_{name}": report_field(F.col(value), marker) for name, (marker, _) in REPORT_FIELDS.items()})
    figures = {name: (F.coalesce(F.col(f"_{name}"), F.lit("")), decimals) for name, (_, decimals) in REPORT_FIELDS.items()}
    read = evaluate_once(words, {f"_{name}": leading_digits(word) for name, (word, decimals) in figures.items() if decimals is not None})
    columns: dict[str, Column] = {}
    for name, (word, decimals) in figures.items():
        columns[name] = to_numeric(F.replace(word, F.lit(","), F.lit(""))) if decimals is None else rounded_column(F.col(f"_{name}"), decimals)
    out = read.withColumns(columns).drop(*[f"_{name}" for name in REPORT_FIELDS])
    total, good = F.col("total_requests"), F.col("success_requests")
    return out.withColumns(
        {"error_rate": error_percent(good, total), "error_rate_cut": error_percent_truncated(good, total)}
    ).drop(value)
