"""Score a stream of requests, keep rejected ones apart and count what was served."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrylight.functions.times import epoch_micros
from quarrylight.operators.forest import score
from quarrylight.operators.preprocess import Preprocessing
from quarrylight.operators.requests import check_named, parse_named, split_requests


#: Triggers are writeStream's: what has arrived, then stop; or for example {"processingTime": "10 seconds"}.
ONCE = {"availableNow": True}


def request_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """(value, path): one JSON request per line of the files arriving in a folder."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return lines.select("value", F.col("_metadata.file_path").alias("path"))


def start_scoring(
    requests: DataFrame,
    model: PipelineModel,
    params: Preprocessing,
    scored_path: str,
    rejected_path: str,
    checkpoint: str,
    mode: str = "consistent",
    value: str = "value",
    version: str = "forest-1",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Append prediction records and rejected requests to two tables, each batch once.

    A batch overwrites its own folder, so a replayed batch after a lost driver or executor leaves
    no second copy.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        parsed = parse_named(batch, value, params, mode).persist()
        good, bad = split_requests(parsed)
        scored = score(good, model, version, keep=[value])
        scored.write.mode("overwrite").parquet(f"{scored_path}/batch={batch_id}")
        bad.select(value, "status", "error").write.mode("overwrite").parquet(f"{rejected_path}/batch={batch_id}")
        parsed.unpersist()

    return (
        requests.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or ONCE))
        .start()
    )


def start_rejects(
    requests: DataFrame, path: str, checkpoint: str, mode: str, value: str = "value", trigger: dict | None = None
) -> StreamingQuery:
    """Only the malformed requests with their reason, appended by the file sink."""
    bad = split_requests(check_named(requests, value, mode).drop("body"))[1]
    return (
        bad.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or ONCE))
        .start()
    )


def start_health(
    events: DataFrame, duration: str, by: list[str], path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Running request count and mean duration per group.

    Every batch writes the whole small table of counters; the newest folder is the current state.
    """
    counters = events.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests_processed"), F.coalesce(F.avg(duration), F.lit(0.0)).alias("avg_time")
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        counters.writeStream.foreachBatch(write)
        .outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or ONCE))
        .start()
    )


def newest_state(spark: SparkSession, path: str) -> DataFrame:
    """The counters of the last finished batch."""
    states = spark.read.parquet(path)
    last = states.agg(F.max("batch")).first()[0]
    return states.where(F.col("batch") == F.lit(last)).drop("batch")


def start_counters(
    events: DataFrame, ts: str, duration: str, by: list[str], path: str, checkpoint: str, every: str = "1 minute",
    late: str = "10 minutes", trigger: dict | None = None,
) -> StreamingQuery:
    """Counters of a stream that keeps running: requests, summed and largest duration per stretch of time and group.

    A late request still counts in its own stretch until the watermark, the newest time seen less `late`,
    has passed the stretch; then the stretch leaves the state, and what comes later is dropped. Each batch writes
    the stretches that it changed, with their whole counters, to a folder of its own that a replay overwrites.
    """
    zoned = dict(events.dtypes)[ts] == "timestamp"
    if not zoned:  # a watermark wants instants; times without a zone are counted as UTC
        events = events.withColumn(ts, F.timestamp_micros(epoch_micros(F.col(ts))))
    begins = F.col("w.start") if zoned else F.expr("timestampadd(MICROSECOND, unix_micros(w.start), TIMESTAMP_NTZ'1970-01-01')")
    stretch = F.window(F.col(ts), every)
    counted = events.withWatermark(ts, late).groupBy(stretch.alias("w"), *by).agg(
        F.count(F.lit(1)).alias("requests"), F.coalesce(F.sum(duration), F.lit(0)).alias("duration"), F.max(duration).alias("slowest"),
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        flat = batch.select(begins.alias("begins"), *by, "requests", "duration", "slowest")
        flat.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        counted.writeStream.foreachBatch(write)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or ONCE))
        .start()
    )


def current_counters(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """(begins, *by, requests, duration, slowest): the newest counters of every stretch."""
    rows = spark.read.parquet(path)
    newest = F.max_by(F.struct("requests", "duration", "slowest"), F.col("batch")).alias("c")
    return rows.groupBy("begins", *by).agg(newest).select("begins", *by, "c.*")


def merged_counters(counters: DataFrame, by: list[str], every: str | None = None) -> DataFrame:
    """Counters of longer stretches, or of all time, from those of shorter ones: counts and sums add up."""
    longer = [F.window("begins", every)["start"].alias("begins")] if every else []
    return counters.groupBy(*longer, *by).agg(
        F.sum("requests").alias("requests"), F.sum("duration").alias("duration"), F.max("slowest").alias("slowest")
    ).withColumn("avg_time", F.col("duration") / F.col("requests"))
