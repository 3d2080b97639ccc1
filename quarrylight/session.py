"""Session settings, the shared work folder and size-checked small tables."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A table is broadcast only if it was measured to stay below both limits.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 16 * 1024 * 1024


def build_session(app: str = "quarrylight", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        # Request JSON may repeat a name; the last value wins, as in most JSON readers.
        "spark.sql.variant.allowDuplicateKeys": "true",
    } | {key.replace("__", "."): value for key, value in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster in spark.checkpoint.dir.

    Only where driver and executors are one process, as in tests, a temporary folder may stand in.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="quarrylight-")
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder of its own below the application's, which is deleted when the driver ends."""
    context = spark.sparkContext
    own = f"{shared_dir(spark).rstrip('/')}/{context.applicationId}"
    if getattr(context, "_quarrylight_folder", None) != own:
        path = context._jvm.org.apache.hadoop.fs.Path(own)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        context._quarrylight_folder = own
    return f"{own}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so that lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for a small materialised table; one with enough partitions stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small_side(df: DataFrame, materialized: bool = False) -> DataFrame:
    """Materialise a lookup table and hint a broadcast only if its measured size allows it.

    Beyond the limits the plain table is returned and the join shuffles, with AQE splitting
    skewed partitions.
    """
    done = df if materialized else materialize(df)
    size = done.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.length(F.to_json(F.struct(*done.columns)))), F.lit(0)).alias("bytes"),
    ).first()
    fits = size["n"] <= BROADCAST_ROWS and size["bytes"] <= BROADCAST_BYTES
    return F.broadcast(done) if fits else done


def evaluate_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """withColumns for costly expressions.

    The optimizer copies a projected expression into every filter pushed below it, and would parse
    the same JSON again for each use. It does not look into a generator, so a one-element inline
    keeps the columns as they were computed.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that matches null keys and leaves one copy of the key columns."""
    renamed = right.withColumnsRenamed({key: f"__r_{key}" for key in keys})
    condition = reduce(
        and_, [F.col(f"`{key}`").eqNullSafe(F.col(f"`__r_{key}`")) for key in keys]
    )
    return left.join(renamed, condition, how).drop(*[f"__r_{key}" for key in keys])
