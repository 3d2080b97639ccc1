"""Table readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header; types are inferred (one more pass over the files) without a schema."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def append_runs(df: DataFrame, path: str, run: list[str], form: str = "parquet") -> None:
    """Append rows to a table partitioned by run; a job that is run again replaces the rows of its own runs.

    Only the partitions of the runs in `df` are written, at the commit of the job, so neither a retried task nor
    a second try of the whole job leaves a row twice, and other runs stay as they are.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True).partitionBy(*run).format(form).save(path)


def write_summary(df: DataFrame, path: str, form: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if form == "csv" else writer.format(form).save(path)


def write_records(df: DataFrame, path: str) -> None:
    """Prediction records as JSON lines."""
    df.write.mode("overwrite").json(path)


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)
