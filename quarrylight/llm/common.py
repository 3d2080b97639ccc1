"""What the operators share: shipping the code, landing tables, broadcast values and components."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.session import new_folder

#: Words are runs of anything but the six ASCII white-space characters; bytes.split() cuts likewise.
WORD = r"[^\x20\x09-\x0D]+"


def ship(spark: SparkSession) -> None:
    """Give the package to Python workers on any machine, once for a Spark context."""
    context = spark.sparkContext
    if getattr(context, "_quarrylight_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="quarrylight-code-")
    archive = os.path.join(folder, "quarrylight.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for base, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(base, name)
                    out.write(path, os.path.join("quarrylight", os.path.relpath(path, root)))
    context.addPyFile(archive)
    context._quarrylight_shipped = True


def land(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write a table in the shared folder and read it again: later steps need no lost executor's files."""
    path = new_folder(df.sparkSession, label)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return a worker's freed memory to the machine: workers live on, and a stage must not hold what an earlier one needed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries do without
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def crc_of_id(column: str = "doc_id") -> Column:
    """The unsigned crc32 of an id as text; that of a null id is 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(0))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b) links by alternating large and small stars.

    Returns (node, root), one row for each linked node; the root is the smallest node of the
    component. Every round groups by node with partial sums only and lands the links, so neither a
    hub nor a long chain meets in one task. An empty table gives an empty result.
    """
    links = land(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(),
        "links",
    )
    before = _sign(links)
    while True:
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(
            F.inline(F.array(
                F.struct(F.col("a"), F.col("low").alias("b")),
                F.struct(F.col("b").alias("a"), F.col("low").alias("b")),
            ))
        )
        links = land(small.filter("a <> b").distinct(), "links")
        after = _sign(links)
        if after == before:
            break
        before = after
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())


def _sign(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("b", "a"))).first())
