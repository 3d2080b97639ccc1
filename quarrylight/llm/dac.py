"""Token ids in directly addressable codes, with random access to any token.

The table of segments is a Parquet table with one row per segment; a segment holds whole documents,
in ascending doc_id order, and is closed at about SEGMENT ids. An id is split into chunks of 8 bits,
lowest first. Level 0 has the lowest chunk of every id and a bitmap that tells which ids go on; level
k holds the next chunk of those ids alone. The rank directory of a level counts the bitmap's ones
before each block of 512 bits. To read id i: take its chunk, and while its bit is set, go to position
rank(i) of the next level. No block is decoded on the way.

columns of a segment: part, segment (their order is the order of ids), first_doc, ids (how many),
doc_ids, doc_sizes (one for each document), levels (bytes of each level), marks (bitmaps, little-endian
bit order), ranks (unsigned 32-bit directories). The directory table has (part, start): how many ids
lie before the part.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarrylight.llm.common import ship
from quarrylight.llm.tokens import encoder
from quarrylight.session import BROADCAST_ROWS

SEGMENT = 1 << 18
BLOCK = 512
SCHEMA = (
    "part int, segment long, ids long, doc_ids array<{kind}>, doc_sizes array<long>, "
    "levels array<binary>, marks array<binary>, ranks array<binary>"
)


def encode(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """(levels, marks, ranks) of unsigned 32-bit ids."""
    levels, marks, ranks = [], [], []
    left = np.asarray(ids, "<u4")
    while True:
        levels.append((left & 255).astype(np.uint8).tobytes())
        more = left > 255
        marks.append(np.packbits(more, bitorder="little").tobytes())
        ones = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
        ranks.append((np.cumsum(ones) - ones).astype("<u4").tobytes())
        if not more.any():
            return levels, marks, ranks
        left = left[more] >> 8


def decode(levels: list[bytes], marks: list[bytes], size: int) -> np.ndarray:
    """All ids of a segment."""
    values = None
    for k in reversed(range(len(levels))):
        own = np.frombuffer(levels[k], np.uint8).astype("<u4")
        if values is not None:
            more = np.unpackbits(np.frombuffer(marks[k], np.uint8), count=len(own), bitorder="little").view(bool)
            own[more] |= values << np.uint32(8)
        values = own
    if len(values) != size:
        raise ValueError(f"a segment of {size} ids has {len(values)}")
    return values


def access(levels: list[bytes], marks: list[bytes], ranks: list[bytes], at: int) -> int:
    """The id at one position, without decoding any other."""
    value = 0
    for k, level in enumerate(levels):
        value |= level[at] << (8 * k)
        bits = marks[k]
        if not bits[at >> 3] >> (at & 7) & 1:
            return value
        block = at // BLOCK
        before = int.from_bytes(ranks[k][4 * block:4 * block + 4], "little")
        within = int.from_bytes(bits[block * BLOCK // 8:(at >> 3) + 1], "little") & ((1 << (at - block * BLOCK)) - 1)
        at = before + within.bit_count()
    raise ValueError("the last level goes on")


def _write(path: str, end: int, kind: pa.DataType, limit: int):
    tail = np.array([end], "<u4").tobytes()

    def run(batches):
        part, segment, docs, pieces, total = TaskContext.get().partitionId(), 0, [], [], 0
        known = encoder(path)

        def row():
            levels, marks, ranks = encode(np.frombuffer(b"".join(pieces), "<u4"))
            return pa.record_batch(
                [pa.array([part], pa.int32()), pa.array([segment], pa.int64()), pa.array([total], pa.int64()),
                 pa.array([docs], pa.list_(kind)), pa.array([[len(x) // 4 for x in pieces]], pa.list_(pa.int64())),
                 *(pa.array([x], pa.list_(pa.binary())) for x in (levels, marks, ranks))],
                ["part", "segment", "ids", "doc_ids", "doc_sizes", "levels", "marks", "ranks"],
            )

        for batch in batches:
            names = batch.column(0).to_pylist()
            texts = ("" if t is None else t for t in batch.column(1).to_pylist())
            for name, ids in zip(names, known.encode(texts), strict=True):
                docs.append(name)
                pieces.append(ids + tail)
                total += len(ids) // 4 + 1
                if total >= limit:
                    yield row()
                    segment, docs, pieces, total = segment + 1, [], [], 0
        if docs:
            yield row()
    return run


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, partitions: int | None = None,
          segment: int = SEGMENT) -> None:
    """Write `docs` as token ids below `folder` (segments/ and directory/), in ascending doc_id order.

    Each document is its ids and end_id; null and empty texts are end_id alone. Null doc_ids come
    first. Repeated ids are kept; rows of one id lie in the order of their texts. Other columns are
    not read. An empty table gives empty tables.
    """
    spark = docs.sparkSession
    ship(spark)
    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = plain.schema["doc_id"].dataType
    number = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = plain.repartitionByRange(number, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(
        _write(tokenizer, end_id, to_arrow_type(kind), segment), SCHEMA.format(kind=kind.simpleString())
    ).write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/segments")
    sizes = spark.read.parquet(f"{folder}/segments").groupBy("part").agg(F.sum("ids").alias("ids"))
    rows, at = [], 0
    for part, ids in sorted(tuple(x) for x in sizes.collect()):  # one number for each partition
        rows.append((part, at))
        at += ids
    spark.createDataFrame(rows, "part int, start long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/directory")


def _read(kind: pa.DataType):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode(row["levels"], row["marks"], row["ids"])
                sizes = np.array(row["doc_sizes"], np.int64)
                stops = np.cumsum(sizes)
                begins = stops - sizes
                raw = [ids[a:b].tobytes() for a, b in zip(begins.tolist(), stops.tolist(), strict=True)]
                yield pa.record_batch(
                    [pa.array(row["doc_ids"], kind), pa.array(row["part"] + 0 * begins, pa.int32()),
                     pa.array(np.full(len(sizes), row["segment"]), pa.int64()), pa.array(begins, pa.int64()),
                     pa.array(sizes, pa.int64()), pa.array(raw, pa.binary())],
                    ["doc_id", "part", "segment", "within", "n_tokens", "ids"],
                )
    return run


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of a written folder: doc_id, start, n_tokens, ids (unsigned 32-bit, little-endian)."""
    ship(spark)
    segments = spark.read.parquet(f"{folder}/segments")
    kind = segments.schema["doc_ids"].dataType.elementType
    starts = _segment_starts(segments.select("part", "segment", "ids"), spark.read.parquet(f"{folder}/directory"))
    found = segments.select("part", "segment", "ids", "doc_ids", "doc_sizes", "levels", "marks").mapInArrow(
        _read(to_arrow_type(kind)),
        f"doc_id {kind.simpleString()}, part int, segment long, within long, n_tokens long, ids binary",
    )
    starts = starts.drop("ids")
    return found.join(F.broadcast(starts) if starts.count() <= BROADCAST_ROWS else starts, ["part", "segment"]).select(
        "doc_id", (F.col("begin") + F.col("within")).alias("start"), "n_tokens", "ids"
    )


def token_at(spark: SparkSession, folder: str, positions: DataFrame) -> DataFrame:
    """(position, id) for each `position` of all ids, by random access; positions beyond the end give no row.

    Segments are found from their column of sizes; one scan of the codes' columns, joined with the segments
    asked for, then gives their codes, of which only the asked ones are decoded.
    """
    ship(spark)
    segments = spark.read.parquet(f"{folder}/segments")
    starts = _segment_starts(segments.select("part", "segment", "ids"), spark.read.parquet(f"{folder}/directory"))
    marks = starts.select(F.col("begin").alias("at"), "part", "segment", "ids", F.lit(None).cast("long").alias("position"))
    asked = positions.select(
        F.col("position").cast("long").alias("at"), F.lit(None).cast("int").alias("part"),
        F.lit(None).cast("long").alias("segment"), F.lit(None).cast("long").alias("ids"),
        F.col("position").cast("long").alias("position"),
    )
    # Positions and segment starts are few numbers beside the ids; a range bucket keeps them apart.
    wide = F.floor(F.col("at") / (4 * SEGMENT))
    spread = marks.withColumn("bucket", F.explode(F.sequence(wide, F.floor((F.col("at") + F.col("ids")) / (4 * SEGMENT)))))
    hit = asked.select("position", wide.alias("bucket")).join(spread.drop("position"), "bucket").filter(
        "position >= at and position < at + ids"
    ).select("part", "segment", (F.col("position") - F.col("at")).alias("within"), "position")
    own = hit.join(segments, ["part", "segment"]).select("position", "within", "levels", "marks", "ranks")

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.record_batch(
                [pa.array([r["position"] for r in rows], pa.int64()),
                 pa.array([access(r["levels"], r["marks"], r["ranks"], r["within"]) for r in rows], pa.int64())],
                ["position", "id"],
            )
    return own.mapInArrow(run, "position long, id long")


def _segment_starts(sizes: DataFrame, directory: DataFrame) -> DataFrame:
    """(part, segment, ids, begin): the ids before each segment, summed within its part."""
    return sizes.selectExpr(
        "part", "segment", "ids",
        "sum(ids) over (partition by part order by segment rows between unbounded preceding and current row) - ids as inside",
    ).join(directory, "part").selectExpr("part", "segment", "ids", "start + inside as begin")
