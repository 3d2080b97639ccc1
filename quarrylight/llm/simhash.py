"""SimHash near-dedup with covering locality-sensitive hashing.

A fingerprint has a bit for each of 64 positions: 1 if more than half of the text's shingle hashes
have it. Two fingerprints are linked if they differ in at most `radius` bits. Candidate pairs come
from masks built so that no pair within the radius can escape: every bit position gets a random
vector of radius + 1 bits, and for every non-zero vector v there is a table whose mask holds the
positions with an odd product with v. The vectors of `radius` differing positions cannot span all
radius + 1 dimensions, so some v is orthogonal to all of them and its mask skips every difference.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import components, land, ship
from quarrylight.session import small_side

BITS = 64
#: Buckets of at most so many different fingerprints are compared pair by pair.
BUCKET = 16
#: Shingle hashes whose bits are counted at once.
CHUNK = 1 << 16


def fingerprint(text: bytes | None, size: int = 3, seed: int = 42) -> int:
    """The fingerprint of a UTF-8 text as an unsigned number; no words: 0."""
    words = (text or b"").lower().split()  # bytes: only A-Z change, only ASCII white space cuts
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-size] + 1)).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[size - 1:].tolist(), strict=True)]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = np.array(hashes[at:at + CHUNK], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(size: int, seed: int):
    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = np.fromiter((fingerprint(t.as_py(), size, seed) for t in texts), np.uint64, len(texts))
            yield pa.record_batch([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])
    return run


def fingerprints(docs: DataFrame, size: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint's 64 bits as a signed long."""
    ship(docs.sparkSession)
    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(_fingerprints(size, seed), f"doc_id {kind}, fp long")


def masks(radius: int, seed: int = 1) -> list[int]:
    """The 2^(radius+1) - 1 masks of the covering family, as signed longs."""
    draw = random.Random(seed)
    vectors = [draw.randrange(1, 1 << (radius + 1)) for _ in range(BITS)]
    found = []
    for v in range(1, 1 << (radius + 1)):
        mask = sum(1 << i for i, vector in enumerate(vectors) if (vector & v).bit_count() % 2)
        found.append(mask - (1 << BITS) if mask >> (BITS - 1) else mask)
    return found


def links(prints: DataFrame, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that join all `fp` within the radius into the same components.

    Buckets of up to `bucket` different fingerprints are compared pair by pair and only real links
    leave them. Larger ones, as groups of near copies make, would give the square of their size:
    there every fingerprint names itself and its 64 neighbours at one bit, and those that name the
    same point are linked to the smallest of them. For radius 2 that is exact: two fingerprints are
    within 2 bits if and only if some point is within 1 bit of both. For radius 1 the neighbours
    that exist are the links.
    """
    if radius not in (1, 2):
        raise ValueError("links are exact for a radius of 1 or 2 bits")
    tables = F.array(*[
        F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key"))
        for i, mask in enumerate(masks(radius))
    ])
    rows = prints.select("fp", F.inline(tables))
    sizes = rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = land(rows.join(sizes, ["band", "key"]), "buckets")

    near = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= radius
    few = (
        shared.filter(F.col("n") <= bucket)
        .groupBy("band", "key").agg(F.sort_array(F.collect_list("fp")).alias("all"))
        .select(F.explode("all").alias("a"), "all")
        .select("a", F.explode(F.filter("all", lambda y: (y > F.col("a")) & near(F.col("a"), y))).alias("b"))
    )
    many = shared.filter(F.col("n") > bucket).select("fp").distinct()
    one_bit = F.array(*[F.lit((1 << i) - (1 << BITS) * (i == BITS - 1)) for i in range(BITS)])
    flipped = F.transform(one_bit, lambda bit: F.col("fp").bitwiseXOR(bit))
    if radius == 2:
        named = many.select("fp", F.explode(F.concat(F.array("fp"), flipped)).alias("point"))
        low = named.groupBy("point").agg(F.min("fp").alias("low"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        many_links = named.join(low, "point").filter("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b"))
    else:
        other = many.select(F.col("fp").alias("b"))
        many_links = many.select(F.col("fp").alias("a"), F.explode(flipped).alias("b")).join(other, "b").select("a", "b")
    return few.unionAll(many_links).distinct()


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """One row per row of `docs`: (doc_id, fp, component_id).

    component_id is the smallest doc_id reachable over links between fingerprints, its own
    included; null where the whole component has null ids. Null and empty texts have fingerprint 0
    and are linked like any other. Repeated rows stay repeated. Other columns are not read. An
    empty table gives an empty result.
    """
    prints = land(fingerprints(docs, size), "fingerprints")
    classes = land(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = components(links(classes.select("fp"), radius, bucket)).withColumnsRenamed({"node": "fp"})
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(rooted.select("fp", "root").join(least, "root").select("fp", "component_id"), "fp").select(
        "doc_id", "fp", "component_id"
    )


def keep_first(docs: DataFrame, size: int = 3, radius: int = 2) -> DataFrame:
    """The rows of `docs` without near duplicates: of each component the one with the smallest doc_id.

    Columns are those of `docs`. Of several rows with that doc_id one stays. Rows without a doc_id
    stay: nothing names them as copies.
    """
    found = land(near_duplicates(docs, size, radius), "components")
    by_id = found.filter("doc_id is not null").groupBy("doc_id").agg(
        F.bool_or(F.col("doc_id") == F.col("component_id")).alias("first"), F.count(F.lit(1)).alias("n")
    )
    rest = docs.join(small_side(by_id.filter("not first").select("doc_id")), "doc_id", "left_anti")
    again = land(by_id.filter("first and n > 1").select("doc_id"), "repeated")
    if again.isEmpty():  # nothing to thin out
        return rest.select(*docs.columns)
    return rest.join(again, "doc_id", "left_anti").select(*docs.columns).unionAll(
        rest.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
    )


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
