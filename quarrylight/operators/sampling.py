"""Deterministic random, stratified and balanced samples with exact sizes.

Rows are ordered by the md5 of key and seed, so a result depends neither on partitioning nor on
input order. The scan that counts the classes counts md5 prefixes, so it already tells in which prefix
the row at any wanted rank lies. A sample is then one more scan; a split compares each row with the
exact cut row, without sorting or shuffling the table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarrylight.operators.ordering import running_totals
from quarrylight.session import materialize, null_safe_join, small_side

SEED = 42
TEST_SHARE = 0.2
SAMPLE_ROWS = 50_000
SMALL_CLASS_ROWS = 1000
MAJORITY_RATIO = 20
# md5 digits counted while the classes are counted: a task sends at most 16 ** 3 counts for each class.
PREFIX_DIGITS = 3
# Rows of one class and prefix that one task ranks; beyond that longer prefixes are counted first.
EDGE_ROWS = 1_000_000


def _key_text(keys: list[str]) -> Column:
    """Key parts with their lengths, so that different keys, null parts included, have different texts."""
    parts = [F.col(f"`{k}`").cast("string") for k in keys]
    return F.concat(*[F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("~")) for p in parts])


def row_hash(keys: list[str], seed: int = SEED) -> Column:
    return F.md5(F.concat(_key_text(keys), F.lit(f":{seed}")))


def class_counts(df: DataFrame, target: str) -> DataFrame:
    return df.groupBy(target).agg(F.count(F.lit(1)).alias("rows"))


def class_shares(df: DataFrame, target: str) -> DataFrame:
    counts = materialize(class_counts(df, target))
    total = counts.agg(F.sum("rows")).first()[0]
    return counts.withColumn("share", F.col("rows") / F.lit(total))


def class_extremes(df: DataFrame, target: str) -> DataFrame:
    """Smallest and largest class and their sizes; ties go to the lower class value."""
    return extremes_of(class_counts(df, target), target)


def extremes_of(counts: DataFrame, target: str) -> DataFrame:
    known = counts.where(F.col(target).isNotNull())
    smallest = F.min(F.struct("rows", F.col(target)))
    return known.agg(
        F.count(F.lit(1)).alias("classes"),
        F.sum("rows").alias("total"),
        smallest[target].alias("minority_class"),
        smallest["rows"].alias("minority_rows"),
        F.min_by(target, F.struct(-F.col("rows"), F.col(target))).alias("majority_class"),
        F.max("rows").alias("majority_rows"),
    )


def proportional_quotas(counts: DataFrame, target: str, total: int, wanted: int) -> DataFrame:
    """Rows to take per class so that exactly `wanted` of `total` are taken in proportion.

    The part that stays behind is allotted by largest remainder (ties to the lower class), the
    sample is the rest.
    """
    kept = max(0, total - wanted)
    exact = F.col("rows").cast("decimal(20,0)") * F.lit(kept).cast("decimal(18,0)")
    base = F.call_function("div", exact, F.lit(total).cast("decimal(20,0)")).cast("bigint")
    parts = counts.withColumns({"_base": base, "_rest": F.pmod(exact, F.lit(total).cast("decimal(20,0)"))})
    missing = kept - (parts.agg(F.sum("_base")).first()[0] or 0)
    ranked = running_totals(parts.withColumn("_less", -F.col("_rest")), ["_less", target], "_place")
    kept_rows = F.col("_base") + F.when(F.col("_place") <= missing, 1).otherwise(0)
    return ranked.withColumn("quota", F.col("rows") - kept_rows).select(target, "rows", "quota")


def prefix_counts(df: DataFrame, keys: list[str], strata: list[str], seed: int = SEED, digits: int = PREFIX_DIGITS) -> DataFrame:
    """(*strata, _p, _n): rows by the first md5 digits, at most 16 ** digits for each stratum.

    One scan gives the size of every class and, whatever number is wanted of it, the prefix in which
    its last wanted row lies: the counts are kept while counting, as a bottom-k of any k.
    """
    hashed = df.select(*strata, F.substring(row_hash(keys, seed), 1, digits).alias("_p"))
    return hashed.groupBy(*strata, "_p").agg(F.count(F.lit(1)).alias("_n"))


def _edges(cells: DataFrame, strata: list[str], quotas: DataFrame) -> DataFrame:
    """(*strata, _edge, _left): the prefix in which a quota ends and how many rows of it belong."""
    upto = F.sum("_n").over(W.partitionBy(*strata).orderBy("_p").rowsBetween(W.unboundedPreceding, 0))
    known = null_safe_join(cells.withColumn("_upto", upto), quotas, strata)
    edge = known.where((F.col("_upto") >= F.col("quota")) & (F.col("_upto") - F.col("_n") < F.col("quota")))
    return edge.select(*strata, F.col("_p").alias("_edge"), (F.col("quota") - (F.col("_upto") - F.col("_n"))).alias("_left"))


def _near(df: DataFrame, keys: list[str], strata: list[str], edges: DataFrame, seed: int) -> DataFrame:
    """The rows up to the edge of their class, with _h, _k and whether they lie in the edge prefix itself."""
    hashed = df.withColumns({"_h": row_hash(keys, seed), "_k": _key_text(keys)})
    joined = null_safe_join(hashed, small_side(edges), strata)
    prefix = F.substring("_h", 1, F.length("_edge"))
    return joined.withColumn("_at_edge", prefix == F.col("_edge")).where(prefix <= F.col("_edge"))


def _cuts(rows: DataFrame, strata: list[str], edge_rows: int) -> DataFrame:
    """Per stratum the (md5, key) of the row in place _left of materialised rows from one prefix."""
    narrow, digits = rows.select(*strata, "_h", "_k", "_left"), PREFIX_DIGITS
    while digits < 32 and (narrow.groupBy(*strata).count().agg(F.max("count")).first()[0] or 0) > edge_rows:
        digits += PREFIX_DIGITS
        cells = narrow.groupBy(*strata, F.substring("_h", 1, digits).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
        edges = _edges(cells, strata, narrow.groupBy(*strata).agg(F.first("_left").alias("quota")))
        joined = null_safe_join(narrow.drop("_left"), small_side(edges), strata)
        narrow = materialize(joined.where(F.substring("_h", 1, digits) == F.col("_edge")).drop("_edge"))
    place = F.row_number().over(W.partitionBy(*strata).orderBy("_h", "_k"))
    last = narrow.withColumn("_place", place).where(F.col("_place") == F.col("_left"))
    return last.select(*strata, F.struct(F.col("_h"), F.col("_k")).alias("_cut"))


def mark_sample(
    df: DataFrame, keys: list[str], quotas: DataFrame, target: str, output: str, cells: DataFrame, seed: int = SEED,
    edge_rows: int = EDGE_ROWS,
) -> DataFrame:
    """Add a boolean column: the row is among its class's first `quota` rows by md5.

    `keys` must identify a row, `cells` are the table's prefix_counts. Classes without a quota row, or
    with quota 0, get false. Two scans: one for the rows in the edge prefixes, one to mark all rows.
    """
    edges = materialize(_edges(cells, [target], small_side(quotas.where("quota > 0").select(target, "quota"))))
    narrow = df.select(*dict.fromkeys([target, *keys]))
    at_edge = materialize(_near(narrow, keys, [target], edges, seed).where("_at_edge"))
    cuts = _cuts(at_edge, [target], edge_rows)
    here = F.struct(row_hash(keys, seed).alias("_h"), _key_text(keys).alias("_k"))
    joined = null_safe_join(df, small_side(cuts), [target], "left")
    return joined.withColumn(output, F.coalesce(here <= F.col("_cut"), F.lit(False))).drop("_cut")


def take_sample(
    df: DataFrame, keys: list[str], quotas: DataFrame, target: str, cells: DataFrame, seed: int = SEED, edge_rows: int = EDGE_ROWS,
) -> DataFrame:
    """The first `quota` rows of each class by md5, in one scan besides that of `cells`.

    Rows before the edge prefix are taken as they come; only those in it are ranked.
    """
    edges = materialize(_edges(cells, [target], small_side(quotas.where("quota > 0").select(target, "quota"))))
    near = materialize(_near(df, keys, [target], edges, seed))
    cuts = small_side(_cuts(near.where("_at_edge"), [target], edge_rows))
    within = null_safe_join(near, cuts, [target]).where(~F.col("_at_edge") | (F.struct("_h", "_k") <= F.col("_cut")))
    return within.select(df.columns)


def _sizes(cells: DataFrame, target: str) -> DataFrame:
    return cells.groupBy(target).agg(F.sum("_n").alias("rows"))


def random_split(df: DataFrame, keys: list[str], share: float = TEST_SHARE, seed: int = SEED, edge_rows: int = EDGE_ROWS) -> DataFrame:
    """Add `split`: the first ceil(share * n) rows by md5 are 'test', the others 'train'."""
    whole = df.withColumn("_all", F.lit(0))
    cells = materialize(prefix_counts(whole, keys, ["_all"], seed))
    total = cells.agg(F.sum("_n")).first()[0] or 0
    quotas = whole.sparkSession.range(1).select(
        F.lit(0).alias("_all"), F.lit(math.ceil(share * total)).cast("bigint").alias("quota")
    )
    marked = mark_sample(whole, keys, quotas, "_all", "_test", cells, seed, edge_rows)
    return marked.withColumn("split", F.when(F.col("_test"), "test").otherwise("train")).drop("_all", "_test")


def stratified_split(df: DataFrame, keys: list[str], target: str, share: float = TEST_SHARE, seed: int = SEED, edge_rows: int = EDGE_ROWS) -> DataFrame:
    """Like random_split, with every class represented in proportion."""
    cells = materialize(prefix_counts(df, keys, [target], seed))
    counts = _sizes(cells, target)
    total = counts.agg(F.sum("rows")).first()[0] or 0
    quotas = proportional_quotas(counts, target, total, math.ceil(share * total))
    marked = mark_sample(df, keys, quotas, target, "_test", cells, seed, edge_rows)
    return marked.withColumn("split", F.when(F.col("_test"), "test").otherwise("train")).drop("_test")


def balance(
    df: DataFrame,
    keys: list[str],
    target: str,
    sample_rows: int = SAMPLE_ROWS,
    small_class_rows: int = SMALL_CLASS_ROWS,
    majority_ratio: int = MAJORITY_RATIO,
    seed: int = SEED,
    edge_rows: int = EDGE_ROWS,
) -> DataFrame:
    """Shrink a table for training.

    Up to sample_rows: unchanged. Otherwise, if the smallest class has fewer than small_class_rows
    rows, that class stays whole and the largest class is cut to majority_ratio times its size;
    classes in between drop out. Otherwise a proportional sample of exactly sample_rows is taken.
    """
    cells = materialize(prefix_counts(df, keys, [target], seed))
    counts = _sizes(cells, target)
    total = counts.agg(F.sum("rows")).first()[0] or 0
    if total <= sample_rows:
        return df
    size = extremes_of(counts, target).first()
    if size["minority_rows"] < small_class_rows:
        # The smallest class whole and a part of the largest are quotas too; other classes have none.
        take = min(size["majority_rows"], majority_ratio * size["minority_rows"])
        wanted = F.when(F.col(target) == F.lit(size["majority_class"]), F.lit(take)).when(
            F.col(target) == F.lit(size["minority_class"]), F.col("rows")
        )
        quotas = counts.where(F.col(target).isin(size["minority_class"], size["majority_class"])).select(target, wanted.cast("bigint").alias("quota"))
    else:
        quotas = proportional_quotas(counts, target, total, sample_rows)
    return take_sample(df, keys, quotas, target, cells, seed, edge_rows)
