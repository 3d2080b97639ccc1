"""Row numbers, running totals and previous-row values over an order no single task can hold.

A window without partition keys, or with a hot key, moves its whole partition to one task. Here
the table is cut into ranges of the whole order, ties included; windows run inside the ranges and
a small table, one row for each range, carries totals or last rows across.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarrylight.session import materialize, small_side

ROWS_PER_BUCKET = 1_000_000
# Ranges whose totals are carried together: carrying takes two levels, so no task sees all ranges' rows.
CARRY_GROUP = 10_000


def _tie_break(df: DataFrame) -> Column:
    """A hash of the row, so that rows with equal order values have an order and can be cut apart."""
    plain = [name for name, dtype in df.dtypes if "map<" not in dtype and dtype != "variant"]
    return F.xxhash64(*[F.col(f"`{name}`") for name in plain])


def order_buckets(df: DataFrame, order: list[str], rows_per_bucket: int = ROWS_PER_BUCKET) -> tuple[DataFrame, int]:
    """The table with `_tie` and `_bucket`, and the number of buckets.

    Buckets are ranges of (order, `_tie`) as Spark sorts them: any type of column, missing values
    first. Only rows alike in every column cannot be cut apart.
    """
    tied = df.withColumn("_tie", _tie_break(df))
    buckets = max(1, math.ceil(df.count() / rows_per_bucket))
    if buckets == 1:
        return tied.withColumn("_bucket", F.lit(0)), 1
    ranged = tied.repartitionByRange(buckets, *order, "_tie").withColumn("_bucket", F.spark_partition_id())
    return materialize(ranged), buckets


def _plus(value: Column, carried: Column) -> Column:
    """The sum of what is there; null if neither is."""
    zero = F.lit(0)
    return F.when(value.isNotNull() | carried.isNotNull(), F.coalesce(value, zero) + F.coalesce(carried, zero))


def _totals_before(bucketed: DataFrame, sums: dict[str, str]) -> DataFrame:
    """(_bucket, _c_0, _c_1, ...): rows and sums of all earlier buckets."""
    totals = materialize(
        bucketed.groupBy("_bucket").agg(
            F.count(F.lit(1)).alias("_s_0"), *[F.sum(c).alias(f"_s_{i}") for i, c in enumerate(sums.values(), 1)]
        ).withColumn("_group", F.floor(F.col("_bucket") / CARRY_GROUP))
    )
    places = range(len(sums) + 1)
    groups = totals.groupBy("_group").agg(*[F.sum(f"_s_{i}").alias(f"_t_{i}") for i in places])
    earlier = W.orderBy("_group").rowsBetween(W.unboundedPreceding, -1)
    groups = groups.select("_group", *[F.sum(f"_t_{i}").over(earlier).alias(f"_g_{i}") for i in places])
    before = W.partitionBy("_group").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    return totals.join(groups, "_group").select(
        "_bucket", *[_plus(F.sum(f"_s_{i}").over(before), F.col(f"_g_{i}")).alias(f"_c_{i}") for i in places]
    )


def running_totals(
    df: DataFrame,
    order: list[str],
    number: str | None = None,
    sums: dict[str, str] | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Global row number and running sums of columns over the given order.

    Missing order values come first. A running sum is null until the column's first value.
    """
    sums = sums or {}
    out, buckets = order_buckets(df, order, rows_per_bucket)
    inside = W.partitionBy("_bucket").orderBy(*order, "_tie")
    to_here = inside.rowsBetween(W.unboundedPreceding, 0)
    found = {name: F.sum(column).over(to_here) for name, column in sums.items()}
    if number:
        found[number] = F.row_number().over(inside).cast("bigint")
    if buckets > 1:
        carried = small_side(_totals_before(out, sums))
        place = {name: i for i, name in enumerate(sums, 1)} | ({number: 0} if number else {})
        out = out.join(carried, "_bucket")
        found = {name: _plus(value, F.col(f"_c_{place[name]}")) for name, value in found.items()}
    return out.withColumns(found).drop("_tie", "_bucket", *[f"_c_{i}" for i in range(len(sums) + 1)])


def previous_values(
    df: DataFrame,
    run: list[str],
    order: list[str],
    columns: dict[str, str],
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """`columns` maps new names to columns whose value in the previous row of the run is wanted.

    Buckets are ranges of (run, order), so a run lies in one bucket or in neighbours, and only the
    first row of a bucket can have its predecessor elsewhere: in the last row of the one before.
    """
    out, buckets = order_buckets(df, [*run, *order], rows_per_bucket)
    values = F.struct(*[F.col(c).alias(n) for n, c in columns.items()])
    inside = W.partitionBy("_bucket", *run).orderBy(*order, "_tie")
    out = out.withColumn("_prev", F.lag(values).over(inside))
    value = F.col("_prev")
    if buckets > 1:
        of_run = F.struct(*[F.col(c).alias(f"r{i}") for i, c in enumerate(run)])
        tails = out.groupBy("_bucket").agg(
            F.max_by(F.struct(of_run.alias("run"), values.alias("values")), F.struct(*run, *order, "_tie")).alias("_tail")
        )
        # One row for each bucket.
        carried = tails.select("_bucket", F.lag("_tail").over(W.orderBy("_bucket")).alias("_carry"))
        out = out.join(small_side(carried), "_bucket")
        first = (F.row_number().over(inside) == 1) & F.col("_carry.run").eqNullSafe(of_run)
        out = out.withColumn("_prev", F.when(first, F.col("_carry.values")).otherwise(value))
    return out.withColumns({name: F.col("_prev")[name] for name in columns}).drop("_tie", "_bucket", "_prev", "_carry")
