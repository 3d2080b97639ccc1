"""Column profile, usable-feature rules and numeric/categorical typing."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.functions.numbers import looks_numeric, null_if_nan

# Limits and names of the drop rules.
MAX_DISTINCT_SHARE = 0.5
MAX_NULL_SHARE = 0.3
DENIED_NAMES = ["timestamp", "date", "time", "src_ip", "dst_ip", "attack"]
TARGET_NAME = "Label"
TARGET_FALLBACKS = ["label", "target", "class"]
PROBE_ROWS = 100
# Distinct values are sketched with 2 ** SKETCH_BITS registers: a relative standard error of 1.04 / sqrt(2 ** 14),
# 0.82 percent, for merged sketches. A verdict rests on a sketch only beyond MARGIN from the limit, six of them.
SKETCH_BITS = 14
SKETCH_ERROR = 1.04 / math.sqrt(2**SKETCH_BITS)
MARGIN = 6 * SKETCH_ERROR


def resolve_target(df: DataFrame, preferred: str = TARGET_NAME) -> str:
    """The preferred target name if present, else the first fallback that is."""
    for name in [preferred, *TARGET_FALLBACKS]:
        if name in df.columns:
            return name
    raise ValueError(f"no target column among {df.columns}")


def table_shape(df: DataFrame) -> DataFrame:
    """(rows, columns, names)"""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        F.lit(",".join(df.columns)).alias("names"),
    )


def _reason(distinct: Column, nulls: Column, rows: Column, name: Column) -> Column:
    return (
        F.when(distinct > rows * MAX_DISTINCT_SHARE, "distinct")
        .when(F.try_divide(nulls, rows) > MAX_NULL_SHARE, "nulls")
        .when(F.lower(name).isin(DENIED_NAMES), "name")
    )


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, rows, distinct, nulls), exact, NaN counting as null.

    Every column is grouped on its own: a narrow scan, repeated values collapse before the
    shuffle, and a frequent value costs its reducer one row per task. A single aggregate over all
    columns would copy each row once per column instead. The columns of a row format such as CSV
    share one scan, so store such a file as a columnar table first.
    """
    dtypes = dict(df.dtypes)
    parts = []
    for name in columns:
        grouped = df.groupBy(null_if_nan(name, dtypes[name]).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        parts.append(
            grouped.agg(
                F.lit(name).alias("column"),
                F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
                F.count("v").alias("distinct"),
                F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def _comparable(name: str, dtype: str) -> Column:
    """Text that is equal exactly where the values are: 0 and -0 alike, timestamps as instants."""
    column = null_if_nan(name, dtype)
    if dtype in ("double", "float"):
        return (column + F.lit(0.0).cast(dtype)).cast("string")
    if dtype == "timestamp":
        return F.unix_micros(column).cast("string")
    if dtype == "binary":
        return F.hex(column)
    return F.to_json(F.struct(column)) if "<" in dtype else column.cast("string")


def distinct_together(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, distinct), exact, for all the columns in one scan; repeated values collapse before the shuffle."""
    dtypes = dict(df.dtypes)
    entries = [F.struct(F.lit(i).alias("c"), _comparable(c, dtypes[c]).alias("v")) for i, c in enumerate(columns)]
    values = df.select(F.inline(F.array(*entries))).where("v IS NOT NULL").groupBy("c", "v").agg(F.count(F.lit(1)))
    names = F.array(*[F.lit(c) for c in columns])
    return values.groupBy("c").agg(F.count(F.lit(1)).alias("distinct")).select(F.get(names, F.col("c")).alias("column"), "distinct")


def column_sketches(df: DataFrame) -> DataFrame:
    """(column, rows, nulls, sketch) in one scan: a mergeable sketch of each column's distinct values.

    Values are hashed to 64 bits; NaN counts as null. Store the rows with each batch of a growing table
    and merge them, instead of scanning the table again.
    """
    measures = []
    for i, (name, dtype) in enumerate(df.dtypes):
        value = null_if_nan(name, dtype)
        hashed = F.when(value.isNotNull(), F.xxhash64(_comparable(name, dtype)))
        measures += [F.hll_sketch_agg(hashed, SKETCH_BITS).alias(f"s{i}"), F.count_if(value.isNull()).alias(f"z{i}")]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *measures)
    entries = [
        F.struct(F.lit(name).alias("column"), F.col(f"z{i}").alias("nulls"), F.col(f"s{i}").alias("sketch"))
        for i, name in enumerate(df.columns)
    ]
    return row.select("rows", F.inline(F.array(*entries))).select("column", "rows", "nulls", "sketch")


def merge_sketches(parts: DataFrame) -> DataFrame:
    """The sketches of a whole table from those of its parts (the union of column_sketches)."""
    return parts.groupBy("column").agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.hll_union_agg("sketch").alias("sketch")
    )


def sketched_counts(sketches: DataFrame) -> DataFrame:
    """(column, rows, distinct, nulls), with the distinct values estimated."""
    return sketches.select("column", "rows", F.hll_sketch_estimate("sketch").alias("distinct"), "nulls")


def sketched_reasons(sketches: DataFrame, df: DataFrame | None = None) -> dict[str, str | None]:
    """The profile's verdict per column from sketches.

    Where an estimate lies within MARGIN of the limit, the distinct values of those columns are counted
    exactly, in one scan of `df`; without `df` the estimate decides. Six standard errors are exceeded
    about once in a billion columns.
    """
    seen = {r["column"]: r for r in sketched_counts(sketches).collect()}
    near = [
        c for c, r in seen.items()
        if r["distinct"] * (1 - MARGIN) <= r["rows"] * MAX_DISTINCT_SHARE < r["distinct"] * (1 + MARGIN) + 1
    ]
    exact = {}
    if df is not None and near:
        exact = {c: 0 for c in near} | {r["column"]: r["distinct"] for r in distinct_together(df, near).collect()}
    reasons: dict[str, str | None] = {}
    for name, r in seen.items():
        if not r["rows"]:
            reasons[name] = None
        elif exact.get(name, r["distinct"]) > r["rows"] * MAX_DISTINCT_SHARE:
            reasons[name] = "distinct"
        elif r["nulls"] / r["rows"] > MAX_NULL_SHARE:
            reasons[name] = "nulls"
        else:
            reasons[name] = "name" if name.lower() in DENIED_NAMES else None
    return reasons


def profile_columns(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Per column: rows, distinct values, null share and why the column is unusable (or null).

    NaN counts as null; nulls are no distinct value. approximate=True estimates the distinct
    values in a single pass, with a relative standard error of SKETCH_ERROR.
    """
    counts = sketched_counts(column_sketches(df)) if approximate else value_counts(df, df.columns)
    reason = _reason(F.col("distinct"), F.col("nulls"), F.col("rows"), F.col("column"))
    share = F.try_divide(F.col("nulls"), F.col("rows"))
    return counts.select("column", "rows", "distinct", share.alias("null_share"), reason.alias("drop_reason"))


def drop_reasons(df: DataFrame) -> dict[str, str | None]:
    """The profile's verdict per column in at most two scans, whatever the number of columns.

    The first sketches all columns; the second counts exactly those whose sketch lies near the limit.
    """
    reasons = sketched_reasons(column_sketches(df), df)
    return {name: reasons.get(name) for name in df.columns}


def column_kinds(df: DataFrame, columns: list[str], order: list[str], probe_rows: int | None = PROBE_ROWS) -> DataFrame:
    """(column, kind): numeric types are numeric, text is if its first rows all parse as numbers.

    "First" needs an order; probe_rows=None looks at the whole column instead.
    """
    texts = [c for c in columns if not isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType))]
    probe = df.select(*order, *[c for c in texts if c not in order])
    if probe_rows is not None:
        probe = probe.orderBy(*order).limit(probe_rows)
    row = probe.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.min(looks_numeric(F.col(f"`{c}`"))).alias(f"t{i}") for i, c in enumerate(texts)],
    )
    verdict = {c: F.coalesce(F.col(f"t{i}"), F.lit(True)) for i, c in enumerate(texts)}
    entries = [
        F.struct(
            F.lit(c).alias("column"),
            F.when(verdict.get(c, F.lit(True)), "numeric").otherwise("categorical").alias("kind"),
        )
        for c in columns
    ]
    return row.select(F.inline(F.array(*entries)))


def select_features(
    df: DataFrame, target: str | None = None, order: list[str] | None = None, probe_rows: int | None = None
) -> tuple[str, list[str], list[str]]:
    """(target, numeric features, categorical features) in table order.

    Text is typed by the whole column unless probe_rows asks for the first rows in the given order.
    """
    target = target or resolve_target(df)
    reasons = drop_reasons(df)
    usable = [c for c in df.columns if reasons[c] is None and c != target]
    if not usable:
        return target, [], []
    kinds = {r["column"]: r["kind"] for r in column_kinds(df, usable, order or [df.columns[0]], probe_rows).collect()}
    return (
        target,
        [c for c in usable if kinds[c] == "numeric"],
        [c for c in usable if kinds[c] == "categorical"],
    )
