"""Exact percentiles without holding a column's values in one task.

The built-in exact percentile keeps every distinct value of a group in memory, which a group with
a third of a huge table does not survive. Here a sketch of a sample brackets each wanted rank. The
brackets are checked by counting, moved if they missed, and narrowed by further sketches until
they hold a bounded number of rows. Only the values inside are then counted one by one; everything
outside collapses to one count. The result is exact whatever the distribution or the ties.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarrylight.functions.numbers import as_number
from quarrylight.session import materialize, null_safe_join, small_side

GRID = 1000
# A sketch reads about this many rows per group, so that merging the tasks' sketches stays small.
SKETCH_ROWS = 10_000_000


def _long_form(df: DataFrame, values: list[str], by: list[str]) -> DataFrame:
    ids = [F.col(f"`{k}`") for k in by]
    typed = df.select(*ids, *[as_number(F.col(f"`{c}`")).alias(c) for c in values])
    long = typed.unpivot([F.col(f"`{k}`") for k in by], [F.col(f"`{c}`") for c in values], "feature", "v")
    return long.where(F.col("v").isNotNull())


def _ranges(long: DataFrame, group: list[str], probs: list[float], settle: int) -> DataFrame:
    """Rows, wanted ranks and, as widest possible brackets, the range of every group."""
    sizes = long.groupBy(*group).agg(
        F.count("v").alias("n"), F.min("v").alias("lowest"), F.max("v").alias("highest")
    )
    out = [*group, "n", "lowest", "highest"]
    for i, p in enumerate(probs):
        position = F.lit(p) * (F.col("n") - 1)
        out += [
            F.floor(position).alias(f"k{i}"),
            (position - F.floor(position)).alias(f"part{i}"),
            F.col("lowest").alias(f"lo{i}"),
            F.col("highest").alias(f"hi{i}"),
            (F.col("n") <= settle).alias(f"ok{i}"),
        ]
    return sizes.select(*out)


def _sampled(joined: DataFrame, rows: Column, sketch_rows: int, seed: int) -> DataFrame:
    return joined.where(F.rand(seed) * rows < sketch_rows)


def _margin(accuracy: int, sketch_rows: int) -> float:
    """Share of the rows by which a sketched rank may be off, with six deviations for the sample."""
    return 3.0 / accuracy + 3.0 / math.sqrt(sketch_rows)


def _sketch(long: DataFrame, state: DataFrame, group: list[str], probs: list[float], accuracy: int, sketch_rows: int) -> DataFrame:
    """First brackets of the groups that are not settled."""
    margin = _margin(accuracy, sketch_rows)
    wanted = [q for p in probs for q in (max(0.0, p - margin), min(1.0, p + margin))]
    open_groups = state.where(~F.col("ok0")).select(*group, "n")
    sample = _sampled(null_safe_join(long, small_side(open_groups), group), F.col("n"), sketch_rows, 1)
    sketched = sample.groupBy(*group).agg(F.percentile_approx("v", wanted, accuracy).alias("q"))
    changes = {}
    for i in range(len(probs)):
        changes[f"lo{i}"] = F.coalesce(F.col("q")[2 * i], F.col(f"lo{i}"))
        changes[f"hi{i}"] = F.coalesce(F.col("q")[2 * i + 1], F.col(f"hi{i}"))
    return null_safe_join(state, sketched, group, "left").withColumns(changes).select(state.columns)


def _narrow(
    long: DataFrame, state: DataFrame, group: list[str], count: int, accuracy: int, settle: int, sketch_rows: int, seed: int
) -> DataFrame:
    """Count around every open bracket; settle, move or narrow it."""
    # One parsed literal instead of a thousand single ones.
    grid = F.expr("array(" + ", ".join(f"{g / GRID!r}D" for g in range(GRID + 1)) + ")")
    slack = 2 + math.ceil(GRID * _margin(accuracy, sketch_rows))
    settled = [F.col(f"ok{i}") for i in range(count)]
    unsettled = state.where(~F.greatest(*settled, F.lit(False)) | ~F.least(*settled, F.lit(True)))
    joined = null_safe_join(long, small_side(unsettled), group).withColumn("luck", F.rand(seed))
    aggs = []
    for i in range(count):
        lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
        inside = (F.col("v") > lo) & (F.col("v") < hi)
        drawn = inside & (F.col("luck") * F.col("n") < sketch_rows)
        aggs += [
            F.count_if(F.col("v") < lo).alias(f"below{i}"),
            F.count_if(F.col("v") <= lo).alias(f"upto{i}"),
            F.count_if(inside).alias(f"open{i}"),
            F.count_if(F.col("v") <= hi).alias(f"end{i}"),
            F.percentile_approx(F.when(drawn, F.col("v")), grid, accuracy).alias(f"grid{i}"),
        ]
    measured = null_safe_join(state, joined.groupBy(*group).agg(*aggs), group, "left")
    changes = {}
    for i in range(count):
        done, lo, hi = F.col(f"ok{i}"), F.col(f"lo{i}"), F.col(f"hi{i}")
        first, last = F.col(f"k{i}"), F.least(F.col(f"k{i}") + 1, F.col("n") - 1)
        upto, width, values = F.col(f"upto{i}"), F.col(f"open{i}"), F.col(f"grid{i}")
        early, late = first < F.col(f"below{i}"), last >= F.col(f"end{i}")
        cells = F.lit(float(GRID)) / F.greatest(width, F.lit(1))
        left = F.floor((first - upto) * cells) - slack
        right = F.ceil((last + 1 - upto) * cells) + slack
        changes[f"lo{i}"] = (
            F.when(done, lo)
            .when(early, F.col("lowest"))
            .when(late & (first >= F.col(f"end{i}")), hi)
            .when(late | (width <= settle) | (first < upto), lo)
            .when(first >= upto + width, hi)
            .otherwise(F.when(left >= 0, F.coalesce(F.get(values, left.cast("int")), lo)).otherwise(lo))
        )
        changes[f"hi{i}"] = (
            F.when(done, hi)
            .when(early & (last < F.col(f"below{i}")), lo)
            .when(late, F.col("highest"))
            .when(early | (width <= settle) | (last >= upto + width), hi)
            .when(last < upto, lo)
            .otherwise(F.when(right <= GRID, F.coalesce(F.get(values, right.cast("int")), hi)).otherwise(hi))
        )
        changes[f"ok{i}"] = done | (~early & ~late & (width <= settle))
    return measured.withColumns(changes).select(state.columns)


def _cells(joined: DataFrame, group: list[str], count: int) -> DataFrame:
    """Count values one by one inside the brackets and as one cell in every gap between them."""
    value = F.col("v")
    inside: Column = F.lit(False)
    gap: Column = F.lit(0)
    for i in range(count):
        inside = inside | value.between(F.col(f"lo{i}"), F.col(f"hi{i}"))
        gap = gap + F.when(value > F.col(f"hi{i}"), 1).otherwise(0)
    ranks = ["n", *[f"{name}{i}" for i in range(count) for name in ("k", "part")]]
    return (
        joined.groupBy(*group, gap.alias("gap"), F.when(inside, value).alias("exact"))
        .agg(F.count(F.lit(1)).alias("cnt"), F.max("v").alias("top"), *[F.max(r).alias(r) for r in ranks])
    )


def exact_percentiles(
    df: DataFrame,
    values: list[str],
    probs: list[float],
    by: list[str] | None = None,
    accuracy: int = 10_000,
    settle: int = 1_000_000,
    sketch_rows: int = SKETCH_ROWS,
) -> DataFrame:
    """Exact, linearly interpolated percentiles of numbers or numeric text; nulls, NaN and other text are skipped.

    Returns one row per group and column: (*by, feature, n, percentiles array in the order of
    probs). `settle` is the number of rows a bracket may hold in the end; groups up to that size
    take one counting pass only.
    """
    by = list(by or [])
    group = [*by, "feature"]
    order = sorted(range(len(probs)), key=lambda i: probs[i])
    sorted_probs = [probs[i] for i in order]

    long = _long_form(df, values, by)
    brackets = materialize(_ranges(long, group, sorted_probs, settle))
    return _settle(long, brackets, group, order, sorted_probs, accuracy, settle, sketch_rows)


def bracketed_percentiles(
    df: DataFrame, value: str, probs: list[float], by: list[str], known: DataFrame, accuracy: int = 10_000,
    settle: int = 1_000_000, sketch_rows: int = SKETCH_ROWS,
) -> DataFrame:
    """exact_percentiles of one column where `known` (*by, lo0, hi0, lo1, ...) says about where they lie.

    Brackets of a merged sketch save the pass that looks for them. One that misses its rank is moved.
    """
    group = [*by, "feature"]
    order = sorted(range(len(probs)), key=lambda i: probs[i])
    sorted_probs = [probs[i] for i in order]
    long = _long_form(df, [value], by)
    ranges = _ranges(long, group, sorted_probs, settle)
    named = known.select(*[F.col(f"`{k}`") for k in by], F.struct(*[c for c in known.columns if c not in by]).alias("_known"))
    joined = null_safe_join(ranges, named, by, "left")
    changes = {}
    for i, place in enumerate(order):
        inside = lambda c: F.greatest(F.least(c, F.col("highest")), F.col("lowest"))
        for side in ("lo", "hi"):
            found = F.when(~F.col(f"ok{i}"), inside(F.col(f"_known.{side}{place}")))
            changes[f"{side}{i}"] = F.coalesce(found, F.col(f"{side}{i}"))
    brackets = materialize(joined.withColumns(changes).select(ranges.columns))
    return _settle(long, brackets, group, order, sorted_probs, accuracy, settle, sketch_rows, sketched=True)


def _settle(
    long: DataFrame, brackets: DataFrame, group: list[str], order: list[int], sorted_probs: list[float], accuracy: int,
    settle: int, sketch_rows: int, sketched: bool = False,
) -> DataFrame:
    """Move and narrow the brackets until each holds few rows, then rank those."""
    count = len(order)
    all_settled = F.min(F.least(*[F.col(f"ok{i}") for i in range(count)], F.lit(True)))

    def settled() -> bool:
        return brackets.agg(all_settled).first()[0] is not False

    if not sketched and not settled():
        brackets = materialize(_sketch(long, brackets, group, sorted_probs, accuracy, sketch_rows))
    # A round divides the rows inside by 100 or so: a trillion rows take three, the last one a check.
    seed = 2
    while not settled():
        brackets = materialize(_narrow(long, brackets, group, count, accuracy, settle, sketch_rows, seed))
        seed += 1

    cells = _cells(null_safe_join(long, small_side(brackets, True), group), group, count)
    running = F.sum("cnt").over(W.partitionBy(*group).orderBy("top").rowsBetween(W.unboundedPreceding, 0))
    ranked = cells.withColumn("upto", running)
    picks = []
    for i in range(count):
        last = F.least(F.col(f"k{i}") + 1, F.col("n") - 1)
        for name, rank in ((f"a{i}", F.col(f"k{i}")), (f"b{i}", last)):
            hit = (F.col("upto") > rank) & (F.col("upto") - F.col("cnt") <= rank)
            found = F.coalesce(F.col("exact"), F.raise_error(F.lit("percentile bracket missed a rank")).cast("double"))
            picks.append(F.max(F.when(hit, found)).alias(name))
    picked = ranked.groupBy(*group).agg(
        F.first("n").alias("n"), *picks, *[F.first(f"part{i}").alias(f"part{i}") for i in range(count)]
    )
    place = {original: i for i, original in enumerate(order)}
    results = [
        F.col(f"a{place[j]}") + (F.col(f"b{place[j]}") - F.col(f"a{place[j]}")) * F.col(f"part{place[j]}")
        for j in range(count)
    ]
    return picked.select(*group, "n", F.array(*results).alias("percentiles"))


def exact_medians(df: DataFrame, values: list[str], by: list[str] | None = None, **limits) -> DataFrame:
    """(*by, feature, median)"""
    rows = exact_percentiles(df, values, [0.5], by, **limits)
    return rows.select(*(by or []), "feature", F.col("percentiles")[0].alias("median"))
