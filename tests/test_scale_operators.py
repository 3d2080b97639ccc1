"""Operators that avoid one-task windows and groups, against plain computations on skewed data."""

import math
import statistics

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylight.operators import ordering, percentiles, sampling
from quarrylight.session import materialize, null_safe_join, shared_dir, small_side


@pytest.fixture(scope="module")
def skewed(spark):
    """3000 rows: group 'hot' has two thirds of them, and one value half of its rows."""
    return materialize(
        spark.range(3000).select(
            F.col("id"),
            F.when(F.col("id") % 3 < 2, "hot").when(F.col("id") % 2 == 0, "a").otherwise(F.lit(None)).alias("g"),
            F.when(F.col("id") % 6 < 3, 0.0).otherwise(F.exp(F.col("id") / 300)).alias("x"),
            F.when(F.col("id") % 7 == 0, F.lit(float("nan"))).when(F.col("id") % 5 == 0, None).otherwise(-F.col("id")).alias("y"),
        )
    )


def linear(values, p):
    values = sorted(values)
    place = p * (len(values) - 1)
    low = math.floor(place)
    high = min(low + 1, len(values) - 1)
    return values[low] + (values[high] - values[low]) * (place - low)


PROBS = [0.99, 0.5, 0.501, 0.0, 1.0]


@pytest.mark.parametrize("limits", [{}, {"accuracy": 50, "settle": 100, "sketch_rows": 100_000}, {"accuracy": 500, "settle": 5, "sketch_rows": 800}])
def test_percentiles(spark, skewed, limits):
    found = percentiles.exact_percentiles(skewed, ["x", "y"], PROBS, ["g"], **limits).collect()
    rows = skewed.collect()
    assert len(found) == 6
    for line in found:
        values = [r[line["feature"]] for r in rows if r["g"] == line["g"]]
        values = [v for v in values if v is not None and not math.isnan(v)]
        assert line["n"] == len(values)
        assert line["percentiles"] == pytest.approx([linear(values, p) for p in PROBS])


def test_median_of_even_count(spark):
    rows = spark.createDataFrame([(float(v),) for v in (1, 2, 4, 8)], "x double")
    assert percentiles.exact_medians(rows, ["x"]).first()["median"] == statistics.median([1, 2, 4, 8])


def test_percentiles_without_values(spark):
    rows = spark.createDataFrame([(None,)], "x double")
    assert percentiles.exact_medians(rows, ["x"]).count() == 0


@pytest.fixture(scope="module")
def timed(spark):
    """One moment holds a third of the rows."""
    moment = F.when(F.col("id") % 3 == 0, F.lit(500)).otherwise(F.col("id"))
    return materialize(
        spark.range(1500).select(
            "id", (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=moment)).alias("ts"),
            (F.col("id") % 2).alias("run"), (F.col("id") * 0.25).alias("v"),
        )
    )


@pytest.mark.parametrize("rows_per_bucket", [50, 1_000_000])
def test_running_totals(spark, timed, rows_per_bucket):
    found = ordering.running_totals(timed, ["ts", "id"], "no", {"total": "v"}, rows_per_bucket)
    window = W.orderBy("ts", "id")
    wanted = timed.withColumns({"no": F.row_number().over(window), "total": F.sum("v").over(window.rowsBetween(W.unboundedPreceding, 0))})
    key = lambda df: sorted((r["id"], r["no"], r["total"]) for r in df.collect())
    assert key(found) == key(wanted)


@pytest.mark.parametrize("order", [["ts", "id"], ["ts"], ["none"]])
def test_hot_moment_is_cut(timed, order):
    cut, buckets = ordering.order_buckets(timed.withColumn("none", F.lit(None).cast("date")), order, 50)
    sizes = cut.groupBy("_bucket").count().agg(F.count("count").alias("cells"), F.max("count").alias("largest")).first()
    assert buckets == 30 and sizes["cells"] <= 30 and sizes["largest"] < 150


def test_many_hot_moments_make_no_more_cells(spark):
    hot = spark.range(20_000).select("id", (F.col("id") % 100).alias("at"), F.col("id").cast("string").alias("key"))
    cut, _ = ordering.order_buckets(hot, ["at", "key"], 50)
    assert cut.select("_bucket").distinct().count() <= 400


@pytest.mark.parametrize("rows_per_bucket", [40, 1_000_000])
def test_order_of_text_and_missing_values(spark, rows_per_bucket):
    """Text as tie-break, a third of the order values missing, sums whose first values are missing."""
    rows = spark.range(600).select(
        F.when(F.col("id") % 3 > 0, (F.col("id") % 5)).alias("at"), F.concat(F.lit("k"), F.col("id")).alias("key"),
        F.when(F.col("id") % 3 > 0, F.col("id")).alias("v"), F.when(F.col("id") % 2 == 0, F.col("id") % 4).alias("run"),
    )
    found = ordering.running_totals(rows, ["at", "key"], "no", {"total": "v"}, rows_per_bucket)
    found = ordering.previous_values(found, ["run"], ["at", "key"], {"before": "key"}, rows_per_bucket)
    window = W.orderBy("at", "key")
    wanted = rows.withColumns({
        "no": F.row_number().over(window), "total": F.sum("v").over(window.rowsBetween(W.unboundedPreceding, 0)),
        "before": F.lag("key").over(W.partitionBy("run").orderBy("at", "key")),
    })
    key = lambda df: sorted(((r["key"], r["no"], r["total"], r["before"]) for r in df.collect()), key=lambda x: x[1])
    assert key(found) == key(wanted)


@pytest.mark.parametrize("rows_per_bucket", [50, 1_000_000])
def test_previous_values(spark, timed, rows_per_bucket):
    found = ordering.previous_values(timed, ["run"], ["ts", "id"], {"before": "v"}, rows_per_bucket)
    wanted = timed.withColumn("before", F.lag("v").over(W.partitionBy("run").orderBy("ts", "id")))
    key = lambda df: sorted((r["id"], r["before"] or -1.0) for r in df.collect())
    assert key(found) == key(wanted)


@pytest.mark.parametrize("edge_rows", [10, 1_000_000])
def test_random_split(spark, skewed, edge_rows):
    one = sampling.random_split(skewed, ["id"], edge_rows=edge_rows)
    other = sampling.random_split(skewed.repartition(7), ["id"])
    tests = {r["id"] for r in one.where("split = 'test'").collect()}
    assert len(tests) == 600 and one.count() == 3000
    assert tests == {r["id"] for r in other.where("split = 'test'").collect()}
    assert tests != {r["id"] for r in sampling.random_split(skewed, ["id"], seed=7).where("split = 'test'").collect()}


def test_odd_split_rounds_up(spark):
    assert sampling.random_split(spark.range(7), ["id"]).where("split = 'test'").count() == 2


def test_stratified_split(spark, skewed):
    counts = {
        (r["g"], r["split"]): r["count"]
        for r in sampling.stratified_split(skewed, ["id"], "g", edge_rows=50).groupBy("g", "split").count().collect()
    }
    assert counts == {
        ("hot", "test"): 400, ("hot", "train"): 1600, ("a", "test"): 100, ("a", "train"): 400, (None, "test"): 100, (None, "train"): 400,
    }


def test_quotas_add_up(spark):
    counts = spark.createDataFrame([("a", 5), ("b", 5), ("c", 4), ("d", 1)], "k string, rows long")
    for wanted in range(16):
        rows = sampling.proportional_quotas(counts, "k", 15, wanted).collect()
        assert sum(r["quota"] for r in rows) == wanted
        assert all(abs(r["quota"] - wanted * r["rows"] / 15) <= 1 for r in rows)


def test_balance(spark):
    rows = spark.range(1000).select(
        "id", F.when(F.col("id") < 20, "rare").when(F.col("id") < 300, "mid").otherwise("big").alias("k")
    )
    sizes = lambda df: {r["k"]: r["count"] for r in df.groupBy("k").count().collect()}
    assert sizes(sampling.balance(rows, ["id"], "k")) == {"rare": 20, "mid": 280, "big": 700}
    under = sampling.balance(rows, ["id"], "k", sample_rows=500, small_class_rows=21)
    assert sizes(under) == {"rare": 20, "big": 400}
    assert sizes(sampling.balance(rows, ["id"], "k", sample_rows=500, small_class_rows=21, majority_ratio=99)) == {"rare": 20, "big": 700}
    assert sizes(sampling.balance(rows, ["id"], "k", sample_rows=500, small_class_rows=20)) == {"rare": 10, "mid": 140, "big": 350}


def test_class_extremes_break_ties_by_class(spark):
    rows = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), ("d",), ("d",)], "k string")
    row = sampling.class_extremes(rows, "k").first()
    assert (row["minority_class"], row["majority_class"], row["total"]) == ("a", "c", 6)


def test_small_side_measures(spark, monkeypatch):
    table = spark.range(10)
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(small_side(table))
    monkeypatch.setattr("quarrylight.session.BROADCAST_ROWS", 5)
    assert not hinted(small_side(table))
    monkeypatch.setattr("quarrylight.session.BROADCAST_ROWS", 100)
    monkeypatch.setattr("quarrylight.session.BROADCAST_BYTES", 20)
    assert not hinted(small_side(table))


def test_null_safe_join(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2)], "k string, v int")
    right = spark.createDataFrame([(None, 3), ("b", 4)], "k string, w int")
    assert sorted(map(tuple, null_safe_join(left, right, ["k"], "left").collect()), key=str) == [("a", 2, None), (None, 1, 3)]


def test_checkpoint_dir_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
