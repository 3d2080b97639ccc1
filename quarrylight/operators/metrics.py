"""Hold-out metrics from (label, prediction) columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.numbers import guarded_ratio
from quarrylight.session import materialize


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(label, prediction, rows)"""
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("rows")
    )


def accuracy(df: DataFrame, label: str, prediction: str) -> DataFrame:
    hit = (F.col(label) == F.col(prediction)).cast("double")
    return df.agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("rows"))


def class_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support per class; an undefined ratio is 0.

    The data is read once, for the small confusion table.
    """
    hit = F.when(F.col("label") == F.col("prediction"), F.col("rows")).otherwise(0)
    none = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("label").alias("class"), F.col("rows").alias("actual"), none.alias("predicted"), hit.alias("hits")),
        F.struct(F.col("prediction").alias("class"), none.alias("actual"), F.col("rows").alias("predicted"), none.alias("hits")),
    )
    totals = (
        materialize(confusion(df, label, prediction))
        .select(F.inline(sides))
        .groupBy("class")
        .agg(*[F.sum(c).alias(c) for c in ("actual", "predicted", "hits")])
    )
    precision, recall = (guarded_ratio(F.col("hits"), F.col(c)) for c in ("predicted", "actual"))
    scored = totals.select("class", precision.alias("precision"), recall.alias("recall"), F.col("actual").alias("support"))
    both = F.col("precision") + F.col("recall")
    return scored.select(
        "class", "precision", "recall", guarded_ratio(2 * F.col("precision") * F.col("recall"), both).alias("f1"), "support"
    )


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """class_report plus the rows 'accuracy', 'macro avg' and 'weighted avg'."""
    per_class = class_report(df, label, prediction)
    names = ["precision", "recall", "f1"]
    macro = per_class.agg(*[F.avg(n).alias(n) for n in names], F.sum("support").alias("support"))
    weight = F.col("support")
    weighted = per_class.agg(
        *[guarded_ratio(F.sum(F.col(n) * weight), F.sum(weight)).alias(n) for n in names], F.sum(weight).alias("support")
    )
    hits = per_class.agg(
        guarded_ratio(F.sum(F.col("recall") * weight), F.sum(weight)).alias("f1"), F.sum(weight).alias("support")
    )
    rows = per_class.withColumn("class", F.col("class").cast("string"))
    order = ["class", *names, "support"]
    empty = F.lit(None).cast("double")
    return (
        rows.select(order)
        .unionByName(hits.select(F.lit("accuracy").alias("class"), empty.alias("precision"), empty.alias("recall"), "f1", "support"))
        .unionByName(macro.select(F.lit("macro avg").alias("class"), *names, "support"))
        .unionByName(weighted.select(F.lit("weighted avg").alias("class"), *names, "support"))
    )


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Root mean squared error and R2 in one pass."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    sums = df.agg(
        F.count(F.lit(1)).alias("rows"), F.sum((y - p) * (y - p)).alias("residual"), F.var_pop(y).alias("variance")
    )
    spread = F.col("variance") * F.col("rows")
    r2 = F.when(spread > 0, 1 - F.col("residual") / spread).otherwise(F.when(F.col("residual") == 0, 1.0).otherwise(0.0))
    return sums.select("rows", F.sqrt(F.col("residual") / F.col("rows")).alias("rmse"), r2.alias("r2"))
