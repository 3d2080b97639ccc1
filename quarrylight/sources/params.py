"""Fitted parameters as tables, and parameters and model metadata as JSON files.

The tables hold any number of categories, one row each. A JSON file is one document, so the task that
writes it holds all of it; Spark derives it from the tables, and the driver does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators import preprocess
from quarrylight.operators.preprocess import Preprocessing, encoded_names, index_of, listed_by_spark
from quarrylight.schemas import METADATA_JSON, PARAMS_JSON


NUMBERS = "feature string, position int, kind string, median double, mean double, scale double"
CATEGORIES = "position long, category string, feature string"


def write_param_table(spark: SparkSession, params: Preprocessing, path: str) -> None:
    """`numbers`, one row for each feature, and `categories`, partitioned by feature."""
    rows = [
        (n, i, "numeric", params.medians.get(n), params.means.get(n), params.scales.get(n)) for i, n in enumerate(params.numeric)
    ] + [(c, i, "categorical", None, None, None) for i, c in enumerate(params.categorical)]
    spark.createDataFrame(rows, NUMBERS).coalesce(1).write.mode("overwrite").parquet(f"{path}/numbers")
    index_of(spark, params).select("position", "category", "feature").write.mode("overwrite").partitionBy("feature").parquet(
        f"{path}/categories"
    )


def read_param_table(spark: SparkSession, path: str) -> Preprocessing:
    """The parameters of a written table; more than DRIVER_CATEGORIES categories stay in it."""
    numbers = spark.read.schema(NUMBERS).parquet(f"{path}/numbers").orderBy("position").collect()  # one row for each feature
    params = Preprocessing(*([r["feature"] for r in numbers if r["kind"] == kind] for kind in ("numeric", "categorical")))
    for row in numbers:
        for known, name in ((params.medians, "median"), (params.means, "mean"), (params.scales, "scale")):
            if row[name] is not None:
                known[row["feature"]] = row[name]
    return _with_categories(params, spark.read.schema(CATEGORIES).parquet(f"{path}/categories"))


def _with_categories(params: Preprocessing, rows: DataFrame) -> Preprocessing:
    counts = {r["feature"]: r["count"] for r in rows.groupBy("feature").count().collect()}
    if sum(counts.values()) > preprocess.DRIVER_CATEGORIES:
        params.index, params.widths = rows.select("feature", "category", "position"), counts
    else:
        for row in rows.orderBy("feature", "position").collect():
            params.categories.setdefault(row["feature"], []).append(row["category"])
    return params


def _write_json(document: DataFrame, path: str) -> None:
    document.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def _numbers(values: dict[str, float]) -> Column:
    """A map literal; its JSON keeps names without a number."""
    entries = [F.struct(F.lit(k).alias("key"), F.lit(v).cast("double").alias("value")) for k, v in values.items()]
    return F.map_from_entries(F.array(*entries)) if entries else F.create_map().cast("map<string,double>")


def _names(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def write_params(spark: SparkSession, params: Preprocessing, path: str) -> None:
    listed = listed_by_spark(spark, params).where(F.col("feature").isin(params.categorical) if params.categorical else F.lit(False))
    categories = listed.agg(F.map_from_entries(F.collect_list(F.struct("feature", "categories"))).alias("categorical_categories"))
    _write_json(categories.select(
        _names(params.numeric).alias("numerical_features"), _names(params.categorical).alias("categorical_features"),
        _numbers(params.medians).alias("numerical_medians"), _numbers(params.means).alias("numerical_means"),
        _numbers(params.scales).alias("numerical_scales"), "categorical_categories",
    ), path)


def params_entries(spark: SparkSession, path: str) -> DataFrame:
    """(kind, feature, number, categories): the usable entries of a parameter file.

    Entries that are not numbers, categories that are not text and empty category lists are dropped.
    """
    whole = spark.read.text(path, wholetext=True)
    parsed = whole.select(F.from_json("value", PARAMS_JSON).alias("p")).select("p.*")
    out = None
    for kind in ("numerical_medians", "numerical_means", "numerical_scales"):
        part = parsed.select(F.lit(kind).alias("kind"), F.explode(kind).alias("feature", "raw"))
        numeric = F.schema_of_variant("raw")
        numeric = numeric.isin("BIGINT", "DOUBLE", "FLOAT") | numeric.startswith("DECIMAL")
        part = part.where(numeric).select(
            "kind", "feature", F.try_variant_get("raw", "$", "double").alias("number"),
            F.lit(None).cast("array<string>").alias("categories"),
        )
        out = part if out is None else out.unionByName(part)
    texts = parsed.select(F.explode("categorical_categories").alias("feature", "raw"))
    items = F.try_variant_get("raw", "$", "array<variant>")
    strings = F.filter(items, lambda v: F.schema_of_variant(v) == "STRING")
    texts = texts.select(
        F.lit("categorical_categories").alias("kind"), "feature", F.lit(None).cast("double").alias("number"),
        F.transform(strings, lambda v: F.try_variant_get(v, "$", "string")).alias("categories"),
    ).where(F.size("categories") > 0)
    return out.unionByName(texts)


def read_params(spark: SparkSession, path: str) -> Preprocessing:
    lists = (
        spark.read.text(path, wholetext=True)
        .select(F.from_json("value", PARAMS_JSON).alias("p"))
        .select("p.numerical_features", "p.categorical_features")
        .first()
    )
    params = Preprocessing(list(lists["numerical_features"] or []), list(lists["categorical_features"] or []))
    targets = {"numerical_medians": params.medians, "numerical_means": params.means, "numerical_scales": params.scales}
    entries = params_entries(spark, path)
    for row in entries.where(F.col("kind").isin(list(targets))).collect():  # one row for each feature and kind
        targets[row["kind"]][row["feature"]] = row["number"]
    listed = entries.where("kind = 'categorical_categories'")
    return _with_categories(params, listed.select("feature", F.posexplode("categories").alias("position", "category")))


def write_metadata(
    spark: SparkSession, params: Preprocessing, target: str, classes: list[str], model_type: str, path: str
) -> None:
    place = F.array_position(_names(params.categorical), F.col("feature"))
    encoded = encoded_names(index_of(spark, params)).select(F.struct(place.alias("place"), "position", "name").alias("e"))
    names = encoded.agg(F.array_sort(F.collect_list("e")).alias("e")).select(F.concat(_names(params.numeric), F.col("e.name")).alias("feature_names"))
    _write_json(names.select(
        "feature_names", _names(params.numeric).alias("numerical_features"), _names(params.categorical).alias("categorical_features"),
        F.lit(target).alias("target"), _names(classes).alias("classes"), F.lit(model_type).alias("model_type"),
        F.array(F.lit(1), F.size("feature_names")).alias("input_shape"),
    ), path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row; fails if the file has no array of feature names."""
    out = spark.read.schema(METADATA_JSON).json(path, multiLine=True)
    row = out.select("feature_names").first()
    if row is None or row["feature_names"] is None:
        raise ValueError(f"{path} has no feature_names array")
    return out
