"""Fit and apply imputation, standardisation and one-hot encoding."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarrylight.functions.numbers import CSV_NUMBER, as_number
from quarrylight.operators.percentiles import exact_medians
from quarrylight.session import materialize, null_safe_join, small_side

MISSING = "Missing"
MIN_SCALE = 1e-8
# Categories up to this count are listed in the parameters; beyond it they stay in a table (wide=True).
DRIVER_CATEGORIES = 100_000


@dataclass
class Preprocessing:
    """Fitted parameters: a few numbers per numeric feature and the categories per text feature.

    Too many categories for a list are rows of `index`, as of category_index, and `widths` has their
    number per feature; `categories` is empty then.
    """

    numeric: list[str]
    categorical: list[str] = field(default_factory=list)
    medians: dict[str, float] = field(default_factory=dict)
    means: dict[str, float] = field(default_factory=dict)
    scales: dict[str, float] = field(default_factory=dict)
    categories: dict[str, list[str]] = field(default_factory=dict)
    index: DataFrame | None = field(default=None, repr=False, compare=False)
    widths: dict[str, int] = field(default_factory=dict)

    def listed(self) -> dict[str, list[str]]:
        if self.index is not None:
            raise ValueError("the categories are too many for a list; use the index, encoded_names and one_hot_long")
        return self.categories

    @property
    def feature_names(self) -> list[str]:
        encoded = [f"{c}_{v}" for c in self.categorical for v in self.listed().get(c, [])]
        return [*self.numeric, *encoded]


def present_number(name: str) -> Column:
    """The column as a double; NaN and text that is no number are null."""
    return as_number(F.col(_quoted(name)))


def fit_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, median, mean, scale): mean and population deviation after the median fill."""
    medians = {r["feature"]: r["median"] for r in exact_medians(df, columns).collect()}
    aggs = []
    for i, name in enumerate(columns):
        filled = F.coalesce(present_number(name), F.lit(medians.get(name)).cast("double"))
        aggs += [F.avg(filled).alias(f"m{i}"), F.stddev_pop(filled).alias(f"s{i}")]
    entries = [
        F.struct(
            F.lit(name).alias("feature"),
            F.lit(medians.get(name)).cast("double").alias("median"),
            F.col(f"m{i}").alias("mean"),
            F.when(F.col(f"s{i}") == 0, 1.0).otherwise(F.col(f"s{i}")).alias("scale"),
        )
        for i, name in enumerate(columns)
    ]
    return df.agg(*aggs).select(F.inline(F.array(*entries)))


def filled_category(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(MISSING))


def distinct_categories(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, category), distinct, missing values as their own category."""
    entries = [F.struct(F.lit(c).alias("feature"), filled_category(c).alias("category")) for c in columns]
    return df.select(F.inline(F.array(*entries))).groupBy("feature", "category").agg(F.count(F.lit(1)).alias("rows"))


def category_index(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, category, position, rows): position of each category in its feature's sorted list.

    The sorted categories stay range-partitioned; dense positions come from the checkpointed
    partitions' sizes, so no task or driver holds a whole list.
    """
    return _positions(distinct_categories(df, columns))


def _positions(found: DataFrame) -> DataFrame:
    ordered = materialize(found.orderBy("feature", "category"))
    parts = ordered.withColumns(
        {"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}
    )
    parts = parts.withColumn("_row", F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)))
    # One row per partition and feature.
    sizes = parts.groupBy("feature", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_low"))
    before = W.partitionBy("feature").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("feature", "_part", "_low", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    joined = null_safe_join(parts, small_side(starts), ["feature", "_part"])
    return joined.select(
        "feature", "category", (F.col("_start") + F.col("_row") - F.col("_low")).alias("position"), "rows"
    )


def encoded_names(index: DataFrame) -> DataFrame:
    """(feature, position, name) with names `feature_category`."""
    return index.select("feature", "position", F.concat_ws("_", "feature", "category").alias("name"))


def one_hot_long(df: DataFrame, keys: list[str], columns: list[str], index: DataFrame) -> DataFrame:
    """(*keys, feature, category, position, known): the set slot of every row and feature.

    The tall form of a one-hot block of any width; unknown categories have no position.
    """
    entries = [F.struct(F.lit(c).alias("feature"), filled_category(c).alias("category")) for c in columns]
    tall = df.select(*keys, F.inline(F.array(*entries)))
    lookup = small_side(index.select("feature", "category", "position"))
    return tall.join(lookup, ["feature", "category"], "left").select(
        *keys, "feature", "category", "position", F.col("position").isNotNull().alias("known")
    )


def fit_preprocessing(df: DataFrame, numeric: list[str], categorical: list[str], wide: bool = False) -> Preprocessing:
    """Fitted parameters; more than DRIVER_CATEGORIES categories stay in a table, as they do if `wide` asks for it.

    A numeric feature without any number is filled with 0 and scaled by 1.
    """
    params = Preprocessing(list(numeric), list(categorical))
    if numeric:
        for row in fit_numeric(df, numeric).collect():
            known = row["median"] is not None
            params.medians[row["feature"]] = row["median"] if known else 0.0
            params.means[row["feature"]] = row["mean"] if known else 0.0
            params.scales[row["feature"]] = row["scale"] if known else 1.0
    if categorical:
        found = materialize(distinct_categories(df, categorical))
        if not wide and found.count() <= DRIVER_CATEGORIES:
            for row in found.orderBy("feature", "category").collect():
                params.categories.setdefault(row["feature"], []).append(row["category"])
        else:
            params.index = materialize(_positions(found))
            params.widths = {r["feature"]: r["count"] for r in found.groupBy("feature").count().collect()}
    return params


class CategoryCodes(Transformer, MLReadable, MLWritable):
    """Codes `_code_i` of the texts `_cat_i` by join with an index; an unknown category has its feature's width as code."""

    def __init__(self, columns: list[str] | None = None, widths: dict[str, int] | None = None, index: DataFrame | None = None):
        super().__init__()
        self.columns, self.widths, self.index = columns or [], widths or {}, index

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = dataset
        for i, name in enumerate(self.columns):
            width = self.widths.get(name, 0)
            known = small_side(self.index.where(F.col("feature") == name).select(
                F.col("category").alias(f"_cat_{i}"), F.col("position").cast("double").alias("_position")
            ))
            code = F.coalesce("_position", F.lit(float(width)))
            about = {"ml_attr": {"type": "nominal", "name": f"_code_{i}", "num_vals": width + 1}}
            kept = [F.col(_quoted(c)) for c in out.columns]
            out = out.join(known, f"_cat_{i}", "left").select(*kept, code.alias(f"_code_{i}", metadata=about))
        return out

    def write(self) -> MLWriter:
        return _CodesWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _CodesReader()


class _CodesWriter(MLWriter):
    def __init__(self, instance: CategoryCodes):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        codes = self.instance
        about = {"columns": codes.columns, "widths": codes.widths}
        DefaultParamsWriter.saveMetadata(codes, path, self.sparkSession, extraMetadata=about)
        codes.index.write.parquet(f"{path}/index")


class _CodesReader(MLReader):
    def load(self, path: str) -> CategoryCodes:
        about = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        codes = CategoryCodes(about["columns"], about["widths"], self.sparkSession.read.parquet(f"{path}/index"))
        codes._resetUid(about["uid"])
        return codes


def index_of(spark, params: Preprocessing) -> DataFrame:
    """(feature, position, category) of the parameters, whether they are listed or in a table."""
    if params.index is not None:
        return params.index.select("feature", F.col("position").cast("long").alias("position"), "category")
    rows = [(c, i, v) for c in params.categorical for i, v in enumerate(params.categories.get(c, []))]
    return spark.createDataFrame(rows, "feature string, position long, category string")


def listed_by_spark(spark, params: Preprocessing) -> DataFrame:
    """(feature, categories): the sorted categories of each feature as one array, collected by Spark."""
    entry = F.struct("position", "category")
    listed = index_of(spark, params).groupBy("feature").agg(F.array_sort(F.collect_list(entry)).alias("_c"))
    return listed.select("feature", F.col("_c.category").alias("categories"))


def tidy_params(df: DataFrame, params: Preprocessing) -> DataFrame:
    """One row per feature: (feature, pos, kind, median, mean, scale, categories)."""
    spark = df.sparkSession
    rows = [
        (n, i, "numeric", params.medians.get(n), params.means.get(n), params.scales.get(n))
        for i, n in enumerate(params.numeric)
    ] + [(c, len(params.numeric) + i, "categorical", None, None, None) for i, c in enumerate(params.categorical)]
    schema = "feature string, pos int, kind string, median double, mean double, scale double"
    named = spark.createDataFrame(rows, schema).join(listed_by_spark(spark, params), "feature", "left")
    empty = F.when(F.col("kind") == "categorical", F.array().cast("array<string>"))
    return named.withColumn("categories", F.coalesce("categories", empty))


def standardise(value: Column, mean: float | None, scale: float | None, skip_tiny: bool = False) -> Column:
    """(value - mean) / scale; unchanged without parameters, or for a tiny scale if asked."""
    if mean is None or scale is None or (skip_tiny and scale <= MIN_SCALE):
        return value
    return (value - F.lit(mean)) / F.lit(scale)


def impute_numeric(df: DataFrame, params: Preprocessing) -> DataFrame:
    return df.withColumns(
        {n: F.coalesce(present_number(n), F.lit(params.medians.get(n)).cast("double")) for n in params.numeric}
    )


def impute_categorical(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: filled_category(c) for c in columns})


def scale_numeric(df: DataFrame, params: Preprocessing, skip_tiny: bool = False) -> DataFrame:
    return df.withColumns(
        {
            n: standardise(F.col(f"`{n}`"), params.means.get(n), params.scales.get(n), skip_tiny)
            for n in params.numeric
        }
    )


def one_hot_columns(params: Preprocessing) -> list[Column]:
    """0/1 columns named `feature_category`; a category not seen at fit time sets none."""
    return [
        F.when(filled_category(c) == F.lit(v), 1.0).otherwise(0.0).alias(f"{c}_{v}")
        for c in params.categorical
        for v in params.listed().get(c, [])
    ]


def place_by_name(values: Column, names: list[str]) -> Column:
    """Map name -> number into an array in the order of `names`, absent names as 0."""
    slots = F.array(*[F.lit(n) for n in names])
    return F.transform(slots, lambda n: F.coalesce(F.try_element_at(values, n), F.lit(0.0)))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def preprocessing_stages(params: Preprocessing, output: str = "features", scale: bool = False) -> list:
    """MLlib stages that turn raw columns into the feature vector.

    The numeric block is imputed (and standardised if asked), the one-hot block is sparse and
    unknown categories are all zeros. Trees need no scaling, so it is off by default; whichever
    is chosen is then the same for training and scoring.
    """
    exprs = ["*"]
    for i, name in enumerate(params.numeric):
        text = f"TRIM(CAST({_quoted(name)} AS STRING))"
        column = (
            f"IF(TYPEOF({_quoted(name)}) = 'string', IF({text} RLIKE r'{CSV_NUMBER}',"
            f" TRY_CAST(REGEXP_REPLACE({text}, r'_|^[+-](?=[nN])', '') AS DOUBLE), NULL), TRY_CAST({_quoted(name)} AS DOUBLE))"
        )
        value = f"COALESCE(NANVL({column}, NULL), {float(params.medians[name])!r}D)"
        if scale:
            value = f"({value} - ({params.means[name]!r}D)) / {params.scales[name]!r}D"
        exprs.append(f"{value} AS _num_{i}")
    for i, name in enumerate(params.categorical):
        exprs.append(f"COALESCE(CAST({_quoted(name)} AS STRING), '{MISSING}') AS _cat_{i}")
    stages: list = [SQLTransformer(statement=f"SELECT {', '.join(exprs)} FROM __THIS__")]
    parts = [f"_num_{i}" for i in range(len(params.numeric))]
    if params.categorical:
        texts = [f"_cat_{i}" for i in range(len(params.categorical))]
        codes = [f"_code_{i}" for i in range(len(params.categorical))]
        slots = [f"_hot_{i}" for i in range(len(params.categorical))]
        # One indexer per column: label lists of different lengths must not share an array.
        stages += [CategoryCodes(params.categorical, params.widths, params.index)] if params.index is not None else [
            StringIndexerModel.from_labels(params.categories.get(c, []), inputCol=t, outputCol=o, handleInvalid="keep")
            for c, t, o in zip(params.categorical, texts, codes)
        ]
        stages.append(OneHotEncoder(inputCols=codes, outputCols=slots, dropLast=True))
        parts += slots
    stages.append(VectorAssembler(inputCols=parts, outputCol=output))
    return stages


def preprocessing_model(df: DataFrame, params: Preprocessing, output: str = "features", scale: bool = False) -> PipelineModel:
    return Pipeline(stages=preprocessing_stages(params, output, scale)).fit(df)


def apply_preprocessing(df: DataFrame, params: Preprocessing, output: str = "features", scale: bool = False) -> DataFrame:
    out = preprocessing_model(df, params, output, scale).transform(df)
    return out.drop(*[c for c in out.columns if c.startswith(("_num_", "_cat_", "_code_", "_hot_"))])
