"""A fitted forest as a table of flat node arrays, walked by column expressions.

One row for each tree: feature, threshold, left and right child of every node, and the values of its
leaves. A forest only compares its inputs with its thresholds, so records whose inputs lie between the
same thresholds reach the same leaves: they are one cell. Scoring walks one record of each cell and joins
the cells' sums back to all records. The walk repeats the record once for each tree, joins the broadcast
table on the tree's number and takes one step down for each level of the forest. Every step is a projection
of array lookups, so the walk runs inside generated code, in stretches whose methods are small enough for
the JVM to compile. A cell's rows lie in one partition, so their sums meet there and one narrow row for
each cell is exchanged.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoderModel, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.operators.bins import packed, with_bins
from quarrylight.operators.forest import class_names, record
from quarrylight.session import materialize, new_folder, small_side, spread

#: A forest whose arrays take more is not broadcast; MLlib's own scoring ships the same nodes as objects.
MOST_NODES = 8_000_000
#: Levels walked in one generated method; the JVM only interprets methods of over 8000 bytes.
STRETCH = 8
#: A number of partitions that coalesce() never has to reduce to: it only ends a generated method.
ANY = 1 << 20

TREES = T.StructType([T.StructField("tree", T.IntegerType(), False)] + [
    T.StructField(name, T.ArrayType(kind, False), False)
    for name, kind in (
        ("feature", T.IntegerType()), ("threshold", T.DoubleType()), ("left", T.IntegerType()), ("right", T.IntegerType()),
        ("value", T.DoubleType()),
    )
])


@dataclass
class FlatForest:
    """`trees` has tree, feature, threshold, left, right and value (all arrays but the first).

    Features 0, 1, ... are the inputs `_num_i`, then the codes `_code_i`, of `prepare`. A feature below 0
    stands for the test "code of input -1 - feature equals threshold", all others for "at most
    threshold". Leaves lead to themselves. `value` has `outputs` numbers for each node: class shares, or
    the one predicted value of a regression.
    """

    trees: DataFrame
    prepare: PipelineModel
    inputs: list[str]
    count: int
    depth: int
    outputs: int
    width: int
    classes: list[str]


def _saved_nodes(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """The nodes of the pipeline's forest, as MLlib writes them: no walk over driver objects."""
    place = new_folder(spark, "nodes")
    model.stages[-1].write().save(place)
    return spark.read.parquet(f"{place}/data").select("treeID", "nodeData.*")


def _slots(spark: SparkSession, numeric: int, widths: list[int]) -> DataFrame:
    """(slot, input, code): what each slot of the assembled vector is; numeric slots have no code."""
    sizes = spark.createDataFrame(
        [(i, 1, i, None) for i in range(numeric)] + [(numeric + i, w, 0, 0) for i, w in enumerate(widths)],
        "input int, size int, first int, code int",
    ).where("size > 0")
    starts = [numeric + sum(widths[:i]) for i in range(len(widths))]
    first = F.when(F.col("code").isNull(), F.col("input"))
    for i, start in enumerate(starts):
        first = first.when(F.col("input") == numeric + i, start)
    each = sizes.select("input", "code", first.alias("first"), F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("at"))
    return each.select(
        (F.col("first") + F.col("at")).cast("int").alias("slot"), "input",
        F.when(F.col("code").isNotNull(), F.col("at")).alias("code"),
    )


def flatten(model: PipelineModel, spark: SparkSession) -> FlatForest:
    """The forest of a pipeline made of preprocessing_stages and a forest of MLlib."""
    assembler = next(s for s in model.stages if isinstance(s, VectorAssembler))
    numeric = [c for c in assembler.getInputCols() if c.startswith("_num_")]
    encoder = next((s for s in model.stages if isinstance(s, OneHotEncoderModel)), None)
    codes = list(encoder.getInputCols()) if encoder else []
    widths = [size - 1 for size in encoder.categorySizes] if encoder else []  # the last slot, unknown, is dropped
    first = next(i for i, s in enumerate(model.stages) if s is (encoder or assembler))
    forest = model.stages[-1]
    outputs = forest.numClasses if class_names(model) else 1

    slots = small_side(_slots(spark, len(numeric), widths))
    nodes = _saved_nodes(model, spark).withColumn("slot", F.col("split.featureIndex"))
    size = nodes.agg(F.count(F.lit(1)).alias("n"), F.count_if(
        (F.col("split.numCategories") >= 0) & (F.col("slot") < len(numeric))
    ).alias("odd")).first()
    if size["odd"]:
        raise ValueError("a numeric feature is split as a categorical one")
    if size["n"] * (3 + outputs) > MOST_NODES * 4:
        raise ValueError(f"{size['n']} nodes are too many to broadcast; score with the fitted pipeline")

    leaf, cut = F.col("leftChild") < 0, F.col("split.leftCategoriesOrThreshold")
    is_code = F.col("code").isNotNull()

    def side(value: float) -> Column:
        """Where a one-hot slot of that value goes."""
        left = F.when(F.col("split.numCategories") >= 0, F.array_contains(cut, value)).otherwise(F.lit(value) <= F.get(cut, F.lit(0)))
        return F.when(left, F.col("leftChild")).otherwise(F.col("rightChild"))

    if class_names(model):
        total = F.aggregate("impurityStats", F.lit(0.0), lambda a, x: a + x)
        value = F.transform("impurityStats", lambda x: F.when(total != 0, x / total).otherwise(F.lit(0.0)))
    else:
        value = F.array("prediction")
    flat = nodes.join(slots, "slot", "left").select(
        F.col("treeID").alias("tree"),
        F.struct(
            F.col("id"),
            F.when(leaf, 0).when(is_code, -1 - F.col("input")).otherwise(F.col("input")).alias("feature"),
            F.when(leaf, 0.0).when(is_code, F.col("code").cast("double")).otherwise(F.get(cut, F.lit(0))).alias("threshold"),
            F.when(leaf, F.col("id")).when(is_code, side(1.0)).otherwise(F.col("leftChild")).alias("left"),
            F.when(leaf, F.col("id")).when(is_code, side(0.0)).otherwise(F.col("rightChild")).alias("right"),
            F.when(leaf, value).otherwise(F.array_repeat(F.lit(0.0), outputs)).alias("value"),
        ).alias("node"),
    )
    # One tree is one group: at most 2 ** (depth + 1) nodes.
    whole = flat.groupBy("tree").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    trees = whole.select(
        "tree", *[F.col(f"nodes.{c}").alias(c) for c in ("feature", "threshold", "left", "right")], F.flatten("nodes.value").alias("value")
    )
    return _landed(
        trees, new_folder(spark, "trees"), PipelineModel(model.stages[:first]), [*numeric, *codes],
        max(t.depth for t in forest.trees), outputs, len(numeric) + sum(widths), class_names(model),
    )


def _landed(trees: DataFrame, folder: str, prepare, inputs, depth, outputs, width, classes) -> FlatForest:
    trees.write.mode("overwrite").parquet(folder)
    table = trees.sparkSession.read.parquet(folder)
    return FlatForest(table, prepare, inputs, table.count(), depth, outputs, width, classes)


def save(forest: FlatForest, folder: str) -> None:
    """The trees as Parquet, the preparing stages as a pipeline and the rest as one JSON line."""
    spark = forest.trees.sparkSession
    forest.trees.write.mode("overwrite").parquet(f"{folder}/trees")
    forest.prepare.write().overwrite().save(f"{folder}/prepare")
    about = {k: getattr(forest, k) for k in ("inputs", "count", "depth", "outputs", "width", "classes")}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/about")


def load(spark: SparkSession, folder: str) -> FlatForest:
    about = json.loads(spark.read.text(f"{folder}/about").first()[0])
    return FlatForest(spark.read.parquet(f"{folder}/trees"), PipelineModel.load(f"{folder}/prepare"), **about)


def _step() -> Column:
    """The node below `_node` that a record goes to."""
    at = lambda name: F.col(name)[F.col("_node")]
    feature, threshold = at("feature"), at("threshold")
    holds = F.when(feature < 0, F.col("_x")[-1 - feature] == threshold).otherwise(F.col("_x")[feature] <= threshold)
    return F.when(holds, at("left")).otherwise(at("right"))


def limits(trees: pa.Table, inputs: int) -> dict[str, list[float]]:
    """The rising thresholds of each input `_x_i`; a test for a code counts as one on either side of it."""
    flat = {c: trees.column(c).combine_chunks().flatten().to_numpy() for c in ("feature", "threshold", "left", "right")}
    inner = flat["left"] != flat["right"]
    feature, threshold = flat["feature"][inner], flat["threshold"][inner]
    found = {}
    for i in range(inputs):
        codes = threshold[feature == -1 - i]
        found[f"_x_{i}"] = np.unique(np.concatenate([threshold[feature == i], codes - 0.5, codes + 0.5])).tolist()
    return found


def cells(rows: DataFrame, inputs: list[str], keys: list[str]) -> DataFrame:
    """(*keys, _x): one row for each cell. Bins are intervals, so the least value of each input lies in the cell too."""
    least = rows.groupBy(*keys).agg(*[F.min(c).alias(c) for c in inputs])
    return spread(materialize(least.select(*keys, F.array(*inputs).alias("_x"))))


def outputs(df: DataFrame, forest: FlatForest, keep: list[str]) -> DataFrame:
    """(*keep, _sums): for every row the sums of the leaves' values over all trees, in tree order.

    `df` is read twice, for its cells and for its rows.
    """
    prepared = forest.prepare.transform(df)
    kept = [F.col(f"`{c}`") for c in keep]
    # Few, small rows of a bounded table: with a schema that rules nulls out, lookups are a check and a read.
    spark = df.sparkSession
    table = forest.trees.select(TREES.names).toArrow()
    trees = F.broadcast(spark.createDataFrame(table, TREES))
    thresholds = limits(table, len(forest.inputs))
    inputs = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(x) for c, x in zip(forest.inputs, thresholds, strict=True)]
    numbers = packed(thresholds)
    keys = [f"_cell_{i}" for i in range(len(numbers))]
    rows = with_bins(prepared.select(*kept, *inputs), thresholds).withColumns(dict(zip(keys, numbers, strict=True)))
    walk = cells(rows, list(thresholds), keys).withColumn(
        "tree", F.explode(F.sequence(F.lit(0), F.lit(forest.count - 1)))
    ).withColumn("_node", F.lit(0))
    for start in range(0, forest.depth, STRETCH):
        walk = walk.coalesce(ANY).join(trees.drop("value"), "tree")
        for _ in range(min(STRETCH, forest.depth - start)):
            walk = walk.withColumn("_node", _step())
        walk = walk.select(*keys, "_x", "tree", "_node")
    place = F.col("_node") * forest.outputs
    sums = [F.sum(F.col("value")[place + i]).alias(f"_s{i}") for i in range(forest.outputs)]
    summed = walk.coalesce(ANY).join(trees.select("tree", "value"), "tree").groupBy(*keys).agg(*sums)
    known = small_side(summed.select(*keys, F.array(*[f"_s{i}" for i in range(forest.outputs)]).alias("_sums")))
    return rows.select(*kept, *keys).join(known, keys).select(*kept, "_sums")


def probabilities(df: DataFrame, forest: FlatForest, keep: list[str], output: str = "probability") -> DataFrame:
    """(*keep, output): the class probabilities, equal to MLlib's bit for bit."""
    total = F.aggregate("_sums", F.lit(0.0), lambda a, x: a + x)
    share = F.transform("_sums", lambda x: x / F.col("_total"))
    found = outputs(df, forest, keep).withColumn("_total", total)
    return found.select(*[F.col(f"`{c}`") for c in keep], share.alias(output))


def score(df: DataFrame, forest: FlatForest, version: str = "forest-1", keep: list[str] | None = None) -> DataFrame:
    """The prediction records of forest.score, from the flat arrays."""
    keep = df.columns if keep is None else keep
    found = probabilities(df, forest, keep, "_probability")
    return record(found, F.col("_probability"), forest.classes, version, forest.width, keep)


def score_value(df: DataFrame, forest: FlatForest, name: str = "forest", keep: list[str] | None = None) -> DataFrame:
    """Prediction records of a regressor: the mean of the trees' values."""
    keep = df.columns if keep is None else keep
    mean = F.get("_sums", F.lit(0)) / F.lit(float(forest.count))
    return outputs(df, forest, keep).select(*[F.col(f"`{c}`") for c in keep], mean.alias("prediction"), F.lit(name).alias("model"))
