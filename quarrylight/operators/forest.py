"""Random forests: training, evaluation, scoring and frozen trees as plain expressions."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.numbers import exceeds
from quarrylight.operators import metrics, sampling
from quarrylight.operators.bins import with_bins
from quarrylight.operators.preprocess import Preprocessing, fit_preprocessing, preprocessing_stages
from quarrylight.operators.profile import select_features
from quarrylight.session import materialize, null_safe_join, small_side, spread

# Forest settings.
CLASSIFIER_TREES, CLASSIFIER_DEPTH = 50, 15
REGRESSOR_TREES, REGRESSOR_DEPTH = 100, 10
SEED = 42
# Bins per continuous feature, MLlib's own default: more find finer thresholds and take as much more memory.
BINS = 32
# A regressor is fitted on the rows of a train part up to this size, and on condensed rows of a larger one.
PLAIN_ROWS = 200_000
# Condensed rows of one cell, which a bootstrap draws each on its own.
GROUPS = 8
# Error of the ranks of the quantiles that stand for a feature's values, as 1 / ACCURACY.
ACCURACY = 1000
# Names shown for the class numbers 0 and 1.
CLASSES = ["Normal", "Attack"]
LABEL = "_label"
HELPERS = ("_num_", "_cat_", "_code_", "_hot_")


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """(target, weight): n / (k * rows of the class) for k classes in n rows."""
    counts = materialize(sampling.class_counts(df, target))
    size = counts.agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("classes")).first()
    weight = F.lit(size["rows"]) / (F.lit(size["classes"]) * F.col("rows"))
    return counts.select(target, weight.alias("weight"))


def with_class_weight(df: DataFrame, target: str, output: str = "weight") -> DataFrame:
    weights = small_side(class_weights(df, target).withColumnRenamed("weight", output))
    return null_safe_join(df, weights, [target])


def fit_classifier(
    train: DataFrame, params: Preprocessing, target: str, trees: int = CLASSIFIER_TREES, depth: int = CLASSIFIER_DEPTH,
    bins: int = BINS,
) -> PipelineModel:
    """A label index, preprocessing and a forest with balanced class weights, fitted as one pipeline.

    `target` holds the classes, of any type and number; they are numbered in their own order, so 0 and 1
    stay 0 and 1, and their names go with the pipeline. Rows without a class are left out.
    """
    forest = RandomForestClassifier(
        featuresCol="features", labelCol=LABEL, weightCol="weight", numTrees=trees, maxDepth=depth,
        seed=SEED, maxMemoryInMB=1024, maxBins=bins,
    )
    named = train.where(F.col(target).isNotNull()).withColumn("_class", F.col(target).cast("string"))
    labels = StringIndexerModel.from_labels(ordered_classes(named, target), inputCol="_class", outputCol=LABEL)
    return Pipeline(stages=[labels, *preprocessing_stages(params), forest]).fit(with_class_weight(named, target))


def ordered_classes(df: DataFrame, target: str) -> list[str]:
    """The classes as text, in the order of their own type."""
    return [r["name"] for r in df.groupBy(target).agg(F.first(F.col(target).cast("string")).alias("name")).orderBy(target).collect()]


def class_names(model: PipelineModel) -> list[str]:
    """The classes of a fitted pipeline, at the place of their number; none for a regressor."""
    return next((list(s.labels) for s in model.stages if isinstance(s, StringIndexerModel) and s.getOutputCol() == LABEL), [])


def predicted_class(model: PipelineModel) -> Column:
    """The name of the class that the pipeline's `prediction` numbers."""
    return F.get(F.array(*[F.lit(c) for c in class_names(model)]), F.col("prediction").cast("int"))


def fit_regressor(
    train: DataFrame, params: Preprocessing, target: str, trees: int = REGRESSOR_TREES, depth: int = REGRESSOR_DEPTH,
    bins: int = BINS, weight: str | None = None,
) -> PipelineModel:
    forest = RandomForestRegressor(
        featuresCol="features", labelCol=target, numTrees=trees, maxDepth=depth, seed=SEED,
        featureSubsetStrategy="all", maxMemoryInMB=1024, maxBins=bins,
    )
    if weight:
        forest.setWeightCol(weight)
    return Pipeline(stages=[*preprocessing_stages(params), forest]).fit(train)


def standing_values(df: DataFrame, names: list[str], bins: int = BINS) -> dict[str, list[float]]:
    """For each column rising values that stand for all: its own values if they are few, otherwise even quantiles.

    They are fewer than the bins. MLlib adds a 0 when it looks for thresholds, so 0 is among values on both sides of it.
    """
    count = max(2, bins - 2)
    places = [i / (count - 1) for i in range(count)]
    about = df.agg(*[f for i, c in enumerate(names) for f in (
        F.approx_count_distinct(c).alias(f"n{i}"), F.percentile_approx(c, places, ACCURACY).alias(f"q{i}"),
    )]).first()
    found = {}
    for i, name in enumerate(names):
        own = []
        if about[f"n{i}"] < 2 * bins:
            own = [r[0] for r in df.select(name).distinct().limit(bins).collect()]
        if not 0 < len(own) < bins:
            own = about[f"q{i}"]
            own = [*own, 0.0] if min(own) < 0 < max(own) else own
        found[name] = sorted({x + 0.0 for x in own})
    return found


def condensed(
    train: DataFrame, keys: list[str], params: Preprocessing, target: str, bins: int = BINS, groups: int = GROUPS
) -> DataFrame:
    """(features, target, weight): rows alike in the bins of all features as at most `groups` weighted rows with their mean target.

    MLlib's trees see of a feature only its bin. Thresholds lie halfway between the values that stand for the bins,
    which is where MLlib puts them, so every row counts in the bin in which it is scored. The part of the variance
    that a condensed row hides is the same before and after any split, so splits gain what they gain on the rows.
    Which rows of a cell are drawn together by the bootstrap follows from a hash of their keys.
    """
    filled = preprocessing_stages(params)[0].transform(train)
    columns = [f"_num_{i}" for i in range(len(params.numeric))]
    values = standing_values(filled, columns, bins)
    halfway = {c: [(a + b) / 2 for a, b in zip(v, v[1:])] for c, v in values.items()}
    dealt = with_bins(filled, halfway).withColumn("_group", F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(groups)))
    label = F.col(f"`{target}`").cast("double")
    # A missing target is an error of the fit, as it is for single rows.
    mean = F.when(F.count(label) == F.count(F.lit(1)), F.avg(label))
    cells = dealt.groupBy(*[f"_bin_{c}" for c in columns], "_group").agg(mean.alias(target), F.count(F.lit(1)).cast("double").alias("weight"))
    stand = [F.get(F.array(*map(F.lit, values[c])), F.col(f"_bin_{c}")).alias(n) for c, n in zip(columns, params.numeric)]
    return cells.select(*stand, target, "weight")


def without_helpers(df: DataFrame) -> DataFrame:
    drop = [c for c in df.columns if c.startswith(HELPERS)] + ["features", "rawPrediction"]
    return df.drop(*drop)


def record(
    df: DataFrame, probability: Column, classes: list[str], version: str, used: int, keep: list[str]
) -> DataFrame:
    """Prediction records from class probabilities.

    Two classes: the probability of the second, strict 0.5 threshold, class name. More classes: the
    largest probability and its class, the first among equals.
    """
    bound = df.withColumn("_p", probability)
    if len(classes) == 2:
        shown = CLASSES if classes == ["0", "1"] else classes
        p = F.get("_p", F.lit(1))
        found = [p.alias("prediction"), exceeds(p).alias("is_attack"), F.when(exceeds(p), shown[1]).otherwise(shown[0]).alias("class_name")]
    else:
        p = F.array_max("_p")
        name = F.get(F.array(*[F.lit(c) for c in classes]), (F.array_position("_p", p) - 1).cast("int"))
        found = [p.alias("prediction"), name.alias("class_name")]
    return bound.select(
        *[F.col(f"`{c}`") for c in keep], *found, F.lit(version).alias("model_version"), F.lit(used).cast("int").alias("features_used")
    )


def score(
    df: DataFrame, model: PipelineModel, version: str = "forest-1", classes: list[str] | None = None,
    keep: list[str] | None = None, width: int | None = None,
) -> DataFrame:
    """Prediction records (see `record`) of a fitted pipeline; `classes` replaces the names it was fitted with.

    `width` is the number of features the caller expects; another one is an error, found once
    from the schema and not row by row.
    """
    scored = model.transform(df)
    used = scored.schema["features"].metadata["ml_attr"]["num_attrs"]
    if width is not None and used != width:
        raise ValueError(f"{used} features instead of {width}")
    keep = df.columns if keep is None else keep
    return record(scored, vector_to_array("probability"), classes or class_names(model) or CLASSES, version, used, keep)


def score_value(df: DataFrame, model: PipelineModel, name: str = "forest", keep: list[str] | None = None) -> DataFrame:
    """Prediction records of a regressor."""
    keep = df.columns if keep is None else keep
    return model.transform(df).select(*[F.col(f"`{c}`") for c in keep], "prediction", F.lit(name).alias("model"))


def train_and_evaluate(
    df: DataFrame, keys: list[str], target: str, features: tuple[list[str], list[str]] | None = None,
    order: list[str] | None = None, trees: int = CLASSIFIER_TREES, depth: int = CLASSIFIER_DEPTH, bins: int = BINS,
    **balancing,
) -> tuple[PipelineModel, Preprocessing, DataFrame]:
    """Select features, split, bound the train part, fit and report. Returns (model, parameters, report).

    The report covers the whole test part; only the rows to fit on are bounded (sample_rows). All
    classes stay in proportion unless small_class_rows asks for the rule that drops classes.
    """
    balancing = {"small_class_rows": 0} | balancing
    if features is None:
        _, numeric, categorical = select_features(df, target, order)
        numeric, categorical = ([c for c in part if c not in keys] for part in (numeric, categorical))
    else:
        numeric, categorical = features
    chosen = df.select(*dict.fromkeys([*keys, *numeric, *categorical, target]))
    marked = materialize(sampling.stratified_split(chosen, keys, target))
    train = spread(materialize(sampling.balance(marked.where("split = 'train'"), keys, target, **balancing)))
    test = marked.where("split = 'test'")
    params = fit_preprocessing(train, numeric, categorical)
    model = fit_classifier(train, params, target, trees, depth, bins)
    known = test.where(F.col(target).isNotNull())
    scored = materialize(model.transform(known).select(F.col(target).cast("string").alias("label"), predicted_class(model).alias("guess")))
    return model, params, metrics.classification_report(scored, "label", "guess")


def train_and_evaluate_value(
    df: DataFrame, keys: list[str], target: str, numeric: list[str], trees: int = REGRESSOR_TREES, depth: int = REGRESSOR_DEPTH,
    bins: int = BINS, plain_rows: int = PLAIN_ROWS,
) -> tuple[PipelineModel, Preprocessing, DataFrame]:
    """Random split, regression forest on the whole train part, error metrics on the test part."""
    chosen = df.select(*dict.fromkeys([*keys, *numeric, target]))
    sampled = materialize(sampling.random_split(chosen, keys))
    train, test = spread(sampled.where("split = 'train'")), sampled.where("split = 'test'")
    params = fit_preprocessing(train, numeric, [])
    if train.count() <= plain_rows:
        model = fit_regressor(train, params, target, trees, depth, bins)
    else:
        # Neighbours in the order of the features go the same ways, so a task's node statistics stay in the cache.
        near = [F.col(f"`{n}`") for n in numeric]
        few = materialize(condensed(train, keys, params, target, bins))
        few = few.repartitionByRange(train.sparkSession.sparkContext.defaultParallelism, *near).sortWithinPartitions(*near)
        model = fit_regressor(few, params, target, trees, depth, bins, "weight")
    report = metrics.regression_metrics(model.transform(test), target, "prediction")
    return model, params, report


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# A frozen tree is a number (leaf) or (feature column, threshold, left, right); left is <=.
Tree = float | tuple


def tree_expression(tree: Tree) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    name, threshold, left, right = tree
    return F.when(F.col(name) <= F.lit(threshold), tree_expression(left)).otherwise(tree_expression(right))


def forest_expression(trees: list[Tree]) -> Column:
    """Mean of the trees' values; for small forests this scores inside generated code."""
    total = tree_expression(trees[0])
    for tree in trees[1:]:
        total = total + tree_expression(tree)
    return total / F.lit(float(len(trees)))


def frozen_trees(model, names: list[str]) -> list[Tree]:
    """Trees of a fitted MLlib regression forest over continuous features, as frozen trees."""

    def walk(node) -> Tree:
        if node.subtreeDepth() == 0:
            return node.prediction()
        split = node.split()
        return (names[split.featureIndex()], split.threshold(), walk(node.leftChild()), walk(node.rightChild()))

    return [walk(tree._call_java("rootNode")) for tree in model.trees]
