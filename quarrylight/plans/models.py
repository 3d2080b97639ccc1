"""Forests over order lines: training, scoring, streaming and a frozen forest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators import flat_forest, forest
from quarrylight.operators.requests import parse_named, payload, split_requests
from quarrylight.plans.requests import event_requests
from quarrylight.plans.sampling import LINE_KEY, _quotas
from quarrylight.session import new_folder, spread
from quarrylight.sources.tables import read_records, read_table, write_records
from quarrylight.streaming import scoring

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CATEGORICAL = ["l_returnflag", "l_linestatus"]


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines with a class to learn (discounted quantity above 24) and a value to learn."""
    lines = read_table(spark, sf, "lineitem").select(*LINE_KEY, *NUMERIC, *CATEGORICAL)
    discounted = F.col("l_quantity") * (1 - F.col("l_discount"))
    return lines.withColumns(
        {
            "Label": (discounted > 24).cast("int"),
            "total": F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")),
        }
    )


def train_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Select features, split, bound the train part, fit 50 trees of depth 15, report on the whole test part.

    Per line of the report: class, support and whether its F1 (for `accuracy` the accuracy) beats
    guessing the larger class always.
    """
    lines = _lines(spark, sf).drop("total")
    _, _, report = forest.train_and_evaluate(lines, LINE_KEY, "Label", order=LINE_KEY)
    classes = F.col("class").isin("0", "1")
    majority = report.where(classes).agg(F.max("support") / F.sum("support")).first()[0]
    return report.select("class", "support", (F.col("f1") > majority).alias("beats_majority"))


def train_regressor(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the test part, and whether the forest explains nine tenths of their variance."""
    _, _, report = forest.train_and_evaluate_value(_lines(spark, sf), LINE_KEY, "total", NUMERIC)
    return report.select("rows", (F.col("r2") > 0.9).alias("explains"))


def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    lines = _lines(spark, sf).select(*LINE_KEY, "Label")
    weighted = forest.with_class_weight(lines, "Label")
    return weighted.withColumn("weight", F.round("weight", 9))


def train_text_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Classes given by name, three of them: discounted quantity up to 12, 24 and above.

    The report shows the names; so do the records of the whole table, scored from the flat forest.
    """
    discounted = F.col("l_quantity") * (1 - F.col("l_discount"))
    size = F.when(discounted > 24, "large").when(discounted > 12, "medium").otherwise("small")
    lines = _lines(spark, sf).drop("total", "Label").withColumn("size", size)
    model, _, report = forest.train_and_evaluate(
        lines, LINE_KEY, "size", features=(NUMERIC, CATEGORICAL), trees=20, depth=10
    )
    records = flat_forest.score(lines, flat_forest.flatten(model, spark), keep=[*LINE_KEY, "size"])
    right = records.groupBy(F.col("size").alias("class")).agg(
        F.count(F.lit(1)).alias("scored"), (F.avg((F.col("class_name") == F.col("size")).cast("int")) > 0.8).alias("mostly_right")
    )
    per_class = report.join(right, "class")
    return per_class.select("class", "support", (F.col("f1") > 0.8).alias("good_f1"), "scored", "mostly_right")


_fitted: dict[tuple[str, str], tuple] = {}


def fitted_classifier(spark: SparkSession, sf: str):
    """The classifier of a folder's order lines and its parameters, fitted once in a Spark application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _fitted:
        lines = _lines(spark, sf).drop("total")
        _fitted[key] = forest.train_and_evaluate(lines, LINE_KEY, "Label", features=(NUMERIC, CATEGORICAL))[:2]
    return _fitted[key]


#: A prediction record is consistent: a probability, the strict threshold and the class name it gives.
CONSISTENT = (
    "prediction BETWEEN 0 AND 1 AND is_attack = (prediction > 0.5) "
    "AND class_name = CASE WHEN is_attack THEN 'Attack' ELSE 'Normal' END"
)


def _by_mllib(spark: SparkSession, sf: str, model) -> DataFrame:
    """The lines' inputs and the fitted pipeline's probability as `fitted`, on all cores."""
    inputs = [*LINE_KEY, *NUMERIC, *CATEGORICAL]
    scored = forest.score(spread(_lines(spark, sf).select(*inputs)), model)
    return scored.select(*inputs, F.col("prediction").alias("fitted"))


def score_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Every line scored by the fitted pipeline and by the one saved and reloaded, and whether they agree."""
    path = new_folder(spark, "model")
    model, _ = fitted_classifier(spark, sf)
    forest.save_model(model, path)
    fitted = _by_mllib(spark, sf, model)
    scored = forest.score(fitted, forest.load_model(path), keep=[*LINE_KEY, "fitted"])
    return scored.select(
        *LINE_KEY, "model_version", "features_used", F.expr(CONSISTENT).alias("consistent"),
        (F.col("prediction") == F.col("fitted")).alias("same_reloaded"),
    )


def stream_score(spark: SparkSession, sf: str) -> DataFrame:
    """Lines sent as JSON requests through files and scored as a stream, compared with a batch over the same files."""
    model, params = fitted_classifier(spark, sf)
    sent, folder = new_folder(spark, "requests"), new_folder(spark, "scored")
    payload(_lines(spark, sf), NUMERIC, CATEGORICAL).select(F.col("payload").alias("value")).write.text(sent)
    query = scoring.start_scoring(
        scoring.request_stream(spark, sent), model, params, f"{folder}/ok", f"{folder}/bad", f"{folder}/state"
    )
    query.awaitTermination()
    good, _ = split_requests(parse_named(spark.read.text(sent), "value", params))
    record = ["value", "prediction", "is_attack", "class_name", "model_version", "features_used"]
    streamed = spark.read.parquet(f"{folder}/ok").select(*record, F.lit(1).alias("_n"))
    batch = forest.score(good, model, keep=["value"]).select(*record, F.lit(-1).alias("_n"))
    pairs = streamed.unionAll(batch).groupBy(*record).agg(
        F.sum("_n").alias("_rest"), F.count_if(F.col("_n") > 0).alias("_sent")
    )
    return pairs.groupBy("model_version", "features_used").agg(
        F.sum("_sent").alias("requests"), F.bool_and(F.expr(CONSISTENT)).alias("consistent"),
        F.bool_and(F.col("_rest") == 0).alias("same_as_batch"),
    )


def stream_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Malformed requests of a stream with their reason."""
    sent, folder = new_folder(spark, "requests"), new_folder(spark, "rejected")
    event_requests(spark, sf).select("value").write.text(sent)
    requests = scoring.request_stream(spark, sent)
    scoring.start_rejects(requests, f"{folder}/bad", f"{folder}/state", "dot").awaitTermination()
    bad = spark.read.parquet(f"{folder}/bad")
    return bad.groupBy("value", "error", "status").agg(F.count(F.lit(1)).alias("requests"))


def stream_health(spark: SparkSession, sf: str) -> DataFrame:
    """Running counters over the event files as a stream."""
    folder = new_folder(spark, "health")
    schema = read_table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    scoring.start_health(events, "value", ["event_type"], f"{folder}/out", f"{folder}/state").awaitTermination()
    return scoring.newest_state(spark, f"{folder}/out").withColumn("avg_time", F.round("avg_time", 6))


def forest_expr(spark: SparkSession, sf: str) -> DataFrame:
    """The fitted forest as flat arrays, walked in generated code, saved and reloaded; each line against MLlib's probability."""
    model, _ = fitted_classifier(spark, sf)
    folder = new_folder(spark, "flat")
    flat_forest.save(flat_forest.flatten(model, spark), folder)
    records = flat_forest.score(
        _by_mllib(spark, sf, model), flat_forest.load(spark, folder), keep=[*LINE_KEY, "fitted"]
    )
    return records.select(
        *LINE_KEY, "model_version", "features_used", F.expr(CONSISTENT).alias("consistent"),
        (F.col("prediction") == F.col("fitted")).alias("same_as_mllib"),
    )


def prediction_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records of the flat forest written as JSON lines and read back, with MLlib's probability beside."""
    model, _ = fitted_classifier(spark, sf)
    folder = new_folder(spark, "records")
    records = flat_forest.score(
        _by_mllib(spark, sf, model), flat_forest.flatten(model, spark), version="flat-1", keep=[*LINE_KEY, "fitted"]
    )
    write_records(records, folder)
    return read_records(spark, folder, records.schema).select(
        *LINE_KEY, "model_version", "features_used", F.expr(CONSISTENT).alias("consistent"),
        (F.col("prediction") == F.col("fitted")).alias("same_as_mllib"),
    )


def stream_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Requests that arrive in two parts with a restart between them; late ones count in their own hour. Merged to days."""
    folder = new_folder(spark, "counters")
    events = read_table(spark, sf, "events").select("event_id", "ts", "event_type", F.col("value").cast("decimal(18,2)").alias("value"))
    by = ["event_type"]
    for part in range(2):
        events.where(F.col("event_id") % 2 == part).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
        scoring.start_counters(stream, "ts", "value", by, f"{folder}/out", f"{folder}/state", "1 hour", "60 days").awaitTermination()
    days = scoring.merged_counters(scoring.current_counters(spark, f"{folder}/out", by), by, "1 day")
    return days.select(
        F.date_format("begins", "yyyy-MM-dd").alias("day"), "event_type", "requests", F.col("slowest").cast("double").alias("slowest"),
        F.round(F.col("avg_time").cast("double"), 6).alias("avg_time"),
    )


# Three small trees: (column, threshold, at most, above).
FROZEN = [
    ("l_quantity", 24.0, ("l_discount", 0.04, 0.1, 0.05), ("l_discount", 0.06, 0.9, 0.7)),
    ("l_extendedprice", 50000.0, 0.3, ("l_tax", 0.02, 0.8, 0.6)),
    ("l_quantity", 30.0, ("l_extendedprice", 20000.0, 0.2, 0.4), 0.95),
]


def frozen_expr(spark: SparkSession, sf: str) -> DataFrame:
    """A small forest given as nested conditions, written as records and read back: values that SQL can compute."""
    folder = new_folder(spark, "records")
    probability = forest.forest_expression(FROZEN)
    records = read_table(spark, sf, "lineitem").select(
        *LINE_KEY, F.round(probability, 9).alias("prediction"), forest.exceeds(probability).alias("is_attack"),
        F.lit("frozen-1").alias("model_version"), F.lit(4).alias("features_used"),
    )
    write_records(records, folder)
    return read_records(spark, folder, records.schema)


QUERIES = {
    f.__name__: f
    for f in (
        train_classifier, train_regressor, class_weights, score_batch, stream_score, stream_rejects, stream_health,
        forest_expr, prediction_records, frozen_expr, train_text_labels, stream_counters,
    )
}


_KEYS = ", ".join(LINE_KEY)

_FOREST = f"""
        WITH p AS (SELECT {_KEYS}, ((CASE WHEN l_quantity <= 24 THEN CASE WHEN l_discount <= 0.04 THEN 0.1 ELSE 0.05 END
                          ELSE CASE WHEN l_discount <= 0.06 THEN 0.9 ELSE 0.7 END END)
              + (CASE WHEN l_extendedprice <= 50000 THEN 0.3 ELSE CASE WHEN l_tax <= 0.02 THEN 0.8 ELSE 0.6 END END)
              + (CASE WHEN l_quantity <= 30 THEN CASE WHEN l_extendedprice <= 20000 THEN 0.2 ELSE 0.4 END ELSE 0.95 END)) / 3.0 AS p
            FROM lineitem)"""

_LABEL = "CAST(l_quantity * (1 - l_discount) > 24 AS INTEGER)"
_DISCOUNTED = "l_quantity * (1 - l_discount)"
_SIZE = f"CASE WHEN {_DISCOUNTED} > 24 THEN 'large' WHEN {_DISCOUNTED} > 12 THEN 'medium' ELSE 'small' END"
_WIDTH = f"(SELECT CAST({len(NUMERIC)} + count(DISTINCT l_returnflag) + count(DISTINCT l_linestatus) AS INTEGER) FROM lineitem)"

SQL = {
    "train_classifier": f"""
        WITH {_quotas("lineitem", _LABEL, "ceil(0.2 * sum(n))")},
        s AS (SELECT CAST(sum(quota) AS BIGINT) AS support FROM q)
        SELECT CAST(k AS VARCHAR) AS class, CAST(quota AS BIGINT) AS support, true AS beats_majority FROM q
        UNION ALL SELECT unnest(['accuracy', 'macro avg', 'weighted avg']), support, true FROM s""",
    "train_regressor": 'SELECT CAST(ceil(0.2 * count(*)) AS BIGINT) AS "rows", true AS explains FROM lineitem',
    "score_batch": f"""
        SELECT {_KEYS}, 'forest-1' AS model_version, {_WIDTH} AS features_used, true AS consistent,
               true AS same_reloaded FROM lineitem""",
    "stream_score": f"""
        SELECT 'forest-1' AS model_version, {_WIDTH} AS features_used, count(*) AS requests, true AS consistent,
               true AS same_as_batch FROM lineitem""",
    "class_weights": f"""
        WITH l AS (SELECT {_KEYS}, CAST(l_quantity * (1 - l_discount) > 24 AS INTEGER) AS "Label" FROM lineitem),
        c AS (SELECT "Label", count(*) AS n FROM l GROUP BY 1)
        SELECT l.*, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 9) AS weight FROM l JOIN c USING ("Label")""",
    "stream_rejects": """
        WITH e AS (SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)
        SELECT CASE k WHEN 0 THEN '{"features":' WHEN 1 THEN '{"data":1}' ELSE '{"features":[1]}' END AS value,
               CASE k WHEN 0 THEN 'body is not valid JSON' WHEN 1 THEN 'body must be an object with features'
                      ELSE 'features must be an object' END AS error,
               CASE k WHEN 1 THEN 400 ELSE 500 END AS status, count(*) AS requests
        FROM e WHERE k <= 2 GROUP BY k""",
    "stream_health": """
        SELECT event_type, count(*) AS requests_processed, round(avg(value), 6) AS avg_time FROM events GROUP BY 1""",
    "stream_counters": """
        SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS requests, max(value) AS slowest,
               round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*), 6) AS avg_time FROM events GROUP BY 1, 2""",
    "prediction_records": f"""
        SELECT {_KEYS}, 'flat-1' AS model_version, {_WIDTH} AS features_used, true AS consistent,
               true AS same_as_mllib FROM lineitem""",
    "forest_expr": f"""
        SELECT {_KEYS}, 'forest-1' AS model_version, {_WIDTH} AS features_used, true AS consistent,
               true AS same_as_mllib FROM lineitem""",
    "frozen_expr": f"""
        {_FOREST} SELECT {_KEYS}, round(CAST(p AS DOUBLE), 9) AS prediction, p > 0.5 AS is_attack,
        'frozen-1' AS model_version, 4 AS features_used FROM p""",
    "train_text_labels": f"""
        WITH {_quotas("lineitem", _SIZE, "ceil(0.2 * sum(n))")}
        SELECT k AS class, CAST(quota AS BIGINT) AS support, true AS good_f1, n AS scored, true AS mostly_right
        FROM q JOIN c USING (k)""",
}
