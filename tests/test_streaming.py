import pytest
from pyspark.sql import functions as F

from quarrylight.operators import forest
from quarrylight.operators.preprocess import fit_preprocessing
from quarrylight.operators.requests import parse_named, payload, split_requests
from quarrylight.session import new_folder
from quarrylight.streaming import scoring


@pytest.fixture(scope="module")
def fitted(spark):
    rows = spark.range(300).select(
        "id", (F.col("id") % 10).cast("double").alias("x"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("c"),
        (F.col("id") % 10 > 6).cast("int").alias("Label"),
    )
    params = fit_preprocessing(rows, ["x"], ["c"])
    return rows, params, forest.fit_classifier(rows, params, "Label", trees=3, depth=3)


def test_stream_equals_batch_and_replays_once(spark, fitted):
    rows, params, model = fitted
    sent, out = new_folder(spark, "sent"), new_folder(spark, "out")
    text = payload(rows, ["x"], ["c"]).select(F.col("payload").alias("value"))
    text = text.unionByName(spark.createDataFrame([("broken",), ('{"features":1}',)], "value string"))
    text.repartition(4).write.text(sent)

    def run(state):
        requests = scoring.request_stream(spark, sent, files_per_trigger=2)
        query = scoring.start_scoring(requests, model, params, f"{out}/ok", f"{out}/bad", f"{out}/{state}")
        query.awaitTermination()
        return query

    run("state")
    good, bad = split_requests(parse_named(text, "value", params))
    wanted = sorted(map(tuple, forest.score(good, model, keep=["value"]).collect()))
    scored = lambda: sorted(map(tuple, spark.read.parquet(f"{out}/ok").drop("batch").collect()))
    assert scored() == wanted
    assert sorted(r["status"] for r in spark.read.parquet(f"{out}/bad").collect()) == [500, 500]
    run("state")
    run("lost")
    assert scored() == wanted


def test_health(spark):
    source, out = new_folder(spark, "events"), new_folder(spark, "health")
    rows = spark.range(40).select((F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("ms"))
    rows.repartition(4).write.parquet(source)
    events = spark.readStream.schema("k long, ms double").option("maxFilesPerTrigger", 1).parquet(source)
    scoring.start_health(events, "ms", ["k"], f"{out}/t", f"{out}/s").awaitTermination()
    found = sorted(map(tuple, scoring.newest_state(spark, f"{out}/t").collect()))
    assert found == [(0, 20, 19.0), (1, 20, 20.0)]


def test_reject_sink(spark):
    sent, out = new_folder(spark, "sent"), new_folder(spark, "rejects")
    spark.createDataFrame([("{}",), ('{"features":{}}',), ("x",)], "value string").write.text(sent)
    scoring.start_rejects(scoring.request_stream(spark, sent), f"{out}/t", f"{out}/s", "prefix").awaitTermination()
    assert sorted((r["value"], r["status"]) for r in spark.read.parquet(f"{out}/t").collect()) == [("x", 500), ("{}", 400)]
