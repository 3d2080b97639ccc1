"""Label indexes and flat forests against MLlib's own scoring."""

import pytest
from pyspark.sql import functions as F

from quarrylight.operators import bins, flat_forest, forest, preprocess
from quarrylight.session import new_folder


@pytest.fixture(scope="module")
def rows(spark):
    x = (F.col("id") * 37 % 101).cast("double")
    kind = F.when(x > 70, "large").when(x > 30, "middle").otherwise("a small one")
    letter = F.element_at(F.array(*[F.lit(c) for c in "abcdefg"]), (F.col("id") % 7 + 1).cast("int"))
    return spark.range(700).select(
        "id", F.when(F.col("id") % 11 > 0, x).alias("x"), letter.alias("c"), F.when(F.col("id") % 13 > 0, letter).alias("d"),
        kind.alias("kind"), (x > 50).cast("int").alias("binary"), (x * 3 + F.col("id") % 7).alias("y"),
    ).cache()


def fitted(rows, target, **settings):
    params = preprocess.fit_preprocessing(rows, ["x"], ["c", "d"])
    return forest.fit_classifier(rows, params, target, **({"trees": 7, "depth": 6} | settings))


def others(rows):
    """Values that were not seen when fitting, missing ones and repeated rows."""
    odd = rows.where("id < 40").withColumns({"c": F.lit("new"), "d": F.lit(None).cast("string"), "x": F.lit(None).cast("double")})
    return rows.unionByName(odd).unionByName(rows.where("id < 5"))


@pytest.mark.parametrize("depth", [1, 6, 9])
def test_flat_forest_equals_mllib(spark, rows, depth):
    model = fitted(rows, "kind", depth=depth)
    flat = flat_forest.flatten(model, spark)
    table = others(rows)
    scored = lambda df: sorted(map(str, df.collect()))
    want = scored(forest.score(table, model, keep=["id"]))
    assert scored(flat_forest.score(table, flat, keep=["id"])) == want and len(want) == 745
    folder = new_folder(spark, "flat")
    flat_forest.save(flat, folder)
    again = flat_forest.load(spark, folder)
    assert scored(flat_forest.score(table, again, keep=["id"])) == want
    assert (again.classes, again.width, again.outputs) == (["a small one", "large", "middle"], 1 + 7 + 8, 3)


def test_flat_forest_walks_one_record_of_a_cell(spark, rows, monkeypatch):
    """Records between the same thresholds are walked once, and all of them get their probabilities."""
    model = fitted(rows, "kind")
    flat = flat_forest.flatten(model, spark)
    many = others(rows).crossJoin(spark.range(40).select(F.col("id").alias("copy"))).withColumns(
        {"id": F.col("id") * 40 + F.col("copy"), "x": F.col("x") + F.col("copy") / 100}
    )
    walked, cells = [], flat_forest.cells
    monkeypatch.setattr(flat_forest, "cells", lambda *a: walked.append(cells(*a)) or walked[0])
    got = sorted(map(str, flat_forest.score(many, flat, keep=["id", "x"]).collect()))
    assert got == sorted(map(str, forest.score(many, model, keep=["id", "x"]).collect())) and len(got) == 745 * 40
    assert walked[0].count() <= 32 * 8 * 9


def test_bins_count_thresholds_below(spark):
    values = [float("-inf"), -1.5, -1.0, -0.0, 0.0, 0.5, 1.0, 1.1, float("inf"), float("nan")]
    table = spark.createDataFrame([(x,) for x in values], "x double").withColumn("y", F.lit(1.0))
    got = [tuple(r) for r in bins.with_bins(table, {"x": [-1.0, 0.0, 1.0], "y": []}).select("_bin_x", "_bin_y").collect()]
    assert got == [(sum(t < x for t in (-1.0, 0.0, 1.0)) if x == x else -1, 0) for x in values]
    wide = {f"c{i}": [float(j) for j in range(50)] for i in range(30)}
    assert len(bins.packed(wide)) == 3 and len(bins.packed({})) == 1


def test_flat_regression_equals_mllib(spark, rows):
    params = preprocess.fit_preprocessing(rows, ["x"], ["c"])
    model = forest.fit_regressor(rows, params, "y", trees=5, depth=5)
    flat = flat_forest.flatten(model, spark)
    want = sorted(map(str, forest.score_value(others(rows), model, keep=["id"]).collect()))
    assert sorted(map(str, flat_forest.score_value(others(rows), flat, keep=["id"]).collect())) == want


def test_wide_categories_in_a_flat_forest(spark, rows, monkeypatch):
    monkeypatch.setattr(preprocess, "DRIVER_CATEGORIES", 5)
    model = fitted(rows, "binary")
    flat = flat_forest.flatten(model, spark)
    want = sorted(map(str, forest.score(others(rows), model, keep=["id"]).collect()))
    assert sorted(map(str, flat_forest.score(others(rows), flat, keep=["id"]).collect())) == want


def test_too_large_a_forest_is_refused(spark, rows, monkeypatch):
    monkeypatch.setattr(flat_forest, "MOST_NODES", 10)
    with pytest.raises(ValueError, match="nodes"):
        flat_forest.flatten(fitted(rows, "binary"), spark)


def test_label_index_is_part_of_the_model(spark, rows):
    """Names of classes of any type, in their own order, saved with the model; rows without a class are left out."""
    some = rows.withColumn("kind", F.when(F.col("id") % 5 > 0, F.col("kind")))
    model = fitted(some, "kind")
    assert forest.class_names(model) == ["a small one", "large", "middle"]
    path = new_folder(spark, "labels")
    forest.save_model(model, path)
    records = forest.score(rows.drop("kind"), forest.load_model(path), keep=["id", "x"])
    assert records.columns == ["id", "x", "prediction", "class_name", "model_version", "features_used"]
    right = records.join(rows.select("id", "kind"), "id").where("x is not null").agg(F.avg((F.col("class_name") == F.col("kind")).cast("int"))).first()[0]
    assert right > 0.95
    numbers = fitted(rows.withColumn("level", F.col("id") % 3 * 10 + 5), "level", trees=2, depth=2)
    assert forest.class_names(numbers) == ["5", "15", "25"]
    assert forest.class_names(fitted(rows, "binary", trees=2, depth=2)) == ["0", "1"]


def test_report_names_classes(rows):
    _, _, report = forest.train_and_evaluate(rows, ["id"], "kind", features=(["x"], ["c"]), trees=5, depth=6)
    got = {r["class"]: r for r in report.collect()}
    assert set(got) == {"a small one", "large", "middle", "accuracy", "macro avg", "weighted avg"}
    assert got["large"]["support"] > 0 and got["accuracy"]["f1"] > 0.8


def test_feature_without_any_number(rows):
    """A numeric feature that holds nothing is filled with 0; numbers in text count, blanks and suffixes do not."""
    table = rows.withColumns({"nothing": F.lit(None).cast("double"), "text": F.when(F.col("id") % 9 == 0, "").when(
        F.col("id") % 9 == 1, F.lit("1d")).otherwise(F.col("x").cast("string"))})
    params = preprocess.fit_preprocessing(table, ["nothing", "text"], [])
    assert (params.medians["nothing"], params.means["nothing"], params.scales["nothing"]) == (0.0, 0.0, 1.0)
    plain = sorted(r["x"] for r in table.where("id % 9 > 1 AND x IS NOT NULL").collect())
    assert params.medians["text"] == (plain[(len(plain) - 1) // 2] + plain[len(plain) // 2]) / 2
    model, _, report = forest.train_and_evaluate(table, ["id"], "binary", features=(["nothing", "text"], []), trees=3, depth=4)
    assert report.where("class = 'accuracy'").first()["f1"] > 0.8
    filled = {r["id"]: (r["nothing"], r["text"]) for r in preprocess.impute_numeric(table, params).select("id", "nothing", "text").collect()}
    assert filled[0] == filled[1] == (0.0, params.medians["text"])
    vectors = preprocess.apply_preprocessing(table, params).select("id", "features").collect()
    assert all(tuple(r["features"]) == filled[r["id"]] for r in vectors)
