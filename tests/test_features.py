import json

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from quarrylight.operators import forest, preprocess, profile
from quarrylight.operators.preprocess import Preprocessing
from quarrylight.session import new_folder
from quarrylight.sources import params as files


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, float(i % 4) if i % 10 else None, "abc"[i % 3] if i % 4 else None, 5.0) for i in range(100)]
    return spark.createDataFrame(rows, "id int, x double, c string, k double")


def test_target(spark):
    frame = lambda *names: spark.createDataFrame([tuple(range(len(names)))], list(names))
    assert profile.resolve_target(frame("a", "Label", "target")) == "Label"
    assert profile.resolve_target(frame("class", "target")) == "target"
    with pytest.raises(ValueError):
        profile.resolve_target(frame("a", "LABEL"))


def test_profile_rules(spark):
    rows = [(i, i % 2, None if i < 4 else 1.0, float("nan") if i < 3 else 1.0, "t", i % 2) for i in range(10)]
    frame = spark.createDataFrame(rows, "id int, half int, holes double, nans double, Time string, Label int")
    found = {r["column"]: (r["distinct"], r["null_share"], r["drop_reason"]) for r in profile.profile_columns(frame).collect()}
    assert found == {
        "id": (10, 0.0, "distinct"), "half": (2, 0.0, None), "holes": (1, 0.4, "nulls"), "nans": (1, 0.3, None),
        "Time": (1, 0.0, "name"), "Label": (2, 0.0, None),
    }
    assert profile.drop_reasons(frame) == {c: v[2] for c, v in found.items()}
    assert {r["column"]: r["drop_reason"] for r in profile.profile_columns(frame, approximate=True).collect()} == {
        c: v[2] for c, v in found.items()
    }
    assert profile.select_features(frame, order=["id"]) == ("Label", ["half", "nans"], [])


def test_drop_reasons_of_an_empty_table(spark):
    assert profile.drop_reasons(spark.range(0)) == {"id": None}


def test_kinds(spark):
    rows = [(i, str(i), "x" if i == 150 else "1e3", True, None) for i in range(200)]
    frame = spark.createDataFrame(rows, "id int, a string, late string, b boolean, none string")
    kinds = lambda **kw: {r["column"]: r["kind"] for r in profile.column_kinds(frame, frame.columns, ["id"], **kw).collect()}
    assert kinds() == dict.fromkeys(frame.columns, "numeric")
    assert kinds(probe_rows=None)["late"] == "categorical"


def test_fit(spark, table):
    params = preprocess.fit_preprocessing(table, ["x", "k"], ["c"])
    assert params.medians == {"x": 1.5, "k": 5.0}
    assert params.scales["k"] == 1.0 and params.means["k"] == 5.0
    assert params.categories == {"c": ["Missing", "a", "b", "c"]}
    assert params.feature_names == ["x", "k", "c_Missing", "c_a", "c_b", "c_c"]
    filled = [r["x"] if r["x"] is not None else 1.5 for r in table.collect()]
    assert params.means["x"] == pytest.approx(sum(filled) / 100)


def test_vector(spark, table):
    params = preprocess.fit_preprocessing(table, ["x"], ["c"])
    other = spark.createDataFrame([(1, None, "zzz", 1.0), (2, 3.0, "b", 1.0), (3, float("nan"), None, 1.0)], table.schema)
    found = preprocess.apply_preprocessing(other, params).orderBy("id").select(vector_to_array("features").alias("v")).collect()
    assert [r["v"] for r in found] == [[1.5, 0, 0, 0, 0], [3.0, 0, 0, 1, 0], [1.5, 1, 0, 0, 0]]
    scaled = preprocess.apply_preprocessing(other, params, scale=True).orderBy("id").select(vector_to_array("features")[0].alias("v")).first()
    assert scaled["v"] == pytest.approx((1.5 - params.means["x"]) / params.scales["x"])


def test_category_positions_over_many_partitions(spark):
    rows = spark.range(2000).select(F.concat(F.lit("v"), F.col("id") % 997).alias("c"), (F.col("id") % 3).cast("string").alias("d"))
    found = preprocess.category_index(rows.repartition(6), ["c", "d"]).collect()
    for name in ("c", "d"):
        values = sorted(r["category"] for r in found if r["feature"] == name)
        assert {r["category"]: r["position"] for r in found if r["feature"] == name} == {v: i for i, v in enumerate(values)}


def test_too_many_categories_stay_in_a_table(spark, monkeypatch):
    monkeypatch.setattr(preprocess, "DRIVER_CATEGORIES", 5)
    rows = spark.range(10).select(F.col("id"), F.col("id").cast("string").alias("c"))
    params = preprocess.fit_preprocessing(rows, [], ["c"])
    assert params.index.count() == 10 and params.widths == {"c": 10} and not params.categories
    index = preprocess.category_index(rows.where("id < 9"), ["c"])
    tall = preprocess.one_hot_long(rows, ["id"], ["c"], index)
    assert tall.count() == 10 and tall.where("known").count() == 9


def test_many_categories_train_and_score(spark, monkeypatch):
    rows = spark.range(400).select(
        "id", (F.col("id") % 7).cast("double").alias("x"), F.concat(F.lit("v"), F.col("id") % 20).alias("c"),
        F.when(F.col("id") % 9 > 0, F.concat(F.lit("w"), F.col("id") % 3)).alias("d"), (F.col("id") % 20 < 6).cast("int").alias("Label"),
    )
    other = rows.where("id < 60").unionByName(rows.where("id < 3").withColumns({"c": F.lit("new"), "d": F.lit("new")}))
    listed = preprocess.fit_preprocessing(rows, ["x"], ["c", "d"])
    plain = forest.fit_classifier(rows, listed, "Label", trees=5, depth=6)
    monkeypatch.setattr(preprocess, "DRIVER_CATEGORIES", 5)
    params = preprocess.fit_preprocessing(rows, ["x"], ["c", "d"], wide=True)
    assert params.categories == {} and params.widths == {"c": 20, "d": 4} and params.medians == listed.medians
    vectors = lambda p: sorted((r["id"], str(r["c"]), r["features"]) for r in preprocess.apply_preprocessing(other, p).collect())
    assert [(i, c, v.toArray().tolist()) for i, c, v in vectors(params)] == [(i, c, v.toArray().tolist()) for i, c, v in vectors(listed)]
    model = forest.fit_classifier(rows, params, "Label", trees=5, depth=6)
    path = new_folder(spark, "wide")
    forest.save_model(model, path)
    records = lambda m: sorted(map(str, forest.score(other, m, keep=["id", "c"], width=25).collect()))
    assert records(model) == records(forest.load_model(path)) and len(records(model)) == 63
    assert all(r["is_attack"] == r["Label"] for r in forest.score(rows, model).collect())
    assert len(records(plain)) == 63
    with pytest.raises(ValueError):
        params.feature_names
    _, found, report = forest.train_and_evaluate(rows, ["id"], "Label", features=(["x"], ["c", "d"]), trees=5, depth=6, bins=16)
    assert found.widths["c"] == 20 and report.where("class = 'accuracy'").first()["f1"] > 0.9


@pytest.mark.parametrize("limit", [100_000, 1_000_000])
def test_many_categories_as_a_table_and_as_json(spark, monkeypatch, limit):
    """200 000 categories go through the partitioned table and the JSON document derived from it."""
    monkeypatch.setattr(preprocess, "DRIVER_CATEGORIES", limit)
    n = 200_000
    rows = spark.range(n).select(
        F.col("id").cast("double").alias("x"), F.concat(F.lit("k/="), F.col("id").cast("string")).alias("key part"),
        F.when(F.col("id") % 2 == 0, "a").alias("few"),
    )
    params = preprocess.fit_preprocessing(rows, ["x"], ["key part", "few"])
    folder = new_folder(spark, "params")
    files.write_param_table(spark, params, f"{folder}/table")
    files.write_params(spark, params, f"{folder}/json")
    files.write_metadata(spark, params, "y", ["0", "1"], "forest", f"{folder}/metadata")
    ordered = lambda p: preprocess.index_of(spark, p).orderBy("feature", "position").agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("feature", "position", "category").cast("decimal(38,0)"))
    ).first()
    for known in (files.read_param_table(spark, f"{folder}/table"), files.read_params(spark, f"{folder}/json")):
        assert (known.index is None) == (limit == 1_000_000) and ordered(known) == ordered(params)
        assert (known.numeric, known.categorical, known.medians, known.scales) == (["x"], ["key part", "few"], params.medians, params.scales)
    meta = files.read_metadata(spark, f"{folder}/metadata").select(F.size("feature_names"), F.get("feature_names", F.lit(1)), F.element_at("feature_names", -1), "input_shape")
    assert tuple(meta.first()) == (n + 3, "key part_k/=0", "few_a", [1, n + 3])
    tidy = preprocess.tidy_params(rows, params).select("feature", F.size("categories").alias("n")).collect()
    assert {r["feature"]: r["n"] for r in tidy} == {"x": None, "key part": n, "few": 2}


def test_params_file_ignores_junk(spark):
    path = new_folder(spark, "junk")
    text = json.dumps(
        {
            "numerical_features": ["a", "b"], "categorical_features": ["c", "d"],
            "numerical_medians": {"a": 1, "b": "no"}, "numerical_means": {"a": 0.5, "b": None}, "numerical_scales": {"a": 2.5},
            "categorical_categories": {"c": ["x", 3, "y"], "d": [], "e": "no"},
        }
    )
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    found = files.read_params(spark, path)
    assert found == Preprocessing(["a", "b"], ["c", "d"], {"a": 1.0}, {"a": 0.5}, {"a": 2.5}, {"c": ["x", "y"]})


def test_params_and_metadata_survive(spark, table):
    params = preprocess.fit_preprocessing(table, ["x", "k"], ["c"])
    path = new_folder(spark, "params")
    files.write_params(spark, params, path)
    assert files.read_params(spark, path) == params
    meta = new_folder(spark, "meta")
    files.write_metadata(spark, params, "y", ["Normal", "Attack"], "forest", meta)
    row = files.read_metadata(spark, meta).first()
    assert row["feature_names"] == params.feature_names and row["input_shape"] == [1, 6]
    broken = new_folder(spark, "broken")
    spark.createDataFrame([('{"target":"y"}',)], "value string").write.text(broken)
    with pytest.raises(ValueError):
        files.read_metadata(spark, broken)


@pytest.fixture(scope="module")
def learnable(spark):
    return spark.range(600).select(
        "id", (F.col("id") % 40).cast("double").alias("x"), (F.hash("id") % 7).cast("double").alias("noise"),
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("c"),
        ((F.col("id") % 40 > 25) & (F.col("id") % 3 != 0)).cast("int").alias("Label"),
        (F.col("id") % 40 * 2 + 1).cast("double").alias("y"),
    )


def test_classifier(spark, learnable):
    frame = learnable.drop("y")
    model, params, report = forest.train_and_evaluate(
        frame, ["id"], "Label", features=(["x", "noise"], ["c"]), trees=5, depth=5
    )
    rows = {r["class"]: r for r in report.collect()}
    assert rows["accuracy"]["f1"] > 0.95 and rows["accuracy"]["support"] == 120
    path = new_folder(spark, "model")
    forest.save_model(model, path)
    one = forest.score(frame, model, keep=["id"]).orderBy("id").collect()
    assert one == forest.score(frame, forest.load_model(path), keep=["id"]).orderBy("id").collect()
    assert one[0]["features_used"] == 4 and {r["class_name"] for r in one} == {"Normal", "Attack"}
    assert forest.score(frame, model, width=4).count() == 600
    with pytest.raises(ValueError):
        forest.score(frame, model, width=116)
    assert all(r["is_attack"] == (r["prediction"] > 0.5) for r in one)


def test_automatic_features(spark, learnable):
    _, params, _ = forest.train_and_evaluate(learnable.drop("y"), ["id"], "Label", order=["id"], trees=2, depth=2)
    assert (params.numeric, params.categorical) == (["x", "noise"], ["c"])


def test_regressor_and_frozen_trees(spark, learnable):
    model, params, report = forest.train_and_evaluate_value(learnable, ["id"], "y", ["x", "noise"], trees=4, depth=4)
    assert report.first()["r2"] > 0.9
    frozen = forest.forest_expression(forest.frozen_trees(model.stages[-1], ["x", "noise"]))
    pairs = model.transform(learnable).select("prediction", frozen.alias("frozen")).collect()
    assert [p["prediction"] for p in pairs] == pytest.approx([p["frozen"] for p in pairs])
    assert forest.score_value(learnable, model, keep=["id"]).columns == ["id", "prediction", "model"]


def test_regressor_on_condensed_rows(spark):
    """A large train part is fitted on few weighted rows that hold every row and lie in the bins they are scored in."""
    table = spark.range(40_000).select(
        "id", (F.col("id") * 7919 % 10_007 - 3000).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("few"),
        F.when(F.col("id") % 9 > 0, F.lit(1.0)).alias("one"),
    ).withColumn("y", F.col("x") * (1 + F.col("few")) + F.pmod(F.hash("id"), F.lit(50)))
    names = ["x", "few", "one"]
    params = preprocess.fit_preprocessing(table, names, [])
    few = forest.condensed(table, ["id"], params, "y", groups=3).collect()
    assert len(few) <= 31 * 5 * 3 and sum(r["weight"] for r in few) == 40_000
    assert sum(r["weight"] * r["y"] for r in few) == pytest.approx(table.agg(F.sum("y")).first()[0])
    assert {r["few"] for r in few} == {0.0, 1.0, 2.0, 3.0, 4.0} and {r["one"] for r in few} == {1.0}
    values = {r["x"] for r in few}
    assert 0.0 in values and len(values) < forest.BINS
    settings = {"trees": 5, "depth": 6}
    model, _, report = forest.train_and_evaluate_value(table, ["id"], "y", names, plain_rows=1000, **settings)
    _, _, plain = forest.train_and_evaluate_value(table, ["id"], "y", names, **settings)
    assert report.first()["rows"] == plain.first()["rows"] == 8000
    assert abs(report.first()["r2"] - plain.first()["r2"]) < 0.01

    def thresholds(tree):
        return set() if not isinstance(tree, tuple) else {tree[:2]} | thresholds(tree[2]) | thresholds(tree[3])

    used = set().union(*map(thresholds, forest.frozen_trees(model.stages[-1], names)))
    train = forest.sampling.random_split(table, ["id"]).where("split = 'train'")
    values = sorted({r["x"] for r in forest.condensed(train, ["id"], params, "y").collect()})
    halfway = {(a + b) / 2 for a, b in zip(values, values[1:])}
    assert {t for c, t in used if c == "x"} <= halfway


def test_missing_target_of_condensed_rows(spark):
    table = spark.range(300).selectExpr("id", "double(id % 7) as x", "if(id = 5, null, double(id)) as y")
    params = preprocess.fit_preprocessing(table, ["x"], [])
    few = forest.condensed(table, ["id"], params, "y", groups=1)
    assert [r["x"] for r in few.collect() if r["y"] is None] == [5.0]
    with pytest.raises(Exception):
        forest.fit_regressor(few, params, "y", weight="weight")


def test_class_weights(spark, learnable):
    weights = {r["Label"]: r["weight"] for r in forest.class_weights(learnable, "Label").collect()}
    ones = learnable.where("Label = 1").count()
    assert weights[1] == pytest.approx(600 / (2 * ones)) and weights[0] == pytest.approx(600 / (2 * (600 - ones)))


def test_whole_column_decides_the_kind(spark):
    rows = spark.range(400).selectExpr("id % 7 as a", "CASE WHEN id = 250 THEN 'x' ELSE string(id % 5) END as t", "int(id % 2) as Label")
    assert profile.select_features(rows, "Label") == ("Label", ["a"], ["t"])
    assert profile.select_features(rows, "Label", ["a"], probe_rows=10)[1] == ["a", "t"]
