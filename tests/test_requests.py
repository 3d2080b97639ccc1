import json
import math

import pytest
from pyspark.sql import functions as F

from quarrylight.operators import requests as rq
from quarrylight.operators.preprocess import Preprocessing

PARAMS = Preprocessing(["x"], ["c"], medians={"x": 9.0}, means={"x": 1.0}, scales={"x": 2.0})
ABSENT = object()


def parse(spark, bodies, mode, scale=False, params=PARAMS):
    rows = spark.createDataFrame(list(enumerate(bodies)), "i int, value string")
    return rq.parse_named(rows, "value", params, mode, scale).orderBy("i").collect()


def body(**features):
    return json.dumps({"features": {k: v for k, v in features.items() if v is not ABSENT}})


NUMBERS = [
    # value, dot, prefix, consistent
    (ABSENT, 0.0, 9.0, None),
    (None, 0.0, 0.0, None),
    ([1], 0.0, 0.0, 0.0),
    ({"a": 1}, 0.0, 0.0, 0.0),
    (True, 1.0, 1.0, 1.0),
    (False, 0.0, 0.0, 0.0),
    (3, 3.0, 3.0, 3.0),
    (2.5, 2.5, 2.5, 2.5),
    ("2,5", 2.5, 25.0, 2.5),
    ("1,000.5", 0.0, 1000.5, 0.0),
    ("1 000", 0.0, 1000.0, 0.0),
    ("12abc", 0.0, 12.0, 0.0),
    ("abc", 0.0, 0.0, 0.0),
    ("1e39", 1e39, 0.0, 1e39),
]


@pytest.mark.parametrize("mode,place", [("dot", 1), ("prefix", 2), ("consistent", 3)])
def test_numbers(spark, mode, place):
    found = parse(spark, [body(x=case[0]) for case in NUMBERS], mode)
    assert [r["x"] for r in found] == [case[place] for case in NUMBERS]


def test_nan_text(spark):
    assert parse(spark, [body(x="nan")], "dot")[0]["x"] == 9.0
    assert math.isnan(parse(spark, [body(x="nan")], "prefix")[0]["x"])


CATEGORIES = [
    (ABSENT, "Missing", "Missing", "Missing"),
    (None, "None", "0.000000", "Missing"),
    (1, "1", "1.000000", "1"),
    (1.0, "1.0", "1.000000", "1.0"),
    (0.25, "0.25", "0.250000", "0.25"),
    (True, "True", "1.000000", "True"),
    ("10.0.0.1", "10.0.0.1", "10.0.0.1", "10.0.0.1"),
    ("", "", "", ""),
]


@pytest.mark.parametrize("mode,place", [("dot", 1), ("prefix", 2), ("consistent", 3)])
def test_categories(spark, mode, place):
    found = parse(spark, [body(c=case[0]) for case in CATEGORIES], mode)
    assert [r["c"] for r in found] == [case[place] for case in CATEGORIES]


def test_scaling(spark):
    found = parse(spark, [body(x=5), body()], "prefix", scale=None)
    assert [r["x"] for r in found] == [2.0, 4.0]
    tiny = Preprocessing(["x"], [], medians={"x": 9.0}, means={"x": 1.0}, scales={"x": 1e-9})
    assert parse(spark, [body(x=5)], "prefix", None, tiny)[0]["x"] == 5.0
    assert parse(spark, [body(x=5)], "dot", None, tiny)[0]["x"] == pytest.approx(4e9)
    assert parse(spark, [body(x=5)], "consistent", None)[0]["x"] == 5.0


BAD = [
    # body, error, dot status, prefix status
    ("not json", rq.NOT_JSON, 500, 500),
    ("", rq.NOT_JSON, 500, 500),
    ("{}", rq.NO_FEATURES, 400, 400),
    ("[1]", rq.NO_FEATURES, 400, 400),
    ('{"feature":{}}', rq.NO_FEATURES, 400, 400),
    ('{"features":[1]}', rq.NOT_OBJECT, 500, 400),
    ('{"features":null}', rq.NOT_OBJECT, 500, 400),
    ('{"features":3}', rq.NOT_OBJECT, 500, 400),
]


def test_rejects(spark):
    for mode, place in (("dot", 2), ("prefix", 3)):
        found = parse(spark, [case[0] for case in BAD], mode)
        assert [r["error"] for r in found] == [case[1] for case in BAD]
        assert [r["status"] for r in found] == [case[place] for case in BAD]
    assert parse(spark, [body()], "dot")[0]["status"] == 200
    assert parse(spark, [body(x="inf")], "dot")[0]["error"] == rq.NOT_FINITE


def test_split(spark):
    rows = spark.createDataFrame([(body(x=1),), ("bad",)], "value string")
    good, bad = rq.split_requests(rq.parse_named(rows, "value", PARAMS))
    assert (good.count(), bad.count()) == (1, 1) and "status" not in good.columns


def test_odd_names(spark):
    params = Preprocessing(["a b", "x.y", "it's"], [], medians={})
    found = parse(spark, [json.dumps({"features": {"a b": 1, "x.y": 2, "it's": 3}})], "prefix", False, params)[0]
    assert [found["a b"], found["x.y"], found["it's"]] == [1, 2, 3]


def test_unfitted(spark):
    rows = spark.createDataFrame([(body(b="1,5", a=2),)], "value string")
    assert rq.named_values(rows, "value", ["a", "z", "b"]).first()["features"] == [2.0, 0.0, 15.0]


def test_positional(spark):
    bodies = [
        '{"features":[1,2.5,true]}', '{"features":[1,2]}', '{"features":["1",2,3]}', '{"features":[null,2,3]}', "{}", "x",
        '{"features":5}',
    ]
    rows = spark.createDataFrame(list(enumerate(bodies)), "i int, value string")
    strict = rq.parse_positional(rows, "value", 3).orderBy("i").collect()
    assert [r["status"] for r in strict] == [200, 400, 400, 400, 400, 400, 400]
    assert strict[0]["features"] == [1.0, 2.5, 1.0]
    loose = rq.parse_positional(rows, "value", 3, "dot").orderBy("i").collect()
    assert [r["status"] for r in loose] == [200, 400, 200, 200, 400, 500, 500]
    assert loose[2]["features"] == [1.0, 2.0, 3.0] and math.isnan(loose[3]["features"][0])


def test_payload_keeps_names_and_drops_nulls(spark):
    rows = spark.createDataFrame([(2, 1.5, None), (1, None, "a")], "i int, x double, c string")
    assert json.loads(rq.sample_payload(rows, ["i"], ["x"], ["c"]).first()[0]) == {"features": {"c": "a"}}
    assert rq.payload(rows, ["x"], ["c"]).where(F.col("i") == 2).first()["payload"] == '{"features":{"x":1.5}}'


def test_positional_dot_reads_whole_numbers_and_rejects_scalars(spark):
    bodies = ['{"features": ["1d"]}', '{"features": [" 1_0.5 "]}', "5", '"features"', '"other"', "true", "[1]"]
    rows = spark.createDataFrame([(b,) for b in bodies], "value string")
    found = {r["value"]: r["status"] for r in rq.parse_positional(rows, "value", 1, "dot").collect()}
    assert [found[b] for b in bodies] == [500, 200, 500, 500, 400, 500, 400]
