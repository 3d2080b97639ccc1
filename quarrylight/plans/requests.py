"""Requests as JSON text built from the tables: parsing, coercion and rejection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import numbers
from quarrylight.operators import requests as rq
from quarrylight.operators.preprocess import Preprocessing
from quarrylight.sources.tables import read_table

LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


# k: a hexadecimal number as sent, and its value as a float.
HEXADECIMALS = {
    3: ("0x1.8p3", "12"),
    4: ("0x1234567890abcdef12", "3.3581273580222965e+20"),
    5: ("-0xFFp-4 ms", "-15.9375"),
    6: (" 0X.8", "0.5"),
    7: ("0x", "0"),
    8: ("0x1000001000000000000001", "1.9342815419677076e+25"),
}


def event_requests(spark: SparkSession, sf: str) -> DataFrame:
    """(event_id, value): one request per event, whose value type depends on the event type.

    view: numbers; click: text with a decimal comma and a boolean; error: text with thousands
    blanks and a unit, or a hexadecimal number where k is in HEXADECIMALS; signup: nulls; purchase:
    the amount is absent. Events whose k is 0, 1 or 2 give a broken body, a body without features and
    features of the wrong type.
    """
    events = read_table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    amount = F.col("value").cast("decimal(12,2)").cast("string")

    def body(amount_json, kind_json):
        return F.concat(F.lit('{"features":{"amount":'), amount_json, F.lit(',"kind":'), kind_json, F.lit("}}"))

    failed = F.concat(F.lit('"1 '), amount, F.lit('ms"'))
    for value, (written, _) in HEXADECIMALS.items():
        failed = F.when(k == value, F.lit(f'"{written}"')).otherwise(failed)
    text = (
        F.when(k == 0, F.lit('{"features":'))
        .when(k == 1, F.lit('{"data":1}'))
        .when(k == 2, F.lit('{"features":[1]}'))
        .when(F.col("event_type") == "view", body(amount, F.concat(F.lit('"view'), k.cast("string"), F.lit('"'))))
        .when(
            F.col("event_type") == "click",
            body(F.concat(F.lit('"'), F.replace(amount, F.lit("."), F.lit(",")), F.lit('"')), F.lit("true")),
        )
        .when(F.col("event_type") == "error", body(failed, F.concat(k.cast("string"), F.lit(".0"))))
        .when(F.col("event_type") == "signup", body(F.lit("null"), F.lit("null")))
        .otherwise(F.concat(F.lit('{"features":{"kind":'), k.cast("string"), F.lit("}}")))
    )
    return events.select("event_id", text.alias("value"))


# Parameters of the request queries: the median stands in for absent amounts.
REQUEST_PARAMS = Preprocessing(
    ["amount"], ["kind"], medians={"amount": 25.5}, means={"amount": 20.0}, scales={"amount": 8.0}
)


def _parsed(spark: SparkSession, sf: str, mode: str) -> DataFrame:
    out = rq.parse_named(event_requests(spark, sf), "value", REQUEST_PARAMS, mode, scale=False)
    good, _ = rq.split_requests(out)
    return good.select("event_id", F.round(F.col("amount").cast("double"), 3).alias("amount"), "kind")


def parse_features_dot(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed(spark, sf, "dot")


def parse_features_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed(spark, sf, "prefix")


def parse_features_consistent(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed(spark, sf, "consistent")


def serve_scaled(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts as the 'prefix' service feeds them to its model: defaulted, then standardised."""
    out = rq.parse_named(event_requests(spark, sf), "value", REQUEST_PARAMS, "prefix")
    good, _ = rq.split_requests(out)
    return good.select("event_id", F.round(F.col("amount").cast("double"), 3).alias("amount"))


def reject_requests(spark: SparkSession, sf: str) -> DataFrame:
    checked = rq.check_named(event_requests(spark, sf), "value", "dot")
    strict = rq.check_named(event_requests(spark, sf), "value", "prefix")
    _, bad = rq.split_requests(checked)
    _, bad_strict = rq.split_requests(strict)
    first = bad.select("event_id", "error", F.col("status").alias("status"), F.lit("dot").alias("mode"))
    return first.unionByName(bad_strict.select("event_id", "error", "status", F.lit("prefix").alias("mode")))


def unfitted_values(spark: SparkSession, sf: str) -> DataFrame:
    """Without fitted parameters every feature is read by name as a number."""
    out = rq.named_values(event_requests(spark, sf), "value", ["kind", "amount"])
    good, _ = rq.split_requests(out)
    return good.select(
        "event_id", *[F.round(F.col("features")[i].cast("double"), 3).alias(f"slot{i}") for i in range(2)]
    )


def positional_request(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as positional requests; label 0 sends one value too few, label 1 a text value."""
    vectors = read_table(spark, sf, "embeddings")
    short = F.slice("embedding", 1, F.size("embedding") - 1)
    sent = F.to_json(F.struct(F.when(F.col("label") == 0, short).otherwise(F.col("embedding")).alias("features")))
    sent = F.when(F.col("label") == 1, F.regexp_replace(sent, r"\[", '["x",')).otherwise(sent)
    parsed = rq.parse_positional(vectors.select("vec_id", sent.alias("value")), "value", width=64)
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return parsed.select(
        "vec_id", "status", "error", F.when(F.col("error").isNull(), F.round(total, 4)).alias("total")
    )


def positional_dot(spark: SparkSession, sf: str) -> DataFrame:
    """Positional requests as the service reads them that also takes text and null.

    Label 0 sends one value too few, 1 its first value as text, 2 a word, 3 null, 4 a broken body, 5 no features.
    """
    vectors = read_table(spark, sf, "embeddings")
    label = F.col("label")
    sent = F.to_json(F.struct(F.when(label == 0, F.slice("embedding", 1, F.size("embedding") - 1)).otherwise(F.col("embedding")).alias("features")))
    changed = (
        F.when(label == 1, F.regexp_replace(sent, r"\[([^,]+),", '[" $1 ",'))
        .when(label == 2, F.regexp_replace(sent, r"\[[^,]+,", '["x",'))
        .when(label == 3, F.regexp_replace(sent, r"\[[^,]+,", "[null,"))
        .when(label == 4, F.substring(sent, F.lit(1), F.length(sent) - 1))
        .when(label == 5, F.replace(sent, F.lit("features"), F.lit("data")))
        .otherwise(sent)
    )
    parsed = rq.parse_positional(vectors.select("vec_id", changed.alias("value")), "value", width=64, mode="dot")
    known = F.filter("features", lambda x: ~F.isnan(x))
    total = F.aggregate(known, F.lit(0.0), lambda a, x: a + x.cast("double"))
    served = F.col("error").isNull()
    return parsed.select(
        "vec_id", "status", "error", F.when(served, F.round(total, 4)).alias("total"),
        F.when(served, F.size("features") - F.size(known)).alias("missing"),
    )


def sample_payload(spark: SparkSession, sf: str) -> DataFrame:
    """The first line as a request, read back field by field."""
    lines = read_table(spark, sf, "lineitem")
    sample = rq.sample_payload(lines, LINE_ORDER, ["l_quantity", "l_tax"], ["l_returnflag"])
    body = F.parse_json("payload")
    return sample.select(
        F.variant_get(body, "$.features.l_quantity", "double").alias("l_quantity"),
        F.variant_get(body, "$.features.l_tax", "double").alias("l_tax"),
        F.variant_get(body, "$.features.l_returnflag", "string").alias("l_returnflag"),
    )


def sigmoid_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Raw outputs of one or two values to a probability, a decision and a class name."""
    supplier = read_table(spark, sf, "supplier")
    raw = F.col("s_acctbal") / 1000
    output = F.when(F.col("s_nationkey") % 2 == 0, F.array(raw)).otherwise(F.array(F.lit(1.0) - raw, raw))
    probability = numbers.probability_from_output(output)
    return supplier.select(
        "s_suppkey",
        F.round(probability, 9).alias("prediction"),
        numbers.exceeds(probability).alias("is_attack"),
        F.when(numbers.exceeds(probability), "Attack").otherwise("Normal").alias("class_name"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        parse_features_dot, parse_features_prefix, parse_features_consistent, serve_scaled, reject_requests,
        unfitted_values, positional_request, positional_dot, sample_payload, sigmoid_fallback,
    )
}

_E = """e AS (SELECT event_id, event_type AS t, CAST(value AS DECIMAL(12,2)) AS v, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)"""
_FLOAT = "CAST(CAST({} AS FLOAT) AS DOUBLE)"
_PREFIX_AMOUNT = (
    "CASE t WHEN 'view' THEN CAST(v AS FLOAT) WHEN 'click' THEN CAST(replace(CAST(v AS VARCHAR), '.', '') AS FLOAT) "
    "WHEN 'error' THEN CASE k " + " ".join(f"WHEN {k} THEN CAST({value} AS FLOAT)" for k, (_, value) in HEXADECIMALS.items())
    + " ELSE CAST('1' || CAST(v AS VARCHAR) AS FLOAT) END WHEN 'signup' THEN 0 ELSE 25.5 END"
)
SQL = {
    "parse_features_dot": f"""
        WITH {_E} SELECT event_id, round(CASE t WHEN 'view' THEN CAST(v AS DOUBLE) WHEN 'click' THEN CAST(v AS DOUBLE) ELSE 0.0 END, 3) AS amount,
        CASE t WHEN 'view' THEN 'view' || k WHEN 'click' THEN 'True' WHEN 'error' THEN k || '.0' WHEN 'signup' THEN 'None' ELSE k || '' END AS kind
        FROM e WHERE k > 2""",
    "parse_features_prefix": f"""
        WITH {_E} SELECT event_id, round({_FLOAT.format(_PREFIX_AMOUNT)}, 3) AS amount,
        CASE t WHEN 'view' THEN 'view' || k WHEN 'click' THEN '1.000000' WHEN 'signup' THEN '0.000000' ELSE k || '.000000' END AS kind
        FROM e WHERE k > 2""",
    "parse_features_consistent": f"""
        WITH {_E} SELECT event_id, round(CASE t WHEN 'view' THEN CAST(v AS DOUBLE) WHEN 'click' THEN CAST(v AS DOUBLE) WHEN 'error' THEN 0.0 END, 3) AS amount,
        CASE t WHEN 'view' THEN 'view' || k WHEN 'click' THEN 'True' WHEN 'error' THEN k || '.0' WHEN 'signup' THEN 'Missing' ELSE k || '' END AS kind
        FROM e WHERE k > 2""",
    "serve_scaled": f"""
        WITH {_E} SELECT event_id, round({_FLOAT.format(f"(CAST({_PREFIX_AMOUNT} AS DOUBLE) - 20.0) / 8.0")}, 3) AS amount FROM e WHERE k > 2""",
    "reject_requests": f"""
        WITH {_E}, m AS (SELECT * FROM (VALUES ('dot', 500), ('prefix', 400)) x(mode, wrong_type))
        SELECT event_id, mode,
               CASE k WHEN 0 THEN '{rq.NOT_JSON}' WHEN 1 THEN '{rq.NO_FEATURES}' ELSE '{rq.NOT_OBJECT}' END AS error,
               CASE k WHEN 0 THEN 500 WHEN 1 THEN 400 ELSE wrong_type END AS status
        FROM e, m WHERE k <= 2""",
    "unfitted_values": f"""
        WITH {_E} SELECT event_id, round(CAST(CASE t WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 0 ELSE k END AS DOUBLE), 3) AS slot0,
        CASE WHEN t = 'purchase' THEN 0.0 ELSE round({_FLOAT.format(_PREFIX_AMOUNT)}, 3) END AS slot1 FROM e WHERE k > 2""",
    "positional_request": f"""
        SELECT vec_id, CASE WHEN label IN (0, 1) OR len(embedding) <> 64 THEN 400 ELSE 200 END AS status,
               CASE WHEN label = 1 THEN '{rq.NOT_NUMERIC}' WHEN label = 0 OR len(embedding) <> 64 THEN '{rq.WRONG_WIDTH}' END AS error,
               CASE WHEN label NOT IN (0, 1) AND len(embedding) = 64
                    THEN round(list_sum(CAST(embedding AS DOUBLE[])), 4) END AS total
        FROM embeddings""",
    "positional_dot": f"""
        WITH v AS (SELECT vec_id, label, len(embedding) = 64 AS fits, CASE WHEN label = 3 THEN list_sum(CAST(embedding[2:] AS DOUBLE[]))
                   ELSE list_sum(CAST(embedding AS DOUBLE[])) END AS s FROM embeddings)
        SELECT vec_id, CASE WHEN label IN (2, 4) THEN 500 WHEN label IN (0, 5) OR NOT fits THEN 400 ELSE 200 END AS status,
               CASE WHEN label = 4 THEN '{rq.NOT_JSON}' WHEN label = 5 THEN '{rq.NO_FEATURES}' WHEN label = 2 THEN '{rq.NOT_NUMERIC}'
                    WHEN label = 0 OR NOT fits THEN '{rq.WRONG_WIDTH}' END AS error,
               CASE WHEN label NOT IN (0, 2, 4, 5) AND fits THEN round(s, 4) END AS total,
               CASE WHEN label NOT IN (0, 2, 4, 5) AND fits THEN CAST(label = 3 AS INTEGER) END AS missing FROM v""",
    "sample_payload": f"SELECT l_quantity, l_tax, l_returnflag FROM lineitem ORDER BY {', '.join(LINE_ORDER)} LIMIT 1",
    "sigmoid_fallback": """
        WITH r AS (SELECT s_suppkey, s_nationkey % 2 = 0 AS single, s_acctbal / 1000 AS v FROM supplier),
        p AS (SELECT s_suppkey, CASE WHEN single AND (v < 0 OR v > 1) THEN 1 / (1 + exp(-v)) ELSE v END AS p FROM r)
        SELECT s_suppkey, round(p, 9) AS prediction, p > 0.5 AS is_attack,
               CASE WHEN p > 0.5 THEN 'Attack' ELSE 'Normal' END AS class_name FROM p""",
}
