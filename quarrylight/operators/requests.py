"""Feature requests as JSON: lenient values, defaults and rejected rows.

Three modes fix what a loosely typed value means. 'dot' reads a comma as the decimal point, takes
0 for an absent number and fills NaN with the median. 'prefix' drops commas and blanks, reads the
longest leading number as a float and takes the median for an absent number. 'consistent' parses
like 'dot', but an absent or null number is imputed as in training and nothing is scaled.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.numbers import fixed_text, parse_dot, parse_prefix, shortest_text, whole_number
from quarrylight.operators.preprocess import MISSING, Preprocessing, standardise
from quarrylight.session import evaluate_once

MODES = ("dot", "prefix", "consistent")

NOT_JSON = "body is not valid JSON"
NO_FEATURES = "body must be an object with features"
NOT_OBJECT = "features must be an object"
NOT_FINITE = "features must be finite"
WRONG_WIDTH = "wrong number of features"
NOT_NUMERIC = "features must be an array of numbers"


def _check_mode(mode: str) -> None:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")


def _value(body: Column, name: str) -> Column:
    escaped = name.replace("\\", "\\\\").replace('"', '\\"')
    return F.try_variant_get(body, f'$.features["{escaped}"]', "variant")


def _is_number(kind: Column) -> Column:
    return kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")


def read_values(df: DataFrame, names: list[str]) -> DataFrame:
    """Add `_kind_i` (type name, null if absent) and `_text_i` for every named value of `body`."""
    if not names:
        return df
    values = evaluate_once(df, {f"_value_{i}": _value(F.col("body"), n) for i, n in enumerate(names)})
    parts = {}
    for i in range(len(names)):
        parts[f"_kind_{i}"] = F.schema_of_variant(F.col(f"_value_{i}"))
        parts[f"_text_{i}"] = F.try_variant_get(F.col(f"_value_{i}"), "$", "string")
    return evaluate_once(values, parts).drop(*[f"_value_{i}" for i in range(len(names))])


def number_of(kind: Column, text: Column, mode: str, default: float | None = None) -> Column:
    """Numeric meaning of a value from its type and text; absent values take `default`."""
    _check_mode(mode)
    fallback = {"dot": F.lit(0.0), "prefix": F.lit(default if default is not None else 0.0), "consistent": F.lit(None)}
    parse = parse_prefix if mode == "prefix" else parse_dot
    out = (
        F.when(kind.isNull(), fallback[mode].cast("double"))
        .when(_is_number(kind), text.try_cast("double"))
        .when(kind == "STRING", parse(text).cast("double"))
        .when((kind == "BOOLEAN") & (text == "true"), F.lit(1.0))
    )
    out = out.when(kind == "VOID", F.lit(None).cast("double")) if mode == "consistent" else out
    out = out.otherwise(F.lit(0.0))
    return out.cast("float") if mode == "prefix" else out


def category_of(kind: Column, text: Column, mode: str) -> Column:
    """Text meaning of a value from its type and text; absent values are the missing category."""
    _check_mode(mode)
    if mode == "prefix":
        other = fixed_text(number_of(kind, text, "prefix"), 6)
        return F.when(kind.isNull(), F.lit(MISSING)).when(kind == "STRING", text).otherwise(other)
    nothing = F.lit(MISSING) if mode == "consistent" else F.lit("None")
    return (
        F.when(kind.isNull(), F.lit(MISSING))
        .when(kind == "VOID", nothing)
        .when(kind == "BOOLEAN", F.initcap(text))
        .when((kind == "DOUBLE") | kind.startswith("DECIMAL"), shortest_text(text.try_cast("double")))
        .otherwise(text)
    )


def _unsearchable(body: Column) -> Column:
    """Bodies in which looking for `features` fails, or finds it where it can't be read: scalars and some text."""
    kind = F.schema_of_variant(body)
    named = F.try_variant_get(body, "$", "string").contains("features")
    return F.coalesce(_is_number(kind) | kind.isin("BOOLEAN", "VOID") | ((kind == "STRING") & named), F.lit(False))


def check_named(df: DataFrame, value: str, mode: str = "consistent") -> DataFrame:
    """Add `body` (variant), `status` and `error` (null if the request is well formed)."""
    _check_mode(mode)
    parsed = evaluate_once(df, {"body": F.try_parse_json(F.col(value))})
    features = F.try_variant_get("body", "$.features", "variant")
    is_object = F.try_variant_get("body", "$.features", "map<string,variant>").isNotNull()
    error = (
        F.when(F.col("body").isNull(), NOT_JSON).when(features.isNull(), NO_FEATURES).when(~is_object, NOT_OBJECT)
    )
    # Only the 'prefix' service calls a features value of the wrong type a client error.
    client = error.isin(NO_FEATURES, NOT_OBJECT) if mode == "prefix" else (error == NO_FEATURES)
    client = client & ~_unsearchable(F.col("body")) if mode == "dot" else client
    status = F.when(error.isNull(), 200).when(client, 400).otherwise(500)
    return parsed.withColumns({"error": error, "status": status})


def parse_named(
    df: DataFrame, value: str, params: Preprocessing, mode: str = "consistent", scale: bool | None = None
) -> DataFrame:
    """Typed feature columns of named requests, next to `status` and `error`.

    'dot' and 'prefix' impute and standardise the numbers as their services do unless scale=False.
    """
    checked = check_named(df, value, mode)
    scale = mode != "consistent" if scale is None else scale
    names = [*params.numeric, *params.categorical]
    read = read_values(checked, names)
    columns = {}
    for i, name in enumerate(params.numeric):
        median = params.medians.get(name)
        number = number_of(F.col(f"_kind_{i}"), F.col(f"_text_{i}"), mode, median)
        if mode == "dot" and median is not None:
            number = F.coalesce(F.nullif(number, F.lit(float("nan"))), F.lit(median))
        columns[name] = number
    for i, name in enumerate(params.categorical, len(params.numeric)):
        columns[name] = category_of(F.col(f"_kind_{i}"), F.col(f"_text_{i}"), mode)
    out = evaluate_once(read, columns) if columns else read
    out = out.drop("body", *[f"_{part}_{i}" for part in ("kind", "text") for i in range(len(names))])
    if mode == "dot" and params.numeric:
        endless = reduce(or_, [F.abs(F.col(f"`{n}`")) == float("inf") for n in params.numeric])
        broken = F.col("error").isNull() & endless
        out = out.withColumns(
            {
                "error": F.when(broken, NOT_FINITE).otherwise(F.col("error")),
                "status": F.when(broken, 500).otherwise(F.col("status")),
            }
        )
    if not scale:
        return out
    scaled = {}
    for n in params.numeric:
        number = standardise(F.col(f"`{n}`"), params.means.get(n), params.scales.get(n), mode == "prefix")
        scaled[n] = number.cast("float") if mode == "prefix" else number
    return out.withColumns(scaled) if scaled else out


def named_values(df: DataFrame, value: str, names: list[str]) -> DataFrame:
    """Without fitted parameters: an array of the named numbers in order, absent ones as 0."""
    read = read_values(check_named(df, value, "prefix"), names)
    numbers = [number_of(F.col(f"_kind_{i}"), F.col(f"_text_{i}"), "prefix") for i in range(len(names))]
    helpers = [f"_{part}_{i}" for part in ("kind", "text") for i in range(len(names))]
    return evaluate_once(read, {"features": F.array(*numbers)}).drop("body", *helpers)


def parse_positional(df: DataFrame, value: str, width: int = 8, mode: str = "prefix") -> DataFrame:
    """Add `features` (array of floats), `status` and `error` for {"features": [...]} requests.

    'prefix' takes numbers and booleans only and calls every fault a client error; 'dot' also reads
    numeric text, takes null as NaN and answers unreadable bodies and values with 500.
    """
    _check_mode(mode)
    parsed = evaluate_once(df, {"body": F.try_parse_json(F.col(value))})
    raw = F.try_variant_get("body", "$.features", "variant")
    items = F.try_variant_get("body", "$.features", "array<variant>")

    def number(item: Column) -> Column:
        kind = F.schema_of_variant(item)
        flag = F.try_variant_get(item, "$", "boolean").cast("double")
        out = F.when(_is_number(kind), F.try_variant_get(item, "$", "double")).when(kind == "BOOLEAN", flag)
        if mode != "prefix":
            text = F.try_variant_get(item, "$", "string")
            out = out.when(kind == "STRING", whole_number(text))
            out = out.when(kind == "VOID", F.lit(float("nan")))
        return out.cast("float")

    read = {"features": F.transform(items, number), "_absent": raw.isNull(), "_no_array": items.isNull()}
    out = evaluate_once(parsed, read)
    bad = F.exists("features", lambda x: x.isNull())
    error = (
        F.when(F.col("body").isNull(), NOT_JSON)
        .when(F.col("_absent"), NO_FEATURES)
        .when(F.col("_no_array") | bad, NOT_NUMERIC)
        .when(F.size("features") != width, WRONG_WIDTH)
    )
    client = F.lit(True) if mode == "prefix" else error.isin(NO_FEATURES, WRONG_WIDTH) & ~_unsearchable(F.col("body"))
    status = F.when(error.isNull(), 200).when(client, 400).otherwise(500)
    return out.withColumns({"error": error, "status": status}).drop("body", "_absent", "_no_array")


def split_requests(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(well-formed, rejected)"""
    return df.where(F.col("error").isNull()).drop("error", "status"), df.where(F.col("error").isNotNull())


def payload(df: DataFrame, numeric: list[str], categorical: list[str], output: str = "payload") -> DataFrame:
    """Add a named request built from feature columns; nulls are left out."""
    fields = [F.col(f"`{n}`").cast("double").alias(n) for n in numeric]
    fields += [F.col(f"`{c}`").cast("string").alias(c) for c in categorical]
    return df.withColumn(output, F.to_json(F.struct(F.struct(*fields).alias("features"))))


def sample_payload(df: DataFrame, order: list[str], numeric: list[str], categorical: list[str]) -> DataFrame:
    """The first row in the given order as a named request."""
    return payload(df.orderBy(*order).limit(1), numeric, categorical).select("payload")
