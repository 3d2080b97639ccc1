"""Fitted parameters, imputation, scaling and encoding."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators import preprocess
from quarrylight.operators.preprocess import Preprocessing
from quarrylight.plans.sampling import LINE_KEY
from quarrylight.session import new_folder, small_side
from quarrylight.sources import params as files
from quarrylight.sources.tables import read_table

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem with gaps: no quantity above 40, no discount of 5 %, no flag 'N'."""
    lines = read_table(spark, sf, "lineitem")
    return lines.select(
        *LINE_KEY,
        F.when(F.col("l_quantity") <= 40, F.col("l_quantity")).alias("l_quantity"),
        "l_extendedprice",
        F.nullif("l_discount", F.lit(0.05)).alias("l_discount"),
        "l_tax",
        F.nullif("l_returnflag", F.lit("N")).alias("l_returnflag"),
        "l_linestatus",
    )


def _rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


def fit_numeric_params(spark: SparkSession, sf: str) -> DataFrame:
    out = preprocess.fit_numeric(_lines(spark, sf), NUMERIC)
    return _rounded(out, {"median": 4, "mean": 4, "scale": 4})


def fit_categories(spark: SparkSession, sf: str) -> DataFrame:
    return preprocess.category_index(_lines(spark, sf), ["l_returnflag", "l_linestatus"])


def encoded_feature_names(spark: SparkSession, sf: str) -> DataFrame:
    orders = read_table(spark, sf, "orders")
    return preprocess.encoded_names(preprocess.category_index(orders, ["o_orderpriority", "o_orderstatus"]))


def impute_median(spark: SparkSession, sf: str) -> DataFrame:
    lines = _lines(spark, sf)
    params = preprocess.fit_preprocessing(lines, NUMERIC, [])
    return preprocess.impute_numeric(lines, params).select(*LINE_KEY, *NUMERIC)


def impute_missing(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["l_returnflag", "l_linestatus"]
    return preprocess.impute_categorical(_lines(spark, sf), columns).select(*LINE_KEY, *columns)


def standardize(spark: SparkSession, sf: str) -> DataFrame:
    lines = _lines(spark, sf)
    params = preprocess.fit_preprocessing(lines, NUMERIC, [])
    scaled = preprocess.scale_numeric(preprocess.impute_numeric(lines, params), params)
    return _rounded(scaled.select(*LINE_KEY, *NUMERIC), {c: 4 for c in NUMERIC})


# The segments of the customers that the encodings are fitted on; customers of other segments encode to zeros.
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE"]


def _fitted_customers(spark: SparkSession, sf: str) -> tuple[DataFrame, Preprocessing]:
    """Customers with gaps in their balance, and what is fitted on those of three segments."""
    customer = read_table(spark, sf, "customer").withColumn("c_acctbal", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")))
    known = customer.where(F.col("c_mktsegment").isin(SEGMENTS))
    return customer, preprocess.fit_preprocessing(known, ["c_acctbal", "c_nationkey"], ["c_mktsegment"])


def one_hot(spark: SparkSession, sf: str) -> DataFrame:
    customer, params = _fitted_customers(spark, sf)
    return customer.select("c_custkey", *preprocess.one_hot_columns(params))


def one_hot_tall(spark: SparkSession, sf: str) -> DataFrame:
    """The tall encoding of orders against the categories of the finished ones only."""
    orders = read_table(spark, sf, "orders")
    known = orders.where("o_orderstatus = 'F'")
    index = preprocess.category_index(known, ["o_orderstatus", "o_orderpriority"])
    return preprocess.one_hot_long(orders, ["o_orderkey"], ["o_orderstatus", "o_orderpriority"], index)


def feature_vector(spark: SparkSession, sf: str) -> DataFrame:
    """Numeric block and one-hot block in one vector, shown slot by slot."""
    customer, params = _fitted_customers(spark, sf)
    vectors = preprocess.apply_preprocessing(customer, params).withColumn("v", vector_to_array("features"))
    return vectors.select("c_custkey", *[F.col("v")[i].alias(f"slot{i}") for i in range(len(params.feature_names))])


def place_by_name(spark: SparkSession, sf: str) -> DataFrame:
    """Named numbers into fixed positions; names without a value give 0."""
    nation = read_table(spark, sf, "supplier")
    values = F.create_map(
        F.lit("balance"), F.col("s_acctbal"), F.lit("nation"), F.col("s_nationkey").cast("double")
    )
    slots = preprocess.place_by_name(values, ["nation", "absent", "balance"])
    return nation.select("s_suppkey", slots.alias("v")).select(
        "s_suppkey", *[F.col("v")[i].alias(f"slot{i}") for i in range(3)]
    )


def tidy_params(spark: SparkSession, sf: str) -> DataFrame:
    lines = _lines(spark, sf)
    params = preprocess.fit_preprocessing(lines, ["l_quantity", "l_tax"], ["l_returnflag"])
    out = preprocess.tidy_params(lines, params).withColumn("categories", F.concat_ws(",", "categories"))
    return _rounded(out, {"median": 4, "mean": 4, "scale": 4})


def params_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Parameters written as JSON and read back."""
    path = new_folder(spark, "params")
    fitted = preprocess.fit_preprocessing(_lines(spark, sf), NUMERIC, ["l_returnflag", "l_linestatus"])
    files.write_params(spark, fitted, path)
    out = files.params_entries(spark, path).withColumn("categories", F.concat_ws(",", "categories"))
    return _rounded(out, {"number": 4})


def metadata_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = new_folder(spark, "metadata")
    fitted = preprocess.fit_preprocessing(_lines(spark, sf), NUMERIC, ["l_returnflag", "l_linestatus"])
    files.write_metadata(spark, fitted, "l_linestatus", ["F", "O"], "RandomForestClassifier", path)
    meta = files.read_metadata(spark, path)
    return meta.select(
        F.concat_ws(",", "feature_names").alias("feature_names"), "target", "model_type",
        F.col("input_shape")[1].alias("width"),
    )


def fit_text_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers as text with blanks, units and Java's suffixes, and a column without any: fitted, imputed and vectorised."""
    lines = read_table(spark, sf, "lineitem")
    text = F.col("l_quantity").cast("int").cast("string")
    odd = F.when(F.col("l_linenumber") == 1, "").when(F.col("l_linenumber") == 2, F.concat(text, F.lit("d"))).when(
        F.col("l_linenumber") == 3, F.concat(F.lit(" "), text, F.lit(" "))
    ).when(F.col("l_linenumber") == 4, F.concat(text, F.lit("e0"))).otherwise(text)
    table = lines.select(*LINE_KEY, odd.alias("amount"), F.lit(None).cast("string").alias("nothing"))
    params = preprocess.fit_preprocessing(table, ["amount", "nothing"], [])
    vectors = preprocess.apply_preprocessing(table, params).withColumn("v", vector_to_array("features"))
    return preprocess.impute_numeric(vectors, params).select(
        *LINE_KEY, "amount", "nothing", F.col("v")[0].alias("slot0"), F.col("v")[1].alias("slot1"),
        F.round(F.lit(params.means["amount"]), 4).alias("mean"),
    )


def params_table(spark: SparkSession, sf: str) -> DataFrame:
    """Parameters with a category for every order, as a partitioned table written and read back."""
    folder = new_folder(spark, "params")
    lines = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("order"), "l_returnflag", "l_tax")
    fitted = preprocess.fit_preprocessing(lines, ["l_tax"], ["order", "l_returnflag"], wide=True)
    files.write_param_table(spark, fitted, folder)
    known = files.read_param_table(spark, folder)
    return preprocess.index_of(spark, known).withColumn("median", F.lit(known.medians["l_tax"]))


def standardize_tall(spark: SparkSession, sf: str) -> DataFrame:
    """Standardisation of the tall form by parameter lookup: (line, feature, value)."""
    lines = read_table(spark, sf, "lineitem").select(*LINE_KEY, *NUMERIC)
    params = small_side(preprocess.fit_numeric(lines, NUMERIC))
    tall = lines.unpivot(LINE_KEY, NUMERIC, "feature", "value").join(params, "feature")
    scaled = (F.coalesce("value", "median") - F.col("mean")) / F.col("scale")
    return tall.select(*LINE_KEY, "feature", F.round(scaled, 4).alias("value"))


QUERIES = {
    f.__name__: f
    for f in (
        fit_numeric_params, fit_categories, encoded_feature_names, impute_median, impute_missing, standardize, standardize_tall,
        one_hot,
        one_hot_tall, fit_text_numbers, params_table, feature_vector, place_by_name, tidy_params, params_roundtrip, metadata_roundtrip,
    )
}

_LINES = f"""l AS (SELECT {', '.join(LINE_KEY)}, CASE WHEN l_quantity <= 40 THEN l_quantity END AS l_quantity, l_extendedprice,
    nullif(l_discount, 0.05) AS l_discount, l_tax, nullif(l_returnflag, 'N') AS l_returnflag, l_linestatus FROM lineitem)"""
_MEDIANS = "m AS (SELECT " + ", ".join(f"median({c}) AS {c}" for c in NUMERIC) + " FROM l)"
_FILLED = (
    f"f AS (SELECT {', '.join('l.' + k for k in LINE_KEY)}, "
    + ", ".join(f"coalesce(l.{c}, m.{c}) AS {c}" for c in NUMERIC)
    + " FROM l, m)"
)
_FIT = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round((SELECT {c} FROM m), 4) AS median, round(avg({c}), 4) AS mean, "
    f"round(CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END, 4) AS scale FROM f"
    for c in NUMERIC
)
_KEYS = ", ".join(LINE_KEY)


def _index_sql(table: str, columns: list[str]) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, coalesce({c}, 'Missing') AS category, count(*) AS \"rows\" FROM {table} GROUP BY 2"
        for c in columns
    )
    return f"SELECT *, row_number() OVER (PARTITION BY feature ORDER BY category) - 1 AS position FROM ({parts})"


SQL = {
    "fit_numeric_params": f"WITH {_LINES}, {_MEDIANS}, {_FILLED} {_FIT}",
    "fit_categories": f"WITH {_LINES} {_index_sql('l', ['l_returnflag', 'l_linestatus'])}",
    "encoded_feature_names": (
        "SELECT feature, position, feature || '_' || category AS name FROM "
        f"({_index_sql('orders', ['o_orderpriority', 'o_orderstatus'])})"
    ),
    "impute_median": f"WITH {_LINES}, {_MEDIANS}, {_FILLED} SELECT * FROM f",
    "impute_missing": (
        f"WITH {_LINES} SELECT {_KEYS}, coalesce(l_returnflag, 'Missing') AS l_returnflag, "
        "coalesce(l_linestatus, 'Missing') AS l_linestatus FROM l"
    ),
    "standardize": (
        f"WITH {_LINES}, {_MEDIANS}, {_FILLED}, s AS (SELECT "
        + ", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}" for c in NUMERIC)
        + f" FROM f) SELECT {_KEYS}, "
        + ", ".join(f"round(({c} - a_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END, 4) AS {c}" for c in NUMERIC)
        + " FROM f, s"
    ),
    "standardize_tall": " UNION ALL ".join(
        f"SELECT {_KEYS}, '{c}' AS feature, round(({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_pop({c}) FROM lineitem), 4) AS value FROM lineitem"
        for c in NUMERIC
    ),
    "one_hot": "SELECT c_custkey, "
    + ", ".join(f"CAST(c_mktsegment = '{v}' AS DOUBLE) AS \"c_mktsegment_{v}\"" for v in SEGMENTS)
    + " FROM customer",
    "one_hot_tall": f"""
        WITH k AS (SELECT * FROM orders WHERE o_orderstatus = 'F'),
        i AS ({_index_sql('k', ['o_orderstatus', 'o_orderpriority'])}),
        t AS (SELECT o_orderkey, 'o_orderstatus' AS feature, o_orderstatus AS category FROM orders
              UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority FROM orders)
        SELECT o_orderkey, t.feature, t.category, position, position IS NOT NULL AS known
        FROM t LEFT JOIN i ON i.feature = t.feature AND i.category = t.category""",
    "feature_vector": "WITH k AS (SELECT median(CASE WHEN c_acctbal > 0 THEN c_acctbal END) AS m FROM customer WHERE c_mktsegment IN "
    f"{tuple(SEGMENTS)}) SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE m END AS slot0, "
    "CAST(c_nationkey AS DOUBLE) AS slot1, "
    + ", ".join(f"CAST(c_mktsegment = '{v}' AS DOUBLE) AS slot{i + 2}" for i, v in enumerate(SEGMENTS))
    + " FROM customer, k",
    "fit_text_numbers": f"""
        WITH t AS (SELECT {_KEYS}, CASE WHEN l_linenumber > 2 THEN CAST(CAST(l_quantity AS INTEGER) AS DOUBLE) END AS x FROM lineitem),
        m AS (SELECT median(x) AS m FROM t), f AS (SELECT {_KEYS}, coalesce(x, m) AS x FROM t, m)
        SELECT {_KEYS}, x AS amount, CAST(0 AS DOUBLE) AS nothing, x AS slot0, CAST(0 AS DOUBLE) AS slot1,
               (SELECT round(avg(x), 4) FROM f) AS mean FROM f""",
    "params_table": """
        WITH c AS (SELECT DISTINCT 'order' AS feature, CAST(l_orderkey AS VARCHAR) AS category FROM lineitem
                   UNION ALL SELECT DISTINCT 'l_returnflag', l_returnflag FROM lineitem)
        SELECT feature, row_number() OVER (PARTITION BY feature ORDER BY category) - 1 AS position, category,
               (SELECT median(l_tax) FROM lineitem) AS median FROM c""",
    "place_by_name": (
        "SELECT s_suppkey, CAST(s_nationkey AS DOUBLE) AS slot0, CAST(0 AS DOUBLE) AS slot1, s_acctbal AS slot2 FROM supplier"
    ),
    "tidy_params": f"""
        WITH {_LINES}, {_MEDIANS}, {_FILLED}, fit AS ({_FIT})
        SELECT feature, CASE feature WHEN 'l_quantity' THEN 0 ELSE 1 END AS pos, 'numeric' AS kind, median, mean, scale,
               '' AS categories FROM fit WHERE feature IN ('l_quantity', 'l_tax')
        UNION ALL
        SELECT 'l_returnflag', 2, 'categorical', NULL, NULL, NULL,
               (SELECT string_agg(DISTINCT coalesce(l_returnflag, 'Missing'), ',' ORDER BY coalesce(l_returnflag, 'Missing')) FROM l)""",
    "params_roundtrip": f"""
        WITH {_LINES}, {_MEDIANS}, {_FILLED}, fit AS ({_FIT})
        SELECT 'numerical_medians' AS kind, feature, median AS number, '' AS categories FROM fit
        UNION ALL SELECT 'numerical_means', feature, mean, '' FROM fit
        UNION ALL SELECT 'numerical_scales', feature, scale, '' FROM fit
        UNION ALL SELECT 'categorical_categories', 'l_returnflag', NULL,
            (SELECT string_agg(DISTINCT coalesce(l_returnflag, 'Missing'), ',' ORDER BY coalesce(l_returnflag, 'Missing')) FROM l)
        UNION ALL SELECT 'categorical_categories', 'l_linestatus', NULL,
            (SELECT string_agg(DISTINCT coalesce(l_linestatus, 'Missing'), ',' ORDER BY coalesce(l_linestatus, 'Missing')) FROM l)""",
    "metadata_roundtrip": f"""
        WITH {_LINES}, n AS (SELECT 'l_returnflag_' || category AS name, 1 AS part FROM (SELECT DISTINCT coalesce(l_returnflag, 'Missing') AS category FROM l)
            UNION ALL SELECT 'l_linestatus_' || category, 2 FROM (SELECT DISTINCT coalesce(l_linestatus, 'Missing') AS category FROM l))
        SELECT '{",".join(NUMERIC)},' || string_agg(name, ',' ORDER BY part, name) AS feature_names, 'l_linestatus' AS target,
               'RandomForestClassifier' AS model_type, CAST({len(NUMERIC)} + count(*) AS INTEGER) AS width FROM n""",
}
