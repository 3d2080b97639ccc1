"""Column profiles, feature typing and class statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylight.operators import profile, sampling
from quarrylight.session import materialize, new_folder
from quarrylight.sources.tables import read_table


def _profile_sql(table: str, columns: dict[str, str]) -> str:
    """One SELECT per column, as one would write it by hand."""
    parts = []
    for name, value in columns.items():
        parts.append(
            f"SELECT '{name}' AS \"column\", count(*) AS \"rows\", count(DISTINCT {value}) AS \"distinct\", "
            f"round(avg(CASE WHEN {value} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_share FROM {table}"
        )
    union = " UNION ALL ".join(parts)
    return (
        "SELECT *, CASE WHEN \"distinct\" > 0.5 * \"rows\" THEN 'distinct' WHEN null_share > 0.3 THEN 'nulls' "
        # Fixed values: the limits and the denied names of the drop rules.
        "WHEN lower(\"column\") IN ('timestamp','date','time','src_ip','dst_ip','attack') THEN 'name' END AS drop_reason "
        f"FROM ({union})"
    )


LINEITEM = (
    "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
    "l_returnflag l_linestatus l_shipdate"
).split()


def profile_columns(spark: SparkSession, sf: str) -> DataFrame:
    out = profile.profile_columns(read_table(spark, sf, "lineitem"))
    return out.withColumn("null_share", F.round("null_share", 6))


def _request_log(spark: SparkSession, sf: str) -> DataFrame:
    events = read_table(spark, sf, "events")
    busy = F.col("event_type").isin("view", "click")
    return events.select(
        F.col("event_id"),
        F.col("ts").alias("Timestamp"),
        F.col("user_id"),
        F.col("event_type").alias("Attack"),
        F.when(~busy, F.col("value")).alias("amount"),
        F.when(F.col("event_type") != "view", F.col("user_id")).alias("peer"),
        F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("user_id") * 0.5).alias("ratio"),
    )


LOG_SQL = (
    "(SELECT event_id, ts AS \"Timestamp\", user_id, event_type AS \"Attack\", "
    "CASE WHEN event_type NOT IN ('view','click') THEN value END AS amount, "
    "CASE WHEN event_type <> 'view' THEN user_id END AS peer, "
    "CASE WHEN event_type <> 'error' THEN user_id * 0.5 END AS ratio FROM events)"
)


def profile_with_nulls(spark: SparkSession, sf: str) -> DataFrame:
    out = profile.profile_columns(_request_log(spark, sf))
    return out.withColumn("null_share", F.round("null_share", 6))


def drop_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """The verdicts of the pass that counts distinct values only where they decide."""
    reasons = profile.drop_reasons(_request_log(spark, sf))
    return spark.createDataFrame(list(reasons.items()), "column string, drop_reason string")


def merged_sketches(spark: SparkSession, sf: str) -> DataFrame:
    """Sketches stored for three batches and merged: counts, the verdict, and whether the estimate is within six standard errors."""
    log, folder = _request_log(spark, sf), new_folder(spark, "sketches")
    for batch in range(3):
        profile.column_sketches(log.where(F.col("event_id") % 3 == batch)).write.mode("append").parquet(folder)
    merged = materialize(profile.merge_sketches(spark.read.parquet(folder)))
    reasons = profile.sketched_reasons(merged, log)
    verdicts = spark.createDataFrame(list(reasons.items()), "column string, drop_reason string")
    exact = profile.distinct_together(log, log.columns)
    off = F.abs(F.col("distinct") - F.col("counted"))
    joined = profile.sketched_counts(merged).join(exact.withColumnRenamed("distinct", "counted"), "column", "left").join(verdicts, "column")
    return joined.fillna(0, ["counted"]).select(
        "column", "rows", F.round(F.col("nulls") / F.col("rows"), 6).alias("null_share"), "drop_reason",
        F.col("counted").alias("distinct"), (off <= F.ceil(F.col("counted") * profile.MARGIN)).alias("within"),
    )


def table_shape(spark: SparkSession, sf: str) -> DataFrame:
    return profile.table_shape(read_table(spark, sf, "lineitem"))


def target_and_features(spark: SparkSession, sf: str) -> DataFrame:
    """Target by name with fallback, features in order, target apart."""
    table = read_table(spark, sf, "customer").select(
        F.col("c_custkey"), F.col("c_acctbal"), F.col("c_mktsegment"), F.col("c_nationkey").alias("class")
    )
    target = profile.resolve_target(table)
    ordered = ["c_mktsegment", "c_acctbal", "c_custkey"]
    return table.withColumn("y", F.col(target)).drop(target).select(*ordered, "y")


def feature_types(spark: SparkSession, sf: str) -> DataFrame:
    """Text columns are numeric if their first 100 rows by event_id parse as numbers."""
    events = read_table(spark, sf, "events")
    texts = events.select("event_id", *[F.col(c).cast("string").alias(c) for c in ("user_id", "event_type", "value", "props")])
    return profile.column_kinds(texts, texts.columns, ["event_id"])


_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _type_sql(column: str) -> str:
    return (
        f"SELECT '{column}' AS \"column\", CASE WHEN bool_and(regexp_matches(trim(CAST({column} AS VARCHAR)), '{_NUMBER}')) "
        f"THEN 'numeric' ELSE 'categorical' END AS kind FROM (SELECT * FROM events ORDER BY event_id LIMIT 100)"
    )


def whole_column_types(spark: SparkSession, sf: str) -> DataFrame:
    """The same typing over whole columns."""
    orders = read_table(spark, sf, "orders")
    texts = orders.select(
        "o_orderkey",
        F.col("o_custkey").cast("string").alias("o_custkey"),
        F.regexp_extract("o_orderpriority", r"^(\d)", 1).alias("level"),
        "o_orderpriority",
        "o_orderstatus",
    )
    return profile.column_kinds(texts, texts.columns, ["o_orderkey"], probe_rows=None)


def select_features(spark: SparkSession, sf: str) -> DataFrame:
    """Usable features of the orders as text, typed by whole columns.

    `late` is a number but for the dearest orders, `blank` is empty text now and then, `gaps` is
    mostly missing, `date` is denied by name and the key has too many different values.
    """
    orders = read_table(spark, sf, "orders")
    digit = F.regexp_extract("o_orderpriority", r"^(\d)", 1)
    table = orders.select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        digit.alias("level"),
        F.when(F.col("o_totalprice") == F.max("o_totalprice").over(W.partitionBy("o_orderstatus")), "x").otherwise(digit).alias("late"),
        F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(digit).alias("blank"),
        F.when(F.col("o_orderkey") % 2 == 0, digit).alias("gaps"),
        digit.alias("date"),
        "o_orderpriority",
        F.col("o_orderstatus").alias("Label"),
    )
    target, numeric, categorical = profile.select_features(table)
    chosen = [(c, "numeric") for c in numeric] + [(c, "categorical") for c in categorical] + [(target, "target")]
    return spark.createDataFrame(chosen, "column string, kind string")


def class_counts(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.class_counts(read_table(spark, sf, "lineitem"), "l_returnflag")


def class_shares(spark: SparkSession, sf: str) -> DataFrame:
    out = sampling.class_shares(read_table(spark, sf, "lineitem"), "l_returnflag")
    return out.withColumn("share", F.round("share", 9))


def class_extremes(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.class_extremes(read_table(spark, sf, "lineitem"), "l_returnflag")


QUERIES = {
    f.__name__: f
    for f in (
        profile_columns, profile_with_nulls, drop_reasons, merged_sketches, table_shape, target_and_features, feature_types,
        whole_column_types, select_features, class_counts, class_shares, class_extremes,
    )
}

_LOG_COLUMNS = {
    c: (f'"{c}"' if c in ("Timestamp", "Attack") else c)
    for c in ("event_id", "Timestamp", "user_id", "Attack", "amount", "peer", "ratio")
}

_ORDERS = """(SELECT o_orderkey, regexp_extract(o_orderpriority, '^(\\d)', 1) AS level,
    CASE WHEN o_totalprice = max(o_totalprice) OVER (PARTITION BY o_orderstatus) THEN 'x' ELSE level END AS late,
    CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE level END AS blank, CASE WHEN o_orderkey % 2 = 0 THEN level END AS gaps,
    o_orderpriority FROM orders)"""


def _select_sql(column: str) -> str:
    """Empty text parses as a missing number, so it leaves a column numeric."""
    return (
        f"SELECT '{column}' AS \"column\", CASE WHEN bool_and(regexp_matches(nullif(trim(CAST({column} AS VARCHAR)), ''), '{_NUMBER}')) "
        f"THEN 'numeric' ELSE 'categorical' END AS kind FROM {_ORDERS} "
        f"HAVING count(DISTINCT {column}) <= 0.5 * count(*) AND count(*) - count({column}) <= 0.3 * count(*)"
    )


SQL = {
    "select_features": " UNION ALL ".join(
        [_select_sql(c) for c in ("o_orderkey", "level", "late", "blank", "gaps", "o_orderpriority")]
        + ["SELECT 'Label', 'target'"]
    ),
    "profile_columns": _profile_sql("lineitem", {c: c for c in LINEITEM}),
    "profile_with_nulls": _profile_sql(LOG_SQL, _LOG_COLUMNS),
    "drop_reasons": f'SELECT "column", drop_reason FROM ({_profile_sql(LOG_SQL, _LOG_COLUMNS)})',
    "merged_sketches": f'SELECT "column", "rows", null_share, drop_reason, "distinct", true AS within FROM ({_profile_sql(LOG_SQL, _LOG_COLUMNS)})',
    "table_shape": (
        f"SELECT count(*) AS \"rows\", {len(LINEITEM)} AS columns, '{','.join(LINEITEM)}' AS names FROM lineitem"
    ),
    "target_and_features": "SELECT c_custkey, c_mktsegment, c_acctbal, c_nationkey AS y FROM customer",
    "feature_types": " UNION ALL ".join(
        _type_sql(c) for c in ("event_id", "user_id", "event_type", "value", "props")
    ),
    "whole_column_types": (
        "SELECT unnest(['o_orderkey','o_custkey','level','o_orderpriority','o_orderstatus']) AS \"column\", "
        "unnest(['numeric','numeric',"
        f"CASE WHEN bool_and(regexp_matches(regexp_extract(o_orderpriority, '^(\\d)', 1), '{_NUMBER}')) THEN 'numeric' ELSE 'categorical' END,"
        f"CASE WHEN bool_and(regexp_matches(o_orderpriority, '{_NUMBER}')) THEN 'numeric' ELSE 'categorical' END,"
        f"CASE WHEN bool_and(regexp_matches(o_orderstatus, '{_NUMBER}')) THEN 'numeric' ELSE 'categorical' END]) AS kind "
        "FROM orders"
    ),
    "class_counts": 'SELECT l_returnflag, count(*) AS "rows" FROM lineitem GROUP BY l_returnflag',
    "class_shares": (
        'SELECT l_returnflag, count(*) AS "rows", round(count(*) / sum(count(*)) OVER (), 9) AS share '
        "FROM lineitem GROUP BY l_returnflag"
    ),
    "class_extremes": """
        WITH c AS (SELECT l_returnflag AS k, count(*) AS n FROM lineitem GROUP BY 1)
        SELECT count(*) AS classes, CAST(sum(n) AS BIGINT) AS total,
               (SELECT k FROM c ORDER BY n, k LIMIT 1) AS minority_class, min(n) AS minority_rows,
               (SELECT k FROM c ORDER BY n DESC, k LIMIT 1) AS majority_class, max(n) AS majority_rows
        FROM c""",
}
