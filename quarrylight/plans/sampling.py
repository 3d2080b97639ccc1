"""Splits and balanced samples with exact sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrylight.operators import sampling
from quarrylight.sources.tables import read_table

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def split_random(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.random_split(read_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"])


def split_stratified(spark: SparkSession, sf: str) -> DataFrame:
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return sampling.stratified_split(orders, ["o_orderkey"], "o_orderstatus")


def balance_stratified(spark: SparkSession, sf: str) -> DataFrame:
    """At most 50 000 rows in proportion to the classes."""
    rows = read_table(spark, sf, "lineitem").select(*LINE_KEY, "l_returnflag")
    return sampling.balance(rows, LINE_KEY, "l_returnflag")


def balance_undersample(spark: SparkSession, sf: str) -> DataFrame:
    """Rare class whole, three times as many of the other; a rare class here is under 1000 rows."""
    return sampling.balance(read_table(spark, sf, "labels"), ["doc_id"], "quality", sample_rows=50, majority_ratio=3)


def balance_dropping_middle(spark: SparkSession, sf: str) -> DataFrame:
    """Three classes, of which the middle one drops out if the smallest is under a million rows."""
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return sampling.balance(
        orders, ["o_orderkey"], "o_orderstatus", sample_rows=1000, small_class_rows=1_000_000, majority_ratio=1
    )


def split_null_keys(spark: SparkSession, sf: str) -> DataFrame:
    """A key whose parts may be null: (1, null) and (null, 1) are different rows."""
    rows = read_table(spark, sf, "orders").selectExpr(
        "CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END AS even", "CASE WHEN o_orderkey % 2 = 1 THEN o_orderkey - 1 END AS odd"
    )
    return sampling.random_split(rows, ["even", "odd"])


QUERIES = {
    f.__name__: f
    for f in (split_null_keys, split_random, split_stratified, balance_stratified, balance_undersample, balance_dropping_middle)
}


def _quotas(table: str, target: str, wanted: str) -> str:
    """CTEs: c(k, n), t(total, wanted), q(k, quota) with the kept part by largest remainder."""
    return f"""
        c AS (SELECT {target} AS k, count(*) AS n FROM {table} GROUP BY 1),
        t AS (SELECT CAST(sum(n) AS BIGINT) AS total, CAST({wanted} AS BIGINT) AS wanted FROM c),
        p AS (SELECT k, n, total - wanted AS kept, (n * (total - wanted)) // total AS base,
                     (n * (total - wanted)) % total AS rest FROM c, t),
        q AS (SELECT k, n - base - CASE WHEN row_number() OVER (ORDER BY rest DESC, k)
                     <= kept - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM p)"""


def _balance_sql(table: str, columns: str, target: str, key: str, rows: int, small: int, ratio: int) -> str:
    return f"""
        WITH {_quotas(table, target, f"least(sum(n), {rows})")},
        lo AS (SELECT k, n FROM c ORDER BY n, k LIMIT 1),
        hi AS (SELECT k, n FROM c ORDER BY n DESC, k LIMIT 1),
        r AS (SELECT {columns}, row_number() OVER (PARTITION BY {target} ORDER BY md5({key} || ':42'), {key}) AS place FROM {table})
        SELECT {columns} FROM r WHERE CASE
            WHEN (SELECT total FROM t) <= {rows} THEN true
            WHEN (SELECT n FROM lo) < {small} THEN {target} = (SELECT k FROM lo)
                 OR ({target} = (SELECT k FROM hi) AND place <= {ratio} * (SELECT n FROM lo))
            ELSE place <= (SELECT quota FROM q WHERE q.k = r.{target}) END"""


def _key(*columns: str) -> str:
    """The text of a key: each part with its length, `~` for a null part."""
    part = "coalesce(length(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '~')"
    return " || ".join(part.format(c) for c in columns)


_LINE = _key(*LINE_KEY)

SQL = {
    "split_null_keys": f"""
        WITH o AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END AS even, CASE WHEN o_orderkey % 2 = 1 THEN o_orderkey - 1 END AS odd FROM orders)
        SELECT even, odd, CASE WHEN row_number() OVER (ORDER BY md5({_key("even", "odd")} || ':42'), {_key("even", "odd")})
               <= ceil(0.2 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM o""",
    "split_random": f"""
        SELECT o_orderkey, o_orderstatus, CASE WHEN row_number() OVER (ORDER BY md5({_key("o_orderkey")} || ':42'), o_orderkey)
               <= ceil(0.2 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM orders""",
    "split_stratified": f"""
        WITH {_quotas("orders", "o_orderstatus", "ceil(0.2 * sum(n))")},
        r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus
                     ORDER BY md5({_key("o_orderkey")} || ':42'), o_orderkey) AS place FROM orders)
        SELECT o_orderkey, o_orderstatus, CASE WHEN place <= quota THEN 'test' ELSE 'train' END AS split
        FROM r JOIN q ON q.k = r.o_orderstatus""",
    "balance_stratified": _balance_sql(
        "lineitem", ", ".join([*LINE_KEY, "l_returnflag"]), "l_returnflag", _LINE, 50_000, 1000, 20
    ),
    "balance_undersample": _balance_sql(
        "labels", "doc_id, quality, toxic", "quality", _key("doc_id"), 50, 1000, 3
    ),
    "balance_dropping_middle": _balance_sql(
        "orders", "o_orderkey, o_orderstatus", "o_orderstatus", _key("o_orderkey"), 1000, 1_000_000, 1
    ),
}
