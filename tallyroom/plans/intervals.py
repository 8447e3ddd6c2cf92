"""Queries over intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroom.functions.numbers import decimal_year
from tallyroom.operators import intervals as iv
from tallyroom.plans.registry import day, days_sql, month, month_sql, query, r6
from tallyroom.sources.tables import read


def _shipping(spark, d, unit) -> DataFrame:
    """(l_suppkey, s, e): from order to shipment, in a unit of time."""
    li, o = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate"), read(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_suppkey", unit("o_orderdate").alias("s"), unit("l_shipdate").alias("e"))


def _islands(s: str, e: str, adjacent: str, length: str) -> str:
    return f"""
WITH x AS (SELECT l_suppkey, {s} AS s, {e} AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey), y AS (SELECT * FROM x WHERE s <= e),
m AS (SELECT *, max(e) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM y),
i AS (SELECT *, sum(CASE WHEN upto IS NULL OR s > upto + {adjacent} THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m),
g AS (SELECT l_suppkey, island, min(s) AS s, max(e) AS e FROM i GROUP BY 1, 2)
SELECT l_suppkey, {length}, count(*) AS n_islands FROM g GROUP BY 1
"""


def _unit_sql(c: str) -> str:
    return f"year({c}) + (month({c}) - 0.5::DOUBLE) / 12"


@query(_islands(days_sql("o_orderdate"), days_sql("l_shipdate"), "0", "CAST(sum(e - s) AS BIGINT) AS length"))
def interval_union_days(spark, d) -> DataFrame:
    rows = iv.compact(_shipping(spark, d, day).where("s <= e"), ["l_suppkey"], "s", "e", 64)
    return iv.union_length(rows, ["l_suppkey"], "s", "e")


@query(_islands(month_sql("o_orderdate"), month_sql("l_shipdate"), "1", "CAST(sum(e - s + 1) AS BIGINT) AS length"))
def interval_union_months(spark, d) -> DataFrame:
    rows = iv.compact(_shipping(spark, d, month).where("s <= e"), ["l_suppkey"], "s", "e", 12)
    return iv.union_length(rows, ["l_suppkey"], "s", "e", inclusive=True, adjacent=1)


@query(_islands(_unit_sql("o_orderdate"), _unit_sql("l_shipdate"), "0", "round(sum(e - s), 6) AS length"))
def interval_union_years(spark, d) -> DataFrame:
    rows = iv.compact(_shipping(spark, d, lambda c: decimal_year(F.col(c))).where("s <= e"), ["l_suppkey"], "s", "e", 1)
    return r6(iv.union_length(rows, ["l_suppkey"], "s", "e"))


@query(f"""
WITH m AS (SELECT o_custkey, o_orderkey, {month_sql("o_orderdate")} AS s FROM orders),
p AS (SELECT *, lag(s) OVER w AS e, lag(o_orderkey) OVER w AS k FROM m WINDOW w AS (PARTITION BY o_custkey ORDER BY s, o_orderkey)),
f AS (SELECT o_custkey, s, min(o_orderkey) AS first FROM m GROUP BY 1, 2)
SELECT p.o_custkey, f.first AS after, p.o_orderkey AS before, greatest(0, p.s - p.e - 1) AS gap FROM p JOIN f ON f.o_custkey = p.o_custkey AND f.s = p.e WHERE greatest(0, p.s - p.e - 1) >= 6
""")
def activity_gaps(spark, d) -> DataFrame:
    """Six months or more without an order."""
    rows = read(spark, d, "orders").select("o_custkey", "o_orderkey", month("o_orderdate").alias("s")).withColumn("e", F.col("s"))
    return iv.gaps(rows, ["o_custkey"], "s", "e", "o_orderkey", 6)


@query(f"""
WITH x AS (SELECT l_orderkey, l_linenumber * 100000000 + l_partkey AS id, {days_sql("l_shipdate")} AS s, {days_sql("l_shipdate")} + CAST(l_quantity AS BIGINT) AS e FROM lineitem)
SELECT a.l_orderkey, a.id AS a, b.id AS b, least(a.e, b.e) - greatest(a.s, b.s) AS shared FROM x a JOIN x b ON a.l_orderkey = b.l_orderkey AND a.id < b.id AND a.s <= b.e AND b.s <= a.e
""")
def interval_overlaps(spark, d) -> DataFrame:
    return iv.overlaps(_lines(spark, d), ["l_orderkey"], "s", "e", "id")


def _lines(spark, d) -> DataFrame:
    start = day("l_shipdate")
    return read(spark, d, "lineitem").select("l_orderkey", "l_suppkey", (F.col("l_linenumber").cast("long") * 100000000 + F.col("l_partkey")).alias("id"), start.alias("s"), (start + F.col("l_quantity").cast("long")).alias("e"))


@query(f"""
WITH x AS (SELECT l_suppkey, {days_sql("l_shipdate")} AS s, {days_sql("l_shipdate")} + CAST(l_quantity AS BIGINT) AS e FROM lineitem),
p AS (SELECT l_suppkey, pt, o, sum(c) AS c FROM (SELECT l_suppkey, s AS pt, 0 AS o, 1 AS c FROM x UNION ALL SELECT l_suppkey, e, 1, -1 FROM x) GROUP BY 1, 2, 3)
SELECT l_suppkey, CAST(max(n) AS BIGINT) AS depth FROM (SELECT l_suppkey, sum(c) OVER (PARTITION BY l_suppkey ORDER BY pt, o) AS n FROM p) GROUP BY 1
""")
def deepest_overlap(spark, d) -> DataFrame:
    return iv.deepest_overlap(_lines(spark, d), ["l_suppkey"], "s", "e")


@query(f"""
WITH x AS (SELECT o_custkey, o_orderkey, {days_sql("o_orderdate")} AS e, {days_sql("o_orderdate")} + 20 AS l FROM orders), t AS (SELECT o_custkey, arg_max(o_orderkey, (e, o_orderkey)) AS i, max(e) AS te FROM x GROUP BY 1)
SELECT t.o_custkey, CASE WHEN NOT EXISTS (SELECT 1 FROM x WHERE x.o_custkey = t.o_custkey AND x.o_orderkey <> t.i AND x.l >= t.te) THEN i END AS latest_id FROM t
""")
def latest_unique(spark, d) -> DataFrame:
    """The order that surely is a customer's last, if dates are known to 20 days."""
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", day("o_orderdate").alias("e")).withColumn("l", F.col("e") + 20)
    return iv.latest_unique(o, ["o_custkey"], "e", "l", "o_orderkey")


@query("""
SELECT a.event_id, a.user_id, (SELECT max(b.event_id) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'view' AND b.ts = (SELECT max(c.ts) FROM events c WHERE c.user_id = a.user_id AND c.event_type = 'view' AND c.ts <= a.ts)) AS view_id
FROM events a WHERE a.event_type = 'purchase'
""")
def as_of_view(spark, d) -> DataFrame:
    """The last view of a user at or before each purchase."""
    e = read(spark, d, "events")
    bought = e.where("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").alias("t"))
    seen = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("t"), F.col("event_id").alias("view_id"))
    return iv.as_of(bought, seen, ["user_id"], "t", "t", ["view_id"]).select("event_id", "user_id", "view_id")
