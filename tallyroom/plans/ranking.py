"""Queries over ordered choices and distances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroom.functions.numbers import haversine_km
from tallyroom.operators import ranking as rk
from tallyroom.plans.registry import day, days_sql, query, r6
from tallyroom.sources.tables import read


@query("""
WITH r AS (SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders),
c AS (SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM r WHERE n <= 3)
SELECT o_orderkey, o_custkey, CAST(rank AS INTEGER) AS rank FROM c WHERE rank <= 10
""")
def question_topk(spark, d) -> DataFrame:
    """The ten dearest orders, three a customer at most."""
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return rk.capped_selection(o, "o_custkey", [F.desc("o_totalprice"), F.asc("o_orderkey")], 3, 10).select("o_orderkey", "o_custkey", "rank")


@query("""
WITH x AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part),
y AS (SELECT *, i // CAST(ceil(n / 4) AS BIGINT) AS b, i % CAST(ceil(n / 4) AS BIGINT) AS r FROM x), z AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY r, b) AS pick FROM y)
SELECT p_partkey, p_brand, CAST(pick AS INTEGER) AS pick FROM z WHERE pick <= 10
""")
def round_robin_sample(spark, d) -> DataFrame:
    """Ten parts a brand, from four price classes in turn."""
    return rk.round_robin(read(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice"), ["p_brand"], ["p_retailprice", "p_partkey"], 4, 10).select("p_partkey", "p_brand", "pick")


@query("SELECT lower(p_name) AS key, arg_min(p_partkey, (-p_retailprice, p_partkey)) AS p_partkey, max(p_retailprice) AS p_retailprice FROM part GROUP BY 1")
def dedupe_best(spark, d) -> DataFrame:
    p = read(spark, d, "part")
    return rk.best_by_key(p, F.lower("p_name"), F.struct((-F.col("p_retailprice")).alias("a"), F.col("p_partkey").alias("b")), ["p_partkey", "p_retailprice"])


@query("""
WITH u AS (SELECT lower(p_name) AS k, p_partkey AS id, p_name AS name, 0 AS side FROM part WHERE p_size < 25 UNION ALL SELECT lower(p_name), p_partkey, p_name, 1 FROM part WHERE p_size >= 25)
SELECT id, name FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY side, id) AS r FROM u) WHERE r = 1 AND k <> ''
""")
def first_wins_merge(spark, d) -> DataFrame:
    p = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), "p_size")
    return rk.first_wins(p.where("p_size < 25").drop("p_size"), p.where("p_size >= 25").drop("p_size"), F.lower("name"), "id")


@query("""
WITH x AS (SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_returnflag <> 'A', l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS spent FROM lineitem)
SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, spent FROM x WHERE spent <= 60
""")
def budgeted_lines(spark, d) -> DataFrame:
    """Lines of each order up to a quantity of 60, accepted ones first."""
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_returnflag")
    order = [F.col("l_returnflag") != "A", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return rk.within_budget(rows, ["l_orderkey"], order, "l_quantity", 60.0).select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "spent")


@query(f"""
WITH o AS (SELECT o_custkey, count(*) AS n, max({days_sql("o_orderdate")}) AS last, sum((o_orderstatus = 'P')::INT) AS pending FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN pending > 3 THEN 'CALL' WHEN 11535 - last <= 14 THEN 'FOLLOW_UP' WHEN n IS NULL THEN 'FIRST_ORDER' WHEN c_acctbal < 0 THEN 'BALANCE' WHEN 11535 - last > 365 THEN 'WIN_BACK' ELSE 'NONE' END AS action FROM customer LEFT JOIN o ON c_custkey = o_custkey
""")
def next_action(spark, d) -> DataFrame:
    o = read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max(day("o_orderdate")).alias("last"), F.count_if(F.col("o_orderstatus") == "P").alias("pending"))
    c = read(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    idle = 11535 - F.col("last")
    rules = [("CALL", F.col("pending") > 3), ("FOLLOW_UP", idle <= 14), ("FIRST_ORDER", F.col("n").isNull()), ("BALANCE", F.col("c_acctbal") < 0), ("WIN_BACK", idle > 365)]
    return rk.first_rule(c, rules, "NONE").select("c_custkey", "action")


@query("""
WITH x AS (SELECT o_custkey, o_orderpriority = '1-URGENT' AS has, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) - 1 AS i FROM orders), m AS (SELECT o_custkey, min(CASE WHEN has THEN i END) AS i FROM x GROUP BY 1)
SELECT o_custkey, CAST(CASE WHEN i = 0 THEN 100 WHEN i <= 2 THEN 70 WHEN i IS NOT NULL THEN 40 END AS INTEGER) AS recency FROM m
""")
def evidence_recency(spark, d) -> DataFrame:
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority")
    return rk.recency_rank(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], F.col("o_orderpriority") == "1-URGENT")


@query("""
SELECT l_partkey, arg_max(l_suppkey, (l_quantity, l_extendedprice, l_suppkey)) AS l_suppkey, max(l_discount) AS l_discount, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS flags FROM lineitem GROUP BY 1
""")
def strongest_merge(spark, d) -> DataFrame:
    rows = read(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", F.array("l_returnflag").alias("flags"))
    out = rk.strongest(rows, ["l_partkey"], F.struct("l_quantity", "l_extendedprice", "l_suppkey"), "l_discount", "flags", ["l_suppkey"])
    return out.withColumn("flags", F.array_join("flags", ","))


@query("""
WITH e AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN turn END AS h FROM conversations)
SELECT conv_id, turn, max(h) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS asked_at FROM e
""")
def carried_header(spark, d) -> DataFrame:
    """The turn of the last question at or before each turn."""
    rows = read(spark, d, "conversations").select("conv_id", "turn", "role")
    return rk.carry_forward(rows, ["conv_id"], "turn", F.when(F.col("role") == "user", F.col("turn")), "asked_at").drop("role")


@query("""
WITH n AS (SELECT n_nationkey AS k, 40.0::DOUBLE + n_nationkey * 0.7 AS lat, -10.0::DOUBLE + n_nationkey * 1.9 AS lon FROM nation),
p AS (SELECT a.k AS a, b.k AS b, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2) AS h FROM n a JOIN n b ON a.k <> b.k)
SELECT a, b, round(floor(2 * 6371.0088 * asin(sqrt(least(1, h))) * 10 + 0.5) / 10, 6) AS km FROM p
""")
def haversine_matrix(spark, d) -> DataFrame:
    """Distances between the 25 nations, a table of fixed size."""
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("k"), (40.0 + F.col("n_nationkey") * 0.7).alias("lat"), (-10.0 + F.col("n_nationkey") * 1.9).alias("lon"))
    a, b = n.select(F.col("k").alias("a"), F.col("lat").alias("y1"), F.col("lon").alias("x1")), n.select(F.col("k").alias("b"), F.col("lat").alias("y2"), F.col("lon").alias("x2"))
    return r6(a.join(b, F.col("a") != F.col("b")).select("a", "b", haversine_km(F.col("y1"), F.col("x1"), F.col("y2"), F.col("x2")).alias("km")))
