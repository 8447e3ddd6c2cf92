"""Queries over requirement matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroom.operators import matching as mt
from tallyroom.plans.registry import month, month_sql, query, r6
from tallyroom.sources.tables import read

#: Requirements on kinds of parts: concept, priority, weight.
WANTED = [("ECONOMY|1", "CORE_MUST", 3.0), ("STANDARD", "MUST", 2.0), ("PROMO|2", "MUST", 1.0), ("LARGE", "NICE", 1.0), ("SMALL|4", "NICE", 2.0)]


def _concepts(spark, d):
    """Kinds by size class, under their kind, under all."""
    kinds = read(spark, d, "part").select("p_type", F.concat_ws("|", "p_type", F.floor(F.col("p_size") / 10).cast("int").cast("string")).alias("id")).distinct()
    parents = kinds.select("id", F.col("p_type").alias("parent")).union(kinds.select("p_type", F.lit("ANY"))).distinct()
    nodes = parents.select(F.explode(F.array("id", "parent")).alias("id")).distinct()
    return nodes, mt.ancestors(parents)


@query("""
WITH RECURSIVE k AS (SELECT DISTINCT p_type, p_type || '|' || CAST(CAST(floor(p_size / 10) AS INTEGER) AS VARCHAR) AS id FROM part), p AS (SELECT id, p_type AS parent FROM k UNION SELECT p_type, 'ANY' FROM k),
a(id, ancestor, d) AS (SELECT id, parent, 1 FROM p UNION ALL SELECT a.id, p.parent, d + 1 FROM a JOIN p ON p.id = a.ancestor)
SELECT id, ancestor, min(d) AS d FROM a GROUP BY 1, 2
""")
def ontology_closure(spark, d) -> DataFrame:
    return _concepts(spark, d)[1]


def _matches(spark, d) -> DataFrame:
    nodes, closure = _concepts(spark, d)
    part = read(spark, d, "part").select("p_partkey", F.concat_ws("|", "p_type", F.floor(F.col("p_size") / 10).cast("int").cast("string")).alias("concept"))
    li = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount")
    evidence = li.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_suppkey", "concept", (F.col("l_quantity") / 50).alias("depth"), (1 - F.col("l_discount") * 8).alias("confidence"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("evidence_id")
    )
    wanted = F.array(*[F.struct(F.lit(c).alias("requirement"), F.lit(p).alias("priority"), F.lit(w).alias("weight")) for c, p, w in WANTED])
    suppliers = read(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_acctbal") / 10000).alias("complete"))
    requirements = suppliers.select("l_suppkey", "complete", F.explode(wanted).alias("w")).select("l_suppkey", "complete", "w.*")
    return mt.best_matches(requirements, evidence, mt.relation_strengths(nodes, closure), "l_suppkey", F.col("complete"))


MATCHES = """
k AS (SELECT p_partkey, p_type, p_type || '|' || CAST(CAST(floor(p_size / 10) AS INTEGER) AS VARCHAR) AS c FROM part),
n AS (SELECT DISTINCT c AS x FROM k UNION SELECT p_type FROM k UNION SELECT 'ANY'),
up AS (SELECT DISTINCT c AS x, p_type AS a FROM k UNION SELECT c, 'ANY' FROM k UNION SELECT p_type, 'ANY' FROM k),
rel AS (SELECT r, c, max(s) AS s FROM (SELECT x AS r, x AS c, 1.0::DOUBLE AS s FROM n UNION ALL SELECT a, x, 0.95::DOUBLE FROM up UNION ALL SELECT x, a, 0.25::DOUBLE FROM up) GROUP BY 1, 2),
e AS (SELECT l_suppkey, k.c, l_quantity / 50 AS depth, l_orderkey * 10 + l_linenumber AS evidence_id FROM lineitem JOIN k ON l_partkey = p_partkey WHERE 1 - l_discount * 8 >= 0.4),
w(requirement, priority, weight) AS (VALUES ('ECONOMY|1', 'CORE_MUST', 3.0::DOUBLE), ('STANDARD', 'MUST', 2.0::DOUBLE), ('PROMO|2', 'MUST', 1.0::DOUBLE), ('LARGE', 'NICE', 1.0::DOUBLE), ('SMALL|4', 'NICE', 2.0::DOUBLE)),
h AS (SELECT l_suppkey, rel.r AS requirement, rel.s * depth AS f, evidence_id, row_number() OVER (PARTITION BY l_suppkey, rel.r ORDER BY rel.s * depth DESC, evidence_id) AS rn FROM e JOIN rel ON rel.c = e.c),
m AS (SELECT s_suppkey AS l_suppkey, s_acctbal / 10000 AS complete, w.requirement, priority, weight, coalesce(f, 0) AS fulfilment,
  CASE WHEN coalesce(f, 0) >= 0.999 THEN 'CONFIRMED' WHEN coalesce(f, 0) > 0 THEN 'PARTIAL' WHEN s_acctbal / 10000 >= 0.75 THEN 'NOT_FOUND' ELSE 'UNKNOWN' END AS status, evidence_id AS best
  FROM supplier CROSS JOIN w LEFT JOIN (SELECT * FROM h WHERE rn = 1) h ON h.l_suppkey = s_suppkey AND h.requirement = w.requirement)
"""


@query(f"WITH {MATCHES} SELECT l_suppkey, requirement, priority, round(fulfilment, 6) AS fulfilment, status, best FROM m")
def requirement_match(spark, d) -> DataFrame:
    return r6(_matches(spark, d).select("l_suppkey", "requirement", "priority", "fulfilment", "status", "best"))


def _scenario(name: str, unknown: str) -> str:
    v = f"CASE WHEN status = 'UNKNOWN' THEN {unknown}::DOUBLE ELSE least(1, fulfilment) END"
    must, nice = "FILTER (priority <> 'NICE')", "FILTER (priority = 'NICE')"
    mean = lambda x, f: f"sum(weight * {x}) {f} / sum(weight) {f}"
    curve = "CASE WHEN b <= 0.25 THEN b / 0.25 * 0.08 WHEN b <= 0.4 THEN 0.08 + (b - 0.25) / 0.15 * 0.2 WHEN b <= 0.55 THEN 0.28 + (b - 0.4) / 0.15 * 0.32 WHEN b <= 0.7 THEN 0.6 + (b - 0.55) / 0.15 * 0.17 WHEN b <= 0.8 THEN 0.77 + (b - 0.7) / 0.1 * 0.13 WHEN b <= 0.9 THEN 0.9 + (b - 0.8) / 0.1 * 0.06 ELSE 0.96 + (least(b, 1) - 0.9) / 0.1 * 0.04 END"
    return f"""{name} AS (SELECT l_suppkey, 100 * (0.8::DOUBLE * ({curve}) + 0.2::DOUBLE * t * t * (3 - 2 * t) * pow(nice, 2.4)) AS score FROM (SELECT *, least(1, greatest(0, (b - 0.45) / 0.4)) AS t FROM (
  SELECT l_suppkey, least(1, 0.55::DOUBLE * {mean(v, must)} + 0.45::DOUBLE * (exp({mean(f"ln(0.05 + 0.95 * ({v}))", must)}) - 0.05) / 0.95) AS b, {mean(v, nice)} AS nice FROM m GROUP BY 1)))"""


@query(f"""
WITH {MATCHES}, {_scenario("lo", "0")}, {_scenario("mi", "0.5")}, {_scenario("hi", "1")},
f AS (SELECT l_suppkey, min(CASE WHEN priority = 'CORE_MUST' AND status <> 'UNKNOWN' AND fulfilment < 0.2 THEN 35 END) AS cap, coalesce(sum(weight) FILTER (priority <> 'NICE' AND status = 'UNKNOWN') / sum(weight) FILTER (priority <> 'NICE'), 0) AS share,
  sum((status IN ('CONFIRMED', 'PARTIAL'))::INT)::BIGINT AS n_matched FROM m GROUP BY 1),
x AS (SELECT l_suppkey, least(lo.score, coalesce(cap, 100)) AS low, least(mi.score, coalesce(cap, 100)) AS mid, least(hi.score, coalesce(cap, 100)) AS high, share, n_matched FROM f JOIN lo USING (l_suppkey) JOIN mi USING (l_suppkey) JOIN hi USING (l_suppkey))
SELECT l_suppkey, round(low, 6) AS low, round(mid, 6) AS mid, round(high, 6) AS high, round(greatest(0, high - low), 6) AS width, round(share, 6) AS unknown_share, n_matched, high - low > 30 OR share > 0.3 AS suppressed,
  round(CASE WHEN NOT (high - low > 30 OR share > 0.3) THEN mid END, 6) AS score FROM x
""")
def alignment_interval(spark, d) -> DataFrame:
    return r6(mt.alignment(_matches(spark, d), "l_suppkey"))


@query("""
WITH m AS (SELECT l_orderkey, l_linenumber AS requirement, CASE l_linenumber % 3 WHEN 0 THEN 'CORE_MUST' WHEN 1 THEN 'MUST' ELSE 'NICE' END AS priority, CASE WHEN l_partkey % 5 = 0 THEN 'FORMAL' ELSE 'SKILL' END AS kind, l_quantity AS weight,
  CASE WHEN l_returnflag = 'A' THEN 'CONFIRMED' WHEN l_returnflag = 'R' AND l_discount < 0.03 THEN 'PARTIAL' WHEN l_discount < 0.05 THEN 'UNKNOWN' ELSE 'NOT_FOUND' END AS status FROM lineitem),
a AS (SELECT *, CASE WHEN status = 'UNKNOWN' THEN 'MEASURE' ELSE 'ADD' END AS advice FROM m WHERE status = 'UNKNOWN' OR status = 'NOT_FOUND' AND kind <> 'FORMAL'), p AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, advice ORDER BY weight DESC, requirement) AS place FROM a)
SELECT l_orderkey, CAST(place AS INTEGER) AS place, requirement, CASE WHEN priority = 'CORE_MUST' THEN CASE advice WHEN 'ADD' THEN 'CRITICAL' ELSE 'HIGH' END WHEN priority = 'MUST' AND advice = 'ADD' THEN 'HIGH' ELSE 'MEDIUM' END AS urgency, advice FROM p WHERE advice = 'MEASURE' OR place <= 2
""")
def alignment_advice(spark, d) -> DataFrame:
    """What would raise orders' alignments, lines as requirements: two to add, and all to measure."""
    n = F.col("l_linenumber") % 3
    status = F.when(F.col("l_returnflag") == "A", "CONFIRMED").when((F.col("l_returnflag") == "R") & (F.col("l_discount") < 0.03), "PARTIAL").when(F.col("l_discount") < 0.05, "UNKNOWN").otherwise("NOT_FOUND")
    rows = read(spark, d, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").alias("requirement"), F.when(n == 0, "CORE_MUST").when(n == 1, "MUST").otherwise("NICE").alias("priority"), F.when(F.col("l_partkey") % 5 == 0, "FORMAL").otherwise("SKILL").alias("kind"), F.col("l_quantity").alias("weight"), status.alias("status")
    )
    return mt.recommendations(rows, "l_orderkey", [F.col("weight").desc(), F.col("requirement")], 2)


@query("""
WITH m AS (SELECT l_orderkey, CASE WHEN l_linestatus = 'O' THEN 'ANY_OF' ELSE 'ALL_OF' END AS op, l_quantity AS w, CASE WHEN l_returnflag = 'A' THEN 1.0::DOUBLE WHEN l_returnflag = 'R' THEN 0.45::DOUBLE ELSE 0 END AS f,
  CASE WHEN l_returnflag = 'A' THEN 'CONFIRMED' WHEN l_returnflag = 'R' THEN 'PARTIAL' WHEN l_discount < 0.05 THEN 'UNKNOWN' ELSE 'NOT_FOUND' END AS s FROM lineitem),
g AS (SELECT l_orderkey, op, coalesce(max(f) FILTER (s <> 'UNKNOWN'), 0) AS best, min(f) AS worst, bool_or(s = 'UNKNOWN') AS u, bool_or(s = 'NOT_FOUND') AS nf, max(w) AS top, sum(w) AS whole FROM m GROUP BY 1, 2)
SELECT l_orderkey, op AS operator, CASE WHEN op = 'ANY_OF' THEN top ELSE whole END AS weight, round(CASE WHEN op = 'ANY_OF' THEN best WHEN nf OR u THEN 0 ELSE worst END, 6) AS fulfilment,
  CASE WHEN op = 'ANY_OF' THEN CASE WHEN best >= 0.999 THEN 'CONFIRMED' WHEN best > 0 THEN 'PARTIAL' WHEN u THEN 'UNKNOWN' ELSE 'NOT_FOUND' END WHEN nf THEN 'NOT_FOUND' WHEN u THEN 'UNKNOWN' WHEN worst >= 0.999 THEN 'CONFIRMED' WHEN worst > 0 THEN 'PARTIAL' ELSE 'NOT_FOUND' END AS status FROM g
""")
def formal_any_all(spark, d) -> DataFrame:
    return r6(_units(spark, d))


def _units(spark, d) -> DataFrame:
    flag = F.col("l_returnflag")
    rows = read(spark, d, "lineitem").select(
        "l_orderkey", F.when(F.col("l_linestatus") == "O", "ANY_OF").otherwise("ALL_OF").alias("operator"), F.col("l_quantity").alias("weight"), F.when(flag == "A", 1.0).when(flag == "R", 0.45).otherwise(0.0).alias("fulfilment"),
        F.when(flag == "A", "CONFIRMED").when(flag == "R", "PARTIAL").when(F.col("l_discount") < 0.05, "UNKNOWN").otherwise("NOT_FOUND").alias("status"),
    )
    return mt.logical_units(rows, ["l_orderkey"], "operator")


@query("""
WITH m AS (SELECT l_orderkey, l_linestatus = 'O' AS anyof, l_quantity AS w, CASE WHEN l_returnflag = 'A' THEN 1.0::DOUBLE WHEN l_returnflag = 'R' THEN 0.45::DOUBLE ELSE 0 END AS f, l_returnflag = 'N' AND l_discount < 0.05 AS u, l_returnflag = 'N' AND NOT l_discount < 0.05 AS nf FROM lineitem),
g AS (SELECT l_orderkey, anyof, coalesce(max(f) FILTER (NOT u), 0) AS best, min(f) AS worst, bool_or(u) AS u, bool_or(nf) AS nf, max(w) AS top, sum(w) AS whole FROM m GROUP BY 1, 2),
x AS (SELECT l_orderkey, NOT anyof AS must, CASE WHEN anyof THEN top ELSE whole END AS w, CASE WHEN anyof THEN best WHEN nf OR u THEN 0 ELSE worst END AS f, CASE WHEN anyof THEN best = 0 AND u ELSE u AND NOT nf END AS u FROM g),
y AS (SELECT l_orderkey, sum((must AND u)::INT)::BIGINT AS n_unknown, sum(w * f) FILTER (must) / sum(w) FILTER (must) AS a, sum(w * f) FILTER (NOT must) / sum(w) FILTER (NOT must) AS b FROM x GROUP BY 1)
SELECT l_orderkey, round(CASE WHEN n_unknown = 0 THEN 100 * CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE 0.85::DOUBLE * a + 0.15::DOUBLE * b END END, 6) AS score, n_unknown FROM y
""")
def formal_score(spark, d) -> DataFrame:
    return r6(mt.formal_score(_units(spark, d).withColumn("mandatory", F.col("operator") == "ALL_OF"), "l_orderkey"))


@query(f"""
WITH o AS (SELECT o_custkey, o_orderpriority, 24018 - {month_sql("o_orderdate")} AS age, o_totalprice / 500000 AS s, CASE WHEN o_orderstatus = 'F' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM orders),
b AS (SELECT o_custkey, o_orderpriority, max(pow(0.5, age / 48.0::DOUBLE) * s) AS v, max(w) AS w FROM o WHERE age >= 0 GROUP BY 1, 2)
SELECT o_custkey, round(100 * sum(v * w) / sum(w), 6) AS recency, count(*) AS n FROM b GROUP BY 1
""")
def half_life_recency(spark, d) -> DataFrame:
    o = read(spark, d, "orders").select("o_custkey", "o_orderpriority", (24018 - month("o_orderdate")).alias("age"), (F.col("o_totalprice") / 500000).alias("s"), F.when(F.col("o_orderstatus") == "F", 2.0).otherwise(1.0).alias("w"))
    return r6(mt.recency(o, ["o_orderpriority"], "age", "s", "w", "o_custkey"))
