"""Queries over the scoring operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyroom.functions.numbers import clamp, monthly_net
from tallyroom.operators import scoring as sc
from tallyroom.plans.registry import query, r6
from tallyroom.sources.tables import read

_P0 = "round(least(100, greatest(0, exp(sum(w * ln(v + 1)) / sum(w)) - 1)), 6)"


def _power(p: float) -> str:
    return f"round(least(100, greatest(0, pow(sum(w * pow(v + 1, {p})) / sum(w), {1 / p}) - 1)), 6)"


@query(f"""
WITH x AS (SELECT p_brand, p_retailprice - 100 * floor(p_retailprice / 100) AS v, CAST(p_size AS DOUBLE) AS w FROM part)
SELECT p_brand, {_power(-1.0)} AS mean_m1, {_power(-0.5)} AS mean_m05, {_P0} AS mean_0, {_power(0.5)} AS mean_05, {_power(1.0)} AS mean_1 FROM x GROUP BY 1
""")
def generalized_means(spark, d) -> DataFrame:
    rows = read(spark, d, "part").select("p_brand", (F.col("p_retailprice") - 100 * F.floor(F.col("p_retailprice") / 100)).alias("v"), F.col("p_size").cast("double").alias("w"))
    return r6(sc.power_means(rows, ["p_brand"], "v", "w"))


@query("""
WITH o AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS spent FROM orders GROUP BY 1),
c AS (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN least(100, c_acctbal / 100) END AS balance, CASE WHEN n IS NOT NULL THEN least(100.0, n * 5.0) END AS activity, CASE WHEN n >= 3 THEN least(100, spent / 50000) END AS spend
  FROM customer LEFT JOIN o ON c_custkey = o_custkey)
SELECT c_custkey, round(balance, 6) AS balance, round(CAST(activity AS DOUBLE), 6) AS activity, round(spend, 6) AS spend,
  round((coalesce(balance * 0.5, 0) + coalesce(activity * 0.3125, 0) + coalesce(spend * 0.1875, 0)) / nullif(CASE WHEN balance IS NULL THEN 0 ELSE 0.5::DOUBLE END + CASE WHEN activity IS NULL THEN 0 ELSE 0.3125::DOUBLE END + CASE WHEN spend IS NULL THEN 0 ELSE 0.1875::DOUBLE END, 0), 6) AS score FROM c
""")
def null_renormalised_score(spark, d) -> DataFrame:
    o = read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("spent"))
    c = read(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey", F.when(F.col("c_acctbal") >= 0, clamp(F.col("c_acctbal") / 100, 0.0, 100.0)).alias("balance"),
        F.when(F.col("n").isNotNull(), F.least(F.lit(100.0), F.col("n") * 5.0)).alias("activity"), F.when(F.col("n") >= 3, F.least(F.lit(100.0), F.col("spent") / 50000)).alias("spend"),
    )
    return r6(c.withColumn("score", sc.renormalised({"balance": 0.5, "activity": 0.3125, "spend": 0.1875})))


@query("""
WITH e AS (SELECT l_suppkey, l_partkey, l_discount * 10 AS i, CASE l_returnflag WHEN 'A' THEN 0.9::DOUBLE WHEN 'R' THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END AS p, 1 - l_tax * 5 AS x FROM lineitem),
k AS (SELECT l_suppkey, l_partkey, max(least(1, greatest(0, i))) AS top FROM e GROUP BY 1, 2), n AS (SELECT l_suppkey, sum(top) AS n_effective FROM k GROUP BY 1),
a AS (SELECT l_suppkey, sum(i) AS w, sum(p * i) / nullif(sum(i), 0) AS provenance, sum(least(1, greatest(0, x)) * i) / nullif(sum(i), 0) AS extraction FROM e GROUP BY 1),
f AS (SELECT a.l_suppkey, n_effective, coalesce(provenance, 0) AS provenance, coalesce(extraction, 0) AS extraction, coalesce(w / nullif(greatest(400, w), 0), 0) AS coverage FROM a JOIN n USING (l_suppkey)),
c AS (SELECT *, pow(least(1, greatest(0, coverage)), 0.4) * pow(least(1, greatest(0, provenance)), 0.25) * pow(least(1, greatest(0, extraction)), 0.2) * pow(1 - exp(-n_effective / 5), 0.15) AS confidence FROM f)
SELECT l_suppkey, round(n_effective, 6) AS n_effective, round(provenance, 6) AS provenance, round(extraction, 6) AS extraction, round(coverage, 6) AS coverage, round(confidence, 6) AS confidence,
  CASE WHEN confidence >= 0.8 THEN 'HIGH' WHEN confidence >= 0.55 THEN 'MEDIUM' WHEN confidence >= 0.35 THEN 'LOW' ELSE 'INSUFFICIENT' END AS band FROM c
""")
def confidence_from_evidence(spark, d) -> DataFrame:
    rows = read(spark, d, "lineitem").select("l_suppkey", "l_partkey", (F.col("l_discount") * 10).alias("i"), F.when(F.col("l_returnflag") == "A", 0.9).when(F.col("l_returnflag") == "R", 0.6).otherwise(0.3).alias("p"), (1 - F.col("l_tax") * 5).alias("x"))
    return r6(sc.evidence_confidence(rows, ["l_suppkey"], "i", "l_partkey", "p", "x", F.lit(400.0)))


def _ledger(spark, d) -> DataFrame:
    rows = read(spark, d, "lineitem").select("l_orderkey", (F.col("l_quantity") * 0.5).alias("contribution"), (F.col("l_tax") * 100).alias("applied"), F.lit(40.0).alias("cap_limit"), ((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.08)).alias("triggered"))
    return sc.score_ledger(rows, rows, rows, "l_orderkey")


LEDGER = """
SELECT l_orderkey, floor(contribution * 1e8 + 0.5) / 1e8 AS contribution, floor(penalty * 1e8 + 0.5) / 1e8 AS penalty, cap, greatest(0, floor((floor(contribution * 1e8 + 0.5) / 1e8 - floor(penalty * 1e8 + 0.5) / 1e8) * 1e8 + 0.5) / 1e8) AS raw FROM
(SELECT l_orderkey, sum(l_quantity * 0.5) AS contribution, sum(l_tax * 100) AS penalty, min(CASE WHEN l_returnflag = 'R' AND l_discount > 0.08 THEN 40.0::DOUBLE END) AS cap FROM lineitem GROUP BY 1)
"""


@query(f"""SELECT l_orderkey, round(contribution, 6) AS contribution, round(penalty, 6) AS penalty, cap, round(raw, 6) AS raw, round(least(raw, coalesce(cap, 100), 100), 6) AS score FROM ({LEDGER})""")
def score_ledger(spark, d) -> DataFrame:
    return r6(_ledger(spark, d))


@query(f"""
WITH x AS (SELECT l_orderkey, cap, raw, CASE WHEN raw > 38 THEN raw + 3 WHEN l_orderkey % 10 = 0 THEN least(raw, coalesce(cap, 100), 100) + 1e-7 ELSE least(raw, coalesce(cap, 100), 100) END AS score FROM ({LEDGER}))
SELECT l_orderkey, 'CAP' AS broken_rule FROM x WHERE cap IS NOT NULL AND score > cap + 1e-8 UNION ALL SELECT l_orderkey, 'RANGE' FROM x WHERE score > 100 + 1e-8 OR score < -1e-8
UNION ALL SELECT l_orderkey, 'SCORE' FROM x WHERE abs(score - least(raw, coalesce(cap, 100), 100)) > 1e-8
""")
def ledger_violations(spark, d) -> DataFrame:
    """What the rules find in a ledger whose high scores were changed by hand."""
    changed = _ledger(spark, d).withColumn("score", F.when(F.col("raw") > 38, F.col("raw") + 3).when(F.col("l_orderkey") % 10 == 0, F.col("score") + 1e-7).otherwise(F.col("score")))
    return sc.ledger_violations(changed, "l_orderkey")


def _numbered(spark, d) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return read(spark, d, "lineitem").select("l_orderkey", F.row_number().over(w).cast("long").alias("nth"), "l_returnflag", (F.col("l_tax") * 100).alias("requested"))


NUMBERED = "SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS nth, l_returnflag, l_tax * 100 AS requested FROM lineitem"


@query(f"""
WITH n AS ({NUMBERED}), c AS (SELECT *, sum(requested) OVER (PARTITION BY l_orderkey ORDER BY nth) AS upto FROM n)
SELECT l_orderkey, nth, round(least(12, upto) - least(12, upto - requested), 6) AS applied FROM c
""")
def penalty_budget_single(spark, d) -> DataFrame:
    return r6(sc.single_budget(_numbered(spark, d), ["l_orderkey"], ["nth"], "requested", F.lit(12.0)).select("l_orderkey", "nth", "applied"))


def _got(flag: str) -> str:
    return f"CASE WHEN n.l_returnflag = '{flag}' THEN r.u{flag} + least(n.requested, greatest(0, 8 - r.u{flag}), greatest(0, 15 - r.used)) ELSE r.u{flag} END"


@query(f"""
WITH RECURSIVE n AS ({NUMBERED}),
r AS (SELECT l_orderkey, 0::BIGINT AS nth, 0.0::DOUBLE AS used, 0.0::DOUBLE AS uA, 0.0::DOUBLE AS uN, 0.0::DOUBLE AS uR, 0.0::DOUBLE AS applied FROM n WHERE nth = 1
  UNION ALL SELECT l_orderkey, nth, used + got, a, b, c, got FROM (
    SELECT n.l_orderkey, n.nth, r.used, {_got("A")} AS a, {_got("N")} AS b, {_got("R")} AS c,
      least(n.requested, greatest(0, 8 - CASE n.l_returnflag WHEN 'A' THEN r.uA WHEN 'N' THEN r.uN ELSE r.uR END), greatest(0, 15 - r.used)) AS got
    FROM r JOIN n ON n.l_orderkey = r.l_orderkey AND n.nth = r.nth + 1))
SELECT l_orderkey, nth, round(applied, 6) AS applied FROM r WHERE nth > 0
""")
def penalty_budget_double(spark, d) -> DataFrame:
    return r6(sc.double_budget(_numbered(spark, d), ["l_orderkey"], "nth", "l_returnflag", "requested", 15.0, 8.0))


@query("""
WITH m AS (SELECT c_mktsegment, c_nationkey, CASE WHEN c_acctbal < -950 THEN 'BLOCKED' WHEN c_acctbal < 0 THEN 'NOT_APPLICABLE' ELSE 'APPLICABLE' END AS app, CASE WHEN c_acctbal <= 9000 THEN c_acctbal / 100 END AS score,
  1.0::DOUBLE + c_custkey % 3 AS weight, 0.5::DOUBLE + (c_custkey % 5) / 10.0::DOUBLE AS conf, CASE WHEN c_acctbal > 8900 THEN 60.0::DOUBLE END AS cap FROM customer),
g AS (SELECT c_mktsegment, c_nationkey, bool_or(app = 'BLOCKED') AS blocked, bool_and(app = 'NOT_APPLICABLE') AS nothing, sum((score IS NOT NULL AND app = 'APPLICABLE')::INT)::BIGINT AS n_scored, sum((app <> 'NOT_APPLICABLE')::INT) AS n,
  exp(sum(weight * ln(score + 1)) FILTER (score IS NOT NULL AND app = 'APPLICABLE') / sum(weight) FILTER (score IS NOT NULL AND app = 'APPLICABLE')) - 1 AS mean, min(cap) AS cap,
  exp(sum(weight * ln(conf)) FILTER (score IS NOT NULL AND app = 'APPLICABLE') / sum(weight) FILTER (score IS NOT NULL AND app = 'APPLICABLE')) AS confidence FROM m GROUP BY 1, 2)
SELECT c_mktsegment, c_nationkey, CASE WHEN blocked THEN 'BLOCKED' WHEN nothing THEN 'NOT_APPLICABLE' WHEN n_scored = 0 THEN 'INSUFFICIENT' WHEN n_scored < n THEN 'PARTIAL' ELSE 'FULL' END AS applicability,
  round(CASE WHEN NOT blocked AND mean IS NOT NULL THEN least(greatest(0, least(100, mean)), coalesce(cap, 100)) WHEN NOT blocked THEN coalesce(cap, 100) END, 6) AS score, round(coalesce(confidence, 0), 6) AS confidence, n_scored FROM g
""")
def domain_consensus(spark, d) -> DataFrame:
    b, k = F.col("c_acctbal"), F.col("c_custkey")
    m = read(spark, d, "customer").select(
        "c_mktsegment", "c_nationkey", F.when(b < -950, "BLOCKED").when(b < 0, "NOT_APPLICABLE").otherwise("APPLICABLE").alias("applicability"), F.when(b <= 9000, b / 100).alias("score"),
        (1.0 + k % 3).alias("weight"), (0.5 + (k % 5) / F.lit(10.0)).alias("confidence"), F.when(b > 8900, 60.0).alias("cap"),
    )
    return r6(sc.domain_consensus(m, ["c_mktsegment"], "c_nationkey"))


@query("""
WITH m AS (SELECT l_suppkey, CASE WHEN l_returnflag <> 'N' THEN l_quantity * 2 END AS s FROM lineitem)
SELECT l_suppkey, count(s) AS n, floor(quantile_cont(s, 0.5) + 0.5) AS median, round(avg(s), 6) AS mean, min(s) AS low, max(s) AS high FROM m GROUP BY 1
""")
def ensemble_median(spark, d) -> DataFrame:
    rows = read(spark, d, "lineitem").select("l_suppkey", F.when(F.col("l_returnflag") != "N", F.col("l_quantity") * 2).alias("s"))
    return r6(sc.ensemble(rows, ["l_suppkey"], "s"))


@query("""
WITH o AS (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1), c AS (SELECT c_custkey, c_acctbal > 0 AS a, coalesce(n >= 5, false) AS b, coalesce(top > 400000, false) AS t, c_mktsegment <> 'MACHINERY' AS s FROM customer LEFT JOIN o ON c_custkey = o_custkey)
SELECT c_custkey, floor(100 * (CASE WHEN a THEN 30 ELSE 0 END + CASE WHEN b THEN 30 ELSE 0 END + CASE WHEN t THEN 25 ELSE 0 END + CASE WHEN s THEN 15 ELSE 0 END) / 100.0::DOUBLE + 0.5) AS complete,
  CASE WHEN NOT a THEN 'balance' WHEN NOT b THEN 'orders' WHEN NOT t THEN 'large' WHEN NOT s THEN 'segment' END AS missing FROM c
""")
def completeness(spark, d) -> DataFrame:
    o = read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))
    c = read(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    parts = [("balance", 30.0, F.col("c_acctbal") > 0), ("orders", 30.0, F.col("n") >= 5), ("large", 25.0, F.col("top") > 400000), ("segment", 15.0, F.col("c_mktsegment") != "MACHINERY")]
    # of equal weights the first: the sort is stable, so the later of equals is wrapped first
    return sc.completeness(c, parts[::-1]).select("c_custkey", "complete", "missing")


SIGNALS = """
SELECT l_suppkey, CAST(sum(l_quantity) AS DOUBLE) AS source_tokens, CAST(sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END) AS DOUBLE) AS extracted_tokens, CAST(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS DOUBLE) AS matched_tokens,
  CAST(count(*) AS DOUBLE) AS comparable_w, CAST(sum(CASE WHEN l_discount > 0.09 THEN 1 ELSE 0 END) AS DOUBLE) AS discordant_w, avg(CAST(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS DOUBLE)) AS section_f1, 1 - avg(l_tax) AS boundary_f1,
  avg(l_tax) AS overlap, CASE WHEN max(l_tax) < 0.08 THEN avg(l_tax) / 2 END AS clipping, avg(l_discount) / 5 AS z_order, CAST(NULL AS DOUBLE) AS nested, avg(l_discount) / 20 AS damage, avg(l_tax) / 2 AS hidden,
  avg(l_tax) / 4 AS doubled, avg(l_discount) * 8 AS heading_separation, 1 - avg(l_tax) * 2 AS heading_levels, CASE WHEN max(l_quantity) > 49 THEN 1 - avg(l_tax) END AS field_parse, avg(l_discount) * 9 AS list_glyphs, avg(l_tax) * 9 AS list_indent, CASE WHEN min(l_quantity) < 2 THEN 0.5::DOUBLE END AS list_hanging,
  CASE WHEN l_suppkey % 3 = 0 THEN 0.8::DOUBLE WHEN l_suppkey % 3 = 1 THEN 0.9::DOUBLE END AS order_confidence FROM lineitem GROUP BY l_suppkey
"""


@query(f"""
WITH s AS ({SIGNALS}), q AS (SELECT *, matched_tokens / nullif(source_tokens, 0) AS re, matched_tokens / nullif(extracted_tokens, 0) AS pr, CASE WHEN coalesce(order_confidence >= 0.85, true) THEN discordant_w / comparable_w END AS dis FROM s),
c AS (SELECT *, CASE WHEN re + pr > 0 THEN 2 * re * pr / (re + pr) ELSE 0 END AS text_layer, exp(-ln(2.0::DOUBLE) * dis / 0.12) AS reading_order, 0.65::DOUBLE * section_f1 + 0.35::DOUBLE * boundary_f1 AS sections,
  exp((-8.0 * overlap * 0.35 + coalesce(-10.0 * clipping * 0.30, 0) + -8.0 * z_order * 0.20) / (0.35::DOUBLE + CASE WHEN clipping IS NULL THEN 0 ELSE 0.3::DOUBLE END + 0.2::DOUBLE)) AS layout, exp(-damage / 0.008) AS encoding,
  0.65::DOUBLE * least(1, heading_separation) + 0.35::DOUBLE * heading_levels AS headings, field_parse AS fields, CASE WHEN list_hanging IS NOT NULL THEN 0.4::DOUBLE * least(1, list_glyphs) + 0.35::DOUBLE * least(1, list_indent) + 0.25::DOUBLE * list_hanging END AS lists,
  least(CASE WHEN re < 0.4 THEN 25.0::DOUBLE END, CASE WHEN dis > 0.25 THEN 40.0::DOUBLE END, CASE WHEN damage > 0.03 THEN 45.0::DOUBLE END, CASE WHEN hidden > 0.25 THEN 50.0::DOUBLE END) AS cap FROM q),
w AS (SELECT *, text_layer * 0.2 + coalesce(reading_order * 0.22, 0) + sections * 0.15 + layout * 0.13 + encoding * 0.12 + headings * 0.07 + coalesce(fields * 0.07, 0) + coalesce(lists * 0.04, 0) AS mass,
  0.67::DOUBLE + CASE WHEN reading_order IS NULL THEN 0 ELSE 0.22::DOUBLE END + CASE WHEN fields IS NULL THEN 0 ELSE 0.07::DOUBLE END + CASE WHEN lists IS NULL THEN 0 ELSE 0.04::DOUBLE END AS part FROM c)
SELECT l_suppkey, round(text_layer, 6) AS text_layer, round(reading_order, 6) AS reading_order, round(sections, 6) AS sections, round(layout, 6) AS layout, round(encoding, 6) AS encoding, round(headings, 6) AS headings, round(fields, 6) AS fields, round(lists, 6) AS lists, cap AS structure_cap,
  round(least(greatest(0, 100 * mass / part - 15 * (1 - exp(-hidden / 0.05)) - 10 * (1 - exp(-doubled / 0.05))), coalesce(cap, 100)), 6) AS structure FROM w
""")
def structure_score(spark, d) -> DataFrame:
    signals = spark.sql(SIGNALS.replace("FROM lineitem", "FROM {lineitem}").replace("0.5::DOUBLE", "0.5D").replace("0.8::DOUBLE", "0.8D").replace("0.9::DOUBLE", "0.9D"), lineitem=read(spark, d, "lineitem"))
    return r6(sc.structure_score(signals).select("l_suppkey", "text_layer", "reading_order", "sections", "layout", "encoding", "headings", "fields", "lists", "structure_cap", "structure"))


@query("""
WITH g AS (SELECT c_custkey, c_acctbal * 3 AS gross FROM customer), y AS (SELECT c_custkey, gross, gross * 12 AS y FROM g),
s AS (SELECT *, least(y, 282600) * 0.1126::DOUBLE + y * 0.0245::DOUBLE AS soc FROM y), b AS (SELECT *, greatest(0, floor(y - soc - 3000 + 0.5)) AS base FROM s),
t AS (SELECT *, greatest(0, floor((CASE WHEN base <= 120000 THEN base * 0.12::DOUBLE ELSE 120000 * 0.12::DOUBLE + (base - 120000) * 0.32::DOUBLE END) - 3600 + 0.5)) AS tax FROM b)
SELECT c_custkey, round(CASE WHEN gross > 0 THEN greatest(0, floor((y - soc - (y - soc) * 0.09::DOUBLE - tax) / 12 * 100 + 0.5) / 100) ELSE 0 END, 2) AS net FROM t
""")
def net_pay(spark, d) -> DataFrame:
    return r6(read(spark, d, "customer").select("c_custkey", monthly_net(F.col("c_acctbal") * 3).alias("net")), 2)
