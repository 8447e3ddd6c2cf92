"""Queries over graphs: nations, their regions, suppliers and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroom.functions.text import edit_similarity
from tallyroom.operators import graph as gr
from tallyroom.plans.registry import query, r6
from tallyroom.sources.tables import read

#: Ids: regions from 0, nations from 100, suppliers from 1e6, customers from 1e9.
EDGES = """
SELECT 'n' || n_nationkey AS id, 100 + n_nationkey::BIGINT AS src, n_regionkey::BIGINT AS dst, 'belongs_to' AS type, 0.9::DOUBLE AS weight, 0.95::DOUBLE AS confidence FROM nation
UNION ALL SELECT 's' || s_suppkey, 1000000 + s_suppkey, 100 + s_nationkey, 'works_in', greatest(0.1, least(1, (s_acctbal + 1000) / 11000)), 0.8::DOUBLE FROM supplier
UNION ALL SELECT 'c' || c_custkey, 1000000000 + c_custkey, 100 + c_nationkey, 'used_by', greatest(0.1, least(1, (c_acctbal + 1000) / 11000)), CASE WHEN c_acctbal < 0 THEN 0.2::DOUBLE ELSE 0.7::DOUBLE END FROM customer
UNION ALL SELECT 'x' || n_nationkey, 100 + n_nationkey, 100 + (n_nationkey * 7 + 3) % 25, 'related_to', 0.5::DOUBLE, 0.6::DOUBLE FROM nation
"""
VERTICES = """
SELECT r_regionkey::BIGINT AS id, r_name AS name, 1.0::DOUBLE AS confidence FROM region UNION ALL SELECT 100 + n_nationkey, n_name, 0.9::DOUBLE FROM nation
UNION ALL SELECT 1000000 + s_suppkey, s_name, CASE WHEN s_acctbal < 0 THEN 0.3::DOUBLE ELSE 0.8::DOUBLE END FROM supplier
UNION ALL SELECT 1000000000 + c_custkey, c_name, 0.7::DOUBLE FROM customer UNION ALL SELECT 50 + p_size, 'size ' || CAST(p_size % 20 AS VARCHAR), 0.6::DOUBLE FROM (SELECT DISTINCT p_size FROM part WHERE p_size < 40)
"""


def _graph(spark, d) -> tuple[DataFrame, DataFrame]:
    n, s, c = read(spark, d, "nation"), read(spark, d, "supplier"), read(spark, d, "customer")
    near = lambda b: F.greatest(F.lit(0.1), F.least(F.lit(1.0), (F.col(b) + 1000) / 11000))

    def edge(df, mark, key, src, dst, kind, weight, sure):
        return df.select(F.concat(F.lit(mark), F.col(key).cast("string")).alias("id"), src.cast("long").alias("src"), dst.cast("long").alias("dst"), F.lit(kind).alias("type"), weight.alias("weight"), sure.alias("confidence"))

    nation = 100 + F.col("n_nationkey")
    edges = (
        edge(n, "n", "n_nationkey", nation, F.col("n_regionkey"), "belongs_to", F.lit(0.9), F.lit(0.95))
        .union(edge(s, "s", "s_suppkey", 1000000 + F.col("s_suppkey"), 100 + F.col("s_nationkey"), "works_in", near("s_acctbal"), F.lit(0.8)))
        .union(edge(c, "c", "c_custkey", 1000000000 + F.col("c_custkey"), 100 + F.col("c_nationkey"), "used_by", near("c_acctbal"), F.when(F.col("c_acctbal") < 0, 0.2).otherwise(0.7)))
        .union(edge(n, "x", "n_nationkey", nation, 100 + (F.col("n_nationkey") * 7 + 3) % 25, "related_to", F.lit(0.5), F.lit(0.6)))
    )
    sizes = read(spark, d, "part").where("p_size < 40").select("p_size").distinct()

    def vertex(df, ident, name, sure):
        return df.select(ident.cast("long").alias("id"), name.alias("name"), sure.alias("confidence"))

    vertices = (
        vertex(read(spark, d, "region"), F.col("r_regionkey"), F.col("r_name"), F.lit(1.0))
        .union(vertex(n, nation, F.col("n_name"), F.lit(0.9)))
        .union(vertex(s, 1000000 + F.col("s_suppkey"), F.col("s_name"), F.when(F.col("s_acctbal") < 0, 0.3).otherwise(0.8)))
        .union(vertex(c, 1000000000 + F.col("c_custkey"), F.col("c_name"), F.lit(0.7)))
        .union(vertex(sizes, 50 + F.col("p_size"), F.concat(F.lit("size "), (F.col("p_size") % 20).cast("string")), F.lit(0.6)))
    )
    return vertices, edges


@query(f"""
WITH v AS ({VERTICES}), e AS ({EDGES}), n AS (SELECT id, sum(i)::BIGINT AS i, sum(o)::BIGINT AS o FROM (SELECT src AS id, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY 1)
SELECT v.id, coalesce(i, 0) AS n_in, coalesce(o, 0) AS n_out, coalesce(i, 0) + coalesce(o, 0) AS n_all FROM v LEFT JOIN n ON n.id = v.id
""")
def graph_degrees(spark, d) -> DataFrame:
    v, e = _graph(spark, d)
    return gr.degrees(v, e.withColumn("status", F.lit("active")))


def _rank_sql(rounds: int) -> str:
    steps = [f"WITH v AS ({VERTICES}), e AS ({EDGES}), o AS (SELECT src, count(*) AS o FROM e GROUP BY 1), s AS (SELECT e.src, e.dst, count(*) / any_value(o)::DOUBLE AS share FROM e JOIN o ON o.src = e.src GROUP BY 1, 2), r0 AS (SELECT id, 1.0 / (SELECT count(*) FROM v)::DOUBLE AS rank FROM v)"]
    for i in range(rounds):
        steps.append(f"r{i + 1} AS (SELECT v.id, 0.15::DOUBLE / (SELECT count(*) FROM v) + 0.85::DOUBLE * (coalesce(g.x, 0) + (SELECT coalesce(sum(rank), 0) FROM r{i} WHERE id NOT IN (SELECT src FROM o)) / (SELECT count(*) FROM v)) AS rank FROM v LEFT JOIN (SELECT dst, sum(rank * share) AS x FROM s JOIN r{i} ON r{i}.id = s.src GROUP BY 1) g ON g.dst = v.id)")
    return ",\n".join(steps) + f"\nSELECT id, round(rank, 9) AS rank FROM r{rounds}"


@query(_rank_sql(6))
def pagerank_fixed(spark, d) -> DataFrame:
    v, e = _graph(spark, d)
    return r6(gr.pagerank(v, e, rounds=6, save_every=3), 9)


def _paths_sql(most: int) -> str:
    cost = "1 / (greatest(0.1, weight) * greatest(0.1, confidence) * CASE type WHEN 'works_in' THEN 1.0::DOUBLE WHEN 'belongs_to' THEN 1.2::DOUBLE WHEN 'related_to' THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END)"
    steps = [f"WITH e AS ({EDGES}), c AS (SELECT src, dst, min(cost) AS cost FROM (SELECT src, dst, {cost} AS cost FROM e UNION ALL SELECT dst, src, {cost} FROM e) WHERE src <> dst GROUP BY 1, 2), p0 AS (SELECT r_regionkey::BIGINT AS source, r_regionkey::BIGINT AS node, 0.0::DOUBLE AS cost FROM region)"]
    steps += [f"p{i} AS (SELECT source, c.dst AS node, min(floor((p.cost + c.cost) * 1e8 + 0.5) / 1e8) AS cost FROM p{i - 1} p JOIN c ON c.src = p.node GROUP BY 1, 2)" for i in range(1, most + 1)]
    rows = " UNION ALL ".join(f"SELECT source, node, cost, {i} AS hops FROM p{i}" for i in range(most + 1))
    return ",\n".join(steps) + f"\nSELECT source, node, round(min(cost), 6) AS cost, CAST(arg_min(hops, (cost, hops)) AS INTEGER) AS hops FROM ({rows}) WHERE node <> source GROUP BY 1, 2"


@query(_paths_sql(3))
def bounded_paths(spark, d) -> DataFrame:
    """The cheapest ways of three edges at most from each region."""
    _, e = _graph(spark, d)
    sources = read(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("source"))
    costs = gr.path_costs(e, {"belongs_to": 1.2, "related_to": 0.8})
    return r6(gr.bounded_paths(sources, costs, 3).select("source", "node", "cost", "hops"))


@query(f"""
WITH v AS ({VERTICES}), e AS ({EDGES}), x AS (SELECT src AS id FROM e UNION SELECT dst FROM e)
SELECT 'LOW_CONFIDENCE_VERTEX' AS kind, CAST(id AS VARCHAR) AS id, name AS detail FROM v WHERE confidence < 0.4 UNION ALL SELECT 'LOW_CONFIDENCE_EDGE', id, type FROM e WHERE confidence < 0.3
UNION ALL SELECT 'DUPLICATE_NAME', CAST(min(id) AS VARCHAR), lower(name) FROM v GROUP BY lower(name) HAVING count(*) > 1 UNION ALL SELECT 'ORPHAN', CAST(id AS VARCHAR), name FROM v WHERE id NOT IN (SELECT id FROM x)
UNION ALL SELECT 'DANGLING', CAST(id AS VARCHAR), NULL FROM x WHERE id NOT IN (SELECT id FROM v)
""")
def graph_audit(spark, d) -> DataFrame:
    return gr.audit(*_graph(spark, d))


@query("""
WITH q(query) AS (VALUES ('small ring'), ('red wigdet'), ('Blue Bolt'), ('larg gear'), ('PROMO'), ('nothing like it'), ('hoopy thing'), ('small ringami')), n AS (SELECT p_name AS name, min(p_partkey) AS id, list(DISTINCT p_type) AS tags FROM part GROUP BY 1),
f AS (SELECT query, lower(query) AS q, replace(lower(query), 'wigdet', 'widget') AS j, CASE WHEN contains(lower(query), 'hoop') THEN 'new ring' END AS v, CASE WHEN lower(query) = 'small ringami' THEN 'small ring' WHEN lower(query) = 'larg gear' THEN 'large gear' END AS st FROM q),
s AS (SELECT query, id, 1.0::DOUBLE AS s, 'exact' AS tier, 1 AS o FROM f JOIN n ON q = lower(name) UNION ALL SELECT query, id, 0.94::DOUBLE, 'jargon', 3 FROM f JOIN n ON j = lower(name) UNION ALL SELECT query, id, 0.92::DOUBLE, 'verbal', 4 FROM f JOIN n ON v = lower(name)
  UNION ALL SELECT query, id, 0.91::DOUBLE, 'stem', 5 FROM f JOIN n ON st = lower(name) UNION ALL SELECT query, id, 0.82::DOUBLE, 'tag', 6 FROM f JOIN n ON list_contains(list_transform(tags, lambda t: lower(t)), q)
  UNION ALL SELECT query, id, 0.75 * (1 - levenshtein(q, lower(name)) / greatest(length(q), length(name))) + 0.25 * 0.8, 'fuzzy', 7 FROM f JOIN n ON 1 - levenshtein(q, lower(name)) / greatest(length(q), length(name)) >= 0.52)
SELECT query, id, round(s, 6) AS score, tier FROM (SELECT *, row_number() OVER (PARTITION BY query, id ORDER BY o) AS r FROM s) WHERE r = 1
""")
def fuzzy_name_search(spark, d) -> DataFrame:
    """Names by a list of queries, in seven tiers; every name is compared."""
    names = read(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"), F.collect_set("p_type").alias("tags"))
    names = names.withColumns({"confidence": F.lit(0.8), "aliases": F.expr("CAST(array() AS array<string>)")})
    queries = spark.createDataFrame([(x,) for x in ("small ring", "red wigdet", "Blue Bolt", "larg gear", "PROMO", "nothing like it", "hoopy thing", "small ringami")], "query string")
    return r6(gr.tiered_search(queries, names, edit_similarity, jargon={"wigdet": "widget"}, actors={"hoop": ["new ring"]}))


@query(f"WITH v AS ({VERTICES}) SELECT id, name FROM v WHERE contains(lower(name), 'er#') OR contains(lower(name), 'size 1') ORDER BY confidence DESC, id LIMIT 20")
def best_vertices(spark, d) -> DataFrame:
    """The 20 surest vertices whose name holds a text: a top-k report."""
    v, _ = _graph(spark, d)
    low = F.lower("name")
    return v.where(low.contains("er#") | low.contains("size 1")).orderBy(F.desc("confidence"), "id").limit(20).select("id", "name")


@query(_rank_sql(3).replace("SELECT id, round(rank, 9) AS rank FROM r3", "SELECT id, round(rank, 9) AS rank FROM r3 ORDER BY round(rank, 9) DESC, id LIMIT 25"))
def pagerank_listing(spark, d) -> DataFrame:
    """The 25 highest ranks after three rounds: a top-k report."""
    v, e = _graph(spark, d)
    return r6(gr.pagerank(v, e, rounds=3, save_every=3), 9).orderBy(F.desc("rank"), "id").limit(25)


_FACTOR = "CASE type WHEN 'belongs_to' THEN 1.2::DOUBLE WHEN 'related_to' THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END"


@query(f"""
WITH e AS (SELECT * FROM ({EDGES}) WHERE type IN ('belongs_to', 'related_to')), b AS (SELECT src, dst, 1 / (greatest(0.1, weight) * greatest(0.1, confidence) * {_FACTOR}) AS cost, confidence * weight AS sure FROM e UNION ALL SELECT dst, src, 1 / (greatest(0.1, weight) * greatest(0.1, confidence) * {_FACTOR}), confidence * weight FROM e),
c AS (SELECT src, dst, min(cost) AS cost, arg_min(sure, cost) AS sure FROM b WHERE src <> dst GROUP BY 1, 2),
p AS (SELECT src AS source, dst AS node, [src, dst] AS path, floor(cost * 1e8 + 0.5) / 1e8 AS cost, 1 AS hops FROM c WHERE src < 100 UNION ALL SELECT a.src, b.dst, [a.src, a.dst, b.dst], floor((floor(a.cost * 1e8 + 0.5) / 1e8 + b.cost) * 1e8 + 0.5) / 1e8, 2 FROM c a JOIN c b ON a.dst = b.src WHERE a.src < 100),
m AS (SELECT source, node, arg_min(path, (cost, hops, path)) AS path FROM p WHERE source <> node GROUP BY 1, 2), s AS (SELECT source, node, unnest(range(1, len(path))) AS step, path FROM m)
SELECT source, node, CAST(step AS INTEGER) AS step, c.src, c.dst, round(floor(cost * 100 + 0.5) / 100, 6) AS cost, round(sure, 6) AS sure FROM s JOIN c ON c.src = path[step] AND c.dst = path[step + 1]
""")
def path_steps(spark, d) -> DataFrame:
    """The steps of the cheapest ways of two edges at most from each region, over edges of two kinds."""
    _, e = _graph(spark, d)
    costs = gr.path_costs(e.where("type IN ('belongs_to', 'related_to')"), {"belongs_to": 1.2, "related_to": 0.8})
    sources = read(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("source"))
    return r6(gr.path_steps(gr.bounded_paths(sources, costs, 2), costs))
