"""Queries over filters, predicates, levels and small decision tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyroom.functions import numbers as nu
from tallyroom.functions import rules as ru
from tallyroom.functions import text as tx
from tallyroom.operators import views as vw
from tallyroom.plans.graphs import VERTICES, _graph
from tallyroom.plans.registry import query, r6
from tallyroom.sources.tables import read


def quoted(x) -> str:
    """A value as SQL says it."""
    if x is None:
        return "NULL"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"{x!r}::DOUBLE" if isinstance(x, float) else str(x).lower()


def made(rows: list[tuple], columns: str) -> str:
    """A list of rows as a SQL table."""
    return f"(VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) AS made({columns})"


def chosen(key: Column, values: list) -> Column:
    """One of the values by a key, in turn."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


STATES = {"1-URGENT": "OPEN", "2-HIGH": "SENT", "3-MEDIUM": "RUNNING", "4-NOT SPECIFIED": "DONE", "4-LOW": "DONE", "5-LOW": "DONE"}
_MAPPED = "CASE o_orderpriority WHEN '1-URGENT' THEN 'OPEN' WHEN '2-HIGH' THEN 'SENT' WHEN '3-MEDIUM' THEN 'RUNNING' WHEN '4-NOT SPECIFIED' THEN 'DONE' WHEN '4-LOW' THEN 'DONE' WHEN '5-LOW' THEN 'DONE' ELSE 'SENT' END"


@query(f"SELECT o_orderkey, {_MAPPED} AS state, true AS in_all, coalesce(o_orderpriority IN ('4-NOT SPECIFIED', '4-LOW', '5-LOW'), false) AS in_done, coalesce(o_orderpriority = '2-HIGH', false) AS in_high FROM orders")
def status_filter(spark, d) -> DataFrame:
    """Fine states as a few, and who passes a filter of each kind."""
    s = F.col("o_orderpriority")
    return read(spark, d, "orders").select("o_orderkey", ru.mapped_status(s, STATES, "SENT").alias("state"), ru.status_matches(s, "ALL").alias("in_all"), ru.status_matches(s, "DONE", STATES).alias("in_done"), ru.status_matches(s, "2-HIGH").alias("in_high"))


@query("SELECT p_partkey FROM part WHERE (list_contains(string_split(lower(p_type), ' '), 'promo') OR list_contains(string_split(lower(p_type), ' '), 'economy')) AND (contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring'))")
def tag_search(spark, d) -> DataFrame:
    """Rows with one of the tags, and a text within their name or a tag."""
    p = read(spark, d, "part").select("p_partkey", "p_name", F.split("p_type", " ").alias("tags"))
    return p.where(ru.tagged(F.col("tags"), ["Promo", "ECONOMY"], [F.col("p_name")], "Ring")).select("p_partkey")


@query("SELECT p_brand, min(p_partkey) AS first_key FROM part WHERE list_contains(string_split(lower(p_type), ' '), 'standard') GROUP BY 1")
def first_by_tag(spark, d) -> DataFrame:
    p = read(spark, d, "part").select("p_partkey", "p_brand", F.split("p_type", " ").alias("tags"))
    return p.where(ru.tagged(F.col("tags"), ["standard"])).groupBy("p_brand").agg(F.min("p_partkey").alias("first_key"))


@query(r"""
WITH s AS (SELECT conv_id, list(coalesce(text, '') ORDER BY turn) AS s FROM conversations GROUP BY 1), f AS (SELECT conv_id, list_filter(s, lambda x: trim(x) <> '') AS f FROM s)
SELECT conv_id, length(regexp_replace(array_to_string(f, ''), '[^\p{L}]', '', 'g')) >= 10 AND (len(list_filter(f, lambda x: length(trim(x)) >= 20 AND contains(trim(x), ' '))) > 0 OR len(f) >= 2) AS enough FROM f
""")
def text_sufficiency(spark, d) -> DataFrame:
    """Whether a conversation's turns hold enough text to be judged."""
    return ru.enough_texts(read(spark, d, "conversations").select("conv_id", "text"), ["conv_id"], "text")


@query("""
WITH x AS (SELECT c_custkey, c_acctbal / 100 AS s, CASE c_custkey % 3 WHEN 0 THEN 'v2' WHEN 1 THEN 'v1' END AS v FROM customer)
SELECT c_custkey, s BETWEEN 0 AND 100 AS valid, s BETWEEN 0 AND 100 AND coalesce(v = 'v2', false) AS canonical, CASE WHEN NOT s BETWEEN 0 AND 100 THEN NULL WHEN s >= 75 THEN 'high' WHEN s >= 50 THEN 'moderate' ELSE 'low' END AS band FROM x
""")
def score_validity(spark, d) -> DataFrame:
    """Scores in range, those of the rules in force, and their band."""
    x = read(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 100).alias("s"), F.when(F.col("c_custkey") % 3 == 0, "v2").when(F.col("c_custkey") % 3 == 1, "v1").alias("v"))
    valid = ru.valid_score(F.col("s"))
    return x.select("c_custkey", valid.alias("valid"), (valid & F.coalesce(F.col("v") == "v2", F.lit(False))).alias("canonical"), nu.band(F.when(valid, F.col("s")), [(75.0, "high"), (50.0, "moderate")], "low").alias("band"))


PLACES = [("Berlin", "on site", "welder", False), ("praca zdalna", None, None, True), (None, "Hybrydowo, two days", "cook", True), ("remotely", "", "", False), ("Home  Office", "", "", True), ("", "umowa B2B", "", True), ("pół etatu", "", "", True), ("", "(part-time)", None, True), ("contractor", "xb2by", "", False)]


@query(f"SELECT o_orderkey, flexible FROM orders JOIN (SELECT row_number() OVER () - 1 AS k, f AS flexible FROM {made([(i, p[3]) for i, p in enumerate(PLACES)], 'k, f')}) ON o_orderkey % {len(PLACES)} = k".replace("SELECT row_number() OVER () - 1 AS k, f AS flexible", "SELECT k, f AS flexible"))
def flexible_work(spark, d) -> DataFrame:
    """Places and descriptions that are made of keys."""
    k = F.col("o_orderkey")
    parts = [chosen(k, [p[i] for p in PLACES]) for i in range(3)]
    return read(spark, d, "orders").select("o_orderkey", ru.flexible_work(*parts).alias("flexible"))


@query("""
WITH x AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 7 ELSE o_orderkey % 5 END AS made_for, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 5 END AS cur, CASE o_orderkey % 3 WHEN 0 THEN 'r1' WHEN 1 THEN 'r2' END AS r, CASE WHEN o_orderkey % 6 < 5 THEN o_orderkey % 2 END AS m FROM orders)
SELECT o_orderkey, CASE WHEN made_for <> cur THEN 'stale' WHEN r <> 'r2' THEN 'stale' WHEN made_for IS NULL OR cur IS NULL OR r IS NULL THEN 'unknown' WHEN m IS NULL THEN 'unknown' WHEN m <> 1 THEN 'stale' ELSE 'current' END AS state FROM x
""")
def analysis_freshness(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    made_for, current = F.when(k % 4 == 1, F.lit(7)).when(k % 4 > 1, k % 5), F.when(k % 7 != 0, k % 5)
    rules, month = F.when(k % 3 == 0, "r1").when(k % 3 == 1, "r2"), F.when(k % 6 < 5, k % 2)
    return read(spark, d, "orders").select("o_orderkey", ru.freshness(made_for, current, rules, F.lit("r2"), month, F.lit(1)).alias("state"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7")
def owned_rows(spark, d) -> DataFrame:
    """Rows of one owner; the filter reaches the scan."""
    return vw.owned_rows(read(spark, d, "orders"), "o_custkey", F.lit(7)).select("o_orderkey", "o_totalprice")


@query(f"WITH v AS ({VERTICES}) SELECT id, name FROM v WHERE confidence >= 0.65 AND id % 9 NOT IN (1, 2)")
def entity_filter(spark, d) -> DataFrame:
    """Vertices that a search may find: sure enough, and neither rejected nor deprecated."""
    v, _ = _graph(spark, d)
    status = F.when(F.col("id") % 9 == 1, "rejected").when(F.col("id") % 9 == 2, "deprecated").otherwise("verified")
    return vw.findable(v.withColumn("status", status), least=0.65).select("id", "name")


@query(r"""
WITH w AS (SELECT conv_id, turn, generate_subscripts(regexp_split_to_array(text, '\s+'), 1) AS i, unnest(regexp_split_to_array(text, '\s+')) AS w FROM conversations WHERE text IS NOT NULL),
b AS (SELECT *, regexp_replace(lower(w), '[^a-z0-9ąćęłńóśźż]', '', 'g') IN ('the', 'und', 'de') AS bad FROM w)
SELECT conv_id, turn, CAST(sum(bad::INT) AS BIGINT) AS n_listed, string_agg(CASE WHEN bad THEN '***' ELSE w END, ' ' ORDER BY i) AS masked FROM b GROUP BY 1, 2
""")
def listed_words(spark, d) -> DataFrame:
    """Texts with the words of a list masked."""
    c = read(spark, d, "conversations").where("text IS NOT NULL")
    return c.select("conv_id", "turn", ru.masked_words(F.col("text"), ["the", "und", "de"]).alias("m")).select("conv_id", "turn", "m.*")


SCRIPTS = [('{"name": "welder"}', False), ('{"name": "<ScRiPt src=x>"}', True), ("JavaScript:alert(1)", True), ("java script", False), ("", False), (None, False)]


@query(f"SELECT c_custkey, bad AS injected FROM customer JOIN {made([(i, b) for i, (_, b) in enumerate(SCRIPTS)], 'k, bad')} ON c_custkey % {len(SCRIPTS)} = k")
def script_guard(spark, d) -> DataFrame:
    return read(spark, d, "customer").select("c_custkey", ru.injected(chosen(F.col("c_custkey"), [s for s, _ in SCRIPTS])).alias("injected"))


HOSTS = [("www.example.com", False), ("LOCALHOST.", True), ("db.internal", True), ("a.cluster.local", True), ("intranet", True), ("metadata", True), ("x.home.arpa", True), ("local.example", False), ("", True), (None, True), ("2001:db8::1", False)]


@query(f"SELECT c_custkey, bad AS closed FROM customer JOIN {made([(i, b) for i, (_, b) in enumerate(HOSTS)], 'k, bad')} ON c_custkey % {len(HOSTS)} = k")
def closed_hosts(spark, d) -> DataFrame:
    return read(spark, d, "customer").select("c_custkey", ru.closed_host(chosen(F.col("c_custkey"), [h for h, _ in HOSTS])).alias("closed"))


@query("""
WITH x AS (SELECT p_partkey, p_partkey % 6 AS need, p_size % 6 AS have, list_extract(['CE', 'C', 'BE', 'B', 'DE'], CAST(p_partkey % 5 + 1 AS INTEGER)) AS held, list_extract(['C', 'B', 'D'], CAST(p_size % 3 + 1 AS INTEGER)) AS wanted FROM part)
SELECT p_partkey, CASE WHEN have >= need THEN 1.0::DOUBLE WHEN need - have = 1 THEN 0.45::DOUBLE WHEN need - have = 2 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END AS level, CASE WHEN held = wanted OR held = wanted || 'E' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS licence FROM x
""")
def rank_fulfilment(spark, d) -> DataFrame:
    """Levels that are reached or nearly so, and licences that cover others."""
    held, wanted = chosen(F.col("p_partkey"), ["CE", "C", "BE", "B", "DE"]), chosen(F.col("p_size"), ["C", "B", "D"])
    return read(spark, d, "part").select("p_partkey", ru.rank_fulfilment(F.col("p_partkey") % 6, F.col("p_size") % 6).alias("level"), ru.licence_fulfilment(held, wanted).alias("licence"))


LEVELS = [
    ("English C1, B2 before", "C1", None, None), ("Język angielski: biegły", "C1", None, None), ("native speaker, MSc", "NATIVE", "MASTER", None), ("średnio zaawansowany; technikum", "B2", "SECONDARY", None), ("Licencjat, prawo jazdy kat. B", None, "BACHELOR", "B"),
    ("Prawo jazdy CE", None, None, "CE"), ("category C1E", None, None, None), ("wykształcenie wyższe, doktorat", None, "DOCTORATE", None), ("podstawowy", "A2", None, None), ("mastery", None, None, None), (None, None, None, None),
]


@query(f"SELECT o_orderkey, language, education, driving FROM orders JOIN {made([(i, *x[1:]) for i, x in enumerate(LEVELS)], 'k, language, education, driving')} ON o_orderkey % {len(LEVELS)} = k")
def level_parsers(spark, d) -> DataFrame:
    """Levels of language and schooling, and licences, read from texts that are made of keys."""
    text = chosen(F.col("o_orderkey"), [x[0] for x in LEVELS])
    o = read(spark, d, "orders").select("o_orderkey", text.alias("t"), tx.fold(text).alias("f"))
    return o.select("o_orderkey", ru.language_level(F.col("f")).alias("language"), ru.education_level(F.col("f")).alias("education"), ru.driving_category(F.col("t")).alias("driving"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity = 1 THEN 'year' WHEN l_quantity % 10 BETWEEN 2 AND 4 AND NOT l_quantity % 100 BETWEEN 12 AND 14 THEN 'years' ELSE 'of years' END AS noun,
  CASE WHEN l_extendedprice / 500 <= 100 THEN CAST(floor(l_extendedprice / 500 + 0.5) AS BIGINT) END AS share FROM lineitem
""")
def plurals_and_shares(spark, d) -> DataFrame:
    """The form of a noun after a quantity, and shares that are in range."""
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ru.plural(F.col("l_quantity"), "year", "years", "of years").alias("noun"), ru.percentage(F.col("l_extendedprice") / 500).alias("share"))


@query("""
WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS depth, 1 - l_discount * 6 AS c FROM lineitem), y AS (SELECT *, c * (0.5::DOUBLE + 0.5::DOUBLE * least(1, depth)) AS w FROM x)
SELECT l_orderkey, l_linenumber, round(CASE WHEN c >= 1 - 1e-9 THEN depth WHEN w >= 0.5 THEN least(1, greatest(0, (w - 0.5) / 0.5)) END, 6) AS depth FROM y
""")
def claim_strength(spark, d) -> DataFrame:
    """Depths of evidence that the strength of its claim lowers."""
    return r6(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ru.claim_depth(F.col("l_quantity") / 50, 1 - F.col("l_discount") * 6).alias("depth")))


@query("SELECT c_custkey, CASE WHEN s >= 8 THEN 'EXCELLENT' WHEN s >= 6 THEN 'SOLID' WHEN s >= 1 THEN 'NEEDS_REFINEMENT' END AS verdict FROM (SELECT c_custkey, CASE WHEN c_custkey % 12 BETWEEN 1 AND 10 THEN c_custkey % 12 END AS s FROM customer)")
def answer_verdicts(spark, d) -> DataFrame:
    """Verdicts by whole scores of 1 to 10; others have none."""
    s = F.col("c_custkey") % 12
    return read(spark, d, "customer").select("c_custkey", nu.band(F.when(s.between(1, 10), s), [(8, "EXCELLENT"), (6, "SOLID")], "NEEDS_REFINEMENT").alias("verdict"))
