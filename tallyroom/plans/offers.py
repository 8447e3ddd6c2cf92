"""Queries over offers and profiles as texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroom.functions import text as tx
from tallyroom.operators import offers as of
from tallyroom.operators import texts as ts
from tallyroom.operators import views as vw
from tallyroom.plans.filters import chosen
from tallyroom.plans.language import _made
from tallyroom.plans.registry import query
from tallyroom.sources.tables import read

OFFERS = [
    ("Cookies\n Welder wanted \n\nYou weld.\nSimilar offers\nCook", "Welder wanted\nYou weld."), ("accept COOKIES now\nBaker", "Baker"), ("similar offers\nx", ""), ("plain", "plain"), (None, ""),
]


@query(_made("customer", "c_custkey", OFFERS, "cleaned"))
def cleaned_offers(spark, d) -> DataFrame:
    return read(spark, d, "customer").select("c_custkey", of.cleaned_offer(chosen(F.col("c_custkey"), [o for o, _ in OFFERS]), "cookies", "^similar offers").alias("cleaned"))


MANY = "intro\nOFFER 1\nWelder\nPay: 10\nOFFER 2\nCook\nplace : Rome\nPay: 20"


@query("SELECT s_suppkey, segment, pay, place FROM supplier, (VALUES (0, NULL, NULL), (1, '10', NULL), (2, '20', 'Rome')) v(segment, pay, place)")
def offer_segments(spark, d) -> DataFrame:
    """Offers of a text that holds several, and the fields that they name."""
    s = read(spark, d, "supplier").select("s_suppkey", F.lit(MANY).alias("t"))
    rows = of.offer_segments(s, "s_suppkey", "t", "OFFER [0-9]")
    return rows.select("s_suppkey", "segment", of.lifted_fields(F.col("content"), {"pay": "pay|salary", "place": "place"}).alias("f")).select("s_suppkey", "segment", "f.*")


@query("""
WITH p(phrase, kind, weight) AS (VALUES ('red widget', 'hard', 3.0::DOUBLE), ('widget', 'hard', 3.0::DOUBLE), ('ring', 'hard', 3.0::DOUBLE), ('small', 'soft', 0.5::DOUBLE), ('red', 'formal', 2.0::DOUBLE)), n AS (SELECT p_partkey, ' ' || lower(p_name) || ' ' AS t FROM part)
SELECT p_partkey, phrase, kind, weight FROM n, p WHERE contains(t, ' ' || phrase || ' ') AND NOT (phrase = 'widget' AND contains(t, ' red widget '))
""")
def dictionary_phrases(spark, d) -> DataFrame:
    table = spark.createDataFrame([("red widget", "hard", 3.0), ("widget", "hard", 3.0), ("ring", "hard", 3.0), ("small", "soft", 0.5), ("red", "formal", 2.0)], "phrase string, kind string, weight double")
    return of.dictionary_phrases(read(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", "p_name", table)


@query("SELECT p_partkey, array_to_string(list_filter([CASE WHEN contains(lower(p_name), 'ring') THEN 'round' END, CASE WHEN regexp_matches(lower(p_name), 'bolt|gear') AND contains(lower(p_name), 'large') THEN 'heavy' END], lambda x: x IS NOT NULL), ',') AS hits FROM part")
def taxonomy_hits(spark, d) -> DataFrame:
    """Definitions that names meet, one of them with a guard."""
    return read(spark, d, "part").select("p_partkey", F.array_join(of.taxonomy_hits(F.col("p_name"), [("round", "ring", None), ("heavy", "bolt|gear", "large")]), ",").alias("hits"))


@query("""
WITH n AS (SELECT l_orderkey, row_number() OVER w AS i, CASE WHEN lead(l_linenumber) OVER w IS NULL THEN '' ELSE CASE l_returnflag WHEN 'A' THEN 'or' WHEN 'R' THEN 'and' ELSE '' END END AS c, coalesce(CASE lag(l_returnflag) OVER w WHEN 'A' THEN 'or' WHEN 'R' THEN 'and' END, '') AS b FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
a AS (SELECT *, c = 'or' OR b = 'or' AS any FROM n), t AS (SELECT *, b = 'and' AND NOT any AND NOT coalesce(lag(any) OVER (PARTITION BY l_orderkey ORDER BY i), false) AS tied FROM a), u AS (SELECT *, coalesce(lead(tied) OVER (PARTITION BY l_orderkey ORDER BY i), false) AS nxt FROM t),
k AS (SELECT *, CASE WHEN any THEN 'ANY_OF' WHEN tied OR nxt THEN 'ALL_OF' ELSE 'SINGLE' END AS kind, CASE WHEN any THEN b <> 'or' ELSE NOT tied END AS begins FROM u)
SELECT l_orderkey, i AS nth, kind, max(CASE WHEN begins THEN i END) OVER (PARTITION BY l_orderkey ORDER BY i) AS head FROM k
""".replace(" AS any,", ' AS "any",').replace("OR b = 'or' AS any FROM", "OR b = 'or' AS \"any\" FROM").replace("NOT any AND", 'NOT "any" AND').replace("lag(any)", 'lag("any")').replace("CASE WHEN any THEN", 'CASE WHEN "any" THEN'))
def requirement_groups(spark, d) -> DataFrame:
    """Lines of an order that or ties, and those left over that and ties."""
    from tallyroom.plans.scoring import _numbered

    rows = _numbered(spark, d).select("l_orderkey", "nth", F.when(F.col("l_returnflag") == "A", "or").when(F.col("l_returnflag") == "R", "and").alias("c"))
    return of.requirement_groups(rows, ["l_orderkey"], "nth", "c").select("l_orderkey", "nth", "kind", "head")


PROFILE = "Jan\nExperience\nWelder, Acme (01.2019 - 03.2020)\nno dates\nBaker (2021-05)\nSkills\nmig, tig ,\nplain\nOther\na, b"


@query("SELECT s_suppkey, section, line, entry, first, last FROM supplier, (VALUES ('experience', 2, 'Welder, Acme', 24228, 24242), ('experience', 4, 'Baker', 24256, 24256), ('skills', 6, 'mig', NULL, NULL), ('skills', 6, 'tig', NULL, NULL)) v(section, line, entry, first, last)")
def profile_entries(spark, d) -> DataFrame:
    """Entries of profiles that are plain texts."""
    s = read(spark, d, "supplier").select("s_suppkey", F.lit(PROFILE).alias("t"))
    lines = ts.sections(s, "s_suppkey", "t", {"experience": "^experience$", "skills": "^skills$", "other": "^other$"})
    return of.profile_entries(lines, "s_suppkey", ["experience"], ["skills"])


@query("""
WITH e AS (SELECT p_partkey AS id, p_name AS name FROM part), a AS (SELECT p_partkey AS id, p_type || ' ' || p_brand AS alias FROM part), q AS (SELECT DISTINCT CASE l_linenumber % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(lower(p_name), 'o', 'ó') ELSE lower(p_type || ' ' || p_brand) END AS q FROM lineitem JOIN part ON p_partkey = l_partkey),
f AS (SELECT q, lower(trim(q)) AS l, strip_accents(lower(trim(q))) AS s FROM q), h AS (SELECT q, 1 AS o, min(id) AS id FROM f JOIN e ON lower(name) = l GROUP BY 1 UNION ALL SELECT q, 2, min(id) FROM f JOIN e ON strip_accents(lower(name)) = s GROUP BY 1 UNION ALL SELECT q, 3, min(id) FROM f JOIN a ON strip_accents(lower(alias)) = s GROUP BY 1)
SELECT q, arg_min(id, o) AS id FROM h GROUP BY 1
""")
def entity_by_name(spark, d) -> DataFrame:
    """Parts by name in other letters, with marks, or by type and brand, as lines ask for them."""
    part = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat_ws(" ", "p_type", "p_brand").alias("alias"))
    li = read(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), (F.col("l_linenumber") % 3).alias("k")).distinct().join(part, "id")
    asked = F.when(F.col("k") == 0, F.upper("name")).when(F.col("k") == 1, F.replace(F.lower("name"), F.lit("o"), F.lit("ó"))).otherwise(F.lower("alias"))
    return of.by_name(li.select(asked.alias("q")).distinct(), part.select("id", "name"), part.select("id", "alias"), "q")


ROLES = [("Senior welder", "METAL"), ("Spawacz gazowy", "METAL"), ("pastry baker / welder", "METAL"), ("Baker", "FOOD"), ("bakery", "OTHER"), (None, "OTHER")]


@query(_made("orders", "o_orderkey", ROLES, "industry"))
def role_industry(spark, d) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", of.first_category(chosen(F.col("o_orderkey"), [r for r, _ in ROLES]), [("METAL", ["welder", "spawacz"]), ("FOOD", ["baker"])], "OTHER").alias("industry"))


@query("""
WITH l AS (SELECT c_nationkey AS s, c_custkey AS k, c_name AS v FROM customer WHERE c_custkey % 4 > 0), i AS (SELECT c_nationkey AS s, c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN c_name || '!' ELSE c_name END AS v FROM customer WHERE c_custkey % 5 > 0)
SELECT coalesce(l.s, i.s) AS s, sum((l.k IS NULL)::INT)::BIGINT AS added, sum((l.k IS NOT NULL AND i.k IS NOT NULL AND l.v <> i.v)::INT)::BIGINT AS changed, sum((l.v = i.v)::INT)::BIGINT AS same, sum((i.k IS NULL)::INT)::BIGINT AS only_here FROM l FULL JOIN i ON l.s = i.s AND l.k = i.k GROUP BY 1
""".replace("sum((l.v = i.v)::INT)", "sum(coalesce(l.v = i.v, false)::INT)"))
def merge_summary(spark, d) -> DataFrame:
    c = read(spark, d, "customer").select(F.col("c_nationkey").alias("s"), F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    changed = c.where("k % 5 > 0").withColumn("v", F.when(F.col("k") % 3 == 0, F.concat("v", F.lit("!"))).otherwise(F.col("v")))
    return of.merge_summary(c.where("k % 4 > 0"), changed, ["s", "k"], "s", "v")


@query("""
WITH m AS (SELECT l_orderkey, l_partkey % 4 AS rule, CASE l_returnflag WHEN 'A' THEN CASE WHEN l_linestatus = 'O' THEN 3 ELSE 2 END WHEN 'R' THEN 1 END AS r FROM lineitem), s AS (SELECT l_orderkey, rule, max(r) AS r FROM m GROUP BY 1, 2 HAVING max(r) IS NOT NULL)
SELECT l_orderkey, rule, CASE r WHEN 3 THEN 'REQUIRED' WHEN 2 THEN 'PREFERRED' ELSE 'INFORMATION' END AS status FROM s WHERE NOT (rule = 0 AND EXISTS (SELECT 1 FROM s t WHERE t.l_orderkey = s.l_orderkey AND t.rule IN (1, 2) AND t.r = 3))
""")
def rule_severity(spark, d) -> DataFrame:
    """What rules come to by their mentions; a general rule goes beside a required special one."""
    flag = F.when(F.col("l_returnflag") == "A", F.when(F.col("l_linestatus") == "O", "REQUIRED").otherwise("PREFERRED")).when(F.col("l_returnflag") == "R", "INFORMATION").otherwise("NEGATED")
    m = read(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") % 4).alias("rule"), flag.alias("p"))
    return of.rule_status(m, ["l_orderkey"], "rule", "p", spark.createDataFrame([(1, 0), (2, 0)], "rule long, parent long"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"id\":' || event_id || ',\"k\":' || json_extract(props, '$.k') || '}' AS doc FROM events")
def json_fields(spark, d) -> DataFrame:
    """A field of a JSON document, and a document built from columns."""
    e = read(spark, d, "events").select("event_id", vw.json_element(F.col("props"), "k", "long").alias("k"))
    return e.select("event_id", "k", vw.json_document({"id": F.col("event_id"), "k": F.col("k")}).alias("doc"))


@query("""
SELECT o_custkey, 'role' AS source, 0.9::DOUBLE AS depth, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT o_custkey, 'point', 0.7::DOUBLE, count(*) FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 UNION ALL SELECT c_custkey, 'skill', 0.5::DOUBLE, 2 FROM customer
""")
def flattened_evidence(spark, d) -> DataFrame:
    """A profile's parts as rows of evidence, each with the depth of its kind."""
    o, li, c = read(spark, d, "orders").select("o_custkey", "o_orderkey"), read(spark, d, "lineitem").select("l_orderkey"), read(spark, d, "customer")
    skills = c.select(F.col("c_custkey").alias("o_custkey"), F.explode(F.array("c_name", "c_mktsegment")))
    rows = vw.flattened({"role": (o, 0.9), "point": (li.join(o, F.col("l_orderkey") == F.col("o_orderkey")), 0.7), "skill": (skills, 0.5)}, "o_custkey")
    return rows.groupBy("o_custkey", "source", "depth").agg(F.count("*").alias("n"))


@query("""
WITH m AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' END AS status, coalesce(nullif(o_orderkey % 10, 0), 5) AS priority FROM orders)
SELECT o_orderkey, status, priority, CASE WHEN status IS NULL THEN 'status' WHEN priority > 8 THEN 'priority' ELSE '' END AS quarantined FROM m
""")
def migrated_records(spark, d) -> DataFrame:
    """Records in a newer form: states renamed, defaults filled in; what can't be is set aside with the rule it breaks."""
    rows = read(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.nullif(F.col("o_orderkey") % 10, F.lit(0)).alias("priority"))
    return vw.migrated(rows, {"F": "done", "O": "open"}, "status", {"priority": F.lit(5)}, {"status": "status IS NOT NULL", "priority": "priority <= 8"})


@query(r"""
SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS BIGINT) AS n_emails, CAST(len(regexp_extract_all(coalesce(text, ''), '\+?[0-9](?:[ -]?[0-9]){8,14}')) AS BIGINT) AS n_phones,
  CAST(len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '')) AS BIGINT) AS n_blocks, length(coalesce(text, '')) < n_chars AS lost FROM documents
""")
def text_contacts(spark, d) -> DataFrame:
    """Addresses, phones and lines that a text holds, and whether it lost characters."""
    return vw.text_contacts(read(spark, d, "documents").select("doc_id", "text", "n_chars"), "text", "n_chars").drop("text", "n_chars")


TERMS = [("Łódź - CENTRUM, ul.", "lodz - centrum ul"), ("  Żółty   kot ", "zolty kot"), ("C++/C#", "c c"), (None, None)]


@query(_made("customer", "c_custkey", TERMS, "term"))
def normal_terms(spark, d) -> DataFrame:
    return read(spark, d, "customer").select("c_custkey", tx.normal_term(chosen(F.col("c_custkey"), [t for t, _ in TERMS])).alias("term"))


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_type, event_id) AS INTEGER) AS place FROM events")
def calendar_order(spark, d) -> DataFrame:
    """Places of events within their day: by instant, then title, then id."""
    return vw.calendar_places(read(spark, d, "events").select("event_id", "ts", "event_type"), F.to_date("ts"), ["ts", "event_type", "event_id"]).select("event_id", "place")


@query("""
WITH u AS (SELECT l_partkey AS p_partkey, max(l_quantity)::DOUBLE AS v FROM lineitem WHERE l_quantity > 45 GROUP BY 1)
SELECT coalesce(p.p_partkey, u.p_partkey) AS p_partkey, CASE WHEN p.p_partkey IS NULL THEN 'NEW' WHEN v IS NULL THEN 'SAME' WHEN p_size > 45 THEN 'PENDING' ELSE 'UPDATED' END AS state, CASE WHEN p_size > 45 THEN p_size::DOUBLE ELSE coalesce(v, p_size::DOUBLE) END AS size FROM part p FULL JOIN u ON u.p_partkey = p.p_partkey
""")
def proposal_queue(spark, d) -> DataFrame:
    """Parts whose size lines change, by id, and those whose change waits to be agreed to."""
    changes = read(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"), F.col("l_quantity").cast("double").alias("size"))
    parts = read(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"))
    return vw.proposals(parts, changes, "p_partkey", "size", F.col("size") > 45)


@query("WITH a AS (SELECT DISTINCT p_type AS canonical, lower(p_name) AS alt FROM part WHERE lower(p_name) <> lower(p_type)) SELECT canonical, count(*) AS n, string_agg(alt, '|' ORDER BY alt) AS labels FROM a GROUP BY 1")
def skill_synonyms(spark, d) -> DataFrame:
    """A skill's other labels, each once, all of them; its own name in any case of letters is none."""
    derived = F.lower("p_name") == F.lower("p_type")
    found = vw.skill_labels(read(spark, d, "part").select(F.col("p_type").alias("canonical"), "p_type", "p_name"), "canonical", "p_name", derived)
    return found.select("canonical", "n", F.array_join("labels", "|").alias("labels"))


@query("""
WITH f AS (SELECT l_orderkey, l_partkey % 6 AS rule, l_returnflag = 'R' AS blocking, l_linestatus = 'O' AS confirmed FROM lineitem)
SELECT l_orderkey, coalesce(string_agg(DISTINCT CAST(rule AS VARCHAR), ',' ORDER BY CAST(rule AS VARCHAR)) FILTER (blocking AND confirmed), '') AS unmet, coalesce(string_agg(DISTINCT CAST(rule AS VARCHAR), ',' ORDER BY CAST(rule AS VARCHAR)) FILTER (blocking AND NOT confirmed), '') AS unconfirmed FROM f GROUP BY 1
""")
def unmet_requirements(spark, d) -> DataFrame:
    """Blocking rules that are not met, and those of which nothing is known."""
    f = read(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") % 6).cast("string").alias("rule"), "l_returnflag", "l_linestatus")
    found = vw.blocking_requirements(f, ["l_orderkey"], "rule", F.col("l_returnflag") == "R", F.col("l_linestatus") == "O")
    return found.select("l_orderkey", F.array_join("unmet", ",").alias("unmet"), F.array_join("unconfirmed", ",").alias("unconfirmed"))