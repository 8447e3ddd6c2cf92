"""Queries over files and helpers of profiles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyroom.operators import dictionary as di
from tallyroom.operators import profiles as pr
from tallyroom.operators.tables import shared_folder
from tallyroom.plans.filters import chosen, made
from tallyroom.plans.registry import query, r6
from tallyroom.plans.texts import DOMAIN, _plain
from tallyroom.sources import html, tables
from tallyroom.sources.tables import read


def _file(spark, df: DataFrame, kind: str, **options) -> str:
    """A table as a file of the shared folder."""
    path = f"{shared_folder(spark)}/tallyroom/{uuid.uuid4().hex}"
    df.write.format(kind).options(**options).save(path)
    return path


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'bad' ELSE 'good' END AS kind, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name || ', ' || chr(34) || 'quoted' || chr(34) || chr(10) || 'second line' END AS name FROM customer")
def csv_records(spark, d) -> DataFrame:
    """A CSV file with quotes, commas, line breaks and records that don't fit, written and read back."""
    k = F.col("c_custkey")
    rows = read(spark, d, "customer").select(F.when(k % 7 == 0, F.concat(F.lit("no"), k.cast("string"))).otherwise(k.cast("string")).alias("c_custkey"), F.concat("c_name", F.lit(', "quoted"\nsecond line')).alias("name"))
    good, bad = tables.read_records(spark, _file(spark, rows, "csv", header="true", escape='"', quoteAll="true"), T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("name", T.StringType())]), "csv", line_breaks=True)
    lost = bad.select(F.regexp_extract("line", "no([0-9]+)", 1).cast("long").alias("c_custkey"), F.lit("bad").alias("kind"), F.lit(None).cast("string").alias("name"))
    return good.select("c_custkey", F.lit("good").alias("kind"), "name").union(lost)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT -o_orderkey, NULL FROM orders WHERE o_orderkey % 5 = 0")
def json_records(spark, d) -> DataFrame:
    """JSON lines with broken ones among them; the broken lines' keys are shown below 0."""
    k = F.col("o_orderkey")
    line = F.when(k % 5 == 0, F.concat(F.lit('{"o_orderkey": '), k.cast("string"))).otherwise(F.to_json(F.struct("o_orderkey", "o_totalprice")))
    good, bad = tables.read_records(spark, _file(spark, read(spark, d, "orders").select(line.alias("value")), "text"), T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_totalprice", T.DoubleType())]))
    return good.union(bad.select(-F.regexp_extract("line", "([0-9]+)", 1).cast("long"), F.lit(None).cast("double")))


@query("""
WITH w AS (SELECT DISTINCT lower(unnest(string_split(p_name, ' '))) AS form FROM part)
SELECT form || 'ł' AS form, form AS lemma, 'subst' AS tag, 0 AS ord, form || 'l' AS folded FROM w
""".replace(", 0 AS ord", ""))
def lexicon_import(spark, d) -> DataFrame:
    """Tab-separated forms: of two readings the higher tag's, without lines that have spaces, unknown tags or too few fields."""
    w = read(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("w")).distinct()
    lines = F.array(F.concat_ws("\t", F.concat("w", F.lit("Ł")), "w", F.lit("subst:sg")), F.concat_ws("\t", F.concat("w", F.lit("ł")), F.lit("other"), F.lit("adj")), F.concat_ws("\t", F.concat("w", F.lit(" x")), "w", F.lit("subst")), F.concat_ws("\t", "w", "w", F.lit("zzz")), F.concat_ws("\t", "w", "w"))
    return tables.read_lexicon(spark, _file(spark, w.select(F.explode(lines).alias("value")), "text"), ["subst", "adj"]).select("form", "lemma", "tag", "folded")


@query("""SELECT c_custkey, '{"@context":"https://schema.org","@type":"Person","name":"' || c_name || '"' || CASE WHEN c_custkey % 3 > 0 THEN ',"worksFor":"' || c_mktsegment || '"' ELSE '' END || '}' AS json_ld FROM customer""")
def json_ld_records(spark, d) -> DataFrame:
    c = read(spark, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("seg"))
    return tables.json_ld(c, {"name": "c_name", "worksFor": "seg"}, "Person").select("c_custkey", "json_ld")


@query("""
WITH p AS (SELECT DISTINCT p_brand, p_type, split_part(p_name, ' ', 2) AS tool FROM part)
SELECT p_brand AS source, 'requires_skill' AS type, p_type AS target FROM p UNION SELECT p_brand, 'used_by', tool FROM p UNION SELECT 'entity', 'profession', p_brand FROM p UNION SELECT 'entity', 'skill', p_type FROM p UNION SELECT 'entity', 'tool', tool FROM p
""")
def seed_import(spark, d) -> DataFrame:
    """Entities and relations of seed documents that are made of the brands."""
    p = read(spark, d, "part").groupBy(F.col("p_brand").alias("name")).agg(F.collect_set("p_type").alias("skills"), F.collect_set(F.split("p_name", " ")[1]).alias("tools"))
    entities, relations = tables.read_seeds(spark, _file(spark, p.select(F.to_json(F.struct("name", "skills", "tools")).alias("value")), "text"))
    return relations.union(entities.select(F.lit("entity"), "kind", "name"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 1 END AS version FROM orders UNION ALL SELECT -o_orderkey - 1, o_totalprice, 1 FROM orders WHERE o_orderkey % 10 = 0")
def upserted_rows(spark, d) -> DataFrame:
    """Changed, new and stale rows put into a table."""
    o = read(spark, d, "orders").select("o_orderkey", "o_totalprice", F.lit(1).alias("version"))
    k = F.col("o_orderkey")
    changes = o.where(k % 4 == 0).select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit(2).alias("version")).union(o.where(k % 10 == 0).select(-k - 1, "o_totalprice", "version")).union(o.where(k % 3 == 0).select("o_orderkey", F.lit(0.0), F.lit(0)))
    return tables.upserted(o, changes, ["o_orderkey"], "version")


SHELLS = [('<div id="root"></div><script>x()</script>', True), ("<body>" + "word " * 80 + "</body>", False), ('<div id="app">Loading</div><p>' + "word " * 80 + "</p>", True), ("", False)]


@query(f"SELECT page_id, length({_plain('html')}) < 250 AS shell, CASE WHEN {DOMAIN} LIKE '%.com' OR {DOMAIN} = 'com' THEN 'Commerce' WHEN {DOMAIN} LIKE '%.org' THEN 'Organisations' END AS portal FROM pages UNION ALL SELECT k, shell, portal FROM {made([(-i, s, 'Commerce') for i, (_, s) in enumerate(SHELLS, 1)], 'k, shell, portal')}")
def page_shells(spark, d) -> DataFrame:
    """Pages that a script fills in, and the portal that they are of."""
    rows = spark.createDataFrame([(-i, "https://shop.com/x", h) for i, (h, _) in enumerate(SHELLS, 1)], "page_id long, url string, html string")
    pages = read(spark, d, "pages").select("page_id", "url", "html").unionByName(rows)
    return pages.select("page_id", html.is_shell(F.col("html")).alias("shell"), html.portal_of(F.col("url"), [("com", "Commerce"), ("org", "Organisations")]).alias("portal"))


#: Files of hosts, by the length of their name.
ROBOTS = [
    "User-agent: *\nDisallow: /fr/\n\nUser-agent: tally # and its like\nDisallow: /en/2*7\nAllow: /en/2", "User-agent: *\nDisallow: /*?page=\nDisallow: /de/$", "User-agent: *\nDisallow: /\nUser-agent: tallyroombot\nDisallow:",
    "User-agent: bot\nDisallow: /en/\nUser-agent: tal\nDisallow: /de/\nUser-agent: BOT\nAllow: /en/1", None,
]


@query(r"""
WITH u AS (SELECT DISTINCT url, regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#]+)', 1) AS host, regexp_extract(url, '^[^:]+://[^/?#]*([^#]*)', 1) AS path FROM pages WHERE url IS NOT NULL)
SELECT url, NOT CASE length(host) % 5 WHEN 0 THEN regexp_matches(path, '^/en/2.*7') WHEN 1 THEN regexp_matches(path, '^/.*[?]page=|^/de/$') WHEN 2 THEN regexp_matches(path, '^/') WHEN 3 THEN regexp_matches(path, '^/en/') AND NOT regexp_matches(path, '^/en/1') ELSE false END AS allowed FROM u
""")
def robots_access(spark, d) -> DataFrame:
    """Pages that their hosts' robots files, parsed for one agent, let it fetch."""
    urls = read(spark, d, "pages").select("url", F.regexp_extract(F.lower("url"), "^[a-z][a-z0-9+.-]*://([^/?#]+)", 1).alias("host"), F.regexp_extract("url", "^[^:]+://[^/?#]*([^#]*)", 1).alias("path")).where("url IS NOT NULL").distinct()
    files = urls.select("host").distinct().withColumn("text", chosen(F.length("host"), ROBOTS))
    return html.robots(html.robots_rules(files, "TallyroomBot/1.0"), urls)


@query("""
WITH l AS (SELECT c_nationkey AS section, c_custkey AS k, c_name AS v FROM customer WHERE c_custkey % 3 < 2), i AS (SELECT c_nationkey AS section, c_custkey AS k, c_name || '!' AS v FROM customer WHERE c_custkey % 3 > 0)
SELECT coalesce(l.section, i.section) AS section, coalesce(l.k, i.k) AS k, CASE WHEN coalesce(l.section, i.section) = 2 THEN i.v ELSE coalesce(l.v, i.v) END AS v FROM l FULL JOIN i ON l.k = i.k
WHERE CASE coalesce(l.section, i.section) WHEN 1 THEN l.k IS NOT NULL WHEN 2 THEN i.k IS NOT NULL OR l.section NOT IN (SELECT section FROM i) ELSE true END
""")
def imported_sections(spark, d) -> DataFrame:
    """Rows here and rows that come in, by each section's strategy."""
    c = read(spark, d, "customer").select(F.col("c_nationkey").alias("section"), F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    return pr.apply_import(c.where("k % 3 < 2"), c.where("k % 3 > 0").withColumn("v", F.concat("v", F.lit("!"))), ["section", "k"], "section", {1: "keep", 2: "replace"})


@query("""
WITH s AS (SELECT o_custkey, o_orderkey AS snap, o_orderdate FROM orders WHERE o_orderkey % 3 = 0), r AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey - o_orderkey % 3 + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END END AS ref FROM orders),
n AS (SELECT o_custkey, arg_max(snap, (o_orderdate, snap)) AS newest FROM s GROUP BY 1)
SELECT o_orderkey, CASE WHEN ref IS NULL THEN 'NONE' WHEN ref NOT IN (SELECT snap FROM s) THEN 'BROKEN' ELSE 'OK' END AS state, CASE WHEN ref IS NOT NULL AND ref NOT IN (SELECT snap FROM s) THEN newest ELSE ref END AS relinked FROM r LEFT JOIN n USING (o_custkey)
""")
def snapshot_references(spark, d) -> DataFrame:
    """Records whose snapshot is gone, and the owner's newest for them."""
    o, k = read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), F.col("o_orderkey")
    snaps = o.where(k % 3 == 0).select("o_custkey", k.alias("snap"), "o_orderdate")
    rows = o.select("o_orderkey", "o_custkey", F.when(k % 7 > 0, k - k % 3 + F.when(k % 5 == 0, 1).otherwise(0)).alias("ref"))
    return pr.references(rows, "o_orderkey", "ref", snaps, "o_custkey", "snap", "o_orderdate")


@query("SELECT conv_id, coalesce(string_agg(t, chr(10) ORDER BY turn), '') AS text FROM (SELECT conv_id, turn, nullif(trim(CASE WHEN turn % 4 = 1 THEN 'turn ' || turn ELSE text END), '') AS t FROM conversations) GROUP BY 1")
def rendered_texts(spark, d) -> DataFrame:
    """Conversations as plain text, with other words for some turns."""
    turn = F.col("turn")
    return pr.rendered(read(spark, d, "conversations").select("conv_id", "turn", "text"), ["conv_id"], ["turn"], F.col("text"), F.when(turn % 4 == 1, F.concat(F.lit("turn "), turn.cast("string"))))


@query("SELECT s_suppkey, 'Why ' || s_name || ' in ' || CASE WHEN s_suppkey % 3 = 0 THEN '...' ELSE 'nation ' || s_nationkey END || ', ' || s_name || '?' AS question FROM supplier")
def injected_questions(spark, d) -> DataFrame:
    s = read(spark, d, "supplier")
    place = F.when(F.col("s_suppkey") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")))
    return s.select("s_suppkey", pr.injected_tokens(F.lit("Why {name} in {place}, {name}?"), {"name": F.col("s_name"), "place": place}).alias("question"))


@query("""
WITH c AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) SELECT c_custkey, 'balance' AS check, CASE WHEN c_acctbal > 0 THEN 'OK' WHEN c_acctbal > -500 THEN 'WARN' ELSE 'FAIL' END AS status FROM customer
UNION ALL SELECT c_custkey, 'orders', CASE WHEN n >= 10 THEN 'OK' WHEN n >= 5 THEN 'WARN' ELSE 'FAIL' END FROM c
""".replace("AS check,", 'AS "check",'))
def preflight(spark, d) -> DataFrame:
    n = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    c = read(spark, d, "customer").select("c_custkey", "c_acctbal").join(n, "c_custkey", "left").fillna(0, ["n"])
    return pr.checklist(c, "c_custkey", {"balance": (F.col("c_acctbal") > 0, F.col("c_acctbal") > -500), "orders": (F.col("n") >= 10, F.col("n") >= 5)})


@query("""
WITH q(q) AS (VALUES ('7'), ('GERMANY'), ('uni'), ('china-town'), ('xyz'), ('Nation#3'), ('nation#00')), n AS (SELECT CAST(n_nationkey AS VARCHAR) AS id, lower(n_name) AS n FROM nation),
h AS (SELECT q, id, n, CASE WHEN lower(q) = id THEN 1 WHEN lower(q) = n THEN 2 WHEN starts_with(n, lower(q)) OR starts_with(lower(q), n) THEN 3 END AS way FROM q, n)
SELECT q, arg_min(id, (way, n, id)) AS place FROM h WHERE way IS NOT NULL GROUP BY 1
""")
def place_lookup(spark, d) -> DataFrame:
    queries = spark.createDataFrame([(x,) for x in ("7", "GERMANY", "uni", "china-town", "xyz", "Nation#3", "nation#00")], "q string")
    return pr.looked_up(queries, read(spark, d, "nation"), "q", "n_nationkey", "n_name")


_PLACED = " UNION ALL ".join(f"SELECT *, '{t}' AS term, regexp_extract(low, '(?:^|[^\\p{{L}}\\p{{N}}_#+]){t}(?:[0-9]+(?:\\.[0-9]+)*)?(?:[^\\p{{L}}\\p{{N}}_#+]|$)') AS m FROM f" for t in ("und", "the"))


@query(f"""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line, unnest(string_split(coalesce(text, ''), chr(10))) AS x FROM documents), f AS (SELECT *, replace(strip_accents(lower(x)), 'ł', 'l') AS low FROM l), p AS ({_PLACED}),
h AS (SELECT doc_id, line, term, substr(x, CAST(greatest(1, instr(low, m) + (NOT starts_with(m, term))::INT - 20) AS INTEGER), 40 + length(term)) AS excerpt FROM p WHERE m <> '')
SELECT doc_id, term, count(*) AS n_lines, CAST(min(line) AS INTEGER) AS first, arg_min(excerpt, line) AS excerpt FROM h GROUP BY 1, 2
""")
def keyword_map(spark, d) -> DataFrame:
    """Where terms stand in each document, with the text around the first."""
    return di.keyword_map(read(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", ["und", "the"])


@query("""
WITH e AS (SELECT l_orderkey AS id, l_suppkey AS owner, l_discount, l_quantity FROM lineitem), v AS (SELECT id, 'RANGE' AS violation FROM e WHERE NOT l_discount BETWEEN 0.01 AND 0.09 UNION SELECT id, 'AMOUNT' FROM e WHERE NOT l_quantity > 2)
SELECT * FROM v UNION ALL SELECT id, 'DUPLICATE' FROM e GROUP BY id HAVING count(*) > 1 UNION ALL SELECT id, 'TWO_OWNERS' FROM e GROUP BY id HAVING min(owner) <> max(owner)
""")
def evidence_violations(spark, d) -> DataFrame:
    e = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("owner"), "l_discount", "l_quantity")
    return pr.evidence_violations(e, "id", "owner", {"RANGE": F.col("l_discount").between(0.01, 0.09), "AMOUNT": F.col("l_quantity") > 2})


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(1 - l_discount * 3 >= 0.85, false) AS order_used, round(CASE WHEN 1 - l_discount * 3 >= 0.85 THEN l_quantity / 50 ELSE greatest(0, l_quantity / 50 - 0.2) END, 6) AS fulfilled FROM lineitem
""")
def strict_signals(spark, d) -> DataFrame:
    """Order evidence that is not sure enough is left out."""
    s = pr.strict_signals(F.lit(1.0), F.lit(0.2), F.col("l_quantity") / 50, 1 - F.col("l_discount") * 3)
    return r6(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", s.alias("s")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "s.*"))


@query("""
WITH x AS (SELECT c_nationkey, c_mktsegment AS domain, CASE WHEN avg(c_acctbal) > 3000 THEN least(100, avg(c_acctbal) / 80) END AS score, bool_or(c_acctbal < -900) AS blocked FROM customer GROUP BY 1, 2),
w AS (SELECT *, CASE domain WHEN 'BUILDING' THEN 3.0::DOUBLE WHEN 'HOUSEHOLD' THEN 2.0::DOUBLE WHEN 'MACHINERY' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS w FROM x)
SELECT c_nationkey, round(CASE WHEN sum(w) FILTER (score IS NOT NULL) > 0 THEN least(exp(sum(w * ln(score + 1)) FILTER (score IS NOT NULL) / nullif(sum(w) FILTER (score IS NOT NULL), 0)) - 1, coalesce(min(CASE WHEN blocked THEN 45.0::DOUBLE END), 100)) END, 6) AS score, count(score) AS n_domains,
  coalesce(string_agg(CASE WHEN score IS NULL THEN domain END, ',' ORDER BY domain), '') AS missing FROM w GROUP BY 1
""")
def global_consensus(spark, d) -> DataFrame:
    """A score over domains, with the domains that have none."""
    a = F.avg("c_acctbal")
    x = read(spark, d, "customer").groupBy("c_nationkey", F.col("c_mktsegment").alias("domain")).agg(F.when(a > 3000, F.least(F.lit(100.0), a / 80)).alias("score"), F.bool_or(F.col("c_acctbal") < -900).alias("blocked"))
    return r6(pr.global_consensus(x, ["c_nationkey"], {"BUILDING": 3.0, "HOUSEHOLD": 2.0, "MACHINERY": 1.0}, F.when(F.col("blocked"), 45.0)))


RULES = [
    ("strict", "mail", "[a-z0-9.]+@[a-z0-9.]+", "required"), ("strict", "number", "[0-9]{4}", "advised"), ("strict", "markup", "[<>{}]", "forbidden"),
    ("plain", "number", "[0-9]{4}", "forbidden"), ("plain", "list", "(?m)^[-*]", "advised"), ("any", "mail", "[a-z0-9.]+@[a-z0-9.]+", "advised"), ("any", "sentence", "[a-z][.]", "required"),
]


def _rules_sql() -> str:
    part = lambda rows: "concat_ws('|', " + ", ".join(f"CASE WHEN {'NOT ' if no else ''}regexp_matches(t, '{p}') THEN '{f}' END" for f, p, no in rows) + ")" if rows else "''"
    out = []
    for profile in ("strict", "plain", "any"):
        own = [r[1:] for r in RULES if r[0] == profile]
        missing = part([(f, p, k == "required") for f, p, k in own if k != "advised"])
        out.append(f"SELECT doc_id, '{profile}' AS profile, {part([(f, p, False) for f, p, _ in own])} AS found, {missing} AS missing, {part([(f, p, True) for f, p, k in own if k == 'advised'])} AS advice, {missing} = '' AS passed FROM d")
    return "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents) " + " UNION ALL ".join(out)


@query(_rules_sql())
def rule_profiles(spark, d) -> DataFrame:
    """Documents against three profiles of rules."""
    found = pr.rule_profiles(read(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", RULES)
    return found.select("doc_id", "profile", *[F.array_join(c, "|").alias(c) for c in ("found", "missing", "advice")], "passed")
