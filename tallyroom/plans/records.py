"""Queries over records, rules and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroom.functions import dates as dt
from tallyroom.functions import rules as ru
from tallyroom.functions.text import let, plain_tokens, token_runs
from tallyroom.operators import events as ev
from tallyroom.operators import records as rc
from tallyroom.operators.tables import parts_for
from tallyroom.plans.registry import micros, month, month_sql, query, r6
from tallyroom.sources.tables import read

HOUR = 3_600_000_000


@query("""
WITH l AS (SELECT c_custkey AS k, md5(c_name || c_mktsegment) AS a FROM customer WHERE c_acctbal < 5000), c AS (SELECT c_custkey AS k, md5(c_name || CASE WHEN c_nationkey = 3 THEN 'X' ELSE c_mktsegment END) AS b FROM customer WHERE c_acctbal > 0)
SELECT coalesce(l.k, c.k) AS c_custkey, CASE WHEN c.k IS NULL THEN 'PUSH' WHEN l.k IS NULL THEN 'PULL' WHEN a = b THEN 'SAME' ELSE 'CONFLICT' END AS decision FROM l FULL JOIN c ON l.k = c.k
""")
def reconciled(spark, d) -> DataFrame:
    c = read(spark, d, "customer")
    local = c.where("c_acctbal < 5000").select("c_custkey", F.md5(F.concat("c_name", "c_mktsegment")).alias("s"))
    cloud = c.where("c_acctbal > 0").select("c_custkey", F.md5(F.concat("c_name", F.when(F.col("c_nationkey") == 3, "X").otherwise(F.col("c_mktsegment")))).alias("s"))
    return rc.reconcile(local, cloud, "c_custkey", "s")


@query("""
WITH e AS (SELECT o_orderkey, o_orderstatus AS s FROM orders WHERE o_totalprice > 50000), a AS (SELECT l_orderkey AS o_orderkey, max(l_linestatus) AS s FROM lineitem GROUP BY 1)
SELECT coalesce(e.o_orderkey, a.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'MISSING' WHEN e.o_orderkey IS NULL THEN 'EXTRA' ELSE 'CHANGED' END AS finding FROM e FULL JOIN a ON e.o_orderkey = a.o_orderkey WHERE a.o_orderkey IS NULL OR e.o_orderkey IS NULL OR e.s <> a.s
""")
def projection_consistency(spark, d) -> DataFrame:
    """Orders' states against those of their lines."""
    e = read(spark, d, "orders").where("o_totalprice > 50000").select("o_orderkey", F.col("o_orderstatus").alias("s"))
    a = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linestatus").alias("s"))
    return rc.consistency(e, a, ["o_orderkey"], "s")


@query("""
WITH k AS (SELECT doc_id, md5(text) AS a, lower(source) || '|' || CAST(n_chars AS VARCHAR) AS b FROM documents), f AS (SELECT a, min(doc_id) AS x FROM k WHERE a IS NOT NULL GROUP BY 1), g AS (SELECT b, min(doc_id) AS x FROM k WHERE b IS NOT NULL GROUP BY 1)
SELECT k.doc_id, CASE WHEN f.x < k.doc_id THEN f.x ELSE g.x END AS "of", CASE WHEN f.x < k.doc_id THEN 'text' ELSE 'size' END AS "by" FROM k LEFT JOIN f USING (a) LEFT JOIN g USING (b) WHERE f.x < k.doc_id OR g.x < k.doc_id
""")
def duplicate_records(spark, d) -> DataFrame:
    """Documents that an earlier one repeats: by text, else by source and size."""
    docs = read(spark, d, "documents")
    return rc.duplicates(docs, "doc_id", {"text": F.md5("text"), "size": F.concat(F.lower("source"), F.lit("|"), F.col("n_chars").cast("string"))})


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 7)")
def missing_evidence(spark, d) -> DataFrame:
    """Parts that were never the seventh line of an order and sent back."""
    required = read(spark, d, "part").select("p_partkey")
    return rc.missing(required, read(spark, d, "lineitem").where("l_returnflag = 'R' AND l_linenumber = 7").select(F.col("l_partkey").alias("p_partkey")), ["p_partkey"])


def _windows(of: str, name: str) -> str:
    """Runs of one to four words, by neighbours."""
    lead = [f"lead(t, {k}) OVER (PARTITION BY id ORDER BY i) AS t{k}" for k in (1, 2, 3)]
    rows = ["SELECT id, i, 1 AS n, t AS phrase FROM {0}l", "SELECT id, i, 2, t || ' ' || t1 FROM {0}l WHERE t1 IS NOT NULL", "SELECT id, i, 3, t || ' ' || t1 || ' ' || t2 FROM {0}l WHERE t2 IS NOT NULL", "SELECT id, i, 4, t || ' ' || t1 || ' ' || t2 || ' ' || t3 FROM {0}l WHERE t3 IS NOT NULL"]
    return f"{name}l AS (SELECT *, {', '.join(lead)} FROM {of}), {name} AS ({' UNION ALL '.join(r.format(name) for r in rows)})"


WORDS = r"list_filter(regexp_split_to_array(replace(strip_accents(lower(coalesce(text, ''))), 'ł', 'l'), '[^\p{L}\p{N}]+'), lambda t: t <> '')"


@query(f"""
WITH w AS (SELECT conv_id, turn, unnest({WORDS}) AS token FROM conversations), l AS (SELECT token AS form, left(token, 4) AS lemma FROM w WHERE length(token) > 6 GROUP BY 1)
SELECT coalesce(lemma, token) AS lemma, count(*) AS n FROM w LEFT JOIN l ON token = form GROUP BY 1
""")
def lemma_counts(spark, d) -> DataFrame:
    """Words by lemma, with a lexicon made of the long words."""
    w = read(spark, d, "conversations").select(F.explode(plain_tokens(F.col("text"))).alias("token"))
    lexicon = w.where("length(token) > 6").distinct().select(F.col("token").alias("form"), F.substring("token", 1, 4).alias("lemma"))
    return rc.lemmas(w, lexicon).groupBy("lemma").agg(F.count("*").alias("n"))


@query(f"""
WITH b AS (SELECT item_id AS id, unnest({WORDS}) AS t, generate_subscripts({WORDS}, 1) AS i FROM benchmark), c AS (SELECT doc_id AS id, unnest({WORDS}) AS t, generate_subscripts({WORDS}, 1) AS i FROM documents),
{_windows("b", "bw")}, {_windows("c", "cw")},
p AS (SELECT phrase, CAST(min(id) AS VARCHAR) AS canonical FROM bw WHERE n IN (2, 4) GROUP BY 1),
h AS (SELECT id, cw.phrase, canonical, i, row_number() OVER (PARTITION BY id ORDER BY n DESC, i) AS r FROM cw JOIN p ON cw.phrase = p.phrase)
SELECT id AS doc_id, phrase, canonical, CAST(i AS INTEGER) AS start FROM h WHERE r = 1
""")
def longest_phrase(spark, d) -> DataFrame:
    """The longest run of two or four of a document's words that stands in a test item."""
    runs = let(plain_tokens(F.col("text")), lambda w: F.concat(token_runs(w, 2), token_runs(w, 4)))
    grams = read(spark, d, "benchmark").select("item_id", F.explode(runs).alias("g"))
    phrases = grams.groupBy(F.col("g.phrase").alias("phrase")).agg(F.min("item_id").cast("string").alias("canonical"))
    return rc.longest_phrase(read(spark, d, "documents").select("doc_id", "text"), "doc_id", plain_tokens(F.col("text")), phrases, 4)


ASKED = ("small ring", "widget", "blue", "red widget extra", "ar")


@query(f"""
WITH q(query) AS (VALUES {", ".join(f"('{x}')" for x in ASKED)}), n AS (SELECT min(p_partkey) AS id, lower(p_name) AS t FROM part GROUP BY 2), w AS (SELECT DISTINCT id, unnest(string_split(t, ' ')) AS t FROM n),
s AS (SELECT query, id, 15 AS s FROM q JOIN n ON query = t UNION ALL SELECT query, w.id, 8 FROM (SELECT DISTINCT query, unnest(string_split(query, ' ')) AS x FROM q) JOIN w ON x = w.t WHERE length(w.t) > 2 UNION ALL SELECT query, id, 3 FROM q JOIN n ON query <> t AND length(query) >= 3 AND length(t) >= 3 AND (contains(query, t) OR contains(t, query)))
SELECT query, id, CAST(sum(s) AS BIGINT) AS score FROM s GROUP BY 1, 2
""")
def index_search(spark, d) -> DataFrame:
    names = read(spark, d, "part").groupBy(F.lower("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))
    queries = spark.createDataFrame([(x,) for x in ASKED], "query string")
    return rc.index_search(queries, rc.inverted_index(names, "id", F.col("name")), "id")


SIGNALS = [("buyer", "a", "g1", 2.0, ["red", "ring"]), ("buyer", "b", "g1", 3.0, ["red", "widget"]), ("buyer", "c", "g2", 1.5, ["small", "blue", "bolt"]), ("maker", "d", "g1", 4.0, ["blue"]), ("maker", "e", "g2", 1.0, ["large"])]


@query(f"""
WITH w AS (SELECT DISTINCT l_orderkey, unnest(string_split(lower(p_name), ' ')) AS w FROM lineitem JOIN part ON l_partkey = p_partkey),
s(role, signal, variants, weight, stem, k) AS (VALUES {", ".join(f"('{r}', '{s}', '{v}', {w}::DOUBLE, '{x}', {len(xs)})" for r, s, v, w, xs in SIGNALS for x in xs)}),
h AS (SELECT l_orderkey, role, signal, variants, weight, k FROM w JOIN s ON w = stem GROUP BY 1, 2, 3, 4, 5, 6 HAVING count(*) = k), b AS (SELECT l_orderkey, role, variants, max(weight * least(k, 4)) AS s FROM h GROUP BY 1, 2, 3), t AS (SELECT l_orderkey, role, sum(s) AS score FROM b GROUP BY 1, 2 HAVING sum(s) >= 4)
SELECT l_orderkey, role, score, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, role) AS INTEGER) AS rank FROM t
""")
def role_scores(spark, d) -> DataFrame:
    li, p = read(spark, d, "lineitem").select("l_orderkey", "l_partkey"), read(spark, d, "part").select("p_partkey", "p_name")
    words = li.join(p, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", F.explode(F.split(F.lower("p_name"), " ")).alias("w"))
    return rc.role_scores(words, spark.createDataFrame(SIGNALS, "role string, signal string, variants string, weight double, stems array<string>"), "l_orderkey", "w", parts=parts_for(li))


@query("""
SELECT DISTINCT x.o_custkey, x.o_orderpriority AS a, y.o_orderpriority AS b FROM orders x JOIN orders y ON x.o_custkey = y.o_custkey
WHERE (x.o_orderpriority = '1-URGENT' AND y.o_orderpriority = '5-LOW') OR (x.o_orderpriority = '2-HIGH' AND y.o_orderpriority = '4-NOT SPECIFIED')
""")
def contradictions(spark, d) -> DataFrame:
    pairs = spark.createDataFrame([("1-URGENT", "5-LOW"), ("2-HIGH", "4-NOT SPECIFIED")], "a string, b string")
    return rc.contradictions(read(spark, d, "orders").select("o_custkey", "o_orderpriority"), pairs, "o_custkey", "o_orderpriority")


@query("""
WITH x AS (SELECT o_custkey, o_orderstatus, o_orderdate, o_orderkey, CASE WHEN o_orderstatus = lag(o_orderstatus) OVER w THEN 0 ELSE 1 END AS o FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_custkey, run, o_orderstatus, count(*) AS n FROM (SELECT *, CAST(sum(o) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS run FROM x) GROUP BY 1, 2, 3
""")
def status_runs(spark, d) -> DataFrame:
    return rc.runs(read(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderdate", "o_orderkey"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderstatus")


@query(r"""
WITH c AS (SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[.;!?\n]+')) AS c FROM documents), s AS (SELECT doc_id, phrase, CASE WHEN regexp_matches(c, ' (?:not|nicht|no|ne) | und ') THEN 1 WHEN regexp_matches(c, ' (?:in|en|mit) ') THEN 2 ELSE 3 END AS k
  FROM c, (VALUES ('the'), ('der'), ('la'), ('of the')) t(phrase) WHERE contains(' ' || c || ' ', ' ' || phrase || ' '))
SELECT doc_id, phrase, CASE max(k) WHEN 1 THEN 'NEGATED' WHEN 2 THEN 'PREFERRED' ELSE 'REQUIRED' END AS status, count(*) AS n FROM s GROUP BY 1, 2
""")
def clause_status(spark, d) -> DataFrame:
    return rc.clause_status(read(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", ["the", "der", "la", "of the"], " (?:not|nicht|no|ne) | und ", " (?:in|en|mit) ")


@query("""
WITH x AS (SELECT doc_id, coalesce(text, '') AS t, source FROM documents), h AS (SELECT doc_id, source, regexp_matches(t, '[0-9]{3}') AS a, regexp_matches(t, '[0-9]') AS b, regexp_matches(t, '@') AS c FROM x)
SELECT doc_id, 'long_number' AS rule, 'BLOCKING' AS severity FROM h WHERE a AND source <> 'src1' UNION ALL SELECT doc_id, 'number', 'OPTIONAL' FROM h WHERE b AND NOT a AND source <> 'src2' UNION ALL SELECT doc_id, 'address', 'BLOCKING' FROM h WHERE c
""")
def knockout_report(spark, d) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "source", "text")
    held = F.when(F.col("source") == "src1", F.array(F.lit("long_number"))).when(F.col("source") == "src2", F.array(F.lit("number"))).otherwise(F.array().cast("array<string>"))
    rules = [("long_number", "[0-9]{3}", "BLOCKING", "number"), ("number", "[0-9]", "OPTIONAL", None), ("address", "@", "BLOCKING", None)]
    return rc.knockouts(docs, "doc_id", F.coalesce("text", F.lit("")), held, rules)


@query("""
WITH a AS (SELECT l_orderkey, 0 AS s, l_linenumber AS ord, 'tax ' || l_linenumber AS problem FROM lineitem WHERE l_tax > 0.07 GROUP BY 1, 2, 3, 4), b AS (SELECT l_orderkey, 1, l_linenumber, 'late ' || l_linenumber FROM lineitem WHERE l_discount > 0.08 GROUP BY 1, 2, 3, 4),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY s, ord, problem) AS rank FROM (SELECT * FROM a UNION ALL SELECT * FROM b))
SELECT l_orderkey, CAST(rank AS INTEGER) AS rank, problem FROM r WHERE rank <= 3
""")
def top_problems(spark, d) -> DataFrame:
    li = read(spark, d, "lineitem")
    make = lambda cond, word: li.where(cond).select("l_orderkey", F.col("l_linenumber").alias("ord"), F.concat(F.lit(word + " "), F.col("l_linenumber").cast("string")).alias("problem")).distinct()
    return rc.top_problems([make("l_tax > 0.07", "tax"), make("l_discount > 0.08", "late")], "l_orderkey")


@query("""
WITH c AS (SELECT conv_id, sum(CASE WHEN role = 'user' THEN length(coalesce(text, '')) ELSE 0 END) AS a, sum(CASE WHEN role = 'user' THEN length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'e', '')) ELSE 0 END) AS ha,
  sum(CASE WHEN role <> 'user' THEN length(coalesce(text, '')) ELSE 0 END) AS b, sum(CASE WHEN role <> 'user' THEN length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'e', '')) ELSE 0 END) AS hb FROM conversations GROUP BY 1)
SELECT conv_id, round((ha / nullif(a, 0)) / nullif(hb / nullif(b, 0), 0), 6) AS density FROM c
""")
def term_density(spark, d) -> DataFrame:
    """How much denser a letter is in questions than in answers."""
    n = F.length(F.coalesce("text", F.lit("")))
    hits = n - F.length(F.replace(F.coalesce("text", F.lit("")), F.lit("e"), F.lit("")))
    user = F.col("role") == "user"
    sums = read(spark, d, "conversations").groupBy("conv_id").agg(F.sum(F.when(user, n).otherwise(0)).alias("a"), F.sum(F.when(user, hits).otherwise(0)).alias("ha"), F.sum(F.when(~user, n).otherwise(0)).alias("b"), F.sum(F.when(~user, hits).otherwise(0)).alias("hb"))
    return r6(sums.select("conv_id", rc.density(F.col("ha"), F.col("a"), F.col("hb"), F.col("b")).alias("density")))


@query("""
WITH u AS (SELECT p_partkey, 'kinds' AS kind, 0 AS ord, p_type AS term FROM part UNION ALL SELECT p_partkey, 'kinds', 1, p_brand FROM part UNION ALL SELECT p_partkey, 'names', 0, p_name FROM part UNION ALL SELECT p_partkey, 'names', 1, upper(p_name) FROM part)
SELECT p_partkey, kind, ord, term FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey, lower(term) ORDER BY kind, ord, term) AS r FROM u) WHERE r = 1
""")
def flattened_claims(spark, d) -> DataFrame:
    p = read(spark, d, "part").select("p_partkey", F.array("p_name", F.upper("p_name")).alias("names"), F.array("p_type", "p_brand").alias("kinds"))
    return rc.flatten_claims(p, "p_partkey", ["kinds", "names"]).select("p_partkey", "kind", "ord", "term")


@query(f"""
WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), p AS (SELECT *, rn <= 8 AND t < 1704672000000000 AS pooled FROM e)
SELECT event_id, user_id, pooled OR row_number() OVER (PARTITION BY user_id, pooled, t // {24 * HOUR} ORDER BY t, event_id) <= 1 AS accepted FROM p
""")
def quota_with_pool(spark, d) -> DataFrame:
    """Eight events of a pool up to a day, then one a day."""
    rows = read(spark, d, "events").select("event_id", "user_id", micros("ts").alias("t"))
    return ev.ordered_fold(rows, "user_id", ["t", "event_id"], "t", rc.pool_rule(8, 1704672000000000, 1, 24 * HOUR), "accepted").drop("t")


@query("SELECT user_id, event_type, least(count(*), 20) AS n FROM events WHERE value BETWEEN 1 AND 200 GROUP BY 1, 2")
def saturating_counters(spark, d) -> DataFrame:
    return read(spark, d, "events").where("value BETWEEN 1 AND 200").groupBy("user_id", "event_type").agg(F.least(F.count("*"), F.lit(20).cast("long")).alias("n"))


# --- dates


@query(f"SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN {month_sql('o_orderdate')} - month(o_orderdate) + 1 ELSE {month_sql('o_orderdate')} END AS month FROM orders")
def parsed_months(spark, d) -> DataFrame:
    """Dates written in five ways, read back as months."""
    k, t = F.col("o_orderkey") % 5, F.col("o_orderdate")
    text = F.when(k == 0, F.date_format(t, "yyyy-MM")).when(k == 1, F.date_format(t, "MM.yyyy")).when(k == 2, F.date_format(t, "MMMM yyyy")).when(k == 3, F.date_format(t, "MM/yyyy")).otherwise(F.date_format(t, "yyyy"))
    return read(spark, d, "orders").select("o_orderkey", dt.parse_month(text).cast("long").alias("month"))


@query("SELECT strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def zone_days(spark, d) -> DataFrame:
    """Events by the day in a zone that is an hour ahead in winter, when all of them happen."""
    return read(spark, d, "events").groupBy(dt.day_in_zone(F.col("ts").cast("timestamp"), "Europe/Warsaw").alias("day")).agg(F.count("*").alias("n"))


@query("""
WITH m AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS m FROM orders), p AS (SELECT m, date_trunc('week', m)::DATE + CAST(i AS INTEGER) AS c FROM m, range(42) t(i))
SELECT strftime(m, '%Y-%m') AS month, strftime(c, '%Y-%m-%d') AS cell, month(c) = month(m) AS inside FROM p
""")
def month_pages(spark, d) -> DataFrame:
    days = read(spark, d, "orders").select(F.trunc("o_orderdate", "month").alias("m")).distinct()
    cells = days.select("m", F.explode(dt.month_page(F.col("m"))).alias("c"))
    return cells.select(F.date_format("m", "yyyy-MM").alias("month"), F.date_format("c", "yyyy-MM-dd").alias("cell"), (F.month("c") == F.month("m")).alias("inside"))


@query("SELECT user_id, greatest(coalesce(max(CASE WHEN event_type = 'purchase' THEN epoch_us(ts) // 1000000 END), 0), 1705000000) + 30 * 86400 AS expires FROM events GROUP BY 1")
def pass_expiry(spark, d) -> DataFrame:
    paid = read(spark, d, "events").groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "purchase", F.floor(micros("ts") / 1000000))).alias("p"))
    return paid.select("user_id", dt.pass_expiry(F.col("p"), F.lit(1705000000).cast("long"), 30).alias("expires"))


# --- rules


#: Addresses of each kind, with whether they are closed.
ADDRESSES = [
    ("8.8.8.8", False), ("192.0.0.9", True), ("192.0.1.1", False), ("192.0.2.200", True), ("198.18.0.1", True), ("198.19.255.255", True), ("198.20.0.1", False), ("198.51.100.7", True), ("203.0.113.1", True), ("203.0.114.1", False),
    ("239.1.2.3", True), ("255.255.255.255", True), ("100.127.0.1", True), ("100.128.0.1", False), ("0177.0.0.1", True), ("1.2.3", True), ("256.1.1.1", True), ("host", True), ("", True), (None, True),
    ("::", True), ("::1", True), ("::2", False), ("fc00::1", True), ("fe80::1%eth0", True), ("ff02::1", True), ("2001:db8::5", True), ("2001:4860:4860::8888", False), ("::ffff:a00:1", True), ("::ffff:808:808", False),
    ("64:ff9b::7f00:1", True), ("64:ff9b::808:808", False), ("1:2:3:4:5:6:7", True), ("1:2:3:4:5:6:7:8", False), ("1::2::3", True), ("g::1", True), ("::ffff:8.8.8.8", True),
]


@query("""
WITH i AS (SELECT c_custkey, (c_custkey * 7) % 256 AS a, (c_custkey * 13 + 5) % 256 AS b FROM customer), n AS (SELECT *, (CASE WHEN c_custkey % 3 = 0 THEN 10 WHEN c_custkey % 3 = 1 THEN 172 ELSE a END) AS f FROM i)
SELECT c_custkey::BIGINT AS id, CASE WHEN c_custkey % 11 = 0 THEN true ELSE f IN (0, 10, 127) OR f >= 224 OR f = 172 AND b BETWEEN 16 AND 31 OR f = 192 AND b = 168 OR f = 169 AND b = 254 OR f = 100 AND b BETWEEN 64 AND 127 OR f = 198 AND b IN (18, 19) END AS closed FROM n
UNION ALL SELECT * FROM (VALUES """ + ", ".join(f"({-i}, {str(c).lower()})" for i, (_, c) in enumerate(ADDRESSES, 1)) + """) s(id, closed)
""")
def closed_addresses(spark, d) -> DataFrame:
    """Addresses that are made of keys, and a list of each kind."""
    k = F.col("c_custkey")
    first = F.when(k % 3 == 0, 10).when(k % 3 == 1, 172).otherwise((k * 7) % 256).cast("string")
    ip = F.when(k % 11 == 0, "host").otherwise(F.concat_ws(".", first, ((k * 13 + 5) % 256).cast("string"), F.lit("1"), F.lit("255")))
    listed = spark.createDataFrame([(-i, a) for i, (a, _) in enumerate(ADDRESSES, 1)], "id long, ip string")
    rows = read(spark, d, "customer").select(k.cast("long").alias("id"), ip.alias("ip")).union(listed)
    return rows.select("id", ru.closed_address(F.col("ip")).alias("closed"))


@query("""
SELECT doc_id, regexp_matches(regexp_replace(lower(coalesce(text, '')), '\\[[^\\]]*\\]', ' ', 'g'), '[0-9]+(?:[.,][0-9]+)? ?%|[$€£] ?[0-9]|[0-9] ?(?:usd|eur|pln|gbp)|[0-9]+ ?x[^a-z]|[0-9]+[+]|[0-9]+ (?:people|users|clients|projects|hours|days|months|years)') AS has_metric FROM documents
""")
def metric_predicate(spark, d) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", ru.has_metric(F.col("text")).alias("has_metric"))


@query("""
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS a, 20.0::DOUBLE AS r, CASE l_returnflag WHEN 'A' THEN 'at_least' WHEN 'R' THEN 'at_most' ELSE CASE WHEN l_linestatus = 'O' THEN 'more_than' ELSE 'less_than' END END AS op FROM lineitem)
SELECT op, round(sum(CASE op WHEN 'at_least' THEN least(1, a / r) WHEN 'at_most' THEN (a <= r)::INT WHEN 'more_than' THEN (a > r)::INT ELSE (a < r)::INT END), 4) AS fulfilled, count(*) AS n FROM x GROUP BY 1
""")
def experience_comparison(spark, d) -> DataFrame:
    op = F.when(F.col("l_returnflag") == "A", "at_least").when(F.col("l_returnflag") == "R", "at_most").when(F.col("l_linestatus") == "O", "more_than").otherwise("less_than")
    rows = read(spark, d, "lineitem").select(op.alias("op"), ru.compare(F.lit(20.0), F.col("l_quantity"), op).alias("f"))
    return r6(rows.groupBy("op").agg(F.sum("f").alias("fulfilled"), F.count("*").alias("n")), 4)


@query("""
WITH h AS (SELECT c_custkey, CAST(list_reduce(list_prepend(0::BIGINT, list_transform(regexp_split_to_array(c_name, ''), lambda c: unicode(c)::BIGINT)), lambda a, c: (a * 31 + c) % 4294967296) AS BIGINT) AS h FROM customer)
SELECT c_custkey, abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 7 AS variant FROM h
""")
def variant_choice(spark, d) -> DataFrame:
    return read(spark, d, "customer").select("c_custkey", ru.variant_of(F.col("c_name"), 7).alias("variant"))


@query("SELECT c_custkey, substr(sha256('c_mktsegment=' || coalesce('s' || c_mktsegment, 'n') || '|c_name=' || coalesce('s' || c_name, 'n') || '|c_nationkey=' || coalesce('s' || CAST(c_nationkey AS VARCHAR), 'n')), 1, 20) AS signature FROM customer")
def row_signatures(spark, d) -> DataFrame:
    return read(spark, d, "customer").select("c_custkey", ru.row_signature("c_name", "c_nationkey", "c_mktsegment").alias("signature"))


@query("""
SELECT c_custkey, round((c_acctbal - 200) / ((40 + (c_custkey % 4) * 0.5::DOUBLE * 5) * 52 / 12), 6) AS hourly FROM customer
""")
def real_hourly_rate(spark, d) -> DataFrame:
    return r6(read(spark, d, "customer").select("c_custkey", ru.real_hourly(F.col("c_acctbal"), 40.0, (F.col("c_custkey") % 4) * 0.5, F.lit(200.0)).alias("hourly")))


@query("""
WITH l AS (SELECT l_orderkey, count(*) AS n, sum((l_returnflag = 'R')::INT) AS r, sum((l_tax > 0.06)::INT) AS t FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN n = 1 THEN 'DISABLED' WHEN t > 3 THEN 'BLOCKED' WHEN r = 0 THEN 'INSUFFICIENT' WHEN n < 5 THEN 'PARTIAL' ELSE 'FULL' END AS applicability FROM l
""")
def applicability(spark, d) -> DataFrame:
    g = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count_if(F.col("l_tax") > 0.06).alias("t"))
    codes = lambda cond, name: F.filter(F.array(F.when(cond, name)), lambda x: x.isNotNull())
    return g.select("l_orderkey", ru.applicability(F.col("n") > 1, F.col("t") <= 3, codes(F.col("r") == 0, "RETURNS"), codes(F.col("n") < 5, "LINES")).alias("applicability"))


@query(f"SELECT o_custkey, count(*) AS n, sum((CASE WHEN o_orderstatus = 'P' THEN 24000 ELSE {month_sql('o_orderdate')} + 2 END >= {month_sql('o_orderdate')} AND {month_sql('o_orderdate')} <= 24001)::INT)::BIGINT AS n_valid FROM orders GROUP BY 1")
def employment_validity(spark, d) -> DataFrame:
    o = read(spark, d, "orders").select("o_custkey", month("o_orderdate").alias("s"), F.when(F.col("o_orderstatus") != "P", month("o_orderdate") + 2).alias("e"))
    return o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(dt.valid_employment(F.col("s"), F.col("e"), F.lit(24000))).alias("n_valid"))
