"""Queries over texts and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroom.functions import text as tx
from tallyroom.operators import texts as ts
from tallyroom.plans.filters import chosen, made
from tallyroom.plans.registry import query, r6
from tallyroom.sources import html
from tallyroom.sources.tables import read

FOLD = "replace(strip_accents(lower({})), 'ł', 'l')"


def _count(pattern: str, text: str = "t") -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


@query(f"""
WITH x AS (SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN replace(t, 'the', 't' || chr(57345) || 'e') WHEN 2 THEN replace(t, '. ', ' ' || chr(57346) || ' ') WHEN 3 THEN replace(t, 'on', chr(65533)) ELSE t END AS t FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
p AS (SELECT *, regexp_replace(t, '[^\\p{{L}}\\p{{N}}\\x{{E000}}-\\x{{F8FF}}]', ' ', 'g') AS u FROM x),
c AS (SELECT doc_id, {_count("[\\p{L}\\p{N}]")} AS lexical, {_count("\\x{FFFD}")} + {_count("|".join(ts.BROKEN))} + 0.1::DOUBLE * {_count("[\\x{E000}-\\x{F8FF}]")} + 0.7::DOUBLE * ({_count("[\\x{E000}-\\x{F8FF}]", "u")} - {_count("[\\x{E000}-\\x{F8FF}]", "regexp_replace(u, '[\\p{L}\\p{N}][\\x{E000}-\\x{F8FF}]|[\\x{E000}-\\x{F8FF}][\\p{L}\\p{N}]', '', 'g')")}) AS m FROM p)
SELECT doc_id, CAST(lexical AS BIGINT) AS lexical, round(CAST(m AS DOUBLE), 6) AS damage_mass, round(m / greatest(1, lexical), 6) AS damage, round(exp(-(m / greatest(1, lexical)) / 0.008), 6) AS encoding FROM c
""")
def doc_encoding_quality(spark, d) -> DataFrame:
    """Damage of documents, of which three in four are damaged in one way each: signs within words, signs alone, lost letters."""
    t, k = F.coalesce("text", F.lit("")), F.col("doc_id") % 4
    hurt = F.when(k == 1, F.replace(t, F.lit("the"), F.lit("t\ue001e"))).when(k == 2, F.replace(t, F.lit(". "), F.lit(" \ue002 "))).when(k == 3, F.replace(t, F.lit("on"), F.lit("\ufffd"))).otherwise(t)
    return r6(ts.encoding_damage(read(spark, d, "documents").select("doc_id", hurt.alias("text")), "text").drop("text"))


HEADINGS, CONTACT, OTHERS = ["(?i)licen[sc]e", "(?i)copyright", "(?i)all rights"], "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", ["[{}<>]", "#{2}", "[0-9]{6}"]


@query(f"""
WITH x AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), c AS (SELECT doc_id, trim(t) = '' AS nil, {" + ".join(f"regexp_matches(t, '{p}')::INT" for p in HEADINGS)} AS h, regexp_matches(t, '{CONTACT}') AS k, {" + ".join(f"regexp_matches(t, '{p}')::INT" for p in OTHERS)} AS o FROM x)
SELECT doc_id, CASE WHEN nil THEN 'UNKNOWN' WHEN o >= 2 AND h = 0 AND NOT k THEN 'OTHER' WHEN h >= 2 OR h >= 1 AND k THEN 'RECORD' ELSE 'UNKNOWN' END AS document_class,
  round(CASE WHEN nil THEN 0 WHEN o >= 2 AND h = 0 AND NOT k THEN least(0.95::DOUBLE, 0.75::DOUBLE + 0.08 * o) WHEN h >= 2 OR h >= 1 AND k THEN least(0.98::DOUBLE, 0.7::DOUBLE + 0.08 * h + CASE WHEN k THEN 0.08 ELSE 0 END) ELSE 0.45::DOUBLE END, 6) AS confidence FROM c
""")
def doc_class_gate(spark, d) -> DataFrame:
    return r6(read(spark, d, "documents").select("doc_id", ts.document_class(F.coalesce("text", F.lit("")), HEADINGS, CONTACT, OTHERS).alias("x")).select("doc_id", "x.*"))


#: Contexts that are made of keys: number, context, class, confidence, weight.
NUMBERS = [
    ("2019", "od 2019 do dziś", "DATE_OR_YEAR", 0.98, 0.0), ("2019", "2017 – 2019 sklep", "DATE_OR_YEAR", 0.98, 0.0), ("5", "5 years of work", "DURATION", 0.93, 0.0), ("10", "Windows 10 hosts", "VERSION_OR_MODEL", 0.9, 0.0), ("40", "increased sales by 40 %", "IMPACT_METRIC", 0.97, 1.0),
    ("12", "obniżyłem koszty o 12 tys.", "IMPACT_METRIC", 0.97, 1.0), ("300", "saved 300 users", "IMPACT_METRIC", 0.88, 1.0), ("300", "300 klientów", "SCALE_METRIC", 0.86, 0.55), ("99", "only 99 zl here", "PRICE_OR_NAME_FRAGMENT", 0.82, 0.0), ("500", "500 EUR", "SCALE_METRIC", 0.78, 0.55),
    ("1999", "in 1999 here", "DATE_OR_YEAR", 0.82, 0.0), ("17", "room 17 b", "UNKNOWN_NUMBER", 0.45, 0.1), ("7", "reduced 7 years of debt by 3 mln", "IMPACT_METRIC", 0.97, 1.0),
]


@query(f"SELECT o_orderkey, context, confidence, weight FROM orders JOIN {made([(i, *x[2:]) for i, x in enumerate(NUMBERS)], 'k, context, confidence, weight')} ON o_orderkey % {len(NUMBERS)} = k")
def numeric_context(spark, d) -> DataFrame:
    """What numbers in contexts that are made of keys stand for."""
    k = F.col("o_orderkey")
    return read(spark, d, "orders").select("o_orderkey", ts.number_context(chosen(k, [x[0] for x in NUMBERS]), chosen(k, [x[1] for x in NUMBERS])).alias("c")).select("o_orderkey", "c.*")


@query(r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^0-9\n]{0,30}[0-9][0-9.,:]*[^0-9\n]{0,30}')) AS w FROM documents), n AS (SELECT doc_id, lower(trim(regexp_replace(w, '\s+', ' ', 'g'))) AS w, regexp_extract(w, '[0-9][0-9.,:]*') AS n FROM w),
f AS (SELECT *, regexp_matches(n, '^(?:19|20)[0-9]{2}$') AS y, regexp_matches(w, '\b(?:IMPACT)') AS i, regexp_matches(w, '\b(?:COUNTED)') AS s, regexp_matches(w, '\b(?:PAID)\b') AS m FROM n),
c AS (SELECT doc_id, CASE WHEN y AND (regexp_matches(w, '\b(?:DATED)\b') OR regexp_matches(w, '[-–—/]\s*(?:19|20)[0-9]{2}')) THEN 'DATE_OR_YEAR' WHEN regexp_matches(w, '\b(?:LASTING)\b') AND NOT i THEN 'DURATION' WHEN regexp_matches(w, '\b(?:VERSIONED)\b') AND NOT i THEN 'VERSION_OR_MODEL'
  WHEN i AND (m OR regexp_matches(w, '%|procent')) OR i AND s THEN 'IMPACT_METRIC' WHEN s THEN 'SCALE_METRIC' WHEN m AND regexp_matches(w, '\b(?:99|24|7)\s*(?:zł|zl)\b') AND NOT i THEN 'PRICE_OR_NAME_FRAGMENT' WHEN m THEN 'SCALE_METRIC' WHEN y THEN 'DATE_OR_YEAR' ELSE 'UNKNOWN_NUMBER' END AS context FROM f)
SELECT doc_id, context, count(*) AS n FROM c GROUP BY 1, 2
""".replace("IMPACT)", ts.ACHIEVED + ")").replace("COUNTED", ts.COUNTED).replace("PAID", ts.PAID).replace("DATED", ts.DATED).replace("LASTING", ts.LASTING).replace("VERSIONED", ts.VERSIONED))
def numbers_of_documents(spark, d) -> DataFrame:
    """The numbers of each document by context; its SQL names the same fixed words."""
    return ts.numbers_in_context(read(spark, d, "documents").select("doc_id", "text"), "doc_id", "text").select("doc_id", "context", "n")


_BAG = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}+#./@_-]+'), lambda t: t <> '')"


@query(f"""
WITH c AS (SELECT conv_id, role, unnest({_BAG}) AS token FROM conversations), a AS (SELECT conv_id, token, count(*) AS a FROM c WHERE role = 'user' GROUP BY 1, 2), b AS (SELECT conv_id, token, count(*) AS b FROM c WHERE role = 'assistant' GROUP BY 1, 2),
s AS (SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(sum(a), 0)::BIGINT AS n_left, coalesce(sum(b), 0)::BIGINT AS n_right, coalesce(sum(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN least(a, b) END), 0)::BIGINT AS n_shared FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.token = b.token GROUP BY 1),
p AS (SELECT *, coalesce(n_shared / nullif(n_right, 0), 0) AS precision, coalesce(n_shared / nullif(n_left, 0), 0) AS recall FROM s)
SELECT conv_id, n_left, n_right, n_shared, round(precision, 9) AS precision, round(recall, 9) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 9) AS f1 FROM p
""")
def token_agreement(spark, d) -> DataFrame:
    """Words of the questions against those of the answers."""
    rows = read(spark, d, "conversations").select("conv_id", "role", F.explode(tx.signed_tokens(F.col("text"))).alias("token"))
    return r6(ts.token_agreement(rows.where("role = 'user'"), rows.where("role = 'assistant'"), ["conv_id"], "token"), 9)


@query("""
WITH r AS (SELECT conv_id, turn AS f, length(coalesce(text, '')) AS s FROM conversations), p AS (SELECT a.conv_id, a.s > b.s AS inv FROM r a JOIN r b ON a.conv_id = b.conv_id AND a.f < b.f AND a.s <> b.s)
SELECT conv_id, CAST(count(*) AS DOUBLE) AS comparable, CAST(sum(inv::INT) AS DOUBLE) AS discordant, round(sum(inv::INT) / count(*), 6) AS discordance FROM p GROUP BY 1
""")
def order_discordance(spark, d) -> DataFrame:
    rows = read(spark, d, "conversations").select("conv_id", "turn", F.length(F.coalesce("text", F.lit(""))).alias("size"))
    return r6(ts.order_discordance(rows, ["conv_id"], "turn", "size"))


@query(r"""
WITH a AS (SELECT doc_id, regexp_replace(text, 'https?://[^ \t\n\r\f]+', '[url]', 'g') AS t FROM documents), b AS (SELECT doc_id, regexp_replace(t, '(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b', '[uuid]', 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(t, 'eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*', '[jwt]', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email]', 'g') AS t FROM b)
SELECT doc_id, substr(trim(regexp_replace(regexp_replace(t, '[0-9]+', '#', 'g'), '[ \t\n\r\f]+', ' ', 'g')), 1, 300) AS scrubbed FROM c
""")
def pii_scrub(spark, d) -> DataFrame:
    """Messages without personal data; their form keeps 300 characters."""
    return read(spark, d, "documents").select("doc_id", tx.scrub(F.col("text")).alias("scrubbed"))


@query("""
WITH n AS (SELECT p_name || CASE p_partkey % 4 WHEN 0 THEN '-Rzeż' WHEN 1 THEN ' Szczóch' WHEN 2 THEN ' Ćma Kotłów' ELSE '' END AS name FROM part),
k AS (SELECT name, regexp_replace(replace(replace(replace(replace(replace(strip_accents(lower(name)), 'ł', 'l'), 'rz', 'z'), 'sz', 's'), 'cz', 'c'), 'ch', 'h'), '[^a-z0-9]', '', 'g') AS sound FROM n)
SELECT sound, count(*) AS n, count(DISTINCT name) AS n_names FROM k GROUP BY 1
""")
def phonetic_key(spark, d) -> DataFrame:
    """Names with marks and digraphs that are made of keys."""
    k = F.col("p_partkey") % 4
    name = F.concat("p_name", F.when(k == 0, "-Rzeż").when(k == 1, " Szczóch").when(k == 2, " Ćma Kotłów").otherwise(""))
    return read(spark, d, "part").select(name.alias("name")).groupBy(tx.phonetic(F.col("name")).alias("sound")).agg(F.count("*").alias("n"), F.countDistinct("name").alias("n_names"))


@query(f"""
WITH x AS (SELECT conv_id, turn, {FOLD.format("coalesce(text, '')")} AS t FROM conversations)
SELECT conv_id, turn, CAST({_count("[^ \\t\\n\\r]+")} AS BIGINT) AS n_words, CAST({_count("[0-9]+")} AS BIGINT) AS n_numbers, CAST({_count("\\?")} AS BIGINT) AS n_questions, CAST(len(list_filter(regexp_split_to_array(t, '[^a-z0-9]+'), lambda w: w IN ('i', 'me', 'my'))) AS BIGINT) AS n_i,
  CAST(len(list_filter(regexp_split_to_array(t, '[^a-z0-9]+'), lambda w: w IN ('we', 'us', 'our'))) AS BIGINT) AS n_we, regexp_matches(t, '[0-9]+ ?%|result|increas|reduc|sav') AS has_result FROM x
""")
def answer_heuristics(spark, d) -> DataFrame:
    return read(spark, d, "conversations").select("conv_id", "turn", ts.answer_marks(F.col("text")).alias("m")).select("conv_id", "turn", "m.*")


@query("""
WITH o AS (SELECT o_orderkey, o_orderkey % 6 AS m, o_orderkey // 1000 + 1 AS th, lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') AS rest, o_orderkey FROM orders)
SELECT o_orderkey, CASE m WHEN 0 THEN NULL WHEN 1 THEN o_orderkey + 1000.0::DOUBLE WHEN 2 THEN 4500.5::DOUBLE WHEN 3 THEN 9.5::DOUBLE WHEN 4 THEN th * 1000.0::DOUBLE + o_orderkey % 1000 ELSE 8000.0::DOUBLE END AS low,
  CASE m WHEN 1 THEN 2 * o_orderkey + 9000.0::DOUBLE WHEN 3 THEN 12.75::DOUBLE END AS high FROM o
""")
def salary_range(spark, d) -> DataFrame:
    """Ranges read from texts that are made of keys: with no number, words between, decimals, narrow spaces, a zero."""
    k = F.col("o_orderkey")
    thousands = F.concat((F.floor(k / 1000) + 1).cast("string"), F.lit("\u202f"), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(" zł"))
    words = F.concat_ws(" ", F.lit("from"), (k + 1000).cast("string"), F.lit("to"), (2 * k + 9000).cast("string"), F.lit("gross"))
    text = F.when(k % 6 == 0, "to be agreed").when(k % 6 == 1, words).when(k % 6 == 2, "4 500,5 EUR").when(k % 6 == 3, "9.50 - 12.75 EUR").when(k % 6 == 4, thousands).otherwise("0 - 8\u00a0000")
    return read(spark, d, "orders").select("o_orderkey", tx.salary_range(text).alias("r")).select("o_orderkey", "r.*")


DOMAIN = "regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www\\.', '')"


@query(f"SELECT nullif({DOMAIN}, '') AS domain, count(*) AS n FROM pages GROUP BY 1")
def url_domains(spark, d) -> DataFrame:
    return read(spark, d, "pages").groupBy(tx.url_domain(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))


def _plain(x: str) -> str:
    out = f"regexp_replace({x}, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<noscript[^>]*>.*?</noscript>|<template[^>]*>.*?</template>|<!--.*?-->', ' ', 'g')"
    out = f"regexp_replace({out}, '<[^>]*>', ' ', 'g')"
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        out = f"replace({out}, '{a}', '{b}')"
    return f"trim(regexp_replace({out}, '[ \\t\\n\\r\\f\\x{{A0}}]+', ' ', 'g'))"


def _tag(x: str, tag: str) -> str:
    inner = f"regexp_extract({x}, '(?is)<{tag}(?:[ \\t\\n][^>]*)?>(.*?)(?:</{tag}>|$)', 1)"
    return f"nullif({_plain(inner)}, '')"


_CALM = "regexp_replace(html, '(?is)" + "|".join(f"<{t}(?:[ \\t\\n][^>]*)?>.*?</{t}>" for t in "script style svg noscript iframe template header footer nav aside form".split()) + "', ' ', 'g')"
_LONG = "The work of this post is told at some length here, so that it has more than the eighty characters that a record needs."
_LD = '<script type="application/ld+json">{}</script>'
#: Pages of each kind: url, html, and what they hold: tier, title, company, description.
MADE = [
    ("https://www.a.example/1", _LD.format('{"broken":') + _LD.format(f'{{"@graph": [{{"@type": "Organization"}}, {{"@type": "BreadcrumbList"}}, {{"@type": "JobPosting", "title": "Welder", "hiringOrganization": {{"name": "Acme"}}, "description": "<p>{_LONG}</p>"}}]}}') + "<h1>No</h1>", "json-ld", "Welder", "Acme", _LONG),
    ("https://b.example/2", _LD.format(f'[{{"@type": "Thing"}}, {{"@type": ["Thing", "JobPosting"], "title": "Cook", "description": "{_LONG}"}}]') + '<p class="company-name">Inn</p>', "json-ld", "Cook", "Inn", _LONG),
    ("https://c.example/3", _LD.format(f'{{"mainEntity": {{"itemListElement": [{{"@type": "JobPosting", "title": "Baker", "description": "short"}}]}}}}') + f"<main>{_LONG}</main>", "json-ld", "Baker", None, _LONG),
    ("https://d.example/4", f'<script id="__NEXT_DATA__" type="application/json">{{"props": {{"offer": {{"jobTitle": "Nurse", "hiringOrganization": {{"name": "Ward"}}, "description": "{_LONG}"}}}}}}</script>', "hydration", "Nurse", "Ward", _LONG),
    ("https://e.example/5", f'<script>var a = 1; window.__NUXT__ = {{"note": "a }} in a text", "data": {{"OfferName": "Pilot", "descriptionText": "{_LONG}"}}}}; go();</script><div data-testid="the-company">Sky</div>', "hydration", "Pilot", "Sky", _LONG),
    ("https://f.example/6", f'<script>window.__INITIAL_STATE__ = {{"title": "Guard"}};</script><title>x</title><div role="main">{_LONG}</div>', "main-content", "Guard", None, _LONG),
    ("https://g.example/7", f"<title>Clerk - Office · Board</title><nav>{_LONG}</nav><body><div role='navigation'>{_LONG}</div><article>{_LONG} Yes.</article></body>", "main-content", "Clerk - Office", None, _LONG + " Yes."),
    ("https://h.example/8", '<meta property="og:title" content="Judge | Board"><meta content="Brief." name="twitter:description"><meta property="og:site_name" content="Court"><p>little</p>', "open-graph", "Judge", "Court", "Brief."),
    ("https://i.example/9", "<p>nothing</p>", "none", None, None, None),
    (None, None, "none", None, None, None),
]


def _said(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


_STATED = ", ".join(f"({-k}, {_said(u and u.split('//')[1].split('/')[0].removeprefix('www.'))}, {', '.join(map(_said, rest))})" for k, (u, _, *rest) in enumerate(MADE, 1))


@query(f"""
WITH a AS (SELECT page_id, nullif({DOMAIN}, '') AS domain, coalesce({_tag("html", "h1")}, {_tag("html", "title")}) AS title, {_CALM} AS calm FROM (SELECT page_id, url, regexp_replace(html, '&(amp|lt|gt|quot|nbsp)([^;])', '&\\1;\\2', 'g') AS html FROM pages)), b AS (SELECT page_id, domain, title, {_tag("calm", "main")} AS m, {_tag("calm", "article")} AS r, {_tag("calm", "body")} AS b FROM a),
c AS (SELECT page_id, domain, title, coalesce(CASE WHEN length(m) >= 80 THEN m END, CASE WHEN length(r) >= 80 THEN r END, CASE WHEN length(b) >= 80 THEN b END) AS t FROM b)
SELECT page_id, domain, CASE WHEN t IS NULL THEN 'none' ELSE 'main-content' END AS tier, title, NULL AS company, substr(t, 1, 20000) AS description FROM c
UNION ALL SELECT * FROM (VALUES {_STATED}) AS s(page_id, domain, tier, title, company, description)
""")
def html_job_cascade(spark, d) -> DataFrame:
    """Records from pages, and from a made page of each kind; of a page's main text a record holds 20,000 characters."""
    made = spark.createDataFrame([(-k, u, h) for k, (u, h, *_) in enumerate(MADE, 1)], "page_id long, url string, html string")
    return html.extract(read(spark, d, "pages").select("page_id", "url", "html").unionByName(made)).select("page_id", "domain", "tier", "title", "company", "description")


@query(f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, unnest(range(len(string_split(coalesce(text, ''), chr(10)))))::INTEGER AS line FROM documents), h AS (SELECT *, CASE WHEN regexp_matches(lower(trim(x)), '^[a-z ]{{1,25}}[.]$') THEN 'short' WHEN regexp_matches(lower(trim(x)), '^[0-9]') THEN 'numbered' WHEN regexp_matches(lower(trim(x)), '^(?:licen|copyright|permission)') THEN 'legal' END AS k FROM l)
SELECT doc_id, coalesce(section, 'none') AS section, count(*) AS n FROM (SELECT doc_id, last_value(k IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS section FROM h) WHERE section IS DISTINCT FROM 'legal' GROUP BY 1, 2
""")
def section_lines(spark, d) -> DataFrame:
    """Lines under the last short or numbered line; what stands under licences is left out."""
    found = ts.sections(read(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", {"short": "^[a-z ]{1,25}[.]$", "numbered": "^[0-9]", "legal": "^(?:licen|copyright|permission)"}, ("legal",))
    return found.groupBy("doc_id", F.coalesce("section", F.lit("none")).alias("section")).agg(F.count("*").alias("n"))
