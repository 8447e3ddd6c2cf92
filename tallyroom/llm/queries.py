"""The queries of the numbered operators over the tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyroom.llm import chat_format, decontamination, jaccard_join, line_dedup, mixing, pii, prefix_trie, quality_classifier, quality_rules, structure_repair, token_counts, toxicity, url_filters
from tallyroom.llm.common import written


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = line_dedup.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return clean.withColumn("deleted", F.array_join(F.col("deleted").cast("array<string>"), ","))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = quality_rules.quality_rules(_read(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep=["doc_id"])
    return rules.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_counts.read_vocabulary(spark)
    return token_counts.count_tokens(_read(spark, sf_dir, "documents").select("doc_id", "text"), pieces, keep=["doc_id"])


def conversation_events(rows: DataFrame) -> DataFrame:
    """Each row as the events of its turn: a text streams in two parts, after a draft that was edited, or generated again."""
    copies = Window.partitionBy("conv_id", "turn", "role", "text").orderBy(F.lit(0))
    # equal rows are turns of their own; ids that follow from the row are the same when a task is run again
    named = rows.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("copy", F.row_number().over(copies))
    msg = F.struct("turn", "role", F.xxhash64("text").alias("hash"), "copy")
    half = F.floor(F.length("text") / 2).cast("int")
    first, second = F.expr("left(text, length(text) div 2)"), F.substring("text", half + 1, F.length("text"))
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    draft = event("delta", F.lit("[INST] a draft"))
    mended = F.array(event("open", F.lit("")), draft, event("edit", first), event("delta", second))
    again = F.array(event("open", F.lit("")), draft, event("regenerate", F.lit("")), event("delta", first), event("delta", second))
    events = F.when(F.col("role") == "assistant", again).otherwise(mended)
    marked = named.select("conv_id", "turn", "role", msg.alias("msg"), F.posexplode(events).alias("k", "e"))
    return marked.select("conv_id", (F.col("turn").cast("long") * 8 + F.col("k")).alias("seq"), "msg", "role", "e.kind", "e.text")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]").alias("text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").cast("int").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said)
    return chat_format.digests(chat_format.format_conversations(conversation_events(rows.unionByName(extra))))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = _read(spark, sf_dir, "pages").select("page_id", "url"), _read(spark, sf_dir, "labels")
    labelled = pages.join(labels, F.col("page_id") == F.col("doc_id")).select("url", (F.col("quality") == 0).alias("bad"))
    return url_filters.url_filter(pages, labelled, keep=["page_id"]).select("page_id", "host", "path", "rule", "verdict", "mined")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify_quality(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels"), keep=["doc_id"])


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify_toxicity(_read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), _read(spark, sf_dir, "labels"), keep=["doc_id"])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = written(prefix_trie.placed_turns(_read(spark, sf_dir, "conversations")))
    return prefix_trie.prefix_trie(*prefix_trie.rebuilt(turns))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_read(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"], redact=False)
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(pii.told("spans", base=True), 256).alias("base_sha256"), pii.told("spans", base=False).alias("spans"))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    audits, digests = structure_repair.repair_conversations(structure_repair.damaged(rows), ids=rows.select("conv_id"), digests=True)
    return audits.join(digests, "conv_id").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_decontamination, op2_line_dedup, op3_quality_rules, op4_token_counts, op5_chat_format, op6_url_filters, op7_quality_classifier, op8_toxicity, op9_mixing, op10_jaccard_join, op11_prefix_trie, op12_pii, op13_structure_repair, pipeline]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1_SQL, "op2_line_dedup": OP2_SQL, "op3_quality_rules": OP3_SQL, "op5_chat_format": OP5_SQL, "op10_jaccard_join": OP10_SQL, "op11_prefix_trie": OP11_SQL, "op12_pii": OP12_SQL, "op13_structure_repair": OP13_SQL}


OP1_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
g AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d CROSS JOIN lens WHERE len(w) >= n),
m AS (SELECT g.doc_id, g.n, g.i, win.item_id FROM g JOIN win ON g.n = win.n AND array_to_string(g.w[g.i:g.i + g.n - 1], ' ') = win.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP2_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
p AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS x FROM d),
c AS (SELECT doc_id, i, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n, sum(len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM p),
w AS (SELECT a.doc_id, a.i AS f, min(b.i) AS t FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.n >= 40 GROUP BY 1, 2
  UNION SELECT b.doc_id, max(a.i), b.i FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.n >= 40 GROUP BY b.doc_id, b.i),
h AS (SELECT w.doc_id, f, t, array_to_string(l[f:t], chr(10)) AS body FROM w JOIN d USING (doc_id)),
m AS (SELECT DISTINCT a.doc_id, a.f, a.t FROM h a JOIN h b ON a.body = b.body AND (b.doc_id < a.doc_id OR b.doc_id = a.doc_id AND b.t < a.f)),
g AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, unnest(range(f, t + 1)) AS i FROM m)),
r AS (SELECT p.doc_id, string_agg(x, chr(10) ORDER BY p.i) FILTER (g.i IS NULL) AS kept, string_agg(CAST(p.i - 1 AS VARCHAR), ',' ORDER BY p.i) FILTER (g.i IS NOT NULL) AS deleted, count(g.i) AS n_deleted
  FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY p.doc_id)
SELECT d.doc_id, CASE WHEN text IS NOT NULL THEN coalesce(kept, '') END AS text, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_deleted, 0) AS BIGINT) AS n_deleted, coalesce(deleted, '') AS deleted FROM d LEFT JOIN r USING (doc_id)
"""

OP3_SQL = r"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
p AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS x FROM w),
g AS (SELECT doc_id, i, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o AS g FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g WHERE g IS NOT NULL) WHERE n > 1),
h AS (SELECT doc_id, count(DISTINCT j) AS again FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY 1),
m AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(again, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN h USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
k AS (SELECT source, count(*) AS n, sum(base_failed::INT)::DOUBLE AS f FROM b WHERE source IS NOT NULL GROUP BY 1),
a AS (SELECT sum(n) AS n, count(*) AS k, sum(f) / sum(n) AS m, sum(n * (f / n) * (f / n)) / sum(n) AS s FROM k),
q AS (SELECT m, least(1000, greatest(1, m * (1 - m) / greatest(1e-12, greatest(0, s - m * m) - m * (1 - m) * k / n) - 1)) AS strength FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce((f + m * strength) / (k.n + strength) > 0.5, false) AS kept FROM b LEFT JOIN k USING (source) CROSS JOIN q
"""

OP5_SQL = r"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, t.turn, t.role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) t(turn, role))
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + 13 + length(replace(replace(replace(replace(text, '\', '\m'), '[', '\b'), ']', '\c'), '</s>', '\e'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(4, len(w)) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON o.a = x.doc_id JOIN n y ON o.b = y.doc_id WHERE 100 * k >= 85 * (x.n + y.n - k)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
c(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT c.a, u.b FROM c JOIN u ON c.b = u.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM c GROUP BY a) m ON m.a = d.doc_id
"""

#: Table of crc32 by bytes, and a text's crc32 by it; the texts are ASCII.
_CRC_TABLE = r"""crc(k, i, v) AS (SELECT 0, i, i FROM range(256) t(i) UNION ALL SELECT k + 1, i, CASE WHEN (v & 1) = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END FROM crc WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM crc WHERE k = 8)"""
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split({0}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295)"

OP11_SQL = (
    "WITH RECURSIVE "
    + _CRC_TABLE
    + r""",
l AS (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS l FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
h AS (SELECT conv_id, l, """
    + _CRC.format("CAST(conv_id AS VARCHAR)")
    + r""" % 9 AS h FROM l CROSS JOIN tab),
b AS (SELECT h.conv_id, list_concat(coalesce(b.l, [])[1:h], h.l[h + 1:]) AS l FROM h LEFT JOIN l b ON b.conv_id = h.conv_id - h.conv_id % 5),
m AS (SELECT conv_id, d, len(l) AS n, sha256(CAST(to_json(l[1:d]) AS VARCHAR)) AS k, sha256(CAST(to_json(l[1:d - 1]) AS VARCHAR)) AS up, CASE WHEN d = 0 THEN 0 ELSE strlen(l[d].x) END AS bytes FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM b)),
n AS (SELECT k, any_value(d) AS depth, any_value(CASE WHEN d > 0 THEN up END) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM m GROUP BY k),
c AS (SELECT up, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY up),
o AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c ON c.up = n.k),
s AS (SELECT m.k, count(*) FILTER (o.n_children = 0) AS n_leaves, sum((o.n_convs - 1) * o.bytes) AS saved FROM o JOIN m ON m.conv_id = o.conv_id AND m.d <= o.depth GROUP BY m.k),
e AS (SELECT k, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ends FROM m WHERE d = n GROUP BY k)
SELECT o.conv_id, o.depth, p.conv_id AS parent_conv_id, o.n_convs, o.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM o JOIN s USING (k) LEFT JOIN e USING (k) LEFT JOIN n p ON p.k = o.up
"""
)

_FORMS = "|".join(form for cue in pii.CUES for form in dict.fromkeys([cue, cue.capitalize(), cue.upper()]))
_IBAN = "[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)"
_PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "url": r"""[A-Za-z][A-Za-z0-9+.-]*://[^\x00-\x20<>"'']*""",
    "account": rf"""(?:{_FORMS})(?:[ _-]?(?:no|number|nr|id|key|code))?\.?[ \t]*[:=#][ \t]*["'']?[A-Za-z0-9][A-Za-z0-9._/+-]*""",
    "iban": f"(?:iban|Iban|IBAN)[:=# ]*{_IBAN}",
}
OP12_SQL = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),\nk AS ("
    + " UNION ALL ".join(f"SELECT doc_id, {n} AS n, '{kind}' AS kind, regexp_extract_all(t, '{p}') AS h, string_split_regex(t, '{p}') AS g FROM d" for n, (kind, p) in enumerate(_PII.items()))
    + r"""),
e AS (SELECT doc_id, n, kind, generate_subscripts(h, 1) AS i, unnest(h) AS x, unnest(g[1:len(h)]) AS y FROM k WHERE len(h) > 0),
f AS (SELECT doc_id, n, kind, x, CAST(sum(length(y) + length(x)) OVER (PARTITION BY doc_id, n ORDER BY i) AS BIGINT) AS z, regexp_replace(x, '[^0-9]', '', 'g') AS q,
  CASE kind WHEN 'account' THEN regexp_extract(x, '[:=#][ \t]*["'']?([A-Za-z0-9][A-Za-z0-9._/+-]*)$', 1) WHEN 'iban' THEN regexp_extract(x, '^(?:iban|Iban|IBAN)[:=# ]*("""
    + _IBAN
    + r""")$', 1) ELSE x END AS v FROM e),
v AS (SELECT doc_id, least(n, 5) AS n, CASE kind WHEN 'iban' THEN 'account' ELSE kind END AS kind, z - length(v) AS b, z - length(v) + length(CASE kind WHEN 'account' THEN rtrim(v, '._/+-') WHEN 'url' THEN rtrim(v, '.,;:!?)]}') ELSE v END) AS z FROM f
  WHERE CASE kind WHEN 'email' THEN true
    WHEN 'ip' THEN regexp_matches(x, '^0*[0-9]{1,3}([.]0*[0-9]{1,3}){3}$') AND list_max(list_transform(string_split(x, '.'), lambda p: TRY_CAST(right('000' || p, 3) AS INT))) <= 255
    WHEN 'card' THEN length(q) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(q) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(q[length(q) - i + 1] AS INT) ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][CAST(q[length(q) - i + 1] AS INT) + 1] END)) % 10 = 0
    WHEN 'phone' THEN length(q) BETWEEN 9 AND 15
    WHEN 'url' THEN regexp_matches(rtrim(x, '.,;:!?)]}'), '://[^/?#@]+@|/(?:~|@|u/|users?/|profiles?/|people/)[A-Za-z0-9]')
    WHEN 'account' THEN length(rtrim(v, '._/+-')) > 5 AND regexp_matches(rtrim(v, '._/+-'), '[0-9]')
    ELSE list_reduce(list_prepend(0, list_transform(string_split(replace(v, ' ', '')[5:] || replace(v, ' ', '')[1:4], ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), lambda a, c: CASE WHEN c < 10 THEN (10 * a + c) % 97 ELSE (100 * a + c) % 97 END) = 1 END),
a AS (SELECT doc_id, string_agg(kind || ':' || b || ':' || z, ',' ORDER BY b, n, z) AS spans, string_agg(kind || ':' || b || ':' || z, ',' ORDER BY b, n, z) FILTER (n < 4) AS base,
  count(*) FILTER (n = 0) AS n_email, count(*) FILTER (n = 1) AS n_ip, count(*) FILTER (n = 2) AS n_card, count(*) FILTER (n = 3) AS n_phone FROM v GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)
"""
)


def _repair_step() -> str:
    """One step backwards of the cheapest repair: of each state the least of (cost, edits, repaired turns)."""
    due = {0: 2, 1: 2, 2: 3, 3: 2}
    said = {2: "user", 3: "assistant"}
    made = lambda cost, edit, rest, turn: f"{{'c': {rest}.c + {cost}, 'a': '{edit}' || {rest}.a, 'r': " + (f"list_prepend({turn}, {rest}.r)" if turn else f"{rest}.r") + "}"
    plain = []
    for s in range(4):
        keep = {0: "CASE i0 WHEN 's' THEN s1 WHEN 'u' THEN s2 END", 1: "CASE i0 WHEN 'u' THEN s2 END", 2: "CASE i0 WHEN 'a' THEN s3 END", 3: "CASE i0 WHEN 'u' THEN s2 END"}[s]
        options = [made(3, "D", f"s{s}", ""), f"CASE WHEN NOT gone AND ({keep}) IS NOT NULL THEN " + made("cut", "K", f"({keep})", "r || ':' || x") + " END", "CASE WHEN NOT gone THEN " + made("cut + 2", "R", f"s{due[s]}", f"'{said[due[s]]}:' || x") + " END"]
        plain.append(f"list_sort(list_filter([{', '.join(options)}], lambda o: o IS NOT NULL))[1] AS b{s}")
    ends = []
    for s in range(4):
        d = due[s]
        once = made(2, "I", f"b{d}", f"'{said[d]}:'")
        twice = f"{{'c': b{due[d]}.c + 4, 'a': 'II' || b{due[d]}.a, 'r': list_concat(['{said[d]}:', '{said[due[d]]}:'], b{due[d]}.r)}}"
        ends.append(f"list_sort([b{s}, {once}, {twice}])[1] AS s{s}")
    return f"SELECT conv_id, i, {', '.join(ends)} FROM (SELECT p.conv_id, w.i, {', '.join(plain)} FROM p JOIN w ON w.conv_id = p.conv_id AND w.i = p.i - 1)"


OP13_SQL = (
    "WITH RECURSIVE "
    + _CRC_TABLE
    + r""",
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS r, coalesce(text, ' ') AS x, """
    + _CRC.format("conv_id || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")
    + r""" % 20 AS k FROM conversations CROSS JOIN tab WHERE conv_id IS NOT NULL),
g AS (SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE r END AS r, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(x, '[.!?]', '', 'g') ELSE x END AS x, unnest(CASE k WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM c WHERE k <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, sha256(x), again) AS i FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, r, x ORDER BY turn NULLS FIRST) > 1 AS again FROM g)),
w AS (SELECT conv_id, i, turn, r, x, r[1] AS i0, lag(r[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before, NOT regexp_matches(x, '[^\x20\x09-\x0D]') AS blank, regexp_matches(x, '[^\x20\x09-\x0D]') AND again AS dup,
  regexp_matches(x, '[^\x20\x09-\x0D]') AND NOT again AND regexp_extract(x, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') AS short, blank OR dup AS gone, short::INT AS cut FROM o),
q AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (short) AS truncated, count(*) FILTER (before IS NOT NULL AND before || i0 NOT IN ('su', 'ua', 'au')) AS illegal FROM w GROUP BY 1),
p(conv_id, i, s0, s1, s2, s3) AS (SELECT conv_id, n + 1, {'c': 0, 'a': '', 'r': CAST([] AS VARCHAR[])}, {'c': 4, 'a': 'II', 'r': ['user:', 'assistant:']}, {'c': 2, 'a': 'I', 'r': ['assistant:']}, {'c': 0, 'a': '', 'r': CAST([] AS VARCHAR[])} FROM q
  UNION ALL """
    + _repair_step()
    + r""")
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(s0.c, 0) AS BIGINT) AS cost, coalesce(s0.a, '') AS audit, sha256(coalesce(array_to_string(s0.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM c) LEFT JOIN q USING (conv_id) LEFT JOIN (SELECT * FROM p WHERE i = 1) USING (conv_id)
"""
)
