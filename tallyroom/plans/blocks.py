"""Queries over columns, blocks and where blocks stand in another text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroom.operators import blocks as bl
from tallyroom.plans.registry import query, r6
from tallyroom.sources.tables import read

#: Each comma of a document as a bar: some texts have columns by that, some fields, some neither.
ROLES, FIRMS = ["the", "und"], ["of", "die", "in"]
HEADS = {"SHORT": "[a-z ]{1,25}[.]", "NUMBERED": "[0-9].*"}


@query(r"""
WITH t AS (SELECT doc_id, replace(text, ', ', ' | ') AS t FROM documents), l AS (SELECT doc_id, t, string_split(coalesce(t, ''), chr(10)) AS l FROM t),
s AS (SELECT doc_id, t, list_transform(l, lambda x: {'barred': contains(x, '|'), 'l': trim(CASE WHEN contains(x, '|') THEN left(x, instr(x, '|') - 1) ELSE x END), 'r': CASE WHEN contains(x, '|') THEN trim(substr(x, instr(x, '|') + 1)) ELSE '' END}) AS s, list_filter(l, lambda x: regexp_matches(x, '[^ ]')) AS said FROM l),
b AS (SELECT *, list_filter(s, lambda x: x.barred AND x.l <> '' AND trim(string_split(x.r, '|')[1]) <> '') AS b FROM s),
f AS (SELECT *, len(list_filter(b, lambda x: regexp_matches(' ' || regexp_replace(replace(strip_accents(lower(x.l)), 'ł', 'l'), '[^\p{L}\p{N}]+', ' ', 'g') || ' ', ' the | und ') AND regexp_matches(' ' || regexp_replace(replace(strip_accents(lower(x.r)), 'ł', 'l'), '[^\p{L}\p{N}]+', ' ', 'g') || ' ', ' of | die | in '))) AS f FROM b)
SELECT doc_id, sha256(CASE WHEN len(said) >= 4 AND len(b) >= 0.28::DOUBLE * len(said) AND len(b) > 0 AND NOT (f >= 2 AND f >= 0.5::DOUBLE * len(b)) THEN array_to_string(list_concat(list_filter(list_transform(s, lambda x: x.l), lambda x: x <> ''), [''], list_filter(list_transform(s, lambda x: x.r), lambda x: x <> '')), chr(10)) ELSE t END) AS text_sha256 FROM f
""")
def unwrapped_columns(spark, d) -> DataFrame:
    """Documents with bars for commas: columns one after the other."""
    rows = read(spark, d, "documents").select("doc_id", F.replace("text", F.lit(", "), F.lit(" | ")).alias("t"))
    return rows.select("doc_id", F.sha2(bl.unwrapped_columns(F.col("t"), ROLES, FIRMS), 256).alias("text_sha256"))


_BLOCKS = r"""l AS (SELECT doc_id, generate_subscripts(x, 1) AS i, trim(unnest(x)) AS x FROM (SELECT doc_id, string_split(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS x FROM documents)),
h AS (SELECT *, CASE WHEN regexp_full_match(lower(x), '[a-z ]{1,25}[.]') THEN 'SHORT' WHEN regexp_full_match(lower(x), '[0-9].*') THEN 'NUMBERED' END AS k FROM l WHERE x <> ''),
g AS (SELECT *, count(k) OVER w AS g, coalesce(last_value(k IGNORE NULLS) OVER w, 'HEADER') AS section FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
b AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS block, section, content FROM (SELECT doc_id, g, any_value(section) AS section, string_agg(x, chr(10) ORDER BY i) AS content FROM g WHERE k IS NULL GROUP BY 1, 2))"""


@query(f"WITH {_BLOCKS} SELECT doc_id, CAST(block AS INTEGER) AS block, section, sha256(content) AS content_sha256 FROM b")
def text_blocks(spark, d) -> DataFrame:
    """Blocks of documents under short and numbered lines."""
    found = bl.text_blocks(read(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", HEADS)
    return found.select("doc_id", "block", "section", F.sha2("content", 256).alias("content_sha256"))


@query(rf"""
WITH {_BLOCKS}, t AS (SELECT doc_id, trim(regexp_replace(lower(CASE doc_id % 3 WHEN 0 THEN array_to_string(list_reverse(string_split(coalesce(text, ''), chr(10))), chr(10)) WHEN 1 THEN replace(coalesce(text, ''), 'the', 'The ') ELSE coalesce(text, '') END), '\s+', ' ', 'g')) AS t FROM documents),
s AS (SELECT b.doc_id, block, 1 + (block % 3) / 2.0::DOUBLE AS w, trim(regexp_replace(lower(content), '\s+', ' ', 'g')) AS c, t FROM b JOIN t USING (doc_id)), p AS (SELECT doc_id, block, w, nullif(instr(t, c), 0) - 1 AS place FROM s WHERE length(c) >= 3),
o AS (SELECT x.doc_id, sum(least(x.w, y.w)) AS all_, sum(CASE WHEN x.place > y.place THEN least(x.w, y.w) ELSE 0 END) AS turned FROM p x JOIN p y ON x.doc_id = y.doc_id AND x.block < y.block AND x.place <> y.place GROUP BY 1)
SELECT p.doc_id, count(*) AS n_blocks, count(place) AS n_located, round(coalesce(sum(w) FILTER (place IS NOT NULL), 0) / sum(w), 6) AS coverage, round(any_value(turned / all_), 6) AS discordance FROM p LEFT JOIN o USING (doc_id) GROUP BY 1
""")
def source_agreement(spark, d) -> DataFrame:
    """Blocks of documents against a text that was turned round, changed or kept."""
    docs = read(spark, d, "documents").select("doc_id", "text")
    whole, k = F.coalesce("text", F.lit("")), F.col("doc_id") % 3
    other = F.when(k == 0, F.array_join(F.reverse(F.split(whole, "\n")), "\n")).when(k == 1, F.replace(whole, F.lit("the"), F.lit("The "))).otherwise(whole)
    found = bl.source_agreement(bl.text_blocks(docs, "doc_id", "text", HEADS), docs.select("doc_id", other.alias("other")), "doc_id", "block", "content", "other", 1 + (F.col("block") % 3) / 2)
    return r6(found.drop("in_order"))
