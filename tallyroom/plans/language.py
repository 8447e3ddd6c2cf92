"""Queries over words, phrases, likeness and what texts say."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroom.functions import phrases as ph
from tallyroom.functions import text as tx
from tallyroom.operators import texts as ts
from tallyroom.plans.filters import chosen, made
from tallyroom.plans.registry import query, r6
from tallyroom.sources.tables import read


def _made(table: str, key: str, rows: list[tuple], columns: str) -> str:
    """SQL of what is stated for texts that are made of a table's keys: the first member of a row is the text."""
    return f"SELECT {key}, {columns} FROM {table} JOIN {made([(i, *r[1:]) for i, r in enumerate(rows)], f'k, {columns}')} ON {key} % {len(rows)} = k"


STEMS = [
    ("kotłowego", "kotlow", "kotłow"), ("Spawacze", "spawacz", "spawacz"), ("testowanie", "testowan", "testow"), ("księgowości", "ksiegowosci", "księgow"), ("sql", "sql", "sql"), ("python", "python", "python"),
    ("programistami", "programist", "programist"), ("ma", "ma", "ma"), ("robotów", "robot", "robot"), ("drukarka", "drukar", "drukark"),
]


@query("""
WITH w AS (SELECT DISTINCT lower(unnest(regexp_split_to_array(text, '[^\\p{L}]+'))) AS word FROM documents), f AS (SELECT word, regexp_replace(replace(strip_accents(word), 'ł', 'l'), '[^a-z0-9-]', '', 'g') AS b FROM w WHERE word <> ''),
g AS (SELECT word, regexp_replace(regexp_replace(b, 'ciol$', 'cotol'), 'kotl', 'cotol') AS b FROM f)
SELECT word, CASE WHEN length(word) <= 3 THEN word ELSE regexp_replace(b, '^(.{3,}?)(?:owego|owych|owym|owski|owska|owek|ami|ach|ego|ych|ich|nym|nej|ow|om|em|ie|iu|ki|ka|ke|y|a|e|o)$', '\\1') END AS stem,
  CASE WHEN length(word) <= 3 OR length(word) <= 6 AND regexp_matches(word, '^[a-z0-9#+.-]+$') THEN word ELSE
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(word, '(?:nościami|nościach|nością|ności|stwem|stwach|stwu)$', ''), '(?:eniach|eniom|eniem|enie|enia|eniu)$', ''), '(?:aniach|aniom|aniem|anie|ania|aniu)$', ''),
  '(?:owałem|owałeś|owaliśmy|owali|ować|uję|ujesz|ują)$', ''), '(?:ałem|ałeś|aliśmy|ałam|ałaś)$', ''), '(?:owali|owały|owało)$', ''), '(?:ami|ach|owi|ego|emu|ich|ych|iej|iem|ym)$', ''), '(?:em|ie|om|ów|ej|ey)$', ''), '(?:a|e|i|o|u|y|ę|ą)$', '') END AS light FROM g
""")
def word_stems(spark, d) -> DataFrame:
    """Stems of all words of the documents, by both rules."""
    w = read(spark, d, "documents").select(F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^\\p{L}]+")).alias("word")).where("word <> ''").distinct()
    return w.select("word", tx.stem_word(F.col("word")).alias("stem"), tx.stem_light(F.col("word")).alias("light"))


_TRI = "list_distinct(list_transform(range(1, length('  ' || {0} || ' ') - 1), lambda i: substr('  ' || {0} || ' ', i, 3)))"
_TRIGRAM = f"CASE WHEN {{a}} = {{b}} THEN 1.0::DOUBLE ELSE len(list_intersect({_TRI.format('{a}')}, {_TRI.format('{b}')})) / len(list_distinct(list_concat({_TRI.format('{a}')}, {_TRI.format('{b}')})))::DOUBLE END"
# Jaro by hand, letter by letter: i letters of a are read, mask marks b's letters that are taken, l holds a's that were
_JARO = """j(a, b, i, mask, l) AS (SELECT a, b, 0, repeat('0', length(b)), '' FROM x UNION ALL SELECT a, b, i + 1, CASE WHEN k IS NULL THEN mask ELSE left(mask, k - 1) || '1' || substr(mask, k + 1) END, CASE WHEN k IS NULL THEN l ELSE l || substr(a, i + 1, 1) END
  FROM (SELECT *, list_filter(range(greatest(1, i + 1 - (greatest(length(a), length(b)) // 2 - 1)), least(length(b), i + 1 + (greatest(length(a), length(b)) // 2 - 1)) + 1), lambda n: substr(mask, n, 1) = '0' AND substr(b, n, 1) = substr(a, i + 1, 1))[1] AS k FROM j) WHERE i < length(a)),
m AS (SELECT a, b, l, array_to_string(list_transform(list_filter(range(1, length(b) + 1), lambda n: substr(mask, n, 1) = '1'), lambda n: substr(b, n, 1)), '') AS r FROM j WHERE i = length(a)),
w AS (SELECT a, b, CASE WHEN l = '' THEN 0 ELSE (length(l) / length(a)::DOUBLE + length(l) / length(b)::DOUBLE + (length(l) - len(list_filter(range(1, length(l) + 1), lambda n: substr(l, n, 1) <> substr(r, n, 1))) / 2.0::DOUBLE) / length(l)) / 3 END AS jaro FROM m),
jw AS (SELECT a, b, CASE WHEN a = b THEN 1.0::DOUBLE ELSE jaro + 0.1::DOUBLE * (1 - jaro) * len(list_filter(range(1, 5), lambda n: n <= length(a) AND n <= length(b) AND left(a, n) = left(b, n))) END AS jw FROM w)"""
SOUGHT = ("small rings", "red wigdet", "blue bolt", "larg gear", "ringowa", "new", "cold plates")
_NAMES = "n AS (SELECT DISTINCT lower(p_name) AS t FROM part), q(q) AS (VALUES " + ", ".join(f"('{x}')" for x in SOUGHT) + ")"
_STEM = "array_to_string(list_transform(string_split({0}, ' '), lambda w: CASE WHEN length(w) <= 3 THEN w ELSE regexp_replace(w, '^(.{{3,}}?)(?:owego|owych|owym|owski|owska|owek|ami|ach|ego|ych|ich|nym|nej|ow|om|em|ie|iu|ki|ka|ke|y|a|e|o)$', '\\1') END), ' ')"


def _pairs(spark, d) -> DataFrame:
    """A list of queries, sent to all names."""
    names = read(spark, d, "part").select(F.lower("p_name").alias("t")).distinct()
    return names.withColumn("q", F.explode(F.array(*[F.lit(x) for x in SOUGHT])))


@query(f"""
WITH RECURSIVE {_NAMES}, x AS (SELECT q AS a, t AS b FROM q, n), {_JARO}
SELECT a AS q, b AS t, round(jw, 6) AS jaro_winkler, round({_TRIGRAM.format(a='a', b='b')}, 6) AS trigram, round(1 - levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE, 6) AS edit FROM jw
""")
def likeness_pairs(spark, d) -> DataFrame:
    """Three measures of likeness of queries and names."""
    q, t = F.col("q"), F.col("t")
    return r6(_pairs(spark, d).select("q", "t", tx.jaro_winkler(q, t).alias("jaro_winkler"), tx.trigram_similarity(q, t).alias("trigram"), tx.edit_similarity(q, t).alias("edit")))


@query(f"""
WITH RECURSIVE {_NAMES}, s AS (SELECT q, t, {_STEM.format('q')} AS sq, {_STEM.format('t')} AS st FROM q, n), x AS (SELECT q AS a, t AS b FROM s UNION SELECT sq, st FROM s), {_JARO}
SELECT q, t, CASE WHEN q = t THEN 1.0::DOUBLE WHEN contains(t, q) THEN 0.88::DOUBLE WHEN contains(q, t) THEN 0.78::DOUBLE WHEN sq = st THEN 0.95::DOUBLE WHEN contains(st, sq) OR contains(sq, st) THEN 0.85::DOUBLE
  ELSE floor((0.35::DOUBLE * o.jw + 0.35::DOUBLE * p.jw + 0.2::DOUBLE * ({_TRIGRAM.format(a='q', b='t')}) + 0.1::DOUBLE * (1 - levenshtein(q, t) / greatest(length(q), length(t))::DOUBLE)) * 100 + 0.5) / 100 END AS likeness
FROM s JOIN jw o ON o.a = q AND o.b = t JOIN jw p ON p.a = sq AND p.b = st
""")
def hybrid_likeness(spark, d) -> DataFrame:
    return r6(_pairs(spark, d).select("q", "t", tx.hybrid_similarity(F.col("q"), F.col("t")).alias("likeness")))


CLAIMS = [
    ("I used red widgets daily. I know Python3 well", True), ("I did not use python", False), ("Not java; python every day", True), ("learning python", False), ("The job requires python", False), ("Python - in training", False), ("my team used python", False),
    ("my colleague used java but I used python", True), ("pythonic code", False), ("no java. PYTHON", True), ("without python, never python!", False), ("pýthon", True), ("", False), (None, False), ("c++ and python/sql", True),
]


@query(_made("orders", "o_orderkey", CLAIMS, "positive"))
def positive_evidence(spark, d) -> DataFrame:
    """Whether claims that are made of keys are evidence of a skill."""
    return read(spark, d, "orders").select("o_orderkey", ph.positive_evidence(chosen(F.col("o_orderkey"), [c for c, _ in CLAIMS]), "python").alias("positive"))


@query("""
WITH w AS (SELECT doc_id, ' ' || replace(array_to_string(regexp_split_to_array(replace(strip_accents(lower(coalesce(text, ''))), 'ł', 'l'), '[^\\p{L}\\p{N}_#+]+'), '  '), ' of the ', ' of the ') || ' ' AS t FROM documents)
SELECT doc_id, CAST(len(string_split(t, ' the ')) - 1 AS BIGINT) AS n_the, CASE WHEN contains(t, ' und ') THEN 'und' WHEN contains(t, ' the ') THEN 'the' END AS first FROM w
""")
def phrase_mentions(spark, d) -> DataFrame:
    """How often a phrase stands in each document, and the first of a list that does."""
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", ph.phrase_count(t, "the").cast("long").alias("n_the"), ph.mention(t, ["und", "the"]).alias("first"))


OFFERS = [
    ("Python. Nice to have: SQL, Java. English.", "Python.  . English."), ("SQL preferred and required Java", "SQL  required Java"), ("Nice to have Go Requirements: C", " Requirements: C"), ("plain", "plain"), ("", ""),
]


@query(_made("customer", "c_custkey", OFFERS, "kept"))
def without_optional(spark, d) -> DataFrame:
    text = chosen(F.col("c_custkey"), [o for o, _ in OFFERS])
    return read(spark, d, "customer").select("c_custkey", ph.without_optional(text, "nice to have|preferred", "\\brequired\\b", "requirements|duties").alias("kept"))


SENTENCES = [("We use C++ and Node.js, daily.", "use c++ node.js daily"), ("«Testy» - CI/CD/ (oraz) QA!", "testy ci/cd oraz qa"), ("a ż 7 we", ""), (None, "")]


@query(_made("customer", "c_custkey", SENTENCES, "words"))
def sentence_words(spark, d) -> DataFrame:
    return read(spark, d, "customer").select("c_custkey", F.array_join(ph.sentence_words(chosen(F.col("c_custkey"), [s for s, _ in SENTENCES]), ["we", "and"]), " ").alias("words"))


FACTS = [("grew by 40 % and 12 000 osob", "12000osob 40%"), ("40 procent; +7,5 mln", "40% 7.5mln"), ("−3 dni, v2x", "-3dni"), ("none", "")]


@query(_made("customer", "c_custkey", FACTS, "metrics"))
def said_metrics(spark, d) -> DataFrame:
    """Numbers of texts in one form, sorted."""
    return read(spark, d, "customer").select("c_custkey", F.array_join(F.array_sort(ph.said_metrics(chosen(F.col("c_custkey"), [f for f, _ in FACTS]))), " ").alias("metrics"))


@query("""
WITH u AS (SELECT conv_id, list_distinct(list_transform(string_split(lower(string_agg(text, ' ') FILTER (role = 'assistant')), ' '), lambda t: trim(t))) AS said, list_distinct(list_transform(string_split(lower(string_agg(text, ' ') FILTER (role = 'user')), ' '), lambda t: trim(t))) AS known FROM conversations GROUP BY 1)
SELECT conv_id, CAST(len(list_filter(said, lambda t: NOT list_contains(known, t))) AS BIGINT) AS n_unknown FROM u WHERE said IS NOT NULL AND known IS NOT NULL
""")
def unknown_terms(spark, d) -> DataFrame:
    """How many words of the answers the questions lack."""
    rows = read(spark, d, "conversations").select("conv_id", "role", F.explode(F.split("text", " ")).alias("t"))
    return ts.unknown_counts(rows.where("role = 'assistant'"), rows.where("role = 'user'"), "conv_id", "t")


@query("""
WITH p AS (SELECT p_brand, list(DISTINCT w) AS w FROM (SELECT p_brand, unnest(string_split(p_type || ' ' || p_name, ' ')) AS w FROM part) GROUP BY 1)
SELECT a.p_brand AS a, b.p_brand AS b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE, 4) AS jaccard, round(len(list_intersect(a.w, b.w)) / len(a.w)::DOUBLE, 6) AS coverage FROM p a JOIN p b ON a.p_brand < b.p_brand
""")
def set_overlaps(spark, d) -> DataFrame:
    """Words of the brands against each other: symmetric and of what one asks for; brands are a short list."""
    p = read(spark, d, "part").select("p_brand", F.explode(F.split(F.concat_ws(" ", "p_type", "p_name"), " ")).alias("w")).groupBy("p_brand").agg(F.collect_set("w").alias("w"))
    pairs = p.select(F.col("p_brand").alias("a"), F.col("w").alias("wa")).join(p.select(F.col("p_brand").alias("b"), F.col("w").alias("wb")), F.col("a") < F.col("b"))
    return r6(pairs.select("a", "b", tx.jaccard(F.col("wa"), F.col("wb")).alias("jaccard"), tx.coverage(F.col("wa"), F.col("wb")).alias("coverage")))


JARGON = {"widget": "gadget", "ring": "annular part", "wigdet": "widget"}


@query("SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: CASE w WHEN 'widget' THEN 'gadget' WHEN 'ring' THEN 'annular part' ELSE w END), ' ') AS name FROM part")
def jargon_names(spark, d) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", ph.substituted(F.col("p_name"), JARGON).alias("name"))


@query("""
WITH v(verb, noun, actor) AS (VALUES ('bolt', 'bolting', 'bolter'), ('gear', 'gearing', 'gearer'), ('plate', 'plating', 'plater')), n AS (SELECT DISTINCT lower(p_name) AS name FROM part), w AS (SELECT DISTINCT name, unnest(string_split(name, ' ')) AS w FROM n)
SELECT DISTINCT name, noun, actor FROM w JOIN v ON contains(w, verb) OR contains(w, noun) OR contains(w, actor)
""")
def actor_expansion(spark, d) -> DataFrame:
    """Nouns and actors of the verbs within a name's words; the table of verbs is a short list that is sent to all names."""
    verbs = F.array(*[F.struct(F.lit(a).alias("verb"), F.lit(b).alias("noun"), F.lit(c).alias("actor")) for a, b, c in (("bolt", "bolting", "bolter"), ("gear", "gearing", "gearer"), ("plate", "plating", "plater"))])
    names = read(spark, d, "part").select(F.lower("p_name").alias("name")).distinct()
    w = names.select("name", F.explode(F.split("name", " ")).alias("w")).select("name", F.explode(F.filter(verbs, lambda v: F.col("w").contains(v["verb"]) | F.col("w").contains(v["noun"]) | F.col("w").contains(v["actor"]))).alias("v"))
    return w.select("name", "v.noun", "v.actor").distinct()


@query("SELECT p_partkey, array_to_string(list_filter([CASE WHEN contains(lower(p_name), 'ring') THEN 'Round' END, CASE WHEN regexp_matches(lower(p_name), 'bolt|gear') THEN 'PROMO' END, CASE WHEN starts_with(lower(p_name), 'small') THEN 'Tiny' END], lambda t: t IS NOT NULL AND NOT list_contains(string_split(lower(p_type), ' '), lower(t))), ',') AS tags FROM part")
def tag_suggestions(spark, d) -> DataFrame:
    rules = [("Round", "ring"), ("PROMO", "bolt|gear"), ("Tiny", "^small")]
    return read(spark, d, "part").select("p_partkey", F.array_join(ph.suggested_tags(F.col("p_name"), rules, F.split("p_type", " ")), ",").alias("tags"))


LETTERS = [
    ("Jan Kowalski, jan@a.example, +48 600 700 800", "[KANDYDAT], [EMAIL], [TELEFON]", 3), ("Jan and Jan Kowalski: jan@a.example or x@b.example or jan@a.example", "[KANDYDAT_2] and [KANDYDAT]: [EMAIL] or [EMAIL_2] or [EMAIL]", 4),
    ("see https://c.example/p?q=1 12345678901", "see [LINK] [ID]", 2), ("in 2019-07 and 123-456", "in 2019-07 and 123-456", 0), ("", "", 0), (None, "", 0),
]


_MAIL, _PHONE = "[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\\.[A-Za-z0-9_.-]+", "(?:\\+[0-9]{1,3}[\\s-]?)?(?:\\([0-9]{1,4}\\)[\\s-]?)?[0-9]{2,3}[\\s-]?[0-9]{2,3}[\\s-]?[0-9]{2,4}\\b"


@query(f"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '{_MAIL}', '[M]', 'g') AS u FROM documents), b AS (SELECT *, regexp_replace(u, '\\b[0-9]{{11}}\\b', '[I]', 'g') AS v FROM a), c AS (SELECT *, regexp_replace(v, '\\bhttps?://[^\\s<>"'']+', '[L]', 'g') AS w FROM b),
f AS (SELECT doc_id, t, list_filter(list_distinct(regexp_extract_all(w, '{_PHONE}')), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 9 AND 15) AS phones, list_distinct(regexp_extract_all(t, '{_MAIL}')) AS mails, list_distinct(regexp_extract_all(u, '\\b[0-9]{{11}}\\b')) AS ids, list_distinct(regexp_extract_all(v, '\\bhttps?://[^\\s<>"'']+')) AS links FROM c)
SELECT doc_id, CAST(len(mails) + len(ids) + len(links) + len(phones) AS INTEGER) AS n_hidden, true AS restored, true AS hidden FROM f
""")
def pseudonymised_documents(spark, d) -> DataFrame:
    """Placeholders in documents: how many, that the texts can be had back, and that no address is left."""
    rows = read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"), ph.pseudonyms(F.col("text"), F.array().cast("array<string>")).alias("p"))
    return rows.select("doc_id", F.size("p.map").alias("n_hidden"), (ph.restored(F.col("p.text"), F.col("p.map")) == F.col("t")).alias("restored"), (~F.col("p.text").rlike("[A-Za-z0-9]@[A-Za-z0-9-]+\\.[A-Za-z]")).alias("hidden"))


@query(_made("orders", "o_orderkey", [(None, t, n, True) for _, t, n in LETTERS], "text, n_hidden, restored"))
def pseudonymised(spark, d) -> DataFrame:
    """Texts that are made of keys with placeholders, and whether they can be had back."""
    text = chosen(F.col("o_orderkey"), [t for t, _, _ in LETTERS])
    rows = read(spark, d, "orders").select("o_orderkey", text.alias("t"), ph.pseudonyms(text, F.array(F.lit("Jan"), F.lit("Jan Kowalski"), F.lit("J"))).alias("p"))
    return rows.select("o_orderkey", "p.text", F.size("p.map").alias("n_hidden"), (ph.restored(F.col("p.text"), F.col("p.map")) == F.coalesce("t", F.lit(""))).alias("restored"))


@query("SELECT doc_id, regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[email]', 'g'), '\\+?[0-9](?:[ -]?[0-9]){8,14}', '[phone]', 'g') AS shown FROM documents")
def redacted(spark, d) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", tx.redact(F.col("text")).alias("shown"))


STACKS = [
    ("TypeError: boom\n    at run (https://a.example/js/app.js:10:5)\n    at C:\\x\\y.js:7:1\n    at <anonymous>", "run@app.js:10|@y.js:7|<anonymous>@:"), ("f@https://b.example/z.js:3:9\n@w.js:4:1\n@", "f@z.js:3|@w.js:4"), ("Error\n  at App\n  Panel\n", "App@:|Panel@:"), (None, ""), ("a\nb\nc\nd\ne\nf", "a@:|b@:|c@:|d@:|e@:"),
]


@query(_made("orders", "o_orderkey", STACKS, "frames"))
def stack_frames(spark, d) -> DataFrame:
    """The frames of stacks that are made of keys."""
    frames = ph.stack_frames(chosen(F.col("o_orderkey"), [s for s, _ in STACKS]))
    show = lambda f: F.concat(F.coalesce(f["fn"], F.lit("")), F.lit("@"), F.coalesce(f["file"], F.lit("")), F.lit(":"), F.coalesce(f["line"].cast("string"), F.lit("")))
    return read(spark, d, "orders").select("o_orderkey", F.array_join(F.transform(frames, show), "|").alias("frames"))


@query("""
WITH s AS (SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' ' || p_partkey), '[0-9]+', '#', 'g'), '\\s+', ' ', 'g') AS t FROM part)
SELECT p_partkey, lpad(format('{:x}', CAST(list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split(t, ''), lambda c: ascii(c)::HUGEINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS BIGINT)), 8, '0') AS mark FROM s
""")
def fingerprints(spark, d) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", tx.fingerprint(F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string"))).alias("mark"))


LINES = [("one two three four five", "one two three four", 2), ("mmmm mmm", "mmmm mmm", 2), ("", "", 0), (None, "", 0), ("averyveryverylongword x y", "averyveryverylongword x y", 2), ("ab cd", "ab cd", 1)]


@query(_made("customer", "c_custkey", LINES, "text, n_lines"))
def wrapped_lines(spark, d) -> DataFrame:
    return read(spark, d, "customer").select("c_custkey", ph.wrapped(chosen(F.col("c_custkey"), [t for t, _, _ in LINES]), 10.0, 2).alias("w")).select("c_custkey", "w.*")


RANGES = [
    ("2019-07", 24234, 24234), ("07.2019 - 09.2020", 24234, 24248), ("2018–2020", 24216, 24240), ("2019-07-2020-01", 24234, 24240), ("2020 / 2018", None, None), ("Jan 2019 — Mar 2019", 24228, 24230), ("1-2-3", None, None), (None, None, None),
]


@query(_made("orders", "o_orderkey", RANGES, "first, last"))
def month_ranges(spark, d) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", ph.month_range(chosen(F.col("o_orderkey"), [r for r, _, _ in RANGES])).alias("r")).select("o_orderkey", "r.*")


@query(r"""
SELECT conv_id, turn, trim(regexp_replace(regexp_replace(replace(strip_accents(lower(coalesce(text, ''))), 'ł', 'l'), '[^a-z0-9 -]', ' ', 'g'), ' +', ' ', 'g')) AS term FROM conversations
""")
def normal_turns(spark, d) -> DataFrame:
    """Every turn in the form of a search term."""
    return read(spark, d, "conversations").select("conv_id", "turn", tx.normal_term(F.coalesce("text", F.lit(""))).alias("term"))


@query(r"""
WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[,;:!?()\[\]{}"''«»„”…‘’‚‛′“‟″]', ' ', 'g'), '[.](\s|$)', ' \1', 'g'), '[.](\s|$)', ' \1', 'g') AS t FROM documents),
w AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(t, '\s+'), lambda x: regexp_replace(x, '^[-/]+|[-/]+$', '', 'g')), lambda x: length(x) > 1 AND regexp_matches(x, '[a-ząćęłńóśźż0-9]') AND x NOT IN ('the', 'und')) AS w FROM t)
SELECT doc_id, CAST(len(w) AS INTEGER) AS n, md5(array_to_string(w, ' ')) AS words FROM w
""")
def words_of_documents(spark, d) -> DataFrame:
    """Words of documents without signs and function words."""
    words = ph.sentence_words(F.col("text"), ["the", "und"])
    return read(spark, d, "documents").select("doc_id", words.alias("w")).select("doc_id", F.size("w").alias("n"), F.md5(F.array_join("w", " ")).alias("words"))


@query("""
WITH o AS (SELECT o_orderkey, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER) AS m, CAST(o_orderkey % 40 AS INTEGER) AS n FROM orders)
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 2 THEN m // 12 * 12 WHEN 4 THEN CASE WHEN n = 0 THEN m END ELSE m END AS first, CASE o_orderkey % 5 WHEN 0 THEN m WHEN 2 THEN (m + n) // 12 * 12 WHEN 4 THEN CASE WHEN n = 0 THEN m END ELSE m + n END AS last FROM o
""")
def order_ranges(spark, d) -> DataFrame:
    """Ranges of months that are written in five ways, from each order's date: alone, with points, as years, with slashes, and turned round."""
    at, k = F.to_date("o_orderdate"), F.col("o_orderkey")
    end = F.add_months(at, (k % 40).cast("int"))
    say = lambda form, a, mark, b: F.concat(F.date_format(a, form), F.lit(mark), F.date_format(b, form))
    text = F.when(k % 5 == 0, F.date_format(at, "yyyy-MM")).when(k % 5 == 1, say("MM.yyyy", at, " - ", end)).when(k % 5 == 2, say("yyyy", at, "–", end)).when(k % 5 == 3, say("yyyy-MM", at, " / ", end)).otherwise(say("MM.yyyy", end, " — ", at))
    return read(spark, d, "orders").select("o_orderkey", ph.month_range(text).alias("r")).select("o_orderkey", "r.*")
