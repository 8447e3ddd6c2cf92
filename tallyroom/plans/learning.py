"""Queries over labelled corpora, calibration and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroom.operators import calibration as cal
from tallyroom.operators import learning as ln
from tallyroom.plans.registry import query, r6
from tallyroom.sources.tables import read

_NAMED = "lower(coalesce(text, ''))"
for _sign, _name in ((r"c\+\+", "cpp"), ("c#", "csharp"), (r"\.net", "dotnet"), (r"node\.js", "nodejs"), (r"react\.js", "react"), (r"vue\.js", "vue"), ("k8s", "kubernetes")):
    _NAMED = f"regexp_replace({_NAMED}, '(^|[^\\p{{L}}\\p{{N}}]){_sign}($|[^\\p{{L}}\\p{{N}}])', ' {_name} \\2', 'g')"
TOKENS = f"list_filter(list_transform(regexp_split_to_array(regexp_replace(translate({_NAMED}, '–—', '--'), '\\[[^\\]]+\\]', ' ', 'g'), '[^\\p{{L}}\\p{{N}}+.#/-]+'), lambda t: regexp_replace(t, '^[+./-]+|[+./-]+$', '', 'g')), lambda t: len(t) BETWEEN 2 AND 48 AND regexp_matches(t, '\\p{{L}}') AND NOT starts_with(t, 'www.'))"
UNIQUE = "u AS (SELECT md5(text) AS form, min(doc_id) AS doc_id, max(quality) AS quality, any_value(text) AS text FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL GROUP BY 1)"
FEATURES = f"""{UNIQUE}, w AS (SELECT DISTINCT doc_id, quality, unnest({TOKENS}) AS feature FROM u),
t AS (SELECT quality, count(*) AS dp FROM u GROUP BY 1), n AS (SELECT feature, count(*) AS n FROM w GROUP BY 1), p AS (SELECT quality, feature, count(*) AS sp FROM w GROUP BY 1, 2),
c AS (SELECT p.quality AS label, p.feature, sp, n - sp AS sn, dp, (SELECT count(*) FROM u) - dp AS dn FROM p JOIN n USING (feature) JOIN t USING (quality) WHERE n >= 5),
o AS (SELECT *, ln((sp + 0.5) / (dp - sp + 0.5)) - ln((sn + 0.5) / (dn - sn + 0.5)) AS log_odds, ((sp + 0.5) / (dp + 1.0)) / ((sn + 0.5) / (dn + 1.0)) AS lift, 1 / (sp + 0.5::DOUBLE) + 1 / (dp - sp + 0.5::DOUBLE) + 1 / (sn + 0.5::DOUBLE) + 1 / (dn - sn + 0.5::DOUBLE) AS var FROM c WHERE dn > 0),
z AS (SELECT *, log_odds / sqrt(var) AS z, least(1, (1 - exp(-(sp + sn) / 8.0::DOUBLE)) * least(1, abs(log_odds / sqrt(var)) / 4)) AS confidence FROM o),
f AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(abs(z), 9) DESC, round(confidence, 9) DESC, feature) AS r FROM z WHERE abs(z) >= 2 AND CASE WHEN log_odds >= 0 THEN lift >= 1.5 ELSE 1 / greatest(lift, 1e-9) >= 1.5 END)"""


def _unique(spark, d) -> DataFrame:
    docs, labels = read(spark, d, "documents").select("doc_id", "text"), read(spark, d, "labels").select("doc_id", "quality")
    rows = docs.where("text IS NOT NULL").join(labels, "doc_id").withColumn("labels", F.array(F.col("quality")))
    return ln.dedup_corpus(rows.drop("quality"), F.md5("text"), "doc_id", "labels").withColumn("quality", F.array_max("labels"))


@query(f"WITH {FEATURES} SELECT label, feature, sp, sn, dp, dn, round(log_odds, 6) AS log_odds, round(z, 6) AS z, round(lift, 6) AS lift, round(confidence, 6) AS confidence, CASE WHEN log_odds >= 0 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS direction FROM f WHERE r <= 120")
def lexeme_log_odds(spark, d) -> DataFrame:
    """The words that set a label's documents apart, of distinct texts."""
    found = ln.lexeme_features(_unique(spark, d).select("quality", "text"), "text", "quality", most=1, meta=False)
    return r6(found.withColumnRenamed("quality", "label").select("label", "feature", "sp", "sn", "dp", "dn", "log_odds", "z", "lift", "confidence", "direction"))


@query(f"""
WITH {FEATURES}, g AS (SELECT feature, log_odds, confidence AS c FROM f WHERE r <= 120 AND label = 1),
h AS (SELECT DISTINCT doc_id, feature FROM (SELECT doc_id, unnest({TOKENS}) AS feature FROM documents)),
k AS (SELECT doc_id, feature, least(1, greatest(-1, log_odds / 4)) AS s, c, row_number() OVER (PARTITION BY doc_id ORDER BY round(abs(least(1, greatest(-1, log_odds / 4)) * c), 9) DESC, feature) AS rk FROM h JOIN g USING (feature)),
a AS (SELECT doc_id, count(*) AS n_matched, sum(s * c) / sum(c) AS strength, 1 - exp(sum(ln(greatest(1e-12, 1 - c)))) AS confidence FROM k WHERE rk <= 24 GROUP BY 1)
SELECT doc_id, coalesce(n_matched, 0) AS n_matched, round(coalesce(strength, 0), 6) AS strength, round(coalesce(confidence, 0), 6) AS confidence, round(least(5, greatest(-5, coalesce(strength * confidence * 5, 0))), 6) AS adjustment FROM documents LEFT JOIN a USING (doc_id)
""")
def runtime_signal(spark, d) -> DataFrame:
    """What the learned words say of every document."""
    found = ln.lexeme_features(_unique(spark, d).select("quality", "text"), "text", "quality", most=1, meta=False).where("quality = 1")
    return r6(ln.runtime_signal(read(spark, d, "documents").select("doc_id", "text"), found, "doc_id", "text", most=1, meta=False))


@query("SELECT lang, count(*) AS n, count(DISTINCT md5(coalesce(text, ''))) AS n_distinct, round(1 - count(DISTINCT md5(coalesce(text, ''))) / count(*), 6) AS duplicate_rate, count(DISTINCT source) AS n_labels FROM documents GROUP BY 1")
def corpus_health(spark, d) -> DataFrame:
    return r6(ln.corpus_health(read(spark, d, "documents"), F.md5(F.coalesce("text", F.lit(""))), "source", ["lang"]))


@query("""
SELECT c_mktsegment, count(*) AS n, count(DISTINCT round(c_acctbal, 6)) AS n_distinct, min(c_acctbal) AS low, max(c_acctbal) AS high, round(quantile_cont(c_acctbal, 0.5), 6) AS median, round(avg(c_acctbal), 6) AS mean, round(stddev_pop(c_acctbal), 4) AS sd,
  count(DISTINCT round(c_acctbal, 6)) = 1 OR stddev_pop(c_acctbal) < 1e-6 AS collapsed FROM customer GROUP BY 1
""")
def score_distribution(spark, d) -> DataFrame:
    return r6(ln.distribution_health(read(spark, d, "customer"), "c_acctbal", ["c_mktsegment"]).withColumn("sd", F.round("sd", 4)))


@query("""
WITH x AS (SELECT doc_id, source, list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::HUGEINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS h FROM documents)
SELECT doc_id, CASE WHEN source = 'src7' THEN 'DISCOVERY' WHEN h % 100 < 20 THEN 'HOLDOUT' ELSE 'TRAIN' END AS part FROM x
""")
def train_holdout_split(spark, d) -> DataFrame:
    return ln.split(read(spark, d, "documents").select("doc_id", "source"), F.col("doc_id"), discovery=F.coalesce(F.col("source") == "src7", F.lit(False))).select("doc_id", "part")


@query(r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), x AS (SELECT *, len(regexp_extract_all(t, '[^\s]')) AS v, list_filter(list_transform(regexp_split_to_array(t, '\r?\n'), lambda x: trim(x)), lambda x: x <> '') AS l FROM d),
k AS (SELECT doc_id, unnest(TOKENS) AS w FROM documents), c AS (SELECT doc_id, w, count(*) AS n FROM k GROUP BY 1, 2), r AS (SELECT doc_id, sum(n) >= 8 AND coalesce(sum(n) FILTER (n >= 5), 0) > 0.22::DOUBLE * sum(n) AS again FROM c GROUP BY 1),
m AS (SELECT doc_id, unnest([CASE WHEN coalesce(len(regexp_extract_all(t, '\p{L}')) / nullif(v, 0), 0) < 0.58::DOUBLE THEN '__meta_low_alpha_ratio__' END, CASE WHEN coalesce(len(regexp_extract_all(t, '[©®\x{FFFD}|\\_=<>]')) / nullif(v, 0), 0) > 0.02::DOUBLE THEN '__meta_weird_symbol_density__' END,
  CASE WHEN len(regexp_extract_all(t, '\p{L}[0-9]\p{L}|[0-9]\p{L}{2,}|\p{L}{2,}[0-9]')) >= 2 THEN '__meta_leetspeak_or_ocr_substitution__' END, CASE WHEN len(list_filter(l, lambda x: length(x) <= 3)) > 0.18::DOUBLE * len(l) THEN '__meta_tiny_line_burst__' END,
  CASE WHEN again THEN '__meta_repetition_burst__' END, CASE WHEN length(t) < 300 THEN '__meta_very_short_document__' END, CASE WHEN length(t) BETWEEN 300 AND 699 THEN '__meta_short_document__' END]) AS feature FROM x LEFT JOIN r USING (doc_id))
SELECT doc_id, feature FROM m WHERE feature IS NOT NULL
""".replace("TOKENS", TOKENS))
def form_features(spark, d) -> DataFrame:
    """What is odd about each document's form."""
    return ln.form_rows(read(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


#: Features of texts: runs of one to three tokens, and what is odd about the form; over a table t(doc_id, text, ...).
_META = r"""x AS (SELECT doc_id, text, len(regexp_extract_all(text, '[^\s]')) AS v, list_filter(list_transform(regexp_split_to_array(text, '\r?\n'), lambda x: trim(x)), lambda x: x <> '') AS l, TOKENS AS w FROM BASE),
r AS (SELECT doc_id, sum(n) >= 8 AND coalesce(sum(n) FILTER (n >= 5), 0) > 0.22::DOUBLE * sum(n) AS again FROM (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(w) AS w FROM x) GROUP BY 1, 2) GROUP BY 1),
y AS (SELECT x.doc_id, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]),
  [CASE WHEN coalesce(len(regexp_extract_all(text, '\p{L}')) / nullif(v, 0), 0) < 0.58::DOUBLE THEN '__meta_low_alpha_ratio__' END, CASE WHEN coalesce(len(regexp_extract_all(text, '[©®\x{FFFD}|\\_=<>]')) / nullif(v, 0), 0) > 0.02::DOUBLE THEN '__meta_weird_symbol_density__' END,
  CASE WHEN len(regexp_extract_all(text, '\p{L}[0-9]\p{L}|[0-9]\p{L}{2,}|\p{L}{2,}[0-9]')) >= 2 THEN '__meta_leetspeak_or_ocr_substitution__' END, CASE WHEN len(list_filter(l, lambda x: length(x) <= 3)) > 0.18::DOUBLE * len(l) THEN '__meta_tiny_line_burst__' END,
  CASE WHEN again THEN '__meta_repetition_burst__' END, CASE WHEN length(text) < 300 THEN '__meta_very_short_document__' END, CASE WHEN length(text) BETWEEN 300 AND 699 THEN '__meta_short_document__' END]) AS f FROM x LEFT JOIN r USING (doc_id))""".replace("TOKENS", TOKENS)


@query(f"""
WITH {FEATURES.replace(f"w AS (SELECT DISTINCT doc_id, quality, unnest({TOKENS}) AS feature FROM u)", _META.replace("BASE", "u") + ", w AS (SELECT DISTINCT doc_id, quality, feature FROM (SELECT doc_id, unnest(f) AS feature FROM y) JOIN u USING (doc_id) WHERE feature IS NOT NULL)")}
SELECT label, feature, sp, sn, dp, dn, round(log_odds, 6) AS log_odds, round(z, 6) AS z, round(lift, 6) AS lift, round(confidence, 6) AS confidence, CASE WHEN log_odds >= 0 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS direction FROM f WHERE r <= 120
""")
def phrase_log_odds(spark, d) -> DataFrame:
    """Runs of one to three words, and marks of form, that set a label's documents apart."""
    found = ln.lexeme_features(_unique(spark, d).select("quality", "text"), "text", "quality")
    return r6(found.withColumnRenamed("quality", "label").select("label", "feature", "sp", "sn", "dp", "dn", "log_odds", "z", "lift", "confidence", "direction"))


BEFORE, AFTER = "SELECT doc_id AS c, CAST(n_chars % 101 AS DOUBLE) AS s FROM documents WHERE lang <> 'fr'", "SELECT doc_id AS c, CAST((n_chars + CASE WHEN source = 'src3' THEN 5 ELSE 0 END) % 101 AS DOUBLE) AS s FROM documents WHERE lang <> 'de'"
DRIFT = f"""WITH b AS ({BEFORE}), a AS ({AFTER}), j AS (SELECT abs(a.s - b.s) AS d, a.c IS NULL AS lost, b.c IS NULL AS new FROM b FULL JOIN a ON a.c = b.c)
SELECT count(d) AS n, sum((coalesce(d, 0) > 1e-9)::INT)::BIGINT AS n_changed, quantile_disc(d, 0.5) AS median, quantile_disc(d, 0.95) AS p95, max(d) AS largest, sum(lost::INT)::BIGINT AS n_lost, sum(new::INT)::BIGINT AS n_new FROM j"""


def _drift(spark, d) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    before = docs.where("lang <> 'fr'").select("doc_id", (F.col("n_chars") % 101).cast("double").alias("s"))
    after = docs.where("lang <> 'de'").select("doc_id", ((F.col("n_chars") + F.when(F.col("source") == "src3", 5).otherwise(0)) % 101).cast("double").alias("s"))
    return cal.drift(before, after, "doc_id", "s")


@query(DRIFT)
def drift_report(spark, d) -> DataFrame:
    return _drift(spark, d)


@query(f"WITH r AS ({DRIFT}) SELECT 'median' AS metric, median AS value, 0.25::DOUBLE AS bound FROM r WHERE NOT coalesce(median <= 0.25, false) UNION ALL SELECT 'p95', p95, 1.0::DOUBLE FROM r WHERE NOT coalesce(p95 <= 1, false) UNION ALL SELECT 'largest', largest, 2.0::DOUBLE FROM r WHERE NOT coalesce(largest <= 2, false)")
def drift_gate(spark, d) -> DataFrame:
    return cal.gate(_drift(spark, d), {"median": ("max", 0.25), "p95": ("max", 1.0), "largest": ("max", 2.0)})


def _labelled(spark, d) -> tuple[DataFrame, DataFrame]:
    e = read(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "GOOD").otherwise("BAD").alias("label"))
    return e, read(spark, d, "documents").where("n_chars > 900").select("doc_id", F.when(F.col("n_chars") > 2000, "GOOD").otherwise("BAD").alias("label"))


PREDICTED = "e AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'GOOD' ELSE 'BAD' END AS label FROM labels), p AS (SELECT doc_id, CASE WHEN n_chars > 2000 THEN 'GOOD' ELSE 'BAD' END AS label FROM documents WHERE n_chars > 900)"


@query(f"WITH {PREDICTED} SELECT coalesce(e.label, 'MISSING') AS expected, coalesce(p.label, 'MISSING') AS predicted, count(*) AS n FROM e FULL JOIN p ON e.doc_id = p.doc_id GROUP BY 1, 2")
def parser_confusion(spark, d) -> DataFrame:
    return cal.confusion(*_labelled(spark, d), "doc_id", "label")


@query(f"""WITH {PREDICTED}, n AS (SELECT sum((p.doc_id IS NOT NULL AND e.doc_id IS NOT NULL)::INT)::BIGINT AS tp, sum((e.doc_id IS NULL)::INT)::BIGINT AS fp, sum((p.doc_id IS NULL)::INT)::BIGINT AS fn FROM e FULL JOIN p ON e.doc_id = p.doc_id AND e.label = p.label)
SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM n""")
def annotation_f1(spark, d) -> DataFrame:
    e, p = _labelled(spark, d)
    return r6(cal.annotations(e, p, ["doc_id", "label"]))


@query("""
WITH s AS (SELECT doc_id, n_chars FROM documents), r AS (SELECT doc_id AS better, lag(doc_id) OVER (ORDER BY doc_id) AS worse FROM labels)
SELECT count(*) AS n, sum((a.n_chars > b.n_chars)::INT)::BIGINT AS n_correct, sum((a.n_chars = b.n_chars)::INT)::BIGINT AS n_tie, sum((a.n_chars < b.n_chars)::INT)::BIGINT AS n_inverted, round(sum((a.n_chars > b.n_chars)::INT) / nullif(count(*), 0), 6) AS accuracy FROM (
  SELECT doc_id AS better, doc_id - 1 AS worse FROM labels) q JOIN s a ON a.doc_id = better JOIN s b ON b.doc_id = worse
""")
def pairwise_ranking(spark, d) -> DataFrame:
    relations = read(spark, d, "labels").select(F.col("doc_id").alias("better"), (F.col("doc_id") - 1).alias("worse"))
    return r6(cal.pairwise(relations, read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars"))


@query("""
WITH x AS (SELECT l_quantity * 900 AS l, l_quantity * 1700 AS h, l_extendedprice AS t FROM lineitem)
SELECT count(*) AS n, sum((t BETWEEN l AND h)::INT)::BIGINT AS n_inside, round(avg(h - l), 6) AS mean_width, round(sum((t BETWEEN l AND h)::INT) / count(*), 6) AS covered FROM x
""")
def interval_coverage(spark, d) -> DataFrame:
    q = F.col("l_quantity")
    return r6(cal.interval_coverage(read(spark, d, "lineitem"), q * 900, q * 1700, F.col("l_extendedprice")))


@query("""
WITH x AS (SELECT quality = 0 AS e, n_chars < 1500 AS p FROM labels JOIN documents USING (doc_id))
SELECT count(*) AS n, sum((NOT e AND p)::INT)::BIGINT AS n_false, sum((e AND NOT p)::INT)::BIGINT AS n_missed, round(sum((NOT e AND p)::INT) / sum((NOT e)::INT), 6) AS false_rate, round(sum((e AND NOT p)::INT) / sum(e::INT), 6) AS missed_rate FROM x
""")
def knockout_calibration(spark, d) -> DataFrame:
    rows = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return r6(cal.knockout_rates(rows, F.col("quality") == 0, F.col("n_chars") < 1500))


@query("""
WITH c AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderstatus) FILTER (o_orderdate < TIMESTAMP '1999-01-01')) AS b, list_sort(list(DISTINCT o_orderstatus) FILTER (o_orderdate >= TIMESTAMP '1999-01-01')) AS a FROM orders GROUP BY 1)
SELECT o_custkey, code, 'NEW' AS change FROM (SELECT o_custkey, unnest(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x))) AS code FROM c)
UNION ALL SELECT o_custkey, code, 'REMOVED' FROM (SELECT o_custkey, unnest(list_filter(coalesce(b, []), lambda x: NOT list_contains(coalesce(a, []), x))) AS code FROM c)
""")
def cap_changes(spark, d) -> DataFrame:
    """States that a customer's orders have had in one half of the years alone."""
    o = read(spark, d, "orders").select("o_custkey", "o_orderstatus", (F.to_date("o_orderdate") >= "1999-01-01").alias("late"))
    sets = o.groupBy("o_custkey").agg(F.collect_set(F.when(~F.col("late"), F.col("o_orderstatus"))).alias("b"), F.collect_set(F.when(F.col("late"), F.col("o_orderstatus"))).alias("a"))
    return cal.cap_changes(sets.select("o_custkey", F.col("b").alias("caps")), sets.select("o_custkey", F.col("a").alias("caps")), "o_custkey", "caps")
