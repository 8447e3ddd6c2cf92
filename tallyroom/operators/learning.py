"""What a labelled corpus says about its words: deduplication, 2 x 2 counts, log-odds, runtime signals, health."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tallyroom.functions import features as ft
from tallyroom.functions.numbers import clamp
from tallyroom.functions.text import feature_tokens, fnv, let, token_ngrams
from tallyroom.operators.tables import saved

#: Counts that a task holds before it passes them on, and rows of its Arrow batches.
HELD_COUNTS, ROWS = 300_000, 20_000


def dedup_corpus(docs: DataFrame, form: Column, key: str, labels: str, weight: str | None = None) -> DataFrame:
    """One row for each text form: the smallest key, the union of the labels, the largest weight.

    form: a column that is equal for equal texts, such as a hash; combined before the shuffle.
    """
    rest = [c for c in docs.columns if c not in {key, labels, weight}]
    aggs = [F.min_by(F.struct(key, *rest), key).alias("__first"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(labels)))).alias(labels)]
    if weight:
        aggs.append(F.max(weight).alias(weight))
    out = docs.groupBy(form.alias("__form")).agg(*aggs)
    return out.select(F.col(f"__first.{key}").alias(key), *[F.col(f"__first.{c}").alias(c) for c in rest], labels, *([weight] if weight else []))


def meta_features(text: Column) -> Column:
    """Names of what is odd about a text's form: few letters, many signs, digits in words, tiny lines, repeats, shortness."""
    body = F.coalesce(text, F.lit(""))
    count = lambda p: F.regexp_count(body, F.lit(p))
    visible = count("[^\\s]")
    lines = F.filter(F.transform(F.split(body, "\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    tokens = feature_tokens(body)

    def repeats(w: Column) -> Column:
        # of sorted words, those in runs of five or more: a run of n has n - 4 that equal the fourth after them, and one beginning
        same = F.filter(F.transform(w, lambda x, i: F.struct((x == F.get(w, i + 4)).alias("runs"), (x != F.coalesce(F.get(w, i - 1), F.lit(""))).alias("first"))), lambda s: s["runs"])
        often = let(same, lambda m: F.size(m) + 4 * F.size(F.filter(m, lambda s: s["first"])))
        return (F.size(w) >= 8) & (often > 0.22 * F.size(w))

    # fixed values: the limits and what they are called
    marks = [
        ("__meta_low_alpha_ratio__", F.when(visible > 0, count("\\p{L}") / visible).otherwise(0.0) < 0.58),
        ("__meta_weird_symbol_density__", F.when(visible > 0, count("[©®\uFFFD|\\\\_=<>]") / visible).otherwise(0.0) > 0.02),
        ("__meta_leetspeak_or_ocr_substitution__", count("\\p{L}[0-9]\\p{L}|[0-9]\\p{L}{2,}|\\p{L}{2,}[0-9]") >= 2),
        ("__meta_tiny_line_burst__", F.size(F.filter(lines, lambda x: F.length(x) <= 3)) > 0.18 * F.size(lines)),
        ("__meta_repetition_burst__", let(F.array_sort(tokens), repeats)),
        ("__meta_very_short_document__", F.length(body) < 300),
        ("__meta_short_document__", F.length(body).between(300, 699)),
    ]
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in marks]), lambda x: x.isNotNull())


def text_features(text: Column, most: int = 3, meta: bool = True) -> Column:
    """The distinct runs of 1 to ``most`` feature tokens of a text, and the names of what is odd about its form."""
    tokens = feature_tokens(text)
    grams = token_ngrams(tokens, most) if most > 1 else F.array_distinct(tokens)
    return F.concat(grams, meta_features(text)) if meta else grams


def word_features(docs: DataFrame, text: str, most: int = 3, meta: bool = True) -> DataFrame:
    """The columns without the text, then feature: a row for each of ``text_features``."""
    return docs.select(*[c for c in docs.columns if c != text], F.explode(text_features(F.col(text), most, meta)).alias("feature"))


def form_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, feature): a row for each name of what is odd about a text's form."""
    schema = T.StructType([docs.schema[key], T.StructField("feature", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ft.Tokens()
        for batch in batches:
            found = [ft.marks(t, ft.tokens(t, known)) for t in batch.column(1).to_pylist()]
            at = pa.array([i for i, some in enumerate(found) for _ in some], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([x for some in found for x in some], pa.string())], names=schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


def feature_counts(docs: DataFrame, text: str, label: str, most: int = 3, meta: bool = True) -> DataFrame:
    """(label, feature, n): in how many texts of a label a feature stands, in parts that sum up; counted in each task before anything is shuffled."""
    schema = T.StructType([docs.schema[label], T.StructField("feature", T.StringType()), T.StructField("n", T.LongType())])
    kind = to_arrow_type(docs.schema[label].dataType)

    def rows(held: dict) -> Iterator[pa.RecordBatch]:
        for named, counts in held.items():
            names, numbers = list(counts), list(counts.values())
            for k in range(0, len(names), ROWS):
                some = names[k : k + ROWS]
                yield pa.RecordBatch.from_arrays([pa.array([named] * len(some), kind), pa.array(some, pa.string()), pa.array(numbers[k : k + ROWS], pa.int64())], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = ft.Tokens(), {}
        for batch in batches:
            for named, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.setdefault(named, Counter()).update(ft.features(t.as_py(), known, most, meta))
                if sum(map(len, held.values())) > HELD_COUNTS:
                    yield from rows(held)
                    held = {}
        yield from rows(held)

    return docs.select(label, text).mapInArrow(run, schema)


def log_odds(sp: Column, sn: Column, dp: Column, dn: Column, alpha: float = 0.5) -> dict[str, Column]:
    """log_odds, z, lift and confidence of 2 x 2 counts: documents with the feature, and all, with and without a label."""
    ap, an = F.greatest(F.lit(0), dp - sp), F.greatest(F.lit(0), dn - sn)
    odds = F.log((sp + alpha) / (ap + alpha)) - F.log((sn + alpha) / (an + alpha))
    z = odds / F.sqrt(1 / (sp + alpha) + 1 / (ap + alpha) + 1 / (sn + alpha) + 1 / (an + alpha))
    lift = ((sp + alpha) / (dp + 2 * alpha)) / ((sn + alpha) / (dn + 2 * alpha))
    sure = (1 - F.exp(-(sp + sn) / 8)) * F.least(F.lit(1.0), F.abs(z) / 4)
    return {"log_odds": odds, "z": z, "lift": lift, "confidence": clamp(sure)}


def lexeme_features(docs: DataFrame, text: str, label: str, *, most: int = 3, meta: bool = True, least_support: int = 5, least_z: float = 2.0, least_lift: float = 1.5, top: int = 120) -> DataFrame:
    """(label, feature, sp, sn, dp, dn, log_odds, z, lift, confidence, direction): the strongest ``top`` features of each label.

    docs: one row a document, with a column of its label.  Counts are sums by key, so a word that every text has is
    combined before the shuffle; the labels' totals are a row a label, and a feature's counts a row for each label.
    """
    by = feature_counts(docs, text, label, most, meta).groupBy(label, "feature").agg(F.sum("n").alias("sp"))
    totals = docs.groupBy(label).agg(F.count("*").alias("dp"))
    all_docs = totals.agg(F.sum("dp")).scalar()
    both = by.groupBy("feature").agg(F.sum("sp").alias("n"), F.collect_list(F.struct(label, "sp")).alias("of")).where(F.col("n") >= least_support)
    rows = both.select("feature", "n", F.explode("of").alias("l")).select("feature", "n", "l.*").join(totals, label)
    rows = rows.select(label, "feature", "sp", (F.col("n") - F.col("sp")).alias("sn"), "dp", (all_docs - F.col("dp")).alias("dn")).where("dn > 0")
    rows = rows.withColumns(log_odds(F.col("sp"), F.col("sn"), F.col("dp"), F.col("dn")))
    strong = F.when(F.col("log_odds") >= 0, F.col("lift") >= least_lift).otherwise(1 / F.greatest(F.col("lift"), F.lit(1e-9)) >= least_lift)
    rows = rows.where((F.abs("z") >= least_z) & strong).withColumn("direction", F.when(F.col("log_odds") >= 0, "POSITIVE").otherwise("NEGATIVE"))
    w = Window.partitionBy(label).orderBy(F.round(F.abs("z"), 9).desc(), F.round("confidence", 9).desc(), "feature")
    return rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= top).drop("__r")


#: Learned features that are sent to the texts; more of them are joined to the texts' features by a shuffle.
SENT_FEATURES = 20_000


def runtime_signal(docs: DataFrame, features: DataFrame, key: str, text: str, *, most: int = 3, meta: bool = True, top: int = 24, cap: float = 5.0, sent: int = SENT_FEATURES) -> DataFrame:
    """(key, n_matched, strength, confidence, adjustment): what learned features (feature, log_odds, confidence) say of a text.

    The ``top`` features by strength times confidence count, ties by name; strength is their mean weighted by confidence,
    confidence that at least one of them is right; the adjustment never passes the cap.  Texts without a feature: zeros.
    Of a feature that stands twice the stronger counts.  Up to ``sent`` features go to the texts, of which no word is shuffled; rows of one key are told apart then.
    """
    s = clamp(F.col("log_odds") / 4, -1.0, 1.0)
    one = features.select("feature", s.alias("s"), F.col("confidence").alias("c")).where("feature IS NOT NULL AND s IS NOT NULL AND c IS NOT NULL")
    one = saved(one.groupBy("feature").agg(F.max_by(F.struct("s", "c"), F.abs(F.col("s") * F.col("c"))).alias("v")).select("feature", "v.*"))
    entry = lambda s, c, f: F.struct((-F.round(F.abs(s * c), 9)).alias("r"), f.alias("f"), s.alias("s"), c.alias("c"))
    if one.count() <= sent:
        # at most ``sent`` rows; a map of them goes to the texts with the function
        learned = {r.feature: (r.r, r.s, r.c) for r in one.select("feature", (-F.round(F.abs(F.col("s") * F.col("c")), 9)).alias("r"), "s", "c").collect()}
        pair = T.ArrayType(T.StructType([T.StructField("s", T.DoubleType()), T.StructField("c", T.DoubleType())]))
        schema = T.StructType([docs.schema[key], T.StructField("b", pair)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, names = ft.Tokens(), learned.keys()
            for batch in batches:
                out = []
                for t in batch.column(1):
                    held = names & ft.features(t.as_py(), known, most, meta)
                    best = sorted((learned[f][0], f) for f in held)[:top]
                    out.append([{"s": learned[f][1], "c": learned[f][2]} for _, f in best])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, to_arrow_type(pair))], names=schema.names)

        rows = docs.select(key, text).mapInArrow(run, schema)
    else:
        hits = word_features(docs.select(key, text), text, most, meta).join(one, "feature")
        best = hits.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(entry(F.col("s"), F.col("c"), F.col("feature")))), 1, top).alias("b"))
        rows = docs.select(key).join(best, key, "left").withColumn("b", F.coalesce("b", F.array().cast(best.schema["b"].dataType)))
    total = lambda body: F.aggregate("b", F.lit(0.0), lambda a, x: a + body(x))
    weight = total(lambda x: x["c"])
    out = rows.select(
        key, F.size("b").cast("long").alias("n_matched"), F.when(weight > 0, total(lambda x: x["s"] * x["c"]) / weight).otherwise(0.0).alias("strength"),
        (1 - F.exp(total(lambda x: F.ln(F.greatest(F.lit(1e-12), 1 - x["c"]))))).alias("confidence"),
    )
    return out.withColumn("adjustment", clamp(F.col("strength") * F.col("confidence") * cap, -cap, cap))


def corpus_health(docs: DataFrame, form: Column, label: str, by: list[str]) -> DataFrame:
    """(by, n, n_distinct, duplicate_rate, n_labels); distinct forms and labels are counted in two levels."""
    rows = docs.select(*by, form.alias("__f"), label)
    forms = rows.groupBy(*by, "__f").agg(F.count("*").alias("c")).groupBy(*by).agg(F.sum("c").alias("n"), F.count("*").alias("n_distinct"))
    kinds = rows.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.lit(1)).groupBy(*by).agg(F.count("*").alias("n_labels"))
    out = forms.join(kinds, by, "left").fillna(0, ["n_labels"])
    return out.select(*by, "n", "n_distinct", (1 - F.col("n_distinct") / F.col("n")).alias("duplicate_rate"), "n_labels")


def distribution_health(df: DataFrame, value: str, by: list[str], collapsed_sd: float = 1e-6) -> DataFrame:
    """(by, n, n_distinct, low, high, median, mean, sd, collapsed) of finite values; distinct to six decimals."""
    v = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*by, F.col(value).alias("v"))
    counts = v.groupBy(*by, F.round("v", 6).alias("r")).agg(F.lit(1)).groupBy(*by).agg(F.count("*").alias("n_distinct"))
    out = v.groupBy(*by).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.percentile("v", F.lit(0.5)).alias("median"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    return out.join(counts, by).withColumn("collapsed", (F.col("n_distinct") == 1) | (F.col("sd") < collapsed_sd))


def md5_number(ident: Column) -> Column:
    """A number of 24 bits from an id, in the JVM alone."""
    return F.conv(F.substring(F.md5(ident), 1, 6), 16, 10).cast("long")


def split(df: DataFrame, ident: Column, holdout: int = 20, discovery: Column | None = None, number: Callable[[Column], Column] = fnv) -> DataFrame:
    """The columns, then part: HOLDOUT for ``holdout`` of 100 buckets of the id's hash, DISCOVERY where asked, else TRAIN.

    number: the hash, 32-bit FNV-1a of the id as text, or one that stays in the JVM.
    """
    bucket = number(ident.cast("string")) % 100
    part = F.when(bucket < holdout, "HOLDOUT").otherwise("TRAIN")
    return df.withColumn("part", part if discovery is None else F.when(discovery, "DISCOVERY").otherwise(part))
