"""Records against records: reconciliation, duplicates, indexes and phrases, rule pairs, knockouts, problem lists."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tallyroom.functions.text import let, token_runs
from tallyroom.operators.tables import stated_list

#: Phrases that a task looks up; rows of a batch that are Python values at a time.
PHRASES, SLICE = 200_000, 64


def reconcile(local: DataFrame, cloud: DataFrame, key: str, signature: str) -> DataFrame:
    """(key, decision): PUSH what is only here, PULL what is only there, SAME or CONFLICT by signature; null is empty."""
    a, b = local.select(key, F.col(signature).alias("a")).where("a IS NOT NULL"), cloud.select(key, F.col(signature).alias("b")).where("b IS NOT NULL")
    decision = F.when(F.col("b").isNull(), "PUSH").when(F.col("a").isNull(), "PULL").when(F.col("a") == F.col("b"), "SAME").otherwise("CONFLICT")
    return a.join(b, key, "full").select(key, decision.alias("decision"))


def consistency(expected: DataFrame, actual: DataFrame, on: list[str], value: str) -> DataFrame:
    """(on, finding): MISSING, EXTRA or CHANGED; what agrees isn't listed."""
    e, a = expected.select(*on, F.struct(value).alias("e")), actual.select(*on, F.struct(value).alias("a"))
    finding = F.when(F.col("a").isNull(), "MISSING").when(F.col("e").isNull(), "EXTRA").when(~F.col("e").eqNullSafe(F.col("a")), "CHANGED")
    return e.join(a, on, "full").select(*on, finding.alias("finding")).where("finding IS NOT NULL")


def duplicates(df: DataFrame, ident: str, keys: dict[str, Column]) -> DataFrame:
    """(ident, of, by): the smallest other record with an equal key, by the first of ``keys`` that finds one.

    The smallest of each key is a minimum, so many records of one key form no pairs; null and empty keys find nothing.
    """
    marks = F.array(*[F.struct(F.lit(i).alias("o"), F.lit(n).alias("by"), k.cast("string").alias("k")) for i, (n, k) in enumerate(keys.items())])
    rows = df.select(F.col(ident).alias("id"), F.explode(marks).alias("m")).select("id", "m.*").where("k IS NOT NULL AND k <> ''")
    first = rows.groupBy("o", "k").agg(F.min("id").alias("of"))
    found = rows.join(first, ["o", "k"]).where(F.col("of") < F.col("id"))
    return found.groupBy("id").agg(F.min(F.struct("o", "by", "of")).alias("m")).select(F.col("id").alias(ident), "m.of", "m.by")


def missing(required: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``required`` without a counterpart."""
    return required.join(present.select(*on).distinct(), on, "left_anti")


def lemmas(tokens: DataFrame, lexicon: DataFrame, token: str = "token") -> DataFrame:
    """The columns, then lemma: that of the lexicon (form, lemma), else the token itself."""
    return tokens.join(lexicon.select(F.col("form").alias("__f"), "lemma"), F.col(token) == F.col("__f"), "left").withColumn("lemma", F.coalesce("lemma", token)).drop("__f")


def _longest_runs(rows: DataFrame, told: list[tuple], kind: T.DataType, most: int) -> DataFrame:
    """(key, phrase, n, start, canonical) of rows (key, tokens joined by spaces): the longest run that is told, the leftmost of equals."""
    key = rows.columns[0]
    kinds = [rows.schema[key].dataType, T.StringType(), T.IntegerType(), T.IntegerType(), kind]
    schema = T.StructType([T.StructField(n, k) for n, k in zip([key, "phrase", "n", "start", "canonical"], kinds, strict=True)])
    by_length: dict[int, dict] = {}
    for p, canonical in told:
        words = tuple(p.split(" "))
        by_length.setdefault(len(words), {})[words] = p, canonical
    lengths = sorted((n for n in by_length if n <= most), reverse=True)

    def longest(words: list[str]) -> tuple | None:
        for n in lengths:
            of = by_length[n]
            runs = lambda n=n: zip(*[words[k:] for k in range(n)], strict=False)
            # most texts hold no run of the greater lengths, which keys() tells without a loop
            if not of.keys().isdisjoint(runs()):
                start, words_of = next((i, r) for i, r in enumerate(runs(), 1) if r in of)
                return of[words_of][0], n, start, of[words_of][1]
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for low in range(0, batch.num_rows, SLICE):
                for i, t in enumerate(batch.column(1).slice(low, SLICE).to_pylist(), low):
                    if t is not None and (best := longest(t.split(" "))):
                        at.append(i)
                        found.append(best)
            columns = list(zip(*found, strict=True)) or [[] for _ in kinds[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(v, to_arrow_type(k)) for v, k in zip(columns, kinds[1:], strict=True)]], names=schema.names)

    return rows.mapInArrow(run, schema)


def longest_phrase(docs: DataFrame, key: str, tokens: Column, phrases: DataFrame, most: int = 5) -> DataFrame:
    """(key, phrase, canonical, start): the longest run of tokens that is a phrase (phrase, canonical), the leftmost of equals.

    Tokens hold no spaces.  Up to ``PHRASES`` phrases are looked up in the tasks, each text's runs from the longest down to
    the first that is found; with more of them, runs are joined with the table.
    """
    told = phrases.where("phrase IS NOT NULL").groupBy("phrase").agg(F.min(F.struct("canonical")).alias("c")).select("phrase", "c.canonical")
    few = told.limit(PHRASES + 1).collect()
    if len(few) <= PHRASES:
        hits = _longest_runs(docs.select(key, let(tokens, lambda w: F.when(F.size(w) > 0, F.array_join(w, " "))).alias("w")), [tuple(r) for r in few], phrases.schema["canonical"].dataType, most)
    else:
        grams = let(tokens, lambda w: F.concat(*[token_runs(w, n) for n in range(1, most + 1)]))
        hits = docs.select(key, F.explode(grams).alias("g")).select(key, "g.*").join(told, "phrase")
    best = hits.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), "start", "phrase", "canonical")).alias("b"))
    return best.select(key, "b.phrase", "b.canonical", "b.start")


def inverted_index(df: DataFrame, ident: str, phrase: Column) -> DataFrame:
    """(ident, term, kind): the phrase, and its words of more than two letters."""
    low = F.lower(phrase)
    words = F.filter(F.array_distinct(F.split(low, " ")), lambda w: F.length(w) > 2)
    terms = F.concat(F.array(F.struct(low.alias("term"), F.lit("phrase").alias("kind"))), F.transform(words, lambda w: F.struct(w.alias("term"), F.lit("word").alias("kind"))))
    return df.select(ident, F.explode(terms).alias("t")).select(ident, "t.*").where("term IS NOT NULL AND term <> ''").distinct()


def index_search(queries: DataFrame, index: DataFrame, ident: str) -> DataFrame:
    """(query, ident, score): 15 for an equal phrase, 8 for each equal word, 3 for each phrase that holds the query or lies in it.

    Phrases that hold each other share their three-letter pieces, so candidates come from an equi-join; texts of fewer
    letters than three are only found by equality.
    """
    q = queries.select("query", F.lower("query").alias("q"))
    words = q.select("query", F.explode(F.array_distinct(F.split("q", " "))).alias("term"))
    exact = q.join(index.where("kind = 'phrase'"), q["q"] == index["term"]).select("query", ident, F.lit(15).alias("s"))
    by_word = words.join(index.where("kind = 'word'"), "term").select("query", ident, F.lit(8).alias("s"))
    pieces = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - 2)), lambda i: F.substring(c, i, 3)))
    left = q.where("length(q) >= 3").select("query", "q", F.explode(pieces(F.col("q"))).alias("p"))
    right = index.where("kind = 'phrase' AND length(term) >= 3").select(ident, "term", F.explode(pieces(F.col("term"))).alias("p"))
    near = left.join(right, "p").where("q <> term AND (contains(q, term) OR contains(term, q))").select("query", ident, "term").distinct().select("query", ident, F.lit(3).alias("s"))
    return exact.unionByName(by_word).unionByName(near).groupBy("query", ident).agg(F.sum("s").alias("score"))


def role_scores(words: DataFrame, signals: DataFrame, key: str, word: str, least: float = 4.0, top: int = 3, parts: int | None = None) -> DataFrame:
    """(key, role, score, rank): signals (role, signal, variants, weight, stems) count where all their stems occur.

    A signal counts weight * min(stems, 4); of one role's signals in one group of variants the best counts; roles under
    ``least`` are left out.  Words that no signal asks for are left at once, and the others dealt by their key, to
    ``parts`` tasks, once for all that follows.
    """
    needed = stated_list(signals.select("role", "signal", "variants", "weight", F.size(F.array_distinct("stems")).alias("k"), F.explode(F.array_distinct("stems")).alias(word)))
    asked = words.select(key, word).join(needed.select(word), word, "left_semi")
    dealt = asked.repartition(parts, key) if parts else asked.repartition(key)
    hits = dealt.distinct().join(needed, word).groupBy(key, "role", "signal", "variants", "weight", "k").agg(F.count("*").alias("n")).where("n = k")
    best = hits.groupBy(key, "role", "variants").agg(F.max(F.col("weight") * F.least("k", F.lit(4))).alias("s")).groupBy(key, "role").agg(F.sum("s").alias("score")).where(F.col("score") >= least)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "role"))).where(F.col("rank") <= top)


def contradictions(tags: DataFrame, pairs: DataFrame, key: str, tag: str) -> DataFrame:
    """(key, a, b) of rule pairs (a, b) whose tags one record holds both."""
    t = tags.select(key, F.col(tag).alias("t")).distinct()
    first = t.join(pairs, F.col("t") == F.col("a")).select(key, "a", "b")
    return first.join(t.withColumnRenamed("t", "b"), [key, "b"], "left_semi").select(key, "a", "b")


def runs(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """(by, run, value, n): maximal runs of equal neighbours, numbered from 1; nulls are equal to nulls."""
    w = Window.partitionBy(*by).orderBy(*order)
    opens = F.when((F.row_number().over(w) > 1) & F.col(value).eqNullSafe(F.lag(value).over(w)), 0).otherwise(1)
    rows = df.withColumn("__o", opens).withColumn("run", F.sum("__o").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy(*by, "run", value).agg(F.count("*").alias("n"))


def clause_status(docs: DataFrame, key: str, text: str, phrases: list[str], negated: str, softened: str) -> DataFrame:
    """(key, phrase, status, n): how a text asks for a phrase - REQUIRED if one clause does, else PREFERRED, else NEGATED.

    Clauses end at . ; ! ? and line ends; negated and softened are patterns on a clause.
    """
    clauses = docs.select(key, F.explode(F.split(F.lower(F.coalesce(text, F.lit(""))), "[.;!?\n]+")).alias("c"))
    said = clauses.select(key, "c", F.explode(F.array(*[F.lit(p) for p in phrases])).alias("phrase")).where(F.expr("contains(concat(' ', c, ' '), concat(' ', phrase, ' '))"))
    kind = F.when(F.col("c").rlike(negated), 1).when(F.col("c").rlike(softened), 2).otherwise(3)
    out = said.groupBy(key, "phrase").agg(F.max(kind).alias("k"), F.count("*").alias("n"))
    return out.select(key, "phrase", F.element_at(F.array(F.lit("NEGATED"), F.lit("PREFERRED"), F.lit("REQUIRED")), F.col("k")).alias("status"), "n")


def knockouts(docs: DataFrame, key: str, text: Column, held: Column, rules: list[tuple[str, str, str, str | None]]) -> DataFrame:
    """(key, rule, severity) of rules (rule, pattern, severity, general) that a text states and a record doesn't hold.

    held: an array of rule names.  A rule's general form is left out where the rule itself is found.
    """
    hits = F.filter(F.array(*[F.when(text.rlike(p), F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"), F.lit(g).cast("string").alias("general"))) for n, p, s, g in rules]), lambda x: x.isNotNull())
    rows = docs.withColumn("__hits", hits).withColumn("__covered", F.transform("__hits", lambda x: F.coalesce(x["general"], F.lit(""))))
    open_ = F.filter("__hits", lambda x: ~F.array_contains(F.col("__covered"), x["rule"]) & ~F.coalesce(F.array_contains(held, x["rule"]), F.lit(False)))
    return rows.select(key, F.explode(open_).alias("x")).select(key, "x.rule", "x.severity")


def top_problems(sources: list[DataFrame], key: str, most: int = 3) -> DataFrame:
    """(key, rank, problem): the first ``most`` problems of each record; sources (key, ord, problem) come in order."""
    rows = sources[0].select(key, "ord", "problem").withColumn("__s", F.lit(0))
    for i, s in enumerate(sources[1:], 1):
        rows = rows.unionByName(s.select(key, "ord", "problem").withColumn("__s", F.lit(i)))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("__s", "ord", "problem")))
    return ranked.where(F.col("rank") <= most).select(key, "rank", "problem")


def density(hits: Column, tokens: Column, other_hits: Column, other_tokens: Column) -> Column:
    """How many times as dense terms are here as there; null where one side has no tokens or there are none there."""
    there = other_hits / F.nullif(other_tokens, F.lit(0))
    return hits / F.nullif(tokens, F.lit(0)) / F.nullif(there, F.lit(0.0))


def flatten_claims(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, kind, ord, term): the members of several arrays, the first of equal terms; an unpivot."""
    def members(c: str) -> Column:
        return F.transform(F.coalesce(F.col(c), F.expr("CAST(array() AS array<string>)")), lambda x, i: F.struct(F.lit(c).alias("kind"), i.alias("ord"), x.alias("term")))

    flat = df.select(key, F.explode(F.concat(*map(members, columns))).alias("r"))
    first = flat.groupBy(key, F.lower("r.term").alias("__t")).agg(F.min(F.struct(F.col("r.kind").alias("kind"), F.col("r.ord").alias("ord"), F.col("r.term").alias("term"))).alias("m"))
    return first.select(key, "m.*")


def pool_rule(pool: int, expires: int, per_day: int, day: int):
    """A quota: first from a pool while it lasts and hasn't expired, then ``per_day`` in each day (of ``day`` time units)."""

    def rule(state: dict, t: int) -> bool:
        left = state.setdefault("pool", pool)
        if left > 0 and t < expires:
            state["pool"] = left - 1
            return True
        if state.get("day") != t // day:
            state["day"], state["n"] = t // day, 0
        state["n"] += 1
        return state["n"] <= per_day

    return rule
