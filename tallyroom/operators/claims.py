"""What a text claims: name-like chunks without a dictionary, and claims that a source doesn't bear out."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tallyroom.functions.phrases import said_metrics
from tallyroom.functions.text import fold
from tallyroom.operators.dictionary import automaton_of, folded, hits
from tallyroom.operators.tables import saved

#: Weight of a chunk that no dictionary has: a sign, not a certainty.
CHUNK_WEIGHT = 1.5
_EDGE = re.compile(r"^([^\w#+]*)(.*?)([^\w#+]*)$", re.S)
_TECHNICAL = re.compile(r"[0-9#+./-]")


@lru_cache(1 << 16)
def _word(word: str) -> str:
    return folded(word)[0]


def chunks_of(text: str, stop: frozenset[str], known) -> list[tuple[str, int, bool]]:
    """(phrase, times, technical): runs of capitalised words, without the stop words at their ends, that count.

    A run ends where a word is small, or with a sign before or behind a word.  A chunk of three signs or more counts if
    one of its words is an acronym or holds a digit or a technical sign, or if its words stand in a row twice in the
    text, in any case of letters; not if it holds a known phrase and more, or a part of one.
    """
    small: list[str] = []  # the text's words in folded form
    runs: dict[str, list[str]] = {}
    run: list[str] = []

    def end() -> None:
        words = [_word(w) for w in run]
        low, high = 0, len(words)
        while low < high and words[low] in stop:
            low += 1
        while high > low and words[high - 1] in stop:
            high -= 1
        if low < high:
            runs.setdefault(" ".join(words[low:high]), run[low:high])
        run.clear()

    for raw in text.split():
        before, word, after = ("", raw, "") if raw.isalnum() else _EDGE.match(raw).groups()
        if not word:
            end()
            continue
        small.append(_word(word))
        if before:
            end()
        if word[0].isupper():
            run.append(word)
        else:
            end()
        if after:
            end()
    end()
    wanted: dict[int, set[str]] = {}
    for phrase in runs:
        wanted.setdefault(phrase.count(" ") + 1, set()).add(phrase)
    times: Counter[str] = Counter()
    for n, phrases in wanted.items():
        if n == 1:
            times.update(w for w in small if w in phrases)
            continue
        for i in range(len(small) - n + 1):
            here = " ".join(small[i : i + n])
            if here in phrases:
                times[here] += 1
    out = []
    for phrase, words in runs.items():
        technical = any((2 <= len(w) <= 6 and all(c.isupper() for c in w)) or _TECHNICAL.search(w) for w in words)
        if len(phrase) < 3 or phrase.isdigit() or not (technical or times[phrase] > 1):
            continue
        if not any(k != phrase for k, *_ in hits(phrase, known)):
            out.append((phrase, times[phrase], technical))
    return out


def dynamic_phrases(docs: DataFrame, key: str, text: str, stop: list[str], known: list[str] = ()) -> DataFrame:
    """(key, phrase, times, technical, weight, rarity): chunks of a text that look like names of skills, tools or products.

    See ``chunks_of``.  stop: words that are no chunk and go from its ends, folded.  known: phrases that a dictionary finds
    anyway, folded.  rarity: the logarithm of all texts to those with the phrase, both and one more; texts are counted
    over the whole table.  Null and empty texts count as texts.
    """
    kinds = [docs.schema[key].dataType, T.StringType(), T.LongType(), T.BooleanType()]
    schema = T.StructType([T.StructField(n, k) for n, k in zip([key, "phrase", "times", "technical"], kinds, strict=True)])
    stops, listed = frozenset(stop), list(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of(listed)
        for batch in batches:
            out = [(k, *c) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for c in chunks_of(t, stops, automaton)]
            columns = list(zip(*out, strict=True)) or [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(v, to_arrow_type(x)) for v, x in zip(columns, kinds, strict=True)], names=schema.names)

    # read twice below
    found = saved(docs.select(key, text).mapInArrow(run, schema))
    total = docs.count()
    texts = found.groupBy("phrase").agg(F.count_distinct(key).alias("n"))
    rarity = F.ln((F.lit(total) + 1) / (F.col("n") + 1))
    return found.join(texts, "phrase").select(key, "phrase", "times", "technical", F.lit(CHUNK_WEIGHT).alias("weight"), rarity.alias("rarity"))


#: Endings of narrating verbs, from eight signs on, in folded form.
NARRATING = ("lem", "lam", "lismy", "lysmy")


def technical_tokens(text: Column, glue: list[str]) -> Column:
    """The distinct tokens of a text that may name a technology, folded.

    Tokens are runs of letters, digits and + # . without full stops at their ends.  Of two signs or more, a-z, digits and
    these signs alone once folded, none of the glue words, and no narrating verb.
    """
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}+#.]+")
    plain = F.transform(words, lambda w: fold(F.regexp_replace(w, "^[.]+|[.]+$", "")))
    verb = lambda w: (F.length(w) >= 8) & w.rlike("(?:" + "|".join(NARRATING) + ")$")
    return F.array_distinct(F.filter(plain, lambda w: (F.length(w) > 1) & w.rlike("^[a-z0-9+#.]+$") & ~w.isin(*glue) & ~verb(w)))


def canonical_labels(synonyms: DataFrame, rounds: int = 8) -> DataFrame:
    """(label, canonical): the ends of chains of synonyms (label, canonical), folded, with each label's every step.

    Closed under following: a label stands with each name that it leads to in ``2 ** rounds`` steps at most.
    """
    steps = synonyms.select(fold(F.trim("label")).alias("label"), fold(F.trim("canonical")).alias("canonical")).where("label <> canonical").distinct()
    closed = steps
    for _ in range(rounds):
        further = closed.join(closed.select(F.col("label").alias("canonical"), F.col("canonical").alias("next")), "canonical")
        grown = saved(closed.union(further.select("label", F.col("next").alias("canonical"))).where("label <> canonical").distinct())
        if grown.count() == closed.count():
            break
        closed = grown
    return closed


def truth_verdicts(claims: DataFrame, sources: DataFrame, key: str, text: str, synonyms: DataFrame, glue: list[str]) -> DataFrame:
    """(key, n_unknown, unknown, n_invented, invented, verdict) of what is claimed against what sources say.

    claims, sources: rows (key, text), any number a key.  unknown: technical tokens of the claims that no source of the
    key has, by themselves or by a canonical name (synonyms: label, canonical, closed over chains).  invented: numbers
    with their units, in one form, that no source has.  PASS where both are empty.  The lists are sorted and hold the
    first 50; the counts are of all.  A key without sources knows nothing.
    """
    tokens = lambda df, of: df.select(key, F.explode(of(F.col(text))).alias("t")).distinct()
    words = lambda c: technical_tokens(c, glue)
    said, known = tokens(claims, words), tokens(sources, words)
    lost = said.join(known, [key, "t"], "left_anti")
    closed = canonical_labels(synonyms)
    # a token that leads to a known name is borne out
    led = lost.join(closed, F.col("t") == F.col("label")).join(known.withColumnRenamed("t", "canonical"), [key, "canonical"], "left_semi").select(key, "t").distinct()
    unknown = lost.join(led, [key, "t"], "left_anti").select(key, F.lit("w").alias("kind"), "t")
    invented = tokens(claims, said_metrics).join(tokens(sources, said_metrics), [key, "t"], "left_anti").select(key, F.lit("m").alias("kind"), "t")
    some = lambda kind: F.slice(F.array_sort(F.collect_list(F.when((F.col("kind") == kind) & (F.col("r") <= 50), F.col("t")))), 1, 50)
    ranked = unknown.union(invented).withColumn("r", F.row_number().over(Window.partitionBy(key, "kind").orderBy("t")))
    out = ranked.groupBy(key).agg(F.count_if(F.col("kind") == "w").alias("n_unknown"), some("w").alias("unknown"), F.count_if(F.col("kind") == "m").alias("n_invented"), some("m").alias("invented"))
    none = F.array().cast("array<string>")
    whole = claims.select(key).distinct().join(out, key, "left")
    return whole.select(
        key, F.coalesce("n_unknown", F.lit(0)).alias("n_unknown"), F.coalesce("unknown", none).alias("unknown"), F.coalesce("n_invented", F.lit(0)).alias("n_invented"),
        F.coalesce("invented", none).alias("invented"), F.when(F.coalesce("n_unknown", F.lit(0)) + F.coalesce("n_invented", F.lit(0)) == 0, "PASS").otherwise("FAIL").alias("verdict"),
    )
