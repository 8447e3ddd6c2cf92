"""Offers and profiles as texts: cleaning, fields, phrases, taxonomies, groups of requirements, entries, names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyroom.functions.phrases import bounded, month_range
from tallyroom.functions.text import fold, let, plain_tokens, token_runs


def cleaned_offer(text: Column, noise: str, tail: str) -> Column:
    """The lines of an offer up to the first that begins the tail, without those that are noise; lines are trimmed, empty ones go."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")

    def cut(x: Column) -> Column:
        at = F.array_min(F.filter(F.transform(x, lambda t, i: F.when(F.lower(t).rlike(tail), i)), lambda i: i.isNotNull()))
        return F.filter(F.slice(x, F.lit(1), F.coalesce(at, F.size(x))), lambda t: ~F.lower(t).rlike(noise))

    return F.array_join(let(lines, cut), "\n")


def offer_segments(docs: DataFrame, key: str, text: str, header: str) -> DataFrame:
    """(key, segment, content): the offers of a text that holds several; each begins at a line that matches the header, what comes before is 0."""
    parts = F.split(F.coalesce(F.col(text), F.lit("")), f"(?m)(?=^(?:{header}))")
    rows = docs.select(key, F.posexplode(parts).alias("i", "content"), F.when(parts[0].rlike(f"^(?:{header})"), 1).otherwise(0).alias("first"))
    return rows.where("trim(content) <> ''").select(key, (F.col("i") + F.col("first")).alias("segment"), F.trim("content").alias("content"))


def lifted_fields(text: Column, labels: dict[str, str]) -> Column:
    """struct of fields that a text names as "label: value" on a line of their own; the first of each counts."""
    return F.struct(*[F.nullif(F.trim(F.regexp_extract(text, f"(?im)^\\s*(?:{p})\\s*:\\s*(.+)$", 1)), F.lit("")).alias(n) for n, p in labels.items()])


def dictionary_phrases(docs: DataFrame, key: str, text: str, phrases: DataFrame, most: int = 3) -> DataFrame:
    """(key, phrase, kind, weight) of dictionary phrases (phrase, kind, weight) in a text, by runs of its words.

    A phrase of kind hard that stands within a longer hard one that the text has is not listed beside it.
    """
    runs = let(plain_tokens(F.col(text)), lambda w: F.array_distinct(F.transform(F.concat(*[token_runs(w, n) for n in range(1, most + 1)]), lambda r: r["phrase"])))
    hits = docs.select(key, F.explode(runs).alias("phrase")).join(phrases, "phrase")
    words = F.concat(F.lit(" "), F.col("phrase"), F.lit(" "))
    longer = hits.where("kind = 'hard'").groupBy(key).agg(F.collect_set(words).alias("__all"))
    within = F.exists("__all", lambda p: p.contains(words) & (p != words))
    return hits.join(longer, key, "left").where(~F.coalesce((F.col("kind") == "hard") & within, F.lit(False))).select(key, "phrase", "kind", "weight")


def taxonomy_hits(text: Column, definitions: list[tuple[str, str, str | None]]) -> Column:
    """Names of the definitions (name, pattern, guard) that a text meets: the pattern, and the guard's pattern where there is one."""
    low = fold(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*[F.when(low.rlike(p) & (low.rlike(g) if g else F.lit(True)), F.lit(n)) for n, p, g in definitions]), lambda x: x.isNotNull())


def requirement_groups(df: DataFrame, by: list[str], order: str, connector: str) -> DataFrame:
    """The columns, then kind and head: items that "or" ties are ANY_OF, then items left over that "and" ties ALL_OF, else SINGLE.

    connector: what stands between an item and the next.  head: the order of a group's first item.  ANY_OF claims first,
    so an item between "and" and "or" is in the ANY_OF group.
    """
    w = Window.partitionBy(*by).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.coalesce(F.lag(connector).over(w), F.lit(""))
    here = F.when(F.lead(order).over(w).isNotNull(), F.coalesce(F.col(connector), F.lit(""))).otherwise("")
    rows = df.withColumns({"__before": before, "__here": here})
    rows = rows.withColumn("__any", (F.col("__before") == "or") | (F.col("__here") == "or"))
    # tied to the item before by "and", where neither is claimed
    tied = (F.col("__before") == "and") & ~F.col("__any") & ~F.coalesce(F.lag("__any").over(w), F.lit(False))
    rows = rows.withColumn("__tied", tied).withColumn("__next", F.coalesce(F.lead("__tied").over(w), F.lit(False)))
    kind = F.when(F.col("__any"), "ANY_OF").when(F.col("__tied") | F.col("__next"), "ALL_OF").otherwise("SINGLE")
    begins = F.when(F.col("__any"), F.col("__before") != "or").otherwise(~F.col("__tied"))
    rows = rows.withColumns({"kind": kind, "__begins": begins})
    return rows.withColumn("head", F.last(F.when(F.col("__begins"), F.col(order)), ignorenulls=True).over(upto)).drop("__before", "__here", "__any", "__tied", "__next", "__begins")


def profile_entries(lines: DataFrame, key: str, dated: list[str], listed: list[str]) -> DataFrame:
    """(key, section, line, entry, first, last) of a text's lines by section (key, line, section, content).

    In dated sections an entry is a line with a range of months in brackets at its end; in listed ones what commas
    part.  Header lines and other sections give none.
    """
    body = F.trim("content")
    when = month_range(F.regexp_extract(body, "\\(([^()]*)\\)$", 1))
    a = lines.where(F.col("section").isin(*dated)).select(key, "section", "line", F.trim(F.regexp_replace(body, "\\([^()]*\\)$", "")).alias("entry"), when.alias("r")).where("r IS NOT NULL AND entry <> ''")
    b = lines.where(F.col("section").isin(*listed) & F.col("content").contains(",")).select(key, "section", "line", F.explode(F.transform(F.split("content", ","), lambda x: F.trim(x))).alias("entry")).where("entry <> ''")
    return a.select(key, "section", "line", "entry", "r.first", "r.last").union(b.select(key, "section", "line", "entry", F.lit(None).cast("int"), F.lit(None).cast("int")))


def by_name(queries: DataFrame, entities: DataFrame, aliases: DataFrame, query: str) -> DataFrame:
    """(query, id): the entity (id, name) of that name in any case, else of the folded name, else of an alias (id, alias); the least id.

    Three equi-joins, and the first that finds one counts.
    """
    q = queries.select(query, F.lower(F.trim(F.col(query))).alias("__low"), fold(F.trim(F.col(query))).alias("__fold"))
    forms = entities.select("id", F.lit(1).alias("o"), F.lower("name").alias("k")).union(entities.select("id", F.lit(2), fold(F.col("name")))).union(aliases.select("id", F.lit(3), fold(F.col("alias"))))
    asked = q.select(query, F.explode(F.array(F.struct(F.lit(1).alias("o"), F.col("__low").alias("k")), F.struct(F.lit(2).alias("o"), F.col("__fold").alias("k")), F.struct(F.lit(3).alias("o"), F.col("__fold").alias("k")))).alias("x")).select(query, "x.*")
    return asked.join(forms, ["o", "k"]).groupBy(query).agg(F.min(F.struct("o", "id"))["id"].alias("id"))


def first_category(text: Column, table: list[tuple[str, list[str]]], otherwise: str | None = None) -> Column:
    """The first category one of whose words stands in the text."""
    low = fold(F.coalesce(text, F.lit("")))
    hit = lambda words: reduce(lambda x, y: x | y, [low.rlike(bounded(w)) for w in words])
    return F.coalesce(*[F.when(hit(ws), F.lit(n)) for n, ws in table], F.lit(otherwise))


def merge_summary(local: DataFrame, incoming: DataFrame, key: list[str], section: str, value: str) -> DataFrame:
    """(section, added, changed, same, only_here) of an import."""
    both = local.select(*key, F.col(value).alias("a"), F.lit(True).alias("here")).join(incoming.select(*key, F.col(value).alias("b"), F.lit(True).alias("there")), key, "full")
    return both.groupBy(section).agg(
        F.count_if(F.col("here").isNull()).alias("added"), F.count_if(F.col("here") & F.col("there") & ~F.col("a").eqNullSafe(F.col("b"))).alias("changed"),
        F.count_if(F.col("here") & F.col("there") & F.col("a").eqNullSafe(F.col("b"))).alias("same"), F.count_if(F.col("there").isNull()).alias("only_here"),
    )


def rule_status(findings: DataFrame, by: list[str], rule: str, polarity: str, parents: DataFrame) -> DataFrame:
    """(by, rule, status) of mentions: REQUIRED if any is, else PREFERRED, else INFORMATION; NEGATED ones say nothing.

    parents: (rule, parent); a general rule goes where one of its special ones is required.
    """
    rank = F.when(F.col(polarity) == "REQUIRED", 3).when(F.col(polarity) == "PREFERRED", 2).when(F.col(polarity) == "INFORMATION", 1)
    said = findings.groupBy(*by, rule).agg(F.max(rank).alias("r")).where("r IS NOT NULL")
    special = said.where("r = 3").join(parents, rule).select(*by, F.col("parent").alias(rule)).distinct()
    left = said.join(special, [*by, rule], "left_anti")
    return left.select(*by, rule, F.element_at(F.array(F.lit("INFORMATION"), F.lit("PREFERRED"), F.lit("REQUIRED")), F.col("r")).alias("status"))
