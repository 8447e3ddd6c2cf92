"""Helpers over profiles: imports by section, references, rendering, checks, lookups, profiles of rules, evidence rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyroom.functions.text import fold
from tallyroom.operators.tables import stated_list


def apply_import(local: DataFrame, incoming: DataFrame, key: list[str], section: str, strategies: dict[str, str]) -> DataFrame:
    """Rows after an import: a section's strategy is merge (what is here wins), replace (what comes alone) or keep (what is here alone).

    A section without a strategy is merged; a section that is to be replaced by nothing stays as it is.
    """
    columns = local.columns
    way = F.coalesce(*[F.when(F.col(section) == s, F.lit(w)) for s, w in strategies.items()], F.lit("merge"))
    filled = incoming.select(section).distinct().withColumn("__filled", F.lit(True))
    here = local.join(filled, section, "left").where((way != "replace") | F.col("__filled").isNull()).select(*columns, F.lit(0).alias("__side"))
    there = incoming.where(way != "keep").select(*columns, F.lit(1).alias("__side"))
    rest = [c for c in columns if c not in key]
    return here.unionByName(there).groupBy(*key).agg(F.min_by(F.struct(*rest), "__side").alias("r")).select(*key, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*columns)


def references(rows: DataFrame, ident: str, ref: str, snapshots: DataFrame, owner: str, snap: str, order: str) -> DataFrame:
    """(ident, state, relinked): OK, NONE or BROKEN by whether the snapshot that a row names exists, and for a broken one the owner's newest."""
    newest = snapshots.groupBy(owner).agg(F.max_by(snap, F.struct(order, snap)).alias("__newest"))
    known = snapshots.select(F.col(snap).alias("__snap")).distinct()
    out = rows.join(known, F.col(ref) == F.col("__snap"), "left").join(newest, owner, "left")
    state = F.when(F.col(ref).isNull(), "NONE").when(F.col("__snap").isNull(), "BROKEN").otherwise("OK")
    return out.select(ident, state.alias("state"), F.when(state == "BROKEN", F.col("__newest")).otherwise(F.col(ref)).alias("relinked"))


def rendered(rows: DataFrame, by: list[str], order: list[str], text: Column, override: Column) -> DataFrame:
    """(by, text): the parts in order, one a line, an override in the place of its part; empty parts are left out."""
    part = F.nullif(F.trim(F.coalesce(override, text)), F.lit(""))
    parts = F.array_sort(F.collect_list(F.when(part.isNotNull(), F.struct(*order, part.alias("__t")))))
    return rows.groupBy(*by).agg(F.array_join(F.transform(parts, lambda p: p["__t"]), "\n").alias("text"))


def injected_tokens(template: Column, values: dict[str, Column], missing: str = "...") -> Column:
    """The template with {name} replaced by values; a null or empty value by ``missing``."""
    return reduce(lambda t, kv: F.replace(t, F.lit("{" + kv[0] + "}"), F.coalesce(F.nullif(kv[1], F.lit("")), F.lit(missing))), values.items(), template)


def checklist(df: DataFrame, ident: str, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(ident, check, status): OK, WARN or FAIL of each check (ok, nearly), one row each; null is not met."""
    grade = lambda ok, near: F.when(F.coalesce(ok, F.lit(False)), "OK").when(F.coalesce(near, F.lit(False)), "WARN").otherwise("FAIL")
    rows = F.array(*[F.struct(F.lit(n).alias("check"), grade(*c).alias("status")) for n, c in checks.items()])
    return df.select(ident, F.explode(rows).alias("c")).select(ident, "c.*")


def looked_up(queries: DataFrame, places: DataFrame, query: str, ident: str, name: str) -> DataFrame:
    """(query, ident): the place whose id the query is, else whose folded name, else whose name begins with it or begins it; the first by name.

    queries: a stated list, sent to all places.
    """
    q = stated_list(queries.select(query, fold(F.trim(F.col(query))).alias("__q")).where("__q <> ''").distinct())
    rows = places.select(F.col(ident).cast("string").alias("__id"), fold(F.col(name)).alias("__n"))
    way = F.when(F.col("__q") == F.col("__id"), 1).when(F.col("__q") == F.col("__n"), 2).when(F.startswith("__n", "__q") | F.startswith("__q", "__n"), 3)
    hits = rows.join(q).withColumn("__way", way).where("__way IS NOT NULL")
    return hits.groupBy(query).agg(F.min_by("__id", F.struct("__way", "__n", "__id")).alias("place"))


def rule_profiles(docs: DataFrame, key: str, text: str, rules: list[tuple[str, str, str, str]]) -> DataFrame:
    """(key, profile, found, missing, advice, passed): what each profile of rules finds in a text.

    rules: rows (profile, field, pattern, severity), the severity ``required``, ``advised`` or ``forbidden``; a table of
    them becomes one projection, in which a pattern that several profiles share is tried once.  found: fields whose
    pattern stands in the text; missing: required ones that don't, and forbidden ones that do; advice: advised ones that
    don't.  passed: nothing is missing.  Lists are in the order of the rules; a null text holds nothing.
    """
    patterns = list(dict.fromkeys(p for _, _, p, _ in rules))
    tried = docs.select(key, F.array(*[F.coalesce(F.col(text), F.lit("")).rlike(p) for p in patterns]).alias("__met"))
    has = lambda p: F.col("__met")[patterns.index(p)]
    some = lambda rows: F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rows], F.lit(None).cast("string")), lambda x: x.isNotNull())
    parts = []
    for profile in dict.fromkeys(p for p, *_ in rules):
        own = [(f, has(p), kind) for name, f, p, kind in rules if name == profile]
        missing = some([(f, ~met if kind == "required" else met) for f, met, kind in own if kind != "advised"])
        parts.append(F.struct(F.lit(profile).alias("profile"), some([(f, met) for f, met, _ in own]).alias("found"), missing.alias("missing"), some([(f, ~met) for f, met, kind in own if kind == "advised"]).alias("advice")))
    return tried.select(key, F.explode(F.array(*parts)).alias("p")).select(key, "p.*", (F.size("p.missing") == 0).alias("passed"))


def evidence_violations(df: DataFrame, ident: str, owner: str, rules: dict[str, Column]) -> DataFrame:
    """(ident, violation): broken rules of rows, ids that stand twice, and ids that two owners claim."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    own = df.select(ident, F.explode(broken).alias("violation")).distinct()
    counts = df.groupBy(ident).agg(F.count("*").alias("n"), F.min(owner).alias("a"), F.max(owner).alias("b"))
    return own.union(counts.where("n > 1").select(ident, F.lit("DUPLICATE"))).union(counts.where("a <> b").select(ident, F.lit("TWO_OWNERS")))


def strict_signals(confidence: Column, order_weight: Column, fulfilled: Column, order_confidence: Column, least: float = 0.85) -> Column:
    """struct(order_used, fulfilled): evidence of the order that is less sure than ``least`` is left out, and its weight lowers what is fulfilled."""
    used = F.coalesce(order_confidence >= least, F.lit(False)) & confidence.isNotNull()
    return F.struct(used.alias("order_used"), F.when(used, fulfilled).otherwise(F.greatest(F.lit(0.0), fulfilled - order_weight)).alias("fulfilled"))


def global_consensus(domains: DataFrame, by: list[str], weights: dict[str, float], cap: Column) -> DataFrame:
    """(by, score, n_domains, missing): the shifted geometric mean of domains' scores by weight, under the least cap; a domain without a score shares its weight.

    domains: (by, domain, score).  No domain with a score: null.
    """
    w = F.coalesce(*[F.when(F.col("domain") == d, F.lit(x)) for d, x in weights.items()], F.lit(0.0))
    wk = F.when(F.col("score").isNotNull(), w)
    mean = F.exp(F.sum(wk * F.ln(F.col("score") + 1)) / F.nullif(F.sum(wk), F.lit(0.0))) - 1
    out = domains.groupBy(*by).agg(mean.alias("m"), F.count("score").alias("n_domains"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("score").isNull(), F.col("domain")))), ",").alias("missing"), F.min(cap).alias("cap"))
    return out.select(*by, F.when(F.col("m").isNotNull(), F.least(F.col("m"), F.coalesce("cap", F.lit(100.0)))).alias("score"), "n_domains", "missing")
