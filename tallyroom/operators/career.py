"""Records of work: verbs, experience and telemetry scores, relevance, bridges, benefits, quotas, revisions and stages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyroom.functions.text import let

#: Weights of the parts of a telemetry score, and points that a blocking finding costs.
WEIGHTS, BLOCKING = {"hard": 0.4, "experience": 0.25, "structure": 0.2, "verbs": 0.15}, 25


def round_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def verb_ratio(text: Column, verbs: list[str], form: str | None = None) -> Column:
    """The share of sentences with a listed verb, or with a word of the form; no sentence: null."""
    sentences = F.filter(F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), "[.!?\n]+"), lambda s: F.trim(s)), lambda s: s != "")

    def has(s: Column) -> Column:
        words = F.split(s, "[^\\p{L}]+")
        hit = F.arrays_overlap(words, F.array(*[F.lit(v) for v in verbs]))
        return hit if form is None else hit | F.exists(words, lambda w: w.rlike(form))

    return let(sentences, lambda s: F.when(F.size(s) > 0, F.size(F.filter(s, has)) / F.size(s)))


def experience_score(years: Column, roles: Column, points: Column, measured: Column) -> Column:
    """0 to 100: half by years (15 at most), a quarter by the share of points with a number, a quarter by points a role (3).

    Without points the second part is left out and the others share its weight; no roles or years: null.
    """
    depth = F.least(F.lit(1.0), points / roles / 3) * 25
    tenure = F.least(F.lit(15.0), years) / 15 * 50
    return F.when((roles > 0) & years.isNotNull(), F.when(points > 0, round_up(tenure + measured / points * 25 + depth)).otherwise(round_up((tenure + depth) / 0.75)))


def layout_score(disordered: Column, headings: Column, tables: Column, glyphs: Column) -> Column:
    """100 less 35 for a broken order, 25 for broken headings, 10 a table (30 at most), 2 for each 5 odd glyphs (20 at most)."""
    off = F.when(disordered, 35).otherwise(0) + F.when(headings, 0).otherwise(25) + F.least(F.lit(30), tables * 10) + F.least(F.lit(20), F.ceil(glyphs / 5) * 2)
    return F.greatest(F.lit(0), 100 - off).cast("long")


def telemetry_score(hard: Column, experience: Column, structure: Column, verbs: Column, blocking: Column, requirements: Column) -> Column:
    """struct(score, assessed): the weighted mean of the parts that are known less the blocking findings, and their weight in per cent.

    No requirements, or no experience: the score is null.
    """
    parts = {"hard": hard, "experience": experience, "structure": structure, "verbs": verbs}
    weight = reduce(lambda x, y: x + y, [F.when(p.isNotNull(), WEIGHTS[n]).otherwise(0.0) for n, p in parts.items()])
    total = reduce(lambda x, y: x + y, [F.coalesce(p * WEIGHTS[n], F.lit(0.0)) for n, p in parts.items()])
    score = F.least(F.lit(100), F.greatest(F.lit(0), round_up(total / weight) - F.least(F.lit(100), blocking * BLOCKING)))
    return F.struct(F.when(experience.isNotNull() & (hard.isNotNull() | (requirements > 0)), score).alias("score"), round_up(weight * 100).alias("assessed"))


def title_similarity(a: Column, b: Column) -> Column:
    """1 for equal titles, 0.8 where one stands within the other as words, else half the share of b's words that a has."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    words = lambda t: F.split(t, "\\s+")
    within = F.concat(F.lit(" "), x, F.lit(" ")).contains(F.concat(F.lit(" "), y, F.lit(" "))) | F.concat(F.lit(" "), y, F.lit(" ")).contains(F.concat(F.lit(" "), x, F.lit(" ")))
    shared = F.size(F.filter(words(y), lambda w: F.array_contains(words(x), w))) / F.size(words(y))
    real = x.rlike("[\\p{L}\\p{N}]") & y.rlike("[\\p{L}\\p{N}]")
    return F.when(F.coalesce(real, F.lit(False)), F.when(x == y, 1.0).when(within, 0.8).otherwise(0.5 * shared)).otherwise(0.0)


def rank_points(points: DataFrame, by: list[str], order: list[str], words: Column, keywords: list[str]) -> DataFrame:
    """The columns, then score (the share of the keywords among a point's words) and rank; equal ones keep their order."""
    wanted = F.array(*[F.lit(k) for k in dict.fromkeys(keywords)])
    rows = points.withColumn("score", F.size(F.array_intersect(words, wanted)) / len(dict.fromkeys(keywords)))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), *order)))


def rank_roles(points: DataFrame, roles: DataFrame, by: list[str], role: str, order: list[str], title: Column) -> DataFrame:
    """(by, role, score, rank) of roles by their points' scores (role, score), their title's likeness and how recent they are.

    0.5 best point, 0.3 mean, 0.15 title, and 0.1 for the newest, 0.02 less for each role before it.
    """
    scores = points.groupBy(role).agg(F.max("score").alias("best"), F.avg("score").alias("mean"))
    rows = roles.join(scores, role, "left").withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])) - 1)
    score = 0.5 * F.coalesce("best", F.lit(0.0)) + 0.3 * F.coalesce("mean", F.lit(0.0)) + 0.15 * title + F.greatest(F.lit(0.0), 0.1 - 0.02 * F.col("i"))
    rows = rows.withColumn("score", F.round(score, 9))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "i"))).select(*by, role, "score", "rank")


def bridges(lacks: DataFrame, evidence: DataFrame, rules: list[tuple[str, list[str]]], owner: str, skill: str) -> DataFrame:
    """(owner, skill, adjacent) for skills that an owner lacks: of the first rule that fits, the first neighbour with evidence.

    rules: a pattern for the skill and its neighbours, in order; a skill that has evidence itself has no bridge; a rule
    without a neighbour that has evidence leaves the next its turn.
    """
    near = F.flatten(F.array(*[F.when(F.lower(F.col(skill)).rlike(p), F.array(*[F.lit(a) for a in adjacent])).otherwise(F.array().cast("array<string>")) for p, adjacent in rules]))
    have = evidence.select(owner, F.lower(F.col(skill)).alias("have")).distinct()
    open_ = lacks.join(have, (lacks[owner] == have[owner]) & (F.lower(lacks[skill]) == have["have"]), "left_anti")
    rows = open_.select(owner, skill, F.posexplode(near).alias("i", "adjacent"))
    hits = rows.join(have, (rows[owner] == have[owner]) & (F.lower(rows["adjacent"]) == have["have"])).select(rows[owner], skill, "i", "adjacent")
    return hits.groupBy(owner, skill).agg(F.min_by("adjacent", "i").alias("adjacent"))


def benefits(text: Column, assumptions: list[tuple[str, list[str], float | None]], negation: str) -> Column:
    """Array of (benefit, value) that a text offers: a keyword in a clause that no negation stands before; value may be null."""
    clauses = F.split(F.lower(F.coalesce(text, F.lit(""))), "[.;!?\n]+")

    def offered(words: list[str]) -> Column:
        said = "|".join(words)
        return F.exists(clauses, lambda c: c.rlike(said) & ~c.rlike(f"(?:{negation}).*(?:{said})"))

    found = [F.when(offered(w), F.struct(F.lit(n).alias("benefit"), F.lit(v).cast("double").alias("value"))) for n, w, v in assumptions]
    return F.filter(F.array(*found), lambda b: b.isNotNull())


def package_value(found: Column) -> Column:
    """The sum of what is valued."""
    return F.aggregate(found, F.lit(0.0), lambda s, b: s + F.coalesce(b["value"], F.lit(0.0)))


def counter_with_refunds(df: DataFrame, by: list[str], order: list[str], refund: Column) -> DataFrame:
    """The columns, then used: a counter that each event raises by one and a refund lowers, never below 0.

    A running sum less its lowest point below 0: no state is carried by hand.
    """
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = df.withColumn("__s", F.sum(F.when(refund, -1).otherwise(1)).over(w))
    return rows.withColumn("used", (F.col("__s") - F.least(F.lit(0), F.min("__s").over(w))).cast("long")).drop("__s")


def revision_rule(state: dict, _: int, base: int | None) -> bool:
    """A save is taken if it is based on the current revision, which it raises; any other is a conflict."""
    if base != state.setdefault("revision", 0):
        return False
    state["revision"] += 1
    return True


def snapshot_states(df: DataFrame, by: list[str], order: list[str], checked: Column, passed: Column) -> DataFrame:
    """The columns, then state: SHADOW until checked, REJECTED if it fails, ACTIVE for the newest of a group that passes, else VALIDATED.

    The newest is a maximum by key, so a group of any size is combined first; there is one ACTIVE a group at most.
    """
    newest = df.where(checked & passed).groupBy(*by).agg(F.max(F.struct(*order)).alias("__newest"))
    state = F.when(~checked, "SHADOW").when(~passed, "REJECTED").when(F.struct(*order) == F.col("__newest"), "ACTIVE").otherwise("VALIDATED")
    return df.join(newest, by, "left").withColumn("state", state).drop("__newest")


def interview_sessions(df: DataFrame, by: list[str], order: list[str], stage: Column, note: Column, time: str) -> DataFrame:
    """(by, started, stage, n_notes, notes): when a session first had a stage, its last one, and its notes, each with the stage at its time."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = df.withColumns({"__stage": stage, "__note": F.nullif(F.trim(note), F.lit(""))}).withColumn("__at", F.last("__stage", ignorenulls=True).over(w))
    notes = F.collect_list(F.when(F.col("__note").isNotNull(), F.struct(*order, F.concat_ws(": ", F.coalesce("__at", F.lit("-")), "__note").alias("n"))))
    out = rows.groupBy(*by).agg(F.min(F.when(F.col("__stage").isNotNull(), F.col(time))).alias("started"), F.max(F.when(F.col("__stage").isNotNull(), F.struct(*order, F.col("__stage").alias("s"))))["s"].alias("stage"), F.array_sort(notes).alias("x"))
    return out.select(*by, "started", "stage", F.size("x").cast("long").alias("n_notes"), F.array_join(F.transform("x", lambda x: x["n"]), " | ").alias("notes"))


def next_meeting(df: DataFrame, by: list[str], time: str, scheduled: Column, done: Column) -> DataFrame:
    """(by, at): the earliest scheduled meeting, however long ago; without one the latest that was held."""
    return df.groupBy(*by).agg(F.coalesce(F.min(F.when(scheduled, F.col(time))), F.max(F.when(done, F.col(time)))).alias("at"))


def corridor(same_area: Column, pair: Column, direct: Column, roads: list[tuple[str, list[tuple[str, str]], float, float, float]]) -> Column:
    """struct(corridor, road_km, minutes) of a way: within an area, along the first road that links the pair, else by distance.

    roads: name, pairs of places, detour factor, km an hour, minutes at the ends.  pair: two places in the order of
    their names, joined by a bar.
    """
    near, mid = direct < 30, direct < 100
    # fixed values: factors, speeds and minutes where no road is named
    out = F.struct(F.lit("REGIONAL").alias("name"), F.when(near, 1.25).when(mid, 1.22).otherwise(1.2).alias("factor"), F.when(direct < 40, 55.0).when(direct < 120, 70.0).otherwise(85.0).alias("speed"), F.when(near, 5.0).otherwise(10.0).alias("ends"))
    part = lambda n, f, s, e: F.struct(F.lit(n).alias("name"), F.lit(f).alias("factor"), F.lit(s).alias("speed"), F.lit(e).alias("ends"))
    for name, pairs, factor, speed, ends in reversed(roads):
        out = F.when(pair.isin(*["|".join(sorted(p)) for p in pairs]), part(name, factor, speed, ends)).otherwise(out)
    out = F.when(same_area, part("URBAN", 1.25, 45.0, 4.0)).otherwise(out)

    def of(r: Column) -> Column:
        km = round_up(direct * r["factor"])
        km = F.when(r["name"] == "URBAN", F.greatest(round_up(direct + 1.5), km)).otherwise(km)
        return F.struct(r["name"].alias("corridor"), km.alias("road_km"), F.greatest(F.lit(8), round_up(km / r["speed"] * 60 + r["ends"])).alias("minutes"))

    return let(out, of)


def polish_key(text: Column, alphabet: str = "aąbcćdeęfghijklłmnńoópqrsśtuvwxyzźż") -> Column:
    """Lower case with each letter as its place in the alphabet, so that plain order is the alphabet's; other signs stay."""
    return F.translate(F.lower(text), alphabet, "".join(chr(0x4E00 + i) for i in range(len(alphabet))))
