"""Requirements against evidence: ontology closure, best match, three truth values, groups, recency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyroom.functions.numbers import clamp, half_life, piecewise, smoothstep
from tallyroom.functions.text import let
from tallyroom.operators.scoring import weighted_geometric
from tallyroom.operators.tables import saved

#: How far evidence for a narrower, and for a wider, concept supports a requirement.
SAME, NARROWER, WIDER = 1.0, 0.95, 0.25


def ancestors(parents: DataFrame, node: str = "id", parent: str = "parent", most: int = 12) -> DataFrame:
    """(node, ancestor, depth) of a parent table; the smallest depth of each pair, at most ``most`` steps.

    Doubling: paths of n steps join paths of n steps, so rounds grow with the logarithm of the depth; a cycle ends it.
    """
    found = parents.select(F.col(node).alias("n"), F.col(parent).alias("a"), F.lit(1).alias("d")).where("n IS NOT NULL AND a IS NOT NULL AND n <> a").distinct()
    paths, steps, n = saved(found), 1, -1
    while steps < most and n != (n := paths.count()):
        longer = paths.alias("x").join(paths.alias("y"), F.col("x.a") == F.col("y.n")).select("x.n", "y.a", (F.col("x.d") + F.col("y.d")).alias("d")).where("n <> a")
        # written, as each round names the one before twice
        paths = saved(paths.unionByName(longer).groupBy("n", "a").agg(F.min("d").alias("d")))
        steps *= 2
    return paths.where(F.col("d") <= most).select(F.col("n").alias(node), F.col("a").alias("ancestor"), "d")


def relation_strengths(nodes: DataFrame, closure: DataFrame, node: str = "id") -> DataFrame:
    """(requirement, concept, strength): an equi-join table for what would be a nested loop over an ontology."""
    same = nodes.select(F.col(node).alias("requirement"), F.col(node).alias("concept"), F.lit(SAME).alias("strength"))
    narrower = closure.select(F.col("ancestor").alias("requirement"), F.col(node).alias("concept"), F.lit(NARROWER).alias("strength"))
    wider = closure.select(F.col(node).alias("requirement"), F.col("ancestor").alias("concept"), F.lit(WIDER).alias("strength"))
    return same.unionByName(narrower).unionByName(wider).groupBy("requirement", "concept").agg(F.max("strength").alias("strength"))


def best_matches(requirements: DataFrame, evidence: DataFrame, relations: DataFrame, owner: str, complete: Column, accept: float = 0.40, known_at: float = 0.75) -> DataFrame:
    """The requirements' columns, then fulfilment, status and best: evidence (owner, concept, depth, confidence, evidence_id).

    Of a requirement's evidence that is sure enough, the one with the largest strength * depth counts, the smallest id
    of equals.  No such evidence: NOT_FOUND where the owner's record is complete enough, else UNKNOWN.
    Best evidence of each owner and requirement is a maximum by key, so an owner may hold any share of the evidence.
    """
    sure = evidence.where(F.col("confidence") >= accept)
    # an owner's best for each concept first: fewer rows meet the relations
    tops = sure.groupBy(owner, "concept").agg(F.max(F.struct("depth", (-F.col("evidence_id")).alias("neg"))).alias("top"))
    hits = tops.join(relations, "concept")
    found = hits.groupBy(owner, "requirement").agg(F.max(F.struct((F.col("strength") * F.col("top.depth")).alias("f"), F.col("top.neg").alias("neg"))).alias("m"))
    out = requirements.join(found, [owner, "requirement"], "left")
    got = F.coalesce(F.col("m.f"), F.lit(0.0))
    status = F.when(got >= 0.999, "CONFIRMED").when(got > 0, "PARTIAL").when(complete >= known_at, "NOT_FOUND").otherwise("UNKNOWN")
    return out.withColumns({"fulfilment": got, "status": status, "best": -F.col("m.neg")}).drop("m")


def scenario(unknown: float) -> dict[str, Column]:
    """Aggregates of matches with UNKNOWN counted as ``unknown``: the musts' two means and the nice-to-haves' mean."""
    v = clamp(F.when(F.col("status") == "UNKNOWN", F.lit(unknown)).otherwise(F.col("fulfilment")))
    w = F.greatest(F.lit(0.0), F.col("weight"))
    must, nice = F.col("priority").isin("MUST", "CORE_MUST"), F.col("priority") == "NICE"
    wm, wn = F.when(must, w), F.when(nice, w)
    return {"arithmetic": F.sum(wm * v) / F.sum(wm), "geometric": weighted_geometric(F.when(must, v), wm), "nice": F.sum(wn * v) / F.sum(wn)}


def scenario_score(arithmetic: Column, geometric: Column, nice: Column) -> Column:
    """0 to 100: musts through a curve, then nice-to-haves behind a gate that the musts open."""
    extra = F.pow(clamp(nice), F.lit(2.40))

    def of(both: Column) -> Column:
        curve = let(both, lambda x: piecewise(x))
        return let(100 * F.when(arithmetic.isNull(), extra).when(nice.isNull(), curve).otherwise(0.8 * curve + 0.2 * smoothstep(both) * extra), lambda x: clamp(x, 0.0, 100.0))

    return let(clamp(0.55 * arithmetic + 0.45 * geometric), of)


def alignment(matches: DataFrame, owner: str, cap: float = 35.0) -> DataFrame:
    """(owner, low, mid, high, width, unknown_share, n_matched, suppressed, score): the interval that unknowns leave open.

    A core requirement that is surely missing caps all three.  The score is null where the interval is wider than 30 or
    unknown musts weigh more than 0.30 of all.  One pass over the matches.
    """
    must, unknown = F.col("priority").isin("MUST", "CORE_MUST"), F.col("status") == "UNKNOWN"
    ways = {"low": 0.0, "mid": 0.5, "high": 1.0}
    out = matches.groupBy(owner).agg(
        F.min(F.when((F.col("priority") == "CORE_MUST") & ~unknown & (F.col("fulfilment") < 0.20), F.lit(cap))).alias("cap"),
        F.coalesce(F.sum(F.when(must & unknown, F.col("weight"))) / F.sum(F.when(must, F.col("weight"))), F.lit(0.0)).alias("unknown_share"),
        F.count_if(F.col("status").isin("CONFIRMED", "PARTIAL")).alias("n_matched"),
        *[c.alias(f"{name}_{k}") for name, u in ways.items() for k, c in scenario(u).items()],
    )
    # the curve stands once in the plan, over an array of the three ways
    parts = ("arithmetic", "geometric", "nice")
    out = out.withColumn("ways", F.array(*[F.struct(*[F.col(f"{n}_{k}").alias(k) for k in parts]) for n in ways]))
    out = out.withColumn("ways", F.transform("ways", lambda x: F.least(scenario_score(*[x[k] for k in parts]), F.coalesce("cap", F.lit(100.0)))))
    out = out.withColumns({n: F.col("ways")[i] for i, n in enumerate(ways)})
    out = out.withColumn("width", F.greatest(F.lit(0.0), F.col("high") - F.col("low")))
    out = out.withColumn("suppressed", (F.col("width") > 30) | (F.col("unknown_share") > 0.30))
    return out.select(owner, "low", "mid", "high", "width", "unknown_share", "n_matched", "suppressed", F.when(~F.col("suppressed"), F.col("mid")).alias("score"))


def logical_units(matches: DataFrame, by: list[str], operator: str) -> DataFrame:
    """(by, operator, weight, fulfilment, status): ANY_OF takes the best known member and the largest weight, ALL_OF the worst and the sum."""
    known = F.col("status") != "UNKNOWN"
    out = matches.groupBy(*by, operator).agg(
        F.coalesce(F.max(F.when(known, F.col("fulfilment"))), F.lit(0.0)).alias("best"), F.min("fulfilment").alias("worst"),
        F.bool_or(~known).alias("unknown"), F.bool_or(F.col("status") == "NOT_FOUND").alias("missing"), F.max("weight").alias("top"), F.sum("weight").alias("all"),
    )
    any_of = F.col(operator) == "ANY_OF"
    value = F.when(any_of, F.col("best")).when(F.col("missing") | F.col("unknown"), 0.0).otherwise(F.col("worst"))
    graded = F.when(F.col("value") >= 0.999, "CONFIRMED").when(F.col("value") > 0, "PARTIAL")
    status = F.when(any_of, F.coalesce(graded, F.when(F.col("unknown"), "UNKNOWN").otherwise("NOT_FOUND"))).when(F.col("missing"), "NOT_FOUND").when(F.col("unknown"), "UNKNOWN").otherwise(F.coalesce(graded, F.lit("NOT_FOUND")))
    return out.withColumn("value", value).select(*by, operator, F.when(any_of, F.col("top")).otherwise(F.col("all")).alias("weight"), F.col("value").alias("fulfilment"), status.alias("status"))


def formal_score(units: DataFrame, owner: str, must_share: float = 0.85) -> DataFrame:
    """(owner, score, n_unknown): musts weigh 85, others 15, of what there is; null where a must is unknown."""
    must = F.col("mandatory")
    mean = lambda m: F.sum(F.when(m, F.col("weight") * F.col("fulfilment"))) / F.sum(F.when(m, F.col("weight")))
    out = units.groupBy(owner).agg(F.count_if(must & (F.col("status") == "UNKNOWN")).alias("n_unknown"), mean(must).alias("m"), mean(~must).alias("n"))
    both = F.when(F.col("m").isNull(), F.col("n")).when(F.col("n").isNull(), F.col("m")).otherwise(must_share * F.col("m") + (1 - must_share) * F.col("n"))
    return out.select(owner, F.when(F.col("n_unknown") == 0, 100 * both).alias("score"), "n_unknown")


def recency(observations: DataFrame, by: list[str], age: str, strength: str, weight: str, owner: str, half: float = 48.0) -> DataFrame:
    """(owner, recency, n): the best decayed observation of each of ``by``, averaged by weight; future ones don't count."""
    best = observations.where(F.col(age) >= 0).groupBy(owner, *by).agg(F.max(half_life(F.col(age), half) * F.col(strength)).alias("v"), F.max(weight).alias("w"))
    return best.groupBy(owner).agg((100 * F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("recency"), F.count("*").alias("n"))


def recommendations(matches: DataFrame, owner: str, order: list[str], most: int = 8) -> DataFrame:
    """(owner, place, requirement, urgency, advice): what would raise an alignment, in the order given.

    ADD: a requirement of which no evidence was found, the first ``most`` of an owner, CRITICAL for a core must, HIGH for a
    must, else MEDIUM; formal ones (kind FORMAL, where there is such a column) have their own score.  MEASURE: one of
    which nothing can be said, all of them, HIGH for a core must, else MEDIUM.  Places count from 1 by advice.
    """
    formal = F.coalesce(F.col("kind") == "FORMAL", F.lit(False)) if "kind" in matches.columns else F.lit(False)
    advice = F.when((F.col("status") == "NOT_FOUND") & ~formal, "ADD").when(F.col("status") == "UNKNOWN", "MEASURE")
    core = F.col("priority") == "CORE_MUST"
    urgency = F.when(advice == "ADD", F.when(core, "CRITICAL").when(F.col("priority") == "MUST", "HIGH").otherwise("MEDIUM")).otherwise(F.when(core, "HIGH").otherwise("MEDIUM"))
    rows = matches.withColumns({"advice": advice, "urgency": urgency}).where("advice IS NOT NULL")
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy(owner, "advice").orderBy(*order)))
    return placed.where((F.col("advice") == "MEASURE") | (F.col("place") <= most)).select(owner, "place", "requirement", "urgency", "advice")
