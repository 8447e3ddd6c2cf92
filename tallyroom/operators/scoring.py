"""Explainable scores: null-aware means, caps, ledgers, penalty budgets, confidence.

Null means "no basis" and is left out, with the weights that remain sharing its part; 0 is a measured value.  All of
these are combined before the shuffle, so one entity may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyroom.functions.numbers import band, clamp, round_half_up
from tallyroom.operators.events import ordered_fold

#: Exponents of coverage, provenance, extraction and sample size in a confidence.
CONFIDENCE_WEIGHTS = (0.40, 0.25, 0.20, 0.15)
CONFIDENCE_BANDS = [(0.35, "LOW"), (0.55, "MEDIUM"), (0.80, "HIGH")]
POWERS = (-1.0, -0.5, 0.0, 0.5, 1.0)


def power_mean(value: Column, weight: Column, p: float, shift: float = 1.0) -> Column:
    """Aggregate: weighted power mean of values moved by ``shift``, within 0 to 100; p = 0 is the geometric mean.

    Rows of null or non-finite value or of weight 0 or less are left out; none left: null.
    """
    good = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")) & (weight > 0)
    w, v = F.when(good, weight), F.when(good, value + shift)
    mean = F.exp(F.sum(w * F.ln(v)) / F.sum(w)) if p == 0 else F.pow(F.sum(w * F.pow(v, F.lit(p))) / F.sum(w), F.lit(1.0 / p))
    return clamp(mean - shift, 0.0, 100.0)


def power_means(df: DataFrame, by: list[str], value: str, weight: str, powers: tuple = POWERS) -> DataFrame:
    """One column for each power: mean_m1, mean_m05, mean_0, mean_05, mean_1."""
    name = lambda p: "mean_" + f"{p:g}".replace("-", "m").replace(".", "")
    return df.groupBy(*by).agg(*[power_mean(F.col(value), F.col(weight), p).alias(name(p)) for p in powers])


def renormalised(parts: dict[str, float]) -> Column:
    """Weighted mean of the columns that aren't null; all null: null."""
    total = sum((F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0) for c, w in parts.items()), F.lit(0.0))
    value = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in parts.items()), F.lit(0.0))
    return F.when(total > 0, value / total)


def weighted_geometric(value: Column, weight: Column, eps: float = 0.05) -> Column:
    """Aggregate over 0 to 1: a zero pulls down but does not annihilate."""
    logs = F.sum(weight * F.ln(eps + (1 - eps) * clamp(value))) / F.sum(weight)
    return clamp((F.exp(logs) - eps) / (1 - eps))


def effective_cap(limit: Column, triggered: Column) -> Column:
    """Aggregate: the smallest cap that is triggered; none: null."""
    return F.min(F.when(triggered, clamp(limit, 0.0, 100.0)))


def score_ledger(components: DataFrame, penalties: DataFrame, caps: DataFrame, key: str) -> DataFrame:
    """(key, contribution, penalty, raw, cap, score) from components (key, contribution), penalties (key, applied) and caps (key, cap_limit, triggered).

    raw: contributions less penalties, at least 0; score: raw under the smallest triggered cap.  Rounded to ten digits.
    """
    rounded = lambda c: round_half_up(c, 8)
    c = components.groupBy(key).agg(rounded(F.sum("contribution")).alias("contribution"))
    p = penalties.groupBy(key).agg(rounded(F.sum("applied")).alias("penalty"))
    k = caps.groupBy(key).agg(effective_cap(F.col("cap_limit"), F.col("triggered")).alias("cap"))
    out = c.join(p, key, "left").join(k, key, "left").withColumn("penalty", F.coalesce("penalty", F.lit(0.0)))
    out = out.withColumn("raw", F.greatest(F.lit(0.0), rounded(F.col("contribution") - F.col("penalty"))))
    return out.withColumn("score", F.least(F.col("raw"), F.coalesce("cap", F.lit(100.0)), F.lit(100.0)))


def ledger_violations(ledger: DataFrame, key: str, within: float = 1e-8) -> DataFrame:
    """(key, broken_rule): every equation of a ledger that its row doesn't keep."""
    rules = {
        "RAW": F.abs(F.col("raw") - F.greatest(F.lit(0.0), F.col("contribution") - F.col("penalty"))) > within,
        "CAP": F.col("cap").isNotNull() & (F.col("score") > F.col("cap") + within),
        "RANGE": (F.col("score") < -within) | (F.col("score") > 100 + within),
        "SCORE": F.abs(F.col("score") - F.least(F.col("raw"), F.coalesce("cap", F.lit(100.0)), F.lit(100.0))) > within,
    }
    broken = F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]), lambda x: x.isNotNull())
    return ledger.select(key, F.explode(broken).alias("broken_rule"))


def single_budget(df: DataFrame, by: list[str], order: list[str], requested: str, budget: Column) -> DataFrame:
    """The columns, then applied: what each request gets of its group's budget, in order.

    Requests under 0 or null count as 0.
    """
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    asked = F.greatest(F.lit(0.0), F.coalesce(requested, F.lit(0.0)))
    upto = F.sum(asked).over(w)
    return df.withColumn("applied", F.least(budget, upto) - F.least(budget, upto - asked))


def double_budget(df: DataFrame, by: list[str], order: str, defect: str, requested: str, scope_budget: float, defect_budget: float) -> DataFrame:
    """(by, order, applied) of requests that draw on two budgets at once: the group's, and their defect's within it.

    What one request gets depends on all before it, so each group's rows go by in order; the state is one sum a defect.
    """
    rows = df.select(*by, order, F.col(defect).cast("string").alias("__defect"), F.greatest(F.lit(0.0), F.coalesce(requested, F.lit(0.0))).cast("double").alias("__asked"))

    def rule(state: dict, _: object, name: str | None, asked: float) -> float:
        spent = state.setdefault("spent", {})
        got = min(asked, max(0.0, defect_budget - spent.get(name, 0.0)), max(0.0, scope_budget - state.get("used", 0.0)))
        spent[name] = spent.get(name, 0.0) + got
        state["used"] = state.get("used", 0.0) + got
        return got

    return ordered_fold(rows, by, [order], order, rule, "applied", also=("__defect", "__asked"), kind=T.DoubleType()).select(*by, order, "applied")


def confidence(coverage: Column, provenance: Column, extraction: Column, n_effective: Column, k: float = 5.0, weights: tuple = CONFIDENCE_WEIGHTS) -> Column:
    """Weighted geometric mean of four qualities; the sample's is 1 - exp(-n / k)."""
    parts = [clamp(coverage), clamp(provenance), clamp(extraction), clamp(1 - F.exp(-F.greatest(F.lit(0.0), n_effective) / k))]
    out = F.lit(1.0)
    for part, w in zip(parts, weights, strict=True):
        out = out * F.pow(part, F.lit(w / sum(weights)))
    return clamp(out)


def evidence_confidence(evidence: DataFrame, by: list[str], importance: str, correlation: str, prior: str, extraction: str, expected: Column, k: float = 5.0) -> DataFrame:
    """(by, coverage, provenance, extraction, n_effective, confidence, band) from evidence rows.

    Rows of one correlation key count once, as the most important of them (capped at 1); qualities are means weighted
    by importance.  A null importance is 1, a null prior or extraction 0.
    """
    imp = F.greatest(F.lit(0.0), F.coalesce(importance, F.lit(1.0)))
    rows = evidence.withColumn("__imp", imp)
    # two levels of groups: no distinct over all rows of an entity
    inner = rows.groupBy(*by, correlation).agg(
        F.max(clamp(F.col("__imp"))).alias("top"), F.sum("__imp").alias("w"),
        F.sum(clamp(F.coalesce(prior, F.lit(0.0))) * F.col("__imp")).alias("p"), F.sum(clamp(F.coalesce(extraction, F.lit(0.0))) * F.col("__imp")).alias("e"),
    )
    out = inner.groupBy(*by).agg(F.sum("top").alias("n_effective"), F.sum("w").alias("w"), F.sum("p").alias("p"), F.sum("e").alias("e"))
    out = out.withColumns({"provenance": F.when(F.col("w") > 0, F.col("p") / F.col("w")).otherwise(0.0), "extraction": F.when(F.col("w") > 0, F.col("e") / F.col("w")).otherwise(0.0)})
    most = F.greatest(expected, F.col("w"))
    out = out.withColumn("coverage", F.when(most > 0, F.col("w") / most).otherwise(0.0))
    out = out.withColumn("confidence", confidence(F.col("coverage"), F.col("provenance"), F.col("extraction"), F.col("n_effective"), k))
    return out.withColumn("band", band(F.col("confidence"), CONFIDENCE_BANDS, "INSUFFICIENT")).drop("w", "p", "e")


def domain_consensus(modules: DataFrame, by: list[str], domain: str, p: float = 0.0) -> DataFrame:
    """(by, domain, applicability, score, confidence, n_scored) from module rows (score, confidence, weight, applicability, cap).

    A domain is BLOCKED if one module is, NOT_APPLICABLE if all are, INSUFFICIENT if none has a score, else PARTIAL or
    FULL.  Its score is the power mean of those scored under their smallest cap.
    """
    scored = F.col("score").isNotNull() & (F.col("applicability") == "APPLICABLE")
    out = modules.groupBy(*by, domain).agg(
        F.bool_or(F.col("applicability") == "BLOCKED").alias("blocked"), F.bool_and(F.col("applicability") == "NOT_APPLICABLE").alias("none"),
        F.count_if(scored).alias("n_scored"), F.count_if(F.col("applicability") != "NOT_APPLICABLE").alias("n"),
        power_mean(F.when(scored, F.col("score")), F.col("weight"), p).alias("mean"), F.min("cap").alias("cap"),
        F.exp(F.sum(F.when(scored, F.col("weight") * F.ln(F.greatest(F.col("confidence"), F.lit(1e-9))))) / F.sum(F.when(scored, F.col("weight")))).alias("confidence"),
    )
    state = F.when(F.col("blocked"), "BLOCKED").when(F.col("none"), "NOT_APPLICABLE").when(F.col("n_scored") == 0, "INSUFFICIENT").when(F.col("n_scored") < F.col("n"), "PARTIAL").otherwise("FULL")
    score = F.when(~F.col("blocked"), F.least(F.col("mean"), F.coalesce("cap", F.lit(100.0))))
    return out.select(*by, domain, state.alias("applicability"), score.alias("score"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "n_scored")


def ensemble(df: DataFrame, by: list[str], score: str) -> DataFrame:
    """(by, n, median, mean, low, high): nulls are passed over, the median of an even number is the rounded mean of the middle two."""
    return df.groupBy(*by).agg(F.count(score).alias("n"), round_half_up(F.percentile(F.col(score), F.lit(0.5))).alias("median"), F.avg(score).alias("mean"), F.min(score).alias("low"), F.max(score).alias("high"))


def completeness(df: DataFrame, sections: list[tuple[str, float, Column]]) -> DataFrame:
    """The columns, then complete (0 to 100) and missing: the heaviest section that isn't filled, the first of equals."""
    total = sum(w for _, w, _ in sections)
    filled = sum((F.when(F.coalesce(ok, F.lit(False)), F.lit(w)).otherwise(0.0) for _, w, ok in sections), F.lit(0.0))
    missing = F.lit(None).cast("string")
    for name, _, ok in sorted(sections, key=lambda s: s[1]):  # the last one to be wrapped is looked at first
        missing = F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)).otherwise(missing)
    return df.withColumns({"complete": round_half_up(100 * filled / total), "missing": missing})


#: Weights of the structure score's components, and decays of its layout damages with their weights.
STRUCTURE_WEIGHTS = {"text_layer": 0.20, "reading_order": 0.22, "sections": 0.15, "layout": 0.13, "encoding": 0.12, "headings": 0.07, "fields": 0.07, "lists": 0.04}
LAYOUT = {"overlap": (8.0, 0.35), "clipping": (10.0, 0.30), "z_order": (8.0, 0.20), "nested": (4.0, 0.15)}


#: Parts of components, and the largest deduction and the scale of what is hidden or doubled.
SECTIONS, HEADINGS, LISTS = {"section_f1": 0.65, "boundary_f1": 0.35}, {"heading_separation": 0.65, "heading_levels": 0.35}, {"list_glyphs": 0.40, "list_indent": 0.35, "list_hanging": 0.25}
DEDUCTIONS = {"hidden": (15.0, 0.05), "doubled": (10.0, 0.05)}
SIGNALS = ["source_tokens", "extracted_tokens", "matched_tokens", "comparable_w", "discordant_w", *SECTIONS, *LAYOUT, "damage", "hidden", "doubled", *HEADINGS, "field_parse", *LISTS]


def structure_score(signals: DataFrame, least_order: float = 0.85) -> DataFrame:
    """The columns, then eight components, structure_cap and structure of layout signals.

    Signals are those in SIGNALS, and order_confidence; ratios are 0 to 1; a signal that is null, or has no column, is no
    basis.  A component of which a part lacks is null, and the weights of those that remain share its own (layout takes
    the parts that there are).  Where order_confidence is below ``least_order`` the order is neither a component nor a
    cap; null counts as sure.  What is hidden or doubled is deducted.  No component: a null structure.
    """
    lacking = [c for c in [*SIGNALS, "order_confidence"] if c not in signals.columns]
    rows = signals.withColumns({c: F.lit(None).cast("double") for c in lacking}) if lacking else signals
    recall, precision = F.col("matched_tokens") / F.nullif(F.col("source_tokens"), F.lit(0)), F.col("matched_tokens") / F.nullif(F.col("extracted_tokens"), F.lit(0))
    sure = F.coalesce(F.col("order_confidence") >= least_order, F.lit(True))
    discord = F.when(sure & (F.col("comparable_w") > 0), clamp(F.col("discordant_w") / F.col("comparable_w")))
    parts = lambda weights: sum(w * clamp(F.col(c)) for c, w in weights.items())
    logs, weights = F.lit(0.0), F.lit(0.0)
    for name, (decay, w) in LAYOUT.items():
        logs, weights = logs + F.coalesce(-decay * clamp(F.col(name)) * w, F.lit(0.0)), weights + F.when(F.col(name).isNotNull(), F.lit(w)).otherwise(0.0)
    out = rows.withColumns(
        {
            "text_layer": F.when(recall.isNotNull() & precision.isNotNull(), F.when(recall + precision > 0, 2 * recall * precision / (recall + precision)).otherwise(0.0)),
            "reading_order": F.exp(-F.log(F.lit(2.0)) * discord / 0.12),
            "sections": parts(SECTIONS),
            "layout": F.when(weights > 0, F.exp(logs / weights)),
            "encoding": F.when(F.col("damage").isNotNull(), F.exp(-F.greatest(F.lit(0.0), F.col("damage")) / 0.008)),
            "headings": parts(HEADINGS),
            "fields": clamp(F.col("field_parse")),
            "lists": parts(LISTS),
        }
    )
    caps = [F.when(recall < 0.40, 25.0), F.when(discord > 0.25, 40.0), F.when(F.col("damage") > 0.03, 45.0), F.when(F.col("hidden") > 0.25, 50.0)]
    fine = sum(F.coalesce(most * (1 - F.exp(-F.col(c) / scale)), F.lit(0.0)) for c, (most, scale) in DEDUCTIONS.items())
    raw = F.greatest(F.lit(0.0), 100 * renormalised(STRUCTURE_WEIGHTS) - fine)
    some = F.coalesce(*STRUCTURE_WEIGHTS).isNotNull()
    scored = out.withColumn("structure_cap", F.array_min(F.array(*caps))).withColumn("structure", F.when(some, F.least(raw, F.coalesce("structure_cap", F.lit(100.0)))))
    return scored.drop(*lacking)