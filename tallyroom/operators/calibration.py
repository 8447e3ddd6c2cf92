"""Calibration and release gates: drift, confusion, ranking accuracy, interval coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drift(before: DataFrame, after: DataFrame, case: str, score: str, within: float = 1e-9) -> DataFrame:
    """One row: n, n_changed, median, p95 and largest change (nearest rank), n_lost, n_new; joined by case."""
    both = before.select(F.col(case).alias("c"), F.col(score).alias("b"), F.lit(1).alias("in_b")).join(after.select(F.col(case).alias("c"), F.col(score).alias("a"), F.lit(1).alias("in_a")), "c", "full")
    d = F.when(F.col("in_b").isNotNull() & F.col("in_a").isNotNull(), F.abs(F.coalesce(F.col("a"), F.lit(0.0)) - F.coalesce(F.col("b"), F.lit(0.0))))
    rows = both.select(d.alias("d"), "in_a", "in_b")
    return rows.agg(
        F.count("d").alias("n"), F.count_if(F.col("d") > within).alias("n_changed"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY d)").alias("median"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY d)").alias("p95"), F.max("d").alias("largest"),
        F.count_if(F.col("in_a").isNull()).alias("n_lost"), F.count_if(F.col("in_b").isNull()).alias("n_new"),
    )


def cap_changes(before: DataFrame, after: DataFrame, case: str, caps: str) -> DataFrame:
    """(case, code, change): caps, arrays of codes, that are NEW or REMOVED."""
    both = before.select(case, F.col(caps).alias("b")).join(after.select(case, F.col(caps).alias("a")), case)
    mark = lambda x, y, kind: F.transform(F.array_except(x, y), lambda c: F.struct(c.alias("code"), F.lit(kind).alias("change")))
    return both.select(case, F.explode(F.concat(mark(F.col("a"), F.col("b"), "NEW"), mark(F.col("b"), F.col("a"), "REMOVED"))).alias("x")).select(case, "x.*")


def gate(metrics: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """(metric, value, bound): the limits that one row of metrics breaks; a null metric breaks its own.

    limits: metric to ("max" or "min", bound).
    """
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(float(b)).alias("bound"), F.coalesce((F.col(m) > b) if way == "max" else (F.col(m) < b), F.lit(True)).alias("broken")) for m, (way, b) in limits.items()])
    return metrics.select(F.explode(rows).alias("x")).where("x.broken").select("x.metric", "x.value", "x.bound")


def annotations(expected: DataFrame, predicted: DataFrame, on: list[str]) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1 of two sets of annotations."""
    e, p = expected.select(*on).distinct().withColumn("e", F.lit(1)), predicted.select(*on).distinct().withColumn("p", F.lit(1))
    n = e.join(p, on, "full").agg(F.count_if(F.col("e").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count_if(F.col("e").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    n = n.withColumns({"precision": safe(F.col("tp"), F.col("tp") + F.col("fp")), "recall": safe(F.col("tp"), F.col("tp") + F.col("fn"))})
    return n.withColumn("f1", safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def confusion(expected: DataFrame, predicted: DataFrame, case: str, label: str) -> DataFrame:
    """(expected, predicted, n); a case that one side lacks is MISSING there."""
    both = expected.select(case, F.col(label).alias("e")).join(predicted.select(case, F.col(label).alias("p")), case, "full")
    return both.groupBy(F.coalesce("e", F.lit("MISSING")).alias("expected"), F.coalesce("p", F.lit("MISSING")).alias("predicted")).agg(F.count("*").alias("n"))


def pairwise(relations: DataFrame, scores: DataFrame, case: str, score: str) -> DataFrame:
    """One row: n, n_correct, n_tie, n_inverted, accuracy of (better, worse) pairs; pairs without both scores don't count."""
    s = scores.select(F.col(case).alias("id"), F.col(score).alias("s")).where("s IS NOT NULL")
    pairs = relations.join(s.select(F.col("id").alias("better"), F.col("s").alias("sb")), "better").join(s.select(F.col("id").alias("worse"), F.col("s").alias("sw")), "worse")
    out = pairs.agg(F.count("*").alias("n"), F.count_if(F.col("sb") > F.col("sw")).alias("n_correct"), F.count_if(F.col("sb") == F.col("sw")).alias("n_tie"), F.count_if(F.col("sb") < F.col("sw")).alias("n_inverted"))
    return out.withColumn("accuracy", F.when(F.col("n") > 0, F.col("n_correct") / F.col("n")))


def interval_coverage(df: DataFrame, low: Column, high: Column, truth: Column) -> DataFrame:
    """One row: n, n_inside, covered, mean_width."""
    rows = df.select(low.alias("l"), high.alias("h"), truth.alias("t")).where("l IS NOT NULL AND h IS NOT NULL AND t IS NOT NULL")
    out = rows.agg(F.count("*").alias("n"), F.count_if((F.col("t") >= F.col("l")) & (F.col("t") <= F.col("h"))).alias("n_inside"), F.avg(F.col("h") - F.col("l")).alias("mean_width"))
    return out.withColumn("covered", F.when(F.col("n") > 0, F.col("n_inside") / F.col("n")))


def knockout_rates(df: DataFrame, expected: Column, predicted: Column) -> DataFrame:
    """One row: n, n_false, n_missed, false_rate, missed_rate of boolean knockouts."""
    out = df.select(expected.alias("e"), predicted.alias("p")).agg(F.count("*").alias("n"), F.count_if(~F.col("e") & F.col("p")).alias("n_false"), F.count_if(F.col("e") & ~F.col("p")).alias("n_missed"), F.count_if("e").alias("ne"))
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return out.select("n", "n_false", "n_missed", rate(F.col("n_false"), F.col("n") - F.col("ne")).alias("false_rate"), rate(F.col("n_missed"), F.col("ne")).alias("missed_rate"))
