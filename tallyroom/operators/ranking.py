"""Ordered choices: top-k in groups, first and best wins, round-robin samples, budgets, first rule that fires."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_in_groups(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The columns, then rank: the first ``k`` of each group."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def capped_selection(df: DataFrame, group: str, order: list[Column], per_group: int, overall: int) -> DataFrame:
    """The columns, then rank: the first ``overall`` rows of which no group gives more than ``per_group``.

    Rows of a null group are under the overall limit alone.  The second cut reads at most ``per_group`` rows a group.
    """
    own = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    some = df.withColumn("__r", F.when(F.col(group).isNull(), 0).otherwise(own)).where(F.col("__r") <= per_group).drop("__r")
    # the sort is a top-k of each task, then of those
    cut = some.orderBy(*order).limit(overall)
    return cut.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def best_by_key(df: DataFrame, key: Column, order: Column, columns: list[str]) -> DataFrame:
    """(key, columns): the row of each key with the smallest order; a maximum by key, so hot keys are combined first.

    Rows with a null or empty key are dropped.
    """
    out = df.groupBy(key.alias("key")).agg(F.min_by(F.struct(*columns), order).alias("__b")).where("key IS NOT NULL AND key <> ''")
    return out.select("key", *[F.col(f"__b.{c}").alias(c) for c in columns])


def first_wins(left: DataFrame, right: DataFrame, key: Column, order: str) -> DataFrame:
    """Rows of both, one for each key: the left table's first, else the right's; rows with an empty key of the right are dropped."""
    columns = left.columns
    both = left.withColumn("__side", F.lit(0)).unionByName(right.select(*columns).withColumn("__side", F.lit(1)))
    out = both.groupBy(key.alias("__key")).agg(F.min_by(F.struct(*columns), F.struct("__side", order)).alias("b")).where("__key IS NOT NULL AND __key <> ''")
    return out.select("b.*")


def round_robin(df: DataFrame, by: list[str], order: list[str], buckets: int, n: int) -> DataFrame:
    """The columns, then pick (from 1): one row of each of ``buckets`` contiguous runs in turn, ``n`` in all for each group.

    A run has ceil(rows / buckets) rows.
    """
    w = Window.partitionBy(*by)
    rows = df.withColumns({"__i": F.row_number().over(w.orderBy(*order)) - 1, "__n": F.count("*").over(w)})
    size = F.ceil(F.col("__n") / buckets)
    rows = rows.withColumns({"__b": F.floor(F.col("__i") / size), "__r": F.col("__i") % size}).where(F.col("__r") < n)
    return rows.withColumn("pick", F.row_number().over(w.orderBy("__r", "__b"))).where(F.col("pick") <= n).drop("__i", "__n", "__b", "__r")


def within_budget(df: DataFrame, by: list[str], order: list[Column], cost: str, budget: float) -> DataFrame:
    """The columns, then spent: rows in order until the first that would pass the budget; later ones don't slip in.

    Costs are not negative, null is 0, so the running sum alone tells.
    """
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("spent", F.sum(F.coalesce(cost, F.lit(0))).over(w)).where(F.col("spent") <= budget)


def first_rule(df: DataFrame, rules: list[tuple[str, Column]], otherwise: str) -> DataFrame:
    """The columns, then action: the name of the first rule whose condition holds; null conditions don't."""
    out = F.lit(otherwise)
    for name, holds in reversed(rules):
        out = F.when(F.coalesce(holds, F.lit(False)), F.lit(name)).otherwise(out)
    return df.withColumn("action", out)


def recency_rank(df: DataFrame, by: list[str], order: list[Column], holds: Column) -> DataFrame:
    """(by, recency): 100 if the newest row has it, 70 if one of the three newest, 40 if an older one, else null."""
    rows = df.withColumn("__i", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    first = rows.groupBy(*by).agg(F.min(F.when(holds, F.col("__i"))).alias("i"))
    return first.select(*by, F.when(F.col("i") == 0, 100).when(F.col("i") <= 2, 70).when(F.col("i").isNotNull(), 40).alias("recency"))


def carry_forward(df: DataFrame, by: list[str], order: str, header: Column, name: str) -> DataFrame:
    """The columns, then ``name``: the last header at or before each row; none yet: null."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(header, ignorenulls=True).over(w))


def strongest(df: DataFrame, by: list[str], order: Column, confidence: str, evidence: str, columns: list[str]) -> DataFrame:
    """(by, columns, confidence, evidence): the strongest row's columns, the largest confidence, the union of the evidence arrays."""
    out = df.groupBy(*by).agg(F.max_by(F.struct(*columns), order).alias("b"), F.max(confidence).alias(confidence), F.array_sort(F.array_distinct(F.flatten(F.collect_set(evidence)))).alias(evidence))
    return out.select(*by, *[F.col(f"b.{c}").alias(c) for c in columns], confidence, evidence)
