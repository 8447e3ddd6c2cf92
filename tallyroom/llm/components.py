"""Connected components of an edge table, by rounds of DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroom.llm.common import discard, written

#: Nodes that may be hubs at a time: a hub has over 1 / HUBS of all edges' ends, so there are no more.
HUBS = 10_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of the edges reaches.

    Alternates two steps until nothing changes: every node's larger neighbours are tied to the smallest node around it
    (so are, in the second step, its smaller neighbours), which halves depths, so rounds grow with the logarithm of the
    longest path.  Each step is written to the shared folder, and the step before is deleted.  Every step is a minimum by key, combined before the
    shuffle, and a join.  The minima of hubs are sent to the edges where they lie, so a node with a third of the edges
    is in no single task.  Nulls are ignored.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    pairs = written(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        # ends: two an edge, and at most one more a node in the second step
        degree = max(64, 4 * pairs.count() // HUBS)
        large = _tied(pairs.union(pairs.select("v", "u")), degree, larger=True)
        small = _tied(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), degree, larger=False)
        discard(pairs, large)
        # a forest of stars: no node is both a centre and a member, none has two centres
        centres = small.select(F.col("v").alias("u")).distinct()
        if small.join(centres, "u", "left_semi").isEmpty() and small.groupBy("u").count().where("count > 1").isEmpty():
            break
        pairs = small
    return small.select(F.col("u").alias("node"), F.col("v").alias("component")).union(small.select(F.col("v"), F.col("v")).distinct())


def with_key_values(rows: DataFrame, values: DataFrame, key: str, degree: int) -> DataFrame:
    """The rows joined to a written table of values (key, n, ...), one a key; n: how many rows a key has.

    Values of keys with more than ``degree`` rows are sent to the rows where they lie, so no task gathers a hot key; the
    caller names a degree that few keys can pass.
    """
    hot = values.where(F.col("n") > degree).drop("n")
    if hot.isEmpty():
        return rows.join(values.drop("n"), key)
    hot = F.broadcast(hot)
    rest = rows.join(hot.select(key), key, "left_anti").join(values.where(F.col("n") <= degree).drop("n"), key)
    return rows.join(hot, key).unionByName(rest)


def _tied(directed: DataFrame, degree: int, larger: bool) -> DataFrame:
    """For each u with neighbours v: ties its larger (else its smaller) neighbours and itself to the smallest of all."""
    least = written(directed.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("m", "u").alias("m"), "n"))
    tied = with_key_values(directed, least, "u", degree)
    if larger:
        tied = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        tied = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    out = written(tied.where("u <> v").distinct())
    discard(least)
    return out
