"""Intervals: union length, gaps, overlaps, chronology.

An owner's intervals are sorted in a window over the owner; owners that hold a large share of all rows are first
reduced by ``compact``, which merges within time buckets so that the window has at most one row a bucket and owner.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def compact(df: DataFrame, by: list[str], start: str, end: str, width: int) -> DataFrame:
    """(by, start, end): of intervals that start in the same bucket of ``width``, those that touch are merged where their extent has no hole.

    Exact: only repeated and nested intervals go; those that start at one point are one, the longest.  Combined before
    the shuffle.
    """
    longest = df.groupBy(*by, start).agg(F.max(end).alias(end))
    w = Window.partitionBy(*by, F.floor(F.col(start) / width)).orderBy(start).rowsBetween(Window.unboundedPreceding, -1)
    return longest.withColumn("__upto", F.max(end).over(w)).where(F.col("__upto").isNull() | (F.col(end) > F.col("__upto"))).drop("__upto")


def islands(df: DataFrame, by: list[str], start: str, end: str, adjacent: float = 0) -> DataFrame:
    """(by, start, end, n): unions of intervals that overlap or begin at most ``adjacent`` after what lies before them ends.

    Rows with a null end or start, or that end before they start, are left out.
    """
    w = Window.partitionBy(*by).orderBy(start, end)
    rows = df.where(F.col(start) <= F.col(end))
    rows = rows.withColumn("__upto", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    opens = F.when(F.col("__upto").isNull() | (F.col(start) > F.col("__upto") + adjacent), 1).otherwise(0)
    rows = rows.withColumn("__island", F.sum(opens).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy(*by, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("__island")


def union_length(df: DataFrame, by: list[str], start: str, end: str, *, inclusive: bool = False, adjacent: float = 0) -> DataFrame:
    """(by, length, n_islands); inclusive: an interval's end counts whole, as months do."""
    one = 1 if inclusive else 0
    return islands(df, by, start, end, adjacent).groupBy(*by).agg(F.sum(F.col(end) - F.col(start) + one).alias("length"), F.count("*").alias("n_islands"))


def gaps(df: DataFrame, by: list[str], start: str, end: str, holder: str, least: float) -> DataFrame:
    """(by, after, before, gap): holes of ``least`` or more between the largest end so far and the next start.

    after: who holds that end, the smallest of equals; before: who begins next.
    """
    w = Window.partitionBy(*by).orderBy(start, end, holder)
    so_far = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = df.where(F.col(start) <= F.col(end)).withColumn("__last", F.max(F.struct(F.col(end).alias("e"), (-F.col(holder)).alias("h"))).over(so_far))
    gap = F.greatest(F.lit(0), F.col(start) - F.col("__last.e") - 1)
    return rows.where(F.col("__last").isNotNull()).select(*by, (-F.col("__last.h")).alias("after"), F.col(holder).alias("before"), gap.alias("gap")).where(F.col("gap") >= least)


def overlaps(df: DataFrame, by: list[str], start: str, end: str, ident: str, width: float | None = None) -> DataFrame:
    """(by, a, b, shared): pairs of one owner's intervals that share a point, a < b.

    Hash-joined by owner and bucket of time, so an owner's intervals only meet those nearby; a pair counts in the first
    bucket that both lie in.  width: of a bucket, by default twice the mean length, which makes at most three rows of
    two intervals, however their lengths differ.
    """
    rows = df.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end))).select(*by, F.col(start).alias("s"), F.col(end).alias("e"), F.col(ident).alias("i"))
    if width is None:
        width = max(1.0, 2 * float(rows.agg(F.avg(F.col("e") - F.col("s"))).first()[0] or 0))
    bucket = lambda c: F.floor(F.col(c) / width).cast("long")
    cut = rows.withColumn("__k", F.explode(F.sequence(bucket("s"), bucket("e"))))
    x, y = cut.select(*by, "__k", F.col("s").alias("s1"), F.col("e").alias("e1"), F.col("i").alias("a")), cut.select(*by, "__k", F.col("s").alias("s2"), F.col("e").alias("e2"), F.col("i").alias("b"))
    pairs = x.join(y, [*by, "__k"]).where("a < b AND s1 <= e2 AND s2 <= e1").where(F.col("__k") == F.greatest(bucket("s1"), bucket("s2")))
    return pairs.select(*by, "a", "b", (F.least("e1", "e2") - F.greatest("s1", "s2")).alias("shared"))


def deepest_overlap(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """(by, depth): how many intervals share a point at most; a sweep over ends, so no pairs are formed."""
    marks = df.where(F.col(start) <= F.col(end)).select(*by, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(0).alias("o"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(1).alias("o"), F.lit(-1).alias("d")))).alias("m"))
    marks = marks.groupBy(*by, "m.at", "m.o").agg(F.sum("m.d").alias("d"))
    w = Window.partitionBy(*by).orderBy("at", "o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marks.withColumn("depth", F.sum("d").over(w)).groupBy(*by).agg(F.max("depth").alias("depth"))


def latest_unique(df: DataFrame, by: list[str], earliest: str, latest: str, ident: str) -> DataFrame:
    """(by, latest_id): the one row that surely comes last although dates are ranges; null where another might.

    earliest, latest: the bounds of a row's date.
    """
    top = df.groupBy(*by).agg(F.max(F.struct(F.col(earliest).alias("e"), F.col(ident).alias("i"))).alias("t"))
    rivals = df.join(top, by).where((F.col(ident) != F.col("t.i")) & (F.col(latest) >= F.col("t.e"))).select(*by).distinct().withColumn("__rival", F.lit(True))
    return top.join(rivals, by, "left").select(*by, F.when(F.col("__rival").isNull(), F.col("t.i")).alias("latest_id"))


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """The left columns, then the values of the last right row of the same key at or before left_time; null where there is none.

    One union and one window: no range join.  Of right rows at one time the largest by values counts.
    """
    carried = F.struct(*[F.col(v) for v in values])
    r = right.select(*by, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), carried.alias("__v"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("__row"))
    l = left.select(*by, F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(right.select(carried).schema[0].dataType).alias("__v"), F.struct(*left.columns).alias("__row"))  # noqa: E741
    w = Window.partitionBy(*by).orderBy("__t", "__side", "__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = r.unionByName(l).withColumn("__last", F.last("__v", ignorenulls=True).over(w)).where("__side = 1")
    return both.select("__row.*", *[F.col(f"__last.{v}").alias(v) for v in values])
