"""Event logs: anonymous counts, rollups, quotas, costs, milestones, lifecycles, calendars.

Ordered rules whose state depends on what was accepted before (limiters, throttles) run over partitions dealt by key
and sorted by time, one batch after the other: a key's events are never gathered in one group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def k_anonymous(df: DataFrame, token: Column, contributor: str, k: int = 5) -> DataFrame:
    """(token, contributors, n): tokens of at least ``k`` different contributors, counted exactly; nulls are no contributors.

    Two levels of groups, so a token that everyone has is spread over its contributors first.
    """
    pairs = df.where(F.col(contributor).isNotNull()).groupBy(token.alias("token"), contributor).agg(F.count("*").alias("c"))
    return pairs.where("token IS NOT NULL").groupBy("token").agg(F.count("*").alias("contributors"), F.sum("c").alias("n")).where(F.col("contributors") >= k)


def error_groups(df: DataFrame, fingerprint: Column, time: Column, payload: Column) -> DataFrame:
    """(fingerprint, occurrences, first_seen, last_seen, last_payload): the latest payload counts, of equal times the largest."""
    rows = df.select(fingerprint.alias("fingerprint"), time.alias("t"), payload.alias("p"))
    return rows.groupBy("fingerprint").agg(F.count("*").alias("occurrences"), F.min("t").alias("first_seen"), F.max("t").alias("last_seen"), F.max(F.struct("t", "p")).alias("l")).select("fingerprint", "occurrences", "first_seen", "last_seen", F.col("l.p").alias("last_payload"))


def lifecycle(groups: DataFrame, statuses: DataFrame, now: Column, resolved_days: float, stale_days: float, unit: float) -> DataFrame:
    """The groups' columns, then status and expired: a resolved group that recurs is open again.

    statuses: (fingerprint, status, since).  Expired: resolved for ``resolved_days``, or open and unseen for ``stale_days``.
    """
    out = groups.join(statuses, "fingerprint", "left")
    status = F.when((F.col("status") == "resolved") & (F.col("last_seen") > F.col("since")), "open").otherwise(F.coalesce("status", F.lit("open")))
    out = out.withColumn("status", status)
    old = lambda t, days: now - t >= days * unit
    return out.withColumn("expired", F.when(F.col("status") == "resolved", old(F.col("since"), resolved_days)).otherwise(old(F.col("last_seen"), stale_days))).drop("since")


def quota_use(df: DataFrame, by: list[str], period: Column, order: list[str], limit: int) -> DataFrame:
    """(by, period, used, accepted, denied): of a key's events in a period the first ``limit`` are accepted.

    How many are accepted needs no order; ``quota_verdicts`` tells which.
    """
    out = df.groupBy(*by, period.alias("period")).agg(F.count("*").alias("used"))
    return out.withColumns({"accepted": F.least(F.col("used"), F.lit(limit).cast("long")), "denied": F.greatest(F.lit(0).cast("long"), F.col("used") - limit)})


def quota_verdicts(df: DataFrame, by: list[str], period: Column, order: list[str], limit: int) -> DataFrame:
    """The columns, then accepted."""
    return df.withColumn("accepted", F.row_number().over(Window.partitionBy(*by, period).orderBy(*order)) <= limit)


def priced(df: DataFrame, prices: DataFrame, model: str, units_in: Column, units_out: Column) -> DataFrame:
    """The columns, then cost: units by price a million; an unknown model has a null cost, not 0.  prices: (model, price_in, price_out), a small table."""
    out = df.join(prices.withColumnRenamed("model", "__m"), df[model] == F.col("__m"), "left")
    return out.withColumn("cost", (units_in * F.col("price_in") + units_out * F.col("price_out")) / 1e6).drop("__m", "price_in", "price_out")


def stage_share(df: DataFrame, by: list[str], submitted: Column, advanced: Column) -> DataFrame:
    """(by, n_submitted, n_advanced, share); nothing submitted: null."""
    out = df.groupBy(*by).agg(F.count_if(submitted).alias("n_submitted"), F.count_if(submitted & advanced).alias("n_advanced"))
    return out.withColumn("share", F.col("n_advanced") / F.nullif(F.col("n_submitted"), F.lit(0)))


def counts_with_total(df: DataFrame, column: str, total: str = "ALL") -> DataFrame:
    """(column, n) by value, and the total; the values are counted once."""
    out = df.groupingSets([[F.col(column)], []], column).agg(F.count("*").alias("n"), F.grouping(column).alias("g"))
    return out.select(F.when(F.col("g") == 1, total).otherwise(F.col(column)).alias(column), "n")


def milestones(df: DataFrame, by: str, time: Column, conditions: dict[str, Column]) -> DataFrame:
    """(by, a time for each condition, level): when each first held; level counts those that ever did."""
    out = df.groupBy(by).agg(*[F.min(F.when(c, time)).alias(n) for n, c in conditions.items()])
    return out.withColumn("level", sum(F.col(n).isNotNull().cast("int") for n in conditions))


def latest(df: DataFrame, by: list[str], order: Column, columns: list[str]) -> DataFrame:
    """(by, columns) of the last row of each key: consent logs, upserts, settings."""
    return df.groupBy(*by).agg(F.max_by(F.struct(*columns), order).alias("l")).select(*by, *[F.col(f"l.{c}").alias(c) for c in columns])


def erase(facts: DataFrame, people: DataFrame, key: str, keep: bool) -> DataFrame:
    """Facts without the people: their rows go, or stay for accounting with a null key."""
    if not keep:
        return facts.join(people.select(key), key, "left_anti")
    gone = people.select(F.col(key).alias("__k"), F.lit(True).alias("__gone")).distinct()
    out = facts.join(gone, facts[key] == F.col("__k"), "left")
    return out.withColumn(key, F.when(F.col("__gone").isNull(), F.col(key))).select(*facts.columns)


def idle_sessions(df: DataFrame, by: list[str], time: str, ident: str, gap: float) -> DataFrame:
    """(by, session, first, last, n, last_id): runs of events less than ``gap`` apart; of each run the last event is what is flushed."""
    w = Window.partitionBy(*by).orderBy(time, ident)
    rows = df.withColumn("__new", F.when(F.col(time) - F.lag(time).over(w) < gap, 0).otherwise(1))
    rows = rows.withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy(*by, "session").agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("n"), F.max(F.struct(time, ident)).alias("l")).select(*by, "session", "first", "last", "n", F.col(f"l.{ident}").alias("last_id"))


def ordered_fold(df: DataFrame, by: str | list[str], order: list[str], time: str, rule: Callable, out: str, parts: int | None = None, also: tuple[str, ...] = (), kind: T.DataType = T.BooleanType()) -> DataFrame:  # noqa: B008
    """The columns, then ``out``: what ``rule(state, time, *also)`` says of each event, in order; state is a key's own dict.

    Rows are dealt by key and sorted; each task holds one batch and one key's state at a time, so a key's events may be
    any share of all.  Null keys are a key; null times come first as 0.
    """
    keys = [by] if isinstance(by, str) else by
    dealt = (df.repartition(parts, *keys) if parts else df.repartition(*keys)).sortWithinPartitions(*keys, *order)
    schema = T.StructType([*df.schema.fields, T.StructField(out, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = object(), {}
        for batch in batches:
            column = lambda c, batch=batch: batch.column(batch.schema.names.index(c)).to_pylist()
            said = []
            for k, t, *rest in zip(zip(*map(column, keys), strict=True), column(time), *map(column, also), strict=True):
                if k != key:
                    key, state = k, {}
                said.append(rule(state, t or 0, *rest))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, to_arrow_type(kind))], names=[*batch.schema.names, out])

    return dealt.mapInArrow(run, schema)


def fixed_window_rule(length: int, most: int) -> Callable[[dict, int], bool]:
    """A window opens at a key's first request and is replaced only by one after its end; the first ``most`` in it are allowed."""

    def rule(state: dict, t: int) -> bool:
        if not state or t > state["end"]:
            state.update(end=t + length, n=0)
        state["n"] += 1
        return state["n"] <= most

    return rule


def throttle_rule(least: int, most: int | None = None) -> Callable[[dict, int], bool]:
    """An event is accepted ``least`` or more after the last accepted one, and no more than ``most`` are in all."""

    def rule(state: dict, t: int) -> bool:
        if state and (t - state["last"] < least or (most is not None and state["n"] >= most)):
            return False
        state.update(last=t, n=state.get("n", 0) + 1)
        return True

    return rule
