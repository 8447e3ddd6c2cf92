"""Keyed rules over streams: limiters and throttles with state, idle sessions, idempotent events, rollups by upsert.

Batch and stream agree on data without late rows: within a batch a key's events are taken in the order of time, and an
event older than the watermark is passed over.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroom.operators.events import fixed_window_rule, throttle_rule
from tallyroom.operators.tables import saved
from tallyroom.streaming.processors import LATE, PROVIDER, ROCKSDB, by_rule


def rate_limited(stream: DataFrame, key: str, time: str, ident: str, seconds: float, most: int, late: str = LATE) -> DataFrame:
    """A key's window opens at its first event and is replaced only after its end; the first ``most`` in it are accepted.

    A window's state goes when the watermark has passed its end: the next event opens another one anyway.
    """
    return by_rule(stream, key, time, ident, ["end", "n"], fixed_window_rule(int(seconds * 1e6), most), lambda held: held["end"], late)


def throttled(stream: DataFrame, key: str, time: str, ident: str, seconds: float, late: str = LATE, most: int | None = None, idle: float | None = None) -> DataFrame:
    """Accepts an event ``seconds`` or more after the last accepted one of its key, and no more than ``most`` in all.

    Without ``most`` a key's state goes ``seconds`` after its last accepted event.  With it the state is what remembers
    the count: it goes ``idle`` seconds (a day by default) after that event, and the key may begin anew.
    """
    gap = int(seconds * 1e6)
    keep = gap if most is None else max(gap, int((idle if idle is not None else 86_400) * 1e6))
    return by_rule(stream, key, time, ident, ["last", "n"], throttle_rule(gap, most), lambda held: held["last"] + keep, late)


def flushed(stream: DataFrame, key: str, time: str, value: str, idle: str, late: str = LATE) -> DataFrame:
    """(key, first, last, n, value): runs of events less than ``idle`` apart, with the last event's value; emitted once the watermark has passed."""
    runs = stream.withWatermark(time, late).groupBy(key, F.session_window(time, idle).alias("w"))
    return runs.agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("n"), F.max_by(value, time).alias(value)).drop("w")


def once(stream: DataFrame, ident: str, time: str, late: str = LATE) -> DataFrame:
    """Each event id once within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([ident])


def rollup_into(path: str, fingerprint: str, time: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps a table of (fingerprint, occurrences, first_seen, last_seen, batch) at ``path``.

    Each batch is one folder of partial counts named by its number, written over on a retry, so a batch counts once;
    ``rolled_up`` sums them.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        part = batch.groupBy(fingerprint).agg(F.count("*").alias("occurrences"), F.min(time).alias("first_seen"), F.max(time).alias("last_seen"))
        part.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return upsert


def rolled_up(parts: DataFrame, fingerprint: str) -> DataFrame:
    return parts.groupBy(fingerprint).agg(F.sum("occurrences").alias("occurrences"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def run_once(stream: DataFrame, checkpoint: str) -> DataFrame:
    """What a stream holds now: one run to its end, written as a table and read back.

    The state store is the one by RocksDB; the session's own setting is put back once the stream has started.
    """
    spark, folder = stream.sparkSession, f"{checkpoint}/out"
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        run = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", f"{checkpoint}/state").outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before) if before is not None else spark.conf.unset(PROVIDER)
    run.awaitTermination()
    return saved(spark.read.schema(stream.schema).parquet(folder))
