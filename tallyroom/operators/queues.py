"""A bounded queue between events and a sender: caps, throttles, evictions, batches and retries, as a fold by key.

The rules are a small state machine; the batch operator folds it over partitions dealt by key and sorted by time, the
streaming one (``streaming.processors``) keeps the same state between micro-batches.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

FATES = ["sent", "evicted", "throttled", "capped"]


@dataclass(frozen=True)
class QueueRules:
    """Times in microseconds.  ``cap``: events that a key may queue in all, None for any number."""

    capacity: int = 50
    batch: int = 20
    repeat: int = 60_000_000
    cap: int | None = 25
    every: int = 30_000_000


@dataclass
class Queue:
    """One key's state.  ``last``: by fingerprint, when an event was last accepted; entries older than ``repeat`` are let go."""

    rules: QueueRules
    waiting: deque = field(default_factory=deque)
    last: dict = field(default_factory=dict)
    accepted: int = 0
    batches: int = 0
    due: int | None = None

    def event(self, t: int, ident: int, fingerprint: str | None, up: Callable[[int], bool]) -> Iterator[tuple]:
        """(ident, fate, batch, place, at) of what the event settles; flushes that were due come before it.

        The cap is asked first.  Then a full queue lets its oldest event go, and only then the throttle is asked: a
        throttled event may push one out.
        """
        yield from self.flushes(t, up)
        rules = self.rules
        if rules.cap is not None and self.accepted >= rules.cap:
            yield ident, "capped", None, None, t
            return
        if len(self.waiting) >= rules.capacity:
            yield self.waiting.popleft(), "evicted", None, None, t
        if fingerprint in self.last and t - self.last[fingerprint] < rules.repeat:
            yield ident, "throttled", None, None, t
        else:
            # an older entry of the fingerprint can't throttle any more: it makes way
            self.last.pop(fingerprint, None)
            self.last[fingerprint] = t
            self.forget(t)
            self.accepted += 1
            self.waiting.append(ident)
        if self.waiting and self.due is None:
            self.due = (t // rules.every + 1) * rules.every

    def forget(self, t: int) -> None:
        """Entries come in the order of time, so the old ones are the first."""
        while self.last and t - next(iter(self.last.values())) >= self.rules.repeat:
            self.last.pop(next(iter(self.last)))

    def flushes(self, t: int, up: Callable[[int], bool]) -> Iterator[tuple]:
        """What is sent until ``t``: batches of the oldest events at each due time; while the sender is down all stays in order."""
        while self.due is not None and self.due <= t:
            at = self.due
            self.due += self.rules.every
            while self.waiting and up(at):
                self.batches += 1
                for place in range(min(self.rules.batch, len(self.waiting))):
                    yield self.waiting.popleft(), "sent", self.batches, place, at
            if not self.waiting:
                self.due = None


def always(at: int) -> bool:
    return True


def queue_fates(df: DataFrame, key: str, time: str, ident: str, fingerprint: str, rules: QueueRules = QueueRules(), up: Callable[[int], bool] = always, until: int | None = None) -> DataFrame:  # noqa: B008
    """(key, ident, fate, batch, place, at): what becomes of each event; time in microseconds.

    An event is sent, in a numbered batch of its key and a place there; or evicted, throttled, or capped, at the time of
    the event that did it.  Flushes come at multiples of ``every`` while anything waits; ``up(at)`` tells whether the
    sender takes a batch.  Flushes go on until ``until``, or for a day after a key's last event; what still waits then
    has no row.  Events of one time come by ident.  Null keys are a key, events without a time are left out.

    A key's events are read in order and only what waits is held.
    """
    day = 86_400_000_000
    dealt = df.where(F.col(time).isNotNull()).select(key, time, ident, fingerprint).repartition(key).sortWithinPartitions(key, time, ident)
    kinds = [df.schema[key].dataType, df.schema[ident].dataType, T.StringType(), T.LongType(), T.LongType(), T.LongType()]
    schema = T.StructType([T.StructField(n, k) for n, k in zip([key, ident, "fate", "batch", "place", "at"], kinds, strict=True)])

    def table(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[] for _ in kinds]
        return pa.RecordBatch.from_arrays([pa.array(v, to_arrow_type(k)) for v, k in zip(columns, kinds, strict=True)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, queue, last = None, None, 0
        for batch in batches:
            out: list = []
            for k, t, i, f in zip(*[batch.column(n).to_pylist() for n in range(4)], strict=True):
                if queue is None or k != held:
                    if queue is not None:
                        out += [(held, *x) for x in queue.flushes(until if until is not None else last + day, up)]
                    held, queue = k, Queue(rules)
                out += [(k, *x) for x in queue.event(t, i, f, up)]
                last = t
            yield table(out)
        if queue is not None:
            yield table([(held, *x) for x in queue.flushes(until if until is not None else last + day, up)])

    return dealt.mapInArrow(run, schema)
