"""Stateful processors whose state ends: rules by key, bounded queues, life cycles of groups.

Each keeps typed state in the state store, which must be the one by RocksDB when the stream starts (``keyed.run_once``
sees to it, others set ``PROVIDER`` to ``ROCKSDB``), and registers an event-time timer for the
moment from which its state can't decide anything any more; then the watermark drops it.  Rows older than the watermark
are passed over.  Of a micro-batch a task holds the times and ids of one key's rows, to bring them into order.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tallyroom.operators.queues import Queue, QueueRules, always

LATE = "10 minutes"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state(stream: DataFrame, key: str, time: str, late: str, processor: StatefulProcessor, out: T.StructType) -> DataFrame:
    if not dict(stream.dtypes)[time].startswith("timestamp"):
        raise ValueError(f"{time} is no timestamp")
    return stream.withWatermark(time, late).groupBy(key).transformWithStateInPandas(processor, out, "append", "eventTime")


def micros(times: pd.Series) -> pd.Series:
    return times.astype("datetime64[us]").astype("int64")


def in_order(rows: Iterator[pd.DataFrame], time: str, ident: str, also: list[str]) -> pd.DataFrame:
    """One key's rows of a micro-batch by time, then id; the columns that the rule reads, and ``micros``."""
    whole = pd.concat([b[[time, ident, *also]] for b in rows])
    whole["micros"] = micros(whole[time])
    return whole.sort_values(["micros", ident], kind="stable")


class Timed(StatefulProcessor):
    """Keeps one timer a key, at the end of its state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def wake(self, at: int | None) -> None:
        """One timer, in microseconds; none for None."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if at is not None:
            self.handle.registerTimer(-(-at // 1000))


class RuleProcessor(Timed):
    """A rule on a dict of whole numbers; ``end`` tells from when on the dict decides nothing."""

    def __init__(self, key: str, time: str, ident: str, names: list[str], rule: Callable[[dict, int], bool], end: Callable[[dict], int]) -> None:
        self.key, self.time, self.ident, self.names, self.rule, self.end = key, time, ident, names, rule, end

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.held = handle.getValueState("held", ", ".join(f"{n} long" for n in self.names))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = dict(zip(self.names, self.held.get(), strict=True)) if self.held.exists() else {}
        whole = in_order(rows, self.time, self.ident, [])
        whole["accepted"] = [self.rule(state, int(t)) for t in whole["micros"]]
        self.held.update(tuple(state[n] for n in self.names))
        self.wake(self.end(state))
        whole[self.key] = key[0]
        yield whole[[self.key, self.ident, self.time, "accepted"]]

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        yield from ()

    def close(self) -> None:
        pass


def by_rule(stream: DataFrame, key: str, time: str, ident: str, names: list[str], rule: Callable[[dict, int], bool], end: Callable[[dict], int], late: str = LATE) -> DataFrame:
    out = T.StructType([*[T.StructField(c, stream.schema[c].dataType) for c in (key, ident, time)], T.StructField("accepted", T.BooleanType())])
    return with_state(stream.select(key, ident, time), key, time, late, RuleProcessor(key, time, ident, names, rule, end), out)


class QueueProcessor(Timed):
    """A bounded queue by key: a list of what waits, a map of fingerprints' last times, and three numbers."""

    def __init__(self, key: str, time: str, ident: str, fingerprint: str, rules: QueueRules, up: Callable[[int], bool], idle: int) -> None:
        self.key, self.time, self.ident, self.fingerprint, self.rules, self.up, self.idle = key, time, ident, fingerprint, rules, up, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting = handle.getListState("waiting", "ident long")
        self.last = handle.getMapState("last", "fingerprint string", "at long")
        self.numbers = handle.getValueState("numbers", "accepted long, batches long, due long, seen long")

    def _load(self) -> tuple[Queue, int]:
        queue, seen = Queue(self.rules), 0
        if self.numbers.exists():
            queue.accepted, queue.batches, queue.due, seen = self.numbers.get()
        queue.waiting = deque(r[0] for r in self.waiting.get())
        queue.last = dict(sorted(((k[0], v[0]) for k, v in self.last.iterator()), key=lambda x: x[1]))
        return queue, seen

    def _keep(self, queue: Queue, seen: int) -> None:
        self.waiting.clear()
        if queue.waiting:
            self.waiting.put([(i,) for i in queue.waiting])
        queue.forget(seen)
        self.last.clear()
        for f, t in queue.last.items():
            self.last.updateValue((f,), (t,))
        self.numbers.update((queue.accepted, queue.batches, queue.due, seen))
        self.wake(queue.due if queue.due is not None else seen + self.idle)

    def _frame(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[self.ident, "fate", "batch", "place", "at"]).astype({"batch": "Int64", "place": "Int64"})
        out.insert(0, self.key, key[0])
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        queue, seen = self._load()
        made: list[tuple] = []
        whole = in_order(rows, self.time, self.ident, [self.fingerprint])
        for t, i, f in zip(whole["micros"], whole[self.ident], whole[self.fingerprint], strict=True):
            made += queue.event(int(t), int(i), f, self.up)
            seen = max(seen, int(t))
        self._keep(queue, seen)
        yield self._frame(key, made)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        queue, seen = self._load()
        now = timerValues.getCurrentWatermarkInMs() * 1000
        made = list(queue.flushes(now, self.up))
        if queue.due is None and now >= seen + self.idle:
            self.waiting.clear(), self.last.clear(), self.numbers.clear(), self.wake(None)
        else:
            self._keep(queue, seen)
        yield self._frame(key, made)

    def close(self) -> None:
        pass


def queued(stream: DataFrame, key: str, time: str, ident: str, fingerprint: str, rules: QueueRules = QueueRules(), up: Callable[[int], bool] = always, late: str = LATE, idle: int = 86_400_000_000) -> DataFrame:  # noqa: B008
    """(key, ident, fate, batch, place, at) as ``operators.queues.queue_fates`` gives them, as soon as they are settled.

    A key that is idle for ``idle`` microseconds after its last event, and has nothing waiting, is forgotten with its cap
    and its batch numbers.
    """
    longs = [T.StructField(n, T.LongType()) for n in ("batch", "place", "at")]
    out = T.StructType([T.StructField(key, stream.schema[key].dataType), T.StructField(ident, T.LongType()), T.StructField("fate", T.StringType()), *longs])
    return with_state(stream.select(key, ident, time, fingerprint), key, time, late, QueueProcessor(key, time, ident, fingerprint, rules, up, idle), out)


class LifeProcessor(Timed):
    """Groups of errors: open, triaged, resolved; what happens to a group, and when it goes."""

    def __init__(self, key: str, time: str, ident: str, kind: str, resolved: int, stale: int) -> None:
        self.key, self.time, self.ident, self.kind, self.resolved, self.stale = key, time, ident, kind, resolved, stale

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.group = handle.getValueState("group", "status string, occurrences long, first_seen long, last_seen long, since long")

    def _row(self, key: tuple, at: int, event: str, group: tuple) -> tuple:
        return key[0], at, event, *group[:4]

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[self.key, "at", "event", "status", "occurrences", "first_seen", "last_seen"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        group = tuple(self.group.get()) if self.group.exists() else None
        out: list[tuple] = []
        whole = in_order(rows, self.time, self.ident, [self.kind])
        for t, kind in zip(whole["micros"], whole[self.kind], strict=True):
            for event, at, after in life_step(group, int(t), kind, self.resolved, self.stale):
                if event:
                    out.append(self._row(key, at, event, after if after is not None else group))
                group = after
        if group is None:
            self.group.clear(), self.wake(None)
        else:
            self.group.update(group)
            self.wake(life_end(group, self.resolved, self.stale))
        yield self._frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        group = tuple(self.group.get()) if self.group.exists() else None
        if group is None or life_end(group, self.resolved, self.stale) > timerValues.getCurrentWatermarkInMs() * 1000:
            yield self._frame([])
            return
        self.group.clear()
        yield self._frame([self._row(key, life_end(group, self.resolved, self.stale), "removed", group)])

    def close(self) -> None:
        pass


def life_end(group: tuple, resolved: int, stale: int) -> int:
    """When a group goes: so long after it was resolved, else after it was last seen."""
    status, _, _, last, since = group
    return since + resolved if status == "resolved" else last + stale


def life_step(group: tuple | None, t: int, kind: str, resolved: int, stale: int) -> Iterator[tuple[str | None, int, tuple | None]]:
    """(event, time, group after): removed if the group's time was over, then what the row does.

    An occurrence opens a group, and opens a triaged or resolved one again; ``triage`` and ``resolve`` change the status of
    a group that is there.  A row that changes no status has no event.
    """
    if group is not None and life_end(group, resolved, stale) <= t:
        yield "removed", life_end(group, resolved, stale), None
        group = None
    if kind in ("triage", "resolve"):
        status = "triaged" if kind == "triage" else "resolved"
        if group is not None and group[0] != status:
            yield status, t, (status, *group[1:4], t)
        return
    if group is None:
        yield "opened", t, ("open", 1, t, t, t)
        return
    again = group[0] != "open"
    yield "reopened" if again else None, t, ("open", group[1] + 1, group[2], t, t if again else group[4])


def lifecycle(stream: DataFrame, key: str, time: str, ident: str, kind: str, resolved: int, stale: int, late: str = LATE) -> DataFrame:
    """(key, at, event, status, occurrences, first_seen, last_seen): opened, reopened, triaged, resolved and removed groups.

    kind: ``triage``, ``resolve``, anything else is an occurrence.  A group goes ``resolved`` microseconds after it was
    resolved, or ``stale`` after it was last seen unresolved; its state goes with it.
    """
    out = f"{key} {stream.schema[key].dataType.simpleString()}, at long, event string, status string, occurrences long, first_seen long, last_seen long"
    return with_state(stream.select(key, ident, time, kind), key, time, late, LifeProcessor(key, time, ident, kind, resolved, stale), T._parse_datatype_string(out))
