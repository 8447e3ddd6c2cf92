"""Streams agree with batches on data without late rows; state goes on after restarts and ends by the watermark."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tallyroom.operators import events, queues
from tallyroom.streaming import keyed, processors

SCHEMA = "event_id long, user_id long, ts timestamp, v double"


def source(spark, folder, parts):
    rows = [(i, i % 3, 60 * i if i % 7 else 60 * i + 30, float(i)) for i in range(90)]
    for n in range(parts):
        some = [r for r in rows if r[0] * parts // 90 == n]
        spark.createDataFrame(some, "event_id long, user_id long, s long, v double").select("event_id", "user_id", F.timestamp_seconds("s").alias("ts"), "v").coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder)), spark.read.schema(SCHEMA).parquet(str(folder))


def test_limiter(spark, tmp_path):
    stream, batch = source(spark, tmp_path / "in", 3)
    got = {r.event_id: r.accepted for r in keyed.run_once(keyed.rate_limited(stream, "user_id", "ts", "event_id", 600, 2), f"file://{tmp_path}/out").collect()}
    folded = events.ordered_fold(batch.select("event_id", "user_id", F.unix_micros("ts").alias("t")), "user_id", ["t", "event_id"], "t", events.fixed_window_rule(600_000_000, 2), "ok")
    assert got == {r.event_id: r.ok for r in folded.collect()}


def test_throttle(spark, tmp_path):
    stream, batch = source(spark, tmp_path / "in", 2)
    got = {r.event_id: r.accepted for r in keyed.run_once(keyed.throttled(stream, "user_id", "ts", "event_id", 500), f"file://{tmp_path}/out").collect()}
    folded = events.ordered_fold(batch.select("event_id", "user_id", F.unix_micros("ts").alias("t")), "user_id", ["t", "event_id"], "t", events.throttle_rule(500_000_000), "ok")
    assert got == {r.event_id: r.ok for r in folded.collect()}


def test_once(spark, tmp_path):
    _, batch = source(spark, tmp_path / "in", 1)
    batch.union(batch).coalesce(1).write.parquet(str(tmp_path / "twice"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "twice"))
    assert keyed.run_once(keyed.once(stream, "event_id", "ts"), f"file://{tmp_path}/out").count() == 90


def test_rollup_counts_a_batch_once(spark, tmp_path):
    _, batch = source(spark, tmp_path / "in", 1)
    put = keyed.rollup_into(f"file://{tmp_path}/roll", "user_id", "ts")
    put(batch, 0), put(batch, 1), put(batch, 1)
    got = keyed.rolled_up(spark.read.parquet(f"file://{tmp_path}/roll"), "user_id").collect()
    assert {r.user_id: r.occurrences for r in got} == {0: 60, 1: 60, 2: 60}


def test_restart_goes_on_from_its_state(spark, tmp_path):
    """A limiter that is stopped between files and started again decides as one run over all."""
    rows = [(i, i % 2, 86_400 + 40 * i) for i in range(60)]
    put = lambda some: spark.createDataFrame(some, "event_id long, user_id long, s long").select("event_id", "user_id", F.timestamp_seconds("s").alias("ts"), F.lit(1.0).alias("v")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put(rows[:30])
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    for restart in (False, True):
        if restart:
            put(rows[30:])
        got = {r.event_id: r.accepted for r in keyed.run_once(keyed.throttled(stream(), "user_id", "ts", "event_id", 200, most=7), f"file://{tmp_path}/out").collect()}
    want, last, n = {}, {}, {}
    for i, u, t in rows:  # by hand
        want[i] = (u not in last) or (t - last[u] >= 200 and n[u] < 7)
        if want[i]:
            last[u], n[u] = t, n.get(u, 0) + 1
    assert got == want


def test_late_rows_are_passed_over(spark, tmp_path):
    for k, seconds in enumerate(([0, 5, 9], [7200], [7300], [3, 8], [20_000])):
        spark.createDataFrame([(10 * k + i, 1, s) for i, s in enumerate(seconds)], "event_id long, user_id long, s long").select("event_id", "user_id", F.timestamp_seconds("s").alias("ts"), F.lit(float(k)).alias("v")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    got = sorted((r.n, r.v) for r in keyed.run_once(keyed.flushed(stream, "user_id", "ts", "v", "60 seconds"), f"file://{tmp_path}/out").collect())
    # a batch passes over what is older than the watermark with which the batch before ended; the last run is still open
    assert got == [(1, 1.0), (1, 2.0), (3, 0.0)]


KINDS = "ident long, owner long, ts timestamp, kind string"


def files(spark, folder, rows, cuts):
    """Rows (ident, owner, seconds, kind) as one file a micro-batch, cut at the seconds."""
    bounds = [float("-inf"), *cuts, float("inf")]
    for low, high in itertools.pairwise(bounds):
        some = [r for r in rows if low <= r[2] < high]
        random.Random(1).shuffle(some)
        spark.createDataFrame(some, "ident long, owner long, s long, kind string").select("ident", "owner", F.timestamp_seconds("s").alias("ts"), "kind").coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(KINDS).option("maxFilesPerTrigger", 1).parquet(str(folder))


def brute_queue(rows, rules, up, until):
    """By hand, second by second of what can happen: lists and no dicts that forget."""
    fates = {}
    for owner in {r[1] for r in rows}:
        queue, taken, last, batches, due = [], 0, {}, 0, None

        def flush(limit):
            nonlocal queue, batches, due
            while due is not None and due <= limit:
                while queue and up(due):
                    batches += 1
                    for place, i in enumerate(queue[: rules.batch]):
                        fates[i] = ("sent", batches, place, due)
                    queue = queue[rules.batch :]
                due = due + rules.every if queue else None

        for i, _, s, kind in sorted((r for r in rows if r[1] == owner), key=lambda r: (r[2], r[0])):
            t = s * 10**6
            flush(t)
            if rules.cap is not None and taken >= rules.cap:
                fates[i] = ("capped", None, None, t)
                continue
            if len(queue) >= rules.capacity:
                fates[queue.pop(0)] = ("evicted", None, None, t)
            if kind in last and t - last[kind] < rules.repeat:
                fates[i] = ("throttled", None, None, t)
            else:
                last[kind] = t
                taken += 1
                queue.append(i)
            if queue and due is None:
                due = (t // rules.every + 1) * rules.every
        flush(until)
    return fates


def queue_rows():
    rng = random.Random(5)
    rows, s = [], 86_400
    for i in range(600):
        s += rng.choice([0, 1, 2, 30])
        # one owner has most of the events
        rows.append((i, rng.choice([1, 1, 1, 1, 2, 3]), s, rng.choice("abcdefgh")))
    return rows, s


RULES = queues.QueueRules(capacity=6, batch=4, repeat=20_000_000, cap=120, every=60_000_000)


def sender(down: bool):
    """One that is down three minutes of seven, or never; a closure, as tasks can't import this module."""
    return (lambda at: (at // 60_000_000) % 7 > 2) if down else queues.always


@pytest.mark.parametrize("down", [False, True])
def test_queue_against_brute_force(spark, down):
    up = sender(down)
    rows, s = queue_rows()
    rows += [(1000 + i, 9, 90_000 + 21 * i, "z") for i in range(150)]  # meets the cap
    until = (s + 10_000) * 10**6
    df = spark.createDataFrame(rows, "ident long, owner long, s long, kind string").withColumn("t", F.col("s") * 1_000_000)
    got = queues.queue_fates(df, "owner", "t", "ident", "kind", RULES, up, until).collect()
    want = brute_queue(rows, RULES, up, until)
    assert {r.ident: (r.fate, r.batch, r.place, r["at"]) for r in got} == want and len(got) == len(want)
    assert {f[0] for f in want.values()} >= {"sent", "throttled", "capped"} | ({"evicted"} if down else set())


def test_queue_stream_equals_batch(spark, tmp_path):
    rows, s = queue_rows()
    rows.append((5000, 77, s + 40_000, "end"))  # moves the watermark past everything else
    third = (s - 86_400) // 3
    stream = files(spark, tmp_path / "in", rows, [86_400 + third, 86_400 + 2 * third, s + 1])
    rules = RULES
    out = processors.queued(stream, "owner", "ts", "ident", "kind", rules, sender(True))
    got = {r.ident: (r.fate, r.batch, r.place, r["at"]) for r in keyed.run_once(out, f"file://{tmp_path}/out").collect()}
    want = brute_queue(rows[:-1], rules, sender(True), (s + 30_000) * 10**6)
    assert {i: f for i, f in got.items() if i != 5000} == want


def test_queue_forgets_old_fingerprints():
    queue = queues.Queue(queues.QueueRules(repeat=10, cap=None, every=5))
    for t in range(0, 1000, 5):
        list(queue.event(t, t, f"f{t}", queues.always))
    assert len(queue.last) <= 2 and len(queue.waiting) <= 2


def brute_life(rows, resolved, stale, until):
    out = []
    for owner in {r[1] for r in rows}:
        group = None  # status, n, first, last, since

        def gone(t):
            nonlocal group
            if group is not None:
                end = group[4] + resolved if group[0] == "resolved" else group[3] + stale
                if end <= t:
                    out.append((owner, end, "removed", group[0], group[1]))
                    group = None

        for _, _, s, kind in sorted((r for r in rows if r[1] == owner), key=lambda r: (r[2], r[0])):
            t = s * 10**6
            gone(t)
            if kind in ("triage", "resolve"):
                new = {"triage": "triaged", "resolve": "resolved"}[kind]
                if group is not None and group[0] != new:
                    group = [new, group[1], group[2], group[3], t]
                    out.append((owner, t, new, new, group[1]))
            elif group is None:
                group = ["open", 1, t, t, t]
                out.append((owner, t, "opened", "open", 1))
            else:
                if group[0] != "open":
                    out.append((owner, t, "reopened", "open", group[1] + 1))
                    group[0], group[4] = "open", t
                group[1], group[3] = group[1] + 1, t
        gone(until)
    return sorted(out)


def test_life_cycle_stream_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, rng.choice([1, 1, 1, 2, 3, 4]), 86_400 + 50 * i, rng.choice(["seen", "seen", "triage", "resolve"])) for i in range(300)]
    rows += [(1000, 5, 90_000, "seen"), (1001, 6, 90_000, "resolve"), (5000, 77, 200_000, "end")]
    resolved, stale = 300 * 10**6, 900 * 10**6
    stream = files(spark, tmp_path / "in", rows, [92_000, 97_000, 150_000])
    got = keyed.run_once(processors.lifecycle(stream, "owner", "ts", "ident", "kind", resolved, stale), f"file://{tmp_path}/out").collect()
    found = sorted((r.owner, r["at"], r.event, r.status, r.occurrences) for r in got if r.owner != 77)
    assert found == brute_life([r for r in rows if r[1] != 77], resolved, stale, 190_000 * 10**6)
    assert {f[2] for f in found} == {"opened", "reopened", "triaged", "resolved", "removed"}


def test_state_ends_and_late_rows_are_passed_over(spark, tmp_path):
    rows = [(0, 1, 86_400, "a"), (1, 1, 86_401, "a"), (2, 2, 200_000, "a"), (3, 2, 300_000, "a")]
    stream = files(spark, tmp_path / "in", rows, [100_000, 250_000])
    out = keyed.throttled(stream, "owner", "ts", "ident", 60)
    at = f"file://{tmp_path}/out"
    assert {r.ident: r.accepted for r in keyed.run_once(out, at).collect()} == {0: True, 1: False, 2: True, 3: True}
    late = spark.createDataFrame([(9, 1, 86_410, "a")], "ident long, owner long, s long, kind string").select("ident", "owner", F.timestamp_seconds("s").alias("ts"), "kind")
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    again = keyed.throttled(spark.readStream.schema(KINDS).parquet(str(tmp_path / "in")), "owner", "ts", "ident", 60)
    assert 9 not in {r.ident for r in keyed.run_once(again, at).collect()}
    state = spark.read.format("statestore").option("stateVarName", "held").load(f"{at}/state")
    assert {r.key.user_id if "user_id" in r.key else r.key[0] for r in state.select("key").collect()} <= {2}
