"""Queries over queues, stores, outboxes and streams with state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroom.operators import queues
from tallyroom.operators.tables import shared_folder
from tallyroom.plans.registry import micros, query, r6
from tallyroom.sources.store import Store, Transaction
from tallyroom.sources.tables import read
from tallyroom.streaming import keyed, outbox, processors

DAY, HOUR = 86_400_000_000, 3_600_000_000
QUEUE = queues.QueueRules(capacity=5, batch=3, repeat=2 * HOUR, cap=60, every=HOUR)


def _own(spark) -> str:
    return f"{shared_folder(spark)}/tallyroom/{uuid.uuid4().hex}"


@query(f"""
WITH RECURSIVE e AS (SELECT user_id, event_id, event_type AS f, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS q, CAST([] AS STRUCT(f VARCHAR, t BIGINT)[]) AS seen, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS nb, CAST(NULL AS BIGINT) AS due, CAST([] AS STRUCT(event_id BIGINT, fate VARCHAR, batch BIGINT, place BIGINT, "at" BIGINT)[]) AS out FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL SELECT user_id, i, CASE WHEN fresh THEN list_append(q2, event_id) ELSE q2 END, CASE WHEN fresh THEN list_append(list_filter(seen, lambda x: x.f <> f), {{'f': f, 't': t}}) ELSE seen END, n + fresh::INT, nb1,
    CASE WHEN d1 IS NULL AND (fresh OR len(q2) > 0) THEN (t // {HOUR} + 1) * {HOUR} ELSE d1 END,
    list_concat(sent, CASE WHEN NOT capped AND len(q1) >= 5 THEN [{{'event_id': q1[1], 'fate': 'evicted', 'batch': NULL, 'place': NULL, 'at': t}}] ELSE [] END, CASE WHEN fresh THEN [] ELSE [{{'event_id': event_id, 'fate': CASE WHEN capped THEN 'capped' ELSE 'throttled' END, 'batch': NULL, 'place': NULL, 'at': t}}] END)
  FROM (SELECT *, CASE WHEN NOT capped AND len(q1) >= 5 THEN q1[2:] ELSE q1 END AS q2, NOT capped AND coalesce(t - list_max(list_transform(list_filter(seen, lambda x: x.f = f), lambda x: x.t)) >= {2 * HOUR}, true) AS fresh
    FROM (SELECT *, CASE WHEN flush THEN [] ELSE q END AS q1, CASE WHEN flush THEN NULL ELSE due END AS d1, CASE WHEN flush THEN nb + (len(q) + 2) // 3 ELSE nb END AS nb1, n >= 60 AS capped,
      CASE WHEN flush THEN list_transform(range(len(q)), lambda k: {{'event_id': q[k + 1], 'fate': 'sent', 'batch': nb + k // 3 + 1, 'place': k % 3, 'at': eff}}) ELSE [] END AS sent
      FROM (SELECT *, coalesce(eff <= t, false) AS flush FROM (SELECT r.*  EXCLUDE (i, out), e.i, e.event_id, e.f, e.t, CASE WHEN (due // {DAY}) % 4 = 0 THEN due ELSE ((due // {DAY}) // 4 + 1) * 4 * {DAY} END AS eff FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1))))),
z AS (SELECT user_id, q, nb, CASE WHEN (due // {DAY}) % 4 = 0 THEN due ELSE ((due // {DAY}) // 4 + 1) * 4 * {DAY} END AS eff FROM r WHERE (user_id, i) IN (SELECT (user_id, max(i)) FROM e GROUP BY user_id)),
o AS (SELECT user_id, unnest(out) AS x FROM r UNION ALL SELECT user_id, unnest(list_transform(range(len(q)), lambda k: {{'event_id': q[k + 1], 'fate': 'sent', 'batch': nb + k // 3 + 1, 'place': k % 3, 'at': eff}})) FROM z)
SELECT user_id, x.event_id, x.fate, x.batch, x.place, x."at" FROM o
""")
def bounded_queue(spark, d) -> DataFrame:
    """Events by user through a queue of five; the sender is up one day of four."""
    e = read(spark, d, "events").select("user_id", "event_id", "event_type", micros("ts").alias("t"))
    return queues.queue_fates(e, "user_id", "t", "event_id", "event_type", QUEUE, lambda at: at // DAY % 4 == 0, until=10**16)


@query("SELECT user_id, event_type, count(*) AS n, round(sum(value), 6) AS spent FROM events GROUP BY ALL")
def usage_ledger(spark, d) -> DataFrame:
    """Facts and counters that change together, batch by batch; the first batch comes twice and counts once."""
    store = Store(spark, _own(spark))

    def tables(tx: Transaction) -> None:
        tx.create("facts", "event_id long, user_id long, event_type string, value double", ["user_id"])
        tx.create("counters", "user_id long, event_type string, n long, spent double", ["user_id", "event_type"])

    def count(batch: DataFrame):
        def change(tx: Transaction) -> None:
            tx.append("facts", batch)
            new = batch.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("spent"))
            old = tx.read("counters").select("user_id", "event_type", F.col("n").alias("n0"), F.col("spent").alias("s0"))
            both = new.join(old, (new.user_id.eqNullSafe(old.user_id)) & (new.event_type.eqNullSafe(old.event_type)), "left").select(new.user_id, new.event_type, (F.col("n") + F.coalesce("n0", F.lit(0))).alias("n"), (F.col("spent") + F.coalesce("s0", F.lit(0.0))).alias("spent"))
            tx.upsert("counters", both, ["n"])

        return change

    store.transact(tables)
    events = read(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    for number in (0, 1, 0):
        store.transact(count(events.where(F.col("event_id") % 2 == number)), "events", number)
    return r6(store.read("counters"))


@query("""
WITH s AS (SELECT o_custkey AS owner, o_orderkey % 3 AS batch, count(*) AS n, arg_max(o_orderpriority, o_orderkey) AS payload FROM orders GROUP BY ALL),
o AS (SELECT DISTINCT owner FROM s),
a AS (SELECT o.owner, CASE WHEN n IS NOT NULL THEN 1 END AS stored, payload AS stored_payload FROM o LEFT JOIN s ON s.owner = o.owner AND batch = 0),
b AS (SELECT a.owner, n, payload, stored, stored_payload, CASE a.owner % 3 WHEN 0 THEN 1 WHEN 1 THEN stored ELSE 9 END AS base, n IS NOT NULL AND NOT coalesce(CASE a.owner % 3 WHEN 0 THEN stored = 1 WHEN 1 THEN true ELSE false END, false) AS stuck FROM a LEFT JOIN s ON s.owner = a.owner AND batch = 1),
c AS (SELECT owner, CASE WHEN n IS NOT NULL AND NOT stuck THEN coalesce(stored, 0) + 1 ELSE stored END AS stored, CASE WHEN n IS NOT NULL AND NOT stuck THEN payload ELSE stored_payload END AS stored_payload, CASE WHEN stuck THEN n END AS revision, CASE WHEN stuck THEN payload END AS payload FROM b),
e AS (SELECT c.owner, c.revision IS NOT NULL AS stuck, CASE WHEN s.n IS NOT NULL AND c.revision IS NULL THEN coalesce(stored, 0) + 1 ELSE stored END AS stored, CASE WHEN s.n IS NOT NULL AND c.revision IS NULL THEN s.payload ELSE stored_payload END AS stored_payload, c.revision + coalesce(s.n, 0) AS revision, CASE WHEN c.revision IS NOT NULL THEN coalesce(s.payload, c.payload) END AS payload FROM c LEFT JOIN s ON s.owner = c.owner AND batch = 2),
f AS (SELECT owner, stuck AND owner % 2 = 1 AS stuck, CASE WHEN stuck AND owner % 2 = 0 THEN coalesce(stored, 0) + 1 ELSE stored END AS stored, CASE WHEN stuck AND owner % 2 = 0 THEN 'chosen' ELSE stored_payload END AS stored_payload, revision, payload FROM e)
SELECT owner, CASE WHEN stuck THEN 'conflict' ELSE 'stored' END AS status, CAST(stored AS BIGINT) AS stored, stored_payload, CAST(CASE WHEN stuck THEN revision END AS BIGINT) AS revision, CASE WHEN stuck THEN payload END AS payload FROM f
""")
def outbox_sync(spark, d) -> DataFrame:
    """Saves by customers in three batches, some on a revision that is gone; every second conflict is resolved."""
    store = Store(spark, _own(spark))
    outbox.open_outbox(store, 8)
    put = outbox.outbox_into(store, "orders", offline=lambda batch: False)
    orders = read(spark, d, "orders")
    base = F.when(F.col("o_orderkey") % 3 == 1, F.when(F.col("o_custkey") % 3 == 0, 1).when(F.col("o_custkey") % 3 == 2, 9)).cast("long")
    saves = orders.select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("at"), base.alias("base"), F.col("o_orderpriority").alias("payload"))
    for batch in (0, 1, 1, 2):
        put(saves.where(F.col("at") % 3 == batch), batch)
    stuck = outbox.status(store).where("status = 'conflict' AND owner % 2 = 0")
    outbox.resolve(store, stuck.select("owner", F.lit("chosen").alias("payload")))
    return outbox.status(store)


@query(f"""
WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, CASE event_type WHEN 'signup' THEN 'resolve' WHEN 'purchase' THEN 'triage' ELSE 'seen' END AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
x AS (SELECT user_id, t, k, i FROM e UNION ALL SELECT user_id, (SELECT max(t) // 1000 * 1000 - 600000000 FROM e), 'end', max(i) + 1 FROM e GROUP BY user_id),
r AS (SELECT user_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS STRUCT(s VARCHAR, n BIGINT, a BIGINT, z BIGINT, c BIGINT)) AS g, CAST([] AS STRUCT("at" BIGINT, event VARCHAR, g STRUCT(s VARCHAR, n BIGINT, a BIGINT, z BIGINT, c BIGINT))[]) AS out FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL SELECT user_id, i, CASE WHEN k = 'end' THEN h ELSE coalesce(after, h) END, list_concat(CASE WHEN over THEN [{{'at': fin, 'event': 'removed', 'g': g}}] ELSE [] END, CASE WHEN after IS NULL OR after.s = h.s THEN [] ELSE [{{'at': t, 'event': CASE WHEN after.s <> 'open' THEN after.s WHEN h IS NULL THEN 'opened' ELSE 'reopened' END, 'g': after}}] END)
  FROM (SELECT *, CASE WHEN k = 'end' THEN NULL WHEN k = 'seen' THEN CASE WHEN h IS NULL THEN {{'s': 'open', 'n': 1, 'a': t, 'z': t, 'c': t}} ELSE {{'s': 'open', 'n': h.n + 1, 'a': h.a, 'z': t, 'c': CASE WHEN h.s = 'open' THEN h.c ELSE t END}} END
      WHEN h IS NOT NULL AND h.s <> CASE k WHEN 'triage' THEN 'triaged' ELSE 'resolved' END THEN {{'s': CASE k WHEN 'triage' THEN 'triaged' ELSE 'resolved' END, 'n': h.n, 'a': h.a, 'z': h.z, 'c': t}} END AS after
    FROM (SELECT *, CASE WHEN over THEN NULL ELSE g END AS h FROM (SELECT *, coalesce(fin <= t, false) AS over FROM (SELECT r.user_id, x.i, x.t, x.k, r.g, CASE WHEN r.g.s = 'resolved' THEN r.g.c + {2 * DAY} ELSE r.g.z + {3 * DAY} END AS fin FROM r JOIN x ON x.user_id = r.user_id AND x.i = r.i + 1))))),
o AS (SELECT user_id, unnest(out) AS x FROM r)
SELECT user_id, x."at", x.event, x.g.s AS status, x.g.n AS occurrences, x.g.a AS first_seen, x.g.z AS last_seen FROM o
""")
def group_life(spark, d) -> DataFrame:
    """Users' events as a stream of occurrences, triages and resolutions; groups go after two or three days."""
    # a pattern, as a stream takes a plain path for a folder
    stream = spark.readStream.schema(read(spark, d, "events").schema).parquet(f"{d}/event[s].parquet")
    kind = F.when(F.col("event_type") == "signup", "resolve").when(F.col("event_type") == "purchase", "triage").otherwise("seen")
    rows = stream.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"))
    return keyed.run_once(processors.lifecycle(rows, "user_id", "ts", "event_id", "kind", 2 * DAY, 3 * DAY), _own(spark))
