"""Queries over event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroom.operators import events as ev
from tallyroom.plans.registry import day, days_sql, micros, query, r6
from tallyroom.sources.tables import read

HOUR = 3_600_000_000


@query("""
SELECT event_type || '-' || CAST(CAST(floor(value / 20) AS INTEGER) AS VARCHAR) AS token, count(DISTINCT user_id) AS contributors, count(*) AS n
FROM events GROUP BY 1 HAVING count(DISTINCT user_id) >= 5 ORDER BY contributors DESC, token LIMIT 20
""")
def kanon_token_corpus(spark, d) -> DataFrame:
    """The tokens of most contributors, of those with five or more."""
    token = F.concat_ws("-", "event_type", F.floor(F.col("value") / 20).cast("int").cast("string"))
    return ev.k_anonymous(read(spark, d, "events"), token, "user_id").orderBy(F.desc("contributors"), "token").limit(20)


def _groups(spark, d):
    return ev.error_groups(read(spark, d, "events").where("event_type = 'error'"), F.md5(F.concat_ws(":", "event_type", F.floor(F.col("value") / 25).cast("int").cast("string"))), micros("ts"), F.col("value"))


GROUPS = """
SELECT md5(event_type || ':' || CAST(CAST(floor(value / 25) AS INTEGER) AS VARCHAR)) AS fingerprint, count(*) AS occurrences, min(epoch_us(ts)) AS first_seen, max(epoch_us(ts)) AS last_seen,
  arg_max(value, (epoch_us(ts), value)) AS last_payload FROM events WHERE event_type = 'error' GROUP BY 1
"""


@query(GROUPS)
def event_error_rollup(spark, d) -> DataFrame:
    return _groups(spark, d)


@query(f"""
WITH g AS ({GROUPS}), s AS (SELECT fingerprint, CASE WHEN fingerprint < '8' THEN 'resolved' ELSE 'triaged' END AS status, 1706140800000000 AS since FROM g WHERE fingerprint < 'c'),
x AS (SELECT g.*, CASE WHEN s.status = 'resolved' AND last_seen > since THEN 'open' ELSE coalesce(s.status, 'open') END AS status, since FROM g LEFT JOIN s USING (fingerprint))
SELECT fingerprint, occurrences, first_seen, last_seen, last_payload, status, CASE WHEN status = 'resolved' THEN 1707955200000000 - since >= 14 * 86400000000 ELSE 1707955200000000 - last_seen >= 21 * 86400000000 END AS expired FROM x
""")
def error_lifecycle(spark, d) -> DataFrame:
    """Groups with a status: resolved ones that recur are open again; old ones expire."""
    g = _groups(spark, d)
    s = g.where("fingerprint < 'c'").select("fingerprint", F.when(F.col("fingerprint") < "8", "resolved").otherwise("triaged").alias("status"), F.lit(1706140800000000).alias("since"))
    return ev.lifecycle(g, s, F.lit(1707955200000000), 14, 21, 24 * HOUR)


@query("""
SELECT user_id, strftime(ts + INTERVAL (user_id % 31) DAY, '%Y-%m') AS period, count(*) AS used, least(count(*), 40) AS accepted, greatest(0, count(*) - 40) AS denied FROM events GROUP BY 1, 2
""")
def usage_monthly_quota(spark, d) -> DataFrame:
    """Users' months, which begin on other days, so that the events meet two of them."""
    month = F.date_format(F.col("ts") + F.make_dt_interval(days=(F.col("user_id") % 31).cast("int")), "yyyy-MM")
    return ev.quota_use(read(spark, d, "events"), ["user_id"], month, ["ts", "event_id"], 40)


@query("""
SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) <= 2 AS accepted FROM events
""")
def quota_verdicts(spark, d) -> DataFrame:
    rows = read(spark, d, "events").select("event_id", "user_id", "ts")
    return ev.quota_verdicts(rows, ["user_id"], F.date_format("ts", "yyyy-MM-dd"), ["ts", "event_id"], 2).select("event_id", "user_id", "accepted")


@query("""
WITH p(model, pi, po) AS (VALUES ('click', 0.15, 0.6), ('view', 0.1, 0.4), ('purchase', 2.5, 10.0)),
e AS (SELECT event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k FROM events)
SELECT event_type, count(*) AS n, count(pi) AS n_priced, round(sum((value * CAST(pi AS DOUBLE) + k * CAST(po AS DOUBLE)) / 1e6), 6) AS cost FROM e LEFT JOIN p ON event_type = model GROUP BY 1
""")
def usage_cost_join(spark, d) -> DataFrame:
    prices = spark.createDataFrame([("click", 0.15, 0.6), ("view", 0.1, 0.4), ("purchase", 2.5, 10.0)], "model string, price_in double, price_out double")
    rows = ev.priced(read(spark, d, "events"), prices, "event_type", F.col("value"), F.regexp_extract("props", "([0-9]+)", 1).cast("double"))
    return r6(rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count("cost").alias("n_priced"), F.sum("cost").alias("cost")))


@query("""
SELECT c_mktsegment, sum(CASE WHEN o_orderstatus <> 'P' THEN 1 ELSE 0 END)::BIGINT AS n_submitted, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS n_advanced,
  round(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN o_orderstatus <> 'P' THEN 1 ELSE 0 END), 0), 6) AS share
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1
""")
def stage_share_by_segment(spark, d) -> DataFrame:
    rows = read(spark, d, "orders").select("o_custkey", "o_orderstatus").join(read(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return r6(ev.stage_share(rows, ["c_mktsegment"], F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F"))


@query("SELECT CASE WHEN grouping(o_orderstatus) = 1 THEN 'ALL' ELSE o_orderstatus END AS o_orderstatus, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), ())")
def pipeline_counts(spark, d) -> DataFrame:
    return ev.counts_with_total(read(spark, d, "orders"), "o_orderstatus")


@query("""
WITH m AS (SELECT user_id, min(CASE WHEN event_type = 'signup' THEN epoch_us(ts) END) AS signed_up, min(CASE WHEN event_type = 'purchase' AND value > 100 THEN epoch_us(ts) END) AS bought, min(CASE WHEN event_type = 'error' AND value > 200 THEN epoch_us(ts) END) AS failed FROM events GROUP BY 1)
SELECT *, CAST((signed_up IS NOT NULL)::INT + (bought IS NOT NULL)::INT + (failed IS NOT NULL)::INT AS INTEGER) AS level FROM m
""")
def first_touch_levels(spark, d) -> DataFrame:
    kind, v = F.col("event_type"), F.col("value")
    return ev.milestones(read(spark, d, "events"), "user_id", micros("ts"), {"signed_up": kind == "signup", "bought": (kind == "purchase") & (v > 100), "failed": (kind == "error") & (v > 200)})


@query("""
SELECT user_id, event_type, granted, at_us FROM (SELECT user_id, event_type, value > 30 AS granted, epoch_us(ts) AS at_us, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1
""")
def consent_latest(spark, d) -> DataFrame:
    rows = read(spark, d, "events").select("event_id", "user_id", "event_type", (F.col("value") > 30).alias("granted"), micros("ts").alias("at_us"))
    return ev.latest(rows, ["user_id", "event_type"], F.struct("at_us", "event_id"), ["granted", "at_us"])


@query("""
SELECT event_id, CASE WHEN user_id IN (SELECT user_id FROM events WHERE value > 300) THEN NULL ELSE user_id END AS user_id, value FROM events
""")
def erasure(spark, d) -> DataFrame:
    facts = read(spark, d, "events").select("event_id", "user_id", "value")
    return ev.erase(facts, facts.where("value > 300").select("user_id").distinct(), "user_id", keep=True)


@query(f"""
WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events), m AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) < {6 * HOUR} THEN 0 ELSE 1 END AS opens FROM e),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY t, event_id)::BIGINT AS session FROM m)
SELECT user_id, session, min(t) AS first, max(t) AS last, count(*) AS n, arg_max(event_id, (t, event_id)) AS last_id FROM s GROUP BY 1, 2
""")
def debounce_sessions(spark, d) -> DataFrame:
    return ev.idle_sessions(read(spark, d, "events").select("user_id", "event_id", micros("ts").alias("t")), ["user_id"], "t", "event_id", 6 * HOUR)


_ORDERED = "e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)"


@query(f"""
WITH RECURSIVE {_ORDERED},
r AS (SELECT event_id, user_id, t, rn, t + {24 * HOUR} AS w, 1 AS n FROM e WHERE rn = 1
  UNION ALL SELECT e.event_id, e.user_id, e.t, e.rn, CASE WHEN e.t > r.w THEN e.t + {24 * HOUR} ELSE r.w END, CASE WHEN e.t > r.w THEN 1 ELSE r.n + 1 END FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
SELECT event_id, user_id, n <= 2 AS accepted FROM r
""")
def rate_limit_fixed_window(spark, d) -> DataFrame:
    rows = read(spark, d, "events").select("event_id", "user_id", micros("ts").alias("t"))
    return ev.ordered_fold(rows, "user_id", ["t", "event_id"], "t", ev.fixed_window_rule(24 * HOUR, 2), "accepted").drop("t")


@query(f"""
WITH RECURSIVE {_ORDERED},
r AS (SELECT event_id, user_id, t, rn, t AS a, true AS ok FROM e WHERE rn = 1
  UNION ALL SELECT e.event_id, e.user_id, e.t, e.rn, CASE WHEN e.t - r.a >= {10 * HOUR} THEN e.t ELSE r.a END, e.t - r.a >= {10 * HOUR} FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
SELECT event_id, user_id, ok AS accepted FROM r
""")
def throttle_last_accepted(spark, d) -> DataFrame:
    rows = read(spark, d, "events").select("event_id", "user_id", micros("ts").alias("t"))
    return ev.ordered_fold(rows, "user_id", ["t", "event_id"], "t", ev.throttle_rule(10 * HOUR), "accepted").drop("t")


@query("SELECT user_id, event_type, CAST(floor(value) AS BIGINT) AS amount, min(event_id) AS event_id FROM events GROUP BY 1, 2, 3")
def idempotent_events(spark, d) -> DataFrame:
    """Of deliveries with one key the first stands."""
    rows = read(spark, d, "events").select("user_id", "event_type", F.floor("value").cast("long").alias("amount"), "event_id")
    return rows.groupBy("user_id", "event_type", "amount").agg(F.min("event_id").alias("event_id"))


@query(f"""
WITH o AS (SELECT {days_sql("o_orderdate")} AS day, 'order' AS kind, o_orderkey AS ref FROM orders),
s AS (SELECT DISTINCT {days_sql("l_shipdate")} AS day, 'shipment' AS kind, l_orderkey AS ref FROM lineitem),
e AS (SELECT {days_sql("ts")} AS day, 'event' AS kind, event_id AS ref FROM events)
SELECT day, kind, count(*) AS n FROM (SELECT * FROM o UNION ALL SELECT * FROM e UNION ALL SELECT s.* FROM s WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.ref = s.ref AND o.day = s.day)) GROUP BY 1, 2
""")
def calendar_union(spark, d) -> DataFrame:
    """Days with orders, shipments (but for those on the order's own day) and events."""
    o = read(spark, d, "orders").select(day("o_orderdate").alias("day"), F.lit("order").alias("kind"), F.col("o_orderkey").alias("ref"))
    s = read(spark, d, "lineitem").select(day("l_shipdate").alias("day"), F.lit("shipment").alias("kind"), F.col("l_orderkey").alias("ref")).distinct()
    e = read(spark, d, "events").select(day("ts").alias("day"), F.lit("event").alias("kind"), F.col("event_id").alias("ref"))
    return o.unionByName(e).unionByName(s.join(o.select("ref", "day"), ["ref", "day"], "left_anti").select("day", "kind", "ref")).groupBy("day", "kind").agg(F.count("*").alias("n"))
