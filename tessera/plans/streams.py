"""Streaming queries, each drained and compared with its batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.streaming import states, timers

from .registry import query


@query("x05s_heartbeat_stream", "SELECT user_id, count(*) AS beats FROM events GROUP BY 1")
def x05s(t):
    out = states.drain(states.heartbeats(states.events(t.spark, t.directory)), "update")
    return out.groupBy("user_id").agg(F.max("beats").alias("beats"))


@query("a17s_hourly_stream", "WITH h AS (SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT start, event_type, n FROM h")
def a17s(t):
    out = states.drain(states.hourly(states.events(t.spark, t.directory)), "update")
    last = out.groupBy("start", "event_type").agg(F.max_by("n", "__batch").alias("n"))
    return last.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("x01s_lifecycle_stream", "SELECT user_id, arg_max(event_type, event_id) AS state FROM events GROUP BY 1")
def x01s(t):
    out = states.drain(states.lifecycle(states.events(t.spark, t.directory)), "update")
    return out.groupBy("user_id").agg(F.max_by("state", "__batch").alias("state"))


@query("x10_webhook_triggers", "SELECT event_id, user_id FROM events WHERE event_type = 'purchase' AND user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def x10(t):
    tracked = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return states.drain(states.triggers(states.events(t.spark, t.directory), tracked), "append").select("event_id", "user_id")


@query("x12s_two_phase_stream", "SELECT user_id AS key, bool_or(event_type IN ('purchase', 'signup')) AS full_ready, CASE WHEN bool_or(event_type IN ('purchase', 'signup')) THEN 200 ELSE 202 END AS code FROM events WHERE event_type IN ('click', 'purchase', 'signup') GROUP BY 1")
def x12s(t):
    """Shallow form first, then the full one; a key that has only the first answers 202."""
    out = states.publish(states.events(t.spark, t.directory))
    full = F.max("phase") == 2
    return out.groupBy("key").agg(full.alias("full_ready"), F.when(full, 200).otherwise(202).alias("code"))


_HOUR = timers.HOUR
_SEEN = "SELECT event_id, user_id, event_type, (epoch_us(ts) // 1000) AS tm, lead((epoch_us(ts) // 1000)) OVER w AS nx, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id ROWS UNBOUNDED PRECEDING) AS grp FROM events WINDOW w AS (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id)"
_PASSED = f"(SELECT (epoch_us(max(ts)) // 1000) - {_HOUR} FROM events)"


def timed(t, of, stream):
    with timers.store(t.spark):
        return states.drain(of(stream), "append").drop("__batch")


@query(
    "x03t_lease_expiry",
    f"""WITH e AS ({_SEEN}), x AS (SELECT *, row_number() OVER (PARTITION BY user_id, grp ORDER BY tm, event_id) - 1 AS n FROM e WHERE event_type = 'click' AND (nx - tm >= {6 * _HOUR} OR (nx IS NULL AND tm + {6 * _HOUR} <= {_PASSED})))
    SELECT user_id, event_id, tm + {6 * _HOUR} AS expired_at, (n % 3 + 1)::INT AS attempt, CASE WHEN n % 3 = 2 THEN 'dead-letter' ELSE 'requeued' END AS outcome, CASE WHEN n % 3 = 2 THEN 0 ELSE 500 * power(2, n % 3)::BIGINT END AS wait_ms FROM x""",
)
def x03t(t):
    """Claims whose lease runs out, by timers: requeued with a back-off, or dead letters at the third expiry."""
    return timed(t, timers.leases, states.events(t.spark, t.directory))


@query(
    "x05t_worker_ageout",
    f"""WITH e AS ({_SEEN}), g AS (SELECT *, coalesce(nx, {_PASSED}) - tm AS gap FROM e)
    SELECT user_id, event_id, 'stale' AS state, tm + {6 * _HOUR} AS since FROM g WHERE gap >= {6 * _HOUR} UNION ALL SELECT user_id, event_id, 'gone', tm + {24 * _HOUR} FROM g WHERE gap >= {24 * _HOUR}""",
)
def x05t(t):
    """Workers that grow stale and are forgotten, by timers."""
    return timed(t, timers.ageouts, states.events(t.spark, t.directory))


@query(
    "x08t_tombstones",
    f"""WITH e AS (SELECT event_id, user_id, event_type, event_id % 3 AS branch, (epoch_us(ts) // 1000) AS tm, (epoch_us(ts) // 1000) - event_id % 5 * {_HOUR} AS synced_at FROM events),
    d AS (SELECT *, max(tm) FILTER (event_type = 'error') OVER (PARTITION BY user_id, branch ORDER BY tm, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gone FROM e)
    SELECT user_id, event_id, NOT coalesce(gone + {6 * _HOUR} > tm AND synced_at <= gone, false) AS accepted FROM d WHERE event_type <> 'error'""",
)
def x08t(t):
    """Writes of deleted branches, refused while the tombstone lives; expired ones leave the state."""
    rows = states.events(t.spark, t.directory).withColumns({"branch": F.col("event_id") % 3, "synced_at": F.unix_millis("ts") - F.col("event_id") % 5 * _HOUR})
    return timed(t, timers.tombstones, rows)


@query(
    "x07s_idle_sessions",
    f"""WITH e AS (SELECT user_id, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)) AS prev FROM events),
    g AS (SELECT *, sum(CASE WHEN us - prev < {12 * 3600 * 1000000} THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS run FROM e)
    SELECT user_id, min(us) AS began, max(us) + {12 * 3600 * 1000000} AS evicted, count(*) AS n FROM g GROUP BY user_id, run
    HAVING max(us) + {12 * 3600 * 1000000} <= (SELECT max(epoch_us(ts)) FROM events) - {3600 * 1000000}""",
)
def x07s(t):
    """Keys idle for twelve hours: a session ends with its last use, and is told once, when the watermark has passed its end."""
    return states.drain(states.idle_sessions(states.events(t.spark, t.directory)), "append").drop("__batch")


@query(
    "x06t_orphan_ledger",
    f"""WITH e AS (SELECT user_id, event_id, event_type = 'purchase' AS live, (epoch_us(ts) // 1000) AS tm, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id ROWS UNBOUNDED PRECEDING) AS run FROM events),
    g AS (SELECT user_id, run, min(tm) FILTER (NOT live) AS first_seen, arg_min(event_id, (tm, event_id)) FILTER (NOT live) AS event_id FROM e GROUP BY 1, 2),
    n AS (SELECT user_id, run - 1 AS run, min(tm) AS until FROM e WHERE live GROUP BY 1, 2)
    SELECT user_id, event_id, first_seen, first_seen + {24 * _HOUR} AS deleted_at FROM g LEFT JOIN n USING (user_id, run) WHERE first_seen IS NOT NULL AND coalesce(until, {_PASSED}) >= first_seen + {24 * _HOUR}""",
)
def x06t(t):
    """What is unreachable keeps its first time of being seen so, until it is reachable again; after a grace it is deleted, once."""
    return timed(t, timers.orphans, states.events(t.spark, t.directory))


@query(
    "x17s_reassembly_stream",
    """WITH j AS (SELECT o_orderkey, epoch_us(CAST(l_shipdate AS TIMESTAMP)) // 1000 AS tm, 1 + o_orderkey % 4 AS expected FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate >= o_orderdate AND CAST(l_shipdate AS TIMESTAMP) <= CAST(o_orderdate AS TIMESTAMP) + INTERVAL 60 DAY),
    n AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY tm) AS fragments FROM j) SELECT o_orderkey AS user_id, fragments::INT AS fragments, tm AS completed_at FROM n WHERE fragments = expected""",
)
def x17s(t):
    """Manifests and fragments as two streams: files are told once, when the last of their expected fragments has come."""
    fragments = states.table(t.spark, t.directory, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").cast("long").alias("part"), F.col("l_shipdate").cast("timestamp").alias("ts"))
    k = F.col("o_orderkey")
    manifests = states.table(t.spark, t.directory, "orders").select(k.alias("id"), (1 + k % 4).alias("expected"), F.col("o_orderdate").cast("timestamp").alias("since"))
    with timers.store(t.spark):
        return states.drain(timers.reassembled(fragments, manifests), "append").drop("__batch")
