"""Job queue, workers and dispatch."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import folds

from .registry import query

_C = F.col
#: kind of an event -> state of the job it stands for
_ST = "CASE kind WHEN 'view' THEN 'queued' WHEN 'click' THEN 'claimed' WHEN 'error' THEN 'failed' ELSE 'done' END"
_JOBS = f"SELECT id, key, {_ST} AS status, id % 6 AS attempts, size % 3 AS class, ts FROM jobs"


def jobs(t):
    k = _C("kind")
    status = F.when(k == "view", "queued").when(k == "click", "claimed").when(k == "error", "failed").otherwise("done")
    return t.jobs.select("id", "key", status.alias("status"), (_C("id") % 6).alias("attempts"), (_C("size") % 3).alias("class"), _C("ts").cast("timestamp").alias("ts"))


_WORKERS = "SELECT c_custkey AS worker, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey % 3 END AS ceiling, c_custkey % 100 AS beat FROM customer"


def workers(t):
    c = _C("c_custkey")
    return t.customer.select(c.alias("worker"), F.when(c % 4 != 0, c % 3).alias("ceiling"), (c % 100).alias("beat"))


@query("p20_live_workers", f"WITH w AS ({_WORKERS}) SELECT worker FROM w WHERE beat >= 40 AND (ceiling IS NULL OR ceiling >= 1)")
def p20(t):
    return workers(t).where("beat >= 40 AND (ceiling IS NULL OR ceiling >= 1)").select("worker")


@query("j11_newer_sibling", f"WITH j AS ({_JOBS}) SELECT id FROM j a WHERE status = 'claimed' AND EXISTS (SELECT 1 FROM j b WHERE b.key = a.key AND b.status = 'queued' AND b.id > a.id)")
def j11(t):
    """EXISTS on the newest queued sibling: an aggregate of one row per key in place of a pair join."""
    newest = jobs(t).where("status = 'queued'").groupBy("key").agg(F.max("id").alias("newest"))
    return jobs(t).where("status = 'claimed'").join(newest, "key").where("newest > id").select("id")


@query("j12_no_queued_sibling", f"WITH j AS ({_JOBS}) SELECT id FROM j a WHERE status = 'failed' AND NOT EXISTS (SELECT 1 FROM j b WHERE b.key = a.key AND b.status = 'queued')")
def j12(t):
    return jobs(t).where("status = 'failed'").join(jobs(t).where("status = 'queued'").select("key"), "key", "left_anti").select("id")


@query("j15_claimable", f"WITH j AS ({_JOBS}), w AS ({_WORKERS}) SELECT worker, count(*) AS claimable FROM w JOIN j ON status = 'queued' AND (ceiling IS NULL OR class <= ceiling) GROUP BY 1")
def j15(t):
    """A theta join on few classes: counted per class first, so only classes meet workers."""
    per = jobs(t).where("status = 'queued'").groupBy("class").agg(F.count("*").alias("n"))
    hit = _C("ceiling").isNull() | (_C("class") <= _C("ceiling"))
    return workers(t).join(F.broadcast(per), hit).groupBy("worker").agg(F.sum("n").alias("claimable"))  # a row for each class


@query("a04_pending_by_class", f"WITH j AS ({_JOBS}) SELECT least(class, 1) AS rank, count(*) AS n FROM j WHERE status = 'queued' GROUP BY 1")
def a04(t):
    return jobs(t).where("status = 'queued'").groupBy(F.least("class", F.lit(1)).alias("rank")).agg(F.count("*").alias("n"))


@query("a05_worker_counts", f"WITH w AS ({_WORKERS}) SELECT count(*) FILTER (beat >= 40) AS live, count(*) FILTER (beat >= 40 AND (ceiling IS NULL OR ceiling >= 2)) AS capable, (SELECT count(*) FROM ({_JOBS}) WHERE status = 'queued') AS queued FROM w")
def a05(t):
    live = _C("beat") >= 40
    w = workers(t).agg(F.count_if(live).alias("live"), F.count_if(live & (_C("ceiling").isNull() | (_C("ceiling") >= 2))).alias("capable"))
    return w.join(jobs(t).where("status = 'queued'").agg(F.count("*").alias("queued")))


@query(
    "a07_reconcile_plan",
    f"WITH p AS (SELECT class, count(*) AS n FROM ({_JOBS}) WHERE status = 'queued' GROUP BY 1), w AS (SELECT count(*) AS live FROM ({_WORKERS}) WHERE beat >= 40) SELECT CAST(sum(n) AS BIGINT) AS pending, least(CAST(sum(n) AS BIGINT), 1200) AS wanted, greatest(least(CAST(sum(n) AS BIGINT), 1200) - max(live), 0) AS to_start, max(class) AS max_rank FROM p, w",
)
def a07(t):
    p = jobs(t).where("status = 'queued'").agg(F.count("*").alias("pending"), F.max("class").alias("max_rank"))
    live = workers(t).where("beat >= 40").agg(F.count("*").alias("live"))
    wanted = F.least("pending", F.lit(1200).cast("long"))
    return p.join(live).select("pending", wanted.alias("wanted"), F.greatest(wanted - _C("live"), F.lit(0).cast("long")).alias("to_start"), "max_rank")


@query("t01_next_job", f"WITH j AS ({_JOBS}) SELECT class, arg_min(id, (ts, id)) AS next FROM j WHERE status = 'queued' GROUP BY 1")
def t01(t):
    best = jobs(t).where("status = 'queued'").groupBy("class").agg(F.min(F.struct("ts", "id")).alias("m"))
    return best.select("class", _C("m.id").alias("next"))


@query("t09_oldest_entry", "SELECT user_id, arg_min(event_id, ts) AS oldest FROM events GROUP BY 1")
def t09(t):
    return t.events.groupBy("user_id").agg(F.min_by("event_id", "ts").alias("oldest"))


@query("w10_monotone_classes", "SELECT p_brand, bool_and(coalesce(prev <= p_retailprice, true)) AS monotone FROM (SELECT p_brand, p_retailprice, lag(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS prev FROM part) GROUP BY 1")
def w10(t):
    prev = F.lag("p_retailprice").over(Window.partitionBy("p_brand").orderBy("p_size", "p_partkey"))
    rows = t.part.select("p_brand", F.coalesce(prev <= _C("p_retailprice"), F.lit(True)).alias("ok"))
    return rows.groupBy("p_brand").agg(F.bool_and("ok").alias("monotone"))


@query(
    "w11_wedge_streak",
    """WITH g AS (SELECT event_id, user_id, event_type, ts, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM events)
    SELECT event_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, grp ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM g""",
)
def w11(t):
    one = lambda kind: F.when(_C("event_type") == kind, 1).otherwise(0)
    run = lambda *k: Window.partitionBy(*k).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    g = t.events.withColumn("grp", F.sum(one("purchase")).over(run("user_id")))
    return g.select("event_id", F.sum(one("error")).over(run("user_id", "grp")).alias("streak"))


@query("x01_job_lifecycle", f"WITH j AS ({_JOBS}) SELECT key, arg_max(status, id) AS status FROM j GROUP BY 1")
def x01(t):
    return jobs(t).groupBy("key").agg(F.max_by("status", "id").alias("status"))


@query(
    "x02_coalesced_enqueues",
    f"WITH j AS ({_JOBS}), g AS (SELECT *, count(*) FILTER (status = 'claimed') OVER (PARTITION BY key ORDER BY id ROWS UNBOUNDED PRECEDING) AS run FROM j) SELECT key, run, min(id) AS id, max(class) AS class, count(*) AS coalesced FROM g WHERE status = 'queued' GROUP BY 1, 2",
)
def x02(t):
    w = Window.partitionBy("key").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    g = jobs(t).withColumn("run", F.sum(F.when(_C("status") == "claimed", 1).otherwise(0)).over(w).cast("long"))
    return g.where("status = 'queued'").groupBy("key", "run").agg(F.min("id").alias("id"), F.max("class").alias("class"), F.count("*").alias("coalesced"))


@query(
    "x03_stale_reclaim",
    f"""WITH j AS ({_JOBS}), q AS (SELECT DISTINCT key FROM j WHERE status = 'queued' AND attempts > 2), c AS (SELECT *, max(id) FILTER (attempts < 5) OVER (PARTITION BY key) AS newest FROM j WHERE status = 'claimed')
    SELECT c.id, CASE WHEN attempts >= 5 THEN 'dead-letter' WHEN q.key IS NOT NULL THEN 'superseded' WHEN c.id < newest THEN 'superseded' ELSE 'requeued' END AS outcome, CASE WHEN attempts < 5 AND q.key IS NULL AND c.id = newest THEN least(class + 1, 2) ELSE class END AS class FROM c LEFT JOIN q ON c.key = q.key""",
)
def x03(t):
    """Attempts first, then a queued sibling; of several stale claims of one key only the newest is requeued
    (a deviation that keeps one queued job per key)."""
    queued = jobs(t).where("status = 'queued' AND attempts > 2").select("key", F.lit(True).alias("sibling")).distinct()
    newest = F.max(F.when(_C("attempts") < 5, _C("id"))).over(Window.partitionBy("key"))
    c = jobs(t).where("status = 'claimed'").withColumn("newest", newest).join(queued, "key", "left")
    lost = _C("sibling").isNotNull() | (_C("id") < _C("newest"))
    dead = _C("attempts") >= 5
    outcome = F.when(dead, "dead-letter").when(lost, "superseded").otherwise("requeued")
    return c.select("id", outcome.alias("outcome"), F.when(~dead & ~lost, F.least(_C("class") + 1, F.lit(2))).otherwise(_C("class")).alias("class"))


@query("x04_ack", f"WITH j AS ({_JOBS}) SELECT id, CASE WHEN id % 10 = 0 THEN 'lost claim' WHEN status = 'done' THEN 'done' WHEN status = 'failed' AND class = 2 THEN 'failed' WHEN status = 'failed' AND attempts >= 5 THEN 'dead-letter' WHEN status = 'failed' THEN 'retry' ELSE 'pending' END AS ack FROM j")
def x04(t):
    s = _C("status")
    ack = F.when(_C("id") % 10 == 0, "lost claim").when(s == "done", "done").when((s == "failed") & (_C("class") == 2), "failed").when((s == "failed") & (_C("attempts") >= 5), "dead-letter").when(s == "failed", "retry").otherwise("pending")
    return jobs(t).select("id", ack.alias("ack"))


@query("x05_heartbeats", "WITH l AS (SELECT user_id, max(ts) AS beat FROM events GROUP BY 1) SELECT user_id, CASE WHEN s >= 24 * 3600 THEN 'gone' WHEN s >= 6 * 3600 THEN 'stale' ELSE 'live' END AS state FROM (SELECT user_id, date_diff('second', beat, (SELECT max(ts) FROM events)) AS s FROM l)")
def x05(t):
    last = t.events.groupBy("user_id").agg(F.max(_C("ts").cast("timestamp")).alias("beat"))
    now = t.events.agg(F.max(_C("ts").cast("timestamp")).alias("now"))
    s = F.unix_timestamp("now") - F.unix_timestamp("beat")
    return last.join(F.broadcast(now)).select("user_id", F.when(s >= 24 * 3600, "gone").when(s >= 6 * 3600, "stale").otherwise("live").alias("state"))


def calls(t):
    return t.events.select("event_id", "user_id", F.unix_timestamp(_C("ts").cast("timestamp")).alias("at"))


_BUCKET = """WITH RECURSIVE e AS (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS tm, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS rn FROM events),
    g AS (SELECT event_id, user_id, tm, rn, {burst} - 1 AS tokens, true AS allowed FROM e WHERE rn = 1 UNION ALL
      SELECT event_id, user_id, tm, rn, CASE WHEN have >= 1 THEN have - 1 ELSE have END, have >= 1 FROM (
        SELECT e.event_id, e.user_id, e.tm, e.rn, least({burst}, g.tokens + {gain}) AS have FROM g JOIN e ON e.user_id = g.user_id AND e.rn = g.rn + 1))
    SELECT event_id, allowed FROM g"""


@query("x09_token_bucket", _BUCKET.format(burst="3::BIGINT", gain="(e.tm - g.tm) // 3600"))
def x09(t):
    return folds.token_bucket(calls(t), "user_id", "at", "event_id", 3600, 3).select("event_id", "allowed")


@query("x18_bandwidth_bucket", _BUCKET.format(burst="2::DOUBLE", gain="(e.tm - g.tm) / 7200::DOUBLE"))
def x18(t):
    return folds.token_bucket(calls(t), "user_id", "at", "event_id", 7200, 2, whole=False).select("event_id", "allowed")


@query(
    "x11_freshness_checks",
    f"""WITH j AS ({_JOBS}), g AS (SELECT *, count(*) FILTER (status = 'queued') OVER (PARTITION BY key ORDER BY id ROWS UNBOUNDED PRECEDING) AS chain FROM j)
    SELECT id, row_number() OVER (PARTITION BY key, chain ORDER BY id) - 1 AS recheck, row_number() OVER (PARTITION BY key, chain ORDER BY id) <= 3 AS checked FROM g WHERE status = 'claimed'""",
)
def x11(t):
    """Re-checks after a build count up along the chain that one push began; at the third the chain stops until the next push."""
    upto = Window.partitionBy("key").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    g = jobs(t).withColumn("chain", F.sum(F.when(_C("status") == "queued", 1).otherwise(0)).over(upto)).where("status = 'claimed'")
    n = F.row_number().over(Window.partitionBy("key", "chain").orderBy("id"))
    return g.select("id", (n - 1).cast("long").alias("recheck"), (n <= 3).alias("checked"))


@query("x12_two_phase_publish", f"WITH j AS ({_JOBS}) SELECT key, bool_or(status = 'claimed') AS depth1, bool_or(status = 'done') AS full_ready, CASE WHEN bool_or(status = 'done') THEN 200 WHEN bool_or(status = 'claimed') THEN 202 ELSE 404 END AS code FROM j GROUP BY 1")
def x12(t):
    one = lambda s: F.bool_or(_C("status") == s)
    return jobs(t).groupBy("key").agg(one("claimed").alias("depth1"), one("done").alias("full_ready")).withColumn("code", F.when(_C("full_ready"), 200).when(_C("depth1"), 202).otherwise(404))


@query(
    "x13_backpressure",
    """WITH RECURSIVE e AS (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS tm, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS rn FROM events),
    g AS (SELECT event_id, user_id, rn, [tm + 43200] AS q, true AS accepted FROM e WHERE rn = 1 UNION ALL
      SELECT e.event_id, e.user_id, e.rn, CASE WHEN len(list_filter(g.q, lambda x: x > e.tm)) < 2 THEN list_filter(g.q, lambda x: x > e.tm) || [e.tm + 43200] ELSE list_filter(g.q, lambda x: x > e.tm) END, len(list_filter(g.q, lambda x: x > e.tm)) < 2
      FROM g JOIN e ON e.user_id = g.user_id AND e.rn = g.rn + 1)
    SELECT event_id, accepted FROM g""",
)
def x13(t):
    """A channel of two places for each key, each taken for twelve hours; a job that finds none is refused."""
    return folds.bounded_queue(calls(t), "user_id", "at", "event_id", 43200, 2).select("event_id", "accepted")


@query("x14_prune_failed", f"WITH j AS ({_JOBS}) SELECT id FROM j WHERE NOT (status = 'failed' AND date_diff('second', ts, (SELECT max(ts) FROM j)) >= 2 * 86400)")
def x14(t):
    now = jobs(t).agg(F.max("ts").alias("now"))
    old = F.unix_timestamp("now") - F.unix_timestamp("ts") >= 2 * 86400
    return jobs(t).join(F.broadcast(now)).where(~((_C("status") == "failed") & old)).select("id")


@query(
    "x15_backoff_gate",
    """WITH g AS (SELECT event_id, user_id, event_type, ts, count(*) FILTER (event_type = 'purchase') OVER w AS grp FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
    f AS (SELECT event_id, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id, grp ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM g)
    SELECT event_id, CASE WHEN n = 0 THEN 0 ELSE least(CAST(500 * power(2, least(n - 1, 6)) AS BIGINT), 60000) END AS wait_ms FROM f""",
)
def x15(t):
    from tessera.functions.scalars import backoff

    return w11(t).select("event_id", F.when(_C("streak") == 0, F.lit(0)).otherwise(backoff(500, _C("streak"), 6, 60000)).cast("long").alias("wait_ms"))


@query("x16_idle_exit", "SELECT event_id, coalesce(date_diff('second', lag(ts) OVER w, ts) > 6 * 3600, false) OR row_number() OVER w > 20 AS exits FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def x16(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_timestamp(_C("ts").cast("timestamp"))
    gap = F.coalesce(at - F.lag(at).over(w) > 6 * 3600, F.lit(False))
    return t.events.select("event_id", (gap | (F.row_number().over(w) > 20)).alias("exits"))
