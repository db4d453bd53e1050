"""Garbage collection, reachability, refs and eviction."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import folds

from .registry import query

_C = F.col


def sweep(objects, reachable):
    """Objects no live manifest names. An anti join on the hash; reachable must come from a complete mark."""
    return objects.join(reachable, "hash", "left_anti")


@query("g09_mark", "SELECT hash FROM reachable")
def g09(t):
    return t.reachable


@query("j01_gc_sweep_anti", "SELECT hash, size FROM objects WHERE hash NOT IN (SELECT hash FROM reachable)")
def j01(t):
    return sweep(t.objects, t.reachable)


_LEDGER = "SELECT p_partkey AS hash, 1000 + p_partkey % 100 AS first_seen FROM part WHERE p_partkey % 3 = 0"


def ledger(t):
    k = _C("p_partkey")
    return t.part.where(k % 3 == 0).select(k.alias("hash"), (F.lit(1000) + k % 100).alias("first_seen"))


@query("j02_ledger_first_seen", f"WITH led AS ({_LEDGER}) SELECT o.hash, coalesce(first_seen, 2000) AS first_seen FROM objects o LEFT JOIN led ON o.hash = led.hash WHERE o.hash NOT IN (SELECT hash FROM reachable)")
def j02(t):
    return sweep(t.objects, t.reachable).join(ledger(t), "hash", "left").select("hash", F.coalesce("first_seen", F.lit(2000).cast("long")).alias("first_seen"))


_FRESH = "SELECT DISTINCT hash FROM chunk_refs JOIN orders ON manifest = o_orderkey WHERE o_orderpriority = '1-URGENT'"


def fresh(t):
    """What a second mark reaches: refs of every status with the priority."""
    refs = t.orders.where("o_orderpriority = '1-URGENT'").select(_C("o_orderkey").alias("manifest"))
    return t.lineitem.select(_C("l_orderkey").alias("manifest"), _C("l_partkey").alias("hash")).join(refs, "manifest").select("hash").distinct()


@query("j03_rescue_recheck", f"WITH fresh AS ({_FRESH}) SELECT hash FROM objects WHERE hash NOT IN (SELECT hash FROM reachable) AND hash NOT IN (SELECT hash FROM fresh)")
def j03(t):
    return sweep(sweep(t.objects, t.reachable), fresh(t)).select("hash")


@query("u01_protected_union", "SELECT hash FROM reachable UNION SELECT doc_id FROM labels WHERE quality = 1")
def u01(t):
    return t.reachable.union(t.labels.where("quality = 1").select(_C("doc_id").alias("hash"))).distinct()


@query("u02_reachable_fields", "SELECT DISTINCT unnest([o_custkey::VARCHAR, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '' END, o_orderstatus]) AS hash FROM live_refs")
def u02(t):
    fields = F.array(_C("o_custkey").cast("string"), F.when(_C("o_orderkey") % 2 == 0, _C("o_orderpriority")).otherwise(""), _C("o_orderstatus"))
    return t.live_refs.select(F.explode(F.array_distinct(fields)).alias("hash")).distinct()


@query("u03_upload_set", "SELECT DISTINCT l_partkey AS hash FROM lineitem WHERE l_returnflag = 'R' ORDER BY 1")
def u03(t):
    return t.lineitem.where("l_returnflag = 'R'").select(_C("l_partkey").alias("hash")).distinct().orderBy("hash")


@query(
    "a13_gc_report",
    f"""WITH led AS ({_LEDGER}), s AS (SELECT o.hash, o.size, r.hash IS NOT NULL AS live, coalesce(first_seen, 2000) <= 1050 AS old FROM objects o LEFT JOIN reachable r ON o.hash = r.hash LEFT JOIN led ON o.hash = led.hash)
    SELECT count(*) AS scanned, count(*) FILTER (live) AS reachable, count(*) FILTER (NOT live AND NOT old) AS tombstoned, count(*) FILTER (NOT live AND old) AS deleted, CAST(coalesce(sum(size) FILTER (NOT live AND old), 0) AS BIGINT) AS bytes FROM s""",
)
def a13(t):
    s = t.objects.join(t.reachable.withColumn("live", F.lit(True)), "hash", "left").join(ledger(t), "hash", "left")
    live, old = F.coalesce("live", F.lit(False)), F.coalesce("first_seen", F.lit(2000)) <= 1050
    return s.agg(
        F.count("*").alias("scanned"), F.count_if(live).alias("reachable"), F.count_if(~live & ~old).alias("tombstoned"), F.count_if(~live & old).alias("deleted"),
        F.coalesce(F.sum(F.when(~live & old, _C("size"))), F.lit(0)).alias("bytes"),
    )


@query("a14_repo_pinned", "SELECT o_custkey, bool_or(o_orderstatus = 'P') AS pinned FROM orders GROUP BY 1")
def a14(t):
    return t.orders.groupBy("o_custkey").agg(F.bool_or(_C("o_orderstatus") == "P").alias("pinned"))


@query(
    "p19_evictable",
    """WITH m AS (SELECT max(o_orderdate) AS now FROM orders), p AS (SELECT *, bool_or(o_orderstatus = 'P') OVER (PARTITION BY o_custkey) AS pinned FROM orders)
    SELECT o_orderkey FROM p, m WHERE NOT pinned AND o_orderpriority <> '5-LOW' AND date_diff('second', o_orderdate, now) >= 30 * 86400""",
)
def p19(t):
    now = t.orders.agg(F.max("o_orderdate").cast("timestamp").alias("now"))
    pinned = t.orders.groupBy("o_custkey").agg(F.bool_or(_C("o_orderstatus") == "P").alias("pinned")).where("NOT pinned").select("o_custkey")
    idle = F.unix_timestamp("now") - F.unix_timestamp(_C("o_orderdate").cast("timestamp"))
    return t.orders.where("o_orderpriority <> '5-LOW'").join(pinned, "o_custkey", "left_semi").join(F.broadcast(now)).where(idle >= 30 * 86400).select("o_orderkey")


@query(
    "w09_budgeted_eviction",
    """WITH c AS (SELECT hash, size, sum(size) OVER (ORDER BY hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS freed FROM objects WHERE hash NOT IN (SELECT hash FROM reachable)), t AS (SELECT sum(size) AS tot FROM objects)
    SELECT hash, size FROM c, t WHERE tot > 50000 AND coalesce(freed, 0) < tot - (50000 * 9) // 10""",
)
def w09(t):
    from tessera.operators.intervals import global_exclusive_sum

    total = t.objects.agg(F.sum("size").alias("tot"))
    cand = global_exclusive_sum(sweep(t.objects, t.reachable), "hash", "size", "freed")
    return cand.join(F.broadcast(total)).where("tot > 50000 AND freed < tot - (50000 * 9) div 10").select("hash", "size")


@query("a06_newest_by_generation", "SELECT o_custkey, o_orderpriority, max(o_orderkey) AS commit_id FROM orders GROUP BY 1, 2")
def a06(t):
    """The fast path: every generation is present and distinct, so the fold is a maximum."""
    return t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.max_by("o_orderkey", "o_orderkey").alias("commit_id"))


def writes(t):
    k = _C("o_orderkey")
    return t.orders.select(
        F.concat_ws("/", "o_custkey", "o_orderpriority").alias("ref"), k.alias("arrival"), (k % 50).cast("string").alias("commit_id"),
        F.when(k % 4 != 0, k % 17).alias("generation"), F.unix_timestamp(_C("o_orderdate").cast("timestamp")).alias("synced_at"),
    )


@query(
    "a06b_newest_wins_fold",
    """WITH RECURSIVE w AS (SELECT o_custkey || '/' || o_orderpriority AS ref, o_orderkey AS arrival, (o_orderkey % 50)::VARCHAR AS c, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 17 END AS gen, epoch(o_orderdate)::BIGINT AS tm,
      row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS rn FROM orders),
    g AS (SELECT ref, rn, c, gen, tm, 1::BIGINT AS landed FROM w WHERE rn = 1 UNION ALL
      SELECT ref, rn, CASE WHEN ok THEN nc ELSE c END, CASE WHEN ok THEN ngen ELSE gen END, CASE WHEN ok THEN ntm ELSE tm END, landed + CASE WHEN ok THEN 1 ELSE 0 END FROM (
        SELECT g.ref, w.rn, g.c, g.gen, g.tm, g.landed, w.c AS nc, w.gen AS ngen, w.tm AS ntm,
          CASE WHEN g.c = w.c THEN true WHEN g.gen IS NOT NULL AND w.gen IS NOT NULL THEN w.gen >= g.gen ELSE w.tm >= g.tm END AS ok FROM g JOIN w ON w.ref = g.ref AND w.rn = g.rn + 1))
    SELECT ref, arg_max(c, rn) AS commit_id, max(landed) AS landed FROM g GROUP BY 1""",
)
def a06b(t):
    """The general rule, in order of arrival: what is stored for each ref in the end."""
    landed = folds.newest_wins(writes(t), "ref", "arrival").where("lands")
    return landed.groupBy("ref").agg(F.max_by("commit_id", "arrival").alias("commit_id"), F.count("*").alias("landed"))


@query("j16_commit_reuse", "SELECT o_orderkey, arg_min(k, k) AS reuse FROM (SELECT a.o_orderkey, b.o_orderkey AS k FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderdate::DATE = b.o_orderdate::DATE AND b.o_orderstatus = 'F') GROUP BY 1")
def j16(t):
    k = F.to_date("o_orderdate").alias("day")
    full = t.orders.where("o_orderstatus = 'F'").groupBy("o_custkey", k).agg(F.min("o_orderkey").alias("reuse"))
    return t.orders.select("o_orderkey", "o_custkey", k).join(full, ["o_custkey", "day"]).select("o_orderkey", "reuse")


@query("w13_first_complete", "SELECT o_custkey, min(o_orderkey) AS first FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def w13(t):
    return t.orders.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"))


@query("j19_added_repos_only", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def j19(t):
    added = t.customer.where("c_mktsegment = 'BUILDING'").select(_C("c_custkey").alias("o_custkey"))
    return t.orders.join(added, "o_custkey", "left_semi").select("o_orderkey")


@query("j21_poll_diff", "SELECT r.o_custkey, max_o AS tip FROM (SELECT o_custkey, max(o_orderkey) AS max_o, min(o_orderkey) AS stored FROM orders GROUP BY 1) r WHERE stored <> max_o AND max_o NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def j21(t):
    r = t.orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("tip"), F.min("o_orderkey").alias("stored")).where("stored <> tip")
    built = t.lineitem.where("l_returnflag = 'R'").select(_C("l_orderkey").alias("tip"))
    return r.join(built, "tip", "left_anti").select("o_custkey", "tip")


@query("j25_enqueue_size", "SELECT coalesce(a.c_custkey, b.o_custkey) AS repo, greatest(nullif(a.s, 0), nullif(b.s, 0)) AS size FROM (SELECT c_custkey, CAST(greatest(floor(c_acctbal), 0) AS BIGINT) AS s FROM customer WHERE c_custkey % 3 <> 0) a FULL JOIN (SELECT o_custkey, count(*) * 100 AS s FROM orders GROUP BY 1) b ON a.c_custkey = b.o_custkey")
def j25(t):
    a = t.customer.where("c_custkey % 3 <> 0").select(_C("c_custkey").alias("repo"), F.greatest(F.floor("c_acctbal"), F.lit(0)).cast("long").alias("a"))
    b = t.orders.groupBy(_C("o_custkey").alias("repo")).agg((F.count("*") * 100).alias("b"))
    return a.join(b, "repo", "full_outer").select("repo", F.greatest(F.nullif("a", F.lit(0)), F.nullif("b", F.lit(0))).alias("size"))


@query("t05_candidates_by_age", "SELECT hash, size FROM objects WHERE hash NOT IN (SELECT hash FROM reachable) ORDER BY size, hash")
def t05(t):
    return sweep(t.objects, t.reachable).orderBy("size", "hash")


@query("t08_added_repos", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY 1")
def t08(t):
    return t.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name").orderBy("c_custkey")


_PASSES = "SELECT l_suppkey AS pass_no, l_partkey AS hash FROM lineitem WHERE l_suppkey <= 10 GROUP BY 1, 2"


@query(
    "x06_orphan_ledger",
    f"""WITH r AS ({_PASSES}), g AS (SELECT DISTINCT hash FROM r), p AS (SELECT hash, pass_no FROM g, (SELECT unnest(range(1, 11)) AS pass_no)),
    s AS (SELECT p.hash, p.pass_no, r.hash IS NOT NULL AS live FROM p LEFT JOIN r ON r.hash = p.hash AND r.pass_no = p.pass_no)
    SELECT hash, min(pass_no) AS first_seen FROM s WHERE NOT live AND pass_no > coalesce((SELECT max(x.pass_no) FROM r x WHERE x.hash = s.hash), 0) GROUP BY 1""",
)
def x06(t):
    """first_seen of what is unreachable at the last of ten passes: the pass after its last reachable one."""
    r = t.lineitem.where("l_suppkey <= 10").select(_C("l_suppkey").alias("pass_no"), _C("l_partkey").alias("hash")).distinct()
    return r.groupBy("hash").agg((F.max("pass_no") + 1).alias("first_seen")).where("first_seen <= 10")


@query("x07_idle_eviction", "SELECT user_id FROM events GROUP BY 1 HAVING date_diff('second', max(ts), (SELECT max(ts) FROM events)) >= 12 * 3600")
def x07(t):
    now = t.events.agg(F.max("ts").cast("timestamp").alias("now"))
    last = t.events.groupBy("user_id").agg(F.max("ts").cast("timestamp").alias("last"))
    return last.join(F.broadcast(now)).where(F.unix_timestamp("now") - F.unix_timestamp("last") >= 12 * 3600).select("user_id")


@query("x08_late_writes", "WITH d AS (SELECT user_id, max(ts) AS deleted_at FROM events WHERE event_type = 'error' GROUP BY 1) SELECT event_id, d.deleted_at IS NULL OR ts > deleted_at OR date_diff('second', deleted_at, (SELECT max(ts) FROM events)) > 6 * 3600 AS lands FROM events LEFT JOIN d USING (user_id) WHERE event_type <> 'error'")
def x08(t):
    ts = _C("ts").cast("timestamp")
    dead = t.events.where("event_type = 'error'").groupBy("user_id").agg(F.max(ts).alias("deleted_at"))
    now = t.events.agg(F.max(ts).alias("now"))
    rows = t.events.where("event_type <> 'error'").select("event_id", "user_id", ts.alias("ts")).join(dead, "user_id", "left").join(F.broadcast(now))
    gone = F.unix_timestamp("now") - F.unix_timestamp("deleted_at") > 6 * 3600
    return rows.select("event_id", (_C("deleted_at").isNull() | (_C("ts") > _C("deleted_at")) | gone).alias("lands"))
