"""Accounting, status, metrics and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalars as f
from tessera.operators import ranks

from .registry import query
from .storage import _TREE, tree

_C = F.col


def unique_bytes(rows, key: str, content: str):
    """Bytes per key, each distinct content counted once; empty content counts nothing."""
    one = rows.groupBy(key, f.content_hash(content).alias("hash")).agg(F.max(f.byte_length(content)).alias("n"))
    return one.groupBy(key).agg(F.sum("n").alias("unique_bytes"))


@query("a01_unique_bytes", "SELECT source, CAST(sum(n) AS BIGINT) AS unique_bytes FROM (SELECT source, sha256(text) AS hash, max(strlen(text)) AS n FROM documents GROUP BY 1, 2) GROUP BY 1")
def a01(t):
    return unique_bytes(t.documents, "source", "text")


@query("a02_logical_bytes", "SELECT o_orderkey AS ref, CAST(sum(p_size) AS BIGINT) AS bytes FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1")
def a02(t):
    return t.chunk_refs.groupBy(_C("manifest").alias("ref")).agg(F.sum("len").alias("bytes"))


@query(
    "a03_amplification",
    "SELECT source, CAST(sum(strlen(text)) FILTER (lang = 'en') AS BIGINT) AS en_bytes, CAST(sum(strlen(text)) FILTER (lang <> 'en') AS BIGINT) AS other_bytes, CASE WHEN sum(n_chars) = 0 THEN 0 ELSE round(sum(strlen(text)) / sum(n_chars), 6) END AS ratio FROM documents GROUP BY 1",
)
def a03(t):
    n = f.byte_length("text")
    ratio = F.when(F.sum("n_chars") == 0, 0.0).otherwise(F.round(F.sum(n) / F.sum("n_chars"), 6))
    return t.documents.groupBy("source").agg(F.sum(F.when(_C("lang") == "en", n)).alias("en_bytes"), F.sum(F.when(_C("lang") != "en", n)).alias("other_bytes"), ratio.alias("ratio"))


@query("a08_counters", "SELECT event_type, count(*) AS n, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total, CAST(sum(CAST(floor(value) AS BIGINT)) // count(*) AS BIGINT) AS average FROM events GROUP BY 1")
def a08(t):
    v = F.floor("value").cast("long")
    rows = t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(v).alias("total"))
    return rows.select("event_type", "n", "total", F.expr("coalesce(total div nullif(n, 0), 0)").alias("average"))


@query("a09_medians", "SELECT event_type, round(median(value), 6) AS med, round(median(value) / quantile_cont(value, 0.25), 6) AS ratio FROM events GROUP BY 1")
def a09(t):
    """By counting, so that no group is held in memory."""
    q = ranks.quantiles(t.events, "event_type", "value", {"med": 0.5, "low": 0.25})
    return q.select("event_type", F.round("med", 6).alias("med"), F.round(F.col("med") / F.col("low"), 6).alias("ratio"))


@query("a10_fragments_by_frame", "SELECT l_partkey AS frame, count(*) AS n, CAST(sum(l_orderkey * 10 + l_linenumber) AS BIGINT) AS digest FROM lineitem GROUP BY 1")
def a10(t):
    """A frame's list is only counted and digested here, so it is never collected."""
    digest = F.sum(_C("l_orderkey") * 10 + _C("l_linenumber"))
    return t.lineitem.groupBy(_C("l_partkey").alias("frame")).agg(F.count("*").cast("int").alias("n"), digest.alias("digest"))


@query("a11_chunk_lengths", "SELECT l_orderkey AS chunk, CAST(max(l_linenumber * 100 + l_quantity) AS BIGINT) AS len FROM lineitem GROUP BY 1")
def a11(t):
    return t.lineitem.groupBy(_C("l_orderkey").alias("chunk")).agg(F.max(_C("l_linenumber") * 100 + _C("l_quantity").cast("long")).alias("len"))


@query("a12_prior_bytes", "SELECT o_custkey, CAST(sum(list_sum([o_orderkey % 7, o_orderkey % 11, 3])) AS BIGINT) AS bytes FROM orders GROUP BY 1")
def a12(t):
    k = _C("o_orderkey")
    packs = F.array(k % 7, k % 11, F.lit(3).cast("long"))
    return t.orders.groupBy("o_custkey").agg(F.sum(F.aggregate(packs, F.lit(0).cast("long"), lambda a, x: a + x)).alias("bytes"))


@query("a15_level_bytes", "SELECT l_returnflag AS level, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS bytes FROM lineitem GROUP BY 1")
def a15(t):
    return t.lineitem.groupBy(_C("l_returnflag").alias("level")).agg(F.sum(_C("l_quantity").cast("long")).alias("bytes"))


@query("a16_throughput", "SELECT event_id, CASE WHEN floor(value) = 0 OR event_id % 9 = 0 THEN 0.0 ELSE round(event_id * 8.0 / floor(value) / 1000, 6) END AS mbps FROM events")
def a16(t):
    ms = F.floor("value")
    return t.events.select("event_id", F.when((ms == 0) | (_C("event_id") % 9 == 0), F.lit(0.0)).otherwise(F.round(_C("event_id") * F.lit(8.0) / ms / 1000, 6)).alias("mbps"))


@query("a17_perf_counters", "SELECT date_trunc('hour', ts) AS batch, count(*) AS n, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1")
def a17(t):
    return t.events.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("batch")).agg(F.count("*").alias("n"), F.sum(F.floor("value").cast("long")).alias("total"))


@query("a18_archive_totals", "SELECT count(*) AS files, count(DISTINCT source) AS frames, CAST(sum(strlen(content)) AS BIGINT) AS raw, count(*) FILTER (content = '') AS empty FROM files_now")
def a18(t):
    return t.files_now.agg(F.count("*").alias("files"), F.count_distinct("source").alias("frames"), F.sum(f.byte_length("content")).alias("raw"), F.count_if(_C("content") == "").alias("empty"))


@query("a19_distinct_keys", "SELECT DISTINCT o_custkey AS repo FROM orders")
def a19(t):
    return t.orders.select(_C("o_custkey").alias("repo")).distinct()


@query("a20_eviction_by_cause", "SELECT CASE WHEN hash % 4 = 0 THEN 'age' ELSE 'size' END AS cause, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM objects WHERE hash NOT IN (SELECT hash FROM reachable) GROUP BY 1")
def a20(t):
    rows = t.objects.join(t.reachable, "hash", "left_anti")
    return rows.groupBy(F.when(_C("hash") % 4 == 0, "age").otherwise("size").alias("cause")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


_SKEL = "s AS (SELECT DISTINCT conv_id, turn, unnest(string_split(text, ' ')) AS obj FROM commits)"


def skeletons(t):
    """(conv_id, turn, obj): the objects of each commit."""
    return t.commits.select("conv_id", "turn", F.explode(F.array_distinct(F.split("text", " "))).alias("obj"))


@query(
    "a21_storage_models",
    f"""WITH {_SKEL}, d AS (SELECT a.* FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.conv_id = a.conv_id AND b.turn = a.turn - 1 AND b.obj = a.obj)),
    t AS (SELECT (SELECT sum(strlen(obj)) FROM (SELECT DISTINCT obj FROM s)) AS unique_once, (SELECT sum(strlen(obj)) FROM s) AS full_each, (SELECT sum(strlen(obj)) FROM d) AS delta_each)
    SELECT CAST(unique_once AS BIGINT) AS unique_once, CAST(full_each AS BIGINT) AS full_each, CAST(delta_each AS BIGINT) AS delta_each, round(full_each / unique_once, 6) AS full_ratio FROM t""",
)
def a21(t):
    """Bytes are raw; each commit is compared with its parent."""
    s = skeletons(t).withColumn("n", F.octet_length("obj").cast("long"))
    prior = skeletons(t).withColumn("turn", _C("turn") + 1)
    once = s.select("obj", "n").distinct().agg(F.sum("n").alias("unique_once"))
    full = s.agg(F.sum("n").alias("full_each"))
    delta = s.join(prior, ["conv_id", "turn", "obj"], "left_anti").agg(F.sum("n").alias("delta_each"))
    return once.join(full).join(delta).withColumn("full_ratio", F.round(_C("full_each") / _C("unique_once"), 6))


@query(
    "a22_skeleton_stats",
    f"""WITH {_SKEL} SELECT a.conv_id, a.turn, count(*) AS objects, count(*) FILTER (NOT EXISTS (SELECT 1 FROM s b WHERE b.conv_id = a.conv_id AND b.turn = a.turn - 1 AND b.obj = a.obj)) AS fresh, round(avg(strlen(obj)), 6) AS avg_size FROM s a GROUP BY 1, 2""",
)
def a22(t):
    s = skeletons(t)
    prior = s.select("conv_id", (_C("turn") + 1).alias("turn"), "obj", F.lit(1).alias("had"))
    j = s.join(prior, ["conv_id", "turn", "obj"], "left")
    return j.groupBy("conv_id", "turn").agg(F.count("*").alias("objects"), F.count_if(_C("had").isNull()).alias("fresh"), F.round(F.avg(F.octet_length("obj")), 6).alias("avg_size"))


@query("a23_access_simulation", f"WITH tree AS ({_TREE}) SELECT count(size) AS found, count(*) - count(size) AS missing, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM (SELECT event_id, user_id FROM events) LEFT JOIN (SELECT * FROM tree WHERE kind = 'blob') ON path = user_id")
def a23(t):
    blobs = tree(t).where("kind = 'blob'").select(_C("path").alias("user_id"), "size")
    j = t.events.select("user_id").join(blobs, "user_id", "left")
    return j.agg(F.count("size").alias("found"), F.count_if(_C("size").isNull()).alias("missing"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


@query("a24_staging_capacity", "SELECT source, CAST(sum(strlen(text)) + sum(strlen(text)) // 3 + 134217728 AS BIGINT) <= 134217728 + 200000 AS fits FROM documents GROUP BY 1")
def a24(t):
    n = F.sum(f.byte_length("text")).alias("n")
    return t.documents.groupBy("source").agg(n).select("source", F.expr("n + n div 3 + 134217728 <= 134217728 + 200000").alias("fits"))


@query("w00_dedup_ratio", "SELECT source, count(*) AS files, count(DISTINCT sha256(text)) AS distinct_files FROM documents GROUP BY 1")
def w00(t):
    return t.documents.groupBy("source").agg(F.count("*").alias("files"), F.count_distinct(f.content_hash("text")).alias("distinct_files"))
