"""Content-addressed storage, scans and codecs (S*, Y*, F1-F3, F18-F20)."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import functions as F

from tessera.functions import scalars as f
from tessera import api
from tessera.operators import chunking, fetch, intervals
from tessera.operators.intervals import global_exclusive_sum
from tessera.sources.chunk_table import ChunkTable
from tessera.sources.object_index import ObjectIndex
from tessera.streaming.sink import shared_folder

from .registry import query


@query("s01_cas_put", "SELECT sha256(content) AS hash, CAST(max(strlen(content)) AS BIGINT) AS size, count(*) AS refs FROM files_now GROUP BY 1")
def s01(t):
    return t.files_now.groupBy(f.content_hash("content").alias("hash")).agg(F.max(f.byte_length("content")).alias("size"), F.count("*").alias("refs"))


@query(
    "s02_range_get",
    """SELECT doc_id, CASE WHEN strlen(text) >= 150 THEN substr(hex(encode(text)), 2 * 100 + 1, 2 * 50) END AS slice_hex FROM documents""",
)
def s02(t):
    part = F.hex(F.substring(F.col("text").cast("binary"), 101, 50))
    return t.documents.select("doc_id", F.when(F.octet_length("text") >= 150, part).alias("slice_hex"))


_STORED = "SELECT doc_id, sha256(text) AS hash, CASE WHEN doc_id % 97 = 0 THEN text || '#x' ELSE text END AS content FROM documents"


@query("s03_cas_verify", f"WITH stored AS ({_STORED}) SELECT doc_id, hash FROM stored WHERE sha256(content) <> hash")
def s03(t):
    content = F.when(F.col("doc_id") % 97 == 0, F.concat("text", F.lit("#x"))).otherwise(F.col("text"))
    stored = t.documents.select("doc_id", f.content_hash("text").alias("hash"), content.alias("content"))
    return stored.where(f.content_hash("content") != F.col("hash")).select("doc_id", "hash")


_NAMES = "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'tmp-' || doc_id WHEN doc_id % 5 = 0 THEN sha1(text) ELSE sha256(text) END AS name, strlen(text) AS size FROM documents"


@query("s04_cas_inventory", f"WITH n AS ({_NAMES}) SELECT name AS hash, CAST(max(size) AS BIGINT) AS size FROM n WHERE length(name) IN (40, 64) GROUP BY 1")
def s04(t):
    d = F.col("doc_id")
    name = F.when(d % 7 == 0, F.concat(F.lit("tmp-"), d)).when(d % 5 == 0, F.sha1("text")).otherwise(f.content_hash("text"))
    rows = t.documents.select(name.alias("hash"), f.byte_length("text").alias("size"))
    return rows.where(F.length("hash").isin(40, 64)).groupBy("hash").agg(F.max("size").alias("size"))


@query("s07_ref_status", "SELECT o_custkey AS repo, count(*) AS branches, max(o_orderdate) AS newest FROM orders GROUP BY 1")
def s07(t):
    return t.orders.groupBy(F.col("o_custkey").alias("repo")).agg(F.count("*").alias("branches"), F.max("o_orderdate").alias("newest"))


@query("s08_queue_depth", "SELECT kind AS status, count(*) AS n, min(id) AS oldest FROM jobs GROUP BY 1")
def s08(t):
    return t.jobs.groupBy(F.col("kind").alias("status")).agg(F.count("*").alias("n"), F.min("id").alias("oldest"))


_TREE = "SELECT doc_id AS path, CASE WHEN doc_id % 13 = 0 THEN 'tree' WHEN doc_id % 17 = 0 THEN 'commit' ELSE 'blob' END AS kind, CASE WHEN doc_id % 13 = 0 THEN 16384 WHEN doc_id % 17 = 0 THEN 57344 WHEN doc_id % 11 = 0 THEN 40960 WHEN doc_id % 7 = 0 THEN 33261 ELSE 33188 END AS mode, sha1(text) AS oid, CAST(strlen(text) AS BIGINT) AS size FROM documents"


def tree(t):
    """documents as tree entries (path, kind, mode, oid, size)."""
    d = F.col("doc_id")
    kind = F.when(d % 13 == 0, "tree").when(d % 17 == 0, "commit").otherwise("blob")
    mode = F.when(d % 13 == 0, 16384).when(d % 17 == 0, 57344).when(d % 11 == 0, 40960).when(d % 7 == 0, 33261).otherwise(33188)
    return t.documents.select(d.alias("path"), kind.alias("kind"), mode.alias("mode"), F.sha1("text").alias("oid"), f.byte_length("text").alias("size"))


@query("s11_tree_scan", f"WITH tree AS ({_TREE}) SELECT path, mode, oid, kind FROM tree WHERE kind NOT IN ('tree', 'commit')")
def s11(t):
    return tree(t).where(~F.col("kind").isin("tree", "commit")).select("path", "mode", "oid", "kind")


@query("s12_ordered_scan", f"WITH tree AS ({_TREE}) SELECT path, oid, mode, row_number() OVER (ORDER BY path) AS pos FROM tree WHERE kind = 'blob'")
def s12(t):
    rows = tree(t).where("kind = 'blob'").select("path", "oid", "mode", F.lit(1).alias("one"))
    return global_exclusive_sum(rows, "path", "one", "before").select("path", "oid", "mode", (F.col("before") + 1).alias("pos"))


@query("s13_path_sizes", f"WITH tree AS ({_TREE}) SELECT path, size FROM tree WHERE kind = 'blob'")
def s13(t):
    return tree(t).where("kind = 'blob'").select("path", "size")


@query("s14_object_lookup", "SELECT l_orderkey, l_linenumber, p_size AS size, p_type AS kind FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_partkey % 5 <> 0")
def s14(t):
    known = t.part.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("size"), F.col("p_type").alias("kind"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey").join(known, "l_partkey", "left").select("l_orderkey", "l_linenumber", "size", "kind")


@query("s15_single_path", f"WITH tree AS ({_TREE}) SELECT path, mode, oid, size FROM tree WHERE path = 42")
def s15(t):
    return tree(t).where("path = 42").select("path", "mode", "oid", "size")


@query(
    "s16_webhook_parse",
    """SELECT event_id, CASE event_type WHEN 'purchase' THEN 'push' WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'ignored' END AS kind,
       CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events""",
)
def s16(t):
    kind = F.col("event_type")
    kind = F.when(kind == "purchase", "push").when(kind == "signup", "create").when(kind == "error", "delete").otherwise("ignored")
    return t.events.select("event_id", kind.alias("kind"), F.from_json("props", "k int").getField("k").alias("k"))


@query("s17_manifest_codec", "SELECT l_orderkey AS manifest, l_linenumber AS frame_index, l_partkey AS hash, CAST(l_quantity AS BIGINT) AS raw_len FROM lineitem")
def s17(t):
    """Manifests with their frames are written as nested Parquet, read back and laid out again."""
    item = F.struct(F.col("l_linenumber").alias("frame_index"), F.col("l_partkey").alias("hash"), F.col("l_quantity").cast("long").alias("raw_len"))
    nested = t.lineitem.groupBy(F.col("l_orderkey").alias("manifest")).agg(F.array_sort(F.collect_list(item)).alias("frames"))
    path = f"{shared_folder(t.spark)}/manifests-{uuid.uuid4().hex[:12]}"
    nested.write.parquet(path)
    return t.spark.read.schema(nested.schema).parquet(path).select("manifest", F.inline("frames"))


@query(
    "s21_metrics_text",
    """SELECT 'queue_events_total{kind="' || event_type || '"} ' || count(*) AS line FROM events GROUP BY event_type
       UNION ALL SELECT '# HELP queue_events_total Events by kind.' AS line""",
)
def s21(t):
    rows = t.events.groupBy("event_type").count().select(F.format_string('queue_events_total{kind="%s"} %d', "event_type", "count").alias("line"))
    return rows.unionByName(t.spark.range(1).select(F.lit("# HELP queue_events_total Events by kind.").alias("line")))


@query(
    "f18_pack_varint",
    """WITH d AS (SELECT doc_id, doc_id % 4 + 1 AS kind, CAST(strlen(text) AS BIGINT) * (1 + doc_id % 5000) AS size FROM documents),
    g AS (SELECT *, list_filter(range(0, 9), lambda i: size // 16 > 0 AND (i = 0 OR (size // 16) >> (7 * i)::INT > 0)) AS g FROM d)
    SELECT doc_id, format('{:02X}', kind * 16 + size % 16 + CASE WHEN size >= 16 THEN 128 ELSE 0 END) || coalesce(list_aggregate(list_transform(g, lambda i: format('{:02X}', (((size // 16) >> (7 * i)::INT) & 127) + CASE WHEN i + 1 < len(g) THEN 128 ELSE 0 END)), 'string_agg', ''), '') AS header,
      CAST(kind AS INT) AS kind, size FROM g""",
)
def f18(t):
    kind, size = F.col("doc_id") % 4 + 1, f.byte_length("text") * (1 + F.col("doc_id") % 5000)
    entries = t.documents.select("doc_id", F.concat(f.pack_header(kind, size), F.encode("text", "UTF-8")).alias("entry"), f.pack_header(kind, size).alias("head"))
    read = entries.select("doc_id", F.hex("head").alias("header"), f.read_pack_header(F.col("entry")).alias("h"))
    return read.select("doc_id", "header", F.col("h.kind").alias("kind"), F.col("h.size").alias("size"))


#: Hashes of all places, boundaries of both kinds, and chunks one after another.
_CDC = f"""WITH RECURSIVE k AS (SELECT {[int(x) for x in chunking._GEAR]}::UBIGINT[] AS gear),
    b AS (SELECT doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS x FROM documents),
    v AS (SELECT doc_id, x, len(x) // 2 AS n, list_transform(regexp_extract_all(x, '..'), lambda y: gear[16 * instr('0123456789ABCDEF', left(y, 1)) + instr('0123456789ABCDEF', right(y, 1)) - 16]::HUGEINT) AS g FROM b, k),
    h0 AS (SELECT doc_id, x, n, list_transform(range(1, n + 1), lambda i: (g[i] + CASE WHEN i > 1 THEN g[i - 1] * 2::HUGEINT ELSE 0 END) % 18446744073709551616) AS g FROM v),
    h1 AS (SELECT doc_id, x, n, list_transform(range(1, n + 1), lambda i: (g[i] + CASE WHEN i > 2 THEN g[i - 2] * 4::HUGEINT ELSE 0 END) % 18446744073709551616) AS g FROM h0),
    h2 AS (SELECT doc_id, x, n, list_transform(range(1, n + 1), lambda i: (g[i] + CASE WHEN i > 4 THEN g[i - 4] * 16::HUGEINT ELSE 0 END) % 18446744073709551616) AS g FROM h1),
    h3 AS (SELECT doc_id, x, n, list_transform(range(1, n + 1), lambda i: (g[i] + CASE WHEN i > 8 THEN g[i - 8] * 256::HUGEINT ELSE 0 END) % 18446744073709551616) AS g FROM h2),
    h4 AS (SELECT doc_id, x, n, list_transform(range(1, n + 1), lambda i: (g[i] + CASE WHEN i > 16 THEN g[i - 16] * 65536::HUGEINT ELSE 0 END) % 18446744073709551616) AS g FROM h3),
    h AS (SELECT doc_id, x, n, list_transform(g, lambda y: y // 1099511627776) AS h FROM h4),
    c AS MATERIALIZED (SELECT doc_id, x, n, list_filter(range(1, n + 1), lambda i: h[i] % 4096 = 0) AS rare, list_filter(range(1, n + 1), lambda i: h[i] % 256 = 0) AS common FROM h),
    r AS (SELECT doc_id, -1 AS chunk_index, 0::BIGINT AS chunk_offset, 0::BIGINT AS stop FROM c WHERE n > 0 UNION ALL
      SELECT r.doc_id, chunk_index + 1, stop, least(coalesce(list_min(list_filter(rare, lambda e: e >= stop + 256 AND e < stop + 1024)), list_min(list_filter(common, lambda e: e >= stop + 1024)), n), stop + 4096, n)
      FROM r JOIN c USING (doc_id) WHERE stop < n)
    SELECT doc_id, chunk_index, chunk_offset, (stop - chunk_offset)::INT AS raw_len, sha256(from_hex(x[2 * chunk_offset + 1:2 * stop])) AS raw_hash FROM r JOIN c USING (doc_id) WHERE chunk_index >= 0"""


@query("f19_content_chunks", _CDC)
def f19(t):
    return chunking.chunks(t.documents, "doc_id", "text")


@query("f20_zstd_frames")
def f20(t):
    return chunking.zstd_lengths(t.documents, "doc_id", "text")


@query("y01_process_batches", "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS raw_len, sha256(text) AS hash FROM documents")
def y01(t):
    return t.documents.select("doc_id", f.byte_length("text").alias("raw_len"), F.sha2("text", 256).alias("hash"))


@query("y02_ordered_map", "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos, CAST(strlen(text) AS BIGINT) AS n FROM documents")
def y02(t):
    """What is done to the items is done anywhere; each keeps its place in its source's order, which a range sum gives for all sources
    at once, so a large source is no task of its own."""
    rows = t.documents.select("source", "doc_id", f.byte_length("text").alias("n"))
    return intervals.positions(rows, "source", "doc_id", "pos").select("doc_id", "pos", "n")


@query("s06_delete_batches", "SELECT hash, (row_number() OVER (ORDER BY hash) - 1) // 1000 AS batch FROM objects WHERE hash NOT IN (SELECT hash FROM reachable)")
def s06(t):
    """Orphans in delete requests of 1000."""
    rows = t.objects.join(t.reachable, "hash", "left_anti").select("hash", F.lit(1).alias("one"))
    return global_exclusive_sum(rows, "hash", "one", "before").select("hash", F.expr("before div 1000").alias("batch"))


@query("s19_requested_paths", f"WITH tree AS ({_TREE}) SELECT path, size FROM (SELECT DISTINCT user_id FROM events) JOIN tree ON path = user_id WHERE kind = 'blob' ORDER BY path LIMIT 1000")
def s19(t):
    """What one request may ask for: the first 1000 paths that exist."""
    asked = t.events.select(F.col("user_id").alias("path")).distinct()
    return tree(t).where("kind = 'blob'").join(asked, "path", "left_semi").select("path", "size").orderBy("path").limit(1000)


@query("y03_chunk_fetch", "SELECT l_orderkey, l_linenumber, l_partkey, sha256(substr(repeat(sha256(CAST(l_partkey AS VARCHAR)), 4), 2 * (l_linenumber * 7) + 1, 2 * (1 + l_quantity::BIGINT % 32)::BIGINT)) AS part FROM lineitem")
def y03(t):
    """Ranges read through a caller's function; here a chunk is four times the digest of its number."""

    def read(chunk, first, end):
        return (hashlib.sha256(str(chunk).encode()).digest() * 4)[first:end]

    want = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_linenumber") * 7).cast("long").alias("at"), (1 + F.col("l_quantity").cast("long") % 32).alias("n"))
    got = fetch.fetched(want, read, "l_partkey", "at", "n")
    return got.select("l_orderkey", "l_linenumber", "l_partkey", F.sha2(F.lower(F.hex("content")), 256).alias("part"))


@query("y03s_chunk_store", "SELECT sha256(p_name) AS hash, CAST(max(strlen(p_name)) AS BIGINT) AS size FROM part GROUP BY 1")
def y03s(t):
    """Chunks put into a table by hash in two writes that overlap, read back and verified."""
    store = ChunkTable(t.spark, f"{shared_folder(t.spark)}/chunks-{uuid.uuid4().hex[:12]}")
    store.put(t.part.where("p_partkey % 3 <> 0"), "p_name")
    store.put(t.part, "p_name")
    return store.rows().join(store.corrupt(), "hash", "left_anti").select("hash", "size")


@query(
    "s02t_stored_ranges",
    "SELECT p_partkey, sha256(p_name) AS hash, sha256(substr(hex(encode(p_name)), 2 * (p_partkey % 5)::BIGINT + 1, 2 * (1 + p_partkey % 4)::BIGINT)) AS part FROM part WHERE p_partkey % 7 = 0 AND strlen(p_name) >= 9",
)
def s02t(t):
    """Byte ranges of stored chunks, by hash."""
    store = ChunkTable(t.spark, f"{shared_folder(t.spark)}/chunks-{uuid.uuid4().hex[:12]}")
    store.put(t.part, "p_name")
    k = F.col("p_partkey")
    wanted = t.part.where("p_partkey % 7 = 0 AND octet_length(p_name) >= 9").select("p_partkey", f.content_hash("p_name").alias("hash"), (k % 5).alias("at"), (1 + k % 4).alias("n"))
    return store.ranges(wanted, "hash", "at", "n").select("p_partkey", "hash", F.sha2(F.hex("part"), 256).alias("part"))


@query("s14t_index_lookup", "SELECT o_orderkey, o_custkey AS oid, (SELECT min(l_suppkey) FROM lineitem WHERE l_partkey = o_custkey) AS pack FROM orders")
def s14t(t):
    """Objects looked up in a stored, bucketed multi-pack index."""
    index = ObjectIndex.build(t.lineitem.select(F.col("l_partkey").alias("oid"), F.col("l_suppkey").alias("pack")))
    return index.lookup(t.orders.select("o_orderkey", F.col("o_custkey").alias("oid"))).select("o_orderkey", "oid", "pack")


@query("y04_stores", "SELECT hash, size, coalesce(first_seen, 5000) AS first_seen, CASE WHEN coalesce(first_seen, 5000) + 100 <= 5000 THEN 'delete' ELSE 'keep' END AS fate FROM objects LEFT JOIN (SELECT p_partkey AS hash, 4850 + p_partkey % 100 AS first_seen FROM part WHERE p_partkey % 3 = 0) USING (hash) WHERE hash NOT IN (SELECT hash FROM reachable)")
def y04(t):
    """A caller's stores in place of the tables."""
    k = F.col("p_partkey")
    stores = api.Frames(objects=t.objects, references=t.reachable.select(F.lit("r").alias("ref"), "hash"))
    ledger = t.part.where(k % 3 == 0).select(k.alias("hash"), (F.lit(4850) + k % 100).cast("long").alias("first_seen"))
    return api.garbage(stores, stores, ledger, 5000, 100)


@query("y05_sync_plan", "WITH n AS (SELECT n.content FROM snap_new n LEFT JOIN snap_old o USING (doc_id) WHERE o.doc_id IS NULL OR o.content <> n.content) SELECT sha256(content) AS hash, CAST(max(strlen(content)) AS BIGINT) AS size FROM n WHERE strlen(content) > 0 AND sha256(content) NOT IN (SELECT sha256(content) FROM snap_old) GROUP BY 1")
def y05(t):
    return api.sync_plan(t.snap_old, t.snap_new, t.snap_old.select(f.content_hash("content").alias("hash")), "doc_id", "content")


@query("y05b_next_jobs", "WITH j AS (SELECT id, size % 3 AS class, ts FROM jobs WHERE kind = 'view'), w AS (SELECT c_custkey AS worker, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey % 3 END AS ceiling FROM customer) SELECT worker, arg_min(id, (ts, id)) AS id FROM w JOIN j ON ceiling IS NULL OR class <= ceiling GROUP BY 1")
def y05b(t):
    jobs = t.jobs.select("id", "key", F.when(F.col("kind") == "view", "queued").otherwise("done").alias("status"), (F.col("size") % 3).alias("class"), F.col("ts").alias("created_at"))
    c = F.col("c_custkey")
    return api.next_jobs(api.Frames(jobs=jobs), t.customer.select(c.alias("worker"), F.when(c % 4 != 0, c % 3).alias("ceiling")))
