"""Snapshot diffs, interval joins, packing inputs and graph closures (J4-J10, J13-J24, U*, W1-W8, W12, T*, G*)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import scalars as f
from tessera.operators import batches, folds, graph, intervals, merkle
from tessera.operators.steps import written

from .registry import query
from .storage import _TREE, tree

_C = F.col
WIDTH = 4096


@query("j04_incremental_files", "SELECT n.doc_id, coalesce(CASE WHEN o.content = n.content THEN sha1(o.content) END, sha1(n.content)) AS blob, CASE WHEN o.content = n.content THEN 1 ELSE 0 END AS reused FROM snap_new n LEFT JOIN snap_old o USING (doc_id)")
def j04(t):
    old = t.snap_old.select("doc_id", _C("content").alias("was"), F.sha1("content").alias("prior"))
    same = _C("was") == _C("content")
    return t.snap_new.join(old, "doc_id", "left").select("doc_id", F.when(same, _C("prior")).otherwise(F.sha1("content")).alias("blob"), F.when(same, 1).otherwise(0).alias("reused"))


@query("j05_chunk_reuse", "SELECT n.doc_id, o.hash IS NULL AS is_new FROM snap_new n LEFT JOIN (SELECT DISTINCT sha256(content) AS hash FROM snap_old) o ON sha256(n.content) = o.hash")
def j05(t):
    old = t.snap_old.select(f.content_hash("content").alias("raw_hash"), F.lit(True).alias("known")).distinct()
    return t.snap_new.select("doc_id", f.content_hash("content").alias("raw_hash")).join(old, "raw_hash", "left").select("doc_id", _C("known").isNull().alias("is_new"))


def diff(old, new):
    """(doc_id, change) of two snapshots. Rows meet by 128-bit digests, so no content is shuffled."""
    said = lambda x, c: x.select("doc_id", F.struct(*[v.alias(k) for k, v in merkle.digest("doc_id", "content").items()]).alias(c))
    j = said(old, "o").join(said(new, "n"), "doc_id", "full_outer")
    change = F.when(_C("o").isNull(), "added").when(_C("n").isNull(), "deleted").when(_C("o") == _C("n"), "same").otherwise("modified")
    return j.select("doc_id", change.alias("change"))


_DIFF = "SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'deleted' WHEN o.content = n.content THEN 'same' ELSE 'modified' END AS change FROM snap_old o FULL JOIN snap_new n USING (doc_id)"


@query("j06_snapshot_diff", _DIFF)
def j06(t):
    return diff(t.snap_old, t.snap_new)


def trees(t):
    """Both snapshots as stored trees, 16 documents to a finest prefix and 16 prefixes to the next."""
    prefixes = [lambda k, b=b: F.shiftright(k, b) for b in (12, 8, 4)]
    return [merkle.stored(x, "doc_id", "content", prefixes) for x in (t.snap_old, t.snap_new)]


@query("j06t_subtree_diff", f"SELECT doc_id, change FROM ({_DIFF}) WHERE change <> 'same'")
def j06t(t):
    """Only subtrees whose digests differ are looked into."""
    return merkle.changes(*trees(t)).withColumnRenamed("key", "doc_id")


def stream(t):
    """The path-ordered byte stream: doc_id, start, len."""
    rows = t.files_now.select("doc_id", f.byte_length("content").alias("len"))
    return intervals.global_exclusive_sum(rows, "doc_id", "len")


_STREAM = "SELECT doc_id, CAST(strlen(content) AS BIGINT) AS len, CAST(coalesce(sum(strlen(content)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM files_now"
_FRAMES = f"SELECT i AS frame, i * {WIDTH} AS fs, least((i + 1) * {WIDTH}, total) AS fe FROM (SELECT sum(len)::BIGINT AS total FROM p), LATERAL (SELECT unnest(range(0, (total + {WIDTH - 1}) // {WIDTH})) AS i)"


def frames(p):
    """Fixed-width frames over a stream (start, len): frame, fs, fe and ``key`` columns of the file that each begins in."""
    total = p.agg(F.sum("len").alias("total"))
    begun = F.sequence(F.expr(f"(start + {WIDTH - 1}) div {WIDTH}"), F.expr(f"(start + len - 1) div {WIDTH}"))
    rows = p.where(f"len > 0 AND (start + {WIDTH - 1}) div {WIDTH} <= (start + len - 1) div {WIDTH}").withColumn("frame", F.explode(begun))
    ends = {"fs": _C("frame") * WIDTH, "fe": F.least((_C("frame") + 1) * WIDTH, "total")}
    return rows.join(F.broadcast(total)).withColumns(ends).drop("total")  # one row


def fragments(p):
    """Overlaps of the files of a stream (start, len > 0) with fixed-width frames, by arithmetic: adds frame, frame_offset, raw_len."""
    touched = F.sequence(F.expr(f"start div {WIDTH}"), F.expr(f"(start + len - 1) div {WIDTH}"))
    rows = p.where("len > 0").withColumn("frame", F.explode(touched)).withColumn("fs", _C("frame") * WIDTH)
    at, end = F.greatest("start", "fs"), F.least(_C("start") + _C("len"), _C("fs") + WIDTH)
    return rows.withColumns({"frame_offset": at - _C("fs"), "raw_len": end - at}).drop("fs")


@query("w01_prefix_offsets", f"SELECT doc_id, start AS byte_start FROM ({_STREAM})")
def w01(t):
    return stream(t).select("doc_id", _C("start").alias("byte_start"))


@query("w02_bundle_offsets", "SELECT l_orderkey, l_linenumber, CAST(coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS idx_offset FROM lineitem")
def w02(t):
    n = _C("l_quantity").cast("long")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", n.alias("n"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("o"))
    return rows.select("l_orderkey", "l_linenumber", intervals.exclusive_sum("n", "o", "l_orderkey").alias("idx_offset"))


@query(
    "j07_fragments",
    f"""WITH p AS ({_STREAM}), fr AS ({_FRAMES})
    SELECT doc_id, frame, greatest(start, fs) - fs AS frame_offset, least(start + len, fe) - greatest(start, fs) AS raw_len FROM p JOIN fr ON start < fe AND start + len > fs WHERE len > 0
    UNION ALL SELECT doc_id, CASE WHEN start >= (SELECT max(fe) FROM fr) THEN (SELECT max(frame) FROM fr) ELSE start // {WIDTH} END,
      start - CASE WHEN start >= (SELECT max(fe) FROM fr) THEN (SELECT max(fs) FROM fr) ELSE start // {WIDTH} * {WIDTH} END, 0 FROM p WHERE len = 0""",
)
def j07(t):
    p = stream(t)
    cols = ("doc_id", "frame", "frame_offset", "raw_len")
    last = p.agg(F.sum("len").alias("le")).select("le", F.expr(f"greatest(le - 1, 0) div {WIDTH}").alias("lf"))
    empty = p.where("len = 0").join(F.broadcast(last))  # one row
    empty = empty.withColumn("frame", F.when(_C("start") >= _C("le"), _C("lf")).otherwise(F.expr(f"start div {WIDTH}")))
    return fragments(p).select(*cols).unionByName(empty.select("doc_id", "frame", (_C("start") - _C("frame") * WIDTH).alias("frame_offset"), _C("len").alias("raw_len")))


_RUNS = f"""d AS ({_DIFF}), m AS (SELECT d.doc_id, change = 'same' AS same, CAST(strlen(o.content) AS BIGINT) AS ol, CAST(strlen(n.content) AS BIGINT) AS nl FROM d LEFT JOIN snap_old o USING (doc_id) LEFT JOIN snap_new n USING (doc_id)),
  s AS (SELECT doc_id, same, coalesce(ol, 0) AS ol, coalesce(nl, 0) AS nl, CAST(coalesce(sum(ol) OVER w, 0) AS BIGINT) AS os, CAST(coalesce(sum(nl) OVER w, 0) AS BIGINT) AS ns FROM m WINDOW w AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  g AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS grp FROM s),
  seg AS (SELECT min(os) AS old_start, max(os + ol) AS old_end, min(ns) - min(os) AS shift FROM g WHERE same GROUP BY grp HAVING max(os + ol) > min(os))"""


def aligned(t):
    """The files of both snapshots by path: doc_id, same, ol, nl (bytes, 0 where absent), os, ns (bytes before), grp (changes before).

    Digests and lengths meet, not contents, and the meeting is written, since bounds, totals and sums all read it.
    """
    own = lambda x, s: x.select("doc_id", F.struct(*[v.alias(k) for k, v in merkle.digest("doc_id", "content").items()]).alias(s), F.coalesce(f.byte_length("content"), F.lit(0)).alias(f"{s}l"))
    m = own(t.snap_old, "o").join(own(t.snap_new, "n"), "doc_id", "full_outer")
    m = m.select("doc_id", F.coalesce(_C("o") == _C("n"), F.lit(False)).alias("same"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("ol", "nl")])
    m = written(m.withColumn("brk", F.when(_C("same"), 0).otherwise(1)), "aligned")
    return intervals.global_exclusive_sum(m, "doc_id", ["ol", "nl", "brk"], ["os", "ns", "grp"])


def segments(m):
    """Maximal unchanged runs of the path-ordered streams: grp, old_start, old_end, shift."""
    g = m.where("same").groupBy("grp").agg(F.min("os").alias("old_start"), F.max(_C("os") + _C("ol")).alias("old_end"), (F.min("ns") - F.min("os")).alias("shift"))
    return g.where("old_end > old_start")


@query("w06_unchanged_runs", f"WITH {_RUNS} SELECT old_start, old_end, shift FROM seg")
def w06(t):
    return segments(aligned(t)).select("old_start", "old_end", "shift")


_OLD = "p AS (SELECT doc_id, CAST(strlen(content) AS BIGINT) AS len FROM snap_old)"


@query("j08_frame_containment", f"WITH {_RUNS}, {_OLD}, fr AS ({_FRAMES}) SELECT frame, fs + shift AS new_start FROM fr JOIN seg ON fs >= old_start AND fe <= old_end AND (old_start = 0 OR fs >= old_start + 8192)")
def j08(t):
    """A frame can lie in a run only if the file that it begins in belongs to it, so the run's number is the join key."""
    m = written(aligned(t), "sums")
    fr = frames(m.select("same", "grp", _C("os").alias("start"), _C("ol").alias("len"))).where("same")
    hit = fr.join(segments(m), "grp").where("fs >= old_start AND fe <= old_end AND (old_start = 0 OR fs >= old_start + 8192)")
    return hit.select("frame", (_C("fs") + _C("shift")).alias("new_start"))


@query(
    "j09_gap_bytes",
    f"""WITH {_RUNS}, q AS (SELECT doc_id, content, CAST(strlen(content) AS BIGINT) AS len, CAST(coalesce(sum(strlen(content)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS st FROM snap_new),
    gap AS (SELECT old_end + shift AS gs, lead(old_start + shift, 1, (SELECT sum(strlen(content)) FROM snap_new)::BIGINT) OVER (ORDER BY old_start) AS ge FROM seg)
    SELECT doc_id, greatest(gs, st) AS at, CAST(least(ge, st + len) - greatest(gs, st) AS BIGINT) AS n, sha256(content[1:0] || substr(hex(encode(content)), 2 * (greatest(gs, st) - st)::BIGINT + 1, 2 * (least(ge, st + len) - greatest(gs, st))::BIGINT)) AS part FROM q JOIN gap ON gs < st + len AND ge > st AND gs < ge WHERE len > 0""",
)
def j09(t):
    m = written(aligned(t), "sums")
    total = m.agg(F.sum("nl").alias("total"))
    seg = segments(m).select("old_start", (_C("old_end") + _C("shift")).alias("gs"), (_C("old_start") + _C("shift")).alias("at"))
    gap = intervals.global_lead(seg, "old_start", "at", "next").join(F.broadcast(total))  # one row
    gap = gap.select("gs", F.coalesce("next", "total").alias("ge"))
    q = m.select("doc_id", _C("ns").alias("st"), (_C("ns") + _C("nl")).alias("en"))
    hit = intervals.overlap_join(q, gap, "st", "en", "gs", "ge", 65536).join(t.snap_new, "doc_id")
    at, end = F.greatest("gs", "st"), F.least("ge", "en")
    part = F.substring(_C("content").cast("binary"), (at - _C("st") + 1).cast("int"), (end - at).cast("int"))
    return hit.select("doc_id", at.alias("at"), (end - at).alias("n"), F.sha2(F.hex(part), 256).alias("part"))


@query("j10_blob_paths", "SELECT sha1(text) AS blob, doc_id AS path, count(*) OVER (PARTITION BY sha1(text)) AS n_paths FROM documents")
def j10(t):
    rows = t.documents.select(F.sha1("text").alias("blob"), _C("doc_id").alias("path"))
    return rows.join(rows.groupBy("blob").agg(F.count("*").alias("n_paths")), "blob")


@query("j13_head_delta", "SELECT DISTINCT sha1(content) AS oid FROM snap_new WHERE sha1(content) NOT IN (SELECT sha1(content) FROM snap_old)")
def j13(t):
    return t.snap_new.select(F.sha1("content").alias("oid")).distinct().join(t.snap_old.select(F.sha1("content").alias("oid")), "oid", "left_anti")


@query("j14_history", "SELECT DISTINCT sha1(text) AS oid FROM documents WHERE sha1(text) NOT IN (SELECT sha1(content) FROM snap_new)")
def j14(t):
    return t.documents.select(F.sha1("text").alias("oid")).distinct().join(t.snap_new.select(F.sha1("content").alias("oid")), "oid", "left_anti")


@query("j17_pack_idx_pairs", "SELECT coalesce(a.doc_id, b.doc_id) AS stem, a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL AS paired FROM (SELECT doc_id FROM documents WHERE doc_id % 9 <> 0) a FULL JOIN (SELECT doc_id FROM documents WHERE doc_id % 8 <> 0) b ON a.doc_id = b.doc_id")
def j17(t):
    pack = t.documents.where("doc_id % 9 <> 0").select(_C("doc_id").alias("stem"), F.lit(True).alias("p"))
    idx = t.documents.where("doc_id % 8 <> 0").select(_C("doc_id").alias("stem"), F.lit(True).alias("i"))
    return pack.join(idx, "stem", "full_outer").select("stem", (_C("p").isNotNull() & _C("i").isNotNull()).alias("paired"))


@query("j18_manifest_chunks", "SELECT DISTINCT o_orderkey AS manifest, unnest(list_filter([sha1(CAST(o_orderkey AS VARCHAR)), CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'idx' || o_custkey END, 'meta' || o_custkey], lambda x: x <> '')) AS hash FROM orders")
def j18(t):
    k = _C("o_orderkey")
    refs = F.array(F.sha1(k.cast("string")), F.when(k % 2 == 0, "").otherwise(F.concat(F.lit("idx"), "o_custkey")), F.concat(F.lit("meta"), "o_custkey"))
    return t.orders.select(k.alias("manifest"), F.explode(F.array_distinct(F.filter(refs, lambda x: x != ""))).alias("hash"))


@query("j20_slice_verify", "SELECT doc_id, doc_id % 6 <> 0 AS ok FROM documents WHERE strlen(text) >= 64")
def j20(t):
    bundle = t.documents.where(F.octet_length("text") >= 64).select("doc_id", _C("text").cast("binary").alias("b"), (_C("doc_id") % 16 + 1).cast("int").alias("at"))
    good = F.sha2(F.substring("b", _C("at"), F.lit(32)), 256)
    rows = bundle.select("doc_id", "b", "at", F.when(_C("doc_id") % 6 == 0, F.reverse(good)).otherwise(good).alias("hash"))
    return rows.select("doc_id", (F.sha2(F.substring("b", _C("at"), F.lit(32)), 256) == _C("hash")).alias("ok"))


@query("j22_index_refresh", "SELECT n.doc_id, coalesce(strlen(o.content), strlen(n.content))::BIGINT AS size, o.doc_id IS NOT NULL AS cached FROM snap_new n LEFT JOIN snap_old o USING (doc_id)")
def j22(t):
    cache = t.snap_old.select("doc_id", f.byte_length("content").alias("c"))
    return t.snap_new.select("doc_id", f.byte_length("content").alias("n")).join(cache, "doc_id", "left").select("doc_id", F.coalesce("c", "n").alias("size"), _C("c").isNotNull().alias("cached"))


@query("j23_index_sizes", "SELECT l_orderkey, l_linenumber, p_size FROM lineitem JOIN part ON l_partkey = p_partkey")
def j23(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", _C("l_partkey").alias("p_partkey")).join(t.part.select("p_partkey", "p_size"), "p_partkey", "left")
    must = F.when(_C("p_size").isNull(), F.raise_error(F.lit("a path has no size"))).otherwise(_C("p_size"))
    return rows.select("l_orderkey", "l_linenumber", must.cast("int").alias("p_size"))


@query("j24_multi_pack_index", "SELECT l_partkey AS oid, min(l_suppkey) AS pack FROM lineitem GROUP BY 1")
def j24(t):
    one = lambda cond: t.lineitem.where(cond).select(_C("l_partkey").alias("oid"), _C("l_suppkey").alias("pack"))
    return one("l_suppkey % 2 = 0").unionByName(one("l_suppkey % 2 <> 0")).groupBy("oid").agg(F.min("pack").alias("pack"))


_BATCH = "WITH RECURSIVE d AS (SELECT source, doc_id, CAST(strlen(text) AS BIGINT) w, {mark} AS mk, row_number() OVER (PARTITION BY source ORDER BY doc_id) rn FROM documents), g AS (SELECT source, doc_id, rn, mk, w AS cum, CAST(0 AS BIGINT) b FROM d WHERE rn = 1 UNION ALL SELECT d.source, d.doc_id, d.rn, d.mk, CASE WHEN {close} THEN d.w ELSE g.cum + d.w END, CASE WHEN {close} THEN g.b + 1 ELSE g.b END FROM g JOIN d ON d.source = g.source AND d.rn = g.rn + 1) SELECT source, doc_id, b AS batch FROM g"


def sized(t):
    return t.documents.select("source", "doc_id", f.byte_length("text").alias("n"), (_C("doc_id") % 200 < 100).cast("int").alias("mk"))


@query("w03_greedy_batches", _BATCH.format(mark="0", close="g.cum + d.w > 32768"))
def w03(t):
    return batches.greedy_batches(sized(t).drop("mk"), "source", "doc_id", "n", 32768).select("source", "doc_id", "batch")


@query("w04_greedy_bundles", _BATCH.format(mark="0", close="(g.cum > 0 AND g.cum + d.w > 32768) OR g.cum >= 32768"))
def w04(t):
    return batches.greedy_batches(sized(t).drop("mk"), "source", "doc_id", "n", 32768, early=True, bytes_only=True).select("source", "doc_id", "batch")


@query("w05_range_requests", _BATCH.format(mark="CAST(doc_id % 200 < 100 AS INT)", close="(g.cum > 0 AND g.cum + d.w > 32768) OR g.mk <> d.mk"))
def w05(t):
    return batches.greedy_batches(sized(t), "source", "doc_id", "n", 32768, breaker="mk", bytes_only=True).select("source", "doc_id", "batch")


@query("w07_tiling", "WITH x AS (SELECT l_orderkey, l_linenumber, (l_linenumber - 1) * 10 + CASE WHEN l_orderkey % 4 = 0 AND l_linenumber = 3 THEN 1 ELSE 0 END AS s, l_linenumber * 10 AS e FROM lineitem), y AS (SELECT *, lead(s) OVER (PARTITION BY l_orderkey ORDER BY s, e) AS nx FROM x) SELECT l_orderkey, min(s) = 0 AND bool_and(coalesce(nx = e, true)) AS tiled FROM y GROUP BY 1")
def w07(t):
    k, n = _C("l_orderkey"), _C("l_linenumber")
    rows = t.lineitem.select("l_orderkey", ((n - 1) * 10 + F.when((k % 4 == 0) & (n == 3), 1).otherwise(0)).alias("s"), (n * 10).alias("e"))
    total = rows.groupBy("l_orderkey").agg(F.max("e").alias("total"))
    return intervals.tiles(rows.join(total, "l_orderkey"), "l_orderkey", "s", "e", "total")


_LEVELS = "SELECT l_orderkey, l_linenumber AS level, CAST(sum(l_quantity) AS BIGINT) AS bytes FROM lineitem GROUP BY 1, 2"


@query("w08_smallest_pair", f"WITH l AS ({_LEVELS}), p AS (SELECT l_orderkey, level, bytes + lead(bytes) OVER (PARTITION BY l_orderkey ORDER BY level) AS s FROM l) SELECT l_orderkey, arg_min(level, s * 1000 + level) AS level, min(s) AS bytes FROM p WHERE s IS NOT NULL GROUP BY 1")
def w08(t):
    w = Window.partitionBy("l_orderkey").orderBy("level")
    rows = t.lineitem.groupBy("l_orderkey", _C("l_linenumber").alias("level")).agg(F.sum(_C("l_quantity").cast("long")).alias("bytes"))
    pair = rows.select("l_orderkey", "level", (_C("bytes") + F.lead("bytes").over(w)).alias("s")).where("s IS NOT NULL")
    best = pair.groupBy("l_orderkey").agg(F.min(F.struct("s", "level")).alias("m"))
    return best.select("l_orderkey", _C("m.level").alias("level"), _C("m.s").alias("bytes"))


@query("w12_first_occurrence", "SELECT sha1(text) AS blob, arg_min(doc_id, (CASE WHEN doc_id % 10 = 0 THEN 0 WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END, doc_id)) AS path FROM documents GROUP BY 1")
def w12(t):
    """First by priority (top level, recent, others), then by path: a minimum, taken before the shuffle."""
    d = _C("doc_id")
    priority = F.when(d % 10 == 0, 0).when(d % 3 == 0, 1).otherwise(2).alias("priority")
    return t.documents.groupBy(F.sha1("text").alias("blob")).agg(F.min(F.struct(priority, d.alias("path"))).alias("m")).select("blob", _C("m.path").alias("path"))


@query("t02_hot_files", "WITH c AS (SELECT doc_id AS path, 0 AS pr, doc_id AS pos FROM documents WHERE doc_id % 10 = 0 UNION ALL SELECT doc_id, 1, -doc_id FROM documents WHERE doc_id % 15 = 0), d AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY pr, pos) AS r FROM c) SELECT path FROM d WHERE r = 1 ORDER BY pr, pos LIMIT 50")
def t02(t):
    top = t.documents.where("doc_id % 10 = 0").select(_C("doc_id").alias("path"), F.lit(0).alias("pr"), _C("doc_id").alias("pos"))
    recent = t.documents.where("doc_id % 15 = 0").select(_C("doc_id").alias("path"), F.lit(1).alias("pr"), (-_C("doc_id")).alias("pos"))
    both = top.unionByName(recent).groupBy("path").agg(F.min(F.struct("pr", "pos")).alias("m"))
    return both.orderBy("m.pr", "m.pos").limit(50).select("path")


@query("t03_last_commits", "SELECT conv_id, turn FROM commits QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def t03(t):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return t.commits.withColumn("r", F.row_number().over(w)).where("r <= 3").select("conv_id", "turn")


@query("t04_sorted_refs", "SELECT o_custkey, list(o_orderkey ORDER BY o_orderpriority, o_orderkey)::VARCHAR AS branches FROM orders GROUP BY 1")
def t04(t):
    refs = F.array_sort(F.collect_list(F.struct("o_orderpriority", "o_orderkey"))).getField("o_orderkey")
    return t.orders.groupBy("o_custkey").agg(refs.alias("b")).select("o_custkey", F.concat(F.lit("["), F.array_join(_C("b").cast("array<string>"), ", "), F.lit("]")).alias("branches"))


@query("t06_pack_order", f"WITH tree AS ({_TREE}) SELECT oid, row_number() OVER (ORDER BY oid) AS pos FROM (SELECT DISTINCT oid FROM tree WHERE kind = 'blob')")
def t06(t):
    rows = tree(t).where("kind = 'blob'").select("oid", F.lit(1).alias("one")).dropDuplicates(["oid"])
    return intervals.global_exclusive_sum(rows, "oid", "one", "b").select("oid", (_C("b") + 1).alias("pos"))


@query("t07_batches_of_200", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 200 AS batch FROM documents")
def t07(t):
    rows = intervals.global_exclusive_sum(t.documents.select("doc_id", F.lit(1).alias("one")), "doc_id", "one", "b")
    return rows.select("doc_id", F.expr("b div 200").alias("batch"))


@query("t10_encoded_order", "SELECT id, sha1(CAST(id AS VARCHAR)) AS enc FROM jobs ORDER BY id")
def t10(t):
    return t.jobs.select("id", F.sha1(_C("id").cast("string")).alias("enc")).orderBy("id")


@query("u04_changed_paths", f"SELECT doc_id FROM ({_DIFF}) WHERE change <> 'same'")
def u04(t):
    return merkle.changes(*trees(t)).select(_C("key").alias("doc_id"))


@query("u05_closure_difference", "SELECT sha1(content) AS oid FROM snap_new EXCEPT SELECT sha1(content) FROM snap_old")
def u05(t):
    return t.snap_new.select(F.sha1("content").alias("oid")).subtract(t.snap_old.select(F.sha1("content").alias("oid")))


@query(
    "u06_cover_invariants",
    f"""WITH b AS (SELECT DISTINCT sha1(content) AS oid FROM snap_old), n AS (SELECT DISTINCT sha1(content) AS oid FROM snap_new),
    d AS (SELECT DISTINCT sha1(content) AS oid FROM snap_new JOIN ({_DIFF}) USING (doc_id) WHERE change <> 'same')
    SELECT (SELECT count(*) FROM d WHERE oid IN (SELECT oid FROM b)) AS overlap, (SELECT count(*) FROM n WHERE oid NOT IN (SELECT oid FROM b) AND oid NOT IN (SELECT oid FROM d)) AS missing""",
)
def u06(t):
    """The delta is taken from changed paths, so it may repeat objects of the base: overlap counts them, missing what neither holds."""
    new, old = (s.select(F.sha1("content").alias("oid")).distinct() for s in (t.snap_new, t.snap_old))
    changed = diff(t.snap_old, t.snap_new).where("change <> 'same'").select("doc_id")
    delta = t.snap_new.join(changed, "doc_id", "left_semi").select(F.sha1("content").alias("oid")).distinct()
    overlap = delta.intersect(old).agg(F.count("*").alias("overlap"))
    return overlap.join(new.subtract(old.union(delta)).agg(F.count("*").alias("missing")))


@query("u07_tagged_packs", "SELECT doc_id, 'head' AS tag FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'history' FROM documents WHERE doc_id % 3 = 1")
def u07(t):
    one = lambda k, tag: t.documents.where(f"doc_id % 3 = {k}").select("doc_id", F.lit(tag).alias("tag"))
    return one(0, "head").unionByName(one(1, "history"))


@query("u08_distinct_dirs", "SELECT DISTINCT source || '/' || lang AS dir FROM documents")
def u08(t):
    return t.documents.select(f.parent_dir(F.concat_ws("/", "source", "lang", "doc_id")).alias("dir")).distinct()


def place_edges(t):
    """region -> nation -> customer and supplier as a tree."""
    node = lambda p, c: F.concat(F.lit(p), c)
    n = t.nation.select(node("r", "n_regionkey").alias("src"), node("n", "n_nationkey").alias("dst"))
    c = t.customer.select(node("n", "c_nationkey").alias("src"), node("c", "c_custkey").alias("dst"))
    s = t.supplier.select(node("n", "s_nationkey").alias("src"), node("s", "s_suppkey").alias("dst"))
    return n.unionByName(c).unionByName(s)


_EDGES = "e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier)"
_CLOSE = f"WITH RECURSIVE {_EDGES}, g AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS node, 0 AS depth FROM region UNION SELECT root, dst, depth + 1 FROM g JOIN e ON src = node"


def regions(t):
    return t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("root"))


@query("g01_closure", f"{_CLOSE}) SELECT root, node FROM g")
def g01(t):
    return graph.closure(place_edges(t), regions(t)).select("root", "node")


@query("g02_depth_limited", f"{_CLOSE} WHERE depth < 1) SELECT root, node, depth FROM g")
def g02(t):
    return graph.closure(place_edges(t), regions(t), 1)


#: Two lanes of commits, odd and even turns; each fourth turn merges the other lane.
_PARENTS = "pa AS (SELECT conv_id, turn, turn - 2 AS parent FROM commits WHERE turn >= 2 UNION ALL SELECT conv_id, turn, turn - 1 FROM commits WHERE turn % 4 = 3)"
_ANCESTORS = "RECURSIVE {p}, g AS (SELECT conv_id, turn AS root, turn AS node FROM ({roots}) UNION SELECT g.conv_id, g.root, pa.parent FROM g JOIN pa ON pa.conv_id = g.conv_id AND pa.turn = g.node)"
_HEADS = "SELECT conv_id, max(turn) AS turn FROM commits GROUP BY 1"


def parents(t):
    """Edges (src, dst, rank) from commits to their parents, with merges; rank 0: the first parent."""
    node = lambda d: F.struct("conv_id", (_C("turn") - d).alias("turn"))
    one = lambda cond, d: t.commits.where(cond).select(node(0).alias("src"), node(d).alias("dst"), F.lit(2 - d).alias("rank"))
    return one("turn >= 2", 2).unionByName(one("turn % 4 = 3", 1))


def heads(t):
    return t.commits.groupBy("conv_id").agg(F.max("turn").alias("turn"))


@query(
    "g03_range_closure",
    f"""WITH {_ANCESTORS.format(p=_PARENTS, roots="SELECT conv_id, turn FROM (SELECT conv_id, max(turn) AS turn FROM commits GROUP BY 1) UNION ALL SELECT conv_id, max(turn) - 4 FROM commits GROUP BY 1 HAVING max(turn) >= 4")},
    h AS ({_HEADS}) SELECT conv_id, node AS turn FROM g JOIN h USING (conv_id) WHERE root = h.turn EXCEPT SELECT conv_id, node FROM g JOIN h USING (conv_id) WHERE root < h.turn""",
)
def g03(t):
    """(from, to]: what the head reaches and the commit four turns before it does not."""
    before = heads(t).select("conv_id", (_C("turn") - 4).alias("turn")).where("turn >= 0")
    roots = heads(t).unionByName(before).select(F.struct("conv_id", "turn").alias("root"))
    found = graph.reach(parents(t), roots).select("root", _C("node.conv_id").alias("conv_id"), _C("node.turn").alias("turn"))
    from_head = _C("root.turn") == _C("head")
    own = found.join(heads(t).select(_C("conv_id").alias("c"), _C("turn").alias("head")), F.col("root.conv_id") == F.col("c"))
    return own.groupBy("conv_id", "turn").agg(F.bool_and(from_head).alias("only")).where("only").select("conv_id", "turn")


@query("g04_generation", f"WITH {_ANCESTORS.format(p=_PARENTS, roots=_HEADS)} SELECT conv_id, root AS turn, count(*) AS generation FROM g GROUP BY 1, 2")
def g04(t):
    """Of each head, the number of distinct ancestors with itself; with merges that is not the longest path."""
    found = graph.reach(parents(t), heads(t).select(F.struct("conv_id", "turn").alias("root")))
    return found.groupBy("root").agg(F.count("*").alias("generation")).select("root.conv_id", "root.turn", "generation")


@query("g05_parents", "SELECT conv_id, turn, CASE WHEN turn > 0 THEN turn - 1 END AS parent FROM commits")
def g05(t):
    p = t.commits.select("conv_id", _C("turn").alias("parent"), (_C("turn") + 1).alias("turn"))
    return t.commits.select("conv_id", "turn").join(p, ["conv_id", "turn"], "left")


_ROWS = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS b FROM lineitem"
_COMPACT = """WITH RECURSIVE g AS (SELECT l_orderkey, list(b ORDER BY l_linenumber, l_partkey, l_suppkey, b) AS l FROM ({rows}) GROUP BY 1 UNION ALL
    SELECT l_orderkey, l[:i - 1] || [l[i] + l[i + 1]] || l[i + 2:] FROM (SELECT l_orderkey, l, list_position(p, list_min(p)) AS i FROM (SELECT l_orderkey, l, list_transform(range(1, len(l)), lambda k: l[k] + l[k + 1]) AS p FROM g WHERE len(l) > 3)))
  SELECT l_orderkey, unnest(range(len(l))) AS level, unnest(l) AS size FROM g WHERE len(l) <= 3"""


@query("g06_compaction", _COMPACT.format(rows=_ROWS))
def g06(t):
    return folds.compaction(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", _C("l_quantity").cast("long").alias("bytes")), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], "bytes", 3)


@query("g07_seal_and_compact", _COMPACT.format(rows=_ROWS + " UNION ALL SELECT o_orderkey, 99, 0, 0, CAST(floor(o_totalprice) AS BIGINT) FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice >= 1"))
def g07(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", _C("l_quantity").cast("long").alias("bytes"))
    tail = t.orders.where("o_orderstatus <> 'F' AND o_totalprice >= 1").select(_C("o_orderkey").alias("l_orderkey"), F.lit(99).alias("l_linenumber"), F.lit(0).cast("long").alias("l_partkey"), F.lit(0).cast("long").alias("l_suppkey"), _C("o_totalprice").cast("long").alias("bytes"))
    return folds.compaction(rows.unionByName(tail), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], "bytes", 3)


@query("g08_rebase_decision", "SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) >= 128 AS rebase FROM lineitem GROUP BY 1")
def g08(t):
    return t.lineitem.groupBy("l_orderkey").agg((F.sum(_C("l_quantity").cast("long")) >= 128).alias("rebase"))


@query("x17_reassembly", f"WITH p AS ({_STREAM}), fr AS ({_FRAMES}) SELECT doc_id, count(*) AS fragments, CAST(sum(least(start + len, fe) - greatest(start, fs)) AS BIGINT) = max(len) AS complete FROM p JOIN fr ON start < fe AND start + len > fs WHERE len > 0 GROUP BY 1")
def x17(t):
    return fragments(stream(t)).groupBy("doc_id").agg(F.count("*").alias("fragments"), (F.sum("raw_len") == F.max("len")).alias("complete"))
