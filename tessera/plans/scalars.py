"""Scalar functions and predicates over rows (F*, P*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalars as f

from .registry import query
from .storage import _TREE, tree

_C = F.col


@query("f01_sha256", "SELECT doc_id, sha256(text) AS hash FROM documents")
def f01(t):
    return t.documents.select("doc_id", f.content_hash("text").alias("hash"))


@query("f02_sha1", "SELECT doc_id, sha1(text) AS hash FROM documents")
def f02(t):
    return t.documents.select("doc_id", F.sha1("text").alias("hash"))


@query("f03_hex", "SELECT p_partkey, lower(hex(encode(p_name))) AS hexed, p_name AS back FROM part")
def f03(t):
    h = F.lower(F.hex("p_name"))
    return t.part.select("p_partkey", h.alias("hexed"), F.decode(F.unhex(h), "UTF-8").alias("back"))


@query("f04_url_slug", "SELECT page_id, rtrim(translate(base64(encode(url)), '+/', '-_'), '=') AS slug, url AS back FROM pages")
def f04(t):
    return t.pages.select("page_id", f.url_slug("url").alias("slug"), f.from_url_slug(f.url_slug("url")).alias("back"))


@query("f05_credential_codec", "SELECT page_id, base64(encode(url)) AS enc, CASE WHEN page_id % 3 = 0 THEN NULL ELSE url END AS dec FROM pages")
def f05(t):
    enc = f.base64_line("url")
    sent = F.when(_C("page_id") % 3 == 0, F.concat(F.lit("*"), enc)).otherwise(enc)
    return t.pages.select("page_id", enc.alias("enc"), f.decode_or_null(sent).alias("dec"))


_PATH = "split_part(split_part(split_part(url, '://', 2), '?', 1), '#', 1)"


@query(
    "f06_owner_name",
    f"WITH p AS (SELECT page_id, regexp_replace({_PATH}, '^[^/]*/', '') AS x FROM pages) SELECT page_id, CASE WHEN regexp_matches(x, '^[^/]+/[^/]+$') THEN split_part(x, '/', 1) END AS owner, CASE WHEN regexp_matches(x, '^[^/]+/[^/]+$') THEN split_part(x, '/', 2) END AS name FROM p",
)
def f06(t):
    x = F.regexp_replace(F.split_part(F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1)), "^[^/]*/", "")
    rows = t.pages.select("page_id", f.owner_and_name(x).alias("o"))
    return rows.select("page_id", _C("o.owner").alias("owner"), _C("o.name").alias("name"))


@query("f07_escape_path", r"SELECT page_id, replace(replace(replace(url, '%', '%25'), '/', '%2F'), '\', '%5C') AS escaped, url AS back FROM pages")
def f07(t):
    return t.pages.select("page_id", f.escape_path(_C("url")).alias("escaped"), f.unescape_path(f.escape_path(_C("url"))).alias("back"))


@query("f08_origin_url", "SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^(https?)://', 1) AS scheme FROM pages")
def f08(t):
    return t.pages.select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"), F.parse_url("url", F.lit("PROTOCOL")).alias("scheme"))


_REF = "CASE WHEN event_id % 3 = 0 THEN 'refs/heads/' || event_type WHEN event_id % 3 = 1 THEN 'refs/tags/v' || event_id ELSE event_type END"
_SHA = "CASE WHEN event_id % 5 = 0 THEN repeat('0', 40) ELSE sha1(CAST(event_id AS VARCHAR)) END"


def refs_of_events(t):
    e = _C("event_id")
    ref = F.when(e % 3 == 0, F.concat(F.lit("refs/heads/"), "event_type")).when(e % 3 == 1, F.concat(F.lit("refs/tags/v"), e)).otherwise(_C("event_type"))
    sha = F.when(e % 5 == 0, F.repeat(F.lit("0"), 40)).otherwise(F.sha1(e.cast("string")))
    return t.events.select("*", ref.alias("ref"), sha.alias("after"))


@query("f09_branch_and_zero", f"WITH r AS (SELECT event_id, {_REF} AS ref, {_SHA} AS after FROM events) SELECT event_id, CASE WHEN starts_with(ref, 'refs/heads/') THEN substr(ref, 12) END AS branch, regexp_matches(after, '^0+$') AS zero FROM r")
def f09(t):
    return refs_of_events(t).select("event_id", f.strip_branch(_C("ref")).alias("branch"), f.is_zero_sha(_C("after")).alias("zero"))


@query("f10_octal_mode", f"WITH tree AS ({_TREE}) SELECT path, CASE mode WHEN 16384 THEN '040000' WHEN 57344 THEN '160000' WHEN 40960 THEN '120000' WHEN 33261 THEN '100755' ELSE '100644' END AS octal, CASE mode WHEN 16384 THEN 'tree' WHEN 57344 THEN 'submodule' WHEN 40960 THEN 'symlink' WHEN 33261 THEN 'executable' ELSE 'file' END AS kind FROM tree")
def f10(t):
    o = f.octal_mode(_C("mode"))
    return tree(t).select("path", o.alias("octal"), f.mode_kind(o).alias("kind"))


@query("f11_rfc3339", "SELECT event_id, strftime(to_timestamp(epoch_s) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS at FROM (SELECT event_id, 1700000000 + event_id * 977 AS epoch_s FROM events)")
def f11(t):
    at = F.timestamp_seconds(F.lit(1700000000) + _C("event_id") * 977)
    return t.events.select("event_id", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"))


@query("f12_backoff", "SELECT event_id, CAST(5 * power(2, least(event_id % 12, 5)) AS BIGINT) AS wait FROM events")
def f12(t):
    return t.events.select("event_id", f.backoff(5, _C("event_id") % 12 + 1, 5).alias("wait"))


@query("f13_capped_backoff", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 1500 ELSE least(CAST(500 * power(2, least(event_id % 12, 6)) AS BIGINT), 60000) END AS wait_ms FROM events")
def f13(t):
    wait = F.when(_C("event_id") % 7 == 0, F.lit(1500)).otherwise(f.backoff(500, _C("event_id") % 12 + 1, 6, 60000))
    return t.events.select("event_id", wait.cast("long").alias("wait_ms"))


_HEAD = "CASE event_id % 5 WHEN 0 THEN 'bytes=' || event_id % 100 || '-' WHEN 1 THEN 'bytes=-' || event_id % 50 WHEN 2 THEN 'bytes=10-' || event_id % 300 WHEN 3 THEN 'items=1-2' ELSE 'bytes=500-600' END"


@query(
    "f14_byte_range",
    f"""WITH h AS (SELECT event_id, {_HEAD} AS h FROM events),
    ab AS (SELECT event_id, TRY_CAST(nullif(regexp_extract(h, '^bytes=([0-9]*)-([0-9]*)$', 1), '') AS BIGINT) AS a, TRY_CAST(nullif(regexp_extract(h, '^bytes=([0-9]*)-([0-9]*)$', 2), '') AS BIGINT) AS b FROM h),
    r AS (SELECT event_id, a, b, CASE WHEN a IS NULL THEN greatest(200 - b, 0) ELSE a END AS x, CASE WHEN a IS NULL OR b IS NULL THEN 199 ELSE least(b, 199) END AS y FROM ab)
    SELECT event_id, CASE WHEN (a IS NOT NULL OR b > 0) AND x <= y AND x < 200 THEN x END AS first, CASE WHEN (a IS NOT NULL OR b > 0) AND x <= y AND x < 200 THEN y END AS last FROM r""",
)
def f14(t):
    e = _C("event_id")
    head = (
        F.when(e % 5 == 0, F.concat(F.lit("bytes="), e % 100, F.lit("-"))).when(e % 5 == 1, F.concat(F.lit("bytes=-"), e % 50))
        .when(e % 5 == 2, F.concat(F.lit("bytes=10-"), e % 300)).when(e % 5 == 3, F.lit("items=1-2")).otherwise(F.lit("bytes=500-600"))
    )
    rows = t.events.select("event_id", f.byte_range(head, F.lit(200).cast("long")).alias("r"))
    return rows.select("event_id", _C("r.first").alias("first"), _C("r.last").alias("last"))


@query("f15_retry_after", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id % 90 END AS secs FROM events")
def f15(t):
    e = _C("event_id")
    said = F.when(e % 2 == 0, F.concat(F.lit("HTTP 429: Retry-After: "), e % 90, F.lit(" s"))).otherwise(F.lit("HTTP 500"))
    return t.events.select("event_id", F.nullif(F.regexp_extract(said, r"(?i)retry-after:\s*(\d+)", 1), F.lit("")).cast("long").alias("secs"))


@query("f16_version_verdict", "SELECT event_id, CASE WHEN event_id % 4 <> 2 THEN 'incompatible' WHEN event_id % 10 > 5 THEN 'upgrade' ELSE 'ok' END AS verdict FROM events")
def f16(t):
    version = F.split(F.concat(_C("event_id") % 4, F.lit("."), _C("event_id") % 10, F.lit(".0")), r"\.")
    major, minor = F.get(version, F.lit(0)).cast("int"), F.get(version, F.lit(1)).cast("int")
    return t.events.select("event_id", F.when(major != 2, "incompatible").when(minor > 5, "upgrade").otherwise("ok").alias("verdict"))


@query("f17_json_path", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def f17(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("f21_help_escape", r"SELECT doc_id, replace(replace(text, '\', '\\'), chr(10), '\n') AS help FROM documents")
def f21(t):
    x = F.replace("text", F.lit("\\"), F.lit("\\\\"))
    return t.documents.select("doc_id", F.replace(x, F.lit("\n"), F.lit("\\n")).alias("help"))


@query("f22_ip_key", "SELECT event_id, '10.0.' || user_id % 256 || '.7' AS rate_key FROM events")
def f22(t):
    forwarded = F.concat(F.lit("10.0."), _C("user_id") % 256, F.lit(".7:"), _C("event_id") % 60000, F.lit(", 192.168.0.1"))
    return t.events.select("event_id", F.trim(F.split_part(F.split_part(forwarded, F.lit(","), F.lit(1)), F.lit(":"), F.lit(1))).alias("rate_key"))


@query("f23_short_ids", "SELECT doc_id, left(sha1(text), 7) AS short FROM documents")
def f23(t):
    return t.documents.select("doc_id", F.left(F.sha1("text"), F.lit(7)).alias("short"))


@query("f24_parent_dir", "SELECT doc_id, source || '/' || lang AS dir FROM documents")
def f24(t):
    return t.documents.select("doc_id", f.parent_dir(F.concat_ws("/", "source", "lang", "doc_id")).alias("dir"))


@query("f25_kb_to_bytes", "SELECT p_partkey, CAST(p_size AS BIGINT) * 1024 AS bytes FROM part")
def f25(t):
    return t.part.select("p_partkey", (_C("p_size").cast("long") * 1024).alias("bytes"))


@query("f26_state_tags", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'claimed' WHEN 'F' THEN 'done' ELSE 'failed' END AS state FROM orders")
def f26(t):
    tags = F.create_map(*[F.lit(x) for x in ("O", "queued", "P", "claimed", "F", "done")])
    return t.orders.select("o_orderkey", F.coalesce(F.element_at(tags, _C("o_orderstatus")), F.lit("failed")).alias("state"))


@query("p01_skeleton", f"WITH tree AS ({_TREE}) SELECT path, kind FROM tree WHERE kind IN ('commit', 'tree') OR (kind = 'blob' AND mode = 40960)")
def p01(t):
    return tree(t).where(_C("kind").isin("commit", "tree") | ((_C("kind") == "blob") & f.octal_mode(_C("mode")).startswith("120"))).select("path", "kind")


@query("p02_symlinks", f"WITH tree AS ({_TREE}) SELECT path FROM tree WHERE kind = 'blob' AND mode = 40960")
def p02(t):
    return tree(t).where((_C("kind") == "blob") & f.octal_mode(_C("mode")).startswith("120")).select("path")


@query("p03_store_blobs", f"WITH tree AS ({_TREE}) SELECT oid, max(size) AS size FROM tree WHERE kind = 'blob' GROUP BY 1")
def p03(t):
    return tree(t).where("kind = 'blob'").groupBy("oid").agg(F.max("size").alias("size"))


@query("p04_drop_trees", f"WITH tree AS ({_TREE}) SELECT path, oid FROM tree WHERE mode NOT IN (16384, 57344)")
def p04(t):
    return tree(t).where(~_C("mode").isin(16384, 57344)).select("path", "oid")


@query("p05_size_class", "SELECT id, CASE WHEN size IS NULL THEN 2 WHEN size <= 20 THEN 0 WHEN size <= 100 THEN 1 ELSE 2 END AS class FROM (SELECT id, CASE WHEN id % 9 = 0 THEN NULL ELSE size END AS size FROM jobs)")
def p05(t):
    size = F.when(_C("id") % 9 != 0, _C("size"))
    return t.jobs.select("id", F.when(size.isNull(), 2).when(size <= 20, 0).when(size <= 100, 1).otherwise(2).alias("class"))


@query("p06_resolve_size", "SELECT id, greatest(nullif(size % 40, 0), nullif(id % 30, 0)) AS size FROM jobs")
def p06(t):
    return t.jobs.select("id", F.greatest(F.nullif(_C("size") % 40, F.lit(0)), F.nullif(_C("id") % 30, F.lit(0))).alias("size"))


@query("p07_rank_clamp", "SELECT id, least(greatest(size % 7 - 2, 0), 3) AS rank FROM jobs")
def p07(t):
    return t.jobs.select("id", F.least(F.greatest(_C("size") % 7 - 2, F.lit(0)), F.lit(3)).alias("rank"))


_STATE = "SELECT o_orderkey, o_orderstatus = 'P' AS evicted, CASE WHEN o_orderkey % 11 = 0 THEN 'failed: x' END AS build, CASE WHEN o_orderkey % 2 = 0 THEN sha1(CAST(o_orderkey AS VARCHAR)) ELSE '' END AS full_m, CASE WHEN o_orderkey % 3 = 0 THEN 's' || o_orderkey ELSE '' END AS shallow, CASE WHEN o_orderkey % 5 = 0 THEN 'l' || o_orderkey ELSE '' END AS legacy, o_orderkey % 7 AS levels FROM orders"


def ref_states(t):
    k = _C("o_orderkey")
    pick = lambda cond, value: F.when(cond, value).otherwise(F.lit(""))
    return t.orders.select(
        "o_orderkey", (_C("o_orderstatus") == "P").alias("evicted"), F.when(k % 11 == 0, "failed: x").alias("build"),
        pick(k % 2 == 0, F.sha1(k.cast("string"))).alias("full_m"), pick(k % 3 == 0, F.concat(F.lit("s"), k)).alias("shallow"),
        pick(k % 5 == 0, F.concat(F.lit("l"), k)).alias("legacy"), (k % 7).alias("levels"),
    )


@query("p08_history_status", f"WITH s AS ({_STATE}) SELECT o_orderkey, CASE WHEN evicted THEN 'cold' WHEN build LIKE 'failed: %' THEN 'failed' WHEN full_m <> '' THEN 'ready' ELSE 'building' END AS status FROM s")
def p08(t):
    return ref_states(t).select("o_orderkey", F.when(_C("evicted"), "cold").when(_C("build").startswith("failed: "), "failed").when(_C("full_m") != "", "ready").otherwise("building").alias("status"))


@query("p09_readiness", f"WITH s AS ({_STATE}) SELECT o_orderkey, NOT evicted AND full_m <> '' AS warm, NOT evicted AND shallow <> '' AS depth1_ready, NOT evicted AND levels > 0 AS archive_ready FROM s")
def p09(t):
    live = ~_C("evicted")
    return ref_states(t).select("o_orderkey", (live & (_C("full_m") != "")).alias("warm"), (live & (_C("shallow") != "")).alias("depth1_ready"), (live & (_C("levels") > 0)).alias("archive_ready"))


@query("p10_primary_manifest", f"WITH s AS ({_STATE}) SELECT o_orderkey, CASE WHEN evicted THEN '' ELSE coalesce(nullif(full_m, ''), nullif(shallow, ''), legacy) END AS manifest FROM s")
def p10(t):
    pick = F.coalesce(F.nullif("full_m", F.lit("")), F.nullif("shallow", F.lit("")), "legacy")
    return ref_states(t).select("o_orderkey", F.when(_C("evicted"), "").otherwise(pick).alias("manifest"))


@query("p11_row_skip", f"WITH s AS ({_STATE}) SELECT o_orderkey FROM s WHERE NOT (full_m = '' AND shallow = '' AND legacy = '' AND levels = 0 AND NOT evicted)")
def p11(t):
    return ref_states(t).where("NOT (full_m = '' AND shallow = '' AND legacy = '' AND levels = 0 AND NOT evicted)").select("o_orderkey")


@query(
    "p12_geometry_check",
    """WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) AS off, p_size FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_partkey % 31 <> 0)
    SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN 'bad mode' WHEN p_size IS NULL THEN 'no frame' ELSE 'out of frame' END AS reason FROM e
    WHERE l_linenumber = 7 OR p_size IS NULL OR off + 10 > p_size""",
)
def p12(t):
    frames = t.part.where("p_partkey % 31 <> 0").select(_C("p_partkey").alias("l_partkey"), _C("p_size").alias("raw_len"))
    e = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", _C("l_quantity").cast("long").alias("off")).join(frames, "l_partkey", "left")
    reason = F.when(_C("l_linenumber") == 7, "bad mode").when(_C("raw_len").isNull(), "no frame").when(_C("off") + 10 > _C("raw_len"), "out of frame")
    return e.select("l_orderkey", "l_linenumber", reason.alias("reason")).where("reason IS NOT NULL")


@query(
    "p13_webhook_policy",
    f"""WITH r AS (SELECT event_id, user_id, {_REF} AS ref, {_SHA} AS after, event_type FROM events)
    SELECT event_id, CASE WHEN user_id % 10 = 0 THEN 'not allowed' WHEN c_custkey IS NULL THEN 'not added' WHEN NOT starts_with(ref, 'refs/heads/') THEN 'not a branch'
      WHEN regexp_matches(after, '^0+$') THEN 'deleted' WHEN event_type IN ('view', 'purchase') THEN 'build' ELSE 'not tracked' END AS reason
    FROM r LEFT JOIN customer ON c_custkey = user_id AND c_custkey % 2 = 0""",
)
def p13(t):
    added = t.customer.where("c_custkey % 2 = 0").select(_C("c_custkey").alias("user_id"), F.lit(True).alias("added"))
    e = refs_of_events(t).join(added, "user_id", "left")
    reason = (
        F.when(_C("user_id") % 10 == 0, "not allowed").when(_C("added").isNull(), "not added").when(f.strip_branch(_C("ref")).isNull(), "not a branch")
        .when(f.is_zero_sha(_C("after")), "deleted").when(_C("event_type").isin("view", "purchase"), "build").otherwise("not tracked")
    )
    return e.select("event_id", reason.alias("reason"))


@query("p14_reuse", f"WITH s AS ({_STATE}) SELECT o_orderkey FROM s WHERE full_m = sha1(CAST(o_orderkey AS VARCHAR)) AND NOT evicted AND (levels > 0 OR build IS NULL)")
def p14(t):
    return ref_states(t).where(_C("full_m") == F.sha1(_C("o_orderkey").cast("string"))).where("NOT evicted AND (levels > 0 OR build IS NULL)").select("o_orderkey")


@query("p15_config_overlay", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN 'branch' END, CASE WHEN c_custkey % 2 = 0 THEN 'repo' END, 'default') AS mode FROM customer")
def p15(t):
    k = _C("c_custkey")
    return t.customer.select("c_custkey", F.coalesce(F.when(k % 3 == 0, "branch"), F.when(k % 2 == 0, "repo"), F.lit("default")).alias("mode"))


@query("p16_identifiers", "SELECT page_id, regexp_matches(url, '^[A-Za-z0-9._/:-]+$') AS rev_ok, length(sha1(url)) IN (40, 64) AS oid_ok FROM pages")
def p16(t):
    oid = F.sha1("url")
    return t.pages.select("page_id", _C("url").rlike("^[A-Za-z0-9._/:-]+$").alias("rev_ok"), (F.length(oid).isin(40, 64) & oid.rlike("^[0-9a-f]+$")).alias("oid_ok"))


@query("p17_safe_path", "SELECT doc_id, doc_id % 4 NOT IN (1, 2) AS safe FROM documents")
def p17(t):
    d = _C("doc_id")
    path = F.when(d % 4 == 1, F.concat(F.lit("/abs/"), d)).when(d % 4 == 2, F.concat(F.lit("a/../"), d)).otherwise(F.concat(F.lit("a/..b/"), d))
    return t.documents.select("doc_id", (~path.rlike(r"^/|(^|/)\.\.(/|$)")).alias("safe"))


@query("p18_mode_resolve", "SELECT event_id, coalesce(CASE WHEN event_id % 5 = 0 THEN 'cli' END, CASE WHEN event_id % 3 = 0 THEN 'env' END, CASE WHEN event_id % 2 = 0 THEN 'config' END, 'default') AS mode FROM events")
def p18(t):
    e = _C("event_id")
    return t.events.select("event_id", F.coalesce(F.when(e % 5 == 0, "cli"), F.when(e % 3 == 0, "env"), F.when(e % 2 == 0, "config"), F.lit("default")).alias("mode"))


@query(
    "p21_verify_decision",
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'skip' WHEN event_id % 3 = 2 THEN 'verify' WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'verify' ELSE 'skip' END AS decision FROM events",
)
def p21(t):
    policy, pinned = _C("event_id") % 3, _C("event_id") % 2 == 0
    d = F.when(policy == 0, "skip").when(policy == 2, "verify").when((_C("event_type") == "view") & pinned, "verify").otherwise("skip")
    return t.events.select("event_id", d.alias("decision"))
