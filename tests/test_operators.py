"""Operators by themselves: folds, intervals, chunking, scalars, graphs, views."""

import base64
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera import api
from tessera.functions import scalars as f
from tessera.operators import batches, chunking, fetch, folds, graph, intervals, merkle
from tessera.sources.tables import with_views
from tessera.streaming import states, timers


def greedy(rows, target, early=False, bytes_only=False):
    """Batch numbers of (size, mark) in order."""
    out, batch, total, last = [], 0, None, None
    for n, mark in rows:
        full = total is not None and total + n > target and not (bytes_only and total == 0)
        if full or total is not None and (early and total >= target or mark != last):
            batch, total = batch + 1, None
        total, last = (total or 0) + n, mark
        out.append(batch)
    return out


@pytest.fixture
def uncoalesced(spark):
    """Sixteen partitions that stay sixteen, so that a key's rows lie in many ranges."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("early, marks, bytes_only", [(False, False, False), (True, False, True), (False, True, True), (True, True, False)])
def test_greedy_batches(spark, uncoalesced, early, marks, bytes_only):
    """Hot and small keys, a null key, empty and oversize items, changes of mark, one batch over many ranges."""
    r = random.Random(1)
    rows = []
    for k, n, size in (("a", 900, lambda: r.randint(0, 60)), ("b", 40, lambda: r.choice([0, 0, 0, 500])), (None, 60, lambda: r.randint(0, 9)), ("c", 1, lambda: 5), ("d", 300, lambda: 0), ("e", 700, lambda: r.choice([0, 1, 99, 100, 101]))):
        rows += [(k, i, size(), r.choice("xy") if marks and r.random() < 0.2 else "x", "extra") for i in range(n)]
    want = {}
    for k in "abcde":
        own = [x for x in rows if x[0] == k]
        want |= {(k, x[1]): b for x, b in zip(own, greedy([x[2:4] for x in own], 100, early, bytes_only))}
    own = [x for x in rows if x[0] is None]
    want |= {(None, x[1]): b for x, b in zip(own, greedy([x[2:4] for x in own], 100, early, bytes_only))}
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i long, n long, m string, extra string")
    done = batches.greedy_batches(df, "k", "i", "n", 100, early, "m" if marks else None, bytes_only)
    assert done.columns == ["k", "i", "n", "m", "extra", "batch"]
    assert {(x.k, x.i): x.batch for x in done.collect()} == want
    assert batches.greedy_batches(df.where("false"), "k", "i", "n", 100).collect() == []


def test_one_key_of_a_million_rows_is_dealt_to_all_tasks(spark, uncoalesced):
    df = spark.range(1_000_000).select(F.lit("k").alias("k"), F.col("id").alias("i"), (F.col("id") * 7919 % 101).alias("n"))
    rows = batches.greedy_batches(df, "k", "i", "n", 1000).withColumn("task", F.spark_partition_id()).toPandas().sort_values("i")
    assert rows["task"].nunique() > 8 and rows["task"].value_counts().max() < 300_000
    assert list(rows["batch"]) == greedy([(n, None) for n in rows["n"]], 1000)


@given(st.lists(st.integers(0, 100), min_size=1, max_size=12), st.integers(0, 5))
def test_compaction_keeps_the_sum(levels, most):
    out = folds.compact_levels(levels, most)
    assert sum(out) == sum(levels) and len(out) == min(len(levels), max(most, 1))


def test_newest_wins_depends_on_arrival(spark):
    a, b, c = ("a", 5, 1), ("b", None, 2), ("c", 3, 3)
    for order, last in (((a, b, c), "c"), ((c, a, b), "b")):
        rows = [("r", i, *x) for i, x in enumerate(order)]
        df = spark.createDataFrame(rows, "ref string, arrival long, commit_id string, generation long, synced_at long")
        landed = folds.newest_wins(df, "ref", "arrival").where("lands").orderBy(F.desc("arrival")).first()
        assert landed.commit_id == last


def test_token_bucket_integer_refill_starves(spark):
    df = spark.createDataFrame([("k", i, i) for i in range(6)], "k string, at long, i long")
    whole = folds.token_bucket(df, "k", "at", "i", 2, 1).orderBy("i").collect()
    exact = folds.token_bucket(df, "k", "at", "i", 2, 1, whole=False).orderBy("i").collect()
    assert [x.allowed for x in whole] == [True] + [False] * 5
    assert [x.allowed for x in exact] == [True, False, True, False, True, False]


def test_overlap_join_equals_theta_join(spark):
    r = random.Random(2)
    a = [(i, s, s + r.choice([0, 1, 16, 17, r.randint(0, 50)])) for i, s in enumerate(r.randrange(0, 500) for _ in range(60))] + [(60, 3, 10**9)]
    b = [(i, s, s + r.choice([r.randint(0, 90), 64, 300])) for i, s in enumerate(r.randrange(0, 500) for _ in range(60))] + [(60, 0, 10**9)]
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] < y[2] and x[2] > y[1] and x[1] < x[2] and y[1] < y[2])
    left, right = spark.createDataFrame(a, "i long, s long, e long"), spark.createDataFrame(b, "j long, fs long, fe long")
    got = intervals.overlap_join(left, right, "s", "e", "fs", "fe", 16).select("i", "j").collect()
    assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize("parts, adaptive", [(4, "true"), (4, "false"), (200, "true")])
def test_global_exclusive_sum(spark, parts, adaptive):
    """More rows than a range exchange samples, in an order of their own, with columns that are read or not."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    n = 50_000 if parts == 4 else 5_000
    try:
        df = spark.range(n).select(((F.col("id") * 7919) % n).alias("i")).select("i", (F.col("i") % 7).alias("n"), F.sha2(F.col("i").cast("string"), 256).alias("extra"))
        two = intervals.global_exclusive_sum(df, "i", ["n", "i"], ["start", "sum"])
        got = two.select("i", "start", "sum", "extra").toPandas().sort_values("i")
        i = np.arange(n)
        assert list(got["start"]) == list(np.cumsum(i % 7) - i % 7) and list(got["sum"]) == list(np.cumsum(i) - i)
        names = intervals.global_exclusive_sum(df.select("extra", F.lit(1).alias("one")), "extra", "one").toPandas().sort_values("extra")
        assert list(names["start"]) == list(range(n))
        after = intervals.global_lead(df, "i", "i", "next").toPandas().sort_values("i")
        assert list(after["next"][:-1]) == list(range(1, n)) and np.isnan(after["next"].iloc[-1])
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert intervals.global_exclusive_sum(df.where("i < 0"), "i", "n").count() == 0


def test_slugs_of_long_names_have_no_line_breaks(spark):
    rows = [("x" * 200,), ("é/?" * 70,), ("",)]
    for x in spark.createDataFrame(rows, "c string").select("c", f.url_slug("c").alias("s"), f.base64_line("c").alias("b"), f.from_url_slug(f.url_slug("c")).alias("back")).collect():
        assert x.s == base64.urlsafe_b64encode(x.c.encode()).decode().rstrip("=") and x.b == base64.b64encode(x.c.encode()).decode() and x.back == x.c


def test_islands(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate("aabba")], "i long, v string")
    assert [x.island for x in intervals.islands(df, "v", "i").orderBy("i").collect()] == [1, 1, 2, 2, 3]


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=6000), st.integers(0, 5999))
def test_chunks_tile_and_a_stream_cuts_alike(data, at):
    ends = chunking.cut_points(data, 64, 128, 512)
    assert (ends[-1] if ends else 0) == len(data)
    assert all(0 < b - a <= 512 for a, b in zip([0, *ends], ends))
    assert all(b - a >= 64 for a, b in zip([0, *ends], ends[:-1]))
    done = [e for e in ends if e <= at]
    if done:  # what follows a boundary is cut without what stands before it
        rest = chunking.cut_points(data[done[-1] :], 64, 128, 512)
        assert [done[-1] + e for e in rest] == ends[len(done) :]


def test_pack_headers(spark):
    rows = [(k, n) for k in (1, 4, 6) for n in (0, 15, 16, 2047, 2048, 10**6, 2**40 + 3, 2**59 - 1)]
    df = spark.createDataFrame(rows, "kind int, size long").withColumn("h", f.pack_header(F.col("kind"), F.col("size")))
    for x in df.select("*", f.read_pack_header(F.concat("h", F.lit(b"rest"))).alias("back")).collect():
        rest, want = x.size >> 4, []
        while rest:
            want.append(rest & 127 | (128 if rest >> 7 else 0))
            rest >>= 7
        assert bytes(x.h) == bytes([x.kind << 4 | x.size & 15 | (128 if want else 0), *want])
        assert (x.back.kind, x.back.size) == (x.kind, x.size)
    bad = spark.createDataFrame([(bytearray(),), (None,), (bytearray([255, 255]),)], "h binary")
    assert [x.r for x in bad.select(f.read_pack_header(F.col("h")).alias("r")).collect()] == [None] * 3


def test_fetch_groups_ranges_of_a_chunk(spark, tmp_path):
    def read(chunk, first, end):
        with open(f"{tmp_path}/calls", "a") as f:
            f.write(f"{chunk}\n")
        return bytes((k * 7 + chunk) % 256 for k in range(first, end))

    rows = [(c, at, n) for c in (1, 2) for at, n in ((0, 5), (3, 9), (20, 0), (9000, 4))] + [(None, 1, 1), (3, None, 1)]
    got = fetch.fetched(spark.createDataFrame(rows, "c long, at long, n long"), read, "c", "at", "n").collect()
    assert len(got) == 10
    for x in got:
        assert x.content is None if None in (x.c, x.at, x.n) else bytes(x.content) == bytes((k * 7 + x.c) % 256 for k in range(x.at, x.at + x.n))
    assert sorted(open(f"{tmp_path}/calls").read().split()) == ["1", "1", "2", "2"]


def test_snapshot_diff_of_nulls(spark):
    old = spark.createDataFrame([(1, None), (2, "a"), (3, "b"), (4, None)], "k long, c string")
    new = spark.createDataFrame([(1, None), (2, "z"), (4, "x"), (5, "")], "k long, c string")
    assert {x.k: x.change for x in api.snapshot_diff(old, new, "k", "c").collect()} == {1: "same", 2: "modified", 3: "deleted", 4: "modified", 5: "added"}


def test_zstd_round_trip(spark):
    df = spark.createDataFrame([(1, "abc" * 100), (2, ""), (3, None)], "i long, t string")
    got = chunking.zstd_lengths(df, "i", "t").orderBy("i").collect()
    assert all(x.same for x in got) and got[0].compressed_len < got[0].raw_len


def test_zstd_frames_hold_one_text():
    """A batch's memory is that of one text and its frame, however many texts it has."""
    import tracemalloc

    import pyarrow as pa

    r = random.Random(1)
    text = r.randbytes(100_000).hex()
    batch = pa.record_batch([pa.array(range(100)), pa.array([text] * 100)], ["i", "t"])
    tracemalloc.start()
    (got,) = chunking.frames([batch])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.column("raw_len").to_pylist() == [200_000] * 100 and all(got.column("same").to_pylist())
    assert peak < 3_000_000


def test_escape_round_trip(spark):
    df = spark.createDataFrame([("a/b%2F\\c",), ("",), (None,)], "p string")
    rows = df.select("p", f.escape_path(F.col("p")).alias("e"), f.unescape_path(f.escape_path(F.col("p"))).alias("back")).collect()
    assert all(x.p == x.back for x in rows) and rows[0].e == "a%2Fb%252F%5Cc"


def test_closure_of_a_diamond(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a")], "src string, dst string")
    got = graph.closure(e, spark.createDataFrame([("a",)], "root string")).collect()
    assert {(x.node, x.depth) for x in got} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}


def reached(edges, root):
    out, todo = {root}, [root]
    while todo:
        v = todo.pop()
        todo += [d for s, d in edges if s == v and d not in out and not out.add(d)]
    return out


def test_reach_of_random_graphs(spark):
    """Cycles, self edges, repeated edges, nodes without edges, roots that are no node."""
    r = random.Random(6)
    for n, m in ((12, 14), (30, 60), (40, 25)):
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(n + i, n + (i + 1) % 5) for i in range(5)]
        roots = [0, 1, 2, n, n + 3, 999]
        got = graph.reach(spark.createDataFrame(edges * 2, "src long, dst long"), spark.createDataFrame([(x,) for x in roots], "root long")).collect()
        assert sorted(map(tuple, got)) == sorted((x, v) for x in roots for v in reached(edges, x))


def test_reach_along_a_long_history_with_merges(spark, monkeypatch):
    """10,000 commits in two lanes that merge: positions take log2 rounds of pointer doubling, and few more reach all."""
    n = 10_000
    rows = [(i, i - 2, 0) for i in range(2, n)] + [(i, i - 1, 1) for i in range(3, n, 4)]
    edges = spark.createDataFrame(rows, "src long, dst long, rank int")
    nodes, _ = graph.chains(edges)
    assert nodes._rounds <= 14 and nodes.select("chain").distinct().count() == 2
    steps = []
    monkeypatch.setattr(graph, "written", lambda df, name, write=graph.written: steps.append(name) or write(df, name))
    roots = spark.createDataFrame([(n - 1,), (n - 2,), (4001,)], "root long")
    got = {x.root: x["count"] for x in graph.reach(edges, roots).groupBy("root").count().collect()}
    after = {}
    for s, d, _ in rows:
        after.setdefault(s, []).append(d)

    def count(root):
        out, todo = {root}, [root]
        while todo:
            todo += [d for d in after.get(todo.pop(), []) if d not in out and not out.add(d)]
        return len(out)

    assert got == {k: count(k) for k in (n - 1, n - 2, 4001)}
    assert steps.count("reached") <= 4 and steps.count("pointers") <= 15


def shuffled(spark):
    """Bytes that all stages so far have written to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    empty = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = store.stageList(None, False, False, empty, None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_tree_comparison_reads_what_differs(spark):
    """Changes are right for any edit, and what is shuffled follows the change, not the snapshot."""
    prefixes = [lambda k, b=b: F.shiftright(k, b) for b in (12, 8, 4)]
    base = spark.range(40_000).select(F.col("id").alias("k"), F.concat(F.lit("text "), F.col("id")).alias("c"))
    edit = F.when(F.col("k") == 17, "new").when(F.col("k") == 30_000, F.lit(None)).otherwise(F.col("c"))
    new = base.where("k <> 123").withColumn("c", edit).unionByName(spark.createDataFrame([(50_000, "x")], "k long, c string"))
    old_tree, new_tree = (merkle.stored(x, "k", "c", prefixes) for x in (base, new))
    assert merkle.unequal(old_tree, new_tree).count() == 4
    before = shuffled(spark)
    got = merkle.changes(old_tree, new_tree).collect()
    few = shuffled(spark) - before
    assert {x.key: x.change for x in got} == {17: "modified", 30_000: "modified", 123: "deleted", 50_000: "added"}
    before = shuffled(spark)
    assert merkle.changes(merkle.stored(base.withColumn("c", F.lit("y")), "k", "c", prefixes), old_tree).count() == 40_000
    assert few * 10 < shuffled(spark) - before
    assert merkle.changes(old_tree, old_tree).collect() == []
    none = merkle.stored(base.where("false"), "k", "c", prefixes)
    assert merkle.changes(none, old_tree).groupBy("change").count().collect() == [("added", 40_000)]
    assert merkle.changes(none, none).collect() == []


def test_views_are_inlined_in_order():
    sql = with_views("WITH x AS (SELECT 1) SELECT * FROM reachable, x")
    assert sql.startswith("WITH live_refs AS") and sql.index("chunk_refs AS") < sql.index("reachable AS") < sql.index("x AS (SELECT 1)")


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def timeline(rows, lease, most):
    """Expired claims (event_id, attempt, outcome) of one key's (event_id, type, hour) in order; the last claim stays open."""
    out, claim, tries = [], None, 0
    for event_id, kind, at in rows:
        if claim and at - claim[1] >= lease:
            tries += 1
            out.append((claim[0], tries, "dead-letter" if tries >= most else "requeued"))
            tries = 0 if tries >= most else tries
        claim = (event_id, at) if kind == "click" else None
        tries = 0 if kind == "purchase" else tries
    return out


def test_leases_over_a_restart(spark, tmp_path):
    """Rows in four files, read one a micro-batch by two runs of one query with one checkpoint: nothing is lost or told twice,
    and claims without a later event expire by timer as soon as the watermark has passed."""
    r = random.Random(8)
    hours = sorted(r.sample(range(1000, 1400), 160))
    rows = [(i, r.randrange(6), r.choice(["click", "click", "click", "view", "purchase"]), h) for i, h in enumerate(hours)]
    rows += [(500, 77, "click", hours[-1]), (501, 78, "view", hours[-1] + 3), (502, 78, "view", hours[-1] + 8)]
    at = str(tmp_path)

    def put(k, some):
        df = spark.createDataFrame(some, "event_id long, user_id long, event_type string, h long")
        df.select("event_id", "user_id", "event_type", F.timestamp_seconds(F.col("h") * 3600).alias("ts")).coalesce(1).write.mode("append").parquet(f"{at}/events.parquet")
        time.sleep(1.1)  # files are read in order of their times

    def run():
        stream = timers.leases(states.events(spark, at, files_per_trigger=1))
        with timers.store(spark):
            q = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/check").trigger(availableNow=True).start()
            q.awaitTermination()

    put(0, rows[:50])
    put(1, rows[50:90])
    run()
    put(2, rows[90:130])
    put(3, rows[130:])
    run()
    got = sorted((x.user_id, x.event_id, x.attempt, x.outcome) for x in spark.read.parquet(f"{at}/out").collect())
    passed = max(h for *_, h in rows) - 1
    want = []
    for k in {x[1] for x in rows}:
        own = [(i, kind, h) for i, u, kind, h in rows if u == k]
        own += [(None, "view", passed)] if passed > own[-1][2] else []
        want += [(k, *x) for x in timeline(own, 6, 3)]
    assert got == sorted(want) and (77, 500, 1, "requeued") in got


def held_to_sql(spark, at, name, of, rows, parts):
    """Rows (event_id, user_id, event_type, seconds) read one file a micro-batch, told as the query's SQL tells them."""
    import duckdb

    from tessera import registry

    for some in parts:
        df = spark.createDataFrame(rows[some], "event_id long, user_id long, event_type string, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
        df.coalesce(1).write.mode("append").parquet(f"{at}/events.parquet")
        time.sleep(1.1)
    stream = states.events(spark, at, files_per_trigger=1)
    stream = stream.withColumns({"branch": F.col("event_id") % 3, "synced_at": F.unix_millis("ts") - F.col("event_id") % 5 * timers.HOUR})
    with timers.store(spark):
        got = states.drain(of(stream), "append").drop("__batch")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{at}/events.parquet/*.parquet'")
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    plain = lambda x: sorted(tuple(map(str, r)) for r in x)
    assert plain(got.select(*columns).collect()) == plain(want) and want
    return got.collect()


TIMED = {"x03t_lease_expiry": timers.leases, "x05t_worker_ageout": timers.ageouts, "x06t_orphan_ledger": timers.orphans, "x08t_tombstones": timers.tombstones}


@pytest.mark.parametrize("name", sorted(TIMED))
def test_timers_over_micro_batches(spark, tmp_path, monkeypatch, name):
    """Keys that share groups, a null key, deadlines that rows and the watermark hit exactly."""
    monkeypatch.setattr(timers, "BUCKETS", 3)
    r = random.Random(3)
    at = sorted(r.sample(range(1000, 1250), 120))
    keys = [*range(9)] if name == "x06t_orphan_ledger" else [*range(8), None]  # its SQL joins by key
    rows = [(i, r.choice(keys), r.choice(["click", "click", "view", "purchase", "error", "error"]), h * 3600) for i, h in enumerate(at)]
    last = at[-1] * 3600
    rows += [(1000 + i, 50 + i, "click", last - 3600 - hours * 3600) for i, hours in enumerate((6, 24))] + [(1010, 60, "click", last - 3600 * 7 + 1)]
    rows.sort(key=lambda x: x[3])
    held_to_sql(spark, str(tmp_path), name, TIMED[name], rows, [slice(0, 50), slice(50, 90), slice(90, None)])


def test_orphans_wait_for_the_watermark(spark, tmp_path):
    """A key that is found an orphan again past its grace is told when the watermark has passed that, not before."""
    h = 3600
    rows = [(1, 7, "view", 1000 * h), (2, 8, "view", 1000 * h), (3, 8, "purchase", 1024 * h), (4, 9, "view", 999 * h), (5, 7, "view", 1024 * h + 60), (6, 7, "error", 1024 * h + 90)]
    got = held_to_sql(spark, str(tmp_path), "x06t_orphan_ledger", timers.orphans, rows, [slice(None)])
    assert sorted(x.event_id for x in got) == [2, 4]


def test_reassembly_drops_what_is_too_late(spark, tmp_path):
    """A file is told once, when its last expected fragment has come; a fragment behind the watermark completes nothing."""
    day = 86_400

    def put(name, rows, schema, time_column):
        df = spark.createDataFrame(rows, schema).withColumn(time_column, F.timestamp_seconds(F.col(time_column) * day))
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}.parquet")
        time.sleep(1.1)

    put("manifests", [(1, 2, 1000), (2, 1, 1000), (3, 1, 1100)], "id long, expected long, since long", "since")
    put("fragments", [(1, 1, 1010), (2, 1, 1010), (2, 2, 1011), (9, 1, 1100)], "file long, part long, ts long", "ts")
    put("fragments", [(9, 2, 1100)], "file long, part long, ts long", "ts")  # manifest 1 leaves the state
    put("fragments", [(1, 2, 1012), (3, 1, 1101), (3, 2, 1102)], "file long, part long, ts long", "ts")
    streams = [states.table(spark, str(tmp_path), x, files_per_trigger=1) for x in ("fragments", "manifests")]
    with timers.store(spark):
        got = states.drain(timers.reassembled(*streams), "append").collect()
    assert sorted((x.user_id, x.fragments, x.completed_at // 1000 // day) for x in got) == [(2, 1, 1010), (3, 1, 1101)]


def test_reassembly_over_micro_batches(spark, tmp_path, monkeypatch):
    """Fragments ahead of their manifest, two manifests of one file, the ends of the range, and null keys: one state, no join of streams."""
    monkeypatch.setattr(timers, "BUCKETS", 2)
    day = 86_400

    def put(name, rows, schema, time_column):
        df = spark.createDataFrame(rows, schema).withColumn(time_column, F.timestamp_micros((F.col(time_column) * day * 1_000_000).cast("long")))
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}.parquet")
        time.sleep(1.1)

    kinds = {"manifests": ("id long, expected long, since double", "since"), "fragments": ("file long, part long, ts double", "ts")}
    parts = {
        "fragments": [[(1, 1, 1003.0), (2, 1, 1002.0), (None, 1, 1002.0), (4, 1, 1001.0)], [(1, 2, 1005.0), (2, 2, 1006.0), (3, 1, 1060.0), (4, 2, 1060.0 + 1e-6)], [(5, 1, 1062.0), (5, 2, 1063.0)]],
        "manifests": [[(2, 2, 1001.0), (None, 1, 1001.0)], [(1, 2, 1002.0), (3, 1, 1000.0), (4, 1, 1000.0 + 1e-6), (4, 3, 1001.0)], [(5, 2, 1061.0)]],
    }
    for name, some in parts.items():
        for rows in some:
            put(name, rows, *kinds[name])
    streams = [states.table(spark, str(tmp_path), x, files_per_trigger=1) for x in ("fragments", "manifests")]
    out = timers.reassembled(*streams)
    assert "Join" not in out._jdf.queryExecution().analyzed().toString()
    with timers.store(spark):
        got = states.drain(out, "append").collect()
    # file 4: the fragment of day 1001 under both manifests, the first of which is complete with it
    assert sorted((x.user_id, x.fragments, x.completed_at // 1000 // day) for x in got) == [(1, 2, 1005), (2, 2, 1006), (3, 1, 1060), (4, 1, 1001), (5, 2, 1063)]
