"""Stored chunks and indexes, exact ranks and places of rows."""

import hashlib
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tessera.operators import folds, intervals, ranks
from tessera.sources.chunk_table import ChunkTable
from tessera.sources.object_index import ObjectIndex


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_chunks_are_put_once_and_found_by_hash(spark, tmp_path):
    store = ChunkTable(spark, f"file://{tmp_path}/chunks")
    texts = ["", "a", "b", "é" * 50, *[f"text {i}" for i in range(300)]]
    assert store.rows().count() == 0 and store.get(sha("a")).collect() == []
    df = spark.createDataFrame([(t,) for t in [*texts, *texts, None]], "t string")
    store.put(df.where("t <> 'a'"), "t")
    store.put(df, "t")
    store.put(df, "t")
    assert {(x.hash, bytes(x.content), x.size) for x in store.rows().collect()} == {(sha(t), t.encode(), len(t.encode())) for t in texts}
    assert store.rows().count() == len(texts) and store.corrupt().collect() == []
    one = store.get(sha("a"))
    assert [bytes(x.content) for x in one.collect()] == [b"a"]
    assert store.rows().where(F.col("hash") == sha("a")).where(F.col("prefix") == sha("a")[:2]).select(F.input_file_name()).distinct().count() == 1
    said = plan(one)
    assert "PartitionFilters: [" in said and sha("a")[:2] in said.split("PartitionFilters: [")[1].split("]")[0]
    assert f"EqualTo(hash,{sha('a')[:4]}" in said or f"In(hash, [{sha('a')[:4]}" in said or "PushedFilters: [IsNotNull(hash), EqualTo(hash" in said


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    store = ChunkTable(spark, f"file://{tmp_path}/chunks")
    store.put(spark.createDataFrame([("kept",)], "t string"), "t")
    rows = spark.range(2000).select(F.when(F.col("id") == 1999, F.raise_error(F.lit("lost"))).otherwise(F.concat(F.lit("t"), F.col("id"))).cast("string").alias("t"))
    with pytest.raises(Exception, match="lost"):
        store.put(rows, "t")
    assert [bytes(x.content) for x in store.rows().collect()] == [b"kept"]


def test_chunks_on_a_path_that_only_spark_opens(spark, tmp_path):
    (tmp_path / "real").mkdir()
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.chunks.link./s", f"file://{tmp_path}/real")
    store = ChunkTable(spark, "viewfs://chunks/s/store")
    store.put(spark.createDataFrame([("abcdef",), ("xyz",)], "t string"), "t")
    wanted = spark.createDataFrame([(1, sha("abcdef"), 2, 3), (2, sha("xyz"), 0, 3)], "i int, h string, at long, n long")
    assert {x.i: bytes(x.part) for x in store.ranges(wanted, "h", "at", "n").collect()} == {1: b"cde", 2: b"xyz"}
    for h, at, n in ((sha("xyz"), 1, 3), (sha("xyz"), 3, 0), (sha("none"), 0, 1)):
        with pytest.raises(Exception, match="no such range"):
            store.ranges(spark.createDataFrame([(h, at, n)], "h string, at long, n long"), "h", "at", "n").collect()


def test_corrupt_chunks_are_named(spark, tmp_path):
    store = ChunkTable(spark, f"file://{tmp_path}/chunks")
    store.put(spark.createDataFrame([("good",)], "t string"), "t")
    bad = spark.createDataFrame([(sha("x"), 1, bytearray(b"y"), sha("x")[:2]), (sha("z"), 9, bytearray(b"z"), sha("z")[:2])], "hash string, size long, content binary, prefix string")
    bad.write.mode("append").partitionBy("prefix").parquet(store.path)
    assert {x.hash for x in store.corrupt().collect()} == {sha("x"), sha("z")}


def test_an_index_is_read_where_it_lies(spark):
    packs = spark.range(5000).select((F.col("id") % 700).alias("oid"), F.concat(F.lit("p"), F.col("id") % 13).alias("pack"))
    index = ObjectIndex.build(packs, 8)
    asked = spark.createDataFrame([(3, "x"), (3, "y"), (699, "z"), (9999, "none")], "oid long, why string")
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = index.lookup(asked)
        want = {i: min(f"p{j % 13}" for j in range(i, 5000, 700)) for i in (3, 699)}
        assert {(x.why, x.pack) for x in found.collect()} == {("x", want[3]), ("y", want[3]), ("z", want[699]), ("none", None)}
        assert plan(found).count("Exchange hashpartitioning") == 1  # of what is asked
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)
        index.drop()


def test_quantiles_by_counting(spark, monkeypatch):
    """Few buckets, so that many rounds are needed; repeated, negative, huge and tiny values, one value, even and odd counts."""
    monkeypatch.setattr(ranks, "BUCKETS", 4)
    r = random.Random(2)
    groups = {"a": [r.gauss(0, 1) for _ in range(501)], "b": [r.choice([1.5, 2.5, -7.0]) for _ in range(400)], "c": [10.0**k for k in range(-300, 300, 7)], "d": [4.0], "e": [1.0, 2.0], "f": [-1.7e308, 1.7e308, 0.0, 1.0, -5e-324]}
    rows = [(k, v) for k, x in groups.items() for v in x] + [("g", None), ("a", None), ("g", float("nan"))]
    r.shuffle(rows)
    got = {x.k: x for x in ranks.quantiles(spark.createDataFrame(rows, "k string, v double").repartition(5), "k", "v", {"med": 0.5, "low": 0.25}).collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        v = sorted(v)
        at = (len(v) - 1) * 0.25
        low = v[int(at)] + (v[min(int(at) + 1, len(v) - 1)] - v[int(at)]) * (at - int(at))
        assert got[k].med == pytest.approx(statistics.median(v)) and got[k].low == pytest.approx(low)


def test_places_within_keys(spark):
    r = random.Random(3)
    rows = [(k, i) for k, n in (("a", 500), ("b", 3), (None, 40)) for i in range(n)]
    r.shuffle(rows)
    got = intervals.positions(spark.createDataFrame(rows, "k string, i long").repartition(6), "k", "i", "pos").collect()
    assert sorted((str(x.k), x.i, x.pos) for x in got) == sorted((str(k), i, i + 1) for k, i in rows)


def test_bounded_queue(spark):
    times = [0, 1, 2, 9, 10, 11, 11, 30]
    df = spark.createDataFrame([("k", t, i) for i, t in enumerate(times)], "k string, at long, i long")
    got = [x.accepted for x in folds.bounded_queue(df, "k", "at", "i", 10, 2).orderBy("i").collect()]
    assert got == [True, True, False, False, True, True, False, True]
