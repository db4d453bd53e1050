"""The registered queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

import importlib
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    return substring_dedup(_read(spark, sf_dir, "documents"), 50, with_text=False)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import packing

    found = packing.pieces(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(found)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity
    from .common import crc_of_id

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_of_id() % 3 == 1
    train = _read(spark, sf_dir, "labels").where(~held_out)
    out = toxicity.score(docs, toxicity.fit(train, docs))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "evidence")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contaminated

    return contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_rules as q

    rows = q.apply_policy(q.ledger(_read(spark, sf_dir, "documents").select("doc_id", "text")), "v1")
    base = F.col("failed").bitwiseAND(F.lit(q.POLICIES["base"])) != 0
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", F.col("failed").alias("failed_bits")
    )


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    return extract(_read(spark, sf_dir, "pages"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lang_id
    from .common import crc_of_id

    docs = _read(spark, sf_dir, "documents")
    held_out = crc_of_id() % 5 == 0
    model = lang_id.fit(docs.where(~held_out).select("doc_id", "text", "lang"))
    out = lang_id.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    out = line_dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_gone").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long")
    # equal texts are neighbours in the order, so a group of copies is cut by as few boundaries as its bytes need
    rows = docs.withColumns({"k1": F.xxhash64("text"), "size": size, "text_crc32": F.crc32(F.coalesce("text", F.lit("")))})
    slices = max(1, math.ceil(int(spark.conf.get("spark.sql.shuffle.partitions")) / 24))
    out = sharding.shard(rows.select("doc_id", "size", "text_crc32", "k1"), 24, "k1", "doc_id", "size", slices=slices)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversation_repair import report

    return report(_read(spark, sf_dir, "conversations"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import token_counts

    out = token_counts(_read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.withColumn("over_limit", F.col("n_tokens") > 4096)


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import report

    return report(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), k=8, rounds=10)


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op")} | {"pipeline": _pipeline}


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


_OP6 = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT *, len(w) AS n, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
m AS (
  SELECT doc_id, n AS n_words, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
    CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
    len(list_filter(w, lambda x: x = upper(x) AND x <> lower(x))) AS n_upper_words,
    len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) AS n_alpha_words
  FROM p),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g FROM p, LATERAL (SELECT unnest(range(1, n - 1)) AS i) WHERE n >= 3),
dup AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS r FROM dup, (VALUES (0), (1), (2)) v(k) GROUP BY 1),
b AS (
  SELECT m.*, coalesce(r, 0) AS n_repeat_words,
    CAST(n_words < 50 AS INT) + 2 * CAST(100 * coalesce(r, 0) > 50 * n_words AS INT) + 4 * CAST(word_chars < 2 * n_words AS INT)
    + 8 * CAST(word_chars > 12 * n_words AS INT) + 16 * CAST(10 * n_symbols > n_words AS INT) + 32 * CAST(10 * n_dup_lines > 3 * n_lines AS INT)
    + 64 * CAST(2 * n_upper_words > n_words AS INT) + 128 * CAST(5 * n_alpha_words < 4 * n_words AS INT) AS failed
  FROM m LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept,
  CAST(failed AS BIGINT) AS failed_bits
FROM b
"""


#: The search with whole audit strings in place of ranks; crc32 bit by bit.
_OP11 = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s
  FROM conversations),
k AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(s, ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda h, b: list_reduce(list_prepend(xor(h, b), range(8)), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 20 AS k
  FROM c),
d AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM k WHERE k <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS rn FROM d),
f AS (
  SELECT conv_id, rn, turn, role, text, substr(role, 1, 1) AS ini,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 THEN 2
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault
  FROM n),
stat AS (
  SELECT conv_id, max(rn) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
    count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (before || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(ini) OVER (PARTITION BY conv_id ORDER BY rn) AS before FROM f) GROUP BY 1),
run(src, len, mid, said) AS (VALUES ('', 0, '', []::VARCHAR[]), ('', 1, 'u', ['user:']), ('', 2, 'a', ['user:', 'assistant:']), ('s', 0, 's', []), ('s', 1, 'u', ['user:']),
  ('s', 2, 'a', ['user:', 'assistant:']), ('u', 0, 'u', []), ('u', 1, 'a', ['assistant:']), ('u', 2, 'u', ['assistant:', 'user:']), ('a', 0, 'a', []), ('a', 1, 'u', ['user:']), ('a', 2, 'a', ['user:', 'assistant:'])),
op(mid, edit, dst, price) AS (
  SELECT mid, 'K', dst, 0 FROM (VALUES ('', 's'), ('', 'u'), ('s', 'u'), ('a', 'u'), ('u', 'a')) v(mid, dst)
  UNION ALL SELECT mid, 'R', dst, 3 FROM (VALUES ('', 'u'), ('s', 'u'), ('a', 'u'), ('u', 'a')) v(mid, dst)
  UNION ALL SELECT mid, 'D', mid, 4 FROM (VALUES (''), ('s'), ('u'), ('a')) v(mid)),
g(conv_id, rn, st, best) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), '', {'cost': CAST(0 AS BIGINT), 'audit': '', 'said': []::VARCHAR[]} FROM d
  UNION ALL
  SELECT f.conv_id, f.rn, op.dst, min({
    'cost': g.best.cost + 3 * len + price + CASE WHEN edit <> 'D' AND fault = 3 THEN 3 ELSE 0 END, 'audit': g.best.audit || repeat('I', len) || edit,
    'said': g.best.said || run.said || CASE edit WHEN 'K' THEN [role || ':' || text] WHEN 'R' THEN [CASE op.dst WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || text] ELSE [] END})
  FROM g JOIN f ON f.conv_id IS NOT DISTINCT FROM g.conv_id AND f.rn = g.rn + 1 JOIN run ON run.src = g.st JOIN op ON op.mid = run.mid
  WHERE edit = 'D' OR (fault NOT IN (1, 2) AND (edit = 'R' OR ini = op.dst))
  GROUP BY 1, 2, 3),
e AS (
  SELECT stat.*, (SELECT min({'cost': g.best.cost + 3 * len, 'audit': g.best.audit || repeat('I', len), 'said': g.best.said || run.said})
    FROM g JOIN run ON run.src = g.st AND run.mid IN ('', 'a') WHERE g.conv_id IS NOT DISTINCT FROM stat.conv_id AND g.rn = stat.n) AS best
  FROM stat)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM i.conv_id
"""


def _op13(k: int = 8, rounds: int = 10) -> str:
    """Every vector against every centroid, a common table for each round."""
    square = "list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT"
    near = lambda r: f"SELECT id, vec_id, any_value(v) AS v, min({{'d': {square}, 'j': j}}) AS m FROM v, c{r} GROUP BY 1, 2"
    mean = "((s - (s % n + n) % n) // n)::BIGINT"
    ctes = [
        "v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(embedding) = 64)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS j, v AS c FROM (SELECT sha256('3:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM v ORDER BY h, v LIMIT {k}))",
    ]
    for r in range(rounds):
        ctes.append(f"a{r} AS MATERIALIZED ({near(r)})")
        ctes.append(
            f"c{r + 1} AS MATERIALIZED (SELECT c.j, coalesce(x.c, c.c) AS c FROM c{r} c LEFT JOIN (SELECT j, list({mean} ORDER BY i) AS c FROM "
            f"(SELECT m.j AS j, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2) GROUP BY 1) x ON x.j = c.j)"
        )
    return f"""WITH {", ".join(ctes)}, e AS ({near(rounds)})
SELECT vec_id, m.j::INT AS cluster, m.d AS distance, sum(m.d) OVER (PARTITION BY m.j)::BIGINT AS cluster_inertia, sum(m.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM e JOIN c{rounds} ON j = m.j"""


def oracle_sql() -> dict[str, str]:
    out = {"op6_quality_rules": _OP6, "op11_conversation_repair": _OP11, "op13_centroid_clustering": _op13()}
    sql = getattr(importlib.import_module("corpus_pipeline"), "ORACLE_SQL", None)
    return out | ({"pipeline": sql} if sql else {})
