"""Quality rules as a bitmask ledger (DataFrame functions only).

Every rule is evaluated once per document into one bit of ``failed``; the measurements
stand beside it. A policy is a version name and a mask of the rules it applies, so a new
policy, or an ablation of one rule, is arithmetic on the ledger and reads no text.

Defined results: a null or empty text has no words and fails ``min_words`` and no other rule; rules are judged row by row, so repeated
rows and ties of any kind are judged alike, and each keeps its row; a text of any length is read whole; an empty table
gives an empty ledger; other columns stay, and those named like a measurement are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

#: Rule name, in bit order, and its condition over the measurements (true: it fails).
RULES: list[tuple[str, str]] = [
    ("min_words", "n_words < 50"),
    ("repeat_words", "100 * n_repeat_words > 50 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 12 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("dup_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("upper_case", "2 * n_upper_words > n_words"),
    ("alpha_words", "5 * n_alpha_words < 4 * n_words"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: Policy versions: the mask of the rules that reject.
POLICIES: dict[str, int] = {
    "base": BIT["min_words"] | BIT["repeat_words"],
    "v1": sum(BIT.values()),
    "lenient": BIT["min_words"] | BIT["repeat_words"] | BIT["symbols"],
}


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measurements of ``text`` to every row; a null text counts as empty.

    Columns of the same names in ``docs`` are replaced; all other columns stay.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("__w", F.regexp_extract_all(t, F.lit(WORD), F.lit(0)))
    n = F.size("__w")
    out = out.withColumn(
        "__tri",
        F.when(n < 3, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2)))
        ),
    )
    out = out.withColumn(
        "__s",
        F.when(F.size(F.array_distinct("__tri")) == F.size("__tri"), F.lit(None)).otherwise(
            F.sort_array(F.transform("__tri", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        ),
    )
    out = out.withColumn(
        "__f",
        F.filter("__s", lambda x, j: F.coalesce(F.get("__s", j + 1)["h"] == x["h"], F.lit(False)) | ((j > 0) & (F.get("__s", F.greatest(j - 1, F.lit(0)))["h"] == x["h"]))),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("__f", lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    out = out.withColumn("__l", F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)))
    measures: dict[str, Column] = {
        "n_words": n.cast("long"),
        "word_chars": F.aggregate("__w", F.lit(0).cast("long"), lambda a, w: a + F.length(w)),
        "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_lines": F.size("__l").cast("long"),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
        "n_repeat_words": F.when(F.col("__s").isNull(), F.lit(0)).otherwise(covered).cast("long"),
        "n_upper_words": F.size(F.filter("__w", lambda w: (w == F.upper(w)) & (w != F.lower(w)))).cast("long"),
        "n_alpha_words": F.size(F.filter("__w", lambda w: w.rlike(r"\p{L}"))).cast("long"),
    }
    keep = [c for c in docs.columns if c not in measures]
    # a generator, so that a filter on the measurements is never pushed below them and evaluated anew
    row = F.inline(F.array(F.struct(*[v.alias(k) for k, v in measures.items()])))
    return out.select(*[F.col(f"`{c}`") for c in keep], row)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements and ``failed`` (bigint, bit i: RULES[i] fails)."""
    bits = None
    for i, (_, cond) in enumerate(RULES):
        bit = F.when(F.expr(cond), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return measured(docs, text).withColumn("failed", bits)


def apply_policy(rows: DataFrame, version: str = "v1") -> DataFrame:
    """Add ``kept``: no rule of the policy fails."""
    return rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(POLICIES[version])) == 0)


def ablation(rows: DataFrame, version: str = "v1") -> DataFrame:
    """Per rule of a policy: rows that fail it, that only it rejects, and that stay without it.

    One pass of bitwise sums over the ledger, whatever the number of rules.
    """
    mask = POLICIES[version]
    hit = F.col("failed").bitwiseAND(F.lit(mask))
    names = [r for r in BIT if BIT[r] & mask]
    sums = [F.count(F.when(hit.bitwiseAND(F.lit(BIT[r])) != 0, 1)).alias(f"f_{r}") for r in names]
    sums += [F.count(F.when(hit == BIT[r], 1)).alias(f"o_{r}") for r in names]
    one = rows.agg(*sums, F.count(F.when(hit == 0, 1)).alias("stay"))
    return one.select(
        F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"f_{r}").alias("n_failed"), F.col(f"o_{r}").alias("n_only"), (F.col("stay") + F.col(f"o_{r}")).alias("n_kept_without")) for r in names]))
    )
