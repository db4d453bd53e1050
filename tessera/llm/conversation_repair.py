"""Conversation repair: the cheapest edits after which the roles of a conversation follow the pattern s?(ua)+ or nothing is left.

Rows are read in the order of turn (nulls first), role, text. The search runs over the four states that a prefix can end in
(nothing, s, u, a). Its edits are macro edits, an insert-run of nought to two turns followed by what is done with the
row: D, K or R. Each macro's code ends at its only letter that is no I, so codes are free of prefixes, and so are the audit
strings of equally many rows: two of them are ordered by their first difference whatever follows. Hence no audit is ever
built during the search. A layer (a row) keeps, for each state, the cost, the rank of its audit among the layer's and a
parent pointer; the next layer orders its candidates by cost, rank of the parent and order of the macro's code.

A conversation is not bound to one task. Rows are dealt by ranges of the whole order, so a long conversation lies in
several segments. For a segment the search is run from each of the four states, which gives 4 x 4 costs and ranks; segments
of a conversation (at most as many as there are ranges) are then combined in order by the same rule, for which such a table
acts as one macro edit; that fixes the states at every segment's ends, and the parent pointers are followed inside
segments only.

Defined results: nulls in any column count as one space; the initial of a role is its first character, and an empty role has
none and fits nowhere; repeated rows are rows; equal conv_ids (null too) are one conversation. Longer insert-runs
cost more and lead to no other state. An empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, discard, map_batches, written

#: What a prefix of the repaired conversation can end in.
STATES = ["", "s", "u", "a"]
#: States in which a conversation may end.
FINAL = (0, 3)
#: Roles that are inserted, and that rows are changed to.
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
MOST = 1 << 60
#: Faults of a row.
BLANK, DUPLICATE, CUT = 1, 2, 3


def _after(state: int, initial: str) -> int | None:
    """The state after a turn of this initial, or None where the pattern forbids it."""
    return {("", "s"): 1, ("", "u"): 2, ("s", "u"): 2, ("a", "u"): 2, ("u", "a"): 3}.get((STATES[state], initial))


def _insert(state: int, run: int) -> int:
    """The state after a run of inserted turns; which roles they have follows from the state."""
    for _ in range(run):
        state = 3 if state == 2 else 2
    return state


@lru_cache(maxsize=64)
def macros(initial: str, fault: int) -> tuple:
    """(from state, to state, cost, order of the code, run, edit, new initial) of every macro edit of such a row."""
    out = []
    for state in range(4):
        for run in range(3):
            at = _insert(state, run)
            out.append((state, at, INSERT * run + DELETE, run, "D", ""))
            if fault in (BLANK, DUPLICATE):
                continue
            more = INSERT * run + (TRUNCATED if fault == CUT else 0)
            if (to := _after(at, initial)) is not None:
                out.append((state, to, more + KEEP, run, "K", initial))
            out += [(state, to, more + REROLE, run, "R", x) for x in ROLES if (to := _after(at, x)) is not None]
    codes = sorted({"I" * m[3] + m[4] for m in out})
    return tuple((a, b, c, codes.index("I" * r + e), r, e, x) for a, b, c, r, e, x in out)


@lru_cache(maxsize=1 << 16)
def layer(costs: tuple, edits: tuple) -> tuple[int, tuple, tuple]:
    """The next layer: what all its costs have in common, (cost above that, rank) by state, and the macro edit that leads to
    each state. Costs above the common part are few different ones, so layers repeat and are looked up."""
    best, how = [(MOST, 0, 0)] * 4, [None] * 4
    for m in edits:
        cost, rank = costs[m[0]]
        if cost < MOST and (x := (cost + m[2], rank, m[3])) < best[m[1]]:
            best[m[1]], how[m[1]] = x, m
    base = min(b[0] for b in best)
    order = sorted({b[1:3] for b in best if b[0] < MOST})
    ranked = tuple((b[0] - base, order.index(b[1:3])) if b[0] < MOST else (MOST, 0) for b in best)
    return base, ranked, tuple(how)


def start(state: int) -> tuple:
    """The layer before the first row, from one state."""
    return tuple((0, 0) if q == state else (MOST, 0) for q in range(4))


def ending(costs: list) -> tuple[int, int, int]:
    """(cost, state, trailing insert-run) of the best end."""
    ends = [(c + INSERT * run, rank, run, q) for q, (c, rank) in enumerate(costs) if c < MOST for run in range(3) if _insert(q, run) in FINAL]
    cost, _, run, q = min(ends)
    return cost, q, run


# ---------------------------------------------------------------- rows


def ordered(rows: DataFrame, text: str = "text") -> DataFrame:
    """The rows with nulls as one space and ``seq``, their place in the order of all conversations, written.

    Ranges of the order are cut by the whole row and, for rows that repeat, by where they come from, so neither a long
    conversation nor a row repeated without end is one task's.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    x = rows.select("conv_id", "turn", said("role"), said(text)).withColumn("__i", F.monotonically_increasing_id())
    key = ["conv_id", "turn", "role", text]
    x = x.repartitionByRange(*key, "__i").sortWithinPartitions(*key)
    return written(x.drop("__i").withColumn("seq", F.monotonically_increasing_id()), "rows")


def faults(rows: DataFrame) -> DataFrame:
    """(seq, conv_id, part, turn, initial, fault) of ordered rows: the narrow form on which the search runs.

    The first row of each (conversation, role, text) is found by an aggregation of hashes, and rows meet it by their own
    number: a text repeated without end is no key of a join.
    """
    narrow = rows.select("seq", "conv_id", "turn", F.substring("role", 1, 1).alias("initial"), F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256).alias("h"), _fault().alias("fault"))
    first = narrow.groupBy("conv_id", "h").agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("first"))
    both = narrow.join(first, "seq", "left")
    fault = F.when(F.col("fault") == BLANK, BLANK).when(F.col("first").isNull(), DUPLICATE).otherwise(F.col("fault"))
    return both.select("seq", "conv_id", F.shiftright("seq", 33).cast("int").alias("part"), "turn", "initial", fault.cast("int").alias("fault"))


def _fault() -> Column:
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return F.when(~F.col("text").rlike(WORD), BLANK).when(~last.isin(".", "!", "?"), CUT).otherwise(0)


def _groups(batches, key: list[str], columns: list[str]):
    """(key values, iterator of the rows' tuples) of each run of equal keys in sorted batches, without holding a run."""
    from itertools import groupby

    def rows():
        for b in batches:
            yield from zip(*[b.column(c).to_pylist() for c in [*key, *columns]])

    n = len(key)
    for k, own in groupby(rows(), key=lambda r: r[:n]):
        yield k, (r[n:] for r in own)


def _tables(rows, arrow, size: int = 4096):
    """Rows of tuples as Arrow batches."""
    import pyarrow as pa
    from itertools import islice

    rows = iter(rows)
    while some := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), arrow.types)], schema=arrow)


def segments(narrow: DataFrame) -> DataFrame:
    """One row per (conv_id, part): the search from each state, and what the counts need at the segment's ends."""

    def one(batches):
        for (conv, part), own in _groups(batches, ["conv_id", "part"], ["turn", "initial", "fault"]):
            n, count, illegal, first, last, turns, low, high = 0, [0] * 4, 0, None, None, 0, None, None
            bases, tables = [0] * 4, [start(p) for p in range(4)]
            for turn, initial, fault in own:
                illegal += bool(n) and last + initial not in ("su", "ua", "au")
                first, last = (first if n else initial), initial
                if turn is not None and turn != high:
                    turns, low, high = turns + 1, (turn if low is None else low), turn
                n, count[fault] = n + 1, count[fault] + 1
                m = macros(initial if initial in ("s", "u", "a") else "", fault)
                for p in range(4):
                    more, tables[p], _ = layer(tables[p], m)
                    bases[p] += more
            costs = [c if c == MOST else base + c for base, t in zip(bases, tables) for c, _ in t]
            yield (conv, part, n, *count[1:], illegal, first, last, turns, low, high, costs, [r for t in tables for _, r in t])

    arrow, schema = _schema(narrow, [("part", "int"), ("n", "long"), ("blank", "long"), ("duplicate", "long"), ("truncated", "long"), ("illegal", "long"), ("first", "string"), ("last", "string"), ("turns", "long"), ("low", "long"), ("high", "long"), ("costs", "array<long>"), ("ranks", "array<int>")])
    x = narrow.withColumn("turn", F.col("turn").cast("long")).repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "seq")
    return map_batches(x, lambda batches: _tables(one(batches), arrow), schema)


def _schema(df: DataFrame, columns: list[tuple[str, str]]):
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = df.schema["conv_id"].dataType.simpleString()
    text = ", ".join(f"{c} {k}" for c, k in [("conv_id", kind), *columns])
    return to_arrow_schema(df.sparkSession.createDataFrame([], text).schema), text


def decisions(found: DataFrame) -> DataFrame:
    """One row per (conv_id, part): the states at the segment's ends and the run inserted after it; on a conversation's first
    segment also its counts and its cost. A task holds one conversation's segments, of which there are at most as many as ranges."""

    def one(batches):
        columns = ["part", "n", "blank", "duplicate", "truncated", "illegal", "first", "last", "turns", "low", "high", "costs", "ranks"]
        for (conv,), own in _groups(batches, ["conv_id"], columns):
            own = list(own)
            base, costs, back = 0, start(0), []
            for x in own:
                edits = tuple((p, q, x[11][4 * p + q], x[12][4 * p + q]) for p in range(4) for q in range(4) if x[11][4 * p + q] < MOST)
                more, costs, how = layer.__wrapped__(costs, edits)
                base += more
                back.append(how)
            cost, q, tail = ending(costs)
            ends = []
            for how in reversed(back):
                ends.append((how[q][0], q))
                q = how[q][0]
            ends.reverse()
            total = [sum(x[k] for x in own) for k in range(2, 6)]
            total[3] += sum(a[7] + b[6] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
            known = [x for x in own if x[9] is not None]
            turns = sum(x[8] for x in known) - sum(a[10] == b[9] for a, b in zip(known, known[1:]))
            gaps = known[-1][10] - known[0][9] + 1 - turns if known else 0
            for i, (x, (a, b)) in enumerate(zip(own, ends)):
                yield (conv, x[0], a, b, tail if i == len(own) - 1 else 0, *([gaps, *total, base + cost] if i == 0 else [None] * 6))

    arrow, schema = _schema(found, [("part", "int"), ("start", "int"), ("end", "int"), ("tail", "int"), ("gaps", "long"), ("blank", "long"), ("duplicate", "long"), ("truncated", "long"), ("illegal", "long"), ("cost", "long")])
    x = found.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return map_batches(x, lambda batches: _tables(one(batches), arrow), schema)


def edits(narrow: DataFrame, decided: DataFrame) -> DataFrame:
    """(conv_id, seq, before, edit, role, after): the inserted roles' initials, what is done with the row, its new role if it
    is changed, and what is inserted after a conversation's last row. Parent pointers of one segment are held."""

    def one(batches):
        for (conv, _), own in _groups(batches, ["conv_id", "part"], ["seq", "initial", "fault", "start", "end", "tail"]):
            back, seqs, costs = [], [], None
            for seq, initial, fault, begin, end, tail in own:
                costs = start(begin) if costs is None else costs
                _, costs, how = layer(costs, macros(initial if initial in ("s", "u", "a") else "", fault))
                back.append(how)
                seqs.append(seq)
            q = end
            for i in range(len(back) - 1, -1, -1):
                back[i] = m = back[i][q]
                q = m[0]
            for i, (seq, m) in enumerate(zip(seqs, back)):
                yield (conv, seq, _roles(m[0], m[4]), m[5], ROLES[m[6]] if m[5] == "R" else None, _roles(end, tail) if i == len(seqs) - 1 else "")

    arrow, schema = _schema(narrow, [("seq", "long"), ("before", "string"), ("edit", "string"), ("role", "string"), ("after", "string")])
    same = narrow["conv_id"].eqNullSafe(decided["conv_id"]) & (narrow["part"] == decided["part"])
    x = narrow.join(decided.select("conv_id", "part", "start", "end", "tail"), same).select(narrow["conv_id"], narrow["part"], "seq", "initial", "fault", "start", "end", "tail")
    x = x.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "seq")
    return map_batches(x, lambda batches: _tables(one(batches), arrow), schema)


def _roles(state: int, run: int) -> str:
    """Initials of a run of inserted turns."""
    out = ""
    for _ in range(run):
        state = _insert(state, 1)
        out += STATES[state]
    return out


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edited rows, conversations) of rows (conv_id, turn, role, text).

    Edited rows: seq (their order), conv_id, turn, role and text as they were, before, edit, new_role, after (see :func:`edits`).
    Conversations: conv_id, gaps, blank, duplicate, truncated, illegal, cost.
    """
    placed = ordered(rows)
    narrow = written(faults(placed), "narrow")
    decided = written(decisions(segments(narrow)), "decisions")
    done = edits(narrow, decided).withColumnRenamed("role", "new_role").drop("conv_id")
    out = written(placed.join(done, "seq"), "edited")
    discard(placed)
    discard(narrow)
    return out, decided.where("cost IS NOT NULL").drop("part", "start", "end", "tail")


def digests(edited: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired_sha256) of edited rows. A sha256 reads its bytes in order, so a conversation is one task's
    stream here, of which only the audit is held."""
    import hashlib

    def one(batches):
        for (conv,), own in _groups(batches, ["conv_id"], ["role", "text", "before", "edit", "new_role", "after"]):
            audit, sha, between = [], hashlib.sha256(), ""
            for role, text, before, edit, new, after in own:
                said = [f"{ROLES[x]}:" for x in before]
                if edit != "D":
                    said.append(f"{new or role}:{text}")
                said += [f"{ROLES[x]}:" for x in after]
                audit.append("I" * len(before) + edit + "I" * len(after))
                for s in said:
                    sha.update((between + s).encode("utf-8", "surrogatepass"))
                    between = "\n"
            yield conv, "".join(audit), sha.hexdigest()

    arrow, schema = _schema(edited, [("audit", "string"), ("repaired_sha256", "string")])
    x = edited.select("conv_id", "seq", "role", "text", "before", "edit", "new_role", "after")
    x = x.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return map_batches(x, lambda batches: _tables(one(batches), arrow, 1024), schema)


# ---------------------------------------------------------------- the query's damage


def damaged(rows: DataFrame) -> DataFrame:
    """Rows damaged by crc32(conv_id:turn) % 20: dropped, emptied, without stops, repeated, made the user's."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    x = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), (F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20).alias("__k"))
    text = F.when(F.col("__k") == 1, "").when(F.col("__k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("__k") == 4, "user").otherwise(F.col("role"))
    x = x.where("__k <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), "__k")
    return x.select("*", F.explode(F.when(F.col("__k") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("col", "__k")


def report(rows: DataFrame) -> DataFrame:
    """One row per conv_id of ``rows``, damaged and repaired."""
    edited, counts = repair(damaged(rows))
    own = digests(edited)
    counts, own = counts.withColumnRenamed("conv_id", "c"), own.withColumnRenamed("conv_id", "d")
    ids = rows.select("conv_id").distinct()
    out = ids.join(counts, ids["conv_id"].eqNullSafe(counts["c"]), "left").join(own, ids["conv_id"].eqNullSafe(own["d"]), "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
