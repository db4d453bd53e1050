"""Packing token sequences into bins of fixed capacity by minimum bin slack.

A bin is filled by the fullest feasible combination of the lengths that are left, found by
a subset-sum dynamic programme over bitsets; that combination is removed, as often as the
counts allow, and the next one is sought. Only the counts per length (at most ``capacity``
numbers, whatever the input) reach the driver; pieces are numbered within their length and
placed by an arithmetic lookup.

Defined results: a null text is an empty one, whose only id is the end; every row is a document of its own, also with a repeated or
null doc_id; of pieces of one length any may take a place, so ties change which document lies where and not how many
sequences there are; a text of any length is encoded whole and cut into pieces; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import gc
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_batches, written

#: Entries of a cache generation; two generations are held.
RETAINED = 500_000
#: Characters that are a pre-token of their own where one of them ends a run after a letter.
TAILS = ".,;:!?$&%#*|<>)"


class Encoder:
    """Ids of whole texts by a byte-level BPE file of the tokenizers library.

    Its pattern starts a new pre-token at a space that a visible character follows, so a text
    is the concatenation of such runs: each run is encoded once and kept for the next texts.
    Texts in which a space stands before another white space, or at the end, or that hold a
    special token's opening, are encoded as they are. A mark at the end of a run is a pre-token of its own after a letter,
    so the run without it is what is encoded.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        # runs are kept here, so the model's own cache would hold them in vain
        self.tok.model._resize_cache(0)
        self.tails = {c: ids.tobytes() for c, ids in zip(TAILS, self._ids(list(TAILS)))}
        size = self.tok.get_vocab_size()
        self.width = np.array([len(self.tok.id_to_token(i) or "") for i in range(size)], np.int64)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Encode runs (a space and the word), many in one text, and cut the ids by their widths in bytes."""
        groups = [words[i : i + 200] for i in range(0, len(words), 200)]
        for g, ids in zip(groups, self._ids([" " + " ".join(g) for g in groups])):
            ends = np.cumsum([len(x.encode()) + 1 for x in g])
            cut = np.searchsorted(np.cumsum(self.width[ids]), ends) + 1
            raw, at = ids.tobytes(), 0
            for x, k in zip(g, (cut * 4).tolist()):
                self.young[x] = raw[at:k]
                at = k

    def many(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text. Nothing here refers to itself, so the collector, which would go through all
        words again and again, waits."""
        on = gc.isenabled()
        gc.disable()
        try:
            return self._many(texts)
        finally:
            if on:
                gc.enable()

    def _many(self, texts: list[str]) -> list[bytes]:
        if len(self.young) > RETAINED:
            self.old, self.young = self.young, {}
        young, old, get = self.young, self.old, self.young.get
        out: list = [None] * len(texts)
        whole, late, miss, ended = [], [], set(), set()
        for i, t in enumerate(texts):
            if "<|" in t:
                whole.append((i, t))
                continue
            head, *rest = t.split(" ")
            got = list(map(get, rest))
            if None in got:
                gaps = [k for k, v in enumerate(got) if v is None]
                # kept runs never begin with a white space
                if any(not rest[k] or rest[k][0].isspace() for k in gaps):
                    whole.append((i, t))
                    continue
                for k in gaps:
                    x = rest[k]
                    if x in old:
                        young[x] = old[x]
                    elif self._ends(x):
                        ended.add(x)
                        core = x[:-1]
                        if core in old:
                            young[core] = old[core]
                        elif core not in young:
                            miss.add(core)
                    else:
                        miss.add(x)
                late.append((i, rest, got, gaps))
            else:
                out[i] = b"".join(got)
            whole.append((i, head))
        self._learn(list(miss))
        for x in ended:
            young[x] = young[x[:-1]] + self.tails[x[-1]]
        for i, rest, got, gaps in late:
            for k in gaps:
                got[k] = young[rest[k]]
            out[i] = b"".join(got)
        for (i, _), ids in zip(whole, self._ids([t for _, t in whole])):
            out[i] = ids.tobytes() + (out[i] or b"")
        for x in [x for x in miss if len(x) > 64]:
            del young[x]
        return out

    def _ends(self, x: str) -> bool:
        """Whether a short run ends with a letter and one mark."""
        return x[-1] in self.tails and 1 < len(x) <= 64 and x[-2].isalpha() and x[-2] < "\u0250"


_encoders: dict[str, Encoder] = {}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """One row per piece of every document: (doc_id, piece, start, length, ids_crc32, part, nth).

    A text's ids and then end_id; a null or empty text gives end_id alone. A longer row is cut
    into pieces of ``capacity`` ids, the first being the remainder. (part, nth) number the pieces
    of one length within one input partition. Repeated doc_ids are packed each.
    """

    def run(batches):
        from pyspark import TaskContext

        if tokenizer not in _encoders:
            _encoders[tokenizer] = Encoder(tokenizer)
        enc = _encoders[tokenizer]
        part, count = TaskContext.get().partitionId(), {}
        last = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo in range(0, len(ids), 256):
                rows = []
                for d, raw in zip(ids.slice(lo, 256).to_pylist(), enc.many([t or "" for t in texts.slice(lo, 256).to_pylist()])):
                    raw += last
                    n = len(raw) // 4
                    at, k = 0, 0
                    while at < n:
                        size = (n % capacity or capacity) if at == 0 else capacity
                        nth = count.get(size, 0)
                        count[size] = nth + 1
                        b = raw[4 * at : 4 * (at + size)]
                        rows.append((d, k, at, size, zlib.crc32(b), part, nth, *([b] if with_ids else [])))
                        at, k = at + size, k + 1
                cols = list(zip(*rows))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names[: len(cols)])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long" + (", ids binary" if with_ids else "")
    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, schema)


def fullest(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """The combination (length, how many) with the largest total of at most capacity.

    It holds the longest length left (that one is the hardest to place later); ties prefer
    long lengths, so that short ones stay for the last gaps.
    """
    longest = max(counts)
    room = capacity - longest
    full = (1 << (room + 1)) - 1
    reach, trail = 1, []
    for n in sorted((x for x in counts if x <= room), reverse=True):
        left = min(counts[n] - (n == longest), room // n)
        k = 1
        while left > 0:
            k = min(k, left)
            new = (reach | reach << (n * k)) & full
            if new != reach:
                trail.append((n, k, reach))
                reach = new
            left -= k
            k *= 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    take = {longest: 1}
    for n, k, before in reversed(trail):
        if not before >> at & 1:
            take[n] = take.get(n, 0) + k
            at -= n * k
    return sorted(take.items(), reverse=True)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int, int]]:
    """Rows (length, first rank, last rank + 1, first sequence, copies per bin, offset, used before).

    A combination is repeated until one of its lengths runs out, so there are at most as many
    combinations as lengths. Within a row, rank r goes to bin first + (r - rank) // copies.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)
    out, seq = [], 0
    while left:
        take = fullest(left, capacity)
        times = min(left[n] // k for n, k in take)
        at = 0
        for n, k in take:
            out.append((n, used[n], used[n] + k * times, seq, k, at, 0))
            used[n] += k * times
            at += n * k
            left[n] -= k * times
            if not left[n]:
                del left[n]
        seq += times
    return out


def pack(found: DataFrame, capacity: int = 1024) -> DataFrame:
    """Place pieces (see :func:`pieces`): adds sequence_id and offset, keeps the other columns."""
    found = written(found, "pieces")
    per = written(found.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    counts = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    spark = found.sparkSession
    rows = plan(counts, capacity)
    w = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("part", "length", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base"))
    ranked = found.join(base.hint("merge"), ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    for n, lo, hi, seq, k, at, _ in rows:
        slots.setdefault(n, []).append((lo, hi, seq, k, at))
    # one short array per length (at most a few entries for each combination): a bounded table
    table = spark.createDataFrame(
        [(n, [dict(zip(("lo", "hi", "seq", "k", "at"), s)) for s in v]) for n, v in slots.items()],
        "length long, slots array<struct<lo long, hi long, seq long, k long, at long>>",
    )
    out = ranked.join(F.broadcast(table), "length")
    out = out.withColumn("s", F.get(F.filter("slots", lambda s: (s["lo"] <= F.col("rank")) & (F.col("rank") < s["hi"])), F.lit(0)))
    i = F.col("rank") - F.col("s.lo")
    out = out.withColumns(
        {
            "sequence_id": (F.col("s.seq") + F.floor(i / F.col("s.k"))).cast("long"),
            "offset": (F.col("s.at") + (i % F.col("s.k")) * F.col("length")).cast("long"),
        }
    )
    return out.select(*[c for c in found.columns if c not in ("part", "nth")], "sequence_id", "offset")
