"""Token counts: pieces are counted once per distinct pre-token, and summed over each document's pre-token frequencies.

A pre-token is a maximal run of characters of which each neighbouring pair occurs inside some piece of the vocabulary. No
merge can cross a pair that is in no piece, so the pieces of a text are those of its pre-tokens side by side, and no
assumption about words or scripts is made. The text is first written as the library does: a space becomes U+2581,
and one more stands before the first character.

Steps: (1) distinct pre-tokens with the number of documents that hold them, summed within a task before they are
shuffled; (2) their pieces, counted once each; (3) documents meet the counts. The most frequent pre-tokens (at most
``frequent`` of them, a fixed bound) are handed to the tasks and summed in place, so no frequent word is ever a key of a
shuffle; all others are joined by pre-token. Ids are never kept: only their number is.

Defined results: a null or empty text has 0 bytes and 0 tokens; every row gives a row, also with a repeated or null doc_id;
a text of any length is read whole, in blocks; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_batches, written

#: What the library writes for a space.
SPACE = "▁"
#: A character of no piece; the library gives one token for it.
BREAK = "\n"
#: Characters looked at in one step.
BLOCK = 1 << 20
#: Distinct pre-tokens that a task holds before it hands them on.
HELD = 500_000
#: Most pre-tokens that are handed to every task.
FREQUENT = 1 << 17


@lru_cache(maxsize=2)
def model(path: str):
    """The library's processor, the class of each code point (0: in no piece) and which pairs of classes lie in a piece."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)
    pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size()) if not special(i)]
    chars = sorted(set("".join(pieces)))
    if BREAK in chars or len(sp.encode(BREAK)) != 2 or len(sp.encode("a")) != 1:
        raise ValueError("the model must put one space before a text and have no piece with a line break")
    kind = np.zeros(0x110000, np.uint16)
    kind[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
    pairs = np.zeros((len(chars) + 1, len(chars) + 1), bool)
    for p in pieces:
        k = kind[[ord(c) for c in p]]
        pairs[k[:-1], k[1:]] = True
    return sp, kind, pairs


def n_pieces(path: str, tokens: list[str]) -> list[int]:
    """Pieces of each pre-token: the library puts a space before a text, so a line break stands between it and the pre-token."""
    sp = model(path)[0]
    return [len(x) - 2 for x in sp.encode([BREAK + t for t in tokens], num_threads=1)]


def _starts(path: str, text: str) -> np.ndarray:
    _, kind, pairs = model(path)
    k = kind[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    return np.flatnonzero(~pairs[k[:-1], k[1:]]) + 1


def pretokens(path: str, texts: list[str | None]):
    """The Counter of each text's pre-tokens. Short texts are cut together, long ones in blocks."""
    i = 0
    while i < len(texts):
        j, parts, size = i, [], 0
        while j < len(texts) and (not parts or size < BLOCK):
            parts.append(SPACE + texts[j].replace(" ", SPACE) if texts[j] else "")
            size += len(parts[-1])
            j += 1
        if len(parts) == 1 and size > BLOCK:
            yield _long(path, parts[0])
        else:
            whole = "".join(parts)
            ends = np.cumsum([len(p) for p in parts])
            cut = np.union1d(_starts(path, whole), np.concatenate([[0], ends])) if whole else np.zeros(1, np.int64)
            at = cut.tolist()
            tokens = [whole[a:b] for a, b in zip(at, at[1:])]
            to = np.searchsorted(cut, ends).tolist()
            for a, b in zip([0, *to], to):
                yield Counter(tokens[a:b])
        i = j


def _long(path: str, text: str) -> Counter:
    out, rest = Counter(), ""
    for k in range(0, len(text), BLOCK):
        rest += text[k : k + BLOCK]
        at = [0, *_starts(path, rest).tolist()]
        out.update(rest[a:b] for a, b in zip(at, at[1:]))
        rest = rest[at[-1] :]
    out[rest] += 1
    return out


def dictionary(docs: DataFrame, path: str) -> DataFrame:
    """(token, docs, pieces): each distinct pre-token of the texts, how many documents hold it, and its pieces."""
    import pyarrow as pa

    def distinct(batches):
        held = Counter()

        def table():
            return pa.RecordBatch.from_pydict({"token": pa.array(list(held), pa.string()), "docs": pa.array(list(held.values()), pa.int64())})

        for batch in batches:
            for own in pretokens(path, batch.column(0).to_pylist()):
                held.update(own.keys())
                if len(held) >= HELD:
                    yield table()
                    held.clear()
        if held:
            yield table()

    def count(batches):
        for batch in batches:
            yield batch.append_column("pieces", pa.array(n_pieces(path, batch.column("token").to_pylist()), pa.int32()))

    found = map_batches(docs.select("text"), distinct, "token string, docs long")
    return map_batches(found.groupBy("token").agg(F.sum("docs").alias("docs")), count, "token string, docs long, pieces int")


def token_counts(docs: DataFrame, path: str, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row of docs (doc_id, text). path: the model's file."""
    import pyarrow as pa

    words = written(dictionary(docs, path), "pieces")
    level = F.floor(F.log2("docs")).cast("int")
    counts = {x.level: x.n for x in words.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()}  # 64 rows at most
    least, total = 64, 0
    while least > 0 and total + counts.get(least - 1, 0) <= frequent:
        least -= 1
        total += counts.get(least, 0)
    top = level >= least
    known = {x.token: x.pieces for x in words.where(top).select("token", "pieces").toLocalIterator()}  # at most ``frequent``

    def known_and_rare(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            sums, rare = [], []
            for own in pretokens(path, texts):
                n, others = 0, []
                for t, k in own.items():
                    if (p := known.get(t)) is None:
                        others.append({"token": t, "k": k})
                    else:
                        n += p * k
                sums.append(n)
                rare.append(others)
            n_bytes = pa.array([len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts], pa.int64())
            kind = pa.list_(pa.struct([("token", pa.string()), ("k", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n_bytes, pa.array(sums, pa.int64()), pa.array(rare, kind)], ["doc_id", "n_bytes", "known", "rare"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, known long, rare array<struct<token: string, k: long>>"
    rows = map_batches(docs.select("doc_id", "text"), known_and_rare, schema)
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "documents")
    others = rows.select("row", F.explode("rare").alias("r")).select("row", "r.token", "r.k")
    sums = others.join(words.where(~top).select("token", "pieces"), "token").groupBy("row").agg(F.sum(F.col("k") * F.col("pieces")).alias("others"))
    # each row's own part and the sums of its other pre-tokens, written so that the pre-tokens can go
    both = rows.select("row", "doc_id", "n_bytes", "known").join(sums, "row", "left")
    out = written(both.select("doc_id", "n_bytes", (F.col("known") + F.coalesce("others", F.lit(0))).alias("n_tokens")), "counts")
    discard(rows)
    discard(words)
    return out
