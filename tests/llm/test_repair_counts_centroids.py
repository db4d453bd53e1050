"""Conversation repair, token counts and centroid clustering against brute force, and on odd input."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from tessera.llm import centroids, conversation_repair, queries, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
ROWS = "conv_id long, turn long, role string, text string, n long, seq long, part int, h string, c string"
PATTERN = re.compile(r"(s?(ua)+)?\Z")
NAMES = {"u": "user", "a": "assistant"}


def table(spark, rows):
    """Conversations with clashing extra columns."""
    return spark.createDataFrame([(*r, 1, 2, 3, "x", "y") for r in rows], ROWS).repartition(3)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        said = lambda x: " " if x is None else str(x)
        k = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def marked(rows):
    """(role, text, fault) in order, faults: 1 blank, 2 duplicate, 3 truncated."""
    seen, out = set(), []
    for _, _, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode())):
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = 1 if not last else 2 if (role, text) in seen else 3 if last[-1] not in ".!?" else 0
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def every_edit(rows):
    """The cheapest (cost, audit, repaired turns) by trying all edits."""
    best = None
    step = []
    for role, text, fault in rows:
        one = [("D", 4, None)]
        if fault not in (1, 2):
            more = 3 if fault == 3 else 0
            one += [("K", more, (role[:1] or "?", role, text)), *[("R", 3 + more, (x, NAMES[x], text)) for x in "ua"]]
        step.append(one)
    runs = ["", "u", "a", "ua", "au"]
    for edits in itertools.product(*step):
        base = sum(e[1] for e in edits)
        if best and base > best[0]:
            continue
        for ins in itertools.product(runs, repeat=len(rows) + 1):
            cost = base + 3 * sum(map(len, ins))
            if best and cost > best[0]:
                continue
            turns = []
            for run, e in zip(ins, [*edits, None]):
                turns += [(x, NAMES[x], "") for x in run]
                turns += [e[2]] if e and e[2] else []
            if not PATTERN.match("".join(t[0] for t in turns)):
                continue
            audit = "".join("I" * len(run) + (e[0] if e else "") for run, e in zip(ins, [*edits, None]))
            if best is None or (cost, audit) < best[:2]:
                best = (cost, audit, "\n".join(f"{r}:{t}" for _, r, t in turns))
    return best


def whole_strings(rows):
    """The same by the best whole string for each state."""
    best = {"": (0, "", [])}
    nxt = {"": "su", "s": "u", "u": "a", "a": "u"}
    for role, text, fault in rows:
        new = {}

        def put(state, cost, audit, turns):
            if state not in new or (cost, audit) < new[state][:2]:
                new[state] = (cost, audit, turns)

        for q, (cost, audit, turns) in best.items():
            for run in range(3):
                at, c, a, t = q, cost + 3 * run, audit + "I" * run, list(turns)
                for _ in range(run):
                    at = "a" if at == "u" else "u"
                    t.append(f"{NAMES[at]}:")
                put(at, c + 4, a + "D", t)
                if fault in (1, 2):
                    continue
                c += 3 * (fault == 3)
                for x in nxt[at]:
                    if x == role[:1]:
                        put(x, c, a + "K", [*t, f"{role}:{text}"])
                    if x in NAMES:
                        put(x, c + 3, a + "R", [*t, f"{NAMES[x]}:{text}"])
        best = new
    ends = []
    for q, (cost, audit, turns) in best.items():
        tail = {"": [], "a": [], "u": ["assistant:"], "s": ["user:", "assistant:"]}[q]
        ends.append((cost + 3 * len(tail), audit + "I" * len(tail), "\n".join(turns + tail)))
    return min(ends)


def wanted(rows, search):
    out = {}
    for conv in {r[0] for r in rows}:
        own = [r for r in damage(rows) if r[0] == conv]
        m = marked(own)
        turns = sorted({r[1] for r in own if r[1] is not None})
        cost, audit, text = search(m) if m else (0, "", "")
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(m, m[1:]))
        faults = [x[2] for x in m]
        gaps = turns[-1] - turns[0] + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *(faults.count(k) for k in (1, 2, 3)), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def conversations(seed, n, rows):
    r = random.Random(seed)
    out = []
    for c in range(n):
        for t in range(r.randint(1, rows)):
            role = r.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "ursula"])
            text = r.choice(["Fine.", "So it is!", "cut off", "é 日本。", None, " \n\t", "", "Why? ", "a.\x0b", f"own {c} {t}."])
            out.append((None if c == 3 else c, r.choice([t, t, t, t + 1, None]), role, text))
    return out


@pytest.fixture
def restored(spark):
    """Settings to put back."""
    old = {}
    yield old
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_against_all_edits(spark, seed):
    rows = conversations(seed, 60, 3)
    got = {x.conv_id: tuple(x[1:]) for x in conversation_repair.report(table(spark, rows)).collect()}
    assert got == wanted(rows, every_edit)
    assert wanted(rows, every_edit) == wanted(rows, whole_strings)


def test_repair_of_one_long_conversation_in_segments(spark, restored):
    """A conversation with most of all rows lies in several segments, with long repeats of one row."""
    for k, v in (("spark.sql.adaptive.coalescePartitions.enabled", "false"), ("spark.sql.shuffle.partitions", "16")):
        restored[k] = spark.conf.get(k)
        spark.conf.set(k, v)
    r = random.Random(9)
    rows = [(7, t, r.choice(["user", "assistant", "system"]), r.choice([f"Turn {t}.", "again.", "cut", " "])) for t in range(900)] + [(7, 901, "user", "same.")] * 200 + conversations(4, 40, 6)
    placed = conversation_repair.ordered(conversation_repair.damaged(table(spark, rows)))
    narrow = conversation_repair.faults(placed)
    assert narrow.where("conv_id = 7").select("part").distinct().count() > 1
    got = {x.conv_id: tuple(x[1:]) for x in conversation_repair.report(table(spark, rows)).collect()}
    assert got == wanted(rows, whole_strings)


def test_repair_of_none_and_of_dropped_rows(spark):
    assert conversation_repair.report(table(spark, [])).collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    out = conversation_repair.report(table(spark, [(gone, 0, "user", "Hi.")])).collect()
    assert [tuple(x) for x in out] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_codes_of_macro_edits_are_free_of_prefixes():
    for initial, fault in itertools.product(["s", "u", "a", ""], range(4)):
        codes = {"I" * m[4] + m[5] for m in conversation_repair.macros(initial, fault)}
        assert not any(a != b and b.startswith(a) for a in codes for b in codes)


# ------------------------------------------------------------------ token counts


def texts():
    r = random.Random(3)
    signs = "abcdefghij éüßñ.,!?'\"-_()<>/\\\n\t0123456789▁日本語한국 　​\x00😀ﬁ①"
    out = [None, "", " ", "  ", "a", " a ", "<s>x</s><unk><0x0A>", "▁▁a▁", "\n", "a\nb", "word " * 500, "x" * 5000, "日本語" * 300]
    out += ["".join(r.choice(signs) for _ in range(r.randint(1, 400))) for _ in range(150)]
    return out + ["The quick brown fox, it's said -- jumps over 12,345 lazy dogs.\n\n    return x;  "] * 5


def test_pretokens_of_a_text_give_its_pieces():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    some = texts()
    for t, own in zip(some, token_counts.pretokens(MODEL, some), strict=True):
        assert sum(n * k for n, k in zip(token_counts.n_pieces(MODEL, list(own)), own.values())) == len(sp.encode(t or "")), repr(t)


def test_pretokens_do_not_depend_on_blocks(monkeypatch):
    some = [t for t in texts() if t]
    want = list(token_counts.pretokens(MODEL, some))
    monkeypatch.setattr(token_counts, "BLOCK", 7)
    assert list(token_counts.pretokens(MODEL, some)) == want


@pytest.mark.parametrize("frequent", [0, 40, 1 << 17])
def test_token_counts(spark, frequent):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [(i // 2 if i != 9 else None, t, "x", 1, 2) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token string, docs long, row long").repartition(3)
    got = sorted(map(repr, map(tuple, token_counts.token_counts(docs, MODEL, frequent).collect())))
    assert got == sorted(repr((i, len((t or "").encode()), len(sp.encode(t or "")))) for i, t, *_ in rows)


def test_token_counts_of_none(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.token_counts(docs, MODEL).collect() == []


# ------------------------------------------------------------------ centroids


def lloyd(x, ids, k, rounds):
    order = sorted(range(len(x)), key=lambda i: (hashlib.sha256(f"3:{'' if ids[i] is None else ids[i]}".encode()).hexdigest(), x[i].tolist()))
    c = x[order[:k]].copy()
    for _ in range(rounds + 1):
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        a, was = d.argmin(1), c.copy()
        for j in range(len(c)):
            if (a == j).any():
                s, n = x[a == j].sum(0), int((a == j).sum())
                c[j] = [int(v) // n for v in s]
    return a, d.min(1), was


@pytest.mark.parametrize("seed, spread, n", [(1, 0.02, 400), (2, 1.0, 300), (3, 0.001, 300), (4, 1.0, 5), (5, 0.0, 50)])
def test_clustering(spark, seed, spread, n):
    """Clusters, noise, many ties (few distinct integers), fewer vectors than centroids, equal vectors."""
    g = np.random.default_rng(seed)
    centre = g.normal(size=(6, 64)).astype(np.float32)
    v = [(centre[g.integers(6)] + spread * g.normal(size=64)).astype(np.float32) for _ in range(n)]
    if seed == 3:
        v = [np.sign(x).astype(np.float32) * (1 / 1024) for x in v]
    ids = [*range(n - 2), 0, None]
    rows = [(i, list(map(float, x)), 1, "x", 2.0) for i, x in zip(ids, v)]
    bad = [(900, None), (901, [1.0] * 63), (902, [1.0] * 65), (903, [float("nan")] + [1.0] * 63), (904, [math.inf] * 64), (905, [None] + [1.0] * 63), (906, [])]
    df = spark.createDataFrame(rows + [(i, x, 1, "x", 2.0) for i, x in bad], "vec_id long, embedding array<float>, a int, v string, upper double").repartition(3)
    got = centroids.report(df, 8, 10).collect()
    x = np.floor(1024 * np.array(v).astype(np.float64)).astype(np.int64)
    a, d, c = lloyd(x, ids, 8, 10)
    name = [hashlib.sha256(",".join(map(str, y.tolist())).encode()).hexdigest() for y in c]
    own = [int(d[a == j].sum()) for j in range(len(c))]
    want = [(i, int(j), int(e), own[j], int(d.sum()), name[j]) for i, j, e in zip(ids, a, d)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_search_scans_fewer_centroids_than_there_are():
    g = np.random.default_rng(7)
    c = (1024 * g.normal(size=(40, 64))).astype(np.int64)
    x = c[g.integers(40, size=4000)] + (100 * g.normal(size=(4000, 64))).astype(np.int64)
    a, upper, lower = centroids.first_assignment(x, c)
    moved = c + g.integers(-20, 20, size=c.shape)
    step = np.sqrt(((moved - c) ** 2).sum(1))
    got, _, _, taken = centroids.exponion(x, a, upper + step[a], lower - step.max(), centroids.Neighbours(moved))
    assert (got == ((x[:, None] - moved[None]) ** 2).sum(2).argmin(1)).all()
    assert taken < 4000 * 40 / 4


def test_clustering_of_none_and_of_huge_components(spark):
    kind = "vec_id long, embedding array<double>"
    assert centroids.report(spark.createDataFrame([(1, None)], kind), 8, 10).collect() == []
    out = centroids.report(spark.createDataFrame([(1, [1e300] * 64), (2, [-1e300] * 64), (3, [0.0] * 64)], kind), 8, 2).collect()
    assert {x.vec_id: x.distance for x in out} == {1: 0, 2: 0, 3: 0}


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op13_centroid_clustering"])
def test_queries_equal_their_sql(spark, data, name):
    import duckdb

    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, data).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.itertuples(index=False))) == sorted(map(tuple, want.itertuples(index=False)))


def test_query_op12(spark, data):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    out = queries.queries()["op12_token_counts"](spark, data)
    assert out.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]
    docs = {x.doc_id: x.text or "" for x in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = out.collect()
    assert len(got) == len(docs)
    for x in got:
        n = len(sp.encode(docs[x.doc_id]))
        assert (x.n_bytes, x.n_tokens, x.over_limit) == (len(docs[x.doc_id].encode()), n, n > 4096)
