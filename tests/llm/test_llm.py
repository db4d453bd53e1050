"""Training-data operators against brute force, and on odd input."""

import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, components, decontam, html_extract, lang_id, line_dedup, ngram_join, packing, quality_rules, queries, refine, sharding, substring_dedup, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, k string, at string, gone string, tokens string, rep string, size string"


def docs_of(spark, texts):
    """Documents with clashing extra columns."""
    rows = [(i, t, "en", "s", len(t or ""), 1, *["x"] * 6) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def prose(r, n, vocabulary=4000):
    return " ".join("w%d" % r.randrange(vocabulary) for _ in range(n))


def odd():
    """Null, empty and blank texts, ties, repeated rows, a null id, one very long text."""
    r = random.Random(5)
    long = prose(r, 30_000)
    same = prose(r, 120)
    return [(0, None), (1, ""), (2, " \n\t "), (3, same), (4, same), (4, same), (5, long), (6, "é 日本 \U0001f600 <|endoftext|>"), (None, same), (7, "x"), (8, prose(r, 80) + "\n" + prose(r, 60))]


def corpus(seed=0, n=60):
    r = random.Random(seed)
    passage = prose(r, 70)
    out = []
    for i in range(n):
        k = r.random()
        if k < 0.2 and out:
            t = r.choice(out)[1].split(" ")
            for _ in range(r.randint(0, 6)):
                if t:
                    t[r.randrange(len(t))] = "e%d" % r.randrange(99)
            t = " ".join(t)
        elif k < 0.4:
            t = prose(r, r.randint(0, 90)) + "\n" + passage + "\n" + prose(r, r.randint(0, 90))
        elif k < 0.5:
            t = "a b " * r.randint(1, 90)
        else:
            t = "\n".join(prose(r, r.randint(1, 40)) for _ in range(r.randint(1, 8)))
        out.append((i, t))
    return out


def words(t):
    return (t or "").encode().split()


# ------------------------------------------------------------------ 1


def brute_substrings(texts, n=50):
    first, out = {}, {}
    for i, t in sorted((x for x in texts if x[0] is not None), key=lambda x: x[0]):
        w = words(t)
        for p in range(len(w) - n + 1):
            first.setdefault(tuple(w[p : p + n]), i)
    for i, t in texts:
        w = words(t)
        gone = set()
        for p in range(len(w) - n + 1):
            if i is not None and first[tuple(w[p : p + n])] < i:
                gone.update(range(p, p + n))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.setdefault(i, []).append((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def two_texts():
    """Rows of one doc_id with different texts; passages at other places of each."""
    r = random.Random(31)
    a, b, c, d = (prose(r, 60) for _ in range(4))
    return [(1, a), (5, a), (5, b), (5, b), (6, b + " " + c), (7, c), (7, d + " " + a), (7, "x " + d), (None, a), (9, d), (9, None)]


@pytest.mark.parametrize("texts", [corpus(1), corpus(2), odd(), two_texts(), []], ids=["a", "b", "odd", "two", "none"])
def test_substring_dedup(spark, texts):
    got = {}
    for x in substring_dedup.substring_dedup(docs_of(spark, texts), 50).collect():
        got.setdefault(x.doc_id, []).append((x.n_words, x.n_removed, x.kept_sha256))
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v) for i, v in brute_substrings(texts).items()}


@pytest.mark.parametrize("n", [5, 9, 16, 33])
def test_substring_dedup_at_other_lengths(spark, n):
    """One, two and three levels."""
    texts = corpus(17, 40)
    assert len(substring_dedup.lengths(n)) == {5: 1, 9: 1, 16: 2, 33: 3}[n]
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substring_dedup.substring_dedup(docs_of(spark, texts), n).collect()}
    assert {i: [v] for i, v in got.items()} == brute_substrings(texts, n)


# ------------------------------------------------------------------ 2


def shingles(t):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def groups(links, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("texts", [corpus(3, 80), odd(), []], ids=["a", "odd", "none"])
def test_ngram_join(spark, texts):
    s = {i: shingles(t) for i, t in texts if i is not None}
    link = [(i, j) for i in s for j in s if i < j and s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j])]
    root = groups(link, s)
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in ngram_join.near_duplicates(docs_of(spark, texts)).collect() if x.doc_id is not None)
    assert got == sorted((i, len(s[i]), root[i]) for i, _ in texts if i is not None)


def test_ngram_join_of_a_large_near_copy_group(spark):
    """Frequent tokens: a group far above the rare class, each member with edits of its own."""
    r = random.Random(9)
    base = [prose(r, 200).split(), prose(r, 60).split()]
    texts = []
    for i in range(150):
        t = list(base[i % 2])
        for _ in range(r.randint(0, 5)):
            t[r.randrange(len(t))] = "e%d" % i
        texts.append((i, " ".join(t)))
    s = {i: shingles(t) for i, t in texts}
    link = [(i, j) for i in s for j in s if i < j and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j])]
    want = groups(link, s)
    got = {x.doc_id: x.component_id for x in ngram_join.near_duplicates(docs_of(spark, texts)).collect()}
    assert got == want


def test_ngram_join_of_families(spark):
    """Copies of copies: many pairs just above and below the similarity, around several bases."""
    r = random.Random(23)
    texts, at = [], 0
    for size in (90, 90, 45):
        base = prose(r, size).split()
        family = [base]
        for _ in range(70):
            t = list(r.choice(family))
            for _ in range(r.randint(0, 3)):
                t[r.randrange(len(t))] = "e%d" % r.randrange(10**6)
            t = t[: r.randint(len(t) - 4, len(t))]
            family.append(t)
        for t in family:
            texts.append((at, " ".join(t)))
            at += 1
    r.shuffle(texts)
    s = {i: shingles(t) for i, t in texts}
    link = [(i, j) for i in s for j in s if i < j and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j])]
    want = groups(link, s)
    assert {x.doc_id: x.component_id for x in ngram_join.near_duplicates(docs_of(spark, texts)).collect()} == want


def test_ngram_join_of_a_doc_id_with_two_texts(spark):
    """Rows of one doc_id with different texts are one document with the links of both."""
    r = random.Random(24)
    a, b, c = (prose(r, 60) for _ in range(3))
    near = lambda t: t + " more"
    texts = [(5, a), (5, b), (7, near(a)), (9, near(b)), (11, near(b)), (3, c), (12, c), (12, near(a)), (20, "x y z")]
    got = {x.doc_id: x.component_id for x in ngram_join.near_duplicates(docs_of(spark, texts)).collect()}
    assert got == {i: 3 for i in (3, 5, 7, 9, 11, 12)} | {20: 20}


def test_signatures_of_linked_sets_meet():
    r = np.random.default_rng(3)
    for n in (2, 3, 5, 9, 24, 60, 200):
        for _ in range(30):
            universe = np.unique(r.integers(1, 2**62, 2 * n + 4).astype(np.uint64))
            count = {int(t): int(c) for t, c in zip(universe, r.choice([1, 3, 40, 500], len(universe)))}
            x = np.sort(r.choice(universe, min(n, len(universe)), replace=False))
            y = x.copy()
            for _ in range(int(r.integers(0, max(1, n // 8) + 1))):
                y[int(r.integers(len(y)))] = universe[int(r.integers(len(universe)))]
            y = np.unique(y)
            inter = len(np.intersect1d(x, y))
            if 5 * inter >= 4 * (len(x) + len(y) - inter) and len(x) > 1 and len(y) > 1:
                shared = {int(t) for t in np.intersect1d(x, y)}
                of = lambda v: np.array([max(count[int(t)], 2 if int(t) in shared else 1) for t in v])
                sign = lambda v: set(ngram_join._signatures(v[of(v) > 1], of(v)[of(v) > 1], len(v)).tolist())
                assert sign(x) & sign(y)


# ------------------------------------------------------------------ 3


@pytest.mark.parametrize("texts", [corpus(4), odd(), []], ids=["a", "odd", "none"])
def test_packing(spark, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    want = []
    for i, t in texts:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    got = packing.pack(packing.pieces(docs_of(spark, texts), path)).collect()
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got), key=key) == sorted(want, key=key)
    seqs = {}
    for x in got:
        seqs.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 1024
    assert len(seqs) <= 1.05 * math.ceil(sum(x.length for x in got) / 1024) + 1


def test_fullest_combination_is_the_fullest():
    r = random.Random(6)
    for _ in range(40):
        counts = {r.randint(1, 60): r.randint(1, 3) for _ in range(r.randint(1, 7))}
        take = packing.fullest(counts, 60)
        longest = max(counts)
        best, sums = 0, {longest}
        for n, c in counts.items():
            for _ in range(c - (n == longest)):
                sums |= {s + n for s in sums if s + n <= 60}
        best = max(sums)
        assert sum(n * k for n, k in take) == best and all(k <= counts[n] for n, k in take)


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    r = random.Random(8)
    texts = ["".join(r.choice(" \n\ta'é日9.x\u00a0\u2003") for _ in range(r.randint(0, 60))) for _ in range(400)]
    texts += ["don't  do it ", " a", "<|endoftext|>", "a <|endoftext|> b"]
    enc = packing.Encoder(path)
    for _ in range(2):
        assert enc.many(texts) == [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_encoder_learns_a_word_once_with_any_mark(monkeypatch):
    """A run with a mark at its end takes the ids of the run without it, and equals the library."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, enc = Tokenizer.from_file(path), packing.Encoder(path)
    seen, learn = [], enc._learn
    monkeypatch.setattr(enc, "_learn", lambda words: (seen.extend(words), learn(words)))
    texts = ["x alphabeta gamm\u00e9", "x alphabeta. gamm\u00e9, gamm\u00e9! alphabeta$", f"x it's. 12. ... a.. \u4e2d. . {'y' * 70}. {'z' * 70}."]
    for t in texts:
        assert enc.many([t]) == [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()]
        if t is texts[1]:
            assert sorted(seen) == ["alphabeta", "gamm\u00e9"]


# ------------------------------------------------------------------ 4, 8


def bag(t):
    """Words and beginnings of longer words with their counts."""
    out = {}
    for w in re.findall(rb"[0-9a-z\x80-\xff]+", t.lower().encode()):
        for x in (w, *[(n, w[:n]) for n in toxicity.BEGINNINGS if len(w) > n]):
            out[x] = out.get(x, 0) + 1
    return out


def test_toxicity_opens_all_blocks_that_matter():
    """Two-step opening of blocks gives what scoring of every example gives, ties included."""
    r = np.random.default_rng(4)
    terms = np.arange(1, 400).astype(np.uint64)
    docs = []
    for k in range(900):
        t = np.unique(r.zipf(1.3, 12) % 399)
        docs.append((terms[t], r.integers(1, 4, len(t)).astype(float)))
    docs[5] = docs[700] = docs[3]
    used = np.unique(np.concatenate([t for t, _ in docs]))
    ix = toxicity.Index(used, np.full(len(used), 9.0), 900, list(range(900)), r.integers(0, 2, 900), docs)
    dense = np.zeros((900, len(used)))
    for e in range(900):
        k = ix.ids[e]
        at, w = ix.query(*docs[k])
        dense[e, at] = w
    for k in list(range(0, 900, 90)) + [3]:
        at, w = ix.query(*docs[k])
        flat = dense[:, at] @ w
        want = np.lexsort((ix.rank, -np.round(flat, 12)))[: toxicity.NEAREST]
        place, s = ix.nearest([(at, w)])[0]
        assert np.allclose(s, flat[want], atol=1e-9) and np.allclose(s, flat[place], atol=1e-9)
    at = [ix.ids[p] for p in ix.nearest([ix.query(*docs[3])])[0][0][:3]]
    assert at == [3, 5, 700]


def test_toxicity_index_is_exact_and_learns(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "FREQUENT", 6)
    r = random.Random(10)
    texts, labels = [], []
    for i in range(500):
        bad = i % 5 == 0
        t = prose(r, 60, 300).split()
        for _ in range(3 if bad else 0):
            t[r.randrange(len(t))] = r.choice(["vile", "scumbags", "awful"])
        texts.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    docs = docs_of(spark, texts)
    train = spark.createDataFrame(labels, "doc_id long, toxic int").where("doc_id < 300")
    ix = toxicity.fit(train, docs)
    assert ix.n == 300 and 0 < ix.top.shape[0] < len(ix.terms)
    # the same cosines from the texts themselves: every term, idf over all documents, phi over the examples
    bags = {i: bag(t) for i, t in texts}
    df = {}
    for v in bags.values():
        for t in v:
            df[t] = df.get(t, 0) + 1
    phi, y = {}, dict(labels)
    pos = sum(y[i] for i in range(300))
    for t in {t for i in range(300) for t in bags[i]}:
        c, a = (sum(f(i) for i in range(300) if t in bags[i]) for f in (lambda i: 1, lambda i: y[i]))
        phi[t] = abs(a * 300 - c * pos) / math.sqrt(max(pos * (300 - pos) * c * (300 - c), 1e-9))
    once = [phi[t] for t in phi if sum(t in bags[i] for i in range(300)) == 1]
    rest = np.mean(once) if once else np.mean(list(phi.values()))
    vec = {}
    for i, v in bags.items():
        w = {t: (1 + math.log(n)) * (math.log(501 / ((df[t] if t in phi else 1) + 1)) + 1) * phi.get(t, rest) for t, n in v.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        vec[i] = {t: x / norm for t, x in w.items()}
    for i in (300, 305, 311, 404, 450):
        sims = sorted((sum(x * vec[e].get(t, 0) for t, x in vec[i].items() if t in phi) for e in range(300)), reverse=True)[: toxicity.NEAREST]
        h = next(iter(toxicity._rows(pa.array([dict(texts)[i]]))))[2]
        assert np.allclose(ix.nearest([ix.query(*np.unique(h, return_counts=True))])[0][1], sims, atol=1e-9)
    got = {x.doc_id: x.score for x in toxicity.score(docs, ix).collect()}
    test = [(got[i], y) for i, y in labels if i >= 300]
    assert np.mean([(s >= 0.7) == bool(y) for s, y in test]) >= 0.97
    weird = toxicity.score(docs_of(spark, odd()), ix).collect()
    assert len(weird) == len(odd()) and all(0 <= x.score <= 1 for x in weird)


def test_toxicity_without_labels(spark):
    docs = docs_of(spark, odd())
    assert toxicity.fit(spark.createDataFrame([], "doc_id long, toxic int"), docs) is None
    assert {x.score for x in toxicity.score(docs, None).collect()} == {0.0}


def test_language_id(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = lang_id.fit(docs.where("doc_id % 2 = 0"))
    got = {x.doc_id: x.lang_pred for x in lang_id.predict(docs, model).collect()}
    truth = {x.doc_id: x.lang for x in docs.where("doc_id % 2 = 1").select("doc_id", "lang").collect()}
    assert np.mean([got[i] == g for i, g in truth.items()]) >= 0.95
    weird = {x.doc_id: x for x in lang_id.predict(docs_of(spark, odd()), model).collect()}
    assert weird[0].lang_pred == weird[1].lang_pred == weird[2].lang_pred == "und" and weird[7].lang_pred != "und"
    assert all(0 <= x.score <= 1 for x in weird.values())
    assert {x.lang_pred for x in lang_id.predict(docs, None).collect()} == {"und"}


# ------------------------------------------------------------------ 5


def test_decontamination(spark):
    r = random.Random(11)
    items = [(k, prose(r, r.choice([30, 40, 9]), 10**6)) for k in range(12)] + [(12, None), (13, ""), (14, "too short")]
    texts = []
    for i in range(40):
        t = prose(r, 150, 10**6).split()
        if i < 12:
            p = items[i][1].split()
            if len(p) > 20:
                for _ in range(4):  # substitutions are tolerated
                    p[r.randrange(len(p))] = "subst"
            p[0] = p[0].upper() + ","
            t[40:40] = p
        texts.append((i, " ".join(t)))
    items = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontam.contaminated(docs_of(spark, texts), items).collect()}
    assert got == {(i, i) for i in range(12)}
    left = decontam.decontaminate(docs_of(spark, texts + odd()), items)
    assert left.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert left.count() == 28 + len(odd()) - sum(1 for i, _ in odd() if i is not None and i < 12)
    assert decontam.contaminated(docs_of(spark, odd()), items.where("false")).count() == 0


def test_decontamination_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_TOKENS", 40)
    r = random.Random(12)
    items = [(k, prose(r, 30, 10**6)) for k in range(5)]
    texts = [(k, prose(r, 20, 10**6) + " " + t) for k, t in items]
    got = decontam.contaminated(docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id) for x in got} == {(k, k) for k in range(5)}


def planted(spark, pairs, **limits):
    """Which items (passage, form in a document) are found in their documents, amid other words."""
    r = random.Random(14)
    texts = [(k, prose(r, 25, 10**6) + " " + t + " " + prose(r, 25, 10**6)) for k, (_, t) in enumerate(pairs)]
    items = spark.createDataFrame([(k, p) for k, (p, _) in enumerate(pairs)], "item_id long, text string")
    return {(x.doc_id, x.item_id): x.n_match for x in decontam.contaminated(docs_of(spark, texts), items, **limits).collect()}


def any_stretch(same, n=13, share=0.7):
    """Most equal tokens of any stretch with n of them and the share; 0 if there is none."""
    total = [0]
    for x in same:
        total.append(total[-1] + x)
    good = [total[j] - total[i] for i in range(len(same)) for j in range(i + n, len(same) + 1) if total[j] - total[i] >= n and 10 * (total[j] - total[i]) >= round(10 * share) * (j - i)]
    return max(good, default=0)


def test_decontamination_meets_all_that_it_accepts(spark):
    """Every k-th token substituted, random places, dense and sparse parts in turn: each stretch that is good is found."""
    r, pairs, want = random.Random(15), [], {}
    changes = [(n, set(range(at, n, k))) for n in (24, 36, 60) for k in (4, 5, 6) for at in range(k)]
    changes += [(n, set(r.sample(range(n), c))) for n, c in ((18, 4), (18, 5), (20, 6), (24, 6), (30, 8), (40, 14), (80, 30)) for _ in range(25)]
    for n in (60, 120):
        changes += [(n, {i for i in range(n) if r.random() < (0.1, 0.5, 0.33)[i // 15 % 3]}) for _ in range(25)]
    changes.append((323, {i for i in range(13, 323) if i % 3 == 0 or i % 31 == 0}))
    changes += [(len(p), {i for i, x in enumerate(p) if x == "x"}) for p in ("eeeeeeeexxxxxxeeeeeeee", "eeeeeexxxeeeeeexxxee", "xeeeeeexxxeeeeeeexx")]
    for k, (n, gone) in enumerate(changes):
        item = [f"i{k}x{j}" for j in range(n)]
        pairs.append((" ".join(item), " ".join("subst" if j in gone else t for j, t in enumerate(item))))
        if got := any_stretch([j not in gone for j in range(n)]):
            want[k, k] = got
    assert len(want) > 100 and (len(changes) - 4, len(changes) - 4) in want and planted(spark, pairs) == want


def test_masks_meet_every_good_stretch():
    """Over all patterns of equal and other tokens, by the last places and the number of equal ones: none that is good is missed."""
    n = decontam.SPAN
    met = [any(all(w >> (n - 1 - i) & 1 == 0 or i in z for i in range(n)) for z in decontam.IGNORED) for w in range(1 << n)]
    now = {(0, 0)}
    for length in range(1, 40):  # 25 equal tokens are at most 35
        new = set()
        for bits, equal in now:
            for other in (0, 1):
                w = (bits << 1 | other) & ((1 << n) - 1)
                if length < n or not met[w]:
                    new.add((w & ((1 << n - 1) - 1), equal + 1 - other))
        now = new
        assert not [e for _, e in now if e >= 13 and 10 * e >= 7 * length]


def test_verified_stretch_against_all_stretches():
    r = np.random.default_rng(5)
    for _ in range(400):
        n = int(r.integers(1, 90))
        item = np.arange(n, dtype=np.uint64)
        doc = np.where(r.random(n) < r.choice([0.2, 0.3, 0.4]), np.uint64(999), item)
        got = decontam._verified(doc, item, 0, 13, 0.7)
        want = any_stretch((doc == item).tolist())
        assert (got[0] if got else 0) == want
        if got:
            same = (doc == item)[got[2] : got[2] - got[1]]
            assert same.sum() == got[0] and same[0] and same[-1] and 10 * same.sum() >= 7 * len(same)


def test_decontamination_of_short_items(spark):
    """All lengths from min_short to min_match, unchanged and with as many substitutions as a hit may have."""
    r, pairs, want = random.Random(16), [], {}
    for n in range(6, 16):
        for c in (0, 0, 1, 2, 3, 4):
            item = [f"s{len(pairs)}x{j}" for j in range(n)]
            gone = set(r.sample(range(n), c))
            if n < 13 and n - c >= 8 and n - c >= 0.7 * n:
                want[len(pairs), len(pairs)] = n - c
            if n >= 13 and c == 0:
                want[len(pairs), len(pairs)] = n
            if n < 13 or c == 0:
                pairs.append((" ".join(item), " ".join("subst" if j in gone else t for j, t in enumerate(item))))
    assert {n for n in want.values()} == set(range(8, 16)) and planted(spark, pairs) == want


# ------------------------------------------------------------------ 6


@pytest.mark.parametrize("texts", [corpus(7), odd(), []], ids=["a", "odd", "none"])
def test_quality_rules(spark, texts):
    rows = quality_rules.apply_policy(quality_rules.ledger(docs_of(spark, texts)), "v1").collect()
    assert len(rows) == len(texts)
    by = {}
    for i, t in texts:
        by.setdefault(i, t)
    for x in rows:
        t = by[x.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tri, seen = [tuple(w[k : k + 3]) for k in range(len(w) - 2)], {}
        for g in tri:
            seen[g] = seen.get(g, 0) + 1
        rep = {k + d for k, g in enumerate(tri) if seen[g] > 1 for d in range(3)}
        lines = [y for y in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", y)]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep))
        assert bool(x.failed & 1) == (len(w) < 50) and bool(x.failed & 2) == (100 * len(rep) > 50 * len(w)) and x.kept == (x.failed == 0)


def test_ablation(spark):
    rows = quality_rules.ledger(docs_of(spark, corpus(7)))
    bits = [x.failed for x in rows.collect()]
    for x in quality_rules.ablation(rows, "base").collect():
        b, m = quality_rules.BIT[x.rule], quality_rules.POLICIES["base"]
        assert (x.n_failed, x.n_only, x.n_kept_without) == (sum(bool(v & b) for v in bits), sum(v & m == b for v in bits), sum(v & m & ~b == 0 for v in bits))


# ------------------------------------------------------------------ 7


def test_html_extraction(spark):
    page = (
        "<html><head><title>T</title><script>var t='</p>';</script></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></nav>"
        "<div class='ad'>Buy this thing now.</div><article><h1>A title of it</h1><p><b>First &amp; foremost,\n this is text.<br><p>Second paragraph, with <a href=x>a link</a> in it.</article>"
        "<div class='comments'><p>I do not agree at all.</p></div><footer>&copy; Someone</footer></body></html>"
    )
    rows = [(1, "u", page), (2, "v", None), (3, "w", ""), (3, "w", ""), (4, "x", "no tags at all"), (5, "y", "<p " * 50)]
    got = {x.page_id: x for x in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == "A title of it\n\nFirst & foremost, this is text.\n\nSecond paragraph, with a link in it."
    assert got[2].text == got[3].text == "" and all(x.n_chars == len(x.text) for x in got.values())


@pytest.mark.parametrize("old, new", [("</head>", ""), ("</head><body>", ""), ("<article>", "<article><svg width='1' />"), ("<p>Two", "<svg/><p>Two"), ("<h1>", "<object data=x><h1>")])
def test_html_tags_left_open_lose_no_text(old, new):
    page = "<html><head><meta charset=utf-8><title>T</title><style>p {}</style></head><body><nav>Home</nav><article><h1>One</h1><p>Two, or <svg><text>no</text></svg>three.</article><script>x</script></body></html>"
    want = [b.text for b in html_extract.blocks(page)]
    assert want == ["Home", "One", "Two, or three."]
    assert [b.text for b in html_extract.blocks(page.replace(old, new))] == want


def test_html_of_broken_and_long_pages():
    """One pass: broken quotes, nesting without end and long texts take time in proportion to the page."""
    for unit in ('<p x="', "<p x='>", "<svg>", "<div><b>", "</i></p>", "<![CDATA[", "<!x", "<p x=\"'>", "< ", "<a href='>t"):
        spent = []
        for n in (4000, 16000):
            began = time.process_time()
            html_extract.blocks("<p>One</p>" + unit * n + "<p>Two</p>")
            spent.append(time.process_time() - began)
        assert spent[1] < 12 * spent[0] + 0.2, (unit, spent)
    assert [b.text for b in html_extract.blocks("<p>One</p><p x=\"y>Two</p><p>Three</p>")] == ["One", "Two", "Three"]
    long = " ".join("word%d" % k for k in range(200_000))
    assert [b.text for b in html_extract.blocks(f"<p>{long}</p>")] == [long]


def test_html_of_odd_tables(spark, monkeypatch):
    """Empty tables, clashing columns, nulls and repeated rows; weights are read back from the shared folder."""
    cols = "page_id long, url string, html string, text string, n_chars long, k string"
    page = "<html><body><nav><a href=/>Home</a></nav><article><h1>A title</h1><p>The text of the article, which goes on for a while.</p></article></body></html>"
    rows = [(1, "u", page, "x", 9, "k"), (1, "u", page, "x", 9, "k"), (None, None, page, None, None, None), (2, "v", None, "t", 1, "k")]
    got = sorted(html_extract.extract(spark.createDataFrame(rows, cols)).collect(), key=str)
    assert html_extract.extract(spark.createDataFrame([], cols)).collect() == []
    net = html_extract.labeller()
    monkeypatch.setattr(html_extract, "_net", [])
    monkeypatch.setattr(html_extract, "train", lambda: net)
    html_extract.labeller(spark)
    html_extract._net.clear()
    read = html_extract.labeller(spark)
    assert read is not net and all(np.array_equal(read.p[k], net.p[k]) for k in net.p)
    assert sorted(html_extract.extract(spark.createDataFrame(rows, cols)).collect(), key=str) == got
    assert [x.n_chars for x in got].count(0) == 1 and len({x.text for x in got}) == 2


def test_html_held_out_pages():
    net = html_extract.labeller()
    seqs = [html_extract.blocks(html_extract.generated(10**9 + k)) for k in range(150)]
    right = np.concatenate([a == (html_extract._truth(s) > 0.5) for s, a in zip(seqs, net.label(seqs))])
    assert right.mean() > 0.985


# ------------------------------------------------------------------ 9, 10


def brute_lines(texts):
    first, order = {}, sorted((i, t or "") for i, t in texts if i is not None)
    for i, t in order:
        for k, x in enumerate(t.split("\n")):
            if re.search(r"[^\x20\x09-\x0D]", x):
                first.setdefault(x, (i, k))
    s = {x: {x[k : k + 10] for k in range(max(1, len(x) - 9))} for x in first}
    near = lambda a, b: 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b))
    link = [(x, y) for x in s for y in s if x < y and near(s[x], s[y]) and 5 * len(s[x] & s[y]) >= 4 * len(s[x] | s[y])]
    root = groups(link, s)
    head = {}
    for x, r in root.items():
        head[r] = min(head.get(r, first[x]), first[x])
    return lambda i, t: "\n".join(x for k, x in enumerate(t.split("\n")) if x not in first or head[root[x]] == (i, k))


@pytest.mark.parametrize("texts", [corpus(8), odd(), []], ids=["a", "odd", "none"])
def test_line_dedup(spark, texts):
    keep = brute_lines(texts)
    got = line_dedup.line_dedup(docs_of(spark, texts))
    assert got.columns[: len(SCHEMA.split(", "))] == [c.split()[0] for c in SCHEMA.split(", ")]
    want = sorted((str(i), str(t if t is None or i is None else keep(i, t))) for i, t in texts)
    assert sorted((str(x.doc_id), str(x.text)) for x in got.collect()) == want


def test_line_dedup_of_one_boilerplate_with_many_tails(spark):
    """Lines of one bucket: only the two copies of a tail are alike enough, wherever in the bucket they stand."""
    r = random.Random(21)
    some = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    base, lines = some(109), []
    for _ in range(300):
        tail = some(13)
        lines += [base + tail + some(6), base + tail + some(6)]
    r.shuffle(lines)
    texts = list(enumerate(lines))
    keep = brute_lines(texts)
    got = {x.doc_id: x.text for x in line_dedup.line_dedup(docs_of(spark, texts)).collect()}
    assert got == {i: keep(i, t) for i, t in texts}


def test_two_similar_lines_share_a_band():
    """Of pairs at the similarity, next to none has no common band."""
    assert (1 - 0.8**line_dedup.ROWS) ** line_dedup.BANDS < 0.003


def compared(monkeypatch, run):
    """How many pairs of sets refine compares while run() is computed, and what run() gives."""
    n = []

    def count(df, name, write=common.written):
        out = write(df, name)
        if name in ("compared", "pairs"):
            n.append(out.count())
        return out

    monkeypatch.setattr(refine, "written", count)
    got = run()
    return sum(n), got


def template_lines(n, seed=41):
    """One template, two variants, tails of their own; and links within a third variant only."""
    r = random.Random(seed)
    some = lambda k: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))
    base, variants, close = some(380), [some(50), some(50)], some(110)
    return [base + variants[i % 2] + some(70) for i in range(n)] + [base + close + some(8) for _ in range(n // 4)]


def test_comparisons_of_line_variants_grow_with_the_group(spark, monkeypatch):
    n = {}
    for k in (100, 200):
        texts = list(enumerate(template_lines(k)))
        n[k], got = compared(monkeypatch, lambda: line_dedup.line_dedup(docs_of(spark, texts)).collect())  # noqa: B023
    keep = brute_lines(texts)
    assert {x.doc_id: x.text for x in got} == {i: keep(i, t) for i, t in texts}
    assert n[200] < 2.6 * n[100], n


def test_comparisons_of_document_variants_grow_with_the_group(spark, monkeypatch):
    r = random.Random(43)
    base, variants = prose(r, 400), [prose(r, 40), prose(r, 40)]
    n = {}
    for k in (60, 120):
        texts = [(i, f"{base} {variants[i % 2]} {prose(r, 60)}") for i in range(k)]
        n[k], got = compared(monkeypatch, lambda: ngram_join.near_duplicates(docs_of(spark, texts)).collect())  # noqa: B023
    s = {i: shingles(t) for i, t in texts}
    link = [(i, j) for i in s for j in s if i < j and 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j])]
    root = groups(link, s)
    assert {x.doc_id: x.component_id for x in got} == root
    assert n[120] < 2.6 * max(n[60], 60), n


def test_the_pivot_of_edited_lines_is_their_original(spark, monkeypatch):
    """Copies that are linked to the original only: once compared with it, nothing is left to decide."""
    r = random.Random(47)
    some = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    base, lines, left = some(400), [], []
    for _ in range(60):
        x = list(base)
        for at in r.sample(range(15, 385, 15), 4):
            x[at] = "#"
        lines.append("".join(x))
    lines.insert(r.randrange(60), base)
    texts = list(enumerate(lines))

    def count(df, name, write=common.written):
        out = write(df, name)
        if name == "open":
            left.append(out.count())
        return out

    monkeypatch.setattr(refine, "written", count)
    got = {x.doc_id: x.text for x in line_dedup.line_dedup(docs_of(spark, texts)).collect()}
    keep = brute_lines(texts)
    assert got == {i: keep(i, t) for i, t in texts}
    assert left == [0], left


def edited_lines(n, seed=53):
    """One line in n copies, each with some words replaced by one of two others."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9)))
    base, others, lines = [word() for _ in range(80)], [word(), word()], []
    for _ in range(n):
        x = list(base)
        for at in r.sample(range(0, 80, 4), r.choice((3, 6, 7, 8))):
            x[at] = r.choice(others)
        lines.append(" ".join(x))
    return [" ".join(base), *lines]


def test_small_groups_of_edited_lines_show_no_tokens(spark, monkeypatch):
    """Copies that share edits beyond the similarity: a row for each member of a group, none for their tokens."""
    n = {}

    def count(df, name, write=common.written):
        out = write(df, name)
        n[name] = n.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(refine, "written", count)
    texts = list(enumerate(edited_lines(50)))
    got = {x.doc_id: x.text for x in line_dedup.line_dedup(docs_of(spark, texts)).collect()}
    keep = brute_lines(texts)
    assert got == {i: keep(i, t) for i, t in texts}
    assert n["open"] + n.get("lists", 0) + n["pairs"] <= n["cells"], n


@pytest.mark.parametrize("seed, small, rounds", [(0, 24, 5), (1, 3, 8), (2, 2, 2)])
def test_refine_against_all_pairs(spark, monkeypatch, seed, small, rounds):
    """Random families of sets in one group under any pivot: components are those of all links, by pivots or by pairs."""
    monkeypatch.setattr(refine, "SMALL", small)
    monkeypatch.setattr(refine, "ROUNDS", rounds)
    r = random.Random(seed)
    sets = {}
    for f in range(8):
        core = r.sample(range(10_000), 40)
        for _ in range(r.randint(1, 9)):
            x = set(core) | set(r.sample(range(500), r.randint(0, 12)))
            for v in r.sample(sorted(x), min(len(x) - 1, r.randint(0, 9))):
                x.discard(v)
            sets[len(sets)] = x | set(range(20_000, 20_000 + 30 * (f % 3)))
    first = r.randrange(len(sets))
    cells = spark.createDataFrame([(first, i, i, first) for i in sets if i != first], "pivot long, id long, r long, rp long")
    got = refine.links(cells, spark.createDataFrame([(i, sorted(x)) for i, x in sets.items()], "id long, v array<long>"), 4, 5).collect()
    link = [(i, j) for i in sets for j in sets if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    assert all(tuple(sorted((x.a, x.b))) in set(link) for x in got)
    assert groups([(x.a, x.b) for x in got], sets) == groups(link, sets)


def test_copies_with_edits_of_their_own_show_no_tokens(spark, monkeypatch):
    """Copies that share what they lack of the pivot, but too little outside it: none is looked at beyond that."""
    r, left = random.Random(61), []
    core, sets = range(90), {0: set(range(90))}
    for i in range(1, 101):
        e = 10 if i % 2 else 16
        sets[i] = set(r.sample(core, 90 - e)) | set(r.sample(range(100, 112), 4)) | set(range(1000 * i, 1000 * i + e - 4))

    def count(df, name, write=common.written):
        out = write(df, name)
        if name in ("large", "lists", "pairs"):
            left.append(out.count())
        return out

    monkeypatch.setattr(refine, "written", count)
    cells = spark.createDataFrame([(0, i, i, 0) for i in sets if i], "pivot long, id long, r long, rp long")
    got = refine.links(cells, spark.createDataFrame([(i, sorted(x)) for i, x in sets.items()], "id long, v array<long>"), 4, 5).collect()
    link = [(i, j) for i in sets for j in sets if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    assert groups([(x.a, x.b) for x in got], sets) == groups(link, sets)
    assert left == [0, 0, 0], left


def test_line_dedup_of_a_doc_id_with_two_texts(spark):
    """A row loses its own lines, never the line that stands in the same place of another row."""
    texts = [(1, "a line that both of them hold, here first"), (5, "a line that both of them hold, here first\nanother one of the first row"), (5, "a unique line that nobody else holds\nqq ww")]
    got = sorted(x.text for x in line_dedup.line_dedup(docs_of(spark, texts)).collect())
    assert got == sorted([texts[0][1], "another one of the first row", texts[2][1]])


def test_components(spark):
    r = random.Random(13)
    pairs = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(100 + k, 101 + k) for k in range(40)]
    want = groups(pairs, {x for p in pairs for x in p})
    got = {x.node: x.root for x in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: v for n, v in want.items() if any(n in p and p[0] != p[1] for p in pairs)}


@pytest.mark.parametrize("texts", [corpus(9, 200), odd(), [], [(i, "same text") for i in range(300)]], ids=["a", "odd", "none", "equal"])
def test_sharding(spark, texts):
    docs = docs_of(spark, texts).select("doc_id", "text")
    rows = docs.select("doc_id", F.xxhash64("text").alias("k1"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"))
    got = sharding.shard(rows, 24, "k1", "doc_id", "size", slices=5).collect()
    assert len(got) == len(texts)
    by, order = {}, []
    for x in got:
        by.setdefault(x.shard, []).append(x)
    for s in sorted(by):
        assert sorted(x.slot for x in by[s]) == list(range(len(by[s]))) and 0 <= s < 24
        order += [x.k1 for x in sorted(by[s], key=lambda x: x.slot)]
    assert order == sorted(order)
    total = sum(x.size for x in got)
    top = max((x.size for x in got), default=0)
    assert all(abs(sum(x.size for x in by.get(s, [])) - total / 24) <= 2 * top + 1 for s in range(24))


@pytest.mark.parametrize("n", [0, 1, 7, 100])
def test_part_search(spark, n):
    r = random.Random(n)
    at = sorted((r.randint(-9, 9), r.randint(-9, 9)) for _ in range(n))
    rows = [(a, b) for a in range(-10, 11) for b in range(-10, 11, 3)]
    got = spark.createDataFrame(rows, "a long, b long").withColumn("p", sharding._part(at, "a", "b")).collect()
    assert all(x.p == sum(s <= (x.a, x.b) for s in at) for x in got)


# ------------------------------------------------------------------ registered queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder of tables with odd rows, two texts of one doc_id, copies, passages of the benchmark, labels and pages."""
    at = str(tmp_path_factory.mktemp("tables"))
    r = random.Random(41)
    texts = odd() + [(100 + i, t) for i, t in corpus(18, 40)] + [(200, prose(r, 90)), (200, prose(r, 70))]
    items = [(k, prose(r, 30, 10**6)) for k in range(3)] + [(3, None), (4, "")]
    texts += [(210 + k, prose(r, 60) + " " + t + " " + prose(r, 60)) for k, t in items if t]
    rows = [(i, t, None if k % 7 == 0 else "en" if k % 2 else "de", "s", len(t or "")) for k, (i, t) in enumerate(texts)]
    page = "<html><body><nav><a href=/>Home</a></nav><article><h1>A title</h1><p>The text of the article, which goes on for a while.</p></article></body></html>"
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _ in texts if i is not None and i % 5], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(1, "u", page), (2, None, None), (2, None, None)], "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return at, texts


def result(spark, name, at):
    out = queries.queries()[name](spark, at)
    return out.dtypes, out.collect()


def test_query_op1(spark, small):
    types, got = result(spark, "op1_substring_dedup", small[0])
    assert types[:4] == [("doc_id", "bigint"), ("n_words", "bigint"), ("n_removed", "bigint"), ("kept_sha256", "string")]
    by = {}
    for x in got:
        by.setdefault(x.doc_id, []).append(x[1:4])
    assert {i: sorted(v) for i, v in by.items()} == {i: sorted(v) for i, v in brute_substrings(small[1]).items()}


def test_query_op2(spark, small):
    types, got = result(spark, "op2_ngram_join", small[0])
    assert types[:3] == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint")]
    s = [(i, shingles(t)) for i, t in small[1] if i is not None]
    link = [(i, j) for i, a in s for j, b in s if i < j and a and b and 100 * len(a & b) >= 80 * len(a | b)]
    root = groups(link, {i for i, _ in s})
    assert sorted(x[:3] for x in got if x.doc_id is not None) == sorted((i, len(v), root[i]) for i, v in s)


def test_query_op3(spark, small):
    types, got = result(spark, "op3_best_fit_packing", small[0])
    assert types[:7] == [("doc_id", "bigint"), ("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")]
    assert sorted(str(x.doc_id) for x in got if x.piece == 0) == sorted(str(i) for i, _ in small[1]) and all(1 <= x.length <= 1024 for x in got)


def test_query_op4(spark, small):
    types, got = result(spark, "op4_toxicity", small[0])
    assert types[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    assert sorted(str(x.doc_id) for x in got) == sorted(str(i) for i, _ in small[1])
    for x in got:
        assert x.doc_id is None or x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1)
        assert 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7)


def test_query_op5(spark, small):
    types, got = result(spark, "op5_decontamination", small[0])
    assert types[:2] == [("doc_id", "bigint"), ("item_id", "bigint")]
    assert {(x.doc_id, x.item_id) for x in got} == {(210 + k, k) for k in range(3)}


def test_query_op7(spark, small):
    types, got = result(spark, "op7_html_extraction", small[0])
    assert types[:4] == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    assert sorted((x.page_id, x.url, x.n_chars) for x in got if x.page_id == 2) == [(2, None, 0)] * 2 and len(got) == 3


def test_query_op8(spark, small):
    types, got = result(spark, "op8_language_id", small[0])
    assert types[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    assert len(got) == len(small[1])
    for x in got:
        assert x.doc_id is None or x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0)
    by = {x.doc_id: x for x in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (0, 1, 2)) and by[3].lang_pred in ("de", "en") and by[3][2:4] == by[4][2:4]


def test_query_op9(spark, small):
    types, got = result(spark, "op9_line_dedup", small[0])
    assert types[0] == ("doc_id", "bigint") and len(got) == len(small[1])
    once = [(i, t) for i, t in small[1] if i not in (200, 4, None)]
    keep = brute_lines([x for x in small[1] if x[0] != 200])
    by = {x.doc_id: x.kept_sha256 for x in got}
    assert {i: by[i] for i, _ in once} == {i: hashlib.sha256(keep(i, t or "").encode()).hexdigest() for i, t in once}


def test_query_op10(spark, small):
    types, got = result(spark, "op10_sharding", small[0])
    assert types[:7] == [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")]
    size = lambda t: len((t or "").encode()) + 8
    assert sorted((str(x.doc_id), x.size, x.text_crc32) for x in got) == sorted((str(i), size(t), zlib.crc32((t or "").encode())) for i, t in small[1])
    by = {}
    for x in got:
        assert x.law == "bytes" and x.grown_shard is None and 0 <= x.shard < 24
        by.setdefault(x.shard, []).append(x.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_empty_documents(spark):
    """No documents give no rows, with examples and without."""
    none = spark.createDataFrame([], SCHEMA)
    some = docs_of(spark, [(i, prose(random.Random(i), 30, 50)) for i in range(40)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    assert toxicity.score(none, toxicity.fit(labels, some)).collect() == []
    assert toxicity.fit(labels, none) is None or toxicity.score(none, toxicity.fit(labels, none)).collect() == []
    assert lang_id.predict(none, lang_id.fit(none)).collect() == [] and lang_id.predict(none, lang_id.fit(some)).collect() == []
    items = spark.createDataFrame([(1, prose(random.Random(1), 30))], "item_id long, text string")
    assert decontam.contaminated(none, items).collect() == [] and decontam.contaminated(some, items.where("false")).collect() == []
    assert packing.pack(packing.pieces(none, public_tokenizers.path("byte_bpe_50k.json"))).collect() == []


def test_decontamination_of_repeated_items(spark):
    """Repeated items and documents hit each."""
    text = prose(random.Random(3), 40)
    items = spark.createDataFrame([(1, text), (2, text), (2, text)], "item_id long, text string")
    got = decontam.contaminated(docs_of(spark, [(1, "x y " + text), (5, text), (5, text)]), items).collect()
    assert {(x.doc_id, x.item_id, x.n_match, x.at) for x in got} == {(1, 1, 40, 2), (1, 2, 40, 2), (5, 1, 40, 0), (5, 2, 40, 0)}


def test_quality_of_clashing_columns(spark):
    rows = [("one two. " * 40, "a", "b", 7), (None, "a", "b", 7)]
    out = quality_rules.ledger(spark.createDataFrame(rows, "text string, __w string, __tri string, n_words int"))
    assert {x.n_words for x in out.collect()} == {80, 0}


def test_line_dedup_of_a_very_hot_line(spark):
    """One line in every document, often, beside near copies of it."""
    line = "the very same words stand in each of these documents, over and over again"
    texts = [(i, "\n".join([line, f"own line {i} of this document, with words of its own {i * 7919}", line, line[: 60 + i % 9] + line[60:]])) for i in range(150)]
    keep = brute_lines(texts)
    assert {x.doc_id: x.text for x in line_dedup.line_dedup(docs_of(spark, texts)).collect()} == {i: keep(i, t) for i, t in texts}


# ------------------------------------------------------------------ pipeline


def test_pipeline_of_odd_tables(spark, small, tmp_path):
    """Odd rows and clashing extra columns go through every stage; an empty table gives no rows."""
    import corpus_pipeline

    got = corpus_pipeline.run(spark, small[0]).collect()
    assert got and {x.doc_id for x in got} <= {i for i, _ in small[1]} and not {x.doc_id for x in got} & {210, 211, 212}
    at = str(tmp_path)
    clash = ", ".join(f"{c} string" for c in ("k", "at", "gone", "n_words", "rep", "root", "size", "kept", "failed"))
    spark.createDataFrame([], f"{DOCS}, {clash}").write.parquet(f"{at}/documents.parquet")
    spark.read.parquet(f"{small[0]}/benchmark.parquet").write.parquet(f"{at}/benchmark.parquet")
    assert corpus_pipeline.run(spark, at).collect() == []


def test_pipeline(spark, data):
    """Each stage on its own input against its brute-force version; the last packs all that is left."""
    import corpus_pipeline
    from tessera.llm.common import written

    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "ngram_join", "decontamination", "best_fit_packing"]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()]
        docs = written(stage(spark, docs, data), name)
        if name == "best_fit_packing":
            assert {x.doc_id for x in docs.select("doc_id").collect()} == {i for i, _ in before}
            break
        assert docs.columns == columns
        after = {x.doc_id: x.text for x in docs.collect()}
        if name == "quality_rules":
            assert all(after[i] == t for i, t in before if i in after) and all(len(words(t)) >= 50 for t in after.values())
        elif name == "line_dedup":
            keep = brute_lines(before)
            assert after == {i: keep(i, t) for i, t in before if keep(i, t).strip(" \t\n\x0b\x0c\r") or not words(t)}
        elif name == "ngram_join":
            s = {i: shingles(t) for i, t in before}
            link = [(i, j) for i in s for j in s if i < j and s[i] and s[j] and 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j])]
            root = groups(link, s)
            assert set(after) == {i for i in s if root[i] == i}
        else:
            bench = [x.text for x in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
            assert not any(b in t for b in bench for t in after.values()) and len(after) >= 0.9 * len(before)


def test_quality_sql(spark, data):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    want = con.execute(queries._OP6).df().sort_values("doc_id")
    got = queries.op6_quality_rules(spark, data).toPandas().sort_values("doc_id")
    assert sorted(got.columns) == sorted(want.columns)
    for c in got.columns:
        assert list(got[c]) == list(want[c])


def test_encoder_pauses_the_collector(monkeypatch):
    """The collector waits while texts are encoded, and is as before afterwards, also after an error."""
    import gc

    import public_tokenizers

    from tessera.llm import packing

    enc = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    seen, learn = [], enc._learn
    monkeypatch.setattr(enc, "_learn", lambda words: (seen.append(gc.isenabled()), learn(words)))
    texts = ["one two three", "", "a  b", "one two.\nthree four"]
    got = enc.many(texts)
    assert seen == [False] and gc.isenabled()
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [e.ids for e in enc.tok.encode_batch(texts, add_special_tokens=False)]
    with pytest.raises(TypeError):
        enc.many([None])
    assert gc.isenabled()


def test_votes_partition_scores_once(monkeypatch):
    """The least of the nearest scores is sought where it decides something: once a block of texts, then once a text."""
    from tessera.llm import toxicity

    r = np.random.default_rng(5)
    n = toxicity.NEAREST * 40
    docs = [(np.unique(r.integers(0, 400, 30)).astype(np.uint64), None) for _ in range(n)]
    docs = [(t, np.ones(len(t))) for t, _ in docs]
    terms = np.unique(np.concatenate([t for t, _ in docs]))
    m = toxicity.Index(terms, np.ones(len(terms)), n, list(range(n)), r.integers(0, 2, n), docs)
    shapes, partition = [], np.partition
    monkeypatch.setattr(np, "partition", lambda a, *x, **k: (shapes.append(np.shape(a)), partition(a, *x, **k))[1])
    got = m.nearest([m.query(*t) for t in docs[:7]])
    assert shapes.count((7, m.blocks * toxicity.BLOCK)) == 1 and all(len(at) == toxicity.NEAREST for at, _ in got)
