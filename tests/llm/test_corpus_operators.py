"""Operators that compare the documents of a corpus, against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from lattica.llm import graph, gru, language_id, lm_score, simhash, substring_dedup
from lattica.llm.common import table

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def least_reachable(nodes, near):
    """By node the least one reachable."""
    up = {x: x for x in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in near:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {x: top(x) for x in nodes}


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


# SimHash.
def test_fingerprints_and_components(spark):
    rng = np.random.default_rng(2)
    base = [" ".join(rng.choice(["The", "a", "of", "x1", "y", "zeta", "Ökö"], 40)) for _ in range(6)]
    texts = [None, "", " ", "one", "one two", "ONE two"] + [b.replace(" a ", " aa ", k) for b in base for k in range(6)] + base
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, extra string")
    got = {r.doc_id: r for r in simhash.near_groups(docs).collect()}
    fps = {i: fingerprint(t) for i, t in enumerate(texts)}
    assert {i: r.fp & (1 << 64) - 1 for i, r in got.items()} == fps
    near = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2]
    assert {i: r.component_id for i, r in got.items()} == least_reachable(fps, near)


@pytest.mark.parametrize("most", [1, 4, 64])
def test_links_lose_no_component(spark, most):
    """Clusters around random centres, with buckets below and above the bound."""
    rng = np.random.default_rng(most)
    fps = set()
    for _ in range(8):
        c = int(rng.integers(0, 1 << 63))
        for _ in range(25):
            x = c
            for b in rng.choice(64, rng.integers(0, 4), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = {(r.u, r.v) for r in simhash.links(df, 2, most).collect()}
    near = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in found)
    assert least_reachable(signed, found) == least_reachable(signed, near)


def test_thresholds_cover_all_pairs():
    """Any pair within max_bits meets under a key of the plan."""
    parts = [list(range(0, 20)), list(range(20, 42)), list(range(42, 64))]
    for ts in ([0, 0, 0], [1, 0, -1], [2, -1, -1]):
        keys = [m for p, t in zip(parts, ts) for m in simhash.masks(p, t)]
        rng = np.random.default_rng(0)
        for _ in range(200):
            diff = sum(1 << int(b) for b in rng.choice(64, 2, replace=False))
            assert any(diff & (m & (1 << 64) - 1) == 0 for m in keys)
    assert simhash.allocate([[0, 5, 50, 500], [0, 1, 10, 100], [0, 5, 50, 500]], 0)[1] == [0, 0, 0]


def test_near_duplicates_keep_one(spark):
    rows = [(1, "a b c d e"), (2, "a b c d e"), (3, "something else entirely"), (3, "something else entirely"), (None, "only here it is"), (None, "only here it is")]
    out = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in out) == [(False, 1), (False, 3), (True, None)]


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(5001, 5100)]
    got = {r.u: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = {x for e in edges for x in e}
    assert {x: got.get(x, x) for x in nodes} == least_reachable(nodes, edges)
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


# Repeated substrings.
def cut_by_hand(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[s : s + 400] for r in raw for s in range(len(r) - 399))
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for s in range(len(r) - 399):
            if seen[r[s : s + 400]] > 1:
                gone[s : s + 400] = True
        kept = bytes(np.frombuffer(r, np.uint8)[~gone])
        out.append((len(r), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_substrings(spark):
    rng = np.random.default_rng(0)
    base = ["".join(rng.choice(list("abcdefgh "), rng.integers(300, 1500))) for _ in range(12)]
    texts = []
    for _ in range(120):
        t = ""
        for _ in range(rng.integers(1, 4)):
            x = base[rng.integers(12)]
            i = rng.integers(0, len(x))
            t += x[i : i + rng.integers(100, 900)] + "".join(rng.choice(list("xyz"), rng.integers(0, 60)))
        texts.append(t)
    texts += ["a" * 1000, "a" * 401, "a" * 400, "a" * 399, "ab" * 700, "", None, "The " * 500, "é" * 450, "x".join(["q" * 397] * 4), *texts[:3]]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, places int").repartition(5)
    got = {r.doc_id: tuple(r)[1:5] for r in substring_dedup.substring_dedup(df).collect()}
    assert got == dict(enumerate(cut_by_hand(texts)))


def test_substrings_of_rows_that_repeat(spark):
    text = "".join(np.random.default_rng(1).choice(list("abc"), 500))
    out = substring_dedup.substring_dedup(spark.createDataFrame([(1, text), (1, text), (None, "b" * 10)], "doc_id long, text string")).collect()
    assert sorted(r.n_removed for r in out) == [0, 500, 500]
    assert substring_dedup.substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# The recurrent layer and the language model.
def test_gradients():
    rng = np.random.default_rng(0)
    h = language_id.HIDDEN
    p = {k: v.astype(np.float64) for k, v in language_id.init(3).items()}
    x, y = rng.integers(97, 104, (5, 7)).astype(np.uint8), rng.integers(0, 3, 5)
    _, g = language_id.train_step(p, x, y)
    for k, at in (("V", (1, 3)), ("c", (2, 0)), ("fU", (2, 1)), ("bU", (h + 1, 0)), ("fW", (3, x[0, 0])), ("bW", (2 * h, x[1, 2])), ("fb", (0, 0))):
        keep = p[k][at]
        p[k][at] = keep + 1e-3
        up = language_id.train_step(p, x, y)[0]
        p[k][at] = keep - 1e-3
        down = language_id.train_step(p, x, y)[0]
        p[k][at] = keep
        assert abs((up - down) / 2e-3 - g[k][at]) < 1e-3 * max(0.1, abs(g[k][at])) + 1e-5


def test_state_is_carried_and_reset():
    """A document's log probability doesn't depend on windows, lanes or its neighbours."""
    p = lm_score.init()
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, lm_score.HEAD + lm_score.N_LOOKS, n).astype(np.int32) for n in (1, 5, 31, 32, 33, 200, 77)]
    alone = np.concatenate([lm_score.run(p, [d]) for d in docs])
    for lanes in (1, 2, 7):
        assert np.allclose(lm_score.run(p, docs, n_lanes=lanes), alone, rtol=1e-4)
    w, h, whole = lm_score.inputs(p), np.zeros((lm_score.HIDDEN, 1), np.float32), 0.0
    x = np.concatenate(([lm_score.HEAD + lm_score.N_LOOKS], docs[5][:-1]))
    for a, b in zip(x, docs[5]):
        lp, h, _ = lm_score.window(p, w, np.array([[a]]), np.array([[b]]), h, False)
        whole += float(lp[0, 0])
    assert abs(whole - alone[5]) < 1e-2


def test_network_is_a_distribution():
    p = lm_score.init()
    n = lm_score.HEAD + lm_score.N_LOOKS
    total = sum(math.exp(lm_score.run(p, [np.array([k], np.int32)])[0]) for k in range(0, n))
    assert abs(total - 1) < 1e-3


def test_lm_base_counts(spark):
    docs = table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r for r in lm_score.lm_scores(docs).collect()}
    train = {i: zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows}
    c = Counter(t for i, x in rows if train[i] for t in lm_score.tokens(x))
    n, v = sum(c.values()), len(c)
    for i, x in rows:
        words = lm_score.tokens(x)
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(words), sum(c[w] > 0 for w in words), n, not train[i])
        assert abs(r.base_score - base) < 1e-6 * abs(base) and r.score < 0
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_learns_from_all_texts(spark, monkeypatch):
    """Every training text reaches the tuning, and the head is ranked by the counts of all of them."""
    rows = [(i, f"{'late ' * 9}w{i}" if i else "early start") for i in range(60)]
    train = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    common, counts = lm_score.common_tokens(train)
    assert dict(zip(common, counts.tolist())) == Counter(t for _, x in rows for t in lm_score.tokens(x)) and common[0] == b"late"
    seen, averaged = [], lm_score.averaged

    def spy(parts):
        seen.extend(r.n for r in parts.collect())
        return averaged(parts)

    monkeypatch.setattr(lm_score, "averaged", spy)
    lm_score.fit(train, common, 1)
    assert sum(seen) == sum(len(lm_score.tokens(x)) for _, x in rows)


def test_lm_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "a A"), (7, "x " * 30000)]
    out = lm_score.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 6 and {r.doc_id: r.n_tokens for r in out} == {1: 1, 2: 1, 3: 4, None: 3, 7: 30001}
    assert len({r.score for r in out if r.doc_id == 3}) == 1
    assert lm_score.lm_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# The pipeline.
def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        before, after = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.text for r in out.collect()}
        assert set(after) <= set(before)
        if name == "simhash_near_dedup":
            fps = {i: fingerprint(t) for i, t in before.items()}
            near = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2]
            assert set(after) == set(least_reachable(fps, near).values())
        if name != "pii":
            assert all(before[i] == t for i, t in after.items())
        else:
            assert set(after) == set(before) and not any("@" in t and re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t) for t in after.values())
        docs = out
    assert corpus_pipeline.run(spark, SF).count() > 0
