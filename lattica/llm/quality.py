"""Quality classifier: Bradley-Terry ranking of documents, then a threshold at a score quantile.

A document is a vector of measures of its text (shares of kinds of characters, repetition of words
and lines, lengths, frequent words), each measure as one of ten quantile bins of the labelled
sample. Pairs of a preferred (label 1) and another (label 0) document train weights by the logistic
loss on the difference of their vectors. The documents' strengths are then cut at the quantile of the
sample that separates its labels best; the score is the logistic function of the distance to the cut.

Only the fit sees a bounded sample of labelled rows (``most_labelled``); the strength of a document is
computed row by row in Arrow batches, over the whole text, without a shuffle.

Defined results: null and empty texts are measured as texts without characters; repeated rows get
equal results; without labels of both kinds every score is the share of label 1 (0.5 without
labels); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from operator import eq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import bucket_of, labelled_sample, map_batches, table

MOST_LABELLED = 20_000
BINS = 10
#: Frequent words of the four languages.
FREQUENT = frozenset("the of and to in a is that it for on was as with be by de la le et les des en un une que pour dans der die und das den von zu mit ist ein el los se por las del con una su para".split())
KINDS = np.zeros(256, np.int64)
for _chars, _kind in (("abcdefghijklmnopqrstuvwxyz", 1), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), ("0123456789", 3), (" \t\r\x0b\x0c", 4), ("\n", 5), (".,;:", 6), ("!?", 7), ("#*$%&<>|", 8), ("'\"()[]{}-_/@+=\\~^`", 9)):
    for _c in _chars:
        KINDS[ord(_c)] = _kind
KINDS[128:] = 10


def measures(text: str | None) -> list[float]:
    """About two dozen measures of a whole text."""
    text = text or ""
    words = text.split()
    raw = text.encode("utf-8", "replace")
    b = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256, np.int64)
    k = np.bincount(KINDS, b, 11) / max(len(raw), 1)
    n, lines = len(words), [x for x in text.split("\n") if x]
    distinct, starts = set(words), [x[:1] for x in words]
    pairs = sum(map(eq, words, words[1:]))
    skips = sum(map(eq, words, words[2:])) if n > 2 else 0
    shape = sum(map(str.isupper, starts)) / max(n, 1)
    seen = [len(w) for w in distinct]
    lengths = len(raw) / max(n, 1)
    three = len(set(zip(words, words[1:], words[2:]))) / max(n - 2, 1) if n > 2 else 1.0
    return [
        float(np.log1p(n)), float(np.log1p(len(raw))), lengths, len(distinct) / max(n, 1), len(distinct) / max(n, 1) ** 0.8,
        pairs / max(n, 1), skips / max(n, 1), shape, three, sum(seen) / max(len(seen), 1), float(max(seen, default=0)),
        len(set(lines)) / max(len(lines), 1), float(np.log1p(len(lines))), n / max(len(lines), 1),
        sum(1 for w in words if w in FREQUENT) / max(n, 1), sum(1 for x in lines if x[-1:] in ".!?") / max(len(lines), 1),
        b[ord("|")] / max(n, 1), b[ord("!")] / max(n, 1), *k[1:].tolist(),
    ]


def binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """One-hot bins of each measure."""
    out = np.zeros((len(x), x.shape[1], BINS), np.float32)
    for j in range(x.shape[1]):
        out[np.arange(len(x)), j, np.searchsorted(edges[j], x[:, j], side="right")] = 1
    return out.reshape(len(x), -1)


def bradley_terry(good: np.ndarray, bad: np.ndarray, *, epochs: int = 60, l2: float = 1e-4, seed: int = 7) -> np.ndarray:
    """Weights that give the preferred document of a pair the higher strength.

    Each epoch pairs every document of either side at least once, in a seeded order.
    """
    rng, n = np.random.default_rng(seed), max(len(good), len(bad))
    w, m = np.zeros(good.shape[1]), np.zeros(good.shape[1])
    for epoch in range(epochs):
        a = np.resize(rng.permutation(len(good)), n)
        b = np.resize(rng.permutation(len(bad)), n)
        for at in range(0, n, 512):
            d = good[a[at : at + 512]] - bad[b[at : at + 512]]
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            m = 0.9 * m + (p @ d) / len(d) - l2 * w
            w = w + 0.3 / (1 + epoch / 10) * m
    return w


def cut_at_quantile(s: np.ndarray, y: np.ndarray) -> float:
    """The strength at the sample's quantile that makes the fewest errors, midway between its neighbours."""
    order = np.argsort(s, kind="stable")
    wrong = np.concatenate(([0], np.cumsum(y[order]))) + np.concatenate((np.cumsum((1 - y[order])[::-1])[::-1], [0]))
    s = np.concatenate(([s[order[0]] - 1], s[order], [s[order[-1]] + 1]))
    ok = np.diff(s) > 0  # a cut parts no ties
    k = int(np.flatnonzero(ok)[np.argmin(wrong[ok])])
    return float((s[k] + s[k + 1]) / 2)


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> dict:
    def make():
        return lambda texts, ys: [ys, [measures(t) for t in texts]]

    rows = map_batches(labelled_sample(docs, labels, "quality", most_labelled).select("text", "y"), make, "y int, x array<double>").collect()
    rows.sort(key=lambda r: (r.y, r.x))
    y = np.array([r.y for r in rows], float)
    if not 0 < y.sum() < len(y):
        return {"edges": None, "share": float(y.mean()) if len(y) else 0.5}
    x = np.array([r.x for r in rows])
    edges = np.quantile(x, np.arange(1, BINS) / BINS, axis=0).T
    f = binned(x, edges)
    w = bradley_terry(f[y == 1], f[y == 0])
    s = f @ w
    return {"edges": edges, "w": w, "cut": cut_at_quantile(s, y), "scale": max(float(s.std()), 1e-6)}


def strength_score(texts: list[str | None], fitted: dict) -> np.ndarray:
    if fitted["edges"] is None:
        return np.full(len(texts), fitted["share"])
    s = binned(np.array([measures(t) for t in texts]), fitted["edges"]) @ fitted["w"]
    return 1 / (1 + np.exp(-np.clip(4 * (s - fitted["cut"]) / fitted["scale"], -40, 40)))


def score(docs: DataFrame, fitted: dict) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""

    def make():
        def rows(ids, held, texts):
            p = strength_score(texts, fitted)
            return [ids, held, p.tolist(), (p >= 0.5).astype(int).tolist()]

        return rows

    rows = docs.select(F.col("doc_id").cast("long"), (bucket_of(F.col("doc_id"), 3) == 1).alias("held_out"), "text")
    return map_batches(rows, make, "doc_id long, held_out boolean, score double, predicted int")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op1: every text of ``documents`` scored for quality."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
