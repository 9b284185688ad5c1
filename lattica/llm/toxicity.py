"""Toxicity: a noisy-channel decoder restores obfuscated words, then the restored text is scored.

The channel swaps letters for look-alikes (l33t), spaces or dots them out, and repeats them. A
token that shows such signs becomes a lattice of the letters each sign may stand for, and Viterbi
picks the path that the channel and a character trigram model make likeliest. A run of single
characters is one lattice, in which a space is nothing or a word break. The model is counted
over all training texts. Words and word beginnings that labelled toxic documents hold far more
often than others (``MIN_TOXIC`` documents, ``MIN_ODDS`` times) are the features of a logistic
regression over the restored words.

Scale: one pass counts trigrams (a table of 32^3 sums, whatever the corpus), one scores; each works
row by row in Arrow batches without a shuffle of text. Only the fit sees a bounded sample of
labelled rows (``most_labelled``). Tokens are decoded once for each task by a cache of bounded size.

Defined results: null or empty texts get the score of a text without any feature; repeated rows get
equal results; without labels of both kinds every score is the share of label 1 (0 without labels);
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import Written, bucket_of, labelled_sample, map_batches, table

A = 32
MOST_LABELLED = 20_000
MIN_TOXIC = 3
MIN_ODDS = 6.0
CACHE = 300_000
THRESHOLD = 0.7
#: What a sign may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "?": "",
}
#: Letters of other scripts that look like Latin ones.
TWINS = str.maketrans("аеорсухіѕјԁкмтвн", "aeopcyxisjdkmtbh")
LETTERS = "abcdefghijklmnopqrstuvwxyz"
ENDS = ".,;:!?\"'()[]{}«»…#%&*|~^=/\\<>-_`"
ODD = re.compile(r"[0-9@$!|+(<€£¡*._\-Ѐ-ӿ]|(\w)\1\1")
MORE = re.compile(r"(.)\1{3,}")
SPACED = re.compile(r"""(?<!\S)["'(\[{«]*(?:[^\W_]|[@$!|+*€])(?: {1,2}(?:[^\W_]|[@$!|+*€])){2,}(?=[.,;:!?"')\]}»…]*(?!\S))""")


def codes() -> np.ndarray:
    """A code below 32 for each byte: 0 for what parts words, 1-26 for letters, the rest for bytes of other letters."""
    lut = np.zeros(256, np.int64)
    for i, c in enumerate(LETTERS):
        lut[ord(c)] = lut[ord(c.upper())] = i + 1
    for b in range(128, 256):
        lut[b] = 27 + b % 5
    return lut


LUT = codes()


def count_trigrams(text: bytes) -> np.ndarray:
    c = LUT[np.frombuffer(b" " + text + b" ", np.uint8)]
    c = c[np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))]  # runs of breaks count as one
    if c.size < 2:
        return np.zeros(A**3, np.int64)
    p = np.concatenate(([0], c[:-1]))
    q = np.concatenate(([0], p[:-1]))
    q[p == 0] = 0  # nothing is known before a break
    return np.bincount((q * A + p) * A + c, minlength=A**3)


def char_model(train: DataFrame) -> np.ndarray:
    """log P(c | a, b) at [a, b, c], from all training texts, smoothed by bigrams."""

    def make():
        def sums(texts):
            out = np.zeros(A**3, np.int64)
            for i in range(0, len(texts), 64):
                out += count_trigrams(" ".join(t for t in texts[i : i + 64] if t).encode("utf-8", "replace"))
            at = np.nonzero(out)[0]
            return [at.tolist(), out[at].tolist()]

        return sums

    rows = map_batches(train.select("text"), make, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(A**3)
    for k, v in rows:
        n[k] = v
    n = n.reshape(A, A, A)
    two = n.sum(0) + 0.5
    two /= two.sum(1, keepdims=True)
    return np.log((n + 5 * two) / (n.sum(2, keepdims=True) + 5)).astype(np.float32)


class Decoder:
    """Viterbi over the lattice of a token or a run of single characters."""

    def __init__(self, model: np.ndarray) -> None:
        self.model = {} if model is None else model.tolist()

    @staticmethod
    def lattice(token: str) -> list[list[tuple[str, float]]]:
        """For each run of a sign, what it may stand for and the channel's log probability."""
        out, i = [], 0
        while i < len(token):
            c, j = token[i], i
            while j < len(token) and token[j] == c:
                j += 1
            n, i = j - i, j
            if c.isalpha():
                options = [(c, 0.0)] if n == 1 else [(c * 2, -0.5), (c, -1.0)] if n == 2 else [(c, -0.2), (c * 2, -1.0)]
            elif c == "*":
                options = [(x * min(n, 1), -3.5) for x in LETTERS] + [("", -4.0)]
            elif c in LOOKALIKES:
                options = [(x, -0.7) for x in LOOKALIKES[c]] + [("", -9.0)]
                if n > 1:
                    options += [(x * 2, -1.0) for x in LOOKALIKES[c]]
            elif c == " ":
                options = [("", -0.5), (" ", -1.0)] if n == 1 else [("", -1.0), (" ", -0.5)]
            else:
                options = [("", -0.3), (" ", -1.5)]
            out.append(options)
        return out

    def decode(self, token: str) -> str:
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        m = self.model
        for options in [*self.lattice(token), [(" ", 0.0)]]:
            now: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, path) in best.items():
                for letters, p in options:
                    s, x, y = score + p, a, b
                    for ch in letters.encode("utf-8"):
                        z = int(LUT[ch])
                        s += m[x][y][z]
                        x, y = (0, 0) if z == 0 else (y, z)
                    old = now.get((x, y))
                    if old is None or s > old[0]:
                        now[x, y] = (s, (path, letters))
            best = now
        path, out = max(best.values(), key=lambda v: v[0])[1], []
        while path is not None:
            path, letters = path
            out.append(letters)
        return "".join(reversed(out)).strip()


class Restorer:
    """The distinct restored words of a text."""

    def __init__(self, model: np.ndarray) -> None:
        self.decoder, self.cache = Decoder(model), {}

    def word(self, raw: str) -> str:
        """The restored token; words that a sign parted have a space between them."""
        found = self.cache.get(raw)
        if found is None:
            w = raw.lower().translate(TWINS).strip(ENDS + " ")
            if w[-2:-1] in ("$", "@") and w[-3:] == w[-1] * 3:
                w = w.rstrip("$@")  # a run of signs behind a word is mere noise
            if any(map(str.isalpha, w)) and (" " in w or ODD.search(w)):
                w = self.decoder.decode(MORE.sub(r"\1\1\1", w))  # more than three of a sign stand for what three do
            found = w
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[raw] = found
        return found

    def words(self, text: str | None) -> set[str]:
        if not text:
            return set()
        out = set(map(self.word, set(text.split())))
        out.update(self.word(m[0]) for m in SPACED.finditer(text))
        for w in [w for w in out if " " in w]:
            out.remove(w)
            out.update(w.split())
        out.discard("")
        return out


def features(words: set[str]) -> set[str]:
    """The words, and the beginnings of the longer ones."""
    return words | {"^" + w[:5] for w in words if len(w) >= 5}


def select_features(rows: DataFrame, n: int, n_toxic: int, min_toxic: int = MIN_TOXIC, min_odds: float = MIN_ODDS) -> list[str]:
    """All features that at least min_toxic toxic documents of the sample hold and that are min_odds times likelier in them."""
    counts = rows.select("y", F.explode("f").alias("f")).groupBy("f").agg(F.sum("y").alias("a"), F.count("*").alias("c"))
    odds = (F.col("a") / F.lit(max(n_toxic, 1))) / ((F.col("c") - F.col("a") + 1) / F.lit(max(n - n_toxic, 1)))
    kept = counts.filter(F.col("a") >= min_toxic).withColumn("odds", odds).filter(F.col("odds") >= min_odds)
    return [r.f for r in sorted(kept.select("f", "a").collect(), key=lambda r: (-r.a, r.f))]


def logistic(rows: list[np.ndarray], y: np.ndarray, n: int, epochs: int = 800, l2: float = 3e-5) -> tuple[np.ndarray, float]:
    """Weights and bias over binary features, by full-batch gradient steps with momentum."""
    w, b, mw, mb = np.zeros(n), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), np.zeros(n), 0.0
    at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    for _ in range(epochs):
        p = 1 / (1 + np.exp(-(b + np.bincount(doc, w[at], len(rows)))))
        g = (p - y) / len(y)
        mw = 0.9 * mw + np.bincount(at, g[doc], n) + l2 * w
        mb = 0.9 * mb + g.sum()
        w, b = w - 3.0 * mw, b - 3.0 * mb
    return w, b


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> dict:
    """The character model, the features' weights and the bias."""
    model = char_model(docs.filter(bucket_of(F.col("doc_id"), 3) != 1))

    def make():
        restorer = Restorer(model)
        return lambda texts, ys: [ys, [sorted(features(restorer.words(t))) for t in texts]]

    rows = Written(map_batches(labelled_sample(docs, labels, "toxic", most_labelled).select("text", "y"), make, "y int, f array<string>"), "toxic").read()
    n, n_toxic = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < n_toxic < n:
        p = n_toxic / n if n else 0.0
        return {"model": model, "weights": {}, "bias": float(np.log((p + 1e-9) / (1 - p + 1e-9)))}
    names = select_features(rows, n, n_toxic)
    index = {f: i for i, f in enumerate(names)}

    def make_ids():
        return lambda ys, fs: [ys, [[index[f] for f in x if f in index] for x in fs]]

    found = map_batches(rows.select("y", "f"), make_ids, "y int, f array<int>").collect()
    found.sort(key=lambda r: (r.y, r.f))  # sums don't depend on the order rows come in
    w, b = logistic([np.array(r.f, np.int64) for r in found], np.array([r.y for r in found], float), max(len(names), 1))
    return {"model": model, "weights": dict(zip(names, w.tolist())), "bias": b}


def score(docs: DataFrame, fitted: dict) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""

    def make():
        restorer, weights, bias = Restorer(fitted["model"]), fitted["weights"], fitted["bias"]

        def rows(ids, held, texts):
            z = np.array([bias + sum(weights.get(f, 0.0) for f in sorted(features(restorer.words(t)).intersection(weights))) for t in texts])
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            return [ids, held, p.tolist(), (p >= THRESHOLD).astype(int).tolist()]

        return rows

    rows = docs.select(F.col("doc_id").cast("long"), (bucket_of(F.col("doc_id"), 3) == 1).alias("held_out"), "text")
    return map_batches(rows, make, "doc_id long, held_out boolean, score double, predicted int")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op10: every text of ``documents`` scored for toxicity."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
