"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy.

The network reads the bytes of a whole text (in lower case, white space and signs included) in both
directions, its state carried across words, and labels every byte position with language
probabilities; a document's log probability of a language is the mean over all its positions. Long
texts are read in windows of about ``WINDOW`` bytes, each from ``CONTEXT`` bytes before its first position and
to as many behind its last, whose own labels count in the windows beside it.

Training sees windows of a bounded sample of documents: about ``docs_per_language`` documents of each
language, all languages alike and every language that is given, and ``WINDOWS_PER_DOC`` windows of a
document, spread evenly over its whole text. Scoring covers every byte of every document, row by row
in Arrow batches, without a shuffle; what it holds is bounded by a batch and a block of windows.

Defined results: a null text or one without a letter is ``und`` with score 0; so is every text if
nothing can be learned; repeated rows get equal results; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import gru
from lattica.llm.common import bucket_of, map_batches, table

DOCS_PER_LANGUAGE = 400
WINDOWS_PER_DOC = 16
TRAIN_WINDOW = 64
HIDDEN = 12
STEPS = 400
BATCH = 128
WINDOW, CONTEXT = 512, 32
#: The symbol that fills up windows; it leaves the state as it is.
NONE = 256


def train_windows(text: str) -> list[bytes]:
    """At most WINDOWS_PER_DOC windows of TRAIN_WINDOW bytes, spread evenly over the text; a shorter text is one window."""
    b = text.lower().encode("utf-8", "replace")
    last = len(b) - TRAIN_WINDOW
    if last <= 0:
        return [b] if b else []
    starts = np.linspace(0, last, min(WINDOWS_PER_DOC, -(-len(b) // TRAIN_WINDOW))).astype(np.int64).tolist()
    return [b[i : i + TRAIN_WINDOW] for i in starts]


def init(n_langs: int, seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    f, b = gru.init(rng, 256, HIDDEN), gru.init(rng, 256, HIDDEN)
    p = {"f" + k: v for k, v in f.items()} | {"b" + k: v for k, v in b.items()}
    return p | {"V": rng.normal(0, 0.2, (n_langs, 2 * HIDDEN)).astype(np.float32), "c": np.zeros((n_langs, 1), np.float32)}


def project(w: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(T, B) symbols to (T, 3H, B) projections."""
    w = np.ascontiguousarray((w + b).T)
    out = np.empty((*at.shape[:1], w.shape[1], *at.shape[1:]), np.float32)
    for x, row in zip(out, at):
        x[:] = w[row].T
    return out


def states(p: dict[str, np.ndarray], x: np.ndarray, keep: bool = False):
    """x: (B, T) bytes; the states of both directions, (T, 2H, B), and what training needs."""
    t = np.ascontiguousarray(x.T)
    h0 = np.zeros((HIDDEN, len(x)), np.float32)
    hf, kf = gru.forward(project(p["fW"], p["fb"], t), h0, p["fU"], keep)
    hb, kb = gru.forward(project(p["bW"], p["bb"], t[::-1]), h0, p["bU"], keep)
    return np.concatenate((hf, hb[::-1]), axis=1), kf, kb


def with_none(p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The network with the symbol NONE, at which the update gate keeps the whole state."""
    keep = np.zeros((3 * HIDDEN, 1), np.float32)
    keep[:HIDDEN] = 100
    return p | {d + "W": np.concatenate((p[d + "W"][:, :NONE], keep), axis=1) for d in "fb"}


def log_labels(p: dict[str, np.ndarray], x: np.ndarray, counted: np.ndarray) -> np.ndarray:
    """The log probabilities of the languages, summed over the counted (B, T) positions of each row, (B, languages)."""
    z = p["V"] @ states(p, x)[0] + p["c"]
    z -= z.max(1, keepdims=True)
    z -= np.log(np.exp(z).sum(1, keepdims=True))
    z *= counted.T[:, None]
    return z.sum(0).T


def train_step(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    h, kf, kb = states(p, x, keep=True)
    t, _, b = h.shape
    prob = gru.softmax(p["V"] @ h + p["c"], 1)
    loss = float(-np.log(prob[:, y, np.arange(b)] + 1e-9).mean())
    prob[:, y, np.arange(b)] -= 1
    prob /= t * b
    dh = p["V"].T @ prob
    g = {"V": np.matmul(prob, h.transpose(0, 2, 1)).sum(0), "c": prob.sum((0, 2))[:, None]}
    for d, kept, dhs, at in (("f", kf, dh[:, :HIDDEN], x.T), ("b", kb, dh[::-1, HIDDEN:], x.T[::-1])):
        dx, g[d + "U"] = gru.backward(dhs, p[d + "U"], kept)
        g[d + "W"], g[d + "b"] = gru.input_gradient(dx, at, 256), dx.sum((0, 2))[:, None]
    return loss, g


def train(windows: dict[str, list[bytes]], langs: list[str], steps: int = STEPS, seed: int = 3) -> dict[str, np.ndarray]:
    """windows: by language. Steps draw languages alike, and a language's windows alike."""
    rng = np.random.default_rng(seed)
    p = init(len(langs))
    opt = gru.Adam(p, 0.01)
    pool: dict[int, list] = {}
    for k, lang in enumerate(langs):
        for w in sorted(windows[lang]):
            pool.setdefault(len(w), []).append((w, k, 1 / len(windows[lang])))
    sizes = sorted(pool)
    sets = {n: (np.frombuffer(b"".join(w for w, _, _ in pool[n]), np.uint8).reshape(-1, n), np.array([k for _, k, _ in pool[n]]), np.cumsum([v for _, _, v in pool[n]])) for n in sizes}
    share = np.array([sets[n][2][-1] for n in sizes])
    for step in range(steps):
        n = int(rng.choice(sizes, p=share / share.sum()))
        x, y, cum = sets[n]
        at = np.minimum(np.searchsorted(cum, rng.random(BATCH) * cum[-1]), len(x) - 1)
        opt.lr = 0.01 * (1 - 0.9 * step / steps)
        opt.step(train_step(p, x[at], y[at])[1])
    return p


def windows_of(n: int) -> Iterator[tuple[int, int, int, int]]:
    """Begin and end of the positions that a window counts, and of the bytes that it reads, over n bytes."""
    k = -(-n // WINDOW)
    for i in range(k):
        a, b = n * i // k, n * (i + 1) // k
        yield a, b, max(0, a - CONTEXT), min(n, b + CONTEXT)


class Labeller:
    """Sums of the labels of whole texts."""

    def __init__(self, p: dict[str, np.ndarray], n_langs: int) -> None:
        self.p, self.n = with_none(p), n_langs
        #: Windows read at once: fewer of them where there are many languages, as each position has a label for each.
        self.rows = max(8, min(256, 4_000_000 // ((WINDOW + 2 * CONTEXT) * n_langs)))

    def labels(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """By text the summed log probabilities and the number of positions."""
        raw = [np.frombuffer(t.lower().encode("utf-8", "replace"), np.uint8) for t in texts]
        at = np.array([(i, *w) for i, b in enumerate(raw) for w in windows_of(len(b))], np.int64).reshape(-1, 5)
        at = at[np.argsort(at[:, 4] - at[:, 3], kind="stable")]
        out = np.zeros((len(texts), self.n))
        for k in range(0, len(at), self.rows):
            some = at[k : k + self.rows]
            doc, begin, end, first, last = some.T
            steps = np.arange((last - first).max())
            x = np.full((len(some), len(steps)), NONE, np.int16)
            for row, (i, _, _, a, b) in zip(x, some.tolist()):
                row[: b - a] = raw[i][a:b]
            counted = (steps >= (begin - first)[:, None]) & (steps < (end - first)[:, None])
            np.add.at(out, doc, log_labels(self.p, x, counted))
        return out, np.array([len(b) for b in raw])


def predict(labeller: Labeller | None, langs: list[str], texts: list[str | None]) -> tuple[list[str], list[float]]:
    lang, score = ["und"] * len(texts), [0.0] * len(texts)
    if labeller is None:
        return lang, score
    some = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
    if some:
        sums, n = labeller.labels([texts[i] for i in some])
        p = gru.softmax(sums / n[:, None])
        for i, row, best in zip(some, p, np.argmax(sums, 1)):
            lang[i], score[i] = langs[best], round(float(row[best]), 6)
    return lang, score


def fit(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> dict:
    """Trains on about docs_per_language documents of each language, chosen by the hash of their id."""
    train_docs = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (bucket_of(F.col("doc_id"), 3) != 1))
    counts = train_docs.groupBy("lang").agg(F.count("*").alias("n"))
    counts = sorted((r.lang, r.n) for r in counts.collect())
    if not counts:
        return {"langs": [], "p": None}
    share = F.create_map(*[x for lang, n in counts for x in (F.lit(lang), F.lit(docs_per_language / n))])
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"), F.lit(1 << 52)) / float(1 << 52)
    sample = train_docs.filter(draw < F.try_element_at(share, "lang")).select("lang", "text")

    def make():
        def cut(langs, texts):
            rows = [(lang, w) for lang, t in zip(langs, texts) for w in train_windows(t)]
            return [[r[0] for r in rows], [r[1] for r in rows]]

        return cut

    # As many windows as the sample's documents have, which is bounded by language.
    windows: dict[str, list[bytes]] = {}
    for r in map_batches(sample, make, "lang string, w binary").collect():
        windows.setdefault(r.lang, []).append(bytes(r.w))
    langs = sorted(windows)
    return {"langs": langs, "p": train(windows, langs) if windows else None}


def score(docs: DataFrame, fitted: dict) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""

    def make():
        langs = fitted["langs"]
        labeller = Labeller(fitted["p"], len(langs)) if langs else None

        def rows(ids, held, texts):
            return [ids, held, *predict(labeller, langs, texts)]

        return rows

    rows = docs.select(F.col("doc_id").cast("long"), (bucket_of(F.col("doc_id"), 3) == 1).alias("held_out"), "text")
    return map_batches(rows, make, "doc_id long, held_out boolean, lang_pred string, score double")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op3: the language of every text of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs))


def keep_identified(docs: DataFrame, *, min_score: float = 0.5, docs_per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """The documents whose language is told with min_score at least, all columns kept; no join is needed."""
    fitted = fit(docs, docs_per_language)
    at = docs.columns.index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def make():
        labeller = Labeller(fitted["p"], len(fitted["langs"])) if fitted["langs"] else None

        def rows(*columns):
            langs, scores = predict(labeller, fitted["langs"], columns[at])
            ok = [x != "und" and s >= min_score for x, s in zip(langs, scores)]
            return [[v for v, k in zip(c, ok) if k] for c in columns]

        return rows

    return map_batches(docs, make, schema)
