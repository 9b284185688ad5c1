"""LM scoring: a gated recurrent language model in numpy, with a class-factored softmax.

Tokens fall into classes: the ``HEAD`` most frequent tokens of all training texts in classes of 64 by frequency,
every other token in a class by its look (first letter, closing sign, letters of a language, digits, length), so
that an unseen token has a class too. The network reads a token (head tokens by themselves, others by
their class) and predicts the next one as P(class | state) * P(token | class, state) for head tokens and
P(class | state) * P(token | class) for the others; the latter is (c + 1) / (N_class + V_class + 1) from
the counts of all training texts. Windows of 32 tokens pass their state on, so a document is scored as
a whole from its first token to its end.

Training: truncated backpropagation on a bounded sample gives a start. Then all training texts are dealt
by hash to shards whose number follows their tokens; each shard trains its own copy on all its texts, in
hash order, and the copies are averaged by their tokens. How rows lie in partitions doesn't matter.

Scale: tokens are counted without a table of all tokens on any machine. Counts of the ``COMMON`` most
frequent ones come to the driver. One pass encodes the texts in blocks of about ``BLOCK_TOKENS``: network
inputs, sums over common tokens, and of the other tokens the hashes that a block holds, each once, with
its count, packed by hash range. A task adds a range's counts up over all blocks and answers each block
with them; a block's documents and its answers meet in one group, which is scored. So a token costs an
entry a block, however many documents hold it, a document needs no key, and no group is larger than a
block (and one document) or a range. What reaches the driver (counts by class, averaged weights, common
tokens) doesn't grow with the input.

Defined results: a null or empty text has one token, its end; repeated rows get equal results (up to
rounding); rows with the same doc_id are scored each by its own; with no training texts all counts are 0
and the model is the untrained one; an empty table gives an empty result; extra columns are ignored.
Tokens outside the common ones are told apart by 64-bit hashes.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import gru
from lattica.llm.common import Written, bucket_of, map_batches, small_batches, table

HEAD = 1024
CLASS = 64
HIDDEN = 16
EMBED = 16
WINDOW = 32
LANES = 128
COMMON = 131_072
SAMPLE_DOCS = 1_500
EPOCHS = 3
RANGE_CHARS = 40_000_000
BLOCK_TOKENS = 1_000_000
#: Shards of the training texts: SHARDS, fewer where they would hold less than LEAST_SHARD tokens, more where they would hold over MOST_SHARD.
SHARDS, LEAST_SHARD, MOST_SHARD = 32, 250_000, 16_000_000
CACHE = 600_000
PLACES = 1024
END = b"\n"
N_HEAD = HEAD // CLASS
#: Looks of tokens outside the head: 2 kinds of first letters, 2 closing signs, 5 kinds of letters, 2 lengths; and tokens with signs or digits inside.
LETTER_KINDS = (frozenset("äöüß"), frozenset("ñíóú¿¡"), frozenset("éèêàçùœâîô"))
N_LOOKS = 2 * 2 * 5 * 2 + 4
N_CLASSES = N_HEAD + N_LOOKS


def look(token: bytes) -> int:
    """The look of a token, 0..N_LOOKS-1."""
    word = token.decode("utf-8", "replace")
    body = word.rstrip(".,;:!?")
    closed = len(body) < len(word)
    if not body.isalpha():
        return N_LOOKS - 4 + (0 if not body else 1 if body.isdigit() else 2 if any(map(str.isdigit, body)) else 3)
    kind = 3 if body.isascii() else next((k for k, s in enumerate(LETTER_KINDS) if not s.isdisjoint(body)), 4)
    long = len(body) > 7
    first = body[0] in "etaoinsr"
    return ((first * 2 + closed) * 5 + kind) * 2 + long


def tokens(text: str | None) -> list[bytes]:
    """Words of the text with A-Z in lower case, then the end."""
    return [*(text or "").encode("utf-8", "replace").lower().split(), END]


def init(seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = gru.init(rng, EMBED, HIDDEN)
    return p | {
        "E": rng.normal(0, 1, (HEAD + N_LOOKS + 1, EMBED)).astype(np.float32),  # the last input is that before the first token
        "C": rng.normal(0, 0.1, (N_CLASSES, HIDDEN)).astype(np.float32), "c": np.zeros((N_CLASSES, 1), np.float32),
        "O": rng.normal(0, 0.1, (N_HEAD, CLASS, HIDDEN)).astype(np.float32), "o": np.zeros((N_HEAD, CLASS, 1), np.float32),
    }


#: The class of each id.
CLASS_OF = np.concatenate((np.arange(HEAD) // CLASS, np.arange(N_LOOKS) + N_HEAD, [-1])).astype(np.int16)  # the last is that of no target, -1


def window(p: dict[str, np.ndarray], w: np.ndarray, x: np.ndarray, y: np.ndarray, h0: np.ndarray, learn: bool):
    """x, y: (T, B) inputs and targets, y -1 where there is none; w: input projections by row.

    Returns the log probability of each target (of its class only outside the head), the last state,
    and with learn the gradients of the mean loss.
    """
    t, b = x.shape
    proj = np.empty((t, 3 * HIDDEN, b), np.float32)
    for out, row in zip(proj, x):
        out[:] = w.take(row, 0).T
    hs, kept = gru.forward(proj, h0, p["U"], learn)
    h = np.ascontiguousarray(hs.transpose(1, 0, 2)).reshape(HIDDEN, t * b)
    flat = y.reshape(-1)
    # Places by class, so that a head class is one run of columns; those without a target come first.
    cls = CLASS_OF[flat]
    order = np.argsort(cls, kind="stable")
    back = np.empty_like(order)
    back[order] = np.arange(t * b)
    skip = int(np.count_nonzero(flat < 0))
    real, cls = order[skip:], cls[order[skip:]]
    target, h_r, n = flat[real], h.take(real, 1), max(len(real), 1)
    bounds = np.searchsorted(cls, np.arange(N_HEAD + 1))
    # States lie within -1..1: sums of this size can't overflow.
    calm = max(np.abs(p["C"]).sum(-1).max() + np.abs(p["c"]).max(), np.abs(p["O"]).sum(-1).max() + np.abs(p["o"]).max()) < 60
    lp = np.zeros(t * b, np.float32)
    own = lp[skip:]
    g = {}
    if learn:
        dh_r = np.zeros((HIDDEN, t * b), np.float32)
        dh_own = dh_r[:, skip:]
        g = {k: np.zeros_like(p[k]) for k in "CcOo"}
    for a in range(0, len(real), PLACES):
        part = slice(a, a + PLACES)
        own[part], e = likelihood(p["C"], p["c"], h_r[:, part], cls[part], calm, learn and n)
        if learn:
            g["C"] += e @ h_r[:, part].T
            g["c"] += e.sum(1, keepdims=True)
            np.matmul(p["C"].T, e, out=dh_own[:, part])
    for k in np.flatnonzero(np.diff(bounds)).tolist():
        part = slice(bounds[k], bounds[k + 1])
        more, e = likelihood(p["O"][k], p["o"][k], h_r[:, part], target[part] - k * CLASS, calm, learn and n)
        own[part] += more
        if learn:
            g["O"][k], g["o"][k] = e @ h_r[:, part].T, e.sum(1, keepdims=True)
            dh_own[:, part] += p["O"][k].T @ e
    if learn:
        dh = dh_r.take(back, 1).reshape(HIDDEN, t, b)
        dx, g["U"] = gru.backward(np.ascontiguousarray(dh.transpose(1, 0, 2)), p["U"], kept)
        embedded = p["E"].T.take(x, 1).transpose(1, 2, 0)  # (T, B, EMBED)
        g["W"], g["b"] = np.matmul(dx, embedded).sum(0), dx.sum((0, 2))[:, None]
        g["E"] = gru.input_gradient(np.matmul(p["W"].T, dx), x, len(p["E"])).T
    return lp.take(back).reshape(t, b), hs[-1], g


def likelihood(m: np.ndarray, bias: np.ndarray, h: np.ndarray, target: np.ndarray, calm: bool, n: int) -> tuple[np.ndarray, np.ndarray | None]:
    """The log softmax of m h + bias at each column's target; with n the gradient of its negative's mean over n, by m h + bias."""
    e = m @ h
    e += bias
    if not calm:
        e -= e.max(0)
    at = target.astype(np.int64) * h.shape[1] + np.arange(h.shape[1])
    picked = e.ravel()[at]
    np.exp(e, out=e)
    total = e.sum(0)
    if n:
        e *= 1 / (total * np.float32(n))
        e.ravel()[at] -= np.float32(1 / n)
    return picked - np.log(total), e if n else None


def lanes(docs: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents laid end to end in n lanes of about equal length: inputs, targets, and each place's document (T, n)."""
    heads = [0] * n
    rows: list[list[int]] = [[] for _ in range(n)]
    if len(docs) <= n:
        for k in range(len(docs)):
            rows[k].append(k)
            heads[k] = len(docs[k])
    else:
        heap = [(0, k) for k in range(n)]
        for d in sorted(range(len(docs)), key=lambda d: -len(docs[d])):
            size, k = heapq.heappop(heap)
            rows[k].append(d)
            heads[k] = size + len(docs[d])
            heapq.heappush(heap, (heads[k], k))
    t = -(-max(heads) // WINDOW) * WINDOW
    x = np.full((n, t), HEAD + N_LOOKS, np.int32)
    y, owner = np.full((n, t), -1, np.int32), np.full((n, t), -1, np.int32)
    for k, ds in enumerate(rows):
        if ds:
            whole = np.concatenate([docs[d] for d in ds])
            y[k, : len(whole)] = whole
            x[k, 1 : len(whole)] = whole[:-1]
            at = 0
            for d in ds:
                x[k, at] = HEAD + N_LOOKS
                owner[k, at : at + len(docs[d])] = d
                at += len(docs[d])
    return np.ascontiguousarray(x.T), np.ascontiguousarray(y.T), np.ascontiguousarray(owner.T)


def run(p: dict[str, np.ndarray], docs: list[np.ndarray], opt: gru.Adam | None = None, n_lanes: int = LANES) -> np.ndarray:
    """Log probability (natural, class only outside the head) of each document; with opt it learns from each window."""
    out = np.zeros(len(docs))
    if not docs:
        return out
    x, y, owner = lanes(docs, min(n_lanes, len(docs)))
    h = np.zeros((HIDDEN, x.shape[1]), np.float32)
    w = None
    for at in range(0, len(x), WINDOW):
        part = slice(at, at + WINDOW)
        live = np.flatnonzero((y[part] >= 0).any(0))
        if w is None or opt is not None:
            w = inputs(p)
        lp, state, g = window(p, w, x[part][:, live], y[part][:, live], h[:, live], opt is not None)
        h[:, live] = state
        who = owner[part][:, live].reshape(-1)
        seen = who >= 0
        out += np.bincount(who[seen], lp.reshape(-1)[seen], len(docs))
        if opt is not None:
            opt.step(g)
    return out


def inputs(p: dict[str, np.ndarray]) -> np.ndarray:
    """Input projections by row. The start symbol shuts the gates: it sets the state anew, so that nothing passes from one document to the next."""
    w = p["E"] @ p["W"].T + p["b"].T
    w[HEAD + N_LOOKS, : 2 * HIDDEN] = SHUT
    return w


SHUT = np.float32(-30.0)


def pack(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].reshape(-1) for k in sorted(p)]).astype(np.float32)


def unpack(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def averaged(parts: DataFrame, fan_in: int = 8) -> np.ndarray | None:
    """The mean of packed weights by tokens, from rows (part, weights, n), at most fan_in of them in a task."""

    def merge(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        n = t.column("n").to_numpy()
        total = np.zeros(0)
        for w, k in zip(t.column("weights"), n):
            x = np.frombuffer(w.as_buffer(), np.float32) * (k / n.sum())
            total = x if not total.size else total + x
        return pa.table({"part": t.column("part")[:1], "weights": pa.array([total.astype(np.float32).tobytes()], pa.binary()), "n": pa.array([int(n.sum())], pa.int64())})

    schema = "part long, weights binary, n long"
    held = Written(parts, "weights")
    while (rows := held.read().count()) > fan_in:
        groups = -(-rows // fan_in)
        after = Written(held.read().groupBy(F.pmod("part", F.lit(groups))).applyInArrow(merge, schema), "weights")
        held.drop()
        held = after
    found = sorted(held.read().collect(), key=lambda r: r.part)
    held.drop()
    total = sum(r.n for r in found)
    return sum(np.frombuffer(r.weights, np.float32) * (r.n / total) for r in found) if total else None


def common_tokens(train: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """The most frequent tokens of all training texts, and their counts."""

    def make_counts():
        def count(texts):
            c = Counter()
            for t in texts:
                c.update(tokens(t))
            return [list(c), list(c.values())]

        return count

    counts = map_batches(train.select("text"), make_counts, "t binary, n long").groupBy("t").agg(F.sum("n").alias("n"))
    held = Written(counts, "tokens")
    # The count that COMMON tokens at most reach, from a histogram by three digits of the count.
    digits = F.pow(F.lit(10.0), F.greatest(F.length(F.col("n").cast("string")) - 3, F.lit(0)))
    bins = held.read().groupBy((F.floor(F.col("n") / digits) * digits).cast("long").alias("least")).agg(F.count("*").alias("tokens")).collect()
    least, room = None, COMMON
    for r in sorted(bins, key=lambda r: -r.least):
        room -= r.tokens
        if room < 0:
            break
        least = r.least
    found = [] if least is None else sorted(held.read().filter(F.col("n") >= least).collect(), key=lambda r: (-r.n, bytes(r.t)))
    held.drop()
    return [bytes(r.t) for r in found], np.array([r.n for r in found], np.int64)


class Places(dict):
    """Token to its place: common tokens first, then the others of a block as they come."""

    def __missing__(self, t: bytes) -> int:
        self[t] = i = len(self)
        return i


def planes(x: np.ndarray) -> bytes:
    """The bytes of numbers, all first ones first: those of sorted or small numbers compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def from_planes(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


ENCODED = "block long, i int, range int, entries binary, doc_id long, held_out boolean, n_tokens long, known long, base double, tail double, ids binary, rare binary"


def encoded(rows: DataFrame, common: list[bytes], counts: np.ndarray, n_ranges: int) -> DataFrame:
    """Two kinds of rows: of each document (block, i, doc_id, held_out, n_tokens, sums over common tokens, ids, rare), of each block and hash range (block, range, entries).

    ids: network inputs; rare: places of its tokens outside the common ones among the block's sorted hashes;
    entries: of these hashes the ones of a range, each with its count in training texts and its look.
    """
    heads = np.array([HEAD + look(t) if i >= HEAD else i for i, t in enumerate(common)], np.int16)
    arrow = [("block", pa.int64()), ("i", pa.int32()), ("range", pa.int32()), ("entries", pa.binary()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("tail", pa.float64()), ("ids", pa.binary()), ("rare", pa.binary())]

    def run_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_common, places = len(common), Places(zip(common, range(len(common))))
        logs, looks = np.log10(counts + 1), {}
        meta: list[tuple] = []
        docs: list[np.ndarray] = []
        first = TaskContext.get().partitionId() << 32
        block = size = 0

        def look_of(t: bytes) -> int:
            k = looks.get(t)
            if k is None:
                k = look(t)
                if len(looks) < CACHE:
                    looks[t] = k
            return k

        def flush() -> pa.RecordBatch:
            rare = list(places)[n_common:]
            for t in rare:
                del places[t]
            kinds = np.array([look_of(t) for t in rare], np.uint8)
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, rare), np.uint64, len(rare))
            hashes, place = np.unique(hashes, return_inverse=True)
            kind = np.zeros(len(hashes), np.uint8)
            kind[place] = kinds
            ids_of = np.concatenate((heads, kinds.astype(np.int16) + np.int16(HEAD)))
            x, sizes = np.concatenate(docs), np.array([len(d) for d in docs])
            at = np.cumsum(sizes) - sizes  # every document has a token, its end
            is_rare = x >= n_common
            c = np.append(logs, 0.0)[np.minimum(x, n_common)]
            base, known = np.add.reduceat(c, at), np.add.reduceat((~is_rare).astype(np.int64), at)
            c[x < HEAD] = 0
            tail = np.add.reduceat(c, at)
            rare_at = place[x[is_rare] - n_common].astype(np.uint32)
            train = np.repeat(np.array([not m[1] for m in meta]), sizes)[is_rare]
            n = np.bincount(rare_at[train], minlength=len(hashes)).astype(np.uint32)
            ends = np.cumsum(np.add.reduceat(is_rare.astype(np.int64), at))
            ids = ids_of[x]
            r = (hashes >> np.uint64(32)).astype(np.int64) * n_ranges >> 32
            cuts = np.flatnonzero(np.diff(r, prepend=-1))
            blobs = [zstandard.compress(planes(hashes[a:b]) + planes(n[a:b]) + kind[a:b].tobytes(), 1) for a, b in zip(cuts, [*cuts[1:], len(r)])]
            k, m = len(docs), len(blobs)
            out = {
                "block": [first + block] * (k + m), "i": [*range(k), *[None] * m], "range": [*[None] * k, *r[cuts].tolist()], "entries": [*[None] * k, *blobs],
                "doc_id": [*[x[0] for x in meta], *[None] * m], "held_out": [*[x[1] for x in meta], *[None] * m], "n_tokens": [*sizes.tolist(), *[None] * m],
                "known": [*known.tolist(), *[None] * m], "base": [*base.tolist(), *[None] * m], "tail": [*tail.tolist(), *[None] * m],
                "ids": [*[ids[a : a + n].tobytes() for a, n in zip(at, sizes)], *[None] * m], "rare": [*[rare_at[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends)], *[None] * m],
            }
            docs.clear()
            meta.clear()
            return pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in arrow], names=[c for c, _ in arrow])

        for b in batches:
            for doc_id, held_out, text in zip(*(c.to_pylist() for c in b.columns)):
                words = tokens(text)
                docs.append(np.fromiter(map(places.__getitem__, words), np.int64, len(words)))
                meta.append((doc_id, held_out))
                size += len(words)
                if size >= BLOCK_TOKENS:
                    yield flush()
                    block, size = block + 1, 0
        if docs:
            yield flush()

    return rows.mapInArrow(run_pass, ENCODED)


def training_texts(held: DataFrame) -> DataFrame:
    """h and ids of the training documents in an encoded table; h: the hash of a document."""
    return held.filter("i is not null and not held_out").select(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "ids").alias("h"), "ids", "n_tokens")


def trained(held: DataFrame, sample_docs: int) -> dict[str, np.ndarray]:
    """A start learned from a bounded sample; then weights averaged over the shards' training on all texts."""
    train = training_texts(held)
    chosen = train.select("h").distinct().orderBy("h").limit(sample_docs)
    sample = train.join(F.broadcast(chosen), "h").groupBy("h").agg(F.min("ids").alias("ids")).collect()
    docs = [np.frombuffer(r.ids, np.int16) for r in sorted(sample, key=lambda r: r.h)]
    p = init()
    rng = np.random.default_rng(1)
    for epoch in range(EPOCHS):
        opt = gru.Adam(p, 0.01 / (1 + 2 * epoch))
        run(p, [docs[i] for i in rng.permutation(len(docs))], opt, 64)

    def tune(t: pa.Table) -> pa.Table:
        own, t = {k: v.copy() for k, v in p.items()}, t.sort_by([("h", "ascending"), ("ids", "ascending")])
        opt, part, size, n = gru.Adam(own, 0.002), [], 0, 0
        for x in t.column("ids"):
            part.append(np.frombuffer(x.as_buffer(), np.int16))
            size += len(part[-1])
            if size > BLOCK_TOKENS:
                run(own, part, opt)
                part, n, size = [], n + size, 0
        run(own, part, opt)
        return pa.table({"part": t.column("shard")[:1].cast(pa.int64()), "weights": pa.array([pack(own).tobytes()], pa.binary()), "n": pa.array([n + size], pa.int64())})

    total = train.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    shards = max(1, min(SHARDS, total // LEAST_SHARD), total // MOST_SHARD)
    parts = train.select("h", "ids", F.pmod("h", F.lit(shards)).alias("shard")).groupBy("shard").applyInArrow(tune, "part long, weights binary, n long")
    mean = averaged(parts)
    return p if mean is None else unpack(mean, p)


def fit(train: DataFrame, common: list[bytes], sample_docs: int = SAMPLE_DOCS) -> dict[str, np.ndarray]:
    """The network learned from training texts (doc_id, text)."""
    small_batches(train.sparkSession)
    held = Written(encoded(train.select(F.col("doc_id").cast("long"), F.lit(False), "text"), common, np.zeros(len(common)), 16), "encoded")
    p = trained(held.read(), sample_docs)
    held.drop()
    return p


ANSWERS = "block long, range int, counts binary, look int, n long, v long"


def answers(t: pa.Table) -> pa.Table:
    """A range's hashes counted over all blocks: for each block the counts of its own, and rows (look, N, V)."""
    raw = [zstandard.decompress(x) for x in t.column("entries").to_pylist()]
    sizes = np.array([len(x) // 13 for x in raw])
    hashes = np.concatenate([from_planes(x[: 8 * n], "<u8") for x, n in zip(raw, sizes)])
    n = np.concatenate([from_planes(x[8 * n : 12 * n], "<u4") for x, n in zip(raw, sizes)])
    looks = np.concatenate([np.frombuffer(x, np.uint8, n, 12 * n) for x, n in zip(raw, sizes)])
    _, first, token = np.unique(hashes, return_index=True, return_inverse=True)
    c = np.bincount(token, n, len(first)).astype(np.int64)
    parts = [zstandard.compress(planes(x.astype("<u8")), 1) for x in np.split(c[token], np.cumsum(sizes)[:-1])]
    kind = looks[first]
    big_n, big_v = np.bincount(kind, c, N_LOOKS).astype(np.int64), np.bincount(kind, c > 0, N_LOOKS).astype(np.int64)
    k, m = t.num_rows, N_LOOKS
    return pa.table({
        "block": pa.array([*t.column("block").to_pylist(), *[None] * m], pa.int64()), "range": pa.array([*t.column("range").to_pylist(), *[None] * m], pa.int32()), "counts": pa.array([*parts, *[None] * m], pa.binary()),
        "look": pa.array([*[None] * k, *range(m)], pa.int32()), "n": pa.array([*[0] * k, *big_n.tolist()], pa.int64()), "v": pa.array([*[0] * k, *big_v.tolist()], pa.int64()),
    })


def block_scores(p: dict[str, np.ndarray], looks: np.ndarray, total_n: int, total_v: int) -> Callable[[pa.Table], pa.Table]:
    """Scores a block: its documents (rows with i) and the counts of its rare tokens. looks: log10 of each look's N + V + 1."""
    norm = float(np.log10(total_n + total_v + 1))

    def score(t: pa.Table) -> pa.Table:
        some = pa.compute.is_valid(t.column("i"))
        docs, found = t.filter(some), t.filter(pa.compute.invert(some)).sort_by("range")
        c = np.concatenate([np.zeros(0, np.uint64), *[from_planes(zstandard.decompress(x), "<u8") for x in found.column("counts").to_pylist()]])
        logs, seen = np.log10(c + 1.0), (c > 0).astype(np.int64)
        # Copies in a block are run once.
        copies: dict[bytes, int] = {}
        copy_of = [copies.setdefault(x, len(copies)) for x in docs.column("ids").to_pylist()]
        texts = [np.frombuffer(x, np.int16) for x in copies]
        model = np.round(run(p, texts) / np.log(10), 3)[copy_of]  # sums in another block differ in the sixth digit
        ids = [texts[k] for k in copy_of]
        by_look = np.concatenate((np.zeros(HEAD), looks))
        s, k = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
        for d, (x, y) in enumerate(zip(ids, docs.column("rare"))):
            model[d] -= by_look[x].sum()
            at = np.frombuffer(y.as_buffer(), np.uint32)
            if len(at):
                s[d], k[d] = logs[at].sum(), seen[at].sum()
        n = docs.column("n_tokens").to_numpy()
        return pa.table({
            "doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": docs.column("n_tokens"), "n_known": pa.array(docs.column("known").to_numpy() + k),
            "train_tokens": pa.array(np.full(len(ids), total_n, np.int64)), "base_score": pa.array(docs.column("base").to_numpy() + s - n * norm), "score": pa.array(docs.column("tail").to_numpy() + s + model),
        })

    return score


def lm_scores(docs: DataFrame, *, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (bucket_of(F.col("doc_id"), 7) == 2).alias("held_out"), "text")
    common, counts = common_tokens(rows.filter("not held_out"))
    chars = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    held = Written(encoded(rows, common, counts, max(16, chars // RANGE_CHARS)), "encoded").read()
    p = trained(held, sample_docs)
    entries = held.filter("entries is not null").select("block", "range", "entries")
    found = Written(entries.groupBy("range").applyInArrow(answers, ANSWERS), "answers").read()
    big_n, big_v = np.zeros(N_LOOKS), np.zeros(N_LOOKS)
    for r in found.filter("look is not null").groupBy("look").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        big_n[r.look], big_v[r.look] = r.n, r.v
    total_n, total_v = int(counts.sum() + big_n.sum()), int(len(counts) + big_v.sum())
    for t, c in zip(common[HEAD:], counts[HEAD:]):
        big_n[look(t)] += c
        big_v[look(t)] += 1
    columns = ["block", "i", "range", "doc_id", "held_out", "n_tokens", "known", "base", "tail", "ids", "rare"]
    both = held.filter("i is not null").select(*columns).unionByName(found.filter("counts is not null").select("block", "range", "counts"), allowMissingColumns=True)
    score = block_scores(p, np.log10(big_n + big_v + 1), total_n, total_v)
    return both.groupBy("block").applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op2: the log probability of every text of ``documents``."""
    return lm_scores(table(spark, sf_dir, "documents"))
