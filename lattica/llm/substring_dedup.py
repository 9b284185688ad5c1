"""Exact substring dedup by prefix-free parsing of the texts' bytes.

A hash rolled over 16 bytes sets triggers that cut each text into phrases, at the same places wherever
the same bytes stand. A 400-byte window begins with a suffix of a phrase, the bytes up to its first
trigger, and goes on with the parse, the phrases from that trigger on. Corpus order, the order of all
windows by their bytes, comes from two suffix arrays: that of the dictionary (all suffixes of the
distinct phrases) and that of the parse (its suffixes by what follows a trigger); windows are ordered by
the rank of their phrase suffix, then by the rank of the parse that follows. A window repeats if its
longest common prefix with a neighbour in that order, read off the parse's LCP array by range minima, has
400 bytes.

Only equality at a depth of 400 bytes matters, so the order is made in shards that no pair of equal
windows straddles, and only of what can repeat:

1. A unit is the run of windows that share a first trigger (and a range of distances to it). The bytes
   that all of them hold, its context, are hashed; only units whose hash occurs twice go on.
2. The units of a range of contexts meet as a shard: context as a 128-bit hash, the bytes before it (the
   phrase's end) and those behind it. Units that are the same as a whole repeat as a whole; of the others
   one each goes into the shard's dictionary and parse, whose suffix arrays give the repeated windows.

Windows without a trigger (long runs of low variety) are phrases longer than a window: units of their own,
compared as a whole.

Passages of over 50 words that documents share may be shorter than 400 bytes. They aren't removed but
counted: of any 22 words in a row the one with the least hash is the trigger of a block of 30 words, so
that every 51 words hold a whole block, the same wherever the same bytes stand. Block hashes go through
step 1 with the units; ``n_shared_blocks`` counts a text's distinct blocks that another row holds too. It is
above 0 for every text that shares 51 words (and the white space between them) with another row, 0 for
one that shares fewer than 30 in a row.

Scale: what is shuffled is packed, about one entry for 40 bytes in step 1, and only parts that can repeat
after it. Entries that are alike within a task are settled there and one is sent on for them, so that a
passage in a third of all texts sends one entry a task. No task holds more than its blocks or its shard,
and no pairs are formed. Texts are joined with their own places by keys of 128 bits. Each step's shuffle files
go as soon as its result is written.

Defined results: a null text is an empty one; texts below 400 bytes lose nothing; rows that repeat a
text are copies of each other, whatever their doc_id; an empty table gives an empty result; extra
columns are ignored. Equality of contexts and of whole units is that of 128-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import Written, shuffles_released, small_batches, table

LENGTH = 400
TRIGGER = 16
PHRASE = 48
RANGE_CHARS = 10_000_000
FLUSH = 400_000
#: Ranges of the distance of a window's start to its first trigger; a unit's context is what all windows of the range hold.
DISTANCES = ((0, 63), (64, 127), (128, 199), (200, LENGTH - TRIGGER))
BEFORE = 200
LONE = len(DISTANCES)
#: A passage of PASSAGE words holds a whole block of BLOCK words, which begins at one of PICK words.
PASSAGE, BLOCK = 51, 30
PICK = PASSAGE - BLOCK + 1
SHARED = LONE + 1

KEY = [("k1", "<i8"), ("k2", "<i8")]
SPOT = [("a", "<i4"), ("lo", "<i4"), ("hi", "<i4"), ("kind", "u1")]
UNIT = np.dtype([("hash", "<u8"), *KEY, *SPOT, ("how", "u1")])
CLASSED = np.dtype([("hash", "<u8"), ("more", "<u8"), ("c1", "<u8"), ("c2", "<u8"), *KEY, *SPOT, ("how", "u1")])
KEYED = np.dtype([*KEY, *SPOT])
PLACE = np.dtype(SPOT)
#: how: an entry to be compared; one that stands for several of its task, itself settled; one that is settled.
PLAIN, SEVERAL, SETTLED = 0, 1, 2


def triggers(data: bytes) -> np.ndarray:
    """Places whose 16 bytes are a trigger: the last 8 hash below the limit that makes phrases of PHRASE bytes on average, and aren't a repeat at a distance of 8 or less (runs)."""
    n = len(data) - 7
    if n <= 8:
        return np.zeros(0, np.int64)
    word = np.empty(n, np.uint64)
    for k in range(min(8, n)):
        m = (len(data) - k) // 8
        word[k::8] = np.frombuffer(data, "<u8", m, k)
    v = word ^ (word >> np.uint64(29))
    v *= np.uint64(0x9E3779B97F4A7C15)
    v ^= v >> np.uint64(32)
    v *= np.uint64(0xD6E8FEB86659FD93)
    t = np.flatnonzero(v < np.uint64((1 << 64) // PHRASE))
    t = t[t >= 8]
    for d in range(1, 9):
        t = t[word[t] != word[t - d]]
    return t - 8


def units(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows (a, lo, hi, kind) of texts that lie end to end: each window's start is in one [lo, hi]."""
    t = triggers(data)
    doc = np.searchsorted(starts, t, "right") - 1
    ok = t + TRIGGER <= ends[doc] if len(t) else np.zeros(0, bool)
    t, doc = t[ok], doc[ok]
    first = np.diff(doc, prepend=-1) > 0
    before = np.where(first, starts[doc] - 1, np.concatenate(([0], t[:-1]))) if len(t) else t
    last = ends - LENGTH  # of window starts
    out = []
    for kind, (near, far) in enumerate(DISTANCES):
        lo = np.maximum(np.maximum(before + 1, t - (LENGTH - TRIGGER)), t - far)
        hi = np.minimum(np.minimum(t, last[doc]), t - near)
        k = lo <= hi
        out.append(np.stack((t[k], lo[k], hi[k], np.full(k.sum(), kind)), axis=1))
    # Windows without a trigger: up to LENGTH - TRIGGER before the next, or behind the last one.
    behind = starts - 1
    if len(t):
        final = np.flatnonzero(np.diff(doc, append=-1) != 0)
        behind = behind.copy()
        behind[doc[final]] = t[final]
    lo = np.concatenate((before + 1, behind + 1))
    hi = np.concatenate((np.minimum(t - (LENGTH - TRIGGER) - 1, last[doc]), last))
    n = np.maximum(hi - lo + 1, 0)
    s = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    out.append(np.stack((s, s, s, np.full(len(s), LONE)), axis=1))
    x = np.concatenate(out)
    return x[np.argsort(x[:, 1], kind="stable")]


def shared_blocks(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, begin and end of the blocks of texts that lie end to end."""
    raw = np.frombuffer(data, np.uint8)
    inside = (raw != 32) & ((raw < 9) | (raw > 13))
    cut = np.zeros(len(raw) + 1, bool)  # a text begins here
    cut[starts] = cut[ends] = True
    begin = np.flatnonzero(inside & (cut[:-1] | ~np.concatenate(([False], inside[:-1]))))
    end = np.flatnonzero(inside & (cut[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    n = len(begin) - PASSAGE + 1  # passages
    doc = np.searchsorted(starts, begin, "right") - 1
    whole = doc[: max(n, 0)] == doc[PASSAGE - 1 :]
    if not whole.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    # A word's hash is that of 8 bytes at its own begin and at those of three more words of its block.
    padded, first = np.concatenate((raw, np.zeros(8, np.uint8))), np.zeros(len(begin), np.uint64)
    for k in range(8):
        first |= padded[begin + k].astype(np.uint64) << np.uint64(8 * k)
    v = np.zeros(n + PICK - 1, np.uint64)
    for k in (0, 1, 3, 7):
        v = (v ^ first[k : k + len(v)]) * np.uint64(0x9E3779B97F4A7C15)
        v ^= v >> np.uint64(29)
    # The least of PICK in a row, of equal ones the first.
    v = v >> np.uint64(32) << np.uint64(32) | np.arange(len(v), dtype=np.uint64)
    least, k = v, 1
    while 2 * k <= PICK:
        least, k = np.minimum(least[:-k], least[k:]), 2 * k
    least = np.minimum(least[:n], least[PICK - k : PICK - k + n])
    at = np.unique(least[whole] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return doc[at], begin[at], end[at + BLOCK - 1]


def context_of(a: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a unit's context begins and ends."""
    begin = a - np.where(kind == LONE - 1, BEFORE, 0)
    size = np.array([LENGTH - DISTANCES[0][1], LENGTH - DISTANCES[1][1], LENGTH - DISTANCES[2][1], TRIGGER, LENGTH])
    return begin, a + size[kind]


def hash64(view: memoryview, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(view[a:b]) for a, b in zip(begin.tolist(), end.tolist())), np.uint64, len(begin))


def hash128(view: memoryview, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    h = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([h(view[a:b]) for a, b in zip(begin.tolist(), end.tolist())]), "<u8").reshape(-1, 2)


def alike(*fields: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first of each group of equal rows, each row's group, and the groups' sizes."""
    order = np.lexsort(fields)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for f in fields:
        x = f[order]
        new[1:] |= x[1:] != x[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return order[new], group, np.bincount(group) if len(order) else np.zeros(0, np.int64)


def settle(e: np.ndarray, fields: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of a task's entries, those that are alike are settled and one more is sent to stand for them; with the place each came from."""
    first, same, count = alike(*(e[f] for f in fields))
    more = first[count > 1]
    at = np.concatenate((np.arange(len(e)), more))
    out = e[at]
    out["how"][: len(e)] = np.where(count[same] > 1, SETTLED, PLAIN)
    out["how"][len(e) :] = SEVERAL
    return out, at


def squeeze(e: np.ndarray, strings: list[bytes]) -> bytes:
    """Entries field by field, places as distances, and their strings, compressed."""
    x = {f: e[f] for f in e.dtype.names}
    x["lo"], x["hi"], x["a"] = x["a"] - x["lo"], x["a"] - x["hi"], np.diff(x["a"], prepend=np.int32(0))
    return len(e).to_bytes(4, "little") + zstandard.compress(b"".join([*(np.ascontiguousarray(x[f]).tobytes() for f in e.dtype.names), *strings]), 1)


def loosen(b: bytes, kind: np.dtype) -> tuple[np.ndarray, bytes]:
    raw = zstandard.decompress(b[4:])
    out, at = np.empty(int.from_bytes(b[:4], "little"), kind), 0
    for f in kind.names:
        size = len(out) * kind[f].itemsize
        out[f] = np.frombuffer(raw[at : at + size], kind[f])
        at += size
    out["a"] = np.cumsum(out["a"], dtype=np.int32)
    out["lo"], out["hi"] = out["a"] - out["lo"], out["a"] - out["hi"]
    return out, raw[at:]


def split_by_range(e: np.ndarray, h: np.ndarray, n_ranges: int, strings: list[bytes] | None = None) -> tuple[np.ndarray, list[bytes]]:
    """The ranges of the 64-bit values h, and each one's entries packed."""
    r = ((h >> np.uint64(32)).astype(np.int64) * n_ranges) >> 32
    order = np.argsort(r, kind="stable")
    e, r = e[order], r[order]
    first = np.flatnonzero(np.diff(r, prepend=-1))
    held = [strings[i] for i in order.tolist()] if strings else []
    return r[first], [squeeze(e[a:b], held[a:b]) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(e)])]


def blocks_of(e: np.ndarray, strings: list[bytes], fields: list[str], n_ranges: int) -> pa.RecordBatch:
    """Packed by range of the hash, settled entries (without strings) by range of the key."""
    e, at = settle(e, fields)
    settled = e["how"] == SETTLED
    held = [b"" if k else strings[i] for i, k in zip(at.tolist(), settled.tolist())] if strings else None
    r, parts = split_by_range(e, np.where(settled, e["k1"].view(np.uint64), e["hash"]), n_ranges, held)
    return pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(parts, pa.binary())], names=["range", "entries"])


def packed_pass(df: DataFrame, entries: Callable[..., tuple[np.ndarray, list[bytes]]], fields: list[str], n_ranges: int) -> DataFrame:
    """Runs ``entries(k1, k2, texts, places)`` over batches and packs the entries and strings it returns by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, strings, n = [], [], 0
        for b in batches:
            e, more = entries(*(c.to_pylist() for c in b.columns))
            held.append(e)
            strings += more
            n += len(e)
            if n > FLUSH:
                yield blocks_of(np.concatenate(held), strings, fields, n_ranges)
                held, strings, n = [], [], 0
        if n:
            yield blocks_of(np.concatenate(held), strings, fields, n_ranges)

    return df.mapInArrow(run, "range int, entries binary")


def unpack(t: pa.Table, kind: np.dtype) -> tuple[np.ndarray, bytes]:
    parts = [loosen(x, kind) for x in t.column("entries").to_pylist()]
    return np.concatenate([e for e, _ in parts]), b"".join(x for _, x in parts)


def by_key(e: np.ndarray, n_ranges: int) -> pa.Table:
    """Rows (range, entries): the places of texts, packed by range of the key."""
    out = np.empty(len(e), KEYED)
    for f in KEYED.names:
        out[f] = e[f]
    r, parts = split_by_range(out, np.ascontiguousarray(out["k1"]).view(np.uint64), n_ranges)
    return pa.table({"range": pa.array(r, pa.int32()), "entries": pa.array(parts, pa.binary())})


def gather(t: pa.Table) -> pa.Table:
    """A row (k1, k2, places) for each text of a range of keys."""
    e, _ = unpack(t, KEYED)
    e = e[np.lexsort((e["hi"], e["lo"], e["kind"], e["a"], e["k2"], e["k1"]))]
    new = np.ones(len(e), bool)
    same = np.ones(max(len(e) - 1, 0), bool)
    for f in KEYED.names:
        same &= e[f][1:] == e[f][:-1]
    new[1:] = ~same
    e = e[new]  # rows that repeat id and text have the same places
    first = np.flatnonzero(np.concatenate((np.ones(min(len(e), 1), bool), (e["k1"][1:] != e["k1"][:-1]) | (e["k2"][1:] != e["k2"][:-1]))))
    places = np.empty(len(e), PLACE)
    for f in PLACE.names:
        places[f] = e[f]
    parts = [x.tobytes() for x in np.split(places, first[1:])] if len(e) else []
    return pa.table({"k1": pa.array(e["k1"][first], pa.int64()), "k2": pa.array(e["k2"][first], pa.int64()), "places": pa.array(parts, pa.binary())})


PLACES = "range int, entries binary"


def repeated_units(t: pa.Table, n_ranges: int) -> pa.Table:
    """Step 1: the units and blocks of a range whose hash occurs twice."""
    e, _ = unpack(t, UNIT)
    settled, e = e[e["how"] == SETTLED], e[e["how"] != SETTLED]
    _, same, _ = alike(e["hash"])
    n = np.bincount(same, 1 + (e["how"] == SEVERAL))
    e = np.concatenate((settled, e[(n[same] > 1) & (e["how"] == PLAIN)]))
    parts = [by_key(e[(e["kind"] == SHARED) == k], n_ranges) for k in (False, True)]
    return pa.concat_tables([x.append_column("shared", pa.array([k > 0] * len(x), pa.bool_())) for k, x in enumerate(parts)])


def dictionary_ranks(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The suffix array of a dictionary as ranks: of the phrases laid end to end in text (ends: each place's phrase's end), the rank of every suffix; equal suffixes share one."""
    n = len(text)
    left = ends - np.arange(n)
    word = np.zeros(n, np.uint64)
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    for k in range(8):
        word |= np.where(left > k, padded[k : k + n], 0).astype(np.uint64) << np.uint64(56 - 8 * k)
    _, rank, _ = alike(np.minimum(left, 8), word)
    depth = 8
    while n and depth < left.max():
        next_rank = np.where(left > depth, rank[np.minimum(np.arange(n) + depth, n - 1)] + 1, 0)
        _, rank, _ = alike(next_rank, rank)
        depth *= 2
    return rank


def parse_order(context: np.ndarray, tails: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of the parse: its suffixes (a context, then the bytes of a row of tails) in order, and the common bytes of their tails with the one before (-1 where the contexts differ)."""
    words = tails.view(">u8")
    order = np.lexsort((*(words[:, k] for k in range(words.shape[1] - 1, -1, -1)), context))
    a, b = tails[order[1:]], tails[order[:-1]]
    differ = a != b
    common = np.where(differ.any(1), differ.argmax(1), tails.shape[1])
    common = np.minimum(common, np.minimum(sizes[order[1:]], sizes[order[:-1]]))
    lcp = np.where(context[order[1:]] == context[order[:-1]], common, -1)
    return order, np.concatenate((np.full(min(len(order), 1), -1), lcp))


def range_minima(x: np.ndarray) -> list[np.ndarray]:
    """Minima of all runs of 1, 2, 4... values."""
    out, k = [x], 1
    while 2 * k <= len(x):
        out.append(np.minimum(out[-1][:-k], out[-1][k:]))
        k *= 2
    return out


def minimum(table: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each run a..b (b included)."""
    level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
    out = np.empty(len(a), np.int64)
    for k in np.unique(level).tolist():
        at = level == k
        out[at] = np.minimum(table[k][a[at]], table[k][b[at] - (1 << k) + 1])
    return out


def repeated_windows(e: np.ndarray, strings: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of units that differ as a whole, the windows that repeat, as (unit, start), by corpus order.

    strings, starts: each unit's bytes before its context and behind it, laid end to end.
    """
    a, kind = e["a"].astype(np.int64), e["kind"].astype(np.int64)
    begin, end = context_of(a, kind)
    lo, hi = e["lo"].astype(np.int64), e["hi"].astype(np.int64)
    before, behind = begin - lo, hi + LENGTH - end
    _, context, _ = alike(e["more"], e["hash"])
    # The parse: what follows each unit's phrase.
    wide = -(-max(int(behind.max()), 1) // 8) * 8
    tails = np.zeros((len(e), wide), np.uint8)
    row = np.repeat(np.arange(len(e)), behind)
    col = np.arange(len(row)) - np.repeat(np.cumsum(behind) - behind, behind)
    tails[row, col] = strings[np.repeat(starts + before, behind) + col]
    order, lcp = parse_order(context, tails, behind)
    rank = np.empty(len(e), np.int64)
    rank[order] = np.arange(len(e))
    # The dictionary: the distinct ends of phrases before a context.
    heads = [strings[s : s + n].tobytes() for s, n in zip(starts.tolist(), before.tolist())]
    phrases = {h: 0 for h in heads}
    sizes = np.array([len(h) for h in phrases])
    at = np.cumsum(sizes) - sizes
    phrases = dict(zip(phrases, at.tolist()))
    suffix = dictionary_ranks(np.frombuffer(b"".join(phrases), np.uint8), np.repeat(at + sizes, sizes))
    # Windows in corpus order.
    n = hi - lo + 1
    unit = np.repeat(np.arange(len(e)), n)
    start = np.arange(len(unit)) - np.repeat(np.cumsum(n) - n - lo, n)
    own = np.array([phrases[h] for h in heads])[unit]
    empty = start >= begin[unit]  # windows that begin with their context
    head = np.where(empty, -1, suffix[np.minimum(own + start - lo[unit], max(len(suffix) - 1, 0))] if len(suffix) else -1)
    w = np.lexsort((rank[unit], head))
    x, y = w[:-1], w[1:]
    near = np.flatnonzero(head[x] == head[y])
    x, y = x[near], y[near]
    # What two windows with the same beginning share of the rest.
    tail = minimum(range_minima(lcp), rank[unit[x]] + 1, rank[unit[y]])
    equal = (tail >= start[x] + LENGTH - end[unit[x]]) & (start[x] - begin[unit[x]] == start[y] - begin[unit[y]])
    found = np.zeros(len(unit), bool)
    found[x[equal]] = found[y[equal]] = True
    return unit[found], start[found]


def repeated_places(t: pa.Table, n_ranges: int) -> pa.Table:
    """Step 2: a shard's repeated windows, as places of their texts."""
    e, raw = unpack(t, CLASSED)
    settled, e = e[e["how"] == SETTLED], e[e["how"] != SETTLED]
    begin, end = context_of(e["a"].astype(np.int64), e["kind"].astype(np.int64))
    size = begin - e["lo"] + e["hi"] + LENGTH - end
    first, same, _ = alike(e["c2"], e["c1"], e["more"], e["hash"])
    n = np.bincount(same, 1 + (e["how"] == SEVERAL), len(first))
    out = [settled, e[(n[same] > 1) & (e["how"] == PLAIN)]]
    # Where a context stands in several such classes, one unit of each is compared window by window.
    _, group, classes = alike(e["more"][first], e["hash"][first])
    some = first[classes[group] > 1] if len(first) else first
    if len(some):
        unit, start = repeated_windows(e[some], np.frombuffer(raw, np.uint8), (np.cumsum(size) - size)[some])
        alone = n[same[some]][unit] < 2  # the others repeat as a whole
        unit, start = unit[alone], start[alone]
        new = np.flatnonzero(np.concatenate((np.ones(min(len(unit), 1), bool), (unit[1:] != unit[:-1]) | (start[1:] != start[:-1] + 1))))
        runs = e[some[unit[new]]]
        runs["a"] = runs["lo"] = start[new]
        runs["hi"] = start[np.append(new[1:] - 1, len(unit) - 1)] if len(new) else 0
        out.append(runs)
    return by_key(np.concatenate(out), n_ranges)


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def first_round(k1: list[int], k2: list[int], texts: list[str | None], _: list) -> tuple[np.ndarray, list[bytes]]:
    raw = [_bytes(t) for t in texts]
    sizes = np.array([len(x) for x in raw])
    keys = np.array(k1, np.int64), np.array(k2, np.int64)

    def laid(some: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        ends = np.cumsum(sizes[some])
        return b"".join(x for x, k in zip(raw, some) if k), np.flatnonzero(some), ends - sizes[some], ends

    out = []
    some = sizes >= LENGTH  # shorter texts have no window, and empty ones would share a start
    if some.any():
        data, row, starts, ends = laid(some)
        u = units(data, starts, ends)
        doc = np.searchsorted(starts, u[:, 1], "right") - 1
        out.append((hash64(memoryview(data), *context_of(u[:, 0], u[:, 3])), row[doc], u[:, 0] - starts[doc], u[:, 1] - starts[doc], u[:, 2] - starts[doc], u[:, 3]))
    some = sizes > 0
    if some.any():
        data, row, starts, ends = laid(some)
        doc, begin, end = shared_blocks(data, starts, ends)
        h = hash64(memoryview(data), begin, end)
        one, _, _ = alike(h, doc)  # a text's equal blocks count once
        one = np.sort(one)
        doc, begin = doc[one], begin[one] - starts[doc[one]]
        out.append((h[one], row[doc], begin, begin, begin, np.full(len(one), SHARED)))
    e = np.zeros(sum(len(x[0]) for x in out), UNIT)
    if len(e):
        e["hash"], row, e["a"], e["lo"], e["hi"], e["kind"] = map(np.concatenate, zip(*out))
        e["hash"] ^= e["kind"].astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        e["k1"], e["k2"] = keys[0][row], keys[1][row]
    return e, []


def second_round(k1: list[int], k2: list[int], texts: list[str | None], blobs: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    out, strings = [np.zeros(0, CLASSED)], []
    for i, j, text, x in zip(k1, k2, texts, blobs):
        p, raw = np.frombuffer(x, PLACE), _bytes(text)
        view = memoryview(raw)
        e = np.zeros(len(p), CLASSED)
        a, kind = p["a"].astype(np.int64), p["kind"].astype(np.int64)
        begin, end = context_of(a, kind)
        c = hash128(view, begin, end)
        e["hash"], e["more"] = c[:, 0] ^ (kind.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)), c[:, 1]
        c = hash128(view, p["lo"], p["hi"] + LENGTH)
        e["c1"], e["c2"], e["k1"], e["k2"] = c[:, 0], c[:, 1], i, j
        for f in PLACE.names:
            e[f] = p[f]
        out.append(e)
        strings += [raw[lo:b] + raw[d : hi + LENGTH] for lo, b, d, hi in zip(p["lo"].tolist(), begin.tolist(), end.tolist(), p["hi"].tolist())]
    return np.concatenate(out), strings


def removed_runs(p: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the windows that start in [lo, hi] of each place."""
    order = np.argsort(p["lo"], kind="stable")
    lo, end = p["lo"][order].astype(np.int64), p["hi"][order].astype(np.int64) + LENGTH
    reach = np.maximum.accumulate(end)
    new = np.flatnonzero(np.concatenate(([True], lo[1:] > reach[:-1])))
    return list(zip(lo[new].tolist(), reach[np.append(new[1:] - 1, len(lo) - 1)].tolist()))


def substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, the removed spans (begin, end in bytes) and n_shared_blocks of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    doc_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    docs = docs.withColumn("k1", F.xxhash64(doc_id, "text")).withColumn("k2", F.xxhash64(F.lit("second"), "text", doc_id))
    with shuffles_released(spark):
        chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(16, chars // RANGE_CHARS)
    long = docs.filter(F.octet_length("text") >= LENGTH)
    wordy = docs.filter(F.octet_length("text") >= 2 * PASSAGE - 1)

    def places_of(found: DataFrame) -> DataFrame:
        return found.groupBy("range").applyInArrow(gather, "k1 long, k2 long, places binary")

    def reduced(entries: DataFrame, reduce: Callable[[pa.Table, int], pa.Table], schema: str = PLACES) -> DataFrame:
        return entries.groupBy("range").applyInArrow(lambda t: reduce(t, n), schema)

    one = packed_pass(wordy.select("k1", "k2", "text", F.lit(None).cast("int").alias("none")), first_round, ["hash"], n)
    with shuffles_released(spark):
        one = Written(reduced(one, repeated_units, PLACES + ", shared boolean"), "units")
    units_found, blocks_found = (one.read().filter(c).drop("shared") for c in ("not shared", "shared"))
    with_places = long.join(places_of(units_found), ["k1", "k2"]).select("k1", "k2", "text", "places")
    two = packed_pass(with_places, second_round, ["c2", "c1", "more", "hash"], n)
    with shuffles_released(spark):
        found = Written(reduced(two, repeated_places).union(blocks_found), "repeats").read()
    one.drop()
    joined = docs.join(places_of(found), ["k1", "k2"], "left").select("doc_id", "text", "places")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc_id, text, places in zip(*(c.to_pylist() for c in b.columns)):
                raw = _bytes(text)
                p = np.frombuffer(places or b"", PLACE)
                shared = p["kind"] == SHARED
                runs = removed_runs(p[~shared]) if not shared.all() else []
                kept, at = hashlib.sha256(), 0
                for s, e in runs:
                    kept.update(raw[at:s])
                    at = e
                kept.update(raw[at:])
                row = (doc_id, len(raw), sum(e - s for s, e in runs), len(runs), kept.hexdigest(), [{"begin": s, "end": e} for s, e in runs], int(shared.sum()))
                for c, v in zip(out, row):
                    c.append(v)
            spans = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), spans, pa.int64()))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "n_shared_blocks"])

    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<begin: long, end: long>>, n_shared_blocks long")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op5: every text of ``documents`` without its repeated 400-byte strings, and how many blocks of 30 words it shares with others."""
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared_blocks")
