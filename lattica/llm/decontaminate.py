"""Benchmark decontamination by spaced seeds.

Texts become words in lower case without signs around them. Fixed masks pick 6 of 8 neighbouring
words, so that a hash of the picked ones survives a substituted word under the ignored places. The
masked hashes of the benchmark are joined with those of every document; around each hit the document
and the item are compared word by word along the hit's diagonal, and the stretch with the best score
(1 for an equal word, -2 for another) counts if it holds ``min_match`` equal words.

Scale: the benchmark is worked off in blocks of about ``block_chars`` characters (4 million make an index
of about 100 MB); a block's items are the only thing sent to the executors, where each Python worker makes
the index once, and documents stream past it in Arrow batches. Nothing of a document is shuffled, so hot
passages or sources have no group to overload. The benchmark's texts pass through the driver; it is the
small side, and each block costs a scan of the documents.

Defined results: null or empty texts hold nothing; an overlap needs 4 distinct equal words, or all the
item's where it has 2 or 3; an item of one word over and over is never found; an item of fewer than 8
words is found only as a whole and only if it has at least 4 distinct words; ties between diagonals go to the first place in the
document; repeated rows give repeated results; empty tables give an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import map_batches, table

#: Places that count in a window of 8 words.
MASKS = ("11111100", "11011011", "10110111", "11101101", "10111101", "11010111", "10111011", "11011101")
SPAN = 8
MIN_MATCH = 8
MIN_DISTINCT = 4
MISMATCH = 2
BLOCK_CHARS = 4_000_000
FILTER_BITS = 22
CACHE = 500_000
SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "…«»“”‘’¿¡–—"


def normal(word: str) -> str:
    return word.lower().strip(SIGNS)


class Ids(dict):
    """Raw word to the id of its normal form: 0 if the benchmark lacks it, -1 for mere signs."""

    def __init__(self, vocabulary: dict[str, int]) -> None:
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, raw: str) -> int:
        w = normal(raw)
        i = self.vocabulary.get(w, 0) if w else -1
        if len(self) < CACHE:
            self[raw] = i
        return i

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        x = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return x[x >= 0]


def mask_hashes(ids: np.ndarray, mask: str, k: int) -> np.ndarray:
    """The hash of the picked words of each window, by 64-bit multiplication."""
    n = len(ids) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = ids.astype(np.uint64)
    out = np.full(n, 0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1, np.uint64)
    for j, c in enumerate(mask):
        if c == "1":
            out ^= x[j : j + n] + np.uint64(0x632BE59BD9B4E019)
            out *= np.uint64(0xFF51AFD7ED558CCD)
            out ^= out >> np.uint64(32)
    return out


class Index:
    """The masked hashes of a block of the benchmark."""

    def __init__(self, items: list[tuple[int, str | None]]) -> None:
        words = [[w for w in map(normal, (t or "").split()) if w] for _, t in items]
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for x in words for w in x}))}
        self.item_ids = [i for i, _ in items]
        self.items = [np.array([self.vocabulary[w] for w in x], np.int64) for x in words]
        self.distinct = [len(np.unique(x)) for x in self.items]
        hashes, item, pos = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for i, x in enumerate(self.items):
            if len(x) < SPAN or self.distinct[i] < 2:
                continue
            for k, m in enumerate(MASKS):
                h = mask_hashes(x, m, k)
                hashes.append(h)
                item.append(np.full(len(h), i, np.int32))
                pos.append(np.arange(len(h), dtype=np.int32))
        # Items shorter than a window are found by their first word.
        self.short: dict[int, list[int]] = {}
        for i, x in enumerate(self.items):
            if len(x) < SPAN and self.distinct[i] >= MIN_DISTINCT:
                self.short.setdefault(int(x[0]), []).append(i)
        h = np.concatenate(hashes)
        order = np.argsort(h, kind="stable")
        self.hashes, self.item, self.pos = h[order], np.concatenate(item)[order], np.concatenate(pos)[order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.hashes >> np.uint64(64 - FILTER_BITS)] = True

    def hits(self, ids: np.ndarray) -> np.ndarray:
        """Rows (place, item, diagonal) of all seed hits in a run of ids, distinct."""
        out = []
        for k, m in enumerate(MASKS):
            h = mask_hashes(ids, m, k)
            at = np.flatnonzero(self.filter[h >> np.uint64(64 - FILTER_BITS)])
            lo, hi = np.searchsorted(self.hashes, h[at], "left"), np.searchsorted(self.hashes, h[at], "right")
            n = hi - lo
            if not n.sum():
                continue
            rows = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            out.append(np.stack((np.repeat(at, n), self.item[rows], np.repeat(at, n) - self.pos[rows]), axis=1))
        for first, items in self.short.items():
            for p in np.flatnonzero(ids == first):
                out += [np.array([[p, i, p]]) for i in items if np.array_equal(ids[p : p + len(self.items[i])], self.items[i])]
        if not out:
            return np.zeros((0, 3), np.int64)
        x = np.concatenate(out)
        return x[np.unique(x[:, 1:], axis=0, return_index=True)[1]]

    def overlap(self, ids: np.ndarray, item: int, diagonal: int) -> tuple[int, int, int]:
        """(equal words, first place, places) of the best stretch of an item along a diagonal."""
        x = self.items[item]
        a, b = max(0, diagonal), min(len(ids), diagonal + len(x))
        same = ids[a:b] == x[a - diagonal : b - diagonal]
        s = np.concatenate(([0], np.cumsum(np.where(same, 1, -MISMATCH))))
        low = np.minimum.accumulate(s)
        end = int(np.argmax(s - low))
        start = int(np.argmin(s[: end + 1]))
        part = same[start:end]
        if len(np.unique(ids[a + start : a + end][part])) < min(MIN_DISTINCT, self.distinct[item]):
            return 0, 0, 0
        return int(part.sum()), a + start, end - start


class Block:
    """Items of the benchmark, sent as they are; a worker makes their index once and holds one index at a time."""

    held: tuple[str, Index] | None = None

    def __init__(self, items: list[tuple[int, str | None]]) -> None:
        self.name, self.items = uuid.uuid4().hex, items

    def index(self) -> Index:
        if Block.held is None or Block.held[0] != self.name:
            Block.held = None
            Block.held = self.name, Index(self.items)
        return Block.held[1]


def find(index: Index, texts: list[str | None], ids: Ids, min_match: int = MIN_MATCH) -> list[tuple[int, int, int, int, int]]:
    """(text, item, equal words, first word, words) of the best overlap of each text and item."""
    out = []
    for a in range(0, len(texts), 256):
        docs = [ids.of(t) for t in texts[a : a + 256]]
        # One run of ids for many texts; SPAN - 1 zeros keep windows from crossing.
        gap = np.zeros(SPAN, np.int64)
        run = np.concatenate([x for d in docs for x in (d, gap)])
        starts = np.concatenate(([0], np.cumsum([len(d) + SPAN for d in docs])[:-1]))
        hits = index.hits(run)
        k = np.searchsorted(starts, hits[:, 0], "right") - 1
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for d, item, diagonal in zip(k.tolist(), hits[:, 1].tolist(), (hits[:, 2] - starts[k]).tolist()):
            n, first, size = index.overlap(docs[d], item, diagonal)
            if n >= min(min_match, len(index.items[item])) and (n, -first) > (lambda o: (o[0], -o[1]))(best.get((d, item), (0, 0, 0))):
                best[d, item] = (n, first, size)
        out += [(a + d, item, *v) for (d, item), v in sorted(best.items())]
    return out


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> list[Block]:
    """The benchmark's blocks, each of items of about block_chars characters together."""
    total = benchmark.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // block_chars))
    rows = benchmark.select("item_id", "text")
    parts = (rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) for k in range(n))
    return [Block([(r.item_id, r.text) for r in sorted(p.collect(), key=lambda r: (r.item_id is None, r.item_id))]) for p in parts]


def contaminated(docs: DataFrame, benchmark: DataFrame, *, min_match: int = MIN_MATCH, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, n_match, first_word, n_words: a row for each document and item that overlap."""

    def one(block: Block) -> DataFrame:
        def make():
            index = block.index()
            ids = Ids(index.vocabulary)

            def rows(doc_ids, texts):
                found = find(index, texts, ids, min_match)
                return [[doc_ids[f[0]] for f in found], [index.item_ids[f[1]] for f in found], *[[f[k] for f in found] for k in (2, 3, 4)]]

            return rows

        return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, item_id long, n_match long, first_word long, n_words long")

    return reduce(DataFrame.unionAll, map(one, blocks(benchmark, block_chars)))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, min_match: int = MIN_MATCH, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents without those that overlap a benchmark item, all columns kept; no join is needed."""
    cols = docs.columns
    at = cols.index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    for block in blocks(benchmark, block_chars):

        def make(block=block):
            index = block.index()
            ids = Ids(index.vocabulary)

            def rows(*columns):
                bad = {f[0] for f in find(index, columns[at], ids, min_match)}
                return [[v for i, v in enumerate(c) if i not in bad] for c in columns]

            return rows

        docs = map_batches(docs, make, schema)
    return docs


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op9: the documents of ``documents`` that hold passages of ``benchmark``."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
