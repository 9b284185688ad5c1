"""SimHash near-duplicates by the generalised pigeonhole principle.

Texts get 64-bit fingerprints of their word shingles. Fingerprints that differ in ``max_bits`` bits or
fewer are linked, and links are followed to components. To find the links, bits are dealt into
partitions that hold correlated bits together; a dynamic programme gives partition i a threshold t_i
with sum(t_i) = max_bits - partitions + 1, by the candidates that each choice is estimated to make.
Two fingerprints within max_bits then differ by at most t_i bits in some partition i (-1: never
probed), so they meet under a key made of that partition without t_i of its bits, and are verified
on all 64 bits.

Scale: only fingerprints are shuffled, and equal ones count once from the start, so that a group of
exact copies is one fingerprint. Keys under which more than ``most_members`` fingerprints meet aren't
paired: their members are linked through the fingerprints one bit away from two of them, each of
which has at most 65 members, which finds the same components. Bit statistics (64 x 64 sums) and candidate
counts (a few sums) are taken over all fingerprints.

Defined results: a null or empty text has fingerprint zero and is linked like any other; repeated
rows are linked as copies; a null doc_id never names a component unless all its members are null; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import Written, map_batches, table
from lattica.llm.graph import components

SHINGLE = 3
MAX_BITS = 2
MOST_MEMBERS = 64
BITS = 64


def shingle_hashes(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of each n-word shingle of the text with A-Z in lower case, repeats included."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[a:b], 42) for a, b in zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist())), np.uint64, len(words) - n + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit j is 1 if it is set in over half the hashes; none: zero."""
    n = len(hashes)
    if not n:
        return 0
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8), bitorder="little").reshape(n, BITS)
    k = n // 255
    counts = bits[k * 255 :].sum(0, dtype=np.int64)
    if k:  # sums of 255 rows fit a byte
        counts += np.add.reduce(bits[: k * 255].reshape(k, 255, BITS), axis=1, dtype=np.uint8).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit integer."""

    def make():
        def rows(ids, texts):
            fps = np.array([fingerprint(shingle_hashes(t, n)) for t in texts], np.uint64)
            return [ids, fps.view(np.int64).tolist()]

        return rows

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, fp long")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and how often bits i and j are both set (64 x 64)."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            bits = np.unpackbits(x.view(np.uint8), bitorder="little").reshape(len(x), BITS).astype(np.float32)
            both += bits.T @ bits
            n += len(x)
        if n:
            at = np.arange(BITS * BITS + 1)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.append(both.reshape(-1), n).astype(np.int64))], names=["k", "n"])

    out = np.zeros(BITS * BITS + 1)
    for r in fps.select("fp").mapInArrow(sums, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        out[r.k] = r.n
    return int(out[-1]), out[:-1].reshape(BITS, BITS)


def correlated_partitions(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """Bits in m partitions of about equal size, each grown from the most correlated bit left by the bits closest to it."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    r = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(r, 0)
    left, out = set(range(BITS)), []
    for k in range(m):
        size = (len(left) + m - k - 1) // (m - k)
        free = sorted(left)
        part = [max(free, key=lambda b: (r[b, free].sum(), -b))]
        while len(part) < size:
            rest = [b for b in free if b not in part]
            part.append(max(rest, key=lambda b: (r[b, part].sum(), -b)))
        out.append(sorted(part))
        left -= set(part)
    return out


def masks(part: list[int], t: int) -> list[int]:
    """Signed masks of a partition without t of its bits, in every way."""
    whole = sum(1 << b for b in part)
    out = [whole - sum(1 << b for b in gone) for gone in combinations(part, t)] if t >= 0 else []
    return [x - (1 << BITS) if x >= 1 << (BITS - 1) else x for x in out]


def estimated_candidates(same: float, both: np.ndarray, n: int, part: list[int], most: int) -> list[float]:
    """Pairs that differ by at most t bits in the partition, t = 0..most: the measured pairs that agree, scaled by the odds that single bits differ."""
    p = np.diag(both)[part] / max(n, 1)
    odds = 2 * p * (1 - p) / np.maximum(1 - 2 * p * (1 - p), 1e-9)
    poly = np.zeros(most + 1)
    poly[0] = 1
    for o in odds:
        poly[1:] += o * poly[:-1].copy()
    return list(np.maximum(same, 1.0) * np.cumsum(poly))


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with sum ``total`` and the least cost; costs[i][t + 1] is that of t."""
    best = {0: (0.0, [])}
    for c in costs:
        now: dict[int, tuple[float, list[int]]] = {}
        for s, (cost, ts) in best.items():
            for t in range(-1, len(c) - 1):
                new = (cost + c[t + 1], [*ts, t])
                if s + t not in now or new < now[s + t]:
                    now[s + t] = new
        best = now
    return best[total]


def probe_plan(fps: DataFrame, max_bits: int) -> list[int]:
    """The masks under which fingerprints are grouped, of the partitioning and thresholds that cost least."""
    n, both = bit_statistics(fps)
    plans = {m: correlated_partitions(n, both, m) for m in range(max(2, max_bits), max_bits + 3)}
    flat = [(m, i, masks(p, 0)[0]) for m, parts in plans.items() for i, p in enumerate(parts)]
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(x)).alias("key")) for k, (_, _, x) in enumerate(flat)])).alias("x")
    groups = fps.select(keys).groupBy("x.k", "x.key").agg(F.count("*").alias("c")).filter("c > 1")
    same = {r.k: r.pairs for r in groups.groupBy("k").agg(F.sum(F.col("c").cast("double") * (F.col("c") - 1) / 2).alias("pairs")).collect()}
    best = None
    for m, parts in plans.items():
        costs = []
        for i, part in enumerate(parts):
            k = next(k for k, x in enumerate(flat) if x[:2] == (m, i))
            pairs = estimated_candidates(same.get(k, 0.0), both, n, part, max_bits)
            # A key costs about what twenty comparisons of longs do.
            costs.append([0.0, *[20.0 * n * comb(len(part), t) + pairs[t] for t in range(max_bits + 1)]])
        found = allocate(costs, max_bits - m + 1)
        if best is None or found[0] < best[0]:
            best = (found[0], [x for part, t in zip(parts, found[1]) for x in masks(part, t)])
    return best[1]


def links(fps: DataFrame, max_bits: int = MAX_BITS, most_members: int = MOST_MEMBERS) -> DataFrame:
    """u, v: pairs of distinct fingerprints whose components are those of all pairs within max_bits."""
    plan = probe_plan(fps, max_bits)
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(x)).alias("key")) for i, x in enumerate(plan)])).alias("x")
    rows = fps.select("fp", keys).select("fp", "x.i", "x.key")
    sizes = rows.groupBy("i", "key").agg(F.count("*").alias("c")).filter("c > 1")
    met = Written(rows.join(sizes, ["i", "key"]), "met").read()
    few = met.filter(F.col("c") <= most_members)
    near = (F.col("a.fp") > F.col("b.fp")) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_bits)
    pairs = few.alias("a").join(few.alias("b"), (F.col("a.i") == F.col("b.i")) & (F.col("a.key") == F.col("b.key")) & near).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    # Where many meet: two within 2 bits are both within 1 bit of some fingerprint; within k, of one k // 2 + k % 2 away.
    many = met.filter(F.col("c") > most_members).select("fp").distinct()
    return pairs.union(star_links(many, max_bits)).distinct()


def star_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links through midpoints: fingerprints within half of max_bits of the same 64-bit value."""
    if max_bits % 2:
        raise ValueError("links through midpoints need an even max_bits")
    half = max_bits // 2
    flips = [reduce(lambda a, b: a | 1 << b, c, 0) for k in range(half + 1) for c in combinations(range(BITS), k)]
    flips = [x - (1 << BITS) if x >= 1 << (BITS - 1) else x for x in flips]
    mids = fps.select("fp", F.explode(F.array(*map(F.lit, flips))).alias("f")).select("fp", F.col("fp").bitwiseXOR(F.col("f")).alias("mid"))
    # A value has at most as many distinct fingerprints around it as there are flips.
    around = mids.groupBy("mid").agg(F.collect_set("fp").alias("s")).filter(F.size("s") > 1)
    return around.select(F.explode("s").alias("u"), F.array_min("s").alias("v")).filter("u <> v")


def roots_of(rows: DataFrame, max_bits: int) -> DataFrame:
    """fp and root (the same for all fingerprints of a component) of the fingerprints in rows."""
    fps = Written(rows.select("fp").distinct(), "fps").read()
    roots = components(links(fps, max_bits))
    return fps.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_groups(docs: DataFrame, *, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id reachable over links) of every document."""
    rows = Written(fingerprints(docs, shingle), "simhash").read()
    named = rows.groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots_of(rows, max_bits), "fp")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(named.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op4: fingerprints and components of all of ``documents``."""
    out = near_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def row_keys(docs: DataFrame) -> DataFrame:
    """docs with two columns more, _k1 and _k2 (longer if docs has such): 128 bits of doc_id and text."""
    doc_id, text = F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))
    mark = "_" * (1 + max(len(c) - len(c.lstrip("_")) for c in docs.columns))
    return docs.withColumns({f"{mark}k1": F.xxhash64(doc_id, text), f"{mark}k2": F.xxhash64(F.lit("second"), text, doc_id)})


def drop_near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each component, that with the least doc_id (a null one comes last); all columns kept.

    Rows are told apart by doc_id and text: different texts that share a doc_id stay unless they are linked;
    of rows that repeat doc_id and text one stays. A null text counts as an empty one.
    """
    named = row_keys(docs)
    k1, k2 = named.columns[-2:]
    id_schema = "doc_id long, k1 long, k2 long, fp long"

    def make():
        def rows(ids, a, b, texts):
            return [ids, a, b, np.array([fingerprint(shingle_hashes(t, shingle)) for t in texts], np.uint64).view(np.int64).tolist()]

        return rows

    rows = Written(map_batches(named.select(F.col("doc_id").cast("long"), k1, k2, "text"), make, id_schema), "simhash").read()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k1", "k2"))
    # By fingerprint first, so that a large component is summed up before its root gathers it.
    named_fps = rows.groupBy("fp").agg(first.alias("f")).join(roots_of(rows, max_bits), "fp")
    kept = named_fps.groupBy("root").agg(F.min("f").alias("f")).select(F.col("f.k1").alias(k1), F.col("f.k2").alias(k2))
    return named.join(kept, [k1, k2], "left_semi").dropDuplicates([k1, k2]).select(*[F.col(f"`{c}`") for c in docs.columns])
