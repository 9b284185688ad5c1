"""Clashing columns, empty tables, ties, long texts and small recomputations of the operators."""

import hashlib
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lattica.llm import common, decontaminate, language_id, lm_score, mixing, pii, quality, quality_rules, simhash, substring_dedup, toxicity

SF = "/root/testdata/sf0.001"
CLASHES = ["_key", "_k1", "_k2", "k1", "k2", "fp", "row", "key", "block", "i", "h", "lines", "places", "host", "y", "n", "t", "w", "range", "_id", "score", "root"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [(1, "one text with some words in it", "en", "s", 30), (1, "another text under the same number", "en", "s", 34), (2, None, None, None, None), (3, "", "de", "s", 0), (None, "un texte sans nombre", "fr", None, 20), (None, "un texte sans nombre", "fr", None, 20), (4, "long " * 40_000 + "mail a@b.cd", "en", "s", 200_011)]


@pytest.fixture(scope="module")
def clashing(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.select("*", *(F.lit("x").alias(c) for c in CLASHES))


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "nothing of this stands in any of the texts at all")], "item_id long, text string")


def operators(docs, labels, bench):
    return {
        "op1": lambda: quality.score(docs, quality.fit(docs, labels)),
        "op2": lambda: lm_score.lm_scores(docs),
        "op3": lambda: language_id.score(docs, language_id.fit(docs)),
        "op4": lambda: simhash.near_groups(docs),
        "op5": lambda: substring_dedup.substring_dedup(docs),
        "op7": lambda: pii.spans_of(docs),
        "op8": lambda: quality_rules.verdicts(docs),
        "op8 texts": lambda: quality_rules.quality_rules(docs),
        "op10": lambda: toxicity.score(docs, toxicity.fit(docs, labels)),
    }


def test_clashing_columns(spark, clashing, bench):
    labels = spark.createDataFrame([(1, 1, 0, "x"), (3, 0, 1, "x"), (4, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")
    for name, make in operators(clashing, labels, bench).items():
        assert make().count() == len(ROWS), name
    assert decontaminate.contaminated(clashing, bench.withColumn("text_", F.lit(1))).count() == 0
    assert mixing.mix(clashing, budget_share=1.0, max_epochs=1).filter("n_tokens > 0").count() == 5


def test_empty_tables_of_all(spark, bench):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, make in operators(docs, labels, bench).items():
        assert make().count() == 0, name


# The pipeline's stages.
def test_stages_keep_columns_and_rows(spark, clashing):
    out = {name: stage(spark, clashing, SF) for name, stage in corpus_pipeline.STAGES[:-1]}
    assert all(df.columns == clashing.columns for df in out.values())
    assert out["simhash_near_dedup"].filter("doc_id = 1").count() == 2
    assert out["simhash_near_dedup"].filter("doc_id is null").count() == 1
    assert out["decontaminate"].count() == out["pii"].count() == len(ROWS)
    assert out["pii"].filter("text like '%[EMAIL]'").count() == 1 and out["pii"].filter("text is null").count() == 1
    kept = {r.text for r in out["language_id"].collect()}
    assert None not in kept and "" not in kept


def test_stages_of_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_stages_against_their_operators(spark):
    """What a stage keeps is what its operator says of the same rows."""
    docs = common.table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    told = {r.doc_id for r in language_id.score(docs, language_id.fit(docs)).collect() if r.lang_pred != "und" and r.score >= 0.5}
    assert {r.doc_id for r in stages["language_id"](spark, docs, SF).collect()} == told
    found = {r.doc_id for r in decontaminate.contaminated(docs, common.table(spark, SF, "benchmark")).collect()}
    assert {r.doc_id for r in stages["decontaminate"](spark, docs, SF).collect()} == {r.doc_id for r in docs.collect()} - found
    clean = {r.doc_id: r for r in stages["pii"](spark, docs, SF).collect()}
    for r in docs.collect():
        spans = pii.find_spans(r.text)[1]
        left, at = "", 0
        for s in spans:
            if s.start >= at:
                left += r.text[at : s.start] + f"[{s.kind.upper()}]"
            at = max(at, s.end)
        assert clean[r.doc_id].text == left + r.text[at:] and clean[r.doc_id].n_chars == len(clean[r.doc_id].text)


# Language models.
def test_lm_does_not_depend_on_partitions(spark):
    docs = common.table(spark, SF, "documents")
    one, four = ({r.doc_id: r.score for r in lm_score.lm_scores(docs.repartition(n)).collect()} for n in (1, 4))
    assert one.keys() == four.keys() and max(abs(one[i] - four[i]) for i in one) < 0.02


def test_planes_round_trip():
    x = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 1000).astype(np.uint64))
    assert (lm_score.from_planes(lm_score.planes(x), "<u8") == x).all() and len(lm_score.from_planes(b"", "<u4")) == 0


def test_every_language_is_learned(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"wort{i} text", f"l{i}") for i in range(900)], "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(language_id, "train", lambda segments, langs: seen.extend(langs) or language_id.init(len(langs)))
    language_id.fit(docs)
    assert sorted(seen) == sorted(f"l{i}" for i in range(900) if zlib.crc32(str(i).encode()) % 3 != 1)


def test_labels_of_whole_texts():
    """Fillers change nothing, every position counts once, and the state passes from word to word."""
    p, langs = language_id.init(3), ["a", "b", "c"]
    texts = ["ein kurzer Text", "x", "Ärger über 10 % und mehr " * 60, "un deux\ttrois\n"]
    whole = language_id.Labeller(p, 3)
    sums, n = whole.labels(texts)
    assert n.tolist() == [len(t.lower().encode()) for t in texts]
    for t, s in zip(texts, sums):
        assert np.allclose(whole.labels([t])[0][0], s, rtol=1e-5)
        x = np.frombuffer(t.lower().encode(), np.uint8)[None]
        by_hand = language_id.log_labels(p, x, np.ones(x.shape, bool))[0]
        assert np.allclose(by_hand, s, rtol=1e-5 if len(t) < language_id.WINDOW else 1e-2)
    for m in (1, language_id.WINDOW, language_id.WINDOW + 1, 5_000):
        spans = list(language_id.windows_of(m))
        assert [i for a, b, _, _ in spans for i in range(a, b)] == list(range(m))
        assert all(first <= a and b <= last and last - first <= language_id.WINDOW + 2 * language_id.CONTEXT for a, b, first, last in spans)
    assert not np.allclose(whole.labels(["ab cd"])[0], whole.labels(["ab"])[0] + whole.labels([" "])[0] + whole.labels(["cd"])[0])
    assert language_id.predict(whole, langs, [None, "", " 12 !", "abc"])[0][:3] == ["und"] * 3


def test_training_windows_span_the_text():
    text = "".join(chr(97 + i % 26) for i in range(10_000))
    got = language_id.train_windows(text)
    assert len(got) == language_id.WINDOWS_PER_DOC and {len(w) for w in got} == {language_id.TRAIN_WINDOW}
    assert got[0] == text[: language_id.TRAIN_WINDOW].encode() and got[-1] == text[-language_id.TRAIN_WINDOW :].encode()
    assert language_id.train_windows("") == [] and language_id.train_windows("ab") == [b"ab"]


# Substrings.
def test_substrings_of_the_table(spark):
    docs = common.table(spark, SF, "documents")
    raw = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    h = xxhash.xxh3_128_intdigest
    windows = {i: [h(memoryview(b)[s : s + 400]) for s in range(len(b) - 399)] for i, b in raw.items()}
    seen = Counter(x for w in windows.values() for x in w)
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(docs).collect()}
    for i, b in raw.items():
        gone = np.zeros(len(b) + 1, np.int64)
        for s, x in enumerate(windows[i]):
            if seen[x] > 1:
                gone[s] += 1
                gone[s + 400] -= 1
        cover = np.cumsum(gone)[: len(b)] > 0
        kept = hashlib.sha256(np.frombuffer(b, np.uint8)[~cover].tobytes()).hexdigest()
        assert (got[i].n_bytes, got[i].n_removed, got[i].kept_sha256) == (len(b), int(cover.sum()), kept)


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {x for x in files.mkString("|").split("|") if "/shuffle_" in x}


def test_substrings_release_shuffles(spark):
    """Before its last step runs, op5 holds no shuffle files of the steps that are written; the setting is put back."""
    key, docs = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", common.table(spark, SF, "documents")
    for value in (None, "false"):
        if value:
            spark.conf.set(key, value)
        before = shuffle_files(spark)
        out = substring_dedup.substring_dedup(docs)
        assert spark.conf.get(key, None) == value
        spark.conf.unset(key)
        until = time.time() + 3  # files go in the background
        while (left := shuffle_files(spark) - before) and time.time() < until:
            time.sleep(0.1)
        assert not left
        assert out.count() == out.count() == docs.count()


def spans_of_words(b, n):
    """All runs of n words of a text, as bytes."""
    at = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)]
    return {b[at[i][0] : at[i + n - 1][1]] for i in range(len(at) - n + 1)}


def assert_shared(docs, rows):
    """Every text that shares 51 words counts blocks, none that doesn't share 30 does."""
    raw = [(r.text or "").encode() for r in rows]
    got = {r.doc_id: r.n_shared_blocks for r in substring_dedup.substring_dedup(docs).collect()}
    long, short = ([spans_of_words(b, n) for b in raw] for n in (51, 30))
    in_long, in_short = (Counter(x for s in sets for x in s) for sets in (long, short))
    kinds = Counter()
    for r, a, b in zip(rows, long, short):
        must, may = any(in_long[x] > 1 for x in a), any(in_short[x] > 1 for x in b)
        assert got[r.doc_id] > 0 if must else may or got[r.doc_id] == 0, r.doc_id
        kinds[must, got[r.doc_id] > 0] += 1
    return kinds


def test_shared_blocks_of_the_table(spark):
    docs = common.table(spark, SF, "documents")
    kinds = assert_shared(docs, docs.collect())
    assert kinds[True, True] and kinds[False, False]


def test_shared_blocks_of_short_passages(spark):
    """Passages of 51 words far below 400 bytes, at any place of a text, and low variety."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(3000)]
    some = lambda n: " ".join(rng.choice(words, n))
    rows = []
    for _ in range(20):
        passage = some(51)
        rows += [passage, f"{some(int(rng.integers(1, 90)))}\n{passage} {some(int(rng.integers(0, 90)))}"]
    rows += [some(120) for _ in range(20)] + [some(29) + "\t" + x + " " + some(29) for x in [some(29)] * 2]
    rows += ["a " * 200, "a " * 60, "b " * 300, "", None, " \n", "ünd " * 51, "vor ünd " + "ünd " * 51, "x" * 900]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    kinds = assert_shared(docs.repartition(5), docs.collect())
    assert kinds[True, True] >= 44 and not kinds[False, True]


def test_suffix_arrays():
    """Ranks of a dictionary's suffixes, the parse's order and its minima, against sorting by hand."""
    rng = np.random.default_rng(4)
    words = list({bytes(rng.choice([97, 98, 0], rng.integers(1, 40)).astype(np.uint8)) for _ in range(60)})
    ends = np.repeat(np.cumsum([len(w) for w in words]), [len(w) for w in words])
    text = b"".join(words)
    rank = substring_dedup.dictionary_ranks(np.frombuffer(text, np.uint8), ends)
    suffixes = [text[i:e] for i, e in enumerate(ends.tolist())]
    assert rank.tolist() == [sorted(set(suffixes)).index(s) for s in suffixes]
    sizes = rng.integers(0, 16, 50)
    tails = np.zeros((50, 16), np.uint8)
    for k, n in enumerate(sizes):
        tails[k, :n] = rng.choice([97, 98], n)
    context = rng.integers(0, 3, 50)
    order, lcp = substring_dedup.parse_order(context, tails, sizes)
    keys = [(context[k], tails[k].tobytes()) for k in order]
    assert keys == sorted(keys)
    for k in range(1, 50):
        a, b = order[k - 1], order[k]
        n = next((j for j in range(min(sizes[a], sizes[b])) if tails[a, j] != tails[b, j]), min(sizes[a], sizes[b]))
        assert lcp[k] == (n if context[a] == context[b] else -1)
    table = substring_dedup.range_minima(lcp)
    a, b = np.triu_indices(50)
    assert substring_dedup.minimum(table, a, b).tolist() == [int(lcp[i : j + 1].min()) for i, j in zip(a, b)]


# Near-duplicates.
def test_near_duplicates_keep_other_texts_and_columns(spark):
    rows = [(1, "first text", "a"), (1, "quite another text here", "b"), (2, "first text", "c"), (None, "first text", "d"), (None, "alone without a number", "e"), (5, None, "f"), (6, "", "g")]
    out = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, _key string")).collect()
    assert sorted(r._key for r in out) == ["a", "b", "e", "f"]


# Personal data.
def test_iban_before_capitals():
    for text, iban in (("IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", "DE89 3704 0044 0532 0130 00"), ("GB82WEST12345698765432 ABC", "GB82WEST12345698765432"), ("XX11 DE89370400440532013000", "DE89370400440532013000")):
        assert [text[s:e] for s, e in pii.ibans(text)] == [iban]
    assert pii.ibans("DE89 3704 0044 0532 0130 01 BIC") == [] and pii.ibans("A" * 5000 + "11" * 3000) == []


# Quality rules.
def test_lines_count_distinct_documents(spark):
    rows = [(7, f"the same line\nown {i}", "en", "h", 1) for i in range(30)] + [(None, "the same line", "en", "h", 1)] * 30
    assert all(r.removed_chars == 0 for r in quality_rules.verdicts(spark.createDataFrame(rows, SCHEMA)).collect())
    rows = [(i, f"the same line\nown {i}", "en", "h", 1) for i in range(30)]
    assert all(r.removed_chars == len("thesameline") for r in quality_rules.verdicts(spark.createDataFrame(rows, SCHEMA)).collect())


# Decontamination.
def overlap_by_hand(doc, item, diagonal):
    """The best stretch along a diagonal: the largest sum of 1 for equal words and -2 for others, the first such."""
    a, b = max(0, diagonal), min(len(doc), diagonal + len(item))
    same = [doc[p] == item[p - diagonal] for p in range(a, b)]
    seeded = any(all(same[s + k] for k, c in enumerate(m) if c == "1") for s in range(len(same) - 7) for m in decontaminate.MASKS)
    best = (0, 0, 0)
    for e in range(len(same) + 1):
        for s in range(e + 1):
            score = sum(1 if x else -2 for x in same[s:e])
            if score > best[0]:
                best = (score, s, e)
    _, s, e = best
    equal = [doc[a + p] for p in range(s, e) if same[p]]
    return seeded, len(equal), len(set(equal)), a + s, e - s


def test_decontaminate_by_hand(spark):
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(10)]
    items = [list(rng.choice(words[: rng.integers(2, 10)], rng.integers(8, 16))) for _ in range(8)]
    docs = []
    for k in range(24):
        d = list(rng.choice(words, 14))
        x = [w if rng.random() > 0.12 else "zz" for w in items[k % 8]]
        docs.append(d[:7] + x[rng.integers(0, 3) :] + d[7:] if k % 3 else d + d)
    expected = {}
    for i, d in enumerate(docs):
        for j, x in enumerate(items):
            for diagonal in range(8 - len(x), len(d) - 7):
                seeded, n, distinct, first, size = overlap_by_hand(d, x, diagonal)
                if seeded and len(set(x)) > 1 and n >= 8 and distinct >= min(4, len(set(x))) and (n, -first) > expected.get((i, j), (0, 0, 0))[:2]:
                    expected[i, j] = (n, -first, size)
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(j, " ".join(x)) for j, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_match, -r.first_word, r.n_words) for r in decontaminate.contaminated(df, bench).collect()}
    assert len(expected) > 8 and {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in expected.items()}


def test_decontaminate_items_of_few_words(spark):
    bench = spark.createDataFrame([(1, "tick tock " * 5), (2, "tick " * 10)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "clock says tick tock tick tock tick tock tick tock tick tock now"), (2, "tick " * 12), (3, "tick tock")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()] == [(1, 1)]


def test_decontaminate_in_blocks(spark):
    """Many blocks find what one does, and the driver sends texts, not indexes."""
    rng = np.random.default_rng(9)
    items = [(j, " ".join(rng.choice([f"w{k}" for k in range(400)], 20))) for j in range(30)]
    bench = spark.createDataFrame([*items, (99, None), (98, "")], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"before {items[i % 30][1]} behind" if i % 2 else "clean") for i in range(40)], "doc_id long, text string")
    whole = sorted(map(tuple, decontaminate.contaminated(docs, bench).collect()))
    small = sorted(map(tuple, decontaminate.contaminated(docs, bench, block_chars=400).collect()))
    assert whole == small and [(r[0], r[1]) for r in whole] == [(i, i % 30) for i in range(40) if i % 2]
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, bench, block_chars=400).collect()} == set(range(0, 40, 2))
    parts = decontaminate.blocks(bench, 400)
    assert len(parts) > 3 and sum(len(b.items) for b in parts) == 32 and not any(isinstance(v, decontaminate.Index) for b in parts for v in vars(b).values())


# Quality and toxicity.
def test_quality_scores_by_hand(spark):
    """A score is the logistic function of the scaled distance of a document's strength to the cut."""
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    fitted = quality.fit(docs, labels)
    for r in quality.score(docs, fitted).limit(20).join(docs, "doc_id").collect():
        x = quality.measures(r.text)
        s = sum(fitted["w"][j * quality.BINS + int(np.searchsorted(fitted["edges"][j], v, side="right"))] for j, v in enumerate(x))
        p = 1 / (1 + np.exp(-np.clip(4 * (s - fitted["cut"]) / fitted["scale"], -40, 40)))
        assert abs(p - r.score) < 1e-5 and r.predicted == int(r.score >= 0.5)


def test_toxicity_decodes_by_all_paths():
    """Viterbi finds the best of all paths through a lattice."""
    text = " ".join(["idiot trash loser"] * 40).encode()
    m = toxicity.count_trigrams(text).reshape(32, 32, 32).astype(float)
    two = m.sum(0) + 0.5
    two /= two.sum(1, keepdims=True)
    model = np.log((m + 5 * two) / (m.sum(2, keepdims=True) + 5)).astype(np.float32)
    d = toxicity.Decoder(model)

    def cost(path, channel):
        a = b = 0
        s = channel
        for ch in (path + " ").encode():
            z = int(toxicity.LUT[ch])
            s += float(model[a][b][z])
            a, b = (0, 0) if z == 0 else (b, z)
        return s

    for token in ("1d10t", "l0ser", "tr4$h"):
        paths = [("", 0.0)]
        for options in d.lattice(token):
            paths = [(p + o, s + c) for p, s in paths for o, c in options]
        assert d.decode(token) == max(paths, key=lambda x: cost(*x))[0].strip()

