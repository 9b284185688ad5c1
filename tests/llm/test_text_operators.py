"""Operators that work row by row or on few tables, against brute force and on awkward rows."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattica.llm import common, decontaminate, language_id, mixing, pii, quality, quality_rules, toxicity
from lattica.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"
AWKWARD = [(1, None, None, None, None, "x"), (2, "", "en", "s", 0, None), (3, "word", "en", "s", 4, None), (3, "word", "en", "s", 4, None), (None, "no id here\nno id here", "fr", None, 1, None), (4, "é " * 5000 + "end", "fr", "s", 9, None), (5, "\n \t\n", None, "s", 4, None)]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


def held(i, n=3):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n


# Personal data.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_by_pattern(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return [(pii.BASE_KINDS[k], s, e) for s, k, e in sorted(out)]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a@.1 2-+5(4)%é0", max_size=60))
def test_pii_base(text):
    assert pii.base_spans(text) == base_by_pattern(text)


def test_pii_adds_and_redacts():
    text = "IBAN DE89370400440532013000, ssn 123-45-6789, card 4111 1111 1111 1111, call (555) 123-4567 or +1 555 123 4567, a.b@c.de"
    kinds = [s.kind for s in pii.find_spans(text)[1]]
    assert kinds == ["iban", "ssn", "card", "local_phone", "phone", "email"]
    assert pii.redact_text(text) == "IBAN [IBAN], ssn [SSN], card [CARD], call [LOCAL_PHONE] or [PHONE], [EMAIL]"
    assert pii.redact_text("part 123-45-6780 of the order") == "part 123-45-6780 of the order"
    assert pii.redact_text(None) is None
    assert not pii.mod97("DE89370400440532013001")


def test_pii_rows(spark, awkward):
    rows = pii.spans_of(awkward).collect()
    assert len(rows) == len(AWKWARD) and all(r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in rows)
    out = pii.redact(awkward)
    assert out.columns == awkward.columns and out.count() == len(AWKWARD)


# SQL and empty tables.
def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.quality_rules(docs).count() == 0
    assert pii.spans_of(docs).count() == 0
    assert mixing.mix(docs).count() == 0
    assert quality.score(docs, quality.fit(docs, labels)).count() == 0
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == 0
    assert language_id.score(docs, language_id.fit(docs)).count() == 0
    assert decontaminate.contaminated(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)


# Quality rules.
def rules_by_hand(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    cover = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover)


def test_quality_rules_measures(spark):
    texts = ["a b c a b c d", "x", None, "", "a a a a", "l1 #$\nl1 #$\n\n \nq", "a b c d a b c e b c d", "ä ö b\vc"]
    docs = spark.createDataFrame([(i, t, "en", None, 1, "x") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: tuple(r[1:6]) for r in quality_rules.quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()}
    assert got == {i: rules_by_hand(t) for i, t in enumerate(texts)}


def test_quality_rules_remove_common_lines(spark):
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(80))
    rows = [(i, f"{body(i)}\n{'Common line ' * 3}", "en", "h", 1, "") for i in range(30)] + [(100 + i, "COMMON  line " * 3 + "\n" + " ".join(f"c{k}" for k in range(60)), "en", "h", 1, "") for i in range(25)]
    out = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(out[i].kept and out[i].removed_chars == 30 for i in range(30))
    assert not any(out[100 + i].kept for i in range(25))


def test_quality_rules_return_texts_without_common_lines(spark):
    top, end = "Home | About | Contact us", "all rights  Reserved"
    rows = [(i, f"{top}\n\nown {i} line\n{end.upper() if i % 2 else end}\nown {i} line\n", "en", "h", 1, "") for i in range(30)] + [(99, f"{top}\n{end}", "en", "other", 1, ""), (100, None, "en", "h", 1, "")]
    out = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {i: out[i].text for i in range(30)} == {i: f"\nown {i} line\nown {i} line\n" for i in range(30)}
    assert out[99].text == f"{top}\n{end}" and out[100].text is None and out[99].removed_chars == out[100].removed_chars == 0
    assert all(out[i].removed_chars == len("".join((top + end).split())) for i in range(30))


def test_quality_rules_repeated_rows(spark, awkward):
    out = quality_rules.quality_rules(awkward.union(awkward)).collect()
    assert len(out) == 2 * len(AWKWARD)


# Mixing.
def test_mixing_redistributes(spark):
    rows = [(i, "w " * 10, "en", "a", 1, "") for i in range(100)] + [(1000 + i, "w " * 10, "en", "b", 1, "") for i in range(5)] + [(2000 + i, "w " * 10, "de", "c", 1, "") for i in range(100)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix(docs, budget_share=0.5, max_epochs=2, weights={"lang": {"en": 1.0, "de": 1.0}}, domain=F.lit("d"))
    got = {r.source: (r.n, r.b) for r in out.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("epochs")).alias("n"), F.first("budget").alias("b")).collect()}
    # 1025 tokens: 512 for each language; b can give 100 of its 256, and its sibling takes the rest.
    assert got["b"] == (100, 100) and got["a"] == (410, 412) and got["c"] == (510, 512)


def test_mixing_prefix_is_the_sorted_one(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 7), "en", "a", 1, "") for i in range(300)], SCHEMA)
    out = {r.doc_id: r.epochs for r in mixing.mix(docs, budget_share=0.4).collect()}
    sizes = {i: i % 7 for i in range(300)}
    rest = int(0.4 * sum(sizes.values()) + 1e-6)
    total, expected = 0, set()
    for i in sorted(sizes, key=lambda i: hashlib.md5(f"mix:1:{i}".encode()).hexdigest()):
        total += sizes[i]
        if total > rest:
            break
        expected.add(i)
    assert set(out) == expected


# Benchmark passages.
def test_decontaminate(spark):
    item = "the quick brown fox jumps over the lazy dog while seven wizards mix odd potions quietly tonight"
    words = item.split()
    swapped = " ".join("zzz" if i in (4, 10) else w for i, w in enumerate(words))
    bench = spark.createDataFrame([(1, item), (2, "one two"), (3, None), (4, "short but all there"), (5, "the the the the the the the the the")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"Well: {item.upper()}!", "en", "s", 1, ""), (2, f"so {swapped} it is", "en", "s", 1, ""), (3, "the the the the the the the the the the", "en", "s", 1, ""), (4, "quick fox dog potions", "en", "s", 1, ""), (5, "A (short) but all there.", "en", "s", 1, ""), (6, None, "en", "s", 1, ""), (None, item, "en", "s", 1, "")], SCHEMA)
    got = {(r.doc_id, r.item_id): r.n_match for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(1, 1): len(words), (2, 1): len(words) - 2, (5, 4): 4, (None, 1): len(words)}
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 6]
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench, block_chars=20).collect()} == set(got)


@pytest.mark.parametrize("period", [4, 5, 6])
def test_decontaminate_regular_substitutions(spark, period):
    words = [f"w{i}" for i in range(40)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    text = " ".join("zzz" if i % period == period - 1 else w for i, w in enumerate(words))
    docs = spark.createDataFrame([(1, text, "en", "s", 1, "")], SCHEMA)
    assert [r.item_id for r in decontaminate.contaminated(docs, bench).collect()] == [1]


# Toxicity.
def test_decoder_restores():
    words = ["idiot", "trash", "loser", "there", "nation", "other", "those"]
    m = sum(toxicity.count_trigrams(" ".join(words * 50).encode()) for _ in range(1)).reshape(32, 32, 32).astype(float)
    two = m.sum(0) + 0.5
    two /= two.sum(1, keepdims=True)
    r = toxicity.Restorer(np.log((m + 5 * two) / (m.sum(2, keepdims=True) + 5)).astype(np.float32))
    for raw, word in (("1d10t", "idiot"), ("tr@$h", "trash"), ("l o s e r", "loser"), ("t.r.a.s.h", "trash"), ("loooser", "loser"), ("TRASH!!", "trash"), ("idiot###", "idiot"), ("!", "")):
        assert (word in r.words(raw)) if word else r.words(raw) == set()


def test_decoder_parts_words():
    words = ["you", "are", "a", "stupid", "person", "die", "now", "trash", "there", "nation"]
    m = toxicity.count_trigrams(" ".join(words * 50).encode()).reshape(32, 32, 32).astype(float)
    two = m.sum(0) + 0.5
    two /= two.sum(1, keepdims=True)
    r = toxicity.Restorer(np.log((m + 5 * two) / (m.sum(2, keepdims=True) + 5)).astype(np.float32))
    for raw, expected in (
        ("you are a s t u p i d person", {"you", "are", "a", "stupid", "person"}), ("y o u a r e s t u p i d", {"you", "are", "stupid"}), ("(s t u p i d!)", {"stupid"}), ("d i e", {"die"}),
        ("tra" + "s" * 60 + "h", {"trash"}), ("y.o.u.-.a.r.e.-.s.t.u.p.i.d.-.p.e.r.s.o.n.-.n.o.w", {"you", "are", "stupid", "person", "now"}),
    ):
        assert expected <= r.words(raw), (raw, r.words(raw))
        assert not any(len(w) > 6 for w in r.words(raw) if w.isalpha() and len(w) < 40), raw


def scored(name, spark):
    docs, labels = common.table(spark, SF.replace("0.001", "0.01"), "documents"), common.table(spark, SF.replace("0.001", "0.01"), "labels")
    return docs, labels, {r.doc_id: r for r in QUERIES[name](spark, SF.replace("0.001", "0.01")).collect()}


@pytest.mark.parametrize(("name", "label", "least"), [("op1_quality", "quality", 0.9), ("op10_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    docs, labels, rows = scored(name, spark)
    assert len(rows) == docs.count()
    y = {r.doc_id: r[label] for r in labels.collect()}
    test = [i for i in y if held(i) == 1]
    assert all(rows[i].held_out == (held(i) == 1) and 0 <= rows[i].score <= 1 for i in rows)
    assert np.mean([rows[i].predicted == y[i] for i in test]) >= least


def test_language_held_out(spark):
    docs = common.table(spark, SF, "documents")
    rows = {r.doc_id: r for r in QUERIES["op3_language_id"](spark, SF).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert np.mean([rows[i].lang_pred == x for i, x in truth.items() if held(i) == 1]) >= 0.97


def test_models_on_awkward_rows(spark, awkward):
    labels = spark.createDataFrame([(2, 1, 0), (3, 0, 1), (4, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for m in (quality, toxicity):
        rows = m.score(awkward, m.fit(awkward, labels)).collect()
        assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows)
    rows = language_id.score(awkward, language_id.fit(awkward)).collect()
    assert len(rows) == len(AWKWARD) and {r.doc_id: r.lang_pred for r in rows}[5] == "und"
