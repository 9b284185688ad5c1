"""Personal data: patterns propose spans, checksums confirm them, context words adjust their score.

E-mail addresses, IPv4 addresses, payment cards (Luhn) and international phone numbers are the base
kinds. IBANs (mod-97), US social security numbers and phone numbers in national form are proposed
too and kept when their score, raised or lowered by nearby words, reaches ``threshold``; they never
displace a base span. ``redact`` replaces every span by a mark of its kind.

Each row is worked on alone, in Arrow batches: no shuffle, memory bounded by a batch. The patterns
can't backtrack over long runs of digits or letters, so time is linear in the text.

Defined results: a null or empty text has no spans (``redact`` leaves null null); repeated rows give
equal results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import map_batches, table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "local_phone")

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DIGIT = re.compile(r"[0-9]")
#: A match can only start where a run of digits does, as the rest of a run fails like the run.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){11,}")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])")

#: Scores without context, and words that raise or lower them.
SCORES = {"email": 0.95, "ip": 0.8, "card": 0.9, "phone": 0.8, "iban": 0.9, "ssn": 0.4, "local_phone": 0.4}
FOR = {
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "mastercard", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto"),
    "ssn": ("ssn", "social", "security"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax"),
}
AGAINST = ("version", "order", "invoice", "isbn", "serial", "part")
CONTEXT_CHARS = 40
CONTEXT_WORD = re.compile(r"[a-z]+")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """An IBAN's check: its letters as numbers, its first four characters last, leave 1."""
    text = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in text)) % 97 == 1


def ibans(text: str) -> list[tuple[int, int]]:
    """From each start the longest run that ends where a group of letters and digits does and passes mod-97; other capitals may follow."""
    out, at = [], 0
    while m := IBAN.search(text, at):
        at = m.start() + 1
        for end in range(m.end(), m.start() + 14, -1):
            if text[end - 1] != " " and not text[end : end + 1].isalnum() and len(code := text[m.start() : end].replace(" ", "")) >= 15 and mod97(code):
                out.append((m.start(), end))
                at = end
                break
    return out


def emails(text: str) -> list[tuple[int, int]]:
    """What the e-mail pattern matches: from each @ back over its local part and forth over its domain."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_SET:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base kinds' spans by start, then kind as listed."""
    out = [(s, 0, e) for s, e in emails(text)]
    if not DIGIT.search(text):  # all other kinds need one
        return [(BASE_KINDS[k], s, e) for s, k, e in out]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 37 and len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return [(BASE_KINDS[k], s, e) for s, k, e in sorted(out)]


def context_score(kind: str, text: str, start: int, end: int) -> float:
    near = set(CONTEXT_WORD.findall(text[max(0, start - CONTEXT_CHARS) : start].lower()) + CONTEXT_WORD.findall(text[end : end + CONTEXT_CHARS].lower()))
    score = SCORES[kind] + 0.3 * bool(near.intersection(FOR.get(kind, ()))) - 0.3 * bool(near.intersection(AGAINST))
    return min(1.0, max(0.0, score))


def find_spans(text: str | None, threshold: float = 0.5) -> tuple[list[tuple[str, int, int]], list[Span]]:
    """The base spans, and these with the proposed ones whose score reaches the threshold."""
    if not text:
        return [], []
    base = base_spans(text)
    if not DIGIT.search(text):
        return base, [Span(k, s, e, context_score(k, text, s, e)) for k, s, e in base]
    spans = [Span(k, s, e, context_score(k, text, s, e)) for k, s, e in base]
    extra = [("iban", s, e) for s, e in ibans(text)]
    if "-" in text:
        extra += [("ssn", m.start(), m.end()) for m in SSN.finditer(text) if m[0][:3] not in ("000", "666") and m[0] < "900" and m[0][4:6] != "00" and m[0][7:] != "0000"]
    extra += [("local_phone", m.start(), m.end()) for m in LOCAL_PHONE.finditer(text)]
    for k, s, e in extra:
        if (score := context_score(k, text, s, e)) >= threshold and all(e <= x.start or s >= x.end for x in spans):
            spans.append(Span(k, s, e, score))
    return base, sorted(spans, key=lambda x: (x.start, KINDS.index(x.kind)))


def redact_text(text: str | None) -> str | None:
    """The text with each span, or run of spans that overlap, replaced by the first one's mark."""
    spans = find_spans(text)[1]
    if not spans:
        return text
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def _joined(spans: list) -> str:
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)


def spans_of(docs: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, all spans, and their scores."""

    def make():
        def rows(ids, texts):
            out = [[] for _ in range(8)]
            for i, t in zip(ids, texts):
                base, spans = find_spans(t, threshold)
                kinds = [b[0] for b in base]
                row = (i, *(kinds.count(k) for k in BASE_KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), [s.score for s in spans])
                for c, v in zip(out, row):
                    c.append(v)
            return out

        return rows

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores array<double>"
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), make, schema)


def redact(docs: DataFrame) -> DataFrame:
    """The documents with their spans replaced by marks; n_chars follows the text, other columns stay."""
    small = docs.select(*docs.columns)
    cols = small.columns
    at = cols.index("text")

    def make():
        def rows(*columns):
            out = list(columns)
            out[at] = [redact_text(t) for t in columns[at]]
            return out

        return rows

    out = map_batches(small, make, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in small.schema))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in cols else out


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op7: the spans of every text of ``documents``."""
    return spans_of(table(spark, sf_dir, "documents"))
