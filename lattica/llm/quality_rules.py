"""Quality rules with cross-document line frequency, in DataFrame functions only.

Each document's words, symbols, repeated lines and repeated 3-word windows are measured inside the
row. Lines are then normalised (lower case, white space collapsed) and hashed; the documents of a
host that hold a line are counted, lines above the host's limit are removed from the text (the others
are joined again in their order), and a document that loses more than ``max_removed`` of its word characters is rejected as depleted.

Scale: texts are read once; each leaves a short row of its measures and its lines' hashes and sizes, which
is written. Counting shuffles a hash and an id for each line, spread by line and document before they are
counted by line, so that a line that a third of all documents share has no task of its own; the join back
to the lines is an equi-join on (host, line) that adaptive execution splits where a line is hot. Texts move
only where they are asked for, to meet the places of their removed lines.

Defined results: a null or empty text has no words or lines (all counts 0, ``base_failed`` true);
a null source is the host ''; rows that share a doc_id count as one document of a line and get results of
their own, rows without doc_id aren't counted; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import WORD_SEP, Written, table

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"


def _letters(c: Column) -> Column:
    return F.length(F.translate(c, WHITE, "")).cast("long")


def _lines(text: Column) -> Column:
    """The \\n-split lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, host, text_hash, text and the base measures of each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", F.coalesce(F.col("source"), F.lit("")).alias("host"), "text", text.alias("t"))
    d = d.select("*", F.array_remove(F.split("t", WORD_SEP), "").alias("w"), _lines(F.col("t")).alias("ln"))
    d = d.select(
        "doc_id",
        "host",
        F.xxhash64("t").alias("text_hash"),
        "text",
        F.size("w").cast("long").alias("n_words"),
        _letters(F.col("t")).alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("ln") - F.size(F.array_distinct("ln"))).cast("long").alias("n_dup_lines"),
        F.transform(
            F.slice("w", 1, F.greatest(F.size("w") - 2, F.lit(0))),
            lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)),
        ).alias("h"),
    )
    # Windows found more than once, by sorting (hash, position): only for texts that have any.
    some = F.size(F.array_distinct("h")) < F.size("h")
    d = d.withColumn("s", F.when(some, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    again = lambda x, i: F.coalesce(F.get("s", i + 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("s", i - 1)["h"] == x["h"], F.lit(False))
    d = d.withColumn("p", F.sort_array(F.transform(F.filter("s", again), lambda x: x["i"])))
    covered = F.transform("p", lambda x, i: F.least(F.lit(3), x - F.coalesce(F.get("p", i - 1), x - 3)))
    n_repeat = F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).cast("long")
    return d.withColumn("n_repeat_words", n_repeat).drop("h", "s", "p")


def line_keys(text: Column) -> Column:
    """For each \\n-split line its word characters and, if it has any, the hash of its normal form."""
    norm = lambda x: F.xxhash64(F.lower(F.trim(F.regexp_replace(x, WORD_SEP, " "))))
    sized = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), _letters(x).cast("int").alias("chars")))
    return F.transform(sized, lambda x: F.struct(F.when(x["chars"] > 0, norm(x["line"])).alias("key"), x["chars"].alias("chars")))


def verdicts(docs: DataFrame, *, min_docs: int = 20, host_share: float = 0.002, max_removed: float = 0.5, min_words: int = 50) -> DataFrame:
    """doc_id, host, text_hash, the measures, ``places`` of the lines above the limit, ``removed_chars`` of these, base_failed and kept of each document.

    A line is above the limit if more than ``greatest(min_docs, host_share * documents of the host)``
    documents of its host hold it. Texts are read once; what follows works on short rows written for it.
    """
    m = measures(docs).withColumn("lines", line_keys(F.coalesce("text", F.lit("")))).drop("text").withColumn("row", F.monotonically_increasing_id())
    m = Written(m, "lines").read()
    # Rows that share a doc_id count as one document.
    held = m.select("host", "doc_id", F.explode(F.array_distinct(F.transform("lines", lambda x: x["key"]))).alias("line")).filter("line is not null")
    counts = held.groupBy("host", "line").agg(F.count_distinct("doc_id").alias("n_docs"))
    hosts = m.groupBy("host").agg(F.greatest(F.lit(float(min_docs)), F.lit(host_share) * F.count("*")).alias("most"))
    # Few lines pass min_docs, so the join with each host's own limit sees little.
    frequent = counts.filter(F.col("n_docs") > min_docs).join(hosts, "host").filter(F.col("n_docs") > F.col("most")).select("host", "line")
    lines = m.select("host", "row", F.posexplode("lines").alias("i", "x")).select("host", "row", "i", F.col("x.key").alias("line"), F.col("x.chars").alias("chars")).filter("line is not null")
    gone = lines.join(frequent, ["host", "line"], "left_semi").groupBy("row").agg(F.sum("chars").alias("lost"), F.collect_set("i").alias("places"))
    out = m.drop("lines").join(gone, "row", "left").withColumn("removed_chars", F.coalesce("lost", F.lit(0)).cast("long")).drop("row", "lost")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    depleted = F.col("removed_chars") > F.lit(max_removed) * F.col("word_chars")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def without_lines(text: Column, places: Column) -> Column:
    """The text without the lines at these places (from 0)."""
    lines = F.split(text, "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places)
    return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")


def quality_rules(docs: DataFrame, **limits: float) -> DataFrame:
    """The verdicts (see there for the limits) and each document's text without the lines above the limit."""
    v = verdicts(docs, **limits).dropDuplicates(["doc_id", "host", "text_hash"])  # rows that repeat a document have the same
    d = docs.select(F.col("doc_id").alias("_id"), F.coalesce("source", F.lit("")).alias("_host"), "text")
    d = d.withColumn("_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    on = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_host") == F.col("host")) & (F.col("_hash") == F.col("text_hash"))
    out = d.join(v, on).withColumn("text", F.when(F.col("places").isNull(), F.col("text")).otherwise(without_lines(F.col("text"), F.col("places"))))
    return out.drop("_id", "_host", "_hash", "places")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op8: quality_rules over all of ``documents``."""
    out = verdicts(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_chars")


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln
  FROM documents
), m AS (
  SELECT doc_id, host, w, ln, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines
  FROM d
), win AS (
  SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS g
  FROM (SELECT doc_id, w, unnest(range(1, n_words - 1)) AS i FROM m)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, host, x, lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))) AS line
  FROM (SELECT doc_id, host, unnest(ln) AS x FROM m)
), frequent AS (
  SELECT host, line FROM lines GROUP BY host, line
  HAVING count(DISTINCT doc_id) > (SELECT greatest(20.0, 0.002 * count(*)) FROM d WHERE d.host = lines.host)
), removed AS (
  SELECT doc_id, sum(length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')))::BIGINT AS n
  FROM lines JOIN frequent USING (host, line) GROUP BY doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
       n_words < 50 OR 100 * coalesce(c.n, 0) > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * coalesce(c.n, 0) > 50 * n_words) AND coalesce(r.n, 0) <= 0.5 * word_chars AS kept,
       coalesce(r.n, 0)::BIGINT AS removed_chars
FROM m LEFT JOIN covered c USING (doc_id) LEFT JOIN removed r USING (doc_id)
"""
