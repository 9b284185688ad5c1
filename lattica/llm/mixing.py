"""Mixing sources to target weights, in DataFrame functions only.

Documents hang on a tree domain - language - source. A token budget is handed down the tree by the
weights of siblings; a node never gets more than its leaves can give (``max_epochs`` times their
tokens), and what one sibling can't take goes to the other siblings by their weights. As every
node's own target is capped by what its subtree can give, a shortage leaves a family only when all
its members are full: siblings come before ancestors. Each leaf then gets whole epochs, and of one
more epoch the prefix, in that epoch's seeded order, whose tokens fit the rest.

Scale: a document is read and counted once and kept as a short row. A leaf's prefix isn't found by
sorting the leaf: tokens are summed by 4096 ranges of the seeded order, the range in which the rest
runs out is found from those sums, and only that range's documents are ordered, so that a leaf with
a third of all rows needs no task that holds it.

Defined results: null lang or source is ''; a document without words takes no tokens and is chosen
with its place in the order; rows that repeat a doc_id stand at one place and are chosen together; a
leaf whose siblings' weights are all zero gets nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import WORD_SEP, Written, table

LANG_WEIGHTS = {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0}
DOMAINS = 4
LEVELS = ("domain", "lang", "source")
RANGE_DIGITS = 3


def default_domain() -> Column:
    """``documents`` has no domain column: sources are dealt to four by the first digit of their md5."""
    digit = F.conv(F.substring(F.md5(F.coalesce(F.col("source"), F.lit("")).cast("binary")), 1, 1), 16, 10)
    return F.concat(F.lit("d"), (digit.cast("int") % DOMAINS).cast("string"))


def weight_of(level: str, weights: dict[str, dict[str, float]]) -> Column:
    """The weight of a node by its name; names that aren't given weigh 1."""
    out = F.lit(1.0)
    for name, w in sorted(weights.get(level, {}).items()):
        out = F.when(F.col(level) == name, F.lit(float(w))).otherwise(out)
    return out


def share_out(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """From target (of the parent), cap and w to ``got``: target by weights, no node above its cap.

    In the order of cap / w the full nodes come first; a node is full if its cap is at most its share
    of what the nodes before it leave.
    """
    before = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("w"), "cap", "name").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parent)
    n = nodes.filter("w > 0")
    n = n.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("w_left", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    n = n.withColumn("full", F.col("cap") * F.col("w_left") <= F.col("w") * (F.col("target") - F.col("cap_before")))
    n = n.withColumn("cap_full", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(whole)).withColumn("w_open", F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(whole))
    # The small term keeps sums of weights from rounding a whole number of tokens down.
    got = F.when(F.col("full"), F.col("cap")).otherwise(F.floor(F.col("w") * (F.col("target") - F.col("cap_full")) / F.col("w_open") + 1e-6))
    return n.withColumn("got", F.greatest(got.cast("long"), F.lit(0).cast("long")))


def budgets(leaves: DataFrame, budget_share: float, max_epochs: int, weights: dict[str, dict[str, float]]) -> DataFrame:
    """domain, lang, source, avail of the leaves to these and ``budget``."""
    caps = leaves.withColumn("cap", F.col("avail") * max_epochs)
    up = {3: caps}
    for k in (2, 1, 0):
        up[k] = up[k + 1].groupBy(*LEVELS[:k]).agg(F.sum("cap").alias("cap"), F.sum("avail").alias("avail"))
    root = up[0].select(F.lit(1).alias("all"), F.least(F.floor(F.lit(budget_share) * F.col("avail") + 1e-6).cast("long"), F.col("cap")).alias("target"))
    # The root is one row, which every domain joins; below it children join their parents.
    down = None
    for k in (1, 2, 3):
        level = LEVELS[k - 1]
        parents = root if k == 1 else down.select("all", *LEVELS[: k - 1], F.col("got").alias("target"))
        nodes = up[k].withColumn("all", F.lit(1)).join(parents, ["all", *LEVELS[: k - 1]])
        nodes = nodes.withColumn("w", weight_of(level, weights)).withColumn("name", F.col(level))
        down = share_out(nodes, list(LEVELS[: k - 1]) or ["all"])
    return down.select(*LEVELS, "avail", F.col("got").alias("budget"))


def mix(docs: DataFrame, *, budget_share: float = 0.6, max_epochs: int = 2, weights: dict[str, dict[str, float]] | None = None, domain: Column | None = None, seed: str = "mix") -> DataFrame:
    """The chosen documents: doc_id, domain, lang, source, n_tokens, epochs (times it is used), budget (of its leaf)."""
    weights = {"lang": LANG_WEIGHTS} if weights is None else weights
    words = F.size(F.array_remove(F.split(F.coalesce(F.col("text"), F.lit("")), WORD_SEP), ""))
    rows = docs.select(
        "doc_id",
        (default_domain() if domain is None else domain).alias("domain"),
        F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"),
        words.cast("long").alias("n_tokens"),
    )
    rows = Written(rows, "mix").read()
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("avail"))
    plan = budgets(leaves, budget_share, max_epochs, weights).filter("avail > 0")
    plan = plan.withColumn("whole", F.floor(F.col("budget") / F.col("avail")).cast("long")).withColumn("rest", F.expr("budget - whole * avail"))
    # Written, the plan of the leaves has a known size: small it is broadcast, else joined by a shuffle.
    plan = Written(plan, "plan").read()
    d = rows.join(plan, list(LEVELS))
    d = d.withColumn("key", F.md5(F.concat_ws(":", F.lit(seed), (F.col("whole") + 1).cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")))
    d = d.withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    sums = d.groupBy(*LEVELS, "range").agg(F.sum("n_tokens").alias("tokens"), F.first("rest").alias("rest"))
    upto = Window.partitionBy(*LEVELS).orderBy("range")
    sums = sums.withColumn("before", F.sum("tokens").over(upto) - F.col("tokens"))
    cut = sums.filter("before <= rest and before + tokens > rest").groupBy(*LEVELS).agg(F.min("range").alias("cut"), F.min_by("before", "range").alias("before"))
    d = d.join(Written(cut, "cut").read(), list(LEVELS), "left")
    # Only the range in which the rest runs out is put in order.
    edge = d.filter("range = cut").withColumn("upto", F.sum("n_tokens").over(Window.partitionBy(*LEVELS).orderBy("key")) + F.col("before"))
    edge = edge.withColumn("more", (F.col("upto") <= F.col("rest")).cast("long")).drop("upto")
    other = d.filter("cut is null or range <> cut").withColumn("more", (F.coalesce(F.col("range") < F.col("cut"), F.lit(True))).cast("long"))
    out = other.unionByName(edge).withColumn("epochs", F.col("whole") + F.when(F.col("rest") > 0, F.col("more")).otherwise(F.lit(0)))
    return out.filter("epochs > 0").select("doc_id", *LEVELS, "n_tokens", "epochs", "budget")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op6: ``documents`` mixed to the default weights at 0.6 of all tokens."""
    return mix(table(spark, sf_dir, "documents"))


def _level_sql(k: int) -> str:
    """The CTE that shares level k's targets out."""
    keys, level = ", ".join(LEVELS[:k]), LEVELS[k - 1]
    part = f"PARTITION BY {', '.join(LEVELS[: k - 1])} " if k > 1 else ""
    weight = "CASE lang WHEN 'en' THEN 4.0 WHEN 'de' THEN 2.0 WHEN 'fr' THEN 2.0 WHEN 'es' THEN 2.0 ELSE 1.0 END::DOUBLE" if level == "lang" else "1.0::DOUBLE"
    up = f"(SELECT {keys}, sum(avail)::BIGINT AS avail, (sum(avail) * 2)::BIGINT AS cap FROM leaves GROUP BY {keys})"
    parent = f"JOIN (SELECT {', '.join(LEVELS[: k - 1])}, got AS target FROM got{k - 1}) USING ({', '.join(LEVELS[: k - 1])})" if k > 1 else "CROSS JOIN root"
    return f"""
n{k} AS (SELECT *, {weight} AS w, {level} AS name FROM {up} {parent}),
b{k} AS (SELECT *, coalesce(sum(cap) OVER o, 0) AS cap_before, sum(w) OVER ({part}) - coalesce(sum(w) OVER o, 0) AS w_left
  FROM n{k} WINDOW o AS ({part}ORDER BY cap / w, cap, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f{k} AS (SELECT *, cap * w_left <= w * (target - cap_before) AS is_full FROM b{k}),
g{k} AS (SELECT *, sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({part}) AS cap_full, sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ({part}) AS w_open FROM f{k}),
got{k} AS (SELECT *, greatest(CASE WHEN is_full THEN cap ELSE floor(w * (target - cap_full) / w_open + 1e-6) END, 0)::BIGINT AS got FROM g{k})"""


def mixing_sql(docs: str = "documents") -> str:
    """DuckDB SQL for mix(docs) with the defaults."""
    return rf"""
WITH d AS (
  SELECT doc_id, 'd' || ((strpos('0123456789abcdef', md5(coalesce(source, ''))[1]) - 1) % 4) AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens
  FROM {docs}
),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS avail FROM d GROUP BY ALL),
root AS (SELECT least(floor(0.6 * sum(avail) + 1e-6)::BIGINT, sum(avail)::BIGINT * 2) AS target FROM leaves),{",".join(map(_level_sql, (1, 2, 3)))},
plan AS (SELECT domain, lang, source, got AS budget, got // avail AS whole, got % avail AS rest FROM got3 WHERE avail > 0),
o AS (
  SELECT d.*, whole, rest, budget,
    sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('mix:' || (whole + 1) || ':' || coalesce(doc_id::VARCHAR, ''))) AS upto
  FROM d JOIN plan USING (domain, lang, source)
)
SELECT doc_id, domain, lang, source, n_tokens, (whole + (rest > 0 AND upto <= rest)::BIGINT)::BIGINT AS epochs, budget
FROM o WHERE whole + (rest > 0 AND upto <= rest)::BIGINT > 0
"""


SQL = mixing_sql()
