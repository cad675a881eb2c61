"""Mixing sources to target weights: hierarchical token budgets over domain, language and source.

A budget is divided at the root among domains, in each domain among languages, in each language among
sources, in proportion to weights.  What a node can supply is its leaves' tokens times ``max_epochs``.
Dividing with those capacities known, a level at a time from the root, redistributes a shortage among
siblings first and reaches an ancestor's siblings only when a whole subtree falls short.  A leaf then
takes whole epochs and a token-prefix of one more, each epoch in its own seeded order.

All DataFrame operations.  A leaf's prefix is found from token sums of hash buckets; only the bucket in
which the budget ends is ordered row by row, so a leaf with a third of all rows stays spread out.

Defined results: null text has no tokens; null language or source is the value 'none'; a row without an id
stands in an epoch's order by its text; a document without tokens is never selected; a text of any length is counted
whole; other columns are not read, whatever their names; repeated ids are separate rows that tie in order (by text, then source
and language; rows equal in all of these stand or fall together); an empty table selects nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Weights of nodes by name; a node not named has weight 1.
DOMAIN_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}
LANG_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 2}
SOURCE_WEIGHTS: dict[str, int] = {}
#: The share of the corpus' tokens that the mix is to hold, in thousandths.
BUDGET_PERMILLE = 600
MAX_EPOCHS = 2
SEED = "mix"
#: Rows that a bucket has on average.
BUCKET_ROWS = 256


def domain_of(source: Column) -> Column:
    """Sources belong to four domains by the number their name ends in, 'dother' without one."""
    n = F.regexp_extract(source, "([0-9]+)$", 1)
    return F.when(n == "", F.lit("dother")).otherwise(F.concat(F.lit("d"), (F.substring(n, -1, 1).cast("int") % 4).cast("string")))


def weight_of(name: Column, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for k, v in sorted(weights.items()):
        out = F.when(name == k, F.lit(v)).otherwise(out)
    return out.cast("double")


def fill(nodes: DataFrame, parent: list[str], budget: str, out: str) -> DataFrame:
    """Divide each parent's budget among its children by weight w, none above its capacity cap.

    With children in the order of cap / w, the k-th is filled if its ratio is at most what is left for
    a unit of weight when those before it are filled; the rest share what is left by weight.
    """
    w = Window.partitionBy(*parent).orderBy("ratio", "node").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parent)
    x = nodes.withColumn("ratio", F.col("cap") / F.col("w"))
    x = x.withColumn("cap_before", F.coalesce(F.sum("cap").over(w), F.lit(0))).withColumn("w_left", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(w), F.lit(0.0)))
    x = x.withColumn("unit", (F.col(budget) - F.col("cap_before")) / F.col("w_left"))
    x = x.withColumn("full", F.col("ratio") <= F.col("unit"))
    x = x.withColumn("share", F.min(F.when(~F.col("full"), F.struct("ratio", "node", "unit"))).over(whole)["unit"])
    got = F.when(F.col("full"), F.col("cap")).otherwise(F.floor(F.col("share") * F.col("w") + F.lit(1e-6)).cast("long"))
    return x.withColumn(out, F.least(got, F.col("cap"))).drop("ratio", "cap_before", "w_left", "unit", "full", "share", "node", "w", "cap")


def leaf_budgets(leaves: DataFrame, budget_permille: int = BUDGET_PERMILLE, max_epochs: int = MAX_EPOCHS, domain_weights=DOMAIN_WEIGHTS, lang_weights=LANG_WEIGHTS, source_weights=SOURCE_WEIGHTS) -> DataFrame:
    """(domain, lang, source, tokens, take): what each leaf of (domain, lang, source, tokens) is to give."""
    total = leaves.groupBy(F.lit(1).alias("one")).agg(F.floor(F.sum("tokens") * F.lit(budget_permille) / F.lit(1000)).cast("long").alias("b0"))
    d = leaves.groupBy("domain").agg((F.sum("tokens") * max_epochs).alias("cap")).withColumn("one", F.lit(1)).join(total, "one")
    d = fill(d.withColumn("node", F.col("domain")).withColumn("w", weight_of(F.col("domain"), domain_weights)), ["one"], "b0", "b1").select("domain", "b1")
    g = leaves.groupBy("domain", "lang").agg((F.sum("tokens") * max_epochs).alias("cap")).join(d, "domain")
    g = fill(g.withColumn("node", F.col("lang")).withColumn("w", weight_of(F.col("lang"), lang_weights)), ["domain"], "b1", "b2").select("domain", "lang", "b2")
    s = leaves.withColumn("cap", F.col("tokens") * max_epochs).join(g, ["domain", "lang"])
    return fill(s.withColumn("node", F.col("source")).withColumn("w", weight_of(F.col("source"), source_weights)), ["domain", "lang"], "b2", "take").select("domain", "lang", "source", "tokens", "take")


def mix(docs: DataFrame, seed: str = SEED, bucket_rows: int = BUCKET_ROWS, max_epochs: int = MAX_EPOCHS, **weights) -> DataFrame:
    """(doc_id, domain, lang, source, epoch, n_tokens) of every selection; a document can be in several epochs.

    Epochs count from 0.  In an epoch a leaf's documents stand by md5(seed, epoch, doc_id); the last
    epoch takes those whose tokens, with all before them, fit what is left of the leaf's budget.
    """
    leaf = ["domain", "lang", "source"]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("none")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("none")).alias("source"),
        F.size(F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("[^ \\x09-\\x0D]+"), F.lit(0))).cast("long").alias("n_tokens"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("tie"),
    )
    rows = stage(rows.where("n_tokens > 0").withColumn("domain", domain_of(F.col("source"))), "leaves")
    stats = rows.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    stats = stage(stats, "leaf_stats")
    plan = leaf_budgets(stats.select(*leaf, "tokens"), max_epochs=max_epochs, **weights).join(stats.select(*leaf, "n"), leaf)
    plan = stage(
        plan.where("take > 0").withColumn("epochs", F.expr("take div tokens").cast("int")).withColumn("rest", F.expr("take % tokens")).withColumn("buckets", F.greatest(F.lit(1), F.expr(f"n div {bucket_rows}")).cast("long")),
        "leaf_plan",
    )
    # A copy of a row for each epoch that its leaf reaches; the leaf side is staged, so AQE can split a hot leaf.
    x = rows.join(plan.select(*leaf, "epochs", "rest", "buckets"), leaf)
    x = x.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs"))))
    x = x.withColumn("key", F.md5(F.concat_ws(":", F.lit(seed), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("none:"), "tie"))).cast("binary")))
    x = x.withColumn("bucket", F.expr("(cast(conv(substring(key, 1, 7), 16, 10) as bigint) * buckets) div 268435456"))
    whole = x.where("epoch < epochs").select("doc_id", *leaf, "epoch", "n_tokens")
    last = stage(x.where("epoch = epochs AND rest > 0").select("doc_id", *leaf, "epoch", "n_tokens", "tie", "rest", "bucket", "key"), "last_epoch")
    sums = last.groupBy(*leaf, "rest", "bucket").agg(F.sum("n_tokens").alias("t"))
    # Prefix sums in two steps: over blocks of 1024 buckets, then in each block.
    sums = stage(sums.withColumn("block", F.expr("bucket div 1024")), "bucket_sums")
    blocks = sums.groupBy(*leaf, "block").agg(F.sum("t").alias("bt"))
    before = F.coalesce(F.sum("bt").over(Window.partitionBy(*leaf).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("block_before", before).drop("bt")
    inside = F.coalesce(F.sum("t").over(Window.partitionBy(*leaf, "block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edges = sums.withColumn("inside", inside).join(blocks, [*leaf, "block"]).withColumn("bucket_before", F.col("block_before") + F.col("inside"))
    cut = edges.where("bucket_before < rest").groupBy(*leaf).agg(F.max(F.struct("bucket", "bucket_before")).alias("c"))
    cut = stage(cut.select(*leaf, F.col("c.bucket").alias("cut"), F.col("c.bucket_before").alias("cut_before")), "leaf_cut")
    y = last.join(cut, leaf)
    below = y.where("bucket < cut").select("doc_id", *leaf, "epoch", "n_tokens")
    running = F.sum("n_tokens").over(Window.partitionBy(*leaf, "cut_before").orderBy("key", "tie").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    at = y.where("bucket = cut").withColumn("upto", running + F.col("cut_before")).where("upto <= rest").select("doc_id", *leaf, "epoch", "n_tokens")
    return whole.unionByName(below).unionByName(at)


def _case(column: str, weights: dict[str, int]) -> str:
    whens = " ".join(f"WHEN {column} = '{k}' THEN {v}.0" for k, v in sorted(weights.items()))
    return f"CAST(CASE {whens} ELSE 1.0 END AS DOUBLE)" if whens else "CAST(1.0 AS DOUBLE)"


def _fill_sql(name: str, source: str, parent: str, budget: str, node: str, out: str, carry: str) -> str:
    before = f"OVER (PARTITION BY {parent} ORDER BY cap / w, {node} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
{name}_a AS (SELECT *, cap / w AS ratio, ({budget} - COALESCE(SUM(cap) {before}, 0)) / (SUM(w) OVER (PARTITION BY {parent}) - COALESCE(SUM(w) {before}, 0.0)) AS unit FROM {source}),
{name}_b AS (SELECT *, MIN(CASE WHEN ratio > unit THEN {{'r': ratio, 'n': {node}, 'u': unit}} END) OVER (PARTITION BY {parent}) AS s FROM {name}_a),
{name} AS (SELECT {carry}, CAST(LEAST(CASE WHEN ratio <= unit THEN cap ELSE CAST(FLOOR(s.u * w + 1e-6) AS BIGINT) END, cap) AS BIGINT) AS {out} FROM {name}_b)"""


def oracle(table: str = "documents") -> str:
    """DuckDB SQL for mix() with its defaults: plain running sums in place of buckets."""
    return f"""
WITH t0 AS (SELECT doc_id, COALESCE(lang, 'none') AS lang, COALESCE(source, 'none') AS source, COALESCE(text, '') AS text FROM {table}),
r AS (SELECT doc_id, lang, source, CASE WHEN regexp_extract(source, '([0-9]+)$', 1) = '' THEN 'dother' ELSE 'd' || CAST(CAST(right(source, 1) AS INT) % 4 AS VARCHAR) END AS domain,
  CAST(len(regexp_extract_all(text, '[^ \\x09-\\x0D]+')) AS BIGINT) AS n_tokens, md5(text) AS tie FROM t0),
rows_ AS (SELECT * FROM r WHERE n_tokens > 0),
leaves AS (SELECT domain, lang, source, CAST(SUM(n_tokens) AS BIGINT) AS tokens FROM rows_ GROUP BY ALL),
total AS (SELECT CAST(FLOOR(SUM(tokens) * {BUDGET_PERMILLE} / 1000) AS BIGINT) AS b0 FROM leaves),
d0 AS (SELECT 1 AS one, domain, CAST(SUM(tokens) * {MAX_EPOCHS} AS BIGINT) AS cap, {_case("domain", DOMAIN_WEIGHTS)} AS w, b0 FROM leaves, total GROUP BY domain, b0),
{_fill_sql("d1", "d0", "one", "b0", "domain", "b1", "domain")},
g0 AS (SELECT domain, lang, CAST(SUM(tokens) * {MAX_EPOCHS} AS BIGINT) AS cap, {_case("lang", LANG_WEIGHTS)} AS w, b1 FROM leaves JOIN d1 USING (domain) GROUP BY domain, lang, b1),
{_fill_sql("g1", "g0", "domain", "b1", "lang", "b2", "domain, lang")},
s0 AS (SELECT domain, lang, source, tokens, tokens * {MAX_EPOCHS} AS cap, {_case("source", SOURCE_WEIGHTS)} AS w, b2 FROM leaves JOIN g1 USING (domain, lang)),
{_fill_sql("s1", "s0", "domain, lang", "b2", "source", "take", "domain, lang, source, tokens")},
plan AS (SELECT *, CAST(take // tokens AS INT) AS epochs, take % tokens AS rest FROM s1 WHERE take > 0),
x AS (SELECT rows_.*, epochs, rest, CAST(e.i AS INT) AS epoch FROM rows_ JOIN plan USING (domain, lang, source), range(0, {MAX_EPOCHS + 1}) e(i) WHERE e.i <= epochs),
k AS (SELECT *, md5('{SEED}:' || CAST(epoch AS VARCHAR) || ':' || COALESCE(CAST(doc_id AS VARCHAR), 'none:' || tie)) AS key FROM x),
y AS (SELECT *, SUM(n_tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY key, tie RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM k)
SELECT doc_id, domain, lang, source, epoch, n_tokens FROM y WHERE epoch < epochs OR upto <= rest
"""
