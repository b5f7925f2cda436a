"""Mixing sources to target weights by hierarchical budgeting (DataFrame
operations only).

The levels (for example domain, language, source) form a tree whose leaves
hold documents.  A token budget at the root is handed down level by level: a
node's budget is shared among its children in proportion to their weights, no
child gets more than its subtree can give (its tokens times the epochs
allowed), and what a child cannot take goes to its siblings by the same rule.
As a node never gets more than its subtree can give, a shortage leaves a
subtree only when the whole subtree is used up: siblings come before
ancestors.  Budgets are whole tokens, rounded down (under one token a child).

A leaf's budget buys whole epochs and then the prefix of one more: documents in
the order of md5(seed-epoch-id), as long as their running total fits.

Scale: texts are read once for their token counts.  A running total over a
leaf is not one task's window: a leaf's documents are dealt into buckets of
about BUCKET documents by the leading digits of their md5, totals of buckets
are summed up, and only the order inside a bucket needs its rows together; a
leaf with a third of all rows is many buckets.  Windows over siblings run on
the tree's nodes, not on documents.

Edge cases: null levels are their own value, shown as ''; a null or empty text
has no tokens and follows its place in the order; nodes without a given weight
weigh 1, nodes of weight 0 get nothing; rows with a null id are left out; rows
that repeat an id are separate documents, told apart by their token count at
most (equal rows are drawn together); an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, unused_name

BUCKET = 4096
SEED = 17
SPACE = "[ \\t\\n\\x0B\\f\\r]+"


def token_count(text: Column) -> Column:
    """White-space separated words of a whole text."""
    return F.coalesce(F.size(F.filter(F.split(text, SPACE), lambda w: w != "")), F.lit(0)).cast("long")


def _weight(levels: list[str], weights: Mapping[tuple, float]) -> Column:
    """Weight of a node given the values on its path: an exact path first,
    then its last value at that level (('*', ..., value)), else 1."""
    depth = len(levels)
    out = F.lit(1.0)
    for path, w in weights.items():
        if len(path) == depth:
            hit = F.lit(True)
            for level, value in zip(levels, path):
                if value != "*":
                    hit = hit & (F.col(level) == value)
            out = F.when(hit, F.lit(float(w))).otherwise(out)
    return out


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: Mapping[tuple, float], budget: Column, max_epochs: int) -> DataFrame:
    """``leaves``: level columns and tokens.  Adds budget (long) to each."""
    # what a subtree can give, leaving out nodes of weight 0 on the way up
    nodes = {len(levels): leaves.select(*levels, (F.col("tokens") * max_epochs).alias("cap"))}
    for d in range(len(levels) - 1, -1, -1):
        below = nodes[d + 1].withColumn("w", _weight(levels[:d + 1], weights)).withColumn("cap", F.when(F.col("w") > 0, F.col("cap")).otherwise(F.lit(0).cast("long")))
        nodes[d + 1] = below
        nodes[d] = below.groupBy(*levels[:d]).agg(F.sum("cap").alias("cap"))
    given = nodes[0].select(F.least(F.floor(budget).cast("long"), F.col("cap")).alias("budget"))
    for d in range(1, len(levels) + 1):
        path, parent = levels[:d], levels[:d - 1]
        if parent:
            up = given.select(*[F.col(c).alias(f"__{c}") for c in parent], F.col("budget").alias("all"))
            on = [F.col(c) == F.col(f"__{c}") for c in parent]
            rows = nodes[d].join(up, on, "left").select(*path, "cap", "w", "all")
        else:
            rows = nodes[d].crossJoin(given.withColumnRenamed("budget", "all"))  # one row
        by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
        order = by.orderBy(F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(F.lit(-1.0)), *path[-1:])
        rows = (rows.withColumn("k", F.row_number().over(order))
                .withColumn("used", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
                .withColumn("left_w", F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
                .withColumn("level", F.try_divide((F.col("all") - F.col("used")).cast("double"), F.col("left_w")))
                .withColumn("full", (F.col("w") <= 0) | (F.col("cap").cast("double") <= F.col("w") * F.col("level")))
                .withColumn("share", F.min(F.when(~F.col("full"), F.struct("k", "level"))).over(by)["level"]))
        given = rows.select(*path, F.when(F.col("full"), F.col("cap")).otherwise(F.floor(F.col("w") * F.col("share"))).cast("long").alias("budget"))
    return given


def draw(docs: DataFrame, levels: list[str], weights: Mapping[tuple, float], budget_share: float, max_epochs: int, seed: int = SEED) -> DataFrame:
    """How often each document is drawn: doc_id, the levels, n_tokens, copies
    (0: not drawn).  The budget is ``budget_share`` of all tokens."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in levels],
                      token_count(F.col("text").cast("string")).alias("n_tokens")).filter("doc_id is not null")
    src = materialise(src, "doc_tokens")
    leaves = src.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs"))
    leaves = materialise(leaves, "leaves")
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    budgets = leaf_budgets(leaves, levels, weights, F.lit(float(total) * budget_share), max_epochs)
    plan = (leaves.join(budgets, levels, "left")
            .withColumn("epochs", F.when(F.col("tokens") > 0, F.least(F.floor(F.col("budget") / F.col("tokens")), F.lit(max_epochs))).otherwise(F.lit(0)).cast("long"))
            .select(*levels, "epochs", (F.col("budget") - F.col("epochs") * F.col("tokens")).alias("rest"),
                    F.greatest(F.ceil(F.col("n_docs") / BUCKET), F.lit(1)).cast("long").alias("buckets")))
    plan = materialise(plan, "mix_plan")
    digest = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("epochs").cast("string"), F.col("doc_id").cast("string")))
    dealt = (src.join(plan, levels).withColumn("h", digest)
             .withColumn("bucket", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / float(1 << 32) * F.col("buckets")).cast("long")))
    totals = dealt.groupBy(*levels, "bucket").agg(F.sum("n_tokens").alias("t"))
    before = totals.select(*levels, "bucket", F.coalesce(F.sum("t").over(
        Window.partitionBy(*levels).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy(*levels, "bucket").orderBy("h", "n_tokens"))
    running = dealt.withColumn("inside", inside).join(before, [*levels, "bucket"])
    fits = (F.col("rest") > 0) & (F.col("before") + F.col("inside") <= F.col("rest"))
    return running.select("doc_id", *levels, "n_tokens", (F.col("epochs") + fits.cast("long")).alias("copies"))


def take(docs: DataFrame, drawn: DataFrame, max_epochs: int) -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as ``drawn``
    (a result of ``draw``) says for its id and token count."""
    docs = docs.filter(F.col("doc_id").isNotNull())
    id_, tokens, copies = (unused_name(docs, c) for c in ("drawn_id", "drawn_tokens", "drawn_copies"))
    times = drawn.groupBy(F.col("doc_id").alias(id_), F.col("n_tokens").alias(tokens)).agg(F.max("copies").alias(copies))
    same = (F.col("doc_id").cast("long") == F.col(id_)) & (token_count(F.col("text").cast("string")) == F.col(tokens))
    if max_epochs == 1:
        return docs.join(times.filter(F.col(copies) > 0), same, "left_semi")
    out = docs.join(times.filter(F.col(copies) > 0), same)
    return out.withColumn(copies, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).drop(id_, tokens, copies)


def mix(docs: DataFrame, levels: list[str], weights: Mapping[tuple, float], budget_share: float, max_epochs: int, seed: int = SEED) -> DataFrame:
    """The drawn documents with all their columns, each as often as drawn."""
    return take(docs, draw(docs, levels, weights, budget_share, max_epochs, seed), max_epochs)
