"""Mixing sources to target weights with hierarchical budgets (DataFrame operations only).

Sources form a tree, one column per level.  A token budget is divided from the
root down: the children of a node share its budget by their weights, and a
child takes at most what its sources hold over ``max_epochs`` passes.  What a
child cannot take goes to its siblings first, again by weight; a node's limit
is the sum of its children's, so only what a whole family cannot take reaches
the family's own siblings.  Shares are whole tokens and add up exactly: after
rounding down, the children with room take one more each, in order of name.

A leaf's budget is spent on passes over its documents.  Full passes take every
document; of the last one a prefix is taken: documents in the order of a
seeded hash of (pass, document), the last one in part.  Prefix sums over a
leaf that holds a third of all rows run in two steps, over ranges of the hash
and then within the one range in which the budget ends; the number of ranges
grows with the square root of the rows, so neither step is long.

A token is a run of characters other than space, tab, line feed, vertical tab,
form feed and carriage return; a null text has none, and documents without
tokens are never taken.  A null level is a node named ``(null)``.  Rows with
equal ids are ordered by a hash of the whole row (``row_hash``); rows equal in
every column are interchangeable, and each counts.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from petrel.llm.runtime import fresh, setup, stored

SPACE = r"\x20\x09-\x0D"
#: Leaves up to which their table is broadcast (about 100 bytes each); beyond, Spark joins by shuffle.
BROADCAST_LEAVES = 20_000


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def first_tokens(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th token."""
    pieces = F.split(text, f"(?<=[^{SPACE}])(?=[{SPACE}])")
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def _weight(level: str, weights: dict[str, int]) -> Column:
    out = None
    for value, w in weights.items():        # one flat case, however many values
        out = (F if out is None else out).when(F.col(level) == value, F.lit(w).cast("long"))
    return F.lit(1).cast("long") if out is None else out.otherwise(F.lit(1).cast("long"))


def _share(nodes: DataFrame, parent: list[str], level: str) -> DataFrame:
    """Divide each family's budget ``b`` among its nodes (w, cap): column ``share``.

    In ascending order of cap / w, a node is full if every node up to it can
    be, and the rest still get as much per weight: that is a prefix."""
    nodes = nodes.withColumn("cap", F.when(F.col("w") > 0, F.col("cap")).otherwise(0)).withColumn(
        "w", F.greatest("w", F.lit(1)))
    family = Window.partitionBy(*parent)
    order = family.orderBy(F.col("cap") / F.col("w"), level)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nodes = (nodes.withColumn("upto", F.sum("cap").over(upto))
             .withColumn("after", F.sum("w").over(family) - F.sum("w").over(upto))
             .withColumn("full", F.col("upto") * F.col("w") + F.col("cap") * F.col("after") <= F.col("b") * F.col("w")))
    nodes = (nodes.withColumn("rest", F.col("b") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(family))
             .withColumn("open_w", F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(family)))
    nodes = nodes.withColumn("share", F.when(F.col("full"), F.col("cap"))
                             .otherwise(F.expr("(rest * w) div nullif(open_w, 0)")))
    nodes = nodes.withColumn("over", F.col("rest") - F.sum(F.when(F.col("full"), 0).otherwise(F.col("share"))).over(family))
    place = F.row_number().over(Window.partitionBy(*parent, "full").orderBy(level))
    return nodes.withColumn("place", place).withColumn(
        "share", F.col("share") + F.when(~F.col("full") & (F.col("place") <= F.col("over")), 1).otherwise(0)).drop(
        "upto", "after", "full", "rest", "open_w", "over", "place")


def budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], budget: Column,
            max_epochs: int) -> DataFrame:
    """``leaves`` (levels, n: tokens of one pass) with ``share``, the tokens to take from each."""
    caps = leaves.withColumn("cap", F.col("n") * max_epochs)
    for level in levels:          # what has no weight holds nothing, at any height
        caps = caps.withColumn("cap", F.when(_weight(level, weights.get(level, {})) > 0, F.col("cap")).otherwise(0))
    root = F.lit(0).alias("root")
    above = caps.agg(F.least(budget.cast("long"), F.coalesce(F.sum("cap"), F.lit(0))).alias("b")).select(root, "b")
    for i, level in enumerate(levels):
        parent = ["root", *levels[:i]]
        nodes = caps.select(root, *levels[:i + 1], "cap").groupBy("root", *levels[:i + 1]).agg(F.sum("cap").alias("cap"))
        nodes = nodes.join(above, parent).withColumn("w", _weight(level, weights.get(level, {})))
        above = _share(nodes, parent, level).select(*parent, level, F.col("share").alias("b"))
    return leaves.join(above.drop("root").withColumnRenamed("b", "share"), levels)


def row_hash(docs: DataFrame) -> Column:
    return F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(docs: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], share: tuple[int, int],
                seed: int = 0, max_epochs: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What to take: one row per document and pass: doc_id, row_hash, levels, epoch, n_tokens, take.

    The budget is share[0] / share[1] of all tokens; ``levels`` are columns of
    ``docs`` from the root down, ``weights`` gives whole-number weights by level
    and value (1 where it names none)."""
    spark = docs.sparkSession
    setup(spark)
    named = [F.coalesce(F.col(c).cast("string"), F.lit("(null)")).alias(c) for c in levels]
    thin = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), row_hash(docs).alias("row_hash"), *named,
                              tokens(F.col(text_col)).alias("n_tokens")).where("n_tokens > 0"), "mix-tokens")
    leaves = thin.groupBy(*levels).agg(F.sum("n_tokens").alias("n"))
    total = thin.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).head()
    plan = budgets(leaves, levels, weights, F.lit(total["n"] * share[0] // share[1]), max_epochs)
    plan = stored(plan.withColumn("passes", F.expr("share div n")).withColumn("rest", F.expr("share % n"))
                  .select(*levels, "passes", "rest").where("passes > 0 or rest > 0"), "mix-plan")
    if plan.count() <= BROADCAST_LEAVES:
        plan = F.broadcast(plan)
    digits = max(1, round(math.log(max(total["rows"], 1), 16) / 2))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("passes"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = thin.join(plan, levels).withColumn("key", key).withColumn("range", F.substring("key", 1, digits))

    held = rows.where("rest > 0").groupBy(*levels, "range").agg(F.sum("n_tokens").alias("held"))
    upto = Window.partitionBy(*levels).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("before", F.coalesce(F.sum("held").over(upto), F.lit(0)))
    part = rows.where("rest > 0").join(held, [*levels, "range"]).where("before < rest")
    inside = Window.partitionBy(*levels, "range").orderBy("key", "doc_id", "row_hash").rowsBetween(
        Window.unboundedPreceding, -1)
    ends = part.where("before + held > rest").withColumn(
        "take", F.least("n_tokens", F.col("rest") - F.col("before") - F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))))
    out = ["doc_id", "row_hash", *levels, F.col("passes").cast("int").alias("epoch"), "n_tokens", "take"]
    last = (part.where("before + held <= rest").withColumn("take", F.col("n_tokens")).select(*out)
            .unionByName(ends.where("take > 0").select(*out)))
    full = (rows.where("passes > 0").withColumn("epoch", F.explode(F.expr("sequence(0, cast(passes as int) - 1)")))
            .withColumn("take", F.col("n_tokens")).select("doc_id", "row_hash", *levels, "epoch", "n_tokens", "take"))
    return full.unionByName(last)


def take_documents(docs: DataFrame, taken: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of ``taken`` (see above) with their texts cut to what is taken; other columns as they are.

    Rows equal in every column are interchangeable: such a document is kept once
    and put out as often as it was taken.  Which ones repeat is found on ids and
    hashes alone, and texts move once, to the join; ``docs`` may have any column names."""
    key, row, size, take = fresh(docs, "mix_id", "mix_hash", "mix_n", "mix_take")
    rows = docs.withColumn(key, F.col(f"`{id_col}`").cast("long")).withColumn(row, row_hash(docs))
    same = lambda a, b: a[key].eqNullSafe(b[key]) & (a[row] == b[row])      # noqa: E731
    often = stored(rows.select(key, row).groupBy(key, row).count().where("count > 1").drop("count"), "mix-often")
    single = rows.join(often, same(rows, often), "left_anti")
    once = rows.join(often, same(rows, often), "left_semi").dropDuplicates([key, row])
    rows = single.unionByName(once)
    t = taken.select(F.col("doc_id").alias(key), F.col("row_hash").alias(row), F.col("n_tokens").alias(size), F.col("take").alias(take))
    rows = rows.join(t, same(rows, t)).drop(t[key], t[row])
    text = F.col(f"`{text_col}`")
    cut = F.when(F.col(take) < F.col(size), first_tokens(text, F.col(take))).otherwise(text)
    return rows.select(*[cut.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
