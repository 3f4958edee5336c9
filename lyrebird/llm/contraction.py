"""Totals of all subtrees by parallel tree contraction, as rounds of joins.

A round rakes and compresses. Rake: leaves give what they have gathered to their parents and are done. Compress:
in a chain of nodes with one live child each, nodes are taken out and what they hold goes to the node above, which
gets the child of the lowest. Each one taken out keeps a note: its part, and the live node below it whose total it
lacks. When the root is raked, the notes are read from the last round to the first, and every total is known.

Rounds grow with the logarithm of the number of nodes, however deep or broad the tree is. A node with very many
children is only ever reached by partial sums over them; every join has one row for each key on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lyrebird.runtime import stage_table

#: What a row of a round's table is: a live node, a raked leaf, a node taken out of a chain.
LIVE, RAKED, OUT = 0, 1, 2
#: Bits of a block of numbers in which a round takes a chain together; every second round has blocks of so many bits more.
BLOCK = 6


def _raked(live: DataFrame, values: list[str]) -> DataFrame:
    """The nodes that were no leaves, with what their leaves have given; n: live children; only: the child where n is 1."""
    leaf = F.col("n") == 0
    given = live.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(
        F.count_if(leaf).alias("_gone"), F.min(F.when(~leaf, F.col("node"))).alias("only"), *[F.coalesce(F.sum(F.when(leaf, F.col(v))), F.lit(0)).alias(f"_{v}") for v in values]
    )
    inner = live.where(~leaf).join(given, "node")
    return inner.select("node", "parent", (F.col("n") - F.col("_gone")).alias("n"), "only", *[(F.col(v) + F.col(f"_{v}")).alias(v) for v in values])


def _runs(unary: DataFrame, values: list[str], bits: int) -> DataFrame:
    """Chains of nodes whose numbers follow one another in a block: each node with its run's top, what it and the nodes below it in the run hold, and the child of the lowest."""
    block = F.call_function("shiftright", F.col("node"), F.lit(bits))
    down = Window.partitionBy("_block").orderBy("node")
    whole = Window.partitionBy("_block", "_run")
    up = whole.orderBy(F.col("node").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    follows = F.coalesce(F.lag("node").over(down) == F.col("parent"), F.lit(False))
    run = unary.withColumn("_block", block).withColumn("_new", F.when(follows, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(down))
    return run.select("node", F.min("node").over(whole).alias("top"), F.max_by("only", "node").over(whole).alias("below"), *[F.sum(v).over(up).alias(v) for v in values])


def _pairs(unary: DataFrame, values: list[str], salt: int) -> DataFrame:
    """As _runs, for pairs of parent and child of different coins, whatever their numbers."""
    coin = F.pmod(F.xxhash64(F.lit(salt), F.col("node")), F.lit(2))
    above = unary.where(coin == 0).select(F.col("node").alias("top"), F.col("only").alias("node"), *[F.col(v).alias(f"_{v}") for v in values])
    pair = above.join(unary.where(coin == 1), "node")
    both = F.array(
        F.struct(F.col("node"), F.col("top"), F.col("only").alias("below"), *[F.col(v).alias(v) for v in values]),
        F.struct(F.col("top").alias("node"), F.col("top"), F.col("only").alias("below"), *[(F.col(v) + F.col(f"_{v}")).alias(v) for v in values]),
    )
    return pair.select(F.inline(both))


def _rake(live: DataFrame, values: list[str]) -> DataFrame:
    """The nodes that stay live, and the leaves, which are done."""
    done = live.where("n = 0").select("node", "parent", "n", F.lit(None).cast("long").alias("only"), *values, F.lit(RAKED).alias("kind"))
    return stage_table(_raked(live, values).withColumn("kind", F.lit(LIVE)).unionByName(done), "raked")


def _compress(inner: DataFrame, values: list[str], k: int) -> DataFrame:
    """The nodes that stay live, and those taken out of chains with what they and the nodes below them in their run hold."""
    unary = inner.where("n = 1")
    runs = _runs(unary, values, BLOCK * (k // 2 + 1)) if k % 2 == 0 else _pairs(unary, values, k)
    none = F.lit(None).cast("long")
    nothing: list[Column] = [none.alias(v) for v in values]
    is_top = F.col("node") == F.col("top")
    # what becomes of a node: it is taken out; it heads a run; the run that ended above it has another node at its end
    became = runs.select("node", F.when(~is_top, F.col("below")).alias("out"), none.alias("under"), *values)
    lowest = runs.where(~is_top).groupBy("below").agg(F.min("top").alias("under")).select(F.col("below").alias("node"), none.alias("out"), "under", *nothing)
    became = became.unionByName(lowest).groupBy("node").agg(F.max("out").alias("out"), F.max("under").alias("under"), *[F.max(v).alias(f"_{v}") for v in values])
    after = inner.join(became, "node", "left")
    kind = F.when(F.col("out").isNull(), LIVE).otherwise(OUT).alias("kind")
    return stage_table(after.select("node", F.coalesce("under", "parent").alias("parent"), "n", kind, F.col("out").alias("below"), *[F.coalesce(f"_{v}", v).alias(v) for v in values]), "compressed")


def subtree_totals(tree: DataFrame, values: list[str], rounds: int = 200) -> DataFrame:
    """(node, and each value's total over the node's subtree, itself included).

    ``tree`` has node, parent (null for a root; there may be several) and n (its number of children), bigints,
    and the values, bigints. Any numbers do; chains are taken out fastest where a node's number follows its
    parent's. Null values count as 0. A node whose parent isn't in the table counts as a root; a ring raises after
    ``rounds``. An empty tree gives no rows. Each round is a table in the shared folder; only counts go to the driver.
    """
    live, tables = tree.select("node", "parent", "n", *[F.coalesce(v, F.lit(0)).cast("long").alias(v) for v in values]), []
    for k in range(rounds):
        raked = _rake(live, values)
        inner = raked.where(F.col("kind") == LIVE)
        n, unary = inner.agg(F.count("*"), F.count_if(F.col("n") == 1)).first()
        chains = _compress(inner, values, k) if unary > 1 else None  # one alone has no other to be joined with
        tables.append((raked.where(F.col("kind") == RAKED).select("node", *values), chains))
        if not n:
            break
        live = inner.drop("only") if chains is None else chains.where(F.col("kind") == LIVE)
    else:
        raise RuntimeError(f"the tree wasn't contracted in {rounds} rounds")
    known = None
    for raked, chains in reversed(tables):
        if chains is not None:
            later = known.select(F.col("node").alias("below"), *[F.col(v).alias(f"_{v}") for v in values])
            found = chains.where(F.col("kind") == OUT).select("node", "below", *values).join(later, "below")
            known = known.unionByName(stage_table(found.select("node", *[(F.col(v) + F.col(f"_{v}")).alias(v) for v in values]), "expanded"))
        known = raked if known is None else known.unionByName(raked)
    return known
