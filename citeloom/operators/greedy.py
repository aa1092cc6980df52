"""Greedy choices in an order, made in rounds: what is first among all that it could meet is chosen at once.

The result is that of going through the candidates one after another.  A round
chooses every candidate that no earlier one left can affect; the first one left
always is one, and candidates in no particular order need few rounds, a number
that grows with the logarithm of theirs.  (Only a chain whose order runs along
it needs as many rounds as it has links.)  Each round is a few joins over what
is left, written to the shared folder; one number reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.sources.store import cut


def dense_cliques(edges: DataFrame, max_size: int) -> DataFrame:
    """a, b, rank, node: greedy cliques of a graph with an order on its edges.

    edges: (a, b, rank) with a < b, each pair once, ranks distinct and
    comparable.  The first edge with both ends free takes, in order, every free
    node that is linked with all nodes taken so far, up to ``max_size`` in all;
    then the next one.  An edge and the free common neighbours of its ends are
    its territory: edges whose territories don't meet can't affect each other,
    so an edge that comes first at every node of its territory is chosen.
    """
    edges = cut(edges.select("a", "b", "rank"))
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    # Common neighbours by the end with fewer links, so that a hub's links aren't paired.
    degree = cut(both.groupBy("a").agg(F.count("*").alias("n")).withColumnRenamed("a", "node"))
    sized = edges.join(degree.select(F.col("node").alias("a"), F.col("n").alias("n_a")), "a").join(degree.select(F.col("node").alias("b"), F.col("n").alias("n_b")), "b")
    fewer = F.col("n_a") <= F.col("n_b")
    ends = sized.select("a", "b", "rank", F.when(fewer, F.col("a")).otherwise(F.col("b")).alias("of"), F.when(fewer, F.col("b")).otherwise(F.col("a")).alias("other"))
    near = ends.join(both.select(F.col("a").alias("of"), F.col("b").alias("node")), "of").filter(F.col("node") != F.col("other"))
    common = near.join(both.select(F.col("a").alias("other"), F.col("b").alias("node")), ["other", "node"], "left_semi").select("a", "b", "rank", "node")
    own = edges.select("a", "b", "rank", F.explode(F.array("a", "b")).alias("node"))
    territory, found = cut(own.unionByName(common)), None
    while not territory.isEmpty():
        first = territory.groupBy("node").agg(F.min("rank").alias("first"))
        judged = territory.join(first, "node").groupBy("a", "b", "rank").agg(F.min((F.col("rank") == F.col("first")).cast("int")).alias("ok"))
        chosen = cut(judged.filter("ok = 1").select("a", "b", "rank"))
        taken = chosen.select("a", "b", "rank", F.explode(F.array("a", "b")).alias("node"))
        # One node a step: the first candidate left, after which those that aren't linked with it go.
        left = territory.join(chosen.select("a", "b"), ["a", "b"], "left_semi").filter("node <> a and node <> b")
        for step in range(max_size - 2):
            left = cut(left)
            pick = left.groupBy("a", "b", "rank").agg(F.min("node").alias("node"))
            taken = taken.unionByName(pick)
            if step + 3 < max_size:
                after = left.join(pick.select("a", "b", F.col("node").alias("picked")), ["a", "b"]).filter("node > picked")
                left = after.join(both.select(F.col("a").alias("picked"), F.col("b").alias("node")), ["picked", "node"], "left_semi").drop("picked")
        taken = cut(taken)
        found = taken if found is None else found.unionByName(taken)
        gone = taken.select("node").distinct()
        # Edges of which an end went are no candidates any more; of the others' territories the nodes that went are missing.
        alive = territory.join(gone, "node", "left_anti")
        both_ends = alive.filter("node = a or node = b").groupBy("a", "b").agg(F.count("*").alias("n")).filter("n = 2").select("a", "b")
        territory = cut(alive.join(both_ends, ["a", "b"], "left_semi"))
    return found if found is not None else own.limit(0)


def first_independent(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, chosen: each node in its order is chosen unless an earlier one that it is linked with was.

    nodes: (node, rank) with distinct ranks; edges: (a, b) between them, in both
    directions.  A round chooses what comes first among its neighbours left and
    drops these.
    """
    ranks = cut(nodes.select("node", "rank"))
    side = lambda x: ranks.select(F.col("node").alias(x), F.col("rank").alias(f"rank_{x}"))
    # An edge matters at its later end.
    links = cut(edges.select("a", "b").filter("a <> b").distinct().join(side("a"), "a").join(side("b"), "b").filter("rank_a < rank_b").select("a", "b"))
    later = links.select(F.col("b").alias("node")).distinct()
    chosen = cut(ranks.join(later, "node", "left_anti").select("node"))
    done, dropped = chosen, None
    while True:
        lost = cut(links.join(chosen.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node")).distinct())
        dropped = lost if dropped is None else dropped.unionByName(lost)
        settled = cut(chosen.unionByName(lost))
        waiting = cut(links.join(settled.select(F.col("node").alias("b")), "b", "left_anti"))  # their later ends are open
        links = cut(waiting.join(settled.select(F.col("node").alias("a")), "a", "left_anti"))
        open_ = waiting.select(F.col("b").alias("node")).distinct()
        chosen = cut(open_.join(links.select(F.col("b").alias("node")).distinct(), "node", "left_anti"))
        if chosen.isEmpty():
            return done.withColumn("chosen", F.lit(True)).unionByName(dropped.withColumn("chosen", F.lit(False)))
        done = done.unionByName(chosen)


def numbered(keys: DataFrame, of: list[str], order: list[str], name: str) -> DataFrame:
    """keys with a number from 0 within each group, by a sort over ranges and the groups' counts in each, so that one group may be as large as it likes.

    The rows of (of, order) are distinct; groups of a range are counted, not collected.
    """
    ordered = cut(keys.repartitionByRange(*of, *order).sortWithinPartitions(*of, *order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = ordered.groupBy(part.alias("_part"), *of).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*of).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition that a group reaches
    starts = counts.select("_part", *of, (before - F.col("_first")).alias("_shift"))
    return ordered.withColumn("_part", part).join(starts, ["_part", *of]).withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")
