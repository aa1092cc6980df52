"""Connected components by alternating large-star and small-star steps, all on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import written


def _least(edges: DataFrame) -> DataFrame:
    """src, least: the smallest neighbour; written, so that the joins below start from plain shuffles, which AQE may split at a hub."""
    return written(edges.groupBy("src").agg(F.min("dst").alias("least")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours move on to a node's smallest one; edges go from larger to smaller nodes, so a hub without a smaller one keeps its edges."""
    least = _least(edges).withColumnRenamed("src", "dst")
    return edges.join(least, "dst", "left").select("src", F.coalesce("least", "dst").alias("dst"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked with the smallest one."""
    least = _least(edges)
    moved = edges.join(least, "src")
    return moved.select(F.col("dst").alias("src"), F.col("least").alias("dst")).unionByName(least.select("src", F.col("least").alias("dst")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component of every node that has an edge, roots themselves left out.

    edges: (src, dst), in any direction, repeated or not; loops are ignored.
    Each round is written to the shared folder, and only two numbers reach the
    driver.
    """
    now = edges.filter("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    now, seen = written(now), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return now.toDF("node", "root")
        seen = mark
        large = written(_large_star(now).filter("src <> dst").distinct())
        now = written(_small_star(large).filter("src <> dst").distinct())
