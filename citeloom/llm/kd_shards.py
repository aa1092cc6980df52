"""Sharding with a K-d tree over the documents' metadata, all in DataFrame operations.

Equal texts form a group with one place in metadata space (the least coordinate
of its rows in each dimension).  Nodes of the tree are split at distributed
weighted medians along their relatively widest dimension, equal coordinates by
the text's hash, until each leaf holds its shard's bytes.  A median comes from
histograms of bounded size that narrow on the cut, for all nodes of a level in
one job; a node's name is a column of its groups.

Groups of over a sixteenth of a shard can't be evened out by cutting between
groups.  There are at most 16 for each shard; they go to the emptiest shard,
largest first, those of nearly a shard or more in pieces by a hash of the id,
and the tree fills the shards up to an equal level.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.llm.common import written

#: Bins of all nodes of a level together, and of one node at least; rounds until a cut is taken as it is.
OVERHEAD, BINS, LEAST_BINS, PASSES = 16, 1 << 16, 64, 12
HEAVY, WHOLE, PIECE, CLOSE = 1 / 16, 0.9, 1 / 16, 1 / 500


def _is_text(docs: DataFrame, name: str) -> bool:
    return isinstance(docs.schema[name].dataType, (T.StringType, T.BinaryType))


def _coordinate(docs: DataFrame, name: str) -> Column:
    """A dimension as a double: numbers as they are, null and NaN first; texts stay, as bytes, until they are ranked."""
    kind, c = docs.schema[name].dataType, F.col(f"`{name}`")
    if _is_text(docs, name):
        return c.cast("binary")
    if isinstance(kind, (T.DateType, T.TimestampType, T.BooleanType)):
        c = c.cast("timestamp").cast("double") if not isinstance(kind, T.BooleanType) else c.cast("int")
    return F.coalesce(F.nanvl(c.cast("double"), F.lit(None).cast("double")), F.lit(-1.0))


def _ranks(docs: DataFrame, name: str) -> DataFrame:
    """value, rank: the place from 0 of each distinct text among all, by bytes; a sort over ranges, a row for each of which is counted."""
    values = docs.select(F.col(f"`{name}`").cast("binary").alias("value")).filter("value is not null").distinct()
    ordered = written(values.repartitionByRange("value").sortWithinPartitions("value").withColumn("at", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("part", F.shiftright("at", 33))
    parts = ordered.groupBy("part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", (before - F.col("first")).alias("shift"))
    return ordered.join(F.broadcast(parts), "part").select("value", (F.col("at") + F.col("shift")).cast("double").alias("rank"))


@dataclass
class _Search:
    """The way to one node's cut: along a dimension from lo to hi, or among equal coordinates x by tie."""

    dim: int
    lo: float
    hi: float
    want: float
    below: float = 0.0
    x: float | None = None
    cut: tuple[float, float] | None = None

    def narrow(self, a: float, b: float, weight: float, n: int, below: float, close: float, last: bool) -> None:
        """Moves on to the bin that holds the cut, or ends at the nearer end of that bin."""
        tie = self.x is not None
        if weight <= close or n == 1 or last or (a == b and tie):
            before = self.want - below <= below + weight - self.want
            at = a if before else _after(b)  # the cut lies before the bin, or just after its last row
            self.cut = (self.x, at) if tie else (at, 0.0)
        elif a == b:
            self.x, self.lo, self.hi, self.below = a, 0.0, 1.0, below
        else:
            self.lo, self.hi, self.below = a, b, below


def _bins(rows: DataFrame, searches: dict[int, _Search], dims: int, bins: int) -> dict[int, tuple]:
    """For each node the bin that holds its cut: smallest and largest key, weight, rows, and the weight before it.

    Histograms and their running sums stay distributed; a row for each node
    reaches the driver.
    """
    spark = rows.sparkSession
    params = spark.createDataFrame([(k, s.dim, s.lo, s.hi, s.x, s.below, s.want) for k, s in searches.items()], "node int, dim int, lo double, hi double, x double, below double, want double")
    rows = rows.join(F.broadcast(params), "node")  # a row for each node
    x = F.element_at(F.array(*[F.col(f"x{k}") for k in range(dims)]), F.col("dim") + 1)
    rows = rows.withColumn("key", F.when(F.col("x").isNull(), x).otherwise(F.when(x == F.col("x"), F.col("tie"))))
    width = F.col("hi") - F.col("lo")
    slot = F.when(width > 0, F.least(F.floor((F.col("key") - F.col("lo")) / width * bins), F.lit(bins - 1))).otherwise(F.lit(0))
    held = rows.filter((F.col("key") >= F.col("lo")) & (F.col("key") <= F.col("hi"))).withColumn("slot", slot)
    found = held.groupBy("node", "slot").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.sum("weight").alias("w"), F.count("*").alias("n"), F.first("below").alias("below"), F.first("want").alias("want"))
    reached = F.sum("w").over(Window.partitionBy("node").orderBy("slot")) + F.col("below")
    found = found.withColumn("reached", reached).withColumn("bin", F.struct("slot", "a", "b", "w", "n", (F.col("reached") - F.col("w")).alias("before")))
    at = F.coalesce(F.min(F.when(F.col("reached") >= F.col("want"), F.col("bin"))), F.max("bin"))
    return {r.node: r.at[1:] for r in found.groupBy("node").agg(at.alias("at")).collect()}


def _cuts(rows: DataFrame, ends: dict[int, int], capacity: list[float], spans: list[float], dims: int, close: float) -> list[tuple]:
    """(node, dimension, coordinate, tie, first shard of the right) for each node; ends: each node's end of shards."""
    stats = rows.groupBy("node").agg(F.sum("weight").alias("w"), *[f(f"x{k}").alias(f"{f.__name__}{k}") for k in range(dims) for f in (F.min, F.max)])
    searches, right = {}, {}
    for r in stats.collect():  # a row for each node
        if ends[r.node] - r.node < 2:
            continue
        right[r.node] = r.node + (ends[r.node] - r.node) // 2
        dim = max(range(dims), key=lambda d: (r[f"max{d}"] - r[f"min{d}"]) / (spans[d] or 1.0))
        room = sum(capacity[r.node : ends[r.node]])
        want = r.w * sum(capacity[r.node : right[r.node]]) / room if room else 0.0
        searches[r.node] = _Search(dim, r[f"min{dim}"], r[f"max{dim}"], want)
    if not searches:
        return []
    bins = max(LEAST_BINS, min(BINS // len(searches), 1024 * max(ends[k] - k for k in searches)))
    for turn in range(PASSES):
        todo = {k: s for k, s in searches.items() if s.cut is None}
        if not todo:
            break
        for k, found in _bins(rows, todo, dims, bins).items():
            searches[k].narrow(*found, close, turn == PASSES - 1)
    return [(k, s.dim, *s.cut, right[k]) for k, s in searches.items()]


def _tree(groups: DataFrame, shards: int, capacity: list[float], spans: list[float], dims: int, close: float) -> DataFrame:
    """hash, shard of each group.

    A node is named by its first shard; a group's node is a column, written anew
    at each level of the tree, so that no plan grows with the tree.
    """
    rows, ends = groups.withColumn("node", F.lit(0)), {0: shards}
    while any(end - k > 1 for k, end in ends.items()):
        cuts = _cuts(rows, ends, capacity, spans, dims, close)
        halves = {k: k + (end - k) // 2 for k, end in ends.items() if end - k > 1}
        ends |= {half: ends[k] for k, half in halves.items()} | halves
        if not cuts:
            break
        params = rows.sparkSession.createDataFrame(cuts, "node int, dim int, x double, t double, right int")
        at = F.element_at(F.array(*[F.col(f"x{k}") for k in range(dims)]), F.col("dim") + 1)
        left = (at < F.col("x")) | ((at == F.col("x")) & (F.col("tie") < F.col("t"))) | F.col("right").isNull()
        rows = written(rows.join(F.broadcast(params), "node", "left").withColumn("node", F.when(left, F.col("node")).otherwise(F.col("right"))).select(*groups.columns, "node"))
    return rows.select("hash", F.col("node").alias("shard"))


def _after(x: float) -> float:
    return math.nextafter(x, math.inf)


def _fill(load: list[float], rest: float) -> list[float]:
    """What each shard still takes so that the rest brings all to one level, as far as it goes."""
    order, level, held = sorted(load), 0.0, 0.0
    for k, x in enumerate(order, 1):
        held += x
        level = (rest + held) / k
        if k == len(order) or level <= order[k]:
            break
    return [max(0.0, level - x) for x in load]


def shard(docs: DataFrame, shards: int = 40, dims: tuple[str, ...] = ("doc_id", "n_chars", "lang", "source"), id_col: str = "doc_id", text_col: str = "text", close: float = CLOSE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: every row in one of the shards.

    Law ``bytes``: shards hold nearly equal sizes.  A row's size is its text's
    UTF-8 bytes and 16; null counts as an empty text.  Equal texts share a shard
    unless together they nearly fill one.  Slots count from 0 in each shard, in
    the order of ids, null first; ``grown_shard`` is null under this law.
    Texts among ``dims`` count by their place among all distinct ones.  Repeated rows each get a slot.  ``dims`` that the table lacks are left out,
    other columns are ignored; an empty table gives no rows.  A cut is looked for
    until it is within ``close`` of a shard's size from the weighted median, or
    no group lies between.  The driver holds a few numbers for each shard.
    """
    present = [c for c in dims if c in docs.columns]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("hash"), *[_coordinate(docs, c).alias(f"x{k}") for k, c in enumerate(present)])
    for k, c in enumerate(present):
        if _is_text(docs, c):
            base = base.join(_ranks(docs, c).withColumnRenamed("value", f"x{k}"), f"x{k}", "left").withColumn(f"x{k}", F.coalesce("rank", F.lit(-1.0))).drop("rank")
    base = written(base if present else base.withColumn("x0", F.lit(0.0)))
    n_dims = max(1, len(present))
    cols = [f"x{k}" for k in range(n_dims)]
    groups = written(base.groupBy("hash").agg(F.sum("size").alias("weight"), F.count("*").alias("n"), *[F.min(c).alias(c) for c in cols]).withColumn("tie", F.pmod(F.xxhash64("hash"), F.lit(1 << 52)) / F.lit(float(1 << 52))))
    whole = groups.agg(F.sum("weight").alias("w"), *[(F.max(c) - F.min(c)).alias(c) for c in cols]).first()
    target = (whole.w or 0) / shards
    heavy = groups.filter(F.col("weight") > target * HEAVY).select("hash", "weight", "n").collect()  # at most 16 for each shard
    pieces = base.sparkSession.createDataFrame([(h.hash, 1 if h.weight <= target * WHOLE else min(h.n, int(h.weight / (target * PIECE)) + 1)) for h in heavy], "hash long, pieces int")
    of_heavy = base.join(F.broadcast(pieces), "hash").withColumn("piece", F.pmod(F.xxhash64("doc_id", F.lit("piece")), F.col("pieces")).cast("int"))
    parts = of_heavy.groupBy("hash", "piece").agg(F.sum("size").alias("w")).collect()
    load, owner = [0.0] * shards, []
    emptiest = [(0.0, k) for k in range(shards)]
    for p in sorted(parts, key=lambda p: (-p.w, p.hash, p.piece)):
        _, k = heapq.heappop(emptiest)
        load[k] += p.w
        heapq.heappush(emptiest, (load[k], k))
        owner.append((p.hash, p.piece, k))
    light = groups.filter(F.col("weight") <= target * HEAVY)
    capacity = _fill(load, (whole.w or 0) - sum(load))
    tree = _tree(light.select("hash", "weight", "tie", *cols), shards, capacity, [whole[c] or 0.0 for c in cols], n_dims, target * close)
    out = ["doc_id", "size", "text_crc32", "shard"]
    owners = base.sparkSession.createDataFrame(owner, "hash long, piece int, shard int")
    placed = of_heavy.join(F.broadcast(owners), ["hash", "piece"]).select(*out)
    rest = base.join(F.broadcast(pieces), "hash", "left_anti").join(tree, "hash").select(*out)
    return _with_slots(placed.unionByName(rest)).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _with_slots(rows: DataFrame) -> DataFrame:
    """slot: the row's place among its shard's, without bringing a shard into one task."""
    ordered = rows.repartitionByRange("shard", "doc_id").sortWithinPartitions("shard", "doc_id").withColumn("at", F.monotonically_increasing_id())
    ordered = written(ordered).withColumn("part", F.shiftright("at", 33))
    runs = ordered.groupBy("part", "shard").agg(F.min("at").alias("first"), F.count("*").alias("n"))  # partitions and shards, added
    start = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("part", "shard", "first", start.alias("start"))
    return ordered.join(F.broadcast(runs), ["part", "shard"]).withColumn("slot", F.col("at") - F.col("first") + F.col("start"))
