"""Mixing sources to target weights by entropy balancing, all in DataFrame operations.

Among all document rates from 0 to ``most`` under which each source yields its
target number of words, the wanted ones have the least relative entropy to "each
document once".  By convex duality they are tilted exponentials,
``min(most, exp(lambda * size / scale))``, with one multiplier for each source.
Newton iterations find all multipliers together: each is one aggregation over the
counts of (source, size), kept within brackets that it narrows.

Rates become copies: the whole part, and one more where a hash of the row lies
below the fractional part.  That threshold is shifted for each source and class
of sizes, from large to small, so that what large documents leave open is made up
by smaller ones.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from citeloom.llm.common import WORD, written

#: Steps of a row's hash above its fraction; Newton rounds; the miss of a target that ends them.
BINS, ROUNDS, EXACT = 1024, 80, 1e-7
#: Sources, of some hundred bytes each, up to which their table is broadcast; beyond, the join is a shuffle.
BROADCAST = 20_000


def cycled(sources: DataFrame, cycle: tuple = (1, 2, 3)) -> DataFrame:
    """sources with weights in turn by code point, null last; no task gets them all."""
    order = F.asc_nulls_last("source")
    ordered = written(sources.repartitionByRange(order).sortWithinPartitions(order).withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))
    parts = ordered.groupBy("part").agg(F.min("at").alias("first"), F.count("*").alias("n"))  # a row for each partition
    parts = parts.select("part", "first", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    place = F.col("at") - F.col("first") + F.col("start")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.pmod(place, F.lit(len(cycle))) + 1).cast("int"))
    return ordered.join(F.broadcast(parts), "part").withColumn("weight", weight).select(*sources.columns, "weight")


def targets(sources: DataFrame, most: int) -> DataFrame:
    """sources (source, total, weight, ...) with the target of each.

    Shares of the total by weight; where a share is above ``most`` times the
    source's size, the excess goes to the others by weight, until none is above:
    one level of words for each unit of weight, that rises until it stays.
    """
    cap, level, total = most * F.col("total"), 0.0, None
    while True:
        full = cap < level * F.col("weight")
        now = sources.agg(F.sum("total").alias("total"), F.sum(F.when(full, cap)).alias("fixed"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("free")).first()
        total = now.total or 0
        rest = total - (now.fixed or 0)
        rise = rest / now.free if now.free else level
        if rise <= level:
            return sources.withColumn("target", F.least(cap.cast("double"), F.lit(level) * F.col("weight")))
        level = rise


def _rate(most: float) -> Column:
    tilt = F.exp(F.least(F.col("lam") * F.col("size") / F.col("scale"), F.lit(700.0)))
    return F.when(F.col("full"), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), tilt))


def _on_source(rows: DataFrame, params: DataFrame, n: int) -> DataFrame:
    """rows with the columns of their source; n: the number of sources."""
    params = params.withColumnRenamed("source", "of")
    return rows.join(F.broadcast(params) if n <= BROADCAST else params, F.col("source").eqNullSafe(F.col("of"))).drop("of")


def solve(counts: DataFrame, sources: DataFrame, most: float, n: int) -> DataFrame:
    """Newton's method on the dual, for all sources at once: source, lam. counts: source, size, n; sources: source, target, scale, full, done.

    A round is one aggregation and one small table.  Raises if a target is still
    missed after ROUNDS.
    """
    none = F.lit(None).cast("double")
    now = written(sources.select("source", "target", "scale", "full", F.lit(0.0).alias("lam"), none.alias("lo"), none.alias("hi"), "done", none.alias("off")))
    x, rate = F.col("size") / F.col("scale"), F.col("r")
    words = F.col("n") * F.col("size") * rate
    miss, lam = F.col("g") - F.col("target"), F.col("lam")
    wide = 1 + 2 * F.abs(lam)
    left, seen = n, None
    for _ in range(ROUNDS if n else 0):
        tilted = _on_source(counts, now.filter("not done").select("source", "lam", "scale", "full"), n).withColumn("r", _rate(most))
        got = tilted.groupBy(F.col("source").alias("of")).agg(F.sum(words).alias("g"), F.coalesce(F.sum(F.when(rate < most, words * x)), F.lit(0.0)).alias("h"))
        met = now.join(F.broadcast(got) if n <= BROADCAST else got, F.col("source").eqNullSafe(F.col("of")), "left")
        met = met.withColumn("done", F.col("done") | (F.abs(miss) <= EXACT * F.col("target")))
        met = met.withColumns({"lo": F.when(~F.col("done") & (miss <= 0), lam).otherwise(F.col("lo")), "hi": F.when(~F.col("done") & (miss > 0), lam).otherwise(F.col("hi")), "step": F.when(F.col("h") > 0, lam - miss / F.col("h"))})
        inside = F.coalesce((F.col("lo").isNull() | (F.col("lo") < F.col("step"))) & (F.col("hi").isNull() | (F.col("step") < F.col("hi"))), F.lit(False))
        middle = (F.coalesce("lo", F.col("hi") - wide) + F.coalesce("hi", F.col("lo") + wide)) / 2
        moved = met.withColumns({"lam": F.when(F.col("done"), lam).when(inside, F.col("step")).otherwise(middle), "off": F.when(~F.col("done"), F.abs(miss) / F.col("target"))})
        seen = Observation()
        now = written(moved.select(now.columns).observe(seen, F.count(F.when(~F.col("done"), 1)).alias("left"), F.max("off").alias("worst")))
        left = seen.get["left"]
        if not left:
            return now.select("source", F.round("lam", 9).alias("lam"))  # sums in another order give the same
    if left:
        raise RuntimeError(f"{left} sources miss their targets by up to {seen.get['worst']:.2g} after {ROUNDS} rounds")
    return now.select("source", "lam")


@dataclass
class Mix:
    """A fitted mix, as a table of a row for each source: what turns a row's source, size and hash into copies."""

    sources: DataFrame
    count: int
    most: int

    def applied(self, rows: DataFrame) -> DataFrame:
        """rows (source, size, row, ...) with source_size, target, rate and copies; up to BROADCAST sources nothing is shuffled."""
        rated = _rated(_on_source(rows, self.sources, self.count), self.most)
        extra = F.coalesce((F.col("late") < F.try_element_at("cuts", F.col("class"))).cast("int"), F.lit(0))
        done = rated.withColumn("copies", (F.floor("rate") + extra).cast("int"))
        return done.withColumnRenamed("total", "source_size").drop("lam", "scale", "full", "part", "late", "class", "cuts")


def _rated(rows: DataFrame, most: int) -> DataFrame:
    """Adds the rate; part: its fraction; late: how far the row's hash is above that; class: of its size."""
    rated = rows.withColumn("rate", F.when(F.col("size") > 0, _rate(most)).otherwise(1.0))
    part = F.col("rate") - F.floor("rate")
    lucky = F.pmod(F.xxhash64("row", F.lit("mix")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return rated.withColumns({"part": part, "late": F.when(part > 0, F.floor((lucky - part) * BINS)), "class": F.floor(F.log2(F.greatest("size", F.lit(1))) / 2)})


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> list[Column]:
    """source, size and row of each document as columns."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return [F.col(f"`{source_col}`").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(F.col(f"`{id_col}`"), text).alias("row")]


def fit(base: DataFrame, weights: Mapping | None = None, most: int = 3) -> Mix:
    """Solves for the rates and their rounding; base: source, size and row of each document, read several times.

    Whatever there is for each source stays in tables, so any number of sources
    will do; the driver gets a few sums.
    """
    counts = written(base.groupBy("source", "size").agg(F.count("*").alias("n")))
    weight = F.col("n") * F.col("size")
    sources = counts.groupBy("source").agg(F.sum(weight).alias("total"), F.sum(weight * F.col("size").cast("double")).alias("square"))
    if weights is None:
        sources = cycled(sources)
    else:
        given = base.sparkSession.createDataFrame([(k, float(w)) for k, w in weights.items()], "of string, weight double")
        sources = sources.join(given, F.col("source").eqNullSafe(F.col("of")), "left").drop("of").fillna(0.0, ["weight"])
    sources = written(sources)
    n = sources.count()
    full = (F.col("total") > 0) & (F.col("target") >= most * F.col("total") * (1 - 1e-12))
    sources = targets(sources, most).withColumns({"scale": F.when(F.col("total") > 0, F.col("square") / F.col("total")).otherwise(1.0), "full": full, "none": F.col("target") <= 0})
    sources = written(sources.withColumn("done", F.col("full") | (F.col("total") == 0) | F.col("none")))
    lam = solve(counts, sources, most, n).withColumnRenamed("source", "of")
    fitted = sources.join(F.broadcast(lam) if n <= BROADCAST else lam, F.col("source").eqNullSafe(F.col("of"))).withColumn("lam", F.when(F.col("none"), -1e9).otherwise(F.col("lam")))
    fitted = written(fitted.select("source", "total", "target", "scale", "full", "lam"))
    return Mix(written(fitted.join(_cuts(base, fitted, most, n), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")), n, most)


def mix(docs: DataFrame, weights: Mapping | None = None, most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken, one row per document.

    size counts the words of a text (null: 0).  ``weights`` by source; a source
    that they lack takes nothing; without them they are 1, 2, 3 in turn over the
    sources by code point, null last.
    taken is copies times size, at most ``most`` times the size; a document
    without words stays once and takes nothing.  The same input gives the same
    copies in any order; repeated rows get equal copies.  A null source is a
    source.  An empty table gives no rows; other columns are ignored.
    """
    base = written(docs.select(F.col(f"`{id_col}`").alias("doc_id"), *sized(docs, id_col, text_col, source_col)))
    done = fit(base, weights, most).applied(base)
    return done.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: Mapping | None = None, most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents themselves, each as often as the mix takes it; up to BROADCAST sources texts aren't shuffled."""
    key = sized(docs, id_col, text_col, source_col)
    found = fit(written(docs.select(*key)), weights, most)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = found.applied(docs.select(whole.alias("document"), *key)).withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
    return rows.select("document.*")


def _cuts(base: DataFrame, fitted: DataFrame, most: int, n: int) -> DataFrame:
    """of, cuts: by class of sizes, rows of a source get a further copy if ``late`` is below the cut.

    Classes go from large to small sizes: each is cut where the words it takes
    come nearest to what is open, less what the smaller classes will take.  A
    source has at most some thirty classes of 2 * BINS steps.
    """
    rated, more = _rated(_on_source(base, fitted, n), most), F.col("part") * F.col("size")
    cells = rated.filter("size > 0").groupBy("source", "class", "late").agg(F.sum("size").cast("double").alias("words"), F.sum(F.floor("rate") * F.col("size")).cast("double").alias("sure"), F.sum(F.round(more, 6)).alias("more"), F.first("target").alias("target"))
    steps = F.filter(F.array_sort(F.collect_list(F.struct("late", "words"))), lambda c: c["late"].isNotNull())
    classes = cells.groupBy("source", "class").agg(steps.alias("steps"), F.sum("sure").alias("sure"), F.sum("more").alias("more"), F.first("target").alias("target"))
    by = classes.groupBy(F.col("source").alias("of")).agg(F.sort_array(F.collect_list(F.struct("class", "more", "steps")), asc=False).alias("classes"), (F.first("target") - F.sum("sure")).alias("open"), F.sum("more").alias("after"))

    def cut(want: Column, steps: Column) -> Column:
        def step(state: Column, c: Column) -> Column:
            nearer = state["on"] & (F.abs(state["got"] + c["words"] - want) <= F.abs(state["got"] - want))
            return F.struct(F.when(nearer, state["got"] + c["words"]).otherwise(state["got"]).alias("got"), F.when(nearer, c["late"] + 1).otherwise(state["cut"]).alias("cut"), nearer.alias("on"))

        return F.aggregate(steps, F.struct(F.lit(0.0).alias("got"), F.lit(-BINS - 1).cast("long").alias("cut"), F.lit(True).alias("on")), step)

    def take(state: Column, c: Column) -> Column:
        after = state["after"] - c["more"]
        done = lambda r: F.struct((state["open"] - r["got"]).alias("open"), after.alias("after"), F.concat(state["cuts"], F.array(F.struct(c["class"].alias("class"), r["cut"].alias("cut")))).alias("cuts"))
        return F.transform(F.array(cut(state["open"] - after, c["steps"])), done)[0]  # the inner search runs once

    empty = F.array().cast("array<struct<class:bigint,cut:bigint>>")
    folded = F.aggregate("classes", F.struct("open", "after", empty.alias("cuts")), take, lambda s: s["cuts"])
    return by.select("of", F.map_from_entries(folded).alias("cuts"))
