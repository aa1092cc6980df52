"""Relational citation-graph operators: co-citation, coupling, shared references, chains, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.operators.greedy import numbered
from citeloom.sources.store import cut


def _counted_in_rows(e: DataFrame, least: int, long: DataFrame | None = None) -> DataFrame:
    """``shared_counts`` of distinct (a, i) by pairs as rows; with ``long`` (a) only pairs with one of these.

    Items that many share come last in each list.  Of two lists with ``least``
    common items, one lies before the last ``least - 1`` of both, so only these
    heads are joined: an item that is the commonest of all it belongs to makes
    no pairs.  The tails, of that bounded length, are then counted for the
    pairs found.  A tail is a top-k, which tasks cut before they shuffle, and a
    head is what the tails lack, so no list is ever sorted as a whole; a key of
    many rows is split by AQE, as both sides of each join are plain shuffles.
    """
    often = e.groupBy("i").agg(F.count("*").alias("often"))
    last = Window.partitionBy("a").orderBy(F.desc("often"), F.desc("i"))
    if least > 1:
        every = cut(e.join(often, "i"))
        tail = cut(every.withColumn("r", F.row_number().over(last)).filter(F.col("r") <= least - 1).select("a", "i"))
        every = every.select("a", "i")
        head = cut(every.join(tail, ["a", "i"], "left_anti"))
    else:
        head = cut(e)
    if long is None:
        met = head.join(head.withColumnRenamed("a", "b"), "i").filter("a < b")
    else:
        some = cut(head.join(long, "a", "left_semi"))
        short = head.join(long, "a", "left_anti")
        met = some.join(some.withColumnRenamed("a", "b"), "i").filter("a < b").select("a", "b").unionByName(some.toDF("c", "i").join(short, "i").select(F.least("a", "c").alias("a"), F.greatest("a", "c").alias("b")))
    found = met.groupBy("a", "b").agg(F.count("*").alias("n"))
    if least < 2:
        return found
    found = cut(found)
    mine = found.join(tail, "a").join(every.withColumnRenamed("a", "b"), ["b", "i"]).select("a", "b")
    theirs = found.join(tail.withColumnRenamed("a", "b"), "b").join(head, ["a", "i"]).select("a", "b")
    more = mine.unionByName(theirs).groupBy("a", "b").agg(F.count("*").alias("more"))
    total = found.join(more, ["a", "b"], "left").select("a", "b", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))
    return total.filter(F.col("n") >= least)


#: Items of a list up to which what follows an item moves with it, so that a pair of short lists is counted where it is made.
SHORT = 16


def shared_counts(pairs: DataFrame, of: str, item: str, least: int) -> DataFrame:
    """a, b, n: every two ``of`` (a < b) that share at least ``least`` of the items, and how many.

    Items that many share come last in each list.  A list of at most SHORT items
    moves once for each of them, with the items that come after it.  Where two
    such lists meet at an item, what they share from there on is counted at
    once, so only pairs with ``least`` common items leave the join; the item at
    which a pair has most is its first one.  Pairs with a longer list are
    counted in rows (``_counted_in_rows``).
    """
    e = pairs.select(F.col(of).alias("a"), F.col(item).alias("i")).distinct().filter("i is not null")
    e = e if least < 2 else cut(e)
    if least < 2:
        return _counted_in_rows(e, least)
    long = cut(e.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") > SHORT).select("a"))
    lists = e if long.isEmpty() else e.join(long, "a", "left_anti")
    often = cut(e.groupBy("i").agg(F.count("*").alias("often")))
    listed = lists.join(often, "i").groupBy("a").agg(F.transform(F.array_sort(F.collect_list(F.struct("often", "i"))), lambda x: x["i"]).alias("items"))
    # The last items begin no part that is long enough.
    at = F.sequence(F.lit(0), F.size("items") - least)
    parts = listed.filter(F.size("items") >= least).select("a", "items", F.explode(at).alias("k")).select("a", F.get("items", F.col("k")).alias("i"), F.slice("items", F.col("k") + 2, F.size("items")).alias("more"))
    met = parts.join(parts.toDF("b", "i", "other"), "i").filter("a < b")
    met = met.select("a", "b", (F.size(F.array_intersect("more", "other")) + 1).cast("long").alias("n")).filter(F.col("n") >= least)
    found = met.groupBy("a", "b").agg(F.max("n").alias("n"))
    if long.isEmpty():
        return found
    # For pairs with a longer list only items of such lists count.
    theirs = e.join(long, "a", "left_semi").select("i").distinct()
    return found.unionByName(_counted_in_rows(cut(e.join(theirs, "i", "left_semi")), least, long))


def co_cited_pairs(edges: DataFrame, papers: DataFrame, min_count: int = 2, limit: int = 20) -> DataFrame:
    """The pairs of papers that most papers cite together."""
    pairs = shared_counts(edges, "cited_id", "citing_id", min_count).toDF("cited_a", "cited_b", "n_citers").orderBy(F.desc("n_citers"), "cited_a", "cited_b").limit(limit)
    t = papers.select("paper_id", "title")
    return pairs.join(t.toDF("cited_a", "title_a"), "cited_a").join(t.toDF("cited_b", "title_b"), "cited_b").select("cited_a", "cited_b", "n_citers", "title_a", "title_b")


def _overlap(edges: DataFrame, near: str, far: str, seeds: list, min_count: int, limit: int, name: str) -> DataFrame:
    """Others that share a ``near`` end with a seed; with several seeds, with each of them somewhere."""
    seeds = sorted(set(seeds))
    e = edges.select(near, far).distinct()
    # The seeds of a near end are bits of words of 60, so that a row for each two ends is left and one count does.
    words = [seeds[k : k + 60] for k in range(0, len(seeds), 60)] or [[]]
    bit = lambda w: F.when(F.col(far).isin(w), F.call_function("shiftleft", F.lit(1).cast("long"), F.array_position(F.array(*map(F.lit, w)), F.col(far)).cast("int") - 1)).otherwise(0)
    bits = [F.bit_or(bit(w) if w else F.lit(0).cast("long")) for w in words]
    mine = e.filter(F.col(far).isin(seeds)).groupBy(near).agg(*[b.alias(f"_s{k}") for k, b in enumerate(bits)])  # the filter reaches the scan
    found = e.filter(~F.col(far).isin(seeds)).join(mine, near).groupBy(F.col(far).alias("paper_id")).agg(F.count("*").alias(name), *[F.bit_or(f"_s{k}").alias(f"_s{k}") for k in range(len(words))])
    for k, w in enumerate(words):
        found = found.filter(F.col(f"_s{k}") == (1 << len(w)) - 1)
    return found.filter(F.col(name) >= min_count).select("paper_id", name).orderBy(F.desc(name), "paper_id").limit(limit)


def co_cited(edges: DataFrame, seeds: list, min_count: int = 2, limit: int = 20) -> DataFrame:
    """paper_id, n_citers: papers cited together with every seed, by distinct citers of any seed."""
    return _overlap(edges, "citing_id", "cited_id", seeds, min_count, limit, "n_citers")


def bib_coupling(edges: DataFrame, seeds: list, min_count: int = 2, limit: int = 20) -> DataFrame:
    """paper_id, n_shared: papers that share references with every seed."""
    return _overlap(edges, "cited_id", "citing_id", seeds, min_count, limit, "n_shared")


#: Matches at the head of two lists for which the lists are compared in full.
MATCHES = 3


def reference_overlap(edges: DataFrame, least: float = 0.25) -> DataFrame:
    """id_a, id_b, shared, jaccard of the reference lists of all pairs with a Jaccard similarity of ``least``; lists are never built.

    References that few papers have come first in each list.  Lists of n and m
    that are similar enough share ``need`` references, of which the k-th has
    ``need - k`` common ones after it; so the first k are within the first
    ``n - need + k`` of one list and ``m - need + k`` of the other.  Only matches
    there are joined, references that everyone has propose no pairs, and lists
    are compared in full for pairs with MATCHES of them (all they need, if fewer).
    """
    e = edges.select(F.col("citing_id").alias("a"), F.col("cited_id").alias("i")).distinct()
    often = e.groupBy("i").agg(F.count("*").alias("often"))
    at = numbered(e.join(often, "i"), ["a"], ["often", "i"], "at")
    ranked = cut(at.join(e.groupBy("a").agg(F.count("*").alias("n")), "a").select("a", "i", F.col("at").cast("int").alias("at"), F.col("n").cast("int").alias("n")))
    head = ranked.filter(F.col("at") < F.col("n") - F.ceil(F.col("n") * least - 1e-9) + MATCHES)
    need = F.greatest(F.ceil((F.col("n_a") + F.col("n_b")) * (least / (1 + least)) - 1e-9), F.lit(1))
    few = F.least(need, F.lit(MATCHES))
    near = (F.col("at_a") < F.col("n_a") - need + few) & (F.col("at_b") < F.col("n_b") - need + few)
    pair = head.toDF("id_a", "i", "at_a", "n_a").join(head.toDF("id_b", "i", "at_b", "n_b"), "i").filter("id_a < id_b").filter((F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b") - 1e-9) & near)
    pair = cut(pair.groupBy("id_a", "id_b", "n_a", "n_b").agg(F.count("*").alias("met")).filter(F.col("met") >= few).drop("met"))
    shorter, longer = F.when(F.col("n_a") <= F.col("n_b"), F.col("id_a")).otherwise(F.col("id_b")), F.when(F.col("n_a") <= F.col("n_b"), F.col("id_b")).otherwise(F.col("id_a"))
    met = pair.withColumns({"a": shorter, "other": longer}).join(ranked.select("a", "i"), "a").join(ranked.select(F.col("a").alias("other"), "i"), ["other", "i"])
    both = met.groupBy("id_a", "id_b", "n_a", "n_b").agg(F.count("*").alias("shared")).withColumn("jaccard", F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared")))
    return both.filter(F.col("jaccard") >= least).select("id_a", "id_b", "shared", "jaccard")


def _common(pairs: DataFrame, member: str, of: str, wanted: list) -> DataFrame:
    """Relational division: the members related to all wanted."""
    wanted = sorted(set(wanted))
    return pairs.filter(F.col(of).isin(wanted)).groupBy(member).agg(F.count_distinct(of).alias("_n")).filter(F.col("_n") == len(wanted)).select(F.col(member).alias("paper_id"))


def shared_refs(edges: DataFrame, ids: list) -> DataFrame:
    """What all ids cite."""
    return _common(edges, "cited_id", "citing_id", ids)


def common_citers(edges: DataFrame, ids: list) -> DataFrame:
    """What cites all ids."""
    return _common(edges, "citing_id", "cited_id", ids)


def shared_papers(paper_authors: DataFrame, author_ids: list) -> DataFrame:
    """Papers by all authors; an id given twice counts once."""
    return _common(paper_authors, "paper_id", "author_id", author_ids)


def coauthors(paper_authors: DataFrame, author_id) -> DataFrame:
    """author_id, n_shared: others by the papers they share."""
    mine = paper_authors.filter(F.col("author_id") == author_id).select("paper_id").distinct()
    return paper_authors.filter(F.col("author_id") != author_id).join(mine, "paper_id", "left_semi").groupBy("author_id").agg(F.count_distinct("paper_id").alias("n_shared"))


def chain(edges: DataFrame, start, depth: int = 2) -> DataFrame:
    """citing_id, depth: papers that cite the start over so many steps; once for each depth at which they are reached.

    One join for each level, deduplicated at once, so that many paths to a paper
    don't multiply.
    """
    e = edges.select("citing_id", "cited_id").distinct()
    level = e.filter(F.col("cited_id") == start).select("citing_id")
    found = level.withColumn("depth", F.lit(1))
    for d in range(2, depth + 1):
        level = e.join(level.withColumnRenamed("citing_id", "cited_id"), "cited_id").select("citing_id").distinct()
        found = found.unionByName(level.withColumn("depth", F.lit(d)))
    return found


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, root: the smallest node of the component of each node of an edge.

    Each round takes the least label among neighbours and then that label's own
    label, so a path shrinks by half; rounds are written, one number reaches the
    driver.
    """
    both = cut(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).unionByName(edges.select(F.col(dst).alias("a"), F.col(src).alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        least = cut(labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root")))
        jump = least.select(F.col("node").alias("root"), F.col("root").alias("up"))
        labels = cut(least.join(jump, "root", "left").select("node", "old", F.coalesce("up", "root").alias("root")))
        if not labels.filter("old <> root").limit(1).count():
            return labels.select("node", "root")
        labels = labels.select("node", "root")


def orientation(edges: DataFrame, kind: str = "directed") -> DataFrame:
    """Distinct edges as given, reversed, or both ways."""
    e = edges.select("citing_id", "cited_id")
    flipped = edges.select(F.col("cited_id").alias("citing_id"), F.col("citing_id").alias("cited_id"))
    return {"directed": lambda: e, "reverse": lambda: flipped, "undirected": lambda: e.unionByName(flipped)}[kind]().distinct()
