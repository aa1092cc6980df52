"""Greedy choices in rounds against going through the candidates one after another, and packing against a loop."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.operators import authors, greedy, packing, resolve


def one_by_one(edges, max_size):
    """edges: {(a, b): rank}."""
    close = {}
    for a, b in edges:
        close.setdefault(a, set()).add(b)
        close.setdefault(b, set()).add(a)
    free, out = set(close), []
    for a, b in sorted(edges, key=edges.get):
        if a in free and b in free:
            chosen = [a, b]
            for c in sorted(free - {a, b}):
                if len(chosen) < max_size and all(c in close[m] for m in chosen):
                    chosen.append(c)
            free -= set(chosen)
            out.append(((a, b), sorted(chosen)))
    return sorted(out)


@pytest.mark.parametrize(("n", "p", "max_size", "levels"), [(40, 0.3, 5, 3), (60, 0.5, 4, 1000), (25, 0.9, 6, 2), (80, 0.1, 2, 5)])
def test_cliques_are_those_of_one_pass(spark, n, p, max_size, levels):
    rng = random.Random(n)
    edges = {(a, b): (rng.randrange(levels), a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < p}
    df = spark.createDataFrame([(a, b, r) for (a, b), r in edges.items()], "a int, b int, rank struct<s:int,a:int,b:int>")
    got = {}
    for r in greedy.dense_cliques(df, max_size).collect():
        got.setdefault((r["a"], r["b"]), []).append(r["node"])
    assert sorted((k, sorted(v)) for k, v in got.items()) == one_by_one(edges, max_size)


def test_parts_are_numbered_in_their_order(spark):
    scored = spark.createDataFrame([("a", "b", 3.0), ("c", "d", 5.0), ("b", "c", 4.0), ("x", "y", 1.0), ("d", "e", 0.5)], "id_a string, id_b string, score double")
    members = spark.createDataFrame([(k, "g") for k in "abcde"] + [("x", "h"), ("y", "h")], "paper_id string, `group` string")
    got = sorted((r["group"], r["part"], r["paper_id"]) for r in resolve.dense_parts(members, scored, 1.0, 3).collect())
    assert got == [("g", 0, "c"), ("g", 0, "d"), ("g", 1, "a"), ("g", 1, "b"), ("h", 0, "x"), ("h", 0, "y")]


def test_a_very_large_component(spark):
    """100,000 papers around one hub, with links between some of them: no step holds the component."""
    n = 100_000
    hub = spark.range(1, n).selectExpr("cast(0 as long) as id_a", "id as id_b", "cast(1 + pmod(xxhash64(id), 997) as double) as score")
    rim = spark.range(1, n - 1).filter("id % 2 = 1").selectExpr("id as id_a", "id + 1 as id_b", "cast(1 + pmod(xxhash64(id, 5), 991) as double) as score")
    members = spark.range(n).selectExpr("id as paper_id", "cast(0 as long) as `group`")
    found = resolve.dense_parts(members, hub.unionByName(rim), 1.0, 5)
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    sizes = found.groupBy("part").agg(F.count("*").alias("n"), F.max(F.when(F.col("paper_id") == 0, 1)).alias("hub")).collect()
    assert len(sizes) >= n // 2 - 2 and {r["n"] for r in sizes if r["hub"]} <= {2, 3} and {r["n"] for r in sizes if not r["hub"]} == {2}
    assert sorted(r["part"] for r in sizes) == list(range(len(sizes)))


def test_first_independent_set(spark):
    rng = random.Random(2)
    for n, p in ((50, 0.1), (30, 0.6), (5, 0.0)):
        rank = {k: rng.random() for k in range(n)}
        edges = [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < p]
        chosen = set()
        for k in sorted(rank, key=rank.get):
            if not any((k in e) and (set(e) - {k}) & chosen for e in edges):
                chosen.add(k)
        got = greedy.first_independent(spark.createDataFrame(list(rank.items()), "node int, rank double"), spark.createDataFrame([*edges, *[(b, a) for a, b in edges]], "a int, b int")).collect()
        assert {r["node"] for r in got if r["chosen"]} == chosen and len(got) == n


def test_one_surname_for_a_fifth_of_all_names(spark):
    rng = random.Random(9)
    firsts = ["A.", "Anna", "Anna B.", "Ana", "C. D.", "Carl", "Maria", "M."]
    rows = [(k, f"{'Smith' if k % 5 == 0 else f'Name{k}'}, {rng.choice(firsts)}{' ' + chr(65 + rng.randrange(6)) + '.' if rng.random() < 0.5 else ''}") for k in range(600)]
    got = authors.batch_groups(spark.createDataFrame(rows, "paper_id int, name string"), spark.createDataFrame([], "author_id string"))
    assert "FlatMapGroups" not in got._jdf.queryExecution().toString()
    by = {r["name"]: (r["author_id"], r["primary_name"]) for r in got.collect()}
    assert set(by) == {n for _, n in rows}
    for name, (author, primary) in by.items():
        assert primary is None or (by[primary][1] is None and by[primary][0] == author and primary != name)


def next_fit(sizes, room):
    bins, used = [], None
    for s in sizes:
        if used is None or used + s > room:
            bins.append(0 if not bins else bins[-1] + 1)
            used = 0
        else:
            bins.append(bins[-1])
        used += s
    return bins


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bins_are_those_of_a_loop(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 0, 1, 5, 9, 10, 11, 30, rng.randrange(10)]) for _ in range(500)]
    df = spark.createDataFrame([(k * 3 - 50, s if s or seed > 1 else None) for k, s in enumerate(sizes)], "id int, bytes int").repartition(4)
    got = [r["bin"] for r in packing.packed(df, ["id"], F.col("bytes"), 12, 2).orderBy("id").collect()]
    assert got == next_fit(sizes, 10)
    small = [1] * 7
    got = packing.packed(spark.createDataFrame(list(enumerate(small)), "id int, bytes int"), ["id"], F.col("bytes"), 5).orderBy("id").collect()
    assert [r["bin"] for r in got] == next_fit(small, 5)  # the last bin isn't full


def test_bins_of_nothing_of_one_row_and_of_zeros(spark):
    empty = spark.createDataFrame([], "id int, bytes int")
    assert packing.packed(empty, ["id"], F.col("bytes"), 10).count() == 0
    assert [r["bin"] for r in packing.packed(spark.createDataFrame([(1, 99)], "id int, bytes int"), ["id"], F.col("bytes"), 10).collect()] == [0]
    assert {r["bin"] for r in packing.packed(spark.range(50).selectExpr("id", "0 as bytes"), ["id"], F.col("bytes"), 10).collect()} == {0}
    with pytest.raises(ValueError):
        packing.packed(empty, ["id"], F.col("bytes"), 5, 5)


def test_packing_takes_few_jobs_however_many_bins(spark):
    """Ranges are packed by themselves: no round for each binary digit of the number of bins."""
    rng = random.Random(4)
    sizes = [rng.choice([0, 1, 2, 3, 40]) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(sizes)), "id int, size int").repartition(7)
    spark.sparkContext.setJobGroup("packing", "")
    try:
        got = [r["bin"] for r in packing.packed(df, ["id"], F.col("size"), 7).orderBy("id").collect()]
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("packing"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == next_fit(sizes, 7) and got[-1] > 1000
    assert jobs <= 20


@pytest.mark.parametrize("room", [1, 5, 9, 40])
def test_steps_of_ranges_follow_each_other(room):
    """Whatever the ranges are, one without a size or with one row among them."""
    rng = random.Random(room)
    for _ in range(200):
        sizes = [rng.choice([0, 0, 1, 2, 7, 60]) for _ in range(rng.randrange(1, 40))]
        cuts = sorted({0, len(sizes), *(rng.randrange(len(sizes) + 1) for _ in range(6))})
        place, before, got = packing._NONE, 0, []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            part = np.array(sizes[lo:hi], np.int64)
            got += packing._bins(part, room, place, before).tolist()
            since, after, n = packing._steps(part, room)
            at = int(np.flatnonzero(since <= place)[-1])
            place, before = (int(after[at]) if n[at] else place + int(after[at])), before + int(n[at])
        assert got == next_fit(sizes, room)
