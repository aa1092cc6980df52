"""Sets as bits, and what authors' queries make of them, against plain Python."""

import random

from pyspark.sql import functions as F

from citeloom.operators import authors as A
from citeloom.operators import bits


def test_pairs_come_back_once(spark):
    rows = [(k, i) for k in range(5) for i in range(150) if (k + i) % 3] * 2 + [(1, None), (None, 7)]
    pairs = spark.createDataFrame(rows, "key int, item int")
    at = bits.places(pairs, "item")
    assert at.count() == at.select("word", "bit").distinct().count() == 150
    sets = bits.packed(pairs, "key", "item", at)
    assert sets.count() <= 6 * at.select("word").distinct().count()
    assert sorted(bits.once(pairs, "key", "item").collect(), key=str) == sorted({r for r in map(tuple, rows) if r[1] is not None}, key=str)


def _graph(seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(45)] + [(3, 3), (4, 5), (5, 4), (1, 99)]
    own = [(p, f"e{rng.randrange(70)}") for p in range(40) for _ in range(2)] + [(None, "e1")]
    scores = [(f"n{n}", f"e{e}", 5 if (n + e) % 17 == 0 and n % 2 else 1 + (n * e) % 4) for n in range(9) for e in range(70) if (n + e) % 2]
    names = [(rng.randrange(44), f"n{rng.randrange(10)}") for _ in range(50)] + [(None, "n2")]
    return names + names[:5], scores, own, edges


def _candidates(names, scores, own, edges):
    step = {(a, b) for x, y in edges for a, b in ((x, y), (y, x)) if a != b}
    beside = lambda of: {b for a, b in step if a in of}
    by = lambda papers: {e for p, e in own if p in papers}
    found = []
    for p, n in set(names):
        one = beside({p})
        near, two = by(one), by(beside(one) - {p})
        mine = [(p, n, e, s, 1 if e in near else 2 if e in two else 3) for m, e, s in scores if m == n]
        found += [r for r in mine if not any(o[3] >= 5 and o[4] < r[4] for o in mine)]
    return found


def _tables(spark, names, scores, own, edges):
    return [spark.createDataFrame(r, s) for r, s in ((names, "paper_id int, name string"), (scores, "name string, author_id string, score int"), (own, "paper_id int, author_id string"), (edges, "citing_id int, cited_id int"))]


def test_hops_and_decisions_are_those_of_a_search(spark):
    for seed in (1, 2):
        data = _graph(seed)
        names, *others = _tables(spark, *data)
        expected = _candidates(*data)
        got = A.hop_candidates(names, *others).select("paper_id", "name", "author_id", "score", "hop")
        assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)
        assert {r[4] for r in expected} == {1, 2, 3}
        whole = sorted(map(tuple, A.link_decisions(names, got).collect()))
        assert sorted(map(tuple, A.link_decisions(names, A.nearest_links(names, *others)).collect())) == whole


def test_decisions_ask_for_few_papers_where_they_are_clear(spark, monkeypatch):
    n = spark.range(2000)
    names, own = n.select(F.col("id").alias("paper_id"), F.lit("n").alias("name")), n.select(F.col("id").alias("paper_id"), F.lit("e").alias("author_id"))
    edges = n.select(F.col("id").alias("citing_id"), ((F.col("id") + 1) % 2000).alias("cited_id"))
    asked, hops = [], A._hops
    monkeypatch.setattr(A, "_hops", lambda wanted, *rest: asked.append(wanted.count()) or hops(wanted, *rest))
    found = A.nearest_links(names, spark.createDataFrame([("n", "e", 4), ("n", "f", 1)], "name string, author_id string, score int"), own, edges)
    assert [tuple(r) for r in found.collect()] == [("n", "e", 4, 1)] and len(asked) == 1 and asked[0] < 200


def test_names_of_one_large_paper_are_not_paired(spark):
    n = spark.range(6000).select(F.lit(1).alias("paper_id"), F.concat(F.lit("N"), F.col("id").cast("string")).alias("name"))
    entities = n.filter("name like '%77'").select(F.col("name").alias("author_id"), F.col("name").alias("canonical_name"), F.col("name").alias("name_variants"))
    members = n.select("paper_id", F.col("name").alias("author_id"))
    found = A.review_evidence(n, entities.select("author_id", F.lit("N77").alias("name"), F.lit(3).alias("score")), entities, members, spark.createDataFrame([(1, "J")], "paper_id int, journal string"))
    got = {r.author_id: (len(r.overlap), *r.venues) for r in found.collect()}
    assert len(got) == 60 and set(got.values()) == {(58, "J"), (59, "J")}
