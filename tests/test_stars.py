"""Identifier blocks as stars, coauthors by classes, ranks without a sorted list, and what speaks for an author."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from citeloom.operators import authors as A
from citeloom.operators import graph, resolve

PAPER = "paper_id long, doi string, s2_id string"


def roots(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_stars_connect_what_all_pairs_do(spark):
    rng = random.Random(4)
    for _ in range(4):
        rows = [(k, rng.choice([None, "", *[f"https://doi.org/10.1/{x}" for x in range(14)]]), rng.choice([None, None, "", *[f"s{x}" for x in range(40)]])) for k in range(60)]
        blank = lambda x: x or None
        pairs = [(a, b) for (a, da, sa), (b, db, sb) in itertools.combinations(rows, 2) if blank(sa) and sa == sb or blank(da) and da == db and not (blank(sa) and blank(sb) and sa != sb)]
        linked = {x for p in pairs for x in p}
        expected = {k: r for k, r in roots(range(60), pairs).items() if k in linked}
        papers = spark.createDataFrame(rows, PAPER)
        assert {r.paper_id: r.group for r in resolve.identifier_groups(papers).collect()} == expected
    assert resolve.identifier_groups(papers.limit(0)).count() == 0


def test_one_doi_of_50000_papers_is_50000_rows(spark):
    papers = spark.range(50_000).select(F.col("id").alias("paper_id"), F.lit("10.1/x").alias("doi"), F.when(F.col("id") % 5 > 0, (F.col("id") % 7).cast("string")).alias("s2_id"))
    links = resolve.identifier_links(papers)
    assert links.count() < 100_000
    groups = resolve.identifier_groups(papers)
    assert groups.agg(F.count("*"), F.max("group")).first() == (50_000, 0)


def test_a_paper_of_5000_authors_is_one_link(spark):
    wrote = spark.range(5000).select(F.lit(1).alias("paper_id"), F.col("id").alias("author_id")).unionByName(spark.createDataFrame([(2, 7), (2, 9000), (2, 7), (3, 9001), (None, 1)], "paper_id int, author_id long"))
    classes = A.coauthor_classes(wrote).cache()
    assert classes.select("class_id").distinct().count() == 4 and classes.count() == 5002
    got = {tuple(r) for r in A.coauthor_links(wrote, classes).collect()}
    assert got == {(0, 0, 1, 4999 * 4998 // 2), (0, 7, 1, 4999), (7, 9000, 1, 1)}


def test_classes_and_links_say_what_all_pairs_say(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(6), a) for a in range(80) for _ in range(rng.randrange(1, 4))]
    wrote = spark.createDataFrame(rows, "paper_id int, author_id int")
    classes = A.coauthor_classes(wrote).cache()
    of = {r.author_id: r.class_id for r in classes.collect()}
    links = {(r.class_a, r.class_b): (r.n, r.pairs) for r in A.coauthor_links(wrote, classes).collect()}
    pairs = Counter()
    for r in A.all_coauthors(wrote).filter("author_id < coauthor_id").collect():
        key = tuple(sorted((of[r.author_id], of[r.coauthor_id])))
        assert links[key][0] == r.n
        pairs[key] += 1
    assert pairs == {k: p for k, (_, p) in links.items()}


@pytest.mark.parametrize("least", [1, 2, 4])
def test_shared_counts_equal_all_pairs(spark, least):
    rng = random.Random(least)
    rows = [(a, rng.choice([0, 1, *range(12)])) for a in range(25) for _ in range(rng.randrange(9))]
    lists = {}
    for a, i in rows:
        lists.setdefault(a, set()).add(i)
    expected = {(a, b, len(lists[a] & lists[b])) for a, b in itertools.combinations(sorted(lists), 2) if len(lists[a] & lists[b]) >= least}
    got = graph.shared_counts(spark.createDataFrame(rows, "a int, i int"), "a", "i", least)
    assert {tuple(r) for r in got.collect()} == expected


def test_overlap_with_many_seeds(spark):
    edges = spark.createDataFrame([(c, s) for c in range(4) for s in range(130) if (s + c) % 3] + [(c, x) for c in range(4) for x in (500, 501) if x == 500 or c < 1], "citing_id long, cited_id long")
    cites = {c: {s for s in range(130) if (s + c) % 3} for c in range(4)}
    assert set().union(*cites.values()) == set(range(130))
    got = [tuple(r) for r in graph.co_cited(edges, list(range(130)), 1).collect()]
    assert got == [(500, 4)]  # 501 is cited beside two thirds of the seeds only
    assert graph.co_cited(edges, [], 1).count() == 0


def test_review_of_candidates(spark):
    names = spark.createDataFrame([(90, "Roe, J."), (90, "Poe, E."), (90, "Nobody, N.")], "paper_id long, name string")
    entities = spark.createDataFrame([("roe_a", "Roe, Jane", "Roe, J.|Roe, Jane|a|b|c|d|e", 2), ("roe_b", "Roe, John", "Roe, John", 1), ("poe", "Poe, Edgar", "Poe, E.|Poe, Edgar", 1), ("x", "Xu, X.", "Xu, X.", 1)], "author_id string, canonical_name string, name_variants string, paper_count long")
    members = spark.createDataFrame([(1, "roe_a"), (1, "poe"), (2, "roe_a"), (2, "x"), (3, "roe_b")], "paper_id long, author_id string")
    papers = spark.createDataFrame([(1, "Nature"), (2, ""), (3, None)], "paper_id long, journal string")
    candidates = spark.createDataFrame([("Roe, J.", "roe_a", 3), ("Roe, J.", "roe_b", 2)], "name string, author_id string, score int")
    found = A.review_text(A.review_evidence(names, candidates, entities, members, papers), entities)
    assert {r.author_id: r.text.split("\n") for r in found.collect()} == {
        "roe_a": ["Roe, J. -> Roe, Jane (roe_a) [score: 3]", "  Variants: Roe, J. | Roe, Jane | a | b | c | +2 more | 2 papers", "  Coauthor overlap: Poe, E.", "  Other coauthors: Poe, Edgar; Xu, X.", "  Venues: Nature"],
        "roe_b": ["Roe, J. -> Roe, John (roe_b) [score: 2]", "  Variants: Roe, John | 1 papers", "  Coauthor overlap: (none)"],
    }


def test_each_two_authors_are_counted_once_and_long_papers_are_joined(spark, monkeypatch):
    monkeypatch.setattr(A, "LISTED", 4)
    rows = [(p, f"a{k}") for p in range(12) for k in range(p % 7 + 1)] + [(1, "a0"), (None, "a0"), (3, None)]
    got = A.all_coauthors(spark.createDataFrame(rows, "paper_id int, author_id string"))
    assert {c for j in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "author_id" in j for c in ("<>", "NOT (author") if c in j} == set()
    want = {}
    of = {p: sorted({a for q, a in rows if q == p and a}) for p in range(12)}
    for names in of.values():
        for a in names:
            for b in names:
                if a != b:
                    want[a, b] = want.get((a, b), 0) + 1
    assert {(r["author_id"], r["coauthor_id"]): r["n"] for r in got.collect()} == want and got.count() == len(want)


@pytest.mark.parametrize("least", [2, 3])
def test_pairs_of_short_lists_are_counted_where_they_meet(spark, monkeypatch, least):
    """No row is moved for a pair that shares too little; longer lists, and items that are null, count as ever."""
    rng = random.Random(least)
    rows = [(a, rng.choice([None, 0, 1, *range(30)])) for a in range(40) for _ in range(rng.randrange(12))]
    lists = {}
    for a, i in rows:
        if i is not None:
            lists.setdefault(a, set()).add(i)
    expected = {(a, b, len(lists[a] & lists[b])) for a, b in itertools.combinations(sorted(lists), 2) if len(lists[a] & lists[b]) >= least}
    df = spark.createDataFrame(rows, "a int, i int")
    monkeypatch.setattr(graph, "_counted_in_rows", None)
    got = graph.shared_counts(df, "a", "i", least)
    assert {tuple(r) for r in got.collect()} == expected and got.count() == len(expected)
    monkeypatch.undo()
    monkeypatch.setattr(graph, "SHORT", 4)
    got = graph.shared_counts(df, "a", "i", least)
    assert {tuple(r) for r in got.collect()} == expected and got.count() == len(expected)
