"""Behaviour of operators on small graphs, worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from citeloom.operators import authors as A
from citeloom.operators import centrality, findings, graph, lookup, maintain, resolve, search
from citeloom.sources import documents, store


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "citing_id string, cited_id string")


def ids(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect()) if len(cols) > 1 else sorted(r[0] for r in df.select(*cols).collect())


def nodes(spark, names, kind="stub"):
    return spark.createDataFrame([(n, n, kind) for n in names], "paper_id string, title string, type string")


def test_pagerank_mass_exceeds_one_with_dangling_papers(spark):
    got = {r.paper_id: r.score for r in centrality.pagerank(nodes(spark, "abc"), edges(spark, [("a", "b"), ("b", "c")]), tol=0, max_iter=6).collect()}
    a = b = c = 1 / 3
    for _ in range(6):  # c cites nothing
        t = (c + 0.15) / 3
        a, b, c = t, t + 0.85 * a, t + 0.85 * b
    assert got == {"a": pytest.approx(a), "b": pytest.approx(b), "c": pytest.approx(c)}
    assert sum(got.values()) > 1


def test_katz_and_seeds(spark):
    e = edges(spark, [("a", "c"), ("b", "c")])
    got = {r.paper_id: r.score for r in centrality.katz(nodes(spark, "abc"), e, tol=1e-12).collect()}
    assert got == {"a": 1.0, "b": 1.0, "c": pytest.approx(1.5)}
    seeded = {r.paper_id: r.score for r in centrality.katz(nodes(spark, "abc"), e, seeds=["a"], alpha=9.0, tol=1e-12).collect()}
    assert seeded == {"a": 1.0, "b": 0.0, "c": pytest.approx(0.25)}


def test_pagerank_of_nothing(spark):
    assert centrality.pagerank(nodes(spark, ""), edges(spark, [])).count() == 0


def test_chain_repeats_a_paper_at_each_depth(spark):
    e = edges(spark, [("b", "a"), ("c", "b"), ("c", "a"), ("a", "c")])
    assert ids(graph.chain(e, "a", 3), "citing_id", "depth") == [("a", 2), ("a", 3), ("b", 1), ("b", 3), ("c", 1), ("c", 2), ("c", 3)]


def test_co_citation_with_several_seeds(spark):
    e = edges(spark, [("x", "s"), ("x", "p"), ("y", "t"), ("y", "p"), ("z", "s"), ("z", "q")])
    assert ids(graph.co_cited(e, ["s", "t"], 1), "paper_id", "n_citers") == [("p", 2)]
    assert ids(graph.shared_refs(e, ["x", "y"]), "paper_id") == ["p"]
    assert ids(graph.common_citers(e, ["s", "p", "p"]), "paper_id") == ["x"]


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (8, 7), (6, 6)], "src long, dst long")
    assert ids(graph.components(e), "node", "root") == [(3, 3), (4, 3), (5, 3), (6, 6), (7, 7), (8, 7), (9, 3)]


def test_alias_closure_drops_cycles(spark):
    a = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("w", "x")], "alias string, target string")
    assert ids(maintain.alias_closure(a), "alias", "target") == [("a", "c"), ("b", "c")]


def test_repair_is_idempotent(spark):
    active = nodes(spark, "abc")
    once = maintain.bidirectional(edges(spark, [("a", "b"), ("a", "a"), ("a", "z")]), edges(spark, [("c", "a")]), active)
    assert ids(once, "citing_id", "cited_id") == [("a", "b"), ("c", "a")]
    assert ids(maintain.bidirectional(once, once, active), "citing_id", "cited_id") == [("a", "b"), ("c", "a")]
    assert ids(maintain.adjacency(once, active).select("paper_id", F.array_join("cited_by", ",").alias("by")), "paper_id", "by") == [("a", "c"), ("b", "a"), ("c", "")]


def test_rewrite_keeps_first_places(spark):
    p = spark.createDataFrame([("p", ["x", "b", "a", "x"]), ("q", None)], "paper_id string, cites array<string>")
    closure = spark.createDataFrame([("b", "a")], "alias string, target string")
    got = {r.paper_id: r.cites for r in maintain.rewritten(p, closure, "cites").collect()}
    assert got == {"p": ["x", "a"], "q": None}


def papers_for_merge(spark):
    rows = [("a", "owned", "T", None, None, None), ("b", "external_owned", "T2", "10.1/b", "abs", None), ("c", "stub", "C", None, None, None), ("e", "stub", "E", None, None, "b")]
    return spark.createDataFrame(rows, "paper_id string, type string, title string, doi string, abstract string, superseded_by string")


def test_merge_moves_everything_to_the_canonical_paper(spark):
    plan = spark.createDataFrame([("a", "b")], "canonical_id string, alias_id string")
    p, e = maintain.merged(papers_for_merge(spark), edges(spark, [("c", "b"), ("c", "a"), ("b", "a"), ("e", "c")]), plan, ["doi", "abstract"])
    got = {r.paper_id: r for r in p.collect()}
    assert (got["a"].doi, got["a"].abstract, got["a"].type, got["a"].superseded_by) == ("10.1/b", "abs", "owned", None)
    assert got["b"].superseded_by == "a" and got["e"].superseded_by == "a"
    assert ids(e, "citing_id", "cited_id") == [("a", "c"), ("c", "a")]
    bad = spark.createDataFrame([("a", "a"), ("b", "zz")], "canonical_id string, alias_id string")
    assert {r.rule for r in maintain.valid_merges(bad, papers_for_merge(spark)).collect()} == {"unknown id", "alias is canonical of its own group", "alias is canonical elsewhere"}


def test_forward_citations(spark):
    papers = spark.createDataFrame([("own", "s0", None), ("known", None, "10.1/K"), ("doe_2020_carbon", None, None)], "paper_id string, s2_id string, doi string")
    rows = [(1, "own", "K", ["X"], "2019", None, "doi:10.1/k"), (2, "own", "Carbon now", ["Jane Doe"], "2020", "n1", None), (3, "own", "Carbon again", ["Doe"], "2020", "n1", None), (4, "own", "Self", [], None, "s0", None)]
    entries = spark.createDataFrame(rows, "entry_id int, cited_id string, title string, authors array<string>, year string, s2_id string, doi string")
    stubs, new, lists = maintain.applied_forward(papers, edges(spark, [("known", "own")]), entries)
    assert ids(stubs, "paper_id", "title") == [("doe_2020_carbon_2", "Carbon now")]
    assert ids(new, "citing_id", "cited_id") == [("doe_2020_carbon_2", "own")]
    assert lists.first().forward_cited_by == ["doe_2020_carbon_2", "known"]


def test_extraction_added(spark):
    before = spark.createDataFrame([("p", "stub", "P"), ("old", "stub", "Old"), ("kept", "owned", "Kept")], "paper_id string, type string, title string")
    cites = spark.createDataFrame([("p", "new", "New"), ("p", "kept", "Kept"), ("q", "far", "Of another")], "citing_id string, id string, title string")
    p, e = maintain.added_extraction(before, edges(spark, [("p", "old"), ("kept", "p")]), before.filter("paper_id = 'p'"), cites)
    assert ids(p, "paper_id", "type") == [("kept", "owned"), ("new", "stub"), ("p", "owned")]
    assert ids(e, "citing_id", "cited_id") == [("kept", "p"), ("p", "kept"), ("p", "new")]


def test_check_finds_each_kind(spark):
    cols = "key string, id string, type string, title string, superseded_by string, cites array<string>, cited_by array<string>, aliases array<string>, extraction_file string, text_file string, source_db string"
    docs = spark.createDataFrame(
        [("a", "a", "owned", "T", None, ["b", "b", "zz"], [], ["s", "nope"], "f", "", None), ("b", "x", "external_owned", "", None, [], [], [], "f", None, None), ("s", "s", "stub", "S", "s", [], ["s"], [], None, None, None), ("d", "d", "odd", "D", None, ["s"], [], [], None, None, None)],
        cols,
    )
    rules = {r.rule for r in maintain.check(docs, {"owned_count": 2, "stub_count": 7}).collect()}
    assert rules == {
        "cites without cited_by", "dangling cites", "self-citation", "invalid type", "duplicates in cites", "id differs from key", "owned without title", "owned without text_file",
        "external with extraction_file", "external without source_db", "unknown alias", "alias not superseded by its paper", "superseded by itself", "cites a superseded paper", "metadata stub_count",
    }


def test_check_equals_plain_rules(spark):
    import random
    from collections import Counter

    rng = random.Random(6)
    some = lambda n: [rng.randrange(24) for _ in range(rng.randrange(n))]
    rows = [(k, rng.choice(["owned", "stub"]), str(rng.randrange(22)) if rng.random() < 0.3 else None, some(6), some(6), some(3)) for k in range(20)]
    gone, keys = {k: int(s) for k, _, s, *_ in rows if s}, {k for k, *_ in rows}
    cites, back = {k: c for k, _, _, c, _, _ in rows}, {k: b for k, _, _, _, b, _ in rows}
    expected = Counter()
    for k, _, s, c, b, a in rows:
        for name, items, theirs in (("cites", c, back), ("cited_by", b, cites)):
            other = "cited_by" if name == "cites" else "cites"
            expected.update((f"dangling {name}", k, str(r)) for r in items if r not in keys)
            expected.update((f"{name} without {other}", k, str(r)) for r in items if k not in gone and r in keys and r not in gone and k not in theirs[r])
            if len(set(items)) < len(items):
                expected[f"duplicates in {name}", k, ""] += 1
        expected.update(("unknown alias", k, str(r)) for r in a if r not in keys)
        expected.update(("alias not superseded by its paper", k, str(r)) for r in a if r in keys and gone.get(r) != k)
        if old := [r for r in c if r in gone and k not in gone]:
            expected["cites a superseded paper", k, str(min(old))] += 1
        if k in c + b:
            expected["self-citation", k, ""] += 1
        if s:
            expected.update([("superseded by itself", k, s)] if int(s) == k else [("superseded in a circle", k, s)] if gone.get(int(s)) == k else [])
    docs = spark.createDataFrame(rows, "key long, type string, superseded_by string, cites array<long>, cited_by array<long>, aliases array<long>")
    assert Counter((r.rule, int(r.id), r.detail) for r in maintain.check(docs).collect()) == expected
    assert maintain.check(docs.limit(0)).count() == 0


PAPER = "paper_id string, title string, authors array<string>, author_key string, doi string, s2_id string, year string, type string, abstract string, cites array<string>, cited_by array<string>"


def pair(spark, a, b):
    rows = [(k, p.get("title"), p.get("authors", []), None, p.get("doi"), p.get("s2"), p.get("year"), "stub", None, p.get("cites", []), p.get("cited_by", [])) for k, p in (("a", a), ("b", b))]
    pairs = spark.createDataFrame([("a", "b")], "id_a string, id_b string")
    return resolve.pair_scores(pairs, spark.createDataFrame(rows, PAPER)).first()


def refs(n, start=0):
    return [f"r{i}" for i in range(start, start + n)]


@pytest.mark.parametrize(
    ("a", "b", "low", "high", "signals"),
    [
        ({"doi": "10.1/A"}, {"doi": "https://doi.org/10.1/a"}, 4, 4, {"doi_match"}),
        ({"s2": "x"}, {"s2": "x"}, 4, 4, {"s2_id_match"}),
        ({"title": "Climate policy and carbon prices in Europe"}, {"title": "Climate policy and carbon prices in Europe"}, 5, 5, {"title_exact"}),
        ({"authors": ["Smith, A.", "Jones, B."]}, {"authors": ["Smith, A.", "Jones, B."]}, 1.5, 1.5, {"first_author", "author_overlap_high"}),
        ({"authors": ["Smith, A."]}, {"authors": ["Jones, B.", "Smith, A.", "Roe, C."]}, 0.5, 0.5, {"author_contained", "author_overlap_low"}),
        ({"year": "2001"}, {"year": "2002"}, 0.3, 0.3, {"year_close"}),
        ({"cited_by": refs(3)}, {"cited_by": refs(3)}, 0.8, 0.8, {"cited_by_overlap"}),
        ({"cited_by": refs(2)}, {"cited_by": refs(2)}, 0, 0, set()),
        ({"cites": refs(10)}, {"cites": refs(7) + refs(3, 50)}, 4, 4, {"cites_overlap_mid"}),
        ({"cites": refs(10)}, {"cites": refs(8) + refs(3, 50)}, 5, 5, {"cites_overlap_strong"}),
        ({}, {}, 0, 0, set()),
    ],
)
def test_pair_scores(spark, a, b, low, high, signals):
    r = pair(spark, a, b)
    assert low <= r.score <= high and set(r.signals) == signals


@pytest.mark.parametrize(
    ("signals", "sim", "length", "cites", "score", "match", "skip"),
    [
        (["doi_match"], 0.1, 10, 0.0, 4.0, True, False),
        ([], 0.98, 50, 0.0, 6.1, True, False),
        ([], 0.98, 30, 0.0, 6.1, False, False),
        (["first_author"], 0.5, 10, 0.85, 5.1, True, False),
        ([], 0.72, 10, 0.85, 3.0, True, False),
        ([], 0.45, 10, 0.0, 3.9, False, True),
        ([], 0.29, 10, 0.4, 9.0, False, True),
        ([], 0.55, 10, 0.3, 4.5, False, False),
    ],
)
def test_classes(spark, signals, sim, length, cites, score, match, skip):
    df = spark.createDataFrame([(signals, sim, length, cites, score)], "signals array<string>, title_similarity double, title_len int, cites_jaccard double, score double")
    r = df.select(resolve.auto_match().alias("m"), resolve.auto_skip().alias("s")).first()
    assert (r.m, r.s) == (match, skip)


def test_citations_that_no_index_finds(spark):
    papers = [("p1", "carbon prices in european power markets", ["Doe, J."], "doe", None, None, "2001", "stub", None, refs(9), []), ("p2", "an unrelated text of something", ["Roe, K."], "roe", None, None, "1980", "stub", None, refs(5, 90), []), ("p3", "more", ["Poe, L.", "Moe, M."], "poe", "10.1/x", None, "1999", "stub", None, [], [])]
    cited = [
        (1, *papers[2][1:4], "10.1/x", *papers[2][5:]),  # by its DOI
        (2, "carbon price in european power markets", [], None, None, None, None, None, None, [], []),  # by a title that is alike
        (3, "", ["Moe, M.", "Poe, L."], None, None, None, None, None, None, [], []),  # by surnames
        (4, "nothing", [], None, None, None, None, None, None, refs(5, 90), []),  # by references
        (5, "nothing at all", [], None, None, None, None, None, None, [], []),
    ]
    got = resolve.candidates_of(spark.createDataFrame(cited, "ref int, " + PAPER.split(", ", 1)[1]), spark.createDataFrame(papers, PAPER))
    assert ids(got, "ref", "paper_id") == [("1", "p3"), ("2", "p1"), ("3", "p3"), ("4", "p2")]


def test_hubs_make_no_pairs(spark):
    """A paper that cites everything proposes nothing for two common citers, and is counted."""
    rows = [("hub", f"r{k}") for k in range(300)] + [("a", "r1"), ("a", "r2"), ("b", "r1"), ("b", "r3"), ("b", "r2")]
    got = graph.shared_counts(edges(spark, rows), "cited_id", "citing_id", 2)
    assert ids(got, "a", "b", "n") == [("r1", "r2", 3), ("r1", "r3", 2), ("r2", "r3", 2)]
    three = graph.shared_counts(edges(spark, rows), "cited_id", "citing_id", 3)
    assert ids(three, "a", "b", "n") == [("r1", "r2", 3)]


def test_overlaps_equal_brute_force(spark):
    import random

    rng = random.Random(1)
    lists = {f"p{k}": {f"r{int(rng.paretovariate(0.6)) % 40}" for _ in range(rng.randrange(1, 15))} for k in range(80)}
    df = edges(spark, [(p, r) for p, refs_ in lists.items() for r in refs_])
    for least in (0.3, 0.5, 1.0):
        expected = [(a, b, len(lists[a] & lists[b])) for a in lists for b in lists if a < b and len(lists[a] & lists[b]) / len(lists[a] | lists[b]) >= least]
        assert ids(graph.reference_overlap(df, least), "id_a", "id_b", "shared") == sorted(expected)
    for least in (1, 2, 4):
        expected = [(a, b, len(lists[a] & lists[b])) for a in lists for b in lists if a < b and len(lists[a] & lists[b]) >= least]
        assert ids(graph.shared_counts(df, "citing_id", "cited_id", least), "a", "b", "n") == sorted(expected)


def test_hubs_are_cut_for_centrality(spark):
    rows = [("hub", f"r{k}") for k in range(200)] + [(f"r{k}", f"r{(k * 7 + 1) % 200}") for k in range(200)] + [(f"r{k}", "hub") for k in range(0, 200, 3)]
    kept = centrality._Edges(edges(spark, rows))
    assert {r.citing_id for r in kept.hubs.collect()} == {"hub"} and kept.rows.count() == len(rows)
    assert kept.rows.filter("citing_id = 'hub'").select("piece").distinct().count() > 1
    papers = nodes(spark, ["hub", *(f"r{k}" for k in range(200))])
    got = {r.paper_id: r.score for r in centrality.pagerank(papers, edges(spark, rows), tol=0, max_iter=4).collect()}
    out = {}
    for a, b in rows:
        out.setdefault(a, []).append(b)
    score = dict.fromkeys(got, 1 / 201)
    for _ in range(4):
        new = dict.fromkeys(got, 0.15 / 201)
        for a, bs in out.items():
            for b in bs:
                new[b] += 0.85 * score[a] / len(bs)
        score = new
    assert all(got[p] == pytest.approx(score[p]) for p in got)


def test_canonical_paper(spark):
    rows = [("o", "owned", None), ("e", "external_owned", "d"), ("s1", "stub", None), ("s2", "stub", "d"), ("s0", "stub", None)]
    p = spark.createDataFrame([(i, "t", [], None, d, None, None, k, None, [], []) for i, k, d in rows], PAPER)
    groups = [("o", 1), ("e", 1), ("s1", 2), ("s2", 2), ("s0", 3), ("s1", 3)]
    got = resolve.canonical(spark.createDataFrame(groups, "paper_id string, group int"), p)
    assert ids(got, "group", "canonical_id") == [(1, "o"), (2, "s2"), (3, "s0")]


def test_blocks_over_the_cap_propose_nothing(spark):
    p = spark.createDataFrame([(i, "k") for i in range(5)], "paper_id long, author_key string")
    assert resolve.block_pairs(p, F.col("author_key"), 4).count() == 0
    assert resolve.block_pairs(p, F.col("author_key"), 5).count() == 10


def test_new_ids_skip_taken_numbers(spark):
    bases = spark.createDataFrame([("b", 1), ("b", 2), ("b", 3), ("c", 1)], "base string, n0 int")
    have = spark.createDataFrame([("b",), ("b_3",)], "paper_id string")
    assert ids(resolve.assign_ids(bases, have, "n0"), "paper_id") == ["b_2", "b_4", "b_5", "c"]


def test_canonical_of_every_group(spark, monkeypatch):
    from citeloom.plans import catalog, resolution

    pairs = spark.range(1, 1201).selectExpr("2 * id as id_a", "2 * id + 1 as id_b", "8.0d as score", "'auto' as bucket")
    papers = spark.range(2, 2402).selectExpr("id as paper_id", "'stub' as type", "'' as doi", "'' as abstract", "array('a') as cites", "array('b') as cited_by", "'t' as title")
    monkeypatch.setattr(resolution, "_scored", lambda spark, d: (pairs, papers))
    monkeypatch.setattr(resolve, "classified", lambda scored, threshold: scored)
    got = catalog.QUERIES["canonical"](spark, "")
    assert ids(got, "canonical_id") == list(range(2, 2402, 2))
    assert catalog.QUERIES["confident_groups"](spark, "").count() == 50


def test_scored_pairs_have_the_defined_cap(spark, monkeypatch):
    from citeloom.plans import catalog, resolution

    papers = spark.range(100).selectExpr("id as paper_id", "if(id < 45, 'one long title', concat('another title ', id)) as title", "concat('a', id) as author_key", "concat('d', id) as doi", "concat('s', id) as s2_id", "array(concat('Doe', id)) as authors", "2000 as year", "'stub' as type", "'' as abstract", "array('a') as cites", "array('b') as cited_by")
    monkeypatch.setattr(catalog.C, "full_papers", lambda spark, d: papers)
    assert resolution._scored(spark, "")[0].filter("id_b < 45").count() == 45 * 44 // 2


def test_author_groups(spark):
    names = spark.createDataFrame([("p1", "Doe, J."), ("p2", "Doe, Jane A."), ("p3", "Doe, J. A."), ("p4", "Doe, K."), ("p1", "World Bank"), ("p2", "et al.")], "paper_id string, name string")
    got = {r.group: r for r in A.person_groups(names).collect()}
    assert set(got) == {"doe_ja", "doe_k"}
    assert (got["doe_ja"].canonical_name, got["doe_ja"].author_id, got["doe_ja"].paper_count) == ("Doe, Jane A.", "doe_jane", 3)
    assert ids(A.institutions(names), "author_id") == ["world_bank"]


def test_author_links(spark):
    entities = spark.createDataFrame([("doe_jane", "Doe, Jane A.", "Doe, Jane A.|Doe, J. A."), ("doe_k", "Doe, K.", "Doe, K.")], "author_id string, canonical_name string, name_variants string")
    names = spark.createDataFrame([("Doe, Jane A.",), ("Doe, Janet A.",), ("Doe, J.",), ("Doe, Zoe",), ("Roe, K.",)], "name string")
    got = {r.name: (r.author_id, r.score) for r in A.link_scores(names, entities).collect()}
    assert got == {"Doe, Jane A.": ("doe_jane", 5), "Doe, Janet A.": ("doe_jane", 4), "Doe, J.": ("doe_jane", 2)}
    lines = spark.createDataFrame([("# no",), ("Doe, J. -> doe_jane",), ("OVERRIDE: A, B -> c",)], "value string")
    assert ids(A.parse_decisions(lines), "name", "author_id", "override") == [("A, B", "c", True), ("Doe, J.", "doe_jane", False)]


def test_search_and_fallback(spark):
    docs = spark.createDataFrame([(1, "Carbon prices"), (2, "carbon carbon tax"), (3, None), (4, "x_y 100%")], "id long, t string")
    assert [r.id for r in search.search(docs, "id", ["t"], "carbon").collect()] == [2, 1]
    assert ids(search.search_or_contains(docs, "id", ["t"], "x_y 100%"), "id") == [4]
    assert ids(search.contains_any(docs, ["t"], "_"), "id") == [4]
    assert search.bm25(docs, "id", ["t"], "").count() == 0


def test_only_reading_statements(spark):
    for s in ("DROP TABLE x", "SELECT 1; SELECT 2", "INSERT INTO x VALUES (1)"):
        with pytest.raises(ValueError):
            lookup.sql(spark, {}, s)


def test_changes_and_undo(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, None)], "k long, v string")
    found = store.changes(old, new, "k")
    assert ids(found, "k", "operation") == [(1, "remove"), (2, "replace"), (3, "add")]
    assert ids(store.undone(new, found, "k"), "k", "v") == [(1, "a"), (2, "b")]


def test_history_and_upsert(spark, tmp_path):
    old = spark.createDataFrame([(1, "a")], "k long, v string")
    found = store.changes(old, spark.createDataFrame([(1, "b")], "k long, v string"), "k")
    for n in range(2):
        store.record(spark, str(tmp_path / "h"), found, "test", f"change {n}")
    assert store.newest(spark.read.parquet(str(tmp_path / "h")), 1).count() == 1
    assert ids(store.filled(old, spark.createDataFrame([(1, "z")], "k long, v string"), "k", ["v"], overwrite=True), "v") == ["z"]


def test_documents_to_tables(spark, tmp_path):
    (tmp_path / "papers.json").write_text(json.dumps({"papers": {"a": {"id": "a", "type": "owned", "title": "T", "authors": ["Doe, J.", "Roe, K."], "year": "c2001", "cites": ["b", "gone"], "extraction_meta": {"passes_completed": [2, 1]}}, "b": {"type": "stub", "title": "B", "cited_by": ["a"]}, "old": {"superseded_by": "a", "cites": ["b"]}}}))
    docs = documents.load_papers(spark, str(tmp_path / "papers.json"))
    got = {r.paper_id: r for r in documents.papers_table(docs).collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"].authors, got["a"].year, got["a"].detail_level, got["a"].passes_completed) == ("Doe, J.; Roe, K.", 2001, "contexts", "1,2")
    assert ids(documents.edges_table(docs), "citing_id", "cited_id", "cited_title") == [("a", "b", "B"), ("a", "gone", "")]
    assert ids(documents.citation_counts(docs), "paper_id", "cited_by_count") == [("a", 0), ("b", 1), ("old", 0)]


def test_extractions_leave_out_sidecars_and_broken_files(spark, tmp_path):
    x = {"claims": [{"claim": "c", "supporting_citations": ["b"]}], "keywords": ["k"], "topics": {"themes": ["t"], "other": ["no"]}, "data_sources": [{"name": "n", "type": "y"}, "bare"], "citations": [{"id": "b", "title": "B", "contexts": [{"purpose": "background"}]}]}
    (tmp_path / "a.json").write_text(json.dumps(x))
    (tmp_path / "a.refs.json").write_text("{}")
    (tmp_path / "bad.json").write_text("[1")
    ex = documents.load_extractions(spark, str(tmp_path))
    tables = documents.extraction_tables(ex)
    assert ids(tables["claims"], "paper_id", "claim", "supporting_citations") == [("a", "c", '["b"]')]
    assert ids(tables["topics"], "field", "value") == [("themes", "t")]
    assert ids(tables["data_sources"], "name") == ["bare", "n"]
    assert ids(documents.context_index(ex), "citing", "cited", "purpose") == [("a", "b", "background")]


def test_files_are_taken_up_once(spark, tmp_path):
    from citeloom.streaming.incremental import extraction_stream, into_parquet, take_up

    src, out, chk = (str(tmp_path / n) for n in ("src", "out", "chk"))
    (tmp_path / "src").mkdir()
    for n, name in enumerate(("a", "b")):
        (tmp_path / "src" / f"{name}.json").write_text(json.dumps({"keywords": [name]}))
        take_up(extraction_stream(spark, src), chk, into_parquet(out, "paper_id"))
        assert spark.read.parquet(out).count() == n + 1


def test_findings(spark):
    f = spark.createDataFrame([(1, "Carbon", "q", "s", ["x"], [("a", "", "")]), (2, "Other", "q", "s", ["x", "y"], [("a", "", ""), ("zz", "", "")])], "finding_id int, title string, question string, summary string, tags array<string>, papers array<struct<paper_id:string,relevance:string,note:string>>")
    pairs = findings.finding_papers(f).select("finding_id", "paper_id")
    assert ids(findings.missing(pairs, nodes(spark, "a", "owned")), "paper_id", "n_findings") == [("zz", 1)]
    assert ids(findings.overlap(pairs, 1, 2), "paper_id") == ["a"]
    assert ids(findings.containing(f, "CARBON"), "finding_id") == [1]
    assert ids(findings.with_flags(pairs, nodes(spark, "a", "owned")), "finding_id", "paper_id", "in_db", "owned") == [(1, "a", True, True), (2, "a", True, True), (2, "zz", False, False)]


def test_pairs_of_a_paper_with_very_many_citers(spark):
    """Neighbours are compared as rows: no list of them is in an exchange, and the hub's list isn't read for each pair."""
    n = 100_000
    many = spark.range(n).selectExpr("concat('c', id) as c").agg(F.collect_list("c").alias("cited_by"))
    hub = many.selectExpr("'hub' as paper_id", "'' as title", "cited_by")
    rest = spark.range(40).selectExpr("concat('p', id) as paper_id", "'' as title", "transform(sequence(0, 9), x -> concat('c', if(id % 2 = 0, x, x + 200000))) as cited_by")
    papers = hub.unionByName(rest).selectExpr("paper_id", "title", "array() as authors", "cast(null as string) as doi", "cast(null as string) as s2_id", "cast(null as string) as year", "cast(array() as array<string>) as cites", "cited_by")
    papers = papers.withColumn("authors", F.array().cast("array<string>"))
    pairs = spark.range(40).selectExpr("'hub' as id_a", "concat('p', id) as id_b")
    stored = resolve.neighbour_store(papers)
    found = resolve.shared_neighbours(pairs, stored)
    assert {(r["id_b"], r["cited_by_a"], r["cited_by_b"], r["cited_by_both"]) for r in found.collect()} == {(f"p{k}", n, 10, 10 if k % 2 == 0 else 0) for k in range(40)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "array" not in plan.split("Exchange")[-1] and "Bucketed: true" in plan
    assert resolve.pair_scores(pairs, papers).count() == 40


def test_rounded_ranking_goes_by_id_where_scores_look_alike(spark):
    scores = spark.createDataFrame([(1, 0.30000001), (2, 0.30000002), (3, 0.5), (4, 0.1), (5, 0.9)], "paper_id long, score double")
    papers = spark.createDataFrame([(i, f"t{i}", "stub" if i == 5 else "owned") for i in range(1, 6)], "paper_id long, title string, type string")
    shown = centrality.ranked(scores, papers, 3, ["owned"], 3).collect()
    assert [(r["rank"], r.paper_id, r.score) for r in shown] == [(1, 3, 0.5), (3, 1, 0.3), (2, 2, 0.3)]
    assert [(r["rank"], r.paper_id) for r in centrality.ranked(scores, papers, 2).collect()] == [(1, 5), (2, 3)]


def test_block_scores_are_pair_scores_of_candidate_pairs(spark, monkeypatch):
    """Pairs of several blocks come once, blocks over the cap make none, lists too long to move are scored as well, and no pair is shuffled."""
    def rows(k):
        return (k, f"a long title of paper {k % 7} here", [f"Name{k % 3}, A.", f"Name{k % 5}, B."], f"key{k % 6}", f"10.1/{k // 2}" if k % 4 < 2 else "", f"S{k // 3}" if k % 3 else None, str(1990 + k % 3), "owned", "", [f"c{j}" for j in range(k % 4, k % 9)], [f"d{j}" for j in range(k % 6 + 2)])

    papers = spark.createDataFrame([rows(k) for k in range(60)], "paper_id long, title string, authors array<string>, author_key string, doi string, s2_id string, year string, type string, abstract string, cites array<string>, cited_by array<string>")
    for cap, carried in ((200, 1000), (9, 1000), (200, 4), (200, 0)):
        monkeypatch.setattr(resolve, "CARRIED", carried)
        expected = sorted(map(str, resolve.pair_scores(resolve.candidate_pairs(papers, cap, cap), papers).collect()))
        assert sorted(map(str, resolve.block_scores(papers, cap=cap, title_cap=cap).collect())) == expected and expected
    monkeypatch.setattr(resolve, "CARRIED", 1000)
    plan = resolve.block_scores(papers)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Aggregate" not in plan


@pytest.mark.parametrize("name", ["auto_groups", "canonical", "confident_groups", "dense_parts"])
def test_groups_make_no_table_of_pairs(spark, monkeypatch, name):
    from citeloom.plans import catalog

    def never(*_):
        raise AssertionError("pairs are scored in their blocks")

    monkeypatch.setattr(resolve, "candidate_pairs", never)
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_overlap_of_references_compares_few_lists_in_full(spark, monkeypatch):
    """All similar pairs, of short lists and of lists that contain each other; pairs that share one reference are not compared in full."""
    import random

    rng = random.Random(5)
    lists = {p: set(rng.sample(range(40), rng.randint(1, 12))) for p in range(60)} | {100: {1}, 101: {1}, 102: {1, 2, 3, 4}, 103: set(range(16)), 104: set(range(4))}
    e = spark.createDataFrame([(p, i) for p, of in lists.items() for i in of], "citing_id long, cited_id long")
    for least in (0.25, 0.5, 1.0):
        want = {(a, b, len(x & y)) for a, x in lists.items() for b, y in lists.items() if a < b and len(x & y) >= least * len(x | y) - 1e-9}
        assert {(r.id_a, r.id_b, r.shared) for r in graph.reference_overlap(e, least).collect()} == want and want
    written = []
    cut = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: written.append(cut(df)) or written[-1])
    sparse = spark.createDataFrame([(p, i) for p in range(60) for i in [0, *range(100 * p + 1, 100 * p + 10)]], "citing_id long, cited_id long")
    assert graph.reference_overlap(sparse, 0.25).count() == 0
    assert [w.count() for w in written if "id_b" in w.columns] == [0]
