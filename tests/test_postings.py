"""Stored indexes: equal to scoring everything, and blocks that are skipped."""

import random

import pytest

from citeloom.operators import postings, search


def corpus(spark, n=3000, seed=1):
    rng = random.Random(seed)
    common, rare = ["the", "of", "and", "to"], ["zebra", "quark", "delta"]
    rows = [(k, " ".join(rng.choices(common, k=rng.randint(0, 30)) + rng.choices(rare, k=1 if rng.random() < 0.02 else 0) * rng.randint(1, 6))) for k in range(n)]
    return spark.createDataFrame([*rows, (n, None), (n + 1, ""), (n + 2, "the " * 500)], "id long, text string")


def best(df):
    return [(r["id"], round(r["score"], 9)) for r in df.collect()]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    docs = corpus(spark).cache()
    return docs, postings.build(docs, "id", ["text"], str(tmp_path_factory.mktemp("index")), block=64)


@pytest.mark.parametrize("query", ["the", "zebra the", "quark delta of", "the of and to", "nothing here", ""])
def test_best_equal_those_of_all_scores(built, query):
    docs, index = built
    want = search.top_hits(search.bm25(docs, "id", ["text"], query), "id", 15)
    assert best(postings.top(index, "id", query)) == best(want)
    every = {r["id"]: round(r["score"], 9) for r in search.bm25(docs, "id", ["text"], query).collect()}
    assert {r["id"]: round(r["score"], 9) for r in postings.scores(index, "id", query).collect()} == every


def test_blocks_are_skipped(built):
    _, index = built
    opened = postings.open_blocks(index, "zebra the", 10).groupBy("opened").count().collect()
    n = {r["opened"]: r["count"] for r in opened}
    assert n[True] >= 1 and n[False] > n[True]
    assert postings.open_blocks(index, "zebra", 10**6).filter("not opened").count() == 0  # fewer blocks than rows wanted: all are read


def test_equal_scores_go_by_key(spark, tmp_path):
    docs = spark.createDataFrame([(k, "same words") for k in range(500)], "id long, text string")
    index = postings.build(docs, "id", ["text"], str(tmp_path), block=16)
    assert [k for k, _ in best(postings.top(index, "id", "same", 7))] == list(range(7))


def test_stored_indexes_are_opened_again(spark, tmp_path):
    papers = spark.createDataFrame([("p1", "Carbon prices", "on markets", ["Doe, J."]), ("p2", "Running", None, None)], "paper_id string, title string, abstract string, authors array<string>")
    claims = spark.createDataFrame([("p1", "prices rise", "by 3 percent"), ("p2", "prices fall", None)], "paper_id string, claim string, quantification string")
    made = postings.build_all({"papers": papers, "claims": claims, "edges": papers}, str(tmp_path), stem=True)
    assert set(made) == {"papers", "claims"}
    again = postings.load(spark, f"{tmp_path}/papers")
    assert again.stem and [r["paper_id"] for r in postings.top(again, "paper_id", "run").collect()] == ["p2"] and [r["paper_id"] for r in postings.top(again, "paper_id", "DOE price").collect()] == ["p1"]
    assert postings.top(made["claims"], "key", "prices").count() == 2


def test_an_empty_table_has_an_index_without_hits(spark, tmp_path):
    index = postings.build(spark.createDataFrame([], "id long, text string"), "id", ["text"], str(tmp_path))
    assert postings.top(index, "id", "the").count() == 0


def test_terms_hits_only_are_read(built):
    _, index = built
    plan = index.blocks.filter("term in ('zebra')").select("block", "top")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,zebra)]" in plan or "In(term" in plan
    assert "keys" not in plan.split("ReadSchema")[1]


def test_search_over_all_kinds(spark, tmp_path):
    a = spark.createDataFrame([(k, k % 3, "urgent steel" if k % 2 else "other") for k in range(40)], "id long, paper_id long, text string")
    b = spark.createDataFrame([(9, 77, "steel steel")], "id long, paper_id long, text string")
    kinds = {n: (postings.build(df, "id", ["text"], f"{tmp_path}/{n}"), df, "id") for n, df in (("a", a), ("b", b), ("c", a.filter("false")))}
    got = postings.search_all(kinds, "steel", 10).orderBy("kind", "rank").collect()
    assert [(r["kind"], r["key"], r["rank"], r["total"]) for r in got] == [("a", str(2 * k + 1), k + 1, 20) for k in range(10)] + [("b", "9", 1, 1)]
    assert {r["papers_shown"] for r in got} == {4}


def test_hits_of_a_block_are_gathered_without_a_shuffle_of_hits(spark, tmp_path, monkeypatch):
    plans, kept = [], postings.cut
    monkeypatch.setattr(postings, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df))
    docs = spark.createDataFrame([(k, f"steel word{k % 7} steel the {k}" if k % 5 else None) for k in range(300)], "id int, text string")
    index = postings.build(docs, "id", ["text"], str(tmp_path / "i"), block=16)
    shuffles = [x for p in plans for x in p.splitlines() if "Exchange " in x and "Broadcast" not in x]
    assert len(plans) == 1 and len(shuffles) == 2  # by key and by block
    rows = index.blocks.filter("term = 'steel'").collect()
    assert sorted(k for r in rows for k in r["keys"]) == [k for k in range(300) if k % 5] and all(len({*r["keys"]}) == r["hits"] <= 16 for r in rows)
