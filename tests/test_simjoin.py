"""The similarity join against all pairs, and longest common subsequences of many pairs at once."""

import random

import numpy as np
import pandas as pd
import pytest

from citeloom.functions import similarity as S
from citeloom.operators import simjoin


def words(rng, n, alphabet):
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 30))) for _ in range(n)]
    out = []
    for b in base:
        out.append(b)
        for _ in range(2):  # near ones, by a few edits
            t = list(b)
            for _ in range(rng.randint(0, max(1, len(b) // 3))):
                k = rng.randrange(len(t) + 1)
                t[k : k + rng.randint(0, 1)] = [rng.choice(alphabet)] * rng.randint(0, 1)
            out.append("".join(t))
    return out


def test_lcs_of_many_pairs_equals_one_by_one():
    rng = random.Random(3)
    lengths = [0, 1, 2, 5, 63, 64, 65, 127, 128, 129, 300]
    a = ["".join(rng.choice("abcdé日🙂") for _ in range(rng.choice(lengths))) for _ in range(400)]
    b = ["".join(rng.choice("abcdé日🙂") for _ in range(rng.choice(lengths))) for _ in range(400)]
    assert S.lcs_lengths(a, b).tolist() == [S.lcs_length(x, y) for x, y in zip(a, b, strict=True)]
    assert S.lcs_lengths(a, a).tolist() == [len(x) for x in a] and S.lcs_lengths([], []).tolist() == []


def test_ratios_of_nulls_and_empty_strings():
    got = S.indel_ratio.func(pd.Series(["", None, "ab", "a"]), pd.Series(["", "x", None, "b"]))
    assert got.tolist()[0] == 100.0 and got.isna().tolist() == [False, True, True, False] and got.tolist()[3] == 0.0


@pytest.mark.parametrize("least", [50, 67, 70, 80, 97, 100])
@pytest.mark.parametrize("alphabet", ["ab", "abcdefghij klmno"])
def test_join_loses_no_pair(spark, least, alphabet):
    rng = random.Random(least)
    left, right = words(rng, 25, alphabet), words(rng, 40, alphabet)
    right += left[::3]
    got = simjoin.similar(spark.createDataFrame([(x,) for x in left + [None, ""]], "s string"), spark.createDataFrame([(x,) for x in right + [None, ""]], "s string"), least).collect()
    want = {(x, y): S.indel(x, y) for x in left for y in right if x and y and S.indel(x, y) >= least - 1e-9}
    assert {(r["a"], r["b"]): r["ratio"] for r in got} == want and len(got) == len(want)


def test_join_of_common_grams_and_an_empty_side(spark):
    left = [f"a study of the {k % 7} common words in {k}" for k in range(60)]
    got = simjoin.similar(spark.createDataFrame([(x,) for x in left], "s string"), spark.createDataFrame([(x,) for x in left], "s string"), 95).collect()
    assert {(r["a"], r["b"]) for r in got} == {(x, y) for x in left for y in left if S.indel(x, y) >= 95}
    assert simjoin.similar(spark.createDataFrame([], "s string"), spark.createDataFrame([("x",)], "s string"), 80).count() == 0
    with pytest.raises(ValueError):
        simjoin.similar(spark.createDataFrame([], "s string"), spark.createDataFrame([], "s string"), 0)


def test_plan_has_no_cross_join_and_looks_at_few_pairs(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([("".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(40)),) for _ in range(600)], "s string")
    one = simjoin._strings(rows, 0.9)
    found = simjoin.near_keys(one, one, 0.9)
    assert "CartesianProduct" not in found._jdf.queryExecution().toString() and "NestedLoop" not in found._jdf.queryExecution().toString()
    assert found.count() < 600 * 600 / 5


def test_sets_that_share_enough_meet(spark):
    rng = np.random.default_rng(5)
    sets = [sorted({f"i{x}" for x in rng.zipf(1.5, int(rng.integers(0, 8))) if x < 50}) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(sets)), "key int, items array<string>")
    for share in (0.25, 0.3, 0.8):
        got = {(r["a"], r["b"]) for r in simjoin.sharing(df, df, share).collect()}
        want = {(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if x and y and len({*x} & {*y}) >= share * len({*x} | {*y})}
        assert want <= got and len(got) < 150 * 150


def test_many_staged_records_and_a_hot_title(spark):
    from citeloom.operators import resolve

    n = 21_000  # more than was once allowed
    staged = spark.range(n).selectExpr("id as ref", "concat('record number ', sha2(string(id), 256)) as title")
    papers = spark.range(n + 3000).selectExpr("id as paper_id", "case when id < 3000 then 'one title of very many papers' else concat('record number ', sha2(string(id - 3000), 256), ' x') end as title", "'owned' as type")
    found = resolve.duplicates_of(staged.filter("ref % 40 = 0 or ref > 20990").unionByName(spark.createDataFrame([(-1, "One title of very many papers!"), (-2, "nothing like it"), (-3, None)], "ref long, title string")), papers)
    got = {r["ref"]: r["paper_id"] for r in found.collect()}
    assert got.pop(-1) == 0 and -2 not in got and -3 not in got
    assert got == {k: k + 3000 for k in range(n) if k % 40 == 0 or k > 20990}


def test_lcs_of_one_string_against_many():
    rng = random.Random(4)
    lengths = [0, 1, 2, 5, 63, 64, 65, 127, 128, 129, 300]
    one, many = (["".join(rng.choice("abcdé日🙂") for _ in range(rng.choice(lengths))) for _ in range(n)] for n in (60, 200))
    for least in (0.2, 0.7, 1.0):
        shares, seen = (least / (2 - least), (2 - least) / least), set()
        for number, of, lcs in S.lcs_against(one, many, shares):
            for k, n in zip(of.tolist(), lcs.tolist(), strict=True):
                assert n == S.lcs_length(one[number], many[k])
                seen.add((number, k))
        assert {(i, k) for i, x in enumerate(one) for k, y in enumerate(many) if x and y and S.indel(x, y) >= 100 * least} <= seen
    assert list(S.lcs_against(["a"], [], (0.5, 2))) == [] and list(S.lcs_against([], ["a"], (0.5, 2))) == []


@pytest.mark.parametrize("least", [50, 70, 100])
def test_compared_blocks_are_what_the_join_gives(spark, least, monkeypatch):
    rng = random.Random(least)
    left, right = words(rng, 25, "abcdefghij klmno"), words(rng, 40, "abcdefghij klmno")
    right += left[::3]
    monkeypatch.setattr(simjoin, "BLOCKS", (8, 16))
    sides = [simjoin._strings(spark.createDataFrame([(x,) for x in side], "s string"), least / 100) for side in (left, right)]
    got = simjoin.compared(*sides, least / 100).collect()
    want = {(x, y): S.indel(x, y) for x in left for y in right if x and y and S.indel(x, y) >= least - 1e-9}
    assert {(r["a"], r["b"]): r["ratio"] for r in got} == want and len(got) == len(want)


def test_titles_that_are_much_alike_are_compared_and_no_join_on_grams_is_made(spark, monkeypatch):
    monkeypatch.setattr(simjoin, "near_keys", lambda *_: pytest.fail("a row for each gram that titles share"))
    monkeypatch.setattr(simjoin, "FEW", 0)
    alike = spark.createDataFrame([(f"a study of the {k % 7} common words in {k}",) for k in range(60)], "s string")
    assert simjoin.similar(alike, alike, 70).count() >= 60


def test_a_title_is_looked_for_in_no_lower_tier_than_its_best(spark, monkeypatch):
    from citeloom.operators import resolve

    asked, found = [], resolve.similar_titles
    monkeypatch.setattr(resolve, "similar_titles", lambda left, right, least: asked.append((least, left.count())) or found(left, right, least))
    staged = spark.createDataFrame([(1, "The growth of very small cities"), (2, "Growth of very small cities!"), (3, "nothing like these")], "ref int, title string")
    papers = spark.createDataFrame([(5, "the growth of very small cities", "owned"), (4, "the growth of very small citys", "stub"), (7, "growth of the big cities", "owned")], "paper_id int, title string, type string")
    got = {r["ref"]: (r["paper_id"], r["score"], r["match_type"]) for r in resolve.duplicates_of(staged, papers).collect()}
    assert got == {1: (5, 5.0, "local"), 2: (5, 3.5, "local")} and asked == [(97.0, 3), (90.0, 2), (80.0, 1)]


@pytest.mark.parametrize("least", [50, 70, 97])
def test_join_on_grams_loses_no_pair_where_pairs_are_many(spark, least, monkeypatch):
    monkeypatch.setattr(simjoin, "FEW", 0)
    monkeypatch.setattr(simjoin, "_crowded", lambda *_: False)
    rng = random.Random(least)
    left, right = words(rng, 25, "abcdefghij klmno"), words(rng, 40, "abcdefghij klmno")
    got = simjoin.similar(*(spark.createDataFrame([(x,) for x in side], "s string") for side in (left, right)), least).collect()
    assert {(r["a"], r["b"]) for r in got} == {(x, y) for x in left for y in right if x and y and S.indel(x, y) >= least - 1e-9}
