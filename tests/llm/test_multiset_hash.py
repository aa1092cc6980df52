"""Fingerprints: the algebra of the vectors, and the operator against a plain pass."""

import hashlib

import numpy as np

from citeloom.llm import multiset_hash as M

from .conftest import DOCS


def plain(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    texts = [r[1] or "" for r in order]
    out = []
    for k, t in enumerate(texts):
        after, half = texts[(k + 1) % len(texts)], len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = (M.Vectors.of([x]) for x in (t, edited, after))
        out.append((order[k][0], len(t), hashlib.sha256(edited.encode()).hexdigest(), a.spelled()[0], b.spelled()[0], float(a.near(b)[0]), float(a.near(c)[0])))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


PROSE = ["one two three four five six", "été 日本語 🙂 text of some words here", "", "a", "lines\nof\n\ntext\r\n", "word " * 5000, " \t ", "one two three four five six", "same start but other end\nand more"]


def test_equals_a_plain_pass(spark, table):
    rows = [(k * 7 - 20, t, None, None, None) for k, t in enumerate(PROSE * 30)] + [(None, "no id", None, None, None), (10**6, None, None, None, None)]
    for n in (1, 4):
        assert found(M.edited_fingerprints(table(rows, DOCS).repartition(n))) == plain(rows)


def test_extreme_ids_and_one_hot_id(spark, table):
    rows = [(2**63 - 1, "top", None, None, None), (-(2**63), "least", None, None, None), (2**60 + 1, "x y z", None, None, None), (2**60 + 2, "x y w", None, None, None), (None, "none", None, None, None)]
    got = found(M.edited_fingerprints(table(rows, DOCS)))
    assert got == plain(rows)
    hot = [(5, f"{k:04d} text {k}", None, None, None) for k in range(2000)] + [(k, "other", None, None, None) for k in range(4)]
    got = M.edited_fingerprints(table(hot, DOCS)).collect()
    assert len(got) == len(hot) and len({r["edited_sha256"] for r in got if r["doc_id"] == 5}) > 1000


def test_a_single_row_follows_itself_and_an_empty_table_gives_none(spark, table):
    assert found(M.edited_fingerprints(table([(1, "abcd", None, None, None)], DOCS))) == plain([(1, "abcd")])
    assert found(M.edited_fingerprints(table([], DOCS))) == []


def test_order_of_paragraphs_and_increments(spark, table):
    a = M.Vectors.of(["first one\nsecond\nsecond\nthird of them all"]).spelled()[0]
    b = M.Vectors.of(["second\nthird of them all\nfirst one\n\nsecond"]).spelled()[0]
    assert a == b and a != M.Vectors.of(["first one\nsecond\nthird of them all"]).spelled()[0]
    assert M.changed(a, inserted=["new here", "and here"], deleted=["second"]) == M.Vectors.of(["first one\nsecond\nthird of them all\nnew here\nand here"]).spelled()[0]
    assert M.changed(a, deleted=["first one", "second", "second", "third of them all"]) == M.Vectors.of([""]).spelled()[0]
    rows = [(1, "first one\nsecond", None, None, None), (2, "second\nfirst one", None, None, None), (None, None, None, None, None)]
    got = dict(map(tuple, M.fingerprints(table(rows, DOCS)).collect()))
    assert got[1] == got[2] and got[None] == M.Vectors.of([""]).spelled()[0]


def test_spelling_is_reversible():
    v = M.Vectors.of(["a b c " * 400, "", "\n".join(f"line {k} of many" for k in range(500))])
    v.lanes[1, :5] = [-(2**31), 2**31 - 1, 64, -65, 8192]
    back = M.Vectors.parsed(v.spelled())
    assert (back.exact == v.exact).all() and (back.lanes == v.lanes).all()


def test_likeness_follows_what_is_shared():
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(5000)]
    texts = [" ".join(rng.choice(words, 600)) for _ in range(40)]
    v = M.Vectors.of(texts)
    for keep in (0.25, 0.5, 0.9):
        cut = int(600 * keep)
        w = M.Vectors.of([" ".join(t.split()[:cut] + o.split()[cut:]) for t, o in zip(texts, texts[::-1], strict=True)])
        assert abs(v.near(w).mean() - keep) < 0.04 and np.abs(v.near(w) - keep).max() < 0.2
    assert v.near(v).min() == 1 and v.near(v[::-1]).max() < 0.2
    assert M.Vectors.of(["", ""]).near(M.Vectors.of(["", "a"])).tolist() == [1.0, 0.0]
