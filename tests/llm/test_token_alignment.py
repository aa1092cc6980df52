"""Alignment against a plain merge over the libraries' own tokens."""

import hashlib
from collections import Counter, defaultdict

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from citeloom.llm import token_alignment as A  # noqa: E402

from .conftest import DOCS  # noqa: E402

LEFT, RIGHT = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "The quick brown fox jumps over the lazy dog.",
    "The quick brown fox jumps over the lazy dog.",
    None,
    "",
    " ",
    "  two  spaces \t and\n\nlines  ",
    "été à la mer, naïve façade — 日本語 テスト 🙂",
    "a space mark ▁ isn't given back",
    "<|endoftext|> and <s> are <0x41> plain </s>",
    "no break   wide　 spaces \u0085 x",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa ======================= 1234567890",
    "é è  é́ don't we'll I'd it's",
    "nul \x00 and \x7f and \x1c control",
    "word " * 3000 + "x" * 3000,
]


def plain(texts):
    """Rows by the contract: two pointers over each text's tokens, then counts."""
    left, right = A._Left(LEFT), A._Right(RIGHT)
    rows, links = [], []
    for t in texts:
        a, b = (left.encode([" " + t])[0], right.encode([" " + t])[0]) if t else ([], [])
        if any(b"".join(side.raw[i] for i in ids) != (" " + t).encode() for side, ids in ((left, a), (right, b)) if t):
            a, b = [], []
        groups, i, j, at = [], 0, 0, [0, 0]
        while i < len(a):
            first, at = (i, j), [at[0] + len(left.raw[a[i]]), at[1] + len(right.raw[b[j]])]
            i, j = i + 1, j + 1
            while at[0] != at[1]:
                if at[0] < at[1]:
                    at[0] += len(left.raw[a[i]])
                    i += 1
                else:
                    at[1] += len(right.raw[b[j]])
                    j += 1
            groups.append((a[first[0] : i], b[first[1] : j]))
        links.append(Counter((x, y) for ga, gb in groups for x in ga for y in gb))
        text = ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in groups)
        rows.append([len(a), len(b), len(groups), sum(links[-1].values()), hashlib.sha256(text.encode()).hexdigest() if text else ""])
    counts, most = Counter(p for x in links for p in x), defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    return [(*r[:4], sum(m for p, m in x.items() if counts[p] == most[p[0]]), sum(m * counts[p] for p, m in x.items()), r[4]) for r, x in zip(rows, links, strict=True)]


def found(df):
    rows = A.scored(df, A.pair_counts(df)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    return sorted((tuple(r) for r in rows), key=repr)


def test_equals_a_plain_merge(spark, table):
    docs = table([(k, t, None, None, None) for k, t in enumerate(TEXTS)], DOCS)
    assert found(A.align(docs, LEFT, RIGHT)) == sorted(((k, *r) for k, r in enumerate(plain(TEXTS))), key=repr)


def test_rare_pairs_meet_in_a_shuffle(spark, table, monkeypatch):
    monkeypatch.setattr(A, "HOT", 3)  # all but three pairs at most
    docs = table([(k, t, None, None, None) for k, t in enumerate(TEXTS)], DOCS)
    assert found(A.align(docs, LEFT, RIGHT)) == sorted(((k, *r) for k, r in enumerate(plain(TEXTS))), key=repr)


def test_null_and_repeated_ids_stay_apart(spark, table):
    docs = table([(None, "one two", None, None, None), (None, "one", None, None, None), (3, "one two", None, None, None), (3, "one two", None, None, None)], DOCS)
    want = plain(["one two", "one", "one two", "one two"])
    assert found(A.align(docs, LEFT, RIGHT)) == sorted(((k, *r) for k, r in zip([None, None, 3, 3], want, strict=True)), key=repr)


def test_empty_table_gives_no_rows(spark, table):
    assert found(A.align(table([], DOCS), LEFT, RIGHT)) == []


def test_chunks_give_what_whole_texts_give():
    coder = A.Aligner(f"{LEFT}\n{RIGHT}")
    assert coder.cuts
    texts = [t or "" for t in TEXTS]
    chunked, whole = coder.documents(texts), coder.documents(texts, whole=True)
    assert chunked[0] == whole[0]
    for a, b in zip(chunked[1:], whole[1:], strict=True):
        assert (a == b).all()


def test_chunks_are_forgotten_and_learnt_again(monkeypatch):
    coder = A.Aligner(f"{LEFT}\n{RIGHT}")
    want = [coder.documents([t or ""]) for t in TEXTS]
    monkeypatch.setattr(A, "REMEMBERED", 8)
    for t, w in zip(TEXTS, want, strict=True):
        got = coder.documents([t or ""])
        assert got[0] == w[0] and all((x == y).all() for x, y in zip(got[1:], w[1:], strict=True))


def test_operator_gives_groups_and_greatest_counts_of_both_sides(spark, table):
    df = A.align(table([(1, "one", None, None, None)], DOCS), LEFT, RIGHT, spelled=True)
    left, right = A._Left(LEFT).encode([" one"])[0], A._Right(RIGHT).encode([" one"])[0]
    assert df.first()["groups"] == f"{left[0]}|{right[0]}"
    assert [tuple(r) for r in A.pair_counts(df).select("a_id", "b_id", "documents", "most_a", "most_b").collect()] == [(left[0], right[0], 1, 1, 1)]
