"""Collocations against plain counting, and sketches that are too small for their input."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from citeloom.llm import collocations as C

from .conftest import DOCS


def plain(rows, least, longest=4, top=2000, share=80):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        best = []
        for p, a in candidates.items():
            if any(100 * b >= share * a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            score, _, left, right = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def rows_of(seed=1, n=300):
    rng = np.random.default_rng(seed)
    vocabulary = ["the", "of", "new", "york", "city", "New", "été", "a-b", "日本", "x y"]
    texts = []
    for _ in range(n):
        words = rng.choice(vocabulary, int(rng.integers(0, 40)), p=[0.3, 0.2, 0.1, 0.1, 0.1, 0.05, 0.05, 0.04, 0.03, 0.03])
        gaps = rng.choice([" ", "  ", "\t", ". ", ",", "\n", "!"], len(words), p=[0.7, 0.05, 0.05, 0.05, 0.05, 0.05, 0.05])
        texts.append("".join(w + g for w, g in zip(words, gaps, strict=True)))
    texts += [None, "", " \t", "...", "new york city " * 500]
    return [(k, t, [None, "en", "und", "fr"][k % 4], None, None) for k, t in enumerate(texts)]


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_equals_plain_counting(spark, table):
    rows = rows_of()
    want = plain(rows, 30)
    assert len(want) > 50 and found(C.collocations(table(rows, DOCS))) == want


@pytest.mark.parametrize("cells", [64, 1 << 12])
def test_small_sketches_lose_nothing(spark, table, monkeypatch, cells):
    monkeypatch.setattr(C, "FEWEST", cells)
    monkeypatch.setattr(C, "MOST", cells)
    monkeypatch.setattr(C, "CHUNK", 32)
    monkeypatch.setattr(C, "SLICE", 500)
    rows = rows_of(2)
    counts = {(r["lang"], r["phrase"]): r["f"] for r in C.phrase_counts(table(rows, DOCS).repartition(5), 5, cells=cells).filter("k > 0").collect()}
    f = defaultdict(Counter)
    for r in plain(rows, 5, top=10**9, share=10**9):
        f[r[0]][r[2]] = r[3]
    assert {(lang, p): a for lang in f for p, a in f[lang].items()} == {k: v for k, v in counts.items() if " " in k[1]}


def test_ranks_stop_at_the_top_and_ties_follow_the_bytes(spark, table):
    rows = [(k, "b c. a b. Z y. é f", "en", None, None) for k in range(40)]
    assert found(C.collocations(table(rows, DOCS), top=3)) == plain(rows, 30, top=3)


def test_nothing_frequent_and_an_empty_table_give_no_rows(spark, table):
    assert found(C.collocations(table([(1, "a b", "en", None, None)], DOCS))) == []
    assert found(C.collocations(table([], DOCS))) == []


def test_large_thresholds_use_wide_cells(spark, table):
    rows = [(k, "a b " * 10, "en", None, None) for k in range(60)]
    assert found(C.collocations(table(rows, DOCS), least=300)) == plain(rows, 300)


def test_sketch_never_underestimates():
    texts = pa.array(["a b a b a b", "a b"])
    words = C.Words(texts, np.zeros(2, np.int64), np.zeros(1, np.uint64))
    assert [(k, len(at)) for k, at, _ in words.grams(4, C._everything)] == [(1, 8), (2, 6), (3, 4), (4, 3)]
    counts = np.zeros((C.ROWS, 8), np.int64)
    _, _, hashes = list(words.grams(2, C._everything))[1]
    for row in range(C.ROWS):
        np.add.at(counts[row], C._cells(hashes, row, 3), 1)
    bits = np.packbits(counts >= 4, axis=1, bitorder="little")
    assert C.Reached(bits, 3)(hashes[:1]).all()  # "a b", four times


def test_scores_stay_exact_beyond_64_bits(spark):
    big = 9_000_000_000_000_000_000
    counts = spark.createDataFrame([("en", 0, "", big), ("en", 1, "a", big), ("en", 1, "b", big - 1), ("en", 2, "a b", big - 7)], "lang string, k int, phrase string, f long")
    assert C.scored(counts).first()["score"] == 2000000 * (big - 7) // (2 * big - 1)
