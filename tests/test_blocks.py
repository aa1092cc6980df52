"""Blocks of strings against blocks of strings: what shared grams rule out isn't compared, and nothing is lost."""

import random
from collections import Counter

import pytest

from citeloom.functions import similarity as S
from citeloom.operators import simjoin


def _texts(seed, n):
    pick = random.Random(seed)
    words = "carbon market price risk power bank é日🙂 aaa aa of the".split()
    return [" ".join(pick.choices(words, k=pick.randint(1, 7))) for _ in range(n)] + ["a", "aa", "x" * 70]


@pytest.mark.parametrize("q", [1, 2])
def test_shared_grams_count_repeats(monkeypatch, q):
    monkeypatch.setattr(S, "SLICE", 7)
    a, b = _texts(1, 20), _texts(2, 30)
    grams = lambda s: Counter(s[k : k + q] for k in range(len(s) - q + 1))
    assert S.shared_grams(a, b, q).tolist() == [[sum((grams(x) & grams(y)).values()) for y in b] for x in a]
    assert S.shared_grams(["a"], ["b", "a"], q).tolist() == [[0, 2 - q]]


@pytest.mark.parametrize("t", [0.5, 0.67, 0.8, 0.9, 0.97, 1.0])
@pytest.mark.parametrize("many", [0.0, 1.0])
def test_blocks_lose_no_pair(monkeypatch, t, many):
    monkeypatch.setattr(simjoin, "MANY", many)
    monkeypatch.setattr(simjoin, "FEW_LEFT", 0)
    a, b = sorted(set(_texts(3, 60))), sorted(set(_texts(4, 80)))
    got = {(a[i], b[j]): r for x, y, z in simjoin._alike(a, b, t) for i, j, r in zip(x.tolist(), y.tolist(), z.tolist(), strict=True)}
    assert got == {(x, y): S.indel(x, y) for x in a for y in b if S.indel(x, y) >= 100 * t - 1e-9}


def test_titles_much_alike_are_hardly_compared(monkeypatch):
    pick = random.Random(5)
    titles = sorted({f"{pick.choice(['large', 'hot', 'blue', 'old'])} {pick.choice(['ring', 'bolt', 'plate', 'gear'])} a study of brand {pick.randrange(25)}small{pick.randrange(50)}" for _ in range(600)})
    own = [x.replace(" a ", " ") for x in titles]
    made, whole = [], simjoin.lcs_lengths
    monkeypatch.setattr(simjoin, "lcs_lengths", lambda x, y: made.append(len(x)) or whole(x, y))
    monkeypatch.setattr(simjoin, "lcs_against", None)
    found = {(i, j) for x, y, _ in simjoin._alike(own, titles, 0.97) for i, j in zip(x.tolist(), y.tolist(), strict=True)}
    assert found == {(i, j) for i, x in enumerate(own) for j, y in enumerate(titles) if S.indel(x, y) >= 97}
    assert 0 < sum(made) < len(titles) ** 2 / 50
