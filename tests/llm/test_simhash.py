import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from citeloom.llm import bytespans as B
from citeloom.llm import simhash as S
from citeloom.llm.components import components

from .conftest import DOCS


def shingles(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])


def fingerprint(text, k=3):
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles(text, k)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(ids, fps, radius):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_xxh64():
    rng = random.Random(1)
    data = np.frombuffer(rng.randbytes(3000), np.uint8)
    start = np.array([rng.randrange(2000) for _ in range(800)])
    length = np.array([rng.choice([rng.randrange(40), rng.randrange(400)]) for _ in start])
    got = B.xxh64(B.Spans(data), start, length)
    assert [int(x) for x in got] == [xxhash.xxh64_intdigest(data[s : s + n].tobytes(), seed=42) for s, n in zip(start, length, strict=True)]


TEXTS = ["", None, " \t\n", "One", "one two", "One two THREE", "É é Ünïcode wörds ÀB", "a b c", "word " * 5000, "x" * 70_000, "tabs\tand\x0bfeeds\x0c end"]


def test_fingerprints_equal_the_definition():
    got = S.fingerprints_of(pa.array(TEXTS), 3)[:, 0]
    assert [int(x) for x in got] == [fingerprint(t) for t in TEXTS]


def near_texts(rng, n):
    words = [f"w{k}" for k in range(400)]
    base = [[rng.choice(words) for _ in range(150)] for _ in range(6)]
    out = []
    for k in range(n):
        t = list(base[k % 6])
        for _ in range(rng.randrange(3)):
            t[rng.randrange(len(t))] = "edit"
        out.append(" ".join(t) if k % 5 else " ".join(rng.choice(words) for _ in range(40)))
    return out


def test_groups_equal_brute_force(table):
    rng = random.Random(2)
    texts = TEXTS + near_texts(rng, 120)
    ids = [3 * k for k in range(len(texts))]
    rows = [(i, t, None, None, None) for i, t in zip(ids, texts, strict=True)] + [(3, texts[1], "z", None, None), (None, "null id", None, None, None)]
    got = S.near_groups(table(rows, DOCS), words=3, radius=2, shard_size=10).collect()
    assert len(got) == len(rows)
    fps = dict(zip(ids, map(fingerprint, texts), strict=True))
    expected = groups(ids, fps, 2)
    assert all(r.component_id == (None if r.doc_id is None else expected[r.doc_id]) for r in got)
    assert all(r.fp0 % (1 << 64) == fps[r.doc_id] for r in got if r.doc_id is not None)


@pytest.mark.parametrize("radius", [0, 2, 7])
def test_trees_lose_no_pair(radius):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 60, dtype=np.uint64)
    points = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) for _ in range(14)]))[:, None]
    tree = S.grow(points[::3], 12)
    forest = S._Forest(len(points))
    seen = 0
    for _, own, query in S._visit(tree, points, radius):
        S.link(points, own, query, radius, radius, forest)
        seen += len(own)
    plain = S._Forest(len(points))
    near = np.bitwise_count(points ^ points.T) <= radius
    plain.unite(*np.nonzero(near))
    assert seen == len(points)
    every = np.arange(len(points))
    assert (forest.root(every) == plain.root(every)).all()


def test_anchors_link_similar_texts(table):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(2000)]
    rows = []
    for k in range(40):
        t = [rng.choice(words) for _ in range(200)]
        rows.append((2 * k, " ".join(t), None, None, None))
        t[rng.randrange(200)] = "changed"
        t[rng.randrange(200)] = "again"
        rows.append((2 * k + 1, " ".join(t), None, None, None))
    found = S.near_groups(table(rows, DOCS), words=5, radius=46, lanes=4, anchors=10).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: i // 2 * 2 for i in range(80)}


def test_crowded_anchors_are_dealt_in_parts(table, monkeypatch):
    monkeypatch.setattr(S, "BUCKET", 3)
    base = " ".join(f"b{k}" for k in range(120))
    rows = [(k, f"{base} tail{k} end{k}", None, None, None) for k in range(30)]
    found = S.near_groups(table(rows, DOCS), words=5, radius=46, lanes=4, anchors=4).collect()
    assert {r.component_id for r in found} == {0}


def test_counts_of_shared_elements():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, n)).astype(np.uint64) for n in (0, 5, 40, 1, 0, 30)]
    size = np.array([len(x) for x in sets])
    start, flat = np.cumsum(size) - size, np.concatenate(sets)
    for held in (7, 10**6):
        S.HELD, kept = held, S.HELD
        for x in sets:
            assert S._shared(x, flat, start, size).tolist() == [len(np.intersect1d(x, y)) for y in sets]
        S.HELD = kept


def jaccard(a, b):
    a, b = set(shingles(a, 5)), set(shingles(b, 5))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("bucket", [1000, 3])
def test_near_stage_links_what_is_similar_and_nothing_else(spark, monkeypatch, bucket):
    import corpus_pipeline as P

    monkeypatch.setattr(S, "BUCKET", bucket)
    rng = random.Random(5)
    texts = []
    for k in range(60):
        t = [f"w{rng.randrange(5000)}" for _ in range(8 if k % 3 == 0 else 9 if k % 3 == 1 else 100)]
        texts.append(" ".join(t))
        if k % 3 == 0:  # four shingles and one or two more: 0.8 and 0.67
            texts.append(" ".join([*t, "more"] if k % 2 else [*t, "more", "words"]))
        elif k % 3 == 1:  # five shingles, of which 4 are shared: 0.67
            texts.append(" ".join([*t[:-1], "other"]))
        else:  # 96 shingles with so many after them
            texts.append(" ".join([*t, *(f"x{k}y{i}" for i in range((k * 7) % 48))]))
    texts += [f"{'again ' * 200}{' '.join(f'r{k}s{i}' for i in range(40))}" for k in range(3)]  # one shingle has most votes
    texts += [" ".join(f"c{i}" for i in range(100)) + "".join(f" d{k}e{i}" for i in range(k % 12)) for k in range(20)]
    pairs = {(a, b) for a in range(len(texts)) for b in range(a) if jaccard(texts[a], texts[b]) >= 0.8}
    forest = S._Forest(len(texts))
    forest.unite(*np.array(sorted(pairs)).T)
    expected = forest.root(np.arange(len(texts)))
    kept = P.near(spark, spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], DOCS), "").collect()
    assert sorted(r.doc_id for r in kept) == sorted({int(x) for x in expected})


def test_large_components_of_copies_and_others(spark, monkeypatch):
    """Copies of one text, chains that lead away from it, and texts that share half of it."""
    import corpus_pipeline as P

    rng = random.Random(11)
    base = [f"b{k}" for k in range(120)]
    texts = []
    for k in range(90):  # copies with a few words changed
        t = base[:]
        for _ in range(rng.randrange(0, 4)):
            t[rng.randrange(120)] = f"c{k}x{rng.randrange(99)}"
        texts.append(t)
    for k in range(12):  # chains: each step ten more words away
        t = base + [f"d{k}"]
        for step in range(4):
            t = t[10:] + [f"e{k}s{step}w{i}" for i in range(10)]
            texts.append(t)
    texts += [base[:60] + [f"f{k}w{i}" for i in range(60)] for k in range(30)]
    texts = [" ".join(t) for t in texts]
    rng.shuffle(texts)
    forest = S._Forest(len(texts))
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if jaccard(texts[a], texts[b]) >= 0.8]
    forest.unite(*np.array(pairs).T)
    expected = forest.root(np.arange(len(texts))).tolist()
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], DOCS)
    groups = lambda: {r.doc_id: r.component_id for r in S.near_groups(docs, 5, P.NEAR_BITS, 4, P.NEAR_ANCHORS, wide=P.NEAR_WIDE).collect()}
    assert groups() == dict(enumerate(expected))
    for bucket, held in ((20, 2_000_000), (1000, 900), (7, 2_000_000)):
        monkeypatch.setattr(S, "BUCKET", bucket)
        monkeypatch.setattr(S, "HELD", held)
        assert groups() == dict(enumerate(expected)), (bucket, held)


def test_components_of_long_chains(spark):
    pairs = [(k + 1, k) for k in range(64)] + [(200, 100), (100, 150), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {k: 0 for k in range(1, 65)} | {150: 100, 200: 100}
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_more_fingerprints_than_the_tree_has_shards_for(table, monkeypatch):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))), None, None, None) for k in range(500)]
    full = {r.doc_id: r.component_id for r in S.near_groups(table(rows, DOCS), radius=6, shard_size=500).collect()}
    monkeypatch.setattr(S, "MAX_SHARDS", 3)
    assert {r.doc_id: r.component_id for r in S.near_groups(table(rows, DOCS), radius=6, shard_size=4).collect()} == full


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from citeloom.llm import common

    class Session:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = staticmethod(dict)  # noqa: N815

        class conf:  # noqa: N801
            get = staticmethod(lambda name, default: default)

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session)


def test_empty_table(table):
    assert S.near_groups(table([], DOCS)).count() == 0
    assert S.near_groups(table([], DOCS), anchors=3).count() == 0
