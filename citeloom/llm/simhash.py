"""SimHash fingerprints and near-duplicate groups found with vantage-point trees.

Words are runs of bytes that aren't white space, A-Z in lower case; a shingle is
``words`` of them joined by spaces (a shorter text is one shingle).  Each
shingle's XXH64 (seed 42) votes on every bit; a bit is set with over half of the
votes.  Lanes after the first come from the same hash, mixed anew.

Distinct fingerprints descend a tree of vantage points into shards: to the left
those within the node's distance of its vantage point.  Two fingerprints within
the radius differ by no more than that in their distance to any vantage point,
so a fingerprint visits the other side as a query only if it is that near to the
boundary.  Each shard prunes in the same way down to small blocks, compares
those exactly, and returns a spanning forest of its links, never all pairs.

With a radius that is a large part of the bits, as for a Jaccard similarity of
0.8, triangle bounds prune nothing and the work grows with the square of the
fingerprints.  There ``anchors`` decide who meets: each is the pair of a text's
smallest shingles under two hash orders, and similar texts share one of several
almost surely.  Texts that share an anchor are compared by their fingerprints,
here of distinct shingles; those near enough form candidate components, of
which each text is in one.  So its set of shingles moves once, and within a
component a link is a Jaccard similarity that was counted.  Of large components
most texts are connected through a few in their middle, and only the others
meet all.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm import bytespans as B
from citeloom.llm.common import mapped, safe, written
from citeloom.llm.components import components

#: Shingles whose votes are counted at once, and fingerprints compared at once.
VOTES, BLOCK = 100_000, 192
#: The driver's tree has at most so many shards, fitted on so many fingerprints for each; shards split further within their tasks.
MAX_SHARDS, SAMPLE = 1 << 16, 16
#: Shingles in an anchor; texts of a group that are compared in one piece, and shingles of theirs.
ANCHOR, BUCKET, HELD = 2, 1000, 2_000_000
#: Texts of a large component's sample, and those of its middle that all others meet.
SAMPLED, MIDDLES = 64, 4
#: Texts of so many shingles have fingerprints whose distances scatter as those of independent bits.
LONG = 64


def _mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """The hash for a further lane: the finaliser of splitmix64 over the hash and the lane's number."""
    if not lane:
        return h
    with np.errstate(over="ignore"):
        x = h + np.uint64(lane) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _fold(h: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """The fingerprint of each of n texts from its shingles' hashes; of: each hash's text, ascending."""
    votes = np.zeros((n, 64), np.int64)
    for lo in range(0, len(h), VOTES):
        part, text = h[lo : lo + VOTES], of[lo : lo + VOTES]
        first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes[text[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    majority = votes * 2 > np.bincount(of, minlength=n)[:, None]
    return np.packbits(majority, axis=1, bitorder="little").view("<u8")[:, 0]


def _anchors(h: np.ndarray, of: np.ndarray, n: int, anchors: int) -> np.ndarray:
    """(texts, anchors): each the mixed smallest hashes under ANCHOR orders; texts without a shingle share zero."""
    out = np.zeros((n, anchors), np.uint64)
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    for k in range(anchors):
        key = np.full(len(first), np.uint64(k + 1))
        for j in range(ANCHOR):
            key = _mixed(key ^ np.minimum.reduceat(_mixed(h, 64 + k * ANCHOR + j), first), 1)
        out[of[first], k] = key
    return out


def _shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every shingle, and its text's number, ascending."""
    data, offsets = B.joined(texts)
    starts, ends, count = B.words(data, offsets)
    n = len(count)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    packed, at = B.compacted(data, starts, ends)
    size, word_of = ends - starts, np.repeat(np.arange(n), count)
    last_word = np.cumsum(count)[word_of] - 1
    stop = np.minimum(np.arange(len(starts)) + words - 1, last_word)
    first_word = (np.cumsum(count) - count)[word_of]
    own = np.flatnonzero((np.arange(len(starts)) + words - 1 <= last_word) | (np.arange(len(starts)) == first_word))
    stop = stop[own]
    return B.xxh64(B.Spans(packed), at[own], at[stop] + size[stop] - at[own]), word_of[own]


def _distinct(h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes, ascending."""
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (of[1:] != of[:-1])][: len(h)]
    return h[new], of[new]


def _digest(h: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """A hash of each text's set of shingles."""
    out = np.zeros(n, np.uint64)
    np.add.at(out, of, _mixed(h, 63))
    return out


def fingerprints_of(texts: pa.Array, words: int, lanes: int = 1, anchors: int = 0) -> np.ndarray:
    """An array of (texts, lanes) unsigned 64-bit fingerprints; with anchors, of distinct shingles, then the anchors, the digest and the number of shingles."""
    h, of = _shingles(texts, words)
    n, out = len(texts), np.zeros((len(texts), lanes + (anchors and anchors + 2)), np.uint64)
    if not len(h):
        return out
    if anchors:
        h, of = _distinct(h, of)
        out[:, lanes:-2] = _anchors(h, of, n, anchors)
        out[:, -2], out[:, -1] = _digest(h, of, n), np.bincount(of, minlength=n)
    for lane in range(lanes):
        out[:, lane] = _fold(_mixed(h, lane), of, n)
    return out


def _set_batches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo = 0
            for texts in B.slices(b.column("text")):
                n = len(texts)
                rows = b.slice(lo, n)
                lo += n
                h, of = _distinct(*_shingles(texts, words))
                ends = np.r_[0, np.cumsum(np.bincount(of, minlength=n))].astype(np.int32) * np.int32(8)
                sets = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(h))])
                own = pa.array(_digest(h, of, n).view(np.int64) == rows.column("digest").to_numpy())  # of rows that share an id, the node's
                names = [c for c in b.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), sets], names=[*names, "shingles"]).filter(own)

    return run


def _hash_batches(words: int, lanes: int, anchors: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo = 0
            for texts in B.slices(b.column("text")):
                n, fp = len(texts), fingerprints_of(texts, words, lanes, anchors).view(np.int64)
                lo += n
                column = lambda k: pa.array(np.ascontiguousarray(fp[:, k]))
                more = [pa.FixedSizeListArray.from_arrays(pa.array(fp[:, lanes:-2].ravel()), anchors).cast(pa.list_(pa.int64())), column(-2), column(-1)] if anchors else []
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo - n, n), *map(column, range(lanes)), *more], names=["doc_id", *(f"fp{k}" for k in range(lanes)), *["anchors", "digest", "n_shingles"][: len(more)]])

    return run


def fingerprints(docs: DataFrame, words: int = 3, lanes: int = 1, anchors: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp0 ... and, if asked, anchors, digest and n_shingles of every whole text; null and texts without a word get zeros."""
    rows = safe(docs, id_col, text_col).toDF("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return mapped(rows, _hash_batches(words, lanes, anchors), f"doc_id {kind}, " + ", ".join(f"fp{k} long" for k in range(lanes)) + ", anchors array<long>, digest long, n_shingles long" * bool(anchors))


def _distance(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.bitwise_count(points ^ to).sum(axis=-1, dtype=np.int64)


def _split(points: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int] | None:
    """A vantage point among a few candidates, and the distance that splits the points most evenly with least crowding at the boundary."""
    best = None
    for v in points[rng.choice(len(points), min(8, len(points)), replace=False)]:
        d = _distance(points, v)
        mu = int(np.median(d))
        for m in (mu - 1, mu):
            left = int((d <= m).sum())
            if 0 < left < len(d) and (best is None or (key := min(left, len(d) - left) / len(d) - ((d > m - 2) & (d <= m + 2)).mean()) > best[0]):
                best = (min(left, len(d) - left) / len(d) - ((d > m - 2) & (d <= m + 2)).mean(), v, m)
    return best and best[1:]


def grow(sample: np.ndarray, shards: int) -> list:
    """A tree as nested lists [vantage, distance, left, right], with a shard's number at each leaf."""
    rng, count = np.random.default_rng(7), [0]

    def node(points: np.ndarray, leaves: int):
        cut = _split(points, rng) if leaves > 1 and len(points) >= 4 else None
        if cut is None:
            count[0] += 1
            return count[0] - 1
        left = _distance(points, cut[0]) <= cut[1]
        return [cut[0], cut[1], node(points[left], leaves // 2), node(points[~left], leaves - leaves // 2)]

    return node(sample, shards)


def _visit(tree, points: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, indices of its own points, indices of points that query it)."""
    stack = [(tree, np.arange(len(points)), np.arange(0))]
    while stack:
        at, own, query = stack.pop()
        if not len(own) + len(query):
            continue
        if not isinstance(at, list):
            yield at, own, query
            continue
        d, q = _distance(points[own], at[0]), _distance(points[query], at[0])
        stack.append((at[2], own[d <= at[1]], query[q <= at[1] + radius]))
        stack.append((at[3], own[d > at[1]], np.r_[own[(d <= at[1]) & (d > at[1] - radius)], query[q > at[1] - radius]]))


class _Forest:
    """Union-find over array indices, many unions at once."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[self.parent[x]]
            if (up == self.parent[x]).all():
                return up
            self.parent[x] = up

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root(a), self.root(b)
            a, b = a[a != b], b[a != b]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def link(points: np.ndarray, own: np.ndarray, query: np.ndarray, radius: int, first: int, forest: _Forest) -> None:
    """Unites all pairs within the radius, and ``first`` in the first lane, that have one point in own and the other in own or query."""
    rng = np.random.default_rng(len(own))
    stack = [(own, query)]
    while stack:
        own, query = stack.pop()
        if not len(own):
            continue
        cut = _split(points[own[rng.choice(len(own), min(len(own), 256), replace=False)]], rng) if len(own) > BLOCK else None
        if cut is None:
            _compare(points, own, query, radius, first, forest)
            continue
        d, q = _distance(points[own], cut[0]), _distance(points[query], cut[0])
        left = d <= cut[1]
        near = own[left & (d > cut[1] - radius)]
        if len(near) + (q <= cut[1] + radius).sum() + (q > cut[1] - radius).sum() > 0.9 * (len(own) + 2 * len(query)) and 2 * min(left.sum(), (~left).sum()) < 0.9 * len(own):
            _compare(points, own, query, radius, first, forest)  # nothing is pruned here
            continue
        stack.append((own[left], query[q <= cut[1] + radius]))
        stack.append((own[~left], np.r_[near, query[q > cut[1] - radius]]))


def _compare(points: np.ndarray, own: np.ndarray, query: np.ndarray, radius: int, first: int, forest: _Forest) -> None:
    everyone = np.r_[own, query]
    for lo in range(0, len(own), BLOCK):
        rows, cols = own[lo : lo + BLOCK], everyone[lo:]  # each pair of own points once
        for c in range(0, len(cols), 16 * BLOCK):
            some = cols[c : c + 16 * BLOCK]
            near = np.bitwise_count(points[rows, 0][:, None] ^ points[some, 0][None, :]) <= first
            i, j = np.nonzero(near)
            if points.shape[1] > 1:
                ok = _distance(points[rows[i]], points[some[j]]) <= radius
                i, j = i[ok], j[ok]
            forest.unite(rows[i], some[j])


def _link_shard(lanes: int, radius: int, first: int):
    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("node", kind="stable").reset_index(drop=True)  # roots are smallest nodes
        points = part[[f"fp{k}" for k in range(lanes)]].to_numpy(np.int64).view(np.uint64)
        own = part["own"].to_numpy()
        forest = _Forest(len(part))
        link(points, np.flatnonzero(own), np.flatnonzero(~own), radius, first, forest)
        node, root = part["node"].to_numpy(), forest.root(np.arange(len(part)))
        moved = root != np.arange(len(part))
        return pd.DataFrame({"src": node[moved], "dst": node[root[moved]]})

    return run


def near_links(nodes: DataFrame, radius: int, lanes: int = 1, first: int | None = None, shard_size: int = 3000) -> DataFrame:
    """Links (src, dst) that connect all nodes whose distinct fingerprints differ in at most radius bits, and in at most ``first`` of the first lane."""
    cols = [f"fp{k}" for k in range(lanes)]
    n = nodes.count()
    shards = max(1, min(MAX_SHARDS, math.ceil(n / shard_size)))
    sample = nodes.select(*cols).orderBy(F.xxhash64(*cols)).limit(shards * SAMPLE).toPandas()  # a bounded sample
    tree = grow(sample.to_numpy(np.int64).view(np.uint64), shards) if len(sample) else 0

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points = np.stack([b.column(c).to_numpy() for c in cols], axis=1).view(np.uint64)
            for shard, own, query in _visit(tree, points, radius):
                at = np.r_[own, query]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard, np.int32)), pa.array(np.arange(len(at)) < len(own)), *(b.column(c).take(pa.array(at)) for c in ["node", *cols])], names=["shard", "own", "node", *cols])

    routed = mapped(nodes.select("node", *cols), route, "shard int, own boolean, node long, " + ", ".join(f"{c} long" for c in cols))
    return routed.groupBy("shard").applyInPandas(_link_shard(lanes, radius, radius if first is None else first), "src long, dst long")


def _within(bits: np.ndarray, size: np.ndarray, other: np.ndarray, radius: int, wide: int) -> np.ndarray:
    """Whether so many differing bits leave a link possible; texts of under LONG shingles scatter more."""
    return bits <= np.where(np.minimum(size, other) >= LONG, radius, wide)


def _runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """The batches' rows, sorted by key, in tables that hold whole groups; keeps one group's rows over from batch to batch."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not len(b):
            continue
        group = np.stack([b.column(c).to_numpy() for c in key], axis=1)
        cut = len(b) - int(np.argmin(np.r_[(group == group[-1]).all(axis=1)[::-1], False]))
        if cut or (held and any(held[-1].column(c)[0] != b.column(c)[0] for c in key)):
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _arrays(rows: pa.Table, key: list[str], lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """group, node, fingerprint and number of shingles of each row."""
    column = lambda c: rows[c].to_numpy()
    return np.stack([column(c) for c in key], axis=1), column("node"), np.stack([column(f"fp{k}") for k in range(lanes)], axis=1).view(np.uint64), column("n_shingles")


def _links(node: np.ndarray, forest: _Forest) -> pa.RecordBatch:
    root = forest.root(np.arange(len(node)))
    moved = root != np.arange(len(node))
    return pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[root[moved]])], names=["src", "dst"])


def _candidate_links(lanes: int, radius: int, wide: int, least: float):
    """A spanning forest of the neighbours of each anchor and pair of parts whose fingerprints and sizes leave a link possible."""
    key = ["anchor", "pair"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, key):
            group, node, points, size = _arrays(rows, key, lanes)
            forest, k = _Forest(len(node)), 1
            at = np.flatnonzero((group[1:] == group[:-1]).all(axis=1))
            while len(at):  # each row with the k-th after it, while they share the group
                near = at[forest.root(at) != forest.root(at + k)]
                near = near[np.minimum(size[near], size[near + k]) >= least * np.maximum(size[near], size[near + k]) * (1 - 1e-9)]
                near = near[np.bitwise_count(points[near, 0] ^ points[near + k, 0]) <= wide]
                near = near[_within(_distance(points[near], points[near + k]), size[near], size[near + k], radius, wide)]
                forest.unite(near, near + k)
                k += 1
                at = at[at + k < len(node)]
                at = at[(group[at + k] == group[at]).all(axis=1)]
            yield _links(node, forest)

    return run


def _elements(sets: pa.BinaryArray) -> np.ndarray:
    """The elements of all sets, one set after another."""
    ends = np.frombuffer(sets.buffers()[1], np.int32)[sets.offset : sets.offset + len(sets) + 1]
    return np.frombuffer(sets.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(np.uint64)


def _shared(x: np.ndarray, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many elements of the set x are in each of the sets that flat holds; all are sorted."""
    out = np.zeros(len(start), np.int64)
    full = np.flatnonzero(size)
    for part in np.split(full, np.searchsorted(np.cumsum(size[full]), np.arange(HELD, size[full].sum(), HELD))):
        if len(part) and len(x):
            n = size[part]
            first = np.cumsum(n) - n
            y = flat[np.repeat(start[part] - first, n) + np.arange(n.sum())]
            out[part] = np.add.reduceat(x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y, first, dtype=np.int64)
    return out


def _link_sets(points: np.ndarray, size: np.ndarray, start: np.ndarray, flat: np.ndarray, radius: int, wide: int, least: float, forest: _Forest, at: np.ndarray, core: np.ndarray) -> None:
    """Unites all texts at ``at`` whose sets have a Jaccard similarity of ``least``; with texts of a core among them, only these with the others.

    Each text in turn meets all later ones that aren't yet connected with it.
    Those in the middle, by the majority of the fingerprints' bits, come first:
    in a group of copies of one text they connect nearly all.
    """
    mixed = core[at].any()
    bits = np.unpackbits(points[at].view(np.uint8).reshape(len(at), -1), axis=1)
    middle = np.packbits(bits.sum(axis=0) * 2 > len(at)).view(np.uint64)
    at = at[np.argsort(_distance(points[at], middle), kind="stable")]
    for k, x in enumerate(at[:-1]):
        later = at[k + 1 :]
        root = forest.root(later)
        later = later[root != forest.root(at[k : k + 1])[0]]
        if not len(later):
            if (root == root[0]).all():
                return
            continue
        later = later[core[later] != core[x]] if mixed else later
        later = later[np.minimum(size[x], size[later]) >= least * np.maximum(size[x], size[later]) * (1 - 1e-9)]
        later = later[_within(_distance(points[later], points[x]), size[later], size[x], radius, wide)]
        both = _shared(flat[start[x] : start[x] + size[x]], flat, start[later], size[later])
        alike = later[both >= least * (size[x] + size[later] - both) * (1 - 1e-12)]
        forest.unite(np.full(len(alike), x), alike)


def _counted_links(lanes: int, radius: int, wide: int, least: float):
    """A spanning forest of the links within each group of (root, pair); rows with one label are connected already."""
    key = ["root", "pair"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, key):
            group, node, points, size = _arrays(rows, key, lanes)
            again = np.r_[False, (node[1:] == node[:-1]) & (group[1:] == group[:-1]).all(axis=1)]
            if again.any():  # rows that repeat an id and its text
                rows = rows.filter(pa.array(~again))
                group, node, points, size = _arrays(rows, key, lanes)
            flat = np.concatenate([_elements(c) for c in rows["shingles"].chunks])
            start, forest = np.cumsum(size) - size, _Forest(len(node))
            label, core = rows["label"].to_numpy(), rows["core"].to_numpy()
            bounds = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(axis=1), True])
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                order = lo + np.argsort(label[lo:hi], kind="stable")
                same = np.flatnonzero(label[order[1:]] == label[order[:-1]])
                forest.unite(order[same], order[same + 1])
                _link_sets(points, size, start, flat, radius, wide, least, forest, np.arange(lo, hi), core)
            yield _links(node, forest)

    return run


def _middles(lanes: int):
    """The nodes of a bounded sample of a group that are nearest to all others of it."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        points = part[[f"fp{k}" for k in range(lanes)]].to_numpy(np.int64).view(np.uint64)
        far = np.array([_distance(points, p).sum() for p in points])
        return part.iloc[np.lexsort((part["node"].to_numpy(), far))[:MIDDLES]][["root", "node"]]

    return run


def _in_pairs(rows: DataFrame, key: str, parts: Column) -> DataFrame:
    """Rows of a group of several parts as often as there are parts, with the pair of parts in which they meet the others."""
    dealt = rows.withColumn("parts", parts.cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pair = F.least("own", "other").cast("long") * F.col("parts") + F.greatest("own", "other")
    return dealt.withColumn("pair", pair).drop("parts", "own", "other")


def _together(rows: DataFrame, key: str) -> DataFrame:
    """Rows by group and pair, each in one task, in order."""
    return rows.repartition(key, "pair").sortWithinPartitions(key, "pair", "node")


def _parts(n: Column) -> Column:
    """Parts of a group of n: their number and their size both grow with its root."""
    return F.when(n <= BUCKET, 1).otherwise(F.ceil(F.sqrt(n) / 4))


def anchored_links(texts: DataFrame, nodes: DataFrame, words: int, radius: int, lanes: int, wide: int, least: float) -> DataFrame:
    """Links (src, dst) that connect all nodes that share an anchor, differ in at most ``radius`` bits (``wide`` if one has under LONG shingles), and have a Jaccard similarity of ``least``.

    texts: (node, text), of which those in a candidate component are read.  In a
    group of many texts that share an anchor each two parts meet.
    """
    cols = [f"fp{k}" for k in range(lanes)]
    slots = nodes.select(F.explode(F.array_distinct("anchors")).alias("anchor"), "node", "n_shingles", *cols)
    shared = written(slots.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1"))
    met = _together(_in_pairs(slots.join(shared, "anchor"), "anchor", _parts(F.col("n"))), "anchor").select("anchor", "pair", "node", "n_shingles", *cols)
    near = components(mapped(met, _candidate_links(lanes, radius, wide, least), "src long, dst long"))
    near = written(near.unionByName(near.select(F.col("root").alias("node"), "root").distinct()))
    sizes = written(near.join(nodes.select("node", "n_shingles"), "node").groupBy("root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("held")))
    known = near.join(sizes, "root").join(nodes.select("node", "digest", "n_shingles", *cols), "node")
    sets = mapped(texts.join(written(known), "node").select("root", "n", "held", "node", "digest", "n_shingles", *cols, "text"), _set_batches(words), "root long, n long, held long, node long, digest long, n_shingles long, " + "".join(f"{c} long, " for c in cols) + "shingles binary")
    sets = written(sets.drop("digest"))

    def counted(rows: DataFrame) -> DataFrame:
        return mapped(_together(rows, "root").select("root", "pair", "node", "label", "core", "n_shingles", *cols, "shingles"), _counted_links(lanes, radius, wide, least), "src long, dst long")

    plain = sets.withColumns({"label": F.col("node"), "core": F.lit(False)})
    few = (F.col("n") <= BUCKET) & (F.col("held") <= HELD)
    links = counted(plain.filter(few).withColumn("pair", F.lit(0).cast("long")))
    return links if sizes.filter(~few).isEmpty() else links.unionByName(_links_of_many(plain.filter(~few), counted, cols))


def _links_of_many(rows: DataFrame, counted: Callable[[DataFrame], DataFrame], cols: list[str]) -> DataFrame:
    """Links of large components, which copies of one text make for the most part.

    First each is dealt in pieces, of which each text is in one, with the texts
    in the middle of a sample in all of them: that connects nearly all copies.
    Then all others meet those connected, in blocks, and each other, by pairs
    of parts.  So the sets move once or twice, and again only for each part of
    those that the first step leaves over.
    """
    lanes, hash_ = len(cols), F.xxhash64("node")
    chosen = rows.select("root", "node", *cols).withColumn("_r", F.row_number().over(Window.partitionBy("root").orderBy(hash_, "node"))).filter(F.col("_r") <= SAMPLED).drop("_r")
    kinds = "root long, node long"
    middles = written(chosen.groupBy("root").applyInPandas(_middles(lanes), kinds))
    pieces = F.ceil(F.greatest(F.col("n") / BUCKET, 2 * F.col("held") / HELD))
    own = rows.withColumn("pair", F.pmod(hash_, pieces))
    everywhere = rows.join(middles, ["root", "node"]).withColumn("pair", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)))
    first = written(counted(own.unionByName(everywhere)))
    joined = components(first).withColumnRenamed("root", "_to")
    labels = written(rows.select("root", "node", "n", "held").join(joined, "node", "left").select("root", "node", "n", "held", F.coalesce("_to", "node").alias("label")))
    clusters = labels.groupBy("root", "label").agg(F.count("*").alias("size"), F.first("n").alias("n"), F.first("held").alias("held"))
    most = clusters.groupBy("root").agg(F.max(F.struct("size", "label")).alias("m"), F.first("n").alias("n"), F.first("held").alias("held")).filter("m.size < n")
    rest = F.col("n") - F.col("m.size")
    parts = F.greatest(_parts(rest), F.ceil(2 * F.col("held") * rest / F.col("n") / HELD))
    blocks = F.ceil(F.greatest(F.col("m.size") / BUCKET, 2 * F.col("held") / HELD))
    most = written(most.select("root", F.col("m.label").alias("main"), parts.cast("long").alias("parts"), blocks.cast("long").alias("blocks")))
    dealt = rows.drop("label", "core").join(labels.select("node", "label"), "node").join(most, "root").withColumn("core", F.col("label") == F.col("main"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    block, part = F.pmod(hash_, F.col("blocks")), F.pmod(hash_, F.col("parts"))
    of_core = F.transform(upto("parts"), lambda j: block * F.col("parts") + j)
    of_rest = F.transform(upto("blocks"), lambda i: i * F.col("parts") + part)
    among = F.transform(upto("parts"), lambda j: (F.col("blocks") + F.least(part, j)) * F.col("parts") + F.greatest(part, j))
    pair = F.when(F.col("core"), of_core).otherwise(F.concat(of_rest, among))
    second = counted(dealt.withColumn("pair", F.explode(pair)).drop("main", "parts", "blocks"))
    return first.unionByName(second)


def near_groups(docs: DataFrame, words: int = 3, radius: int = 2, lanes: int = 1, anchors: int = 0, shard_size: int = 3000, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, wide: int | None = None) -> DataFrame:
    """doc_id, fp0 ..., component_id: the smallest id reachable over links of fingerprints within the radius.

    ``shard_size`` is that of the vantage-point trees.  With ``anchors``,
    fingerprints are of distinct shingles, and linked are texts whose distinct
    shingles have a Jaccard similarity of ``least``, if they share an anchor, as
    all but (1 - s^2)^anchors of those with a similarity s do, and their
    fingerprints are within the radius, or within ``wide`` where a text has
    under LONG shingles.  Ids are integers.

    One row per input row, repeated rows too.  A null id gets a null
    component.  Null and empty texts have fingerprint zero and link like any
    other.  An empty table gives no rows; other columns are ignored.
    """
    cols = [f"fp{k}" for k in range(lanes)]
    hashed = written(fingerprints(docs, words, lanes, anchors, id_col, text_col))
    key = [*cols, *["digest", "n_shingles"] * bool(anchors)]
    nodes = written(hashed.filter("doc_id is not null").groupBy(*key).agg(F.min("doc_id").cast("long").alias("node"), *[F.min("anchors").alias("anchors")] * bool(anchors)))
    texts = safe(docs, id_col, text_col).toDF("node", "text").withColumn("node", F.col("node").cast("long"))
    links = anchored_links(texts, nodes, words, radius, lanes, radius if wide is None else wide, least) if anchors else near_links(nodes, radius, lanes, None, shard_size)
    roots = components(links)
    labels = nodes.join(roots, "node", "left").select(*key, F.coalesce("root", "node").alias("component_id"))
    return hashed.join(labels, key, "left").select("doc_id", *cols, F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
