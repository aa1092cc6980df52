"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, and how often their ids are linked.

In each task the cumulative ends of both sides' tokens are merged: a byte offset
where both end closes a group, and every occurrence of a left token is linked
with every occurrence of a right one in its group.  Spark counts in how many
documents each pair of ids is linked, finds each side's greatest count, and
joins both back to the documents.  Counts of the commonest pairs, of which there
are at most HOT, are broadcast; the others, each of which has less than one in
HOT of all rows, meet in a shuffle, so no pair is a hot key.

Both tokenizers cut a text before a space between two characters that aren't
white space, so distinct chunks are encoded and aligned once and remembered,
found by a hash and compared in full.  That holds for a byte-level tokenizer
with the usual pattern and for pieces without a space mark after another
character, which is checked on the models; texts of each task are also encoded
whole and compared.  For other models every text is one chunk.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm import bytespans as B
from citeloom.llm.common import kept, mapped, safe, written

#: Pairs of ids whose counts are broadcast, at most: some 3 MB.
HOT = 100_000
#: Chunks that a worker remembers, bytes of text worked on at once, and bytes of chunks encoded as one text.
REMEMBERED, SLICE, AT_ONCE = 250_000, 2_000_000, 16_384
_BEGINS = np.zeros(256, bool)  # bytes that may follow a space at which texts are cut: no white space, no space mark
_BEGINS[0x21:0x7F] = True
_BEGINS[[*range(0xC3, 0xE0), *range(0xE4, 0xF5)]] = True
_PAIRS = np.zeros(256, bool)  # first bytes of two-byte characters among which there is no white space
_PAIRS[0xC3:0xE0] = True


def _byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


class _Left:
    """A byte-level tokenizer of the tokenizers library; special tokens inside texts are plain text."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker for each core
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        self.coder.encode_special_tokens = True
        own, config = _byte_level(), json.loads(self.coder.to_str())
        names = [self.coder.id_to_token(i) or "" for i in range(self.coder.get_vocab_size())]
        self.raw = [bytes(own[c] for c in t) if all(c in own for c in t) else t.encode() for t in names]
        pre = config["pre_tokenizer"] or {}
        self.cuts = config["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", False) and not pre.get("add_prefix_space")

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.coder.encode_batch(texts, add_special_tokens=False)]


class _Right:
    """A SentencePiece model, which sets a space before each text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.coder = m = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        self.raw = [bytes([int(t[1:-1], 16)]) if m.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(names)]
        self.cuts = not any("▁" in t.lstrip("▁") for i, t in enumerate(names) if not m.is_control(i))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.coder.encode([t[1:] for t in texts], num_threads=1)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in lists], np.int64)
    return np.fromiter((i for x in lists for i in x), np.int64, int(sizes.sum())), sizes


def _ranges(bound: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of some ranges' elements, one range after another, and the ranges' new bounds."""
    size = bound[of + 1] - bound[of]
    new = np.r_[0, np.cumsum(size)]
    return np.repeat(bound[of] - new[:-1], size) + np.arange(new[-1]), new


class Aligner:
    """Encodes and aligns batches of texts; remembers chunks."""

    def __init__(self, paths: str):
        left, right = paths.split("\n")
        self.left, self.right = _Left(left), _Right(right)
        self.sizes = [np.array([len(x) for x in side.raw], np.int64) for side in (self.left, self.right)]
        self.cuts = self.left.cuts and self.right.cuts
        numbers = [str(i) for i in range(max(len(side.raw) for side in (self.left, self.right)))]
        self.words = [np.array([n + end for n in numbers], object) for end in ",|;"]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.keys, self.used = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # of each chunk: its hash, and how often it was met
        self.place, self.bytes = np.zeros(1, np.int64), np.zeros(0, np.uint8)
        self.spans = B.Spans(self.bytes)
        self.spelled: list[str] = []
        self.numbers = np.zeros((0, 5), np.int64)  # left tokens, right tokens, groups, links; whether either side's bytes differ
        self.first, self.pairs, self.times = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _keep(self) -> None:
        """Makes room: of the chunks met more than once the commonest stay, at most half of all."""
        common = np.sort(np.argsort(-self.used, kind="stable")[: REMEMBERED // 2])
        common = common[self.used[common] > 1]
        spelled, numbers, place, data, first, pairs, times = self.spelled, self.numbers, self.place, self.bytes, self.first, self.pairs, self.times
        keys, used = self.keys[common], self.used[common] // 2
        self._forget()
        self.known = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self.keys, self.used = keys, used
        at, self.place = _ranges(place, common)
        self.bytes = data[at]
        self.spans = B.Spans(self.bytes)
        self.spelled, self.numbers = [spelled[k] for k in common.tolist()], numbers[common]
        at, self.first = _ranges(first, common)
        self.pairs, self.times = pairs[at], times[at]

    def _left_ids(self, chunks: list[bytes], plain: np.ndarray) -> list[list[int]]:
        """Chunks that begin and end without white space are encoded many in one text, and told apart by their bytes."""
        out: list[list[int]] = [[]] * len(chunks)
        alone = np.flatnonzero(~plain).tolist()
        together, held, size = [], [], 0
        for k in np.flatnonzero(plain).tolist():
            held.append(k)
            size += len(chunks[k])
            if size >= AT_ONCE:
                together.append(held)
                held, size = [], 0
        together += [held] if held else []
        for group, ids in zip(together, self.left.encode([b"".join(chunks[k] for k in g).decode() for g in together]), strict=True):
            ends = np.cumsum(self.sizes[0][ids])
            wanted = np.cumsum([len(chunks[k]) for k in group])
            at = np.searchsorted(ends, wanted)
            if len(ends) and ends[-1] == wanted[-1] and (ends[at] == wanted).all():
                at = [0, *(at + 1).tolist()]
                for k, a, b in zip(group, at, at[1:], strict=False):
                    out[k] = ids[a:b]
            else:
                alone += group
        for k, ids in zip(alone, self.left.encode([chunks[k].decode() for k in alone]), strict=True):
            out[k] = ids
        return out

    def aligned(self, chunks: list[bytes], plain: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each chunk: its groups spelled, its numbers, and its links as pairs with their times; the links' bounds come first of the last three."""
        n = len(chunks)
        ids = [self._left_ids(chunks, plain), self.right.encode([c.decode() for c in chunks])]
        bad = np.zeros(n, bool)
        for side, lists in zip((self.left, self.right), ids, strict=True):
            if b"".join([side.raw[i] for x in lists for i in x]) != b"".join(chunks):
                bad |= np.array([b"".join([side.raw[i] for i in x]) != c for x, c in zip(lists, chunks, strict=True)], bool)
        for k in np.flatnonzero(bad).tolist():
            ids[0][k], ids[1][k] = [], []
        flat, count = zip(*map(_flat, ids), strict=True)
        ends = [np.cumsum(self.sizes[s][flat[s]]) for s in (0, 1)]
        both = np.intersect1d(*ends, assume_unique=True)  # the merge: where tokens of both sides end
        group = [np.searchsorted(both, e) for e in ends]  # the group of each token
        size = [np.bincount(g, minlength=len(both)) for g in group]
        bound = [np.r_[0, np.cumsum(c)] for c in count]
        last = np.where(count[0] > 0, bound[0][1:] - 1, 0)  # the last token of a chunk closes its last group
        groups_to = np.where(count[0] > 0, group[0][last] + 1 if len(flat[0]) else 0, 0)
        groups_to = np.maximum.accumulate(groups_to)
        n_groups = np.diff(groups_to, prepend=0)
        links = np.r_[0, np.cumsum(size[0] * size[1])][groups_to]
        numbers = np.stack([count[0], count[1], n_groups, np.diff(links, prepend=0), bad], axis=1).astype(np.int64).reshape(-1, 5)
        return self._spelled(flat, group, groups_to), numbers, *self._links(flat, group, size, groups_to)

    def _spelled(self, flat, group, groups_to) -> list[str]:
        """`a1,a2|b1;a3|b2,b3`: ids of both sides, group by group."""
        if not len(flat[0]):
            return [""] * len(groups_to)
        part = np.concatenate([2 * group[0], 2 * group[1] + 1])  # left ids, then right ids of a group
        order = np.argsort(part, kind="stable")
        part, ids = part[order], np.concatenate(flat)[order]
        more = np.r_[part[1:] == part[:-1], False]
        words = np.where(more, self.words[0][ids], np.where(part & 1 == 0, self.words[1][ids], self.words[2][ids])).tolist()
        to = np.searchsorted(part, 2 * groups_to).tolist()
        return ["".join(words[a:b])[:-1] for a, b in zip([0, *to], to, strict=False)]

    @staticmethod
    def _links(flat, group, size, groups_to) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of each chunk and how often each is linked; in a group, equal ids of a side are counted before they are paired."""
        chunk_of = np.searchsorted(groups_to, np.arange(len(size[0])), side="right")
        sides = []
        for f, g in zip(flat, group, strict=True):
            key, times = np.unique(g << 32 | f, return_counts=True)
            sides.append((key >> 32, key & 0xFFFFFFFF, times))
        (ga, a, ta), (gb, b, tb) = sides
        first = np.searchsorted(gb, np.arange(len(size[0]) + 1))
        width = (first[1:] - first[:-1])[ga] if len(ga) else np.zeros(0, np.int64)
        left = np.repeat(np.arange(len(ga)), width)
        right = np.repeat(first[ga] if len(ga) else ga, width) + np.arange(len(left)) - np.repeat(np.cumsum(width) - width, width)
        chunk, pair, times = chunk_of[ga[left]], a[left] << 32 | b[right], ta[left] * tb[right]
        order = np.lexsort((pair, chunk))
        chunk, pair, times = chunk[order], pair[order], times[order]
        new = np.r_[True, (chunk[1:] != chunk[:-1]) | (pair[1:] != pair[:-1])][: len(pair)]
        at = np.flatnonzero(new)
        times = np.add.reduceat(times, at) if len(at) else times
        return np.searchsorted(chunk[at], np.arange(len(groups_to) + 1)), pair[at], times

    def _learn(self, keys: list[int], chunks: list[bytes], plain: np.ndarray) -> None:
        spelled, numbers, first, pairs, times = self.aligned(chunks, plain)
        self.known.update(zip(keys, range(len(self.known), len(self.known) + len(keys)), strict=True))
        self.keys, self.used = np.r_[self.keys, np.array(keys, np.uint64)], np.r_[self.used, np.zeros(len(keys), np.int64)]
        self.spelled += spelled
        self.numbers = np.concatenate([self.numbers, numbers])
        self.first = np.r_[self.first, self.first[-1] + first[1:]]
        self.pairs, self.times = np.r_[self.pairs, pairs], np.r_[self.times, times]
        self.place = np.r_[self.place, self.place[-1] + np.cumsum([len(c) for c in chunks])]
        self.bytes = np.r_[self.bytes, np.frombuffer(b"".join(chunks), np.uint8)]
        self.spans = B.Spans(self.bytes)

    def documents(self, texts: list[str], whole: bool = False) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What ``aligned`` gives, for each whole text; null and empty texts, and those whose bytes a side doesn't give back, have no tokens."""
        raw = [b" " + t.encode() if t else b"" for t in texts]
        data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])]
        starts = offsets[:-1][np.diff(offsets) > 0]
        if self.cuts and not whole and len(data):
            before, after = np.r_[np.uint8(0), data[:-1]], np.r_[data[1:], np.uint8(0)]
            solid = (before >= 0x21) & (before < 0x7F) | (before >= 0x80) & _PAIRS[np.r_[np.uint8(0), before[:-1]]]
            cut = (data == 32) & solid & _BEGINS[after]
            cut[starts] = True
            starts = np.flatnonzero(cut)
        ends = np.r_[starts[1:], len(data)][: len(starts)]
        doc = np.searchsorted(offsets, starts, side="right") - 1
        if whole or not self.cuts:
            raws = [r for r in raw if r]
            spelled, numbers, first, pairs, times = self.aligned(raws, np.zeros(len(raws), bool))
            slot = np.arange(len(starts))
        else:
            slot = self._slots(data, starts, ends)
            if slot is None:
                return self.documents(texts, whole=True)
            spelled, numbers, first, pairs, times = self.spelled, self.numbers, self.first, self.pairs, self.times
        return self._summed(len(texts), doc, slot, spelled, numbers, first, pairs, times)

    def _slots(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray | None:
        """Where each chunk is remembered; None if two have one hash."""
        spans, length = B.Spans(data), ends - starts
        keys, at, part = np.unique(B.quick(spans, starts, length), return_index=True, return_inverse=True)
        keys = keys.tolist()
        if len(self.known) + sum(k not in self.known for k in keys) > REMEMBERED:
            self._keep()
        new = [k for k, key in enumerate(keys) if key not in self.known]
        if new:
            raw, one = data.tobytes(), at[new]
            last = np.maximum(ends[one] - 1, 1)
            plain = _BEGINS[data[np.minimum(starts[one] + 1, len(data) - 1)]] & (length[one] > 1)
            plain &= (data[last] >= 0x21) & (data[last] < 0x7F) | (data[last] >= 0x80) & _PAIRS[data[last - 1]]
            self._learn([keys[k] for k in new], [raw[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)], plain)
        mine = np.fromiter((self.known[k] for k in keys), np.int64, len(keys))
        self.used[mine] += np.bincount(part, minlength=len(keys))
        slot = mine[part]
        if (self.place[slot + 1] - self.place[slot] != length).any() or not B.same(spans, starts, self.spans, self.place[slot], length):
            return None
        return slot

    @staticmethod
    def _summed(n, doc, slot, spelled, numbers, first, pairs, times):
        """The chunks' results put together by document."""
        total = np.stack([np.bincount(doc, weights=numbers[slot, c], minlength=n).astype(np.int64) for c in range(5)], axis=1)
        good = total[:, 4] == 0
        total[~good] = 0
        bound = np.searchsorted(doc, np.arange(n + 1))
        names = slot.tolist()
        groups = [";".join([spelled[s] for s in names[a:b]]) if ok else "" for a, b, ok in zip(bound[:-1].tolist(), bound[1:].tolist(), good.tolist(), strict=True)]
        on = good[doc]
        doc, slot = doc[on], slot[on]
        size = first[slot + 1] - first[slot]
        at, _ = _ranges(first, slot)
        distinct, dense = np.unique(pairs[at], return_inverse=True)
        key, back = np.unique(np.repeat(doc, size) * max(len(distinct), 1) + dense, return_inverse=True)
        merged = np.bincount(back, weights=times[at], minlength=len(key)).astype(np.int64)
        return groups, total[:, :4], np.searchsorted(key // max(len(distinct), 1), np.arange(n + 1)), distinct[key % max(len(distinct), 1)] if len(key) else pairs[:0], merged


def _agree(coder: Aligner, texts: list[str], found) -> bool:
    """Whether the first text of a slice, encoded whole, gives what its chunks gave."""
    whole = coder.documents(texts[:1], whole=True)
    to = found[2][1]
    return whole[0][0] == found[0][0] and (whole[1][0] == found[1][0]).all() and np.array_equal(whole[3], found[3][:to]) and np.array_equal(whole[4], found[4][:to])


def align(docs: DataFrame, left: str, right: str, spelled: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, written: row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, links (array of pair, times), if asked also groups.

    ``left`` is a byte-level tokenizers file, ``right`` a SentencePiece model,
    both readable for all executors.  The left side encodes a space and the
    text, the right side the text.  A pair is (left id << 32) + right id; its
    times are how many occurrences it links in the document.  Groups are spelled
    ``a1,a2|b1;a3|b2,b3``; their digest is empty for a text without tokens: null,
    empty, or one whose bytes either side doesn't give back.  ``row`` numbers
    the rows, so repeated and null ids stay apart.  Other columns are ignored.
    """
    rows = safe(docs, id_col, text_col).toDF("doc_id", "text")
    paths = f"{left}\n{right}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, row = kept("aligner", paths, Aligner), TaskContext.get().partitionId() << 36
        for b in batches:
            lo = 0
            for part in B.slices(b.column("text"), SLICE):
                texts = [t or "" for t in part.to_pylist()]
                found = coder.documents(texts)
                if coder.cuts and not _agree(coder, texts, found):
                    raise ValueError("a text encoded whole differs from its chunks: these models don't cut texts at single spaces")
                groups, numbers, first, pairs, times = found
                n = len(texts)
                links = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.StructArray.from_arrays([pa.array(pairs, pa.int64()), pa.array(times, pa.int64())], names=["pair", "times"]))
                columns = {"row": pa.array(row + np.arange(n)), "doc_id": b.column("doc_id").slice(lo, n)} | {c: pa.array(numbers[:, k]) for k, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
                columns["groups_sha256"] = pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups], pa.string())
                yield pa.RecordBatch.from_pydict(columns | {"links": links} | ({"groups": pa.array(groups, pa.string())} if spelled else {}))
                lo, row = lo + n, row + n

    kind = rows.schema["doc_id"].dataType.simpleString()
    return written(mapped(rows, run, f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<struct<pair:long,times:long>>" + ", groups string" * spelled, "aligner"))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, a_id, b_id, documents that link them, and the greatest such number of the left and of the right id; written."""
    counts = written(aligned.select(F.explode("links.pair").alias("pair")).groupBy("pair").agg(F.count("*").alias("documents")))
    counts = counts.select("pair", F.shiftright("pair", 32).alias("a_id"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b_id"), "documents")
    of_a, of_b = (counts.groupBy(side).agg(F.max("documents").alias(f"most_{side[0]}")) for side in ("a_id", "b_id"))
    return written(counts.join(of_a, "a_id").join(of_b, "b_id").select("pair", "a_id", "b_id", "documents", "most_a", "most_b"))


def scored(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """aligned with n_best (links whose pair has its left id's greatest count) and count_sum (the counts of all links)."""
    bound = (counts.agg(F.sum("documents")).first()[0] or 0) // HOT + 1  # fewer than HOT pairs can have as many documents
    links = aligned.select("row", F.inline("links"))
    values = counts.select("pair", "documents", (F.col("documents") == F.col("most_a")).alias("best"))
    hot = values.filter(F.col("documents") >= bound)

    def summed(met: DataFrame) -> DataFrame:
        return met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("documents")).alias("count_sum"))

    common = summed(links.join(F.broadcast(hot), "pair"))
    rare = summed(links.join(F.broadcast(hot.select("pair")), "pair", "left_anti").join(values.filter(F.col("documents") < bound), "pair"))
    both = common.unionByName(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return aligned.join(both, "row", "left").fillna(0, ["n_best", "count_sum"])
