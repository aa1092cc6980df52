"""Vectorised work on the bytes of many texts at once: words, and XXH64 of byte ranges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, a line feed after each, and each text's start; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "").cast(pa.large_binary())
    texts = pc.binary_join_element_wise(texts, pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]] if len(texts) else data[:0], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (a run of bytes that aren't white space), and the number of words of each text."""
    solid = ~_SPACES[data]
    edge = np.diff(solid.astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return _LOWER[data]


def compacted(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words in lower case (A-Z only) with one space after each, and the words' new starts."""
    solid = ~_SPACES[data]
    keep = solid.copy()
    keep[1:] |= solid[:-1]
    out = _LOWER[np.where(solid, data, np.uint8(32))[keep]]
    at = np.zeros(len(starts), np.int64)
    np.cumsum((ends - starts + 1)[:-1], out=at[1:]) if len(starts) else None
    return out, at


def slices(texts: pa.Array, most: int = 2_000_000) -> Iterator[pa.Array]:
    """Consecutive slices of about so many bytes, one text at least; null takes no bytes."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + most, side="right")) - 1)
        yield texts.slice(lo, hi - lo)
        lo = hi


def _rotl(x: np.ndarray, k: int) -> np.ndarray:
    return (x << np.uint64(k)) | (x >> np.uint64(64 - k))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


class Spans:
    """Reads little-endian words at any byte position of a buffer."""

    def __init__(self, data: np.ndarray):
        padded = np.zeros((len(data) + 7) // 8 * 8 + 16, np.uint8)
        padded[: len(data)] = data
        self.bytes, self.lanes = padded, padded.view("<u8")

    def u64(self, at: np.ndarray) -> np.ndarray:
        low, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
        return (self.lanes[low] >> shift) | ((self.lanes[low + 1] << np.uint64(1)) << (np.uint64(63) - shift))

    def u32(self, at: np.ndarray) -> np.ndarray:
        return self.u64(at) & np.uint64(0xFFFFFFFF)


def xxh64(spans: Spans, start: np.ndarray, length: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each byte range, all ranges at once."""
    with np.errstate(over="ignore"):
        seed = np.uint64(seed)
        h = np.full(len(start), seed + _P5, np.uint64)
        at, rest = start.astype(np.int64), length.astype(np.int64)
        if len(long := np.flatnonzero(rest >= 32)):
            h[long], used = _stripes(spans, at[long], rest[long], seed)
            at, rest = at.copy(), rest.copy()
            at[long] += used
            rest[long] -= used
        h += length.astype(np.uint64)
        for k in range(3):
            if not len(on := np.flatnonzero(rest >= 8 * (k + 1))):
                break
            lane = spans.u64(at[on] + 8 * k)
            h[on] = _rotl(h[on] ^ _round(np.zeros(len(on), np.uint64), lane), 27) * _P1 + _P4
        at = at + (rest & ~7)
        rest = rest & 7
        if len(on := np.flatnonzero(rest >= 4)):
            h[on] = _rotl(h[on] ^ (spans.u32(at[on]) * _P1), 23) * _P2 + _P3
        at, rest = at + (rest & 4), rest & 3
        for k in range(3):
            if not len(on := np.flatnonzero(rest > k)):
                break
            h[on] = _rotl(h[on] ^ (spans.bytes[at[on] + k].astype(np.uint64) * _P5), 11) * _P1
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        return h ^ (h >> np.uint64(32))


def quick(spans: Spans, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A cheaper 64-bit hash, for telling byte ranges of one process apart."""
    with np.errstate(over="ignore"):
        h = length.astype(np.uint64) * _P3
        on = np.arange(len(start))
        at, rest = start, length
        while len(on):
            lane = spans.u64(at)
            cut = rest < 8
            lane[cut] &= (np.uint64(1) << (rest[cut].astype(np.uint64) << np.uint64(3))) - np.uint64(1)
            x = (h[on] ^ lane) * _P1
            h[on] = x ^ (x >> np.uint64(29))
            more = rest > 8
            on, at, rest = on[more], at[more] + 8, rest[more] - 8
        return h * _P2


def same(a: Spans, at: np.ndarray, b: Spans, other: np.ndarray, length: np.ndarray) -> bool:
    """Whether all byte ranges of a equal those of b."""
    while len(at):
        differ = a.u64(at) ^ b.u64(other)
        cut = length < 8
        differ[cut] &= (np.uint64(1) << (length[cut].astype(np.uint64) << np.uint64(3))) - np.uint64(1)
        if differ.any():
            return False
        more = length > 8
        at, other, length = at[more] + 8, other[more] + 8, length[more] - 8
    return True


def _stripes(spans: Spans, at: np.ndarray, rest: np.ndarray, seed: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The state after the stripes of 32 bytes, and the bytes they took."""
    turns = rest // 32
    order = np.argsort(-turns, kind="stable")
    at, left = at[order], turns[order]
    v = [np.full(len(at), seed + d, np.uint64) for d in (_P1 + _P2, _P2, np.uint64(0), np.uint64(0) - _P1)]
    for k in range(int(left[0])):
        n = np.searchsorted(-left, -k, side="left")  # those with more turns than k
        for j in range(4):
            v[j][:n] = _round(v[j][:n], spans.u64(at[:n] + 32 * k + 8 * j))
    h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
    for x in v:
        h = (h ^ _round(np.zeros(len(x), np.uint64), x)) * _P1 + _P4
    out = np.empty_like(h)
    out[order] = h
    return out, turns * 32
