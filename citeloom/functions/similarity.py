"""String similarity and stemming, which Spark has no built-in for, as vectorised pandas UDFs."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine word of bits for each character of a."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


#: Pairs that advance together.
TOGETHER = 20_000
#: Kinds of grams that are counted together.
SLICE = 1024


def lcs_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of many pairs.

    All pairs with as many machine words of bits (one bit for each character of
    the shorter string) advance together, a character of the longer one a step.
    """
    out = np.zeros(len(a), np.int64)
    short = [x if len(x) <= len(y) else y for x, y in zip(a, b, strict=True)]
    long = [y if len(x) <= len(y) else x for x, y in zip(a, b, strict=True)]
    width = np.array([-(-len(x) // 64) for x in short], np.int64)
    for w in np.unique(width[width > 0]).tolist():
        of = np.flatnonzero(width == w)
        step = max(1, TOGETHER // w)
        for lo in range(0, len(of), step):
            part = of[lo : lo + step].tolist()
            out[part] = _together([short[k] for k in part], [long[k] for k in part], w)
    return out


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64), np.array([len(t) for t in texts], np.int64)


def _together(a: list[str], b: list[str], w: int) -> np.ndarray:
    """As ``lcs_lengths``, for pairs whose first string takes w words."""
    a, size = _codes(a)
    b, steps = _codes(b)
    order = np.argsort(-steps, kind="stable")  # pairs that are done leave at the end
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    owner = place[np.repeat(np.arange(len(size)), size)]
    within = np.arange(len(a)) - np.repeat(np.cumsum(size) - size, size)
    keys, slot = np.unique(owner << 21 | a, return_inverse=True)
    masks = np.zeros((len(keys) + 1, w), np.uint64)  # the last row: a character that isn't there
    np.bitwise_or.at(masks, (slot, within >> 6), np.uint64(1) << (within & 63).astype(np.uint64))
    wanted = place[np.repeat(np.arange(len(steps)), steps)] << 21 | b
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    at = np.where(keys[at] == wanted, at, len(keys))
    first, n_steps = (np.cumsum(steps) - steps)[order], steps[order]
    row = np.full((len(steps), w), ~np.uint64(0))
    for k in range(int(n_steps[0])):
        n = int(np.searchsorted(-n_steps, -k, side="left"))
        mask = masks[at[first[:n] + k]]
        carry = np.zeros(n, np.uint64)
        for j in range(w):
            r = row[:n, j]
            hit = r & mask[:, j]
            total = r + hit
            more = total + carry
            carry = ((total < r) | (more < total)).astype(np.uint64)
            row[:n, j] = more | (r & ~mask[:, j])
    tail = np.arange(w)[None, :] * 64
    bits = np.clip(size[order][:, None] - tail, 0, 64)
    inside = np.where(bits == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(bits, 63).astype(np.uint64)) - np.uint64(1))
    out = np.empty(len(order), np.int64)
    out[order] = size[order] - np.bitwise_count(row & inside).astype(np.int64).sum(axis=1)
    return out


def lcs_against(one: list[str], many: list[str], shares: tuple[float, float]):
    """For each string of ``one`` its number, the numbers of those of ``many`` whose lengths lie within the shares of its own, and the lengths of the longest common subsequences.

    The bits stand for the characters of the one; the many advance together, a
    character of theirs a step, so a pair costs few operations on whole arrays.
    """
    order = np.argsort([-len(t) for t in many], kind="stable")
    chars, size = _codes([many[k] for k in order])
    alphabet, codes = np.unique(chars, return_inverse=True)
    table = np.full((int(size[0]) if len(size) else 0, len(size)), len(alphabet), np.intp)
    if len(chars):
        table[np.arange(len(chars)) - np.repeat(np.cumsum(size) - size, size), np.repeat(np.arange(len(size)), size)] = codes
    for number, text in enumerate(one):
        n = len(text)
        lo, hi = (int(np.searchsorted(-size, -x, side)) for x, side in ((np.floor(n * shares[1] + 1e-9), "left"), (np.ceil(n * shares[0] - 1e-9), "right")))
        if not n or lo >= hi:
            continue
        w = -(-n // 64)
        masks = np.zeros((w, len(alphabet) + 1), np.uint64)
        for i, c in enumerate(_codes([text])[0].tolist()):
            at = int(np.searchsorted(alphabet, c))
            if at < len(alphabet) and alphabet[at] == c:
                masks[i >> 6, at] |= np.uint64(1 << (i & 63))
        rows = [np.full(hi - lo, ~np.uint64(0)) for _ in range(w)]
        going = np.searchsorted(-size[lo:hi], -np.arange(int(size[lo])), "left").tolist()
        room = np.empty((2, hi - lo), np.uint64)
        for k, m in enumerate(going):
            at, mask, total, carry = table[k, lo : lo + m], room[0, :m], room[1, :m], None
            for j in range(w):
                r = rows[j][:m]
                np.take(masks[j], at, out=mask, mode="clip")
                np.bitwise_and(r, mask, out=total)
                np.bitwise_xor(r, total, out=mask)  # r without what it hits
                np.add(total, r, out=total)
                if w > 1:
                    more = total if carry is None else total + carry
                    carry = ((total < r) | (more < total)).astype(np.uint64)
                    np.bitwise_or(more, mask, out=r)
                else:
                    np.bitwise_or(total, mask, out=r)
        inside = [np.uint64((1 << min(64, n - 64 * j)) - 1) for j in range(w)]
        yield number, order[lo:hi], n - sum(np.bitwise_count(rows[j] & inside[j]).astype(np.int64) for j in range(w))


def shared_grams(a: list[str], b: list[str], q: int) -> np.ndarray:
    """How many grams of q characters, 1 or 2, each string of a shares with each of b, repeats counted."""
    chars, size = _codes([*a, *b])
    owner = np.repeat(np.arange(len(size)), size)
    if q == 2:
        inside = owner[1:] == owner[:-1]
        chars, owner = (chars[:-1] << 21 | chars[1:])[inside], owner[1:][inside]
    shared = np.zeros((len(a), len(b)), np.float32)
    if not len(chars):
        return shared
    kinds, gram = np.unique(chars, return_inverse=True)
    # A string's second such gram is another item than its first: what two strings share is a product of zeros and ones.
    key = np.sort(owner * len(kinds) + gram)
    start = np.flatnonzero(np.diff(key, prepend=-1))
    turn = np.arange(len(key)) - np.repeat(start, np.diff(start, append=len(key)))
    owner, gram = key // len(kinds), key % len(kinds)
    item = np.unique(turn * len(kinds) + gram, return_inverse=True)[1]
    left = owner < len(a)
    both = np.flatnonzero(np.logical_and(*[np.bincount(item[on], minlength=item.max() + 1) > 0 for on in (left, ~left)]))
    place = np.full(item.max() + 1, -1)
    place[both] = np.arange(len(both))
    at = place[item]
    for lo in range(0, len(both), SLICE):
        tables = []
        for n, on, first in ((len(a), left, 0), (len(b), ~left, len(a))):
            on = on & (at >= lo) & (at < lo + SLICE)
            table = np.zeros((n, min(SLICE, len(both) - lo)), np.float32)
            table[owner[on] - first, at[on] - lo] = 1
            tables.append(table)
        shared += tables[0] @ tables[1].T
    return shared


def _ratios(a: list[str], b: list[str]) -> np.ndarray:
    total = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], np.int64)
    return np.where(total > 0, 200.0 * lcs_lengths(a, b) / np.maximum(total, 1), 100.0)


def _of_rows(a: pd.Series, b: pd.Series, shown) -> pd.Series:
    known = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    out[known] = _ratios([shown(x) for x in a[known]], [shown(x) for x in b[known]])
    return pd.Series(out).astype("Float64").where(pd.Series(known), pd.NA)


def _ordered(t: str) -> str:
    return " ".join(sorted(t.split()))


def indel(a: str | None, b: str | None) -> float | None:
    """200 * LCS / (len(a) + len(b)): 100 for equal strings, two empty ones too."""
    if a is None or b is None:
        return None
    return 200.0 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_sort(a: str | None, b: str | None) -> float | None:
    if a is None or b is None:
        return None
    return indel(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


@F.pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return _of_rows(a, b, str)


@F.pandas_udf(DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return _of_rows(a, b, _ordered)


def with_similarity(pairs: DataFrame) -> DataFrame:
    """pairs with ``sim``, the greater of both ratios of t_a and t_b as a share, instead of the texts; 0 where one is null or empty.

    For pairs that stand together by their texts: a batch compares each distinct
    pair once.  ``mapInArrow``, so that Python gets the columns given and no
    wider row waits for it.
    """
    import pyarrow as pa

    rest = [c for c in pairs.columns if c not in ("t_a", "t_b")]
    schema = StructType([*[pairs.schema[c] for c in rest], StructField("sim", DoubleType())])

    def run(batches):
        for batch in batches:
            a, b = (batch.column(c).fill_null("").dictionary_encode() for c in ("t_a", "t_b"))
            code = a.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(1, len(b.dictionary)) + b.indices.to_numpy(zero_copy_only=False)
            pair, back = np.unique(code, return_inverse=True)
            one, other = a.dictionary.to_pylist(), b.dictionary.to_pylist()
            left, right = [one[k] for k in pair // max(1, len(other))], [other[k] for k in pair % max(1, len(other))]
            both = np.maximum(_ratios(left, right), _ratios([*map(_ordered, left)], [*map(_ordered, right)])) / 100 if left else np.zeros(0)
            sim = np.where([bool(x and y) for x, y in zip(left, right, strict=True)], both, 0.0) if left else both
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(sim[back], pa.float64())], names=[*rest, "sim"])

    return pairs.mapInArrow(run, schema)


_VOWELS = "aeiou"


def _cons(w: str, i: int) -> bool:
    return w[i] not in _VOWELS and (w[i] != "y" or i == 0 or not _cons(w, i - 1))


def _measure(w: str) -> int:
    kinds = "".join("c" if _cons(w, i) else "v" for i in range(len(w)))
    return len(re.findall("vc", re.sub(r"(.)\1+", r"\1", kinds)))


def _has_vowel(w: str) -> bool:
    return any(not _cons(w, i) for i in range(len(w)))


def _cvc(w: str) -> bool:
    return len(w) > 2 and _cons(w, len(w) - 3) and not _cons(w, len(w) - 2) and _cons(w, len(w) - 1) and w[-1] not in "wxy"


# Suffix rules of the published algorithm, longest first where they overlap.
_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def porter(w: str) -> str:
    """The stem of a lower-case word by Porter's algorithm."""
    if len(w) < 3:
        return w
    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        stem = w[:-2] if w.endswith("ed") else w[:-3] if w.endswith("ing") else None
        if stem is not None and _has_vowel(stem):
            w = stem
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _cons(w, len(w) - 1) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        pairs = sorted((x.split(":") for x in rules.split()), key=lambda x: -len(x[0]))
        for end, new in pairs:
            if w.endswith(end):
                w = w[: -len(end)] + new if _measure(w[: -len(end)]) > 0 else w
                break
    for end in sorted(_STEP4.split(), key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _cvc(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


@F.pandas_udf(ArrayType(StringType()))
def porter_stems(tokens: pd.Series) -> pd.Series:
    """The stems of each row's tokens; a batch stems each distinct word once."""
    known: dict[str, str] = {}
    return pd.Series([None if t is None else [known.get(w) or known.setdefault(w, porter(w)) for w in t] for t in tokens])
