"""SentencePiece encoding as batched numpy Viterbi, and decoding.

A text is split where a run of space marks begins, since no piece has a space
mark after another character (checked when a model is loaded), and around
characters that are in no piece; the segmentation of a text is then that of its
words, one after another.  Distinct words of equal length advance together:
hashes of all their substrings probe the sorted keys of the pieces, and at each
position a maximum over the lengths of the last piece stores the backpointer.

For a unigram model the maximum is over sums of scores; ties take the longest
last piece.  A model of merges is decided by transitions instead: a sequence of
pieces is what the merges give if and only if they give each two neighbours
back when run on those alone (the first merge across a boundary would also
happen there).  So at each position exactly one last piece is admissible after
the one before it, and the maximum finds it.  Verdicts on pairs are remembered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from citeloom.llm import bytespans as B
from citeloom.llm.common import kept, mapped, safe
from citeloom.llm.simhash import _mixed

MARK, SPACE = 0x2581, 0x20
#: Words up to this length advance together, longer ones, never remembered, go one by one; words hashed at once.
TOGETHER, WORDS, PROBES, REMEMBERED, UNKNOWN_PENALTY = 128, 1 << 18, 400_000, 200_000, 10.0
#: Before a word; less than any character's number, which keeps packed pairs positive.
START, VERDICTS = -2 - 0x110000, 500_000
_BASE = 0x9E3779B97F4A7C15 | 1


def _settings(proto: bytes) -> dict[tuple[int, int], list[int]]:
    """A serialised model's settings: by (message, field), the values of numbers and the lengths of others."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value, shift, at = value | (proto[at] & 127) << shift, shift + 7, at + 1
            if proto[at - 1] < 128:
                return value, at

    def fields(at: int, end: int) -> Iterator[tuple[int, int, int]]:
        """Field, value or length, and where the field's content starts."""
        while at < end:
            key, at = number(at)
            kind = key & 7
            value, at = number(at) if kind in (0, 2) else (0, at + (8 if kind == 1 else 4))
            yield key >> 3, value, at
            at += value if kind == 2 else 0

    out: dict[tuple[int, int], list[int]] = {}
    for message, size, at in fields(0, len(proto)):
        for f, value, _ in fields(at, at + size):
            out.setdefault((message, f), []).append(value)
    return out


#: Fixed numbers of the format: messages, their fields, and values of two of them.
_PIECE, _TRAINER, _NORMALIZER, _DENORMALIZER = 1, 2, 3, 5
_TYPE, _MODEL_TYPE, _SUFFIX, _CHAR_MAP, _PREFIX, _EXTRA_SPACES, _ESCAPED = 3, 3, 24, 2, 3, 4, 5
_UNIGRAM, _MERGES, _USER_DEFINED, _UNUSED = 1, 2, 4, 5


def _is_of_merges(proto: bytes) -> bool:
    """Whether a serialised model is one of merges; refuses what isn't supported."""
    found = _settings(proto)
    last = lambda message, field, default: found.get((message, field), [default])[-1]
    kind = last(_TRAINER, _MODEL_TYPE, _UNIGRAM)
    if kind not in (_UNIGRAM, _MERGES):
        raise ValueError("a model that is neither of unigrams nor of merges")
    if last(_NORMALIZER, _CHAR_MAP, 0) or last(_DENORMALIZER, _CHAR_MAP, 0):
        raise ValueError("a model that normalises characters")
    if not last(_NORMALIZER, _PREFIX, 1) or last(_NORMALIZER, _EXTRA_SPACES, 1) or not last(_NORMALIZER, _ESCAPED, 1) or last(_TRAINER, _SUFFIX, 0):
        raise ValueError("a model that treats spaces in another way than to mark each and to set one before the text")
    if {_USER_DEFINED, _UNUSED} & {*found.get((_PIECE, _TYPE), [])}:
        raise ValueError("a model with user-defined or unused pieces")
    return kind == _MERGES


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE to the power of 0 to n and of 0 to -n, modulo 2^64."""
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.r_[np.uint64(1), np.full(n, np.uint64(b))]) for b in (_BASE, pow(_BASE, -1, 1 << 64)))


_UP, _DOWN = _powers(TOGETHER)


def _sums(codes: np.ndarray) -> np.ndarray:
    """Running sums whose differences, times a power, are hashes of substrings; codes: (words, length)."""
    with np.errstate(over="ignore"):
        out = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
        np.cumsum(_mixed(codes.astype(np.uint64), 1) * _UP[None, : codes.shape[1]], axis=1, out=out[:, 1:])
        return out


def _flat(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all elements of ranges, one range after another, and each one's place within its range."""
    within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.repeat(starts, sizes) + within, within


def _word_keys(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each word, of one code point at least."""
    with np.errstate(over="ignore"):
        flat, within = _flat(starts, sizes)
        value = _mixed(codes[flat].astype(np.uint64), 1) * _UP[within]
        return _mixed(np.add.reduceat(value, np.cumsum(sizes) - sizes), 2) + sizes.astype(np.uint64)


class Pieces:
    """A model's pieces: encodes and decodes batches of texts."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        special = [m.is_control(i) or m.is_unknown(i) or m.is_unused(i) for i in range(n)]
        self.byte = {int(m.id_to_piece(i)[1:-1], 16): i for i in range(n) if m.is_byte(i)}
        self.unknown = m.unk_id()
        self.merges = _is_of_merges(m.serialized_model_proto())
        self.verdicts: dict[int, bool] = {}
        self.judged, self.allowed = np.zeros(0, np.int64), np.zeros(0, np.int8)
        normal = [i for i in range(n) if not special[i] and not m.is_byte(i)]
        self.text = {m.id_to_piece(i): (m.get_score(i), i) for i in normal}
        if any("▁" in p.lstrip("▁") for p in self.text):
            raise ValueError("a piece has a space mark after another character")
        self.longest = max(map(len, self.text))
        if self.longest > TOGETHER:
            raise ValueError(f"a piece of more than {TOGETHER} characters")
        self.bottom = min(s for s, _ in self.text.values()) - UNKNOWN_PENALTY
        by_length: dict[int, list[str]] = {}
        for p in self.text:
            by_length.setdefault(len(p), []).append(p)
        keys, ids = [], []
        for k, group in by_length.items():
            keys.append(_sums(np.array([[ord(c) for c in p] for p in group]))[:, -1])
            ids.append([self.text[p][1] for p in group])
        keys, ids = np.concatenate(keys), np.concatenate(ids)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order].astype(np.int32)
        self.scores = np.array([m.get_score(int(i)) for i in self.ids])
        self.lengths = np.array([len(m.id_to_piece(int(i))) for i in self.ids])
        self.names = [m.id_to_piece(i) for i in range(n)]
        self.piece_codes = np.zeros((len(self.ids), self.longest), np.uint32)
        for row, i in zip(self.piece_codes, self.ids.tolist(), strict=True):
            row[: len(self.names[i])] = [*map(ord, self.names[i])]
        self.inside = np.zeros(0x110000, bool)
        self.inside[[ord(c) for p in self.text for c in p]] = True
        self.bucket = np.r_[np.searchsorted(self.keys, np.arange(1 << 20, dtype=np.uint64) << np.uint64(44)), len(self.keys)].astype(np.int32)
        raw = [b"" if special[i] else bytes([int(m.id_to_piece(i)[1:-1], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
        raw[self.unknown] = " ⁇ ".encode()
        self.raw = pa.array(raw, pa.large_binary())
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.first, self.flat = np.zeros(1, np.int64), np.zeros(0, np.int32)
        self.place, self.codes = np.zeros(1, np.int64), np.zeros(0, np.uint32)  # of the words themselves
        self.spans = B.Spans(self.codes.view(np.uint8))

    def _fallback(self, char: str) -> list[int]:
        return [self.byte[b] for b in char.encode()] if self.byte else [self.unknown]

    def probe(self, key: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The place of each substring among the sorted keys, or -1; a key's first bits say where to look, mostly that nothing is there."""
        out, flat = np.full(key.shape, -1, np.int64), key.ravel()
        first = (flat >> np.uint64(44)).astype(np.int64)
        at, end = self.bucket[first], self.bucket[first + 1]
        on = np.flatnonzero(at < end)
        at, end = at[on], end[on]
        while len(on):
            same = self.keys[at] == flat[on]
            out.ravel()[on[same]] = at[same]
            more = ~same & (at + 1 < end)
            on, at, end = on[more], at[more] + 1, end[more]
        return np.where(self.lengths[out] == size, out, -1)

    def merged(self, text: str) -> list[str]:
        """What the merges make of a short text: the best score first, the first place among equals."""
        parts = list(text)
        while True:
            best, at = -np.inf, -1
            for k in range(len(parts) - 1):
                found = self.text.get(parts[k] + parts[k + 1])
                if found and (found[0] > best or at < 0):
                    best, at = found[0], k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _spelled(self, code: int) -> str:
        """A piece by its id, a character without one by -2 less its code point, nothing by START."""
        return "" if code == START else chr(-2 - code) if code < 0 else self.names[code]

    def admissible(self, pair: int) -> bool:
        """Whether the merges leave two neighbours, packed in one number, as they are."""
        if (found := self.verdicts.get(pair)) is None:
            left, right = self._spelled((pair >> 24) + START), self._spelled((pair & 0xFFFFFF) + START)
            found = self.verdicts[pair] = self.merged(left + right) == ([left, right] if left else [right])
        return found

    def one(self, word: str) -> list[int]:
        """The plain form of the same search, for very long words."""
        if self.merges:
            return self._one_of_merges(word)
        best, back = [0.0] + [-np.inf] * len(word), [(0, -1)] * (len(word) + 1)
        for i in range(len(word)):
            single = False
            for j in range(i + 1, min(len(word), i + self.longest) + 1):
                if found := self.text.get(word[i:j]):
                    single |= j == i + 1
                    if best[i] + found[0] > best[j]:
                        best[j], back[j] = best[i] + found[0], (i, found[1])
            if not single and best[i] + self.bottom > best[i + 1]:
                best[i + 1], back[i + 1] = best[i] + self.bottom, (i, -1)
        out, at = [], len(word)
        while at:
            i, piece = back[at]
            out.append(self._fallback(word[i:at]) if piece < 0 else [piece])
            at = i
        return [x for part in reversed(out) for x in part]

    def _one_of_merges(self, word: str) -> list[int]:
        last, size = [START], [0]
        for j in range(1, len(word) + 1):
            for k in range(min(self.longest, j), 0, -1):
                found = self.text.get(word[j - k : j])
                if found is None and k > 1:
                    continue
                code = found[1] if found else -2 - ord(word[j - 1])
                if self.admissible((last[j - k] - START) << 24 | code - START):
                    last.append(code)
                    size.append(k)
                    break
        out, at = [], len(word)
        while at:
            out.append([last[at]] if last[at] >= 0 else self._fallback(chr(-2 - last[at])))
            at -= size[at]
        return [x for part in reversed(out) for x in part]

    def together(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and each word's number of ids; codes: the code points of (words, length)."""
        n, length = codes.shape
        sums = _sums(codes)
        best, back = np.full((n, length + 1), -np.inf), np.zeros((n, length + 1), np.int16)
        piece = np.full((n, length + 1), -1, np.int32)
        best[:, 0], piece[:, 0] = 0, START
        for j in range(1, length + 1):
            sizes = np.arange(min(self.longest, j), 0, -1)
            with np.errstate(over="ignore"):
                key = (sums[:, j, None] - sums[:, j - sizes]) * _DOWN[j - sizes][None, :]
            at = self.probe(key, sizes[None, :])
            hit = at >= 0
            ids = np.where(hit, self.ids[at], -1)
            ids[:, -1] = np.where(hit[:, -1], ids[:, -1], -codes[:, j - 1].astype(np.int32) - 2)
            if self.merges:
                total = self._transitions(piece[:, j - sizes], ids)
            else:
                score = np.where(hit, self.scores[at], -np.inf)
                score[:, -1] = np.where(hit[:, -1], score[:, -1], self.bottom)
                total = best[:, j - sizes] + score
            pick = np.argmax(total, axis=1)
            row = np.arange(n)
            best[:, j], back[:, j] = total[row, pick], sizes[pick]
            piece[:, j] = ids[row, pick]
            some = np.flatnonzero(hit[row, pick])
            if not self._holds(codes, some, j - sizes[pick[some]], sizes[pick[some]], at[some, pick[some]]):
                return self._one_by_one(codes)  # another string has a piece's hash
        steps, at, row = [], np.full(n, length), np.arange(n)
        while at.any():
            steps.append(np.where(at > 0, piece[row, at], -1))
            at = np.where(at > 0, at - back[row, at], 0)
        found = np.stack(steps[::-1], axis=1)
        count = (found != -1).sum(axis=1)
        flat = found[found != -1]
        if not len(odd := np.flatnonzero(flat < 0)):
            return flat, count
        fallback = [self._fallback(chr(-2 - c)) for c in flat[odd].tolist()]
        times = np.ones(len(flat), np.int64)
        times[odd] = [len(x) for x in fallback]
        word = np.repeat(np.arange(n), count)
        flat = np.repeat(flat, times)
        flat[flat < 0] = np.fromiter((i for x in fallback for i in x), np.int32)
        return flat, np.bincount(word, weights=times, minlength=n).astype(np.int64)

    def _holds(self, codes: np.ndarray, row: np.ndarray, start: np.ndarray, size: np.ndarray, piece: np.ndarray) -> bool:
        """Whether the pieces chosen are what stands in the words."""
        flat, within = _flat(start, size)
        return bool((codes[np.repeat(row, size), flat] == self.piece_codes[np.repeat(piece, size), within]).all())

    def _one_by_one(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [self.one("".join(map(chr, word))) for word in codes.tolist()]
        return np.fromiter((i for x in found for i in x), np.int32), np.array([len(x) for x in found], np.int64)

    def _transitions(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """1 where a candidate is admissible after what is before it, else 0."""
        out = np.zeros(ids.shape, np.int8)
        on = np.nonzero(ids != -1)
        pairs = (before[on].astype(np.int64) - START) << 24 | (ids[on].astype(np.int64) - START)
        distinct, of = np.unique(pairs, return_inverse=True)
        at = np.minimum(np.searchsorted(self.judged, distinct), max(len(self.judged) - 1, 0))
        known = self.judged[at] == distinct if len(self.judged) else np.zeros(len(distinct), bool)
        verdict = self.allowed[at] if len(self.judged) else np.zeros(len(distinct), np.int8)
        verdict[~known] = np.fromiter(map(self.admissible, distinct[~known].tolist()), np.int8, int((~known).sum()))
        out[on] = verdict[of]
        return out

    def _settle(self) -> None:
        """New verdicts on pairs join the sorted ones."""
        if len(self.judged) + len(self.verdicts) > VERDICTS:
            self.judged, self.allowed = self.judged[:0], self.allowed[:0]
        keys = np.concatenate([self.judged, np.fromiter(self.verdicts, np.int64, len(self.verdicts))])
        allowed = np.concatenate([self.allowed, np.fromiter(self.verdicts.values(), np.int8, len(self.verdicts))])
        self.judged, first = np.unique(keys, return_index=True)
        self.allowed = allowed[first]
        self.verdicts = {}

    def _learn(self, codes: np.ndarray, keys: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        firsts, flats, words = [self.first], [self.flat], [self.codes]
        for size in np.unique(sizes).tolist():
            of = np.flatnonzero(sizes == size)
            step = max(1, PROBES // (size * self.longest))
            for lo in range(0, len(of), step):
                part = of[lo : lo + step]
                words.append(codes[starts[part][:, None] + np.arange(size)])
                ids, count = self.together(words[-1])
                self.known.update(zip(keys[part].tolist(), range(len(self.known), len(self.known) + len(part)), strict=True))
                firsts.append(firsts[-1][-1] + np.cumsum(count))
                flats.append(ids)
        self.first, self.flat = np.concatenate(firsts), np.concatenate(flats)
        self.place = np.r_[self.place, self.place[-1] + np.cumsum(np.concatenate([np.full(len(w), w.shape[1]) for w in words[1:]]))]
        self.codes = np.concatenate([w.ravel() for w in words])
        self.spans = B.Spans(self.codes.view(np.uint8))
        if len(self.verdicts) > 2000:
            self._settle()

    def _differ(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Whether words aren't those remembered in their slots."""
        out = self.place[slot + 1] - self.place[slot] != sizes
        shorter = np.minimum(sizes, self.place[slot + 1] - self.place[slot])
        flat, within = _flat(starts, shorter)
        same = codes[flat] == self.codes[np.repeat(self.place[slot], shorter) + within]
        return out if same.all() else out | ~np.logical_and.reduceat(same, np.cumsum(shorter) - shorter)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text."""
        marked = ["▁" + t.replace(" ", "▁") if t else "" for t in texts]
        codes = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4")
        bound = np.cumsum([0, *map(len, marked)])
        mark = codes == MARK
        begins = mark.copy()
        begins[1:] &= ~mark[:-1]
        alone = ~self.inside[codes]
        begins |= alone
        begins[1:] |= alone[:-1]
        begins[bound[:-1][bound[:-1] < len(codes)]] = True  # a text's first code point
        starts = np.flatnonzero(begins)
        sizes = np.diff(np.r_[starts, len(codes)])
        short = np.flatnonzero(sizes <= TOGETHER)
        keys = np.zeros(len(starts), np.uint64)
        for lo in range(0, len(short), WORDS):
            part = short[lo : lo + WORDS]
            keys[part] = _word_keys(codes, starts[part], sizes[part])
        distinct, at, word = np.unique(keys[short], return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > REMEMBERED:
            self._forget()
        known = distinct.tolist()
        new = np.array([k for k, key in enumerate(known) if key not in self.known], np.int64)
        if len(new):
            self._learn(codes, distinct[new], starts[short[at[new]]], sizes[short[at[new]]])
        slot = np.zeros(len(starts), np.int64)
        slot[short] = np.fromiter((self.known[k] for k in known), np.int64, len(known))[word] if len(known) else 0
        first, flat = self.first, self.flat
        plain, place = sizes > TOGETHER, self.place[slot[short]]
        if (self.place[slot[short] + 1] - place != sizes[short]).any() or not B.same(B.Spans(codes.view(np.uint8)), 4 * starts[short], self.spans, 4 * place, 4 * sizes[short]):
            plain[short] = self._differ(codes, starts[short], sizes[short], slot[short])  # words that share another's hash go one by one, too
        if len(long := np.flatnonzero(plain)):
            found = [self.one("".join(map(chr, codes[starts[k] : starts[k] + sizes[k]]))) for k in long]
            slot[long] = len(first) - 1 + np.arange(len(long))
            first = np.r_[first, first[-1] + np.cumsum([len(x) for x in found])]
            flat = np.r_[flat, np.fromiter((i for x in found for i in x), np.int32)]
        n = first[slot + 1] - first[slot] if len(starts) else np.zeros(0, np.int64)
        total = np.r_[0, np.cumsum(n)]
        ids = flat[np.repeat(first[slot] - total[:-1], n) + np.arange(total[-1])] if len(starts) else np.zeros(0, np.int32)
        total = total[np.searchsorted(starts, bound)]
        if not self.byte:  # unknown characters in a row are one unknown piece
            again = np.r_[False, (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)][: len(ids)]
            again[total[:-1][total[:-1] < len(ids)]] = False
            ids, total = ids[~again], total - np.r_[0, np.cumsum(again)][total]
        return ids, np.diff(total)

    def decode(self, ids: pa.ListArray) -> list[str]:
        """The text of each list of ids; without ids it is empty."""
        bound = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
        flat = ids.values.slice(bound[0], bound[-1] - bound[0])
        joined = self.raw.take(flat)
        at = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset + bound - bound[0]] if len(joined) else np.zeros(len(bound), np.int64)
        data = joined.buffers()[2].to_pybytes() if len(joined) else b""
        return [data[a:b].decode("utf-8", "replace").removeprefix(" ") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _texts(column: pa.Array) -> Iterator[list[str]]:
    for part in B.slices(column):
        yield [t or "" for t in part.to_pylist()]


def _lists(ids: np.ndarray, n: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, model: str, decoded: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the ids of every whole text, one row per input row; if asked, also ``text``, decoded from the ids at once.

    Null and empty texts have no ids and decode to an empty text.  Characters
    outside the model become byte pieces, or, if the model has none, one unknown
    piece for each run of them.  Models that normalise characters, that treat
    spaces otherwise than by one mark each, or that have pieces of over TOGETHER
    characters, user-defined or unused ones, are an error.  Decoding gives the text back exactly, unless it holds the space mark
    itself, which becomes a space.  Repeated rows stay repeated; an empty table
    gives no rows; other columns are ignored.
    """
    rows = safe(docs, id_col, text_col).toDF("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = kept("pieces", model, Pieces)
        for b in batches:
            lo = 0
            for texts in _texts(b.column("text")):
                ids = _lists(*coder.encode(texts))
                columns = {"doc_id": b.column("doc_id").slice(lo, len(texts)), "ids": ids} | ({"text": pa.array(coder.decode(ids), pa.string())} if decoded else {})
                yield pa.RecordBatch.from_pydict(columns)
                lo += len(texts)

    return mapped(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>" + ", text string" * decoded, "pieces")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """The columns of ``encoded`` (doc_id, ids) and the text that the ids give; without ids it is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = kept("pieces", model, Pieces)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                texts = coder.decode(part.column("ids"))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return mapped(encoded.select("doc_id", "ids"), run, f"doc_id {kind}, ids array<int>, text string", "pieces")
