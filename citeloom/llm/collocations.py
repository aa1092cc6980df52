"""Phrase collocations: merged count-min sketches, an exact second pass, scores, subsumption.

Two sketch passes overestimate counts of n-grams: the first those of words and
pairs, the second those of longer phrases all of whose pairs survive the first.
A task counts saturating cells in an array of fixed size; arrays are merged cell
by cell, and what every task gets back is one bit a cell: whether it reaches the
least count.  Sketches never underestimate, so nothing frequent is lost; the
third pass counts the survivors exactly, by their full text.  The size of a
sketch decides how much of what is rare reaches that pass, never the result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm import bytespans as B
from citeloom.llm.common import mapped, safe, written

#: Rows of a sketch; cells of each: one for so many bytes of input, within bounds; cells that move together.
ROWS, BYTES_A_CELL, FEWEST, MOST, CHUNK = 2, 8, 1 << 16, 1 << 24, 1 << 16
#: Bytes of input of one sketch at most.
A_TASK = 2 << 30
SLICE = 4_000_000
#: Parts of a language that are ranked each for itself first.
RANKED_APART = 64
_WORD, _GAP, _STOP = 0, 1, 2
_KIND = np.full(256, _WORD, np.uint8)
_KIND[list(b" \t")] = _GAP
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = _STOP
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x * _ODD[0]
        x = (x ^ (x >> np.uint64(31))) * _ODD[1]
        return x ^ (x >> np.uint64(29))


class Words:
    """The words of some texts: their bytes with one space after each, an exact number for each distinct word, and which are neighbours in a piece."""

    def __init__(self, texts: pa.Array, langs: np.ndarray, lang_keys: np.ndarray):
        """langs: each text's language, as a place in ``lang_keys``."""
        data, offsets = B.joined(texts)
        data = B.lowered(data)
        kind = _KIND[data]
        solid = kind == _WORD
        edge = np.diff(solid.view(np.int8), prepend=np.int8(0))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        piece = np.cumsum(kind == _STOP, dtype=np.int32)[starts]
        self.n = len(starts)
        self.linked = np.r_[piece[1:] == piece[:-1], False][: self.n]  # a text's end is a stop, too
        self.lang = langs[np.searchsorted(offsets, starts, side="right") - 1]
        keep = solid.copy()
        keep[1:] |= solid[:-1]
        self.data = np.where(solid, data, np.uint8(32))[keep]
        self.at = np.r_[0, np.cumsum(ends - starts + 1)]
        spelled = pa.Array.from_buffers(pa.large_binary(), self.n, [None, pa.py_buffer(self.at.astype(np.int64)), pa.py_buffer(self.data)]).dictionary_encode()
        self.code, self.distinct = spelled.indices.to_numpy().astype(np.int64), max(len(spelled.dictionary), 1)
        joined, bound = B.joined(spelled.dictionary.cast(pa.large_string()))
        self.key = _mixed(B.quick(B.Spans(joined), bound[:-1], np.diff(bound)))[self.code]
        with np.errstate(over="ignore"):
            self.one = _mixed(self.key + lang_keys[self.lang])

    def longer(self, hashes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
        """Hashes of the phrases of k words at ``at``, from those of the first k - 1."""
        with np.errstate(over="ignore"):
            return _mixed(hashes + self.key[at + k - 1] * np.uint64(2 * k + 1))

    def grams(self, most: int, passes: Callable[[np.ndarray, int], np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(k, places, hashes) of the phrases of each length that pass, and whose shorter phrases all do."""
        at, hashes = np.arange(self.n), self.one
        for k in range(1, most + 1):
            if k > 1:
                stays = np.zeros(self.n + 1, bool)
                stays[at] = True
                on = self.linked[at] & stays[at + 1] if k == 2 else stays[at + 1]
                at = at[on]
                hashes = self.longer(hashes[on], at, k)
            on = passes(hashes, k)
            at, hashes = at[on], hashes[on]
            yield k, at, hashes

    def spelled(self, at: np.ndarray, k: int) -> pa.Array:
        """The phrases of k words at ``at``: neighbours lie side by side, one space between."""
        raw = self.data.tobytes()
        return pa.array([raw[a:b] for a, b in zip(self.at[at].tolist(), (self.at[at + k] - 1).tolist(), strict=True)], pa.binary()).cast(pa.string())


def _languages(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct languages of a batch, each row's place among them, and a key for each."""
    coded = column.dictionary_encode()
    names = coded.dictionary.to_pylist()
    keys = np.array([zlib.crc32(x.encode()) | zlib.crc32(x.encode(), 7) << 32 for x in names], np.uint64)
    return names, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), _mixed(keys)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], Words]]:
    for b in batches:
        if not b.num_rows:
            continue
        names, places, keys = _languages(b.column("lang"))
        lo = 0
        for texts in B.slices(b.column("text"), SLICE):
            yield names, Words(texts, places[lo : lo + len(texts)], keys)
            lo += len(texts)


def _cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((hashes * _ODD[row]) >> np.uint64(64 - bits)).astype(np.int64)


class Reached:
    """Merged sketches as bits: whether a phrase's cells reach the least count in every row."""

    def __init__(self, rows: np.ndarray, bits: int):
        self.rows, self.bits = rows, bits

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        on = np.arange(len(hashes))
        for row in range(ROWS):
            cell = _cells(hashes[on], row, self.bits)
            on = on[(self.rows[row, cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1]
        out = np.zeros(len(hashes), bool)
        out[on] = True
        return out


def _everything(hashes: np.ndarray, k: int) -> np.ndarray:
    return np.ones(len(hashes), bool)


def _sketched(lengths: tuple[int, ...], bits: int, least: int, before):
    """A task's sketch of the phrases of some lengths; cells saturate where that can't hide that the least count is reached."""
    kind = np.uint8 if least <= 255 else np.uint32
    top = np.iinfo(kind).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached = before.value if before else None

        def passes(hashes: np.ndarray, k: int) -> np.ndarray:
            return reached(hashes) if reached and k < lengths[0] else _everything(hashes, k)

        counts = np.zeros((ROWS, 1 << bits), kind)
        for _, words in _sliced(batches):
            for k, _, hashes in words.grams(lengths[-1], passes):
                if k in lengths:
                    for row in range(ROWS):
                        cell, times = np.unique(_cells(hashes, row, bits), return_counts=True)
                        counts[row, cell] = np.minimum(counts[row, cell].astype(np.int64) + times, top)
        step = min(CHUNK, 1 << bits)
        for row in range(ROWS):
            for lo in range(0, 1 << bits, step):
                part = counts[row, lo : lo + step]
                if part.any():
                    yield pa.RecordBatch.from_pydict({"chunk": pa.array([(row << bits) + lo], pa.int64()), "counts": pa.array([part.tobytes()], pa.binary())})

    return run


def _merged(least: int):
    """Sums the sketches of all tasks chunk by chunk; of a cell stays whether it reaches the least count."""
    kind = np.uint8 if least <= 255 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for b in batches:
            for chunk, counts in zip(b.column("chunk").to_pylist(), b.column("counts"), strict=True):
                part = np.frombuffer(counts.as_buffer(), kind)
                if chunk != now:
                    if now is not None:
                        yield _bits(now, total, least)
                    now, total = chunk, np.zeros(len(part), np.int64)
                total += part
        if now is not None:
            yield _bits(now, total, least)

    return run


def _bits(chunk: int, total: np.ndarray, least: int) -> pa.RecordBatch:
    bits = np.packbits(total >= least, bitorder="little")
    return pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int64()), "bits": pa.array([bits.tobytes()], pa.binary())})


def _reached(rows: DataFrame, lengths: tuple[int, ...], bits: int, least: int, before):
    """The merged sketch as a broadcast: ROWS * 2^bits bits, 4 MB at MOST cells, whatever the input."""
    spark = rows.sparkSession
    parts = mapped(rows, _sketched(lengths, bits, least, before), "chunk long, counts binary")
    found = written(mapped(parts.repartition("chunk").sortWithinPartitions("chunk"), _merged(least), "chunk long, bits binary"))
    out = np.zeros((ROWS, (1 << bits) // 8), np.uint8)
    for r in found.toLocalIterator():
        part = np.frombuffer(r["bits"], np.uint8)
        row, lo = divmod(r["chunk"], 1 << bits)
        out[row, lo // 8 : lo // 8 + len(part)] = part
    return spark.sparkContext.broadcast(Reached(out, bits))


def _counted(longest: int, short, long):
    """Rows (lang, k, phrase, f) of the survivors in each slice, counted by their full texts; k = 0 counts all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = short.value, long.value

        def passes(hashes: np.ndarray, k: int) -> np.ndarray:
            return (first if k <= 2 else second)(hashes)

        for names, words in _sliced(batches):
            total = np.bincount(words.lang, minlength=len(names))
            yield _rows(names, np.arange(len(names)), 0, pa.array([""] * len(names)), total)
            number = np.zeros(words.n + 1, np.int64)  # of the phrase that begins at each place, exact
            for k, at, _ in words.grams(longest, passes):
                if not len(at):
                    break
                before = words.lang[at] if k == 1 else number[at]
                _, one, number[at], times = np.unique(before * words.distinct + words.code[at + k - 1], return_index=True, return_inverse=True, return_counts=True)
                yield _rows(names, words.lang[at[one]], k, words.spelled(at[one], k), times)

    return run


def _rows(names: list[str], lang: np.ndarray, k: int, phrase: pa.Array, f: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(lang)), pa.array(np.full(len(lang), k), pa.int32()), phrase, pa.array(f, pa.int64())], names=["lang", "k", "phrase", "f"])


def phrase_counts(docs: DataFrame, least: int = 30, longest: int = 4, lang_col: str = "lang", text_col: str = "text", cells: int = MOST) -> DataFrame:
    """lang, k, phrase, f: every phrase of up to ``longest`` words with at least ``least`` occurrences, exactly counted; k = 0: all words of a language.

    Written to the shared folder.  The text is read three times; a sketch covers
    up to A_TASK bytes of it, so that its size is small beside what it counts.
    A worker holds ROWS * ``cells`` bytes of counts at most; the bits that
    return to it, by way of the driver, are an eighth of that.  Of an input with
    far more than 30 phrases for each cell the sketches drop little: give more
    cells where memory allows.
    """
    rows = safe(docs, lang_col, text_col).toDF("lang", "text").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    spark = docs.sparkSession
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    bits = (min(max(size // BYTES_A_CELL, FEWEST), cells) - 1).bit_length()
    few = rows.coalesce(max(spark.sparkContext.defaultParallelism, min(size // A_TASK, 1 << 20)))
    short = _reached(few, (1, 2), bits, least, None)
    long = _reached(few, (3, *range(4, longest + 1)), bits, least, short) if longest > 2 else short
    found = mapped(rows, _counted(longest, short, long), "lang string, k int, phrase string, f long")
    return written(found.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f")).filter((F.col("k") == 0) | (F.col("f") >= least)))


def _words(first: Column | int, n: Column | int) -> Column:
    """n words of the column words, from the first one on (1 is the first)."""
    return F.array_join(F.slice("words", first, n), " ")


def _exact(c: str) -> Column:
    return F.col(c).cast("decimal(20,0)")


def scored(counts: DataFrame) -> DataFrame:
    """Candidates with their lowest-scoring cut: lang, k, phrase, a, l, r, score."""
    phrases = counts.filter("k > 0").select("lang", "phrase", "f")
    candidates = counts.filter("k > 1").select("lang", "k", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")).select("lang", "k", "phrase", "a", "cut", _words(F.lit(1), F.col("cut")).alias("first"), _words(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    # Written, so that the joins start from plain shuffles, which AQE may split where very many phrases share a part.
    left = written(written(cuts).join(phrases.toDF("lang", "first", "l"), ["lang", "first"]))
    both = left.join(phrases.toDF("lang", "rest", "r"), ["lang", "rest"])
    score = F.expr("(cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = both.groupBy("lang", "k", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))
    return best.select("lang", "k", "phrase", "a", "best.l", "best.r", "best.score")


def _unsubsumed(candidates: DataFrame, share: int) -> DataFrame:
    """Candidates that no longer one holds with at least ``share`` percent of their occurrences."""
    words = candidates.select("lang", "k", F.col("a").alias("longer"), F.split("phrase", " ").alias("words"))
    sizes = words.filter("k > 2").select("*", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("n"))
    parts = sizes.select("lang", "longer", "n", "words", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("n") + 1)).alias("from")).select("lang", "longer", _words(F.col("from"), F.col("n")).alias("phrase"))
    most = parts.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    held = F.coalesce(_exact("longer") * 100 >= _exact("a") * share, F.lit(False))
    return candidates.join(most, ["lang", "phrase"], "left").filter(~held).drop("longer")


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, top: int = 2000, share: int = 80, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Each language's best phrases: lang, rank (from 1), phrase, a, l, r, n, score.

    Texts are lower-cased in A-Z and split at ``[.,;:!?\\x0A-\\x0D]`` into pieces,
    these into words ``[^\\x20\\x09]+``; null texts are empty, a null language is
    ``und``.  A candidate has 2 to ``longest`` words and a >= ``least``
    occurrences; l and r are those of its parts at the cut with the lowest
    floor(2000000 a / (l + r)), the first such cut; n counts all words of the
    language.  A candidate inside a longer one with at least ``share`` percent
    of its occurrences is dropped.  Order: score, a (both descending), phrase (by
    bytes).  Repeated rows count each time; a table without a candidate gives no
    rows; other columns are ignored.
    """
    counts = phrase_counts(docs, least, longest, lang_col, text_col)
    total = counts.filter("k = 0").select("lang", F.col("f").alias("n"))
    best = _unsubsumed(written(scored(counts)), share)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    best = best.withColumn("apart", F.pmod(F.xxhash64("phrase"), F.lit(RANKED_APART)))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "apart").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
