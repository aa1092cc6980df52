"""Language identification by prediction by partial matching.

Per language, a tree of byte contexts up to ``ORDER`` bytes holds frozen counts.
A byte costs what the longest known context says (method C: a symbol's count, or
the number of distinct symbols for an escape, over both together), escapes to
shorter contexts included; an unknown byte costs eight bits in the end.  A text's
language is the one with the shortest exact code.

All languages share one tree of the strings seen in any.  With ``E(c)``, the
escapes from context c down its suffixes, and a matched string m = context +
byte, the cost is E(context before) + R(m), where R(m) holds the price of the
longest suffix of m that the language knows, less the escapes that weren't
taken.  So a text is scored by walking the tree for all bytes at once, and two
table rows for each byte.

The counts come from a bounded sample: up to ``docs_per_lang`` labelled documents
for each of up to MAX_LANGS languages, chosen by a hash of the id, whole texts.
Every context seen is kept, and every text is scored whole.  Texts are learned
and scored in lower case, so that one in capitals is in its language, too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm import bytespans as B
from citeloom.llm.common import mapped, safe, written

#: The longest context; bytes scored at once; more languages than MAX_LANGS are refused, since a row of the tables is a number for each.
ORDER, CHUNK, MAX_LANGS = 4, 1 << 18, 256
UNKNOWN_BITS = 8.0
UNDETERMINED = "und"
#: Labelled documents of a language that the counts come from.
DOCS = 240


@dataclass
class Model:
    """langs: in code-point order; symbols: a byte's column in child; child: (nodes that can be contexts, symbols), of
    which the last is the dead node, with the leaves' numbers after it; escapes, rest: as E and R above, for each
    context and each node by language.  The root is node 0."""

    langs: list[str]
    symbols: np.ndarray
    child: np.ndarray
    escapes: np.ndarray
    rest: np.ndarray

    def bits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The code length of each text under each language, and its bytes."""
        data, offsets = B.joined(texts)
        size = np.diff(offsets) - 1
        sym = self.symbols[data]
        sym[offsets[1:] - 1] = self.child.shape[1] - 1  # the line feed after each text leads nowhere
        dead, root = len(self.child) - 1, 0
        out = np.zeros((len(texts), len(self.langs)))
        before = [np.full(ORDER, dead), root]  # deepest nodes at the end of the last chunk
        for lo in range(0, len(sym), CHUNK):
            s = sym[lo : lo + CHUNK]
            level = self.child[root][s]
            match, ends, context = np.where(level == dead, root, level), [level[-1]], None
            for k in range(1, ORDER + 1):
                context = match  # the longest of up to ORDER bytes
                level = self.child[np.r_[before[0][k - 1], level[:-1]], s]
                ends.append(level[-1])
                match = np.where(level == dead, match, level)
            cost = self.escapes[np.r_[before[1], context[:-1]]] + self.rest[match]
            cost[s == self.child.shape[1] - 1] = 0
            # The texts that this chunk has a part of.
            a, b = np.searchsorted(offsets, lo, side="right") - 1, np.searchsorted(offsets, lo + len(s))
            out[a:b] += np.add.reduceat(cost, np.maximum(offsets[a:b] - lo, 0), axis=0, dtype=np.float64)
            before = [np.array(ends[:ORDER]), context[-1]]
        return out, size


def train(samples: dict[str, list[str]]) -> Model:
    """The frozen tables of each language's texts; no language if all are empty."""
    langs = sorted(samples)
    texts = [(k, t.encode()) for k, lang in enumerate(langs) for t in samples[lang]]
    data = np.frombuffer(b"".join(t for _, t in texts), np.uint8)
    if not len(data):
        return Model([], np.zeros(256, np.int16), np.ones((2, 2), np.int32), np.zeros((2, 0)), np.zeros((2, 0)))
    size = np.array([len(t) for _, t in texts], np.int64)
    lang = np.repeat(np.array([k for k, _ in texts], np.int16), size)
    room = np.minimum(np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size) + 1, ORDER + 1).astype(np.int8)  # bytes of the text up to here
    seen = np.unique(data)
    unknown, stop = len(seen), len(seen) + 1
    symbols = np.full(256, unknown, np.int16)
    symbols[seen] = np.arange(len(seen))
    sym = symbols[data]
    # Nodes by level: the root, then the strings of 1 to ORDER + 1 bytes; at: the node that ends at each byte.
    parent, byte, counts, at = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros((1, len(langs)), np.float32)], np.zeros(len(data), np.int32)
    level = [0, 1]  # where each level starts
    for k in range(1, ORDER + 2):
        up = np.r_[np.int32(0), at[:-1]] if k > 1 else at
        keys, inverse = np.unique(np.where((room >= k) & (up >= 0), up.astype(np.int64) * stop + sym, -1), return_inverse=True)
        none = int(keys[0] < 0)  # bytes too near a text's start
        counts.append(np.bincount(inverse * len(langs) + lang, minlength=len(keys) * len(langs)).reshape(len(keys), -1)[none:].astype(np.float32))
        parent.append(keys[none:] // stop)
        byte.append(keys[none:] % stop)
        at = np.where(inverse >= none, level[-1] + inverse - none, -1).astype(np.int32)
        level.append(level[-1] + len(keys) - none)
    inner, total = level[-2], level[-1]  # nodes that can be contexts, and all
    parent, byte, counts = np.concatenate(parent), np.concatenate(byte), np.concatenate(counts)
    number = np.arange(total) + (np.arange(total) >= inner)  # the dead node is between contexts and leaves
    child = np.full((inner + 1, stop + 1), inner, np.int32)
    child[parent[1:], byte[1:]] = number[1:]
    n, kinds = np.zeros((inner, len(langs))), np.zeros((inner, len(langs)))
    for k in range(len(langs)):
        n[:, k] = np.bincount(parent[1:], counts[1:, k], inner)
        kinds[:, k] = np.bincount(parent[1:], counts[1:, k] > 0, inner)
    escapes, rest = np.zeros((inner + 1, len(langs)), np.float32), np.zeros((total + 1, len(langs)), np.float32)
    rest[0] = UNKNOWN_BITS
    with np.errstate(divide="ignore", invalid="ignore"):
        escape = np.where(n > 0, -np.log2(kinds / (n + kinds)), 0.0)
        escapes[0] = escape[0]
        suffix = np.zeros(1, np.int64)  # of the level before
        for lo, hi in zip(level[1:-1], level[2:], strict=True):
            up, base = parent[lo:hi], level[level.index(lo) - 1]
            suffix = child[suffix[up - base], byte[lo:hi]].astype(np.int64) if lo > 1 else np.zeros(hi - lo, np.int64)
            if lo < inner:
                escapes[lo:hi] = escape[lo:hi] + escapes[suffix]
            price = -np.log2(counts[lo:hi] / (n + kinds)[up]) - escapes[up]
            rest[number[lo:hi]] = np.where(counts[lo:hi] > 0, price, rest[suffix])
    return Model(langs, symbols, child, escapes, rest)


def sample(docs: DataFrame, docs_per_lang: int = DOCS) -> DataFrame:
    """lang, text: the bounded sample, in lower case; docs: (doc_id, text, lang)."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    share = written(known.groupBy("lang").agg((F.lit(float(docs_per_lang)) / F.count("*")).alias("share")))  # so small a table is broadcast, texts stay
    if share.count() > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return known.join(share, "lang").filter(place < F.col("share")).select("lang", F.lower("text").alias("text"))


def fit(docs: DataFrame, docs_per_lang: int = DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Trains on the driver from the bounded sample of the labelled rows: whole texts of about ``docs_per_lang`` rows for each language.

    More than MAX_LANGS languages are an error.
    """
    rows = sample(safe(docs, id_col, text_col, lang_col).toDF("doc_id", "text", "lang"), docs_per_lang).collect()
    by: dict[str, list[str]] = {}
    for lang, text in sorted(rows):
        by.setdefault(lang, []).append(text)
    return train(by)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, bits_per_byte for every whole text, in lower case.

    ``score`` is the language's posterior at equal priors, from the code
    lengths; ties go to the first language by code point.  Null texts and texts
    without a letter get ``und``, score 0 and no bits, as does everything if no
    language was learned.  Repeated rows stay; an empty table gives no rows;
    other columns are ignored.
    """
    rows = safe(docs, id_col, text_col).toDF("doc_id", "text")
    rows = rows.select("doc_id", F.when(F.col("text").rlike(r"\p{L}"), F.lower("text")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.langs, UNDETERMINED], object)
        for b in batches:
            lo = 0
            for part in B.slices(b.column("text")):
                n = len(part)
                lo += n
                known = np.array(part.is_valid()) & bool(m.langs)
                if m.langs:
                    bits, size = m.bits(part)
                    best = bits.argmin(axis=1)
                    score = np.where(known, 1 / np.exp2(bits.min(axis=1)[:, None] - bits).sum(axis=1), 0.0)
                    rate = np.where(known, bits.min(axis=1) / np.maximum(size, 1), 0.0)
                else:
                    best, score, rate = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
                pred = names[np.where(known, best, len(m.langs))]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo - n, n), pa.array(pred, pa.string()), pa.array(score), pa.array(rate, mask=~known)], names=["doc_id", "lang_pred", "score", "bits_per_byte"])

    return mapped(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, bits_per_byte double")


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 3: fold 1 is held out."""
    return F.crc32(F.col(id_col).cast("string")) % 3
