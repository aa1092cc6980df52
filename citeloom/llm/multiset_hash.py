"""Document fingerprints by a homomorphic multiset hash.

A text is the multiset of its paragraphs (non-empty lines).  Each paragraph is
hashed to a wide vector, and a fingerprint is the sum of these vectors: lanes of
64 bits modulo 2^64 from a digest of the whole paragraph, which tell multisets
apart, and lanes of 32 bits modulo 2^32, to which each run of three words adds
or takes one at a hashed place.  So the order of paragraphs doesn't matter,
inserting or deleting one adds or subtracts its vector, and the inner product of
two fingerprints' small lanes estimates what the texts share.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm import bytespans as B
from citeloom.llm.common import mapped, safe, written

#: Lanes that tell multisets apart, lanes for likeness (its standard error is 1 / sqrt(LANES) at most), words of a run.
EXACT, LANES, RUN = 8, 512, 3
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
#: Rows sampled for each part into which the ordered documents are cut, and parts for each partition.
SAMPLED, PARTS = 40, 3
#: Bytes of text, and rows, worked on at once.
SLICE, BLOCK = 1_000_000, 1000


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * _ODD[0]
        x = (x ^ (x >> np.uint64(29))) * _ODD[1]
        return x ^ (x >> np.uint64(32))


class Vectors:
    """The fingerprints of some texts: ``exact`` (texts, EXACT) of 64 bits and ``lanes`` (texts, LANES) of 32 bits."""

    def __init__(self, exact: np.ndarray, lanes: np.ndarray):
        self.exact, self.lanes = exact, lanes

    @classmethod
    def of(cls, texts: list[str]) -> Vectors:
        """Null-free texts; an empty one has the zero vector."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        paragraphs, owner = [], []
        for k, r in enumerate(raw):
            lines = [x for x in r.split(b"\n") if x]
            paragraphs += lines
            owner += [k] * len(lines)
        owner = np.array(owner, np.int64)
        exact = np.zeros((len(texts), EXACT), np.uint64)
        digests = np.frombuffer(b"".join([hashlib.blake2b(p, digest_size=8 * EXACT).digest() for p in paragraphs]), "<u8").reshape(-1, EXACT)
        with np.errstate(over="ignore"):
            np.add.at(exact, owner, digests)
        lanes = np.zeros((len(texts), LANES), np.int64)
        data, offsets = B.joined(pa.array(paragraphs, pa.large_binary()).cast(pa.large_string()))
        starts, ends, n = B.words(data, offsets)
        if len(starts):
            key, first = _runs(_mixed(B.quick(B.Spans(data), starts, ends - starts)), n)
            lane, sign = (key >> np.uint64(55)).astype(np.int64) % LANES, 1.0 - 2.0 * (key & np.uint64(1)).astype(np.float64)
            lanes = np.bincount(owner[first] * LANES + lane, weights=sign, minlength=len(texts) * LANES).astype(np.int64).reshape(-1, LANES)
        return cls(exact, lanes.astype(np.int32))

    def __getitem__(self, at) -> Vectors:
        return Vectors(self.exact[at], self.lanes[at])

    def plus(self, other: Vectors, sign: int = 1) -> Vectors:
        """The fingerprints after the paragraphs of ``other`` have come (1) or gone (-1)."""
        with np.errstate(over="ignore"):
            return Vectors(self.exact + other.exact if sign > 0 else self.exact - other.exact, self.lanes + np.int32(sign) * other.lanes)

    def near(self, other: Vectors) -> np.ndarray:
        """2xy / (xx + yy) of the lanes for likeness, within 0 to 1; exactly 1 for equal fingerprints and for no others."""
        x, y = self.lanes.astype(np.float64), other.lanes.astype(np.float64)
        both = (x * x).sum(axis=1) + (y * y).sum(axis=1)
        shared = 2 * (x * y).sum(axis=1) / np.where(both > 0, both, 1)
        same = (self.exact == other.exact).all(axis=1) & (self.lanes == other.lanes).all(axis=1)
        return np.where(same, 1.0, np.clip(shared, 0.0, 1.0 - 1e-9))

    def spelled(self) -> list[str]:
        """Each fingerprint as text: the 64-bit lanes, then the others as zigzag numbers of seven bits a byte, in base64."""
        flat = self.lanes.ravel().astype(np.int64)
        flat = (flat << 1) ^ (flat >> 63)
        size = 1 + sum((flat >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
        at = np.repeat(np.arange(len(flat)), size)
        step = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
        small = ((flat[at] >> 7 * step) & 127 | np.where(step + 1 < size[at], 128, 0)).astype(np.uint8).tobytes()
        ends = np.cumsum(size)[LANES - 1 :: LANES].tolist()
        head = self.exact.astype("<u8").tobytes()
        w = 8 * EXACT
        return [base64.b64encode(head[k * w : (k + 1) * w] + small[a:b]).decode() for k, (a, b) in enumerate(zip([0, *ends], ends, strict=False))]

    @classmethod
    def parsed(cls, texts: list[str]) -> Vectors:
        """The inverse of ``spelled``."""
        raw = [base64.b64decode(t) for t in texts]
        exact = np.frombuffer(b"".join(r[: 8 * EXACT] for r in raw), "<u8").reshape(-1, EXACT).copy()
        data = np.frombuffer(b"".join(r[8 * EXACT :] for r in raw), np.uint8).astype(np.int64)
        last = data < 128
        number = np.cumsum(last) - last
        first = np.r_[0, np.flatnonzero(last)[:-1] + 1] if len(data) else data
        value = np.zeros(int(last.sum()), np.int64)
        np.add.at(value, number, (data & 127) << 7 * (np.arange(len(data)) - first[number]))
        return cls(exact, ((value >> 1) ^ -(value & 1)).astype(np.int32).reshape(-1, LANES))


def _runs(words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each run of RUN words inside a paragraph (of all words, if there are fewer), and its paragraph; n: words of each."""
    first = np.cumsum(n) - n
    key, owner = [], []
    for size in range(1, RUN + 1):
        times = np.maximum(n - RUN + 1, 0) if size == RUN else (n == size).astype(np.int64)
        of = np.repeat(np.arange(len(n)), times)
        at = np.repeat(first - np.cumsum(times) + times, times) + np.arange(len(of))
        h = np.full(len(of), size, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(size):
                h = _mixed(h * _ODD[2] + words[at + k])
        key.append(h)
        owner.append(of)
    return np.concatenate(key), np.concatenate(owner)


def _order(row) -> tuple:
    """Descending id, null last, then a hash of the text."""
    return (row["doc_id"] is None, ~(row["doc_id"] or 0), row["hash"])


def _parts(keys: DataFrame) -> DataFrame:
    """keys (doc_id, hash) with ``part``: consecutive stretches of the order, cut at sampled rows; where they are cut changes no result."""
    spark = keys.sparkSession
    parts = PARTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = min(1.0, SAMPLED * parts / max(keys.count(), 1))
    sample = sorted(map(_order, keys.select(F.col("doc_id").cast("long").alias("doc_id"), "hash").sample(share, 7).collect()))
    cuts = sorted({sample[k * len(sample) // parts] for k in range(1, parts)}) if sample else []
    none, ids, hashes = (np.array([c[i] for c in cuts], np.int64) for i in range(3))

    @F.pandas_udf("int")
    def part(missing: pd.Series, doc_id: pd.Series, h: pd.Series) -> pd.Series:
        """The number of cuts at or before each row, found by sorting both together."""
        mine = np.stack([missing.to_numpy(np.int64), ~doc_id.to_numpy(np.int64), h.to_numpy(np.int64)])
        both = np.concatenate([np.stack([none, ids, hashes]), mine], axis=1)
        n = len(none)
        rank = np.lexsort((np.arange(both.shape[1]), both[2], both[1], both[0]))
        out = np.empty(both.shape[1], np.int32)
        out[rank] = np.cumsum(rank < n)
        return pd.Series(out[n:])

    number = F.col("doc_id").cast("long")
    return keys.withColumn("part", part(number.isNull(), F.coalesce(number, F.lit(0).cast("long")), F.col("hash")))


def _with_followers(docs: DataFrame) -> DataFrame:
    """The rows in order, each part of them followed by the first row of the next part (guest); the last part by the first row of all.

    Only one row of each part moves twice: ids and hashes say which, and each
    text is shuffled once.
    """
    rows = docs.withColumn("hash", F.xxhash64("text"))
    numbered = _parts(rows.select("doc_id", "hash", "text"))
    keys = written(numbered.select("doc_id", "hash", "part"))
    top = keys.groupBy("part").agg(F.max("doc_id").alias("top"))
    first = keys.join(F.broadcast(top), "part").filter(F.col("doc_id").eqNullSafe(F.col("top"))).groupBy("part", "top").agg(F.min("hash").alias("least")).collect()
    first = sorted((r["part"], r["top"], r["least"]) for r in first)
    follows = [(first[k - 1][0], i, h) for k, (_, i, h) in enumerate(first)]  # of the first row of a part: the part before, the last one for the first
    kind = docs.schema["doc_id"].dataType.simpleString()
    heads = docs.sparkSession.createDataFrame(follows, f"part int, top {kind}, least long")
    guests = rows.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("top")) & (F.col("hash") == F.col("least"))).groupBy("part", "doc_id", "hash").agg(F.min("text").alias("text"))
    both = numbered.select("part", F.lit(False).alias("guest"), "doc_id", "hash", "text").unionByName(guests.select("part", F.lit(True).alias("guest"), "doc_id", "hash", "text"))
    return both.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part").sortWithinPartitions("part", "guest", F.desc_nulls_last("doc_id"), "hash", "text").drop("hash")


def _edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _blocks(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    lo = 0
    for texts in B.slices(b.column("text"), SLICE):
        for k in range(0, len(texts), BLOCK):
            yield b.slice(lo + k, min(BLOCK, len(texts) - k))
        lo += len(texts)


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None  # the last row of what was read before
    for b in batches:
        for part in _blocks(b):
            if held is not None:
                part = pa.Table.from_batches([held, part]).combine_chunks().to_batches()[0]
            if part.num_rows > 1:
                yield _rows(part)
            held = part.slice(part.num_rows - 1)


def _rows(rows: pa.RecordBatch) -> pa.RecordBatch:
    """All rows but the last one and guests, each with the one after it."""
    texts = rows.column("text").to_pylist()
    mine = np.flatnonzero(~rows.column("guest").to_numpy(zero_copy_only=False)[:-1])
    edited = [_edited(texts[k], texts[k + 1]) for k in mine.tolist()]
    vectors, changed = Vectors.of(texts), Vectors.of(edited)
    own, after = vectors[mine], vectors[mine + 1]
    ids = rows.column("doc_id").take(pa.array(mine))
    return pa.RecordBatch.from_arrays(
        [ids, pa.array([len(texts[k]) for k in mine.tolist()], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()), pa.array(own.spelled(), pa.string()), pa.array(changed.spelled(), pa.string()), pa.array(own.near(changed)), pa.array(own.near(after))],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the
    first as many (or all) of the next document's, in descending order of ids;
    after the last comes the first.  Null ids come last; rows with one id follow
    each other by a hash of their texts, then by the texts.  Null texts count as
    empty, and an empty text's fingerprint is the zero vector.  A single row
    follows itself; an empty table gives no rows; other columns are ignored.
    """
    rows = safe(docs, id_col, text_col).toDF("doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return mapped(_with_followers(rows), _fingerprinted, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of every whole text; null counts as empty; repeated rows stay repeated; other columns are ignored."""
    rows = safe(docs, id_col, text_col).toDF("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _blocks(b):
                found = Vectors.of(pc.fill_null(part.column("text"), "").to_pylist()).spelled()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])

    return mapped(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def changed(fingerprint: str, inserted: list[str] = (), deleted: list[str] = ()) -> str:
    """The fingerprint after paragraphs have come and gone, without the text."""
    out = Vectors.parsed([fingerprint])
    for sign, paragraphs in ((1, inserted), (-1, deleted)):
        if paragraphs:
            out = out.plus(Vectors.of(["\n".join(paragraphs)]), sign)
    return out.spelled()[0]
