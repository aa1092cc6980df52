"""Nearest neighbours by maximum inner product over score-aware quantised vectors.

Euclidean nearness becomes an inner product: (x, -|x|^2 / 2) times (q, 1) is
largest for the nearest x.  Vectors are cut into pieces of a few dimensions, each
coded by one of 16 centres.  The codes minimise a score-aware loss that
penalises the residual parallel to the vector ``eta`` times as much as the rest,
since that part changes the largest inner products; the norm is kept as it is.
A query's table of 16 products for each piece scores all codes of a block, two
four-bit codes at a time, and the best are reranked by exact distances in double
precision on the original vectors.

Centres are fitted for each length of vectors on a bounded sample and kept in a
table; every vector is coded and scanned.  A task holds a block of vectors of
one length and reads the queries of that length slice by slice from the shared
folder; it returns at most ``k`` rows for each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.common import mapped, part_files, safe, written
from citeloom.llm.files import reader

CENTRES, SAMPLE, SWEEPS, LEAST_ROWS = 16, 16_384, 8, 2048
#: A block's vectors in double precision, and a slice's scores.
BLOCK_BYTES, SCORES = 64 << 20, 4 << 20


class Codebook:
    """centres: (pieces, 16, width) of vectors padded with zeros to whole pieces, an even number of them."""

    def __init__(self, sample: np.ndarray, width: int = 2, eta: float = 4.0):
        self.dims, self.width, self.eta = sample.shape[1], width, eta
        self.pieces = -(-self.dims // (2 * width)) * 2
        x = self._cut(sample)
        rng = np.random.default_rng(11)
        self.centres = x[rng.choice(len(x), CENTRES, replace=len(x) < CENTRES)].transpose(1, 0, 2).copy()
        for sweep in range(SWEEPS):
            codes = self._nearest(x) if sweep == 0 else self._coded(x, codes)
            self._refit(x, codes)

    @classmethod
    def stored(cls, dims: int, width: int, eta: float, centres: bytes) -> Codebook:
        """A codebook of centres fitted before."""
        book = cls.__new__(cls)
        book.dims, book.width, book.eta, book.pieces = dims, width, eta, -(-dims // (2 * width)) * 2
        book.centres = np.frombuffer(centres).reshape(book.pieces, CENTRES, width)
        return book

    def _cut(self, vectors: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(vectors), self.pieces * self.width))
        padded[:, : self.dims] = vectors
        return padded.reshape(len(vectors), self.pieces, self.width)

    def _nearest(self, x: np.ndarray) -> np.ndarray:
        # |x - c|^2 without |x|^2, which all centres share.
        return np.stack([((c**2).sum(axis=1) - 2 * x[:, p] @ c.T).argmin(axis=1) for p, c in enumerate(self.centres)], axis=1)

    def _coded(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """One sweep of coordinate descent over the pieces: each takes the centre with the least loss, the others held."""
        unit = _units(x)
        row = np.arange(len(x))
        along = ((x - self.centres[np.arange(self.pieces), codes]) * unit).sum(axis=(1, 2))
        codes = codes.copy()
        for p, c in enumerate(self.centres):
            own = (x[:, p] * unit[:, p]).sum(axis=1)[:, None] - unit[:, p] @ c.T
            rest = along - own[row, codes[:, p]]
            loss = (c**2).sum(axis=1) - 2 * x[:, p] @ c.T + (self.eta - 1) * (rest[:, None] + own) ** 2
            codes[:, p] = loss.argmin(axis=1)
            along = rest + own[row, codes[:, p]]
        return codes

    def _refit(self, x: np.ndarray, codes: np.ndarray) -> None:
        """Each centre to the least loss of its vectors, the other pieces' residuals held."""
        unit = _units(x)
        parts = ((x - self.centres[np.arange(self.pieces), codes]) * unit).sum(axis=2)
        along = parts.sum(axis=1)
        for p in range(self.pieces):
            of = (codes[:, p, None] == np.arange(CENTRES)).astype(float)  # (rows, 16)
            u, v = unit[:, p], x[:, p]
            pull = u * ((v * u).sum(axis=1) + along - parts[:, p])[:, None]
            left = of.sum(axis=0)[:, None, None] * np.eye(self.width) + (self.eta - 1) * (of.T @ (u[:, :, None] * u[:, None, :]).reshape(len(x), -1)).reshape(CENTRES, self.width, self.width)
            right = of.T @ (v + (self.eta - 1) * pull)
            some = of.any(axis=0)
            self.centres[p, some] = np.linalg.solve(left[some], right[some][:, :, None])[:, :, 0]
            now = ((v - self.centres[p, codes[:, p]]) * u).sum(axis=1)
            along += now - parts[:, p]
            parts[:, p] = now

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """(rows, pieces / 2) bytes of two codes each."""
        x = self._cut(vectors)
        codes = self._coded(x, self._coded(x, self._nearest(x))).astype(np.uint8)
        return codes[:, 0::2] | codes[:, 1::2] << 4

    def decode(self, packed: np.ndarray) -> np.ndarray:
        """The vectors that the codes stand for."""
        codes = np.stack([packed & 15, packed >> 4], axis=2).reshape(len(packed), self.pieces)
        return self.centres[np.arange(self.pieces), codes].reshape(len(packed), -1)[:, : self.dims]

    def scan(self, queries: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """Approximate inner products of (queries, rows) from tables of 256 pairs of codes."""
        q = self._cut(queries)
        table = np.einsum("qpw,pcw->pqc", q, self.centres).astype(np.float32)
        out = np.zeros((len(queries), len(packed)), np.float32)
        for p in range(0, self.pieces, 2):
            pair = (table[p, :, None, :] + table[p + 1, :, :, None]).reshape(len(queries), 256)
            out += np.take(pair, packed[:, p // 2], axis=1)
        return out


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x**2).sum(axis=(1, 2), keepdims=True)), 1e-30)


def _best(score: np.ndarray, k: int, margin: float) -> np.ndarray:
    """Places of the scores that are at most the margin below the k-th largest."""
    if len(score) <= k:
        return np.arange(len(score))
    return np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k] - margin)


def _slices(files: list[str], size: int, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids, marks and vectors of one length in Parquet files sorted by length, at most so many rows at a time."""
    import pyarrow.parquet as pq

    for path in files:
        with reader(path) as f:
            file = pq.ParquetFile(f)
            at = file.schema_arrow.names.index("size")  # the columns before it are flat
            spans = [file.metadata.row_group(g).column(at).statistics for g in range(file.num_row_groups)]
            groups = [g for g, s in enumerate(spans) if s is None or not s.has_min_max or s.min <= size <= s.max]
            for b in file.iter_batches(rows, row_groups=groups, columns=["size", "vec_id", "mark", "embedding"]):
                sizes = b.column("size").to_numpy()
                if not (mine := sizes == size).all():
                    b = b.filter(pa.array(mine))
                if b.num_rows:
                    yield b.column("vec_id").to_numpy(), b.column("mark").to_numpy(), _matrix(b)


def _book(files: list[str], size: int, width: int, eta: float) -> Codebook:
    """The codebook of a length."""
    import pyarrow.parquet as pq

    for path in files:
        with reader(path) as f:
            found = pq.read_table(f, filters=[("size", "=", size)])
        if found.num_rows:
            return Codebook.stored(size, width, eta, found.column("centres")[0].as_py())
    raise ValueError(f"no centres for vectors of length {size}")


def _books(indexed: DataFrame, width: int, eta: float) -> DataFrame:
    """size, centres: a codebook for each length, fitted on the SAMPLE vectors with the smallest hashes.

    A threshold that more than SAMPLE hashes pass leaves the rest out before
    the shuffle.
    """
    h = F.xxhash64("vec_id", "mark")
    counts = indexed.groupBy("size").agg(F.count("*").alias("n"))
    low = h <= F.lit(-(2.0**63)) + F.lit(2.0**64) * F.lit(1.25 * SAMPLE) / F.col("n")
    few = indexed.select("size", "vec_id", "mark", "embedding").join(counts, "size").filter(low).select("size", "embedding", h.alias("h"))
    first = Window.partitionBy("size").orderBy("h")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        book = Codebook(np.stack(rows.sort_values("h", kind="stable")["embedding"].to_list()), width, eta)
        return pd.DataFrame({"size": [book.dims], "centres": [book.centres.tobytes()]})

    return few.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= SAMPLE).drop("r").groupBy("size").applyInPandas(fit, "size int, centres binary")


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return b.column("embedding").flatten().to_numpy().reshape(b.num_rows, -1)


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, embedding, mark of the rows that take part, repeated rows once; mark tells the vectors of one id apart."""
    v = safe(df, id_col, vector_col).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = v.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine & F.exists("embedding", lambda x: x != 0))
    return v.dropDuplicates(["vec_id", "embedding"]).withColumn("mark", F.xxhash64("embedding"))


def search(vectors: DataFrame, is_query, k: int = 10, spread: float = 3.0, width: int = 2, eta: float = 4.0, block_rows: int | None = None, block_queries: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score, mark: the k nearest found for each row for which ``is_query`` holds, never the row itself.

    score is the Euclidean distance; equal distances rank the smaller id first.
    ``is_query`` is a condition on vec_id.  Vectors that are null, zero, or hold
    a null or non-finite component, and rows with a null id, take no part.  Ids
    are integers.  Repeated rows, of one id with one vector, are one row.  Rows
    of one id with different vectors are rows of their own: each is a candidate
    of the others, and each is a query with ranks of its own, told apart by
    ``mark``, a hash of the query's vector.  Vectors of different lengths have
    no distance, so each is searched among those of its length, of which there
    may be any number.  An empty table gives no rows; other columns are ignored.

    A task holds a block of rows, by default of BLOCK_BYTES, so that longer
    vectors make smaller blocks, and a slice of queries of SCORES scores.
    In each block of rows all candidates are measured exactly whose approximate
    score is below the k-th best by no more than ``spread`` standard deviations
    of the difference that coding makes, so a dense cluster of near copies is
    measured as a whole.  Of equal vectors only the k + 1 smallest ids can be
    among any k nearest, so only those are coded; tasks keep no more of each
    vector even before the shuffle.
    """
    good = written(usable(vectors, id_col, vector_col).select(F.size("embedding").alias("size"), "vec_id", "mark", "embedding"))
    copies = Window.partitionBy("embedding").orderBy("vec_id")
    indexed = written(good.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1).drop("copy"))
    total, numbers = indexed.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    books = part_files(written(_books(indexed, width, eta)))
    asked = part_files(written(good.filter(is_query).sortWithinPartitions("size")))
    blocks = -(-total // block_rows) if block_rows else -(-8 * numbers // BLOCK_BYTES)
    tasks = max(blocks, min(good.sparkSession.sparkContext.defaultParallelism, -(-total // LEAST_ROWS)), 1)
    height = lambda size: block_rows or max(1024, BLOCK_BYTES // (8 * size))

    def nearest(book: Codebook, ids: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The k nearest in one block of rows for all queries of their length, which are read slice by slice."""
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        packed = book.encode(x)
        error = np.sqrt(((x - book.decode(packed)) ** 2).sum(axis=1).mean() / x.shape[1])
        half = ((x**2).sum(axis=1) / 2).astype(np.float32)
        for qids, marks, qx in _slices(asked, book.dims, block_queries or max(1, min(128, SCORES // height(book.dims)))):
            near = book.scan(qx, packed) - half
            found = []
            for i, score in enumerate(near):
                at = _best(score, k + 1, spread * np.sqrt(2) * error * np.sqrt((qx[i] ** 2).sum()))
                at = at[(ids[at] != qids[i]) | (x[at] != qx[i]).any(axis=1)]
                exact = np.sqrt(np.cumsum((x[at] - qx[i]) ** 2, axis=1)[:, -1])  # summed in the order of the components
                first = np.lexsort((ids[at], exact))[:k]
                found.append((np.full(len(first), qids[i]), np.full(len(first), marks[i]), ids[at][first], exact[first]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["query_id", "mark", "vec_id", "score"])

    def search_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, ids, x, n = None, [], [], 0
        for b in batches:
            sizes = b.column("size").to_numpy()
            cuts = np.r_[0, np.flatnonzero(np.diff(sizes)) + 1, len(sizes)]
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if lo == hi:
                    continue
                size = int(sizes[lo])
                if n and (size != book.dims or n >= height(size)):
                    yield from nearest(book, np.concatenate(ids), np.concatenate(x))
                    ids, x, n = [], [], 0
                if book is None or size != book.dims:
                    book = _book(books, size, width, eta)
                ids.append(b.column("vec_id")[lo:hi].to_numpy())
                x.append(_matrix(b.slice(lo, hi - lo)))
                n += hi - lo
        if n:
            yield from nearest(book, np.concatenate(ids), np.concatenate(x))

    spread_out = indexed.select("size", "vec_id", "embedding").repartitionByRange(tasks, "size", F.xxhash64("vec_id")).sortWithinPartitions("size")
    met = mapped(spread_out, search_blocks, "query_id long, mark long, vec_id long, score double")
    order = Window.partitionBy("query_id", "mark").orderBy("score", "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "mark")
