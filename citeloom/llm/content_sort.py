"""Exact deduplication by content sort.

Rows are range-partitioned at sampled splitters over (first bytes of the
normalised text, its hash, id), so a hot text spreads over several partitions,
and the driver samples keys of a few bytes, never texts.  Spark's external sort
then places equal texts side by side; neighbours are compared in full.  Texts
that continue in the next partition meet again in a summary of two rows for
each partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import SPACE, mapped, safe, written

INTERIOR, FIRST, LAST = -1, 0, 1


class _Runs:
    """Turns sorted batches into rows of runs; holds the ids of the open run only."""

    def __init__(self, pid: int, id_type: pa.DataType):
        self.pid, self.id_type, self.closed = pid, id_type, 0
        self.ids: list[pa.Array] = []
        self.text, self.chars = None, 0

    def open(self, text: str, chars: int) -> None:
        self.text, self.chars, self.ids = text, chars, []

    def close(self, last: bool) -> Iterator[pa.RecordBatch]:
        if self.text is None:
            return
        ids = pa.concat_arrays(self.ids)
        edge = FIRST if not self.closed else LAST if last else INTERIOR
        self.closed += 1
        yield self._rows(ids, np.array([len(ids)]), [self.text], [self.chars], edge)
        self.text = None

    def inner(self, ids: pa.Array, sizes: np.ndarray, texts: list[str], chars: list[int]) -> pa.RecordBatch:
        self.closed += len(sizes)
        return self._rows(ids, sizes, texts, chars, INTERIOR)

    def _rows(self, ids, sizes, texts, chars, edge) -> pa.RecordBatch:
        n, first = len(ids), np.r_[0, np.cumsum(sizes)[:-1]]
        kept = np.zeros(n, bool)
        kept[first] = True
        run = np.repeat(np.arange(len(sizes)), sizes)
        sha = pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts]).take(pa.array(run))
        edge_text = pa.array([texts[0] if edge != INTERIOR else None] + [None] * (n - 1), pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, self.pid), pa.int32()), pa.array(np.full(n, edge), pa.int32()), ids, ids.take(pa.array(np.repeat(first, sizes))), pa.array(np.repeat(sizes, sizes), pa.int64()), pa.array(kept), sha, pa.array(np.repeat(chars, sizes), pa.int64()), edge_text],
            names=["pid", "edge", "doc_id", "keep_id", "group_size", "kept", "text_sha256", "chars", "edge_text"],
        )


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs = None
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        ids, texts, chars = b.column("doc_id"), b.column("norm"), b.column("chars")
        runs = runs or _Runs(TaskContext.get().partitionId(), ids.type)
        new = np.ones(n, bool)
        new[1:] = ~pc.equal(texts.slice(1), texts.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        new[0] = runs.text is None or texts[0].as_py() != runs.text
        starts = np.flatnonzero(new)
        head = starts[0] if len(starts) else n
        if head:
            runs.ids.append(ids.slice(0, head))
        if len(starts):
            yield from runs.close(last=False)
            if runs.closed == 0 and len(starts) > 1:  # the partition's first run is an edge
                runs.open(texts[starts[0]].as_py(), chars[starts[0]].as_py())
                runs.ids.append(ids.slice(starts[0], starts[1] - starts[0]))
                yield from runs.close(last=False)
                starts = starts[1:]
            if len(starts) > 1:
                at = pa.array(starts[:-1])
                yield runs.inner(ids.slice(starts[0], starts[-1] - starts[0]), np.diff(starts), texts.take(at).to_pylist(), chars.take(at).to_pylist())
            runs.open(texts[starts[-1]].as_py(), chars[starts[-1]].as_py())
            runs.ids.append(ids.slice(starts[-1]))
    if runs:
        yield from runs.close(last=True)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space (``SPACE``); null counts
    as empty.  Of equal texts the row with the most code points in the original
    text stays, then the smallest id; a null id comes after all others.  Of
    repeated rows with one id, one stays; ``keep_id`` is null only if every id
    of the group is null.  An empty table gives no rows; other columns of the
    input are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = safe(docs, id_col, text_col).toDF("doc_id", "text").select("doc_id", F.regexp_replace(text, SPACE + "+", "").alias("norm"), F.char_length(text).cast("long").alias("chars"))
    rows = rows.withColumns({"head": F.substring(F.encode("norm", "UTF-8"), 1, 16), "hash": F.xxhash64("norm")})
    order = ["head", "hash", "norm", F.desc("chars"), F.asc_nulls_last("doc_id")]
    ordered = rows.repartitionByRange("head", "hash", F.asc_nulls_last("doc_id")).sortWithinPartitions(*order)
    kind = ordered.schema["doc_id"].dataType.simpleString()
    marked = written(mapped(ordered.select("doc_id", "norm", "chars"), _mark, f"pid int, edge int, doc_id {kind}, keep_id {kind}, group_size long, kept boolean, text_sha256 string, chars long, edge_text string"))
    return _stitched(marked)


def _stitched(marked: DataFrame) -> DataFrame:
    """Joins the runs that partitions share: at most two rows of summary each, compared by their full texts."""
    out = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    edges = marked.filter("edge_text is not null")
    best = F.struct((-F.col("chars")).alias("less"), F.col("keep_id").isNull().alias("none"), "keep_id", "pid", "edge")
    groups = edges.groupBy("edge_text").agg(F.min(best).alias("best"), F.sum("group_size").alias("total"))
    at = edges.select("pid", "edge", "edge_text").join(groups, "edge_text").select("pid", "edge", "best", "total")
    inner = marked.filter(F.col("edge") == INTERIOR).select(*out)
    outer = (
        marked.filter(F.col("edge") != INTERIOR)
        .join(F.broadcast(at), ["pid", "edge"])  # two rows for each partition at most
        .select("doc_id", F.col("best.keep_id").alias("keep_id"), F.col("total").alias("group_size"), (F.col("kept") & (F.col("best.pid") == F.col("pid")) & (F.col("best.edge") == F.col("edge"))).alias("kept"), "text_sha256")
    )
    return inner.unionByName(outer)
