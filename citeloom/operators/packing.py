"""Next-fit packing of an ordered table into bins of bounded size, without a pass from the first row to the last.

All that a range of rows needs to know of those before it is up to which place
the bin that is open at its start has room.  So each range says what any such
place leads to: the place for the next range, and how many bins begin.  That is
a step function with a step for each row that may begin the range's first bin,
fewer where packings soon meet.  A pass over the steps, a few for each range,
gives every range its place; then the ranges pack their rows by themselves.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.sources.store import cut


def running(df: DataFrame, order: list[str | Column], sums: dict[str, Column]) -> DataFrame:
    """df, in ranges of ``order``, with running sums of columns, each row's own included.

    ``order`` settles the place of every row.  A window runs over each range;
    the ranges' sums, a row for each, are put before them.
    """
    ordered = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    rows = ordered.withColumn("_part", part)
    rows = rows.withColumns({name: F.sum(value).over(inside) for name, value in sums.items()})
    whole = ordered.groupBy(part.alias("_part")).agg(*[F.sum(value).alias(f"_{name}") for name, value in sums.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = whole.select("_part", *[F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).alias(f"_{name}") for name in sums])  # a row for each range
    done = rows.join(F.broadcast(shifts), "_part")
    return done.select(*df.columns, *[(F.col(name) + F.col(f"_{name}")).cast("long").alias(name) for name in sums])


#: A place before all others; no bin is open.
_NONE = -(1 << 61)


def _following(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's end, and the first row that no longer fits into a bin that begins at it; the number of rows, if all do."""
    ends = np.cumsum(sizes)
    return ends, np.maximum(np.searchsorted(ends, ends - sizes + room, "right"), np.arange(1, len(ends) + 1))


def _steps(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a range, with places from its start: from which place of the open bin's end a step holds, the place after the range, and the bins that begin in it.

    A bin that has room for the whole range stays open; its place, counted from
    the next range's start, is its own less the range's size (a last step of no bins).
    """
    (ends, follow), n = _following(sizes, room), len(sizes)
    jump, last, count = np.r_[follow, n], np.arange(n + 1), np.r_[np.ones(n, np.int64), 0]
    while (jump < n).any():  # pointers of 1, 2, 4, ... bins, until all lead beyond the last row
        last, count, jump = np.where(jump < n, last[jump], last), count + count[jump], jump[jump]
    after = (ends - sizes + room)[last[:n]] - ends[-1]
    since = np.r_[_NONE, ends[:-1]]
    may = (since <= room) & np.r_[True, sizes[1:] > 0]  # a row without a size fits wherever the one before it did
    since, after, count = since[may], after[may], count[:n][may]
    new = np.r_[True, (np.diff(after) != 0) | (np.diff(count) != 0)]
    return np.r_[since[new], ends[-1]], np.r_[after[new], -ends[-1]], np.r_[count[new], 0]


def _bins(sizes: np.ndarray, room: int, place: int, before: int) -> np.ndarray:
    """The bins of a range's rows; ``place``: the open bin's end, the last of ``before`` bins."""
    ends, follow = _following(sizes, room)
    begins, at = np.zeros(len(sizes), np.int64), int(np.searchsorted(ends, place, "right"))
    while at < len(sizes):
        begins[at], at = 1, int(follow[at])
    return before - 1 + np.cumsum(begins)


def packed(df: DataFrame, order: list[str], size: Column, most: int, header: int = 0) -> DataFrame:
    """df with ``bin``, from 0: rows in order fill bins of at most ``most`` bytes, ``header`` of which each bin spends itself.

    A row that no longer fits begins the next bin; one that fits into none has a
    bin of its own.  Null sizes count as 0.  ``order`` names columns whose values
    are distinct together; an empty table gives no rows.
    """
    import pyarrow as pa

    if most <= header:
        raise ValueError("a header fills a bin")
    room = most - header
    amount = F.greatest(F.coalesce(size, F.lit(0)).cast("long"), F.lit(0).cast("long"))
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), amount.alias("size"), *[F.col(f"`{c}`").alias(f"k{n}") for n, c in enumerate(order)])
    keys = [f"k{n}" for n in range(len(order))]
    ordered = cut(whole.repartitionByRange(*keys).sortWithinPartitions(*keys).select("row", "size").withColumn("at", F.monotonically_increasing_id()))
    sizes = ordered.select(F.shiftright("at", 33).alias("part"), "at", "size")

    def steps(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        since, after, count = _steps(table.column("size").to_numpy(), room)
        return pa.table({"part": pa.array([table.column("part")[0].as_py()] * len(since), pa.int64()), "since": since, "after": after, "n": count})

    def places(batches):
        part, place, before, found = None, _NONE, 0, None
        for batch in batches:
            out = []
            for p, since, after, n in zip(*(batch.column(c).to_pylist() for c in ("part", "since", "after", "n")), strict=True):
                if p != part:
                    if found is not None:
                        place, before = found
                    out.append((p, place, before))
                    part = p
                if since <= place:  # the last step that holds counts
                    found = (after if n else place + after, before + n)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], names=["part", "place", "before"])

    def bins(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        place, before = (table.column(c)[0].as_py() for c in ("place", "before"))
        return pa.table({"at": table.column("at"), "bin": _bins(table.column("size").to_numpy(), room, place, before)})

    function = sizes.groupBy("part").applyInArrow(steps, "part long, since long, after long, n long")
    opened = cut(function.repartition(1).sortWithinPartitions("part", "since").mapInArrow(places, "part long, place long, before long"))  # a few rows for each range, one held at a time
    found = sizes.join(F.broadcast(opened), "part").groupBy("part").applyInArrow(bins, "at long, bin long")
    return ordered.join(found, "at").select("row.*", "bin")
