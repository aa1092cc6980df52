"""Streams over several batches: versions meet in state, windows are settled once, late rows are kept."""

import datetime

import pytest
from pyspark.sql import functions as F

from citeloom.streaming import incremental as I

LIKE = "paper string, modified long, title string"


def put(spark, rows, path, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_versions_in_different_batches_and_a_restart(spark, tmp_path):
    src, out, chk = (str(tmp_path / n) for n in ("src", "out", "chk"))
    like = spark.createDataFrame([], LIKE)
    batches = [[("a", 1, "a1"), ("b", 5, "b5"), ("c", None, "none"), ("a", 1, "also a1")], [("a", 3, "a3"), ("b", 2, "b2"), ("c", 0, "c0")], [("a", 2, "a2"), ("b", 5, "b5"), ("d", 1, "d1")]]
    for n, rows in enumerate(batches):
        put(spark, rows, src, LIKE)
        if n != 1:  # the second batch is taken up after a restart, with the third
            I.take_up_versions(I.table_stream(spark, like, src, 1), "paper", "modified", chk, out)
    want = sorted(map(tuple, I.newest_versions(spark.read.schema(LIKE).parquet(src), "paper", "modified").collect()))
    assert [r[:2] for r in want] == [("a", 3), ("b", 5), ("c", 0), ("d", 1)]
    assert sorted(map(tuple, I.current(spark, out, like, "paper", "modified").collect())) == want
    taken = spark.read.schema(LIKE).parquet(out).drop("batch")
    assert taken.filter("title in ('a2', 'b2')").count() == 0 and taken.filter("paper = 'b'").count() == 1  # what is older, or the same again, isn't taken up
    I.take_up_versions(I.table_stream(spark, like, src, 1), "paper", "modified", chk, out)
    assert spark.read.schema(LIKE).parquet(out).count() == taken.count()


EVENTS = "ts timestamp, event_type string, value double"


def at(hour, minute=0):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hour, minutes=minute)


@pytest.mark.parametrize("runs", [1, 4])
def test_windows_are_settled_once_and_late_rows_kept(spark, tmp_path, runs):
    src, out, chk = (str(tmp_path / n) for n in ("src", "out", "chk"))
    like = spark.createDataFrame([], EVENTS)
    batches = [
        [(at(h, m), "x", 1.0) for h in range(5) for m in (0, 30)],
        [(at(h), "y", 2.0) for h in range(4, 9)] + [(at(0), "x", 100.0), (at(4, 5), "x", 1.0)],  # the first hour is settled by now, the fifth isn't
        [(at(8, 59), "y", 1.0), (None, "y", 1.0)] + [(at(h), "z", 3.0) for h in range(9, 30)] + [(at(1), "late", 7.0)],
        [(at(5), "late", 1.0), (at(29, 30), "z", 3.0)],
    ]
    for n, rows in enumerate(batches):
        put(spark, rows, src, EVENTS)
        if runs > 1:
            query = I.settled_counts(I.table_stream(spark, like, src, 1), chk, out)
    if runs == 1:
        query = I.settled_counts(I.table_stream(spark, like, src, 1), chk, out)
    late = sorted((r["ts"], r["event_type"]) for r in I.late_rows(spark, out, like).collect())
    assert late == sorted([(at(0), "x"), (at(1), "late"), (at(5), "late")])
    counts = spark.read.parquet(f"{out}/counts")
    got = sorted((r["window_start"], r["event_type"], r["n"], r["total"]) for r in counts.collect())
    every = spark.read.schema(EVENTS).parquet(src).join(I.late_rows(spark, out, like), ["ts", "event_type", "value"], "left_anti")
    closed = I.event_counts(every).filter(F.col("window_start") + F.expr("interval 1 hour") <= F.lit(at(29, 20)))
    assert got == sorted((r["window_start"], r["event_type"], r["n"], r["total"]) for r in closed.collect()) and len(got) == len(set(g[:2] for g in got))
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert held[-1] == 1  # the one window that isn't settled; the state of the others went
    if runs > 1:
        assert max(held) <= 1 + len(batches[3])


def test_versions_meet_in_a_join_not_in_state_of_every_key(spark, tmp_path):
    """Many keys in a few batches: what was taken up is the state, and a null key is a key."""
    src, out, chk = (str(tmp_path / n) for n in ("src", "out", "chk"))
    like = spark.createDataFrame([], LIKE)
    version = lambda on, at, title: spark.range(5000).filter(on).selectExpr("if(id = 0, null, string(id)) AS paper", f"{at}L AS modified", f"'{title}' AS title")
    for rows in (version("true", 5, "first"), version("id % 2 = 0", 9, "newer"), version("id % 3 = 0", 7, "other")):
        rows.write.mode("append").parquet(src)
        I.take_up_versions(I.table_stream(spark, like, src), "paper", "modified", chk, out)
    titles = {r["title"]: r["count"] for r in I.current(spark, out, like, "paper", "modified").groupBy("title").count().collect()}
    assert titles == {"newer": 2500, "other": 833, "first": 1667}
    assert spark.read.schema(LIKE).parquet(out).count() == 5000 + 2500 + 833  # of the third batch the rows that nothing newer came before
    assert not (tmp_path / "chk" / "state").exists()
