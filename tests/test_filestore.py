"""An index that is kept per file equals one built anew, and leaves untouched parts alone."""

import os

from pyspark.sql import functions as F

from citeloom.sources.filestore import ContextStore

SCHEMA = "file string, purpose string, quote string"


def parse(files):
    rows = files.select("file", F.explode(F.from_json("value", "array<struct<purpose:string,quote:string>>")).alias("c"))
    return rows.select("file", "c.*")


def listing(spark, names, version):
    return spark.createDataFrame([(f"f{k}", f'[{{"purpose":"p{(k + version(k)) % 3}","quote":"{k} {version(k)}"}},{{"purpose":"p{k % 2}","quote":"second"}}]' if k % 7 else "[]") for k in names], "file string, value string")


def parts(path):
    out = {}
    for top, _, names in os.walk(path):
        for n in names:
            if n.endswith(".parquet"):
                out.setdefault(os.path.basename(top), set()).add(n)
    return out


def test_updates_equal_a_full_build(spark, tmp_path):
    kept = ContextStore(spark, str(tmp_path / "kept"), parse, SCHEMA, parts=64)
    kept.update(listing(spark, range(90), lambda k: 0))
    before = {n: parts(tmp_path / "kept" / n) for n in ("rows", "sums", "files")}
    now = listing(spark, [k for k in range(100) if k % 13], lambda k: int(k % 30 == 1))
    states = {r["file"]: r["state"] for r in kept.update(now).collect()}
    assert states == {f"f{k}": "gone" for k in range(0, 90, 13)} | {f"f{k}": "changed" for k in range(90) if k % 30 == 1 and k % 13 and k % 7} | {f"f{k}": "new" for k in range(90, 100) if k % 13}
    fresh = ContextStore(spark, str(tmp_path / "fresh"), parse, SCHEMA, parts=64)
    fresh.update(now)
    read = lambda df: sorted(map(tuple, df.collect()))
    assert read(kept.rows()) == read(fresh.rows()) == read(parse(now)) and read(kept.purposes()) == read(fresh.purposes()) and read(kept.files()) == read(fresh.files())
    touched = {f"part={r['p']}" for r in spark.createDataFrame([(f,) for f in states], "file string").selectExpr("pmod(xxhash64(file), 64) as p").collect()}
    for name, was in before.items():
        after = parts(tmp_path / "kept" / name)
        assert {k: v for k, v in was.items() if k not in touched} == {k: v for k, v in after.items() if k not in touched} and len(touched) < 64
    assert kept.update(now).count() == 0


def test_everything_may_go(spark, tmp_path):
    kept = ContextStore(spark, str(tmp_path), parse, SCHEMA, parts=4)
    assert kept.rows().count() == 0 and kept.purposes().count() == 0
    kept.update(listing(spark, range(10), lambda k: 0))
    kept.update(listing(spark, [], lambda k: 0))
    assert kept.rows().count() == 0 and kept.purposes().count() == 0 and kept.files().count() == 0
    kept.update(listing(spark, range(3), lambda k: 1))
    assert kept.rows().count() == 4
