"""Structural patches: applied to the old documents they give the new ones, and back."""

import json
import random

from citeloom.operators import patch


def docs(spark, values):
    return spark.createDataFrame([(k, None if v is None else json.dumps(v, ensure_ascii=False)) for k, v in values.items()], "key string, value string")


def read(df):
    return {r["key"]: json.loads(r["value"]) for r in df.collect()}


def grown(rng, depth=0):
    kind = rng.randrange(6 if depth < 3 else 3)
    if kind < 3:
        return [rng.randrange(5), rng.choice(["a", "é/~", "", "x"]), rng.choice([None, True, False])][kind]
    if kind < 5:
        return {rng.choice(["a", "b/c", "d~e", "", "0", "é"]): grown(rng, depth + 1) for _ in range(rng.randrange(4))}
    return [grown(rng, depth + 1) for _ in range(rng.randrange(4))]


def changed(rng, v, depth=0):
    if rng.random() < 0.25:
        return grown(rng, depth)
    if isinstance(v, dict):
        return {k: changed(rng, x, depth + 1) for k, x in v.items() if rng.random() < 0.85} | ({"new": grown(rng, depth + 1)} if rng.random() < 0.2 else {})
    if isinstance(v, list):
        return [changed(rng, x, depth + 1) for x in v if rng.random() < 0.85] + ([grown(rng, depth + 1)] if rng.random() < 0.3 else [])
    return v


def test_patches_and_their_inverses(spark):
    rng = random.Random(8)
    old = {f"k{n}": {"r": grown(rng), "l": [grown(rng) for _ in range(3)]} for n in range(120)}
    new = {k: changed(rng, v) for k, v in old.items() if rng.random() < 0.9} | {f"n{n}": grown(rng) for n in range(10)}
    new = {k: v for k, v in new.items() if v is not None}  # a null text is no document
    found = patch.diff(docs(spark, old), docs(spark, new))
    assert read(patch.applied(docs(spark, old), found)) == new
    assert read(patch.applied(docs(spark, new), patch.inverse(found))) == old
    assert found.join(found.selectExpr("key", "path as above"), "key").filter("path <> above and startswith(path, concat(above, '/'))").count() == 0


def test_operations_stand_at_the_highest_pointer(spark):
    old = {"a": {"x": {"y": 1, "z": [1, 2, {"q": 1}]}, "a/b": {"~": 1}, "same": [1]}, "gone": 1}
    new = {"a": {"x": {"y": "1", "z": [1]}, "a/b": {"~": 2}, "same": [1], "w": {"v": []}}, "come": {"n": 1}}
    got = sorted((r["key"], r["path"], r["operation"], r["before"], r["after"]) for r in patch.diff(docs(spark, old), docs(spark, new)).collect())
    want = [("a", "/a~1b/~0", "replace", "1", "2"), ("a", "/w", "add", None, '{"v":[]}'), ("a", "/x/y", "replace", "1", '"1"'), ("a", "/x/z/1", "remove", "2", None), ("a", "/x/z/2", "remove", '{"q":1}', None), ("come", "", "add", None, '{"n":1}'), ("gone", "", "remove", "1", None)]
    assert got == sorted(want)


def test_versions_are_taken_back(spark):
    rng = random.Random(5)
    first = {f"k{n}": {"r": grown(rng), "s": n, "o": {"a": 1}} for n in range(60)}
    second = {k: changed(rng, v) if rng.random() < 0.5 else {**v, "s": "two"} for k, v in first.items()}
    second = {k: v for k, v in second.items() if v is not None}
    third = {k: changed(rng, v) if rng.random() < 0.3 else v for k, v in second.items() if rng.random() < 0.95}
    third = {k: {**v, "s": "three"} if isinstance(v, dict) and "s" in v else v for k, v in third.items() if v is not None}
    from pyspark.sql import functions as F

    steps = patch.diff(docs(spark, first), docs(spark, second)).withColumn("version", F.lit(2)).unionByName(patch.diff(docs(spark, second), docs(spark, third)).withColumn("version", F.lit(3)))
    assert read(patch.rolled_back(docs(spark, third), steps, [2, 3])) == first
    assert read(patch.rolled_back(docs(spark, third), steps, [3])) == second


def test_nothing_and_nulls(spark):
    assert patch.diff(docs(spark, {}), docs(spark, {})).count() == 0
    assert patch.flattened(docs(spark, {"a": None})).count() == 0
