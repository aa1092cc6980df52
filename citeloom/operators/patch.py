"""Structural patches of nested documents.

A document is JSON, read as VARIANT and flattened to a row for each JSON pointer:
scalars with their values, containers with their kind.  Two versions joined by
pointer give operations add, remove and replace on the highest pointer that
differs, so a list or object that comes or goes is one operation, with its whole
value.  Each operation holds what was there before, so a patch has an inverse,
and patches of consecutive versions compose by pointer: the first one's ``before``
and the last one's ``after``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _step(path: Column, name: Column) -> Column:
    """A pointer with one more step, by the rules of JSON pointers."""
    return F.concat(path, F.lit("/"), F.replace(F.replace(name, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))


def flattened(docs: DataFrame, deepest: int = 32) -> DataFrame:
    """key, path, kind, value, for (key, value) with JSON texts: each container and scalar by its pointer.

    kind is object, array or scalar; value is the JSON text, for containers of
    all that they hold.  Levels are exploded one after another, until no
    container is left; documents nested deeper than ``deepest`` are an error.
    A text that isn't JSON is one too; null texts have no rows.
    """
    from citeloom.sources.store import cut

    level = docs.filter("value is not null").select(F.col("key").cast("string").alias("key"), F.lit("").alias("path"), F.parse_json("value").alias("v"))
    done = None
    for _ in range(deepest + 1):
        value = F.to_json("v")
        kind = F.when(F.startswith(value, F.lit("{")), "object").when(F.startswith(value, F.lit("[")), "array").otherwise("scalar")
        shown = cut(level.select("key", "path", kind.alias("kind"), value.alias("value")))
        done = shown if done is None else done.unionByName(shown)
        inner = shown.filter("kind <> 'scalar' and value not in ('{}', '[]')")
        if inner.isEmpty():
            return done
        objects = inner.filter("kind = 'object'").select("key", "path", F.explode(F.from_json("value", "map<string,variant>")).alias("name", "v"))
        arrays = inner.filter("kind = 'array'").select("key", "path", F.posexplode(F.from_json("value", "array<variant>")).alias("name", "v"))
        level = objects.select("key", _step(F.col("path"), F.col("name")).alias("path"), "v").unionByName(arrays.select("key", _step(F.col("path"), F.col("name").cast("string")).alias("path"), "v"))
    raise ValueError(f"documents nested more than {deepest} deep")


def _parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """key, path, operation, before, after: what makes the old documents (key, value) the new ones.

    An operation stands at the highest pointer where the kinds, or two scalars,
    differ; below it there is none.  Whole documents that come or go have the
    empty path.  Elements of lists are told apart by their places.
    """
    a = flattened(old).select("key", "path", F.col("kind").alias("kind_a"), F.col("value").alias("before"))
    b = flattened(new).select("key", "path", F.col("kind").alias("kind_b"), F.col("value").alias("after"))
    both = a.join(b, ["key", "path"], "full_outer")
    same = F.col("kind_a").eqNullSafe(F.col("kind_b")) & ((F.col("kind_a") != "scalar") | (F.col("before") == F.col("after")))
    # What comes or goes below another such place, or below one whose kind changes, is part of that operation.
    differs = both.filter(~same)
    tops = differs.select("key", F.col("path").alias("above")).distinct()
    steps = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))
    below = differs.filter("path <> ''").select("key", "path", F.explode(above).alias("above")).join(tops, ["key", "above"], "left_semi").select("key", "path").distinct()
    kind = F.when(F.col("before").isNull(), "add").when(F.col("after").isNull(), "remove").otherwise("replace")
    return differs.join(below, ["key", "path"], "left_anti").select("key", "path", kind.alias("operation"), "before", "after")


def inverse(patch: DataFrame) -> DataFrame:
    """The patch that takes the new documents back."""
    back = F.when(F.col("operation") == "add", "remove").when(F.col("operation") == "remove", "add").otherwise("replace")
    return patch.select("key", "path", back.alias("operation"), F.col("after").alias("before"), F.col("before").alias("after"))


def _at(doc, steps: list[str]):
    for s in steps:
        doc = doc[int(s) if isinstance(doc, list) else s]
    return doc


def _applied(value: str | None, operations: list) -> str | None:
    """One document after its operations: removals from the last place on, then replacements and additions from the first."""
    doc = None if value is None else json.loads(value)
    steps_of = lambda path: [s.replace("~1", "/").replace("~0", "~") for s in path.split("/")[1:]]
    place = lambda o: [(0, int(s), "") if s.isdigit() else (1, 0, s) for s in steps_of(o[0])]
    gone = sorted((o for o in operations if o[1] == "remove"), key=place, reverse=True)
    come = sorted((o for o in operations if o[1] != "remove"), key=place)
    for path, operation, after in [*gone, *come]:
        steps = steps_of(path)
        if not steps:
            if operation == "remove":
                return None
            doc = json.loads(after)
            continue
        of, last = _at(doc, steps[:-1]), steps[-1]
        if operation == "remove":
            del of[int(last) if isinstance(of, list) else last]
        elif isinstance(of, list) and operation == "add":
            of.insert(int(last), json.loads(after))
        else:
            of[int(last) if isinstance(of, list) else last] = json.loads(after)
    return json.dumps(doc, ensure_ascii=False, separators=(",", ":"))


def applied(docs: DataFrame, patch: DataFrame) -> DataFrame:
    """key, value of the documents (key, value) after the patch; documents that it doesn't touch stay as they are.

    Only touched documents move, each with its own operations.
    """
    of = patch.groupBy("key").agg(F.collect_list(F.struct("path", "operation", "after")).alias("operations"))
    keyed = docs.select(F.col("key").cast("string").alias("key"), "value")
    touched = keyed.join(of, "key", "full_outer").filter("operations is not null")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            values = [_applied(v, [(o["path"], o["operation"], o["after"]) for o in ops]) for v, ops in zip(part["value"], part["operations"], strict=True)]
            yield pd.DataFrame({"key": part["key"], "value": pd.Series(values, dtype=object)}).dropna(subset=["value"])

    changed = touched.mapInPandas(run, "key string, value string")
    return keyed.join(of.select("key"), "key", "left_anti").unionByName(changed)


def composed(patches: DataFrame) -> DataFrame:
    """One patch for consecutive ones (version, key, path, operation, before, after).

    Where an operation stands below another version's, the higher one must carry
    the lower change, so both versions' documents are needed: such keys are
    left to ``rolled_back``, which applies the inverses one after another; the
    others compose pointer by pointer.
    """
    by = Window.partitionBy("key", "path").orderBy("version")
    ends = patches.withColumns({"first": F.first("before").over(by), "last": F.last("after").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "_r": F.row_number().over(by)}).filter("_r = 1")
    kind = F.when(F.col("first").isNull(), "add").when(F.col("last").isNull(), "remove").otherwise("replace")
    return ends.filter(~F.col("first").eqNullSafe(F.col("last"))).select("key", "path", kind.alias("operation"), F.col("first").alias("before"), F.col("last").alias("after"))


def overlapping(patches: DataFrame) -> DataFrame:
    """key: documents of which versions changed places above or below each other, or a list's length."""
    listed = F.col("path").rlike("/[0-9]+$") & (F.col("operation") != "replace")
    steps = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))
    higher = patches.filter("path <> ''").select("key", "version", F.explode(above).alias("path")).distinct()
    met = higher.join(patches.select("key", F.col("version").alias("other"), "path"), ["key", "path"]).filter("version <> other")
    return met.select("key").unionByName(patches.filter(listed).select("key")).distinct()


def rolled_back(docs: DataFrame, patches: DataFrame, versions: list[int]) -> DataFrame:
    """The documents before the given versions, which are the newest and consecutive.

    Patches that don't overlap compose and are undone in one step; documents of
    which they do are taken back version by version.
    """
    from citeloom.sources.store import cut

    mine = cut(patches.filter(F.col("version").isin(versions)))
    apart = cut(overlapping(mine))
    now = applied(docs, inverse(composed(mine.join(apart, "key", "left_anti"))))
    for v in sorted(versions, reverse=True):
        now = cut(applied(now, inverse(mine.filter(F.col("version") == v).join(apart, "key", "left_semi"))))
    return now
