import hashlib
import random
import re

from citeloom.llm.content_sort import exact_dedup

from .conftest import DOCS


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(norm(text), []).append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = []
    for n, members in groups.items():
        best = min(members)[3]
        sha = hashlib.sha256(n.encode()).hexdigest()
        out += [(m[3], best, len(members), sha) for m in members]
    return sorted(out, key=repr)


def run(df):
    rows = exact_dedup(df).collect()
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows), key=repr), rows


def test_equals_brute_force(spark, table):
    rng = random.Random(5)
    texts = ["", None, " \t", "a b", "ab", "a\nb ", "é" * 3, "long " * 9000, "x"] + ["hot text"] * 6
    rows = [(k, rng.choice(texts)) for k in range(300)] + [(None, "ab"), (None, "alone"), (7, "ab"), (7, "ab")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got, full = run(table([(i, t, None, None, None) for i, t in rows], DOCS).repartition(7))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute(rows)
    kept = {}
    for r in full:
        kept.setdefault(r.text_sha256, []).append(r)
    assert all(sum(r.kept for r in g) == 1 for g in kept.values())
    assert all(r.doc_id == r.keep_id for r in full if r.kept)


def test_a_group_over_many_partitions(spark, table):
    rows = [(k, "same  text" if k % 3 else f"t{k}") for k in range(500)]
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got, _ = run(table([(i, t, None, None, None) for i, t in rows], DOCS))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute(rows)


def test_empty_table(table):
    assert run(table([], DOCS))[0] == []
