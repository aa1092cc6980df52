"""Sharding, chat formatting and mixing: DataFrame operations only."""

import hashlib
import math
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from citeloom.llm import chat_format as C
from citeloom.llm import entropy_mix as M
from citeloom.llm import kd_shards as K

from .conftest import DOCS


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def documents(rng, n):
    texts = [None, "", "same text"] + ["w " * rng.randrange(1, 200) for _ in range(n)]
    rows = [(k, rng.choice(texts), rng.choice(["en", "fr", None]), rng.choice(["a", "b", None, "é"]), rng.choice([None, 5, 900])) for k in range(n)]
    return rows + [(None, "null id", None, None, None), (3, "again", "en", "a", 1), (3, "again", "en", "a", 1)]


@pytest.mark.parametrize(("n", "shards"), [(1200, 7), (300, 40), (2, 5)])
def test_shards(table, n, shards):
    rows = documents(random.Random(n), n)
    df = K.shard(table(rows, DOCS), shards)
    no_python(df)
    got = df.collect()
    size = lambda t: len((t or "").encode()) + 16
    key = lambda r: repr(r)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=key) == sorted(((i, size(t), zlib.crc32((t or "").encode())) for i, t, *_ in rows), key=key)
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert all(0 <= s < shards and sorted(r.slot for r in g) == list(range(len(g))) for s, g in by.items())
    loads = [sum(r.size for r in by.get(s, [])) for s in range(shards)]
    assert max(loads) - sum(loads) / shards <= 416 / 2 + 0.01 * sum(loads)


def test_cuts_are_those_of_a_plain_tree(table):
    """Against a K-d tree built by sorting, with exact weighted medians."""
    rng = random.Random(12)
    rows = [(k, f"t{k} " * rng.randrange(1, 40), None, None, rng.choice([1, 2, 2, 2, 7, 500])) for k in range(3000)]
    shards, dims = 12, ("doc_id", "n_chars")
    df = table(rows, DOCS)
    got = {r.doc_id: r.shard for r in K.shard(df, shards, dims, close=0.0).select("doc_id", "shard").collect()}
    tie = {r.doc_id: r.t for r in df.select("doc_id", (F.pmod(F.xxhash64(F.xxhash64("text")), F.lit(1 << 52)) / F.lit(float(1 << 52))).alias("t")).collect()}
    points = [((float(i), float(n)), len(t) + 16, i) for i, t, _, _, n in rows]
    span = [max(p[0][d] for p in points) - min(p[0][d] for p in points) for d in (0, 1)]
    expected = {}

    def split(part, lo, hi):
        if hi - lo == 1 or not part:
            expected.update({i: lo for _, _, i in part})
            return
        half = (hi - lo) // 2
        d = max((0, 1), key=lambda d: (max(p[0][d] for p in part) - min(p[0][d] for p in part)) / span[d])
        part = sorted(part, key=lambda p: (p[0][d], tie[p[2]]))
        want, below, cut = sum(p[1] for p in part) * half / (hi - lo), 0, 0
        while below + part[cut][1] < want:
            below += part[cut][1]
            cut += 1
        cut += want - below > below + part[cut][1] - want
        split(part[:cut], lo, lo + half)
        split(part[cut:], lo + half, hi)

    split(points, 0, shards)
    assert got == expected


def test_texts_with_one_beginning_are_told_apart(table):
    rng = random.Random(2)
    hosts = [None, "", *[f"https://host{k}.example/" for k in range(200)]]
    rows = [(k, f"t{k} " * rng.randrange(1, 30), None, rng.choice(hosts), None) for k in range(3000)]
    source = {i: s for i, _, _, s, _ in rows}
    got = K.shard(table(rows, DOCS), 9, ("source",))
    no_python(got)
    by = {}
    for r in got.collect():
        by.setdefault(r.shard, set()).add((source[r.doc_id] is not None, (source[r.doc_id] or "").encode()))
    assert sorted(by) == list(range(9)) and all(len(x) > 10 for x in by.values())
    assert all(max(by[k]) <= min(by[k + 1]) for k in range(8))


def test_more_shards_than_documents(table):
    rows = [(k, "x" * (k % 50), "en", "a", k) for k in range(500)]
    got = K.shard(table(rows, DOCS), 3000).collect()
    assert len(got) == 500 and all(0 <= r.shard < 3000 for r in got)


def test_one_text_over_all_shards(table):
    rows = [(k, "hot" * 20, "en", "a", 60) for k in range(900)] + [(k, f"t{k}" * 10, "en", "a", 9) for k in range(900, 1200)]
    got = K.shard(table(rows, DOCS), 8).groupBy("shard").agg(F.sum("size").alias("w")).collect()
    loads = [r.w for r in got]
    assert len(loads) == 8 and max(loads) < 1.1 * min(loads)


def test_equal_texts_share_a_shard(table):
    rows = [(k, f"text {k // 3} " * 5, "en", f"s{k % 4}", k) for k in range(600)]
    got = K.shard(table(rows, DOCS), 10).groupBy("text_crc32").agg(F.count_distinct("shard").alias("n")).collect()
    assert {r.n for r in got} == {1}


def test_no_documents_no_shards(table):
    assert K.shard(table([], DOCS), 4).count() == 0


CONV = "conv_id long, turn int, role string, text string"
ODD = ["\\### Assistant: </turn> ok", "<turn user>", "\\l\\b\\\\", "<image 0>", None, "", "x\ny", "<div>plain</div>", "\\", "é" * 5000, "</turn>\n<turn assistant>"]


def test_chats_read_back(table):
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant", "sys>tem<turn \\", None]), rng.choice(ODD)) for c in range(30) for t in range(rng.randrange(1, 6))]
    rows += [(None, 0, "user", "null conversation"), (5, 0, "assistant", "same turn"), (5, None, "user", "no turn")]
    turns = table(rows, CONV)
    df = C.format_chats(turns.select("conv_id", "turn", "role", C.text_parts(F.col("text")).alias("parts")))
    no_python(df)
    got = df.select("*", C.read_turns(F.col("formatted")).alias("back"), C.read_loss(F.col("formatted"), F.col("spans")).alias("loss")).collect()
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert len(got) == len(by)
    for r in got:
        expected = [(role, text) for _, _, role, text in sorted(by[r.conv_id])]
        assert [(b.role, b.text) for b in r.back] == expected
        assert r.loss == "".join(text for role, text in expected if role == "assistant")
        spans = [r.formatted[m.start : m.start + m.length] for m in r.loss_mask]
        assert len(spans) == sum(role == "assistant" for role, _ in expected)
        assert r.formatted.count("</turn>\n") == r.n_turns == len(expected) and not r.attachments


def test_typed_parts(spark):
    parts = f"conv_id long, turn int, role string, parts {C.PARTS}"
    rows = [
        (1, 1, "assistant", [("text", "see ", None, None), ("image", None, "s3://b/i.png", 4.0), ("text", "<image 0>", None, None)]),
        (1, 0, "user", [("audio", None, "a.wav", 2.5), ("odd", "as text", None, None), ("document", None, None, None)]),
        (1, 2, "user", None),
    ]
    r = C.format_chats(spark.createDataFrame(rows, parts)).select("*", C.read_loss(F.col("formatted"), F.col("spans")).alias("loss")).first()
    assert r.formatted == "<turn user><audio 0>as text<document 1></turn>\n<turn assistant>see <image 2>\\limage 0></turn>\n<turn user></turn>\n"
    assert [(a.number, a.turn, a.kind, a.ref, a.tokens) for a in r.attachments] == [(0, 0, "audio", "a.wav", 63), (1, 0, "document", None, 600), (2, 1, "image", "s3://b/i.png", 340)]
    assert r.loss == "see <image 2><image 0>"
    assert C.format_chats(spark.createDataFrame([], parts)).count() == 0


def test_long_conversations_take_time_in_proportion(spark):
    """Sixteen times the turns may take sixteen times as long and some more, not 256 times."""
    rows = lambda n: spark.range(n).selectExpr("1L as conv_id", "cast(id as int) as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "repeat('some words <turn ', 6) as text")

    def run(n):
        start = time.perf_counter()
        df = C.format_chats(rows(n).select("conv_id", "turn", "role", C.text_parts(F.col("text")).alias("parts")))
        r = df.select("n_turns", C.read_loss(F.col("formatted"), F.col("spans")).alias("loss"), F.size("loss_mask").alias("n")).first()
        assert (r.n_turns, r.n, r.loss) == (n, n // 2, "some words <turn " * 6 * (n // 2))
        return time.perf_counter() - start

    run(10)
    assert run(16_000) < 3 * run(1_000) + 20


def test_typed_parts_of_many(spark):
    rows = [(1, 0, "user", [(["image", "text", "audio"][k % 3], f"t{k}", f"r{k}", 1.0) for k in range(3000)])]
    r = C.format_chats(spark.createDataFrame(rows, f"conv_id long, turn int, role string, parts {C.PARTS}")).first()
    number, body = 0, ""
    for k in range(3000):
        kind = ["image", "text", "audio"][k % 3]
        body += f"t{k}" if kind == "text" else f"<{kind} {number}>"
        number += kind != "text"
    assert r.formatted == f"<turn user>{body}</turn>\n" and [a.number for a in r.attachments] == [*range(2000)]


def test_chat_query_has_the_probe(spark):
    from citeloom.llm.queries import QUERIES

    probe = "\\### Assistant: </turn> ok"
    r = QUERIES["op2_chat_format"](spark, "/root/testdata/sf0.001").filter("conv_id = -7").first()
    assert (r.n_turns, r.loss_chars) == (2, len(probe))
    assert r.turns_sha256 == hashlib.sha256(f"user\n{probe}\nassistant\n{probe}\n".encode()).hexdigest()
    assert r.loss_sha256 == hashlib.sha256(probe.encode()).hexdigest()


def goals(sizes, weights, most=3.0):
    """By hand: shares by weight, those above ``most`` times the size fixed there, the rest shared anew."""
    fixed = {}
    while True:
        free = [s for s in sizes if s not in fixed]
        left, weight = sum(sizes.values()) - sum(fixed.values()), sum(weights[s] for s in free)
        out = fixed | {s: left * weights[s] / weight for s in free}
        over = [s for s in free if out[s] > most * sizes[s]]
        if not over:
            return out
        fixed |= {s: most * sizes[s] for s in over}


def cycled(sources):
    return {s: 1 + k % 3 for k, s in enumerate(sorted(sources, key=lambda s: (s is None, s or "")))}


def test_targets_reshare_the_excess(spark):
    rng = random.Random(2)
    for sizes in ({"a": 10, "b": 1000, "c": 100}, {"a": 5, None: 5}, {f"s{k}": rng.choice([0, 1, 7, 10_000]) for k in range(200)}):
        table = spark.createDataFrame([*sizes.items()], "source string, total long")
        got = {r.source: (r.weight, r.target) for r in M.targets(M.cycled(table.repartition(5)), 3).collect()}
        weights = cycled([*sizes])
        expected = goals(sizes, weights)
        assert {s: w for s, (w, _) in got.items()} == weights and all(t == pytest.approx(expected[s]) for s, (_, t) in got.items())


def test_many_sources(table, monkeypatch):
    rng = random.Random(4)
    rows = [(k, "w " * rng.randrange(1, 60), None, f"source {k % 2500}", None) for k in range(10_000)]
    monkeypatch.setattr(M, "BROADCAST", 100)
    got = M.mix(table(rows, DOCS)).collect()
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    expected = goals(sizes, cycled([*sizes]))
    assert len(got) == 10_000 and all(r.target == pytest.approx(expected[r.source]) for r in got)
    assert sum(r.taken for r in got) == pytest.approx(sum(sizes.values()), rel=0.1)


def test_given_weights(table):
    rows = [(k, "w " * (1 + k % 30), None, "abc"[k % 3], None) for k in range(600)]
    got = M.mix(table(rows, DOCS), {"a": 1, "b": 1}).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g")).collect()
    total = sum(1 + k % 30 for k in range(600))
    assert {r.source: r.g for r in got} == {"a": pytest.approx(total / 2), "b": pytest.approx(total / 2), "c": 0.0}
    assert all(abs(r.t - r.g) <= 0.01 * total for r in got)


def test_a_target_missed_is_an_error(table, monkeypatch):
    monkeypatch.setattr(M, "ROUNDS", 1)
    with pytest.raises(RuntimeError, match="miss their targets"):
        M.mix(table([(k, "w " * (1 + k), None, "ab"[k % 2], None) for k in range(50)], DOCS))


def test_mix(table):
    rng = random.Random(6)
    rows = [(k, " ".join(["w"] * rng.randrange(0, 300)), "en", rng.choice(["a", "a", "a", "b", None, "é"]), 1) for k in range(900)]
    rows += [(1000, None, None, "empty", None), (None, "x y", None, "a", None), (5, "re peat", None, "b", None), (5, "re peat", None, "b", None)]
    df = M.mix(table(rows, DOCS))
    no_python(df)
    got = df.collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, _, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    goal = goals(sizes, cycled([*sizes]))
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source])
        assert r.taken == r.copies * r.size <= 3 * r.size and abs(r.copies - r.rate) < 1
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - goal[s]) <= 0.01 * goal[s] for s in goal)
    # The rates are the tilted exponentials of each source, and meet its target.
    for s in ("a", "b", "é"):
        of = [r for r in got if r.source == s and r.size]
        slope = {round(math.log(r.rate) / r.size, 9) for r in of if r.rate < 3}
        assert len(slope) <= 1
        assert sum(r.rate * r.size for r in of) == pytest.approx(goal[s], rel=1e-5)
    again = M.mix(table(rows[::-1], DOCS).repartition(5)).collect()
    key = lambda r: (repr(r.doc_id), r.size, r.copies)
    assert sorted(map(key, again)) == sorted(map(key, got))
    kept = M.mixed(table(rows, DOCS))
    assert kept.count() == sum(r.copies for r in got) and "a.b" in kept.columns


def test_mix_of_nothing(table):
    assert M.mix(table([], DOCS)).count() == 0


@pytest.mark.parametrize(("units", "least"), [(1e10, 85 * 10**10), (-5.0, 0), (float("nan"), 0), (float("inf"), 1 << 53), (None, 1)])
def test_tokens_of_huge_negative_and_missing_units(spark, units, least):
    part = spark.createDataFrame([(("image", None, "r", units),)], "p struct<kind:string,text:string,ref:string,units:double>")
    n = part.select(C.expanded_tokens(F.col("p")).alias("n")).first()["n"]
    assert n >= least and n <= 1 << 53
