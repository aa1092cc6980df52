"""The pipeline's stages on a small corpus with planted cases, each against its plain definition."""

import random

import pytest

from pyspark.sql import functions as F

import corpus_pipeline as P
from citeloom.llm import ppm_language
from citeloom.llm.common import written

from .conftest import DOCS

EN = "the cat and dog are in that house with some other things of this old town near here now then we went away".split()
FR = "le chat et chien sont dans cette maison avec des autres choses de la vieille ville ici puis nous sommes partis loin".split()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    prose = lambda words, n: " ".join(rng.choice(words) + rng.choice(["", "s", "ly"]) for _ in range(n))
    out = [(k, prose(EN if k % 2 else FR, 150), "en" if k % 2 else "fr", f"s{k % 3}", 1) for k in range(120)]
    exact = [(200 + k, out[k][1].replace(" ", "  "), out[k][2], "s0", 1) for k in range(5)]
    near = []
    for k in range(10, 16):
        w = out[k][1].split()
        w[70] = "changed"
        near.append((300 + k, " ".join(w), out[k][2], "s1", 1))
    odd = [(400, None, None, None, None), (401, "1234 !!", None, "s0", 1), (402, "", "en", "s0", 1)]
    repeated = [(119, out[119][1], "en", "s2", 1)]
    return out + exact + near + odd + repeated


def test_stages(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows, DOCS)
    columns, ids = docs.columns, {}
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, "").write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        ids[name] = sorted(r.doc_id for r in docs.select("doc_id").collect())
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
    assert ids["language_id"] == sorted([*range(120), 119, *range(200, 205), *range(310, 316)])
    assert ids["exact_dedup"] == sorted([*range(5, 120), *range(200, 205), *range(310, 316)])  # the longer text stays
    assert ids["simhash_near_dedup"] == sorted([*range(5, 120), *range(200, 205)])
    assert set(ids["mixing"]) <= set(ids["simhash_near_dedup"])
    assert ids["sentencepiece"] == ids["mixing"]
    run = P.run
    (tmp_path / "sf").mkdir()
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    assert sorted(r.doc_id for r in run(spark, str(tmp_path / "sf")).select("doc_id").collect()) == ids["sentencepiece"]


def test_stages_of_nothing(spark):
    for _, stage in P.STAGES:
        assert stage(spark, spark.createDataFrame([], DOCS), "").count() == 0


def test_rows_without_an_id_or_with_a_repeated_one(spark):
    cat, dog, fr = "the cat and the dog went away then to that house", "some other things of this old town are near here now", "le chat et le chien sont dans cette maison avec des autres"
    rows = [(None, cat), (None, cat), (1, fr), (2, dog), (2, "1234 !!"), (2, dog), (None, "99 !!"), (3, cat + "  "), (None, dog)]
    docs = spark.createDataFrame([(i, t, "fr" if t == fr else "en", "s", None) for i, t in rows], DOCS)
    kept = []
    for _, stage in P.STAGES[:3]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), DOCS)
        kept.append(sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr))
    assert kept[0] == sorted([(None, cat), (None, cat), (1, fr), (2, dog), (2, dog), (3, cat + "  "), (None, dog)], key=repr)
    assert [len(k) for k in kept[1:]] == [3, 3] and {i for i, _ in kept[1]} <= {1, 2, 3, None} and {t.strip() for _, t in kept[1]} == {cat, dog, fr}
    assert (3, cat + "  ") in kept[1]


def test_learned_languages_only(spark, rows):
    assert ppm_language.fit(spark.createDataFrame(rows, DOCS)).langs == ["en", "fr"]


CLASH = ["_row", "_doc", "_several", "_turn", "a.b", "id", "stays", "node", "document", "bits_per_byte"]


def test_stages_with_clashing_columns_and_a_very_long_text(spark, rows):
    import string

    rng = random.Random(4)
    made = ["".join(rng.choices(string.ascii_lowercase, k=7)) for _ in range(50_000)]
    long = " ".join(f"{rng.choice(EN)} {w}" for w in made for _ in range(16))  # some 10 MB
    docs = spark.createDataFrame([*rows, (500, long, "en", "s0", None)], DOCS).select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASH)])
    for name, stage in P.STAGES:
        out = stage(spark, docs, "")
        if name != P.STAGES[-1][0]:
            assert out.columns == docs.columns
            docs = written(out)
            assert docs.select("`a.b`").distinct().count() == 1 and docs.filter(f"length(text) = {len(long)}").count() >= 1
        else:
            assert out.count() == docs.count()


def test_stages_of_nothing_with_clashing_columns(spark):
    empty = spark.createDataFrame([], DOCS).select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASH)])
    for _, stage in P.STAGES:
        assert stage(spark, empty, "").count() == 0
