import math
import os
import random
import zlib

import pyarrow as pa
import pytest

from citeloom.llm import ppm_language as L

from .conftest import DOCS

SAMPLES = {"en": ["the cat sat on the mat", "a thing that is there"], "fr": ["le chat est sur le tapis", "été à la forêt"], "xx": ["qqq"]}


def code_length(text, lang):
    """The same code, symbol by symbol."""
    count = {name: {} for name in SAMPLES}
    for name, texts in SAMPLES.items():
        for t in map(str.encode, texts):
            for i in range(len(t)):
                for k in range(1, min(L.ORDER + 1, i + 1) + 1):
                    s = t[i - k + 1 : i + 1]
                    count[name][s] = count[name].get(s, 0) + 1
    child = {}
    for s, n in count[lang].items():
        child.setdefault(s[:-1], {})[s[-1]] = n
    bits, b = 0.0, text.encode()
    for i in range(len(b)):
        for k in range(min(L.ORDER, i), -1, -1):
            c = child.get(b[i - k : i])
            if c and b[i] in c:
                bits -= math.log2(c[b[i]] / (sum(c.values()) + len(c)))
                break
            if c:
                bits -= math.log2(len(c) / (sum(c.values()) + len(c)))
        else:
            bits += L.UNKNOWN_BITS
    return bits


def test_code_lengths(monkeypatch):
    texts = ["the mat", "le tapis à", "ZZ?", "", "qq\nq", "the cat sat"]
    model = L.train(SAMPLES)
    for chunk in (L.CHUNK, 5):
        monkeypatch.setattr(L, "CHUNK", chunk)
        bits, size = model.bits(pa.array(texts))
        assert size.tolist() == [len(t.encode()) for t in texts]
        for k, t in enumerate(texts):
            assert bits[k].tolist() == pytest.approx([code_length(t, lang) for lang in model.langs], abs=1e-3)


def test_cases(table):
    rows = [(1, "the cat", None, None, None), (2, None, None, None, None), (3, "123 !?", None, None, None), (4, "", None, None, None), (None, "le chat", None, None, None), (5, "the " * 40_000, None, None, None), (5, "le tapis", None, None, None)]
    got = sorted(((r.doc_id, r.lang_pred, r.score) for r in L.identify(table(rows, DOCS), L.train(SAMPLES)).collect()), key=repr)
    assert [(i, p) for i, p, _ in got] == [(1, "en"), (2, "und"), (3, "und"), (4, "und"), (5, "en"), (5, "fr"), (None, "fr")]
    assert all(0 <= s <= 1 for _, _, s in got)
    assert L.identify(table([], DOCS), L.train(SAMPLES)).count() == 0
    assert {r.lang_pred for r in L.identify(table(rows, DOCS), L.train({})).collect()} == {"und"}


def test_fit_without_labels(table):
    assert L.fit(table([(1, "text", None, None, None), (2, None, "en", None, None)], DOCS)).langs == []


def test_many_languages(table):
    rng = random.Random(7)
    made = {f"l{k:02d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäöüéèñ") for _ in range(rng.randrange(3, 8))) for _ in range(40)] for k in range(60)}
    text = lambda lang: " ".join(rng.choice(made[lang]) for _ in range(60))
    model = L.train({lang: [text(lang) for _ in range(5)] for lang in made})
    rows = [(k, text(lang), lang, None, None) for k, lang in enumerate([*made] * 3)]
    got = {r.doc_id: r.lang_pred for r in L.identify(table(rows, DOCS), model).collect()}
    assert [got[k] for k, *_ in rows] == [lang for _, _, lang, *_ in rows]


def test_capitals_change_nothing(table):
    rows = [(k, t.upper() if k % 2 else t, None, None, None) for k, t in enumerate(["the cat sat there"] * 2 + ["été sur la forêt"] * 2)]
    got = {r.doc_id: (r.lang_pred, r.score, r.bits_per_byte) for r in L.identify(table(rows, DOCS), L.train(SAMPLES)).collect()}
    assert got[0] == got[1] and got[2] == got[3] and (got[0][0], got[2][0]) == ("en", "fr")


def test_sample_of_whole_texts(table, monkeypatch):
    rows = [(k, f"text {k} " * 2000, "ab"[k % 2], None, None) for k in range(400)]
    got = L.sample(table(rows, DOCS), 50).collect()
    assert {r.text for r in got} <= {r[1] for r in rows} and 60 < len(got) < 150
    monkeypatch.setattr(L, "MAX_LANGS", 1)
    with pytest.raises(ValueError, match="languages"):
        L.fit(table(rows, DOCS))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from citeloom.llm.queries import QUERIES

    got = {r.doc_id: r for r in QUERIES["op5_language_id"](spark, "/root/testdata/sf0.01").collect()}
    held = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(got[r.doc_id].held_out for r in held) and len(got) == docs.count()
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) / len(held) > 0.97
