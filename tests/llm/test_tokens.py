import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from citeloom.llm import piece_viterbi as V
from citeloom.llm import token_stream as T

from .conftest import DOCS

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS, MODEL = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", None, "  ", "Hello, World.", "it's DON'T x's 's.", "naïve STRASSE Straße ÉTÉ é́", "a<|endoftext|>b <|ENDOFTEXT|>", "5.7 12,000. x9.", "...", "日本語 text", "\U0001f600 ok", "y " * 9000, "z" * 3000, "a b c", "Dots.. end. Mid.dle, İstanbul ǅ"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


def test_parts_give_the_library_ids(library):
    ids, n = T.Encoder(WORDS).encode(pa.array(TEXTS), 2)
    expected = [library.encode(t or "", add_special_tokens=False).ids + [2] for t in TEXTS]
    assert n.tolist() == [len(x) for x in expected]
    assert ids.tolist() == [i for x in expected for i in x]


def test_parts_of_one_hash_are_told_apart(library, monkeypatch):
    monkeypatch.setattr(T.B, "quick", lambda spans, start, length: length.astype(np.uint64) % np.uint64(3))
    coder = T.Encoder(WORDS)
    for texts in (["ab", "ab ab"], ["cd ab", "x"], TEXTS):
        ids, n = coder.encode(pa.array(texts), 2)
        expected = [library.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
        assert n.tolist() == [len(x) for x in expected] and ids.tolist() == [i for x in expected for i in x]


def test_files_hold_all_ids_in_order(spark, table, library):
    rows = [(len(TEXTS) - k, t, None, None, None) for k, t in enumerate(TEXTS)] + [(None, "null id", None, None, None), (3, "again", None, None, None)]
    entries = T.write_sequences(table(rows, DOCS), WORDS, 2, length=16)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in T.read_digests(entries).collect())
    at = 0
    for (start, doc_id, n, crc), (i, t) in zip(got, sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        assert (start, doc_id, n, crc) == (at, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += n
    assert sorted(got) == sorted(tuple(r) for r in T.read_digests(entries.withColumns({c: entries.at * 0 for c in ("at", "n_tokens", "start")})).select("start", "doc_id", "n_tokens", "ids_crc32").collect())
    for e in entries.collect():  # random access by the table of entries
        assert (e.start, e.doc_id, e.n_tokens, zlib.crc32(T.Sequences(e.path).ids(e.at, e.n_tokens).astype("<u4").tobytes())) in got
    path = entries.first().path
    file = T.Sequences(path).file
    assert file.schema.field("tokens").type.list_size == 16 and file.schema.field("mask").type.value_type == pa.bool_()
    masked = sum(sum(x) for k in range(file.num_record_batches) for x in file.get_batch(k).column("mask").to_pylist())
    assert masked == sum(r.n_tokens for r in entries.filter(entries.path == path).collect())


def test_documents_over_many_batches(tmp_path):
    rng, path = np.random.default_rng(5), str(tmp_path / "x.arrow")
    texts = [np.r_[rng.integers(3, 99, n), 2].astype(np.uint16) for n in (0, 7000, 0, 1, 12000, 4095, 4096, 3)]
    packer = T._Packer(path, np.dtype(np.uint16), 16, 2)
    for lo, hi in ((0, 3), (3, 5), (5, 8)):
        packer.add(np.concatenate(texts[lo:hi]), pa.array([f"d{k}" for k in range(lo, hi)]), np.array([len(x) for x in texts[lo:hi]]))
    packer.close()
    at, got = 0, [row for doc_id, first, n, sums in T.documents_of(path) for row in zip(doc_id.to_pylist(), first.tolist(), n.tolist(), sums, strict=True)]
    for k, (row, ids) in enumerate(zip(got, texts, strict=True)):
        assert row == (f"d{k}", at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
        at += len(ids)


def test_a_file_that_disagrees_with_itself_is_an_error(tmp_path):
    def file(ids, ends):
        path = str(tmp_path / f"{len(list(tmp_path.iterdir()))}.arrow")
        packer = T._Packer(path, np.dtype(np.uint16), 4, 2)
        packer.add(np.array(ids, np.uint16), pa.array(range(len(ends))), np.diff(ends, prepend=0))
        packer.close()
        return list(T.documents_of(path))

    assert [n.tolist() for _, _, n, _ in file([5, 2, 6, 7, 2], [2, 5])] == [[2, 3]]
    for ids, ends in (([5, 2, 6, 7, 2], [1, 5]), ([5, 2, 6, 7, 2], [2]), ([5, 2], [2, 2])):
        with pytest.raises(ValueError):
            file(ids, ends)


def test_other_tokenizers_get_whole_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    ids, n = T.Encoder(path).encode(pa.array(["two  words", None]), 9)
    assert ids.tolist() == Tokenizer.from_file(path).encode("two  words", add_special_tokens=False).ids + [9, 9] and n.tolist()[1] == 1


def test_no_documents(table):
    assert T.read_digests(T.write_sequences(table([], DOCS), WORDS, 2)).count() == 0


@pytest.fixture(scope="module")
def pieces():
    return V.Pieces(MODEL)


@pytest.fixture(scope="module")
def unigram(pieces):
    """The same pieces and scores, to be maximised."""
    found = V.Pieces(MODEL)
    assert found.merges
    found.merges = False
    return found


def test_a_model_of_merges_gives_the_library_ids(pieces):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [t or "" for t in TEXTS] + [" lead", "a  b\n\n c\t", "=====  ----", "    def f(x):\n        return x**2", "aaaa" * 90, "Ununbelievablyness"]
    ids, n = pieces.encode(texts)
    bound = np.r_[0, np.cumsum(n)]
    for k, t in enumerate(texts):
        assert ids[bound[k] : bound[k + 1]].tolist() == library.encode(t)


def field(number, value):
    """One field of a protocol buffer."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def model_file(path, pieces, trainer=field(3, 1), normalizer=field(3, 1) + field(4, 0)):
    """A model written by hand: (piece, score, type) and the settings' bytes."""
    path.write_bytes(b"".join(field(1, field(1, p.encode()) + field(2, float(s)) + field(3, kind)) for p, s, kind in pieces) + field(2, trainer) + field(3, field(1, b"identity") + normalizer))
    return str(path)


@pytest.mark.parametrize("bytes_too", [True, False])
def test_a_unigram_model_gives_the_library_ids(pieces, tmp_path, bytes_too):
    import sentencepiece

    rng = random.Random(3)
    taken = [p for p in pieces.text if rng.random() < 0.4 or len(p) == 1 and p.isascii()]
    made = [("<unk>", 0.0, 2), *[(f"<0x{k:02X}>", -30.0, 6) for k in range(256 * bytes_too)], *[(p, -rng.uniform(3, 14), 1) for p in taken]]
    path = model_file(tmp_path / "u.model", made, field(3, 1) + field(35, int(bytes_too)))
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), V.Pieces(path)
    assert not own.merges
    words = "the internationalisation of straightforward tokens, été naïve 日本 Übergröße unbelievable re-reading 😀😁 x".split(" ")
    texts = [t or "" for t in TEXTS if len(t or "") < 4000] + [" ".join(rng.choice(words) for _ in range(60)) for _ in range(40)]
    ids, n = own.encode(texts)
    bound = np.r_[0, np.cumsum(n)]
    for k, t in enumerate(texts):
        assert ids[bound[k] : bound[k + 1]].tolist() == library.encode(t), t


def test_models_that_are_not_supported(tmp_path):
    base = [("<unk>", 0.0, 2), ("▁", -1.0, 1), ("a", -2.0, 1)]
    for k, (more, settings) in enumerate([([("b" * 129, -3.0, 1)], {}), ([("own", -3.0, 4)], {}), ([("un", -3.0, 5)], {}), ([], {"normalizer": field(3, 1)}), ([], {"normalizer": field(3, 0) + field(4, 0)}), ([], {"trainer": field(3, 4)}), ([], {"trainer": field(3, 1) + field(24, 1)}), ([("a▁", -3.0, 1)], {})]):
        with pytest.raises(ValueError, match="piece|model"):
            V.Pieces(model_file(tmp_path / f"{k}.model", base + more, **settings))


def test_words_and_pieces_of_one_hash_are_told_apart(pieces, monkeypatch):
    texts = [t or "" for t in TEXTS if len(t or "") < 4000] + ["some other words here and there"] * 2
    expected = pieces.encode(texts)[0].tolist()
    own = V.Pieces(MODEL)
    monkeypatch.setattr(V, "_word_keys", lambda codes, starts, sizes: sizes.astype(np.uint64))
    assert own.encode(texts)[0].tolist() == expected and own.encode(texts[::-1])[1].sum() == len(expected)
    wrong = own.piece_codes.copy()
    wrong[own.ids == own.text["▁the"][1]] = 1  # as if another piece had this hash
    own.piece_codes, plain = wrong, []
    own.one = lambda word: plain.append(word) or pieces.one(word)
    words = np.array([[ord(c) for c in w] for w in ("▁the", "▁and")])
    assert own.together(words)[0].tolist() == pieces.together(words)[0].tolist() and plain == ["▁the", "▁and"]


def test_together_equals_one_by_one(pieces, unigram):
    texts = [t or "" for t in TEXTS] + [" lead", "a  b\n\n c\t", "▁mark"]
    for model in (pieces, unigram):
        ids, n = model.encode(texts)
        bound = np.r_[0, np.cumsum(n)]
        for k, t in enumerate(texts):
            assert ids[bound[k] : bound[k + 1]].tolist() == (model.one("▁" + t.replace(" ", "▁")) if t else [])


def test_a_unigram_model_gets_the_best_segmentation(unigram):
    def best(word):
        if not word:
            return 0.0
        return max(unigram.text[word[:k]][0] + best(word[k:]) for k in range(1, len(word) + 1) if word[:k] in unigram.text)

    back = {i: s for s, i in unigram.text.values()}
    for word in ("▁hello", "▁token", "▁straße", "▁zz"):
        assert sum(back[i] for i in unigram.one(word)) == pytest.approx(best(word))


def test_forgetting_changes_nothing(pieces, monkeypatch):
    expected = pieces.encode(["some words here", "other words there"])[0].tolist()
    monkeypatch.setattr(V, "REMEMBERED", 2)
    assert pieces.encode(["some words here", "other words there"])[0].tolist() == expected


def test_round_trip(table):
    rows = [(k, t, None, None, None) for k, t in enumerate(TEXTS)] + [(None, "null id", None, None, None)]
    df = table(rows, DOCS)
    both = {r.doc_id: r for r in V.encode(df, MODEL, decoded=True).collect()}
    assert all(both[i].text == (t or "") for i, t, *_ in rows)
    assert {r.doc_id: r.text for r in V.decode(V.encode(df, MODEL), MODEL).collect()} == {i: t or "" for i, t, *_ in rows}
    assert V.encode(table([], DOCS), MODEL).count() == 0


def test_a_known_part_is_looked_up_once():
    """Each distinct part of a batch costs one look into what a worker remembers, and bytes are spelt as the tokenizer spells them."""
    import public_tokenizers
    import pyarrow as pa

    from citeloom.llm import token_stream

    class Counting(dict):
        looks = 0

        def get(self, *a):
            Counting.looks += 1
            return super().get(*a)

        def __getitem__(self, k):
            Counting.looks += 1
            return super().__getitem__(k)

        def __contains__(self, k):
            Counting.looks += 1
            return super().__contains__(k)

    coder = token_stream.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = pa.array(["größe und façade, the the end.", "ÿ the Émile"])
    ids, n = coder.encode(texts, 2)
    coder.known = Counting(coder.known)
    again, m = coder.encode(texts, 2)
    assert ids.tolist() == again.tolist() and n.tolist() == m.tolist()
    whole = [[*coder.tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts.to_pylist()]
    assert ids.tolist() == [i for w in whole for i in w] and n.tolist() == list(map(len, whole))
    assert Counting.looks == len(coder.known)
