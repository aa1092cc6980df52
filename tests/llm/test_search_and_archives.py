import gzip
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.llm import anisotropic as A
from citeloom.llm import files, warc

VEC = "vec_id long, embedding array<float>, label int"


def brute(rows, queries, k):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in good:
        if q in queries:
            near = sorted((float(np.sqrt(np.cumsum((v - x) ** 2)[-1])), i) for i, v in good if i != q)[:k]
            out[q] = near
    return out


def vectors(rng, n, dims=16):
    f32 = lambda v: [float(np.float32(x)) for x in v]
    base = [f32(rng.gauss(0, 1) for _ in range(dims)) for _ in range(n)]
    rows = list(enumerate(base))
    rows += [(n + k, base[0]) for k in range(60)]  # copies
    rows += [(n + 100 + k, f32(x + rng.gauss(0, 0.001) for x in base[1])) for k in range(200)]  # a dense cluster
    rows += [(n + 400, None), (n + 401, [0.0] * dims), (n + 402, [None] * dims), (n + 403, [float("nan")] * dims), (n + 404, [float("inf")] + [1.0] * (dims - 1)), (None, base[2])]
    return rows


def test_neighbours(table):
    rng = random.Random(8)
    rows = vectors(rng, 400)
    df = table([(i, v, 0) for i, v in rows], VEC).repartition(3)
    got = A.search(df, F.col("vec_id") % 20 == 0, k=10, block_rows=200, block_queries=16).collect()
    expected = brute(rows, {i for i, _ in rows if i is not None and i % 20 == 0}, 10)
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    assert set(by) == set(expected)
    hits = 0
    for q, found in by.items():
        assert [r for r, _, _ in sorted(found)] == list(range(1, 11))
        near = [(s, i) for _, s, i in sorted(found)]
        assert near == sorted(near)
        hits += len(set(near) & set(expected[q]))
    assert hits >= 0.99 * sum(map(len, expected.values()))


def test_few_and_no_candidates(table):
    assert A.search(table([], VEC), F.col("vec_id") == 0).count() == 0
    assert A.search(table([(0, [1.0, 2.0], 0)], VEC), F.col("vec_id") == 0).count() == 0
    got = A.search(table([(0, [1.0, 0.0], 0), (1, [1.0, 1.0], 0), (2, [0.0, 0.0], 0)], VEC), F.col("vec_id") == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 1, 1.0)]


def test_vectors_of_each_length_are_searched_apart(table):
    rows = [(0, [1.0, 0.0], 0), (1, [1.0, 1.0], 0), (2, [1.0, 0.0, 3.0], 0), (3, [], 0), (4, [5.0], 0), (6, [1.0, 0.0, 5.0], 0)]
    got = A.search(table(rows, VEC), F.col("vec_id") % 2 == 0).collect()
    assert sorted((r.query_id, r.vec_id, r.score) for r in got) == [(0, 1, 1.0), (2, 6, 2.0), (6, 2, 2.0)]


def test_any_number_of_lengths(table):
    rng = random.Random(3)
    rows = [(k, [rng.choice([1.0, 2.0, 3.0]) for _ in range(1 + k % 70)], 0) for k in range(700)]
    rows += [(700 + k, [rng.gauss(0, 1), rng.gauss(0, 1)], 0) for k in range(400)]  # one length has a third
    plain = [(i, [float(np.float32(x)) for x in v]) for i, v, _ in rows]
    got = A.search(table(rows, VEC).repartition(5), F.col("vec_id") % 9 == 0, k=4, block_rows=50).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.score, r.vec_id))
    for q, v in plain:
        if q % 9 == 0:
            assert by.pop(q) == brute([r for r in plain if len(r[1]) == len(v)], {q}, 4)[q]
    assert not by


def test_repeated_rows_hide_no_neighbour(table):
    rows = [(0, [1.0, 0.0], 0)] * 12 + [(1, [1.0, 0.0], 0), (2, [5.0, 5.0], 0)]
    got = A.search(table(rows, VEC).repartition(4), F.col("vec_id") == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(got, key=lambda r: r.rank)] == [(0, 1, 1), (0, 2, 2)]


def test_one_id_with_several_vectors(table):
    rows = [(0, [1.0, 0.0], 0), (0, [9.0, 0.0], 0), (0, [9.0, 0.0], 0), (1, [2.0, 0.0], 0)]
    got = A.search(table(rows, VEC), F.col("vec_id") == 0).collect()
    by = {}
    for r in sorted(got, key=lambda r: r.rank):
        by.setdefault(r.mark, []).append((r.rank, r.vec_id, r.score))
    assert sorted(by.values()) == [[(1, 1, 1.0), (2, 0, 8.0)], [(1, 1, 7.0), (2, 0, 8.0)]]


def test_codes_favour_the_parallel_residual():
    x = np.random.default_rng(5).normal(size=(600, 12))
    unit = x / np.sqrt((x**2).sum(axis=1, keepdims=True))
    parallel = {}
    for eta in (1.0, 8.0):
        book = A.Codebook(x, 2, eta)
        parallel[eta] = (((x - book.decode(book.encode(x))) * unit).sum(axis=1) ** 2).mean()
    assert parallel[8.0] < parallel[1.0]
    book = A.Codebook(x, 2, 4.0)
    packed = book.encode(x)
    assert np.allclose(book.scan(x[:5], packed), x[:5] @ book.decode(packed).T, atol=1e-4)


PAGE = "page_id long, url string, html string"
ROWS = [(9, "http://a/9", "<p>é same</p>"), (2, "http://a/2", "<p>é same</p>"), (5, "http://b/ü\r\nX: y", "other\r\n\r\nbody"), (7, None, None), (1, "http://c", ""), (None, "http://d", "alone"), (None, "http://d", ""), (8, "u", "x" * 300_000), (2, "http://a/2", "<p>é same</p>"), (11, "v", "<p>é same</p>")]


def expected(rows, minimum):
    own = {}
    for i, _, h in rows:
        if i is not None:
            own[h or ""] = min(i, own.get(h or "", i))
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        first = own.get(h or "") if len(data) >= minimum and i is not None else i
        out.append((i, len(data), warc.base32_sha1(data), "response" if first == i else "revisit", None if first == i else first))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("minimum", "gap", "most"), [(0, warc.GAP, warc.MOST), (0, 0, 1), (5, 10, 500)])
def test_archives_read_back(table, minimum, gap, most):
    index = warc.write_archives(table(ROWS, PAGE), minimum)
    got = [tuple(r) for r in warc.read_selected(index, gap, most).collect()]
    assert sorted(got, key=repr) == expected(ROWS, minimum)


def test_one_record_for_each_row_of_repeated_ids(table):
    rows = [(i, f"u{i}", h) for i, h in [(1, "A"), (2, "C"), (5, "A"), (5, "B"), (6, "A"), (7, "A"), (7, "C")]]
    index = warc.write_archives(table(rows, PAGE))
    assert sorted([tuple(r) for r in warc.read_selected(index).collect()], key=repr) == expected(rows, 0)
    paths, raw = sorted({r.path for r in index.collect()}), b""
    for path in paths:
        with files.reader(path) as f:
            raw += gzip.decompress(f.read())
    assert raw.count(b"\r\n\r\nB\r\n\r\n") == 1


def test_any_selection_can_be_read(table):
    index = warc.write_archives(table(ROWS, PAGE))
    got = warc.read_selected(index.filter("page_id % 2 = 1").orderBy(F.desc("offset"))).collect()
    assert sorted(r.page_id for r in got) == [1, 5, 7, 9, 11]
    assert warc.read_selected(warc.write_archives(table([], PAGE))).count() == 0


def test_files_are_plain_warc(table):
    index = warc.write_archives(table(ROWS[:5], PAGE).coalesce(1)).collect()
    raw = b""
    for path in sorted({r.path for r in index}):
        with files.reader(path) as f:
            raw += gzip.decompress(f.read())
    assert raw.count(b"WARC/1.1\r\n") == 5 and raw.count(b"WARC-Type: revisit\r\n") == 2
    assert b"\r\nX: y\r\n" not in raw and b"WARC-Target-URI: http://b/%C3%BC%0D%0AX:%20y\r\n" in raw


def test_coalesced_ranges():
    ranges = [(0, 10), (10, 5), (40, 5), (46, 100), (200, 1)]
    assert list(files.coalesced(ranges, 1, 1000)) == [(0, 15, [0, 1]), (40, 146, [2, 3]), (200, 201, [4])]
    assert list(files.coalesced(ranges, 1000, 60)) == [(0, 45, [0, 1, 2]), (46, 146, [3]), (200, 201, [4])]
    assert list(files.coalesced([], 1, 1)) == []


def test_no_more_than_one_payload_is_held():
    import tracemalloc

    def records():
        for k in range(300):
            payload = bytes([k % 251]) * 1_000_000
            yield {"warc-type": "response", "warc-payload-digest": "sha1:" + warc.base32_sha1(payload), "payload": payload, "warc-record-id": f"<urn:page:{k}>"}

    tracemalloc.start()
    rows = warc._digests(records())
    assert rows.num_rows == 300 and tracemalloc.get_traced_memory()[1] < 20_000_000
    tracemalloc.stop()
