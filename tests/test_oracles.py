"""Every query with SQL equals DuckDB on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from citeloom.plans import catalog  # noqa: E402

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_oracle(spark, con, name):
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    found = con.execute(catalog.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == cols
    expected = [tuple(r[names.index(c)] for c in cols) for r in found.fetchall()]
    assert plain(tuple(r) for r in df.select(*cols).collect()) == plain(expected)


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_pagerank_counts_every_citation(spark):
    from citeloom.operators import centrality
    from citeloom.sources import corpus as C

    every = centrality.pagerank(C.papers(spark, DATA), C.edges(spark, DATA), max_iter=catalog.ITERATIONS, tol=0)
    assert plain(catalog.QUERIES["pagerank"](spark, DATA).collect()) == plain((r.paper_id, round(r.score, 7)) for r in every.collect())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
