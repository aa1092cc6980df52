"""BM25 text search by a scan, and substring search; stored indexes are in ``postings``.

Tokens are runs of a-z in lower case, optionally stemmed, without stop words.
``score = sum log10((N - df + 0.5) / (df + 0.5) + 1) * tf (k + 1) / (tf + k (1 - b + b len / avg))``
over the distinct terms of the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.sources.store import cut

K, B = 1.2, 0.75


def tokens(columns: list[str], stem: bool = False, stop: list[str] | None = None) -> Column:
    """The tokens of a row's columns together."""
    found = F.filter(F.split(F.lower(F.concat_ws(" ", *columns)), "[^a-z]+"), lambda t: t != "")
    if stop:
        found = F.filter(found, lambda t: ~t.isin(*stop))
    if stem:
        from citeloom.functions.similarity import porter_stems

        found = porter_stems(found)
    return found


def terms_of(query: str, stem: bool = False, stop: list[str] | None = None) -> list[str]:
    import re

    found = sorted({t for t in re.split("[^a-z]+", query.lower()) if t and t not in (stop or [])})
    if stem:
        from citeloom.functions.similarity import porter

        found = sorted({porter(t) for t in found})
    return found


def _count(column: str, term: str) -> Column:
    return F.size(F.filter(column, lambda x: x == term))


def _term_score(tf: Column, df: Column, length: Column, n: Column, average: Column, k: float, b: float) -> Column:
    return F.log10((n - df + 0.5) / (df + 0.5) + 1) * tf * (k + 1) / (tf + k * (1 - b + b * length / average))


def bm25(docs: DataFrame, key: str, columns: list[str], query: str, stem: bool = False, stop: list[str] | None = None, k: float = K, b: float = B) -> DataFrame:
    """key, score of the rows with a term.

    One scan of the texts counts the few query terms in each row; the counts
    are written, and give first the totals, one row, and then the scores.
    """
    terms = terms_of(query, stem, stop)
    if not terms:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    counted = docs.select(key, tokens(columns, stem, stop).alias("t"))
    counted = cut(counted.select(key, F.size("t").alias("len"), *[_count("t", w).alias(f"tf{i}") for i, w in enumerate(terms)]))
    totals = counted.agg(F.count("*").alias("n"), F.avg("len").alias("average"), *[F.sum((F.col(f"tf{i}") > 0).cast("int")).alias(f"df{i}") for i in range(len(terms))])
    score = sum((F.when(F.col(f"tf{i}") > 0, _term_score(F.col(f"tf{i}"), F.col(f"df{i}"), F.col("len"), F.col("n"), F.col("average"), k, b)).otherwise(0.0) for i in range(len(terms))), F.lit(0.0))
    any_term = F.greatest(*[F.col(f"tf{i}") for i in range(len(terms))], F.lit(0)) > 0
    return counted.filter(any_term).join(F.broadcast(totals)).select(key, score.alias("score"))  # one row


def contains_any(docs: DataFrame, columns: list[str], term: str) -> DataFrame:
    """Rows with the term in one of the columns, in any case; wildcards are plain characters."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(term.lower())), F.lit(False))
    return docs.filter(hit)


def top_hits(scored: DataFrame, key: str, limit: int) -> DataFrame:
    """The best rows; scores that agree to nine digits are equal, since sums may differ in the last ones, and go by key."""
    return scored.orderBy(F.desc(F.round("score", 9)), key).limit(limit)


def search(docs: DataFrame, key: str, columns: list[str], query: str, limit: int = 15, keep: Column | None = None, **options) -> DataFrame:
    """key, score of the best rows; ``keep`` filters before the limit, and after the statistics."""
    scored = bm25(docs, key, columns, query, **options)
    if keep is not None:
        scored = scored.join(docs.filter(keep).select(key), key, "left_semi")
    return top_hits(scored, key, limit)


def search_or_contains(docs: DataFrame, key: str, columns: list[str], query: str, limit: int = 20, **options) -> DataFrame:
    """Ranked hits; if no row has a term, rows that contain the query as it stands, with a null score."""
    ranked = search(docs, key, columns, query, limit, **options)
    plain = contains_any(docs, columns, query).select(key, F.lit(None).cast("double").alias("score")).orderBy(key).limit(limit)
    none = ranked.agg((F.count("*") == 0).alias("none"))
    return ranked.unionByName(plain.join(F.broadcast(none)).filter("none").drop("none"))  # one row


def counts(tables: dict[str, tuple[DataFrame, list[str]]], query: str, stop: list[str] | None = None) -> DataFrame:
    """source, n: how many rows of each table have a term of the query."""
    from functools import reduce

    terms = terms_of(query, stop=stop)
    rows = [df.filter(F.arrays_overlap(tokens(cols), F.array(*map(F.lit, terms)))).agg(F.count("*").alias("n")).select(F.lit(name).alias("source"), "n") for name, (df, cols) in tables.items()]
    return reduce(DataFrame.unionByName, rows)
