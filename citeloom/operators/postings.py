"""Block-max postings: full-text indexes that are built once, stored by term, and searched without scoring every hit.

Rows are numbered in the order of their keys, and BLOCK consecutive numbers are a
block.  The index has a row for each term and block with a hit: the keys, counts
and lengths of its hits, and the greatest impact among them, an impact being a
term's part of the BM25 score without its weight.  A search reads the impacts
first.  The best hit of a block scores at least its greatest weighted impact,
so the limit-th greatest of these is a lower bound of the last score wanted; no
hit of a block scores more than the sum of its terms' greatest, so blocks whose
sum stays below that bound are skipped: their hits are never read or scored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators.search import B, K, terms_of, tokens, top_hits
from citeloom.sources.store import cut

BLOCK = 128
#: The tables that have an index: key and texts. Rows without a key of their own go by their number.
INDEXED = {
    "papers": ("paper_id", ["title", "abstract", "authors"]),
    "contexts": (None, ["quote", "explanation", "cited_title"]),
    "claims": (None, ["claim", "quantification"]),
    "sections": (None, ["heading", "summary"]),
    "keywords": (None, ["keyword"]),
    "topics": (None, ["value"]),
    "authors": ("author_id", ["canonical_name", "name_variants"]),
}


class Index:
    """A stored index: ``blocks`` (term, block, hits, top, keys, tf, len) and ``totals`` (n, average, key, stem), one row."""

    def __init__(self, blocks: DataFrame, totals: DataFrame):
        self.blocks, self.totals = blocks, totals
        self.stem = bool(totals.first()["stem"])


def _impact(tf: Column, length: Column, average: Column) -> Column:
    return tf * (K + 1) / (tf + K * (1 - B + B * length / average))


def _weight(n: Column, df: Column) -> Column:
    return F.log10((n - df + 0.5) / (df + 0.5) + 1)


def build(docs: DataFrame, key: str, columns: list[str], path: str, stem: bool = False, stop: list[str] | None = None, block: int = BLOCK) -> Index:
    """Writes the index of some text columns below ``path`` and opens it.

    Null texts count as empty; rows without a token count in the statistics.
    Keys are distinct.  A term that every row has makes as many small rows as
    there are blocks, so no term is a hot key; files hold ranges of terms, so a
    search reads few row groups.
    """
    t = tokens(columns, stem, stop)
    totals = docs.select(F.size(t).alias("len")).agg(F.count("*").alias("n"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("average")).withColumn("stem", F.lit(stem))
    totals.write.mode("overwrite").parquet(f"{path}/totals")
    totals = docs.sparkSession.read.parquet(f"{path}/totals")
    # Texts move twice, by key and by block; as a block's rows then stand together, its hits are counted and gathered without a shuffle.
    ordered = docs.select(F.col(key).alias("key"), *columns).repartitionByRange("key").sortWithinPartitions("key")
    placed = ordered.withColumn("block", F.floor(F.monotonically_increasing_id() / block)).repartition("block")
    rows = placed.select("key", "block", t.alias("t")).select("key", "block", F.size("t").alias("len"), F.explode("t").alias("term"))
    hits = rows.groupBy("block", "key", "term").agg(F.count("*").cast("int").alias("tf"), F.first("len").alias("len"))
    hits = hits.join(F.broadcast(totals.select("average"))).withColumn("impact", _impact(F.col("tf"), F.col("len"), F.col("average")))  # one row
    of = hits.groupBy("block", "term").agg(F.count("*").cast("int").alias("hits"), F.max("impact").alias("top"), F.array_sort(F.collect_list(F.struct("key", "tf", "len"))).alias("h"))
    blocks = cut(of.select("term", "block", "hits", "top", F.col("h.key").alias("keys"), F.col("h.tf").alias("tf"), F.col("h.len").alias("len")))
    blocks.repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{path}/blocks")
    return load(docs.sparkSession, path)


def load(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/totals"))


def build_all(tables: dict[str, DataFrame], path: str, stem: bool = False) -> dict[str, Index]:
    """The indexes of all tables of INDEXED that are there, each below ``path``; list columns are read as their items."""
    out = {}
    for name, (key, columns) in INDEXED.items():
        if name not in tables:
            continue
        df = tables[name] if key else tables[name].dropDuplicates()
        text = [F.array_join(c, " ").alias(c) if df.schema[c].dataType.typeName() == "array" else F.col(c) for c in columns if c in df.columns]
        out[name] = build(df.select((F.col(key) if key else row_number_of(df)).alias("key"), *text), "key", [c for c in columns if c in df.columns], f"{path}/{name}", stem)
    return out


def row_number_of(df: DataFrame) -> Column:
    """A number of a row that doesn't depend on its place: a hash of all that it holds."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])


def _weighted(index: Index, query: str) -> tuple[DataFrame, DataFrame]:
    """The blocks of the query's terms, and each term's weight, a row for each."""
    found = index.blocks.filter(F.col("term").isin(terms_of(query, index.stem)))
    df = found.groupBy("term").agg(F.sum("hits").alias("df"))
    return found, df.join(F.broadcast(index.totals)).select("term", _weight(F.col("n"), F.col("df")).alias("weight"), "average")


def _summed(blocks: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    hits = blocks.join(F.broadcast(weights), "term").select("weight", "average", F.explode(F.arrays_zip("keys", "tf", "len")).alias("h"))
    part = F.col("weight") * _impact(F.col("h.tf"), F.col("h.len"), F.col("average"))
    return hits.groupBy(F.col("h.keys").alias(key)).agg(F.sum(part).alias("score"))


def scores(index: Index, key: str, query: str) -> DataFrame:
    """key, score of every row with a term."""
    return _summed(*_weighted(index, query), key)


def open_blocks(index: Index, query: str, limit: int) -> DataFrame:
    """block, most, opened: for each block with a term the most that a row of it may score, and whether it must be read."""
    found, weights = _weighted(index, query)
    part = F.col("top") * F.col("weight")
    bounds = cut(found.select("term", "block", "top").join(F.broadcast(weights), "term").groupBy("block").agg(F.sum(part).alias("most"), F.max(part).alias("least")))
    last = bounds.select("least").orderBy(F.desc("least")).limit(limit).agg(F.when(F.count("*") == limit, F.min("least")).otherwise(0.0).alias("last"))
    # Scores that agree to nine digits are equal, so what is that near must be read, too.
    return bounds.join(F.broadcast(last)).select("block", "most", (F.col("most") >= F.col("last") - 1e-8).alias("opened"))  # one row


def top(index: Index, key: str, query: str, limit: int = 15) -> DataFrame:
    """key, score of the best rows, as ``top_hits`` of all scores."""
    found, weights = _weighted(index, query)
    opened = open_blocks(index, query, limit).filter("opened").select("block")
    return top_hits(_summed(found.join(opened, "block", "left_semi"), weights, key), key, limit)


def search_all(kinds: dict[str, tuple[Index, DataFrame, str]], query: str, limit: int = 10) -> DataFrame:
    """kind, total, rank, key, paper_id, text, score, papers_shown: the best rows of each kind in one table.

    kinds: name -> (index, rows, key), rows holding the key, a paper_id and the text to be shown.
    ``total`` counts the kind's rows with a term, ``papers_shown`` the distinct
    papers among all rows shown.  A kind without a hit gives no row.
    """
    from functools import reduce

    from pyspark.sql import Window

    parts = []
    for name, (index, rows, key) in kinds.items():
        found, _ = _weighted(index, query)
        total = found.select(F.explode("keys").alias("k")).agg(F.count_distinct("k").alias("total"))
        best = top(index, key, query, limit).join(F.broadcast(total))
        ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), key)))  # ``limit`` rows
        paper = rows.select(key, *[(F.col(c) if c in rows.columns else F.lit(None)).cast("string").alias(f"_{c}") for c in ("paper_id", "text")])
        parts.append(ranked.join(paper, key).select(F.lit(name).alias("kind"), "total", "rank", F.col(key).cast("string").alias("key"), F.col("_paper_id").alias("paper_id"), F.col("_text").alias("text"), "score"))
    shown = cut(reduce(DataFrame.unionByName, parts))
    return shown.join(F.broadcast(shown.agg(F.count_distinct("paper_id").alias("papers_shown"))))  # one row
