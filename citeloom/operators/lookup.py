"""Point queries, filters and counts over the relational corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.sources.documents import owned


def resolve(table: DataFrame, key: str, wanted: str) -> DataFrame:
    """id, n: the ids that a term means: itself if it exists, else those that contain it in any case; n of 1 is unambiguous."""
    ids = table.select(F.col(key).cast("string").alias("id")).distinct()
    found = ids.withColumn("exact", F.col("id") == wanted).filter(F.col("exact") | F.contains(F.lower("id"), F.lit(wanted.lower())))
    any_exact = found.agg(F.max("exact").alias("any_exact"))
    hits = found.join(F.broadcast(any_exact)).filter(F.col("exact") | ~F.col("any_exact"))  # one row
    total = hits.agg(F.count("*").alias("n"))
    return hits.join(F.broadcast(total)).select("id", "n")


def cited_counts(contexts: DataFrame, key: str = "citing_id", name: str = "n_cited") -> DataFrame:
    """Distinct cited papers of each citing paper, from annotated contexts."""
    return contexts.groupBy(F.col(key).alias("paper_id")).agg(F.count_distinct("cited_id").alias(name))


def cited_by_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("cited_id").alias("paper_id")).agg(F.count("*").alias("cited_by_count"))


def paper(papers: DataFrame, edges: DataFrame, contexts: DataFrame, paper_id) -> DataFrame:
    """A paper's row with its counts; filters reach both scans before anything is aggregated."""
    p = papers.filter(F.col("paper_id") == paper_id)
    n_by = cited_by_counts(edges.filter(F.col("cited_id") == paper_id))
    n_cited = cited_counts(contexts.filter(F.col("citing_id") == paper_id))
    return p.join(n_by, "paper_id", "left").join(n_cited, "paper_id", "left").fillna(0, ["cited_by_count", "n_cited"])


def owned_list(papers: DataFrame, edges: DataFrame, contexts: DataFrame) -> DataFrame:
    """Owned papers with both counts."""
    p = papers.filter(owned(F.col("type"))).select("paper_id", "title", "year", "type")
    return p.join(cited_counts(contexts), "paper_id", "left").join(cited_by_counts(edges), "paper_id", "left").fillna(0, ["n_cited", "cited_by_count"])


def by_author(papers: DataFrame, authors: DataFrame, paper_authors: DataFrame, term: str) -> DataFrame:
    """Papers of the author entities whose name or variants contain the term in any case."""
    hit = authors.filter(F.contains(F.lower("canonical_name"), F.lit(term.lower())))
    return papers.join(paper_authors.join(hit, "author_id").select("paper_id").distinct(), "paper_id", "left_semi")


def author_info(authors: DataFrame, paper_authors: DataFrame, author_id) -> DataFrame:
    """An entity with its variants other than the canonical name and its number of papers."""
    n = paper_authors.filter(F.col("author_id") == author_id).groupBy("author_id").agg(F.count_distinct("paper_id").alias("paper_count"))
    one = authors.filter(F.col("author_id") == author_id)
    if "name_variants" in one.columns:
        one = one.withColumn("name_variants", F.array_join(F.array_except(F.split("name_variants", r"\|"), F.array("canonical_name")), "|"))
    return one.join(n, "author_id", "left").fillna(0, ["paper_count"])


def top(df: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """The n rows with the largest value, smaller keys first among equals: a distributed top-k, not a sort."""
    return df.orderBy(F.desc_nulls_last(by), key).limit(n)


def contexts_citing(contexts: DataFrame, paper_id, limit: int | None = None) -> DataFrame:
    found = contexts.filter(F.col("cited_id") == paper_id)
    return found if limit is None else found.orderBy("citing_id", "purpose", "section").limit(limit)


def cited_with_purpose(contexts: DataFrame, paper_id) -> DataFrame:
    return contexts.filter(F.col("citing_id") == paper_id).select("cited_id", "purpose").distinct()


def by_purpose(contexts: DataFrame, purpose: str, limit: int = 30) -> DataFrame:
    """The first contexts of one purpose, and how many there are in all."""
    found = contexts.filter(F.col("purpose") == purpose)
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy("citing_id", "cited_id", "section").limit(limit).join(F.broadcast(total))  # one row


def counts_by(df: DataFrame, key: str | Column, name: str = "n") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias(name))


def examples_by(df: DataFrame, key: str, item: str, most: int = 5) -> DataFrame:
    """Each group's count and its first items by order, joined by commas; groups are never gathered whole."""
    from pyspark.sql import Window

    n = df.groupBy(key).agg(F.count("*").alias("n"))
    first = df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(item))).filter(F.col("_r") <= most)
    listed = first.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col(item).cast("string").alias("_i")))), lambda s: s["_i"]), ", ").alias("examples"))
    return n.join(listed, key)


def stats(counted: dict[str, tuple[DataFrame, list[Column]]]) -> DataFrame:
    """metric, value: each table's aggregates in one pass over it."""
    rows = []
    for name, (df, aggs) in counted.items():
        one = df.agg(*[a.cast("long").alias(f"c{k}") for k, (_, a) in enumerate(aggs)])
        rows.append(one.select(F.explode(F.array(*[F.struct(F.lit(f"{name}.{label}").alias("metric"), F.col(f"c{k}").alias("value")) for k, (label, _) in enumerate(aggs)])).alias("s")).select("s.*"))
    return reduce(DataFrame.unionByName, rows)


def schema_listing(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, column_name, data_type, nullable, position."""
    rows = [(t, f.name, f.dataType.simpleString(), f.nullable, k) for t, df in sorted(tables.items()) for k, f in enumerate(df.schema.fields)]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, nullable boolean, position int")


READ_ONLY = ("select", "with", "describe", "show", "explain")


def sql(spark, tables: dict[str, DataFrame], statement: str) -> DataFrame:
    """A statement over the tables as views; anything that could write is refused."""
    body = statement.strip().rstrip(";")
    if ";" in body or body.split(None, 1)[0].lower() not in READ_ONLY:
        raise ValueError("only one reading statement is allowed")
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(body)
