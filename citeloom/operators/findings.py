"""Saved research findings (finding_id, title, question, summary, tags, papers) and context views grouped by paper."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.operators.graph import shared_counts
from citeloom.sources.documents import owned


def finding_papers(findings: DataFrame) -> DataFrame:
    return findings.select("finding_id", F.explode("papers").alias("p")).select("finding_id", "p.*")


def listed(findings: DataFrame) -> DataFrame:
    return findings.select("finding_id", "title", F.size("papers").alias("n_papers"), F.array_join(F.array_sort("tags"), ", ").alias("tags"))


def with_flags(pairs: DataFrame, papers: DataFrame) -> DataFrame:
    """(finding_id, paper_id) with in_db and owned as the corpus has them now."""
    p = papers.select("paper_id", F.lit(True).alias("in_db"), owned(F.col("type")).alias("owned"))
    return pairs.join(p, "paper_id", "left").fillna(False, ["in_db", "owned"])


def missing(pairs: DataFrame, papers: DataFrame) -> DataFrame:
    """paper_id, n_findings: papers that findings name and nobody owns."""
    have = papers.filter(owned(F.col("type"))).select("paper_id")
    return pairs.join(have, "paper_id", "left_anti").groupBy("paper_id").agg(F.count_distinct("finding_id").alias("n_findings"))


def for_paper(findings: DataFrame, paper_id) -> DataFrame:
    return findings.filter(F.exists("papers", lambda p: p["paper_id"] == paper_id)).select("finding_id", "title")


def overlap(pairs: DataFrame, a, b) -> DataFrame:
    """paper_id: the papers that two findings share."""
    of = lambda x: pairs.filter(F.col("finding_id") == x).select("paper_id")
    return of(a).intersect(of(b))


def overlaps(pairs: DataFrame, least: int = 2) -> DataFrame:
    """finding_a, finding_b, n_shared: all pairs of findings that share so many papers."""
    return shared_counts(pairs, "finding_id", "paper_id", least).toDF("finding_a", "finding_b", "n_shared")


def tag_counts(tags: DataFrame) -> DataFrame:
    return tags.groupBy("tag").agg(F.count("*").alias("n"))


def containing(findings: DataFrame, term: str) -> DataFrame:
    """Findings with the term in any text field, tag or paper entry."""
    hit = F.contains(F.lower(F.to_json(F.struct("title", "question", "summary", "tags", "papers"))), F.lit(term.lower()))
    return findings.filter(hit).select("finding_id", "title")


def explore(contexts: DataFrame, papers: DataFrame, owned_only: bool = False, purpose: str | None = None, term: str | None = None, sort: str = "appearances", limit: int | None = 50, most_shown: int = 5) -> DataFrame:
    """paper_id, title, year, appearances, purposes, shown: cited papers with their contexts.

    Filters go by type, then purpose (of contexts), then a term: in the title it
    keeps all contexts of the paper, else those that hold it.  Counts cover all
    contexts; ``shown`` has the first few, so that no list grows with the group.
    """
    from pyspark.sql import Window

    p = papers.select(F.col("paper_id").alias("cited_id"), "title", "year", "type")
    c = contexts.join(p, "cited_id")
    c = c.filter(owned(F.col("type"))) if owned_only else c
    c = c.filter(F.col("purpose") == purpose) if purpose else c
    if term:
        texts = [x for x in ("quote", "explanation", "section") if x in contexts.columns]
        hit = F.contains(F.lower("title"), F.lit(term.lower()))
        for x in texts:
            hit = hit | F.coalesce(F.contains(F.lower(x), F.lit(term.lower())), F.lit(False))
        c = c.filter(hit)
    order = ["citing_id", "purpose", "section"]
    first = c.withColumn("_r", F.row_number().over(Window.partitionBy("cited_id").orderBy(*order))).filter(F.col("_r") <= most_shown)
    one = F.struct("_r", F.concat_ws(":", F.col("citing_id").cast("string"), "purpose", "section").alias("s"))
    shown = first.groupBy("cited_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["s"]), ";").alias("shown"))
    total = c.groupBy("cited_id", "title", "year").agg(F.count("*").alias("appearances"), F.array_join(F.array_sort(F.collect_set("purpose")), ",").alias("purposes"))
    by = {"appearances": [F.desc("appearances")], "year": [F.asc_nulls_last("year")], "id": [], "purpose": [F.asc("purposes")]}[sort]
    out = total.orderBy(*by, "cited_id").limit(limit) if limit else total
    return out.join(shown, "cited_id").withColumnRenamed("cited_id", "paper_id")
