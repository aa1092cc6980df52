"""Command line: builds relational tables from JSON stores and answers questions over them.

``python -m citeloom.cli build JSON_DIR DATA_DIR`` writes Parquet tables;
``python -m citeloom.cli --data DATA_DIR COMMAND ...`` reads them.  Only this
layer collects rows, and only as many as it prints.
"""

from __future__ import annotations

import argparse
import re
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators import centrality, findings, graph, lookup, postings, search
from citeloom.sources import documents, store

WIDTH = 80
TABLES = ["papers", "edges", "contexts", "authors", "paper_authors", "claims", "keywords", "topics", "sections", "methodology", "data_sources", "questions", "citation_counts"]


def build(spark: SparkSession, source: str, out: str) -> None:
    """Every relational table from papers.json, contexts.json, authors.json, extractions/ and, if there is one, findings/."""
    docs = documents.load_papers(spark, f"{source}/papers.json").cache()
    authors, paper_authors = documents.authors_tables(spark, f"{source}/authors.json")
    tables = {"papers": documents.papers_table(docs), "edges": documents.edges_table(docs), "citation_counts": documents.citation_counts(docs), "contexts": documents.contexts_table(spark, f"{source}/contexts.json"), "authors": authors, "paper_authors": paper_authors}
    tables |= documents.extraction_tables(documents.load_extractions(spark, f"{source}/extractions"))
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{source}/findings")
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        tables["findings"] = documents.load_findings(spark, f"{source}/findings")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}.parquet")
    docs.unpersist()


def show(df: DataFrame, limit: int) -> str:
    """Up to ``limit`` rows as text: columns cut at 80 characters, NULL for null, the number of rows last."""
    rows = df.limit(limit).collect()
    cells = [df.columns] + [["NULL" if v is None else str(v).replace("\n", " ")[:WIDTH] for v in r] for r in rows]
    width = [max(len(r[k]) for r in cells) for k in range(len(df.columns))]
    lines = ["  ".join(c.ljust(w) for c, w in zip(r, width, strict=True)).rstrip() for r in cells]
    return "\n".join([lines[0], "  ".join("-" * w for w in width), *lines[1:], f"({len(rows)} rows)"])


def wrap(text: str | None, width: int = WIDTH, indent: str = "") -> str:
    """Text in lines of at most so many characters, each indented; paragraphs stay apart."""
    import textwrap

    return "\n\n".join(textwrap.fill(" ".join(p.split()), width, initial_indent=indent, subsequent_indent=indent) for p in re.split(r"\n\s*\n", text or "") if p.strip())


def packed(texts: list[str], most: int, header: int = 200) -> list[list[str]]:
    """Texts of a review list in files of at most so many bytes, in order; a longer text has a file of its own."""
    files: list[list[str]] = []
    room = 0
    for t in texts:
        size = len(t.encode())
        if not files or size > room:
            files.append([])
            room = most - header
        files[-1].append(t)
        room -= size
    return files


def one_id(papers: DataFrame, wanted: str) -> str:
    """The id that a term means; an error if there is none or more than one."""
    hits = [r.id for r in lookup.resolve(papers, "paper_id", wanted).orderBy("id").limit(20).collect()]
    if len(hits) != 1:
        raise SystemExit(f"no paper matches {wanted!r}" if not hits else f"{wanted!r} may be: " + ", ".join(hits))
    return hits[0]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="citeloom", description=__doc__.split("\n")[0])
    p.add_argument("--data", default=".", help="folder of the Parquet tables")
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, *args, **kw: _add(sub, name, args, **kw)
    add("build", "source", "out")
    for name in ("paper", "abstract", "cites", "cited-by", "claims", "keywords", "methodology", "sections", "questions", "data-sources"):
        add(name, "id")
    for name in ("author", "author-info", "coauthors"):
        add(name, "name")
    for name in ("owned", "stats", "methods", "purposes-list"):
        add(name)
    for name in ("top-cited", "top-authors"):
        add(name, limit=20)
    add("purpose", "purpose", limit=30)
    add("chain", "id", depth=2)
    for name in ("co-cited", "bib-coupling"):
        add(name, "ids+", min=2, limit=20)
    for name in ("shared-refs", "common-citers", "shared-papers"):
        add(name, "ids+")
    for name in ("search", "search-claims", "search-sections", "search-topics", "search-keywords", "search-authors", "search-methods"):
        add(name, "query", limit=15)
    for name in ("pagerank", "katz"):
        q = add(name, limit=15)
        q.add_argument("--seed", action="append")
        kind = q.add_mutually_exclusive_group()
        kind.add_argument("--reverse", action="store_const", dest="kind", const="reverse", default="directed")
        kind.add_argument("--undirected", action="store_const", dest="kind", const="undirected")
        of = q.add_mutually_exclusive_group()
        of.add_argument("--owned", action="store_const", dest="types", const=documents.OWNED_TYPES)
        of.add_argument("--stubs", action="store_const", dest="types", const=["stub"])
        q.add_argument("--max-iter", type=int, default=100)
        q.add_argument("--tol", type=float, default=1e-6)
        if name == "katz":
            q.add_argument("--alpha", type=float)
            q.add_argument("--beta", type=float, default=1.0)
    q = add("explore", limit=50)
    q.add_argument("--owned", action="store_true")
    q.add_argument("--purpose")
    q.add_argument("--search")
    q.add_argument("--sort", choices=["id", "year", "purpose", "appearances"], default="id")
    add("search-all", "query", limit=10)
    add("index")
    add("findings")
    for name in ("findings-show", "findings-papers"):
        add(name, "finding")
    for name in ("findings-search", "findings-tag"):
        add(name, "term")
    add("findings-for-paper", "id")
    add("findings-missing")
    add("findings-tags")
    add("findings-overlap", "finding", "other")
    add("sql", "statement", limit=1000)
    add("schema")
    return p


def _add(sub, name: str, args: tuple, **options):
    q = sub.add_parser(name)
    for a in args:
        q.add_argument(a.rstrip("+"), nargs="+" if a.endswith("+") else None)
    for option, default in options.items():
        q.add_argument(f"--{option}", type=int, default=default)
    return q


def keyed(df: DataFrame, name: str) -> DataFrame:
    """A table's rows with the key that its index gives them."""
    own, columns = postings.INDEXED[name]
    rows = df.withColumn("key", F.col(own)) if own else df.dropDuplicates().withColumn("key", postings.row_number_of(df))
    return rows.withColumn("text", F.concat_ws(" | ", *[c for c in columns if c in df.columns]))


def stored_index(spark: SparkSession, data: str, name: str, df: DataFrame) -> postings.Index:
    """The index that ``index`` left, or one made for this session."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{data}/indexes/{name}/totals")
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return postings.load(spark, f"{data}/indexes/{name}")
    return postings.build_all({name: df}, store.shared_path(spark))[name]


def answer(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    t = lambda name: spark.read.parquet(f"{a.data}/{name}.parquet")
    papers = t("papers")
    pid = one_id(papers, a.id) if getattr(a, "id", None) else None
    of = lambda name: t(name).filter(F.col("paper_id") == pid)
    hit = lambda name, key, cols: search.top_hits(search.bm25(t(name), key, cols, a.query), key, a.limit)
    named = lambda: search.contains_any(t("authors"), ["canonical_name", "name_variants"], a.name)
    ids = [one_id(papers, i) for i in a.ids] if getattr(a, "ids", None) and a.command != "shared-papers" else getattr(a, "ids", None)
    indexed = lambda name: stored_index(spark, a.data, name, t(name))
    found = lambda: t("findings")
    pairs = lambda: findings.finding_papers(found()).withColumn("finding_id", F.col("finding_id").cast("string"))
    rank = lambda scores: centrality.ranked(scores, papers, a.limit, a.types)
    return {
        "paper": lambda: lookup.paper(papers, t("edges"), t("contexts"), pid),
        "abstract": lambda: papers.filter(F.col("paper_id") == pid).select("paper_id", "abstract"),
        "cites": lambda: lookup.contexts_citing(t("contexts"), pid),
        "cited-by": lambda: lookup.cited_with_purpose(t("contexts"), pid),
        "claims": lambda: of("claims").orderBy("pos"),
        "keywords": lambda: of("keywords").select(F.lit("keyword").alias("field"), F.col("keyword").alias("value")).unionByName(of("topics").select("field", "value")),
        "methodology": lambda: of("methodology"),
        "sections": lambda: of("sections").orderBy("pos"),
        "questions": lambda: of("questions").orderBy("pos"),
        "data-sources": lambda: of("data_sources").orderBy("pos"),
        "author": lambda: lookup.by_author(papers, t("authors"), t("paper_authors"), a.name).orderBy(F.desc("year"), "paper_id"),
        "author-info": lambda: named(),
        "coauthors": lambda: graph.coauthors(t("paper_authors"), a.name).orderBy(F.desc("n_shared"), "author_id"),
        "owned": lambda: lookup.owned_list(papers, t("edges"), t("contexts")).orderBy("paper_id"),
        "stats": lambda: lookup.stats({n: (t(n), [("rows", F.count("*"))]) for n in TABLES}),
        "methods": lambda: lookup.examples_by(t("methodology"), "type", "paper_id").orderBy(F.desc("n")),
        "purposes-list": lambda: lookup.counts_by(t("contexts"), "purpose").orderBy(F.desc("n")),
        "top-cited": lambda: lookup.top(t("citation_counts"), "cited_by_count", "paper_id", a.limit),
        "top-authors": lambda: lookup.top(t("authors").filter("type = 'person'"), "paper_count", "author_id", a.limit),
        "purpose": lambda: lookup.by_purpose(t("contexts"), a.purpose, a.limit),
        "chain": lambda: graph.chain(t("edges"), pid, a.depth).orderBy("depth", "citing_id"),
        "co-cited": lambda: graph.co_cited(t("edges"), ids, a.min, a.limit),
        "bib-coupling": lambda: graph.bib_coupling(t("edges"), ids, a.min, a.limit),
        "shared-refs": lambda: graph.shared_refs(t("edges"), ids),
        "common-citers": lambda: graph.common_citers(t("edges"), ids),
        "shared-papers": lambda: graph.shared_papers(t("paper_authors"), ids),
        "search": lambda: hit("papers", "paper_id", ["title", "abstract", "authors"]),
        "search-claims": lambda: hit("claims", "claim", ["claim", "quantification"]),
        "search-sections": lambda: hit("sections", "heading", ["heading", "summary"]),
        "search-topics": lambda: hit("topics", "value", ["value"]),
        "search-keywords": lambda: hit("keywords", "keyword", ["keyword"]),
        "search-authors": lambda: search.search_or_contains(t("authors"), "author_id", ["canonical_name", "name_variants"], a.query, a.limit),
        "search-methods": lambda: search.contains_any(t("methodology"), ["type"], a.query).select("paper_id", "type").limit(a.limit),
        "search-all": lambda: postings.search_all({n: (indexed(n), keyed(t(n), n), "key") for n in ("topics", "claims", "keywords", "papers", "sections")}, a.query, a.limit).orderBy("kind", "rank"),
        "index": lambda: spark.createDataFrame([(n, i.totals.first()["n"]) for n, i in postings.build_all({n: t(n) for n in postings.INDEXED}, f"{a.data}/indexes").items()], "table string, rows long"),
        "findings": lambda: found().select("finding_id", "title", "tags").orderBy("finding_id"),
        "findings-show": lambda: found().filter(F.col("finding_id").cast("string") == a.finding),
        "findings-papers": lambda: findings.with_flags(pairs().filter(F.col("finding_id") == a.finding), papers),
        "findings-search": lambda: findings.containing(found(), a.term).select("finding_id", "title"),
        "findings-tag": lambda: found().filter(F.array_contains("tags", a.term)).select("finding_id", "title"),
        "findings-for-paper": lambda: pairs().filter(F.col("paper_id") == pid),
        "findings-missing": lambda: findings.missing(pairs(), papers),
        "findings-tags": lambda: findings.tag_counts(found().select(F.explode("tags").alias("tag"))),
        "findings-overlap": lambda: findings.overlap(pairs(), a.finding, a.other),
        "pagerank": lambda: rank(centrality.pagerank(papers, t("edges"), a.kind, a.seed, max_iter=a.max_iter, tol=a.tol)),
        "katz": lambda: rank(centrality.katz(papers, t("edges"), a.kind, a.seed, a.alpha, a.beta, max_iter=a.max_iter, tol=a.tol)),
        "explore": lambda: findings.explore(t("contexts"), papers, a.owned, a.purpose, a.search, a.sort, a.limit),
        "sql": lambda: lookup.sql(spark, {n: t(n) for n in TABLES}, a.statement),
        "schema": lambda: lookup.schema_listing({n: t(n) for n in TABLES}),
    }[a.command]()


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("citeloom").getOrCreate()
    if a.command == "build":
        build(spark, a.source, a.out)
    else:
        print(show(answer(spark, a), getattr(a, "limit", None) or 1000))
    return 0


if __name__ == "__main__":
    sys.exit(main())
