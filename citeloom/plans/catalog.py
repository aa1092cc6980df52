"""Named queries over the corpus views, each with its oracle SQL where SQL can express it.

Every query reads its whole tables; a limit is part of the operator.  Where an
operator compares two versions of a table, conditions on keys or types make the
versions differ.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions import text as T
from citeloom.operators import authors as A
from citeloom.operators import centrality, findings, graph, ingest, lookup, maintain, search
from citeloom.plans.registry import ORACLES, QUERIES, query
from citeloom.sources import corpus as C
from citeloom.sources import store
from citeloom.sources.corpus import with_views
from citeloom.streaming import incremental

# Lookups and counts.
N_CITED = "SELECT citing_id AS paper_id, count(DISTINCT cited_id) AS n_cited FROM contexts GROUP BY 1"
CITED_BY = "SELECT cited_id AS paper_id, count(*) AS cited_by_count FROM edges GROUP BY 1"
WITH_COUNTS = f"LEFT JOIN ({N_CITED}) USING (paper_id) LEFT JOIN ({CITED_BY}) USING (paper_id)"


@query(
    "paper_summary",
    with_views("papers", "edges", "contexts") + f" SELECT paper_id, title, journal, year, type, doi, abstract, coalesce(cited_by_count, 0) AS cited_by_count, coalesce(n_cited, 0) AS n_cited FROM papers {WITH_COUNTS} WHERE paper_id = 42",
)
def paper_summary(spark, d):
    return lookup.paper(C.papers(spark, d), C.edges(spark, d), C.contexts(spark, d), 42)


@query(
    "owned_list",
    with_views("papers", "edges", "contexts") + f" SELECT paper_id, title, year, type, coalesce(n_cited, 0) AS n_cited, coalesce(cited_by_count, 0) AS cited_by_count FROM papers {WITH_COUNTS} WHERE type IN ('owned', 'external_owned')",
)
def owned_list(spark, d):
    return lookup.owned_list(C.papers(spark, d), C.edges(spark, d), C.contexts(spark, d))


@query("abstract", with_views("papers") + " SELECT paper_id, abstract FROM papers WHERE paper_id = 7")
def abstract(spark, d):
    return C.papers(spark, d).filter("paper_id = 7").select("paper_id", "abstract")


@query("resolve_exact", with_views("papers") + " SELECT CAST(paper_id AS VARCHAR) AS id, CAST(1 AS BIGINT) AS n FROM papers WHERE paper_id = 12")
def resolve_exact(spark, d):
    return lookup.resolve(C.papers(spark, d), "paper_id", "12")


@query(
    "resolve_partial",
    with_views("authors") + " SELECT canonical_name AS id, count(*) OVER () AS n FROM (SELECT DISTINCT canonical_name FROM authors WHERE contains(lower(canonical_name), 'r#00000001'))",
)
def resolve_partial(spark, d):
    return lookup.resolve(C.authors(spark, d), "canonical_name", "r#00000001")


@query(
    "author_papers",
    with_views("papers", "authors", "paper_authors") + " SELECT DISTINCT paper_id, title, year FROM papers JOIN paper_authors USING (paper_id) JOIN authors USING (author_id) WHERE contains(lower(canonical_name), '00000003')",
)
def author_papers(spark, d):
    return lookup.by_author(C.papers(spark, d), C.authors(spark, d), C.paper_authors(spark, d), "00000003").select("paper_id", "title", "year")


@query(
    "author_info",
    with_views("authors", "paper_authors") + " SELECT author_id, canonical_name, count(DISTINCT paper_id) AS paper_count FROM authors LEFT JOIN paper_authors USING (author_id) WHERE author_id = 3 GROUP BY 1, 2",
)
def author_info(spark, d):
    return lookup.author_info(C.authors(spark, d), C.paper_authors(spark, d), 3)


@query("top_authors", with_views("paper_authors") + " SELECT author_id, count(*) AS paper_count FROM paper_authors GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_authors(spark, d):
    return lookup.top(lookup.counts_by(C.paper_authors(spark, d), "author_id", "paper_count"), "paper_count", "author_id", 10)


@query("top_cited", with_views("edges") + f" SELECT * FROM ({CITED_BY}) ORDER BY cited_by_count DESC, paper_id LIMIT 20")
def top_cited(spark, d):
    return lookup.top(lookup.cited_by_counts(C.edges(spark, d)), "cited_by_count", "paper_id", 20)


@query("cites_of", with_views("contexts") + " SELECT citing_id, cited_id, purpose, section FROM contexts WHERE cited_id = 42")
def cites_of(spark, d):
    return lookup.contexts_citing(C.contexts(spark, d), 42)


@query("cited_by_of", with_views("contexts") + " SELECT DISTINCT cited_id, purpose FROM contexts WHERE citing_id = 42")
def cited_by_of(spark, d):
    return lookup.cited_with_purpose(C.contexts(spark, d), 42)


@query(
    "purpose_contexts",
    with_views("contexts") + " SELECT citing_id, cited_id, purpose, section, count(*) OVER () AS total FROM contexts WHERE purpose = '1-URGENT' ORDER BY citing_id, cited_id, section LIMIT 30",
)
def purpose_contexts(spark, d):
    return lookup.by_purpose(C.contexts(spark, d), "1-URGENT")


@query("purposes_list", with_views("contexts") + " SELECT purpose, count(*) AS n FROM contexts GROUP BY 1")
def purposes_list(spark, d):
    return lookup.counts_by(C.contexts(spark, d), "purpose")


@query(
    "methods_list",
    """SELECT p_type AS method, count(*) AS n, (SELECT string_agg(CAST(k AS VARCHAR), ', ' ORDER BY k) FROM (SELECT p_partkey AS k FROM part q WHERE q.p_type = p.p_type ORDER BY 1 LIMIT 5)) AS examples FROM part p GROUP BY p_type""",
)
def methods_list(spark, d):
    return lookup.examples_by(C.papers(spark, d).withColumnRenamed("abstract", "method"), "method", "paper_id")


@query("search_methods", with_views("papers") + " SELECT paper_id, title, abstract AS method, year FROM papers WHERE contains(lower(abstract), 'econ') ORDER BY year DESC, paper_id LIMIT 50")
def search_methods(spark, d):
    hits = search.contains_any(C.papers(spark, d), ["abstract"], "ECON")
    return hits.select("paper_id", "title", F.col("abstract").alias("method"), "year").orderBy(F.desc("year"), "paper_id").limit(50)


@query(
    "sections_of",
    "SELECT conv_id AS paper_id, turn AS pos, role AS heading, text AS summary FROM conversations WHERE conv_id = 3",
)
def sections_of(spark, d):
    return C.sections(spark, d).filter("paper_id = 3")


@query("questions_of", "SELECT conv_id AS paper_id, text AS question FROM conversations WHERE conv_id = 5 AND role = 'user'")
def questions_of(spark, d):
    return C.sections(spark, d).filter("paper_id = 5 and heading = 'user'").select("paper_id", F.col("summary").alias("question"))


@query("claims_of_type", "SELECT conv_id AS paper_id, turn AS pos, text AS claim FROM conversations WHERE role = 'assistant'")
def claims_of_type(spark, d):
    return C.sections(spark, d).filter("heading = 'assistant'").select("paper_id", "pos", F.col("summary").alias("claim"))


TOPICS_SQL = "SELECT p_partkey AS paper_id, 'brand' AS field, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'type', p_type FROM part UNION ALL SELECT p_partkey, 'size', CAST(p_size AS VARCHAR) FROM part"


@query("keywords_and_topics", f"SELECT paper_id, string_agg(field || '=' || value, '; ' ORDER BY field, value) AS topics FROM ({TOPICS_SQL}) GROUP BY 1")
def keywords_and_topics(spark, d):
    t = C.topics(spark, d)
    pair = F.concat_ws("=", "field", "value")
    return t.groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("field", "value", pair.alias("s")))), lambda x: x["s"]), "; ").alias("topics"))


@query("data_sources", "SELECT page_id AS paper_id, url AS name FROM pages")
def data_sources(spark, d):
    return C.table(spark, d, "pages").select(F.col("page_id").alias("paper_id"), F.col("url").alias("name"))


@query(
    "stats",
    with_views("papers", "edges", "contexts", "authors")
    + """ SELECT 'papers.all' AS metric, count(*) AS value FROM papers UNION ALL SELECT 'papers.owned', count(*) FROM papers WHERE type IN ('owned', 'external_owned')
UNION ALL SELECT 'papers.stub', count(*) FROM papers WHERE type = 'stub' UNION ALL SELECT 'papers.years', count(DISTINCT year) FROM papers
UNION ALL SELECT 'edges.all', count(*) FROM edges UNION ALL SELECT 'edges.citing', count(DISTINCT citing_id) FROM edges
UNION ALL SELECT 'contexts.all', count(*) FROM contexts UNION ALL SELECT 'contexts.purposes', count(DISTINCT purpose) FROM contexts UNION ALL SELECT 'authors.all', count(*) FROM authors""",
)
def stats(spark, d):
    kind = F.col("type")
    return lookup.stats({
        "papers": (C.papers(spark, d), [("all", F.count("*")), ("owned", F.count(F.when(kind.isin("owned", "external_owned"), 1))), ("stub", F.count(F.when(kind == "stub", 1))), ("years", F.count_distinct("year"))]),
        "edges": (C.edges(spark, d), [("all", F.count("*")), ("citing", F.count_distinct("citing_id"))]),
        "contexts": (C.contexts(spark, d), [("all", F.count("*")), ("purposes", F.count_distinct("purpose"))]),
        "authors": (C.authors(spark, d), [("all", F.count("*"))]),
    })


@query(
    "distributions",
    with_views("papers", "contexts")
    + """ SELECT 'year' AS kind, CAST(year AS VARCHAR) AS value, count(*) AS n FROM papers GROUP BY 2 UNION ALL SELECT 'type', coalesce(type, 'unknown'), count(*) FROM papers GROUP BY 2
UNION ALL SELECT 'method', abstract, count(*) FROM papers GROUP BY 2 UNION ALL SELECT 'purpose', purpose, count(*) FROM contexts GROUP BY 2""",
)
def distributions(spark, d):
    p, c = C.papers(spark, d), C.contexts(spark, d)
    one = lambda df, kind, col: df.groupBy(F.coalesce(col.cast("string"), F.lit("unknown")).alias("value")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "value", "n")
    return one(p, "year", F.col("year")).unionByName(one(p, "type", F.col("type"))).unionByName(one(p, "method", F.col("abstract"))).unionByName(one(c, "purpose", F.col("purpose")))


_LISTED = {
    "papers": "paper_id bigint, title string, journal string, year int, type string, doi string, abstract string", "edges": "citing_id bigint, cited_id bigint",
    "contexts": "citing_id bigint, cited_id bigint, purpose string, section string", "authors": "author_id bigint, canonical_name string", "paper_authors": "paper_id bigint, author_id bigint",
}


@query("schema_listing", "SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{c.split()[0]}', '{c.split()[1]}', CAST({k} AS INTEGER))" for t, cols in _LISTED.items() for k, c in enumerate(cols.split(", "))) + ") v(table_name, column_name, data_type, position)")
def schema_listing(spark, d):
    return lookup.schema_listing({n: getattr(C, n)(spark, d) for n in ("papers", "edges", "contexts", "authors", "paper_authors")}).drop("nullable")


@query("sql_passthrough", with_views("papers") + " SELECT type, count(*) AS n, min(year) AS first_year FROM papers GROUP BY type HAVING count(*) > 1")
def sql_passthrough(spark, d):
    return lookup.sql(spark, {"papers": C.papers(spark, d)}, "SELECT type, count(*) AS n, min(year) AS first_year FROM papers GROUP BY type HAVING n > 1")


# Graph.
@query(
    "co_cited_pairs",
    with_views("papers", "edges")
    + """, top AS (SELECT a.cited_id AS cited_a, b.cited_id AS cited_b, count(*) AS n_citers FROM edges a JOIN edges b ON a.citing_id = b.citing_id
  WHERE a.cited_id < b.cited_id GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY 3 DESC, 1, 2 LIMIT 20)
SELECT cited_a, cited_b, n_citers, p.title AS title_a, q.title AS title_b FROM top JOIN papers p ON p.paper_id = cited_a JOIN papers q ON q.paper_id = cited_b""",
)
def co_cited_pairs(spark, d):
    return graph.co_cited_pairs(C.edges(spark, d), C.papers(spark, d))


def _overlap_sql(near: str, far: str, seeds: str, name: str, least: int) -> str:
    return with_views("edges") + f""" SELECT e.{far} AS paper_id, count(DISTINCT e.{near}) AS {name} FROM edges e JOIN edges m ON e.{near} = m.{near}
WHERE m.{far} IN ({seeds}) AND e.{far} NOT IN ({seeds}) GROUP BY 1 HAVING count(DISTINCT m.{far}) = {len(seeds.split(','))} AND count(DISTINCT e.{near}) >= {least} ORDER BY 2 DESC, 1 LIMIT 20"""


@query("co_cited_single", _overlap_sql("citing_id", "cited_id", "42", "n_citers", 1))
def co_cited_single(spark, d):
    return graph.co_cited(C.edges(spark, d), [42], min_count=1)


@query("co_cited_multi", _overlap_sql("citing_id", "cited_id", "42, 43", "n_citers", 1))
def co_cited_multi(spark, d):
    return graph.co_cited(C.edges(spark, d), [42, 43], min_count=1)


@query("bib_coupling_single", _overlap_sql("cited_id", "citing_id", "42", "n_shared", 1))
def bib_coupling_single(spark, d):
    return graph.bib_coupling(C.edges(spark, d), [42], min_count=1)


@query("bib_coupling_multi", _overlap_sql("cited_id", "citing_id", "10, 11", "n_shared", 1))
def bib_coupling_multi(spark, d):
    return graph.bib_coupling(C.edges(spark, d), [10, 11], min_count=1)


@query("common_citers", with_views("edges") + ", best AS (SELECT cited_id FROM edges GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 2) SELECT citing_id AS paper_id FROM edges WHERE cited_id IN (SELECT cited_id FROM best) GROUP BY 1 HAVING count(DISTINCT cited_id) = 2")
def common_citers(spark, d):
    e = C.edges(spark, d)
    best = [r.paper_id for r in lookup.top(lookup.cited_by_counts(e), "cited_by_count", "paper_id", 2).collect()]
    return graph.common_citers(e, best)


@query("shared_refs", with_views("edges") + ", best AS (SELECT citing_id FROM edges GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 2) SELECT cited_id AS paper_id FROM edges WHERE citing_id IN (SELECT citing_id FROM best) GROUP BY 1 HAVING count(DISTINCT citing_id) = 2")
def shared_refs(spark, d):
    e = C.edges(spark, d)
    best = [r.citing_id for r in e.groupBy("citing_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "citing_id").limit(2).collect()]
    return graph.shared_refs(e, best)


@query("shared_papers", with_views("paper_authors") + " SELECT paper_id FROM paper_authors WHERE author_id IN (1, 2) GROUP BY 1 HAVING count(DISTINCT author_id) = 2")
def shared_papers(spark, d):
    return graph.shared_papers(C.paper_authors(spark, d), [1, 2])


@query("coauthors", with_views("paper_authors") + " SELECT b.author_id, count(DISTINCT b.paper_id) AS n_shared FROM paper_authors a JOIN paper_authors b USING (paper_id) WHERE a.author_id = 3 AND b.author_id <> 3 GROUP BY 1")
def coauthors(spark, d):
    return graph.coauthors(C.paper_authors(spark, d), 3)


def _chain_sql(depth: int) -> str:
    return with_views("edges", recursive=True) + f""", chain AS (SELECT citing_id, 1 AS depth FROM edges WHERE cited_id = 42
UNION SELECT e.citing_id, c.depth + 1 FROM edges e JOIN chain c ON e.cited_id = c.citing_id WHERE c.depth < {depth}) SELECT DISTINCT citing_id, depth FROM chain"""


@query("chain_depth2", _chain_sql(2))
def chain_depth2(spark, d):
    return graph.chain(C.edges(spark, d), 42, 2)


@query("chain_depth3", _chain_sql(3))
def chain_depth3(spark, d):
    return graph.chain(C.edges(spark, d), 42, 3)


@query(
    "components",
    "SELECT doc_id AS node, min(doc_id) OVER (PARTITION BY text) AS root FROM documents QUALIFY count(*) OVER (PARTITION BY text) > 1",
)
def components(spark, d):
    """Duplicate groups of exact texts, as components of a chain of neighbours in each group."""
    from pyspark.sql import Window

    docs = C.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    link = docs.withColumn("next", F.lead("doc_id").over(Window.partitionBy("h").orderBy("doc_id"))).filter("next is not null")
    return graph.components(link, "doc_id", "next")


ITERATIONS = 8


def _rank_sql(kind: str, seeds: str | None, edges: str = "SELECT citing_id, cited_id FROM edges") -> str:
    flip = "SELECT cited_id AS citing_id, citing_id AS cited_id FROM raw"
    e = {"directed": "SELECT DISTINCT * FROM raw", "reverse": f"SELECT DISTINCT * FROM ({flip})", "undirected": f"SELECT * FROM raw UNION {flip}"}[kind]
    p = f"CASE WHEN paper_id IN ({seeds}) THEN 1.0 / {len(seeds.split(','))} ELSE 0.0 END" if seeds else "1.0 / (SELECT count(*) FROM papers)"
    steps = [f"s0 AS MATERIALIZED (SELECT paper_id, CAST({p} AS DOUBLE) AS score, CAST({p} AS DOUBLE) AS p FROM papers)"]
    for i in range(ITERATIONS):
        steps.append(f"""s{i + 1} AS MATERIALIZED (SELECT s.paper_id, ((SELECT coalesce(sum(score), 0) FROM s{i} WHERE paper_id NOT IN (SELECT citing_id FROM o)) + 0.15) * s.p + 0.85 * coalesce(g.got, 0) AS score, s.p
FROM s{i} s LEFT JOIN (SELECT e.cited_id, sum(u.score / o.n) AS got FROM e JOIN s{i} u ON u.paper_id = e.citing_id JOIN o ON o.citing_id = e.citing_id GROUP BY 1) g ON g.cited_id = s.paper_id)""")
    return with_views("papers", "edges") + f""", raw AS ({edges}), e AS MATERIALIZED ({e}), o AS MATERIALIZED (SELECT citing_id, count(*) AS n FROM e GROUP BY 1),
{', '.join(steps)} SELECT paper_id, round(score, 7) AS score FROM s{ITERATIONS}"""


def _rank(spark, d, kind="directed", seeds=None, edges=None):
    found = centrality.pagerank(C.papers(spark, d), C.edges(spark, d) if edges is None else edges, kind, seeds, max_iter=ITERATIONS, tol=0)
    return found.select("paper_id", F.round("score", 7).alias("score"))


@query("pagerank", _rank_sql("directed", None))
def pagerank(spark, d):
    return _rank(spark, d)


@query("pagerank_reverse", _rank_sql("reverse", None))
def pagerank_reverse(spark, d):
    return _rank(spark, d, "reverse")


@query("pagerank_undirected", _rank_sql("undirected", None))
def pagerank_undirected(spark, d):
    return _rank(spark, d, "undirected")


@query("pagerank_seeded", _rank_sql("directed", "3, 6, 42"))
def pagerank_seeded(spark, d):
    return _rank(spark, d, seeds=[3, 6, 42])


@query("pagerank_owned_citers", _rank_sql("directed", None, "SELECT citing_id, cited_id FROM edges JOIN papers ON paper_id = citing_id WHERE type = 'owned'"))
def pagerank_owned_citers(spark, d):
    """What owned papers cite alone: all others cite nothing, so their mass is given out anew."""
    own = C.papers(spark, d).filter("type = 'owned'").select(F.col("paper_id").alias("citing_id"))
    return _rank(spark, d, edges=C.edges(spark, d).join(own, "citing_id", "left_semi"))


def _katz_sql(seeds: str | None) -> str:
    base = f"CASE WHEN paper_id IN ({seeds}) THEN 1.0 ELSE 0.0 END" if seeds else "1.0"
    steps = [f"s0 AS MATERIALIZED (SELECT paper_id, CAST({base} AS DOUBLE) AS score, CAST({base} AS DOUBLE) AS b FROM papers)"]
    for i in range(ITERATIONS):
        steps.append(f"s{i + 1} AS MATERIALIZED (SELECT s.paper_id, s.b + (SELECT a FROM alpha) * coalesce(g.got, 0) AS score, s.b FROM s{i} s LEFT JOIN (SELECT e.cited_id, sum(u.score) AS got FROM edges e JOIN s{i} u ON u.paper_id = e.citing_id GROUP BY 1) g ON g.cited_id = s.paper_id)")
    return with_views("papers", "edges") + f", alpha AS (SELECT 0.5 / max(n) AS a FROM (SELECT count(*) AS n FROM edges GROUP BY cited_id)), {', '.join(steps)} SELECT paper_id, round(score, 7) AS score FROM s{ITERATIONS}"


@query("katz", _katz_sql(None))
def katz(spark, d):
    return centrality.katz(C.papers(spark, d), C.edges(spark, d), max_iter=ITERATIONS, tol=0).select("paper_id", F.round("score", 7).alias("score"))


@query("katz_seeded", _katz_sql("3, 6, 42"))
def katz_seeded(spark, d):
    return centrality.katz(C.papers(spark, d), C.edges(spark, d), seeds=[3, 6, 42], max_iter=ITERATIONS, tol=0).select("paper_id", F.round("score", 7).alias("score"))


@query("centrality_ranked", _rank_sql("directed", None).replace("SELECT paper_id, round(score, 7) AS score FROM", "SELECT row_number() OVER (ORDER BY score DESC, paper_id) AS rank, paper_id, title, round(score, 7) AS score FROM") + " JOIN papers USING (paper_id) WHERE type IN ('owned', 'external_owned') ORDER BY score DESC, paper_id LIMIT 15")
def centrality_ranked(spark, d):
    scores = centrality.pagerank(C.papers(spark, d), C.edges(spark, d), max_iter=ITERATIONS, tol=0)
    found = centrality.ranked(scores, C.papers(spark, d), 15, ["owned", "external_owned"], 7)
    return found.select(F.col("rank").cast("long").alias("rank"), "paper_id", "title", "score")


# Search.
TERMS = "('the', 'of', 'and')"
TOKENS_SQL = "SELECT {key} AS id, unnest(regexp_split_to_array(lower({text}), '[^a-z]+')) AS term FROM {table}"


def _bm25_sql(key: str, text: str, table: str, terms: list[str], tail: str) -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""WITH t AS ({TOKENS_SQL.format(key=key, text=text, table=table)}), l AS (SELECT id, count(*) AS len FROM t WHERE term <> '' GROUP BY 1),
c AS (SELECT count(*) AS n, (SELECT sum(len) FROM l) / count(*) AS average FROM {table}),
f AS (SELECT id, term, count(*) AS tf FROM t WHERE term IN ({listed}) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM f GROUP BY 1),
s AS (SELECT id, sum(log10((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / average))) AS score FROM f JOIN df USING (term) JOIN l USING (id) CROSS JOIN c GROUP BY 1)
{tail}"""


@query("bm25_search", _bm25_sql("doc_id", "text", "documents", ["the", "of", "and"], "SELECT id AS doc_id, round(score, 6) AS score FROM s ORDER BY round(s.score, 9) DESC, id LIMIT 15"))
def bm25_search(spark, d):
    return search.search(C.table(spark, d, "documents"), "doc_id", ["text"], "The of and", 15).select("doc_id", F.round("score", 6).alias("score"))


@query("bm25_count", _bm25_sql("doc_id", "text", "documents", ["les", "und"], "SELECT count(*) AS n FROM s"))
def bm25_count(spark, d):
    return search.bm25(C.table(spark, d, "documents"), "doc_id", ["text"], "les und").agg(F.count("*").alias("n"))


@query("bm25_filtered", _bm25_sql("doc_id", "text", "documents", ["the", "that"], "SELECT id AS doc_id, round(score, 6) AS score FROM s JOIN documents ON doc_id = id WHERE source = 'src3' ORDER BY round(s.score, 9) DESC, id LIMIT 15"))
def bm25_filtered(spark, d):
    found = search.search(C.table(spark, d, "documents"), "doc_id", ["text"], "the that", 15, keep=F.col("source") == "src3")
    return found.select("doc_id", F.round("score", 6).alias("score"))


# The words of three stems; the general stemmer is tested on the published examples.
@query("bm25_stemmed", _bm25_sql("doc_id", "text", "documents", ["and", "nation", "thing"], "SELECT id AS doc_id, round(score, 6) AS score FROM s ORDER BY round(s.score, 9) DESC, id LIMIT 15").replace("regexp_split_to_array(lower(text), '[^a-z]+')", r"list_transform(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: regexp_replace(x, '^(and|nation|thing)(s|e|es|ed|ing)$', '\1'))"))
def bm25_stemmed(spark, d):
    return search.search(C.table(spark, d, "documents"), "doc_id", ["text"], "nations and things", 15, stem=True).select("doc_id", F.round("score", 6).alias("score"))


@query(
    "search_all_counts",
    """SELECT 'documents' AS source, count(*) AS n FROM documents WHERE list_has_any(regexp_split_to_array(lower(text), '[^a-z]+'), ['the', 'les'])
UNION ALL SELECT 'conversations', count(*) FROM conversations WHERE list_has_any(regexp_split_to_array(lower(text), '[^a-z]+'), ['the', 'les'])
UNION ALL SELECT 'parts', count(*) FROM part WHERE list_has_any(regexp_split_to_array(lower(p_name), '[^a-z]+'), ['the', 'les'])""",
)
def search_all_counts(spark, d):
    return search.counts({"documents": (C.table(spark, d, "documents"), ["text"]), "conversations": (C.table(spark, d, "conversations"), ["text"]), "parts": (C.table(spark, d, "part"), ["p_name"])}, "the les")


@query("search_sections", _bm25_sql("conv_id * 1000 + turn", "text", "conversations", ["la", "que"], "SELECT id, round(score, 6) AS score FROM s ORDER BY round(s.score, 9) DESC, id LIMIT 10"))
def search_sections(spark, d):
    rows = C.table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return search.search(rows, "id", ["text"], "la que", 10).select("id", F.round("score", 6).alias("score"))


@query("search_claims", _bm25_sql("id", "text", "(SELECT conv_id * 1000 + turn AS id, text FROM conversations WHERE role = 'assistant')", ["the", "que"], "SELECT id, round(score, 6) AS score FROM s ORDER BY round(s.score, 9) DESC, id LIMIT 15"))
def search_claims(spark, d):
    rows = C.table(spark, d, "conversations").filter("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return search.search(rows, "id", ["text"], "que the", 15).select("id", F.round("score", 6).alias("score"))


@query("search_topics", _bm25_sql("p_partkey", "p_type", "part", ["economy", "brass"], "SELECT id AS paper_id, round(score, 6) AS score FROM s ORDER BY round(s.score, 9) DESC, id LIMIT 15"))
def search_topics(spark, d):
    rows = C.topics(spark, d).filter("field = 'type'").select("paper_id", "value")
    return search.search(rows, "paper_id", ["value"], "Economy brass", 15).select("paper_id", F.round("score", 6).alias("score"))


@query("search_keywords", _bm25_sql("p_partkey", "p_name || ' ' || p_brand", "part", ["brand", "large"], "SELECT id AS paper_id, round(score, 6) AS score FROM s ORDER BY round(s.score, 9) DESC, id LIMIT 15"))
def search_keywords(spark, d):
    return search.search(C.papers(spark, d), "paper_id", ["title", "journal"], "brand large", 15).select("paper_id", F.round("score", 6).alias("score"))


@query("search_authors_fallback", "SELECT s_suppkey AS author_id, CAST(NULL AS DOUBLE) AS score FROM supplier WHERE contains(lower(s_name), '#00000000') ORDER BY 1 LIMIT 20")
def search_authors_fallback(spark, d):
    return search.search_or_contains(C.authors(spark, d), "author_id", ["canonical_name"], "#00000000")


@query("ilike_fallback", "SELECT p_partkey AS paper_id FROM part WHERE contains(lower(p_name), 'red_') OR contains(lower(p_brand), 'brand#2')")
def ilike_fallback(spark, d):
    return search.contains_any(C.papers(spark, d), ["title", "journal"], "Brand#2").unionByName(search.contains_any(C.papers(spark, d), ["title", "journal"], "red_")).select("paper_id").distinct()


@query(
    "snippet",
    """WITH h AS (SELECT doc_id, text, instr(lower(text), 'the') AS pos, length(text) AS n FROM documents),
s AS (SELECT *, greatest(pos - 40, 1) AS a, least(pos + 43, n + 1) AS b FROM h)
SELECT doc_id, CASE WHEN pos > 0 THEN (CASE WHEN a > 1 THEN '...' ELSE '' END) || substring(text, a, b - a) || (CASE WHEN b <= n THEN '...' ELSE '' END)
  WHEN n > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS snippet FROM s""",
)
def snippet(spark, d):
    return C.table(spark, d, "documents").select("doc_id", T.snippet(F.col("text"), "the").alias("snippet"))


# Scalars.
@query(
    "scalars",
    """SELECT p_partkey AS paper_id, 'part_' || CAST(p_partkey AS VARCHAR) AS doi_norm, replace(lower(p_name), ' ', '_') AS prefix,
CASE WHEN length(replace(lower(p_name), ' ', '_')) > 8 THEN replace(lower(p_name), ' ', '_') ELSE '' END AS block, CAST(1990 + p_partkey % 35 AS INTEGER) AS year_int,
CASE p_partkey % 4 WHEN 0 THEN 'metadata' WHEN 1 THEN 'contexts' WHEN 2 THEN 'analysis' ELSE 'full' END AS level FROM part""",
)
def scalars(spark, d):
    k = F.col("p_partkey")
    passes = F.slice(F.array(*map(F.lit, [1, 2, 3, 4])), F.lit(1), (k % 4 + 1).cast("int"))
    doi = F.concat(F.when(k % 2 == 0, "https://doi.org/").otherwise("DOI: "), F.lit("Part_"), k.cast("string"))
    year = F.concat(F.lit("c. "), (1990 + k % 35).cast("string"), F.lit(" (rev.)"))
    return C.table(spark, d, "part").select(k.alias("paper_id"), T.normalize_doi(doi).alias("doi_norm"), T.title_prefix(F.col("p_name")).alias("prefix"), T.blocking_prefix(F.col("p_name")).alias("block"), T.safe_year(year).alias("year_int"), T.detail_level(passes).alias("level"))


_LETTERS = ("".join(T.LETTERS.values()), "".join(k * len(v) for k, v in T.LETTERS.items()))


# RE2 has no lookaround: stops beside a digit are set aside first.
@query(
    "normalize_title",
    rf"""WITH a AS (SELECT doc_id, translate(replace(text, 'ß', 'ss'), '{_LETTERS[0]}', '{_LETTERS[1]}') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(replace(regexp_replace(t, '([0-9]+(\.[0-9]+)?)\s*°\s*([CcFfKk])', '\1\3', 'g'), '-', ' '), '[^\p{{L}}\p{{N}}_\s.]', ' ', 'g') AS t FROM a),
c AS (SELECT doc_id, replace(replace(regexp_replace(regexp_replace(t, '([0-9])\.', '\1' || chr(1), 'g'), '\.([0-9])', chr(1) || '\1', 'g'), '.', ' '), chr(1), '.') AS t FROM b)
SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(lower(t), '\s+'), lambda w: w <> '' AND w NOT IN ({", ".join(f"'{w}'" for w in T.TITLE_STOP_WORDS)})), ' ') AS title FROM c""",
)
def normalize_title(spark, d):
    return C.table(spark, d, "documents").select("doc_id", T.normalize_title(F.col("text")).alias("title"))


@query("first_author_key", "SELECT s_suppkey AS author_id, 'supplier' AS key FROM supplier")
def first_author_key(spark, d):
    name = F.concat(F.regexp_replace("canonical_name", "#", "-"), F.lit(", A.; Other, B."))
    return C.authors(spark, d).select("author_id", T.first_author_key(name).alias("key"))


@query(
    "jaccard_cites",
    with_views("edges")
    + """, s AS (SELECT citing_id, count(*) AS n FROM edges GROUP BY 1), i AS (SELECT a.citing_id AS id_a, b.citing_id AS id_b, count(*) AS shared FROM edges a JOIN edges b ON a.cited_id = b.cited_id AND a.citing_id < b.citing_id GROUP BY 1, 2)
SELECT id_a, id_b, round(shared / (x.n + y.n - shared), 6) AS jaccard FROM i JOIN s x ON x.citing_id = id_a JOIN s y ON y.citing_id = id_b WHERE shared / (x.n + y.n - shared) >= 0.05""",
)
def jaccard_cites(spark, d):
    return graph.reference_overlap(C.edges(spark, d), 0.05).select("id_a", "id_b", F.round("jaccard", 6).alias("jaccard"))


# Maintenance.
ALIAS_SQL = "SELECT p_partkey AS alias, p_partkey // 3 AS target FROM part WHERE p_size <= 7 AND p_partkey > 0"


@query(
    "alias_remap",
    f"""WITH RECURSIVE a AS ({ALIAS_SQL}), w AS (SELECT alias, target FROM a UNION SELECT w.alias, a.target FROM w JOIN a ON w.target = a.alias)
SELECT alias, target FROM w WHERE target NOT IN (SELECT alias FROM a)""",
)
def alias_remap(spark, d):
    return maintain.alias_closure(C.aliases(spark, d))


REMAP_CTE = f", a AS ({ALIAS_SQL}), w AS (SELECT alias, target FROM a UNION SELECT w.alias, a.target FROM w JOIN a ON w.target = a.alias), m AS (SELECT alias, target FROM w WHERE target NOT IN (SELECT alias FROM a))"


@query(
    "rewrite_refs",
    with_views("edges", recursive=True) + REMAP_CTE + """ SELECT DISTINCT coalesce(x.target, citing_id) AS citing_id, coalesce(y.target, cited_id) AS cited_id FROM edges LEFT JOIN m x ON x.alias = citing_id LEFT JOIN m y ON y.alias = cited_id
WHERE coalesce(x.target, citing_id) <> coalesce(y.target, cited_id)""",
)
def rewrite_refs(spark, d):
    return maintain.remapped(C.edges(spark, d), maintain.alias_closure(C.aliases(spark, d)))


SIDES = "cites AS (SELECT DISTINCT citing_id, cited_id FROM contexts WHERE section <> 'R'), cited_by AS (SELECT DISTINCT citing_id, cited_id FROM contexts WHERE purpose <> '5-LOW')"
SIDES_SQL = f", {SIDES}, active AS (SELECT paper_id FROM papers WHERE type <> 'external_owned'), bidi AS (SELECT * FROM (SELECT * FROM cites UNION SELECT * FROM cited_by) WHERE citing_id <> cited_id AND citing_id IN (SELECT paper_id FROM active) AND cited_id IN (SELECT paper_id FROM active))"


def _sides(spark, d):
    return *C.sides(spark, d), C.papers(spark, d).filter("type <> 'external_owned'")


@query("bidi_repair", with_views("papers", "contexts") + SIDES_SQL + " SELECT citing_id, cited_id FROM bidi")
def bidi_repair(spark, d):
    return maintain.bidirectional(*_sides(spark, d))


@query("edges_added", with_views("papers", "contexts") + SIDES_SQL + " SELECT 'cites' AS side, count(*) AS n FROM (SELECT * FROM bidi EXCEPT SELECT * FROM cites) UNION ALL SELECT 'cited_by', count(*) FROM (SELECT * FROM bidi EXCEPT SELECT * FROM cited_by)")
def edges_added(spark, d):
    return maintain.edges_added(*_sides(spark, d))


@query(
    "check_violations",
    with_views("papers", "contexts")
    + f", {SIDES}"
    + """, gone AS (SELECT paper_id FROM papers WHERE year = 1995 AND paper_id > 5)
SELECT 'error' AS severity, 'cites without cited_by' AS rule, count(*) AS n FROM (SELECT * FROM cites EXCEPT SELECT * FROM cited_by) WHERE citing_id NOT IN (FROM gone) AND cited_id NOT IN (FROM gone)
UNION ALL SELECT 'error', 'cited_by without cites', count(*) FROM (SELECT * FROM cited_by EXCEPT SELECT * FROM cites) WHERE citing_id NOT IN (FROM gone) AND cited_id NOT IN (FROM gone)
UNION ALL SELECT 'error', 'cites a superseded paper', count(DISTINCT citing_id) FROM cites WHERE citing_id NOT IN (FROM gone) AND cited_id IN (FROM gone)""",
)
def check_violations(spark, d):
    found = maintain.check(C.paper_documents(spark, d))
    return found.groupBy("severity", "rule").agg(F.count("*").alias("n"))


CTX_SQL = "SELECT DISTINCT citing_id, cited_id, purpose, section FROM contexts"


@query("context_counts", with_views("contexts") + " SELECT cited_id, purpose, count(*) AS n, count(DISTINCT citing_id) AS n_citers FROM contexts GROUP BY 1, 2")
def context_counts(spark, d):
    return C.contexts(spark, d).groupBy("cited_id", "purpose").agg(F.count("*").alias("n"), F.count_distinct("citing_id").alias("n_citers"))


@query(
    "context_dedup_first",
    with_views("contexts") + f", c AS ({CTX_SQL}), mine AS (SELECT * FROM c WHERE citing_id % 2 = 0) SELECT citing_id, cited_id, purpose, section FROM c WHERE NOT EXISTS (SELECT 1 FROM mine m WHERE m.citing_id = c.citing_id AND m.cited_id = c.cited_id) QUALIFY row_number() OVER (PARTITION BY citing_id, cited_id ORDER BY purpose || section) = 1",
)
def context_dedup_first(spark, d):
    c = C.contexts(spark, d).distinct().withColumn("ordinal", F.concat("purpose", "section"))
    return maintain.new_contexts(c.filter("citing_id % 2 = 0"), c, "ordinal").select("citing_id", "cited_id", "purpose", "section")


@query(
    "corpus_import",
    """WITH l AS (SELECT p_partkey AS k, p_name AS title, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS journal, CASE WHEN p_size % 2 = 0 THEN 'owned' ELSE 'stub' END AS type FROM part WHERE p_partkey % 4 <> 0),
o AS (SELECT p_partkey AS k, p_name AS title, p_brand AS journal, CASE WHEN p_size % 3 = 0 THEN 'owned' ELSE 'stub' END AS type FROM part WHERE p_partkey % 5 <> 0)
SELECT coalesce(l.k, o.k) AS paper_id, coalesce(l.title, o.title) AS title, CASE WHEN l.k IS NULL OR (l.journal = '' AND o.k IS NOT NULL) THEN o.journal ELSE l.journal END AS journal,
CASE WHEN l.k IS NULL THEN (CASE WHEN o.type = 'owned' THEN 'external_owned' ELSE o.type END) WHEN l.type = 'stub' AND o.type = 'owned' THEN 'external_owned' ELSE l.type END AS type,
CASE WHEN l.k IS NULL THEN 'add' WHEN o.k IS NULL THEN 'keep' ELSE 'enrich' END AS action FROM l FULL OUTER JOIN o ON l.k = o.k""",
)
def corpus_import(spark, d):
    p = C.table(spark, d, "part")
    one = lambda keep, journal, kind: p.filter(keep).select(F.col("p_partkey").alias("paper_id"), F.col("p_name").alias("title"), journal.alias("journal"), F.when(kind, "owned").otherwise("stub").alias("type"))
    local = one("p_partkey % 4 <> 0", F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_brand")), F.col("p_size") % 2 == 0)
    other = one("p_partkey % 5 <> 0", F.col("p_brand"), F.col("p_size") % 3 == 0)
    return maintain.imported(local, other, ["title", "journal"])


@query(
    "snapshot_changes",
    """SELECT p_partkey AS paper_id, CASE WHEN p_partkey % 7 = 0 THEN 'add' WHEN p_partkey % 5 = 0 THEN 'remove' ELSE 'replace' END AS operation FROM part WHERE p_partkey % 7 = 0 AND p_partkey % 5 <> 0 OR p_partkey % 5 = 0 AND p_partkey % 7 <> 0 OR p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 3 = 0""",
)
def snapshot_changes(spark, d):
    p = C.papers(spark, d).select("paper_id", "title")
    old = p.filter("paper_id % 7 <> 0")
    new = p.filter("paper_id % 5 <> 0").withColumn("title", F.when(F.col("paper_id") % 3 == 0, F.upper("title")).otherwise(F.col("title")))
    return store.changes(old, new, "paper_id").select("paper_id", "operation")


@query("upsert", "SELECT p_partkey AS paper_id, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS title FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0")
def upsert(spark, d):
    p = C.papers(spark, d).select("paper_id", "title")
    return store.upserted(p.filter("paper_id % 2 = 0"), p.filter("paper_id % 3 = 0").withColumn("title", F.upper("title")), "paper_id")


@query(
    "external_ids_patch",
    "SELECT p_partkey AS paper_id, CASE WHEN p_partkey % 2 = 0 THEN 'kept' WHEN p_partkey % 3 = 0 THEN 'S' || CAST(p_partkey AS VARCHAR) ELSE '' END AS s2_id FROM part",
)
def external_ids_patch(spark, d):
    p = C.papers(spark, d).select("paper_id", F.when(F.col("paper_id") % 2 == 0, "kept").otherwise("").alias("s2_id"))
    found = p.filter("paper_id % 3 = 0").select("paper_id", F.concat(F.lit("S"), F.col("paper_id").cast("string")).alias("s2_id"))
    return store.filled(p, found, "paper_id", ["s2_id"])


@query(
    "merge_plan_errors",
    """WITH p AS (SELECT p_partkey AS c, p_partkey * 2 AS a FROM part) SELECT 'unknown id' AS rule, CAST(a AS VARCHAR) AS id FROM p WHERE a NOT IN (SELECT c FROM p)
UNION ALL SELECT 'alias is canonical elsewhere', CAST(a AS VARCHAR) FROM p WHERE a IN (SELECT c FROM p) UNION ALL SELECT 'alias is canonical of its own group', CAST(a AS VARCHAR) FROM p WHERE a = c""",
)
def merge_plan_errors(spark, d):
    plan = C.papers(spark, d).select(F.col("paper_id").alias("canonical_id"), (F.col("paper_id") * 2).alias("alias_id"))
    return maintain.valid_merges(plan, C.papers(spark, d))


# Authors.
NAMES_SQL = "SELECT l_partkey AS paper_id, 'Name' || CAST(l_suppkey % 40 AS VARCHAR) || ', ' || CASE l_suppkey % 3 WHEN 0 THEN 'A.' WHEN 1 THEN 'Anna B.' ELSE 'C. D.' END AS name FROM lineitem"


@query(
    "author_groups",
    f"""WITH n AS ({NAMES_SQL}), k AS (SELECT paper_id, name, lower(split_part(name, ',', 1)) AS last, CASE WHEN name LIKE '%Anna%' THEN 'ab' WHEN name LIKE '%A.' THEN 'a' ELSE 'cd' END AS i FROM n),
g AS (SELECT *, last || '_' || CASE WHEN i = 'a' AND last IN (SELECT last FROM k WHERE i = 'ab') THEN 'ab' ELSE i END AS grp FROM k)
SELECT grp AS "group", count(DISTINCT paper_id) AS paper_count, string_agg(DISTINCT name, '|' ORDER BY name) AS name_variants FROM g GROUP BY 1""",
)
def author_groups(spark, d):
    return A.person_groups(C.author_names(spark, d)).select("group", "paper_count", "name_variants")


@query(
    "author_prefix_merge",
    f"""WITH n AS ({NAMES_SQL}), k AS (SELECT DISTINCT lower(split_part(name, ',', 1)) AS last, CASE WHEN name LIKE '%Anna%' THEN 'ab' WHEN name LIKE '%A.' THEN 'a' ELSE 'cd' END AS i FROM n)
SELECT last || '_' || i AS key, last || '_' || CASE WHEN i = 'a' AND last IN (SELECT last FROM k WHERE i = 'ab') THEN 'ab' ELSE i END AS "group" FROM k""",
)
def author_prefix_merge(spark, d):
    return A.merged_keys(A.parsed(C.author_names(spark, d)).filter("key is not null"))


@query(
    "coauthor_links",
    """WITH s AS (SELECT l_orderkey AS author_id, list_sort(list(DISTINCT l_suppkey % 10)) AS papers FROM lineitem GROUP BY 1), c AS (SELECT papers, min(author_id) AS class_id, count(*) AS size FROM s GROUP BY 1)
SELECT * FROM (SELECT a.class_id AS class_a, b.class_id AS class_b, len(list_intersect(a.papers, b.papers)) AS n, CASE WHEN a.class_id = b.class_id THEN a.size * (a.size - 1) // 2 ELSE a.size * b.size END AS pairs FROM c a JOIN c b ON a.class_id <= b.class_id) WHERE n > 0 AND pairs > 0""",
)
def coauthor_links(spark, d):
    """Papers of very many authors: each order an author of what a tenth of the suppliers wrote."""
    wrote = C.table(spark, d, "lineitem").select((F.col("l_suppkey") % 10).alias("paper_id"), F.col("l_orderkey").alias("author_id"))
    return A.coauthor_links(wrote, store.cut(A.coauthor_classes(wrote)))


@query("all_coauthors", with_views("paper_authors") + " SELECT a.author_id, b.author_id AS coauthor_id, count(*) AS n FROM paper_authors a JOIN paper_authors b USING (paper_id) WHERE a.author_id <> b.author_id GROUP BY 1, 2")
def all_coauthors(spark, d):
    return A.all_coauthors(C.paper_authors(spark, d))


# Findings and composites.
FINDINGS_SQL = "SELECT DISTINCT l_orderkey AS finding_id, l_partkey AS paper_id FROM lineitem"


@query("findings_missing", with_views("papers") + f" SELECT paper_id, count(DISTINCT finding_id) AS n_findings FROM ({FINDINGS_SQL}) WHERE paper_id NOT IN (SELECT paper_id FROM papers WHERE type <> 'stub') GROUP BY 1")
def findings_missing(spark, d):
    return findings.missing(findings.finding_papers(C.findings(spark, d)), C.papers(spark, d))


@query("findings_overlap", f"WITH f AS ({FINDINGS_SQL}) SELECT a.finding_id AS finding_a, b.finding_id AS finding_b, count(*) AS n_shared FROM f a JOIN f b ON a.paper_id = b.paper_id AND a.finding_id < b.finding_id GROUP BY 1, 2 HAVING count(*) >= 2")
def findings_overlap(spark, d):
    return findings.overlaps(findings.finding_papers(C.findings(spark, d)).select("finding_id", "paper_id"))


@query("findings_tags", "SELECT o_orderpriority AS tag, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1")
def findings_tags(spark, d):
    return findings.tag_counts(C.findings(spark, d).select(F.explode("tags").alias("tag")))


@query("findings_for_paper", f"SELECT finding_id, 'Order ' || CAST(finding_id AS VARCHAR) AS title FROM ({FINDINGS_SQL}) WHERE paper_id = 42")
def findings_for_paper(spark, d):
    return findings.for_paper(C.findings(spark, d), 42)


@query("findings_flags", with_views("papers") + f" SELECT finding_id, paper_id, type IS NOT NULL AS in_db, coalesce(type <> 'stub', FALSE) AS owned FROM ({FINDINGS_SQL}) LEFT JOIN papers USING (paper_id)")
def findings_flags(spark, d):
    return findings.with_flags(findings.finding_papers(C.findings(spark, d)).select("finding_id", "paper_id"), C.papers(spark, d))


@query(
    "explore_grouped",
    with_views("papers", "contexts")
    + """, c AS (SELECT cited_id, title, year, citing_id, purpose, section FROM contexts JOIN papers ON paper_id = cited_id WHERE type <> 'stub' AND purpose = '2-HIGH'),
r AS (SELECT *, row_number() OVER (PARTITION BY cited_id ORDER BY citing_id, purpose, section) AS r FROM c),
t AS (SELECT cited_id, title, year, count(*) AS appearances, string_agg(DISTINCT purpose, ',' ORDER BY purpose) AS purposes, string_agg(CAST(citing_id AS VARCHAR) || ':' || purpose || ':' || section, ';' ORDER BY r) FILTER (r <= 5) AS shown FROM r GROUP BY 1, 2, 3)
SELECT cited_id AS paper_id, title, year, appearances, purposes, shown FROM t ORDER BY appearances DESC, cited_id LIMIT 50""",
)
def explore_grouped(spark, d):
    return findings.explore(C.contexts(spark, d), C.papers(spark, d), owned_only=True, purpose="2-HIGH")


@query(
    "event_counts",
    "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
)
def event_counts(spark, d):
    return incremental.event_counts(C.table(spark, d, "events")).withColumn("total", F.round("total", 4))


# Ingest.
@query("coverage", "SELECT 'doi' AS name, count(*) AS n FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'title', count(*) FROM part UNION ALL SELECT 'server:' || CASE WHEN p_partkey % 3 = 0 THEN 'arxiv' ELSE 'ssrn' END, count(*) FROM part WHERE p_partkey % 3 < 2 GROUP BY 1")
def coverage(spark, d):
    k = F.col("paper_id")
    p = C.keyed_papers(spark, d).withColumn("preprint_server", T.preprint_server(F.when(k % 3 == 0, "a"), F.when(k % 3 == 1, "10.2139/SSRN.1"), F.lit(None).cast("string")))
    return ingest.coverage(p, ["doi", "title"])


@query("fetch_targets", with_views("papers") + " SELECT paper_id FROM papers WHERE type IN ('owned', 'external_owned') OR type = 'stub' AND paper_id % 2 = 0")
def fetch_targets(spark, d):
    p = C.papers(spark, d).withColumn("doi", F.when(F.col("paper_id") % 2 == 0, F.col("doi")))
    return ingest.fetch_targets(p, "citations")


@query(
    "text_stages",
    """SELECT CAST(p_partkey AS VARCHAR) AS stem, CASE WHEN p_partkey % 4 = 0 THEN (CASE WHEN p_partkey % 8 = 0 THEN 'done' WHEN p_partkey % 3 = 0 THEN (CASE WHEN p_partkey % 5 = 0 THEN 'done' ELSE 'in_process' END) ELSE 'staging' END)
WHEN p_partkey % 3 = 0 THEN (CASE WHEN p_partkey % 5 = 0 THEN 'done' ELSE 'in_process' END) ELSE 'staging' END AS stage FROM part""",
)
def text_stages(spark, d):
    p = C.table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_partkey").cast("string").alias("stem"))
    papers = p.filter("k % 4 = 0").select(F.col("stem").alias("text_stem"), F.col("stem").alias("paper_id"), (F.col("k") % 8 == 0).alias("has_passes"))
    ex = p.filter("k % 3 = 0").select(F.col("stem").alias("paper_id"), F.lit(None).cast("string").alias("source_stem"), (F.col("k") % 5 == 0).alias("has_meta"))
    return ingest.text_stages(p.select("stem"), papers, ex)


@query("unprocessed", "SELECT CAST(p_partkey AS VARCHAR) AS stem FROM part WHERE p_partkey % 2 <> 0 AND p_partkey % 3 <> 0")
def unprocessed(spark, d):
    p = C.table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_partkey").cast("string").alias("stem"))
    return ingest.unprocessed(p, p.filter("k % 2 = 0"), p.filter("k % 3 = 0"))


@query(
    "merged_topics",
    f"""WITH RECURSIVE a AS ({ALIAS_SQL}), w AS (SELECT alias, target FROM a UNION SELECT w.alias, a.target FROM w JOIN a ON w.target = a.alias), m AS (SELECT alias, target FROM w WHERE target NOT IN (SELECT alias FROM a)),
t AS ({TOPICS_SQL}), r AS (SELECT coalesce(target, paper_id) AS to_id, paper_id, field, value, target IS NULL AS own FROM t LEFT JOIN m ON alias = paper_id)
SELECT to_id AS paper_id, field, value FROM r QUALIFY row_number() OVER (PARTITION BY to_id, field, lower(value) ORDER BY own DESC, paper_id, value) = 1""",
)
def merged_topics(spark, d):
    closure = maintain.alias_closure(C.aliases(spark, d))
    return ingest.merged_rows(C.topics(spark, d), closure, ["field", "value"], ["value"], ["value"])


from citeloom.plans import documents, resolution, structures, upkeep  # noqa: E402, F401  the other families of queries
