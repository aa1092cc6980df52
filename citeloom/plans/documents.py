"""Queries over JSON documents, archives and histories, made of the test tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.plans.registry import query
from citeloom.sources import archive, store
from citeloom.sources import corpus as C
from citeloom.sources import documents as D
from citeloom.sources.corpus import with_views


def _written(files: DataFrame) -> str:
    """The path of JSON texts (file, value), one file for each."""
    path = store.shared_path(files.sparkSession)
    files.select("file", "value").repartition("file").write.partitionBy("file").text(path)
    return path


KEPT = "CASE p_partkey % 3 WHEN 0 THEN 'owned' WHEN 1 THEN 'external_owned' ELSE 'stub' END AS type"
PAPER_DOCS = f"docs AS (SELECT p_partkey AS k, 'p' || CAST(p_partkey AS VARCHAR) AS paper_id, p_name AS title, {KEPT}, p_partkey % 11 = 0 AS gone FROM part)"


@query(
    "json_papers",
    f"""WITH {PAPER_DOCS} SELECT paper_id, type, title, 'Name' || CAST(k % 40 AS VARCHAR) || ', A.; Other, B.' AS authors, CAST(1990 + k % 35 AS INTEGER) AS year,
  CASE k % 4 WHEN 3 THEN 'full' WHEN 2 THEN 'analysis' WHEN 1 THEN 'contexts' ELSE 'metadata' END AS detail_level, substr('1,2,3,4', 1, CAST(2 * (k % 4) + 1 AS BIGINT)) AS passes_completed, CASE WHEN k % 2 = 0 THEN paper_id END AS s2_id FROM docs WHERE NOT gone""",
)
def json_papers(spark, d):
    docs = D.load_papers(spark, _written(C.paper_store(spark, d)))
    return D.papers_table(docs).select("paper_id", "type", "title", "authors", "year", "detail_level", "passes_completed", "s2_id")


@query(
    "json_edges",
    f"""WITH {PAPER_DOCS}, e AS (SELECT paper_id AS citing_id, 'p' || CAST(k + step AS VARCHAR) AS cited_id FROM docs, (VALUES (1), (2)) v(step) WHERE NOT gone)
SELECT citing_id, cited_id, coalesce(title, '') AS cited_title FROM e LEFT JOIN (SELECT paper_id, title FROM docs WHERE NOT gone) ON paper_id = cited_id""",
)
def json_edges(spark, d):
    return D.edges_table(D.load_papers(spark, _written(C.paper_store(spark, d))))


@query("json_citation_counts", f"WITH {PAPER_DOCS} SELECT paper_id, CAST(1 AS INTEGER) AS cited_by_count FROM docs")
def json_citation_counts(spark, d):
    return D.citation_counts(D.load_papers(spark, _written(C.paper_store(spark, d))))


@query("json_contexts", with_views("contexts") + " SELECT CAST(citing_id AS VARCHAR) AS citing_id, CAST(cited_id AS VARCHAR) AS cited_id, purpose, section FROM contexts")
def json_contexts(spark, d):
    return D.contexts_table(spark, _written(C.context_store(spark, d))).select("citing_id", "cited_id", "purpose", "section")


@query(
    "json_extractions",
    """WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS paper_id, * FROM part)
SELECT 'claims' AS relation, paper_id, 0 AS pos, p_name || '|' || p_type || '|["' || paper_id || '","x"]' AS item FROM p
UNION ALL SELECT 'keywords', paper_id, 0, p_brand FROM p UNION ALL SELECT 'keywords', paper_id, 1, p_type FROM p
UNION ALL SELECT 'topics', paper_id, 0, 'themes=' || p_type FROM p UNION ALL SELECT 'topics', paper_id, 0, 'sectors=' || p_brand FROM p UNION ALL SELECT 'topics', paper_id, 0, 'sectors=all' FROM p
UNION ALL SELECT 'sections', paper_id, 0, 'Intro|' || p_name FROM p UNION ALL SELECT 'methodology', paper_id, 0, p_type || '|m' FROM p WHERE p_partkey % 2 = 0
UNION ALL SELECT 'data_sources', paper_id, 0, 'Census ' || paper_id FROM p UNION ALL SELECT 'data_sources', paper_id, 1, 'Survey|panel' FROM p UNION ALL SELECT 'questions', paper_id, 0, 'why ' || paper_id FROM p""",
)
def json_extractions(spark, d):
    """The seven relations of the extractions in one list."""
    t = D.extraction_tables(D.extractions(C.extraction_files(spark, d)))
    shown = {
        "claims": ["claim", "type", "supporting_citations"], "keywords": ["keyword"], "topics": ["field", "value"], "sections": ["heading", "summary"],
        "methodology": ["type", "model_name"], "data_sources": ["name", "type"], "questions": ["question"],
    }
    one = lambda name, cols: t[name].select(F.lit(name).alias("relation"), "paper_id", (F.col("pos") if "pos" in t[name].columns else F.lit(0)).alias("pos"), F.concat_ws("=" if name == "topics" else "|", *cols).alias("item"))
    return reduce(DataFrame.unionByName, [one(name, cols) for name, cols in shown.items()])


@query("json_index_files", "SELECT count(*) AS n, CAST(sum(CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) + count(*) AS n_indexed FROM part")
def json_index_files(spark, d):
    """How many files count as extractions, and how many do for the context index."""
    files = store.cut(C.extraction_files(spark, d))
    return D.extractions(files).agg(F.count("*").alias("n")).crossJoin(D.extractions(files, D.INDEX_SIDECAR).agg(F.count("*").alias("n_indexed")))  # one row each


@query("json_refs", "SELECT CAST(p_partkey AS VARCHAR) AS paper_id, 'c' || CAST(p_partkey + 1 AS VARCHAR) AS id, 'T' AS title, 'A, B.' AS author, '1999' AS year FROM part")
def json_refs(spark, d):
    return D.refs_table(D.extractions(C.extraction_files(spark, d))).select("paper_id", "id", "title", F.element_at("authors", 1).alias("author"), "year")


@query("context_index", "SELECT CAST(p_partkey AS VARCHAR) AS citing, 'c' || CAST(p_partkey + 1 AS VARCHAR) AS cited, 'T' AS cited_title, 'background' AS purpose, 'Intro' AS section, p_name AS quote FROM part")
def context_index(spark, d):
    return D.context_index(D.extractions(C.extraction_files(spark, d))).select("citing", "cited", "cited_title", "purpose", "section", "quote")


@query(
    "sidecar_contexts",
    """WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS paper_id, p_partkey % 5 AS m, p_name AS quote FROM part)
SELECT paper_id, 'c' AS ref, 1 AS chunk, 'first' AS purpose, quote FROM p WHERE m = 0 UNION ALL SELECT paper_id, 'd', 12, 'second', quote FROM p WHERE m = 0
UNION ALL SELECT paper_id, 's', 0, 'single', quote FROM p WHERE m = 1 UNION ALL SELECT paper_id, 'a', 0, 'top', quote FROM p WHERE m = 2 UNION ALL SELECT paper_id, 'b', 0, 'own', quote FROM p WHERE m = 3""",
)
def sidecar_contexts(spark, d):
    return D.sidecar_contexts(C.sidecar_files(spark, d)).select("paper_id", "ref", "chunk", "purpose", "quote")


@query(
    "json_authors",
    """SELECT 's' || CAST(s_suppkey AS VARCHAR) AS author_id, s_name AS canonical_name, 'person' AS type, s_name || '|X' || s_name AS name_variants, CAST(2 AS INTEGER) AS paper_count FROM supplier
UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR), n_name, 'institution', n_name, 1 FROM nation""",
)
def json_authors(spark, d):
    return D.authors_tables(spark, _written(C.author_store(spark, d)))[0].drop("owned_paper_count")


@query("json_paper_authors", "SELECT 'p' || CAST(s_suppkey AS VARCHAR) AS paper_id, 's' || CAST(s_suppkey AS VARCHAR) AS author_id FROM supplier UNION ALL SELECT 'p0', 's' || CAST(s_suppkey AS VARCHAR) FROM supplier UNION ALL SELECT 'p' || CAST(n_nationkey AS VARCHAR), 'n' || CAST(n_nationkey AS VARCHAR) FROM nation")
def json_paper_authors(spark, d):
    return D.authors_tables(spark, _written(C.author_store(spark, d)))[1]


@query("json_findings", "SELECT CAST(l_orderkey AS VARCHAR) AS finding_id, 'Order ' || CAST(l_orderkey AS VARCHAR) AS title, min(o_orderpriority) AS tags, CAST(count(DISTINCT l_partkey) AS INTEGER) AS n_papers FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2")
def json_findings(spark, d):
    return D.findings_of(C.finding_files(spark, d)).select("finding_id", "title", F.array_join("tags", ",").alias("tags"), F.size("papers").alias("n_papers"))


@query("changed_files", "SELECT CAST(p_partkey AS VARCHAR) AS path, CASE WHEN p_partkey % 5 = 0 THEN 'new' WHEN p_partkey % 7 = 0 THEN 'gone' ELSE 'changed' END AS state FROM part WHERE (p_partkey % 5 = 0) <> (p_partkey % 7 = 0) OR p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 3 = 0")
def changed_files(spark, d):
    p = C.table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_partkey").cast("string").alias("path"), F.lit(10).cast("long").alias("mtime"), F.col("p_size").cast("long").alias("size"))
    now = p.filter("k % 7 <> 0").withColumn("mtime", F.when(F.col("k") % 3 == 0, 11).otherwise(10).cast("long"))
    return D.changed_files(now, p.filter("k % 5 <> 0"))


# Archives and histories.
@query("archive_papers", with_views("papers") + " SELECT paper_id, title, type FROM papers")
def archive_papers(spark, d):
    """Papers exported and loaded again, without the fields that hold only here."""
    path = store.shared_path(spark)
    archive.export({"papers": C.papers(spark, d).select("paper_id", "title", "type", F.lit("x").alias("pdf_file")), "edges": C.edges(spark, d)}, path)
    return archive.load(spark, path)["papers"]


@query("manifest", "SELECT o_orderpriority AS source, count(*) AS n FROM orders GROUP BY 1")
def manifest(spark, d):
    """A manifest of a line for each order, a malformed one after each tenth."""
    o = C.table(spark, d, "orders")
    line = F.to_json(F.struct(F.col("o_orderdate").cast("string").alias("timestamp"), F.col("o_orderpriority").alias("source"), F.lit("d").alias("description"), F.col("o_orderkey").cast("string").alias("file")))
    path = store.shared_path(spark)
    o.select(F.explode(F.when(F.col("o_orderkey") % 10 == 0, F.array(line, F.lit("{broken"))).otherwise(F.array(line))).alias("value")).write.text(path)
    return archive.changes_from_manifest(spark, path).groupBy("source").agg(F.count("*").alias("n"))


def _versions(spark, d):
    p = C.papers(spark, d).select("paper_id", "title")
    return p.filter("paper_id % 7 <> 0"), p.filter("paper_id % 5 <> 0").withColumn("title", F.when(F.col("paper_id") % 3 == 0, F.upper("title")).otherwise(F.col("title")))


@query("history_undone", "SELECT p_partkey AS paper_id, p_name AS title FROM part WHERE p_partkey % 7 <> 0")
def history_undone(spark, d):
    """The older version again, from the newer one and the recorded changes."""
    old, new = _versions(spark, d)
    path = store.shared_path(spark)
    store.record(spark, path, store.changes(old, new, "paper_id"), "test", "second version")
    return store.undone(new, spark.read.parquet(path), "paper_id")


@query("history_newest", "SELECT p_partkey AS paper_id, CASE WHEN p_partkey % 7 = 0 THEN 'add' WHEN p_partkey % 5 = 0 THEN 'remove' ELSE 'replace' END AS operation FROM part WHERE (p_partkey % 7 = 0) <> (p_partkey % 5 = 0) OR p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 3 = 0 ORDER BY p_partkey DESC LIMIT 25")
def history_newest(spark, d):
    """The last of two recorded batches; an older one was pruned."""
    old, new = _versions(spark, d)
    path = store.shared_path(spark)
    store.record(spark, path, store.changes(old.limit(0), old, "paper_id"), "test", "first version")
    store.record(spark, path, store.changes(old, new, "paper_id"), "test", "second version")
    return store.newest(store.pruned(spark.read.parquet(path), 1), 25, "paper_id").select("paper_id", "operation")


@query("published_copy", with_views("papers") + " SELECT paper_id, title FROM papers")
def published_copy(spark, d):
    path = store.shared_path(spark)
    p = C.papers(spark, d).select("paper_id", "title")
    store.published(p.limit(3), path)
    return store.published(p, path)


@query("replaced_table", "SELECT p_partkey AS paper_id, upper(p_name) AS title FROM part")
def replaced_table(spark, d):
    """A table replaced by what is read from it."""
    path = store.shared_path(spark)
    first = store.replace_table(C.papers(spark, d).select("paper_id", "title"), path)
    return store.replace_table(first.withColumn("title", F.upper("title")), path)


@query("patch_rows", "SELECT 'replace' AS op, '/papers/p' || CAST(p_partkey AS VARCHAR) || '/title' AS path, p_name AS value FROM part")
def patch_rows(spark, d):
    """A patch in compressed files."""
    row = F.struct(F.lit("replace").alias("op"), F.concat(F.lit("/papers/p"), F.col("p_partkey").cast("string"), F.lit("/title")).alias("path"), F.col("p_name").alias("value"))
    docs = C.table(spark, d, "part").groupBy(F.floor(F.col("p_partkey") / 1000).alias("file")).agg(F.to_json(F.collect_list(row)).alias("value"))
    path = store.shared_path(spark)
    docs.repartition("file").write.partitionBy("file").option("compression", "gzip").text(path)
    return D.load_patch(spark, path)



@query("methodology_of", "SELECT CAST(p_partkey AS VARCHAR) AS paper_id, p_type AS type, 'm' AS model_name, 'Census ' || CAST(p_partkey AS VARCHAR) || '; Survey' AS data_sources FROM part WHERE p_partkey % 2 = 0")
def methodology_of(spark, d):
    """The method of each paper that states one, with its data sources."""
    t = D.extraction_tables(D.extractions(C.extraction_files(spark, d)))
    named = t["data_sources"].groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]), "; ").alias("data_sources"))
    return t["methodology"].select("paper_id", "type", "model_name").join(named, "paper_id", "left")


@query("json_export", "SELECT p_partkey AS paper_id, '{\"journal\":\"' || p_brand || '\",\"paper_id\":' || CAST(p_partkey AS VARCHAR) || ',\"title\":\"' || p_name || '\"}' AS value FROM part")
def json_export(spark, d):
    """Rows as JSON, fields in order of name."""
    return store.as_json(C.papers(spark, d).select("title", "paper_id", "journal"), "paper_id")


@query("tracked_changes", "SELECT p_partkey AS paper_id, CASE WHEN p_partkey % 7 = 0 THEN 'add' WHEN p_partkey % 5 = 0 THEN 'remove' ELSE 'replace' END AS operation FROM part WHERE (p_partkey % 7 = 0) <> (p_partkey % 5 = 0) OR p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 3 = 0")
def tracked_changes(spark, d):
    """What two replacements of a table leave in its history: the first has nothing to compare with, the third no change."""
    old, new = _versions(spark, d)
    path, history = store.shared_path(spark), store.shared_path(spark)
    for version in (old, new, new):
        store.tracked(version, path, "paper_id", history, "test", "version")
    return spark.read.parquet(history).select("paper_id", "operation")


@query("build_state", "SELECT 's' || CAST(p_size AS VARCHAR) AS source FROM part GROUP BY 1, p_size HAVING p_size % 2 = 0")
def build_state(spark, d):
    """Sources of which a file changed since the last build."""
    f = C.table(spark, d, "part").select(F.concat(F.lit("s"), F.col("p_size").cast("string")).alias("source"), F.col("p_name").alias("path"), F.col("p_partkey").alias("mtime"), F.col("p_size").cast("long").alias("size"))
    changed = f.withColumn("size", F.when(F.col("size") % 2 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return D.stale_sources(changed, D.build_state(f))
