"""Queries over structures that are kept: full-text indexes, context indexes by file, patches, packed work lists, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.operators import packing, patch, postings
from citeloom.plans.registry import query
from citeloom.sources import corpus as C
from citeloom.sources import documents as D
from citeloom.sources import store
from citeloom.sources.filestore import ContextStore
from citeloom.streaming import incremental


def bm25_ctes(name: str, key: str, text: str, table: str, terms: list[str]) -> str:
    """CTEs up to s_name: id, score of the rows of a table with a term."""
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""t_{name} AS (SELECT {key} AS id, unnest(regexp_split_to_array(lower({text}), '[^a-z]+')) AS term FROM {table}), l_{name} AS (SELECT id, count(*) AS len FROM t_{name} WHERE term <> '' GROUP BY 1),
c_{name} AS (SELECT count(*) AS n, (SELECT sum(len) FROM l_{name}) / count(*) AS average FROM {table}), f_{name} AS (SELECT id, term, count(*) AS tf FROM t_{name} WHERE term IN ({listed}) GROUP BY 1, 2), df_{name} AS (SELECT term, count(*) AS df FROM f_{name} GROUP BY 1),
s_{name} AS (SELECT id, sum(log10((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / average))) AS score FROM f_{name} JOIN df_{name} USING (term) JOIN l_{name} USING (id) CROSS JOIN c_{name} GROUP BY 1)"""


def _index(spark, df, key, columns):
    return postings.build(df, key, columns, store.shared_path(spark))


@query("bm25_indexed", f"WITH {bm25_ctes('d', 'doc_id', 'text', 'documents', ['les', 'und'])} SELECT id AS doc_id, round(score, 6) AS score FROM s_d")
def bm25_indexed(spark, d):
    index = _index(spark, C.table(spark, d, "documents"), "doc_id", ["text"])
    return postings.scores(index, "doc_id", "les und").select("doc_id", F.round("score", 6).alias("score"))


@query("bm25_top_indexed", f"WITH {bm25_ctes('d', 'doc_id', 'text', 'documents', ['the', 'que', 'that'])} SELECT id AS doc_id, round(score, 6) AS score FROM s_d ORDER BY round(s_d.score, 9) DESC, id LIMIT 15")
def bm25_top_indexed(spark, d):
    """The best of a stored index, blocks that can't hold them skipped."""
    index = _index(spark, C.table(spark, d, "documents"), "doc_id", ["text"])
    return postings.top(index, "doc_id", "that que the").select("doc_id", F.round("score", 6).alias("score"))


_KINDS = {"abstracts": ("p_partkey", "p_name || ' ' || p_type", "part", "id"), "claims": ("o_orderkey", "o_orderpriority || ' ' || o_orderstatus", "orders", "o_custkey"), "sections": ("conv_id * 1000 + turn", "coalesce(text, '')", "conversations", "conv_id"), "topics": ("doc_id", "coalesce(text, '')", "documents", "doc_id")}
_TERMS = ["steel", "the", "urgent", "les"]


def _search_all_sql() -> str:
    ctes = ", ".join(bm25_ctes(k, key, text, table, _TERMS) for k, (key, text, table, _) in _KINDS.items())
    paper = {"abstracts": "id", "claims": "(SELECT o_custkey FROM orders WHERE o_orderkey = id)", "sections": "id // 1000", "topics": "id"}
    shown = " UNION ALL ".join(f"SELECT * FROM (SELECT '{k}' AS kind, count(*) OVER () AS total, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank, CAST(id AS VARCHAR) AS key, CAST({paper[k]} AS VARCHAR) AS paper_id, round(score, 6) AS score FROM s_{k} QUALIFY rank <= 10)" for k in _KINDS)
    return f"WITH {ctes}, shown AS ({shown}) SELECT kind, total, CAST(rank AS BIGINT) AS rank, key, paper_id, score, (SELECT count(DISTINCT paper_id) FROM shown) AS papers_shown FROM shown"


@query("search_all", _search_all_sql())
def search_all(spark, d):
    """The best ten of each kind of text, their totals, and the number of papers shown."""
    k = F.col("p_partkey")
    rows = {
        "abstracts": C.table(spark, d, "part").select(k.alias("id"), k.alias("paper_id"), F.concat_ws(" ", "p_name", "p_type").alias("text")),
        "claims": C.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("paper_id"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("text")),
        "sections": C.table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("paper_id"), "text"),
        "topics": C.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("paper_id"), "text"),
    }
    kinds = {name: (_index(spark, df, "id", ["text"]), df, "id") for name, df in rows.items()}
    return postings.search_all(kinds, " ".join(_TERMS)).withColumns({"score": F.round("score", 6), "rank": F.col("rank").cast("long")}).drop("text")


# Streams.
@query(
    "stream_event_counts",
    """WITH e AS (SELECT *, ts < TIMESTAMP '2024-01-11' AND event_id % 50 = 0 AS planted FROM events), w AS (SELECT max(ts) - INTERVAL 10 MINUTE AS passed FROM e WHERE NOT planted),
c AS (SELECT *, date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR <= passed AS settled FROM e, w)
SELECT window_start, event_type, count(*) FILTER (NOT planted) AS n, round(sum(value) FILTER (NOT planted), 4) AS total, count(*) FILTER (planted) AS n_late FROM c WHERE settled GROUP BY 1, 2""",
)
def stream_event_counts(spark, d):
    """Counts of settled windows from a stream in order of time; some rows of its first days come at its end, too late."""
    events = C.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark takes no other type
    planted = (F.col("ts") < F.to_timestamp(F.lit("2024-01-11"))) & (F.col("event_id") % 50 == 0)
    day = F.dayofmonth("ts")
    source, checkpoint, path = (store.shared_path(spark) for _ in range(3))
    for slice_of in (~planted & (day <= 10), ~planted & day.between(11, 20), ~planted & (day > 20), planted):
        events.filter(slice_of).write.mode("append").parquet(source)
        incremental.settled_counts(incremental.table_stream(spark, events, source), checkpoint, path)
    counts = spark.read.schema("window_start timestamp, event_type string, n long, total double").parquet(f"{path}/counts").select("window_start", "event_type", "n", "total")
    late = incremental.late_rows(spark, path, events).groupBy(F.window("ts", "1 hour")["start"].alias("window_start"), "event_type").agg(F.count("*").alias("n_late"))
    both = counts.join(late, ["window_start", "event_type"], "full_outer").fillna(0, ["n", "n_late"])
    return both.withColumns({"window_start": F.col("window_start").cast("timestamp_ntz"), "total": F.round("total", 4)})


@query("stream_papers", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'newer ' WHEN p_partkey % 3 = 0 THEN 'other ' ELSE '' END || p_name AS p_name FROM part")
def stream_papers(spark, d):
    """Versions of papers that come in three batches, not in the order of their times, with a restart between them."""
    k = F.col("p_partkey")
    parts = C.table(spark, d, "part")
    version = lambda on, modified, name: parts.filter(on).select("p_partkey", F.lit(modified).cast("long").alias("modified"), F.concat(F.lit(name), "p_name").alias("p_name"))
    source, checkpoint, path = (store.shared_path(spark) for _ in range(3))
    like = version(F.lit(True), 5, "")
    for batch in (like, version(k % 2 == 0, 9, "newer "), version(k % 3 == 0, 7, "other ")):
        batch.write.mode("append").parquet(source)
        incremental.take_up_versions(incremental.table_stream(spark, like, source), "p_partkey", "modified", checkpoint, path)
    return incremental.current(spark, path, like, "p_partkey", "modified").select("p_partkey", "p_name")


# Indexes and documents that change.
@query(
    "index_after_changes",
    """SELECT CAST(p_partkey AS VARCHAR) AS citing, 'c' || CAST(p_partkey + 1 AS VARCHAR) AS cited, CASE WHEN p_partkey % 3 = 0 THEN 'method' ELSE 'background' END AS purpose,
  count(*) OVER (PARTITION BY p_partkey % 3 = 0) AS n_purpose FROM part WHERE p_partkey % 7 <> 0""",
)
def index_after_changes(spark, d):
    """The context index after a third of the files changed, some went and some came: only their parts are written anew."""
    k = F.coalesce(F.try_to_number("file", F.lit("9999999999")), F.lit(-1)).cast("long")
    every = store.cut(C.extraction_files(spark, d).withColumn("k", k))
    parse = lambda files: D.context_index(D.extractions(files, D.INDEX_SIDECAR)).select(F.col("citing").alias("file"), "cited", "purpose", "quote")
    kept = ContextStore(spark, store.shared_path(spark), parse, "file string, cited string, purpose string, quote string", parts=64)
    kept.update(every.filter("k % 5 <> 0"))
    kept.update(every.filter("k % 7 <> 0").withColumn("value", F.when(F.col("k") % 3 == 0, F.regexp_replace("value", "background", "method")).otherwise(F.col("value"))))
    return kept.rows().join(kept.purposes(), "purpose").select(F.col("file").alias("citing"), "cited", "purpose", F.col("n").alias("n_purpose"))


def _documents(spark, d, version: int):
    """Parts as nested documents in three versions; what changes goes by the key modulo 10."""
    k, m = F.col("p_partkey"), F.col("p_partkey") % 10
    text = lambda c: F.to_json(F.struct(F.col(c).alias("x")))
    quoted = lambda c: F.regexp_extract(text(c), r'^\{"x":(.*)\}$', 1)
    changed = lambda on, new, old: F.when(m.isin(on) & F.lit(version > 1), F.lit(new) if isinstance(new, str) else new).otherwise(F.lit(old) if isinstance(old, str) else old)
    meta = F.concat(F.lit('{'), changed([2], "", F.concat(F.lit('"brand":'), quoted("p_brand"), F.lit(","))), F.lit('"size":'), (F.col("p_size") + F.when((m == 1) & F.lit(version > 1), version).otherwise(0)).cast("string"), F.lit("}"))
    x = F.concat(F.lit("["), k.cast("string"), changed([3], ',"y","z"]', ',"x"]'))
    listed = changed([6], "[]", F.concat(F.lit("[1,"), x, F.lit("]")))
    body = F.concat(
        F.lit('{"a/b":{"~":'), changed([5], "2", "1"), F.lit('},"id":'), k.cast("string"), F.lit(',"list":'), listed, F.lit(',"meta":'), changed([4], "null", meta),
        changed([7], F.concat(F.lit(',"name":{"first":'), quoted("p_name"), F.lit("}")), F.concat(F.lit(',"title":'), quoted("p_name"))), F.lit("}" if version < 3 else ',"version":3}'),
    )
    there = (m != 9) if version > 1 else (m != 8)
    return C.table(spark, d, "part").filter(there).select(k.cast("string").alias("key"), body.alias("value"))


_K = "CAST(p_partkey AS VARCHAR)"
_OPERATIONS = [
    (1, "/meta/size", "replace", "CAST(p_size AS VARCHAR)", "CAST(p_size + 2 AS VARCHAR)"),
    (2, "/meta/brand", "remove", "'\"' || p_brand || '\"'", "NULL"),
    (3, "/list/1/1", "replace", "'\"x\"'", "'\"y\"'"),
    (3, "/list/1/2", "add", "NULL", "'\"z\"'"),
    (4, "/meta", "replace", "'{\"brand\":\"' || p_brand || '\",\"size\":' || CAST(p_size AS VARCHAR) || '}'", "'null'"),
    (5, "/a~1b/~0", "replace", "'1'", "'2'"),
    (6, "/list/0", "remove", "'1'", "NULL"),
    (6, "/list/1", "remove", f"'[' || {_K} || ',\"x\"]'", "NULL"),
    (7, "/title", "remove", "'\"' || p_name || '\"'", "NULL"),
    (7, "/name", "add", "NULL", "'{\"first\":\"' || p_name || '\"}'"),
]
_WHOLE = f"'{{\"a/b\":{{\"~\":1}},\"id\":' || {_K} || ',\"list\":[1,[' || {_K} || ',\"x\"]],\"meta\":{{\"brand\":\"' || p_brand || '\",\"size\":' || CAST(p_size AS VARCHAR) || '}},\"title\":\"' || p_name || '\"}}'"
_PATHS = " UNION ALL ".join(f"SELECT {_K} AS key, '{path}' AS path, '{op}' AS operation, {before} AS before, {after} AS after FROM part WHERE p_partkey % 10 = {m}" for m, path, op, before, after in [*_OPERATIONS, (8, "", "add", "NULL", _WHOLE), (9, "", "remove", _WHOLE, "NULL")])


@query("patch_paths", _PATHS)
def patch_paths(spark, d):
    """The operations between two versions of nested documents, by JSON pointer."""
    return patch.diff(_documents(spark, d, 1), _documents(spark, d, 2))


@query("rolled_back_two", f"SELECT {_K} AS key, {_WHOLE} AS value FROM part WHERE p_partkey % 10 <> 8")
def rolled_back_two(spark, d):
    """Documents of a third version, taken back to the first by the inverse patches."""
    versions = [store.cut(_documents(spark, d, v)) for v in (1, 2, 3)]
    steps = [patch.diff(a, b).withColumn("version", F.lit(n)) for n, (a, b) in enumerate(zip(versions, versions[1:], strict=False), 2)]
    back = patch.rolled_back(versions[2], steps[0].unionByName(steps[1]), [2, 3])
    return back.select("key", F.to_json(F.parse_json("value")).alias("value"))


# Lines of documents whose fields nobody declared.
@query(
    "jsonl_inferred",
    """SELECT o_orderkey AS key, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE '"' || o_orderstatus || '"' END AS status, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS note,
  CASE WHEN o_orderkey % 5 = 0 THEN o_custkey END AS extra, (SELECT count(*) FROM orders WHERE o_orderkey % 10 = 0) * 2 AS n_aside FROM orders""",
)
def jsonl_inferred(spark, d):
    """A line for each order, with fields that are missing, extra or of two types; after each tenth two lines that are no objects."""
    k = F.col("o_orderkey")
    o = C.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    status = F.when(k % 4 == 0, F.col("o_custkey").cast("string")).otherwise(F.concat(F.lit('"'), "o_orderstatus", F.lit('"')))
    note = F.when(k % 3 != 0, F.concat(F.lit(',"note":"'), "o_orderpriority", F.lit('"'))).otherwise("")
    extra = F.when(k % 5 == 0, F.concat(F.lit(',"nested":{"extra":'), F.col("o_custkey").cast("string"), F.lit("}"))).otherwise("")
    line = F.concat(F.lit('{"key":'), k.cast("string"), F.lit(',"status":'), status, note, extra, F.lit("}"))
    path = store.shared_path(spark)
    o.select(F.explode(F.when(k % 10 == 0, F.array(line, F.lit('{"key":'), F.lit("[1]"))).otherwise(F.array(line))).alias("value")).write.text(path)
    rows, aside = D.inferred_lines(spark, path)
    return rows.select("key", F.to_json("status").alias("status"), "note", F.col("nested.extra").alias("extra")).join(F.broadcast(aside.agg(F.count("*").alias("n_aside"))))  # one row


@query(
    "work_lists",
    """WITH RECURSIVE o AS MATERIALIZED (SELECT doc_id, strlen(coalesce(text, '')) AS size, row_number() OVER (ORDER BY doc_id) AS i FROM documents),
r AS (SELECT i, doc_id, size, 0 AS bin, size AS used FROM o WHERE i = 1
UNION ALL SELECT o.i, o.doc_id, o.size, CASE WHEN r.used + o.size > 29800 THEN bin + 1 ELSE bin END, CASE WHEN r.used + o.size > 29800 THEN o.size ELSE r.used + o.size END FROM r JOIN o ON o.i = r.i + 1)
SELECT CAST(bin AS BIGINT) AS bin, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, min(doc_id) AS first_id, max(doc_id) AS last_id FROM r GROUP BY 1""",
)
def work_lists(spark, d):
    """All documents by id in lists of at most 30 KB, 200 bytes of which a list's head takes."""
    docs = C.table(spark, d, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("size"))
    return packing.packed(docs, ["doc_id"], F.col("size"), 30_000, 200).groupBy("bin").agg(F.count("*").alias("n"), F.sum("size").cast("long").alias("bytes"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
