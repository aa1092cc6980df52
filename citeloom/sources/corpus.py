"""Corpus views over the supplied star-schema tables.

No citation corpus ships with the test tables, so each relation of the data
model is a deterministic view over them: parts are papers, consecutive lines of
an order are citations, suppliers are authors.  Every function takes
``(spark, sf_dir)`` and returns a lazy DataFrame; nothing is cached here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paper_id, title, journal, year, type: one row per part."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("paper_id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("journal"),
        (F.lit(1990) + F.col("p_partkey") % 35).cast("int").alias("year"),
        F.when(F.col("p_size") % 3 == 0, "owned").when(F.col("p_size") % 3 == 1, "external_owned").otherwise("stub").alias("type"),
        F.concat(F.lit("10.1000/"), F.lower("p_brand"), F.lit("."), F.col("p_partkey").cast("string")).alias("doi"),
        F.col("p_type").alias("abstract"),
    )


def _line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring lines of one order; both sides shuffle once on the order key."""
    line = table(spark, sf_dir, "lineitem")
    a = line.select("l_orderkey", (F.col("l_linenumber") + 1).alias("n"), F.col("l_partkey").alias("citing_id"), "l_returnflag")
    b = line.select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("cited_id"))
    return a.join(b, ["l_orderkey", "n"]).filter("citing_id <> cited_id")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """citing_id, cited_id: distinct directed citations."""
    return _line_pairs(spark, sf_dir).select("citing_id", "cited_id").distinct()


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """citing_id, cited_id, purpose, section: one row per annotated citation."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("purpose"))
    return _line_pairs(spark, sf_dir).join(orders, "l_orderkey").select("citing_id", "cited_id", "purpose", F.col("l_returnflag").alias("section"))


def authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """author_id, canonical_name, n_key."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("author_id"), F.col("s_name").alias("canonical_name"))


def paper_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paper_id, author_id: distinct authorship pairs."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("paper_id"), F.col("l_suppkey").alias("author_id")).distinct()


#: The same relations in SQL, for the oracle queries: names -> body of a CTE.
PAIRS_SQL = """SELECT a.l_orderkey, a.l_partkey AS citing_id, b.l_partkey AS cited_id, a.l_returnflag AS section
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
  WHERE a.l_partkey <> b.l_partkey"""
VIEWS_SQL = {
    "papers": """SELECT p_partkey AS paper_id, p_name AS title, p_brand AS journal, CAST(1990 + p_partkey % 35 AS INTEGER) AS year,
  CASE WHEN p_size % 3 = 0 THEN 'owned' WHEN p_size % 3 = 1 THEN 'external_owned' ELSE 'stub' END AS type,
  '10.1000/' || lower(p_brand) || '.' || CAST(p_partkey AS VARCHAR) AS doi, p_type AS abstract FROM part""",
    "pairs": PAIRS_SQL,
    "edges": "SELECT DISTINCT citing_id, cited_id FROM pairs",
    "contexts": "SELECT citing_id, cited_id, o_orderpriority AS purpose, section FROM pairs JOIN orders ON l_orderkey = o_orderkey",
    "authors": "SELECT s_suppkey AS author_id, s_name AS canonical_name FROM supplier",
    "paper_authors": "SELECT DISTINCT l_partkey AS paper_id, l_suppkey AS author_id FROM lineitem",
}


def with_views(*names: str, recursive: bool = False) -> str:
    """The WITH clause that defines the named relations, in order."""
    need = [n for n in VIEWS_SQL if n in names or n == "pairs" and {"edges", "contexts"} & {*names}]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(f"{n} AS ({VIEWS_SQL[n]})" for n in need)


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paper_id, pos, heading, summary: the turns of a conversation."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("paper_id"), F.col("turn").alias("pos"), F.col("role").alias("heading"), F.col("text").alias("summary"))


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paper_id, field, value: three columns of a part as rows."""
    fields = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type"), F.lit("size"), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("paper_id"), F.explode(fields).alias("field", "value"))


def keyed_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paper_id, title, author_key, doi: papers with keys that several of them share."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("paper_id"), F.col("p_name").alias("title"), F.concat("p_brand", "p_type", F.col("p_size").cast("string")).alias("author_key"), F.when(k % 2 == 0, F.concat(F.lit("D"), F.floor(k / 4).cast("string"))).alias("doi"))


def titled_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers with all that stands in their own rows: no authors and no citations."""
    k, p = F.col("p_partkey"), table(spark, sf_dir, "part")
    key = F.concat("p_brand", "p_type", F.col("p_size").cast("string"))
    return p.select(
        k.alias("paper_id"),
        F.concat_ws(" ", "p_name", F.lit("a study of"), key).alias("title"),
        key.alias("author_key"),
        F.when(k % 2 == 0, F.concat(F.lit("D"), F.floor(k / 4).cast("string"))).alias("doi"),
        (F.lit(1990) + k % 35).cast("int").alias("year"),
        F.when(F.col("p_size") % 3 == 0, "owned").when(F.col("p_size") % 3 == 1, "external_owned").otherwise("stub").alias("type"),
        F.col("p_type").alias("abstract"),
        F.when(k % 5 == 0, F.concat(F.lit("S"), F.floor(k / 10).cast("string"))).alias("s2_id"),
    )


def full_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers with everything that pair scores look at."""
    e = edges(spark, sf_dir)
    out = e.groupBy(F.col("citing_id").alias("paper_id")).agg(F.collect_set(F.col("cited_id").cast("string")).alias("cites"))
    back = e.groupBy(F.col("cited_id").alias("paper_id")).agg(F.collect_set(F.col("citing_id").cast("string")).alias("cited_by"))
    names = paper_authors(spark, sf_dir).groupBy("paper_id").agg(F.array_sort(F.collect_set(F.concat(F.lit("Name"), (F.col("author_id") % 40).cast("string"), F.lit(", A.")))).alias("authors"))
    return titled_papers(spark, sf_dir).join(out, "paper_id", "left").join(back, "paper_id", "left").join(names, "paper_id", "left").fillna({"doi": ""})


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """alias, target: chains of several steps."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").filter((F.col("p_size") <= 7) & (k > 0)).select(k.alias("alias"), F.floor(k / 3).cast("long").alias("target"))


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Citations as the citing and as the cited papers list them: by the contexts that each side knows."""
    c = contexts(spark, sf_dir)
    side = lambda keep: c.filter(keep).select("citing_id", "cited_id").distinct()
    return side("section <> 'R'"), side("purpose <> '5-LOW'")


def paper_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers as documents with lists that disagree, some superseded."""
    cites, cited_by = sides(spark, sf_dir)
    out = cites.groupBy(F.col("citing_id").alias("key")).agg(F.collect_set("cited_id").alias("cites"))
    back = cited_by.groupBy(F.col("cited_id").alias("key")).agg(F.collect_set("citing_id").alias("cited_by"))
    p = papers(spark, sf_dir).select(F.col("paper_id").alias("key"), "type", "title", F.when((F.col("year") == 1995) & (F.col("paper_id") > 5), F.col("paper_id") - 1).cast("string").alias("superseded_by"))
    return p.join(out, "key", "left").join(back, "key", "left").select("key", "type", "title", "superseded_by", *[F.coalesce(c, F.array().cast("array<bigint>")).alias(c) for c in ("cites", "cited_by")])


def author_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paper_id, name: author strings with initials and first names."""
    s = F.col("l_suppkey")
    first = F.when(s % 3 == 0, "A.").when(s % 3 == 1, "Anna B.").otherwise("C. D.")
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("paper_id"), F.concat(F.lit("Name"), (s % 40).cast("string"), F.lit(", "), first).alias("name"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with lines as findings: their parts are the papers, their priority the tag."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("finding_id")).agg(F.transform(F.array_sort(F.collect_set("l_partkey")), lambda p: F.struct(p.alias("paper_id"), F.lit("").alias("note"))).alias("papers"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("finding_id"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"), F.lit("").alias("question"), F.lit("").alias("summary"), F.array("o_orderpriority").alias("tags"))
    return o.join(lines, "finding_id")


# Documents, as JSON texts (file, value) of at most a thousand entries each.


def _store(rows: DataFrame, key: str, name: str, number: Column) -> DataFrame:
    """file, value: objects ``{name: {key: r}}`` of the rows (key, r)."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), F.col("r").alias("value")))))
    return rows.groupBy(F.concat(F.lit(f"{name}-"), F.floor(number / 1000).cast("string")).alias("file")).agg(F.to_json(F.struct(entries.alias(name))).alias("value"))


def paper_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as paper documents: some superseded, years as text, passes out of order, two citations each."""
    k = F.col("p_partkey")
    pid = lambda n: F.concat(F.lit("p"), n.cast("string"))
    passes = F.reverse(F.slice(F.array(*map(F.lit, [1, 2, 3, 4])), F.lit(1), (k % 4 + 1).cast("int")))
    r = F.struct(
        pid(k).alias("id"), F.when(k % 3 == 0, "owned").when(k % 3 == 1, "external_owned").otherwise("stub").alias("type"), F.col("p_name").alias("title"),
        F.array(F.concat(F.lit("Name"), (k % 40).cast("string"), F.lit(", A.")), F.lit("Other, B.")).alias("authors"), F.concat(F.lit("c. "), (1990 + k % 35).cast("string")).alias("year"),
        F.when(k % 2 == 0, pid(k)).otherwise("").alias("s2_paper_id"), F.when(k % 11 == 0, pid(k - 1)).alias("superseded_by"), F.array(pid(k + 1), pid(k + 2)).alias("cites"), F.array(pid(k - 1)).alias("cited_by"),
        F.struct(passes.alias("passes_completed")).alias("extraction_meta"),
    )
    return _store(table(spark, sf_dir, "part").select(pid(k).alias("key"), r.alias("r"), k.alias("n")), "key", "papers", F.col("n"))


def context_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts by cited paper; those of every third one don't name it."""
    c = contexts(spark, sf_dir)
    one = F.struct(F.col("citing_id").cast("string").alias("citing"), F.when(F.col("cited_id") % 3 != 0, F.col("cited_id").cast("string")).alias("cited"), "purpose", "section")
    return _store(c.groupBy("cited_id").agg(F.collect_list(one).alias("r")).withColumn("key", F.col("cited_id").cast("string")), "key", "by_cited", F.col("cited_id"))


def extraction_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extraction for each part, with a stamp beside each third, and one file that can't be read."""
    k, text = F.col("p_partkey"), F.col("p_partkey").cast("string")
    body = F.to_json(F.struct(
        F.array(F.struct(F.col("p_name").alias("claim"), F.col("p_type").alias("type"), F.array(text, F.lit("x")).alias("supporting_citations"))).alias("claims"), F.array("p_brand", "p_type").alias("keywords"),
        F.create_map(F.lit("themes"), F.array("p_type"), F.lit("sectors"), F.array("p_brand", F.lit("all")), F.lit("other"), F.array(F.lit("left out"))).alias("topics"),
        F.array(F.struct(F.lit("Intro").alias("heading"), F.col("p_name").alias("summary"))).alias("sections"), F.when(k % 2 == 0, F.struct(F.col("p_type").alias("type"), F.lit("m").alias("model_name"))).alias("methodology"), F.array(F.concat(F.lit("why "), text)).alias("questions"),
        F.array(F.struct(F.concat(F.lit("c"), (k + 1).cast("string")).alias("id"), F.lit("T").alias("title"), F.array(F.lit("A, B.")).alias("authors"), F.lit("1999").alias("year"), F.array(F.struct(F.lit("background").alias("purpose"), F.lit("Intro").alias("section"), F.col("p_name").alias("quote"))).alias("contexts"))).alias("citations"),
    ))
    sources = F.concat(F.lit(',"data_sources":["Census '), text, F.lit('",{"name":"Survey","type":"panel"}]}'))
    main = table(spark, sf_dir, "part").select(text.alias("file"), F.concat(F.regexp_replace(body, r"\}$", ""), sources).alias("value"))
    stamps = table(spark, sf_dir, "part").filter(k % 3 == 0).select(F.concat(text, F.lit(".meta")).alias("file"), F.lit('{"keywords":["stamp"]}').alias("value"))
    return main.unionByName(stamps).unionByName(spark.createDataFrame([("broken", "{not json")], "file string, value string"))


def sidecar_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per part the main file and, by its key modulo 5: two chunks and a single file, a single one, or contexts in the main file in two ways, or none."""
    k = F.col("p_partkey")
    entry = lambda ref, purpose: F.concat(F.lit('{"id":"'), F.lit(ref), F.lit('","contexts":[{"purpose":"'), F.lit(purpose), F.lit('","quote":"'), F.col("p_name"), F.lit('"}]}'))
    listed = lambda name, *entries: F.concat(F.lit('{"' + name + '":['), F.concat_ws(",", *entries), F.lit("]}"))
    rows = [
        ("", k % 5 == 2, F.concat(F.lit('{"citation_contexts":['), entry("a", "top"), F.lit('],"citations":['), entry("b", "own"), F.lit("]}"))),
        ("", k % 5 == 3, listed("citations", entry("b", "own"))),
        ("", ~(k % 5).isin(2, 3), F.lit("{}")),
        (".contexts", k % 5 < 2, listed("citations", entry("s", "single"))),
        (".contexts.1", k % 5 == 0, listed("citations", entry("c", "first"), entry("", "no id"))),
        (".contexts.12", k % 5 == 0, listed("citations", entry("d", "second"))),
        (".contexts.50", k % 5 == 1, listed("citations", entry("e", "beyond"))),
    ]
    parts = table(spark, sf_dir, "part")
    return reduce(DataFrame.unionByName, [parts.filter(on).select(F.concat(k.cast("string"), F.lit(end)).alias("file"), value.alias("value")) for end, on, value in rows])


def author_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as persons, nations as institutions."""
    s = F.col("s_suppkey")
    made = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), s.cast("string")).alias("key"), F.struct(F.col("s_name").alias("canonical_name"), F.array(F.col("s_name"), F.concat(F.lit("X"), F.col("s_name"))).alias("name_variants"), F.array(F.concat(F.lit("p"), s.cast("string")), F.lit("p0")).alias("papers"), F.lit(2).alias("paper_count")).alias("r"), s.alias("n"))
    n = F.col("n_nationkey")
    firms = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), n.cast("string")).alias("key"), F.struct(F.col("n_name").alias("name"), F.array(F.concat(F.lit("p"), n.cast("string"))).alias("papers")).alias("r"), n.alias("n"))
    return _store(made, "key", "persons", F.col("n")).unionByName(_store(firms, "key", "institutions", F.col("n")))


def finding_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as files, every fourth without an id of its own, and one that can't be read."""
    f = findings(spark, sf_dir)
    one = F.struct(F.when(F.col("finding_id") % 4 != 0, F.col("finding_id").cast("string")).alias("id"), "title", "question", "summary", "tags", F.transform("papers", lambda p: F.struct(p["paper_id"].cast("string").alias("paper_id"), p["note"].alias("note"))).alias("papers"))
    return f.select(F.col("finding_id").cast("string").alias("file"), F.to_json(one).alias("value")).unionByName(spark.createDataFrame([("broken", "[")], "file string, value string"))
