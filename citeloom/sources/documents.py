"""JSON documents to relational tables: papers, edges, contexts, extractions, authors, findings.

Schemas are explicit; nothing is inferred.  Stores are read as text, one JSON
object each, so that one malformed file gives no rows rather than an error.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import text as T

PAPER = """id string, type string, title string, authors string, year string, journal string, doi string, abstract string,
pdf_file string, text_file string, extraction_file string, s2_paper_id string, arxiv_id string, pubmed_id string, pmc_id string,
preprint_server string, open_access_url string, source_db string, superseded_by string, dedup_pending boolean, cites array<string>,
cited_by array<string>, aliases array<string>, forward_cited_by array<string>, extraction_meta struct<passes_completed:array<int>>"""
CONTEXT = "citing string, cited string, cited_title string, purpose string, section string, quote string, explanation string"
PERSON = "id string, canonical_name string, name string, name_variants array<string>, papers array<string>, paper_count int, owned_paper_count int"
EXTRACTION = """claims array<struct<claim:string,type:string,confidence:string,evidence_basis:string,quantification:string,supporting_citations:array<string>>>,
keywords array<string>, topics map<string,array<string>>, sections array<struct<heading:string,summary:string,annotated_text:string>>,
methodology struct<type:string,model_name:string,approach:string,temporal_scope:string,geographic_scope:string,unit_of_analysis:string,scenarios:string>,
data_sources array<string>, questions array<string>,
citations array<struct<id:string,title:string,authors:array<string>,year:string,contexts:array<struct<purpose:string,section:string,quote:string,explanation:string>>>>"""
TOPIC_FIELDS = ["themes", "geographic_focus", "sectors", "policy_context"]
OWNED_TYPES = ["owned", "external_owned"]
#: Files beside an extraction that aren't one themselves.
SIDECAR = r"\.(refs|contexts|sections|analysis|meta)(\.[0-9]+)?$"
#: The same for the context index, which takes a stamp for an extraction.
INDEX_SIDECAR = r"\.(refs|contexts|sections|analysis)(\.[0-9]+)?$"


def owned(kind: Column) -> Column:
    return kind.isin(*OWNED_TYPES)


def files(spark: SparkSession, path: str) -> DataFrame:
    """file, value: each file as one text, its name without .json; compressed files are read as what they hold."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)\.json(\.gz)?$", 1).alias("file"), "value")


def _entries(docs: DataFrame, field: str, schema: str) -> DataFrame:
    """key, value structs of a map of objects."""
    parsed = docs.select(F.explode(F.from_json("value", f"{field} map<string,struct<{_typed(schema)}>>")[field]).alias("key", "r"))
    return parsed.select("key", "r.*")


def _typed(schema: str) -> str:
    """A column list in the form that struct<> takes."""
    out, depth = [], 0
    for part in schema.replace("\n", " ").split(","):
        out.append(part.strip() if depth else part.strip().replace(" ", ":", 1))
        depth += part.count("<") - part.count(">")
    return ",".join(out)


def authors_text(raw: Column) -> Column:
    """A JSON list of names joined by semicolons; any other text as it is."""
    return F.when(F.startswith(F.ltrim(raw), F.lit("[")), F.array_join(F.from_json(raw, "array<string>"), "; ")).otherwise(raw)


def load_papers(spark: SparkSession, path: str) -> DataFrame:
    """Every paper document, superseded ones too; key is its place in the store."""
    return _entries(files(spark, path), "papers", PAPER)


def papers_table(docs: DataFrame) -> DataFrame:
    """The relational papers: superseded ones left out, years and passes made plain."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    passes = F.col("extraction_meta.passes_completed")
    return docs.filter(F.coalesce("superseded_by", F.lit("")) == "").select(
        F.col("key").alias("paper_id"), "type", "title", F.coalesce(authors_text(F.col("authors")), F.lit("")).alias("authors"), T.safe_year(F.col("year")).alias("year"), "journal", "doi", "abstract", "pdf_file", "text_file",
        T.detail_level(passes).alias("detail_level"), F.array_join(F.array_sort(F.coalesce(passes, F.array().cast("array<int>"))), ",").alias("passes_completed"),
        blank("s2_paper_id").alias("s2_id"), *[blank(c).alias(c) for c in ("arxiv_id", "pubmed_id", "pmc_id", "preprint_server", "open_access_url")],
    )


def edges_table(docs: DataFrame) -> DataFrame:
    """citing_id, cited_id, cited_title: citations of papers that aren't superseded, titles where the cited paper is known."""
    raw = docs.filter(F.coalesce("superseded_by", F.lit("")) == "").select(F.col("key").alias("citing_id"), F.explode("cites").alias("cited_id"))
    titles = papers_table(docs).select(F.col("paper_id").alias("cited_id"), F.col("title").alias("cited_title"))
    return raw.join(titles, "cited_id", "left").select("citing_id", "cited_id", F.coalesce("cited_title", F.lit("")).alias("cited_title"))


def contexts_table(spark: SparkSession, path: str) -> DataFrame:
    lists = files(spark, path).select(F.explode(F.from_json("value", f"by_cited map<string,array<struct<{_typed(CONTEXT)}>>>")["by_cited"]).alias("key", "list"))
    rows = lists.select("key", F.explode("list").alias("c"))
    return rows.select(F.col("c.citing").alias("citing_id"), F.coalesce("c.cited", "key").alias("cited_id"), *[f"c.{x}" for x in ("cited_title", "purpose", "section", "quote", "explanation")])


def citation_counts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("key").alias("paper_id"), F.size(F.coalesce("cited_by", F.array().cast("array<string>"))).alias("cited_by_count"))


def extractions(found: DataFrame, sidecar: str = SIDECAR) -> DataFrame:
    """paper_id and the parsed extraction of each main file of (file, value); sidecars and files that hold no JSON object are left out.

    Another pattern for ``sidecar`` keeps other files, as INDEX_SIDECAR does.
    """
    main = found.filter(~F.col("file").rlike(sidecar) & F.col("value").rlike(r"^\s*\{"))
    rows = main.select(F.col("file").alias("paper_id"), F.from_json("value", EXTRACTION + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("x"))
    return rows.filter("x is not null and x._bad is null").select("paper_id", "x.*").drop("_bad")


def load_extractions(spark: SparkSession, path: str) -> DataFrame:
    return extractions(files(spark, path))


_CONTEXTS = "array<struct<id:string,contexts:array<struct<purpose:string,section:string,quote:string,explanation:string>>>>"


def _part(found: DataFrame, kind: str) -> DataFrame:
    """paper_id, chunk, value of the sidecars of one kind: the numbered ones from 1 to 49 if a paper has any, else the single one (chunk 0)."""
    named = found.select(F.regexp_extract("file", rf"^(.+)\.{kind}(\.[0-9]{{1,2}})?$", 1).alias("paper_id"), F.coalesce(F.try_to_number(F.nullif(F.regexp_extract("file", rf"\.{kind}\.([0-9]{{1,2}})$", 1), F.lit("")), F.lit("99")).cast("int"), F.lit(0)).alias("chunk"), "value")
    named = named.filter("paper_id <> '' and chunk < 50")
    most = named.groupBy("paper_id").agg(F.max("chunk").alias("most"))
    return named.join(most, "paper_id").filter("chunk > 0 or most = 0").drop("most")


def sidecar_contexts(found: DataFrame) -> DataFrame:
    """paper_id, ref, chunk, entry, pos and the fields of each context of (file, value).

    From the contexts sidecars; for papers without one from the main file's
    ``citation_contexts``, or else from its citations' own contexts.
    """
    sidecars = _part(found, "contexts")
    entries = sidecars.select("paper_id", "chunk", F.from_json("value", f"citations {_CONTEXTS}")["citations"].alias("list"))
    main = found.filter(~F.col("file").rlike(SIDECAR)).withColumnRenamed("file", "paper_id").join(sidecars.select("paper_id").distinct(), "paper_id", "left_anti")
    both = main.select("paper_id", F.lit(0).alias("chunk"), F.from_json("value", f"citation_contexts {_CONTEXTS}, citations {_CONTEXTS}").alias("x"))
    known = F.filter("x.citation_contexts", lambda e: F.coalesce(e["id"], F.lit("")) != "")
    inline = both.select("paper_id", "chunk", F.when(F.size(known) > 0, known).otherwise(F.col("x.citations")).alias("list"))
    rows = entries.unionByName(inline).select("paper_id", "chunk", F.posexplode("list").alias("entry", "e")).filter("e.id <> ''")
    return rows.select("paper_id", F.col("e.id").alias("ref"), "chunk", "entry", F.posexplode("e.contexts").alias("pos", "c")).select("paper_id", "ref", "chunk", "entry", "pos", "c.*")


def sidecar_sections(found: DataFrame) -> DataFrame:
    """paper_id, chunk, pos and the fields of each section of the sections sidecars."""
    rows = _part(found, "sections").select("paper_id", "chunk", F.from_json("value", "sections array<struct<heading:string,summary:string,annotated_text:string>>")["sections"].alias("list"))
    return rows.select("paper_id", "chunk", F.posexplode("list").alias("pos", "s")).select("paper_id", "chunk", "pos", "s.*")


def extraction_tables(ex: DataFrame) -> dict[str, DataFrame]:
    """The seven relations of the extractions, with each item's position."""
    items = lambda c: ex.select("paper_id", F.posexplode(c).alias("pos", "i"))
    source = lambda f: F.get_json_object("i", f"$.{f}")
    return {
        "claims": items("claims").select("paper_id", "pos", *[f"i.{c}" for c in ("claim", "type", "confidence", "evidence_basis", "quantification")], F.to_json("i.supporting_citations").alias("supporting_citations")),
        "keywords": items("keywords").select("paper_id", "pos", F.col("i").alias("keyword")),
        "topics": ex.select("paper_id", F.explode("topics").alias("field", "values")).filter(F.col("field").isin(*TOPIC_FIELDS)).select("paper_id", "field", F.explode("values").alias("value")),
        "sections": items("sections").select("paper_id", "pos", "i.heading", "i.summary", "i.annotated_text"),
        "methodology": ex.filter("methodology is not null").select("paper_id", "methodology.*"),
        "data_sources": items("data_sources").select("paper_id", "pos", F.coalesce(source("name"), "i").alias("name"), source("type").alias("type"), source("description").alias("description")),
        "questions": items("questions").select("paper_id", "pos", F.col("i").alias("question")),
    }


def refs_table(ex: DataFrame) -> DataFrame:
    """The citations of each extraction without their contexts."""
    return ex.select("paper_id", F.explode("citations").alias("c")).select("paper_id", "c.id", "c.title", "c.authors", "c.year")


def context_index(ex: DataFrame) -> DataFrame:
    """citing, cited, cited_title and the context's fields: one row per annotated citation."""
    cites = ex.select(F.col("paper_id").alias("citing"), F.explode("citations").alias("c"))
    return cites.select("citing", F.col("c.id").alias("cited"), F.col("c.title").alias("cited_title"), F.explode("c.contexts").alias("x")).select("citing", "cited", "cited_title", "x.*")


def load_patch(spark: SparkSession, path: str) -> DataFrame:
    """op, path, value of a JSON list of changes, compressed or not."""
    rows = files(spark, path).select(F.explode(F.from_json("value", "array<struct<op:string,path:string,value:string>>")).alias("x"))
    return rows.select("x.*")


def import_root(spark: SparkSession, path: str, wanted: str = "papers.json") -> str:
    """The first folder of an unpacked corpus that has the store: data/db, db, or the top."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in (f"{path}/data/db", f"{path}/db", path):
        at = jvm.org.apache.hadoop.fs.Path(f"{folder}/{wanted}")
        if at.getFileSystem(conf).exists(at):
            return folder
    raise FileNotFoundError(f"no {wanted} in {path}")


def authors_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """authors and paper_authors from persons and institutions."""
    docs = files(spark, path)
    both = _entries(docs, "persons", PERSON).withColumn("type", F.lit("person")).unionByName(_entries(docs, "institutions", PERSON).withColumn("type", F.lit("institution")))
    authors = both.select(F.col("key").alias("author_id"), F.coalesce("canonical_name", "name").alias("canonical_name"), "type", F.array_join(F.coalesce("name_variants", F.array("name")), "|").alias("name_variants"), F.coalesce("paper_count", F.size("papers")).alias("paper_count"), F.coalesce("owned_paper_count", F.lit(0)).alias("owned_paper_count"))
    return authors, both.select(F.explode("papers").alias("paper_id"), F.col("key").alias("author_id"))


def findings_of(found: DataFrame) -> DataFrame:
    """The findings of (file, value); files that hold no JSON object are left out, one without an id goes by its name."""
    schema = "id string, title string, question string, summary string, tags array<string>, papers array<struct<paper_id:string,relevance:string,note:string>>"
    rows = found.filter(F.col("value").rlike(r"^\s*\{")).select("file", F.from_json("value", schema).alias("x")).filter("x is not null")
    return rows.select(F.coalesce("x.id", "file").alias("finding_id"), "x.title", "x.question", "x.summary", "x.tags", "x.papers")


def load_findings(spark: SparkSession, path: str) -> DataFrame:
    return findings_of(files(spark, path))


def changed_files(listing: DataFrame, known: DataFrame) -> DataFrame:
    """path, state (new, changed, gone): by modification time and size."""
    both = listing.select("path", "mtime", "size").join(known.select("path", F.col("mtime").alias("m"), F.col("size").alias("s")), "path", "full_outer")
    state = F.when(F.col("m").isNull(), "new").when(F.col("mtime").isNull(), "gone").when((F.col("m") != F.col("mtime")) | (F.col("s") != F.col("size")), "changed")
    return both.select("path", state.alias("state")).filter("state is not null")


def build_state(listing: DataFrame) -> DataFrame:
    """source, n, newest, size of the files that a build read (source, path, mtime, size), to be kept with what it wrote."""
    return listing.groupBy("source").agg(F.count("*").alias("n"), F.max("mtime").alias("newest"), F.sum("size").alias("size"))


def stale_sources(listing: DataFrame, state: DataFrame) -> DataFrame:
    """source: those that a build must read again, since a file is new, gone or changed in time or size."""
    now = build_state(listing)
    both = now.join(state.toDF("source", "_n", "_newest", "_size"), "source", "full_outer")
    same = F.col("n").eqNullSafe(F.col("_n")) & F.col("newest").eqNullSafe(F.col("_newest")) & F.col("size").eqNullSafe(F.col("_size"))
    return both.filter(~same).select("source")


def inferred_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, aside) of JSON lines whose fields nobody declared.

    The schema is that of all lines together: a field that some lines lack is
    null there, one whose values have no common type stays a variant, so no
    value is lost.  Lines that hold no JSON object are set aside as they are;
    blank lines are neither.  Without any object there are no columns.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "").withColumn("v", F.try_parse_json("value"))
    good = F.coalesce(F.startswith(F.to_json("v"), F.lit("{")), F.lit(False))
    schema = lines.filter(good).select(F.schema_of_variant_agg("v")).first()[0] or "VOID"
    aside = lines.filter(~good).select("value")
    if not schema.startswith("OBJECT<") or schema == "OBJECT<>":
        return lines.filter(good).select(), aside
    # An object is a struct; a field that only ever is null has no type of its own.
    typed = re.sub(r": VOID(?=[,>])", ": STRING", schema.replace("OBJECT<>", "VARIANT").replace("OBJECT<", "STRUCT<"))
    return lines.filter(good).select(F.variant_get("v", "$", typed).alias("r")).select("r.*"), aside
