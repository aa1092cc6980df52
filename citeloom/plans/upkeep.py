"""Queries of maintenance and ingest: merges, extractions, forward citations, work lists, fetched answers, and name and id scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeloom.functions import text as T
from citeloom.operators import fetch, findings, ingest, maintain, resolve
from citeloom.plans.registry import query
from citeloom.sources import corpus as C
from citeloom.sources.corpus import with_views


def _part(spark, d):
    return C.table(spark, d, "part").withColumn("k", F.col("p_partkey"))


def _named(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


# Merges. Of every group of five papers that starts with an even five, the second and third join the first.
PLAN = "plan AS (SELECT p_partkey AS alias, p_partkey - p_partkey % 10 AS target FROM part WHERE p_partkey % 10 IN (1, 2) AND p_partkey > 10)"
MERGE_PAPERS = "old AS (SELECT p_partkey AS paper_id, CASE WHEN p_partkey % 10 = 0 THEN '' ELSE p_name END AS abstract, CASE WHEN p_partkey % 10 = 0 OR p_size % 3 = 2 THEN 'stub' WHEN p_size % 3 = 1 THEN 'external_owned' ELSE 'owned' END AS type FROM part)"


def _merge(spark, d):
    p = _part(spark, d).withColumn("size", F.col("p_size") % 3)
    kind = F.when((F.col("k") % 10 == 0) | (F.col("size") == 2), "stub").when(F.col("size") == 1, "external_owned").otherwise("owned")
    papers = p.select(F.col("k").alias("paper_id"), F.when(F.col("k") % 10 == 0, "").otherwise(F.col("p_name")).alias("abstract"), kind.alias("type"), F.lit(None).cast("long").alias("superseded_by"))
    plan = p.filter((F.col("k") % 10).isin(1, 2) & (F.col("k") > 10)).select((F.col("k") - F.col("k") % 10).alias("canonical_id"), F.col("k").alias("alias_id"))
    papers = papers.withColumn("superseded_by", F.col("superseded_by").cast("string"))
    text = lambda df, *cols: df.select(*[F.col(c).cast("string").alias(c) if c in cols else F.col(c) for c in df.columns])
    return maintain.merged(text(papers, "paper_id"), text(C.edges(spark, d), "citing_id", "cited_id"), text(plan, "canonical_id", "alias_id"), ["abstract"])


@query(
    "merged_papers",
    f"""WITH {PLAN}, {MERGE_PAPERS}, gain AS (SELECT target, min_by(abstract, CAST(alias AS VARCHAR)) AS abstract, bool_or(type <> 'stub') AS up FROM plan JOIN old ON paper_id = alias GROUP BY 1)
SELECT CAST(o.paper_id AS VARCHAR) AS paper_id, CASE WHEN o.abstract = '' THEN coalesce(g.abstract, '') ELSE o.abstract END AS abstract, CASE WHEN o.type = 'stub' AND g.up THEN 'external_owned' ELSE o.type END AS type, CAST(p.target AS VARCHAR) AS superseded_by
FROM old o LEFT JOIN gain g ON g.target = o.paper_id LEFT JOIN plan p ON p.alias = o.paper_id""",
)
def merged_papers(spark, d):
    return _merge(spark, d)[0]


@query("merged_edges", with_views("edges") + f", {PLAN} SELECT DISTINCT CAST(coalesce(a.target, citing_id) AS VARCHAR) AS citing_id, CAST(coalesce(b.target, cited_id) AS VARCHAR) AS cited_id FROM edges LEFT JOIN plan a ON a.alias = citing_id LEFT JOIN plan b ON b.alias = cited_id WHERE coalesce(a.target, citing_id) <> coalesce(b.target, cited_id)")
def merged_edges(spark, d):
    return _merge(spark, d)[1]


@query(
    "rewritten_lists",
    with_views("edges", recursive=True) + ", a AS (SELECT p_partkey AS alias, p_partkey // 3 AS target FROM part WHERE p_size <= 7 AND p_partkey > 0), w AS (SELECT alias, target FROM a UNION SELECT w.alias, a.target FROM w JOIN a ON w.target = a.alias), m AS (SELECT alias, target FROM w WHERE target NOT IN (SELECT alias FROM a)), "
    "e AS (SELECT citing_id, coalesce(target, cited_id) AS id, min(cited_id) AS first FROM edges LEFT JOIN m ON alias = cited_id GROUP BY 1, 2) SELECT citing_id AS paper_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY first) AS cites FROM e GROUP BY 1",
)
def rewritten_lists(spark, d):
    lists = C.edges(spark, d).groupBy(F.col("citing_id").alias("paper_id")).agg(F.array_sort(F.collect_set("cited_id")).alias("cites"))
    found = maintain.rewritten(lists, maintain.alias_closure(C.aliases(spark, d)), "cites")
    return found.select("paper_id", F.array_join(F.transform("cites", lambda x: x.cast("string")), ",").alias("cites"))


@query("adjacency", with_views("papers", "edges") + " SELECT paper_id, coalesce((SELECT string_agg(CAST(cited_id AS VARCHAR), ',' ORDER BY cited_id) FROM edges WHERE citing_id = paper_id), '') AS cites, coalesce((SELECT string_agg(CAST(citing_id AS VARCHAR), ',' ORDER BY citing_id) FROM edges WHERE cited_id = paper_id), '') AS cited_by FROM papers")
def adjacency(spark, d):
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return maintain.adjacency(C.edges(spark, d), C.papers(spark, d)).select("paper_id", text("cites"), text("cited_by"))


@query(
    "forced_import",
    """WITH l AS (SELECT p_partkey AS k, p_brand AS journal, CASE WHEN p_size % 2 = 0 THEN 'owned' ELSE 'stub' END AS type FROM part WHERE p_partkey % 4 <> 0), o AS (SELECT p_partkey AS k, p_type AS journal, CASE WHEN p_size % 3 = 0 THEN 'owned' ELSE 'stub' END AS type FROM part WHERE p_partkey % 5 <> 0)
SELECT coalesce(l.k, o.k) AS paper_id, CASE WHEN l.k IS NULL OR o.k IS NOT NULL AND l.type <> 'owned' THEN o.journal ELSE l.journal END AS journal, CASE WHEN l.k IS NULL THEN 'add' WHEN o.k IS NULL THEN 'keep' WHEN l.type <> 'owned' THEN 'replace' ELSE 'enrich' END AS action FROM l FULL OUTER JOIN o ON l.k = o.k""",
)
def forced_import(spark, d):
    p = _part(spark, d)
    one = lambda keep, journal, kind: p.filter(keep).select(F.col("k").alias("paper_id"), F.col(journal).alias("journal"), F.when(kind, "owned").otherwise("stub").alias("type"))
    found = maintain.imported(one("k % 4 <> 0", "p_brand", F.col("p_size") % 2 == 0), one("k % 5 <> 0", "p_type", F.col("p_size") % 3 == 0), ["journal"], force=True)
    return found.select("paper_id", "journal", "action")


# Extractions of every seventh paper: each cites the next paper, itself and one that is new.
EXTRACTED = "x AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 7 = 0), c AS (SELECT k AS citing_id, k + 1 AS id FROM x UNION ALL SELECT k, k FROM x UNION ALL SELECT k, 1000000 + k FROM x)"
NOW = f"{EXTRACTED}, now AS (SELECT citing_id, cited_id FROM edges WHERE citing_id NOT IN (SELECT k FROM x) UNION SELECT citing_id, id FROM c WHERE citing_id <> id)"


def _extracted(spark, d):
    p = _part(spark, d).filter("k % 7 = 0")
    cited = lambda n: p.select(F.col("k").alias("citing_id"), n.alias("id"), F.lit("a title").alias("title"))
    papers = C.papers(spark, d).select("paper_id", "title", "type")
    citations = cited(F.col("k") + 1).unionByName(cited(F.col("k"))).unionByName(cited(F.col("k") + 1000000))
    return maintain.added_extraction(papers, C.edges(spark, d), papers.filter("paper_id % 7 = 0"), citations)


@query("extraction_edges", with_views("edges") + f", {NOW} SELECT citing_id, cited_id FROM now")
def extraction_edges(spark, d):
    return _extracted(spark, d)[1]


@query(
    "extraction_papers",
    with_views("papers", "edges") + f""", {NOW}, every AS (SELECT paper_id, title, type FROM papers WHERE paper_id NOT IN (SELECT k FROM x) UNION ALL SELECT DISTINCT id, 'a title', 'stub' FROM c WHERE id NOT IN (SELECT paper_id FROM papers))
SELECT paper_id, title, type FROM every WHERE NOT (type = 'stub' AND paper_id IN (SELECT cited_id FROM edges WHERE citing_id IN (SELECT k FROM x)) AND paper_id NOT IN (SELECT cited_id FROM now)) UNION ALL SELECT paper_id, title, 'owned' FROM papers WHERE paper_id IN (SELECT k FROM x)""",
)
def extraction_papers(spark, d):
    return _extracted(spark, d)[0]


# Forward citations: entries name a paper by external id, by DOI, or are new, some of them twice.
FORWARD = """e AS (SELECT p_partkey AS entry_id, p_partkey % 50 + 1 AS n, CASE p_partkey % 4 WHEN 0 THEN 's' || CAST(p_partkey // 4 AS VARCHAR) WHEN 2 THEN 'new' || CAST(p_partkey // 8 AS VARCHAR) END AS s2, CASE p_partkey % 4 WHEN 1 THEN '10.1/' || CAST(p_partkey // 4 AS VARCHAR) END AS doi, p_partkey AS k, p_name AS title FROM part WHERE p_partkey > 4),
base AS (SELECT e.*, 'doe_2001_' || split_part(regexp_replace(lower(title), '^(the|of) ', ''), ' ', 1) AS base, CASE k % 4 WHEN 0 THEN 'p' || CAST(k // 4 AS VARCHAR) WHEN 1 THEN 'p' || CAST(k // 4 AS VARCHAR) END AS known, coalesce(s2, doi, trim(regexp_replace(lower(title), '\\s+', ' ', 'g'))) AS key FROM e),
first AS (SELECT * FROM base WHERE known IS NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY entry_id) = 1), numbered AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY entry_id) AS r FROM first), stubs AS (SELECT key, title, CASE WHEN r = 1 THEN base ELSE base || '_' || CAST(r AS VARCHAR) END AS paper_id FROM numbered)"""


def _forward(spark, d):
    p = _part(spark, d)
    k = F.col("k")
    papers = p.select(_named("p", k).alias("paper_id"), _named("s", k).alias("s2_id"), _named("https://doi.org/10.1/", k).alias("doi"))
    s2 = F.when(k % 4 == 0, _named("s", F.floor(k / 4))).when(k % 4 == 2, _named("new", F.floor(k / 8))).otherwise("")
    entries = p.filter("k > 4").select(k.alias("entry_id"), _named("p", k % 50 + 1).alias("cited_id"), F.col("p_name").alias("title"), F.array(F.lit("Doe, J.")).alias("authors"), F.lit(2001).alias("year"), s2.alias("s2_id"), F.when(k % 4 == 1, _named("10.1/", F.floor(k / 4))).otherwise("").alias("doi"))
    edges = p.select(_named("p", k).alias("citing_id"), F.lit("p1").alias("cited_id"))
    return maintain.applied_forward(papers, edges, entries)


@query("forward_stubs", f"WITH {FORWARD} SELECT paper_id, title FROM stubs")
def forward_stubs(spark, d):
    return _forward(spark, d)[0].select("paper_id", "title")


CITERS = FORWARD + ", citers AS (SELECT DISTINCT coalesce(known, s.paper_id) AS citing_id, 'p' || CAST(n AS VARCHAR) AS cited_id FROM base LEFT JOIN stubs s USING (key) WHERE coalesce(known, s.paper_id) <> 'p' || CAST(n AS VARCHAR))"


@query("forward_edges", f"WITH {CITERS} SELECT citing_id, cited_id FROM citers WHERE NOT (cited_id = 'p1' AND citing_id IN (SELECT 'p' || CAST(p_partkey AS VARCHAR) FROM part))")
def forward_edges(spark, d):
    return _forward(spark, d)[1]


@query("forward_lists", f"WITH {CITERS} SELECT cited_id AS paper_id, string_agg(citing_id, ',' ORDER BY citing_id) AS forward_cited_by FROM citers GROUP BY 1")
def forward_lists(spark, d):
    return _forward(spark, d)[2].select("paper_id", F.array_join("forward_cited_by", ",").alias("forward_cited_by"))


# Decisions and review.
@query("merge_decisions", "SELECT CASE WHEN p_partkey % 2 = 0 THEN 'merge' ELSE 'skip' END AS action, CAST(p_partkey AS VARCHAR) AS canonical_id, unnest([p_brand, 'x' || CAST(p_partkey AS VARCHAR)]) AS alias_id FROM part WHERE p_partkey % 3 <> 0")
def merge_decisions(spark, d):
    k = F.col("k").cast("string")
    line = F.when(F.col("k") % 6 == 0, F.concat(F.lit("# merge "), k, F.lit(" a b"))).when(F.col("k") % 3 == 0, F.concat(F.lit("merge "), k)).otherwise(F.concat(F.when(F.col("k") % 2 == 0, " merge ").otherwise("skip  "), k, F.lit(" "), F.col("p_brand"), F.lit("  x"), k))
    return maintain.parse_merge_decisions(_part(spark, d).select(line.alias("value")))


@query("author_decisions", "SELECT p_name AS name, 'a' || CAST(p_partkey AS VARCHAR) AS author_id, p_partkey % 5 = 1 AS override FROM part WHERE p_partkey % 5 <> 0")
def author_decisions(spark, d):
    from citeloom.operators import authors

    k = F.col("k")
    line = F.concat(F.when(k % 5 == 0, "# ").when(k % 5 == 1, "OVERRIDE: ").otherwise(""), F.col("p_name"), F.lit(" -> a"), k.cast("string"))
    return authors.parse_decisions(_part(spark, d).select(line.alias("value")))


@query("skip_pairs", "WITH g AS (SELECT p_partkey // 4 AS g, CAST(p_partkey AS VARCHAR) AS id FROM part) SELECT a.id || '|||' || b.id AS pair_key FROM g a JOIN g b ON a.g = b.g AND a.id < b.id")
def skip_pairs(spark, d):
    return maintain.skip_pairs(_part(spark, d).select(F.floor(F.col("k") / 4).alias("group"), F.col("k").cast("string").alias("paper_id")))


@query("cleared_flags", "SELECT p_partkey AS paper_id, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 <> 0 THEN true END AS dedup_pending FROM part")
def cleared_flags(spark, d):
    p = _part(spark, d).select(F.col("k").alias("paper_id"), F.when(F.col("k") % 2 == 0, True).alias("dedup_pending"))
    return maintain.cleared(p, p.filter("paper_id % 3 = 0").unionByName(p.filter("paper_id % 9 = 0")))


@query("adopted_papers", "SELECT p_partkey AS paper_id, CASE WHEN p_partkey % 2 = 0 THEN 'owned' ELSE CASE WHEN p_partkey % 4 = 1 THEN 'external_owned' ELSE 'stub' END END AS type, CASE WHEN p_partkey % 4 = 0 THEN 'f' || CAST(p_partkey AS VARCHAR) ELSE '' END AS text_file, CASE WHEN p_partkey % 4 <> 0 THEN 'other' END AS source_db FROM part")
def adopted_papers(spark, d):
    """External papers among those with an even key become owned."""
    k = F.col("k")
    p = _part(spark, d).select(k.alias("paper_id"), F.when(k % 4 == 2, "owned").when(k % 4 == 3, "stub").otherwise("external_owned").alias("type"), F.lit("").alias("text_file"), F.lit("other").alias("source_db"))
    return maintain.adopted(p, _part(spark, d).filter("k % 2 = 0").select(k.alias("paper_id"), _named("f", k).alias("text_file")))


@query("review_lines", "SELECT p_partkey // 4 AS \"group\", 'GROUP ' || CAST(p_partkey // 4 AS VARCHAR) || chr(10) || string_agg('- ' || CAST(p_partkey AS VARCHAR) || ' [stub] ' || CASE WHEN p_partkey % 3 = 0 THEN '(no title)' ELSE p_name END || ' (n.d.) cites 1, cited by 2', chr(10) ORDER BY p_partkey) AS text FROM part GROUP BY 1")
def review_lines(spark, d):
    p = _part(spark, d)
    papers = p.select(F.col("k").alias("paper_id"), F.lit("stub").alias("type"), F.when(F.col("k") % 3 == 0, "").otherwise(F.col("p_name")).alias("title"), F.lit(None).cast("int").alias("year"), F.lit(1).alias("n_cites"), F.lit(2).alias("n_cited_by"))
    return maintain.review_lines(p.select(F.floor(F.col("k") / 4).alias("group"), F.col("k").alias("paper_id")), papers)


@query("paper_summaries", with_views("papers", "edges") + " SELECT paper_id, title, year, type, abstract, CAST((SELECT count(*) FROM edges WHERE citing_id = paper_id) AS INTEGER) AS n_cites, CAST((SELECT count(*) FROM edges WHERE cited_id = paper_id) AS INTEGER) AS n_cited_by FROM papers")
def paper_summaries(spark, d):
    lists = maintain.adjacency(C.edges(spark, d), C.papers(spark, d))
    return ingest.paper_summaries(C.papers(spark, d).join(lists, "paper_id"))


# Ingest.
@query(
    "text_chunks",
    r"""WITH RECURSIVE ends AS (SELECT doc_id, coalesce(text, '') AS t, 0 AS chunk, CAST(0 AS BIGINT) AS a FROM documents
UNION ALL SELECT doc_id, t, chunk + 1, a + 2800 + place FROM (SELECT *, CASE WHEN regexp_matches(z, '(?s)^(.*\n)?#{1,3}\s') THEN length(regexp_extract(z, '(?s)^(.*\n|)#{1,3}\s', 1))
    WHEN instr(z, chr(10) || chr(10)) > 0 THEN length(regexp_extract(z, '(?s)^(.*)\n\n', 1)) + 1 WHEN instr(z, chr(10)) > 0 THEN length(regexp_extract(z, '(?s)^(.*)\n', 1)) + 1 ELSE 1200 END AS place FROM (SELECT *, substr(t, a + 2801, 1200) AS z FROM ends WHERE length(t) - a > 4000))),
b AS (SELECT *, lead(a, 1, length(t)) OVER (PARTITION BY doc_id ORDER BY chunk) AS z, chunk = max(chunk) OVER (PARTITION BY doc_id) AS final FROM ends)
SELECT doc_id, chunk, substr(t, a + 1, z - a) AS text FROM b WHERE chunk = 0 OR NOT final OR regexp_matches(substr(t, a + 1, z - a), '\S')""",
)
def text_chunks(spark, d):
    return ingest.chunks(C.table(spark, d, "documents"), "doc_id", "text", 4000)


_BLANK = r"regexp_replace(x, '[ \t]', '', 'g')"
_COUNT = lambda c: f"length(regexp_replace(x, '{c}', '', 'g'))"
_SPLIT = r"list_filter(regexp_split_to_array(x, '[ \t]+'), lambda w: w <> '')"
_OF = f"greatest(length({_BLANK}), 1)"
_LETTERS, _DIGITS, _COMMAS = _COUNT(r"\P{L}"), _COUNT(r"\P{Nd}"), _COUNT("[^,]")
_TITLE = rf"100 * {_LETTERS} >= 70 * {_OF} AND 100 * {_DIGITS} <= 12 * {_OF} AND 100 * (length({_BLANK}) - {_LETTERS} - {_DIGITS}) <= 15 * {_OF} AND length(x) >= 16 AND len({_SPLIT}) >= 4 AND 4 * {_COMMAS} <= len({_SPLIT}) AND regexp_matches(x, '[\p{{L}}\p{{Nd}}.?!)]$')"
_AUTHORS = rf"{_COMMAS} >= 1 AND length(x) < 200 AND 100 * {_DIGITS} <= 12 * {_OF} AND 2 * len(list_filter({_SPLIT}, lambda w: regexp_matches(w, '^[^\p{{L}}]*\p{{Lu}}'))) >= len({_SPLIT}) AND len({_SPLIT}) <= 4 * ({_COMMAS} + 1)"


@query(
    "guessed_metadata",
    rf"""WITH l AS (SELECT doc_id, list_filter(list_transform(list_filter(list_transform(string_split(substr(text, 1, 3000), chr(10)), lambda x: regexp_replace(x, '^[\s\x0B]+|[\s\x0B]+$', '', 'g')), lambda x: x <> '' AND NOT starts_with(x, '=') AND NOT starts_with(x, 'PAGE')), lambda x: regexp_replace(x, '^#{{1,6}}[ \t]+', '')), lambda x: x <> '') AS lines FROM documents),
p AS (SELECT doc_id, lines, list_position(list_transform(lines, lambda x: {_TITLE}), true) AS place FROM l)
SELECT doc_id, CASE WHEN place > 0 THEN lines[place] ELSE '' END AS title, CAST(CASE WHEN place > 0 THEN least(3, len(list_filter(lines[place + 1:], lambda x: {_AUTHORS}))) ELSE 0 END AS INTEGER) AS n_authors FROM p""",
)
def guessed_metadata(spark, d):
    return C.table(spark, d, "documents").select("doc_id", ingest.guessed_metadata(F.col("text")).alias("m")).select("doc_id", "m.title", F.size("m.authors").alias("n_authors"))


@query("pages_of_texts", "SELECT p_partkey AS doc_id, unnest([1, 2]) AS page, unnest([p_name, p_type]) AS body FROM part")
def pages_of_texts(spark, d):
    rule = "=" * 80
    page = lambda n, body: F.concat(F.lit(f"{rule}\nPAGE {n}\n{rule}\n"), F.col(body))
    texts = _part(spark, d).select(F.col("k").alias("doc_id"), F.concat(F.lit("cover\n"), page(1, "p_name"), F.lit("\n"), page(2, "p_type")).alias("text"))
    found = ingest.pages(texts, "doc_id", "text")
    return found.select("doc_id", "page", F.trim(F.regexp_replace("text", rf"{rule}\nPAGE \d+\n{rule}\n|\n$", "")).alias("body"))


@query("verified_titles", "SELECT p_partkey AS ref, kind AS candidate FROM part, (VALUES ('year'), ('name')) v(kind) WHERE kind = 'year' OR p_partkey % 2 = 0")
def verified_titles(spark, d):
    """Of four candidates for each title those with its year, or its author's surname, and nearly its words."""
    k = F.col("k")
    wanted = _part(spark, d).select(k.alias("ref"), F.upper("p_name").alias("title"), F.lit("1999").alias("year"), F.lit("Doe, J.").alias("author"))
    one = lambda kind, title, year, author: _part(spark, d).select(k.alias("ref"), F.lit(kind).alias("candidate"), title.alias("title"), F.lit(year).alias("year"), author.alias("author"))
    name = F.col("p_name")
    found = one("year", name, "1999", F.lit("X Y")).unionByName(one("name", name, "2005", F.when(k % 2 == 0, "Jane Doe").otherwise("Jane Doerr"))).unionByName(one("other", F.lit("zzz qqq xxx jjj vvv"), "1999", F.lit("Doe, J."))).unionByName(one("none", name, "2005", F.lit("")))
    return ingest.verified_titles(wanted, found)


@query(
    "external_ids",
    "SELECT p_partkey AS paper_id, 's' || CAST(p_partkey AS VARCHAR) AS s2_id, CASE WHEN p_partkey % 3 = 0 THEN '2101.' || CAST(p_partkey AS VARCHAR) END AS arxiv_id, '10.2139/ssrn.' || CAST(p_partkey AS VARCHAR) AS doi, CASE WHEN p_partkey % 3 = 0 THEN 'arxiv' ELSE 'ssrn' END AS preprint_server FROM part",
)
def external_ids(spark, d):
    k = F.col("k")
    ids = F.struct(F.when(k % 3 == 0, _named("2101.", k)).otherwise("").alias("ArXiv"), _named("10.2139/SSRN.", k).alias("DOI"))
    answer = F.to_json(F.struct(_named("s", k).alias("paperId"), ids.alias("externalIds")))
    return _part(spark, d).select(k.alias("paper_id"), ingest.external_ids(answer).alias("x")).select("paper_id", "x.s2_id", "x.arxiv_id", "x.doi", "x.preprint_server")


@query(
    "citing_records",
    "SELECT p_partkey AS k, p_name AS title, 'Doe, Jane|Plato' AS authors, CAST(1990 + p_partkey % 35 AS INTEGER) AS year, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_type END AS journal, CASE WHEN p_partkey % 3 = 0 THEN '10.1/x' || CAST(p_partkey AS VARCHAR) END AS doi, 's' || CAST(p_partkey AS VARCHAR) AS s2_paper_id, '' AS abstract FROM part",
)
def citing_records(spark, d):
    """Entries of a service's list of citations as records."""
    k = F.col("k")
    paper = F.struct(F.col("p_name").alias("title"), F.array(F.struct(F.lit("Jane Doe").alias("name")), F.struct(F.lit("Plato").alias("name"))).alias("authors"), (1990 + k % 35).alias("year"), F.when(k % 2 == 0, F.struct(F.col("p_brand").alias("name"))).alias("publicationVenue"), F.struct(F.col("p_type").alias("name")).alias("journal"), F.struct(F.when(k % 3 == 0, _named("https://doi.org/10.1/X", k)).alias("DOI")).alias("externalIds"), _named("s", k).alias("paperId"))
    r = _part(spark, d).select("k", fetch.citing_record(F.to_json(F.struct(paper.alias("citingPaper")))).alias("r")).select("k", "r.*")
    return r.withColumn("authors", F.array_join("authors", "|"))


_CHOICES = """CASE k % 6 WHEN 0 THEN '2101.0000' || CAST(k % 9 AS VARCHAR) || 'v2' WHEN 1 THEN '10.48550/arXiv.2101.' || CAST(10000 + k AS VARCHAR) WHEN 2 THEN 'https://arxiv.org/abs/2101.' || CAST(10000 + k AS VARCHAR) || 'v3' WHEN 3 THEN 'https://doi.org/10.1101/' || CAST(k AS VARCHAR) WHEN 4 THEN 'doe_2001_title' ELSE '10.5/' || CAST(k AS VARCHAR) END"""


@query(
    "download_choices",
    f"""WITH p AS (SELECT p_partkey AS k FROM part) SELECT k, {_CHOICES} AS identifier, CASE WHEN k % 4 = 0 THEN 'https://free/' || CAST(k AS VARCHAR) WHEN k % 6 = 0 THEN 'https://arxiv.org/pdf/2101.0000' || CAST(k % 9 AS VARCHAR) WHEN k % 6 IN (1, 2) THEN 'https://arxiv.org/pdf/2101.' || CAST(10000 + k AS VARCHAR) WHEN k % 6 = 3 THEN 'https://www.biorxiv.org/content/10.1101/' || CAST(k AS VARCHAR) || '.full.pdf'
  WHEN k % 6 = 4 THEN 'https://www.biorxiv.org/content/10.1101/z' || CAST(k AS VARCHAR) || '.full.pdf' END AS url, CASE WHEN k % 4 = 0 THEN 's2_open_access' WHEN k % 6 < 3 THEN 'arxiv_direct' WHEN k % 6 < 5 THEN 'biorxiv_direct' WHEN k % 5 = 0 THEN 'not_found' ELSE 'not_open_access' END AS source FROM p""",
)
def download_choices(spark, d):
    k = F.col("k")
    text = k.cast("string")
    identifier = F.when(k % 6 == 0, F.concat(F.lit("2101.0000"), (k % 9).cast("string"), F.lit("v2"))).when(k % 6 == 1, _named("10.48550/arXiv.2101.", 10000 + k)).when(k % 6 == 2, F.concat(_named("https://arxiv.org/abs/2101.", 10000 + k), F.lit("v3"))).when(k % 6 == 3, _named("https://doi.org/10.1101/", k)).when(k % 6 == 4, "doe_2001_title").otherwise(_named("10.5/", k))
    free = F.when(k % 4 == 0, F.concat(F.lit("https://free/"), text))
    return _part(spark, d).select("k", identifier.alias("identifier"), fetch.download_choice(identifier, _named("DOI:10.1101/Z", k), free, k % 5 != 0).alias("c")).select("k", "identifier", "c.url", "c.source")


@query("lookup_keys", "SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN 'DOI:10.1/' || CAST(p_partkey AS VARCHAR) WHEN p_partkey % 3 = 0 THEN 'TITLE:' || p_name END AS wanted FROM part")
def lookup_keys(spark, d):
    k = F.col("k")
    return _part(spark, d).select("k", fetch.service_id(F.when(k % 2 == 0, _named("doi: 10.1/", k)).otherwise(""), F.when(k % 3 == 0, F.concat(F.lit(" "), "p_name"))).alias("wanted"))


@query("import_matches", "SELECT 'paper_' || CAST(p_partkey AS VARCHAR) || '_of_the_year_with_a_name' AS paper_id, CASE p_partkey % 3 WHEN 0 THEN 'paper_' || CAST(p_partkey AS VARCHAR) || '_of_the_year_with_a_name' WHEN 1 THEN left('paper_' || CAST(p_partkey AS VARCHAR) || '_of_the_year_with_a_name', 30) || '-scan' ELSE 'x lengthy' || CAST(p_partkey AS VARCHAR) || ' document' END AS stem, CASE p_partkey % 3 WHEN 0 THEN 'id' WHEN 1 THEN 'prefix' ELSE 'title' END AS how FROM part")
def import_matches(spark, d):
    k = F.col("k")
    pid = F.concat(F.lit("paper_"), k.cast("string"), F.lit("_of_the_year_with_a_name"))
    title = F.concat(F.lit("A Lengthy"), k.cast("string"), F.lit(" Document of it"))
    stem = F.when(k % 3 == 0, pid).when(k % 3 == 1, F.concat(F.substring(pid, 1, 30), F.lit("-scan"))).otherwise(F.concat(F.lit("x lengthy"), k.cast("string"), F.lit(" document")))
    p = _part(spark, d)
    return fetch.import_matches(p.select(pid.alias("paper_id"), title.alias("title")), p.select(stem.alias("stem")))


@query("fetch_again", "SELECT p_partkey AS paper_id, CASE p_partkey % 5 WHEN 0 THEN 'never attempted' WHEN 1 THEN 'too old' ELSE 'retry' END AS reason FROM part WHERE p_partkey % 5 IN (0, 1, 4)")
def fetch_again(spark, d):
    """Never tried, too old, fresh, not found, failed."""
    k = F.col("paper_id")
    p = _part(spark, d).select(F.col("k").alias("paper_id"))
    log = p.filter("paper_id % 5 <> 0").select("paper_id", F.when(k % 5 < 3, "ok").when(k % 5 == 3, "not_found").otherwise("error").alias("result"), F.when(k % 5 == 1, "2024-01-01").otherwise("2024-03-01").alias("fetched"))
    return ingest.should_fetch(p, log, F.lit("2024-03-05").cast("date"))


@query("queued_requests", "SELECT p_partkey AS paper_id FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 3 <> 0")
def queued_requests(spark, d):
    p = _part(spark, d).select(F.col("k").alias("paper_id"))
    return ingest.new_requests(p.filter("paper_id % 2 = 0"), p, p.filter("paper_id % 3 = 0"))


@query("attached_contexts", "SELECT p_partkey AS paper_id, 'c1' AS id, CASE WHEN p_partkey % 2 = 0 THEN 'direct' ELSE 'by key' END AS quote FROM part")
def attached_contexts(spark, d):
    """Contexts by a citation's id, or by its key where no id fits."""
    p = _part(spark, d)
    citations = p.select(F.col("k").alias("paper_id"), F.lit("c1").alias("id"), F.lit("7").alias("citation_key"))
    contexts = p.select(F.col("k").alias("paper_id"), F.when(F.col("k") % 2 == 0, "c1").otherwise("ref_7").alias("ref"), F.when(F.col("k") % 2 == 0, "direct").otherwise("by key").alias("quote"))
    more = p.filter("k % 2 = 0").select(F.col("k").alias("paper_id"), F.lit("ref_7").alias("ref"), F.lit("left out").alias("quote"))
    return ingest.with_contexts(citations, contexts.unionByName(more)).select("paper_id", "id", "quote")


@query("overlaid", "SELECT p_partkey AS paper_id, CASE WHEN p_partkey % 4 = 0 THEN p_type ELSE p_name END AS summary FROM part")
def overlaid(spark, d):
    p = _part(spark, d).select(F.col("k").alias("paper_id"), "p_name", "p_type")
    over = p.filter("paper_id % 2 = 0").select("paper_id", F.when(F.col("paper_id") % 4 == 0, F.col("p_type")).alias("summary"))
    return ingest.overlaid(p.select("paper_id", F.col("p_name").alias("summary")), over, ["summary"])


@query("merged_stamps", f"WITH {PLAN}, a AS (SELECT target, string_agg(CAST(alias AS VARCHAR), ',' ORDER BY CAST(alias AS VARCHAR)) AS merged_from FROM plan GROUP BY 1) SELECT CAST(p_partkey AS VARCHAR) AS paper_id, CASE WHEN a.target IS NULL THEN '1' ELSE '1,2,3' END AS passes, 'own' AS model, coalesce(a.merged_from, '') AS merged_from FROM part LEFT JOIN a ON a.target = p_partkey WHERE p_partkey NOT IN (SELECT alias FROM plan)")
def merged_stamps(spark, d):
    """Stamps of merged extractions: all passes, the canonical paper's models first."""
    k = F.col("k")
    alias = (k % 10).isin(1, 2) & (k > 10)
    p = _part(spark, d)
    meta = p.select(k.cast("string").alias("paper_id"), F.when(alias, F.array(F.lit(3), F.lit(2))).otherwise(F.array(F.lit(1))).alias("passes"), F.create_map(F.lit("1"), F.when(alias, "other").otherwise("own")).alias("models"))
    closure = p.filter(alias).select(k.cast("string").alias("alias"), (k - k % 10).cast("string").alias("target"))
    found = ingest.merged_meta(meta, closure)
    return found.select("paper_id", F.array_join(F.transform("passes", lambda x: x.cast("string")), ",").alias("passes"), F.col("models")["1"].alias("model"), F.array_join("merged_from", ",").alias("merged_from"))


@query("extraction_stamps", "SELECT p_partkey AS paper_id, 'tool' AS extractor, CASE p_partkey % 4 WHEN 0 THEN '1' WHEN 1 THEN '1,2' WHEN 2 THEN '1,2,3' ELSE '1,2,3,4' END AS passes, CASE p_partkey % 4 WHEN 0 THEN 'metadata' WHEN 1 THEN 'contexts' WHEN 2 THEN 'analysis' ELSE 'full' END AS detail_level FROM part")
def extraction_stamps(spark, d):
    k = F.col("k")
    passes = F.reverse(F.slice(F.array(*map(F.lit, [1, 2, 3, 4])), F.lit(1), (k % 4 + 1).cast("int")))
    m = _part(spark, d).select(k.alias("paper_id"), ingest.extraction_meta(passes, F.create_map(F.lit("1"), F.lit("m")), "tool").alias("m")).select("paper_id", "m.*")
    return m.select("paper_id", "extractor", F.array_join(F.transform("passes_completed", lambda x: x.cast("string")), ",").alias("passes"), "detail_level")


# Names and ids.
@query(
    "identifiers",
    """WITH p AS (SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN 'https://x.org/' || CAST(p_partkey AS VARCHAR) WHEN 1 THEN '2101.00001v' || CAST(p_partkey AS VARCHAR) WHEN 2 THEN '10.48550/arXiv.2101.' || CAST(p_partkey AS VARCHAR) || 'v2' WHEN 3 THEN 'doe_2001_title' WHEN 4 THEN 'hep-th/0101001' ELSE p_name END AS s FROM part)
SELECT k, CASE k % 6 WHEN 0 THEN 'url' WHEN 1 THEN 'arxiv_id' WHEN 2 THEN 'doi' WHEN 3 THEN 'db_paper_id' WHEN 4 THEN 'arxiv_id' ELSE 'unknown' END AS kind, CASE k % 6 WHEN 1 THEN '2101.00001' WHEN 2 THEN lower(s) ELSE s END AS normalized, CASE k % 6 WHEN 2 THEN '2101.' || CAST(k AS VARCHAR) END AS arxiv FROM p""",
)
def identifiers(spark, d):
    k = F.col("k")
    s = F.when(k % 6 == 0, _named("https://x.org/", k)).when(k % 6 == 1, _named("2101.00001v", k)).when(k % 6 == 2, F.concat(_named("10.48550/arXiv.2101.", k), F.lit("v2"))).when(k % 6 == 3, "doe_2001_title").when(k % 6 == 4, "hep-th/0101001").otherwise(F.col("p_name"))
    return _part(spark, d).select("k", T.classify_identifier(s).alias("c"), T.arxiv_from_doi(s).alias("arxiv")).select("k", "c.kind", "c.normalized", "arxiv")


@query(
    "generated_ids",
    """WITH p AS (SELECT p_partkey AS k, 'van_dyke_' || CAST(1990 + p_partkey % 3 AS VARCHAR) || '_' || lower(split_part(p_name, ' ', 1)) AS base FROM part), n AS (SELECT k, base, row_number() OVER (PARTITION BY base ORDER BY k) AS r, CASE WHEN base LIKE '%1990%' THEN 1 ELSE 0 END AS skip FROM p)
SELECT k, CASE WHEN r + skip = 1 THEN base ELSE base || '_' || CAST(r + skip AS VARCHAR) END AS paper_id FROM n""",
)
def generated_ids(spark, d):
    """New ids, numbered where they repeat; those of 1990 have been taken once."""
    k = F.col("k")
    base = T.paper_id_base(F.concat(F.lit("The "), "p_name"), F.array(F.lit("Van Dyke, A."), F.lit("Other, B.")), (1990 + k % 3).cast("string"))
    bases = _part(spark, d).select("k", base.alias("base"))
    return resolve.assign_ids(bases, bases.filter("base like '%1990%'").select(F.col("base").alias("paper_id")).distinct(), "k").select("k", "paper_id")


@query(
    "names",
    """SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'doe' WHEN 1 THEN 'doe, roe' WHEN 2 THEN 'doe, roe, poe' ELSE 'doe, roe, poe et al.' END AS shown, CASE p_partkey % 4 WHEN 0 THEN 'van_der_berg' WHEN 1 THEN 'muller_ostrom' WHEN 2 THEN 'iea|international_energy_agency' ELSE 'obrien' END AS lastnames,
  CASE WHEN p_partkey % 2 = 0 THEN 'Doe, Jane B.' ELSE 'Plato' END AS flipped, regexp_replace(p_name, '[^A-Za-z0-9_.-]', '_', 'g') || '_.pdf' AS file, p_partkey % 4 = 3 OR p_partkey % 4 = 2 AS stale, CASE p_partkey % 4 WHEN 0 THEN 'van der berg' WHEN 1 THEN 'müller-oström' WHEN 2 THEN 'iea' ELSE 'o''brien' END AS last FROM part""",
)
def names(spark, d):
    k = F.col("k")
    of = lambda *values: F.when(k % 4 == 0, values[0]).when(k % 4 == 1, values[1]).when(k % 4 == 2, values[2]).otherwise(values[3])
    author = of("Van der Berg, A.", "Müller-Oström, B.", "IEA", "Conan O'Brien")
    return _part(spark, d).select(
        "k",
        T.format_authors(of("doe, J.", "doe, J.; roe, K.", "doe, J.; roe, K.; ; poe, L.", "doe, J.; roe, K.; poe, L.; moe, M.")).alias("shown"),
        F.array_join(T.normalize_author_lastname(of("Van der Berg, A.", "Müller-Oström, B.", "IEA", "O'Brien, C.")), "|").alias("lastnames"),
        T.flip_name(F.when(k % 2 == 0, "Jane B. Doe").otherwise("Plato")).alias("flipped"),
        T.safe_filename(F.concat("p_name", F.lit("?.pdf"))).alias("file"),
        T.stale(of("2024-03-01", "2024-02-20", "2024-01-01", "unknown"), F.lit("2024-03-05").cast("date")).alias("stale"),
        T.first_lastname(author).alias("last"),
    )


# Findings.
@query("findings_listed", "SELECT l_orderkey AS finding_id, 'Order ' || CAST(l_orderkey AS VARCHAR) AS title, CAST(count(DISTINCT l_partkey) AS INTEGER) AS n_papers, min(o_orderpriority) AS tags FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2")
def findings_listed(spark, d):
    return findings.listed(C.findings(spark, d))


@query("findings_search", "SELECT DISTINCT l_orderkey AS finding_id, 'Order ' || CAST(l_orderkey AS VARCHAR) AS title FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE contains(lower(o_orderpriority), 'urgent') OR contains('order ' || CAST(l_orderkey AS VARCHAR), '1urgent')")
def findings_search(spark, d):
    return findings.containing(C.findings(spark, d), "URGENT")


@query("findings_shared", "WITH f AS (SELECT DISTINCT l_orderkey AS f, l_partkey AS p FROM lineitem), best AS (SELECT f FROM f GROUP BY 1 ORDER BY count(*) DESC, f LIMIT 2) SELECT p AS paper_id FROM f WHERE f IN (SELECT f FROM best) GROUP BY 1 HAVING count(DISTINCT f) = 2")
def findings_shared(spark, d):
    pairs = findings.finding_papers(C.findings(spark, d)).select("finding_id", "paper_id").distinct()
    a, b = (r.finding_id for r in pairs.groupBy("finding_id").count().orderBy(F.desc("count"), "finding_id").limit(2).collect())
    return findings.overlap(pairs, a, b)


# More of the same families.
@query("text_stage_status", "SELECT stage, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 3 = 0 THEN (CASE WHEN p_partkey % 5 = 0 THEN 'done' ELSE 'in_process' END) ELSE 'staging' END AS stage FROM part) GROUP BY 1")
def text_stage_status(spark, d):
    p = _part(spark, d).select("k", F.col("k").cast("string").alias("stem"))
    none = p.filter("k < 0").select(F.col("stem").alias("text_stem"), F.col("stem").alias("paper_id"), F.lit(True).alias("has_passes"))
    ex = p.filter("k % 3 = 0").select(F.col("stem").alias("paper_id"), F.lit(None).cast("string").alias("source_stem"), (F.col("k") % 5 == 0).alias("has_meta"))
    return ingest.stage_counts(ingest.text_stages(p.select("stem"), none, ex))


_LOOKUP = "SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN 'doi:10.1/' || CAST(p_partkey AS VARCHAR) ELSE '' END AS doi, CASE WHEN p_partkey % 5 = 0 THEN 's' || CAST(p_partkey AS VARCHAR) END AS s2_id, p_name AS title FROM part"


@query(
    "lookup_targets",
    f"""WITH p AS ({_LOOKUP}) SELECT 'doi' AS mode, k AS paper_id, '10.1/' || CAST(k AS VARCHAR) AS wanted FROM p WHERE doi <> '' AND s2_id IS NULL UNION ALL SELECT 'title', k, title FROM p WHERE doi = '' AND s2_id IS NULL
UNION ALL SELECT 'enrich', k, s2_id FROM p WHERE s2_id IS NOT NULL AND k % 3 <> 0""",
)
def lookup_targets(spark, d):
    """The papers of each way to look identifiers up."""
    k = F.col("k")
    p = _part(spark, d).select(k.alias("paper_id"), F.when(k % 2 == 0, _named("doi:10.1/", k)).otherwise("").alias("doi"), F.when(k % 5 == 0, _named("s", k)).alias("s2_id"), F.col("p_name").alias("title"), F.when(k % 3 == 0, "x").otherwise("").alias("arxiv_id"), F.lit("").alias("pubmed_id"), F.lit("stub").alias("type"), F.lit(1).alias("cited_by_count"))
    one = lambda mode: ingest.lookup_targets(p, mode).select(F.lit(mode).alias("mode"), "paper_id", "wanted")
    return one("doi").unionByName(one("title")).unionByName(one("enrich"))


@query("title_searches", "SELECT p_partkey AS paper_id, p_name AS wanted, CAST(p_size % 3 AS INTEGER) AS turn FROM part ORDER BY p_size % 3, p_partkey % 7 DESC, p_partkey LIMIT 40")
def title_searches(spark, d):
    """The first forty titles to search for."""
    k = F.col("k")
    kind = F.when(F.col("p_size") % 3 == 0, "owned").when(F.col("p_size") % 3 == 1, "external_owned").otherwise("stub")
    p = _part(spark, d).select(k.alias("paper_id"), F.lit("").alias("doi"), F.lit("").alias("s2_id"), F.col("p_name").alias("title"), F.lit("").alias("arxiv_id"), F.lit("").alias("pubmed_id"), kind.alias("type"), (k % 7).alias("cited_by_count"))
    return ingest.lookup_targets(p, "title").limit(40)


@query(
    "alias_enriched",
    f"WITH {PLAN}, {MERGE_PAPERS}, gain AS (SELECT target, min_by(abstract, alias) AS abstract FROM plan JOIN old ON paper_id = alias WHERE abstract <> '' GROUP BY 1) SELECT paper_id, CASE WHEN o.abstract = '' THEN coalesce(g.abstract, '') ELSE o.abstract END AS abstract FROM old o LEFT JOIN gain g ON target = paper_id",
)
def alias_enriched(spark, d):
    k = F.col("k")
    papers = _part(spark, d).select(k.alias("paper_id"), F.when(k % 10 == 0, "").otherwise(F.col("p_name")).alias("abstract"))
    closure = _part(spark, d).filter((k % 10).isin(1, 2) & (k > 10)).select(k.alias("alias"), (k - k % 10).alias("target"))
    return maintain.enriched(papers, closure, ["abstract"])


@query(
    "merged_claims",
    f"WITH {PLAN}, c AS (SELECT p_partkey AS k, p_type AS claim, p_name AS source FROM part UNION ALL SELECT p_partkey, 'one for all', p_name FROM part), m AS (SELECT coalesce(target, k) AS paper_id, claim, source, target IS NULL AS own, k FROM c LEFT JOIN plan ON alias = k) SELECT paper_id, claim, source FROM m QUALIFY row_number() OVER (PARTITION BY paper_id, claim ORDER BY own DESC, k) = 1",
)
def merged_claims(spark, d):
    """Claims of merged extractions, by their text, the canonical paper's first."""
    k = F.col("k")
    p = _part(spark, d)
    rows = p.select(k.alias("paper_id"), F.col("p_type").alias("claim"), F.col("p_name").alias("source")).unionByName(p.select(k.alias("paper_id"), F.lit("one for all").alias("claim"), F.col("p_name").alias("source")))
    closure = p.filter((k % 10).isin(1, 2) & (k > 10)).select(k.alias("alias"), (k - k % 10).alias("target"))
    return ingest.merged_rows(rows, closure, ["claim"], ["source"])


@query("merged_strings", "SELECT p_partkey // 10 AS paper_id, min_by(CASE WHEN p_partkey % 2 = 0 THEN upper(p_type) ELSE lower(p_type) END, p_partkey) AS value FROM part GROUP BY 1, lower(p_type)")
def merged_strings(spark, d):
    """Lists of ten papers as one: the first spelling of each value."""
    k = F.col("k")
    items = _part(spark, d).select(F.floor(k / 10).alias("paper_id"), F.when(k % 2 == 0, F.upper("p_type")).otherwise(F.lower("p_type")).alias("value"), "k")
    return maintain.merged_strings(items, ["k"]).select("paper_id", "value")
