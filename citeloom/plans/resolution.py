"""Queries of entity resolution: duplicate papers and author entities, with SQL that scores pairs by itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.operators import authors as A
from citeloom.operators import bits, resolve
from citeloom.plans.registry import query
from citeloom.sources import corpus as C
from citeloom.sources import store
from citeloom.sources.corpus import VIEWS_SQL


def ratio_sql(a: str, b: str) -> str:
    """200 * LCS / (length(a) + length(b)): the longest common subsequence with a bit for each character of a, below 127."""
    full = f"((CAST(1 AS HUGEINT) << length({a})) - 1)"
    masks = f"list_transform(string_split({b}, ''), lambda c: list_sum(list_transform(range(length({a})), lambda i: CASE WHEN {a}[CAST(i + 1 AS INTEGER)] = c THEN CAST(1 AS HUGEINT) << CAST(i AS INTEGER) ELSE CAST(0 AS HUGEINT) END)))"
    return f"(200.0 * (length({a}) - bit_count(list_reduce([{full}] || {masks}, lambda r, m: ((r + (r & m)) | (r - (r & m))) & {full}))) / (length({a}) + length({b})))"


# Blocking.
PAPERS = """part_papers AS (SELECT p_partkey AS paper_id, p_name || ' a study of ' || p_brand || p_type || CAST(p_size AS VARCHAR) AS title, p_name AS short, p_brand || p_type || CAST(p_size AS VARCHAR) AS author_key,
  CASE WHEN p_partkey % 2 = 0 THEN 'd' || CAST(p_partkey // 4 AS VARCHAR) END AS doi, CASE WHEN p_partkey % 5 = 0 THEN 'S' || CAST(p_partkey // 10 AS VARCHAR) END AS s2_id, 1990 + p_partkey % 35 AS year,
  CASE WHEN p_size % 3 = 0 THEN 2 WHEN p_size % 3 = 1 THEN 1 ELSE 0 END AS kind, p_type AS abstract FROM part)"""


def _plain(title: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({title}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def _pairs_sql(title: str, families: list[str]) -> str:
    """CTEs up to pairs: id_a, id_b of the papers that share a key of a family, blocks of 2 to CAP for some."""
    prefix = f"array_to_string(list_slice(string_split({_plain(title)}, ' '), 1, 5), '_')"
    keys = {"author": ("author_key", resolve.CAP), "doi": ("doi", "NULL"), "s2": ("s2_id", "NULL"), "title": (f"CASE WHEN length({prefix}) > 8 THEN {prefix} END", resolve.CAP)}
    rows = " UNION ALL ".join(f"SELECT paper_id, '{f}' AS f, {keys[f][0]} AS k, {keys[f][1]} AS cap FROM part_papers" for f in families)
    return f"""WITH RECURSIVE {PAPERS}, keyed AS (SELECT * FROM ({rows}) WHERE k IS NOT NULL), blocks AS (SELECT f, k FROM keyed GROUP BY f, k HAVING max(cap) IS NULL OR count(*) BETWEEN 2 AND max(cap)),
pairs_of AS (SELECT DISTINCT x.paper_id AS id_a, y.paper_id AS id_b FROM keyed x JOIN keyed y ON x.f = y.f AND x.k = y.k AND x.paper_id < y.paper_id JOIN blocks b ON b.f = x.f AND b.k = x.k)"""


@query("candidate_pairs", _pairs_sql("short", ["author", "doi", "title"]) + " SELECT id_a, id_b FROM pairs_of")
def candidate_pairs(spark, d):
    return resolve.candidate_pairs(C.keyed_papers(spark, d))


@query("undecided_pairs", _pairs_sql("short", ["author", "doi", "title"]) + " SELECT id_a, id_b FROM pairs_of WHERE (id_a + id_b) % 5 <> 0 AND (id_a % 7 = 0 OR id_b % 7 = 0)")
def undecided_pairs(spark, d):
    papers = C.keyed_papers(spark, d).withColumn("dedup_pending", F.col("paper_id") % 7 == 0)
    pairs = store.cut(resolve.candidate_pairs(papers))
    return resolve.undecided(pairs, papers, pairs.filter("(id_a + id_b) % 5 = 0"))


# Scores. Points are rounded half to even; shares half up, as decimals.
_TIER = lambda value, tiers, k: "CASE " + " ".join(f"WHEN {value} >= {t[0]} THEN " + (repr(t[k]) if k == 1 else f"'{t[k]}'") for t in tiers) + (" ELSE 0.0 END" if k == 1 else " END")
_AJ = "CASE WHEN a.n_names > 0 AND b.n_names > 0 THEN len(list_intersect(a.names, b.names)) / len(list_distinct(list_concat(a.names, b.names))) ELSE 0 END"
_SHARE = "CASE WHEN len(a.{0}) > 0 AND len(b.{0}) > 0 THEN len(list_intersect(a.{0}, b.{0})) / (len(a.{0}) + len(b.{0}) - len(list_intersect(a.{0}, b.{0}))) ELSE 0 END"
SCORES = (
    _pairs_sql("title", ["author", "doi", "s2", "title"])
    + f""", pairs AS ({VIEWS_SQL['pairs']}), edges AS ({VIEWS_SQL['edges']}),
named AS (SELECT paper_id, list(lower(split_part(n, ',', 1)) ORDER BY n) AS names FROM (SELECT DISTINCT l_partkey AS paper_id, 'Name' || CAST(l_suppkey % 40 AS VARCHAR) || ', A.' AS n FROM lineitem) GROUP BY 1),
cited AS (SELECT citing_id AS paper_id, list(cited_id) AS cites FROM edges GROUP BY 1), citing AS (SELECT cited_id AS paper_id, list(citing_id) AS cited_by FROM edges GROUP BY 1),
full_papers AS (SELECT p.*, {_plain('title')} AS t, list_sort(string_split({_plain('title')}, ' ')) AS words, coalesce(names, []) AS names, coalesce(len(names), 0) AS n_names, coalesce(cites, []) AS cites, coalesce(cited_by, []) AS cited_by
  FROM part_papers p LEFT JOIN named USING (paper_id) LEFT JOIN cited USING (paper_id) LEFT JOIN citing USING (paper_id)),
titles AS (SELECT *, greatest({ratio_sql('t_a', 't_b')}, {ratio_sql('s_a', 's_b')}) / 100 AS sim FROM (SELECT DISTINCT a.t AS t_a, b.t AS t_b, array_to_string(a.words, ' ') AS s_a, array_to_string(b.words, ' ') AS s_b FROM pairs_of JOIN full_papers a ON a.paper_id = id_a JOIN full_papers b ON b.paper_id = id_b)),
met AS (SELECT id_a, id_b, sim, greatest(length(a.t), length(b.t)) AS title_len, {_AJ} AS aj, {_SHARE.format('cites')} AS cj, {_SHARE.format('cited_by')} AS bj, len(list_intersect(a.cited_by, b.cited_by)) AS n_citers,
  least(a.n_names, b.n_names) AS fewer, greatest(a.n_names, b.n_names) AS more, len(list_intersect(a.names, b.names)) AS shared, coalesce(a.names[1] = b.names[1], false) AS same_first, coalesce(a.doi = b.doi, false) AS same_doi, coalesce(a.s2_id = b.s2_id, false) AS same_s2,
  coalesce(a.s2_id <> b.s2_id, false) AS s2_mismatch, abs(a.year - b.year) AS gap, sim < 0.80 AND length(array_to_string(list_slice(string_split(a.t, ' '), 1, 5), '_')) > 8 AND list_slice(string_split(a.t, ' '), 1, 5) = list_slice(string_split(b.t, ' '), 1, 5) AS on_prefix
  FROM pairs_of JOIN full_papers a ON a.paper_id = id_a JOIN full_papers b ON b.paper_id = id_b JOIN titles ON t_a = a.t AND t_b = b.t),
pointed AS (SELECT *, {_TIER('aj', resolve.AUTHORS, 1)} AS author_points, bj >= 0.30 AND n_citers >= 3 AS citers FROM met),
held AS (SELECT *, author_points < 0.5 AND fewer BETWEEN 1 AND 2 AND more >= 3 AND shared = fewer AS contained FROM pointed),
scored AS (SELECT id_a, id_b, CAST(round_even(round((CASE WHEN same_s2 THEN 4.0 ELSE 0.0 END) + (CASE WHEN same_doi THEN 4.0 ELSE 0.0 END) + {_TIER('sim', resolve.TITLE, 1)} + (CASE WHEN on_prefix THEN 0.75 ELSE 0.0 END)
    + least((CASE WHEN contained THEN 0.5 ELSE author_points END) + (CASE WHEN same_first THEN 0.5 ELSE 0.0 END), 1.5) + (CASE gap WHEN 0 THEN 0.5 WHEN 1 THEN 0.3 WHEN 2 THEN 0.1 ELSE 0.0 END) + (CASE WHEN citers THEN 0.75 ELSE 0.0 END) + {_TIER('cj', resolve.CITES, 1)}, 6), 1) AS DOUBLE) AS score,
  concat_ws(',', {_TIER('sim', resolve.TITLE, 2)}, {_TIER('aj', resolve.AUTHORS, 2)}, {_TIER('cj', resolve.CITES, 2)}, CASE WHEN same_s2 THEN 's2_id_match' END, CASE WHEN same_doi THEN 'doi_match' END, CASE WHEN on_prefix THEN 'title_prefix' END, CASE WHEN same_first THEN 'first_author' END,
    CASE WHEN contained THEN 'author_contained' END, CASE gap WHEN 0 THEN 'year_match' WHEN 1 THEN 'year_close' WHEN 2 THEN 'year_near' END, CASE WHEN citers THEN 'cited_by_overlap' END) AS signals,
  round(sim + 1e-12, 3) AS title_similarity, CAST(title_len AS INTEGER) AS title_len, round(cj + 1e-12, 3) AS cites_jaccard, round(bj + 1e-12, 3) AS cited_by_jaccard, round(aj + 1e-12, 3) AS author_jaccard, s2_mismatch, same_s2, same_doi, same_first FROM held)"""
)
COLUMNS = ["id_a", "id_b", "score", "signals", "title_similarity", "title_len", "cites_jaccard", "cited_by_jaccard", "author_jaccard", "s2_mismatch"]


def _scored(spark, d):
    papers = C.full_papers(spark, d)
    return resolve.block_scores(papers), papers


@query("pair_scores", SCORES + f" SELECT {', '.join(COLUMNS)} FROM scored")
def pair_scores(spark, d):
    return _scored(spark, d)[0].withColumn("signals", F.array_join("signals", ",")).select(*COLUMNS)


AUTO = "(same_s2 OR same_doi OR title_similarity >= 0.97 AND title_len >= 40 AND score > 6.0 OR cites_jaccard >= 0.80 AND same_first AND score > 5.0 OR cites_jaccard >= 0.80 AND title_similarity >= 0.70)"
SKIP = "(title_similarity < 0.50 AND cites_jaccard = 0 AND score < 4.0 OR title_similarity < 0.30 AND NOT same_s2 AND NOT same_doi AND cites_jaccard < 0.50)"


def _classed(least: float) -> str:
    return SCORES + f", classed AS (SELECT *, CASE WHEN {AUTO} THEN 'auto' WHEN {SKIP} THEN 'skip' ELSE 'judgment' END AS bucket FROM scored WHERE NOT s2_mismatch AND ({AUTO} OR score >= {least}))"


@query("pair_buckets", _classed(resolve.THRESHOLD) + " SELECT bucket, count(*) AS n FROM classed GROUP BY 1")
def pair_buckets(spark, d):
    return resolve.classified(_scored(spark, d)[0]).groupBy("bucket").agg(F.count("*").alias("n"))


GROUPS = _classed(1.0) + """, links AS (SELECT id_a AS a, id_b AS b FROM classed WHERE bucket = 'auto' UNION SELECT id_b, id_a FROM classed WHERE bucket = 'auto'),
reach AS (SELECT DISTINCT a AS node, a AS near FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.near), members AS (SELECT node AS paper_id, min(near) AS grp FROM reach GROUP BY 1),
firm AS (SELECT m.grp, max(c.score) AS best FROM classed c JOIN members m ON m.paper_id = c.id_a JOIN members o ON o.paper_id = c.id_b AND o.grp = m.grp GROUP BY 1),
listed AS (SELECT grp, best, count(*) AS size, CASE WHEN best >= 7 THEN 'high' WHEN best >= 4.5 THEN 'medium' ELSE 'low' END AS confidence FROM firm JOIN members USING (grp) GROUP BY 1, 2)"""


def _grouped(spark, d):
    scored, papers = _scored(spark, d)
    found = store.cut(resolve.classified(scored, 1.0).select("id_a", "id_b", "score", "bucket"))
    return found, store.cut(resolve.groups(found, "auto")), papers


@query(
    "canonical",
    GROUPS + """ SELECT grp AS "group", paper_id AS canonical_id, best, size, confidence FROM (SELECT m.grp, p.paper_id, row_number() OVER (PARTITION BY m.grp ORDER BY kind DESC, doi IS NOT NULL DESC, len(cited_by) DESC, len(cites) DESC, length(title) DESC, p.paper_id) AS r
  FROM members m JOIN full_papers p USING (paper_id)) JOIN listed USING (grp) WHERE r = 1""",
)
def canonical(spark, d):
    found, members, papers = _grouped(spark, d)
    return resolve.canonical(members, papers).join(resolve.confidence(found, members, None), "group").select("group", "canonical_id", "best", "size", "confidence")


@query("auto_groups", GROUPS + ' SELECT paper_id, grp AS "group" FROM members')
def auto_groups(spark, d):
    """Papers that are one beyond doubt, without a pair made for an identifier."""
    return resolve.auto_groups(C.full_papers(spark, d), 1.0)


_IDS = {"doi": "p_brand || 'w' || CAST(p_partkey {div} 200 AS STRING)", "s2_id": "CASE WHEN p_size % 2 = 0 THEN 'S' || CAST(p_partkey {div} 40 AS STRING) || right(p_brand, 1) END"}


@query(
    "identifier_groups",
    f"""WITH RECURSIVE p AS (SELECT p_partkey AS paper_id, {_IDS['doi'].format(div='//')} AS doi, {_IDS['s2_id'].format(div='//')} AS s2_id FROM part),
links AS (SELECT a.paper_id AS a, b.paper_id AS b FROM p a JOIN p b ON a.paper_id <> b.paper_id AND (a.s2_id = b.s2_id OR a.doi = b.doi AND coalesce(a.s2_id = b.s2_id, true))),
reach AS (SELECT DISTINCT a AS node, a AS near FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.near) SELECT node AS paper_id, min(near) AS "group" FROM reach GROUP BY 1""",
)
def identifier_groups(spark, d):
    """Parts that share a DOI of some eight parts or an external id, unless the external ids differ."""
    part = C.table(spark, d, "part")
    return resolve.identifier_groups(part.select(F.col("p_partkey").alias("paper_id"), *[F.expr(x.format(div="div")).alias(c) for c, x in _IDS.items()]))


@query("confident_groups", GROUPS + ' SELECT grp AS "group", best, size, confidence FROM listed ORDER BY best DESC, grp LIMIT 50')
def confident_groups(spark, d):
    """The listing of groups, best first."""
    found, members, _ = _grouped(spark, d)
    return resolve.confidence(found, members).select("group", "best", "size", "confidence")


# The greedy choice as a recursion: each step takes the best pair left, then ids in order while all their pairs hold.
@query(
    "dense_parts",
    GROUPS + """, inside AS (SELECT m.grp, c.id_a AS a, c.id_b AS b, c.score FROM classed c JOIN members m ON m.paper_id = c.id_a JOIN members o ON o.paper_id = c.id_b AND o.grp = m.grp WHERE c.score >= 1.0),
whole AS (SELECT grp, list({'a': a, 'b': b} ORDER BY score DESC, a, b) AS pairs, list(CAST(a AS VARCHAR) || '-' || CAST(b AS VARCHAR)) AS keys, list_sort(list_distinct(list_concat(list(a), list(b)))) AS every FROM inside GROUP BY 1),
cut AS (SELECT grp, -1 AS part, CAST([] AS BIGINT[]) AS chosen, every AS free FROM whole
UNION ALL SELECT grp, part + 1, chosen, list_filter(free, lambda x: NOT list_contains(chosen, x)) FROM (SELECT c.grp, part, free, list_reduce([[first.a, first.b]] || list_transform(list_filter(free, lambda x: x <> first.a AND x <> first.b), lambda x: [x]),
    lambda held, x: CASE WHEN len(held) < 5 AND len(list_filter(held, lambda m: NOT list_contains(keys, CAST(least(m, x[1]) AS VARCHAR) || '-' || CAST(greatest(m, x[1]) AS VARCHAR)))) = 0 THEN list_concat(held, x) ELSE held END) AS chosen
  FROM (SELECT c.grp, part, free, keys, list_filter(pairs, lambda p: list_contains(free, p.a) AND list_contains(free, p.b))[1] AS first FROM cut c JOIN whole w ON w.grp = c.grp) c WHERE first IS NOT NULL))
SELECT grp AS "group", CAST(part AS INTEGER) AS part, unnest(chosen) AS paper_id FROM cut WHERE part >= 0""",
)
def dense_parts(spark, d):
    found, members, _ = _grouped(spark, d)
    return resolve.dense_parts(members, found, 1.0, 5)


# Two steps of one paper: known under a title, and as a citation.
@query(
    "duplicate_check",
    f"""WITH {PAPERS}, r AS (SELECT p_partkey AS ref, p_name || ' study of ' || p_brand || p_type || CAST(p_size AS VARCHAR) || '!' AS title FROM part WHERE p_partkey % 20 = 0),
rt AS (SELECT ref, {_plain('title')} AS t_a FROM r), pt AS (SELECT paper_id, kind, {_plain('title')} AS t_b FROM part_papers),
m AS (SELECT *, {ratio_sql('t_a', 't_b')} AS plain, {ratio_sql('s_a', 's_b')} AS ordered FROM (SELECT *, array_to_string(list_sort(string_split(t_a, ' ')), ' ') AS s_a, array_to_string(list_sort(string_split(t_b, ' ')), ' ') AS s_b FROM rt JOIN pt ON 3 * least(length(t_a), length(t_b)) >= 2 * greatest(length(t_a), length(t_b)))),
s AS (SELECT *, greatest(plain, ordered) / 100 AS sim FROM m), b AS (SELECT *, {_TIER('sim', resolve.TITLE, 1)} AS score, row_number() OVER (PARTITION BY ref ORDER BY {_TIER('sim', resolve.TITLE, 1)} DESC, paper_id) AS turn FROM s)
SELECT ref, paper_id, CAST(score AS DOUBLE) AS score, round(sim + 1e-12, 3) AS similarity, CASE kind WHEN 2 THEN 'local' WHEN 1 THEN 'external' ELSE 'stub' END AS match_type FROM b WHERE turn = 1 AND score >= 2""",
)
def duplicate_check(spark, d):
    """Of every twentieth paper a title that is nearly its own, against all papers."""
    p = C.titled_papers(spark, d)
    staged = C.table(spark, d, "part").filter("p_partkey % 20 = 0").select(F.col("p_partkey").alias("ref"), F.concat("p_name", F.lit(" study of "), "p_brand", "p_type", F.col("p_size").cast("string"), F.lit("!")).alias("title"))
    return resolve.duplicates_of(staged, p).select("ref", "paper_id", "score", "similarity", "match_type")


# Citations without an identifier: half of them under a title that no index knows, so that they are held against all papers.
_NEW = "CASE WHEN paper_id % 40 = 0 THEN title ELSE 'new ' || title END"
_AGAINST_ALL = (
    SCORES.replace("FROM pairs_of JOIN full_papers a", "FROM asked JOIN refs a")
    .replace("JOIN full_papers a ON", "JOIN refs a ON")
    .replace(
        "titles AS (SELECT *, greatest",
        f"refs AS (SELECT *, list_sort(string_split(t, ' ')) AS words FROM (SELECT paper_id, year, names, n_names, cites, [] AS cited_by, CAST(NULL AS VARCHAR) AS doi, CAST(NULL AS VARCHAR) AS s2_id, {_plain(_NEW)} AS t FROM full_papers WHERE paper_id % 20 = 0)),\n"
        "asked AS (SELECT r.paper_id AS id_a, p.paper_id AS id_b FROM refs r, full_papers p),\n"
        "titles AS (SELECT *, CASE WHEN 13 * least(length(t_a), length(t_b)) < 7 * greatest(length(t_a), length(t_b)) THEN 0 ELSE 1 END * greatest",
    )
)


@query(
    "scored_candidates",
    _AGAINST_ALL
    + """, found AS (SELECT id_a AS ref, id_b AS paper_id, score, list_slice(string_split(a.t, ' '), 1, 5) = list_slice(string_split(b.t, ' '), 1, 5) AND length(array_to_string(list_slice(string_split(a.t, ' '), 1, 5), '_')) > 8 AS indexed
  FROM scored JOIN refs a ON a.paper_id = id_a JOIN full_papers b ON b.paper_id = id_b WHERE score >= 1)
SELECT ref, paper_id, score FROM found f WHERE indexed OR NOT EXISTS (SELECT 1 FROM found o WHERE o.ref = f.ref AND o.indexed)""",
)
def scored_candidates(spark, d):
    """Every twentieth paper as a citation, against all papers."""
    p = C.full_papers(spark, d)
    title = F.when(F.col("paper_id") % 40 == 0, F.col("title")).otherwise(F.concat(F.lit("new "), "title"))
    cited = p.filter("paper_id % 20 = 0").select(F.col("paper_id").alias("ref"), title.alias("title"), "authors", "year", "cites", F.lit("none").alias("author_key"), F.lit(None).cast("string").alias("doi"))
    return resolve.candidates_of(cited, p).select(F.col("ref").cast("long").alias("ref"), "paper_id", "score")


@query(
    "indexed_candidates",
    f"""WITH {PAPERS}, c AS (SELECT p_partkey AS ref, CAST(p_partkey AS VARCHAR) AS id, p_name AS title, p_brand || p_type || CAST(p_size AS VARCHAR) AS author_key, CASE WHEN p_partkey % 4 = 0 THEN 'd' || CAST(p_partkey // 4 AS VARCHAR) END AS doi, 1990 + p_partkey % 35 AS year FROM part WHERE p_partkey % 20 = 0),
t AS (SELECT *, array_to_string(list_slice(string_split({_plain('title')}, ' '), 1, 5), '_') AS prefix FROM (SELECT * EXCLUDE (title), short AS title FROM part_papers)), u AS (SELECT *, array_to_string(list_slice(string_split({_plain('title')}, ' '), 1, 5), '_') AS prefix FROM c)
SELECT ref, paper_id, 'id' AS "by" FROM u JOIN t ON u.id = CAST(t.paper_id AS VARCHAR) UNION SELECT ref, paper_id, 'doi' FROM u JOIN t ON u.doi = t.doi UNION SELECT ref, paper_id, 'author_year' FROM u JOIN t ON u.author_key = t.author_key AND u.year = t.year
UNION SELECT ref, paper_id, 'title' FROM u JOIN t ON u.prefix = t.prefix AND length(u.prefix) > 8""",
)
def indexed_candidates(spark, d):
    """Every twentieth paper as a citation, against all papers."""
    p = C.keyed_papers(spark, d).join(C.papers(spark, d).select("paper_id", "year"), "paper_id")
    c = p.filter("paper_id % 20 = 0").select(F.col("paper_id").alias("ref"), F.col("paper_id").cast("string").alias("id"), "title", "author_key", F.when(F.col("paper_id") % 4 == 0, F.col("doi")).alias("doi"), "year")
    return resolve.indexed_candidates(c, p)


# Authors.
_KIND = "CASE s % 3 WHEN 0 THEN {0} WHEN 1 THEN {1} ELSE {2} END"
NAMED = f"raw AS (SELECT l_partkey AS paper_id, l_suppkey AS s, 'name' || CAST(l_suppkey % 40 AS VARCHAR) AS last FROM lineitem), n AS (SELECT paper_id, last, {_KIND.format(chr(39) + 'a' + chr(39), chr(39) + 'ab' + chr(39), chr(39) + 'cd' + chr(39))} AS i, 'N' || substr(last, 2) || ', ' || {_KIND.format(chr(39) + 'A.' + chr(39), chr(39) + 'Anna B.' + chr(39), chr(39) + 'C. D.' + chr(39))} AS name FROM raw)"
ENTITIES = "g AS (SELECT *, last || '_' || CASE WHEN i = 'a' AND last IN (SELECT last FROM n WHERE i = 'ab') THEN 'ab' ELSE i END AS grp FROM n), ent AS (SELECT grp, last, max(CASE i WHEN 'ab' THEN last || '_anna' ELSE last || '_' || i END) AS author_id, list_sort(list(DISTINCT i)) AS inits, list(DISTINCT CASE i WHEN 'ab' THEN 'anna' ELSE '' END) AS firsts FROM g GROUP BY 1, 2)"
LINKED = f"""WITH {NAMED}, {ENTITIES}, new AS (SELECT DISTINCT paper_id, last, i, CASE i WHEN 'ab' THEN 'ana' ELSE '' END AS first, replace(name, 'Anna', 'Ana') AS name FROM n),
scored AS (SELECT name, author_id, 1 + CASE WHEN list_contains(inits, i) THEN 2 WHEN len(list_filter(inits, lambda x: starts_with(i, x) OR starts_with(x, i))) > 0 THEN 1 ELSE -9 END
  + CASE WHEN first = '' OR len(list_filter(firsts, lambda x: x <> '')) = 0 THEN 0 WHEN list_contains(firsts, first) THEN 2 WHEN len(list_filter(firsts, lambda x: x <> '' AND {ratio_sql('first', 'x')} > 85)) > 0 THEN 1 ELSE -1 END AS score
  FROM (SELECT DISTINCT name, last, i, first FROM new) JOIN ent USING (last)), links AS (SELECT name, author_id, score FROM scored WHERE score > 0)"""
HOPS = LINKED + f""", pairs AS ({VIEWS_SQL['pairs']}), edges AS ({VIEWS_SQL['edges']}), step AS (SELECT citing_id AS a, cited_id AS b FROM edges UNION SELECT cited_id, citing_id FROM edges), mine AS (SELECT DISTINCT paper_id FROM new),
one AS (SELECT paper_id, b AS near, 1 AS hop FROM mine JOIN step ON a = paper_id), near AS (SELECT paper_id, near, min(hop) AS hop FROM (SELECT * FROM one UNION SELECT paper_id, b, 2 FROM one JOIN step ON a = near) WHERE paper_id <> near GROUP BY 1, 2),
of AS (SELECT DISTINCT paper_id AS near, author_id FROM g JOIN ent USING (grp)), close AS (SELECT paper_id, author_id, min(hop) AS hop FROM near JOIN of USING (near) GROUP BY 1, 2),
found AS (SELECT new.paper_id, new.name, l.author_id, l.score, coalesce(c.hop, 3) AS hop FROM new JOIN links l USING (name) LEFT JOIN close c ON c.paper_id = new.paper_id AND c.author_id = l.author_id),
kept AS (SELECT * FROM found f WHERE NOT EXISTS (SELECT 1 FROM found o WHERE o.paper_id = f.paper_id AND o.name = f.name AND o.hop < f.hop AND o.score >= 5))"""


def _links(spark, d):
    names = bits.once(C.author_names(spark, d), "paper_id", "name")
    groups = store.cut(A.person_groups(names))
    renamed = names.select("name").distinct().select("name", F.regexp_replace("name", "Anna", "Ana").alias("new"))
    new = names.join(renamed, "name").select("paper_id", F.col("new").alias("name"))
    return names, groups, new, store.cut(A.link_scores(new, groups.select("author_id", "canonical_name", "name_variants")))


@query("author_link_scores", LINKED + " SELECT name, author_id, CAST(score AS INTEGER) AS score FROM links")
def author_link_scores(spark, d):
    return _links(spark, d)[3]


@query("hop_candidates", HOPS + " SELECT paper_id, name, author_id, CAST(score AS INTEGER) AS score, CAST(hop AS INTEGER) AS hop FROM kept")
def hop_candidates(spark, d):
    names, groups, new, scores = _links(spark, d)
    return A.hop_candidates(new, scores, A.memberships(names, groups), C.edges(spark, d)).select("paper_id", "name", "author_id", "score", "hop")


@query("author_link_decisions", HOPS + """, best AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, hop, author_id) = 1)
SELECT n.name, CASE WHEN score IS NULL THEN 'new' WHEN score >= 3 THEN 'auto' ELSE 'judgment' END AS decision, author_id, CAST(score AS INTEGER) AS score FROM (SELECT DISTINCT name FROM new) n LEFT JOIN best USING (name)""")
def author_link_decisions(spark, d):
    names, groups, new, scores = _links(spark, d)
    return A.link_decisions(new, A.nearest_links(new, scores, A.memberships(names, groups), C.edges(spark, d)))


REVIEW = LINKED + """, of AS (SELECT DISTINCT paper_id, author_id FROM g JOIN ent USING (grp)), v AS (SELECT DISTINCT author_id, name AS variant FROM g JOIN ent USING (grp)),
one AS (SELECT author_id, arg_max(variant, length(variant)) AS canonical_name, string_agg(variant, ' | ' ORDER BY variant) AS variants, (SELECT count(*) FROM of WHERE of.author_id = v.author_id) AS papers FROM v GROUP BY 1),
co AS (SELECT DISTINCT a.name, b.name AS other FROM new a JOIN new b ON a.paper_id = b.paper_id AND a.name <> b.name), near AS (SELECT DISTINCT a.author_id, b.author_id AS co_id FROM of a JOIN of b USING (paper_id) WHERE a.author_id <> b.author_id),
held AS (SELECT DISTINCT l.name, l.author_id, co.other FROM links l JOIN co USING (name) JOIN near USING (author_id) JOIN v ON v.author_id = near.co_id AND v.variant = co.other),
others AS (SELECT l.name, l.author_id, canonical_name, row_number() OVER (PARTITION BY l.name, l.author_id ORDER BY co_id) AS r FROM links l JOIN near USING (author_id) JOIN one ON one.author_id = co_id WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.name = l.name AND h.author_id = l.author_id AND h.other = canonical_name)),
venues AS (SELECT author_id, j, first, row_number() OVER (PARTITION BY author_id ORDER BY first) AS r FROM (SELECT author_id, 'J' || CAST(paper_id % 7 AS VARCHAR) AS j, min(paper_id) AS first FROM of WHERE paper_id % 7 > 0 GROUP BY 1, 2)),
x AS (SELECT author_id, string_agg(j, ', ' ORDER BY first) AS venues FROM venues WHERE r <= 3 GROUP BY 1), y AS (SELECT name, author_id, string_agg(canonical_name, '; ' ORDER BY r) AS others FROM others WHERE r <= 3 GROUP BY 1, 2), z AS (SELECT name, author_id, string_agg(other, '; ' ORDER BY other) AS overlap FROM held GROUP BY 1, 2)
SELECT name, author_id, concat_ws(chr(10), name || ' -> ' || canonical_name || ' (' || author_id || ') [score: ' || CAST(CAST(score AS INTEGER) AS VARCHAR) || ']', '  Variants: ' || variants || ' | ' || CAST(papers AS VARCHAR) || ' papers',
  '  Coauthor overlap: ' || coalesce(overlap, '(none)'), '  Other coauthors: ' || others, '  Venues: ' || venues) AS text FROM links JOIN one USING (author_id) LEFT JOIN x USING (author_id) LEFT JOIN y USING (name, author_id) LEFT JOIN z USING (name, author_id)"""


@query("author_review", REVIEW)
def author_review(spark, d):
    """What a reviewer reads of every candidate entity of every new name."""
    names, groups, new, scores = _links(spark, d)
    journal = F.when(F.col("paper_id") % 7 > 0, F.concat(F.lit("J"), (F.col("paper_id") % 7).cast("string"))).otherwise("")
    papers = names.select("paper_id").distinct().withColumn("journal", journal)
    return A.review_text(A.review_evidence(new, scores, groups, A.memberships(names, groups), papers), groups)


@query(
    "author_update",
    f"""WITH {NAMED}, k AS (SELECT DISTINCT paper_id, name, last || '_' || i AS key, last, i, paper_id % 10 = 0 AS fresh FROM n),
old AS (SELECT paper_id, name, last || '_' || CASE WHEN i = 'a' AND last IN (SELECT last FROM k WHERE i = 'ab' AND NOT fresh) THEN 'ab' ELSE i END AS key FROM k WHERE NOT fresh)
SELECT key AS "group", count(DISTINCT paper_id) AS paper_count, string_agg(DISTINCT name, '|' ORDER BY name) AS name_variants FROM (SELECT * FROM old UNION SELECT paper_id, name, key FROM k WHERE fresh) GROUP BY 1""",
)
def author_update(spark, d):
    """Every tenth paper's authors added to the entities of all others."""
    names = C.author_names(spark, d)
    old = names.filter("paper_id % 10 <> 0")
    groups = store.cut(A.person_groups(old))
    return A.updated_groups(groups, A.memberships(old, groups), names.filter("paper_id % 10 = 0"))[0].select("group", "paper_count", "name_variants")


@query(
    "author_batch_groups",
    """WITH n AS (SELECT DISTINCT 'Name' || CAST(l_suppkey % 40 AS VARCHAR) AS last, l_suppkey % 3 AS k FROM lineitem)
SELECT last || ', ' || CASE k WHEN 0 THEN 'A. B.' WHEN 1 THEN 'Anna B.' ELSE 'C. D.' END AS name,
  lower(last) || CASE WHEN k = 1 OR k = 0 AND last IN (SELECT last FROM n WHERE k = 1) THEN '_anna' WHEN k = 0 THEN '_ab' ELSE '_cd' END AS author_id, CASE WHEN k = 0 THEN (SELECT max(m.last || ', Anna B.') FROM n m WHERE m.last = n.last AND m.k = 1) END AS primary_name FROM n""",
)
def author_batch_groups(spark, d):
    """Names that nobody knows, matched with each other."""
    s = F.col("l_suppkey")
    first = F.when(s % 3 == 0, "A. B.").when(s % 3 == 1, "Anna B.").otherwise("C. D.")
    names = C.table(spark, d, "lineitem").select(F.col("l_partkey").alias("paper_id"), F.concat(F.lit("Name"), (s % 40).cast("string"), F.lit(", "), first).alias("name"))
    return A.batch_groups(names, spark.createDataFrame([], "author_id string"))


@query("institutions", "WITH n AS (SELECT l_partkey AS paper_id, 'Bank & Co ' || CAST(l_suppkey % 7 AS VARCHAR) AS name FROM lineitem) SELECT 'bank_and_co_' || right(name, 1) AS author_id, name AS canonical_name, count(DISTINCT paper_id) AS paper_count FROM n GROUP BY 1, 2")
def institutions(spark, d):
    line = C.table(spark, d, "lineitem")
    firm = line.select(F.col("l_partkey").alias("paper_id"), F.concat(F.lit("Bank & Co "), (F.col("l_suppkey") % 7).cast("string")).alias("name"))
    return A.institutions(firm.unionByName(C.author_names(spark, d)).unionByName(line.select(F.col("l_partkey").alias("paper_id"), F.lit("et al.").alias("name"))))


@query(
    "authors_applied",
    f"WITH {NAMED}, {ENTITIES}, v AS (SELECT author_id, last, list_sort(list(DISTINCT name)) AS v FROM g JOIN ent USING (grp, last) GROUP BY 1, 2), x AS (SELECT *, 'N' || substr(last, 2) || ', Annabel Bea' AS more FROM v) SELECT author_id, CASE WHEN author_id LIKE '%_anna' THEN more ELSE v[1] END AS canonical_name, CASE WHEN author_id LIKE '%_anna' THEN array_to_string(list_sort(list_append(v, more)), '|') ELSE array_to_string(v, '|') END AS name_variants FROM x WHERE author_id LIKE '%_anna' OR len(v) = 1",
)
def authors_applied(spark, d):
    """A longer name decided for each Anna; entities of one variant stay as they are."""
    groups = store.cut(A.person_groups(C.author_names(spark, d)).select("author_id", "canonical_name", "name_variants"))
    anna = groups.filter(F.endswith("author_id", F.lit("_anna")))
    decisions = anna.select("author_id", F.concat(F.substring_index("canonical_name", ",", 1), F.lit(", Annabel Bea")).alias("name"))
    return A.applied(groups, decisions).filter(F.endswith("author_id", F.lit("_anna")) | ~F.contains("name_variants", F.lit("|")))
