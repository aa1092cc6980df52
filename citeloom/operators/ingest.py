"""From texts and extraction sidecars to records: chunks, guessed metadata, merged extractions, work lists."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import text as T
from citeloom.functions.similarity import indel_ratio
from citeloom.operators.maintain import blank, first_of_each
from citeloom.sources.documents import owned

CHUNK, PAGE_RULE = 160_000, "=" * 80
#: What lines of a title page look like: a title's fewest words and characters; shares in percent of their characters that aren't blank; an author line's greatest length.
TITLE_WORDS, TITLE_LENGTH, LETTERS, DIGITS, MARKS, AUTHOR_LENGTH = 4, 16, 70, 12, 15, 200


def cuts(text: str, most: int) -> list[int]:
    """Where chunks end: in the last 30 % of the room before a heading, else after a paragraph's or a line's end, else at the limit."""
    ends, start = [], 0
    while len(text) - start > most:
        low, high = start + int(most * 0.7), start + most
        zone = text[low:high]
        headings = [m.start() for m in re.finditer(r"(?m)^#{1,3}\s+", zone)]
        at = headings[-1] if headings else next((k + 1 for k in (zone.rfind("\n\n"), zone.rfind("\n")) if k >= 0), len(zone))
        start = low + at if low + at > start else high
        ends.append(start)
    return ends + [len(text)]


def chunks(docs: DataFrame, key: str, text: str, most: int = CHUNK) -> DataFrame:
    """key, chunk (from 0), text: each whole text in pieces of at most so many characters; a last piece of white space alone is left out."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for k, t in zip(part["k"], part["t"].fillna(""), strict=True):
                ends = cuts(t, most)
                for i, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
                    if i == 0 or i < len(ends) - 1 or t[a:b].strip():
                        rows.append((k, i, t[a:b]))
            yield pd.DataFrame(rows, columns=[key, "chunk", "text"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"`{key}` {kind}, chunk int, text string")


def pages(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, page, text of texts with page rules; what stands before the first page is left out."""
    rule = rf"{PAGE_RULE}\nPAGE \d+\n{PAGE_RULE}\n"
    piece = F.explode(F.filter(F.split(text, f"(?={rule})"), lambda p: p.rlike(f"^{rule}")))
    return docs.select(key, piece.alias("text")).select(key, F.regexp_extract("text", r"PAGE (\d+)", 1).cast("int").alias("page"), "text")


def _features(line: Column) -> tuple[Column, ...]:
    """Letters, decimal digits and other characters in percent of those that aren't blank, and the numbers of words, of words with a capital first, and of commas."""
    count = lambda pattern: F.length(F.regexp_replace(line, pattern, ""))
    solid, letters, digits = count("[ \t]"), count(r"\P{L}"), count(r"\P{Nd}")
    share = lambda n: 100 * n / F.greatest(solid, F.lit(1))
    words = F.filter(F.split(line, "[ \t]+"), lambda w: w != "")
    capital = F.size(F.filter(words, lambda w: w.rlike(r"^[^\p{L}]*\p{Lu}")))
    return share(letters), share(digits), share(solid - letters - digits), F.size(words), capital, count("[^,]")


def _may_be_title(line: Column) -> Column:
    """Prose of some length, mostly letters, that isn't a list and doesn't lead up to something."""
    letters, digits, marks, words, _, commas = _features(line)
    prose = (letters >= LETTERS) & (digits <= DIGITS) & (marks <= MARKS)
    return prose & (F.length(line) >= TITLE_LENGTH) & (words >= TITLE_WORDS) & (4 * commas <= words) & line.rlike(r"[\p{L}\p{Nd}.?!)]$")


def _may_be_authors(line: Column) -> Column:
    """A list, mostly of words with a capital first, with few digits."""
    _, digits, _, words, capital, commas = _features(line)
    return (commas >= 1) & (F.length(line) < AUTHOR_LENGTH) & (digits <= DIGITS) & (2 * capital >= words) & (words <= 4 * (commas + 1))


def guessed_metadata(text: Column) -> Column:
    """(title, authors): the first line of the title page that looks like a title, and up to three after it that look like authors.

    Lines are judged by what they are made of: their length, words, capitals,
    commas, and shares of letters, digits and other characters.
    """
    lines = F.filter(F.transform(F.split(F.substring(text, 1, 3000), "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: (x != "") & ~x.rlike("^(=|PAGE)"))
    clean = F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"^#{1,6}[ \t]+", "")), lambda x: x != "")
    at = F.array_position(F.transform(clean, _may_be_title), F.lit(True)).cast("int")
    rest = F.filter(F.slice(clean, at + 1, F.size(clean) + 1), _may_be_authors)
    return F.struct(F.when(at > 0, F.element_at(clean, at)).otherwise("").alias("title"), F.when(at > 0, F.slice(rest, 1, 3)).otherwise(F.array().cast("array<string>")).alias("authors"))


def verified_titles(wanted: DataFrame, found: DataFrame, least: float = 0.85, whole_surname: bool = True) -> DataFrame:
    """ref, candidate: pairs (ref, candidate) of a search whose titles are alike and whose year or first author agrees.

    Both sides: title, year, author (one string).  With ``whole_surname`` the
    surnames must be equal, else one may lie within the other.
    """
    a = wanted.select("ref", F.lower("title").alias("t_a"), F.col("year").cast("string").alias("y_a"), T.first_lastname(F.col("author")).alias("n_a"))
    b = found.select("ref", "candidate", F.lower("title").alias("t_b"), F.col("year").cast("string").alias("y_b"), T.first_lastname(F.col("author")).alias("n_b"))
    same = F.col("n_a") == F.col("n_b") if whole_surname else F.contains("n_b", F.col("n_a"))
    agree = F.coalesce(F.col("y_a") == F.col("y_b"), F.lit(False)) | (F.coalesce(same, F.lit(False)) & (F.col("n_a") != ""))
    return a.join(b, "ref").filter(agree).filter(indel_ratio("t_a", "t_b") >= 100 * least).select("ref", "candidate")


def external_ids(response: Column) -> Column:
    """What an identifier service's JSON answer says: ids, open-access URL, preprint server."""
    get = lambda p: F.nullif(F.get_json_object(response, f"$.{p}"), F.lit(""))
    doi, url = F.lower(get("externalIds.DOI")), get("openAccessPdf.url")
    return F.struct(get("paperId").alias("s2_id"), get("externalIds.ArXiv").alias("arxiv_id"), get("externalIds.PubMed").alias("pubmed_id"), get("externalIds.PubMedCentral").alias("pmc_id"), get("externalIds.DBLP").alias("dblp_id"), doi.alias("doi"), url.alias("open_access_url"), T.preprint_server(get("externalIds.ArXiv"), doi, url).alias("preprint_server"))


def coverage(papers: DataFrame, columns: list[str]) -> DataFrame:
    """name, n: how many papers have each column filled, and each preprint server's papers, in one pass each."""
    filled = papers.agg(*[F.count(F.when(~blank(c), 1)).alias(c) for c in columns])
    rows = filled.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in columns])).alias("s")).select("s.*")
    if "preprint_server" not in papers.columns:
        return rows
    servers = papers.filter(~blank("preprint_server")).groupBy(F.concat(F.lit("server:"), "preprint_server").alias("name")).agg(F.count("*").alias("n"))
    return rows.unionByName(servers)


def fetch_targets(papers: DataFrame, mode: str) -> DataFrame:
    """paper_id of those to fetch: ``citations`` (owned, or stubs with a DOI), ``external``, or ``stubs`` with an identifier."""
    has_id = ~blank("doi") | ~blank("s2_id") if "s2_id" in papers.columns else ~blank("doi")
    keep = {"citations": owned(F.col("type")) | ((F.col("type") == "stub") & ~blank("doi")), "external": F.col("type") == "external_owned", "stubs": (F.col("type") == "stub") & has_id}[mode]
    return papers.filter(keep).select("paper_id")


def lookup_targets(papers: DataFrame, mode: str, batch: int = 500) -> DataFrame:
    """paper_id, wanted, turn of papers whose identifiers are looked up: ``doi`` (a DOI, no external id), ``title`` (neither), ``enrich`` (an external id, no other one).

    ``turn`` is the order of title searches: owned papers first, then external
    ones, then stubs, the most cited first; for the others it is a number of
    batches of about ``batch`` papers by a hash of the id.
    """
    none = lambda c: blank(F.col(c).cast("string"))
    keep, wanted = {"doi": (~none("doi") & none("s2_id"), T.normalize_doi(F.col("doi"))), "title": (none("doi") & none("s2_id") & ~none("title"), F.trim("title")), "enrich": (~none("s2_id") & none("arxiv_id") & none("pubmed_id"), F.col("s2_id"))}[mode]
    found = papers.filter(keep).select("paper_id", wanted.alias("wanted"), "type", "cited_by_count")
    if mode == "title":
        rank = F.when(F.col("type") == "owned", 0).when(F.col("type") == "external_owned", 1).otherwise(2)
        return found.select("paper_id", "wanted", F.struct(rank.alias("kind"), (-F.coalesce("cited_by_count", F.lit(0))).alias("less"), "paper_id").alias("turn")).orderBy("turn").withColumn("turn", F.col("turn.kind"))
    n = max(1, -(-found.count() // batch))
    return found.select("paper_id", "wanted", F.pmod(F.xxhash64("paper_id"), F.lit(n)).cast("int").alias("turn"))


def stage_counts(stages: DataFrame) -> DataFrame:
    """stage, n: the status of the texts."""
    return stages.groupBy("stage").agg(F.count("*").alias("n"))


def should_fetch(targets: DataFrame, log: DataFrame, today: Column, days: int = 30) -> DataFrame:
    """paper_id, reason of targets to try (again): never tried, failed for now, or an answer that is too old."""
    last = log.groupBy("paper_id").agg(F.max_by("result", "fetched").alias("result"), F.max("fetched").alias("fetched"))
    j = targets.join(last, "paper_id", "left")
    reason = F.when(F.col("result").isNull(), "never attempted").when(F.col("result").isin("not_found", "not_open_access"), None).when(F.col("result") == "ok", F.when(T.stale(F.col("fetched"), today, days), "too old")).otherwise("retry")
    return j.select("paper_id", reason.alias("reason")).filter("reason is not null")


def text_stages(texts: DataFrame, papers: DataFrame, extractions: DataFrame) -> DataFrame:
    """stem, stage: done, in_process or staging, by the paper that names the text, else the extraction that does, else one of its name.

    papers: text_stem, paper_id, has_passes; extractions: paper_id, source_stem, has_meta.
    """
    by_paper = papers.filter("text_stem is not null").groupBy(F.col("text_stem").alias("stem")).agg(F.max("has_passes").alias("passes"), F.min("paper_id").alias("paper_id"))
    own = extractions.select("paper_id", F.col("has_meta").alias("own_meta"))
    by_source = extractions.filter("source_stem is not null").groupBy(F.col("source_stem").alias("stem")).agg(F.max("has_meta").alias("source_meta"))
    by_name = extractions.select(F.col("paper_id").alias("stem"), F.col("has_meta").alias("name_meta"))
    j = texts.join(by_paper, "stem", "left").join(own, "paper_id", "left").join(by_source, "stem", "left").join(by_name, "stem", "left")
    state = lambda meta: F.when(meta, "done").otherwise("in_process")
    known = F.when(F.col("passes"), "done").when(F.col("own_meta").isNotNull(), state(F.col("own_meta"))).otherwise("staging")
    stage = F.when(F.col("paper_id").isNotNull(), known).when(F.col("source_meta").isNotNull(), state(F.col("source_meta"))).when(F.col("name_meta").isNotNull(), state(F.col("name_meta"))).otherwise("staging")
    return j.select("stem", stage.alias("stage"))


def unprocessed(listing: DataFrame, *done: DataFrame) -> DataFrame:
    """The stems of a listing that none of the others has."""
    left = listing.select("stem").distinct()
    for d in done:
        left = left.join(d.select("stem"), "stem", "left_anti")
    return left


def with_contexts(citations: DataFrame, contexts: DataFrame) -> DataFrame:
    """citations (paper_id, id, citation_key) and their contexts (paper_id, ref, ...): one row for each pair.

    Contexts go by the citation's id.  In papers where none matches, a ref of
    the form ref_N goes by the citation's key N instead.
    """
    c = citations.select("paper_id", "id", "citation_key").distinct()
    direct = contexts.join(c.select("paper_id", F.col("id").alias("ref"), "id"), ["paper_id", "ref"])
    unmatched = contexts.join(direct.select("paper_id").distinct(), "paper_id", "left_anti")
    number = F.regexp_extract("ref", r"^ref_(\d+)$", 1)
    second = unmatched.withColumn("citation_key", number).filter("citation_key <> ''").join(c.filter("citation_key is not null"), ["paper_id", "citation_key"]).select(direct.columns)
    return direct.unionByName(second)


def overlaid(base: DataFrame, over: DataFrame, columns: list[str]) -> DataFrame:
    """base with columns replaced where ``over`` has a row of the paper with a value."""
    o = over.select("paper_id", *[F.col(c).alias(f"_{c}") for c in columns])
    j = base.join(o, "paper_id", "left")
    return j.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns])


def merged_rows(rows: DataFrame, closure: DataFrame, keys: list[str], order: list[str], ignore_case: list[str] | None = None) -> DataFrame:
    """Extraction rows of aliases moved to their canonical papers: the first of each key stays, canonical rows before others."""
    j = rows.join(closure.select(F.col("alias").alias("paper_id"), "target"), "paper_id", "left")
    j = j.withColumns({"_own": F.col("target").isNull(), "paper_id": F.coalesce("target", "paper_id"), "_from": F.col("paper_id")}).drop("target")
    folded = [f"_k{i}" for i, _ in enumerate(keys)]
    j = j.withColumns({f: F.lower(k) if k in (ignore_case or []) else F.col(k) for f, k in zip(folded, keys, strict=True)})
    return first_of_each(j, ["paper_id", *folded], [F.desc("_own"), "_from", *order]).drop("_own", "_from", *folded)


def merged_meta(meta: DataFrame, closure: DataFrame) -> DataFrame:
    """paper_id, passes, models, merged_from: passes of all, models of the canonical paper first."""
    j = meta.join(closure.select(F.col("alias").alias("paper_id"), "target"), "paper_id", "left")
    own = j.filter("target is null").select("paper_id", "passes", "models")
    more = j.filter("target is not null").groupBy(F.col("target").alias("paper_id")).agg(F.array_distinct(F.flatten(F.collect_list("passes"))).alias("p"), F.flatten(F.collect_list(F.map_entries("models"))).alias("m"), F.array_sort(F.collect_set("paper_id")).alias("merged_from"))
    both = own.join(more, "paper_id", "left")
    none = F.array().cast("array<int>")
    mine = F.coalesce(F.map_keys("models"), F.array().cast("array<string>"))
    extra = F.filter(F.coalesce(F.col("m"), F.array().cast("array<struct<key:string,value:string>>")), lambda e: ~F.array_contains(mine, e["key"]))
    first = F.aggregate(extra, F.array().cast("array<struct<key:string,value:string>>"), lambda s, e: F.when(F.exists(s, lambda x: x["key"] == e["key"]), s).otherwise(F.concat(s, F.array(e))))
    return both.select("paper_id", F.array_sort(F.array_union(F.coalesce("passes", none), F.coalesce("p", none))).alias("passes"), F.map_concat(F.coalesce("models", F.create_map().cast("map<string,string>")), F.map_from_entries(first)).alias("models"), F.coalesce("merged_from", F.array().cast("array<string>")).alias("merged_from"))


def extraction_meta(passes: Column, models: Column, extractor: str) -> Column:
    """The stamp of an extraction: extractor, passes in order, how far they went, models by pass, today's date."""
    done = F.array_sort(F.coalesce(passes, F.array().cast("array<int>")))
    return F.struct(F.lit(extractor).alias("extractor"), done.alias("passes_completed"), T.detail_level(passes).alias("detail_level"), models.alias("models"), F.current_date().cast("string").alias("extracted_at"))


def paper_summaries(papers: DataFrame) -> DataFrame:
    """What a reviewer sees of a paper: id, title, year, type, the abstract's first 200 characters, degrees."""
    count = lambda c: F.size(F.coalesce(F.col(c), F.array()))
    return papers.select("paper_id", "title", "year", "type", F.substring("abstract", 1, 200).alias("abstract"), count("cites").alias("n_cites"), count("cited_by").alias("n_cited_by"))


def new_requests(wanted: DataFrame, papers: DataFrame, queue: DataFrame) -> DataFrame:
    """paper_id of requests for known papers that aren't queued yet; raises for unknown ids."""
    unknown = wanted.join(papers.select("paper_id"), "paper_id", "left_anti").limit(1).collect()
    if unknown:
        raise ValueError(f"unknown paper: {unknown[0].paper_id}")
    return wanted.select("paper_id").distinct().join(queue.select("paper_id"), "paper_id", "left_anti")
