"""Maintenance of the graph: aliases, repair, merges, imports, and the consistency check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.sources.documents import owned
from citeloom.sources.store import cut


def alias_closure(aliases: DataFrame) -> DataFrame:
    """alias, target of (alias, target): each alias's last target; those that lead into a cycle are left out.

    Pointer doubling: after k rounds a pointer spans 2^k steps, so the rounds
    are the logarithm of the longest chain.
    """
    now = cut(aliases.filter("alias is not null and target is not null").groupBy("alias").agg(F.min("target").alias("target")))
    start = now.select(F.col("alias").alias("target"), F.lit(True).alias("is_alias"))
    rounds = max(1, now.count()).bit_length() + 1
    for _ in range(rounds):
        up = now.select(F.col("alias").alias("target"), F.col("target").alias("up"))
        new = cut(now.join(up, "target", "left").select("alias", F.coalesce("up", "target").alias("target"), F.col("up").isNotNull().alias("moved")))
        now = new.select("alias", "target")
        if not new.filter("moved").limit(1).count():
            break
    return now.join(start, "target", "left").filter("is_alias is null").select("alias", "target")


def remapped(edges: DataFrame, closure: DataFrame) -> DataFrame:
    """Distinct edges with aliases resolved on both sides, without self-citations."""
    a = closure.select(F.col("alias").alias("citing_id"), F.col("target").alias("a"))
    b = closure.select(F.col("alias").alias("cited_id"), F.col("target").alias("b"))
    j = edges.join(a, "citing_id", "left").join(b, "cited_id", "left").select(F.coalesce("a", "citing_id").alias("citing_id"), F.coalesce("b", "cited_id").alias("cited_id"))
    return j.filter("citing_id <> cited_id").distinct()


def rewritten(papers: DataFrame, closure: DataFrame, column: str) -> DataFrame:
    """A list column with ids replaced, first occurrences kept in order."""
    item = papers.select("paper_id", F.posexplode(column).alias("pos", "alias")).join(closure, "alias", "left").withColumn("id", F.coalesce("target", "alias"))
    first = item.groupBy("paper_id", "id").agg(F.min("pos").alias("pos"))
    lists = first.groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda s: s["id"]).alias("_new"))
    empty = F.array().cast(papers.schema[column].dataType)
    return papers.join(lists, "paper_id", "left").withColumn(column, F.when(F.col(column).isNotNull(), F.coalesce("_new", empty))).drop("_new")


def bidirectional(cites: DataFrame, cited_by: DataFrame, active: DataFrame) -> DataFrame:
    """citing_id, cited_id: edges known from either side, both ends active, no self-citation."""
    flip = cited_by.select("citing_id", "cited_id")
    e = cites.select("citing_id", "cited_id").unionByName(flip).filter("citing_id <> cited_id").distinct()
    a = active.select("paper_id").distinct()
    return e.join(a.withColumnRenamed("paper_id", "citing_id"), "citing_id", "left_semi").join(a.withColumnRenamed("paper_id", "cited_id"), "cited_id", "left_semi").select("citing_id", "cited_id")


def edges_added(cites: DataFrame, cited_by: DataFrame, active: DataFrame) -> DataFrame:
    """side, n: how many reverse entries a repair adds on each side."""
    full = bidirectional(cites, cited_by, active)
    missing = lambda have, name: full.join(have.select("citing_id", "cited_id").distinct(), ["citing_id", "cited_id"], "left_anti").agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "n")
    return missing(cites, "cites").unionByName(missing(cited_by, "cited_by"))


def adjacency(edges: DataFrame, papers: DataFrame) -> DataFrame:
    """paper_id, cites, cited_by as sorted lists of every paper."""
    out = edges.groupBy(F.col("citing_id").alias("paper_id")).agg(F.array_sort(F.collect_set("cited_id")).alias("cites"))
    back = edges.groupBy(F.col("cited_id").alias("paper_id")).agg(F.array_sort(F.collect_set("citing_id")).alias("cited_by"))
    kind = F.array().cast(f"array<{papers.schema['paper_id'].dataType.simpleString()}>")
    return papers.select("paper_id").distinct().join(out, "paper_id", "left").join(back, "paper_id", "left").select("paper_id", F.coalesce("cites", kind).alias("cites"), F.coalesce("cited_by", kind).alias("cited_by"))


def blank(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) == ""


def enriched(papers: DataFrame, closure: DataFrame, columns: list[str]) -> DataFrame:
    """Canonical papers with blank fields filled from their aliases, smaller alias ids first."""
    donor = papers.withColumnRenamed("paper_id", "alias").join(closure, "alias")
    best = donor.groupBy("target").agg(*[F.min(F.when(~blank(c), F.struct("alias", F.col(c).alias("v")))).getField("v").alias(f"_{c}") for c in columns])
    j = papers.join(best.withColumnRenamed("target", "paper_id"), "paper_id", "left")
    return j.select(*[F.when(blank(c), F.coalesce(f"_{c}", c)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in papers.columns])


def valid_merges(plan: DataFrame, papers: DataFrame) -> DataFrame:
    """rule, id: what is wrong with a plan (canonical_id, alias_id); no rows if it can be carried out."""
    known = papers.select(F.col("paper_id").alias("id"))
    ids = plan.select(F.col("canonical_id").alias("id")).unionByName(plan.select(F.col("alias_id").alias("id"))).distinct()
    canon = plan.select(F.col("canonical_id").alias("id")).distinct()
    alias = plan.select(F.col("alias_id").alias("id"))
    rows = {
        "unknown id": ids.join(known, "id", "left_anti"),
        "alias is canonical of its own group": plan.filter("canonical_id = alias_id").select(F.col("alias_id").alias("id")),
        "alias is canonical elsewhere": alias.distinct().join(canon, "id", "left_semi"),
        "alias in several groups": plan.groupBy("alias_id").agg(F.count_distinct("canonical_id").alias("n")).filter("n > 1").select(F.col("alias_id").alias("id")),
    }
    return reduce(DataFrame.unionByName, [df.select(F.lit(rule).alias("rule"), F.col("id").cast("string").alias("id")) for rule, df in rows.items()])


def merged(papers: DataFrame, edges: DataFrame, plan: DataFrame, fill: list[str]) -> tuple[DataFrame, DataFrame]:
    """Papers and edges after a plan: blanks filled, aliases superseded, their edges moved, references rewritten.

    A type rises to external_owned at most.  Earlier aliases of an alias follow
    it to its new target.
    """
    old = papers.filter(~blank("superseded_by")).select(F.col("paper_id").alias("alias"), F.col("superseded_by").alias("target"))
    closure = cut(alias_closure(old.unionByName(plan.select(F.col("alias_id").alias("alias"), F.col("canonical_id").alias("target")))))
    p = enriched(papers, closure, fill)
    to = closure.select(F.col("alias").alias("paper_id"), F.col("target").alias("_target"))
    better = papers.join(to, "paper_id").filter(owned(F.col("type"))).select(F.col("_target").alias("paper_id"), F.lit(True).alias("_up")).distinct()
    p = p.join(to, "paper_id", "left").join(better, "paper_id", "left")
    kind = F.when((F.col("type") == "stub") & F.col("_up"), "external_owned").otherwise(F.col("type"))
    p = p.select(*[F.coalesce("_target", "superseded_by").alias(c) if c == "superseded_by" else kind.alias(c) if c == "type" else F.col(c) for c in papers.columns])
    return p, remapped(edges, closure)


def imported(local: DataFrame, other: DataFrame, columns: list[str], force: bool = False) -> DataFrame:
    """Local papers with another corpus's: action add, enrich or keep for each, by key.

    New papers of an owned type come as external_owned; blanks of known ones are
    filled, everything but local owned papers is replaced if forced.
    """
    o = other.select("paper_id", *[F.col(c).alias(f"_{c}") for c in columns], F.col("type").alias("_type"), F.lit(True).alias("_there"))
    j = local.withColumn("_here", F.lit(True)).join(o, "paper_id", "full_outer")
    add, both = F.col("_here").isNull(), F.col("_here") & F.col("_there")
    over = both & F.lit(force) & (F.col("type") != "owned")
    kind = F.when(add & owned(F.col("_type")), "external_owned").when(add, F.col("_type")).when(both & (F.col("type") == "stub") & owned(F.col("_type")), "external_owned").otherwise(F.col("type"))
    value = lambda c: F.when(add | over, F.coalesce(f"_{c}", c)).when(both & blank(F.col(c).cast("string")), F.coalesce(f"_{c}", c)).otherwise(F.col(c))
    out = [kind.alias(c) if c == "type" else value(c).alias(c) if c in columns else F.col(c) for c in local.columns]
    action = F.when(add, "add").when(over, "replace").when(both, "enrich").otherwise("keep")
    return j.select(*out, action.alias("action"))


def new_contexts(local: DataFrame, other: DataFrame, order: str) -> DataFrame:
    """Contexts of another corpus for pairs (citing, cited) without a local one: the first of each pair."""
    fresh = other.join(local.select("citing_id", "cited_id").distinct(), ["citing_id", "cited_id"], "left_anti")
    first = Window.partitionBy("citing_id", "cited_id").orderBy(order)
    return fresh.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")


def first_of_each(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row for each key by an explicit order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def merged_strings(items: DataFrame, order: list, ignore_case: bool = True) -> DataFrame:
    """(paper_id, value) lists of several extractions as one: the first spelling of each value stays."""
    key = F.lower("value") if ignore_case else F.col("value")
    return first_of_each(items.withColumn("_k", key), ["paper_id", "_k"], order).drop("_k")


def forward_matches(entries: DataFrame, papers: DataFrame) -> DataFrame:
    """entry_id, paper_id: known papers of fetched citations by external id, else DOI; null for new ones."""
    by_id = papers.filter(~blank("s2_id")).groupBy("s2_id").agg(F.min("paper_id").alias("by_id"))
    by_doi = papers.filter("doi is not null").groupBy("doi").agg(F.min("paper_id").alias("by_doi"))
    return entries.join(by_id, "s2_id", "left").join(by_doi, "doi", "left").select("entry_id", F.coalesce("by_id", "by_doi").alias("paper_id"))


def applied_forward(papers: DataFrame, edges: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What fetched citers of known papers add: stubs, edges, and (paper_id, forward_cited_by).

    entries: entry_id, cited_id, title, authors (array), year, s2_id, doi.  A
    citer is a known paper by external id, else DOI; else the first entry of
    one identifier or title becomes a stub with a new id.
    """
    from citeloom.functions import text as T
    from citeloom.operators.resolve import assign_ids

    e = entries.withColumn("doi", T.normalize_doi(F.col("doi"))).withColumn("s2_id", F.nullif("s2_id", F.lit("")))
    known = papers.select("paper_id", "s2_id", T.normalize_doi(F.col("doi")).alias("doi"))
    e = e.join(forward_matches(e, known), "entry_id").withColumn("key", F.coalesce("s2_id", "doi", T.title_text(F.col("title"))))
    fresh = first_of_each(e.filter("paper_id is null"), ["key"], ["entry_id"]).drop("paper_id")
    fresh = fresh.withColumn("base", T.paper_id_base(F.col("title"), F.col("authors"), F.col("year")))
    stubs = cut(assign_ids(fresh, papers.select("paper_id"), "entry_id").select("paper_id", "key", "title", "authors", "year", "s2_id", "doi", F.lit("stub").alias("type")))
    citers = e.select("entry_id", "cited_id", "key", F.col("paper_id").alias("known_id")).join(stubs.select("key", "paper_id"), "key", "left").select(F.coalesce("known_id", "paper_id").alias("citing_id"), "cited_id").filter("citing_id <> cited_id").distinct()
    lists = citers.groupBy(F.col("cited_id").alias("paper_id")).agg(F.array_sort(F.collect_set("citing_id")).alias("forward_cited_by"))
    return stubs.drop("key"), citers.join(edges.select("citing_id", "cited_id"), ["citing_id", "cited_id"], "left_anti"), lists


def added_extraction(papers: DataFrame, edges: DataFrame, new: DataFrame, citations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Papers and edges with extractions: their papers owned, their citations replacing their earlier ones, a stub for each new id.

    new: papers with paper_id; citations: citing_id, id, title.  Citations of
    other papers are left out.  Stubs that nothing cites any more go.
    """
    pid = new.select("paper_id")
    citing = pid.withColumnRenamed("paper_id", "citing_id")
    of = citations.join(citing, "citing_id", "left_semi")
    kept = edges.join(citing, "citing_id", "left_anti")
    mine = of.select("citing_id", F.col("id").alias("cited_id")).filter("citing_id <> cited_id")
    now = kept.select("citing_id", "cited_id").unionByName(mine).distinct()
    stubs = of.groupBy(F.col("id").alias("paper_id")).agg(F.min("title").alias("title")).withColumn("type", F.lit("stub")).join(papers, "paper_id", "left_anti").join(pid, "paper_id", "left_anti")
    rest = papers.join(pid, "paper_id", "left_anti").unionByName(stubs, allowMissingColumns=True)
    orphans = edges.join(citing, "citing_id", "left_semi").select(F.col("cited_id").alias("paper_id")).join(now.select(F.col("cited_id").alias("paper_id")), "paper_id", "left_anti").distinct()
    gone = rest.filter("type = 'stub'").join(orphans, "paper_id", "left_semi").select("paper_id")
    return rest.join(gone, "paper_id", "left_anti").unionByName(new.withColumn("type", F.lit("owned")), allowMissingColumns=True), now


#: Fields that papers shouldn't have any more.
STALE_FIELDS = ["author_lastnames", "title_normalized"]


def check(papers: DataFrame, metadata: dict | None = None) -> DataFrame:
    """severity, rule, id, detail of what is inconsistent in paper documents.

    papers: key, id, type, title, superseded_by, cites, cited_by, aliases,
    extraction_file, text_file, source_db.  One pass over the documents gives
    the rules of a row, one over each list all that they refer to: each
    reference is looked up once, and both lists' edges meet in one aggregation,
    so the number of scans and joins doesn't grow with that of the rules.
    """
    papers, has = cut(papers), set(papers.columns)
    kind = papers.schema["key"].dataType
    by = F.when(~blank("superseded_by"), F.col("superseded_by")).cast(kind)
    none = F.lit("")
    rules = [
        ("error", "self-citation", F.array_contains("cites", F.col("key")) | F.array_contains("cited_by", F.col("key")), none),
        ("error", "invalid type", ~F.coalesce("type", none).isin("owned", "external_owned", "stub"), F.coalesce("type", none)),
        ("error", "superseded by itself", F.col("key") == by, by),
    ]
    rules += [("warning", f"duplicates in {c}", F.size(c) > F.size(F.array_distinct(c)), none) for c in ("cites", "cited_by")]
    if "id" in has:
        rules.append(("error", "id differs from key", (F.col("id") != "") & (F.col("id") != F.col("key")), F.col("id")))
    if "title" in has:
        rules.append(("error", "owned without title", owned(F.col("type")) & blank("title"), none))
    for c in sorted({"extraction_file", "text_file"} & has):
        rules.append(("error", f"owned without {c}", (F.col("type") == "owned") & blank(c), none))
        rules.append(("warning", f"external with {c}", (F.col("type") == "external_owned") & ~blank(c), none))
    if "source_db" in has:
        rules.append(("error", "external without source_db", (F.col("type") == "external_owned") & blank("source_db"), none))
    for c in sorted(set(STALE_FIELDS) & has):
        rules.append(("warning", f"stale field {c}", F.col(c).isNotNull(), F.lit(c)))
    said = lambda severity, rule, detail: F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))
    whens = lambda rules: [F.when(on, said(s, r, detail)) for s, r, on, detail in rules]
    listed = lambda df: df.filter("x is not null").select("x.severity", "x.rule", F.col("key").cast("string").alias("id"), "x.detail")
    of_rows = listed(papers.select("key", F.explode(F.array(*whens(rules))).alias("x")))

    # Every reference with the list that it stands in, and what is known of the paper it means.
    lists = [c for c in ("cites", "cited_by", "aliases") if c in has]
    held = [papers.select("key", by.isNull().alias("active"), F.lit(c).alias("list"), F.explode(c).alias("ref")) for c in lists]
    held.append(papers.select("key", F.lit(False).alias("active"), F.lit("superseded_by").alias("list"), by.alias("ref")).filter("ref is not null"))
    refs = reduce(DataFrame.unionByName, held).withColumn("ref", F.col("ref").cast(kind))
    known = papers.groupBy(F.col("key").alias("ref")).agg(F.min(by).alias("target"), F.lit(True).alias("exists"))
    refs = cut(refs.join(known, "ref", "left").withColumn("exists", F.coalesce("exists", F.lit(False))))
    on, there, target = (lambda c: F.col("list") == c), F.col("exists"), F.col("target")
    # At most one of these holds for a reference.
    of_refs = [("error", f"dangling {c}", on(c) & ~there, F.col("ref")) for c in ("cites", "cited_by")]
    of_refs.append(("error", "unknown alias", on("aliases") & ~there, F.col("ref")))
    of_refs.append(("error", "alias not superseded by its paper", on("aliases") & there & (target.isNull() | (target != F.col("key"))), F.col("ref")))
    of_refs.append(("error", "superseded in a circle", on("superseded_by") & (F.col("key") != F.col("ref")) & (target == F.col("key")), F.col("ref")))
    old = refs.filter(on("cites") & F.col("active") & target.isNotNull()).groupBy("key").agg(F.min("ref").alias("ref"))
    old = old.select(F.lit("error").alias("severity"), F.lit("cites a superseded paper").alias("rule"), F.col("key").cast("string").alias("id"), F.col("ref").cast("string").alias("detail"))
    # An edge as both papers' lists have it: how often an active paper names an active other, and whether the other does at all.
    out, live = on("cites"), F.col("active") & there & target.isNull()
    ends = refs.filter(on("cites") | on("cited_by")).select(F.when(out, F.col("key")).otherwise(F.col("ref")).alias("a"), F.when(out, F.col("ref")).otherwise(F.col("key")).alias("b"), out.alias("out"), live.alias("live"))
    edges = ends.groupBy("a", "b").agg(F.count(F.when(F.col("out"), 1)).alias("n_out"), F.count(F.when(~F.col("out"), 1)).alias("n_back"), F.count(F.when(F.col("live"), 1)).alias("n"))
    edges = edges.filter("n > 0 and (n_out = 0 or n_back = 0)").withColumn("n", F.explode(F.array_repeat("n", F.col("n").cast("int"))))
    forth = F.col("n_out") > 0
    one_sided = edges.select(F.lit("error").alias("severity"), F.when(forth, "cites without cited_by").otherwise("cited_by without cites").alias("rule"), F.when(forth, F.col("a")).otherwise(F.col("b")).cast("string").alias("id"), F.when(forth, F.col("b")).otherwise(F.col("a")).cast("string").alias("detail"))
    found = reduce(DataFrame.unionByName, [of_rows, listed(refs.select("key", F.coalesce(*whens(of_refs)).alias("x"))), old, one_sided])
    if metadata:
        actual = papers.agg(F.count(F.when(owned(F.col("type")), 1)).alias("owned_count"), F.count(F.when(F.col("type") == "stub", 1)).alias("stub_count"))
        for name, stated in metadata.items():
            found = found.unionByName(actual.filter(F.col(name) != stated).select(F.lit("error").alias("severity"), F.lit(f"metadata {name}").alias("rule"), F.lit("").alias("id"), F.col(name).cast("string").alias("detail")))
    return found


def parse_merge_decisions(lines: DataFrame) -> DataFrame:
    """action, canonical_id, alias_id from lines "merge|skip canonical alias ..."; comments and short lines are left out."""
    t = F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")
    rows = lines.filter(~F.startswith(F.trim("value"), F.lit("#"))).select(t.alias("t")).filter((F.size("t") >= 3) & F.element_at("t", 1).isin("merge", "skip"))
    return rows.select(F.element_at("t", 1).alias("action"), F.element_at("t", 2).alias("canonical_id"), F.explode(F.slice("t", 3, 1 << 20)).alias("alias_id"))


def skip_pairs(groups: DataFrame) -> DataFrame:
    """pair_key: every two ids of a skipped group (group, paper_id), smaller first."""
    g = groups.select("group", "paper_id")
    return g.toDF("group", "a").join(g.toDF("group", "b"), "group").filter("a < b").select(F.concat_ws("|||", F.col("a").cast("string"), F.col("b").cast("string")).alias("pair_key")).distinct()


def cleared(papers: DataFrame, decided: DataFrame) -> DataFrame:
    """Papers without the dedup_pending flag where a decision (paper_id) was made."""
    d = decided.select("paper_id").distinct().withColumn("_done", F.lit(True))
    flag = F.when(F.col("_done"), None).otherwise(F.col("dedup_pending"))
    return papers.join(d, "paper_id", "left").withColumn("dedup_pending", flag).drop("_done")


def adopted(papers: DataFrame, wanted: DataFrame) -> DataFrame:
    """Papers with the external ones among ``wanted`` (paper_id, text_file) owned from now on, their text file set, no source database left."""
    w = wanted.groupBy("paper_id").agg(F.min("text_file").alias("_text"), F.lit(True).alias("_mine"))
    j = papers.join(w, "paper_id", "left")
    up = F.coalesce(F.col("_mine") & (F.col("type") == "external_owned"), F.lit(False))
    new = {"type": F.when(up, "owned").otherwise(F.col("type")), "text_file": F.when(up, F.col("_text")).otherwise(F.col("text_file")), "source_db": F.when(~up, F.col("source_db"))}
    return j.select(*[new[c].alias(c) if c in new else F.col(c) for c in papers.columns])


def review_lines(members: DataFrame, papers: DataFrame) -> DataFrame:
    """group, text: what a reviewer reads of each duplicate group, a line for each paper in order of id."""
    blank_as = lambda c, other: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(other))
    p = papers.select("paper_id", F.concat(F.lit("- "), F.col("paper_id").cast("string"), F.lit(" ["), blank_as("type", "?"), F.lit("] "), blank_as("title", "(no title)"), F.lit(" ("), blank_as("year", "n.d."), F.lit(") cites "), F.col("n_cites").cast("string"), F.lit(", cited by "), F.col("n_cited_by").cast("string")).alias("line"))
    lines = members.join(p, "paper_id").groupBy("group").agg(F.array_sort(F.collect_list(F.struct("paper_id", "line"))).alias("rows"))
    return lines.select("group", F.concat(F.lit("GROUP "), F.col("group").cast("string"), F.lit("\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).alias("text"))
