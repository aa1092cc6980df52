"""Author entities: grouping of names, coauthors, linking of new names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import text as T
from citeloom.functions.similarity import indel_ratio
from citeloom.operators import bits, greedy
from citeloom.sources.documents import owned
from citeloom.sources.store import cut


def parsed(paper_names: DataFrame) -> DataFrame:
    """paper_id, name and the name's parts, once for each pair; institutions, without a comma, have none.  Each name is parsed once."""
    names = paper_names.select("paper_id", "name").distinct()
    parts = names.select("name").distinct().select("name", T.parse_author(F.col("name")).alias("p"))
    return names.join(parts, "name").select("paper_id", "name", "p.*")


def _named(paper_names: DataFrame) -> DataFrame:
    """name and its parts, of each distinct name that has a key."""
    return paper_names.select("name").distinct().select("name", T.parse_author(F.col("name")).alias("p")).select("name", "p.*").filter("key is not null")


def merged_keys(keys: DataFrame) -> DataFrame:
    """key, group: a key that ends in one initial joins the only longer key that starts with it."""
    k = keys.select("key").distinct()
    short = k.filter(F.col("key").rlike("^.+_[a-z]$"))
    # Longer keys share the surname and the first initial, which makes this an equi-join.
    longer = k.select(F.col("key").alias("long"), F.regexp_extract("key", "^(.*_[a-z])[a-z]*$", 1).alias("stem")).filter("stem <> '' and long <> stem")
    only = short.join(longer, short["key"] == longer["stem"]).groupBy("key").agg(F.count("*").alias("n"), F.max("long").alias("long")).filter("n = 1")
    return k.join(only.select("key", "long"), "key", "left").select("key", F.coalesce("long", "key").alias("group"))


def person_groups(paper_names: DataFrame, papers: DataFrame | None = None) -> DataFrame:
    """One entity for each group: author_id, canonical_name, variants, paper_count, owned_paper_count.

    The canonical name has the longest first name, then the most characters,
    then the greatest text; the id is the longest candidate, numbered where
    several groups would share it.
    """
    p = cut(_named(paper_names))
    p = p.join(merged_keys(p), "key")
    name_rank = F.struct(F.length("firstname"), F.length("name"), "name")
    one = p.groupBy("group").agg(F.max_by("name", name_rank).alias("canonical_name"), F.max_by("author_id", F.struct(F.length("author_id"), "author_id")).alias("base"), F.array_join(F.array_sort(F.collect_set("name")), "|").alias("name_variants"))
    at = bits.places(one, "group")
    wrote = bits.packed(paper_names.join(p.select("name", "group"), "name"), "paper_id", "group", at).filter("paper_id is not null")
    if papers is not None:
        wrote = wrote.join(papers.filter(owned(F.col("type"))).select("paper_id", F.lit(True).alias("owned")).distinct(), "paper_id", "left")
    else:
        wrote = wrote.withColumn("owned", F.lit(None).cast("boolean"))
    # Counted by bits, before the groups' names come in.
    counts = bits.rows(wrote, at.select("word", "bit")).groupBy("word", "bit").agg(F.count("*").alias("n"), F.count("owned").alias("n_owned")).join(at, ["word", "bit"]).select("group", "n", "n_owned")
    one = one.join(counts, "group", "left").withColumns({"paper_count": F.coalesce("n", F.lit(0)), "owned_paper_count": F.coalesce("n_owned", F.lit(0))}).drop("n", "n_owned")
    turn = F.row_number().over(Window.partitionBy("base").orderBy("group"))
    return one.withColumn("turn", turn).withColumn("author_id", F.when(F.col("turn") == 1, F.col("base")).otherwise(F.concat_ws("_", "base", F.col("turn").cast("string")))).drop("base", "turn")


def institutions(paper_names: DataFrame) -> DataFrame:
    """Names without a comma, except "et al.": names with one slug are one entity."""
    n = paper_names.filter(~F.contains("name", F.lit(",")) & (F.trim("name") != "") & (F.trim("name") != "et al."))
    slug = F.regexp_replace(F.regexp_replace(F.replace(F.replace(F.lower(F.trim("name")), F.lit(" "), F.lit("_")), F.lit("&"), F.lit("and")), "[^a-z0-9_]", ""), "_+", "_")
    return n.withColumn("author_id", F.regexp_replace(slug, "^_|_$", "")).filter("author_id <> ''").groupBy("author_id").agg(F.min(F.trim("name")).alias("canonical_name"), F.count_distinct("paper_id").alias("paper_count"))


#: Authors of a paper up to which they are one list.
LISTED = 1000


def all_coauthors(paper_authors: DataFrame) -> DataFrame:
    """author_id, coauthor_id, n: pairs that share papers, both ways.

    Each two authors are counted once and turned round at the end.  Papers stand
    in order of their ids, whose neighbours often have the same authors, so tasks
    count most of a pair before it is shuffled.  A paper of over LISTED authors
    is no list; its rows are joined.
    """
    a = paper_authors.select("paper_id", "author_id").filter("paper_id is not null and author_id is not null").distinct()
    lists = a.repartitionByRange("paper_id").groupBy("paper_id").agg(F.count("*").alias("n"), F.slice(F.collect_list("author_id"), 1, LISTED).alias("of"))
    one = lists.filter(F.col("n") <= LISTED).select("of", F.explode("of").alias("author_id"))
    pairs = one.select("author_id", F.explode(F.filter("of", lambda x: x > F.col("author_id"))).alias("coauthor_id"))
    large = cut(a.groupBy("paper_id").agg(F.count("*").alias("n")).filter(F.col("n") > LISTED).select("paper_id"))
    if not large.isEmpty():
        rest = a.join(large, "paper_id", "left_semi")
        pairs = pairs.unionByName(rest.join(rest.withColumnRenamed("author_id", "coauthor_id"), "paper_id").filter("author_id < coauthor_id").select("author_id", "coauthor_id"))
    n = pairs.groupBy("author_id", "coauthor_id").agg(F.count("*").alias("n"))
    turned = F.explode(F.array(F.struct("author_id", "coauthor_id", "n"), F.struct(F.col("coauthor_id").alias("author_id"), F.col("author_id").alias("coauthor_id"), "n"))).alias("p")
    return n.select(turned).select("p.*")


def coauthor_classes(paper_authors: DataFrame) -> DataFrame:
    """author_id, class_id: authors of the same papers, by the smallest of them.

    Sums of two hashes of an author's papers propose a class; each member's
    papers are then looked up among those of the class's first author, and who
    differs is a class of its own.
    """
    a = paper_authors.select("paper_id", "author_id").filter("paper_id is not null and author_id is not null").distinct()
    wide = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(38,0)"))
    sets = cut(a.groupBy("author_id").agg(F.count("*").alias("n"), wide("paper_id").alias("h"), wide(F.lit(1), F.col("paper_id")).alias("g")))
    first = sets.groupBy("n", "h", "g").agg(F.min("author_id").alias("class_id"))
    found = cut(sets.join(first, ["n", "h", "g"]).select("author_id", "class_id"))
    others = found.filter("author_id <> class_id")
    theirs = a.withColumnRenamed("author_id", "class_id")
    differ = a.join(others, "author_id").join(theirs, ["class_id", "paper_id"], "left_anti").select("author_id").distinct().withColumn("differs", F.lit(True))
    return found.join(differ, "author_id", "left").select("author_id", F.when(F.col("differs"), F.col("author_id")).otherwise(F.col("class_id")).alias("class_id"))


def coauthor_links(paper_authors: DataFrame, classes: DataFrame) -> DataFrame:
    """class_a <= class_b, n, pairs: how many papers any two authors of the classes share, and how many two authors that are.

    With the membership this says all that ``all_coauthors`` says.  A paper
    whose thousands of authors wrote nothing else together is one row here.
    """
    sizes = classes.groupBy("class_id").agg(F.count("*").alias("size"))
    of = cut(paper_authors.select("paper_id", "author_id").distinct().join(classes.filter("author_id = class_id"), "author_id").select("paper_id", "class_id"))
    n = of.withColumnRenamed("class_id", "class_a").join(of.withColumnRenamed("class_id", "class_b"), "paper_id").filter("class_a <= class_b").groupBy("class_a", "class_b").agg(F.count("*").alias("n"))
    side = lambda x: sizes.toDF(f"class_{x}", f"size_{x}")
    inside = F.expr("size_a * (size_a - 1) div 2")
    counted = n.join(side("a"), "class_a").join(side("b"), "class_b").withColumn("pairs", F.when(F.col("class_a") == F.col("class_b"), inside).otherwise(F.col("size_a") * F.col("size_b")))
    return counted.filter("pairs > 0").select("class_a", "class_b", "n", "pairs")


def match_score(similar: Column) -> Column:
    """Points of a parsed name against an entity's variants (arrays initials_set, first_set); 0 is no match.

    ``similar``: whether a first name of the entity is nearly the name's.
    """
    i, f = F.col("initials"), F.col("full_firstname")
    known = F.filter("initials_set", lambda x: x.isNotNull())
    prefix = F.exists(known, lambda x: F.startswith(i, x) | F.startswith(x, i))
    points = F.when((i == "") | (F.size(known) == 0), 0).when(F.array_contains(known, i), 2).when(prefix, 1)
    firsts = F.filter("first_set", lambda x: x != "")
    first = F.when((f == "") | (F.size(firsts) == 0), 0).when(F.array_contains(firsts, f), 2).when(similar, 1).otherwise(-1)
    return F.coalesce(1 + points + first, F.lit(0))


def link_scores(new_names: DataFrame, entities: DataFrame) -> DataFrame:
    """name, author_id, score for entities with the name's surname.

    new_names: (name); entities: (author_id, canonical_name, name_variants with
    ``|`` between).  Only pairs of first names that differ reach Python.
    """
    n = new_names.select("name").distinct().select("name", T.parse_author(F.col("name")).alias("p")).filter("p is not null").select("name", F.lower("p.lastname").alias("last"), "p.initials", "p.full_firstname").distinct()
    v = entities.select("author_id", F.lower(F.trim(F.substring_index("canonical_name", ",", 1))).alias("last"), F.explode(F.split("name_variants", r"\|")).alias("variant"))
    v = v.select("author_id", "last", T.parse_author(F.col("variant")).alias("p")).groupBy("author_id", "last").agg(F.collect_set("p.initials").alias("initials_set"), F.collect_set("p.full_firstname").alias("first_set"))
    j = n.join(v, "last")
    firsts = j.filter("full_firstname <> ''").select("full_firstname", F.explode("first_set").alias("other")).filter("other <> '' and other <> full_firstname").distinct()
    near = firsts.filter(indel_ratio("full_firstname", "other") > 85).groupBy("full_firstname").agg(F.collect_set("other").alias("near"))
    scored = j.join(near, "full_firstname", "left").withColumn("score", match_score(F.coalesce(F.arrays_overlap("first_set", "near"), F.lit(False))))
    return scored.filter("score > 0").select("name", "author_id", "score")


def hop_candidates(names: DataFrame, scores: DataFrame, paper_authors: DataFrame, edges: DataFrame) -> DataFrame:
    """paper_id, name, author_id, score, hop: candidates near a paper in the citation graph first.

    Hop 1 are entities of papers it cites or is cited by, hop 2 those of their
    neighbours, hop 3 all others.  Where a hop has a score of 5, later ones are
    left out.  Entities are sets of bits, so a citation moves a paper's entities
    as a few numbers; no neighbourhood of two steps is built.
    """
    at, known, edges = bits.places(scores, "author_id"), bits.places(names, "name"), cut(edges.select("citing_id", "cited_id"))
    said = cut(bits.packed(names, "paper_id", "name", known))
    wanted = bits.rows(said, known).select("paper_id", "name").join(bits.packed(scores, "name", "author_id", at), "name").groupBy("paper_id", "word").agg(bits.union("bits"))
    hops = _hops(wanted, cut(bits.packed(paper_authors, "paper_id", "author_id", at)), edges)
    listed = hops.groupBy("paper_id").agg(F.map_from_entries(F.collect_list(F.struct("word", F.struct("one", "two")))).alias("hops"))
    strong = scores.groupBy("name").agg((F.max("score") >= 5).alias("strong"))
    asked = scores.join(at, "author_id").join(strong, "name").select("name", "author_id", "score", F.col("word").alias("of"), F.col("bit").alias("at"), "strong")
    found = bits.rows(said.join(listed, "paper_id", "left"), known).select("paper_id", "name", "hops").join(asked, "name")
    found = found.withColumns({"of": F.try_element_at("hops", F.col("of")), "bit": F.col("at")}).withColumns({"one": F.col("of.one"), "two": F.col("of.two")})
    near = found.select("paper_id", "name", "author_id", "score", F.when(bits.holds("one"), 1).when(bits.holds("two"), 2).otherwise(3).alias("hop"), "strong")
    # Only a name that has a score of 5 somewhere can lose a row.
    best = Window.partitionBy("paper_id", "name").orderBy("hop").rangeBetween(Window.unboundedPreceding, -1)
    kept = near.filter("strong").withColumn("before", F.max("score").over(best)).filter("before is null or before < 5").drop("before")
    return near.filter("not strong").unionByName(kept).drop("strong")


def _hops(wanted: DataFrame, own: DataFrame, edges: DataFrame, part: Column | None = None) -> DataFrame:
    """paper_id, word, one, two: which of a paper's wanted entities are one step away, and which of the others two steps.

    wanted, own, tables (paper_id, word, bits); edges, a table (citing_id,
    cited_id); ``part``, if given, holds for all papers of ``wanted``.
    """
    side = lambda a, b: edges.select(F.col(a).alias("paper_id"), F.col(b).alias("near"))
    step = side("citing_id", "cited_id").unionByName(side("cited_id", "citing_id")).filter("paper_id <> near")
    own = own.filter("paper_id is not null")
    theirs = own.select(F.col("paper_id").alias("near"), "word", F.col("bits").alias("theirs"))
    around = lambda steps: steps.join(theirs, "near").groupBy("paper_id", "word").agg(bits.union("theirs"))
    asked = wanted.filter("paper_id is not null").join(around(step if part is None else step.filter(part)), ["paper_id", "word"], "left").select("paper_id", "word", "bits", F.coalesce("theirs", F.lit(0)).alias("theirs"))
    asked = cut(asked.select("paper_id", "word", F.expr("bits & theirs").alias("one"), F.expr("bits & ~theirs").alias("rest")))
    rest = asked.filter("rest <> 0").join(own, ["paper_id", "word"], "left").select("paper_id", "word", "rest", F.coalesce("bits", F.lit(0)).alias("mine"))
    middle = cut(step.join(rest, "paper_id").select("paper_id", F.col("near").alias("middle"), "word", F.expr("rest & mine").alias("mine"), F.expr("rest & ~mine").alias("others")))
    # Two steps away must be another paper. A paper's own entities are beside each of its neighbours, so there it takes a second paper.
    need = middle.filter("mine <> 0").groupBy(F.col("middle").alias("paper_id"), "word").agg(F.bit_or("mine").alias("need"))
    held = step.join(need, "paper_id").join(theirs, ["near", "word"]).withColumn("both", F.expr("need & theirs")).filter("both <> 0").select("paper_id", "near", "word", F.explode(F.filter(F.sequence(F.lit(0), F.lit(bits.WIDTH - 1)), lambda b: F.call_function("getbit", F.col("both"), b) == 1)).alias("bit"))
    twice = held.groupBy("paper_id", "word", "bit").agg(F.min("near").alias("least"), F.max("near").alias("most")).filter("least < most")
    twice = twice.groupBy("paper_id", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("theirs"))
    on = lambda df: df.withColumnRenamed("paper_id", "middle")
    met = middle.filter("mine <> 0").join(on(twice), ["middle", "word"]).select("paper_id", "word", F.expr("mine & theirs").alias("two"))
    others = middle.filter("others <> 0")
    beside = around(step.join(others.select(F.col("middle").alias("paper_id")).distinct(), "paper_id", "left_semi"))
    met = met.unionByName(others.join(on(beside), ["middle", "word"]).select("paper_id", "word", F.expr("others & theirs").alias("two")))
    return asked.select("paper_id", "word", "one").join(met.groupBy("paper_id", "word").agg(bits.union("two")), ["paper_id", "word"], "left").select("paper_id", "word", "one", F.coalesce("two", F.lit(0)).alias("two"))


#: The part of all papers that ``nearest_links`` looks at first.
FIRST = 64


def nearest_links(names: DataFrame, scores: DataFrame, paper_authors: DataFrame, edges: DataFrame) -> DataFrame:
    """name, author_id, score, hop: of each name the candidates that ``link_decisions`` may choose, at their least hop on any paper.

    Only candidates of a name's greatest score are asked for: none has more than
    5, so what a nearer 5 leaves out would not be chosen.  No hop is below 1, so
    a candidate found there on some papers needs no other paper, and those after
    it in order can't be chosen; the others are looked for on all papers.
    """
    best = scores.groupBy("name").agg(F.max("score").alias("score"))
    left, edges = cut(scores.join(best, ["name", "score"]).select("name", "author_id", "score").distinct()), cut(edges.select("citing_id", "cited_id"))
    at, known = bits.places(left, "author_id"), bits.places(names.join(left.select("name").distinct(), "name", "left_semi"), "name")
    said, own = cut(bits.packed(names, "paper_id", "name", known)), cut(bits.packed(paper_authors, "paper_id", "author_id", at))
    # Without a paper nothing is near, but a name is a candidate of its own.
    every = left.withColumn("hop", F.lit(3)).join(known.select("name"), "name", "left_semi")
    found, share = None, F.pmod(F.xxhash64("paper_id"), F.lit(FIRST)) == 0
    for part in (share, ~share):
        asked = cut(bits.rows(said.filter(part), known).select("paper_id", "name"))
        wanted = asked.join(bits.packed(left, "name", "author_id", at), "name").groupBy("paper_id", "word").agg(bits.union("bits"))
        hops = _hops(wanted, own, edges, part)
        near = asked.join(left.join(at, "author_id"), "name").join(hops, ["paper_id", "word"]).select("name", "author_id", "score", F.when(bits.holds("one"), 1).when(bits.holds("two"), 2).otherwise(3).alias("hop"))
        near = cut(near.groupBy("name", "author_id", "score").agg(F.min("hop").alias("hop")))
        found = near if found is None else found.unionByName(near)
        first = found.filter("hop = 1").groupBy("name").agg(F.min("author_id").alias("first"))
        left = cut(left.join(first, "name", "left").filter("first is null or author_id < first").drop("first"))
        if left.isEmpty():
            break
    return found.unionByName(every).groupBy("name", "author_id", "score").agg(F.min("hop").alias("hop"))


def link_decisions(names: DataFrame, candidates: DataFrame) -> DataFrame:
    """name, decision (auto, judgment, new), author_id: the best candidate of the name's first paper that has one."""
    order = Window.partitionBy("name").orderBy(F.desc("score"), "hop", "author_id")
    best = candidates.withColumn("r", F.row_number().over(order)).filter("r = 1")
    kind = F.when(F.col("score").isNull(), "new").when(F.col("score") >= 3, "auto").otherwise("judgment")
    return names.select("name").distinct().join(best.select("name", "author_id", "score"), "name", "left").select("name", kind.alias("decision"), "author_id", "score")


def applied(entities: DataFrame, decisions: DataFrame) -> DataFrame:
    """Entities with the names decided for them: variants joined, the canonical name replaced by a longer one."""
    d = decisions.filter("author_id is not null").groupBy("author_id").agg(F.array_sort(F.collect_set("name")).alias("more"), F.max_by("name", F.struct(F.length("name"), "name")).alias("longest"))
    j = entities.join(d, "author_id", "left")
    variants = F.array_join(F.array_sort(F.array_union(F.split("name_variants", r"\|"), F.coalesce("more", F.array().cast("array<string>")))), "|")
    name = F.when(F.length("longest") > F.length("canonical_name"), F.col("longest")).otherwise(F.col("canonical_name"))
    return j.select(*[variants.alias(c) if c == "name_variants" else name.alias(c) if c == "canonical_name" else F.col(c) for c in entities.columns])


def parse_decisions(lines: DataFrame) -> DataFrame:
    """name, author_id, override from lines ``name -> id`` or ``OVERRIDE: name -> id``; # comments are left out."""
    v = F.trim("value")
    rows = lines.filter(~F.startswith(v, F.lit("#")) & F.contains("value", F.lit("->")))
    over = F.startswith(v, F.lit("OVERRIDE:"))
    body = F.regexp_replace(v, "^OVERRIDE:", "")
    return rows.select(F.trim(F.substring_index(body, "->", 1)).alias("name"), F.trim(F.substring_index(body, "->", -1)).alias("author_id"), over.alias("override"))


def memberships(paper_names: DataFrame, groups: DataFrame) -> DataFrame:
    """paper_id, author_id of the entities (group, author_id) that ``person_groups`` made of the same names."""
    p = _named(paper_names).select("name", "key")
    of = p.join(merged_keys(p), "key").join(groups.select("group", "author_id"), "group").select("name", "author_id")
    return bits.once(paper_names.join(of, "name"), "paper_id", "author_id")


def updated_groups(groups: DataFrame, members: DataFrame, new_names: DataFrame, papers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Entities (group, author_id, canonical_name, name_variants, paper_count, owned_paper_count) and (paper_id, author_id) with new papers' names.

    Names go to the entity whose group is their key, which keeps its id; others
    make entities of their own.  Groups aren't merged anew: that takes a full
    build.  ``papers``, if given, has the types of all papers that are counted.
    """
    from citeloom.operators.resolve import assign_ids

    p = parsed(new_names).filter("key is not null")
    more = p.groupBy(F.col("key").alias("group")).agg(F.max_by("author_id", F.struct(F.length("author_id"), "author_id")).alias("base"), F.array_sort(F.collect_set("name")).alias("more"))
    known = groups.select("group", "author_id", "name_variants")
    fresh = assign_ids(more.join(known, "group", "left_anti"), groups.select(F.col("author_id").alias("paper_id")), "group").withColumnRenamed("paper_id", "author_id")
    names = F.array_sort(F.array_union(F.split(F.coalesce("name_variants", F.lit("")), r"\|"), F.coalesce("more", F.array().cast("array<string>"))))
    rows = known.join(more.drop("base"), "group", "left").unionByName(fresh.select("group", "author_id", F.lit(None).cast("string").alias("name_variants"), "more"))
    rows = rows.withColumn("names", F.filter(names, lambda n: n != ""))
    rank = lambda n: F.struct(F.length(F.trim(F.regexp_replace(n, "^[^,]*,", ""))).alias("first"), F.length(n).alias("all"), n.alias("name"))
    both = members.unionByName(p.select("paper_id", "key").join(rows.select(F.col("group").alias("key"), "author_id"), "key").select("paper_id", "author_id")).distinct()
    types = both.withColumn("owned", F.lit(False)) if papers is None else both.join(papers.select("paper_id", owned(F.col("type")).alias("owned")), "paper_id", "left")
    counts = types.groupBy("author_id").agg(F.count("*").alias("paper_count"), F.count(F.when(F.col("owned"), 1)).alias("owned_paper_count"))
    done = rows.join(counts, "author_id").select("group", "author_id", F.array_max(F.transform("names", rank))["name"].alias("canonical_name"), F.array_join("names", "|").alias("name_variants"), "paper_count", "owned_paper_count")
    return done, both


def batch_groups(names: DataFrame, existing: DataFrame, least: int = 3) -> DataFrame:
    """name, author_id, primary_name of new names (paper_id, name) that match no entity, matched with each other.

    Within a surname, names with longer first names, then of more papers, then
    by text, come first: each joins the earlier one that it matches best, or
    stands for itself with a suggested id that ``existing`` (author_id) lacks.
    """
    from citeloom.operators.resolve import assign_ids

    n = names.select("paper_id", "name", T.parse_author(F.col("name")).alias("p")).filter("p is not null")
    n = cut(n.groupBy("name").agg(F.count_distinct("paper_id").alias("n"), F.first("p").alias("p")).select("name", "n", F.lower("p.lastname").alias("last"), "p.initials", "p.full_firstname"))
    alone = n.select(F.col("name").alias("author_id"), F.col("name").alias("canonical_name"), F.col("name").alias("name_variants"))
    ranks = n.select(F.col("name").alias("node"), F.struct((-F.length("full_firstname")).alias("size"), (-F.col("n")).alias("n"), F.col("name").alias("name")).alias("rank"))
    close = link_scores(n.select("name"), alone).filter((F.col("score") >= least) & (F.col("name") != F.col("author_id")))
    last = lambda x: n.select(F.col("name").alias(x), F.col("last").alias(f"last_{x}"))
    close = cut(close.join(last("name"), "name").join(last("author_id"), "author_id").filter("last_name = last_author_id").select("name", "author_id", "score"))
    # A name looks at its own matches only, so a match counts from its later end.
    side = lambda x: ranks.select(F.col("node").alias(x), F.col("rank").alias(f"rank_{x}"))
    earlier = cut(close.join(side("name"), "name").join(side("author_id"), "author_id").filter("rank_author_id < rank_name"))
    primary = cut(greedy.first_independent(ranks, earlier.select(F.col("author_id").alias("a"), F.col("name").alias("b"))))
    best = F.min(F.struct((-F.col("score")).alias("less"), F.col("rank_author_id").alias("rank"), F.col("author_id").alias("of")))["of"]
    joined = earlier.join(primary.filter("chosen").select(F.col("node").alias("author_id")), "author_id", "left_semi").groupBy("name").agg(best.alias("primary_name"))
    chosen = cut(n.select("name").join(joined, "name", "left"))
    suffix = F.when(F.col("full_firstname") != "", F.col("full_firstname")).when(F.col("initials") != "", F.col("initials")).otherwise("unknown")
    first = n.join(chosen.filter("primary_name is null").select("name"), "name").select("name", F.concat_ws("_", "last", suffix).alias("base"))
    ids = assign_ids(first, existing.select(F.col("author_id").alias("paper_id")), "name").select("name", F.col("paper_id").alias("author_id"))
    return chosen.join(ids.withColumnRenamed("name", "of"), F.col("of") == F.coalesce("primary_name", "name")).select("name", "author_id", "primary_name")


def review_evidence(names: DataFrame, candidates: DataFrame, entities: DataFrame, members: DataFrame, papers: DataFrame, shown: int = 3) -> DataFrame:
    """name, author_id, score, overlap, others, venues: what speaks for each candidate entity of a new name.

    ``overlap`` are the names beside the new one on its papers that a coauthor
    of the candidate goes by; ``others`` the first coauthors by id that are not
    among them, ``venues`` the first journals by paper, at most ``shown`` of each.
    Who shares a paper with whom is a union of the papers' sets, in bits: neither
    the names nor the entities of a paper are paired row by row.  names (paper_id,
    name), candidates (name, author_id, score), entities (author_id,
    canonical_name, name_variants), members (paper_id, author_id), papers
    (paper_id, journal).
    """
    asked = cut(candidates.select("name", "author_id", "score").distinct())
    trimmed = names.join(names.select("name").distinct().select("name", F.trim("name").alias("_trimmed")), "name").select("paper_id", F.col("_trimmed").alias("name"))
    known, at = bits.places(trimmed, "name"), bits.places(members, "author_id")
    said, own = cut(bits.packed(trimmed, "paper_id", "name", known)), cut(bits.packed(members, "paper_id", "author_id", at))

    def beside(sets: DataFrame, every: DataFrame, of: DataFrame, item: str, other: str) -> DataFrame:
        """item, other: what stands on a paper beside each item of ``of``."""
        wanted = every.join(of.select(item).distinct(), item, "left_semi")
        met = sets.join(sets.select("paper_id", F.col("word").alias("_word"), F.col("bits").alias("_bits")), "paper_id")
        near = bits.rows(met, wanted).groupBy(item, "_word").agg(F.bit_or("_bits").alias("bits")).withColumnRenamed("_word", "word")
        return bits.rows(near, every.withColumnRenamed(item, other)).select(item, other).filter(F.col(item) != F.col(other))

    goes_by = entities.select(F.col("author_id").alias("co_id"), F.explode(F.array_union(F.array("canonical_name"), F.split("name_variants", r"\|"))).alias("other"))
    proposed = asked.select("name", "author_id").join(beside(said, known, asked, "name", "other"), "name").join(goes_by, "other").filter("author_id <> co_id")
    together = cut(beside(own, at, asked, "author_id", "co_id"))
    overlap = cut(proposed.join(together, ["author_id", "co_id"]).select("name", "author_id", "other").distinct())
    title = entities.select(F.col("author_id").alias("co_id"), F.col("canonical_name").alias("other"))
    rest = asked.select("name", "author_id").join(together, "author_id").join(title, "co_id").join(overlap, ["name", "author_id", "other"], "left_anti")
    rest = rest.withColumn("r", F.row_number().over(Window.partitionBy("name", "author_id").orderBy("co_id"))).filter(F.col("r") <= shown)
    journals = bits.rows(own.join(papers.select("paper_id", "journal").filter("journal <> ''"), "paper_id"), at).groupBy("author_id", "journal").agg(F.min("paper_id").alias("first"))
    journals = journals.withColumn("r", F.row_number().over(Window.partitionBy("author_id").orderBy("first", "journal"))).filter(F.col("r") <= shown)
    ordered = lambda c, by: F.transform(F.array_sort(F.collect_list(F.struct(by, c))), lambda x: x[c])
    return (
        asked.join(overlap.groupBy("name", "author_id").agg(F.array_sort(F.collect_list("other")).alias("overlap")), ["name", "author_id"], "left")
        .join(rest.groupBy("name", "author_id").agg(ordered("other", "r").alias("others")), ["name", "author_id"], "left")
        .join(journals.groupBy("author_id").agg(ordered("journal", "r").alias("venues")), "author_id", "left")
        .select("name", "author_id", "score", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("overlap", "others", "venues")])
    )


def review_text(evidence: DataFrame, entities: DataFrame, shown: int = 5) -> DataFrame:
    """name, author_id, text: the lines in which a reviewer reads a candidate; lists without an item have no line, but the overlap has."""
    variants = F.split("name_variants", r"\|")
    more = F.when(F.size(variants) > shown, F.array(F.concat(F.lit("+"), (F.size(variants) - shown).cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    papers = F.array(F.concat(F.col("paper_count").cast("string"), F.lit(" papers")))
    line = lambda label, c, sep: F.when(F.size(c) > 0, F.concat(F.lit(f"  {label}: "), F.array_join(c, sep)))
    lines = [
        F.concat(F.col("name"), F.lit(" -> "), F.col("canonical_name"), F.lit(" ("), F.col("author_id"), F.lit(") [score: "), F.col("score").cast("string"), F.lit("]")),
        F.concat(F.lit("  Variants: "), F.array_join(F.concat(F.slice(variants, 1, shown), more, papers), " | ")),
        F.coalesce(line("Coauthor overlap", "overlap", "; "), F.lit("  Coauthor overlap: (none)")),
        line("Other coauthors", "others", "; "),
        line("Venues", "venues", ", "),
    ]
    return evidence.join(entities, "author_id").select("name", "author_id", F.concat_ws("\n", *lines).alias("text"))
