"""Normalisers and parsers of bibliographic text, as column expressions.

All take and return Columns and stay in the JVM.  Unless stated, null gives
null and an empty text an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with a plain form, name particles, organisations, and words that don't count in titles.
LETTERS = {
    "u": "üúùûůÜÚÙÛŮ", "o": "öøóòôõÖØÓÒÔÕ", "a": "äåáàâãÄÅÁÀÂÃ", "e": "éèêëěÉĚ", "n": "ñńÑŃ", "c": "çčÇČ",
    "i": "íìîïıÍÌÎÏ", "y": "ýÿÝ", "r": "řŘ", "s": "šśŠŚ", "z": "žźżŽŹŻ", "g": "ğĞ", "l": "łŁ",
}
PARTICLES = ["van der", "van de", "van den", "van", "von", "de la", "de los", "de las", "del", "de", "da", "du", "le", "la", "der", "den"]
ORGANISATIONS = {
    "iea": "international_energy_agency",
    "ipcc": "intergovernmental_panel_climate_change",
    "irena": "international_renewable_energy_agency",
    "imf": "international_monetary_fund",
    "oecd": "organisation_economic_cooperation_development",
    "ecb": "european_central_bank",
    "tcfd": "task_force_climate_related_financial_disclosures",
}
TITLE_STOP_WORDS = """a an the of in on for to by at from with as into through about between among across
during near under within without and or but nor yet so both either neither is are be was were has have had
will would can could do does did may might shall should must its it this that these those which who what how
why where their there here""".split()


def transliterate(text: Column) -> Column:
    """Letters with marks to plain ones; only the listed letters change."""
    return F.translate(F.replace(text, F.lit("ß"), F.lit("ss")), "".join(LETTERS.values()), "".join(k * len(v) for k, v in LETTERS.items()))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def normalize_title(title: Column) -> Column:
    t = F.regexp_replace(transliterate(F.coalesce(title, F.lit(""))), r"(?U)(\d+(?:\.\d+)?)\s*°\s*([CcFfKk])", "$1$2")
    t = F.regexp_replace(F.replace(t, F.lit("-"), F.lit(" ")), r"(?U)[^\w\s.]", " ")
    t = F.lower(F.regexp_replace(t, r"(?<![0-9])\.(?![0-9])", " "))
    return F.array_join(F.filter(words_of(t), lambda w: ~w.isin(*TITLE_STOP_WORDS)), " ")


def title_text(title: Column) -> Column:
    """Lower case, punctuation to spaces, single spaces."""
    t = F.regexp_replace(F.lower(F.trim(F.coalesce(title, F.lit("")))), r"(?U)[^\w\s]", " ")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def title_prefix(title: Column, words: int = 5) -> Column:
    """The first words of the title's plain text, joined by underscores."""
    return F.array_join(F.slice(words_of(title_text(title)), 1, words), "_")


def blocking_prefix(title: Column) -> Column:
    """The prefix as a blocking key: empty if too short to tell titles apart."""
    p = title_prefix(title)
    return F.when(F.length(p) > 8, p).otherwise("")


def normalize_doi(doi: Column) -> Column:
    """Without URL and scheme, in lower case; empty and null give null."""
    d = F.regexp_replace(F.trim(doi), r"^https?://(dx\.)?doi\.org/", "")
    return F.nullif(F.lower(F.regexp_replace(d, r"(?i)^doi:\s*", "")), F.lit(""))


def safe_year(year: Column) -> Column:
    """The first four digits in a row as an integer."""
    return F.try_to_number(F.nullif(F.regexp_extract(year.cast("string"), r"(\d{4})", 1), F.lit("")), F.lit("9999")).cast("int")


def detail_level(passes: Column) -> Column:
    """How far an extraction went, from the passes it completed."""
    has = lambda *n: F.size(F.array_except(F.array(*map(F.lit, n)), F.coalesce(passes, F.array().cast("array<int>")))) == 0
    return F.when(has(1, 2, 3, 4), "full").when(has(1, 2, 3), "analysis").when(has(1, 2), "contexts").otherwise("metadata")


def first_lastname(author: Column) -> Column:
    """Before the comma, or the last word, in lower case."""
    return F.lower(F.when(F.contains(author, F.lit(",")), F.trim(F.substring_index(author, ",", 1))).otherwise(F.try_element_at(words_of(author), F.lit(-1))))


def first_author_key(authors: Column) -> Column:
    """The first of authors joined by semicolons: surname in letters a-z only; null if none are left."""
    return F.nullif(F.regexp_replace(first_lastname(F.trim(F.substring_index(authors, ";", 1))), "[^a-z]", ""), F.lit(""))


def initials(firstname: Column) -> Column:
    return F.array_join(F.transform(F.filter(F.split(F.trim(firstname), r"[-\s.]+"), lambda p: p != ""), lambda p: F.lower(F.substring(p, 1, 1))), "")


def parse_author(name: Column) -> Column:
    """(lastname, firstname, initials, full_firstname, key, author_id) of "Last, First"; null without a comma or surname."""
    n = F.trim(name)
    last, first = F.trim(F.substring_index(n, ",", 1)), F.trim(F.regexp_replace(n, "^[^,]*,", ""))
    init = initials(first)
    word = F.lower(F.coalesce(F.try_element_at(words_of(F.replace(F.replace(first, F.lit("."), F.lit("")), F.lit("-"), F.lit(" "))), F.lit(1)), F.lit("")))
    full = F.when(F.length(word) > 1, word).otherwise("")
    part = F.when(full != "", full).otherwise(init)
    raw = F.when(part != "", F.concat(F.lower(last), F.lit("_"), part)).otherwise(F.lower(last))
    slug = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, "[ -]", "_"), "[^a-z0-9_]", ""), "_+", "_")
    key = F.when(init != "", F.concat(F.lower(last), F.lit("_"), init)).otherwise(F.lower(last))
    row = F.struct(last.alias("lastname"), first.alias("firstname"), init.alias("initials"), full.alias("full_firstname"), key.alias("key"), F.regexp_replace(slug, "^_|_$", "").alias("author_id"))
    return F.when(F.contains(n, F.lit(",")) & (last != ""), row)


def normalize_author_lastname(author: Column) -> Column:
    """The normal forms of an author's surname: one, two for a known organisation, none for an empty name."""
    s = F.trim(author)
    comma = F.contains(s, F.lit(","))
    last = F.trim(F.substring_index(s, ",", 1))
    org = ~comma & (F.upper(s) == s)
    slug = F.replace(F.regexp_replace(F.lower(transliterate(s)), r"[\s-]+", "_"), F.lit("'"), F.lit(""))
    known = F.lit(None).cast("string")
    for short, long in ORGANISATIONS.items():
        known = F.when(slug == short, F.lit(long)).otherwise(known)
    low = F.lower(transliterate(last))
    tidy = lambda x: F.replace(F.replace(x, F.lit("'"), F.lit("")), F.lit("-"), F.lit("_"))
    plain = tidy(low)
    for p in sorted(PARTICLES, key=len):  # the longest is tested first
        plain = F.when(F.startswith(low, F.lit(p + " ")), F.concat(F.lit(p.replace(" ", "_") + "_"), tidy(F.trim(F.substring(low, len(p) + 2, 1 << 20))))).otherwise(plain)
    person = F.regexp_replace(plain, r"(?U)[^\w]", "")
    return F.when(F.coalesce(s, F.lit("")) == "", F.array().cast("array<string>")).when(org, F.filter(F.array(slug, known), lambda x: x.isNotNull())).otherwise(F.filter(F.array(person), lambda x: x != ""))


def paper_id_base(title: Column, authors: Column, year: Column) -> Column:
    """surname_year_word; repeats of one base are told apart by ``resolve.assign_ids``."""
    last = F.coalesce(first_lastname(F.try_element_at(authors, F.lit(1))), F.lit("unknown"))
    last = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(transliterate(last)), "[^a-z0-9]", "_"), "^_+|_+$", ""), "_+", "_")
    word = F.filter(words_of(title_text(transliterate(title))), lambda w: ~w.isin(*TITLE_STOP_WORDS) & ~w.rlike("^[0-9]+$"))
    return F.concat_ws("_", F.when(last == "", "unknown").otherwise(last), F.coalesce(F.nullif(F.trim(year.cast("string")), F.lit("")), F.lit("0000")), F.coalesce(F.try_element_at(word, F.lit(1)), F.lit("paper")))


def format_authors(authors: Column, most: int = 3) -> Column:
    """Up to three surnames of authors joined by semicolons, then "et al."."""
    names = F.transform(F.filter(F.split(authors, ";"), lambda a: F.trim(a) != ""), lambda a: F.trim(F.substring_index(F.trim(a), ",", 1)))
    shown = F.array_join(F.slice(names, 1, most), ", ")
    return F.when(F.size(names) > most, F.concat(shown, F.lit(" et al."))).otherwise(shown)


def classify_identifier(s: Column) -> Column:
    """(kind, normalized): url, arxiv_id, doi, db_paper_id or unknown."""
    t = F.trim(s)
    arxiv = t.rlike(r"^(\d{4}\.\d{4,5}|[a-z-]+(\.[A-Z]{2})?/\d{7})(v\d+)?$")
    kind = F.when(t.rlike("^https?://"), "url").when(arxiv, "arxiv_id").when(F.startswith(t, F.lit("10.")), "doi").when(t.rlike(r"^[a-z][a-z0-9_]*_\d{4}_[a-z]"), "db_paper_id").otherwise("unknown")
    return F.struct(kind.alias("kind"), F.when(kind == "arxiv_id", F.regexp_replace(t, r"v\d+$", "")).when(kind == "doi", F.lower(t)).otherwise(t).alias("normalized"))


def arxiv_from_doi(doi: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_extract(doi, r"(?i)^10\.48550/arxiv\.(.+)$", 1), r"v\d+$", ""), F.lit(""))


def preprint_server(arxiv_id: Column, doi: Column, open_access_url: Column) -> Column:
    d, url = F.lower(F.coalesce(doi, F.lit(""))), F.coalesce(open_access_url, F.lit(""))
    return (
        F.when(F.coalesce(arxiv_id, F.lit("")) != "", "arxiv")
        .when(d.rlike(r"^10\.1101/\d{4}\.\d{2}\.\d{2}\.\d+"), F.when(F.contains(url, F.lit("medrxiv.org")), "medrxiv").otherwise("biorxiv"))
        .when(F.startswith(d, F.lit("10.2139/ssrn.")), "ssrn")
        .when(F.contains(url, F.lit("arxiv.org")), "arxiv")
        .when(F.contains(url, F.lit("biorxiv.org")), "biorxiv")
        .when(F.contains(url, F.lit("medrxiv.org")), "medrxiv")
    )


def flip_name(name: Column) -> Column:
    """ "First Last" as "Last, First"; names with a comma or of one word stay."""
    return F.when(F.contains(name, F.lit(",")), name).otherwise(F.regexp_replace(F.trim(name), r"^(.*\S)\s+(\S+)$", "$2, $1"))


def snippet(text: Column, term: str, around: int = 40) -> Column:
    """The text around the first hit in any case, or its first 100 characters."""
    at = F.instr(F.lower(text), term.lower())
    start = F.greatest(at - around, F.lit(1))
    stop = F.least(at + len(term) + around, F.length(text) + 1)
    hit = F.concat(F.when(start > 1, "...").otherwise(""), F.substr(text, start, stop - start), F.when(stop <= F.length(text), "...").otherwise(""))
    return F.when(at > 0, hit).when(F.length(text) > 100, F.concat(F.substring(text, 1, 100), F.lit("..."))).otherwise(text)


def safe_filename(name: Column) -> Column:
    return F.substring(F.regexp_replace(name, r"(?U)[^\w.-]", "_"), 1, 100)


def stale(fetched: Column, today: Column, days: int = 30) -> Column:
    """Whether a cached answer is too old or its date can't be read."""
    return F.coalesce(F.datediff(today, F.try_to_date(fetched)) >= days, F.lit(True))
