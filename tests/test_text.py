import pytest
from pyspark.sql import functions as F

from citeloom.functions import similarity as S
from citeloom.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize(
    ("f", "value", "expected"),
    [
        (T.transliterate, "Größe Ñandú È", "Grosse nandu È"),
        (T.normalize_title, "The Effects of 1.5 °C warming: a U.S. case-study", "effects 1.5c warming u s case study"),
        (T.normalize_title, None, ""),
        (T.title_prefix, "A Study, of the Many-Things here", "a_study_of_the_many"),
        (T.blocking_prefix, "Short", ""),
        (T.normalize_doi, " https://dx.doi.org/10.1/ABC ", "10.1/abc"),
        (T.normalize_doi, "DOI: 10.1/X", "10.1/x"),
        (T.normalize_doi, "", None),
        (T.safe_year, "c. 1999b", 1999),
        (T.safe_year, "n.d.", None),
        (T.first_author_key, "O'Neil-Smith, J.; Doe, A.", "oneilsmith"),
        (T.first_author_key, "Jane Doe", "doe"),
        (T.initials, "Jean-Paul M.", "jpm"),
        (T.normalize_author_lastname, "van der Berg, A.", ["van_der_berg"]),
        (T.normalize_author_lastname, "O'Neil-Smith, J.", ["oneil_smith"]),
        (T.normalize_author_lastname, "IEA", ["iea", "international_energy_agency"]),
        (T.normalize_author_lastname, "  ", []),
        (T.arxiv_from_doi, "10.48550/arXiv.2101.00001v2", "2101.00001"),
        (T.flip_name, "Anna Maria Lopez", "Lopez, Anna Maria"),
        (T.format_authors, "A, x; B, y; C, z; D, w", "A, B, C et al."),
    ],
)
def test_scalar(spark, f, value, expected):
    assert one(spark, value, f) == expected


def test_parse_author(spark):
    r = one(spark, "García Márquez, Gabriel J.", T.parse_author)
    assert (r.lastname, r.initials, r.full_firstname, r.key) == ("García Márquez", "gj", "gabriel", "garcía márquez_gj")
    assert r.author_id == "garca_mrquez_gabriel"
    assert one(spark, "World Bank", T.parse_author) is None


def test_identifiers(spark):
    kinds = {"https://x.org": "url", "2101.00001v3": "arxiv_id", "10.1/A": "doi", "smith_2020_word": "db_paper_id", "??": "unknown"}
    for value, kind in kinds.items():
        assert one(spark, value, T.classify_identifier).kind == kind


@pytest.mark.parametrize(("passes", "level"), [([1, 2, 3, 4], "full"), ([1, 2, 3], "analysis"), ([1, 2, 4], "contexts"), ([1], "metadata"), (None, "metadata")])
def test_detail_level(spark, passes, level):
    assert spark.createDataFrame([(passes,)], "p array<int>").select(T.detail_level(F.col("p")).alias("x")).first().x == level


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_lcs_against_the_plain_form():
    import random

    rng = random.Random(3)
    for _ in range(500):
        a, b = ("".join(rng.choices("abcd", k=rng.randrange(12))) for _ in range(2))
        assert S.lcs_length(a, b) == lcs(a, b)
    assert S.indel("", "") == 100 and S.indel("abc", None) is None
    assert S.token_sort("b a", "a b") == 100


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("rational", "ration"), ("triplicate", "triplic"), ("hopeful", "hope"), ("revival", "reviv"), ("adoption", "adopt"), ("rate", "rate"), ("controll", "control"), ("sky", "sky")])
def test_porter(word, stem):
    assert S.porter(word) == stem
