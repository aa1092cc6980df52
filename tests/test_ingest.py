import json

import pytest
from pyspark.sql import functions as F

from citeloom.operators import ingest
from citeloom.sources import archive, documents


def ids(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_chunks_end_at_headings_paragraphs_or_lines(spark):
    head = "x" * 75 + "\n# Heading\n" + "y" * 40
    para = "x" * 80 + "\n\n" + "y" * 60
    line = "x" * 80 + "\n" + "y" * 60
    rows = [(1, head), (2, para), (3, line), (4, "z" * 250), (5, "short"), (6, None), (7, "x" * 100 + " \n ")]
    got = {}
    for r in ingest.chunks(spark.createDataFrame(rows, "id int, t string"), "id", "t", 100).collect():
        got.setdefault(r.id, []).append(r.text)
    assert got[1] == ["x" * 75 + "\n", "# Heading\n" + "y" * 40]
    assert got[2] == ["x" * 80 + "\n", "\n" + "y" * 60]
    assert got[3] == ["x" * 80 + "\n", "y" * 60]
    assert [len(t) for t in got[4]] == [100, 100, 50]
    assert got[5] == ["short"] and got[6] == [""] and got[7] == ["x" * 100]


def test_pages(spark):
    rule = "=" * 80
    text = f"cover\n{rule}\nPAGE 1\n{rule}\nfirst\n{rule}\nPAGE 7\n{rule}\nlast"
    got = ingest.pages(spark.createDataFrame([("a", text), ("b", "none")], "id string, t string"), "id", "t").collect()
    assert [(r.id, r.page, r.text.split("\n")[3]) for r in got] == [("a", 1, "first"), ("a", 7, "last")]


@pytest.mark.parametrize(
    ("line", "title"),
    [
        ("A Long Enough Title of a Paper", True),
        ("Prix du carbone : étude de l'élasticité en Europe", True),
        ("Is the market efficient? Evidence from 1990", True),
        ("too short a", False),
        ("Onlythreeratherlong words here", False),
        ("10.1000/182 and 2101.00001 v2 12 May 2021", False),
        ("https://host.example/a/b?c=d and e", False),
        ("<!-- a remark in the page's source -->", False),
        ("[a link to it](http://x.example/y/z)", False),
        ("Doe, Jane, Roe, Kim, and Poe, Max", False),
        ("Contents of this number follow here:", False),
        ("", False),
    ],
)
def test_lines_that_look_like_a_title(spark, line, title):
    assert spark.createDataFrame([(line,)], "x string").select(ingest._may_be_title(F.col("x")).alias("t")).first().t is title


@pytest.mark.parametrize(("line", "authors"), [("Doe, Jane, Roe, K.", True), ("B, C", True), ("Jane Doe", False), ("Received 12 May 2001, in revised form", False), ("we thank, among others, the editor", False), ("A, " * 80, False)])
def test_lines_that_look_like_authors(spark, line, authors):
    assert spark.createDataFrame([(line,)], "x string").select(ingest._may_be_authors(F.col("x")).alias("t")).first().t is authors


def test_guessed_metadata(spark):
    text = "arXiv:2101.00001\n123\nJournal of Things\n# A Long Enough Title of a Paper\nDoe, Jane, Roe, K.\nshort\nReceived 1 May\nB, C"
    m = spark.createDataFrame([(text,), ("tiny",), (None,)], "t string").select(ingest.guessed_metadata(F.col("t")).alias("m")).collect()
    assert (m[0].m.title, m[0].m.authors) == ("A Long Enough Title of a Paper", ["Doe, Jane, Roe, K.", "B, C"])
    assert (m[1].m.title, m[1].m.authors) == ("", [])


def test_verified_titles(spark):
    wanted = spark.createDataFrame([(1, "Carbon Prices in Europe", "2001", "Doe, J.")], "ref int, title string, year string, author string")
    found = spark.createDataFrame([(1, "a", "Carbon prices in Europe", "2001", "X Y"), (1, "b", "Carbon prices in Europe", "1990", "Jane Doe"), (1, "c", "Carbon prices in Europe", "1990", "Jane Doerr"), (1, "d", "Other", "2001", "Doe")], "ref int, candidate string, title string, year string, author string")
    assert ids(ingest.verified_titles(wanted, found), "candidate") == [("a",), ("b",)]
    assert ids(ingest.verified_titles(wanted, found, whole_surname=False), "candidate") == [("a",), ("b",), ("c",)]


def test_external_ids(spark):
    a = {"paperId": "s", "externalIds": {"DOI": "10.1101/2020.01.02.123", "PubMed": 5}, "openAccessPdf": {"url": "https://www.medrxiv.org/x"}}
    r = spark.createDataFrame([(json.dumps(a),)], "j string").select(ingest.external_ids(F.col("j")).alias("x")).first().x
    assert (r.s2_id, r.pubmed_id, r.doi, r.preprint_server, r.arxiv_id) == ("s", "5", "10.1101/2020.01.02.123", "medrxiv", None)


def test_what_to_fetch(spark):
    targets = spark.createDataFrame([(k,) for k in "abcde"], "paper_id string")
    log = spark.createDataFrame([("b", "ok", "2024-01-01"), ("c", "ok", "2024-03-01"), ("d", "not_found", "2020-01-01"), ("e", "error", "2024-03-01"), ("e", "error", "bad")], "paper_id string, result string, fetched string")
    assert ids(ingest.should_fetch(targets, log, F.lit("2024-03-05").cast("date")), "paper_id", "reason") == [("a", "never attempted"), ("b", "too old"), ("e", "retry")]


def test_contexts_by_id_then_by_key(spark):
    cites = spark.createDataFrame([("p", "x", "1"), ("q", "y", "2"), ("q", "z", None)], "paper_id string, id string, citation_key string")
    ctx = spark.createDataFrame([("p", "x", "c1"), ("p", "ref_1", "lost"), ("q", "ref_2", "c2"), ("q", "ref_9", "lost")], "paper_id string, ref string, quote string")
    assert ids(ingest.with_contexts(cites, ctx), "paper_id", "id", "quote") == [("p", "x", "c1"), ("q", "y", "c2")]


def test_merged_extractions(spark):
    closure = spark.createDataFrame([("b", "a")], "alias string, target string")
    kw = spark.createDataFrame([("a", 0, "Tax"), ("b", 0, "tax"), ("b", 1, "Carbon"), ("c", 0, "tax")], "paper_id string, pos int, keyword string")
    assert ids(ingest.merged_rows(kw, closure, ["keyword"], ["pos"], ["keyword"]), "paper_id", "keyword") == [("a", "Carbon"), ("a", "Tax"), ("c", "tax")]
    meta = spark.createDataFrame([("a", [2, 1], {"1": "m"}), ("b", [3], {"1": "n", "3": "o"})], "paper_id string, passes array<int>, models map<string,string>")
    r = ingest.merged_meta(meta, closure).first()
    assert (r.paper_id, r.passes, r.models, r.merged_from) == ("a", [1, 2, 3], {"1": "m", "3": "o"}, ["b"])
    base = spark.createDataFrame([("a", "old"), ("b", "old")], "paper_id string, v string")
    assert ids(ingest.overlaid(base, spark.createDataFrame([("a", "new"), ("b", None)], "paper_id string, v string"), ["v"]), "paper_id", "v") == [("a", "new"), ("b", "old")]


def test_requests(spark):
    one = lambda *x: spark.createDataFrame([(v,) for v in x], "paper_id string")
    assert ids(ingest.new_requests(one("a", "b", "a"), one("a", "b", "c"), one("b")), "paper_id") == [("a",)]
    with pytest.raises(ValueError):
        ingest.new_requests(one("zz"), one("a"), one())


def test_archives(spark, tmp_path):
    p = spark.createDataFrame([("a", "t", "local.pdf")], "paper_id string, title string, pdf_file string")
    archive.export({"papers": p}, str(tmp_path / "x"), "me")
    assert archive.load(spark, str(tmp_path / "x"))["papers"].columns == ["paper_id", "title"]
    spark.createDataFrame([(json.dumps({"format_version": 9, "tables": []}),)], "value string").write.mode("overwrite").text(str(tmp_path / "x" / "manifest"))
    with pytest.raises(ValueError):
        archive.load(spark, str(tmp_path / "x"))
    (tmp_path / "m.jsonl").write_text('{"source": "s"}\nnot json\n')
    assert archive.changes_from_manifest(spark, str(tmp_path / "m.jsonl")).count() == 1


def test_zipped_corpus(spark, tmp_path):
    import zipfile

    from citeloom.sources import documents

    path = tmp_path / "corpus.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("manifest.json", json.dumps({"format_version": 1}))
        z.writestr("db/papers.json", json.dumps({"papers": {"a": {"id": "a", "title": "T"}}}))
        z.writestr("../out.json", "{}")
    root = archive.unpacked(spark, f"file://{path}", f"file://{tmp_path}/unpacked")
    at = documents.import_root(spark, root)
    assert at.endswith("/unpacked/db") and [r.title for r in documents.load_papers(spark, f"{at}/papers.json").collect()] == ["T"]
    assert not (tmp_path / "out.json").exists()
    with pytest.raises(FileNotFoundError):
        documents.import_root(spark, str(tmp_path / "nowhere"))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("manifest.json", json.dumps({"format_version": 9}))
    with pytest.raises(ValueError, match="version"):
        archive.unpacked(spark, f"file://{path}", f"file://{tmp_path}/again")


def test_sections_come_from_chunks_first(spark):
    from citeloom.sources import documents

    part = lambda *h: json.dumps({"sections": [{"heading": x, "summary": ""} for x in h]})
    rows = [("p", "{}"), ("p.sections", part("single")), ("p.sections.2", part("c")), ("p.sections.1", part("a", "b")), ("q.sections", part("only")), ("r", "{}"), ("p.sections.77", part("too far"))]
    got = documents.sidecar_sections(spark.createDataFrame(rows, "file string, value string")).orderBy("paper_id", "chunk", "pos").collect()
    assert [(r.paper_id, r.heading) for r in got] == [("p", "a"), ("p", "b"), ("p", "c"), ("q", "only")]


def test_wrapped_text():
    from citeloom.cli import wrap

    assert wrap("one two three\nfour\n\nfive", 9, "  ") == "  one two\n  three\n  four\n\n  five"
    assert wrap(None) == "" and max(map(len, wrap("word " * 100).split("\n"))) <= 80


def test_inferred_lines(spark, tmp_path):
    rows = ['{"a":1,"b":{"c":"x"}}', '{"a":2.5,"d":[1,2],"odd name":null}', '{"a":3,"b":{"c":4},"e f":true}', "  ", "[1]", "{broken", "null", '"text"']
    (tmp_path / "x.jsonl").write_text("\n".join(rows))
    found, aside = documents.inferred_lines(spark, str(tmp_path / "x.jsonl"))
    assert {r["value"] for r in aside.collect()} == {"[1]", "{broken", "null", '"text"'}
    got = found.selectExpr("double(a) a", "to_json(b.c) c", "d", "`e f` e").orderBy("a").collect()
    assert [(r.a, r.c, r.d, r.e) for r in got] == [(1.0, '"x"', None, None), (2.5, None, [1, 2], None), (3.0, "4", None, True)]
    (tmp_path / "y.jsonl").write_text("[1]\n")
    none, aside = documents.inferred_lines(spark, str(tmp_path / "y.jsonl"))
    assert none.count() == 0 and aside.count() == 1
