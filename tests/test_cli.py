import json

import pytest

from citeloom import cli


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("store")
    papers = {
        "doe_2001_carbon": {"id": "doe_2001_carbon", "type": "owned", "title": "Carbon prices", "authors": ["Doe, J."], "year": 2001, "abstract": "On carbon.", "cites": ["roe_1999_tax"], "cited_by": []},
        "roe_1999_tax": {"id": "roe_1999_tax", "type": "stub", "title": "Tax", "authors": ["Roe, K."], "year": "1999", "cites": [], "cited_by": ["doe_2001_carbon"]},
    }
    (d / "extractions").mkdir()
    (d / "papers.json").write_text(json.dumps({"papers": papers}))
    (d / "contexts.json").write_text(json.dumps({"by_cited": {"roe_1999_tax": [{"citing": "doe_2001_carbon", "purpose": "background", "section": "Intro", "quote": "q"}]}}))
    (d / "authors.json").write_text(json.dumps({"persons": {"doe_j": {"canonical_name": "Doe, J.", "name_variants": ["Doe, J."], "papers": ["doe_2001_carbon"], "paper_count": 1}}, "institutions": {"bank": {"name": "Bank", "papers": ["roe_1999_tax"]}}}))
    (d / "extractions" / "doe_2001_carbon.json").write_text(json.dumps({"claims": [{"claim": "prices rise", "type": "finding"}], "keywords": ["tax"], "topics": {"themes": ["energy"]}, "sections": [{"heading": "Intro", "summary": "s"}], "methodology": {"type": "model"}, "questions": ["why"]}))
    (d / "findings").mkdir()
    for k, papers_of in (("f1", ["doe_2001_carbon", "roe_1999_tax"]), ("f2", ["roe_1999_tax", "unknown"])):
        (d / "findings" / f"{k}.json").write_text(json.dumps({"id": k, "title": f"Finding {k}", "question": "q", "summary": "rising", "tags": ["macro"], "papers": [{"paper_id": p, "note": ""} for p in papers_of]}))
    cli.build(spark, str(d), str(d / "out"))
    return str(d / "out")


@pytest.mark.parametrize(
    ("args", "shown"),
    [
        (["paper", "carbon"], "Carbon prices"), (["abstract", "doe"], "On carbon."), (["cites", "tax"], "background"), (["cited-by", "doe_2001"], "roe_1999_tax"), (["claims", "doe"], "prices rise"),
        (["keywords", "doe"], "energy"), (["methodology", "doe"], "model"), (["sections", "doe"], "Intro"), (["questions", "doe"], "why"), (["data-sources", "doe"], "(0 rows)"), (["author", "doe"], "Carbon"),
        (["author-info", "doe"], "doe_j"), (["coauthors", "doe_j"], "(0 rows)"), (["owned"], "doe_2001_carbon"), (["stats"], "papers.rows"), (["methods"], "model"), (["purposes-list"], "background"), (["top-cited"], "roe_1999_tax"),
        (["top-authors"], "doe_j"), (["purpose", "background"], "Intro"), (["chain", "tax"], "doe_2001_carbon"), (["co-cited", "tax"], "(0 rows)"), (["bib-coupling", "doe"], "(0 rows)"), (["shared-refs", "doe"], "roe_1999_tax"),
        (["common-citers", "tax"], "doe_2001_carbon"), (["shared-papers", "doe_j"], "doe_2001_carbon"), (["search", "carbon"], "doe_2001_carbon"), (["search-claims", "prices"], "prices rise"), (["search-authors", "doe"], "doe_j"),
        (["pagerank", "--max-iter", "3"], "Tax"), (["katz", "--max-iter", "3", "--owned"], "Carbon"), (["explore", "--purpose", "background"], "Tax"), (["sql", "SELECT count(*) AS n FROM papers"], "2"), (["schema"], "cited_title"),
        (["search-all", "prices carbon energy"], "energy"), (["index"], "sections"), (["search-all", "prices"], "doe_2001_carbon"), (["findings"], "Finding f2"), (["findings-show", "f1"], "rising"), (["findings-papers", "f1"], "doe_2001_carbon"),
        (["findings-search", "RISING"], "Finding f1"), (["findings-tag", "macro"], "Finding f1"), (["findings-for-paper", "tax"], "f2"), (["findings-missing"], "unknown"), (["findings-tags"], "macro"), (["findings-overlap", "f1", "f2"], "roe_1999_tax"),
    ],
)
def test_command(spark, data, capsys, args, shown):
    assert cli.main(["--data", data, *args]) == 0
    assert shown in capsys.readouterr().out


def test_packing():
    assert cli.packed(["aaaa", "bb", "cccccccc", "é"], 10, 3) == [["aaaa", "bb"], ["cccccccc"], ["é"]]
    assert cli.packed([], 10) == []


def test_ids_must_be_clear(spark, data):
    with pytest.raises(SystemExit, match="may be"):
        cli.main(["--data", data, "paper", "_"])
    with pytest.raises(SystemExit, match="no paper"):
        cli.main(["--data", data, "paper", "zzz"])
