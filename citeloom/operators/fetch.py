"""Answers of bibliographic services: calls with retries, pages, downloads, and records made of their JSON.

The pure parts are columns over tables of answers.  ``answers`` makes such a
table of a table of requests: each task calls at its own pace, and a request
that fails is a row with a status, never a failed job.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import text as T

#: Entries of a page, seconds before the first repetition, and statuses that mean there is nothing.
PAGE, DELAY, ABSENT = 1000, 5.0, (400, 404)
PDF = b"%PDF"


def api_key(name: str, path: str | None = None) -> str | None:
    """A key from the environment, or else from a file of ``name: value`` lines."""
    if found := os.environ.get(name):
        return found
    if path and os.path.exists(path):
        with open(path) as f:
            pairs = dict(line.split(":", 1) for line in f if ":" in line and not line.lstrip().startswith("#"))
        return {k.strip(): v.strip().strip("\"'") for k, v in pairs.items()}.get(name) or None
    return None


def called(url: str, body: dict | None = None, headers: dict | None = None, retries: int = 3, delay: float = DELAY, wait: Callable[[float], None] = time.sleep) -> bytes | None:
    """What a URL answers; None where there is nothing.  A busy or failing service is asked again after twice the time."""
    for turn in range(retries):
        request = urllib.request.Request(url, None if body is None else json.dumps(body).encode(), {"Accept": "application/json", **({"Content-Type": "application/json"} if body is not None else {}), **(headers or {})})
        try:
            with urllib.request.urlopen(request, timeout=30) as answer:  # noqa: S310  the caller's own service
                return answer.read()
        except urllib.error.HTTPError as e:
            if e.code in ABSENT:
                return None
            if turn == retries - 1 or e.code not in (429, 500, 502, 503, 504):
                raise
        except urllib.error.URLError:
            if turn == retries - 1:
                raise
        wait(delay * 2**turn)
    return None


def paged(get: Callable[[int, int], dict | None], most: int | None = None, page: int = PAGE) -> Iterator[dict]:
    """The entries of all pages, ``most`` at most; get(offset, limit) gives an object with ``data`` and, if there is more, ``next``."""
    offset = 0
    while True:
        limit = page if most is None else min(page, most - offset)
        answer = get(offset, limit) if limit > 0 else None
        data = (answer or {}).get("data") or []
        yield from data[:limit]
        offset += len(data)
        if not data or len(data) < limit or "next" not in answer:
            return


def downloaded(url: str, path: str, get: Callable[[str], bytes | None] = called) -> str:
    """Saves a PDF under its name only when it is whole: ok, not_found, or not_pdf for an answer that is something else."""
    data = get(url)
    if data is None:
        return "not_found"
    if not data.startswith(PDF):
        return "not_pdf"
    with open(f"{path}.part", "wb") as f:
        f.write(data)
    os.replace(f"{path}.part", path)
    return "ok"


def answers(requests: DataFrame, key: str, call: Callable[[str], str | None], pause: float = 0.0) -> DataFrame:
    """key, status (ok, not_found, failed), response of each request (key, url); a table for the next steps, and the log of this one."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for k, url in zip(part["k"], part["url"], strict=True):
                try:
                    found = call(url)
                    rows.append((k, "not_found" if found is None else "ok", found))
                except Exception as e:  # noqa: BLE001  the row says so
                    rows.append((k, "failed", str(e)))
                time.sleep(pause)
            yield pd.DataFrame(rows, columns=[key, "status", "response"])

    return requests.select(F.col(key).alias("k"), "url").mapInPandas(run, f"`{key}` {requests.schema[key].dataType.simpleString()}, status string, response string")


def citing_record(entry: Column) -> Column:
    """title, authors, year, journal, doi, s2_paper_id, abstract of one entry of a paper's citations, as JSON."""
    get = lambda p: F.get_json_object(entry, f"$.citingPaper.{p}")
    names = F.transform(F.from_json(get("authors"), "array<struct<name:string>>"), lambda a: T.flip_name(a["name"]))
    journal = F.coalesce(F.nullif(get("publicationVenue.name"), F.lit("")), get("journal.name"), F.lit(""))
    return F.struct(F.coalesce(get("title"), F.lit("")).alias("title"), F.coalesce(names, F.array().cast("array<string>")).alias("authors"), get("year").cast("int").alias("year"), journal.alias("journal"), T.normalize_doi(get("externalIds.DOI")).alias("doi"), get("paperId").alias("s2_paper_id"), F.coalesce(get("abstract"), F.lit("")).alias("abstract"))


def service_id(doi: Column, title: Column) -> Column:
    """How a target is looked up: by its DOI if it has one, else by its title; null if it has neither."""
    d = T.normalize_doi(doi)
    return F.when(d.isNotNull(), F.concat(F.lit("DOI:"), d)).when(F.trim(F.coalesce(title, F.lit(""))) != "", F.concat(F.lit("TITLE:"), F.trim(title)))


def download_choice(identifier: Column, doi: Column, open_access: Column, known: Column) -> Column:
    """url, source of a paper to download.

    ``identifier`` as its user gives it; ``doi`` of the paper that it names, if
    any; ``open_access`` the service's URL; ``known`` whether the service knows
    the paper.  After the service's URL come those of preprint servers, which
    follow from an id.
    """
    c = T.classify_identifier(identifier)
    kind, value = c["kind"], c["normalized"]
    in_url = F.regexp_replace(F.regexp_extract(identifier, r"arxiv\.org/(?:abs|pdf)/([^\s?/]+)", 1), r"v\d+$", "")
    d = F.when(kind == "doi", value).when(kind == "url", F.nullif(F.lower(F.regexp_extract(identifier, "doi\\.org/(.+)$", 1)), F.lit(""))).when(kind == "db_paper_id", T.normalize_doi(doi))
    preprint = F.coalesce(F.when(kind == "arxiv_id", value), F.nullif(F.when(kind == "url", in_url), F.lit("")), T.arxiv_from_doi(d))
    free = F.nullif(open_access, F.lit(""))
    url = F.coalesce(free, F.concat(F.lit("https://arxiv.org/pdf/"), preprint), F.when(F.startswith(d, F.lit("10.1101/")), F.concat(F.lit("https://www.biorxiv.org/content/"), d, F.lit(".full.pdf"))))
    source = F.when(free.isNotNull(), "s2_open_access").when(preprint.isNotNull(), "arxiv_direct").when(F.startswith(d, F.lit("10.1101/")), "biorxiv_direct").when(~F.coalesce(known, F.lit(True)), "not_found").otherwise("not_open_access")
    return F.struct(url.alias("url"), source.alias("source"))


def import_matches(papers: DataFrame, listing: DataFrame) -> DataFrame:
    """paper_id, stem, how (id, prefix, title): the file of a listing (stem) that is most likely each paper's.

    By its id, else by the id's first 30 characters at the name's start, else by
    the title's first two words of over four letters, both within the name; the
    first name of each kind.  Names meet papers by these, never all with all.
    """
    p = papers.select("paper_id", F.substring("paper_id", 1, 30).alias("head"), F.slice(F.transform(F.filter(T.words_of(F.coalesce("title", F.lit(""))), lambda w: F.length(w) > 4), F.lower), 1, 2).alias("words"))
    f = listing.select("stem").distinct()
    same = p.join(f, F.col("paper_id") == F.col("stem")).select("paper_id", "stem", F.lit(1).alias("rank"))
    heads = f.select("stem", F.substring("stem", 1, 30).alias("head"))
    # A name starts with a shorter head, too: every length of head that papers have is a key.
    sizes = [r.n for r in p.select(F.length("head").alias("n")).distinct().collect()]  # thirty at most
    keys = f.select("stem", F.explode(F.array_distinct(F.array(*[F.substring("stem", 1, n) for n in sizes] or [F.lit(None).cast("string")]))).alias("head"))
    prefix = p.filter("head <> ''").join(keys, "head").select("paper_id", "stem", F.lit(2).alias("rank"))
    parts = heads.select("stem", F.explode(F.array_distinct(F.filter(F.split(F.lower("stem"), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 4))).alias("word"))
    first = p.filter(F.size("words") == 2).withColumn("word", F.col("words")[0])
    title = first.join(parts, "word").filter(F.contains(F.lower("stem"), F.col("words")[1])).select("paper_id", "stem", F.lit(3).alias("rank"))
    best = same.unionByName(prefix).unionByName(title).groupBy("paper_id").agg(F.min(F.struct("rank", "stem")).alias("b"))
    return best.select("paper_id", "b.stem", F.element_at(F.array(F.lit("id"), F.lit("prefix"), F.lit("title")), F.col("b.rank")).alias("how"))
