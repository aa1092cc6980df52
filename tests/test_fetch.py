import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from citeloom.operators import fetch


@pytest.fixture(scope="module")
def service():
    """A small service: busy at first, absent, failing, or with pages."""
    asked = {}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802  the library's name
            asked[self.path] = asked.get(self.path, 0) + 1
            if self.path == "/gone":
                return self.send_error(404)
            if self.path == "/busy" and asked[self.path] < 3:
                return self.send_error(429)
            if self.path == "/broken":
                return self.send_error(503)
            body = b"%PDF-1.4 text" if self.path == "/pdf" else json.dumps({"path": self.path}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_POST(self):  # noqa: N802
            body = self.rfile.read(int(self.headers["Content-Length"]))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_calls_wait_twice_as_long_each_time(service):
    waits = []
    assert json.loads(fetch.called(service + "/busy", wait=waits.append)) == {"path": "/busy"}
    assert waits == [5.0, 10.0]
    assert fetch.called(service + "/gone") is None
    assert fetch.called(service + "/x", body={"ids": [1]}) == b'{"ids": [1]}'
    with pytest.raises(OSError):
        fetch.called(service + "/broken", wait=waits.append)


def test_pages():
    entries = [{"n": k} for k in range(25)]
    calls = []

    def get(offset, limit):
        calls.append((offset, limit))
        return {"data": entries[offset : offset + limit]} | ({"next": offset + limit} if offset + limit < 25 else {})

    assert list(fetch.paged(get, page=10)) == entries and calls == [(0, 10), (10, 10), (20, 10)]
    assert list(fetch.paged(get, most=12, page=10)) == entries[:12]
    assert list(fetch.paged(lambda o, n: None)) == []


def test_downloads_are_whole_or_not_there(service, tmp_path):
    path = tmp_path / "a.pdf"
    assert fetch.downloaded(service + "/html", str(path)) == "not_pdf" and not path.exists()
    assert fetch.downloaded(service + "/gone", str(path)) == "not_found"
    assert fetch.downloaded(service + "/pdf", str(path)) == "ok" and path.read_bytes().startswith(b"%PDF")
    assert [x.name for x in tmp_path.iterdir()] == ["a.pdf"]


def test_answers_are_rows(spark):
    def call(url):
        if url == "bad":
            raise OSError("no route")
        return None if url == "gone" else json.dumps({"paperId": url})

    rows = spark.createDataFrame([(1, "a"), (2, "gone"), (3, "bad")], "id int, url string")
    got = sorted(tuple(r) for r in fetch.answers(rows, "id", call).collect())
    assert got == [(1, "ok", '{"paperId": "a"}'), (2, "not_found", None), (3, "failed", "no route")]


def test_keys_from_environment_or_file(tmp_path, monkeypatch):
    path = tmp_path / "c.yaml"
    path.write_text('# key: no\nSOME_KEY: "abc"\nother: x\n')
    monkeypatch.delenv("SOME_KEY", raising=False)
    assert fetch.api_key("SOME_KEY", str(path)) == "abc" and fetch.api_key("SOME_KEY") is None
    monkeypatch.setenv("SOME_KEY", "env")
    assert fetch.api_key("SOME_KEY", str(path)) == "env"


def test_records_of_odd_entries(spark):
    rows = [('{"citingPaper": {}}',), ("{}",), ("not json",), (None,)]
    got = spark.createDataFrame(rows, "e string").select(fetch.citing_record(F.col("e")).alias("r")).select("r.*").collect()
    assert all((r.title, r.authors, r.journal, r.doi) == ("", [], "", None) for r in got)
