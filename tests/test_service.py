from __future__ import annotations

import io
import json
import re
import threading
import urllib.error
import urllib.request

import pytest

from quarry import __main__ as cli
from quarry import service
from quarry.embed import HashingEmbedder
from quarry.ids import readable_id
from quarry.plans.corpus import Corpus


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    c = Corpus(spark, str(tmp_path_factory.mktemp("served") / "corpus"), HashingEmbedder(16))
    c.index(spark.createDataFrame([("a", "red apples"), ("b", "blue boats")], "id string, text string"))
    return c


def test_ids():
    got = readable_id()
    assert re.fullmatch("[a-z0-9-]+", got) and len(got.split("-")) == 4 and len(got) <= 30


def test_http(corpus):
    server = service.serve(corpus, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def ask(method, path, body=None):
        request = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", json.dumps(body).encode() if body is not None else None, method=method)
        try:
            with urllib.request.urlopen(request) as got:
                return got.status, json.load(got)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    try:
        assert ask("POST", "/api/index", {"id": "c d", "text": "green trees"}) == (200, {"status": "indexed", "id": "c d"})
        assert ask("GET", "/api/search?query=green%20trees&limit=1")[1]["results"][0]["id"] == "c d"
        assert ask("POST", "/api/search", {"query": ""})[0] == 400
        assert ask("GET", "/api/documents/c%20d/chunks")[1]["chunks"][0]["chunk_text"] == "green trees"
        assert ask("PUT", "/api/chunks/c%20d", {"text": "new words"})[0] == 200
        assert ask("GET", "/api/chunks/c%20d")[1]["chunk_text"] == "new words"
        assert ask("DELETE", "/api/documents/c%20d")[0] == 200 and ask("DELETE", "/api/documents/c%20d")[0] == 404
        request = urllib.request.Request(f"http://127.0.0.1:{server.server_port}/api/files/t.csv", b"k,v\nx,1\n", method="PUT")
        assert json.load(urllib.request.urlopen(request)) == {"status": "indexed", "id": "t"}
        assert ask("GET", "/api/documents/t/chunks")[1]["chunks"][1]["chunk_type"] == "csv_rows"
        page = lambda path: urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}{path}").read().decode()
        assert page("/file/t") == "k,v\nx,1\n" and page("/file/a") == "red apples" and "red apples" in page("/view/a")
        assert "/view/t" in page("/documents") and "/api/search" in page("/docs") and "red apples" in page("/?query=red%20apples") and "<form>" in page("/chat")
        assert ask("GET", "/api/documents/a/text")[1] == {"document_id": "a", "text": "red apples"} and ask("GET", "/file/none")[0] == 404
        request = urllib.request.Request(f"http://127.0.0.1:{server.server_port}/api/files/broken.xlsx", b"no workbook", method="PUT")
        with pytest.raises(urllib.error.HTTPError):
            urllib.request.urlopen(request)
        assert ask("DELETE", "/api/documents/t")[0] == 200
        assert {d["id"] for d in ask("GET", "/api/documents")[1]["documents"]} == {"a", "b"}
        assert ask("GET", "/api/health")[1]["documents"] == 2
        assert ask("GET", "/api/none")[0] == 404 and ask("DELETE", "/api/index")[0] == 405 and ask("POST", "/api/chat", {"message": "x"})[0] == 400
        told = ask("GET", "/api/metrics")[1]
        assert told["gauges"]["documents"] == 2 and all(list(r["buckets"].values()) == sorted(r["buckets"].values()) and r["buckets"]["10"] <= r["count"] for r in told["requests"])
        assert {"route": "/api/health", "status": 200}.items() <= next(r for r in ask("GET", "/api/metrics")[1]["requests"] if r["route"] == "/api/health").items()
    finally:
        server.shutdown()


def test_tools(corpus):
    calls = [
        {"id": 1, "method": "initialize"},
        {"method": "notifications/initialized"},
        {"id": 2, "method": "tools/list"},
        {"id": 3, "method": "tools/call", "params": {"name": "search", "arguments": {"query": "red apples", "limit": 1}}},
        {"id": 4, "method": "tools/call", "params": {"name": "search"}},
        {"id": 5, "method": "tools/call", "params": {"name": "fly"}},
        {"id": 6, "method": "tools/call", "params": {"name": "delete_document", "arguments": {"document_id": "zz"}}},
    ]
    out = io.StringIO()
    service.tools(corpus, io.StringIO("\n".join(map(json.dumps, calls)) + "\n{bad\n"), out)
    got = {r["id"]: r for r in map(json.loads, out.getvalue().splitlines())}
    assert set(got) == {1, 2, 3, 4, 5, 6, None} and len(got[2]["result"]["tools"]) == 6
    assert json.loads(got[3]["result"]["content"][0]["text"])["results"][0]["id"] == "a"
    assert [got[i]["error"]["code"] for i in (4, 5, 6)] == [-32602, -32601, -32603]


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    settings, folder = str(tmp_path / "q.yaml"), str(tmp_path / "corpus")
    run = lambda *args: (cli.main(["--config", settings, "--corpus", folder, *args]), json.loads(capsys.readouterr().out or "null"))
    assert run("config", "set", "chunking.max_tokens", "50")[1]["chunking"]["max_tokens"] == 50
    assert run("index", "--id", "x", "--text", "hello from the shell")[1]["id"] == "x"
    monkeypatch.setattr("sys.stdin", io.StringIO("line one\nline two\n"))
    assert run("index", "-", "--id", "y")[0] == 0
    assert run("search", "hello shell", "--limit", "1")[1][0]["id"] == "x"
    assert {d["id"] for d in run("docs")[1]} == {"x", "y"}
    assert run("rm", "y")[0] == 0 and run("health")[1]["documents"] == 1
    assert run("reset", "--force")[0] == 0
