"""The HTTP and tool interfaces of a corpus; both call the same verbs."""

from __future__ import annotations

import json
import mimetypes
import os
import time
from collections import Counter
from collections.abc import Callable
from html import escape
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import TextIO
from urllib.parse import parse_qs, quote, unquote, urlsplit

from quarry.ids import readable_id
from quarry.operators.metrics import BUCKETS
from quarry.operators.search import limit_of


MOST_BYTES = 50 << 20  # of a request


class Missing(Exception):
    """An argument that a verb needs is not there."""


class Verbs:
    """What both interfaces offer, with plain values in and out."""

    def __init__(self, corpus, model=None):
        self.corpus, self.model = corpus, model

    @staticmethod
    def need(args: dict, *names: str) -> list:
        if lacking := [n for n in names if not args.get(n)]:
            raise Missing(f"{', '.join(lacking)} required")
        return [args[n] for n in names]

    def index(self, args: dict) -> dict:
        (text,) = self.need(args, "text")
        id_ = args.get("id") or readable_id()
        self.corpus.index(self.corpus.spark.createDataFrame([(id_, text)], "id string, text string"))
        return {"status": "indexed", "id": id_}

    def _files(self, path: str) -> dict:
        got = self.corpus.index_files(path)
        if not got["indexed"]:
            raise ValueError(got["errors"][0]["error"] if got["errors"] else "no file is there")
        return {"status": "indexed", "id": os.path.splitext(os.path.basename(path))[0], **({"errors": got["errors"]} if got["failed"] else {})}

    def index_file(self, args: dict) -> dict:
        return self._files(*self.need(args, "file_path"))

    def upload(self, args: dict) -> dict:
        """A file's bytes, kept in the corpus and parsed by its name's extension."""
        name, data = self.need(args, "name", "data")
        return self._files(self.corpus.keep_file(os.path.basename(name), data))

    def search(self, args: dict, most: int | None = None) -> dict:
        (query,) = self.need(args, "query")
        rows = self.corpus.search(query, limit_of(int(args.get("limit") or 0), most)).collect()
        return {"results": [r.asDict(True) for r in rows]}

    def chat(self, args: dict) -> dict:
        (message,) = self.need(args, "message")
        if self.model is None:
            raise Missing("a chat model is not set")
        return self.corpus.chat(message, self.model, limit_of(int(args.get("limit") or 0), 20, 5))

    def documents(self, args: dict) -> dict:
        """A page of the listing, and where the next one begins."""
        rows, after = self.corpus.page(limit_of(int(args.get("limit") or 0), 1000, 100), args.get("after"))
        return {"documents": rows, "next": after}

    def document(self, args: dict) -> dict:
        return self.corpus.document(*self.need(args, "document_id"))

    def text(self, args: dict) -> dict:
        found = self.corpus.document(*self.need(args, "document_id"))
        return {"document_id": found["id"], "text": found["original_text"]}

    def file(self, args: dict) -> tuple[str, bytes]:
        """The file that a document came from, or its text where it came from none."""
        found = self.corpus.document(*self.need(args, "document_id"))
        if not found["source_path"]:
            return "text/plain; charset=utf-8", found["original_text"].encode()
        kind = mimetypes.guess_type(found["source_path"])[0] or "application/octet-stream"
        return kind, self.corpus.read_file(found["source_path"])

    def view(self, args: dict) -> tuple[str, bytes]:
        found = self.corpus.document(*self.need(args, "document_id"))
        return page(found["id"], f"<pre>{escape(found['original_text'])}</pre>")

    def list_page(self, args: dict) -> tuple[str, bytes]:
        rows, after = self.corpus.page(100, args.get("after"))
        items = "".join(f'<li><a href="/view/{quote(r["id"], safe="")}">{escape(r["id"])}</a> {escape(r["doc_type"] or "")} {r["chunk_count"]}</li>' for r in rows)
        more = f'<p><a href="/documents?after={quote(after, safe="")}">More</a></p>' if after else ""
        return page("Documents", f"<ul>{items}</ul>{more}")

    def search_page(self, args: dict) -> tuple[str, bytes]:
        form = '<form><input name="query"><button>Search</button></form>'
        found = self.search(args, 50)["results"] if args.get("query") else []
        return page("Search", form + "".join(f'<h2><a href="/view/{quote(r["id"], safe="")}">{escape(r["id"])}</a></h2><p>{escape(r["text"][:500])}</p>' for r in found))

    def chat_page(self, args: dict) -> tuple[str, bytes]:
        form = '<form><input name="message"><button>Ask</button></form>'
        return page("Chat", form + (f"<p>{escape(self.chat(args)['response'])}</p>" if args.get("message") else ""))

    def help_page(self, args: dict) -> tuple[str, bytes]:
        return page("Interface", "<ul>" + "".join(f"<li>{m} {escape(p)}</li>" for m, p, _ in routes(self)) + "</ul>")

    def chunks(self, args: dict) -> dict:
        (id_,) = self.need(args, "document_id")
        self.corpus.document(id_)
        return {"document_id": id_, "chunks": [r.asDict() for r in self.corpus.chunks(id_).collect()]}

    def chunk(self, args: dict) -> dict:
        return self.corpus.chunk(*self.need(args, "chunk_id"))

    def edit(self, args: dict) -> dict:
        self.corpus.update_chunk(*self.need(args, "chunk_id", "text"))
        return {"status": "updated", "chunk_id": args["chunk_id"]}

    def delete(self, args: dict) -> dict:
        (id_,) = self.need(args, "document_id")
        self.corpus.delete(id_)
        return {"status": "deleted", "document_id": id_}

    def health(self, args: dict) -> dict:
        return self.corpus.health()


def page(title: str, body: str) -> tuple[str, bytes]:
    links = '<p><a href="/">Search</a> <a href="/documents">Documents</a> <a href="/chat">Chat</a> <a href="/docs">Interface</a></p>'
    return "text/html; charset=utf-8", f"<!doctype html><meta charset=utf-8><title>{escape(title)}</title>{links}<h1>{escape(title)}</h1>{body}".encode()


def routes(verbs: Verbs) -> list[tuple[str, str, Callable[[dict], dict]]]:
    """(method, path, verb); a part in braces is an argument."""
    return [
        ("POST", "/api/index", verbs.index),
        ("PUT", "/api/files/{name}", verbs.upload),
        ("GET", "/api/search", verbs.search),
        ("POST", "/api/search", verbs.search),
        ("POST", "/api/chat", verbs.chat),
        ("GET", "/api/documents", verbs.documents),
        ("GET", "/api/documents/{document_id}", verbs.document),
        ("DELETE", "/api/documents/{document_id}", verbs.delete),
        ("GET", "/api/documents/{document_id}/chunks", verbs.chunks),
        ("GET", "/api/chunks/{chunk_id}", verbs.chunk),
        ("PUT", "/api/chunks/{chunk_id}", verbs.edit),
        ("GET", "/api/documents/{document_id}/text", verbs.text),
        ("GET", "/api/health", verbs.health),
        ("GET", "/file/{document_id}", verbs.file),
        ("GET", "/view/{document_id}", verbs.view),
        ("GET", "", verbs.search_page),
        ("GET", "/documents", verbs.list_page),
        ("GET", "/chat", verbs.chat_page),
        ("GET", "/docs", verbs.help_page),
    ]


def match(pattern: str, path: str) -> dict | None:
    want, have = pattern.split("/"), path.rstrip("/").split("/")
    if len(want) != len(have):
        return None
    out = {}
    for w, h in zip(want, have):
        if w.startswith("{") and h:
            out[w[1:-1]] = unquote(h)
        elif w != h:
            return None
    return out


def serve(corpus, port: int = 8080, model=None) -> ThreadingHTTPServer:
    """An HTTP server, not yet running; ``/api/metrics`` has the requests by route and status, with their
    seconds in cumulative buckets, and the documents, chunks and vectors there are."""
    table, counts, spent, within = routes(Verbs(corpus, model)), Counter(), Counter(), Counter()

    def metrics() -> dict:
        def row(route, status, n):
            buckets = {str(le): within[route, status, le] for le in BUCKETS["http_seconds"]}
            return {"route": route, "status": status, "count": n, "seconds": round(spent[route, status], 6), "buckets": buckets}

        return {"requests": [row(r, s, n) for (r, s), n in counts.items()], "gauges": {t: corpus.table(t).count() for t in ("documents", "chunks", "embeddings")}}

    class Handler(BaseHTTPRequestHandler):
        def answer(self) -> None:
            began, url = time.time(), urlsplit(self.path)
            pattern, status, body = "other", 404, {"error": "no such path"}
            if self.command == "GET" and url.path == "/api/metrics":
                pattern, status, body = url.path, 200, metrics()
            for method, p, verb in table:
                found = match(p, url.path)
                if found is None:
                    continue
                pattern = p
                if method != self.command:
                    if status == 404:
                        status, body = 405, {"error": "method not allowed"}
                    continue
                try:
                    size = int(self.headers.get("Content-Length") or 0)
                    if size > MOST_BYTES:
                        raise ValueError("too large")
                    body = self.rfile.read(size)
                    if "name" in found:
                        given = {"data": body}
                    else:
                        given = json.loads(body) if size else {k: v[0] for k, v in parse_qs(url.query).items()}
                    status, body = 200, verb({**given, **found})
                except (Missing, ValueError) as e:
                    status, body = 400, {"error": str(e)}
                except KeyError as e:
                    status, body = 404, {"error": str(e.args[0])}
                except Exception as e:  # the server stays up
                    status, body = 500, {"error": str(e)[:500]}
                break
            counts[pattern, status] += 1
            took = time.time() - began
            spent[pattern, status] += took
            for le in BUCKETS["http_seconds"]:
                within[pattern, status, le] += took <= le
            kind, data = body if isinstance(body, tuple) else ("application/json", json.dumps(body, default=str).encode())
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_PUT = do_DELETE = answer

        def log_message(self, *_):
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


_TEXT, _COUNT = {"type": "string"}, {"type": "integer"}


def tool_table(verbs: Verbs) -> dict[str, tuple[str, dict, list[str], Callable[[dict], dict]]]:
    """(description, arguments, those required, verb) by the tool's name."""
    return {
        "index": ("Add or replace a text", {"text": _TEXT, "id": _TEXT}, ["text"], verbs.index),
        "index_file": ("Parse a file and add it", {"file_path": _TEXT}, ["file_path"], verbs.index_file),
        "search": ("Find documents (10 by default, at most 50)", {"query": _TEXT, "limit": _COUNT}, ["query"], lambda a: verbs.search(a, 50)),
        "chat": ("Answer a question from the documents (5 by default, at most 20)", {"message": _TEXT, "limit": _COUNT}, ["message"], verbs.chat),
        "list_documents": ("List the documents", {}, [], verbs.documents),
        "delete_document": ("Delete a document", {"document_id": _TEXT}, ["document_id"], verbs.delete),
    }


def respond(table: dict, message: dict) -> dict | None:
    """The reply to one JSON-RPC message; none to a notification."""
    if "id" not in message:
        return None
    reply = {"jsonrpc": "2.0", "id": message["id"]}
    error = lambda code, text: reply | {"error": {"code": code, "message": text}}
    method, given = message.get("method"), message.get("params") or {}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "quarry", "version": "0.1.0"}}}
    if method == "tools/list":
        tools_ = [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r}} for n, (d, p, r, _) in table.items()]
        return reply | {"result": {"tools": tools_}}
    if method != "tools/call" or given.get("name") not in table:
        return error(-32601, "no such method or tool")
    try:
        got = table[given["name"]][3](given.get("arguments") or {})
    except Missing as e:
        return error(-32602, str(e))
    except Exception as e:  # the loop goes on
        return error(-32603, str(e)[:500])
    return reply | {"result": {"content": [{"type": "text", "text": json.dumps(got, default=str)}]}}


def tools(corpus, source: TextIO, sink: TextIO, model=None) -> None:
    """Answer JSON-RPC messages, one on each line, until the input ends."""
    table = tool_table(Verbs(corpus, model))
    for line in source:
        try:
            got = respond(table, json.loads(line))
        except ValueError:
            got = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        if got is not None:
            sink.write(json.dumps(got) + "\n")
            sink.flush()
