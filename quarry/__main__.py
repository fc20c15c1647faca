"""``python -m quarry``: a corpus from the command line."""

from __future__ import annotations

import argparse
import json
import sys

from quarry import config
from quarry.ids import readable_id


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarry", description=__doc__)
    p.add_argument("--config", default="quarry.json", help="settings file, .json or .yaml")
    p.add_argument("--corpus", help="folder of the corpus")
    sub = p.add_subparsers(dest="verb", required=True)
    a = sub.add_parser("index", help="add files, or a text")
    a.add_argument("path", nargs="?", help="file or folder; - for standard input")
    a.add_argument("--id")
    a.add_argument("--text")
    a = sub.add_parser("search")
    a.add_argument("query")
    a.add_argument("--limit", type=int, default=10)
    a = sub.add_parser("chat")
    a.add_argument("message")
    a.add_argument("--limit", type=int, default=5)
    sub.add_parser("health")
    a = sub.add_parser("documents", aliases=["docs"], help="list documents, last updated first")
    a.add_argument("--limit", type=int, default=100)
    a.add_argument("--after", help="where the page before ended")
    a = sub.add_parser("delete", aliases=["rm"])
    a.add_argument("id", nargs="+")
    a = sub.add_parser("chunks")
    a.add_argument("id")
    a = sub.add_parser("edit", help="replace a chunk's text")
    a.add_argument("chunk_id")
    a.add_argument("text")
    a = sub.add_parser("reset")
    a.add_argument("--force", action="store_true")
    a = sub.add_parser("config")
    a.add_argument("action", choices=["init", "show", "set"])
    a.add_argument("key", nargs="?")
    a.add_argument("value", nargs="?")
    a = sub.add_parser("serve", help="the HTTP interface")
    a.add_argument("--port", type=int, default=8080)
    sub.add_parser("tools", help="the tool interface, JSON-RPC over standard input and output")
    return p


def open_corpus(args, settings: config.Config):
    from quarry.plans.corpus import Corpus
    from quarry.session import get_session

    spark = get_session("local[*]", **{"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    return Corpus(spark, args.corpus or settings.path, max_tokens=settings.chunking.max_tokens, overlap=settings.chunking.overlap)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    settings = config.load(args.config)
    show = lambda x: print(json.dumps(x, indent=2, default=str, ensure_ascii=False))
    if args.verb == "config":
        if args.action == "set":
            config.put(settings, args.key, args.value)
        if args.action in ("init", "set"):
            config.save(settings, args.config)
        from dataclasses import asdict

        show(asdict(settings))
        return 0
    corpus = open_corpus(args, settings)
    if args.verb == "index":
        text = args.text if args.text is not None else sys.stdin.read() if args.path == "-" else None
        if text is not None:
            id_ = args.id or readable_id()
            corpus.index(corpus.spark.createDataFrame([(id_, text)], "id string, text string"))
            show({"status": "indexed", "id": id_})
        else:
            got = corpus.index_files(args.path)
            show({"status": "indexed" if got["indexed"] else "failed", **got})
            return 0 if got["indexed"] or not got["failed"] else 1
    elif args.verb == "search":
        show([r.asDict(True) for r in corpus.search(args.query, args.limit).collect()])
    elif args.verb == "chat":
        from quarry.plans.chat import HttpChatModel

        show(corpus.chat(args.message, HttpChatModel(settings.model.endpoint, settings.model.chat_model), args.limit))
    elif args.verb in ("documents", "docs"):
        rows, after = corpus.page(args.limit, args.after)
        show(rows)
        if after:
            print(f"more with --after {after!r}", file=sys.stderr)
    elif args.verb in ("delete", "rm"):
        show({"version": corpus.delete(*args.id)})
    elif args.verb == "chunks":
        show([r.asDict() for r in corpus.chunks(args.id).collect()])
    elif args.verb == "edit":
        show({"version": corpus.update_chunk(args.chunk_id, args.text)})
    elif args.verb == "health":
        show(corpus.health())
    elif args.verb == "serve":
        from quarry.service import serve

        serve(corpus, args.port).serve_forever()
    elif args.verb == "tools":
        from quarry.service import tools

        tools(corpus, sys.stdin, sys.stdout)
    elif args.verb == "reset":
        if not args.force and input("Delete the corpus? [y/N] ").strip().lower() != "y":
            return 1
        corpus.reset(force=True)
    return 0


if __name__ == "__main__":
    sys.exit(main())
