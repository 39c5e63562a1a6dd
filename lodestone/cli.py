"""Command line: ingest, remove, stats, vacuum, ask, chat, eval, serve. Exit codes: 0 done, 1 nothing
found or done, 2 an error, told in one line."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Callable

from lodestone import __version__
from lodestone.operators.rerank import RERANKERS
from lodestone.operators.search import DEFAULT_MODES, MODES


def between(low: int, high: int | None = None) -> Callable[[str], int]:
    def check(s: str) -> int:
        try:
            n = int(s)
        except ValueError:
            raise argparse.ArgumentTypeError(f"{s!r} is not a whole number") from None
        if n < low or (high is not None and n > high):
            raise argparse.ArgumentTypeError(f"must be at least {low}" + (f" and at most {high}" if high is not None else ""))
        return n

    return check


def cutoffs(s: str) -> list[int]:
    return sorted({between(1)(x) for x in s.split(",")})


def question(s: str) -> str:
    if not s.strip():
        raise argparse.ArgumentTypeError("the question is empty")
    return s


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestone")
    p.add_argument("--version", action="version", version=__version__)
    p.add_argument("--index", default=os.environ.get("LODESTONE_INDEX", "lodestone-index"))
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("ingest")
    c.add_argument("paths", nargs="+")
    c.add_argument("--reset", action="store_true")
    c.add_argument("--tag", action="append", dest="tags")
    c.add_argument("--prefix", default="")
    c.add_argument("--embedder")
    c.add_argument("--chunk-size", type=between(50), default=800)
    c.add_argument("--overlap", type=between(0), default=150)
    c = sub.add_parser("remove")
    c.add_argument("paths", nargs="+")
    c = sub.add_parser("stats")
    c.add_argument("--json", action="store_true")
    sub.add_parser("vacuum")
    for name in ("ask", "chat"):
        c = sub.add_parser(name)
        if name == "ask":
            c.add_argument("question", type=question)
        c.add_argument("-k", type=between(1, 100), default=5)
        c.add_argument("--mode", choices=MODES, default="hybrid")
        c.add_argument("--rerank", choices=("none", *RERANKERS), default="none")
        c.add_argument("--source", action="append", default=[])
        c.add_argument("--tag", action="append", default=[])
        c.add_argument("--multi-query", action="store_true")
        c.add_argument("--no-llm", action="store_true", help="leave the language model alone: extractive answers, words carried over")
        c.add_argument("--json", action="store_true")
    c = sub.add_parser("eval")
    c.add_argument("--questions", required=True)
    c.add_argument("--k", type=cutoffs, default=[1, 3, 5])
    c.add_argument("--modes", default=",".join(DEFAULT_MODES))
    c.add_argument("--judge", action="store_true")
    c.add_argument("--no-llm", action="store_true", help="extractive answers and heuristic verdicts")
    c.add_argument("--json", action="store_true")
    c = sub.add_parser("serve")
    c.add_argument("--host", default="127.0.0.1")
    c.add_argument("--port", type=between(0, 65535), default=8000)
    c.add_argument("-k", type=between(1, 20), default=5)
    return p


def options(args: argparse.Namespace) -> dict:
    return {"k": args.k, "mode": args.mode, "rerank": None if args.rerank == "none" else args.rerank, "sources": args.source, "tags": args.tag, "multi": args.multi_query, "llm": not args.no_llm}


def run(args: argparse.Namespace, spark=None) -> int:
    from pyspark.sql import functions as F

    from lodestone.backends import ChatBackend
    from lodestone.engine import Engine, to_json
    from lodestone.session import local_session
    from lodestone.sources.loaders import read_questions

    spark = spark or local_session("*")
    backend = None if getattr(args, "no_llm", False) else ChatBackend.from_environment()
    engine = Engine.with_backend(spark, args.index, backend, getattr(args, "embedder", None) if not getattr(args, "reset", False) else None)
    if args.command == "ingest":
        if args.reset:
            engine.reset()
            engine = Engine(spark, args.index, args.embedder)
        done = 0
        for path in args.paths:
            r = engine.ingest_path(path, prefix=args.prefix, tags=args.tags, max_chars=args.chunk_size, overlap=args.overlap, prune=os.path.isdir(path))
            n = r.counts
            done += n["added"] + n["updated"] + n["unchanged"]
            print(f"{path}: {n['added']} added, {n['updated']} updated, {n['unchanged']} unchanged, {n['removed']} removed, {r.chunks} chunks")
            for source, owner in r.conflicts.items():
                print(f"skip {source}: it belongs to {owner}", file=sys.stderr)
            for bad in r.unreadable.toLocalIterator() if r.unreadable is not None else ():
                print(f"warning: {bad['source']} could not be read: {bad['error']}", file=sys.stderr)
        return 0 if done else 1
    if args.command == "remove":
        gone = 0
        for row in engine.remove(args.paths).orderBy("source").toLocalIterator():
            print(row["source"])
            gone += 1
        if not gone:
            print("nothing matched")
        return 0 if gone else 1
    if args.command == "vacuum":
        before, after = engine.vacuum()
        print(f"{before} -> {after} bytes")
        return 0
    if args.command == "stats":
        rows = engine.stats()
        if args.json:
            print(to_json(rows.collect()))
        else:
            rows.show(1000, truncate=False)
        return 0 if not rows.isEmpty() else 1
    if not engine.store.manifest()["records"]:
        raise ValueError(f"the index at {args.index} is empty; ingest something first")
    if args.command == "ask":
        got = engine.ask(args.question, **options(args))
        print(to_json(got) if args.json else show(got))
        return 0 if got["sources"] else 1
    if args.command == "chat":
        history: list[str] = []
        for line in sys.stdin:
            said = line.strip()
            if said in ("/quit", "/exit"):
                break
            if said == "/reset":
                history = []
            elif said:
                got = engine.ask(said, history[-10:], **options(args))
                print(to_json(got) if args.json else show(got), flush=True)
                history.append(said)
        return 0
    if args.command == "eval":
        rows = read_questions(spark, args.questions).withColumn("qid", F.monotonically_increasing_id())
        modes = args.modes.split(",")
        report = engine.evaluate(rows, args.k, modes)
        answers = engine.evaluate_answers(rows, modes[0])
        if args.json:
            print(to_json({"retrieval": [r.asDict() for r in report.collect()], "answers": answers.first().asDict()}))
        else:
            report.show(truncate=False)
            answers.show(truncate=False)
        if args.judge:
            from lodestone.operators.evaluate import judge_summary

            judge_summary(engine.judge(rows, modes[0], backend=backend and backend.judge)).show(truncate=False)
        return 0
    from lodestone.server import serve

    serve(engine, args.host, args.port, args.k)
    return 0


def show(got: dict) -> str:
    lines = [got["answer"], ""] + [f"[{s['n']}] {s['source']} {s['heading']} ({s['score']})" for s in got["sources"]]
    return "\n".join(([f"note: {got['warning']}"] if got.get("warning") else []) + lines)


def main(argv: list[str] | None = None, spark=None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        return run(args, spark)
    except (ValueError, OSError) as e:
        print(f"error: {str(e).splitlines()[0]}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
