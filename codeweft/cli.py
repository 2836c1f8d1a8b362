"""Command line: index, map, context and serve."""

from __future__ import annotations

import argparse
import sys
from threading import Event

from . import pipeline, tools
from .operators import pack
from .session import local_session
from .streaming import watch


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="codeweft")
    parser.add_argument("--path", default=".", help="repository to read")
    parser.add_argument("--cache", help="cache table; by default .codeweft/cache below the repository")
    verbs = parser.add_subparsers(dest="verb", required=True)
    verbs.add_parser("index").add_argument("--force", action="store_true", help="ignore the cache")
    verbs.add_parser("map")
    context = verbs.add_parser("context")
    context.add_argument("task")
    context.add_argument("--budget", type=int, default=pack.BUDGET)
    verbs.add_parser("serve").add_argument("--watch", action="store_true", help="index again after changes of files")
    args = parser.parse_args(argv)

    spark = local_session()
    cache = args.cache or f"{args.path}/.codeweft/cache"
    index, counters = pipeline.index(spark, args.path, cache, getattr(args, "force", False))
    if args.verb == "index":
        print(" ".join(f"{k}={v}" for k, v in counters.items()))
    elif args.verb == "map":
        print(index.get_repo_map())
        for r in index.nodes.where("symbol is not null").orderBy("id").limit(25).collect():
            print(f"- {r.id}")
    elif args.verb == "context":
        print(index.get_context_for_task(args.task, args.budget))
    else:
        stop = Event()
        held = pipeline.Live(spark, args.path, cache, index)
        stream = watch.follow(spark, args.path, f"{cache}.watch", held.renew, stop) if args.watch else None
        for reply in tools.serve(held, sys.stdin):
            print(reply, flush=True)
        stop.set()
        if stream:
            stream.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
