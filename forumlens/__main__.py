"""Command line: python -m forumlens {stats,export,run,status,query,check,scope} --root STORE."""

from __future__ import annotations

import argparse
from datetime import datetime

from pyspark.sql import functions as F

from .operators.upkeep import group_stats
from .plans.stages import Pipeline
from .session import get_session
from .sources.ingest import Scope, TimeFrame, checks
from .sources.readers import Store
from .sources.sinks import export_store


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="forumlens")
    parser.add_argument("command", choices=["stats", "export", "run", "status", "query", "check", "scope"])
    parser.add_argument("--root", required=True, help="folder of the store, or of the tables for `query`")
    parser.add_argument("--out", help="folder to export to")
    parser.add_argument("--step", type=int, action="append", help="steps to run; all by default")
    parser.add_argument("--name", help="name of the query")
    parser.add_argument("--start", help="first day of a back-fill, for `scope`")
    parser.add_argument("--end", help="day after its last")
    parser.add_argument("--groups", default="", help="its groups, separated by commas")
    parser.add_argument("--posts", type=int, default=100, help="its posts a group")
    parser.add_argument("--chunk-days", type=int, default=7, help="days that are asked for at once")
    args = parser.parse_args(argv)
    if args.command == "scope":  # what a back-fill would take; nothing is pulled
        try:
            scope = Scope.of(TimeFrame.parse(args.start or "", args.end or ""), len([g for g in args.groups.split(",") if g.strip()]), args.posts, args.chunk_days)
        except ValueError as error:
            parser.error(str(error))
        print(f"{scope.chunks} chunks, about {scope.requests:.0f} requests, about {scope.minutes:.1f} minutes")
        return 0
    spark = get_session()
    store = Store(spark, args.root)
    if args.command == "stats":
        for table in ("posts", "comments"):
            print(table, store.read(table).count())
        group_stats(store.read("posts")).orderBy(F.desc("post_count")).show(50, truncate=False)
    elif args.command == "export":
        print(export_store(store, args.out))
    elif args.command == "check":
        found = checks(spark, store)
        for name, state in found.items():
            print(name, state)
        return int(any(state != "ok" for state in found.values()))
    elif args.command == "status":
        for row in Pipeline(store, datetime.now()).status():
            print(row["step"], row["state"])
    elif args.command == "query":
        from .plans import discovery, overview, stored  # noqa: F401 (register queries)
        from .plans.catalogue import QUERIES

        QUERIES[args.name](spark, args.root).show(50, truncate=False)
    else:
        failed = False
        for line in Pipeline(store, datetime.now()).run(args.step):
            print(line, flush=True)
            failed = " failed: " in line
        return int(failed)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
