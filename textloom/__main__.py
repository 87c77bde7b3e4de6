"""``python -m textloom queries`` lists the queries; ``python -m textloom run NAME TABLES OUT`` writes one's result as Parquet."""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="textloom")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("queries", help="list the queries")
    run = commands.add_parser("run", help="write a query's result as Parquet")
    run.add_argument("name")
    run.add_argument("tables", help="directory of the tables")
    run.add_argument("out")
    run.add_argument("--master", default=None)
    args = parser.parse_args(argv)
    from textloom.plans.queries import QUERIES

    if args.command == "queries":
        print("\n".join(sorted(QUERIES)))
        return 0
    if args.name not in QUERIES:
        print(f"no query {args.name!r}", file=sys.stderr)
        return 2
    from textloom.session import build_session

    QUERIES[args.name](build_session(master=args.master), args.tables).write.mode("overwrite").parquet(args.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
