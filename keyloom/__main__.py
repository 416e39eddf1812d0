"""Command line: ``python -m keyloom list`` and ``python -m keyloom run QUERY --data DIR [--to PATH --format parquet|json|csv] [--rows N]``."""

from __future__ import annotations

import argparse
import sys

from . import session
from .plans import ORACLES, QUERIES


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="keyloom", description="Registered queries over a directory of Parquet tables.")
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries")
    shown = commands.add_parser("sql", help="the SQL that gives a query's rows")
    shown.add_argument("query", choices=sorted(ORACLES), metavar="QUERY")
    run = commands.add_parser("run", help="run a query and print or write its rows")
    run.add_argument("query", choices=sorted(QUERIES), metavar="QUERY")
    run.add_argument("--data", required=True, help="directory of the tables")
    run.add_argument("--to", help="where to write; without it rows are printed")
    run.add_argument("--format", choices=("parquet", "json", "csv"), default="parquet")
    run.add_argument("--rows", type=int, default=20, help="rows to print")
    run.add_argument("--cpus", type=int)
    return top


def main(arguments: list[str] | None = None) -> int:
    args = parser().parse_args(arguments)
    if args.command == "list":
        print("\n".join(sorted(QUERIES)))
    elif args.command == "sql":
        print(ORACLES[args.query])
    else:
        df = QUERIES[args.query](session.local(args.cpus), args.data)
        if args.to:
            df.write.mode("error").format(args.format).save(args.to)
        else:
            df.show(args.rows, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
