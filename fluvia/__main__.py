"""python -m fluvia list | run NAME TABLES OUT: run a named query over a folder of tables and write it as Parquet."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from fluvia.plans import catalog


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="fluvia", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the queries")
    run = commands.add_parser("run", help="run a query")
    run.add_argument("name", choices=sorted(catalog.QUERIES))
    run.add_argument("tables")
    run.add_argument("out")
    run.add_argument("--overwrite", action="store_true")
    args = parser.parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(catalog.QUERIES)))
        return 0
    spark = SparkSession.builder.appName(f"fluvia-{args.name}").getOrCreate()
    catalog.QUERIES[args.name](spark, args.tables).write.mode("overwrite" if args.overwrite else "error").parquet(args.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
