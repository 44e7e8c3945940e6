"""``python -m strandbase callgraph|compare|extract|match|permissions|manifest ...``; see ``--help`` of each."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from strandbase import commands
from strandbase.functions.filters import InvalidPattern


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandbase")
    sub = p.add_subparsers(dest="command", required=True)
    made = {name: sub.add_parser(name) for name in ("callgraph", "compare", "extract", "match", "permissions", "manifest")}
    made["callgraph"].add_argument("paths", nargs="+")
    for name in ("compare", "extract", "match", "permissions"):
        made[name].add_argument("old")
    for name in ("compare", "extract", "match"):
        made[name].add_argument("new")
    made["permissions"].add_argument("new", nargs="?")
    made["extract"].add_argument("out")
    for name in ("callgraph", "compare", "extract", "match"):
        made[name].add_argument("-f", "--filterclass", action="append", default=[])
    made["extract"].add_argument("-s", "--filtersmali", action="append", default=[])
    m = made["match"]
    m.add_argument("-t", "--threshold", type=float, default=0.8)
    m.add_argument("--change-threshold", type=float, default=0.0)
    m.add_argument("--wl-iterations", type=int, default=3)
    m.add_argument("--csv", action="store_true")
    m.add_argument("-d", "--show-details", action="store_true")
    m.add_argument("--node-matching", action="store_true")
    made["manifest"].add_argument("path")
    made["manifest"].add_argument("format", nargs="?", default="printed", choices=["json", "printed", "yaml", "xml"])
    return p


def _print(lines: DataFrame) -> None:
    for row in lines.toLocalIterator():
        print(row["line"])


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.command == "callgraph":
        _print(commands.callgraph(spark, a.paths, a.filterclass))
    elif a.command == "compare":
        _print(commands.compare(spark, a.old, a.new, a.filterclass))
    elif a.command == "extract":
        commands.extract(spark, a.old, a.new, a.out, a.filterclass, a.filtersmali)
    elif a.command == "match":
        first, *rest = commands.match(spark, a.old, a.new, a.threshold, a.change_threshold, a.wl_iterations, a.csv, a.show_details, a.filterclass, a.node_matching)
        _print(first)
        for df in rest:
            if not a.csv:
                print()
            _print(df)
    elif a.command == "permissions":
        _print(commands.permission_changes(spark, a.old, a.new) if a.new else commands.permission_list(spark, a.old))
    else:
        print(commands.show_manifest(spark, a.path, a.format), end="" if a.format == "printed" else "\n")


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("strandbase").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        run(spark, a)
    except (commands.ArchiveError, InvalidPattern) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
