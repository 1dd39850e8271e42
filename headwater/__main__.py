"""python -m headwater COMMAND: analyze, review, upstream, downstream, impact, search, summary."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from .operators import traverse
from .plans.build import Repository, build, read_json, repositories, write_json
from .plans.review import report, review


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="headwater", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("analyze", "review"):
        c = sub.add_parser(name)
        c.add_argument("--repo", action="append", default=[], help="NAME=PATH; else the JSON list in REPOS")
        c.add_argument("--out", help="a folder (analyze) or a file (review)")
        if name == "review":
            c.add_argument("--root", default=".")
            c.add_argument("--base", default="origin/main")
            c.add_argument("--head", default="HEAD")
            c.add_argument("--json", action="store_true")
    for name in ("upstream", "downstream", "impact", "search", "summary"):
        c = sub.add_parser(name)
        c.add_argument("graph", help="what analyze wrote, or one JSON document")
        if name != "summary":
            c.add_argument("what")
        if name in ("upstream", "downstream"):
            c.add_argument("--depth", type=int, default=traverse.DEFAULT_DEPTH)
        if name == "summary":
            c.add_argument("--type")
            c.add_argument("--below", type=float)
    return p


def printed(rows: DataFrame) -> None:
    """All rows, partition by partition, tab-separated."""
    print(*rows.columns, sep="\t")
    for x in rows.toLocalIterator():
        print(*x, sep="\t")


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("headwater").getOrCreate()
    if args.command in ("analyze", "review"):
        repos = [Repository(*r.split("=", 1)) for r in args.repo] or repositories()
        if args.command == "analyze":
            graph = build(spark, repos)
            if args.out:
                write_json(graph, args.out)
            traverse.counts(graph).orderBy("kind", "value").show(100, False)
            return 0
        found = review(spark, args.root, repos, args.base, args.head)
        text = json.dumps(found.as_dict(), default=str, indent=1) + "\n" if args.json else report(found)
        if args.out:
            with open(args.out, "w", encoding="utf-8") as f:
                f.write(text)
        else:
            sys.stdout.write(text)
        return 0
    graph = read_json(spark, args.graph)
    try:
        if args.command == "search":
            traverse.search(graph.nodes, args.what).show(traverse.SEARCH_LIMIT, False)
        elif args.command == "impact":
            traverse.impact(graph, args.what).show(1, False)
        elif args.command == "summary":
            traverse.counts(graph).orderBy("kind", "value").show(100, False)
            if args.type or args.below is not None:
                printed(traverse.listing(graph, args.type, args.below).orderBy("source_id", "target_id"))
        else:
            out = traverse.walk(graph, args.what, args.command == "downstream", args.depth)
            printed(out.nodes.select("id", "node_type").orderBy("id"))
            printed(out.edges.select("source_id", "edge_type", "target_id", "transformation", "confidence").orderBy("source_id", "target_id"))
    except KeyError as e:
        print(f"no node {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
