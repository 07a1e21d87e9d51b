"""Command line: init, index, status, the graph queries, search, export and serve."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import replace

from pyspark.sql import SparkSession

from .operators.export import dot_rows, json_sections
from .service import Service, ToolError, render, serve
from .settings import load_settings, write_starter_config

QUERIES = {"callers": "symbol", "callees": "symbol", "deps": "module", "dependents": "module", "impact": "symbol", "search": "query"}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="symgraph")
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--root")
    common.add_argument("--config")
    common.add_argument("--index")
    common.add_argument("--json", action="store_true")
    commands = out.add_subparsers(dest="command", required=True)
    commands.add_parser("init", parents=[common])
    index = commands.add_parser("index", parents=[common])
    index.add_argument("--force", action="store_true")
    index.add_argument("--quiet", action="store_true")
    commands.add_parser("status", parents=[common])
    commands.add_parser("serve", parents=[common])
    for name, argument in QUERIES.items():
        query = commands.add_parser(name, parents=[common])
        query.add_argument(argument)
        query.add_argument("--limit", type=int)
        if name == "impact":
            query.add_argument("--depth", type=int, default=3)
    export = commands.add_parser("export", parents=[common])
    export.add_argument("format", choices=["json", "dot"])
    export.add_argument("-o", "--output")
    return out


def exported(service: Service, kind: str) -> str:
    index = service.index()
    if kind == "dot":
        return "\n".join(r["line"] for r in dot_rows(index).orderBy("section", "a", "b", "line").toLocalIterator()) + "\n"
    held = {"meta": {"root": index.root, "last_indexed": index.last_indexed}}
    held |= {name: [json.loads(x) for x in rows.toJSON().toLocalIterator()] for name, rows in json_sections(index).items()}
    return json.dumps(held, ensure_ascii=False, indent=2)


def run(args: argparse.Namespace) -> int:
    if args.command == "init":
        print(write_starter_config(args.root or "."))
        return 0
    settings = load_settings(args.root, args.config)
    settings = replace(settings, index_path=args.index) if args.index else settings
    spark = SparkSession.builder.appName("symgraph").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    service = Service(spark, settings)
    if args.command == "serve":
        serve(service)
        return 0
    if args.command == "export":
        text = exported(service, args.format)
        if args.output:
            with open(args.output, "w", encoding="utf-8") as out:
                out.write(text)
        else:
            print(text)
        return 0
    if args.command == "index":
        value = service.call("reindex", {"force": args.force})
    elif args.command == "status":
        value = service.call("overview")
    else:
        given = {QUERIES[args.command]: getattr(args, QUERIES[args.command]), "limit": args.limit, "depth": getattr(args, "depth", None)}
        value = service.call(args.command, {k: v for k, v in given.items() if v is not None})
    if not getattr(args, "quiet", False):
        print(json.dumps(value, default=str, ensure_ascii=False) if args.json else render(value))
    return 0


def main(argv: list[str] | None = None) -> int:
    try:
        return run(parser().parse_args(argv))
    except KeyboardInterrupt:
        return 130
    except (ToolError, ValueError, OSError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
