"""python -m codestrata analyze PATH | init [PATH] | version | help"""

from __future__ import annotations

import argparse
import os
import sys

from codestrata.operators.gate import INTERNAL, PASS, USAGE

VERSION = "0.1.0"


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="codestrata", description="Structural analytics of a source tree.", exit_on_error=False)
    commands = top.add_subparsers(dest="command")
    run = commands.add_parser("analyze", help="analyse a folder", exit_on_error=False)
    run.add_argument("path", nargs="?", default=".")
    run.add_argument("--config")
    run.add_argument("--format", default="text", choices=("text", "json", "yaml", "mermaid"))
    run.add_argument("--out")
    run.add_argument("-v", "--verbose", action="store_true")
    init = commands.add_parser("init", help="write a configuration template", exit_on_error=False)
    init.add_argument("path", nargs="?", default=".")
    commands.add_parser("version")
    commands.add_parser("help")
    try:
        args = top.parse_args(argv)
    except (argparse.ArgumentError, SystemExit) as problem:
        print(problem, file=sys.stderr)
        return PASS if getattr(problem, "code", None) == 0 else USAGE
    if args.command in (None, "help"):
        top.print_help()
        return PASS if args.command else USAGE
    if args.command == "version":
        print(VERSION)
        return PASS
    from codestrata.plans import config

    if args.command == "init":
        file = os.path.join(args.path, config.CONFIG_NAME)
        if os.path.exists(file):
            print(f"{file} exists", file=sys.stderr)
            return USAGE
        with open(file, "w", encoding="utf-8") as out:
            out.write(config.TEMPLATE)
        return PASS
    if not os.path.exists(args.path):
        print(f"{args.path} does not exist", file=sys.stderr)
        return USAGE
    try:
        cfg = config.load(args.config or config.discover(args.path))
    except config.UsageError as problem:
        print(problem, file=sys.stderr)
        return USAGE
    from pyspark.sql import SparkSession

    from codestrata.plans.analyze import analyze
    from codestrata.plans.report import render

    spark = SparkSession.builder.appName("codestrata").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        report = analyze(spark, args.path, cfg, args.verbose)
        text = render(report, args.format)
        code = report.verdict.first().exit_code
    except Exception as problem:
        print(problem, file=sys.stderr)
        return INTERNAL
    if args.out:
        with open(args.out, "w", encoding="utf-8") as out:
            out.write(text)
    else:
        print(text, end="")
    return code


if __name__ == "__main__":
    sys.exit(main())
