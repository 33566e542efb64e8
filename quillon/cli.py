"""Command lines: `python -m quillon.cli rank ...` and `python -m quillon.cli scan ...`."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from .operators import importance, scan
from .session import session
from .sources import files


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quillon")
    commands = parser.add_subparsers(dest="command", required=True)
    rank = commands.add_parser("rank", help="features ranked by an ensemble of gated networks")
    rank.add_argument("table")
    rank.add_argument("label")
    rank.add_argument("--columns", nargs="+", required=True)
    rank.add_argument("--runs", type=int, default=20)
    rank.add_argument("--l1", type=float, default=0.5)
    rank.add_argument("--epochs", type=int, default=60)
    rank.add_argument("--out", required=True)
    driven = commands.add_parser("scan", help="channels scored by what the rest of the system adds")
    driven.add_argument("table")
    driven.add_argument("--time")
    driven.add_argument("--dimension", type=int, default=3)
    driven.add_argument("--degree", type=int, default=3)
    driven.add_argument("--no-difference", action="store_true")
    driven.add_argument("--out", required=True)
    args = parser.parse_args(argv)
    spark = session("quillon")
    if args.command == "rank":
        rows = spark.read.csv(args.table, header=True, inferSchema=True)
        runs = importance.run_gates(rows, args.columns, args.label, args.runs, l1=args.l1, epochs=args.epochs)
        files.write_report(importance.summarise(runs), args.out, [F.desc("importance")])
    else:
        config = scan.ScanConfig(dimension=args.dimension, degree=args.degree, difference=not args.no_difference)
        result, _, gates = scan.scan(files.read_matrix(spark, args.table, args.time), config)
        files.write_report(result, args.out, [F.desc("excess")])
        gates.show(truncate=False)


if __name__ == "__main__":
    main()
