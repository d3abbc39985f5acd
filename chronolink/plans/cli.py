"""python -m chronolink.plans.cli run|report|diagnose: the analysis over CSV files."""

from __future__ import annotations

import argparse

from ..operators import diagnostics
from ..schema import normalise_edges
from ..session import local_session
from ..sources.io import load_csv
from .pipeline import Options, run


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="chronolink")
    sub = parser.add_subparsers(dest="command", required=True)
    a = sub.add_parser("run", help="discover edges in a series table")
    a.add_argument("input")
    a.add_argument("output")
    a.add_argument("--methods", default="granger,pcmci,correlation")
    a.add_argument("--tau-max", type=int)
    a.add_argument("--alpha", type=float, default=0.05)
    a.add_argument("--time"), a.add_argument("--id"), a.add_argument("--variable"), a.add_argument("--value")
    for name in ("report", "diagnose"):
        b = sub.add_parser(name, help="summarise a CSV of edges")
        b.add_argument("input")
    args = parser.parse_args(argv)
    spark = local_session()
    if args.command == "run":
        df, meta = load_csv(spark, args.input, args.time, args.id, args.variable, args.value)
        days = meta.first()["sampling_days"]
        out = run(df.drop("ts"), args.output, Options(tau_max=args.tau_max, alpha=args.alpha, sampling_days=days, methods=tuple(args.methods.split(","))))
        out["tiers"].show(truncate=False)
        return 0
    e = normalise_edges(spark.read.option("header", True).option("inferSchema", True).csv(args.input))
    (diagnostics.detection_statistics(e) if args.command == "report" else diagnostics.detection(e)).show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
