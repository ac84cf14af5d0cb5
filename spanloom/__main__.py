"""Command line: python -m spanloom COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from spanloom.api import Lineage
from spanloom.operators.report import gate_failed
from spanloom.sources.events import read_written


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="spanloom")
    top.add_argument("--store", help="folder of the store")
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("hook", help="capture JSON events, one to a line, from standard input or a path").add_argument("path", nargs="?")
    commands.add_parser("status")
    commands.add_parser("sources").add_argument("session", nargs="?")
    for name in ("audit", "attribute"):
        commands.add_parser(name).add_argument("file")
    gate = commands.add_parser("gate")
    gate.add_argument("files", nargs="+")
    gate.add_argument("--max-ungrounded", type=float, default=30.0)
    export = commands.add_parser("export")
    export.add_argument("file")
    export.add_argument("-o", "--out")
    commands.add_parser("verify").add_argument("file")
    why = commands.add_parser("why")
    why.add_argument("file")
    why.add_argument("line", type=int)
    cite = commands.add_parser("cite")
    cite.add_argument("file")
    cite.add_argument("start", type=int)
    cite.add_argument("end", type=int)
    cite.add_argument("source")
    cite.add_argument("evidence", nargs="?")
    commands.add_parser("reset")
    return top


def run(lineage: Lineage, args: argparse.Namespace) -> int:
    """1 if a gate fails or an attestation is not valid; 0 otherwise, also for unknown files."""
    match args.command:
        case "hook":
            given = args.path
            if given is None:  # events of this machine: a write is as its file stands now
                lines = read_written([x for x in sys.stdin.read().splitlines() if x.strip()])
                rows = [(*r, k) for k, r in enumerate(lines)]
                given = lineage.spark.createDataFrame(rows, "raw string, resolved_content string, seq bigint")
            print(json.dumps(lineage.capture(given)))
        case "status":
            print(json.dumps(lineage.status()))
        case "sources":
            for r in lineage.sources(args.session, 60).toLocalIterator():
                print(f"{r['id']} {r['type']} {r['uri']} {r['preview']}")
        case "audit" | "attribute":
            print(lineage.audit(args.file) or f"{args.file}: not captured")
        case "gate":
            verdicts = lineage.gate(args.files, args.max_ungrounded)
            for r in verdicts.collect():  # one row for each named file
                print(f"{'FAIL' if r['failed'] else 'ok'} {r['path']}: {r['ungrounded']} of {r['spans']} ungrounded ({r['ungrounded_pct']:.0f} %)")
            return int(gate_failed(verdicts))
        case "export":
            signed = lineage.export(args.file, args.out)
            print(f"{args.file}: not captured" if signed is None else f"wrote {args.out}" if args.out else json.dumps(signed, indent=2))
        case "verify":
            valid = lineage.verify(args.file)
            print("valid" if valid else "not valid")
            return int(not valid)
        case "why":
            print(lineage.why_text(args.file, args.line))
        case "cite":
            print(json.dumps(lineage.cite(args.file, args.start, args.end, args.source, args.evidence)))
        case "reset":
            lineage.reset()
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("spanloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return run(Lineage(spark, args.store), args)


if __name__ == "__main__":
    sys.exit(main())
