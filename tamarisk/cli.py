"""Command line: todo, annotate, kappa, and the freeze commands."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tamarisk.functions.text import render
from tamarisk.operators import annotation, freeze
from tamarisk.sources.log import AnnotationLog, RESPONSE, read_items

KEYS = {"a": "applicant", "n": "non_applicant", "u": "unclear"}


def _log(spark: SparkSession, path: str):
    return AnnotationLog(spark, path).responses() if Path(path).exists() else spark.createDataFrame([], RESPONSE)


def annotate(spark: SparkSession, args: argparse.Namespace) -> int:
    """Ask for the label of each open item; answers are appended at once."""
    rows = _log(spark, args.log)
    items = annotation.todo(read_items(spark, args.items), rows, args.annotator).orderBy("item_id")
    seq = rows.agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]
    for r in items.select("item_id", render(F.col("sentence"), F.col("cue_start"), F.col("cue_end")).alias("text")).toLocalIterator():
        print(f"\n{r.text}\n(a)pplicant (n)on_applicant (u)nclear (s)kip (q)uit")
        said = (sys.stdin.readline() or "q").strip().lower()
        if said == "q":
            break
        if said in KEYS:
            seq += 1
            row = [(seq, r.item_id, args.annotator, KEYS[said], datetime.now(UTC).isoformat(timespec="seconds"), None)]
            AnnotationLog(spark, args.log).append(spark.createDataFrame(row, RESPONSE))
    return 0


def kappa(spark: SparkSession, args: argparse.Namespace) -> int:
    """Print the pair's agreement; exit code 1 below the gate, 2 without common items."""
    rows = annotation.answers(_log(spark, args.log)).where(F.col("annotator_id").isin(args.a, args.b))
    found = annotation.gate_status(annotation.kappa_pairs(rows)).collect()
    if not found:
        print("no item was answered by both", file=sys.stderr)
        return 2
    print(json.dumps(found[0].asDict(), sort_keys=True))
    return 0 if found[0].gate_status == "usable" else 1


def _manifest(path: str) -> freeze.Manifest:
    data = json.loads(Path(path).read_text())
    return freeze.Manifest(tuple(data["sources"]), data["lockfile"], data.get("config", {}), data.get("corpus_checksums", {}), data.get("model_pins", {}))


def freeze_(spark: SparkSession, args: argparse.Namespace) -> int:
    """manifest: list the components; compute: print the hash; verify: compare it."""
    parts = freeze.components(spark, _manifest(args.manifest), lambda p: Path(args.root, p).read_bytes())
    if args.action == "manifest":
        for r in parts.orderBy("name").collect():
            print(f"{r.digest}  {r.name}")
        return 0
    if args.action == "compute":
        print(freeze.freeze_hash(parts).first()[0])
        return 0
    try:
        freeze.verify(parts, args.hash or "")
    except freeze.FreezeMismatch as e:
        print(e, file=sys.stderr)
        return 1
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tamarisk")
    commands = parser.add_subparsers(required=True)
    p = commands.add_parser("annotate")
    p.add_argument("--items", required=True)
    p.add_argument("--log", required=True)
    p.add_argument("--annotator", required=True)
    p.set_defaults(run=annotate)
    p = commands.add_parser("kappa")
    p.add_argument("--log", required=True)
    p.add_argument("a")
    p.add_argument("b")
    p.set_defaults(run=kappa)
    p = commands.add_parser("freeze")
    p.add_argument("action", choices=("manifest", "compute", "verify"))
    p.add_argument("--manifest", required=True)
    p.add_argument("--root", default=".")
    p.add_argument("--hash")
    p.set_defaults(run=freeze_)
    args = parser.parse_args(argv)
    return args.run(spark or SparkSession.builder.appName("tamarisk").getOrCreate(), args)


if __name__ == "__main__":
    sys.exit(main())
