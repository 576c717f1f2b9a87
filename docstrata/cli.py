"""python -m docstrata.cli LAKE COMMAND …: the steps of a lake from the command line, each prints JSON lines."""

from __future__ import annotations

import argparse
import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.operators.chunking import Chunking
from docstrata.plans.pipeline import MODES, Pipeline
from docstrata.session import get_session
from docstrata.sources.lake import Lake, latest_report
from docstrata.sources.listings import questions


def records(spark, path: str) -> DataFrame:
    """Listed records with their bytes from Parquet; columns that are not there are null."""
    found = spark.read.parquet(path)
    names = "source source_id title url published_at registered_at extension record_number record_type docket content_type extra_json".split()
    missing = {n: F.lit(None).cast("string") for n in names if n not in found.columns}
    if "size_hint" not in found.columns:
        missing["size_hint"] = F.lit(None).cast("long")
    return found.withColumns(missing)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="docstrata")
    p.add_argument("lake")
    p.add_argument("--run-id", default=None)
    p.add_argument("--chunking", type=json.loads, default={}, help="fields of a chunk version as JSON")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("ingest", "run"):
        sub.add_parser(name).add_argument("listed", help="Parquet of listed records with their bytes")
    for name in ("silver", "rechunk", "gate", "gold", "versions", "health", "watermark", "status", "validation", "quarantine"):
        sub.add_parser(name)
    watch = sub.add_parser("watch")
    watch.add_argument("listed", help="Parquet that listed records are added to")
    watch.add_argument("--every", type=float, default=900.0, help="seconds between polls")
    watch.add_argument("--once", action="store_true")
    golden = sub.add_parser("eval")
    golden.add_argument("questions", help="golden questions as JSON lines")
    golden.add_argument("--name", default="dev")
    golden.add_argument("--mode", choices=sorted(MODES), default="rerank")
    found = sub.add_parser("documents")
    found.add_argument("contains", nargs="?", default="")
    found.add_argument("--limit", type=int, default=100)
    sub.add_parser("activate").add_argument("version")
    ask = sub.add_parser("ask")
    ask.add_argument("question")
    ask.add_argument("--filter", type=json.loads, default={})
    ask.add_argument("--mode", choices=sorted(MODES), default="rerank")
    ask.add_argument("--fresh", action="store_true", help="no answer from the cache")
    sql = sub.add_parser("sql")
    sql.add_argument("text")
    sql.add_argument("tables", nargs="+")
    return p


def main(argv: list[str] | None = None, spark=None) -> list[dict]:
    """Run a command and print all its rows, one at a time; the rows are returned too."""
    args = parser().parse_args(argv)
    now = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    run_id = args.run_id or f"run-{now}"
    lake = Lake(spark or get_session(), args.lake)
    p = Pipeline(lake, chunking=Chunking(**args.chunking))
    steps = {
        "ingest": lambda: p.ingest(records(lake.spark, args.listed), run_id, now),
        "run": lambda: p.run(records(lake.spark, args.listed), run_id, now),
        "silver": lambda: p.silver(run_id, now),
        "rechunk": lambda: {"chunks": p.rechunk(run_id, now)},
        "gate": lambda: {"gate": p.gate() or "passed"},
        "gold": lambda: {"indexed": p.gold(run_id, now)},
        "versions": p.versions,
        "health": p.health,
        "watermark": p.watermark,
        "activate": lambda: p.activate(args.version, now) or p.versions(),
        "ask": lambda: p.answer(lake.spark.createDataFrame([(1, args.question)], "query_id long, qtext string"), now, args.mode, use_cache=not args.fresh, **args.filter),
        "status": p.status,
        "validation": lambda: latest_report(lake.read("bronze/reports")),
        "quarantine": p.quarantine,
        "documents": lambda: p.documents(args.contains, args.limit),
        "watch": lambda: {"polls": p.watch(lambda: records(lake.spark, args.listed), args.every, args.once)},
        "eval": lambda: p.evaluate(questions(lake.spark, args.questions), args.mode, args.name, now),
        "sql": lambda: lake.sql(args.text, args.tables),
    }
    out, rows = steps[args.command](), []
    # rows come one partition at a time
    for row in (json.loads(r) for r in out.toJSON().toLocalIterator()) if isinstance(out, DataFrame) else [out]:
        print(json.dumps(row, ensure_ascii=False, default=str))
        rows.append(row)
    return rows


if __name__ == "__main__":
    main()
