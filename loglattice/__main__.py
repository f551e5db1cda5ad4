"""Verbs of an operator: python -m loglattice query|templates|erase|backfill|compact|sweep STORE TENANT [...]."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import SparkSession

from loglattice.operators.engine import Engine
from loglattice.sources.store import LogStore, graph_tuples


def run(args: argparse.Namespace, spark: SparkSession) -> dict:
    store = LogStore(spark, args.store)
    if args.verb == "query":
        return Engine(store).answer(args.tenant, args.statement)
    if args.verb == "templates":
        return Engine(store).list_templates(args.tenant)
    if args.verb == "erase":
        for c in args.conversation:
            store.request_erasure(args.tenant, c)
        return {"requested": args.conversation, "erased": store.erase(args.tenant, args.column) if args.now else {}}
    if args.verb == "backfill":
        made = store.backfill(args.tenant, lambda df: store.append_tuples(args.tenant, graph_tuples(df)))
        return {"partitions": len(made)}
    if args.verb == "compact":
        return {"partitions": store.compact(args.tenant, time.time_ns())}
    return {t: {"compacted": n, "erased": e} for t, (n, e) in store.sweep([args.tenant], time.time_ns(), args.column).items()}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loglattice")
    verbs = p.add_subparsers(dest="verb", required=True)
    for verb in ("query", "templates", "erase", "backfill", "compact", "sweep"):
        v = verbs.add_parser(verb)
        v.add_argument("store")
        v.add_argument("tenant")
        if verb == "query":
            v.add_argument("statement")
        if verb in ("erase", "sweep"):
            v.add_argument("--column", default="conversation_id")
        if verb == "erase":
            v.add_argument("conversation", nargs="+")
            v.add_argument("--now", action="store_true", help="erase at once instead of with the next sweep")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    print(json.dumps(run(args, spark or SparkSession.builder.getOrCreate()), default=str))


if __name__ == "__main__":
    main()
