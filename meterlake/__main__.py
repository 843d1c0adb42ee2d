"""python -m meterlake COMMAND over folders of logs: import, analyze-cache, audit, audit-external, diagnose; follow
keeps a store up to date, and reprice prices its calls anew."""

import argparse
import datetime
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.operators import audits, cache_window
from meterlake.plans import ingest
from meterlake.schemas import ACCOUNT_STATE, SESSION
from meterlake.session import build
from meterlake.sinks import files
from meterlake.sources import catalogs, exports, kimi, lines
from meterlake.streaming.reconcile import COUNTERS, Reconciler


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="meterlake", description=__doc__)
    p.add_argument("--kimi", help="folder that holds sessions/")
    p.add_argument("--claude", help="folder that holds projects/")
    p.add_argument("--subscription", help="the account's subscription: pro, enterprise or another")
    p.add_argument("--overrides", help="a JSON file of prices")
    of = p.add_subparsers(dest="command", required=True)
    of.add_parser("import", help="totals of an import, as JSON")
    of.add_parser("analyze-cache", help="the cache-inactivity report")
    a = of.add_parser("audit", help="compare with a usage export, as CSV")
    a.add_argument("export")
    a.add_argument("--zone", default="UTC")
    a.add_argument("--layout", choices=["long", "wide"], default="wide")
    a.add_argument("--out", required=True)
    x = of.add_parser("audit-external", help="compare with another tool's report, as JSON")
    x.add_argument("report")
    x.add_argument("--provider", choices=["anthropic", "moonshotai"], default="anthropic")
    for name, text in (("follow", "take up what has changed into a store, and tell the counters"), ("reprice", "price a store's calls anew")):
        o = of.add_parser(name, help=text)
        o.add_argument("--store", required=True)
        if name == "follow":
            o.add_argument("--every", help="go on, at intervals such as '30 seconds'")
            o.add_argument("--checkpoints", help="a folder for the streams that go on")
    d = of.add_parser("diagnose", help="tables about transcripts")
    d.add_argument("what", choices=["sessions", "hourly", "aborts", "replays"])
    d.add_argument("--day", default=str(datetime.datetime.now(datetime.UTC).date()))
    d.add_argument("--until", help="last day, for replays")
    return p


def keep(spark: SparkSession, args: argparse.Namespace, rates: DataFrame, states: DataFrame) -> dict:
    """Works on a store: counters of what was taken up, or totals of what was priced."""
    roots = [r for r in (args.kimi, args.claude) if r]
    made = Reconciler(spark, args.store if ":/" in args.store else f"file://{os.path.abspath(args.store)}", spark.createDataFrame([], SESSION), rates, states)
    if args.command == "reprice":
        return made.reprice(rates)
    before = (made.store.versions() or [0])[-1]
    made.detect(states)
    if args.every:
        if not args.checkpoints:
            raise SystemExit("--every needs --checkpoints")
        streams = [made.start(root, f"{args.checkpoints}/{i}", args.every) for i, root in enumerate(roots)]
        for stream in streams:
            stream.awaitTermination()
    for root in roots:
        made.take(root)
    new = made.batches.where(F.col("version") > before)
    return new.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS]).first().asDict()


def main(given: list[str] | None = None) -> None:
    args = arguments().parse_args(given)
    spark = build()
    rates = catalogs.bundled(spark)
    if args.overrides:
        with open(args.overrides, encoding="utf-8") as f:
            rates = rates.unionByName(catalogs.overrides(spark, f.read(), 1000))
    policy = {"pro": "pro-fable", "enterprise": "enterprise-api"}.get(args.subscription, "subscription-excluded")
    states = spark.createDataFrame([(1, args.subscription, policy, 0)] if args.subscription else [], ACCOUNT_STATE)
    if args.command == "diagnose":
        ingest.diagnose(spark, args.claude, args.what, args.day, states, args.until).show(1000, False)
        return
    if args.command in ("follow", "reprice"):
        print(json.dumps(keep(spark, args, rates, states)))
        return
    ledger = ingest.ledger(spark, rates, states, args.kimi, args.claude)
    if args.command == "import":
        print(files.json_lines(ingest.import_totals(ledger)).first().line)
    elif args.command == "analyze-cache":
        found = kimi.requests(lines.texts(lines.read(spark, args.kimi, "wire.jsonl")))
        calls = kimi.cache_calls(ledger.calls, found)
        print(files.cache_report(cache_window.analyze(calls).first(), cache_window.gap_bands(cache_window.transitions(calls)).collect(), cache_window.sensitivity(calls).collect()))
    elif args.command == "audit-external":
        documents = spark.read.text(args.report, wholetext=True).withColumnRenamed("value", "content")
        found = exports.report_models(documents) if args.provider == "anthropic" else exports.report_total(documents).withColumnRenamed("total_usd", "cost_usd")
        print(files.json_lines(audits.external_comparison(found, ledger.calls, args.provider)).first().line)
    else:
        documents = spark.read.text(args.export, wholetext=True).withColumnRenamed("value", "content")
        span = exports.usage_range(documents).first()
        rows = audits.compared(ledger.calls, exports.usage_days(documents), span.start_date, span.end_date, args.zone)
        files.write_csv(audits.wide(rows) if args.layout == "wide" else audits.long(rows), args.out, ["date", "model_key"], one_file=True)


if __name__ == "__main__":
    main()
