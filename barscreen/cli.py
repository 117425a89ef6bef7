"""Command line: backfill, update, status, corpactions, adjust, indicators, compact, serve, screen, backtest, daily, position."""

from __future__ import annotations

import argparse
import dataclasses
import datetime as dt
import logging
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from barscreen.config import Config, load
from barscreen.operators.portfolio import distribution, exit_breakdown, rolling_returns, yearly_returns
from barscreen.plans import backtest, daily, report
from barscreen.sources.fetch import Fetcher
from barscreen.sources.store import Store

ROLLING = (30, 90, 365, 1095)


def parser() -> argparse.ArgumentParser:
    """The subcommands, their flags and defaults, by which callers know this command line."""
    day = dt.date.fromisoformat
    p = argparse.ArgumentParser(prog="barscreen", description=__doc__)
    p.add_argument("--config")
    p.add_argument("--root", help="folder of the stored tables, in place of the configured one")
    sub = p.add_subparsers(dest="command", required=True)
    dated = {}
    for name in ("backfill", "update", "daily", "corpactions"):
        dated[name] = sub.add_parser(name)
        dated[name].add_argument("--from", dest="start", type=day)
        dated[name].add_argument("--to", dest="end", type=day)
        if name != "corpactions":
            dated[name].add_argument("--limit", type=int)
            dated[name].add_argument("--max-consecutive-failures", type=int, default=5)
    dated["daily"].add_argument("--preset")
    dated["daily"].add_argument("--ca-lookback-days", type=int, default=45)
    dated["daily"].add_argument("--compact-above-mb", type=float, default=900.0)
    for name in ("status", "adjust", "indicators", "compact"):
        sub.add_parser(name)
    serve = sub.add_parser("serve")
    serve.add_argument("--host", default="127.0.0.1")
    serve.add_argument("--port", type=int, default=8787)
    screen = sub.add_parser("screen")
    screen.add_argument("--preset")
    screen.add_argument("--date", type=day)
    back = sub.add_parser("backtest")
    back.add_argument("--preset", dest="presets", action="append")
    for name in ("--start", "--end", "--split"):
        back.add_argument(name, type=day)
    back.add_argument("--by-year", action="store_true")
    held = sub.add_parser("position")
    held.add_argument("action", choices=("add", "close", "list"))
    held.add_argument("--symbol", default="")
    held.add_argument("--price", type=float)
    held.add_argument("--quantity", type=int, default=0)
    held.add_argument("--date", type=day)
    held.add_argument("--id", type=int)
    held.add_argument("--reason", default="manual")
    return p


def status(store: Store) -> None:
    for title, found in (("bars", report.summary(store.prices())), ("sessions", report.counts_by(store.table("ingest_log"), "status")), ("actions", report.counts_by(store.table("corporate_actions"), "verification", "action_type")), ("failures", report.recent_failures(store.table("ingest_log"))), ("duplicates", report.duplicate_rows(store.prices()))):
        print(f"{title}\n{daily.rendered(found)}")
    print(f"stored: {store.bytes_of('') / 1e6:.1f} MB")


def backtests(store: Store, config: Config, args: argparse.Namespace) -> None:
    indicators, shut = store.table("indicators"), store.table("quarantine")
    for name in args.presets or [None]:
        preset = config.preset(name)
        runs = backtest.walk_forward(indicators, shut, preset, config, args.split) if args.split else {"all": backtest.run(indicators, shut, preset, config, args.start, args.end)}
        for part, result in runs.items():
            print(f"{preset.name}, {part}\n{daily.rendered(result.stats, {'trades': 0})}\nwithout costs\n{daily.rendered(result.stats_gross)}\n{daily.rendered(exit_breakdown(result.trades))}")
            print(f"costs took {result.cost_drag_on_return()} of the return")
            if args.by_year:
                print(daily.rendered(yearly_returns(result.curve).orderBy("year"), {"return": 4, "max_drawdown": 4}))
                for days in ROLLING:
                    print(f"any {days} days\n{daily.rendered(distribution(rolling_returns(result.curve, days)))}")


def positions(store: Store, args: argparse.Namespace) -> int:
    today = args.date or dt.date.today()
    if args.action == "add":
        if not args.symbol or not args.price or args.quantity <= 0:
            print("a symbol, a price and a quantity are needed", file=sys.stderr)
            return 2
        print(store.add_position(args.symbol.upper(), today, args.price, args.quantity))
    elif args.action == "close":
        if args.id is None or args.price is None:
            print("an id and a price are needed", file=sys.stderr)
            return 2
        return 0 if store.close_position(args.id, today, args.price, args.reason, again=True) else 1
    else:
        print(daily.rendered(report.open_first(store.table("positions"))))
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO)
    config = load(args.config)
    config = dataclasses.replace(config, ingest=dataclasses.replace(config.ingest, root=args.root)) if args.root else config
    spark = spark or SparkSession.builder.appName("barscreen").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store, fetcher = Store(spark, config.ingest.root), Fetcher(config.ingest)
    match args.command:
        case "backfill" | "update":
            tally = daily.fill_gaps(store, config, fetcher, args.start or config.ingest.history_start, args.end or dt.date.today(), args.limit, args.max_consecutive_failures)
            print(tally)
            return 1 if tally.failed else 0
        case "corpactions":
            daily.take_in_actions(store, config, fetcher, args.start or config.ingest.history_start, args.end or dt.date.today())
        case "adjust":
            print(store.adjust(config.actions))
        case "indicators":
            print(store.rebuild_indicators(config.indicators))
        case "compact":
            print("%d bytes before, %d after" % store.compact())
        case "status":
            status(store)
        case "serve":
            from barscreen import web

            web.serve(store, config, args.host, args.port)
        case "screen":
            day, basket, _ = daily.outputs(store, config, args.preset, args.date)
            print(f"{day}\n{daily.rendered(basket)}")
        case "backtest":
            backtests(store, config, args)
        case "position":
            return positions(store, args)
        case "daily":
            return daily.daily(store, config, fetcher, args.start, args.end, args.preset, args.ca_lookback_days, args.compact_above_mb, args.limit, args.max_consecutive_failures)
    return 0


if __name__ == "__main__":
    sys.exit(main())
