"""The scheduled run: fill gaps, take in actions, recompute, check, report."""

from __future__ import annotations

import datetime as dt
import logging
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barscreen.config import Config
from barscreen.functions import text
from barscreen.plans import report
from barscreen.sources.calendar import weekdays
from barscreen.sources.fetch import Fetched, Fetcher, chunks
from barscreen.sources.files import landed_at, read_actions
from barscreen.sources.store import Store, logged
from barscreen.sources.versions import Files

log = logging.getLogger(__name__)


@dataclass
class Tally:
    stored: int = 0
    rows: int = 0
    holidays: int = 0
    pending: int = 0
    failed: int = 0
    skipped: int = 0


def gap_plan(store: Store, sources: DataFrame, start: dt.date, end: dt.date, today: dt.date, confirm_after_days: int) -> DataFrame:
    """(day, source, absent) of the weekdays from start to end that aren't settled, in a plan of joins.

    sources (priority, source, first_day, last_day; an open end is null): of those that cover a day the first counts, and a
    day without any has a null source. absent: what a missing file means by today, a holiday or not yet.
    """
    settled = store.table("ingest_log").filter("status in ('ok', 'holiday')").select(F.col("trade_date").alias("day"))
    return open_days(weekdays(store.spark, start, end), sources, settled, F.lit(today), confirm_after_days)


def open_days(days: DataFrame, sources: DataFrame, settled: DataFrame, today: Column, confirm_after_days: int) -> DataFrame:
    """The plan of gap_plan over given days (day) and settled ones (day). Sources are a few lines of settings."""
    covers = (F.coalesce("first_day", F.lit("0001-01-01").cast("date")) <= F.col("day")) & (F.col("day") <= F.coalesce("last_day", F.lit("9999-12-31").cast("date")))
    first = F.min(F.when(F.col("source").isNotNull(), F.struct("priority", "source"))).alias("first")
    met = days.join(settled, "day", "left_anti").join(F.broadcast(sources), covers, "left").groupBy("day").agg(first)
    return met.select("day", F.col("first.source").alias("source"), text.conclusively_absent(F.col("day"), today, confirm_after_days).alias("absent"))


def fill_gaps(store: Store, config: Config, fetcher: Fetcher, start: dt.date, end: dt.date, limit: int | None = None, max_consecutive_failures: int = 5, today: dt.date | None = None, batch_days: int = 250) -> Tally:
    """Every weekday from start to end that isn't settled: stored, a holiday, still pending, or failed.

    Files are fetched one after the other and land; each batch of them is then parsed and stored in one job. One bad session
    costs that session only; so many failures in a row stop the run.
    """
    tally, in_a_row = Tally(), 0
    sources = config.ingest.sources_table(store.spark)
    plan = gap_plan(store, sources, start, end, today or dt.date.today(), config.ingest.holiday_confirm_after_days)
    days = [tuple(r) for r in plan.orderBy("day").collect()]
    tally.skipped = weekdays(store.spark, start, end).count() - len(days)
    while days and in_a_row < max_consecutive_failures:
        room = batch_days if limit is None else min(batch_days, limit - tally.stored - tally.holidays)
        if room <= 0:
            break
        now, days = days[:room], days[room:]
        fetched, states, failing = [], {}, 0
        for day, source, absent in now:
            try:
                got = fetcher.fetch(config.ingest.source_named(source).url_for(day)) if source else Fetched("not_found")
                failing = 0
                if got.status == "not_found":
                    states[day] = ("holiday" if absent else "pending", source, None)
                else:
                    fetched.append((store.land(f"{day:%Y%m%d}.csv.zip", got.content).rpartition("/")[2], day, source))
            except Exception as error:  # a server that refuses one file must not end a run over years of them
                states[day] = ("failed", source, f"{type(error).__name__}: {error}")
                failing += 1
                if failing + in_a_row >= max_consecutive_failures:
                    break
        rows = taken(store, config, fetched)
        states |= {day: ("failed", source, problem) for day, source, problem, _ in rows if problem}
        stored = {day: n for day, _, problem, n in rows if not problem}
        store.versions("ingest_log").append([logged(day, status, source, None, None, note, None) for day, (status, source, note) in states.items()])
        for day, _, _ in now:
            status = "ok" if day in stored else states[day][0] if day in states else None
            tally.stored += status == "ok"
            tally.rows += stored.get(day, 0)
            tally.holidays += status == "holiday"
            tally.pending += status == "pending"
            if status == "failed":
                log.error("%s failed: %s", day, states[day][2])
                tally.failed, in_a_row = tally.failed + 1, in_a_row + 1
                if in_a_row >= max_consecutive_failures:
                    log.error("%d failures in a row: the run stops", in_a_row)
                    break
            elif status is not None:
                in_a_row = 0
    return tally


def taken(store: Store, config: Config, fetched: list[tuple[str, dt.date, str]]) -> list[tuple[dt.date, str, str | None, int]]:
    """(day, source, problem, rows) of landed files (name, day, source), stored in one job."""
    if not fetched:
        return []
    told = store.spark.createDataFrame(fetched, "name string, expected date, layout string")
    found = landed_at(store.spark, *(f"{store.root}/landed/{name}" for name, _, _ in fetched))
    found = found.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(told, "name").drop("name")
    report = {r["expected"]: r for r in store.take_in(found, config.universe)}
    unseen = {"problem": "the file is empty", "stored": {}}
    told = [(day, source, report.get(day, unseen)) for _, day, source in fetched]
    return [(day, source, r["problem"], sum(r["stored"].values())) for day, source, r in told]


def take_in_actions(store: Store, config: Config, fetcher: Fetcher, start: dt.date, end: dt.date) -> None:
    fetcher.start_session()
    for first, last in chunks(start, end):
        got = fetcher.fetch(config.ingest.actions_url.format(start=f"{first:%d-%m-%Y}", end=f"{last:%d-%m-%Y}"))
        if got.status == "ok" and got.content:
            store.add_actions(read_actions(store.spark, store.land(f"actions-{first:%Y%m%d}.json", got.content), config.universe))


def write_csv(found: DataFrame, files: Files, name: str, as_of: dt.date) -> str:
    """A small table as one CSV file, {name}_{date}.csv, in the folder of files, on whatever file system that is."""
    files.write(f"{name}_{as_of}.csv", found.toPandas().to_csv(index=False).encode())
    return f"{files.root}/{name}_{as_of}.csv"


def rendered(found: DataFrame, places: dict[str, int] | None = None) -> str:
    """A small table as text: thousands separators, nulls as a dash, an empty one as (none)."""
    places = places or {}
    shown = [F.coalesce(F.format_number(c, places.get(c, 2)) if kind in ("double", "float") else F.format_number(c, 0) if kind == "bigint" else F.col(c).cast("string"), F.lit("-")).alias(c) for c, kind in found.dtypes]
    rows = [list(map(str, r)) for r in found.select(*shown).collect()]
    if not rows:
        return "  (none)"
    widths = [max(len(r[k]) for r in [found.columns, *rows]) for k in range(len(found.columns))]
    return "\n".join("  ".join(v.rjust(w) for v, w in zip(r, widths, strict=True)) for r in [found.columns, *rows])


def recompute(store: Store, config: Config) -> dict[str, int]:
    verdicts = store.adjust(config.actions)
    return verdicts | {"indicator_rows": store.rebuild_indicators(config.indicators)}


def outputs(store: Store, config: Config, preset_name: str | None = None, as_of: dt.date | None = None) -> tuple[dt.date, DataFrame, DataFrame]:
    """(date, shortlist, status of what is held) once the data are found healthy."""
    indicators, preset = store.table("indicators"), config.preset(preset_name)
    day = as_of or report.latest_date(indicators)
    if day is None:
        raise report.HealthError("there are no indicators yet")
    report.check_health(store.prices(), store.table("ingest_log"), store.table("corporate_actions"), day)
    basket = report.shortlist(indicators, store.table("quarantine"), preset, config.rules, config.portfolio.min_warmup_bars, day)
    return day, basket, report.position_status(store.table("positions"), indicators, config.rules, config.indicators.ema_mid, day)


def daily(store: Store, config: Config, fetcher: Fetcher, start: dt.date | None = None, end: dt.date | None = None, preset_name: str | None = None, lookback_days: int = 45, compact_above_mb: float = 900.0, limit: int | None = None, max_consecutive_failures: int = 5) -> int:
    """Exit code: 1 if the day's data aren't fit to act on."""
    today = end or dt.date.today()
    fill_gaps(store, config, fetcher, start or config.ingest.history_start, today, limit, max_consecutive_failures)
    take_in_actions(store, config, fetcher, today - dt.timedelta(days=lookback_days), today)
    recompute(store, config)
    if store.bytes_of("") > compact_above_mb * 1e6:
        store.compact()
    try:
        day, basket, held = outputs(store, config, preset_name)
    except report.HealthError as error:
        log.error("%s", error)
        return 1
    for name, found in (("positions", held), ("shortlist", basket)):
        print(f"{name} {day}\n{rendered(found)}")
        write_csv(found, Files(store.spark, config.ingest.output), name, day)
    store.log_shortlist(basket, config.preset(preset_name).name, day)
    return 0
