"""The stored tables: bars in commits, everything else as numbered versions.

Bars are written into a folder of their own for each commit, by month, and nobody sees them until the log names the commit
for a session. The log's entry is published at once (see versions), so bars and log appear together: a session that breaks
off leaves a folder that no entry names. A session that is written again is named under its new commit; its old bars stay
for readers that have begun and go when prices are compacted. Compaction is a commit too: the visible bars by month and
range of symbols, named in one entry for all sessions that nobody has written meanwhile.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barscreen.config import Actions, Indicators, Universe
from barscreen.functions import text
from barscreen.operators import adjust, recursive, windows
from barscreen.schemas import LASTING, PRICES, TABLES
from barscreen.sources import files
from barscreen.sources.versions import Files, Lost, Versions

COLUMNS = [c.split()[0] for c in PRICES.split(", ")]
#: What marks a commit's folder that no session is read from any more; Spark's readers pass over such names.
DEAD = "_dead"


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark, self.root)

    def versions(self, name: str) -> Versions:
        schema, key = TABLES.get(name, (None, ()))
        return Versions(self.spark, f"{self.root}/{name}", schema, key, LASTING.get(name, ()))

    def bytes_of(self, name: str) -> int:
        return self.files.bytes_of(name)

    def table(self, name: str) -> DataFrame:
        """A table as of its last entry."""
        return self.versions(name).read()

    def replace(self, name: str, rows: DataFrame, keep: int = 2, files: int | None = 1) -> None:
        """The whole table anew; what readers of the version before may still read stays."""
        self.versions(name).replace(rows.coalesce(files) if files else rows, keep=keep)

    def upsert(self, name: str, rows: DataFrame) -> None:
        """Rows take the place of those with the same key; of several new ones with one key the last to arrive counts."""
        self.versions(name).append_table(rows)

    # -- bars -------------------------------------------------------------------------------------------------

    def _visible(self) -> tuple[int, DataFrame]:
        """(number of the log's last entry, the (trade_date, commit_id) that it names): a row for each session."""
        last, log = self.versions("ingest_log").snapshot()
        return last, log.filter("commit_id IS NOT NULL").select("trade_date", "commit_id")

    def _bars_of(self, visible: DataFrame) -> DataFrame:
        """Bars with month and commit_id, of these sessions' commits only: other folders aren't even listed."""
        commits = sorted(r[0] for r in visible.select("commit_id").distinct().collect())  # one a session at most, fewer once compacted
        if not commits:
            return self.spark.createDataFrame([], f"{PRICES}, commit_id string, month string, slice int")
        read = self.spark.read.schema(f"{PRICES}, commit_id string, month string, slice int").option("basePath", f"{self.root}/prices")
        found = read.parquet(*[f"{self.root}/prices/commit_id={c}" for c in commits])
        return found.join(visible, ["trade_date", "commit_id"], "left_semi")

    def prices(self, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
        """Bars of all sessions that the log names, or of those from first to last: then other months' folders aren't read."""
        found = self._bars_of(self._visible()[1])
        if first:
            found = found.filter((F.col("month") >= f"{first:%Y-%m}") & (F.col("trade_date") >= F.lit(first)))
        if last:
            found = found.filter((F.col("month") <= f"{last:%Y-%m}") & (F.col("trade_date") <= F.lit(last)))
        return found.select(*COLUMNS)

    def stage(self, bars: DataFrame, bars_per_file: int | None = None) -> str:
        """Write bars into a new commit, which nobody sees yet; its id begins with the time.

        A file for each month; with bars_per_file, as many for a month as that takes, each with a range of symbols.
        """
        commit = f"{dt.datetime.now(dt.timezone.utc):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:12]}"
        rows = bars.select(*COLUMNS, F.date_format("trade_date", "yyyy-MM").alias("month"))
        if bars_per_file is None:
            rows = rows.withColumn("slice", F.lit(0))
        else:
            counts = rows.groupBy("month", "symbol").agg(F.count("*").alias("n"))
            before = F.sum("n").over(Window.partitionBy("month").orderBy("symbol").rowsBetween(Window.unboundedPreceding, -1))
            slices = counts.select("month", "symbol", F.floor(F.coalesce(before, F.lit(0)) / bars_per_file).cast("int").alias("slice"))
            rows = rows.join(slices, ["month", "symbol"])
        rows = rows.repartition("month", "slice").sortWithinPartitions("month", "slice", "symbol", "trade_date")
        rows.write.partitionBy("month", "slice").parquet(f"{self.root}/prices/commit_id={commit}")
        return commit

    def write_day(self, day: dt.date, source: str, bars: DataFrame, sha: str = "") -> int:
        """Replace a session's bars and note it as ok; returns how many there are."""
        commit = self.stage(bars.filter(F.col("trade_date") == F.lit(day)))
        count = self.spark.read.schema(PRICES).parquet(f"{self.root}/prices/commit_id={commit}").count()
        self.mark(day, "ok", source, count, sha, commit=commit)
        return count

    def mark(self, day: dt.date, status: str, source: str | None = None, row_count: int | None = None, sha: str | None = None, note: str | None = None, commit: str | None = None) -> None:
        """Note a session's state; bars that it has stay visible unless a commit is given."""
        self.versions("ingest_log").append([logged(day, status, source, row_count, sha, note, commit)])

    def take_in(self, landed: DataFrame, universe: Universe) -> list[dict]:
        """Store the sessions of any number of landed files (see files.parsed) in one job, one commit and one log entry.

        Returns what files.file_report says, and the days stored of each file. A file with a problem costs itself only: it
        is noted as a failed session if its day is known, and in the table rejects.
        """
        staging = f"{self.root}/staging/{uuid.uuid4().hex}"
        files.parsed(landed, universe).write.parquet(staging)  # files may change: what is judged is what is stored
        rows = self.spark.read.parquet(staging)
        report = [r.asDict() for r in files.file_report(rows).orderBy("arrived", "path").collect()]  # a row for each file of the batch
        fit = files.fit_bars(rows, files.file_report(rows))
        if any(r["problem"] is None for r in report):
            commit = self.stage(fit)
            stored = fit.groupBy("path", "trade_date").agg(F.count("*").alias("n")).orderBy("trade_date").collect()
        else:
            commit, stored = None, []
        by_path = {r["path"]: r for r in report}
        entries = [logged(r["trade_date"], "ok", by_path[r["path"]]["layout"], r["n"], by_path[r["path"]]["sha"], None, commit) for r in stored]
        done = {r["trade_date"] for r in stored}
        bad = [r for r in report if r["problem"] is not None]
        entries += [logged(r["expected"], "failed", r["layout"], None, r["sha"], r["problem"], None) for r in bad if r["expected"] and r["expected"] not in done]
        if bad:
            now = dt.datetime.now()
            self.versions("rejects").append([{"path": r["path"], "source": r["layout"], "expected": r["expected"], "note": r["problem"][:500], "rejected_at": now} for r in bad])
        self.versions("ingest_log").append(entries)
        self.files.delete(staging.removeprefix(f"{self.root}/"))
        for r in report:
            r["stored"] = {s["trade_date"]: s["n"] for s in stored if s["path"] == r["path"]}
        return report

    def land(self, name: str, content: bytes) -> str:
        """Keep a fetched file under the root, on whatever file system that is."""
        self.files.write(f"landed/{name}", content)
        return f"{self.root}/landed/{name}"

    def settled_dates(self) -> set[dt.date]:
        """Dates that need no other attempt; pending and failed ones do."""
        return {r[0] for r in self.table("ingest_log").filter("status in ('ok', 'holiday')").select("trade_date").collect()}

    # -- actions, prices on today's basis, indicators ------------------------------------------------------------

    def add_actions(self, actions: DataFrame) -> None:
        """New and restated actions, to be verified: without a price effect they are ignored, else pending."""
        state = F.when(F.col("action_type") == "ignored", "ignored").otherwise("pending")
        self.upsert("corporate_actions", actions.withColumns({"verification": state, "observed": F.lit(None).cast("double"), "deviation": F.lit(None).cast("double")}))

    def adjust(self, settings: Actions) -> dict[str, int]:
        """Verify all actions, add quarantine windows (which are never taken back) and rebuild the factors' spans."""
        prices = self.prices()
        self.versions("corporate_actions").update(lambda actions: adjust.verified(actions, prices, settings).coalesce(1))
        actions = self.table("corporate_actions")
        self.upsert("quarantine", adjust.quarantined(actions, settings))
        self.replace("adj_intervals", adjust.intervals(actions))
        return {r[0]: r[1] for r in actions.groupBy("verification").count().collect()}

    def adjusted(self) -> DataFrame:
        """Always computed from raw prices, which are never rewritten."""
        return adjust.adjusted(self.prices(), self.table("adj_intervals"))

    def rebuild_indicators(self, settings: Indicators, bars_per_file: int = 500_000) -> int:
        """Compute all indicators and store them twice: by ranges of dates, for screens, and by symbol, for one symbol's bars."""
        made = windows.narrowed(windows.with_windows(recursive.sequential(self.adjusted(), settings), settings))
        staging = f"{self.root}/staging/{uuid.uuid4().hex}"
        made.write.parquet(staging)  # computed once for both
        self._lay_out_indicators(self.spark.read.parquet(staging), bars_per_file)
        self.files.delete(staging.removeprefix(f"{self.root}/"))
        return self.table("indicators").count()

    def _lay_out_indicators(self, rows: DataFrame, bars_per_file: int, keep: int = 2, at: int | None = None) -> None:
        count = max(1, -(-rows.count() // bars_per_file))
        by_date = rows.repartitionByRange(count, "trade_date").sortWithinPartitions("trade_date", "symbol")
        buckets = {"buckets": F.lit(count), "bucket": bucket_of(F.col("symbol"), F.lit(count))}
        by_symbol = rows.withColumns(buckets).repartition(count, "bucket").sortWithinPartitions("bucket", "symbol", "trade_date")
        self.versions("indicators").replace(by_date, at, keep, {"by_symbol": (by_symbol, ("buckets", "bucket"))})

    def symbol_indicators(self, symbol: str) -> DataFrame:
        """One symbol's bars: its bucket is a folder, so one file is read; bars are in order in it."""
        found = self.versions("indicators").copy("by_symbol")
        if found is None:
            return self.table("indicators").filter(F.col("symbol") == symbol)
        own = F.col("bucket") == bucket_of(F.lit(symbol), F.col("buckets"))  # of folders' names alone: decided before any file is opened
        return found.filter(own & (F.col("symbol") == symbol)).drop("buckets", "bucket")

    # -- positions and shortlists --------------------------------------------------------------------------------

    def _change_positions(self, change: Callable[[DataFrame, Versions, int], object], tries: int = 1000) -> object:
        """change gets the positions, their table and the number that it must write under; it is called again on loss."""
        table = self.versions("positions")
        for _ in range(tries):
            last, held = table.snapshot()
            try:
                return change(held, table, last + 1)
            except Lost:
                continue
        raise Lost("positions: other writers came between too often")

    def add_position(self, symbol: str, entry_date: dt.date, entry_price: float, quantity: int, note: str | None = None) -> int:
        def add(held: DataFrame, table: Versions, at: int) -> int:
            new = held.agg(F.coalesce(F.max("position_id"), F.lit(0)) + 1).first()[0]
            table.append([{"position_id": new, "symbol": symbol, "entry_date": entry_date, "entry_price": float(entry_price), "quantity": quantity, "note": note}], at)
            return new

        return self._change_positions(add)

    def close_position(self, position_id: int, exit_date: dt.date, exit_price: float, reason: str = "manual", again: bool = False) -> bool:
        """Note an exit; a closed position only changes with `again`."""

        def close(held: DataFrame, table: Versions, at: int) -> bool:
            own = held.filter((F.col("position_id") == position_id) & (F.lit(again) | F.col("exit_date").isNull())).first()
            if own is not None:
                table.append([own.asDict() | {"exit_date": exit_date, "exit_price": float(exit_price), "exit_reason": reason[:64]}], at)
            return own is not None

        return self._change_positions(close)

    def delete_position(self, position_id: int) -> bool:
        def delete(held: DataFrame, table: Versions, at: int) -> bool:
            there = not held.filter(F.col("position_id") == position_id).isEmpty()
            if there:
                table.remove([{"position_id": position_id}], at)
            return there

        return self._change_positions(delete)

    def log_shortlist(self, found: DataFrame, preset: str, as_of: dt.date) -> None:
        """A row for each name, all its figures as JSON; logging a day again replaces its rows."""
        rows = found.select(F.lit(as_of).alias("as_of_date"), "symbol", "rank", F.lit(preset).alias("preset"), F.to_json(F.struct(*found.columns)).alias("payload"))
        if not rows.isEmpty():
            self.upsert("shortlist_log", rows)

    # -- upkeep ----------------------------------------------------------------------------------------------------

    def compact(self, bytes_per_file: int = 128 << 20, grace: dt.timedelta = dt.timedelta(days=1)) -> tuple[int, int]:
        """Compact prices, fold all tables and rewrite the indicators in files of a good size; bytes before and after."""
        before = self.bytes_of("")
        self.compact_prices(bytes_per_file, grace)
        for name in TABLES:
            table = self.versions(name)
            if table.last():
                table.fold(keep=1)  # False if it is in use just now; the next time will do
        indicators = self.versions("indicators")
        if indicators.last():
            last, found = indicators.snapshot()
            per_file = max(1, int(found.count() * bytes_per_file / max(1, self.bytes_of("indicators"))))
            try:
                self._lay_out_indicators(found, per_file, keep=1, at=last + 1)
            except Lost:
                pass
        return before, self.bytes_of("")

    def compact_prices(self, bytes_per_file: int = 128 << 20, grace: dt.timedelta = dt.timedelta(days=1)) -> int:
        """Rewrite the visible bars, a file for each month or, of large months, for each range of symbols; how many sessions moved.

        Nothing is done if one commit holds them all. Commits that no session is read from are marked, and deleted once
        that is `grace` ago: longer than any reader or writer takes.
        """
        last, visible = self._visible()
        read = {r["trade_date"]: r["commit_id"] for r in visible.collect()}  # a row for each session
        moved: list[dt.date] = []
        if len(set(read.values())) > 1:
            bars = self._bars_of(visible)
            size = sum(self.bytes_of(f"prices/commit_id={c}") for c in set(read.values()))
            per_file = max(1, int(bytes_per_file * max(1, bars.count()) / max(1, size)))
            commit = self.stage(bars, per_file)
            log = self.versions("ingest_log")
            for _ in range(1000):
                now = log.read().filter("commit_id IS NOT NULL")
                rows = [r.asDict() for r in now.collect() if read.get(r["trade_date"]) == r["commit_id"]]
                try:
                    log.append([r | {"commit_id": commit} for r in rows], at=last + 1)
                    moved = [r["trade_date"] for r in rows]
                    break
                except Lost:
                    last = log.last()
        self._bury(grace)
        return len(moved)

    def _bury(self, grace: dt.timedelta) -> None:
        live = {r[0] for r in self._visible()[1].select("commit_id").distinct().collect()}
        for name in self.files.names("prices"):
            if name.startswith("commit_id=") and name.removeprefix("commit_id=") not in live:
                if not self.files.exists(f"prices/{name}/{DEAD}"):
                    self.files.write(f"prices/{name}/{DEAD}", b"")
                if self.files.age(f"prices/{name}/{DEAD}") >= grace.total_seconds():
                    self.files.delete(f"prices/{name}")

    def missing_file_status(self, day: dt.date, today: dt.date, confirm_after_days: int) -> str:
        """holiday once the file is late for good, pending before."""
        late = self.spark.range(1).select(text.conclusively_absent(F.lit(day), F.lit(today), confirm_after_days)).first()[0]
        return "holiday" if late else "pending"


def bucket_of(symbol: Column, buckets: Column) -> Column:
    return F.pmod(F.xxhash64(symbol), buckets.cast("bigint")).cast("int")


def logged(day: dt.date, status: str, source: str | None, row_count: int | None, sha: str | None, note: str | None, commit: str | None) -> dict:
    """A row of the log."""
    return {"trade_date": day, "source": source, "status": status, "row_count": row_count, "content_sha": sha, "fetched_at": dt.datetime.now(), "note": note and note[:500], "commit_id": commit}
