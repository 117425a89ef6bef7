"""What the data and a day's screen say: shortlist, held positions, health and summaries, as DataFrames."""

from __future__ import annotations

import datetime as dt
import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barscreen.config import ExitRules, Preset
from barscreen.operators.screen import screened

log = logging.getLogger(__name__)

# Columns in the order that readers of these tables expect.
SHORTLIST_COLUMNS = (
    "rank", "symbol", "close", "rsi", "adx", "mom_short", "mom_long_skip", "ext_atr", "ext_zscore", "pct_from_high", "trend_age_days", "up_day_ratio", "rsi_divergence", "stoch_k", "stoch_d", "vol_ratio",
    "vol_sustained", "median_turnover", "atr", "suggested_stop",
)
SYMBOL_COLUMNS = (
    "trade_date", "open", "high", "low", "close", "volume", "turnover", "ema_20", "ema_50", "ema_100", "ema_200", "rsi", "adx", "stoch_k", "stoch_d", "atr", "median_turnover", "mom_short", "mom_long_skip",
    "ext_zscore", "trend_age_days", "pct_from_high",
)


class HealthError(RuntimeError):
    """The day's data isn't fit to act on."""


def latest_date(bars: DataFrame) -> dt.date | None:
    return bars.agg(F.max("trade_date")).first()[0]


def shortlist(indicators: DataFrame, quarantine: DataFrame, preset: Preset, rules: ExitRules, min_warmup_bars: int, as_of: dt.date | str | Column) -> DataFrame:
    """The day's basket in order of rank, always with SHORTLIST_COLUMNS. The date filter reaches the scan: ranks are by date."""
    day = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("date")
    ranked = screened(indicators.filter(F.col("trade_date") == day), quarantine, preset, min_warmup_bars, preset.basket_size)
    stop = F.col("close") - rules.initial_stop_atr * F.col("atr").cast("double")
    return ranked.withColumn("suggested_stop", stop).select(*SHORTLIST_COLUMNS).orderBy("rank")


def position_status(positions: DataFrame, indicators: DataFrame, rules: ExitRules, ema_mid: int, as_of: dt.date | str | Column) -> DataFrame:
    """Every exit rule for what is held, on closes up to as_of: the entry bar counts as the first, today's close too."""
    day = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("date")
    held = positions.filter("exit_date is null").select("position_id", "symbol", "entry_date", "entry_price", "quantity")
    at_entry = indicators.select("symbol", F.col("trade_date").alias("entry_date"), F.col("atr").cast("double").alias("atr"))
    held = held.join(at_entry, ["symbol", "entry_date"])
    bars = indicators.select(F.col("symbol").alias("_s"), "trade_date", "close", F.col(f"ema_{ema_mid}").alias("trend"))
    path = held.join(bars, (F.col("symbol") == F.col("_s")) & (F.col("trade_date") >= F.col("entry_date")) & (F.col("trade_date") <= day))
    today = F.col("trade_date") == day
    told = path.groupBy("position_id", "symbol", "entry_date", "entry_price", "quantity", "atr").agg(
        F.max(F.when(today, F.col("close"))).alias("last_close"),
        F.max("close").alias("peak_close"),
        F.count("*").alias("bars_held"),
        F.max(F.when(today, F.col("trend"))).alias("_trend"),
    )
    initial = F.col("entry_price") - rules.initial_stop_atr * F.col("atr")
    armed = F.col("peak_close") >= F.col("entry_price") + rules.trailing_arms_at_r * rules.initial_stop_atr * F.col("atr")
    told = told.withColumns({"initial_stop": initial, "trailing_stop": F.when(armed, F.col("peak_close") - rules.trailing_stop_atr * F.col("atr"))})
    action = (
        F.when(F.col("last_close") <= F.col("initial_stop"), "EXIT: initial stop")
        .when(F.col("last_close") <= F.col("trailing_stop"), "EXIT: trailing stop")
        .when(F.col("bars_held") >= rules.max_hold_days, "EXIT: time stop")
        .when((F.col("last_close") < F.col("_trend")) & (F.col("bars_held") >= rules.min_hold_days), "WATCH: below trend EMA")
        .otherwise("HOLD")
    )
    gain = F.col("last_close") / F.col("entry_price") - 1
    return told.withColumns({"unrealised_return": gain, "action": action}).drop("atr", "_trend").orderBy(F.col("action").desc(), "entry_date")


def closed_positions(positions: DataFrame, limit: int = 100) -> DataFrame:
    closed = positions.filter("exit_date is not null").withColumn("realised_return", F.col("exit_price") / F.col("entry_price") - 1)
    return closed.select("position_id", "symbol", "entry_date", "entry_price", "quantity", "exit_date", "exit_price", "exit_reason", "realised_return").orderBy(F.col("exit_date").desc(), "position_id").limit(limit)


def session_counts(bars: DataFrame, as_of: dt.date | str | Column, days: int = 40) -> DataFrame:
    """(rows, median_rows): bars on as_of, and the median of the counts of the sessions of the days before it."""
    day = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("date")
    counts = bars.filter((F.col("trade_date") <= day) & (F.col("trade_date") >= F.date_sub(day, days))).groupBy("trade_date").count()
    rows = F.coalesce(F.sum(F.when(F.col("trade_date") == day, F.col("count"))), F.lit(0))
    return counts.agg(rows.alias("rows"), F.median(F.when(F.col("trade_date") < day, F.col("count"))).alias("median_rows"))


def check_health(prices: DataFrame, ingest_log: DataFrame, actions: DataFrame, as_of: dt.date, min_rows_ratio: float = 0.8) -> None:
    """Raise on a missing or thin session and on failed ingests; warn of mismatched actions."""
    rows, median = session_counts(prices, as_of).first()
    if not rows:
        raise HealthError(f"there are no bars on {as_of}")
    if median and rows < median * min_rows_ratio:
        raise HealthError(f"{as_of} has {rows} bars, the median of 40 days is {median:.0f}: the session is not complete")
    if failed := ingest_log.filter("status = 'failed'").count():
        raise HealthError(f"{failed} dates failed to be ingested")
    if mismatched := actions.filter("verification = 'mismatch'").count():
        log.warning("%d corporate actions disagree with their price gap and are quarantined", mismatched)


def duplicate_rows(bars: DataFrame) -> DataFrame:
    """(duplicates): rows beyond the first of each symbol and date."""
    return bars.groupBy("symbol", "trade_date").count().filter("count > 1").agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))


def summary(bars: DataFrame) -> DataFrame:
    return bars.agg(F.count("*").alias("bars"), F.countDistinct("symbol").alias("symbols"), F.countDistinct("trade_date").alias("sessions"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("latest_date"))


def counts_by(table: DataFrame, *columns: str) -> DataFrame:
    return table.groupBy(*columns).agg(F.count("*").alias("rows"))


def recent_dates(bars: DataFrame, limit: int = 120) -> DataFrame:
    return bars.select("trade_date").distinct().orderBy(F.col("trade_date").desc()).limit(max(1, min(limit, 2000)))


def search_symbols(bars: DataFrame, term: str, limit: int = 25) -> DataFrame:
    """Symbols like the term (its % and _ are wildcards) and when each was last seen, an exact match first."""
    term = term.upper()[:32]
    found = bars.filter(F.col("symbol").like(f"%{term}%") if term else F.lit(False)).groupBy("symbol").agg(F.max("trade_date").alias("last_seen"))
    return found.orderBy((F.col("symbol") == term).desc(), "symbol").limit(limit)


def symbol_bars(indicators: DataFrame, symbol: str, days: int = 260) -> DataFrame:
    """A symbol's last bars, oldest first."""
    last = indicators.filter(F.col("symbol") == symbol.upper()).orderBy(F.col("trade_date").desc()).limit(max(30, min(days, 2000)))
    return last.select(*[c for c in SYMBOL_COLUMNS if c in indicators.columns]).orderBy("trade_date")


def symbol_actions(actions: DataFrame, symbol: str, limit: int = 20) -> DataFrame:
    own = actions.filter((F.col("symbol") == symbol.upper()) & F.col("adj_factor").isNotNull())
    return own.select("ex_date", "action_type", "adj_factor", "verification", "subject").orderBy(F.col("ex_date").desc(), "subject").limit(limit)


def recent_failures(ingest_log: DataFrame, limit: int = 10) -> DataFrame:
    return ingest_log.filter("status = 'failed'").select("trade_date", "note").orderBy(F.col("trade_date").desc()).limit(limit)


def by_column(table: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """A table in the order that a reader asks for; nulls come last either way."""
    return table.orderBy(F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last())


def open_first(positions: DataFrame) -> DataFrame:
    """All positions, open ones first, then by exit and entry."""
    return positions.orderBy(F.col("exit_date").asc_nulls_first(), "entry_date", "position_id")
