"""Backtests: screen, rank, date filter, exits and the slot ledger, with all costs and without any."""

from __future__ import annotations

import dataclasses
import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barscreen.config import Config, Costs, Preset
from barscreen.operators.exits import outcomes
from barscreen.operators.portfolio import curve_of, ledger, statistics, trades_of
from barscreen.operators.screen import baskets, screened


@dataclasses.dataclass(frozen=True)
class Result:
    preset: str
    trades: DataFrame
    curve: DataFrame
    stats: DataFrame
    stats_gross: DataFrame

    def cost_drag_on_return(self) -> float | None:
        """What costs took off the total return."""
        net, gross = (s.select("total_return_net").first()[0] for s in (self.stats, self.stats_gross))
        return None if net is None or gross is None else gross - net


def signals(indicators: DataFrame, quarantine: DataFrame, preset: Preset, min_warmup_bars: int, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """(symbol, signal_index, signal_date, rank) of each date's basket between start and end, both included."""
    ranked = screened(indicators, quarantine, preset, min_warmup_bars, preset.basket_size)
    for day, within in ((start, F.col("trade_date") >= F.lit(start)), (end, F.col("trade_date") <= F.lit(end))):
        ranked = ranked.filter(within) if day else ranked
    return ranked.select("symbol", F.col("bar_index").alias("signal_index"), F.col("trade_date").alias("signal_date"), "rank")


def candidates(found: DataFrame, indicators: DataFrame, config: Config, costs: Costs) -> DataFrame:
    """Signals with their outcomes; those on a symbol's last bar have none and go."""
    return found.join(outcomes(found, indicators, config.rules, costs, config.indicators.ema_mid), ["symbol", "signal_index"])


def run(indicators: DataFrame, quarantine: DataFrame, preset: Preset, config: Config, start: dt.date | None = None, end: dt.date | None = None) -> Result:
    """indicators should be a stored table: it is read for the screen and for the exits.

    The run without costs is made anew: slippage moves fills, and with them the stops that are hit.
    """
    p = config.portfolio
    found = signals(indicators, quarantine, preset, p.min_warmup_bars, start, end)

    def book(costs: Costs) -> tuple[DataFrame, DataFrame]:
        made = ledger(candidates(found, indicators, config, costs), p.slots, p.capital, costs).cache()
        return trades_of(made), curve_of(made)

    (trades, curve), (free_trades, free_curve) = book(config.costs), book(dataclasses.replace(config.costs, enabled=False))
    return Result(preset.name, trades, curve, statistics(trades, curve, p.capital), statistics(free_trades, free_curve, p.capital))


def walk_forward(indicators: DataFrame, quarantine: DataFrame, preset: Preset, config: Config, split: dt.date) -> dict[str, Result]:
    """One run up to the split date and one from it; the date itself is in both."""
    return {"in_sample": run(indicators, quarantine, preset, config, end=split), "out_of_sample": run(indicators, quarantine, preset, config, start=split)}


RUN = ("preset", "side", "net")


def book_of_runs(indicators: DataFrame, quarantine: DataFrame, presets: list[Preset], config: Config, split: dt.date | None = None) -> DataFrame:
    """The ledgers (see portfolio.ledger) of all runs at once, by RUN: each preset, with costs and without any, over the
    whole time and, with a split date, up to it and from it, the date itself being in both.

    The bars are screened in one pass, and joined once for the exits of each different signal; a run is a group of its own.
    """
    p = config.portfolio
    found = baskets(indicators, quarantine, presets, p.min_warmup_bars)
    found = found.select("preset", "symbol", F.col("bar_index").alias("signal_index"), F.col("trade_date").alias("signal_date"), "rank")
    sides = [F.lit("whole")]
    if split is not None:
        sides += [F.when(F.col("signal_date") <= F.lit(split), F.lit("in_sample")), F.when(F.col("signal_date") >= F.lit(split), F.lit("out_of_sample"))]
    ended = outcomes(found.select("symbol", "signal_index").distinct(), indicators, config.rules, config.costs, config.indicators.ema_mid, both=True)
    each = found.withColumn("side", F.explode(F.array_compact(F.array(*sides)))).join(ended, ["symbol", "signal_index"])
    free = dataclasses.replace(config.costs, enabled=False)
    return ledger(each, p.slots, p.capital, lambda key: config.costs if key[2] else free, by=RUN)


def figures_of_runs(book: DataFrame, capital: float) -> DataFrame:
    """A row of statistics for each run of a preset and a side, of the run with costs, and what costs took off the total return."""
    found = statistics(trades_of(book, *RUN), curve_of(book, *RUN), capital, *RUN)
    free = found.filter("NOT net").select("preset", "side", F.col("trades").alias("trades_gross"), F.col("total_return_net").alias("total_return_gross"), F.col("cagr_net").alias("cagr_gross"))
    both = found.filter("net").drop("net").join(free, ["preset", "side"], "full")
    return both.withColumn("cost_drag_on_return", F.col("total_return_gross") - F.col("total_return_net"))
