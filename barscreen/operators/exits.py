"""Exit rules for signals, without a look ahead: each signal meets the bars after it, and the earliest rule wins.

Signals (at most a basket for each date) are spread over their holding window and joined to the bars by symbol and
bar number; nothing is ever made for all bars times the window. All that a rule needs at a bar is a window over the
signal's earlier bars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barscreen.config import Costs, ExitRules
from barscreen.functions.costs import slipped, slippage_bps

KEY = ("symbol", "signal_index")


def holding_windows(signals: DataFrame, bars: DataFrame, horizon: int) -> DataFrame:
    """A row for each signal and each of the `horizon` bars after it (k from 0), as far as the symbol has bars."""
    spread = signals.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1)))).withColumn("bar_index", F.col("signal_index") + 1 + F.col("k"))
    return spread.join(bars, ["symbol", "bar_index"])


def outcomes(signals: DataFrame, indicators: DataFrame, rules: ExitRules, costs: Costs, ema_mid: int, both: bool = False) -> DataFrame:
    """One row for each signal (symbol, signal_index) that has a bar to enter on, with entry, exit, reason and return.

    both: two rows, with `net` true and false; the second fills without slippage, which moves the stops that are hit. The
    bars are joined once for both.

    Entry is the next bar's open. The stop starts initial_stop_atr below it and, once the highest close before the bar
    under test is far enough up, trails that close; it fills at the stop or a worse open. Closes below the trend line
    on structural_exit_days bars in a row (not before min_hold_days) exit at the next open; the last bar of the window
    exits at its open, as data_end if the symbol ends early. At the same bar a stop goes before a structural exit, and
    that before the end. A signal on a symbol's last bar has no outcome.
    """
    bars = indicators.select("symbol", "bar_index", "trade_date", "open", "low", "close", F.col(f"ema_{ema_mid}").alias("trend"))
    at = indicators.select("symbol", F.col("bar_index").alias("signal_index"), F.col("atr").cast("double").alias("atr"), "median_turnover")
    known = signals.select(*KEY).join(at, list(KEY)).withColumn("slippage_bps", slippage_bps(costs, F.col("median_turnover")))
    path, key = holding_windows(known, bars, rules.max_hold_days), KEY
    if both:
        path, key = path.withColumn("net", F.explode(F.array(F.lit(True), F.lit(False)))), (*KEY, "net")

    def filled(price: Column, side: str) -> Column:
        fill = slipped(costs, price, F.col("slippage_bps"), side)
        return F.when(F.col("net"), fill).otherwise(price) if both else fill

    whole = Window.partitionBy(*key)
    ordered = whole.orderBy("k")
    entry = F.first("entry_price").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    path = path.withColumn("entry_price", F.when(F.col("k") == 0, filled(F.col("open"), "buy")))
    path = path.withColumns({
        "entry_price": entry,
        "entry_date": F.first("trade_date").over(ordered.rowsBetween(Window.unboundedPreceding, 0)),
        "time_k": F.max("k").over(whole),
        "top": F.max("close").over(ordered.rowsBetween(Window.unboundedPreceding, -1)),
        "below": F.coalesce(F.col("close") < F.col("trend"), F.lit(False)).cast("int"),
    })
    risk = rules.initial_stop_atr * F.col("atr")
    top = F.coalesce("top", "entry_price")  # nothing closed before the entry bar
    initial = F.col("entry_price") - risk
    armed = top >= F.col("entry_price") + rules.trailing_arms_at_r * risk
    stop = F.when(armed, F.greatest(initial, top - rules.trailing_stop_atr * F.col("atr"))).otherwise(initial)
    days = ordered.rowsBetween(1 - rules.structural_exit_days, 0)
    persistent = (F.sum("below").over(days) == rules.structural_exit_days) & (F.col("k") >= rules.min_hold_days)
    path = path.withColumns({"stop": stop, "persistent": persistent})
    firsts = path.groupBy(*key).agg(
        F.min(F.when(F.col("low") <= F.col("stop"), F.col("k"))).alias("stop_k"),
        (F.min(F.when(F.col("persistent"), F.col("k"))) + 1).alias("structural_k"),
        F.first("time_k").alias("time_k"),
    )
    structural = F.when(F.col("structural_k") <= F.col("time_k"), F.col("structural_k"))
    chosen = firsts.withColumn("structural_k", structural).withColumn("exec_k", F.least("stop_k", "structural_k", "time_k"))
    ended = F.when(F.col("time_k") < rules.max_hold_days - 1, "data_end").otherwise("time")
    reason = F.when(F.col("stop_k") == F.col("exec_k"), "stop").when(F.col("structural_k") == F.col("exec_k"), "structural").otherwise(ended)
    chosen = chosen.select(*key, F.col("exec_k").alias("k"), reason.alias("exit_reason"))

    fill = F.when(F.col("exit_reason") == "stop", F.least("stop", "open")).otherwise(F.col("open"))
    out = path.join(chosen, [*key, "k"]).withColumn("exit_price", filled(fill, "sell"))
    return out.select(
        *key,
        "entry_date",
        F.col("trade_date").alias("exit_date"),
        "entry_price",
        "exit_price",
        (F.col("exit_price") / F.col("entry_price") - 1).alias("gross_return"),
        (F.col("k") + 1).alias("hold_days"),
        "exit_reason",
        "median_turnover",
        "slippage_bps",
    )
