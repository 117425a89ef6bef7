"""The slot ledger and what is told about it.

Which candidates get a slot depends on all that came before, across symbols: the ledger is a sequential fold over dates.
A backtest's input is bounded (a basket of candidates a date), so its group runs beside the data, in applyInPandas, and
many backtests are many groups; statistics of trades and curves are aggregations again.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barscreen.config import Costs

CANDIDATES = ("symbol", "entry_date", "exit_date", "entry_price", "exit_price", "rank", "gross_return", "exit_reason", "hold_days")
TRADES = (
    "symbol string, entry_date date, exit_date date, entry_price double, exit_price double, quantity double, cost_basis double, buy_cost double, "
    "gross_return double, exit_reason string, hold_days int, exit_value double, sell_cost double, net_profit double, net_return double"
)
LEDGER = f"kind string, date date, equity double, open_positions int, {TRADES}"


def _levy(costs: Costs, value: float, tax: float, flat: float) -> float:
    """The charges of functions.costs for one amount."""
    if not costs.enabled:
        return 0.0
    share = value * costs.brokerage_pct
    charged = (min(share, costs.brokerage_flat) if costs.brokerage_flat > 0 else share) + value * costs.exchange_txn_pct + value * costs.sebi_turnover_pct
    return charged + charged * costs.gst_pct + value * tax + flat


def fold_slots(candidates: pd.DataFrame, slots: int, capital: float, costs: Costs, buy_charge_once: bool = False) -> tuple[list[dict], list[dict]]:
    """Trades and equity curve of a portfolio of equal slots.

    On each date exits come first, then entries in order of rank while slots are free, each with an equal part of the
    equity, no symbol twice; then exits again, for positions that end on the day they begin. The curve is of realised
    equity. The buy charge lowers equity at entry and is part of the cost that profit is measured against at exit, so
    it counts twice in equity; buy_charge_once leaves it out at entry.
    """
    entering, leaving, held = defaultdict(list), defaultdict(list), set()
    for row in candidates.sort_values(["entry_date", "rank", "symbol"]).to_dict("records"):
        entering[row["entry_date"]].append(row)
    trades, curve, equity = [], [], capital

    def settle(date) -> float:
        gained = 0.0
        for trade in leaving.pop(date, ()):
            value = trade["quantity"] * trade["exit_price"]
            charge = _levy(costs, value, costs.stt_sell_pct, costs.dp_charge)
            profit = value - charge - trade["cost_basis"]
            trades.append(trade | {"exit_value": value, "sell_cost": charge, "net_profit": profit, "net_return": profit / trade["cost_basis"]})
            held.discard(trade["symbol"])
            gained += profit
        return gained

    for date in sorted(set(candidates["entry_date"]) | set(candidates["exit_date"])):
        equity += settle(date)
        for row in entering[date]:
            part = equity / slots
            if len(held) >= slots or row["symbol"] in held or not part / row["entry_price"] > 0:
                continue
            charge = _levy(costs, part, costs.stt_buy_pct + costs.stamp_duty_buy_pct, 0.0)
            equity -= 0.0 if buy_charge_once else charge
            held.add(row["symbol"])
            bought = {"entry_date": date, "quantity": part / row["entry_price"], "cost_basis": part + charge, "buy_cost": charge}
            leaving[row["exit_date"]].append({k: row[k] for k in CANDIDATES if k != "rank"} | bought)
        equity += settle(date)
        curve.append({"date": date, "equity": equity, "open_positions": len(held)})
    return trades, curve


def ledger(candidates: DataFrame, slots: int, capital: float, costs: Costs | Callable[[tuple], Costs], buy_charge_once: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Trades and curve points of slot portfolios in one table; `trades_of` and `curve_of` take it apart.

    Each value of the columns `by` (a preset, a rule set, a first year) is a portfolio of its own, with all of its
    candidates in one group: many backtests are dealt out over the tasks, and one has a basket a date. costs may be
    a function of these values.
    """
    columns = [c.split()[0] for c in LEDGER.split(", ")]

    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        trades, curve = fold_slots(df[list(CANDIDATES)], slots, capital, costs(key) if callable(costs) else costs, buy_charge_once)
        rows = [{"kind": "trade", **t} for t in trades] + [{"kind": "point", **c} for c in curve]
        made = pd.DataFrame(rows, columns=columns).astype({"open_positions": "Int32", "hold_days": "Int32"})
        for name, value in reversed(list(zip(by, key, strict=False))):
            made.insert(0, name, value)
        return made

    own = [f"{f.name} {f.dataType.simpleString()}" for f in candidates.select(*by).schema.fields] if by else []
    keyed = candidates.select(*by, *CANDIDATES) if by else candidates.select(*CANDIDATES, F.lit(1).alias("_all"))
    return keyed.groupBy(*(by or ("_all",))).applyInPandas(run, ", ".join([*own, LEDGER]))


def trades_of(book: DataFrame, *by: str) -> DataFrame:
    return book.filter("kind = 'trade'").select(*by, *[c.split()[0] for c in TRADES.split(", ")])


def curve_of(book: DataFrame, *by: str) -> DataFrame:
    return book.filter("kind = 'point'").select(*by, "date", "equity", "open_positions")


def _curve_window(by: tuple[str, ...]) -> WindowSpec:
    return Window.partitionBy(*(by or (F.lit(1),)))


def _beside(rows: DataFrame, summary: DataFrame, key: str, value: str) -> DataFrame:
    """rows with the value of their key's row in summary; null is a key like any other."""
    renamed = summary.select(F.col(key).alias("_key"), value)
    return rows.join(renamed, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")


def drawdowns(curve: DataFrame, *by: str) -> DataFrame:
    """curve with `drawdown`, from the highest point so far (within `by`).

    Many curves (`by`) are dealt out. A single one goes in two levels, so that it isn't ordered in one task, however long: the
    highest point of each month, the highest of the months before (a row a month), and within a month the highest so far.
    """
    if by:
        peak = F.max("equity").over(_curve_window(by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
        return curve.withColumn("drawdown", F.col("equity") / peak - 1)
    months = curve.withColumn("_month", F.trunc("date", "month"))
    high = months.groupBy("_month").agg(F.max("equity").alias("_high"))
    before = _curve_window(()).orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
    met = _beside(months, high.withColumn("_before", F.max("_high").over(before)), "_month", "_before")
    within = F.max("equity").over(Window.partitionBy("_month").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    return met.withColumn("drawdown", F.col("equity") / F.greatest("_before", within) - 1).drop("_month", "_before")


def statistics(trades: DataFrame, curve: DataFrame, capital: float, *by: str) -> DataFrame:
    """A row of figures for each backtest (`by`); without any and without a trade, `trades` is 0 and the rest null."""
    net, count = F.col("net_return"), F.count("*")
    win, loss = (F.avg(F.when(c, net)) for c in (net > 0, net <= 0))
    t = trades.groupBy(*by).agg(
        count.alias("trades"),
        F.avg("gross_return").alias("mean_gross_return"),
        F.percentile("net_return", 0.5).alias("median_net_return"),
        F.avg("net_return").alias("mean_net_return"),
        F.avg((net > 0).cast("double")).alias("hit_rate"),
        win.alias("avg_win"),
        loss.alias("avg_loss"),
        F.avg("hold_days").alias("avg_hold_days"),
        (F.sum("cost_basis") + F.sum("exit_value")).alias("_traded"),
        (F.sum("buy_cost") + F.sum("sell_cost")).alias("total_costs"),
    )
    c = drawdowns(curve, *by).groupBy(*by).agg(F.max_by("equity", "date").alias("_final"), F.min("drawdown").alias("max_drawdown"), F.datediff(F.max("date"), F.min("date")).alias("_days"))
    both = (t.join(c, list(by), "left") if by else t.join(c, F.lit(True), "left")).withColumn("years", F.when(F.col("_days") == 0, 1).otherwise(F.col("_days")) / 365.25)
    some = F.col("trades") > 0
    figures = {
        "total_return_net": F.col("_final") / capital - 1,
        "cagr_net": F.pow(F.col("_final") / capital, 1 / F.col("years")) - 1,
        "mean_gross_return": F.col("mean_gross_return"),
        "median_net_return": F.col("median_net_return"),
        "mean_net_return": F.col("mean_net_return"),
        "max_drawdown": F.col("max_drawdown"),
        "hit_rate": F.col("hit_rate"),
        "avg_win": F.coalesce("avg_win", F.lit(0.0)),
        "avg_loss": F.coalesce("avg_loss", F.lit(0.0)),
        "win_loss_ratio": F.coalesce("avg_win", F.lit(0.0)) / F.abs(F.nullif(F.col("avg_loss"), F.lit(0.0))),
        "avg_hold_days": F.col("avg_hold_days"),
        "turnover_x_per_year": F.col("_traded") / capital / F.col("years"),
        "total_costs": F.col("total_costs"),
        "cost_drag_pct_of_capital": F.col("total_costs") / capital,
        "cost_drag_per_trade": F.col("total_costs") / F.nullif(F.col("trades"), F.lit(0)),
        "years": F.col("years"),
    }
    return both.select(*by, "trades", *[F.when(some, v).alias(k) for k, v in figures.items()])


def exit_breakdown(trades: DataFrame) -> DataFrame:
    """Trades, mean net return, share of winners and mean holding time by exit reason, most trades first."""
    net = F.col("net_return")
    found = trades.groupBy("exit_reason").agg(F.count("*").alias("trades"), F.avg(net).alias("mean_net"), F.avg((net > 0).cast("double")).alias("hit_rate"), F.avg("hold_days").alias("mean_hold"))
    return found.orderBy(F.col("trades").desc(), "exit_reason")


def yearly_returns(curve: DataFrame, *by: str) -> DataFrame:
    """By curve and calendar year: last over first equity of the year, drawdown within it, points."""
    by_year = drawdowns(curve.withColumn("year", F.year("date")), *by, "year")
    ends = F.max_by("equity", "date") / F.min_by("equity", "date") - 1
    return by_year.groupBy(*by, "year").agg(ends.alias("return"), F.min("drawdown").alias("max_drawdown"), F.count("*").alias("trading_days"))


def rolling_returns(curve: DataFrame, window_days: int = 365, *by: str) -> DataFrame:
    """(*by, date, return): from each point to the first one at least window_days later; points without one are left out.

    Many curves (`by`) are dealt out. A single one goes in buckets of days, so that it isn't ordered in one task, however long:
    the points of a bucket and the days that are asked for in it meet in one order; where no point follows in the bucket,
    the first of the next bucket is taken, of which there is a row each.
    """
    if by:
        later = _curve_window(by).orderBy("_day").rangeBetween(window_days, Window.unboundedFollowing)
        found = curve.withColumn("_day", F.unix_date("date")).withColumn("_then", F.first("equity").over(later)).filter("_then is not null")
        return found.select(*by, "date", (F.col("_then") / F.col("equity") - 1).alias("return"))
    width = max(1, window_days)
    points = curve.select(F.unix_date("date").alias("_day"), F.col("equity").alias("_point"), F.lit(None).cast("date").alias("date"), F.lit(None).cast("double").alias("_from"))
    asked = curve.filter("date IS NOT NULL").select((F.unix_date("date") + window_days).alias("_day"), F.lit(None).cast("double").alias("_point"), "date", F.col("equity").alias("_from"))
    points = points.filter("_day IS NOT NULL").withColumn("_is_point", F.lit(True))
    both = points.unionByName(asked.withColumn("_is_point", F.lit(False))).withColumn("_bucket", F.floor(F.col("_day") / width))
    follows = Window.partitionBy("_bucket").orderBy("_day").rangeBetween(0, Window.unboundedFollowing)
    here = F.first(F.when(F.col("_is_point"), F.struct("_point")), ignorenulls=True).over(follows)
    firsts = both.groupBy("_bucket").agg(F.min_by(F.struct("_point"), F.when(F.col("_is_point"), F.col("_day"))).alias("_first"))
    later = F.first("_first", ignorenulls=True).over(_curve_window(()).orderBy("_bucket").rowsBetween(1, Window.unboundedFollowing))
    met = _beside(both.withColumn("_here", here).filter("NOT _is_point"), firsts.withColumn("_next", later), "_bucket", "_next")
    found = met.withColumn("_then", F.coalesce("_here", "_next")["_point"]).filter("_then IS NOT NULL")
    return found.select("date", (F.col("_then") / F.col("_from") - 1).alias("return"))


def distribution(returns: DataFrame, *by: str) -> DataFrame:
    """Windows, worst, p10, median, mean, p90, best and the share above zero, of all rows or of each group."""
    r = F.col("return")
    p = lambda x: F.percentile("return", x)
    figures = [F.count("*").alias("windows"), F.min(r).alias("worst"), p(0.1).alias("p10"), p(0.5).alias("median"), F.avg(r).alias("mean"), p(0.9).alias("p90"), F.max(r).alias("best"), F.avg((r > 0).cast("double")).alias("share_positive")]
    return returns.groupBy(*by).agg(*figures)
