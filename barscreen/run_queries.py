"""All presets, with costs and without, before and after a split date: one table of ledgers by run."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from barscreen.plans import backtest
from barscreen.queries import _BUY, _C, _N, _R, _SELL, IND, QUARANTINE, _ranked, _without_bars, config, indicators, preset, quarantine, query, rounded
from barscreen.sources import proxy

SPLIT = dt.date(1998, 6, 15)
_PRESETS = [preset(name) for name in sorted(config().presets)]
_CAPITAL = config().portfolio.capital
_PATH = "PARTITION BY net, symbol, signal_index"
_RANKED = ",\n".join(_ranked(p).replace("ranked AS", f"ranked_{p.name} AS") for p in _PRESETS)
_SIGNALS = " UNION ALL ".join(f"SELECT '{p.name}' AS preset, symbol, bar_index AS signal_index, trade_date AS signal_date, rank, CAST(atr AS DOUBLE) AS atr, median_turnover FROM ranked_{p.name} WHERE rank <= {p.basket_size}" for p in _PRESETS)
_GAIN = "h.quantity * h.exit_price * (1 - h.sell) - h.dp - h.cost_basis"
RUNS = f"""{IND},\n{_without_bars(QUARANTINE)},\n{_RANKED},
sig AS ({_SIGNALS}),
once AS (SELECT DISTINCT symbol, signal_index, atr, CASE WHEN median_turnover >= 5e8 THEN 10e0 WHEN median_turnover >= 1e8 THEN 20e0 WHEN median_turnover >= 2e7 THEN 40e0 ELSE 80e0 END AS tier FROM sig),
modes AS (SELECT symbol, signal_index, atr, net, CASE WHEN net THEN tier ELSE 0e0 END AS bps FROM once, (VALUES (true), (false)) AS v(net)),
way AS (SELECT s.*, i.bar_index - s.signal_index - 1 AS k, i.trade_date, i.open, i.low, i.close, CASE WHEN i.close < i.ema_50 THEN 1 ELSE 0 END AS below
    FROM modes s JOIN ind i ON i.symbol = s.symbol AND i.bar_index > s.signal_index AND i.bar_index <= s.signal_index + {_R.max_hold_days}),
way2 AS (SELECT *, first_value(open) OVER ({_PATH} ORDER BY k) * (1 + bps / 10000) AS entry, first_value(trade_date) OVER ({_PATH} ORDER BY k) AS entry_date, max(k) OVER ({_PATH}) AS time_k,
        max(close) OVER ({_PATH} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top0,
        k >= {_R.min_hold_days} AND sum(below) OVER ({_PATH} ORDER BY k ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) = 2 AS persistent FROM way),
way3 AS (SELECT *, coalesce(top0, entry) AS top FROM way2),
way4 AS (SELECT *, CASE WHEN top >= entry + 6 * atr THEN greatest(entry - 6 * atr, top - 8 * atr) ELSE entry - 6 * atr END AS stop FROM way3),
firsts AS (SELECT net, symbol, signal_index, min(k) FILTER (low <= stop) AS stop_k, min(k) FILTER (persistent) + 1 AS structural_k, max(time_k) AS time_k FROM way4 GROUP BY net, symbol, signal_index),
chosen AS (SELECT net, symbol, signal_index, least(stop_k, CASE WHEN structural_k <= time_k THEN structural_k END, time_k) AS k, stop_k FROM firsts),
ended AS (SELECT w.net, w.symbol, w.signal_index, entry_date, trade_date AS exit_date, entry AS entry_price, CASE WHEN c.k = stop_k THEN least(stop, open) ELSE open END * (1 - bps / 10000) AS exit_price, c.k + 1 AS hold_days
    FROM way4 w JOIN chosen c ON w.net = c.net AND w.symbol = c.symbol AND w.signal_index = c.signal_index AND w.k = c.k),
sided AS (SELECT *, 'whole' AS side FROM sig UNION ALL SELECT *, 'in_sample' FROM sig WHERE signal_date <= DATE '{SPLIT}' UNION ALL SELECT *, 'out_of_sample' FROM sig WHERE signal_date >= DATE '{SPLIT}'),
wanted AS (SELECT s.preset || '/' || s.side || '/' || CASE WHEN e.net THEN 'net' ELSE 'gross' END AS run, s.preset, s.side, e.net, s.rank, e.symbol, e.entry_date, e.exit_date, e.entry_price, e.exit_price, e.hold_days
    FROM sided s JOIN ended e ON s.symbol = e.symbol AND s.signal_index = e.signal_index),
days AS (SELECT run, d, row_number() OVER (PARTITION BY run ORDER BY d) AS i FROM (SELECT run, entry_date AS d FROM wanted UNION SELECT run, exit_date FROM wanted) AS x),
asked AS (SELECT run, entry_date AS d, list(struct_pack(symbol := symbol, exit_date := exit_date, entry_price := entry_price, exit_price := exit_price, hold_days := hold_days) ORDER BY rank, symbol) AS asks FROM wanted GROUP BY run, entry_date),
moments AS (SELECT days.run, i, days.d, coalesce(asks, []) AS asks FROM days LEFT JOIN asked ON days.run = asked.run AND days.d = asked.d),
known AS (SELECT run, preset, side, net, CASE WHEN net THEN {_BUY} ELSE 0e0 END AS buy, CASE WHEN net THEN {_SELL} ELSE 0e0 END AS sell, CASE WHEN net THEN {_C.dp_charge!r} ELSE 0e0 END AS dp FROM (SELECT DISTINCT run, preset, side, net FROM wanted) AS x),
fold AS (
    SELECT run, CAST(0 AS BIGINT) AS i, CAST(NULL AS DATE) AS d, {_CAPITAL!r}::DOUBLE AS equity, c AS held, c AS sold FROM known, (SELECT
        CAST([] AS STRUCT(symbol VARCHAR, entry_date DATE, exit_date DATE, entry_price DOUBLE, exit_price DOUBLE, quantity DOUBLE, cost_basis DOUBLE, buy_cost DOUBLE, hold_days BIGINT, sell DOUBLE, dp DOUBLE)[]) AS c) AS x
    UNION ALL
    SELECT run, i, d, entered + coalesce(list_sum(list_transform(list_filter(bought, lambda h: h.exit_date = d), lambda h: {_GAIN})), 0),
        list_concat(stay, list_filter(bought, lambda h: h.exit_date <> d)), list_concat(leaving, list_filter(bought, lambda h: h.exit_date = d))
    FROM (SELECT *, settled * power(1 - buy / {_N}, len(taken)) AS entered, list_transform(taken, lambda a, k: struct_pack(symbol := a.symbol, entry_date := d, exit_date := a.exit_date, entry_price := a.entry_price,
            exit_price := a.exit_price, quantity := settled / {_N} * power(1 - buy / {_N}, k - 1) / a.entry_price, cost_basis := settled / {_N} * power(1 - buy / {_N}, k - 1) * (1 + buy),
            buy_cost := settled / {_N} * power(1 - buy / {_N}, k - 1) * buy, hold_days := a.hold_days, sell := sell, dp := dp)) AS bought
        FROM (SELECT *, list_slice(list_filter(asks, lambda a: NOT list_contains(list_transform(stay, lambda h: h.symbol), a.symbol)), 1, {_N} - len(stay)) AS taken
            FROM (SELECT m.run, m.i, m.d, m.asks, n.buy, n.sell, n.dp, list_filter(f.held, lambda h: h.exit_date <> m.d) AS stay, list_filter(f.held, lambda h: h.exit_date = m.d) AS leaving,
                    f.equity + coalesce(list_sum(list_transform(list_filter(f.held, lambda h: h.exit_date = m.d), lambda h: {_GAIN})), 0) AS settled
                FROM fold f JOIN moments m ON m.run = f.run AND m.i = f.i + 1 JOIN known n ON n.run = f.run) AS x) AS y) AS z),
trades AS (SELECT run, h.exit_price / h.entry_price - 1 AS gross_return, h.cost_basis, h.quantity * h.exit_price AS exit_value, h.buy_cost + h.quantity * h.exit_price * h.sell + h.dp AS costs, ({_GAIN}) / h.cost_basis AS net_return, h.hold_days
    FROM (SELECT run, unnest(sold) AS h FROM fold) AS x),
t AS (SELECT run, count(*) AS trades, avg(gross_return) AS mean_gross_return, median(net_return) AS median_net_return, avg(net_return) AS mean_net_return, avg(CASE WHEN net_return > 0 THEN 1e0 ELSE 0e0 END) AS hit_rate, avg(hold_days) AS avg_hold_days,
    sum(cost_basis) + sum(exit_value) AS traded, sum(costs) AS total_costs FROM trades GROUP BY run),
c AS (SELECT run, max_by(equity, d) / {_CAPITAL!r} AS grown, min(equity / peak - 1) AS max_drawdown, CASE WHEN max(d) = min(d) THEN 1 ELSE date_diff('day', min(d), max(d)) END / 365.25 AS years
    FROM (SELECT *, max(equity) OVER (PARTITION BY run ORDER BY d) AS peak FROM fold WHERE i > 0) AS x GROUP BY run),
stats AS (SELECT n.preset, n.side, n.net, t.*, c.grown, c.max_drawdown, c.years FROM known n JOIN t ON t.run = n.run JOIN c ON c.run = n.run)"""


def _book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proxy.kept(spark, sf_dir, "book_of_runs", lambda: backtest.book_of_runs(indicators(spark, sf_dir), quarantine(spark, sf_dir), _PRESETS, config(), SPLIT))


_SHOWN = ("mean_gross_return", "median_net_return", "mean_net_return", "max_drawdown", "hit_rate", "avg_hold_days", "total_costs", "years")


@query(
    f"""WITH RECURSIVE {RUNS} SELECT a.preset, a.side, a.trades, {', '.join(f'round(a.{x}, 6) AS {x}' for x in _SHOWN)}, round(a.grown - 1, 6) AS total_return_net, round(power(a.grown, 1 / a.years) - 1, 6) AS cagr_net,
    round(a.traded / {_CAPITAL!r} / a.years, 6) AS turnover_x_per_year, b.trades AS trades_gross, round(b.grown - 1, 6) AS total_return_gross, round(b.grown - a.grown, 6) AS cost_drag_on_return
    FROM (FROM stats WHERE net) AS a JOIN (FROM stats WHERE NOT net) AS b ON a.preset = b.preset AND a.side = b.side"""
)
def walk_forward_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every preset and side, what costs took off, in sample and out of sample."""
    found = backtest.figures_of_runs(_book(spark, sf_dir), _CAPITAL)
    return rounded(found.select("preset", "side", "trades", *_SHOWN, "total_return_net", "cagr_net", "turnover_x_per_year", "trades_gross", "total_return_gross", "cost_drag_on_return"))
