"""The registered queries on bars, actions, screens and backtests, each with its DuckDB text where SQL can say it."""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barscreen.config import Config, Preset, load
from barscreen.functions import costs as charges
from barscreen.functions import text
from barscreen.operators import adjust, portfolio, recursive, screen, windows
from barscreen.plans import backtest, report
from barscreen.schemas import PRICES
from barscreen.sources import calendar, files, proxy

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
WARMUP = 200


@functools.cache
def config() -> Config:
    return load()


def preset(name: str) -> Preset:
    """A shipped preset with floors that fit the proxy bars, whose turnover is small."""
    return dataclasses.replace(config().presets[name], min_turnover=25_000.0, adx_min=min(config().presets[name].adx_min, 10.0))


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = proxy.oracle_text(sql)
        return f

    return register


def _plain_zero(x: Column) -> Column:
    return F.when(x == 0, 0.0).otherwise(x)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles and floats to so many places: engines add in different orders."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: _plain_zero(F.round(F.col(c).cast("double"), places)) for c, k in kinds.items() if k in ("double", "float")})


def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        return windows.narrowed(windows.with_windows(recursive.sequential(proxy.bars(spark, sf_dir), config().indicators), config().indicators))

    return proxy.kept(spark, sf_dir, "indicators", build)


# ---- oracle texts that several queries share ---------------------------------------------------------------------

_W = "OVER (PARTITION BY symbol ORDER BY trade_date)"


def _frame(first: int, last: int) -> str:
    end = "CURRENT ROW" if last == 0 else f"{last} PRECEDING"
    return f"OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN {first} PRECEDING AND {end})"


def _ema(name: str, period: int) -> str:
    return f"(1 - 2e0 / {period + 1}) * r.{name} + 2e0 / {period + 1} * b.close AS {name}"


def _smooth(old: str, new: str) -> str:
    return f"(1 - 1e0 / 14) * {old} + 1e0 / 14 * {new}"


SEQ = f"""{proxy.BARS},
b AS (SELECT *, row_number() {_W} AS n, lag(close) {_W} AS pc, high - lag(high) {_W} AS up, lag(low) {_W} - low AS down FROM bars),
steps AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, greatest(close - pc, 0) AS gain, greatest(pc - close, 0) AS loss,
        CASE WHEN up > down AND up > 0 THEN up ELSE 0e0 END AS rise, CASE WHEN down > up AND down > 0 THEN down ELSE 0e0 END AS fall FROM b),
r AS (SELECT symbol, n, close AS ema_20, close AS ema_50, close AS ema_100, close AS ema_200, CAST(NULL AS DOUBLE) AS ag, CAST(NULL AS DOUBLE) AS al,
        high - low AS atr, 0e0 AS plus, 0e0 AS minus, 0e0 AS adx FROM steps WHERE n = 1
    UNION ALL SELECT symbol, n, ema_20, ema_50, ema_100, ema_200, ag, al, atr, plus, minus,
        {_smooth("adx", "coalesce(100 * abs(100 * plus / nullif(atr, 0) - 100 * minus / nullif(atr, 0)) / nullif(100 * plus / nullif(atr, 0) + 100 * minus / nullif(atr, 0), 0), 0)")} AS adx
    FROM (SELECT b.symbol, b.n, {_ema("ema_20", 20)}, {_ema("ema_50", 50)}, {_ema("ema_100", 100)}, {_ema("ema_200", 200)},
            CASE WHEN r.ag IS NULL THEN b.gain ELSE {_smooth("r.ag", "b.gain")} END AS ag, CASE WHEN r.al IS NULL THEN b.loss ELSE {_smooth("r.al", "b.loss")} END AS al,
            {_smooth("r.atr", "b.tr")} AS atr, {_smooth("r.plus", "b.rise")} AS plus, {_smooth("r.minus", "b.fall")} AS minus, r.adx
        FROM r JOIN steps b ON b.symbol = r.symbol AND b.n = r.n + 1) AS x),
rsis AS (SELECT b.symbol, b.trade_date, b.open, b.high, b.low, b.close, b.volume, b.turnover, b.n, b.pc, b.tr, r.ema_20, r.ema_50, r.ema_100, r.ema_200, r.atr, r.adx,
        CASE WHEN r.ag + r.al = 0 THEN 50e0 ELSE 100 * r.ag / nullif(r.ag + r.al, 0) END AS rsi, ema_20 > ema_50 AND ema_50 > ema_100 AND ema_100 > ema_200 AS stack
    FROM steps b JOIN r ON b.symbol = r.symbol AND b.n = r.n),
islands AS (SELECT *, sum(CASE WHEN stack THEN 0 ELSE 1 END) {_W} AS island FROM rsis),
seq AS (SELECT *, CAST(sum(CASE WHEN stack THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, island ORDER BY trade_date) AS INTEGER) AS trend_age_days,
        CAST(CASE WHEN coalesce(count(close) {_frame(20, 1)} = 20 AND close > max(close) {_frame(20, 1)}, false)
            AND NOT coalesce(count(rsi) {_frame(20, 1)} = 20 AND rsi > max(rsi) {_frame(20, 1)}, false) THEN 1 ELSE 0 END AS TINYINT) AS rsi_divergence
    FROM islands)"""
_LOW, _HIGH = f"min(low) {_frame(13, 0)}", f"max(high) {_frame(13, 0)}"
IND = f"""{SEQ},
w1 AS (SELECT *, close / nullif(lag(close, 30) {_W}, 0) - 1 AS mom_short, close / nullif(lag(close, 126) {_W}, 0) - 1 AS mom_long, lag(close, 21) {_W} / nullif(lag(close, 147) {_W}, 0) - 1 AS mom_long_skip,
        volume / nullif(avg(volume) {_frame(20, 1)}, 0) AS vol_ratio, avg(volume) {_frame(4, 0)} / nullif(avg(volume) {_frame(49, 0)}, 0) AS vol_sustained, median(turnover) {_frame(20, 1)} AS median_turnover,
        max(high) {_frame(251, 0)} AS high_252, avg(CASE WHEN close > pc THEN 1 ELSE 0 END) {_frame(19, 0)} AS up_day_ratio, 100 * (close - {_LOW}) / nullif({_HIGH} - {_LOW}, 0) AS stoch_k FROM seq),
w2 AS (SELECT *, avg(stoch_k) {_frame(2, 0)} AS stoch_d, (close - ema_50) / nullif(atr, 0) AS ext_atr, close / nullif(high_252, 0) - 1 AS pct_from_high FROM w1),
w3 AS (SELECT *, (ext_atr - avg(ext_atr) {_frame(251, 0)}) / nullif(stddev_samp(ext_atr) {_frame(251, 0)}, 0) AS ext_zscore FROM w2),
ind AS (SELECT symbol, trade_date, open, high, low, close, volume, turnover, n AS bar_index, ema_20, ema_50, ema_100, ema_200, trend_age_days, rsi_divergence, median_turnover,
        {", ".join(f"CAST({c} AS FLOAT) AS {c}" for c in windows.NARROW)} FROM w3)"""


def _select(source: str, *columns: str, table: str | None = None) -> str:
    table = table or ("bars" if source is proxy.BARS else "seq" if source is SEQ else "ind")
    shown = ", ".join(c if c in ("symbol", "trade_date", "bar_index", "trend_age_days", "rsi_divergence", "rank") else f"round(CAST({c} AS DOUBLE), 6) + 0e0 AS {c}" for c in columns)
    return f"WITH {'RECURSIVE ' if source is not proxy.BARS else ''}{source} SELECT {shown} FROM {table}"


# ---- bars and windows --------------------------------------------------------------------------------------------


@query(f"WITH {proxy.BARS} SELECT symbol, trade_date, open, high, low, close, volume, turnover, trades FROM bars")
def bars_from_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proxy.bars(spark, sf_dir)


def _window_query(name: str, expression: Callable[[], dict], sql: str) -> None:
    """A query of one window column on the proxy bars."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = proxy.bars(spark, sf_dir).withColumns(expression())
        return rounded(made.select("symbol", "trade_date", *expression()))

    run.__name__ = name
    query(f"WITH {proxy.BARS} SELECT symbol, trade_date, {sql} FROM bars")(run)


_window_query("mom_short", lambda: {"mom_short": windows.momentum(30)}, f"round(close / nullif(lag(close, 30) {_W}, 0) - 1, 6) AS mom_short")
_window_query("mom_long", lambda: {"mom_long": windows.momentum(126)}, f"round(close / nullif(lag(close, 126) {_W}, 0) - 1, 6) AS mom_long")
_window_query("mom_long_skip", lambda: {"mom_long_skip": windows.momentum(126, 21)}, f"round(lag(close, 21) {_W} / nullif(lag(close, 147) {_W}, 0) - 1, 6) AS mom_long_skip")
_window_query("vol_ratio", lambda: {"vol_ratio": windows.vol_ratio(20)}, f"round(volume / nullif(avg(volume) {_frame(20, 1)}, 0), 6) AS vol_ratio")
_window_query("vol_sustained", lambda: {"vol_sustained": windows.vol_sustained(5, 50)}, f"round(avg(volume) {_frame(4, 0)} / nullif(avg(volume) {_frame(49, 0)}, 0), 6) AS vol_sustained")
_window_query("median_turnover", lambda: {"median_turnover": windows.median_turnover(20)}, f"round(median(turnover) {_frame(20, 1)}, 6) AS median_turnover")
_window_query("bar_index", lambda: {"bar_index": windows.bar_index()}, f"count(*) {_frame(1_000_000_000, 0)} AS bar_index")
_window_query("stoch_k", lambda: {"stoch_k": windows.stoch_k(14)}, f"round(100 * (close - {_LOW}) / nullif({_HIGH} - {_LOW}, 0), 6) AS stoch_k")


@query(f"WITH {proxy.BARS} SELECT symbol, trade_date, high_252, round(close / nullif(high_252, 0) - 1, 6) AS pct_from_high FROM (SELECT *, max(high) {_frame(251, 0)} AS high_252 FROM bars) AS x")
def high_252_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    high = F.max("high").over(windows.by_bar().rowsBetween(-251, 0))
    made = proxy.bars(spark, sf_dir).withColumn("high_252", high).withColumn("pct_from_high", F.col("close") / F.nullif(F.col("high_252"), F.lit(0.0)) - 1)
    return rounded(made.select("symbol", "trade_date", "high_252", "pct_from_high"))


@query(f"WITH {proxy.BARS} SELECT symbol, trade_date, prior_close, round(avg(CASE WHEN close > prior_close THEN 1 ELSE 0 END) {_frame(19, 0)}, 6) AS up_day_ratio FROM (SELECT *, lag(close) {_W} AS prior_close FROM bars) AS x")
def up_day_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = proxy.bars(spark, sf_dir).withColumn("prior_close", windows.prior_close())
    up = F.avg(F.when(F.col("close") > F.col("prior_close"), 1).otherwise(0)).over(windows.by_bar().rowsBetween(-19, 0))
    return rounded(made.select("symbol", "trade_date", "prior_close", up.alias("up_day_ratio")))


@query(f"WITH {proxy.BARS} SELECT symbol, trade_date, round(k, 6) AS stoch_k, round(avg(k) {_frame(2, 0)}, 6) AS stoch_d FROM (SELECT *, 100 * (close - {_LOW}) / nullif({_HIGH} - {_LOW}, 0) AS k FROM bars) AS x")
def stochastic(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = proxy.bars(spark, sf_dir).withColumn("stoch_k", windows.stoch_k(14))
    return rounded(made.select("symbol", "trade_date", "stoch_k", F.avg("stoch_k").over(windows.by_bar().rowsBetween(-2, 0)).alias("stoch_d")))


@query(
    f"WITH {proxy.BARS} SELECT symbol, trade_date, mom_short, rank FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY m DESC, symbol) AS rank, round(m, 6) AS mom_short"
    f" FROM (SELECT *, close / nullif(lag(close, 30) {_W}, 0) - 1 AS m, median(turnover) {_frame(20, 1)} AS t, row_number() {_W} AS n FROM bars) AS x WHERE n >= {WARMUP} AND t >= 25000 AND m IS NOT NULL) AS y WHERE rank <= 15"
)
def momentum_top15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: each session's 15 strongest names among those that are warm and liquid."""
    made = proxy.bars(spark, sf_dir).withColumns({"mom_short": windows.momentum(30), "median_turnover": windows.median_turnover(20), "bar_index": windows.bar_index()})
    passed = made.filter((F.col("bar_index") >= WARMUP) & (F.col("median_turnover") >= 25_000) & F.col("mom_short").isNotNull())
    order = windows.Window.partitionBy("trade_date").orderBy(F.col("mom_short").desc_nulls_last(), "symbol")
    return rounded(passed.withColumn("rank", F.row_number().over(order)).filter("rank <= 15").select("symbol", "trade_date", "mom_short", "rank"))


# ---- recursive indicators ----------------------------------------------------------------------------------------


def _sequence_query(name: str, *columns: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(recursive.sequential(proxy.bars(spark, sf_dir), config().indicators).select("symbol", "trade_date", *columns))

    run.__name__ = name
    query(_select(SEQ, "symbol", "trade_date", *columns))(run)


_sequence_query("ema_stack", "ema_20", "ema_50", "ema_100", "ema_200")
_sequence_query("rsi", "rsi")
_sequence_query("adx", "adx")
_sequence_query("trend_age", "trend_age_days")
_sequence_query("rsi_divergence", "rsi_divergence")


@query(f"WITH RECURSIVE {SEQ} SELECT symbol, trade_date, round(tr, 6) AS true_range, round(atr, 6) AS atr FROM seq")
def true_range_atr(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = recursive.smoothed(proxy.bars(spark, sf_dir), config().indicators)
    return rounded(made.select("symbol", "trade_date", windows.true_range().alias("true_range"), "atr"))


@query(_select(SEQ, "symbol", "trade_date", "ema_20", "ema_50", "ema_100", "ema_200", "rsi", "atr", "adx", "trend_age_days"))
def averages_by_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All recursive averages as a scan over chunks of bars, in built-in expressions."""
    made = recursive.sequential(proxy.bars(spark, sf_dir), config().indicators, long_symbols=True)
    return rounded(made.select("symbol", "trade_date", "ema_20", "ema_50", "ema_100", "ema_200", "rsi", "atr", "adx", "trend_age_days"))


@query(f"WITH RECURSIVE {IND} SELECT symbol, trade_date, round(ext_atr, 5) AS ext_atr, round(ext_zscore, 5) AS ext_zscore FROM w3")
def ext_atr_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = windows.with_windows(recursive.sequential(proxy.bars(spark, sf_dir), config().indicators), config().indicators)
    return rounded(made.select("symbol", "trade_date", "ext_atr", "ext_zscore"), 5)


# ---- screens -----------------------------------------------------------------------------------------------------

VERDICTS = f"""{proxy.RAW},
parsed AS (SELECT symbol, ex_date, product(adj_factor) AS parsed FROM actions WHERE adj_factor IS NOT NULL GROUP BY symbol, ex_date),
gap AS (SELECT p.symbol, p.ex_date, p.parsed, r.prev_close / nullif(r.open, 0) AS observed FROM parsed p LEFT JOIN raw r ON r.symbol = p.symbol AND r.trade_date = p.ex_date),
verdicts AS (SELECT *, abs(parsed / observed - 1) AS deviation, CASE WHEN observed IS NULL THEN 'unverified' WHEN abs(parsed / observed - 1) <= 0.1 THEN 'verified' ELSE 'mismatch' END AS verification FROM gap)"""
QUARANTINE = f"""{VERDICTS},
quarantine AS (SELECT DISTINCT a.symbol, CAST(a.ex_date - INTERVAL 5 DAY AS DATE) AS from_date, CAST(a.ex_date + INTERVAL 250 DAY AS DATE) AS to_date,
        CASE WHEN action_type = 'demerger' THEN 'demerger' ELSE '{adjust.MISMATCH}' END AS reason
    FROM actions a LEFT JOIN verdicts v ON a.symbol = v.symbol AND a.ex_date = v.ex_date AND a.adj_factor IS NOT NULL WHERE action_type = 'demerger' OR v.verification = 'mismatch')"""


def _without_bars(sql: str) -> str:
    """A chain of CTEs that another one, with the bars, goes before."""
    return sql.removeprefix(proxy.BARS + ",\n")


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = proxy.made(spark, sf_dir, proxy.ACTIONS, "actions")
    nothing = F.lit(None)
    return made.withColumns({"observed": nothing.cast("double"), "deviation": nothing.cast("double"), "verification": F.lit("pending")})


def raw_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proxy.made(spark, sf_dir, proxy.RAW, "raw")


def verified_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proxy.kept(spark, sf_dir, "verified", lambda: adjust.verified(actions(spark, sf_dir), raw_prices(spark, sf_dir), config().actions))


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proxy.kept(spark, sf_dir, "quarantine", lambda: adjust.quarantined(verified_actions(spark, sf_dir), config().actions))


def _conditions(p: Preset) -> str:
    """The same rules once more, as text for the oracle."""
    rules = [f"bar_index >= {WARMUP}", f"rsi BETWEEN {p.rsi_min} AND {p.rsi_max}"]
    rules += ["ema_20 > ema_50 AND ema_50 > ema_100 AND ema_100 > ema_200"] * p.require_ema_stack + ["close > greatest(ema_20, ema_50, ema_200)"] * p.require_close_above
    rules += [f"adx > {p.adx_min}"] * (p.adx_min > 0) + [f"close > {p.min_close}"] * (p.min_close > 0)
    rules.append(f"{'median_turnover' if p.liquidity_mode == 'median' else 'close * volume'} >= {p.min_turnover}")
    rules += [f"stoch_k <= {p.max_stoch_k}"] * (p.max_stoch_k is not None)
    rules += [f"{'vol_sustained' if p.volume_metric == 'sustained' else 'vol_ratio'} >= CAST({p.volume_min_ratio} AS FLOAT)"] * (p.volume_mode == "gate")
    return " AND ".join([*rules, f"{p.rank_by} IS NOT NULL"])


def _ranked(p: Preset) -> str:
    return f"""ranked AS (SELECT i.*, row_number() OVER (PARTITION BY trade_date ORDER BY {p.rank_by} DESC, symbol) AS rank FROM ind i WHERE {_conditions(p)}
        AND NOT EXISTS (SELECT 1 FROM quarantine q WHERE q.symbol = i.symbol AND i.trade_date BETWEEN q.from_date AND q.to_date))"""


_SHOWN = ("close", "rsi", "adx", "mom_short", "mom_long_skip", "stoch_k", "vol_ratio", "vol_sustained", "median_turnover")


def _screen_query(name: str) -> None:
    p = preset(name)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = screen.screened(indicators(spark, sf_dir), quarantine(spark, sf_dir), p, WARMUP, p.basket_size)
        return rounded(found.select("trade_date", "rank", "symbol", *_SHOWN), 4)

    run.__name__ = f"screen_{name}"
    shown = ", ".join(f"round(CAST({c} AS DOUBLE), 4) + 0e0 AS {c}" for c in _SHOWN)
    query(f"WITH RECURSIVE {IND},\n{_without_bars(QUARANTINE)},\n{_ranked(p)} SELECT trade_date, rank, symbol, {shown} FROM ranked WHERE rank <= {p.basket_size}")(run)


for _name in ("trend", "pullback", "breakout", "baseline"):
    _screen_query(_name)


@query(f"WITH {QUARANTINE} SELECT symbol, trade_date, close FROM bars b WHERE NOT EXISTS (SELECT 1 FROM quarantine q WHERE q.symbol = b.symbol AND b.trade_date BETWEEN q.from_date AND q.to_date)")
def quarantine_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.outside_quarantine(proxy.bars(spark, sf_dir).select("symbol", "trade_date", "close"), quarantine(spark, sf_dir))


@query(f"WITH {QUARANTINE} SELECT symbol, from_date, to_date, reason FROM quarantine")
def quarantine_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quarantine(spark, sf_dir)


# ---- corporate actions -------------------------------------------------------------------------------------------


@query(f"WITH {VERDICTS} SELECT symbol, ex_date, round(parsed, 6) AS parsed FROM parsed")
def action_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(adjust.action_products(actions(spark, sf_dir)))


@query(f"WITH {VERDICTS} SELECT symbol, ex_date, round(parsed, 6) AS parsed, round(observed, 6) AS observed, round(deviation, 6) AS deviation, verification FROM verdicts")
def verify_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(adjust.verdicts(actions(spark, sf_dir), raw_prices(spark, sf_dir), config().actions))


SPANS = f"""{VERDICTS},
cumulative AS (SELECT symbol, ex_date, product(parsed) OVER (PARTITION BY symbol ORDER BY ex_date DESC ROWS UNBOUNDED PRECEDING) AS f,
        coalesce(lag(ex_date) OVER (PARTITION BY symbol ORDER BY ex_date), DATE '{adjust.FAR_PAST}') AS start_date FROM verdicts WHERE verification = 'verified'),
spans AS (SELECT symbol, start_date, ex_date AS end_date, f AS cum_factor FROM cumulative WHERE f <> 1
    UNION ALL SELECT symbol, max(ex_date), DATE '{adjust.FAR_FUTURE}', 1e0 FROM cumulative GROUP BY symbol)"""


@query(f"WITH {SPANS} SELECT symbol, start_date, end_date, round(cum_factor, 6) AS cum_factor FROM spans")
def adj_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(adjust.intervals(verified_actions(spark, sf_dir)))


@query(
    f"WITH {SPANS} SELECT r.symbol, trade_date, {', '.join(f'round({c} / coalesce(cum_factor, 1), 6) AS {c}' for c in ('open', 'high', 'low', 'close', 'prev_close'))},"
    " CAST(round(volume * coalesce(cum_factor, 1)) AS BIGINT) AS volume, turnover, trades FROM raw r LEFT JOIN spans s ON r.symbol = s.symbol AND trade_date >= start_date AND trade_date < end_date"
)
def prices_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(adjust.adjusted(raw_prices(spark, sf_dir), adjust.intervals(verified_actions(spark, sf_dir))))


# ---- reports -----------------------------------------------------------------------------------------------------


@query(
    f"""WITH RECURSIVE {IND},\n{_without_bars(QUARANTINE)},\n{_ranked(preset("breakout"))}, dated AS (SELECT max(trade_date) AS d FROM ranked)
    SELECT rank, symbol, {", ".join(f"round(CAST({c} AS DOUBLE), 4) + 0e0 AS {c}" for c in report.SHORTLIST_COLUMNS[2:10])}, trend_age_days,
        {", ".join(f"round(CAST({c} AS DOUBLE), 4) + 0e0 AS {c}" for c in ("up_day_ratio",))}, rsi_divergence, {", ".join(f"round(CAST({c} AS DOUBLE), 4) + 0e0 AS {c}" for c in report.SHORTLIST_COLUMNS[13:19])},
        round(close - 6 * CAST(atr AS DOUBLE), 4) AS suggested_stop FROM ranked, dated WHERE trade_date = d AND rank <= 15"""
)
def shortlist_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The basket of the last session that has one."""
    found, shut, p = indicators(spark, sf_dir), quarantine(spark, sf_dir), preset("breakout")
    day = screen.screened(found, shut, p, WARMUP, 1).agg(F.max("trade_date")).first()[0]
    return rounded(report.shortlist(found, shut, p, config().rules, WARMUP, day), 4)


@query(
    f"""WITH RECURSIVE {IND},\n{_without_bars(proxy.POSITIONS)}, today AS (SELECT max(trade_date) AS d FROM ind),
    held AS (SELECT p.position_id, p.symbol, p.entry_date, p.entry_price, p.quantity, CAST(i.atr AS DOUBLE) AS atr FROM positions p JOIN ind i ON i.symbol = p.symbol AND i.trade_date = p.entry_date WHERE exit_date IS NULL),
    told AS (SELECT h.position_id, h.symbol, h.entry_date, h.entry_price, h.quantity, h.atr, max(CASE WHEN trade_date = d THEN close END) AS last_close, max(close) AS peak_close, count(*) AS bars_held,
            max(CASE WHEN trade_date = d THEN ema_50 END) AS trend FROM held h JOIN ind i ON i.symbol = h.symbol AND i.trade_date >= h.entry_date, today WHERE i.trade_date <= d GROUP BY ALL),
    stops AS (SELECT *, entry_price - 6 * atr AS initial_stop, CASE WHEN peak_close >= entry_price + 6 * atr THEN peak_close - 8 * atr END AS trailing_stop FROM told)
    SELECT position_id, symbol, entry_date, round(entry_price, 4) AS entry_price, quantity, last_close, peak_close, bars_held, round(initial_stop, 4) AS initial_stop, round(trailing_stop, 4) AS trailing_stop,
        round(last_close / entry_price - 1, 4) AS unrealised_return, CASE WHEN last_close <= initial_stop THEN 'EXIT: initial stop' WHEN last_close <= trailing_stop THEN 'EXIT: trailing stop'
        WHEN bars_held >= 60 THEN 'EXIT: time stop' WHEN last_close < trend AND bars_held >= 60 THEN 'WATCH: below trend EMA' ELSE 'HOLD' END AS action FROM stops"""
)
def position_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = indicators(spark, sf_dir)
    held = proxy.made(spark, sf_dir, proxy.POSITIONS, "positions")
    return rounded(report.position_status(held, found, config().rules, config().indicators.ema_mid, report.latest_date(proxy.bars(spark, sf_dir))), 4)


@query(
    f"WITH {proxy.BARS}, d AS (SELECT max(trade_date) AS d FROM bars), c AS (SELECT trade_date, count(*) AS n FROM bars GROUP BY trade_date)"
    " SELECT (SELECT n FROM c, d WHERE trade_date = d) AS rows, (SELECT median(n) FROM c, d WHERE trade_date < d AND trade_date >= d - INTERVAL 40 DAY) AS median_rows"
)
def health_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = proxy.bars(spark, sf_dir)
    return report.session_counts(bars, report.latest_date(bars))


@query("SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, CAST(l_shipdate AS DATE) HAVING count(*) > 1) AS x")
def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, parts = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "part"))
    raw = lines.join(parts, lines.l_partkey == parts.p_partkey).select(F.col("p_brand").alias("symbol"), F.col("l_shipdate").cast("date").alias("trade_date"))
    return report.duplicate_rows(raw)


@query(f"WITH {proxy.BARS} SELECT count(*) AS bars, count(DISTINCT symbol) AS symbols, count(DISTINCT trade_date) AS sessions, min(trade_date) AS first_date, max(trade_date) AS latest_date FROM bars")
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.summary(proxy.bars(spark, sf_dir))


@query(f"WITH {VERDICTS} SELECT verification, count(*) AS rows FROM verdicts GROUP BY verification")
def verification_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.counts_by(adjust.verdicts(actions(spark, sf_dir), raw_prices(spark, sf_dir), config().actions), "verification")


@query(f"WITH {proxy.BARS} SELECT symbol, max(trade_date) AS last_seen FROM bars WHERE symbol LIKE '%BRAND#1%' OR upper(symbol) LIKE '%BRAND#1%' GROUP BY symbol ORDER BY (symbol = 'BRAND#1') DESC, symbol LIMIT 25")
def symbol_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = proxy.bars(spark, sf_dir).withColumn("symbol", F.upper("symbol"))
    found = report.search_symbols(bars, "Brand#1")
    return found.withColumn("symbol", F.concat(F.lit("Brand"), F.substring("symbol", 6, 20)))


@query(f"WITH {proxy.BARS} SELECT DISTINCT trade_date FROM bars ORDER BY trade_date DESC LIMIT 120")
def dates_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.recent_dates(proxy.bars(spark, sf_dir))


@query(f"WITH RECURSIVE {IND}, one AS (SELECT min(symbol) AS s FROM ind) SELECT trade_date, {', '.join(f'round(CAST({c} AS DOUBLE), 4) AS {c}' for c in ('close', 'ema_20', 'ema_200', 'rsi', 'adx', 'atr'))}, trend_age_days FROM ind, one WHERE symbol = s ORDER BY trade_date DESC LIMIT 260")
def symbol_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = proxy.bars(spark, sf_dir).agg(F.min("symbol")).first()[0]
    found = indicators(spark, sf_dir).filter(F.col("symbol") == first).withColumn("symbol", F.upper("symbol"))
    return rounded(report.symbol_bars(found, first).select("trade_date", "close", "ema_20", "ema_200", "rsi", "adx", "atr", "trend_age_days"), 4)


# ---- costs, exits, portfolio -------------------------------------------------------------------------------------


@query(f"WITH {proxy.BARS} SELECT symbol, trade_date, CASE WHEN t >= 5e8 THEN 10e0 WHEN t >= 1e8 THEN 20e0 WHEN t >= 2e7 THEN 40e0 ELSE 80e0 END AS slippage_bps FROM (SELECT *, turnover * 1000 AS t FROM bars) AS x")
def slippage_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = proxy.bars(spark, sf_dir)
    return bars.select("symbol", "trade_date", charges.slippage_bps(config().costs, F.col("turnover") * 1000).alias("slippage_bps"))


@query(
    "SELECT o_orderkey, round(v * (0.0000297 + 0.000001) * 1.18 + v * 0.001 + v * 0.00015, 4) AS buy_cost, round(v * (0.0000297 + 0.000001) * 1.18 + v * 0.001 + 15.93, 4) AS sell_cost,"
    " round(v * 1.004, 4) AS bought_at, round(v * 0.996, 4) AS sold_at FROM (SELECT o_orderkey, o_totalprice AS v FROM orders) AS x"
)
def buy_sell_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, v = config().costs, F.col("o_totalprice")
    made = {"buy_cost": charges.buy_costs(c, v), "sell_cost": charges.sell_costs(c, v), "bought_at": charges.slipped(c, v, F.lit(40.0), "buy"), "sold_at": charges.slipped(c, v, F.lit(40.0), "sell")}
    return rounded(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", *[x.alias(k) for k, x in made.items()]), 4)


BACKTEST = "trend"
_P, _R = preset(BACKTEST), load().rules
_PATH = "PARTITION BY symbol, signal_index"
OUTCOMES = f"""{IND},\n{_without_bars(QUARANTINE)},\n{_ranked(_P)},
sig AS (SELECT symbol, bar_index AS signal_index, trade_date AS signal_date, rank, CAST(atr AS DOUBLE) AS atr, median_turnover,
        CASE WHEN median_turnover >= 5e8 THEN 10e0 WHEN median_turnover >= 1e8 THEN 20e0 WHEN median_turnover >= 2e7 THEN 40e0 ELSE 80e0 END AS bps FROM ranked WHERE rank <= {_P.basket_size}),
way AS (SELECT s.*, i.bar_index - s.signal_index - 1 AS k, i.trade_date, i.open, i.low, i.close, CASE WHEN i.close < i.ema_50 THEN 1 ELSE 0 END AS below
    FROM sig s JOIN ind i ON i.symbol = s.symbol AND i.bar_index > s.signal_index AND i.bar_index <= s.signal_index + {_R.max_hold_days}),
way2 AS (SELECT *, first_value(open) OVER ({_PATH} ORDER BY k) * (1 + bps / 10000) AS entry, first_value(trade_date) OVER ({_PATH} ORDER BY k) AS entry_date, max(k) OVER ({_PATH}) AS time_k,
        max(close) OVER ({_PATH} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top0,
        k >= {_R.min_hold_days} AND sum(below) OVER ({_PATH} ORDER BY k ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) = 2 AS persistent FROM way),
way3 AS (SELECT *, coalesce(top0, entry) AS top FROM way2),
way4 AS (SELECT *, CASE WHEN top >= entry + 6 * atr THEN greatest(entry - 6 * atr, top - 8 * atr) ELSE entry - 6 * atr END AS stop FROM way3),
firsts AS (SELECT symbol, signal_index, min(k) FILTER (low <= stop) AS stop_k, min(k) FILTER (persistent) + 1 AS structural_k, max(time_k) AS time_k FROM way4 GROUP BY symbol, signal_index),
chosen AS (SELECT symbol, signal_index, least(stop_k, CASE WHEN structural_k <= time_k THEN structural_k END, time_k) AS k, stop_k, structural_k, time_k FROM firsts),
outcomes AS (SELECT w.symbol, w.signal_index, w.signal_date, w.rank, entry_date, trade_date AS exit_date, entry AS entry_price, CASE WHEN c.k = stop_k THEN least(stop, open) ELSE open END * (1 - bps / 10000) AS exit_price, c.k + 1 AS hold_days,
        CASE WHEN c.k = stop_k THEN 'stop' WHEN c.k = structural_k THEN 'structural' WHEN c.time_k < {_R.max_hold_days - 1} THEN 'data_end' ELSE 'time' END AS exit_reason, w.bps
    FROM way4 w JOIN chosen c ON w.symbol = c.symbol AND w.signal_index = c.signal_index AND w.k = c.k)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = indicators(spark, sf_dir)
    signals = backtest.signals(found, quarantine(spark, sf_dir), _P, WARMUP)
    return backtest.candidates(signals, found, config(), config().costs)


@query(
    f"""WITH RECURSIVE {OUTCOMES} SELECT symbol, signal_index, signal_date, rank, entry_date, exit_date, round(entry_price, 4) AS entry_price, round(exit_price, 4) AS exit_price,
    round(exit_price / entry_price - 1, 4) AS gross_return, hold_days, exit_reason, bps AS slippage_bps FROM outcomes"""
)
def exit_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_candidates(spark, sf_dir).drop("median_turnover"), 4)


@query(
    f"""WITH RECURSIVE {OUTCOMES} SELECT exit_reason, count(*) AS trades, round(avg(exit_price / entry_price - 1), 6) AS mean_net, round(avg(CASE WHEN exit_price > entry_price THEN 1e0 ELSE 0e0 END), 6) AS hit_rate,
    round(avg(hold_days), 6) AS mean_hold FROM outcomes GROUP BY exit_reason"""
)
def exit_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.exit_breakdown(_candidates(spark, sf_dir).withColumn("net_return", F.col("gross_return"))))


def _book(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = config().portfolio

    def build() -> DataFrame:
        return portfolio.ledger(_candidates(spark, sf_dir), p.slots, p.capital, config().costs)

    return proxy.kept(spark, sf_dir, "book", build)


_C, _N = load().costs, load().portfolio.slots
#: What one amount costs, as shares of it (the configured brokerage is nothing), and the flat part of a sale.
_BUY = f"(({_C.exchange_txn_pct!r} + {_C.sebi_turnover_pct!r}) * (1 + {_C.gst_pct!r}) + {_C.stt_buy_pct!r} + {_C.stamp_duty_buy_pct!r})"
_SELL = f"(({_C.exchange_txn_pct!r} + {_C.sebi_turnover_pct!r}) * (1 + {_C.gst_pct!r}) + {_C.stt_sell_pct!r})"
_PROFIT = f"h.quantity * h.exit_price * (1 - {_SELL}) - {_C.dp_charge!r} - h.cost_basis"
#: The ledger as a recursion over dates: a row holds the equity, the positions and what was sold on the date. Each entry
#: of a date gets a slot's part of what the entry before has left, a geometric row.
FOLD = f"""{OUTCOMES},
days AS (SELECT d, row_number() OVER (ORDER BY d) AS i FROM (SELECT entry_date AS d FROM outcomes UNION SELECT exit_date FROM outcomes) AS x),
asked AS (SELECT entry_date AS d, list(struct_pack(symbol := symbol, exit_date := exit_date, entry_price := entry_price, exit_price := exit_price, exit_reason := exit_reason, hold_days := hold_days) ORDER BY rank, symbol) AS asks
    FROM outcomes GROUP BY entry_date),
moments AS (SELECT i, days.d, coalesce(asks, []) AS asks FROM days LEFT JOIN asked ON days.d = asked.d),
fold AS (
    SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS DATE) AS d, {load().portfolio.capital!r}::DOUBLE AS equity, c AS held, c AS sold FROM (SELECT
        CAST([] AS STRUCT(symbol VARCHAR, entry_date DATE, exit_date DATE, entry_price DOUBLE, exit_price DOUBLE, quantity DOUBLE, cost_basis DOUBLE, buy_cost DOUBLE, exit_reason VARCHAR, hold_days BIGINT)[]) AS c) AS x
    UNION ALL
    SELECT i, d, entered + coalesce(list_sum(list_transform(list_filter(bought, lambda h: h.exit_date = d), lambda h: {_PROFIT})), 0),
        list_concat(stay, list_filter(bought, lambda h: h.exit_date <> d)), list_concat(leaving, list_filter(bought, lambda h: h.exit_date = d))
    FROM (SELECT *, settled * power(1 - {_BUY} / {_N}, len(taken)) AS entered, list_transform(taken, lambda a, k: struct_pack(symbol := a.symbol, entry_date := d, exit_date := a.exit_date, entry_price := a.entry_price,
            exit_price := a.exit_price, quantity := settled / {_N} * power(1 - {_BUY} / {_N}, k - 1) / a.entry_price, cost_basis := settled / {_N} * power(1 - {_BUY} / {_N}, k - 1) * (1 + {_BUY}),
            buy_cost := settled / {_N} * power(1 - {_BUY} / {_N}, k - 1) * {_BUY}, exit_reason := a.exit_reason, hold_days := a.hold_days)) AS bought
        FROM (SELECT *, list_slice(list_filter(asks, lambda a: NOT list_contains(list_transform(stay, lambda h: h.symbol), a.symbol)), 1, {_N} - len(stay)) AS taken
            FROM (SELECT m.i, m.d, m.asks, list_filter(f.held, lambda h: h.exit_date <> m.d) AS stay, list_filter(f.held, lambda h: h.exit_date = m.d) AS leaving,
                    f.equity + coalesce(list_sum(list_transform(list_filter(f.held, lambda h: h.exit_date = m.d), lambda h: {_PROFIT})), 0) AS settled
                FROM fold f JOIN moments m ON m.i = f.i + 1) AS x) AS y) AS z),
trades AS (SELECT h.*, h.exit_price / h.entry_price - 1 AS gross_return, h.quantity * h.exit_price AS exit_value, h.quantity * h.exit_price * {_SELL} + {_C.dp_charge!r} AS sell_cost, {_PROFIT} AS net_profit
    FROM (SELECT unnest(sold) AS h FROM fold) AS x),
curve AS (SELECT d AS date, equity, CAST(len(held) AS INTEGER) AS open_positions FROM fold WHERE i > 0)"""
_AMOUNTS = ("entry_price", "exit_price", "quantity", "cost_basis", "buy_cost", "gross_return", "exit_value", "sell_cost", "net_profit")


@query(
    f"""WITH RECURSIVE {FOLD} SELECT symbol, entry_date, exit_date, {', '.join(f'round({c}, 4) AS {c}' for c in _AMOUNTS)}, round(net_profit / cost_basis, 4) AS net_return,
    exit_reason, CAST(hold_days AS INTEGER) AS hold_days FROM trades"""
)
def slot_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.trades_of(_book(spark, sf_dir)), 4)


@query(f"WITH RECURSIVE {FOLD} SELECT date, round(equity, 4) AS equity, open_positions FROM curve")
def equity_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.curve_of(_book(spark, sf_dir)), 4)


@query(
    f"""WITH RECURSIVE {FOLD}, n AS (SELECT *, net_profit / cost_basis AS net FROM trades),
    t AS (SELECT count(*) AS trades, avg(gross_return) AS mean_gross_return, median(net) AS median_net_return, avg(net) AS mean_net_return, avg(CASE WHEN net > 0 THEN 1e0 ELSE 0e0 END) AS hit_rate,
        coalesce(avg(net) FILTER (net > 0), 0) AS avg_win, coalesce(avg(net) FILTER (net <= 0), 0) AS avg_loss, avg(hold_days) AS avg_hold_days, sum(cost_basis) + sum(exit_value) AS traded, sum(buy_cost) + sum(sell_cost) AS total_costs FROM n),
    c AS (SELECT max_by(equity, date) / {load().portfolio.capital!r} AS grown, min(equity / peak - 1) AS max_drawdown, CASE WHEN max(date) = min(date) THEN 1 ELSE date_diff('day', min(date), max(date)) END / 365.25 AS years
        FROM (SELECT *, max(equity) OVER (ORDER BY date) AS peak FROM curve) AS x)
    SELECT trades, {', '.join(f'round({x}, 6) AS {k}' for k, x in {
        'total_return_net': 'grown - 1', 'cagr_net': 'power(grown, 1 / years) - 1', 'mean_gross_return': 'mean_gross_return', 'median_net_return': 'median_net_return', 'mean_net_return': 'mean_net_return', 'max_drawdown': 'max_drawdown',
        'hit_rate': 'hit_rate', 'avg_win': 'avg_win', 'avg_loss': 'avg_loss', 'win_loss_ratio': 'avg_win / abs(nullif(avg_loss, 0))', 'avg_hold_days': 'avg_hold_days',
        'turnover_x_per_year': f'traded / {load().portfolio.capital!r} / years', 'total_costs': 'total_costs', 'cost_drag_pct_of_capital': f'total_costs / {load().portfolio.capital!r}', 'cost_drag_per_trade': 'total_costs / trades', 'years': 'years'}.items())} FROM t, c"""
)
def portfolio_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = _book(spark, sf_dir)
    return rounded(portfolio.statistics(portfolio.trades_of(book), portfolio.curve_of(book), config().portfolio.capital))


def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every symbol's closes as an equity curve of its own."""
    return proxy.bars(spark, sf_dir).select("symbol", F.col("trade_date").alias("date"), F.col("close").alias("equity"))


_CURVE = f"{proxy.BARS}, curve AS (SELECT symbol, trade_date AS date, close AS equity FROM bars)"


@query(
    f"""WITH {_CURVE}, d AS (SELECT *, year(date) AS y, equity / max(equity) OVER (PARTITION BY symbol, year(date) ORDER BY date) - 1 AS dd FROM curve)
    SELECT symbol, CAST(y AS INTEGER) AS year, round(max_by(equity, date) / min_by(equity, date) - 1, 6) AS return, round(min(dd), 6) AS max_drawdown, count(*) AS trading_days FROM d GROUP BY symbol, y"""
)
def yearly_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.yearly_returns(_curve(spark, sf_dir), "symbol"))


_ROLLED = f"""{_CURVE}, rolled AS (SELECT a.symbol, a.date, b.equity / a.equity - 1 AS r
    FROM curve a ASOF JOIN curve b ON a.symbol = b.symbol AND a.date + INTERVAL 365 DAY <= b.date)"""


@query(f"WITH {_ROLLED} SELECT symbol, date, round(r, 6) AS return FROM rolled WHERE r IS NOT NULL")
def rolling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.rolling_returns(_curve(spark, sf_dir), 365, "symbol"))


@query(
    f"""WITH {_ROLLED} SELECT symbol, count(*) AS windows, round(min(r), 6) AS worst, round(quantile_cont(r, 0.1), 6) AS p10, round(median(r), 6) AS median, round(avg(r), 6) AS mean,
    round(quantile_cont(r, 0.9), 6) AS p90, round(max(r), 6) AS best, round(avg(CASE WHEN r > 0 THEN 1e0 ELSE 0e0 END), 6) AS share_positive FROM rolled WHERE r IS NOT NULL GROUP BY symbol"""
)
def distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.distribution(portfolio.rolling_returns(_curve(spark, sf_dir), 365, "symbol"), "symbol"))


# ---- files of both layouts ---------------------------------------------------------------------------------------

#: A whole row, a blank close, a row that ends before its close, another series, an excluded name, another instrument.
UDIFF_LINES = (
    "TradDt,TckrSymb,SctySrs,FinInstrmTp,ISIN,OpnPric,HghPric,LwPric,ClsPric,PrvsClsgPric,TtlTradgVol,TtlTrfVal,TtlNbOfTxsExctd",
    "2024-03-01,AAA,EQ,STK,IN1,10,11,9,10.5,10,1000,10500.5,12", "2024-03-01,BBB,EQ,STK,IN2,20,-,19,, ,2000,41000,", "2024-03-01,CCC,EQ,STK,IN3,1,2,1", "2024-03-01,DDD,BE,STK,IN4,1,1,1,1,1,1,1,1",
    "2024-03-01,EEE-RE,EQ,STK,IN5,1,1,1,1,1,1,1,1", "2024-03-01,FFF,EQ,IDX,IN6,1,1,1,1,1,1,1,1",
)
LEGACY_LINES = (
    "SYMBOL,SERIES,OPEN,HIGH,LOW,CLOSE,LAST,PREVCLOSE,TOTTRDQTY,TOTTRDVAL,TIMESTAMP,TOTALTRADES,ISIN,",
    "AAA,EQ,10,11,9,10.5,10.4,10,1000,10500.5,01-MAR-2024,12,IN1,", "BBB,EQ,20,-,19,,20,,2000,41000,01-Mar-24,,,", "CCC,EQ,1,2", "EEE-RE,EQ,1,1,1,1,1,1,1,1,01-MAR-2024,1,IN5,", "GGG,SM,1,1,1,1,1,1,1,1,01-MAR-2024,1,IN7,",
)


def _fields(lines: tuple[str, ...], columns: dict[str, str], layout: str, day: str, short: str) -> str:
    """SQL that reads the lines by the places of their columns; the universe is series EQ, instrument STK, no -RE names."""
    places = {n.strip(): k + 1 for k, n in enumerate(lines[0].split(","))}
    f = lambda c: f"nullif(trim(f[{places[columns[c]]}]), '')"
    numbers = ", ".join(f"TRY_CAST({f(c)} AS DOUBLE) AS {c}" for c in ("open", "high", "low", "close", "prev_close", "turnover"))
    wholes = ", ".join(f"CAST(TRY_CAST({f(c)} AS DOUBLE) AS BIGINT) AS {c}" for c in ("volume", "trades"))
    kind = f" AND f[{places['FinInstrmTp']}] = 'STK'" if "FinInstrmTp" in places else ""
    return f"""SELECT '{layout}' AS layout, {f('symbol')} AS symbol, CAST({day.format(f('trade_date'))} AS DATE) AS trade_date, {f('isin')} AS isin, {f('series')} AS series, {numbers}, {wholes}
        FROM (SELECT string_split(line, ',') AS f FROM (VALUES {', '.join(f"('{x}')" for x in lines[1:])}) AS v(line)) AS x
        WHERE len(f) >= {places[short]} AND {f('series')} = 'EQ' AND NOT regexp_matches({f('symbol')}, '-RE[0-9]*$'){kind}"""


@query(
    f"""{_fields(UDIFF_LINES, files.UDIFF, 'udiff', '{}', 'ClsPric')} UNION ALL
    {_fields(LEGACY_LINES, files.LEGACY, 'legacy', "CASE WHEN length({0}) = 11 THEN try_strptime({0}, '%d-%b-%Y') ELSE try_strptime({0}, '%d-%b-%y') END", 'CLOSE')}"""
)
def bar_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both layouts out of literal lines: short rows go, blank closes stay."""
    texts = [(layout, "\n".join(lines)) for layout, lines in (("udiff", UDIFF_LINES), ("legacy", LEGACY_LINES))]
    landed = spark.createDataFrame([(layout, None, None, t, None) for layout, t in texts], files.LANDED)
    rows = files.parsed(landed, config().universe).filter("NOT is_file")
    return rows.select("layout", *[c.split()[0] for c in PRICES.split(", ")])


# ---- text functions ----------------------------------------------------------------------------------------------

SUBJECTS = (
    "Bonus 1:1", "Bonus issue 4:1", "Face Value Split From Rs 10/- Per Share To Rs 2/- Per Share", "Consolidation From Re 1/- To Rs 10/-", "Bonus 1:1 / Face Value Split - From Rs 10/- Per Share To Rs 5/-",
    "Scheme of Arrangement", "Bonus Debenture 1:1", "Dividend Rs 5", "Sub-Division", "Bonus", "Spin-Off Split", "Bonus 2:0",
)


def _literal(values: tuple[str, ...]) -> str:
    return ", ".join("('" + v.replace("'", "''") + "')" for v in values)


def _like(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower(subject), '{w}')" for w in words) + ")"


_TYPE = f"""CASE WHEN {_like(text.DEMERGER_WORDS)} THEN 'demerger' ELSE coalesce(nullif(concat_ws('+', CASE WHEN contains(lower(subject), 'bonus') AND NOT {_like(text.BONUS_EXCLUSIONS)} THEN 'bonus' END,
    CASE WHEN {_like(text.CONSOLIDATION_WORDS)} THEN 'consolidation' WHEN {_like(text.SPLIT_WORDS)} THEN 'split' END), ''), 'ignored') END"""
_TYPED = f"typed AS (SELECT subject, {_TYPE} AS action_type FROM (VALUES {_literal(SUBJECTS)}) AS v(subject))"


@query(f"WITH {_TYPED} SELECT subject, action_type FROM typed")
def classify_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(s,) for s in SUBJECTS], "subject string").withColumn("action_type", text.classify(F.col("subject")))


# The numbers of a subject by the places of its words: a list of words, numbers and signs, searched from the left.
_WORDS = "regexp_extract_all(replace(replace(lower(subject), 'rs.', 'rs '), 're.', 're '), '[0-9]*[.][0-9]+|[0-9]+|[a-z]+|[^a-z0-9 ]')"
_PLACED = f"""placed AS (SELECT *, [k FOR k IN range(1, len(w) + 1) IF w[k] = 'from' AND w[k + 1] IN ('rs', 're') AND TRY_CAST(w[k + 2] AS DOUBLE) IS NOT NULL][1] AS f,
        [k FOR k IN range(1, len(w) + 1) IF w[k + 1] = ':' AND TRY_CAST(w[k] AS BIGINT) IS NOT NULL AND (w[k - 1] = 'bonus' OR w[k - 1] = 'issue' AND w[k - 2] = 'bonus')][1] AS b
    FROM (SELECT *, {_WORDS} AS w FROM typed) AS x),
    ratios AS (SELECT *, [k FOR k IN range(f + 1, len(w) + 1) IF w[k] = 'to' AND w[k + 1] IN ('rs', 're') AND TRY_CAST(w[k + 2] AS DOUBLE) IS NOT NULL][1] AS t FROM placed)"""
_BONUS = "(1 + TRY_CAST(w[b] AS DOUBLE) / nullif(TRY_CAST(w[b + 2] AS DOUBLE), 0))"
_FACE = "(TRY_CAST(w[f + 2] AS DOUBLE) / nullif(TRY_CAST(w[t + 2] AS DOUBLE), 0))"
_FACTOR = f"""CASE WHEN action_type NOT IN ('ignored', 'demerger') THEN (CASE WHEN contains(action_type, 'bonus') THEN {_BONUS} ELSE 1 END)
    * (CASE WHEN contains(action_type, 'split') OR contains(action_type, 'consolidation') THEN {_FACE} ELSE 1 END) END"""


@query(f"WITH {_TYPED}, {_PLACED} SELECT subject, action_type, {_FACTOR} AS factor FROM ratios")
def parse_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = classify_subjects(spark, sf_dir)
    return typed.withColumn("factor", text.action_factor(F.col("subject"), F.col("action_type")))


DATES = ("02-JAN-2015", "13-Jul-20", "2020/07/13", "31-DEC-99", "")


@query(f"SELECT raw, CAST(CASE WHEN length(raw) = 11 THEN try_strptime(raw, '%d-%b-%Y') ELSE try_strptime(raw, '%d-%b-%y') END AS DATE) AS parsed FROM (VALUES {_literal(DATES)}) AS v(raw)")
def legacy_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(d,) for d in DATES], "raw string").withColumn("parsed", text.bar_date(F.col("raw")))


NUMBERS = ("12.5", " 7 ", "-", "", "abc", "1e3", "-2.75", "-1")


@query(f"SELECT raw, TRY_CAST(nullif(trim(raw), '') AS DOUBLE) AS value, CAST(trunc(TRY_CAST(nullif(trim(raw), '') AS DOUBLE)) AS BIGINT) AS whole FROM (VALUES {_literal(NUMBERS)}) AS v(raw)")
def parsed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.createDataFrame([(n,) for n in NUMBERS], "raw string")
    return raw.select("raw", text.number(F.col("raw")).alias("value"), text.whole(F.col("raw")).alias("whole"))


@query("SELECT CAST(d AS DATE) AS day FROM generate_series(DATE '2024-01-01', DATE '2024-12-31', INTERVAL 1 DAY) AS t(d) WHERE isodow(d) < 6")
def weekdays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.weekdays(spark, "2024-01-01", "2024-12-31")


@query(f"WITH {proxy.BARS} SELECT symbol, trade_date, date_diff('day', trade_date, DATE '2025-01-01') >= 2 AS absent FROM bars")
def holiday_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.lit("2025-01-01").cast("date")
    return proxy.bars(spark, sf_dir).select("symbol", "trade_date", text.conclusively_absent(F.col("trade_date"), day, config().ingest.holiday_confirm_after_days).alias("absent"))
