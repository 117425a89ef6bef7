"""Behaviour of the operators on small literal frames."""

from __future__ import annotations

import dataclasses
import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barscreen.config import Costs, ExitRules, Preset, load
from barscreen.functions import costs as charges
from barscreen.functions import display, text
from barscreen.operators import adjust, exits, portfolio, recursive, scan, screen, windows
from barscreen.sources import files

CONFIG = load()
DAY = dt.date(2024, 1, 1)


def bars_of(spark, closes, symbol="A", volume=1000, start=DAY):
    rows = [(symbol, start + dt.timedelta(days=k), float(c), c * 1.01, c * 0.99, float(c), volume, float(c) * volume) for k, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, trade_date date, open double, high double, low double, close double, volume bigint, turnover double")


def loop_wilder(values, period):
    out, last = [], None
    for v in values:
        if v is None:
            out.append(None)
            continue
        last = v if last is None else last + (v - last) / period
        out.append(last)
    return out


def test_smoothing_matches_an_independent_loop(spark):
    closes = (100 + np.cumsum(np.random.default_rng(7).normal(size=120))).tolist()
    got = recursive.sequential(bars_of(spark, closes), CONFIG.indicators).orderBy("trade_date").toPandas()
    high, low = [c * 1.01 for c in closes], [c * 0.99 for c in closes]
    step = [None] + [b - a for a, b in zip(closes, closes[1:])]
    up, down = (loop_wilder([None if d is None else max(s * d, 0.0) for d in step], 14) for s in (1, -1))
    rsi = [None if u is None else 50.0 if u + d == 0 else 100 * u / (u + d) for u, d in zip(up, down)]
    tr = [h - l if k == 0 else max(h - l, abs(h - closes[k - 1]), abs(l - closes[k - 1])) for k, (h, l) in enumerate(zip(high, low))]
    ema = [closes[0]]
    for c in closes[1:]:
        ema.append(ema[-1] + (c - ema[-1]) * 2 / 21)
    assert pd.isna(got.rsi[0]) and np.allclose(got.rsi[1:], rsi[1:])
    assert np.allclose(got.atr, loop_wilder(tr, 14)) and np.allclose(got.ema_20, ema)
    assert got.adx.between(0, 100).all()


def test_rsi_saturates(spark):
    for closes, value in ((range(100, 140), 100.0), (range(140, 100, -1), 0.0), ([100] * 40, 50.0)):
        got = recursive.smoothed(bars_of(spark, closes), CONFIG.indicators).orderBy("trade_date").toPandas()
        assert np.allclose(got.rsi[1:], value)


def test_a_missing_close_decays_by_position_and_never_becomes_nan(spark):
    bars = bars_of(spark, [100.0, 110.0, 120.0, 130.0]).withColumn("close", F.when(F.day("trade_date") != 2, F.col("close")))
    got = recursive.smoothed(bars, CONFIG.indicators).orderBy("trade_date")
    a = 2 / 21
    expected = ((1 - a) ** 2 * 100 + a * 120) / ((1 - a) ** 2 + a)
    assert got.collect()[2]["ema_20"] == pytest.approx(expected)
    assert got.filter(F.isnan("ema_20") | F.isnan("rsi") | F.isnan("close")).count() == 0


def test_divergence_on_the_first_full_window_and_trend_age(spark):
    got = recursive.sequential(bars_of(spark, [100 + k for k in range(260)]), CONFIG.indicators).orderBy("trade_date").toPandas()
    assert got.rsi_divergence[20] == 1 and (got.rsi_divergence[:20] == 0).all()
    assert got.trend_age_days[0] == 0 and got.trend_age_days[259] == got.trend_age_days[258] + 1


def test_windows_use_partial_frames_and_leave_today_out(spark):
    got = bars_of(spark, [100.0, 110.0, 121.0]).withColumns({"v": windows.vol_ratio(20), "m": windows.median_turnover(20), "n": windows.bar_index()}).orderBy("trade_date").collect()
    assert [r["n"] for r in got] == [1, 2, 3]
    assert got[0]["v"] is None and got[1]["v"] == 1.0 and got[0]["m"] is None
    assert got[2]["m"] == pytest.approx((100_000 + 110_000) / 2)


def preset(**changes):
    plain = Preset("plain", False, False, 0.0, 100.0, 0.0, 0.0, "median", 0.0, "off", "spike", 0.0, "mom_short", 50)
    return dataclasses.replace(plain, **changes)


def indicator_rows(spark, rows):
    schema = "symbol string, trade_date date, bar_index bigint, close double, volume bigint, rsi float, adx float, stoch_k float, vol_ratio float, vol_sustained float, median_turnover double, mom_short float, ema_20 double, ema_50 double, ema_100 double, ema_200 double"
    return spark.createDataFrame(rows, schema)


ROW = dict(symbol="A", trade_date=DAY, bar_index=250, close=100.0, volume=10, rsi=60.1, adx=30.0, stoch_k=40.0, vol_ratio=1.5, vol_sustained=1.5, median_turnover=500.0, mom_short=0.1, ema_20=99.0, ema_50=98.0, ema_100=97.0, ema_200=96.0)
NO_QUARANTINE = "symbol string, from_date date, to_date date, reason string"


@pytest.mark.parametrize(
    ("rule", "changed", "passes"),
    [
        ({}, {}, True), ({}, {"bar_index": 199}, False), ({"rsi_min": 60.1}, {}, True), ({"rsi_max": 60.1}, {}, True), ({"require_ema_stack": True}, {"ema_100": 98.0}, False), ({"require_close_above": True}, {"ema_100": 200.0}, True),
        ({"require_close_above": True}, {"ema_50": 100.0}, False), ({"adx_min": 30.0}, {}, False), ({"min_close": 100.0}, {}, False), ({"min_turnover": 500.0}, {}, True), ({"min_turnover": 0.0}, {"median_turnover": None}, False),
        ({"liquidity_mode": "same_day", "min_turnover": 1000.0}, {}, True), ({"max_stoch_k": 40.0}, {}, True), ({"volume_mode": "gate", "volume_min_ratio": 1.6}, {}, False), ({"volume_mode": "rank", "volume_min_ratio": 9.0}, {}, True), ({}, {"mom_short": None}, False),
    ],
)
def test_each_screen_rule(spark, rule, changed, passes):
    rows = indicator_rows(spark, [tuple((ROW | changed).values())])
    assert (screen.screened(rows, spark.createDataFrame([], NO_QUARANTINE), preset(**rule), 200).count() == 1) is passes


def test_rank_ties_quarantine_and_top_n(spark):
    rows = [tuple((ROW | {"symbol": s, "mom_short": m}).values()) for s, m in (("B", 0.2), ("A", 0.2), ("C", 0.3), ("D", 0.9))]
    shut = spark.createDataFrame([("D", DAY, DAY, "x"), ("D", DAY - dt.timedelta(3), DAY + dt.timedelta(3), "y")], NO_QUARANTINE)
    got = screen.screened(indicator_rows(spark, rows), shut, preset(), 200, 3).orderBy("rank").collect()
    assert [(r["rank"], r["symbol"]) for r in got] == [(1, "C"), (2, "A"), (3, "B")]


def actions_of(spark, rows):
    return spark.createDataFrame(rows, "symbol string, ex_date date, action_type string, subject string, adj_factor double, observed double, deviation double, verification string")


def split_gap(spark, old, new, n=6):
    rows = [("A", DAY + dt.timedelta(k), float(old if k < n else new), float(old), 1000, 1e6) for k in range(2 * n)]
    rows = [(s, d, o, o, o, o, old if k <= n else float(new), v, t) for k, (s, d, o, _, v, t) in enumerate(rows)]
    return spark.createDataFrame([(s, d, o, h, l, c, float(p), v, t) for s, d, o, h, l, c, p, v, t in rows], "symbol string, trade_date date, open double, high double, low double, close double, prev_close double, volume bigint, turnover double")


@pytest.mark.parametrize(
    ("old", "new", "factors", "verdict", "closes"),
    [(1000, 200, [5.0], "verified", {200.0}), (9331, 933.1, [2.0, 5.0], "verified", {933.1}), (9331, 933.1, [5.0], "mismatch", {9331.0, 933.1}), (9.81, 98.1, [0.1], "verified", {98.1})],
)
def test_adjustment_needs_the_gap_that_the_ratios_say(spark, old, new, factors, verdict, closes):
    prices, ex = split_gap(spark, old, new), DAY + dt.timedelta(6)
    actions = actions_of(spark, [("A", ex, "split", f"s{k}", f, None, None, "pending") for k, f in enumerate(factors)])
    done = adjust.verified(actions, prices, CONFIG.actions)
    assert {r["verification"] for r in done.collect()} == {verdict}
    got = adjust.adjusted(prices, adjust.intervals(done)).toPandas()
    assert {round(c, 6) for c in got.close} == closes
    assert (got.turnover == 1e6).all()
    if verdict == "verified":
        assert set(got.volume) == {1000, round(1000 * np.prod(factors))}
    assert adjust.quarantined(done, CONFIG.actions).count() == (verdict == "mismatch")


def test_demergers_are_quarantined_and_unverified_actions_do_nothing(spark):
    actions = actions_of(spark, [("A", DAY, "demerger", "d", None, None, None, "pending"), ("Z", DAY, "split", "s", 2.0, None, None, "pending")])
    done = adjust.verified(actions, split_gap(spark, 10, 10), CONFIG.actions)
    assert {(r["symbol"], r["verification"]) for r in done.collect()} == {("A", "pending"), ("Z", "unverified")}
    got = adjust.quarantined(done, CONFIG.actions).collect()
    assert [(r["symbol"], r["reason"], (r["to_date"] - r["from_date"]).days) for r in got] == [("A", "demerger", 255)]
    assert adjust.intervals(done).count() == 0


RULES = ExitRules(2.5, 3.0, 1.0, 2, 90, 0)
FREE = Costs(enabled=False)


def panel(spark, closes, opens=None, lows=None, trend=None, symbol="A"):
    rows = [
        (symbol, k + 1, DAY + dt.timedelta(k), float((opens or {}).get(k, c)), float((lows or {}).get(k, c - 1)), float(c), float((trend or {}).get(k, c - 50)), 4.0, 1e9)
        for k, c in enumerate(closes)
    ]
    return spark.createDataFrame(rows, "symbol string, bar_index bigint, trade_date date, open double, low double, close double, ema_50 double, atr float, median_turnover double")


def outcome(spark, bars, at=9, rules=RULES, costs=FREE, symbol="A"):
    signal = spark.createDataFrame([(symbol, at + 1)], "symbol string, signal_index bigint")
    rows = exits.outcomes(signal, bars, rules, costs, 50).collect()
    return rows[0].asDict() if rows else None


def test_stops_fill_at_the_level_or_a_worse_open(spark):
    flat = [100.0] * 40
    touched = outcome(spark, panel(spark, flat, lows={15: 89.0}))
    assert (touched["exit_reason"], touched["exit_price"], touched["hold_days"]) == ("stop", 90.0, 6)
    gapped = outcome(spark, panel(spark, flat, opens={15: 80.0}, lows={15: 79.0}))
    assert (gapped["exit_reason"], gapped["exit_price"]) == ("stop", 80.0)
    first = outcome(spark, panel(spark, flat, lows={10: 80.0}))
    assert first["entry_date"] == first["exit_date"] and first["hold_days"] == 1


def test_structural_time_and_data_end(spark):
    closes = [100.0 + k for k in range(140)]
    structural = outcome(spark, panel(spark, closes, trend={14: 500, 15: 500}))
    assert (structural["exit_reason"], structural["exit_date"], structural["exit_price"]) == ("structural", DAY + dt.timedelta(16), 116.0)
    late = outcome(spark, panel(spark, closes, trend={14: 500, 15: 500}), rules=dataclasses.replace(RULES, min_hold_days=30))
    assert late["exit_reason"] == "time"
    timed = outcome(spark, panel(spark, closes), rules=dataclasses.replace(RULES, max_hold_days=30))
    assert (timed["exit_reason"], timed["hold_days"]) == ("time", 30)
    ended = outcome(spark, panel(spark, closes[:20]).unionByName(panel(spark, closes, symbol="B")))
    assert (ended["exit_reason"], ended["hold_days"]) == ("data_end", 10)
    assert outcome(spark, panel(spark, closes[:10])) is None


def test_the_future_changes_nothing(spark):
    closes = [100.0 + k for k in range(40)] + [60.0] + [61.0] * 20
    known = outcome(spark, panel(spark, closes, lows={40: 50.0}))
    poisoned = outcome(spark, panel(spark, closes[:41] + [9999.0] * 20, lows={40: 50.0} | {k: 0.1 for k in range(41, 61)}))
    assert known == poisoned and known["exit_reason"] == "stop"
    # trailing: highest close before bar 40 is 139, three ATR of 4 below it
    assert known["exit_price"] == min(139.0 - 12.0, 60.0)


def candidates(rows):
    return pd.DataFrame([dict(zip(portfolio.CANDIDATES, r)) for r in rows])


def test_slots_fill_by_rank_and_free_on_exit():
    d = [DAY + dt.timedelta(k) for k in range(8)]
    rows = [("A", d[0], d[2], 100.0, 110.0, 1, 0.1, "time", 2), ("B", d[0], d[2], 100.0, 110.0, 2, 0.1, "time", 2), ("C", d[2], d[4], 100.0, 110.0, 1, 0.1, "time", 2), ("D", d[4], d[6], 100.0, 110.0, 1, 0.1, "time", 2)]
    trades, curve = portfolio.fold_slots(candidates(rows), 1, 1000.0, FREE)
    assert [t["symbol"] for t in trades] == ["A", "C", "D"]
    assert curve[-1]["equity"] == pytest.approx(1000 * 1.1**3)
    same_day = [("A", d[0], d[0], 100.0, 90.0, 1, -0.1, "stop", 1), ("B", d[1], d[2], 100.0, 100.0, 1, 0.0, "time", 1)]
    trades, curve = portfolio.fold_slots(candidates(same_day), 1, 1000.0, FREE)
    assert [t["symbol"] for t in trades] == ["A", "B"] and curve[0]["open_positions"] == 0
    held = [("A", d[0], d[3], 100.0, 100.0, 1, 0.0, "time", 3), ("A", d[1], d[4], 100.0, 100.0, 1, 0.0, "time", 3)]
    assert len(portfolio.fold_slots(candidates(held), 5, 1000.0, FREE)[0]) == 1


def test_the_buy_charge_counts_twice_unless_told_otherwise():
    row = [("A", DAY, DAY + dt.timedelta(1), 100.0, 100.0, 1, 0.0, "time", 1)]
    (trade,), twice = portfolio.fold_slots(candidates(row), 1, 100_000.0, CONFIG.costs)
    _, once = portfolio.fold_slots(candidates(row), 1, 100_000.0, CONFIG.costs, buy_charge_once=True)
    assert once[-1]["equity"] - twice[-1]["equity"] == pytest.approx(trade["buy_cost"])


def test_statistics_of_trades_and_curves(spark):
    rows = [("A", DAY, DAY + dt.timedelta(1), 100.0, 110.0, 1, 0.1, "time", 1), ("B", DAY + dt.timedelta(2), DAY + dt.timedelta(9), 100.0, 75.0, 1, -0.25, "stop", 7)]
    book = portfolio.ledger(spark.createDataFrame(candidates(rows)), 1, 1000.0, FREE)
    got = portfolio.statistics(portfolio.trades_of(book), portfolio.curve_of(book), 1000.0).first().asDict()
    assert got["trades"] == 2 and got["hit_rate"] == 0.5 and got["max_drawdown"] == pytest.approx(-0.25)
    assert got["total_return_net"] == pytest.approx(1.1 * 0.75 - 1) and got["win_loss_ratio"] == pytest.approx(0.1 / 0.25)
    none = portfolio.statistics(portfolio.trades_of(book).limit(0), portfolio.curve_of(book).limit(0), 1000.0).first().asDict()
    assert none["trades"] == 0 and none["cagr_net"] is None


def test_costs_in_columns_agree_with_the_ledger_and_the_tiers(spark):
    turnover = spark.createDataFrame([(1e9,), (2e8,), (5e7,), (1e7,), (4e6,), (None,)], "t double")
    assert [r[0] for r in turnover.select(charges.slippage_bps(CONFIG.costs, F.col("t"))).collect()] == [10, 20, 40, 80, 80, 80]
    c, v = CONFIG.costs, 67_000.0
    buy, sell, off = spark.range(1).select(charges.buy_costs(c, F.lit(v)), charges.sell_costs(c, F.lit(v)), charges.sell_costs(FREE, F.lit(v))).first()
    assert buy == pytest.approx(portfolio._levy(c, v, c.stt_buy_pct + c.stamp_duty_buy_pct, 0.0)) and off == 0.0
    assert sell == pytest.approx(portfolio._levy(c, v, c.stt_sell_pct, c.dp_charge))
    assert (buy + sell) / v == pytest.approx(0.0025, abs=2e-4)


def test_packed_subjects_multiply(spark):
    subjects = ["Bonus 1:1 / Face Value Split - From Rs 10/- Per Share To Rs 5/-", "Bonus 4:1/Face Value Split From Rs 2/- To Re 1/-", "Face Value Split - From Rs 10/- To Re 1/-", "Bonus 2:1", "Bonus / Face Value Split From Rs 10 To Rs 5", "Dividend"]
    df = spark.createDataFrame([(s,) for s in subjects], "s string").withColumn("t", text.classify(F.col("s")))
    got = df.select("t", text.action_factor(F.col("s"), F.col("t")).alias("f"), text.factor_note(F.col("s"), F.col("t")).alias("n")).collect()
    assert [r["f"] for r in got] == [4.0, 10.0, 10.0, 3.0, None, None]
    assert got[0]["t"] == "bonus+split" and got[4]["n"] == "no readable ratio: bonus" and got[5]["t"] == "ignored"


def test_a_subject_is_cut_into_pieces_once(spark):
    """Factor and note name the pieces of a subject many times; cut for each place, 20,000 subjects took most of a minute."""
    df = spark.createDataFrame([("Bonus 1:1",)], "s string").withColumn("t", text.classify(F.col("s")))
    for made in (text.action_factor(F.col("s"), F.col("t")), text.factor_note(F.col("s"), F.col("t")), *text.face_values(F.col("s")), *text.bonus_ratio(F.col("s"))):
        assert df.select(made.alias("x"))._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    raw = spark.createDataFrame([("A", "EQ", "02-Jan-2015", "Bonus 1:1", "", "10")], files.ACTION_FIELDS)
    read = files.actions_from(raw, CONFIG.universe)
    assert read._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert [(r["adj_factor"], r["note"]) for r in read.collect()] == [(2.0, None)]


def test_averages_as_a_scan(spark):
    r, rows = random.Random(1), []
    for key, (n, share) in enumerate([(1, 0), (5, 0.2), (256, 0.1), (257, 0.3), (1500, 0.05), (600, 0)]):
        for k in range(n):
            gone = r.random() < share or key == 3 and k < 10 or key == 4 and 300 < k < 1200
            rows.append((f"k{key}", k, None if gone else float("nan") if r.random() < 0.01 else r.random() * 100, r.random() * (r.random() < 0.5)))
    passes = {"a": ("x", 2 / 21), "b": ("x", 2 / 201), "c": ("z", 1 / 14), "d": ("x", 1.0), "e": ("z", 2 / 3)}
    df = spark.createDataFrame(rows, "key string, n int, x double, z double")
    got = scan.averages(df, passes, "key", "n").toPandas().sort_values(["key", "n"], ignore_index=True)
    plain = pd.DataFrame(rows, columns=["key", "n", "x", "z"]).sort_values(["key", "n"], ignore_index=True)
    for name, (column, weight) in passes.items():
        expected = plain.groupby("key")[column].transform(lambda v, w=weight: recursive.average(v, w))
        np.testing.assert_allclose(got[name].to_numpy(float), expected.to_numpy(float), rtol=1e-12)
    assert scan.averages(df.limit(0), passes, "key", "n").count() == 0


def test_long_curves_in_two_levels(spark):
    r = random.Random(8)
    curves = {}
    for name in ("a", "b", None):
        days = sorted(r.sample(range(9000, 11000), 150)) + ([15_000, 15_001] if name == "a" else [])
        curves[name] = [(dt.date(1970, 1, 1) + dt.timedelta(d), 100 + r.random() * 50) for d in days]
    rows = [(n, d, e) for n, points in curves.items() for d, e in points]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "name string, date date, equity double")
    for by, groups in ((("name",), curves), ((), {None: curves["a"]})):
        part = df if by else df.filter("name = 'a'")
        got = {(x["name"] if by else None, x["date"]): x["drawdown"] for x in portfolio.drawdowns(part, *by).collect()}
        back = {(x["name"] if by else None, x["date"]): x["return"] for x in portfolio.rolling_returns(part, 90, *by).collect()}
        falls, returns = {}, {}
        for n, points in groups.items():
            for k, (d, e) in enumerate(points):
                falls[n, d] = e / max(x for _, x in points[: k + 1]) - 1
                then = next((x for t, x in points if (t - d).days >= 90), None)
                if then is not None:
                    returns[n, d] = then / e - 1
        assert got == pytest.approx(falls) and back == pytest.approx(returns)


def test_subjects_by_their_words(spark):
    subjects = {
        "Face Value Split From Rs.10/- To Re.1/-": (10.0, 1.0),
        "From Rs 2 To Rs 1 And From Rs 1 To Rs 10": (2.0, 1.0),
        "SPLIT TO RS 5 FROM RS 10 TO RS 2.50": (10.0, 2.5),
        "Split From 10 To 2": (None, None),
        "Split From Rs 10": (10.0, None),
        "From Rs 10 To Rs 0": (10.0, None),
        "": (None, None),
        None: (None, None),
    }
    df = spark.createDataFrame([(s,) for s in subjects], "s string")
    assert {r[0]: (r[1], r[2]) for r in df.select("s", *text.face_values(F.col("s"))).collect()} == subjects
    ratios = {
        "Bonus 1:2": (1.0, 2.0),
        "Bonus Issue 3 : 1": (3.0, 1.0),
        "bonus 1:1 / bonus 5:1": (1.0, 1.0),
        "Rights 1:5, Bonus 2:1": (2.0, 1.0),
        "Bonus shares 1:1": (None, None),
        "Bonus": (None, None),
        "Bonus 1.5:1": (None, None),
        "Bonus 2:0": (2.0, None),
    }
    df = spark.createDataFrame([(s,) for s in ratios], "s string")
    assert {r[0]: (r[1], r[2]) for r in df.select("s", *text.bonus_ratio(F.col("s"))).collect()} == ratios


def test_amounts_as_they_are_shown(spark):
    values = [1234567.891, -1234567.0, 999.995, 0.0, -0.001, 100000.0, 12345678.0, None, float("nan"), 70.04838562011719]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    got = df.select("k", display.grouped(F.col("v")), display.short_amount(F.col("v")), display.percent(F.col("v")), display.tidy(F.col("v"))).orderBy("k").collect()
    assert [r[1] for r in got] == ["12,34,567.89", "-12,34,567.00", "1,000.00", "0.00", "0.00", "1,00,000.00", "1,23,45,678.00", "–", "–", "70.05"]
    assert [r[2] for r in got][:7] == ["12.3L", "-1234567", "1000", "0", "0", "1.0L", "1.2cr"]
    assert got[9][4] == 70.0484 and got[0][4] == 1234570.0 and got[3][3] == "0.0%" and got[7][3] == "–"
    cells = spark.createDataFrame([('a"b,c',), ("x\ny",), ("plain",), (None,)], "s string")
    assert [r[0] for r in cells.select(display.csv_cell(F.col("s"))).collect()] == ['"a""b,c"', '"x\ny"', "plain", ""]
