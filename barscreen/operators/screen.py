"""The point-in-time screen: a preset's predicates, the quarantine anti join and the rank within each date."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barscreen.config import Preset
from barscreen.operators.windows import NARROW


def _limit(name: str, value: float) -> Column:
    """A threshold in its column's own width: a 32-bit value is compared with the 32-bit threshold, not a wider one."""
    return F.lit(float(value)).cast("float") if name in NARROW else F.lit(float(value))


def _above(name: str, value: float, or_equal: bool = False) -> Column:
    return F.col(name) >= _limit(name, value) if or_equal else F.col(name) > _limit(name, value)


def predicates(preset: Preset, min_warmup_bars: int) -> list[Column]:
    """One column for each rule of the preset; a null on either side lets no bar through."""
    p = preset
    rules = [F.col("bar_index") >= min_warmup_bars, F.col("rsi").between(_limit("rsi", p.rsi_min), _limit("rsi", p.rsi_max))]
    if p.require_ema_stack:
        rules += [F.col(f"ema_{a}") > F.col(f"ema_{b}") for a, b in ((20, 50), (50, 100), (100, 200))]
    if p.require_close_above:
        rules += [F.col("close") > F.col(f"ema_{n}") for n in (20, 50, 200)]
    if p.adx_min > 0:
        rules.append(_above("adx", p.adx_min))
    if p.min_close > 0:
        rules.append(_above("close", p.min_close))
    turnover = F.col("median_turnover") if p.liquidity_mode == "median" else F.col("close") * F.col("volume")
    rules.append(turnover >= float(p.min_turnover))
    if p.max_stoch_k is not None:
        rules.append(F.col("stoch_k") <= _limit("stoch_k", p.max_stoch_k))
    if p.volume_mode == "gate":
        rules.append(_above("vol_sustained" if p.volume_metric == "sustained" else "vol_ratio", p.volume_min_ratio, or_equal=True))
    return [*rules, F.col(p.rank_by).isNotNull()]


def outside_quarantine(indicators: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Bars that no quarantine window of their symbol covers, both ends included; overlapping windows do no harm."""
    q = quarantine.select(F.col("symbol").alias("_s"), "from_date", "to_date")
    return indicators.join(q, (F.col("symbol") == F.col("_s")) & F.col("trade_date").between(F.col("from_date"), F.col("to_date")), "left_anti")


def screened(indicators: DataFrame, quarantine: DataFrame, preset: Preset, min_warmup_bars: int, top_n: int | None = None) -> DataFrame:
    """The bars that pass, with `rank` from 1 on each date by descending rank_by, ties by symbol; top_n limits the rank."""
    missing = {f"ema_{n}" for n in (20, 50, 100, 200)} - set(indicators.columns)
    if missing and (preset.require_ema_stack or preset.require_close_above):
        raise ValueError(f"the screen needs {', '.join(sorted(missing))}")
    passed = outside_quarantine(indicators.filter(functools.reduce(operator.and_, predicates(preset, min_warmup_bars))), quarantine)
    rank = F.row_number().over(Window.partitionBy("trade_date").orderBy(F.col(preset.rank_by).desc_nulls_last(), "symbol"))
    ranked = passed.withColumn("rank", rank)
    return ranked if top_n is None else ranked.filter(F.col("rank") <= top_n)


def baskets(indicators: DataFrame, quarantine: DataFrame, presets: list[Preset], min_warmup_bars: int) -> DataFrame:
    """The baskets of many presets in one pass: the bars that pass one, with `preset` and its `rank`, basket_size a date."""
    passing = []
    for p in presets:
        fit = functools.reduce(operator.and_, predicates(p, min_warmup_bars))
        passing.append(F.when(fit, F.struct(F.lit(p.name).alias("preset"), F.col(p.rank_by).cast("double").alias("_by"), F.lit(p.basket_size).alias("_size"))))
    met = F.filter(F.array(*passing), lambda x: x.isNotNull())
    each = outside_quarantine(indicators.withColumn("_met", met).filter(F.size("_met") > 0), quarantine).withColumn("_met", F.explode("_met"))
    each = each.select(*indicators.columns, "_met.*")
    rank = F.row_number().over(Window.partitionBy("preset", "trade_date").orderBy(F.col("_by").desc_nulls_last(), "symbol"))
    largest = max(p.basket_size for p in presets)  # a rank limit that is a constant is applied before the exchange too
    return each.withColumn("rank", rank).filter(F.col("rank") <= largest).filter(F.col("rank") <= F.col("_size")).drop("_by", "_size")
