"""Window indicators: one exchange and one sort by symbol and date serve them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barscreen.config import Indicators

#: Columns that are stored as 32-bit floats; prices, turnover and its median stay doubles.
NARROW = (
    "rsi", "adx", "atr", "ext_atr", "pct_from_high", "mom_short", "mom_long", "mom_long_skip", "vol_ratio", "vol_sustained", "up_day_ratio", "high_252", "stoch_k", "stoch_d", "ext_zscore",
)


def by_bar() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("trade_date")


def _last(n: int) -> WindowSpec:
    return by_bar().rowsBetween(1 - n, 0)


def _before(n: int) -> WindowSpec:
    return by_bar().rowsBetween(-n, -1)


def _change(now: Column, then: Column) -> Column:
    return now / F.nullif(then, F.lit(0.0)) - 1


def prior_close() -> Column:
    return F.lag("close", 1).over(by_bar())


def momentum(days: int, skip: int = 0) -> Column:
    now = F.lag("close", skip).over(by_bar()) if skip else F.col("close")
    return _change(now, F.lag("close", days + skip).over(by_bar()))


def vol_ratio(days: int) -> Column:
    """Today's volume over the average of the days before it."""
    return F.col("volume") / F.nullif(F.avg("volume").over(_before(days)), F.lit(0.0))


def vol_sustained(fast: int, slow: int) -> Column:
    return F.avg("volume").over(_last(fast)) / F.nullif(F.avg("volume").over(_last(slow)), F.lit(0.0))


def median_turnover(days: int) -> Column:
    """Exact median of the days before: the aggregate `median` takes no ordered frame, `percentile` does."""
    return F.percentile("turnover", 0.5).over(_before(days))


def bar_index() -> Column:
    return F.row_number().over(by_bar()).cast("bigint")


def stoch_k(days: int) -> Column:
    low, high = F.min("low").over(_last(days)), F.max("high").over(_last(days))
    return 100 * (F.col("close") - low) / F.nullif(high - low, F.lit(0.0))


def true_range() -> Column:
    """The largest of the day's range and its distances from the close before; the first bar has its range only."""
    before = prior_close()
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def with_trend_age(bars: DataFrame, stacked: Column) -> DataFrame:
    """trend_age_days: how many bars in a row, up to this one, `stacked` has held (gaps and islands)."""
    on = F.coalesce(stacked, F.lit(False))
    marked = bars.withColumn("_on", on).withColumn("_island", F.sum(F.when(F.col("_on"), 0).otherwise(1)).over(by_bar()))
    run = Window.partitionBy("symbol", "_island").orderBy("trade_date")
    return marked.withColumn("trend_age_days", F.sum(F.col("_on").cast("int")).over(run).cast("int")).drop("_on", "_island")


def rsi_divergence(days: int) -> Column:
    """1 where the close is above all of the days before but rsi is not; both need that many values to compare with."""

    def breaks(name: str) -> Column:
        full = F.count(name).over(_before(days)) == days
        return F.coalesce(full & (F.col(name) > F.max(name).over(_before(days))), F.lit(False))

    return (breaks("close") & ~breaks("rsi")).cast("tinyint")


def with_windows(bars: DataFrame, settings: Indicators) -> DataFrame:
    """bars (with the smoothed columns) and all window indicators, as doubles."""
    s = settings
    first = bars.withColumns({
        "prior_close": prior_close(),
        "mom_short": momentum(s.momentum_short),
        "mom_long": momentum(s.momentum_long),
        "mom_long_skip": momentum(s.momentum_long, s.momentum_skip),
        "vol_ratio": vol_ratio(s.volume_average),
        "vol_sustained": vol_sustained(s.volume_fast, s.volume_slow),
        "median_turnover": median_turnover(s.turnover_median),
        "high_252": F.max("high").over(_last(s.high_lookback)),
        "stoch_k": stoch_k(s.stochastic),
        "bar_index": bar_index(),
    })
    up = F.when(F.col("close") > F.col("prior_close"), 1).otherwise(0)
    second = first.withColumns({
        "up_day_ratio": F.avg(up).over(_last(s.up_days)),
        "stoch_d": F.avg("stoch_k").over(_last(s.stochastic_smoothing)),
        "ext_atr": (F.col("close") - F.col(f"ema_{s.ema_mid}")) / F.nullif(F.col("atr"), F.lit(0.0)),
        "pct_from_high": _change(F.col("close"), F.col("high_252")),
    })
    around = _last(s.zscore_lookback)
    zscore = (F.col("ext_atr") - F.avg("ext_atr").over(around)) / F.nullif(F.stddev_samp("ext_atr").over(around), F.lit(0.0))
    return second.withColumn("ext_zscore", zscore)


def narrowed(indicators: DataFrame) -> DataFrame:
    return indicators.withColumns({c: F.col(c).cast("float") for c in NARROW if c in indicators.columns})
