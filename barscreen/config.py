"""Settings as typed records, read from TOML; a preset is a section, not a branch in code."""

from __future__ import annotations

import datetime as dt
import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any, TypeVar

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = Path(__file__).with_name("config.toml")
T = TypeVar("T")


# The names of the settings are the keys of the TOML file, and those in URLs are its placeholders.


@dataclass(frozen=True)
class Indicators:
    ema_periods: tuple[int, ...] = (20, 50, 100, 200)
    rsi_period: int = 14
    atr_period: int = 14
    adx_period: int = 14
    momentum_short: int = 30
    momentum_long: int = 126
    momentum_skip: int = 21
    volume_average: int = 20
    volume_fast: int = 5
    volume_slow: int = 50
    stochastic: int = 14
    stochastic_smoothing: int = 3
    turnover_median: int = 20
    high_lookback: int = 252
    zscore_lookback: int = 252
    up_days: int = 20
    divergence: int = 20

    @property
    def ema_mid(self) -> int:
        """The second smallest period: the trend line of stops and extensions."""
        return sorted(self.ema_periods)[1]


@dataclass(frozen=True)
class Preset:
    name: str
    require_ema_stack: bool
    require_close_above: bool
    rsi_min: float
    rsi_max: float
    adx_min: float
    min_close: float
    liquidity_mode: str
    min_turnover: float
    volume_mode: str
    volume_metric: str
    volume_min_ratio: float
    rank_by: str
    basket_size: int
    max_stoch_k: float | None = None


@dataclass(frozen=True)
class ExitRules:
    initial_stop_atr: float = 6.0
    trailing_stop_atr: float = 8.0
    trailing_arms_at_r: float = 1.0
    structural_exit_days: int = 2
    max_hold_days: int = 60
    min_hold_days: int = 60


@dataclass(frozen=True)
class Costs:
    enabled: bool = True
    brokerage_pct: float = 0.0
    brokerage_flat: float = 0.0
    stt_buy_pct: float = 0.001
    stt_sell_pct: float = 0.001
    exchange_txn_pct: float = 0.0000297
    sebi_turnover_pct: float = 0.000001
    stamp_duty_buy_pct: float = 0.00015
    gst_pct: float = 0.18
    dp_charge: float = 15.93
    slippage_tiers: tuple[tuple[float, float], ...] = ((0, 80), (20_000_000, 40), (100_000_000, 20), (500_000_000, 10))


@dataclass(frozen=True)
class Portfolio:
    slots: int = 15
    capital: float = 1_000_000.0
    min_warmup_bars: int = 200
    default_preset: str = "pullback"


@dataclass(frozen=True)
class Actions:
    tolerance: float = 0.10
    quarantine_before: int = 5
    quarantine_after: int = 250


@dataclass(frozen=True)
class Universe:
    series: tuple[str, ...] = ("EQ",)
    instrument_types: tuple[str, ...] = ("STK",)
    exclude_symbols: tuple[str, ...] = ("-RE$", "-RE[0-9]+$")


@dataclass(frozen=True)
class FileSource:
    name: str
    url: str
    start: dt.date
    end: dt.date

    def url_for(self, day: dt.date) -> str:
        return self.url.format(yyyymmdd=f"{day:%Y%m%d}", yyyy=f"{day:%Y}", mm=f"{day:%m}", dd=f"{day:%d}", MON=f"{day:%b}".upper())


@dataclass(frozen=True)
class Ingest:
    root: str = "data/bars"
    output: str = "data/output"
    history_start: dt.date = dt.date(2015, 1, 1)
    holiday_confirm_after_days: int = 2
    timeout_seconds: float = 40.0
    seconds_between_requests: float = 0.4
    max_retries: int = 4
    backoff_base_seconds: float = 2.0
    backoff_max_seconds: float = 60.0
    user_agent: str = "barscreen"
    session_url: str = ""
    actions_url: str = ""
    sources: tuple[FileSource, ...] = ()

    def source_for(self, day: dt.date) -> FileSource | None:
        """The first source, in the order of the settings, whose range holds the day."""
        return next((s for s in self.sources if s.start <= day <= s.end), None)

    def source_named(self, name: str) -> FileSource:
        return next(s for s in self.sources if s.name == name)

    def sources_table(self, spark: SparkSession) -> DataFrame:
        """(priority, source, first_day, last_day): the ranges of source_for as rows."""
        return spark.createDataFrame([(k, s.name, s.start, s.end) for k, s in enumerate(self.sources)], "priority int, source string, first_day date, last_day date")


@dataclass(frozen=True)
class Config:
    indicators: Indicators = field(default_factory=Indicators)
    presets: dict[str, Preset] = field(default_factory=dict)
    rules: ExitRules = field(default_factory=ExitRules)
    costs: Costs = field(default_factory=Costs)
    portfolio: Portfolio = field(default_factory=Portfolio)
    actions: Actions = field(default_factory=Actions)
    universe: Universe = field(default_factory=Universe)
    ingest: Ingest = field(default_factory=Ingest)

    def preset(self, name: str | None = None) -> Preset:
        name = name or self.portfolio.default_preset
        if name not in self.presets:
            raise KeyError(f"no preset {name!r}; there are {', '.join(sorted(self.presets))}")
        return self.presets[name]


def _frozen(value: Any) -> Any:
    return tuple(_frozen(v) for v in value) if isinstance(value, list) else value


def _record(kind: type[T], raw: dict[str, Any]) -> T:
    unknown = raw.keys() - {f.name for f in fields(kind)}
    if unknown:
        raise ValueError(f"unknown settings for {kind.__name__}: {', '.join(sorted(unknown))}")
    return kind(**{k: _frozen(v) for k, v in raw.items()})


def load(path: str | Path | None = None) -> Config:
    """The default settings, with the sections of another file in place of the same ones."""
    raw = tomllib.loads(DEFAULTS.read_text())
    if path is not None:
        for section, values in tomllib.loads(Path(path).read_text()).items():
            raw[section] = {**raw.get(section, {}), **values}
    ingest = {**raw["ingest"], "sources": [_record(FileSource, s) for s in raw["ingest"].get("sources", [])]}
    indicators = _record(Indicators, raw["indicators"])
    if len(indicators.ema_periods) < 2:
        raise ValueError("at least two EMA periods are needed")
    return Config(
        indicators=indicators,
        presets={name: _record(Preset, {"name": name, **values}) for name, values in raw["presets"].items()},
        rules=_record(ExitRules, raw["rules"]),
        costs=_record(Costs, raw["costs"]),
        portfolio=_record(Portfolio, raw["portfolio"]),
        actions=_record(Actions, raw["actions"]),
        universe=_record(Universe, raw["universe"]),
        ingest=_record(Ingest, ingest),
    )
