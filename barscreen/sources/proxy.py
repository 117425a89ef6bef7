"""Bars, actions, quarantine and positions made from the test tables, which hold no prices of their own.

The text of these inputs is the same for Spark and for an oracle: {lineitem} and {part} stand for the tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barscreen.sources.shared import shared_folder

BARS = """li AS (SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS trade_date, l_orderkey ok, l_linenumber ln, l_partkey pk, l_extendedprice ep, l_quantity q,
        CAST(round((l_discount - 0.05) * 100) AS BIGINT) * CAST(l_quantity AS BIGINT) AS step
    FROM {lineitem} JOIN {part} ON l_partkey = p_partkey),
path AS (SELECT *, 100000 + sum(step) OVER (PARTITION BY symbol ORDER BY trade_date, ok, ln, pk, ep ROWS UNBOUNDED PRECEDING) AS ticks,
        row_number() OVER (PARTITION BY symbol ORDER BY trade_date, ok, ln, pk, ep) AS rn FROM li),
bars AS (SELECT symbol, trade_date, CAST(min_by(ticks, rn) AS DOUBLE) / 100 AS open, CAST(max(ticks) AS DOUBLE) / 100 AS high, CAST(min(ticks) AS DOUBLE) / 100 AS low,
        CAST(max_by(ticks, rn) AS DOUBLE) / 100 AS close, CAST(sum(q) AS BIGINT) AS volume, round(sum(ep), 2) AS turnover, count(*) AS trades
    FROM path GROUP BY symbol, trade_date)"""

NUMBERED = f"""{BARS},
symbols AS (SELECT symbol, row_number() OVER (ORDER BY symbol) AS sidx FROM (SELECT DISTINCT symbol FROM bars) AS x),
numbered AS (SELECT b.*, s.sidx, row_number() OVER (PARTITION BY b.symbol ORDER BY b.trade_date) AS n FROM bars b JOIN symbols s ON b.symbol = s.symbol)"""

#: Fixed values of the made-up actions: on bar n of the symbols given, with the true factor and the recorded one.
ACTIONS = f"""{NUMBERED},
events AS (SELECT symbol, trade_date AS ex_date, 'split' AS action_type, 'Face Value Split' AS subject,
        CASE sidx % 5 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 WHEN 2 THEN 10e0 WHEN 3 THEN 1e-1 ELSE 3e0 END AS actual, CASE WHEN sidx % 7 = 0 THEN 5e-1 ELSE 1e0 END AS part
    FROM numbered WHERE n = 60 AND sidx <= 20
    UNION ALL SELECT symbol, trade_date, 'bonus', 'Bonus 1:1', 2e0, 1e0 FROM numbered WHERE n = 90 AND sidx <= 10
    UNION ALL SELECT symbol, trade_date, 'split', 'Face Value Split', 2e0, 1e0 FROM numbered WHERE n = 80 AND sidx = 24
    UNION ALL SELECT symbol, trade_date, 'bonus', 'Bonus 4:1', 5e0, 1e0 FROM numbered WHERE n = 80 AND sidx = 24
    UNION ALL SELECT symbol, trade_date, 'demerger', 'Demerger', CAST(NULL AS DOUBLE), 1e0 FROM numbered WHERE n = 75 AND sidx IN (21, 22)
    UNION ALL SELECT symbol, CAST(trade_date - INTERVAL 1 DAY AS DATE), 'split', 'Face Value Split', 2e0, 1e0 FROM numbered WHERE n = 1 AND sidx = 23),
actions AS (SELECT symbol, ex_date, action_type, subject, actual * part AS adj_factor FROM events)"""

RAW = f"""{ACTIONS},
gaps AS (SELECT symbol, ex_date, exp(sum(ln(actual))) AS f FROM events WHERE actual IS NOT NULL GROUP BY symbol, ex_date),
factors AS (SELECT b.symbol, b.trade_date, coalesce(round(exp(sum(ln(round(g.f, 6)))), 6), 1e0) AS f
    FROM bars b LEFT JOIN gaps g ON b.symbol = g.symbol AND b.trade_date < g.ex_date GROUP BY b.symbol, b.trade_date),
raw AS (SELECT b.symbol, b.trade_date, b.open * f.f AS open, b.high * f.f AS high, b.low * f.f AS low, b.close * f.f AS close,
        lag(b.close * f.f) OVER (PARTITION BY b.symbol ORDER BY b.trade_date) AS prev_close, CAST(round(b.volume / f.f) AS BIGINT) AS volume, b.turnover, b.trades
    FROM bars b JOIN factors f ON b.symbol = f.symbol AND b.trade_date = f.trade_date)"""

POSITIONS = f"""{NUMBERED},
positions AS (SELECT CAST(sidx AS INT) AS position_id, symbol, trade_date AS entry_date,
        close * CASE sidx WHEN 3 THEN 10e0 WHEN 5 THEN 5e-1 ELSE 1e0 END AS entry_price, 10 AS quantity, CAST(NULL AS DATE) AS exit_date FROM numbered WHERE n = 40 AND sidx <= 5
    UNION ALL SELECT 6, symbol, trade_date, close, 10, CAST(NULL AS DATE) FROM (SELECT *, row_number() OVER (ORDER BY trade_date DESC, symbol) AS latest FROM numbered) AS x WHERE latest = 1
    UNION ALL SELECT 7, symbol, trade_date, close, 10, trade_date FROM numbered WHERE n = 50 AND sidx = 6)"""


def oracle_text(text: str) -> str:
    """The same text for DuckDB, on its views."""
    return text.replace("{lineitem}", "lineitem").replace("{part}", "part")


_KEPT: dict[tuple[str, str, str], str] = {}


def kept(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table that a deployment would have stored: written once in a session, as Parquet in the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _KEPT:
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        build().write.parquet(path)
        _KEPT[key] = path
    return spark.read.parquet(_KEPT[key])


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "part")}
        return spark.sql(f"WITH {BARS} SELECT * FROM bars", **tables)

    return kept(spark, sf_dir, "bars", build)


def made(spark: SparkSession, sf_dir: str, text: str, name: str) -> DataFrame:
    """A table of one of the texts above, on the stored bars."""
    rest = text.removeprefix(BARS)
    return kept(spark, sf_dir, name, lambda: spark.sql(f"WITH bars AS (SELECT * FROM {{bars}}){rest} SELECT * FROM {name}", bars=bars(spark, sf_dir)))
