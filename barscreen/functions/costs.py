"""Transaction costs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barscreen.config import Costs


def slippage_bps(costs: Costs, median_turnover: Column) -> Column:
    """One-way slippage by liquidity: the tier with the highest threshold that the turnover reaches; no turnover, the widest."""
    tiers = sorted(costs.slippage_tiers)
    turnover, out = F.coalesce(median_turnover, F.lit(0.0)), F.lit(float(tiers[0][1]))
    for threshold, bps in tiers:
        out = F.when(turnover >= float(threshold), F.lit(float(bps))).otherwise(out)
    return out


def brokerage(costs: Costs, value: Column) -> Column:
    share = value * costs.brokerage_pct
    return F.least(share, F.lit(costs.brokerage_flat)) if costs.brokerage_flat > 0 else share


def _levies(costs: Costs, value: Column) -> Column:
    """Brokerage, exchange and regulator's charges, and the service tax on those."""
    charged = brokerage(costs, value) + value * costs.exchange_txn_pct + value * costs.sebi_turnover_pct
    return charged + charged * costs.gst_pct


def buy_costs(costs: Costs, value: Column) -> Column:
    if not costs.enabled:
        return F.lit(0.0)
    return _levies(costs, value) + value * costs.stt_buy_pct + value * costs.stamp_duty_buy_pct


def sell_costs(costs: Costs, value: Column, dp_units: Column | float = 1.0) -> Column:
    if not costs.enabled:
        return F.lit(0.0)
    units = F.lit(dp_units) if isinstance(dp_units, (int, float)) else dp_units
    return _levies(costs, value) + value * costs.stt_sell_pct + units * costs.dp_charge


def slipped(costs: Costs, price: Column, bps: Column, side: str) -> Column:
    """Buys fill above the price, sales below it."""
    if not costs.enabled:
        return price
    return price * (1.0 + (bps if side == "buy" else -bps) / 10_000.0)
