"""Corporate actions: verification against the price gap, quarantine, cumulative factors and adjusted prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barscreen.config import Actions

FAR_PAST, FAR_FUTURE = "1990-01-01", "2999-12-31"
# Fixed value: the reason as it is stored.
MISMATCH = "corporate action ratio disagrees with price gap"


def action_products(actions: DataFrame) -> DataFrame:
    """(symbol, ex_date, parsed): factors that share an ex-date compound, and only their product is one gap."""
    return actions.filter("adj_factor is not null").groupBy("symbol", "ex_date").agg(F.product("adj_factor").alias("parsed"))


def verdicts(actions: DataFrame, prices: DataFrame, settings: Actions) -> DataFrame:
    """(symbol, ex_date, parsed, observed, deviation, verification).

    Prices are by far the larger side: the actions' keys filter them first, and what is left joins the actions.
    """
    parsed = action_products(actions)
    at = prices.select("symbol", F.col("trade_date").alias("ex_date"), (F.col("prev_close") / F.nullif(F.col("open"), F.lit(0.0))).alias("observed"))
    gaps = at.join(parsed.select("symbol", "ex_date"), ["symbol", "ex_date"], "left_semi")
    found = parsed.join(gaps, ["symbol", "ex_date"], "left")
    deviation = F.abs(F.col("parsed") / F.nullif(F.col("observed"), F.lit(0.0)) - 1)
    verdict = F.when(F.col("observed").isNull(), "unverified").when(F.col("deviation") <= settings.tolerance, "verified").otherwise("mismatch")
    return found.withColumn("deviation", deviation).withColumn("verification", verdict)


def verified(actions: DataFrame, prices: DataFrame, settings: Actions) -> DataFrame:
    """actions with observed, deviation and verification set on every row that has a factor; other rows stay as they are."""
    new = verdicts(actions, prices, settings).select("symbol", "ex_date", *[F.col(c).alias(f"_{c}") for c in ("observed", "deviation", "verification")])
    joined = actions.join(new, ["symbol", "ex_date"], "left")
    has = F.col("adj_factor").isNotNull()
    return joined.withColumns({c: F.when(has, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("observed", "deviation", "verification")}).select(actions.columns)


def quarantined(actions: DataFrame, settings: Actions) -> DataFrame:
    """Windows around demergers and mismatches; one row for each symbol, first day and reason."""
    demerger = F.col("action_type") == "demerger"
    rows = actions.filter(demerger | (F.col("verification") == "mismatch"))
    return rows.select(
        "symbol",
        F.date_sub("ex_date", settings.quarantine_before).alias("from_date"),
        F.date_add("ex_date", settings.quarantine_after).alias("to_date"),
        F.when(demerger, "demerger").otherwise(MISMATCH).alias("reason"),
    ).distinct()


def intervals(actions: DataFrame) -> DataFrame:
    """(symbol, start_date, end_date, cum_factor), half open: the product of all verified factors still to come.

    Spans without an effect are left out, but for the open one after a symbol's last action.
    """
    events = action_products(actions.filter("verification = 'verified'")).withColumnRenamed("parsed", "f")
    latest_first = Window.partitionBy("symbol").orderBy(F.col("ex_date").desc()).rowsBetween(Window.unboundedPreceding, 0)
    start = F.coalesce(F.lag("ex_date").over(Window.partitionBy("symbol").orderBy("ex_date")), F.lit(FAR_PAST).cast("date"))
    spans = events.select("symbol", start.alias("start_date"), F.col("ex_date").alias("end_date"), F.product("f").over(latest_first).alias("cum_factor"))
    tail = events.groupBy("symbol").agg(F.max("ex_date").alias("start_date")).select("symbol", "start_date", F.lit(FAR_FUTURE).cast("date").alias("end_date"), F.lit(1.0).alias("cum_factor"))
    return spans.filter("cum_factor <> 1.0").unionByName(tail)


def adjusted(prices: DataFrame, spans: DataFrame) -> DataFrame:
    """prices on today's basis: prices divided, volume multiplied by the factor of the span that the date is in."""
    s = spans.withColumnRenamed("symbol", "_s")
    inside = (F.col("symbol") == F.col("_s")) & (F.col("trade_date") >= F.col("start_date")) & (F.col("trade_date") < F.col("end_date"))
    factor = F.coalesce("cum_factor", F.lit(1.0))
    joined = prices.join(s, inside, "left")
    changed = {c: F.col(c) / factor for c in ("open", "high", "low", "close", "prev_close")}
    return joined.withColumns({**changed, "volume": F.round(F.col("volume") * factor).cast("bigint")}).select(prices.columns)
