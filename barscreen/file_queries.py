"""Queries on files, texts, days and amounts, all of which Spark makes from columns of the tables."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barscreen.functions import costs as charges
from barscreen.functions import display, text
from barscreen.plans import daily, report
from barscreen.queries import _BONUS, _FACTOR, _PLACED, _TYPE, config, query, rounded
from barscreen.schemas import PRICES
from barscreen.sources import files, proxy

# ---- landed files of both layouts --------------------------------------------------------------------------------

#: By day: plain, old layout, columns turned round and quoted, another day's rows, a column missing, old layout.
KINDS = 6
_UDIFF = ("TradDt", "TckrSymb", "SctySrs", "FinInstrmTp", "ISIN", "OpnPric", "HghPric", "LwPric", "ClsPric", "PrvsClsgPric", "TtlTradgVol", "TtlTrfVal", "TtlNbOfTxsExctd")
_LEGACY = ("SYMBOL", "SERIES", "OPEN", "HIGH", "LOW", "CLOSE", "LAST", "PREVCLOSE", "TOTTRDQTY", "TOTTRDVAL", "TIMESTAMP", "TOTALTRADES", "ISIN", "")


def _landed(bars: DataFrame) -> DataFrame:
    """A file for each session of bars."""
    day = F.col("trade_date")
    kind = F.pmod(F.unix_date(day), F.lit(KINDS))
    known = {
        "symbol": F.when(kind == 2, F.concat(F.lit('"'), "symbol", F.lit('"'))).otherwise(F.col("symbol")),
        "series": F.when(F.col("volume") % 11 == 0, "BE").otherwise("EQ"),
        "close": F.when(F.col("volume") % 7 == 0, "-").otherwise(F.col("close").cast("string")),
        "isin": F.concat(F.lit("IN"), "symbol"),
        **{c: F.col(c).cast("string") for c in ("open", "high", "low", "volume", "turnover", "trades")},
    }
    own = {files.UDIFF[c]: v for c, v in known.items()} | {files.LEGACY[c]: v for c, v in known.items()}
    own |= {"TradDt": F.date_add(day, F.when(kind == 3, 1).otherwise(0)).cast("string"), "FinInstrmTp": F.lit("STK"), "TIMESTAMP": F.upper(F.date_format(day, "dd-MMM-yyyy"))}

    def line(names: tuple[str, ...]) -> Column:
        return F.concat_ws(",", *[own.get(n, F.lit("")) for n in names])

    layouts = {1: _LEGACY, 2: _UDIFF[::-1], 4: tuple(n for n in _UDIFF if n != "ClsPric"), 5: _LEGACY}
    row, header = line(_UDIFF), F.lit(",".join(_UDIFF))
    for k, names in layouts.items():
        row, header = F.when(kind == k, line(names)).otherwise(row), F.when(kind == k, F.lit(",".join(names))).otherwise(header)
    texts = bars.select(day, header.alias("header"), row.alias("row")).groupBy("trade_date", "header").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    return texts.select(
        F.date_format("trade_date", "yyyyMMdd").alias("path"),
        F.lit("2025-01-01").cast("timestamp").alias("arrived"),
        F.lit("").alias("sha"),
        F.concat_ws("\n", "header", F.array_join("rows", "\n")).alias("text"),
        F.lit(None).cast("string").alias("problem"),
        F.col("trade_date").alias("expected"),
    )


_BY_KIND = f"""{proxy.BARS}, told AS (SELECT *, trade_date - DATE '1970-01-01' AS n, ((trade_date - DATE '1970-01-01') % {KINDS} + {KINDS}) % {KINDS} AS kind FROM bars)"""


@query(
    f"""WITH {_BY_KIND} SELECT strftime(trade_date, '%Y%m%d') AS path, symbol, trade_date, 'IN' || symbol AS isin, 'EQ' AS series, open, high, low, CASE WHEN volume % 7 <> 0 THEN close END AS close,
    CAST(NULL AS DOUBLE) AS prev_close, volume, turnover, trades FROM told WHERE kind IN (0, 1, 2, 5) AND volume % 11 <> 0"""
)
def file_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars of all files that are fit, of both layouts and any order of columns, parsed in one job."""
    rows = files.parsed(_landed(proxy.bars(spark, sf_dir)), config().universe)
    return files.fit_bars(rows, files.file_report(rows)).select("path", *[c.split()[0] for c in PRICES.split(", ")])


@query(
    f"""WITH {_BY_KIND}, f AS (SELECT trade_date, kind, CASE WHEN kind IN (1, 5) THEN 'legacy' ELSE 'udiff' END AS layout, CASE WHEN kind = 4 THEN 0 ELSE count(*) FILTER (volume % 11 <> 0) END AS rows FROM told GROUP BY trade_date, kind)
    SELECT strftime(trade_date, '%Y%m%d') AS path, layout, rows, CASE WHEN kind = 4 THEN 'udiff: columns missing: ClsPric' WHEN rows = 0 THEN layout || ': no rows are left in the universe'
        WHEN kind = 3 THEN 'udiff: the file for ' || trade_date || ' has rows of ' || CAST(trade_date + INTERVAL 1 DAY AS DATE) END AS problem FROM f"""
)
def file_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each file, if anything is."""
    rows = files.parsed(_landed(proxy.bars(spark, sf_dir)), config().universe)
    return files.file_report(rows).select("path", "layout", "rows", "problem")


# ---- days without a settled session ------------------------------------------------------------------------------

_RANGES = ((0, "udiff", "1996-01-01", None), (1, "legacy", None, "1996-06-30"), (2, "archive", "1993-01-01", "1995-12-31"))
_TODAY = "1998-08-02"


@query(
    f"""WITH span AS (SELECT min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS b FROM orders),
    days AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM span),
    settled AS (SELECT CAST(o_orderdate AS DATE) AS day FROM orders GROUP BY 1 HAVING count(*) % 3 = 0),
    ranges AS (SELECT * FROM (VALUES {', '.join(f"({k}, '{n}', {'DATE ' + repr(a) if a else 'NULL::DATE'}, {'DATE ' + repr(b) if b else 'NULL::DATE'})" for k, n, a, b in _RANGES)}) AS v(priority, source, a, b))
    SELECT day, min_by(source, priority) AS source, date_diff('day', day, DATE '{_TODAY}') >= 2 AS absent FROM days LEFT JOIN ranges ON coalesce(a <= day, true) AND coalesce(day <= b, true)
    WHERE isodow(day) < 6 AND day NOT IN (FROM settled) GROUP BY day"""
)
def open_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekdays of orders that have no settled session, with the source to ask and what a missing file means."""
    dated = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderdate").cast("date").alias("day"))
    days = dated.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day")).filter(F.weekday("day") < 5)
    settled = dated.groupBy("day").count().filter("count % 3 = 0").select("day")
    sources = spark.createDataFrame(list(_RANGES), "priority int, source string, first_day string, last_day string")
    sources = sources.select("priority", "source", F.to_date("first_day").alias("first_day"), F.to_date("last_day").alias("last_day"))
    return daily.open_days(days, sources, settled, F.lit(_TODAY).cast("date"), config().ingest.holiday_confirm_after_days)


@query(
    """SELECT CAST(o_orderdate AS DATE) AS day, 'https://host/' || strftime(CAST(o_orderdate AS DATE), '%Y') || '/' || upper(strftime(CAST(o_orderdate AS DATE), '%b')) || '/cm' || strftime(CAST(o_orderdate AS DATE), '%d%m%Y') || '_'
    || strftime(CAST(o_orderdate AS DATE), '%Y%m%d') || '.zip' AS url FROM orders GROUP BY 1"""
)
def file_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the file of each day would be."""
    days = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return days.withColumn("url", text.dated("https://host/{yyyy}/{MON}/cm{dd}{mm}{yyyy}_{yyyymmdd}.zip", F.col("day")))


# ---- subjects, numbers and dates ---------------------------------------------------------------------------------

_SUBJECTS = (
    "'Bonus ' || {a} || ':' || {b}", "'Bonus Issue ' || {a} || ' : ' || {b}", "'Face Value Split - From Rs ' || {a} || '/- Per Share To Rs ' || {b} || '/- Per Share'", "'Consolidation From Re.' || {b} || ' To Rs.' || {a} || '/-'",
    "'Bonus ' || {a} || ':' || {b} || ' / Sub-Division From Rs.' || {c} || ' To Re ' || {b}", "'Scheme Of Arrangement ' || {a}", "'Bonus Debentures ' || {a} || ':' || {b}", "'Dividend - Rs ' || {c} || ' Per Share'",
    "'Split From ' || {a} || ' To ' || {b}", "'Bonus - ' || {a} || ':' || {b}", "'Bonus 0:0, ' || {a} || ' : ' || {b}", "'Split To Rs ' || {b} || ' From Rs ' || {a} || ' To Rs ' || {c}",
)
_SUBJECT = "CASE p_partkey % 12 " + " ".join(f"WHEN {k} THEN {s.format(a='p_size', b='(p_partkey % 7)', c='p_retailprice')}" for k, s in enumerate(_SUBJECTS)) + " END"
_TYPED_PARTS = f"typed AS (SELECT p_partkey, subject, {_TYPE} AS action_type FROM (SELECT p_partkey, {_SUBJECT} AS subject FROM part) AS s)"


@query(f"WITH {_TYPED_PARTS}, {_PLACED} SELECT p_partkey, action_type, round({_FACTOR}, 6) AS factor, {_BONUS} IS NULL AND contains(action_type, 'bonus') AS no_bonus FROM ratios")
def subject_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type and factor of subjects that name sizes and prices of parts."""
    subject, kind = F.col("subject"), F.col("action_type")
    made = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.expr(_SUBJECT).alias("subject")).withColumn("action_type", text.classify(subject))
    noted = F.contains(F.coalesce("read.note", F.lit("")), F.lit("bonus")) & F.contains(kind, F.lit("bonus"))
    return rounded(made.withColumn("read", text.read_factor(subject, kind)).select("p_partkey", "action_type", "read.factor", noted.alias("no_bonus")))


_RAW = "CASE l_linenumber % 5 WHEN 0 THEN '-' WHEN 1 THEN ' ' || l_extendedprice || ' ' WHEN 2 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR(20)) WHEN 3 THEN '' ELSE 'x' || l_quantity END"


@query(
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, TRY_CAST(nullif(trim(raw), '') AS DOUBLE) AS value, CAST(trunc(TRY_CAST(nullif(trim(raw), '') AS DOUBLE)) AS BIGINT) AS whole, CAST(l_shipdate AS DATE) AS day
    FROM (SELECT *, {_RAW} AS raw FROM lineitem) AS x"""
)
def column_numbers_and_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and dates read back from text: blanks, dashes and words are null, years of two and of four digits are dates."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("raw", F.expr(_RAW.replace("VARCHAR(20)", "STRING")))
    day = F.col("l_shipdate").cast("date")
    told = F.when(F.col("l_linenumber") % 2 == 0, F.upper(F.date_format(day, "dd-MMM-yyyy"))).otherwise(F.date_format(day, "dd-MMM-yy"))
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.number(F.col("raw")).alias("value"), text.whole(F.col("raw")).alias("whole"), text.bar_date(told).alias("day"))


# ---- amounts -----------------------------------------------------------------------------------------------------

_AMOUNT = "CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN -o_totalprice WHEN o_orderkey % 5 = 1 THEN o_totalprice * 1000 WHEN o_orderkey % 5 = 2 THEN o_totalprice / 1000 ELSE o_totalprice END"
#: A number of hundredths, as text with groups of two before the last three digits: from the right, cut and turned round.
_GROUPED = """(CASE WHEN v < 0 AND cents > 0 THEN '-' ELSE '' END || CASE WHEN length(w) > 3 THEN reverse(array_to_string(list_transform(range(0, (length(w) - 2) // 2), lambda k: substr(reverse(w[:length(w) - 3]), k * 2 + 1, 2)), ',')) || ',' ELSE '' END
    || right(w, 3) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0'))"""


@query(
    f"""WITH a AS (SELECT o_orderkey, CAST({_AMOUNT} AS DOUBLE) AS v FROM orders), c AS (SELECT *, CAST(round(abs(v) * 100) AS BIGINT) AS cents FROM a), t AS (SELECT *, CAST(cents // 100 AS VARCHAR) AS w FROM c)
    SELECT o_orderkey, CASE WHEN v IS NULL THEN '–' ELSE {_GROUPED} END AS shown, CASE WHEN v IS NULL THEN '–' WHEN v >= 1e7 THEN 'cr' WHEN v >= 1e5 THEN 'L' ELSE '' END AS unit FROM t"""
)
def indian_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts of orders with their digits in lakhs and crores, and the unit that a short form has."""
    amounts = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.expr(_AMOUNT).cast("double").alias("v"))
    return amounts.select("o_orderkey", display.grouped(F.col("v")).alias("shown"), F.regexp_extract(display.short_amount(F.col("v")), "([a-zA-Z–]*)$", 1).alias("unit"))


_CAPPED = dataclasses.replace(config().costs, brokerage_pct=0.0003, brokerage_flat=20.0)


@query(
    """SELECT o_orderkey, round(l + l * 0.18 + v * 0.001 + v * 0.00015, 3) AS buy_cost, round(l + l * 0.18 + v * 0.001 + 15.93, 3) AS sell_cost, round(b, 3) AS brokerage, 0e0 AS free_buy, 0e0 AS free_sell, round(v, 3) AS free_fill
    FROM (SELECT *, b + v * 0.0000297 + v * 0.000001 AS l FROM (SELECT o_orderkey, o_totalprice AS v, least(o_totalprice * 0.0003, 20e0) AS b FROM orders) AS x) AS y"""
)
def capped_brokerage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs with a brokerage that is a share up to a flat amount; and with costs disabled."""
    v, free = F.col("o_totalprice"), dataclasses.replace(_CAPPED, enabled=False)
    made = {"buy_cost": charges.buy_costs(_CAPPED, v), "sell_cost": charges.sell_costs(_CAPPED, v), "brokerage": charges.brokerage(_CAPPED, v)}
    found = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", *[x.alias(k) for k, x in made.items()], charges.buy_costs(free, v).alias("free_buy"), charges.sell_costs(free, v).alias("free_sell"), charges.slipped(free, v, F.lit(40.0), "buy").alias("free_fill"))
    return rounded(found, 3)


# ---- positions ---------------------------------------------------------------------------------------------------

_HELD = """SELECT o_orderkey AS position_id, o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS entry_date, o_totalprice AS entry_price, 10 AS quantity,
    CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderdate + INTERVAL 30 DAY AS DATE) END AS exit_date, CASE WHEN o_orderstatus <> 'O' THEN o_totalprice * (1 + (o_custkey % 7 - 3) / 1e1) END AS exit_price,
    CASE WHEN o_orderstatus <> 'O' THEN 'manual' END AS exit_reason FROM {orders}"""


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_HELD, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))


@query(
    f"""SELECT position_id, symbol, entry_date, entry_price, quantity, exit_date, round(exit_price, 4) AS exit_price, exit_reason, round(exit_price / entry_price - 1, 6) AS realised_return
    FROM ({_HELD.format(orders="orders")}) AS h WHERE exit_date IS NOT NULL ORDER BY h.exit_date DESC, position_id LIMIT 100"""
)
def closed_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of positions that were closed last."""
    found = report.closed_positions(_held(spark, sf_dir))
    return found.withColumns({"exit_price": F.round("exit_price", 4), "realised_return": F.round("realised_return", 6)})


_ORDERS = (("nulls_first", "exit_date ASC NULLS FIRST, entry_date"), ("ascending", "exit_price ASC NULLS LAST"), ("descending", "exit_price DESC NULLS LAST"))


@query(
    " UNION ALL ".join(
        f"SELECT '{n}' AS list, CAST(place AS BIGINT) AS place, position_id FROM (SELECT position_id, row_number() OVER (ORDER BY {by}, position_id) AS place FROM ({_HELD.format(orders='orders')}) AS h) AS o WHERE place <= 50" for n, by in _ORDERS
    )
)
def position_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 of each list that a reader can ask for: open positions first, and by a column with nulls last."""
    held = _held(spark, sf_dir)
    lists = {"nulls_first": report.open_first(held), "ascending": report.by_column(held, "exit_price"), "descending": report.by_column(held, "exit_price", True)}
    parts = [df.select("position_id").limit(50).select(F.lit(n).alias("list"), F.monotonically_increasing_id().alias("place"), "position_id") for n, df in lists.items()]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.withColumn("place", F.col("place") % (1 << 33) + 1)


@query(
    f"""SELECT position_id, json_extract_string(j, '$.symbol') AS symbol, CAST(json_extract_string(j, '$.entry_price') AS DOUBLE) AS entry_price, json_extract_string(j, '$.exit_reason') AS exit_reason
    FROM (SELECT position_id, to_json(struct_pack(symbol := symbol, entry_price := entry_price, exit_reason := exit_reason)) AS j FROM ({_HELD.format(orders="orders")}) AS h) AS x"""
)
def json_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as JSON, as the shortlist log keeps them, read back by name."""
    held = _held(spark, sf_dir).select("position_id", "symbol", "entry_price", "exit_reason")
    kept = held.select("position_id", F.to_json(F.struct("symbol", "entry_price", "exit_reason")).alias("payload"))
    back = F.from_json("payload", "symbol string, entry_price double, exit_reason string")
    return kept.select("position_id", back.alias("p")).select("position_id", "p.*")
