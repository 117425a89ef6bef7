"""Daily bar files and action files as DataFrames: two CSV layouts, zipped or not, and a JSON layout.

Any number of files are parsed in one job. Each brings its own header, so the places of its columns are looked up for each
file before its lines are split; both layouts may be among them. What is no number becomes null. Whatever would make a
session doubtful (a damaged archive, a missing column, no row left, another day's rows) is found for each file and noted
beside it, and the others are taken.
"""

from __future__ import annotations

import datetime as dt
import io
import zipfile
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barscreen.config import Universe
from barscreen.functions import text
from barscreen.schemas import PRICES

# The columns of the two layouts, and what each becomes.
UDIFF = {
    "symbol": "TckrSymb", "trade_date": "TradDt", "isin": "ISIN", "series": "SctySrs", "open": "OpnPric", "high": "HghPric", "low": "LwPric", "close": "ClsPric", "prev_close": "PrvsClsgPric",
    "volume": "TtlTradgVol", "turnover": "TtlTrfVal", "trades": "TtlNbOfTxsExctd",
}
LEGACY = {
    "symbol": "SYMBOL", "trade_date": "TIMESTAMP", "isin": "ISIN", "series": "SERIES", "open": "OPEN", "high": "HIGH", "low": "LOW", "close": "CLOSE", "prev_close": "PREVCLOSE", "volume": "TOTTRDQTY",
    "turnover": "TOTTRDVAL", "trades": "TOTALTRADES",
}
LAYOUTS = {"udiff": (UDIFF, (), "FinInstrmTp"), "legacy": (LEGACY, ("ISIN", "TOTALTRADES"), None)}  # columns, those that may be missing, instrument type


class ParseError(ValueError):
    """A file that must not be stored."""


def unzipped(content: bytes) -> tuple[str | None, str | None]:
    """The text of the one file in an archive, or what is wrong with it."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            names = archive.namelist()
            if len(names) != 1:
                return None, f"expected one file in the archive, found {len(names)}"
            return archive.read(names[0]).decode("utf-8", errors="replace"), None
    except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError) as error:
        return None, f"the archive can't be read: {error}"


LANDED = "path string, arrived timestamp, sha string, text string, problem string"


def landed(contents: DataFrame) -> DataFrame:
    """LANDED of files as Spark's binaryFile source has them: CSV files, and zipped ones, which Spark's CSV reader doesn't open."""

    @F.pandas_udf("struct<text: string, problem: string>")
    def unzip(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([unzipped(bytes(c)) for c in content], columns=["text", "problem"])

    about = ["path", F.col("modificationTime").alias("arrived"), F.sha2("content", 256).alias("sha")]
    zipped = F.lower("path").endswith(".zip")
    plain = contents.filter(~zipped).select(*about, F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.lit(None).cast("string").alias("problem"))
    return plain.union(contents.filter(zipped).select(*about, unzip("content").alias("z")).select("path", "arrived", "sha", "z.text", "z.problem"))


def landed_at(spark: SparkSession, *paths: str) -> DataFrame:
    """LANDED of the files at some paths; Spark passes over files without a byte."""
    return landed(spark.read.format("binaryFile").load(list(paths)))


LINE_BREAK = "\r?\n"
OUTSIDE_QUOTES = '(?=(?:[^"]*"[^"]*")*[^"]*$)'


def _split(text: Column, at: str) -> Column:
    """text cut at a pattern, but not inside double quotes; the dear pattern only where there is a quote."""
    return F.when(F.contains(text, F.lit('"')), F.split(text, at + OUTSIDE_QUOTES, -1)).otherwise(F.split(text, at, -1))


def _unquoted(field: Column) -> Column:
    trimmed = F.trim(field)
    inner = F.substring(trimmed, F.lit(2), F.length(trimmed) - 2)
    return F.when(trimmed.rlike('(?s)^".*"$') & (F.length(trimmed) >= 2), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(field)


def _headed(files: DataFrame) -> DataFrame:
    """files with their lines, layout, places of columns (from 1, 0 for none) and, if there is one, their problem."""
    lines = _split(F.coalesce("text", F.lit("")), LINE_BREAK)
    header = F.regexp_replace(F.get("lines", F.lit(0)), "^\ufeff", "")
    names = F.transform(F.split(header, ",", -1), lambda c: F.trim(F.regexp_replace(F.trim(c), '^"|"$', "")))
    found = files.withColumn("lines", lines).withColumn("names", names)
    own = F.when(F.array_contains("names", UDIFF["symbol"]), F.lit("udiff")).when(F.array_contains("names", LEGACY["symbol"]), F.lit("legacy"))
    found = found.withColumn("layout", F.coalesce("layout", own))
    missing, places = F.lit(None).cast("string"), {}
    for name, (columns, optional, instrument) in LAYOUTS.items():
        needed = {*columns.values(), *([instrument] if instrument else [])} - set(optional)
        gone = F.array_sort(F.array_except(F.array(*[F.lit(c) for c in sorted(needed)]), "names"))
        said = F.concat(F.lit(f"{name}: columns missing: "), F.array_join(gone, ", "))
        missing = F.when((F.col("layout") == name) & (F.size(gone) > 0), said).otherwise(missing)
    for c in (*UDIFF, "instrument"):
        named = {name: columns.get(c, instrument) for name, (columns, _, instrument) in LAYOUTS.items()}
        at = [F.when(F.col("layout") == name, F.array_position("names", column)) for name, column in named.items() if column]
        places[c] = F.coalesce(*at, F.lit(0)).cast("int")
    problem = F.coalesce(
        "problem",
        F.when(F.trim(F.regexp_replace(F.array_join("lines", ""), "^\ufeff", "")) == "", "the file is empty"),
        F.when(F.col("layout").isNull(), "the header is of no known layout"),
        F.when(~F.col("layout").isin(*LAYOUTS), F.concat(F.lit("there is no layout "), "layout")),
        missing,
    )
    return found.withColumns({"problem": problem, "at": F.struct(*[v.alias(k) for k, v in places.items()])}).drop("names", "text")


def parsed(files: DataFrame, universe: Universe) -> DataFrame:
    """Bars (PRICES) of files (LANDED, and optionally `layout` and `expected` date for each), each with `path`; and a row of
    each file itself, with `is_file` set, that says what is known of it.

    Rows that end before their close are left out, as are empty lines; a blank close is a bar without a close, which keeps
    its session. A file is one row until its lines are split, so it must be small, as the files of one session are.
    """
    for c, kind in (("layout", "string"), ("expected", "date")):
        if c not in files.columns:
            files = files.withColumn(c, F.lit(None).cast(kind))
    headed = _headed(files)
    lines = F.when(F.col("problem").isNull(), F.col("lines")).otherwise(F.slice("lines", 1, 1))
    rows = headed.select("path", "arrived", "sha", "layout", "expected", "problem", "at", F.posexplode(lines).alias("nth", "line"))
    rows = rows.withColumns({"is_file": F.col("nth") == 0, "f": _split(F.col("line"), ",")})
    field = {c: _unquoted(F.get("f", F.col(f"at.{c}") - 1)) for c in (*UDIFF, "instrument")}
    kept = (F.trim("line") != "") & (F.size("f") >= F.col("at.close")) & F.trim(field["series"]).isin(*universe.series)
    kept &= (F.col("at.instrument") == 0) | F.trim(field["instrument"]).isin(*universe.instrument_types)
    for pattern in universe.exclude_symbols:
        kept &= ~F.trim(field["symbol"]).rlike(pattern)
    raw = field["trade_date"]
    day = F.when(F.col("layout") == "udiff", F.try_to_timestamp(F.trim(raw), F.lit("yyyy-MM-dd")).cast("date")).otherwise(text.bar_date(raw))
    made = {"symbol": F.trim(field["symbol"]), "trade_date": day, "isin": F.nullif(F.trim(field["isin"]), F.lit("")), "series": F.trim(field["series"])}
    made |= {c: text.number(field[c]) for c in ("open", "high", "low", "close", "prev_close")}
    made |= {"volume": text.whole(field["volume"]), "turnover": text.number(field["turnover"]), "trades": text.whole(field["trades"])}
    bar = [F.when(~F.col("is_file"), v).alias(k) for k, v in made.items()]
    return rows.filter(F.col("is_file") | F.coalesce(kept, F.lit(False))).select("path", "is_file", "arrived", "sha", "layout", "expected", "problem", *bar)


def file_report(rows: DataFrame) -> DataFrame:
    """(path, arrived, sha, layout, expected, rows, first_day, last_day, problem) for each file of parsed rows; problem is null if it is fit."""
    bar = F.when(~F.col("is_file"), F.lit(1))
    known = [F.max(c).alias(c) for c in ("arrived", "sha", "layout", "expected", "problem")]
    found = rows.groupBy("path").agg(*known, F.count(bar).alias("rows"), F.count("trade_date").alias("dated"), F.min("trade_date").alias("first_day"), F.max("trade_date").alias("last_day"))
    other = F.col("expected").isNotNull() & ((F.col("first_day") != F.col("expected")) | (F.col("last_day") != F.col("expected")))
    days = F.when(F.col("first_day") == F.col("last_day"), F.col("first_day").cast("string")).otherwise(F.concat("first_day", F.lit(" to "), "last_day"))
    problem = F.coalesce(
        "problem",
        F.when(F.col("rows") == 0, F.concat("layout", F.lit(": no rows are left in the universe"))),
        F.when(F.col("dated") < F.col("rows"), F.concat("layout", F.lit(": "), (F.col("rows") - F.col("dated")).cast("string"), F.lit(" dates can't be read"))),
        F.when(other, F.concat("layout", F.lit(": the file for "), F.col("expected").cast("string"), F.lit(" has rows of "), days)),
    )
    return found.withColumn("problem", problem).drop("dated")


def fit_bars(rows: DataFrame, report: DataFrame) -> DataFrame:
    """(path and PRICES) of the files without a problem; of several files with rows of one day the last to arrive counts."""
    fit = report.filter("problem IS NULL").select("path")
    bars = rows.filter(~F.col("is_file")).join(fit, "path", "left_semi")
    last = bars.groupBy("trade_date").agg(F.max(F.struct("arrived", "path")).alias("last")).select("trade_date", F.col("last.path").alias("path"))
    return bars.join(last, ["trade_date", "path"], "left_semi").select("path", *[c.split()[0] for c in PRICES.split(", ")])


def read_bars(spark: SparkSession, path: str, layout: str, universe: Universe, expected: dt.date | None = None) -> DataFrame:
    """A session's bars; raises ParseError if a file has a problem."""
    rows = parsed(landed_at(spark, path).withColumns({"layout": F.lit(layout), "expected": F.lit(expected).cast("date")}), universe)
    for (problem,) in file_report(rows).filter("problem IS NOT NULL").select("problem").limit(1).collect():
        raise ParseError(problem)
    return rows.filter(~F.col("is_file")).select(*[c.split()[0] for c in PRICES.split(", ")])


ACTION_FIELDS = "symbol string, series string, exDate string, subject string, isin string, faceVal string"


def actions_from(rows: DataFrame, universe: Universe) -> DataFrame:
    """Corporate actions of ACTION_FIELDS; rows without a symbol, a subject or a date that can be read are left out."""
    trimmed = {c: F.trim(F.coalesce(c, F.lit(""))) for c in ("symbol", "series", "subject", "isin")}
    typed = rows.select(
        *[c for c in rows.columns if c == "arrived"],
        trimmed["symbol"].alias("symbol"),
        text.ex_date(F.col("exDate")).alias("ex_date"),
        F.nullif(trimmed["isin"], F.lit("")).alias("isin"),
        trimmed["series"].alias("series"),
        text.classify(trimmed["subject"]).alias("action_type"),
        trimmed["subject"].alias("subject"),
        F.nullif(text.number(F.col("faceVal")), F.lit(0.0)).alias("face_value"),
    )
    kept = typed.filter((F.col("symbol") != "") & (F.col("subject") != "") & F.col("ex_date").isNotNull())
    if universe.series:
        kept = kept.filter(F.col("series").isin(*universe.series))
    subject, kind = F.col("subject"), F.col("action_type")
    read = kept.withColumn("read", text.read_factor(subject, kind))
    return read.select(*kept.columns, F.col("read.factor").alias("adj_factor"), "read.note")


def read_actions(spark: SparkSession, path: str, universe: Universe) -> DataFrame:
    """Corporate actions of JSON files (arrays of records); a file that is no JSON gives none. `arrived` is their order: by file name, then as in the file."""
    rows = spark.read.schema(ACTION_FIELDS).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    arrived = F.struct(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("nth"))  # a file of this kind is never split
    return actions_from(rows.withColumn("arrived", arrived), universe)
