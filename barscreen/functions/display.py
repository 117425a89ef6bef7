"""How amounts are shown to people: digits in lakhs and crores, shares as percent, blanks as a dash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NONE = "–"
CRORE, LAKH = 10_000_000, 100_000


def _shown(value: Column, text: Column) -> Column:
    return F.when(value.isNull() | F.isnan(value), F.lit(NONE)).otherwise(text)


def _fixed(value: Column, places: int) -> Column:
    """A number with so many decimals, halves away from zero, without separators."""
    units = F.floor(F.abs(value) * 10**places + 0.5).cast("decimal(38,0)")
    text = units.cast("string") if places == 0 else (units.cast(f"decimal(38,{places})") / F.lit(10**places).cast("decimal(10,0)")).cast(f"decimal(38,{places})").cast("string")
    return F.concat(F.when((value < 0) & (units > 0), F.lit("-")).otherwise(F.lit("")), text)


def grouped(value: Column, places: int = 2) -> Column:
    """12,34,567.89: the last three digits before the point, then groups of two."""
    value = value.cast("double")
    fixed = _fixed(value, places)
    whole = F.regexp_extract(fixed, r"^-?([0-9]+)", 1)
    sign, rest = F.when(fixed.startswith("-"), F.lit("-")).otherwise(F.lit("")), F.regexp_extract(fixed, r"(\.[0-9]+)$", 1)
    head, last = F.left(whole, F.greatest(F.length(whole) - 3, F.lit(0))), F.right(whole, F.lit(3))
    pairs = F.regexp_replace(head, r"(?<=[0-9])(?=(?:[0-9]{2})+$)", ",")
    return _shown(value, F.concat(sign, F.when(head == "", F.lit("")).otherwise(F.concat(pairs, F.lit(","))), last, rest))


def short_amount(value: Column) -> Column:
    """1.2cr from a crore on, 3.4L from a lakh on, whole below that."""
    value = value.cast("double")
    large = F.when(value >= CRORE, F.concat(_fixed(value / CRORE, 1), F.lit("cr"))).when(value >= LAKH, F.concat(_fixed(value / LAKH, 1), F.lit("L")))
    return _shown(value, F.coalesce(large, _fixed(value, 0)))


def percent(value: Column, places: int = 1) -> Column:
    value = value.cast("double")
    return _shown(value, F.concat(_fixed(value * 100, places), F.lit("%")))


def tidy(value: Column) -> Column:
    """Six significant digits at most, no zeros behind them: for numbers in files."""
    value = value.cast("double")
    magnitude = F.floor(F.log10(F.nullif(F.abs(value), F.lit(0.0)))).cast("int")
    scale = F.pow(F.lit(10.0), F.lit(5) - magnitude)
    return F.when(value == 0, F.lit(0.0)).otherwise(F.round(value * scale) / scale)


def csv_cell(value: Column) -> Column:
    """Text for a CSV file: quoted if it holds a comma, a quote or a line break; null is empty."""
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(value.rlike('[",\n\r]'), quoted).otherwise(value), F.lit(""))
