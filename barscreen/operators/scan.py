"""Exponential averages as an associative scan, in built-in expressions.

A step of such an average is an affine map of the value before: y = a * before + b * x. Maps compose to maps, so the rows of
a key are cut into chunks by their number, and in each chunk all prefixes are composed at once by two window sums: with
W the sum of the logarithms of a, y = exp(W) * (entering + sum of b * x * exp(-W)). What enters a chunk comes from the maps
of the chunks before, one for each chunk of some hundred rows, composed in their order. So a chunk is the largest piece of
work that goes through one task in order, but for the maps of a key's chunks.

A step after missing values decays for them too: after g steps the weights are (1 - w) ** g and w, over their sum.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows in a chunk at most, and the largest exponent that its weights may come to.
CHUNK, EXPONENT = 256, 300.0


def chunk_rows(weights: list[float]) -> int:
    """How many rows a chunk may have, so that the decay over it is a number that doubles hold well."""
    fastest = max([-math.log1p(-w) for w in weights if w < 1], default=1.0)
    return max(1, min(CHUNK, int(EXPONENT / fastest)))


def averages(rows: DataFrame, passes: dict[str, tuple[str, float]], key: str, order: str) -> DataFrame:
    """rows and a column for each pass (name: (column, weight)): the average of the column so far, by key in the given order.

    It starts with the first value that isn't null, keeps its value where there is none, and is null before the first.
    key and order together are unique. A weight of 1 gives the last value itself.
    """
    sources = sorted({c for c, _ in passes.values()})
    slow = {n: (c, w) for n, (c, w) in passes.items() if w < 1}
    last = Window.partitionBy(key).orderBy(order)
    so_far, before = last.rowsBetween(Window.unboundedPreceding, 0), last.rowsBetween(Window.unboundedPreceding, -1)
    x = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in sources}
    found = rows.withColumn("_n", F.row_number().over(last)).withColumns({f"_x_{c}": v for c, v in x.items()})
    seen = {f"_seen_{c}": F.last(F.when(F.col(f"_x_{c}").isNotNull(), F.col("_n")), ignorenulls=True).over(before) for c in sources}
    found = found.withColumns(seen).withColumn("_chunk", F.floor((F.col("_n") - 1) / chunk_rows([w for _, w in passes.values()])))
    own = Window.partitionBy(key, "_chunk").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)

    def steps(c: str, w: float) -> tuple[Column, Column]:
        """(logarithm of a, b * x) of a row: no change where there is no value, and nothing to decay before the first one."""
        there, first = F.col(f"_x_{c}").isNotNull(), F.col(f"_seen_{c}").isNull()
        decay = (F.col("_n") - F.col(f"_seen_{c}")) * F.lit(math.log1p(-w))
        total = F.exp(decay) + w
        log_a = F.when(there & ~first, F.greatest(decay - F.ln(total), F.lit(-EXPONENT))).otherwise(F.lit(0.0))
        return log_a, F.when(there & first, F.col(f"_x_{c}")).when(there, F.lit(w) / total * F.col(f"_x_{c}")).otherwise(F.lit(0.0))

    each = {n: steps(c, w) for n, (c, w) in slow.items()}
    found = found.withColumns({f"_w_{n}": F.sum(a).over(own) for n, (a, _) in each.items()})
    found = found.withColumns({f"_s_{n}": F.sum(b * F.exp(-F.col(f"_w_{n}"))).over(own) for n, (_, b) in each.items()})
    if slow:
        entering = _entering(found, list(slow), key)
        found = found.join(entering, (F.col(key) == F.col("_key")) & (F.col("_chunk") == F.col("_of")), "left")
    out = {}
    for k, (n, (c, _)) in enumerate(slow.items()):
        value = F.exp(F.col(f"_w_{n}")) * (F.coalesce(F.get("_in", F.lit(k)), F.lit(0.0)) + F.col(f"_s_{n}"))
        out[n] = F.when(F.col(f"_x_{c}").isNotNull() | F.col(f"_seen_{c}").isNotNull(), value)
    out |= {n: F.last(f"_x_{c}", ignorenulls=True).over(so_far) for n, (c, w) in passes.items() if w >= 1}
    return found.withColumns(out).select(*rows.columns, *passes)


def _entering(found: DataFrame, names: list[str], key: str) -> DataFrame:
    """(_key, _of, _in): the values that enter each chunk but the first, out of a row for each chunk."""
    ends = [F.array(*[F.max_by(f"_{kind}_{n}", "_n") for n in names]).alias(kind) for kind in ("w", "s")]
    maps = found.groupBy(F.col(key).alias("_key"), "_chunk").agg(*ends).filter(F.col("_key").isNotNull())
    listed = maps.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("_chunk", "w", "s"))).alias("maps"))
    nothing = F.array_repeat(F.lit(0.0), len(names))
    state = F.struct(F.array().cast("array<array<double>>").alias("out"), nothing.alias("y"))

    def through(state: Column, step: Column) -> Column:
        left = F.zip_with(F.zip_with(state["y"], step["s"], lambda y, s: y + s), step["w"], lambda v, w: v * F.exp(w))
        return F.struct(F.concat(state["out"], F.array(left)).alias("out"), left.alias("y"))

    after = listed.select("_key", F.transform("maps", lambda m: m["_chunk"]).alias("chunks"), F.aggregate("maps", state, through)["out"].alias("out"))
    each = after.select("_key", F.explode(F.arrays_zip("chunks", "out")).alias("x"))
    return each.select("_key", (F.col("x.chunks") + 1).alias("_of"), F.col("x.out").alias("_in"))
