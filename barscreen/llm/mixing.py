"""Mixing sources to target weights along a domain, language, source tree.

The budget goes down the tree by weight. A node never gets more than its leaves can give over `max_epochs` epochs, so
what a leaf is short of goes to its siblings first, and to other languages or domains only when no sibling has room.
Each leaf then takes whole epochs of its documents, and of one more epoch, in an order that the seed, the epoch and
doc_id fix, the longest prefix whose tokens fit into the rest. That prefix is given by one cutoff key for each leaf:
sums over 4096 ranges of the key find the range that it is in, and only that range's documents are put in order. Tokens
are those of the vocabulary that packing uses, counted once; documents and counts are written together, so choosing reads
narrow columns and is then a filter beside a join with the leaves' table. Texts aren't shuffled up to BROADCAST_LEAVES.
"""

from __future__ import annotations

from collections.abc import Mapping
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barscreen.llm.common import packed, small_batches, unpacked, written
from barscreen.llm.packing import encoded

LEAF = ("_domain", "_lang", "_source")
DOMAINS = ("web", "reference", "community")
DOMAIN_WEIGHTS = {"web": 5, "reference": 3, "community": 2}
LANG_WEIGHTS = {"en": 6, "de": 2, "fr": 2, "es": 2}
BROADCAST_LEAVES = 10_000


def domain_of(source: Column) -> Column:
    """A domain for each source of the test tables, by the number in its name; "other" without one."""
    number = F.try_element_at(F.regexp_extract_all(source, F.lit("([0-9]{1,9})")), F.lit(1)).cast("int")
    return F.coalesce(F.get(F.array(*map(F.lit, DOMAINS)), F.pmod(number, F.lit(len(DOMAINS)))), F.lit("other"))


def token_counts(text: Column) -> Column:
    """The number of tokens of a whole text, by the vocabulary that packing uses; a null or empty text has none."""

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(encoded(t)) if t else 0 for t in texts], dtype="int64")

    return count(text)


def shared_out(budget: int, children: list[tuple[str, int, int]]) -> dict[str, int]:
    """What each child (name, weight, capacity) gets: in proportion to the weights, but for those that are full."""
    out, left = {}, sum(w for _, w, _ in children)
    for name, weight, room in sorted(children, key=lambda c: (Fraction(c[2], c[1]) if c[1] else 0, c[0])):
        out[name] = min(room, budget * weight // left) if weight else 0
        budget, left = budget - out[name], left - weight
    return out


def budgets(leaves: Mapping[tuple[str, str, str], int], budget: int, weights: tuple[Mapping[str, int], ...], max_epochs: int) -> dict[tuple[str, str, str], int]:
    """Tokens for each leaf (domain, language, source) of the given size; weights of names that aren't listed are 1."""

    below: dict[tuple[str, ...], dict[tuple[str, ...], None]] = {}
    room: dict[tuple[str, ...], int] = {}
    for leaf, size in leaves.items():  # each node once for each leaf under it, so the work is that of the leaves
        weight = 1
        for k in range(len(LEAF), 0, -1):
            weight = weight and weights[k - 1].get(leaf[k - 1], 1)
            room[leaf[: k - 1]] = room.get(leaf[: k - 1], 0) + (max_epochs * size if weight else 0)
            below.setdefault(leaf[: k - 1], {})[leaf[:k]] = None
        room[leaf] = max_epochs * size

    def down(prefix: tuple[str, ...], amount: int) -> dict[tuple[str, str, str], int]:
        if len(prefix) == len(LEAF):
            return {prefix: amount}
        nodes = sorted(below.get(prefix, {}))
        given = shared_out(amount, [(n[-1], weights[len(prefix)].get(n[-1], 1), room[n]) for n in nodes])
        return {k: v for n in nodes for k, v in down(n, given[n[-1]]).items()}

    return down((), min(budget, room.get((), 0)))


def mixed(
    docs: DataFrame,
    share: float = 0.6,
    max_epochs: int = 2,
    seed: int = 11,
    domain: Column | None = None,
    domain_weights: Mapping[str, int] | None = None,
    lang_weights: Mapping[str, int] | None = None,
    source_weights: Mapping[str, int] | None = None,
) -> DataFrame:
    """docs with `domain`, `tokens` and `epoch`: a row for each epoch (from 0) that a document is taken in.

    docs: (doc_id, text, lang, source and any others; domain, tokens and epoch are replaced). share: the budget, as a part of all tokens of docs. A null lang
    or source is a name of its own (empty); a null text has no tokens. Documents of one leaf with the same doc_id are
    taken together. A leaf without tokens is not taken; an empty table gives no rows. Weights are whole numbers.
    The leaves' sizes go through the driver (one row for each), documents never do.
    """
    spark = docs.sparkSession
    parts = (domain_of(F.col("source")) if domain is None else domain, F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit("")))
    small_batches(spark)
    counted = docs.select("doc_id", packed(docs).alias("_row"), token_counts(F.col("text")).alias("_tokens"), *[c.alias(n) for c, n in zip(parts, LEAF, strict=True)])
    named = written(counted, "sized-documents")  # tokens are counted once
    sized = named.select("doc_id", "_tokens", *LEAF)
    leaves = {tuple(r[:3]): r[3] for r in sized.groupBy(*LEAF).agg(F.sum("_tokens")).collect()}
    weights = tuple(w if w is not None else default for w, default in ((domain_weights, DOMAIN_WEIGHTS), (lang_weights, LANG_WEIGHTS), (source_weights, {})))
    given = budgets(leaves, int(Fraction(str(share)) * sum(leaves.values())), weights, max_epochs)
    rows = [(*k, *divmod(given[k], n)) for k, n in leaves.items() if n]
    plan = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in LEAF) + ", _full bigint, _rest bigint")
    small = F.broadcast if len(rows) <= BROADCAST_LEAVES else lambda df: df

    def key() -> Column:
        return F.md5(F.concat_ws(":", F.lit(seed), F.col("_full"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))

    keyed = sized.join(small(plan.filter("_rest > 0")), list(LEAF)).withColumn("_key", key()).withColumn("_range", F.substring("_key", 1, 3))
    sums = keyed.groupBy(*LEAF, "_rest", "_range").agg(F.sum("_tokens").alias("n"))
    upto = Window.partitionBy(*LEAF).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    edge = sums.withColumn("upto", F.sum("n").over(upto)).filter("upto > _rest")
    edge = edge.groupBy(*LEAF).agg(F.min(F.struct("_range", (F.col("upto") - F.col("n")).alias("_before"))).alias("e")).select(*LEAF, "e.*")
    near = keyed.join(small(edge), [*LEAF, "_range"]).groupBy(*LEAF, "_rest", "_before", "_key").agg(F.sum("_tokens").alias("n"))
    inside = Window.partitionBy(*LEAF).orderBy("_key").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("upto", F.col("_before") + F.sum("n").over(inside)).filter("upto <= _rest").groupBy(*LEAF).agg(F.max("_key").alias("_last"))
    cutoffs = written(edge.join(near, list(LEAF), "left").select(*LEAF, F.coalesce("_last", "_range").alias("_cutoff")), "cutoffs")
    plan = plan.join(cutoffs, list(LEAF), "left")

    taken = named.join(small(plan), list(LEAF)).withColumn("_times", F.col("_full") + F.coalesce((key() <= F.col("_cutoff")).cast("int"), F.lit(0)))
    epochs = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_times") - 1)).alias("epoch")
    return taken.filter("_times > 0").select(*unpacked("_row", docs.columns, "domain", "tokens", "epoch"), F.col("_domain").alias("domain"), F.col("_tokens").alias("tokens"), epochs)
