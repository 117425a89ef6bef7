"""Near-duplicate embeddings through a pivot-permutation index.

A vector is described by its `nearest` reference vectors in order of nearness. Two vectors of one label become candidates
if they share at least `shared` of those; inverted lists, one for each label and pivot, bring them together, and a pair
counts only in the list of the smallest pivot that it shares, so that it is seen once; vectors that have fewer than
`shared` - 1 pivots beyond a list's can't be in such a pair and stay out of it. A list with more than `max_list`
vectors is split by the next shared pivot, which loses nothing while fewer than `shared` pivots are fixed; a list that is
still too long is compared in pairs of blocks. Every candidate is verified by its cosine in double precision. Tasks
return a count and one link to a root for each vector, never all pairs of a group; equal vectors are compared once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barscreen.llm.common import narrow, written
from barscreen.llm.components import connected_components
from barscreen.llm.simhash import _merge
from barscreen.llm.vectors import flat, usable

CHUNK = 1 << 15  # pairs that are verified at once
COLUMNS = "unit bigint, copies bigint, prefix array<int>, embedding array<float>, key bigint, top int"


def number_of_pivots(vectors: int) -> int:
    """128, doubled for every fourfold number of vectors from 50,000 on, and 1024 at most: lists stay short, recall whole.

    Of pairs with a cosine of 0.98 in 64 dimensions, 4,000 of 4,000 share three of their eight nearest pivots out of 128
    or 256, and 3,999 out of 512 or 1024; of pairs at random 1.3 % out of 128, and 0.03 % out of 1024.
    """
    return int(min(1024, 128 * 2 ** max(0, np.log2(max(1, vectors) / 50_000) // 2)))


def reference_vectors(vectors: DataFrame, pivots: int) -> np.ndarray:
    """`pivots` rows of unit length at most: the vectors whose hash is smallest, a fixed bounded sample."""
    rows = vectors.select("embedding").orderBy(F.xxhash64("embedding"), "embedding").limit(pivots).collect()
    width = max((len(r[0]) for r in rows), default=1)
    out = np.zeros((len(rows), width))
    for k, r in enumerate(rows):
        out[k, : len(r[0])] = np.array(r[0]) / np.linalg.norm(r[0])
    return out


def _sized(m: np.ndarray, width: int) -> np.ndarray:
    return m[:, :width] if m.shape[1] >= width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def permutations(vectors: DataFrame, pivots: np.ndarray, nearest: int) -> DataFrame:
    """vectors with `prefix`: the nearest reference vectors, nearest first."""
    nearest = min(nearest, len(pivots))

    @F.arrow_udf("array<int>")
    def prefix(embedding: pa.Array) -> pa.Array:
        out = np.empty((len(embedding), nearest), np.int32)
        width = np.diff(embedding.offsets.to_numpy())
        for n in np.unique(width):
            at = np.flatnonzero(width == n)
            out[at] = np.argsort(-(flat(embedding.take(pa.array(at))).astype(np.float64) @ _sized(pivots, n).T), axis=1, kind="stable")[:, :nearest]
        return pa.ListArray.from_arrays(nearest * np.arange(len(out) + 1, dtype=np.int32), out.ravel())

    return vectors.withColumn("prefix", prefix("embedding"))


def _linker(threshold: float, shared: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        """Links between block one and block two of a list (the same block, or two different ones)."""
        one, two = key[1].as_py(), key[2].as_py()
        depth, top = rows["depth"][0].as_py(), rows["top"][0].as_py()
        unit, copies, block = (rows[c].to_numpy() for c in ("unit", "copies", "block"))
        v, prefix = flat(rows["embedding"]).astype(np.float64), flat(rows["prefix"])
        v /= np.sqrt((v * v).sum(axis=1))[:, None]
        pivots, at = np.unique(prefix, return_inverse=True)
        sets = np.zeros((len(rows), len(pivots)), np.float32)
        np.put_along_axis(sets, at.reshape(prefix.shape), 1, axis=1)
        weight = prefix.shape[1] + 1  # more than all the pivots of a vector: a sum tells how many shared ones are below top
        weighed = sets * np.where(pivots < top, weight, 1).astype(np.float32)
        least, beyond = weight * (depth - 1) + shared - (depth - 1), weight * depth
        rows_at, columns = np.flatnonzero(block == one), np.flatnonzero(block == two)
        links, parent, others = np.zeros(len(rows), np.int64), np.arange(len(rows)), sets[columns].T
        step = max(1, (1 << 21) // max(1, len(columns)))
        for k in range(0, len(rows_at), step):
            part = rows_at[k : k + step]
            common = weighed[part] @ others
            found = (common >= least) & (common < beyond)
            if one == two:
                found &= part[:, None] < columns[None, :]
            a, b = np.nonzero(found)
            a, b = part[a], columns[b]
            for c in range(0, len(a), CHUNK):
                x, y = a[c : c + CHUNK], b[c : c + CHUNK]
                near = np.einsum("ij,ij->i", v[x], v[y]) >= threshold
                x, y = x[near], y[near]
                np.add.at(links, x, copies[y])
                np.add.at(links, y, copies[x])
                _merge(parent, x, y)
        at = np.flatnonzero(links)
        return pa.table({"unit": unit[at], "links": links[at], "root": unit[parent[at]]})

    return run


def _lists(described: DataFrame, shared: int, max_list: int) -> DataFrame:
    """Each vector once for each list that it can have a pair in, with that list's depth, largest pivot and block numbers.

    A pair shares `shared - depth` pivots or more beyond its list's largest one, so a vector that has fewer isn't listed.
    """
    now = described.withColumns({"key": F.xxhash64("label", F.size("embedding")), "top": F.lit(-1), "prefix": F.sort_array("prefix")})
    done = None
    for depth in range(1, shared + 1):
        after = F.filter("prefix", lambda p: p > F.col("top"))
        now = now.withColumn("p", F.explode(F.slice(after, 1, F.greatest(F.size(after) - (shared - depth), F.lit(0))))).withColumn("key", F.xxhash64("key", "p")).withColumn("top", F.col("p"))
        now = now.selectExpr(*[x.split()[0] for x in COLUMNS.split(", ")], f"{depth} AS depth")
        long = written(now.groupBy("key").count().filter(F.col("count") > max_list).select("key", F.ceil(F.col("count") / max_list).alias("blocks")), "long-lists")
        if long.isEmpty():
            now = now.withColumn("blocks", F.lit(1).cast("bigint"))
            return now if done is None else done.union(now)
        if depth < shared:
            short = now.join(long.select("key"), "key", "left_anti").select(now.columns).withColumn("blocks", F.lit(1).cast("bigint"))
            done = short if done is None else done.union(short)
            now = written(now.join(long.select("key"), "key", "left_semi").select(now.columns), "long-list-vectors").drop("depth")
        else:
            now = now.join(long, "key", "left").select(*now.columns, F.coalesce("blocks", F.lit(1)).alias("blocks"))
    return now if done is None else done.union(now)


def near_duplicate_vectors(
    vectors: DataFrame, threshold: float = 0.98, pivots: int | None = None, nearest: int = 8, shared: int = 3, max_list: int = 4096
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding, label; others are ignored).

    Rows are compared if their labels are equal and not null and their vectors equally long. A vector that is null,
    zero, or holds null or non-finite components, and a row without a label, has no links and is its own component.
    Repeated rows are vectors of their own. component_id is the smallest vec_id of a component (null vec_ids take
    part in links but never name one); kept says that a row has that vec_id. The index is fitted on `pivots` vectors
    and holds all vectors. Vectors of any length are compared whole. An empty table gives no rows.
    """
    all_rows = narrow(vectors, "vec_id", "embedding", "label")
    sound = all_rows.filter(F.col("label").isNotNull() & usable(F.col("embedding")) & F.exists("embedding", lambda x: x != 0))
    units = written(
        sound.groupBy("label", "embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first_id")).withColumn("unit", F.monotonically_increasing_id()), "units"
    )
    reference = reference_vectors(units, pivots or number_of_pivots(units.count()))
    shared = max(1, min(shared, nearest, len(reference)))
    described = written(permutations(units, reference, nearest).select("unit", "copies", "label", "embedding", "prefix"), "permutations")
    lists = _lists(described, shared, max_list).withColumn("block", F.pmod(F.xxhash64("unit"), "blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    dealt = lists.withColumn("other", other).withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other"))
    found = written(
        dealt.select("unit", "copies", "prefix", "embedding", "key", "top", "depth", "block", "one", "two")
        .groupBy("key", "one", "two")
        .applyInArrow(_linker(threshold, shared), "unit bigint, links bigint, root bigint"),
        "vector-links",
    )
    counted = found.groupBy("unit").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("unit").alias("u"), F.col("root").alias("v")))
    named = units.select("unit", "first_id").join(counted, "unit", "left").join(roots.withColumnRenamed("id", "unit"), "unit", "left")
    named = named.withColumn("c", F.coalesce("component_id", "unit")).drop("component_id")
    least = named.groupBy("c").agg(F.min("first_id").alias("component_id"))
    named = named.join(least, "c").select("unit", F.coalesce("links", F.lit(0)).alias("links"), "component_id")
    keyed = lambda df: df.withColumn("key", F.xxhash64("label", "embedding"))  # noqa: E731  first in the join's order, it spares comparisons of vectors
    of_row = keyed(all_rows).join(keyed(units.select("label", "embedding", "unit", "copies")), ["key", "label", "embedding"], "left").select("vec_id", "unit", "copies")
    nowhere = -1 - F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20))  # no unit is negative: rows without one are spread over tasks
    out = of_row.withColumn("unit", F.coalesce("unit", nowhere)).join(named, "unit", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
