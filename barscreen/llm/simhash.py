"""Near duplicates by SimHash fingerprints, matched through a hierarchical index in Gray order.

All distinct fingerprints are sorted by Gray rank, so that neighbours share bit patterns, and cut into blocks. A node of
the index holds the bits in which all its members agree: a pattern and a mask, factored out of them. Upper nodes stand
for ranges of blocks, and pairs of nodes are followed downwards, by joins, while the differences accumulated over their
shared bits stay within the limit; whole groups go with a pair that doesn't. Only the members of pairs of blocks that are
left meet in a task, where the same descent goes on over the nodes inside the blocks, down to leaves of 32 fingerprints.
A pair that differs in `bits` or fewer bits can't be pruned, so none is lost; and as each level shares some more bits, a
fingerprint meets a number of others that grows with a power of the logarithm of their number only. A task returns a
spanning forest of what it has linked, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barscreen.llm.common import narrow, small_batches, written
from barscreen.llm.components import connected_components

SEED = 42
CHUNK = 1 << 16  # shingles whose bits are counted at once
LEAF, FAN = 32, 8  # fingerprints in a leaf, children of a node
PAIRS = 1 << 15  # node pairs that are opened at once
LEAVES = 1 << 8  # leaf pairs whose fingerprints are compared at once
BLOCK = 1 << 14  # fingerprints of a block, whose pairs are dealt out


def fingerprint(text: str | None, words: int = 3) -> int:
    """The unsigned 64-bit SimHash of a text's shingles of `words` words; zero without any word."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    n, digest = max(1, len(tokens) - words + 1), xxhash.xxh64_digest
    shingles = map(b" ".join, zip(*(tokens[k:] for k in range(min(words, len(tokens)))), strict=False))
    ones = np.zeros(64, np.int64)
    for _ in range(0, n, CHUNK):
        made = b"".join([digest(x, SEED) for x in islice(shingles, CHUNK)])
        ones += np.unpackbits(np.frombuffer(made, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): fp as a signed long."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("bigint")
    def fp(text: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in text], np.uint64).view(np.int64))

    return narrow(docs, "doc_id", "text").select("doc_id", fp("text").alias("fp"))


def gray_rank(fp: Column) -> Column:
    """The place of a bit pattern in the reflected Gray sequence, order-preserving as a signed long."""
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, k))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def _merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of a[i] and b[i]; afterwards every parent is a root."""
    while len(a):
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def _levels(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(pattern, mask) of the nodes of each level, leaves first; mask: the bits in which all members agree."""
    out, width = [], LEAF
    while True:
        at = np.arange(0, len(fps), width)
        both = np.bitwise_and.reduceat(fps, at)
        out.append((both, ~(np.bitwise_or.reduceat(fps, at) ^ both)))
        if len(at) <= FAN:
            return out
        width *= FAN


def _opened(i: np.ndarray, j: np.ndarray, sizes: tuple[int, int], same: bool, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """All pairs of a child of i and a child of j; inside one block each pair once."""
    k = np.arange(FAN)
    a, b = (i[:, None, None] * FAN + k[None, :, None]), (j[:, None, None] * FAN + k[None, None, :])
    a, b = np.broadcast_arrays(a, b)
    keep = (a < sizes[0]) & (b < sizes[1])
    if same:
        keep &= a <= b
    return a[keep], b[keep], *(np.broadcast_to(x[:, None, None], a.shape)[keep] for x in more)


def linked(one: np.ndarray, two: np.ndarray | None, bits: int) -> np.ndarray:
    """The root of each member of block one, then of block two (None: pairs inside one), all in Gray order.

    Members whose fingerprints differ in `bits` or fewer bits come under one root.
    """
    same = two is None
    sides = (one, one if same else two)
    shift = 0 if same else len(one)
    parent = np.arange(len(one) if same else len(one) + len(two))
    leaves = [np.pad(x, (0, -len(x) % LEAF), mode="edge").reshape(-1, LEAF) for x in sides]  # the last leaf repeats its last member
    levels = [_levels(x) for x in sides]
    while len(levels[0]) != len(levels[1]):  # blocks of unequal size: the lower tree gets a root
        low = min(levels, key=len)
        pattern, mask = low[-1]
        common = np.bitwise_and.reduce(pattern, keepdims=True)
        low.append((common, np.bitwise_and.reduce(mask, keepdims=True) & ~(np.bitwise_or.reduce(pattern, keepdims=True) ^ common)))
    top = len(levels[0]) - 1
    n, m = (len(x[top][0]) for x in levels)
    i, j = np.triu_indices(n) if same else (x.ravel() for x in np.indices((n, m)))
    stack = [(top, i, j, np.zeros(len(i), np.uint64), np.zeros(len(i), np.int64))]
    while stack:
        level, i, j, seen, acc = stack.pop()
        if len(i) > PAIRS:
            stack += [(level, *(x[k : k + PAIRS] for x in (i, j, seen, acc))) for k in range(0, len(i), PAIRS)]
            continue
        (pattern, mask), (other, others_mask) = levels[0][level], levels[1][level]
        shared = mask[i] & others_mask[j]
        acc = acc + np.bitwise_count((pattern[i] ^ other[j]) & shared & ~seen)
        near = acc <= bits
        i, j, shared, acc = i[near], j[near], shared[near], acc[near]
        if level:
            stack.append((level - 1, *_opened(i, j, (len(levels[0][level - 1][0]), len(levels[1][level - 1][0])), same, shared, acc)))
            continue
        for k in range(0, len(i), LEAVES):
            a, b = i[k : k + LEAVES], j[k : k + LEAVES]
            close = np.bitwise_count(leaves[0][a][:, :, None] ^ leaves[1][b][:, None, :]) <= bits
            pair, x, y = np.unravel_index(np.flatnonzero(close), close.shape)
            _merge(parent, np.minimum(a[pair] * LEAF + x, len(sides[0]) - 1), np.minimum(b[pair] * LEAF + y, len(sides[1]) - 1) + shift)
    return parent


def _blocks(distinct: DataFrame, block: int) -> tuple[DataFrame, int]:
    """(id, low, high, members) of blocks in Gray order, and a bound of the ids.

    id >> 4 is the range of Gray ranks that a block is in; members are the fingerprints as bytes, low and high their
    bitwise and and or.
    """
    parts = max(1, -(-distinct.count() // (4 * block)))
    ordered = distinct.select("fp", gray_rank(F.col("fp")).alias("rank")).repartitionByRange(parts, "rank").sortWithinPartitions("rank")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [df for df in batches if len(df)]
        if not held:
            return
        part, fps = int(held[0]["part"].iloc[0]), np.concatenate([df["fp"].to_numpy(np.int64) for df in held])
        size = max(block, -(-len(fps) // 16))
        made = [fps[k : k + size] for k in range(0, len(fps), size)]
        yield pd.DataFrame({
            "id": [16 * part + k for k in range(len(made))],
            "low": [np.bitwise_and.reduce(x) for x in made],
            "high": [np.bitwise_or.reduce(x) for x in made],
            "members": [x.tobytes() for x in made],
        })

    rows = ordered.select("fp", F.spark_partition_id().alias("part")).mapInPandas(cut, "id bigint, low bigint, high bigint, members binary")
    blocks = written(rows, "fingerprint-blocks")
    return blocks, (blocks.agg(F.max("id")).first()[0] or 0) + 1


def block_pairs(blocks: DataFrame, bound: int, bits: int) -> DataFrame:
    """(i, j), i <= j: the blocks that no difference in their nodes' shared bits keeps apart, by descent from the top."""
    spark, top = blocks.sparkSession, 0
    while bound >> (4 * top) > 16:
        top += 1
    count = (bound >> (4 * top)) + 1
    pairs = spark.range(count).select(F.col("id").alias("i"), F.explode(F.sequence("id", F.lit(count - 1))).alias("j"), F.lit(0).cast("bigint").alias("seen"), F.lit(0).alias("acc"))
    for level in range(top, -1, -1):
        node = F.shiftright("id", 4 * level).alias("node")
        nodes = blocks.groupBy(node).agg(F.bit_and("low").alias("low"), F.bit_or("high").alias("high"))
        nodes = nodes.select("node", (F.col("node") if level == top else F.shiftright("node", 4)).alias("up"), "low", F.bitwise_not(F.col("low").bitwiseXOR(F.col("high"))).alias("mask"))
        above = pairs.select(F.col("i").alias("up_i"), F.col("j").alias("up_j"), "seen", "acc")
        one, two = (nodes.select(F.col("up").alias(f"up_{x}"), F.col("node").alias(x), F.col("low").alias(f"low_{x}"), F.col("mask").alias(f"mask_{x}")) for x in ("i", "j"))
        met = above.join(one, "up_i").join(two, "up_j").filter("i <= j").withColumn("both", F.col("mask_i").bitwiseAND(F.col("mask_j")))
        apart = F.col("low_i").bitwiseXOR(F.col("low_j")).bitwiseAND(F.col("both")).bitwiseAND(F.bitwise_not("seen"))
        pairs = met.withColumn("acc", F.col("acc") + F.bit_count(apart)).filter(F.col("acc") <= bits).select("i", "j", F.col("both").alias("seen"), "acc")
    return pairs.select("i", "j")


def linked_fingerprints(distinct: DataFrame, bits: int = 3, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) that join all fingerprints of `distinct` (fp) into the components of "differs in `bits` or fewer bits"."""
    blocks, bound = _blocks(distinct, block)
    pairs = written(block_pairs(blocks, bound, bits), "block-pairs")
    ends = pairs.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("id"))

    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        at = {int(k): np.frombuffer(m, np.int64) for k, m in zip(df["id"], df["members"], strict=True)}
        one, two = at[int(key[0])], at[int(key[1])]
        same = key[0] == key[1]
        parent = linked(one.view(np.uint64), None if same else two.view(np.uint64), bits)
        fps = one if same else np.concatenate((one, two))
        moved = np.flatnonzero(parent != np.arange(len(parent)))
        return pd.DataFrame({"u": fps[moved], "v": fps[parent[moved]]})

    return ends.join(blocks.select("id", "members"), "id").groupBy("i", "j").applyInPandas(run, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 3, block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs (doc_id, text; other columns are ignored).

    component_id is the smallest doc_id that is reachable over links, the row's own included. A null text counts as
    empty; texts without a word have fingerprint zero and link like any other. Rows with a null doc_id keep their
    fingerprint, link with nothing and have a null component. Repeated rows are returned as often as they come; an empty
    table gives no rows. A text of any length counts whole.
    """
    fps = written(fingerprints(docs, words), "fingerprints")
    distinct = written(fps.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    found = connected_components(linked_fingerprints(distinct, bits, block))
    named = distinct.join(found.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("component_id", "fp").alias("c"))
    least = named.groupBy("c").agg(F.min("first_id").alias("component_id"))
    named = named.join(least, "c").select("fp", "component_id")
    out = fps.join(named, "fp", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), own.alias("component_id"))
