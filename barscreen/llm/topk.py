"""Exact top-k inner products by a three-phase uniform threshold (Cao and Wang, 2004).

The dimensions are split among `parts` score lists; a score is the sum of a vector's entries in them.
First, blocks of vectors give their best entries of every list, with their full scores: the k-th best of those is a
cutoff that no result can be below. Any k vectors give a safe one, so every `FIRST`-th block is enough for that, and the
first phase costs a fraction of the second. Then, with the cutoff at all blocks, every entry of at least cutoff / parts
is collected, list by list: a vector without such an entry sums up to less than the cutoff. Last, what was collected has
the entries that it misses added, and the k best full scores stay. Queries and vectors meet in blocks of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barscreen.llm.common import narrow, written
from barscreen.llm.vectors import matrix, usable

FIRST = 4  # one block of so many is read by the first phase
CELLS = 1 << 20  # scores that are held at once
FOUND = "query_row bigint, query_id bigint, vec_row bigint, vec_id bigint, score bigint"


def _split(df: pd.DataFrame, parts: int) -> tuple:
    """Queries, vectors in order of vec_id, and the edges of each list's dimensions."""
    asks = df[df["asks"]]
    others = df[~df["asks"]].sort_values(["vec_id", "row"])
    q, v = (np.floor(256 * matrix(x["embedding"])) for x in (asks, others))
    width = len(df["embedding"].iloc[0])
    return asks, others, q, v, [width * k // parts for k in range(parts + 1)]


def _scores(q: np.ndarray, v: np.ndarray, edges: list[int]) -> list[np.ndarray]:
    return [q[:, a:b] @ v[:, a:b].T for a, b in zip(edges, edges[1:], strict=False)]


def _top(row: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Where the k best of each row are; vec is in order of preference among equal scores."""
    order = np.lexsort((vec, -score, row))
    start = np.flatnonzero(np.concatenate(([True], row[order][1:] != row[order][:-1]))) if len(order) else np.empty(0, np.int64)
    nth = np.arange(len(order)) - np.repeat(start, np.diff(np.concatenate((start, [len(order)]))))
    return order[nth < k]


def _searcher(k: int, parts: int, bounded: bool):
    def run(df: pd.DataFrame) -> pd.DataFrame:
        asks, others, q, v, edges = _split(df, parts)
        out = []
        step = max(1, CELLS // max(1, len(others)))
        for at in range(0, len(asks) if len(others) else 0, step):
            own = asks.iloc[at : at + step]
            lists = _scores(q[at : at + step], v, edges)
            if bounded:
                cutoff = own["cutoff"].to_numpy(np.float64, na_value=-np.inf)[:, None]
                wanted = np.logical_or.reduce([parts * x >= cutoff for x in lists])
            else:
                cutoff, wanted = np.full((len(own), 1), -np.inf), np.zeros((len(own), len(others)), bool)
                for x in lists:
                    best = np.argpartition(-x, min(k, x.shape[1] - 1), axis=1)[:, : k + 1]
                    np.put_along_axis(wanted, best, True, axis=1)
            wanted &= own["row"].to_numpy()[:, None] != others["row"].to_numpy()[None, :]
            a, b = np.nonzero(wanted)
            full = sum(x[a, b] for x in lists)
            enough = full >= cutoff[a, 0]
            a, b, full = a[enough], b[enough], full[enough]
            best = _top(a, b, full, k)
            a, b = own.iloc[a[best]], others.iloc[b[best]]
            out.append(pd.DataFrame({"query_row": a["row"].to_numpy(), "query_id": a["vec_id"].to_numpy(), "vec_row": b["row"].to_numpy(), "vec_id": b["vec_id"].to_numpy(), "score": full[best].astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({c.split()[0]: pd.Series(dtype="int64") for c in FOUND.split(", ")})

    return run


def top_k(vectors: DataFrame, queries: Column, k: int = 5, parts: int = 2, query_block: int = 8192, vector_block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest scores of every query row among all rows but its own.

    vectors: (vec_id, embedding); others are ignored. queries: a condition on vec_id that marks the query rows. A
    score is the integer inner product of floor(256 * x); ties go to the smaller vec_id. Vectors that are null or
    hold null or non-finite components, and rows with a null vec_id, take no part; vectors of different lengths
    aren't compared, and those of any length count whole. Repeated rows are vectors, and queries, of their own. Fewer than k
    others: all of them. An empty table gives no rows.
    """
    rows = narrow(vectors, "vec_id", "embedding").filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = written(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "embedding", F.size("embedding").alias("dim"), F.coalesce(queries, F.lit(False)).alias("asks")), "vectors")
    n, m = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("asks").cast("bigint")), F.lit(0))).first()
    across, down = max(1, math.ceil(m / query_block)), max(1, math.ceil(n / vector_block))
    spread = lambda count, name: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)
    own = lambda count, name: F.pmod(F.xxhash64("row"), F.lit(count)).cast("int").alias(name)
    blocks = rows.select("row", "vec_id", "embedding", "dim", own(down, "y"), spread(across, "x"), F.lit(False).alias("asks"), F.lit(None).cast("bigint").alias("cutoff"))

    def search(cutoffs: DataFrame | None) -> DataFrame:
        asks = rows.filter("asks")
        asks = asks.withColumn("cutoff", F.lit(None).cast("bigint")) if cutoffs is None else asks.join(cutoffs, "row", "left")
        asks = asks.select("row", "vec_id", "embedding", "dim", spread(down, "y"), own(across, "x"), F.lit(True).alias("asks"), "cutoff")
        met = blocks.unionByName(asks)
        return (met.filter(F.col("y") % FIRST == 0) if cutoffs is None else met).groupBy("dim", "x", "y").applyInPandas(_searcher(k, parts, cutoffs is not None), FOUND)

    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "vec_row")
    nth = lambda found: found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    cutoffs = written(nth(search(None)).filter(F.col("rank") == k).select(F.col("query_row").alias("row"), F.col("score").alias("cutoff")), "cutoffs")
    return nth(search(cutoffs)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
