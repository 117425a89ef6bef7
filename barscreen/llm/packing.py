"""Best-fit packing of tokenized documents by minimum bin slack.

Bins are filled one pattern at a time: a bitset subset-sum over the lengths that are still there finds the fullest
combination that fits, and that combination is removed as often as it is there. Only the histogram of lengths (at most
`capacity` rows, however many documents there are) is needed for that; which pieces go where then follows from each
piece's rank among the pieces of its length, by arithmetic. Ranks are counted within small shares of a length and
shifted by the shares before, so that a length that very many pieces have is never ranked in one task.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barscreen.llm.common import narrow, small_batches, written

END_ID = 2
CAPACITY = 1024
TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
SPECIAL = {"<|endoftext|>": 50256}  # the token that TOKENIZER adds to the vocabulary
LONG_RUN = 100_000  # tiktoken's search with the vocabulary's pattern fails on a million of white space in a row
SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)


@functools.cache
def encoding(name: str = RANKS, pattern: str | None = None):
    """The byte-level vocabulary as tiktoken ranks, which give the same ids as TOKENIZER in a fifth of the time."""
    import public_tokenizers as public
    import tiktoken

    with open(public.path(name), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=pattern or public.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def encoded(text: str) -> list[int]:
    """The ids of a whole text, however long its runs of white space are.

    To the vocabulary's pattern such a run is one piece, but for its last character if a word or sign follows. Long runs
    are cut out there and go by a pattern that needs no look ahead, which gives the same ids.
    """
    out, at = [], 0
    for run in SPACES.finditer(text) if len(text) >= LONG_RUN else ():
        more = run.end() < len(text) and not text.startswith(tuple(SPECIAL), run.end())
        out += encoding().encode(text[at : run.start()], allowed_special="all")
        at = run.end() - more
        out += encoding(pattern=r"\s+").encode_ordinary(text[run.start() : at])
    return out + encoding().encode(text[at:], allowed_special="all")


def token_ids(text: str | None) -> np.ndarray:
    """The ids of a whole text and the end id, as little-endian unsigned 32-bit numbers."""
    return np.array([*encoded(text or ""), END_ID], "<u4")


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all of `capacity`, but the first, which may be shorter."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((k, capacity) for k in range(first, n, capacity))]


def pieces(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece of each document."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("array<struct<piece: int, start: bigint, length: bigint, ids_crc32: bigint>>")
    def of(text: pd.Series) -> pd.Series:
        out = []
        for t in text:
            ids = token_ids(t)
            out.append([{"piece": k, "start": s, "length": n, "ids_crc32": zlib.crc32(ids[s : s + n])} for k, (s, n) in enumerate(cut(len(ids), capacity))])
        return pd.Series(out, dtype=object)

    return narrow(docs, "doc_id", "text").select("doc_id", F.explode(of("text")).alias("p")).select("doc_id", "p.*")


def fullest(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """(length, times) of the combination of available pieces with the least slack, the longest piece being in it.

    Bit s of the set says that some combination fills s. The set before each length is kept, to walk back from the
    fullest sum; repeated lengths are taken in powers of two. Only lengths that fit beside the longest are tried, and
    the search ends as soon as the bin can be full.
    """
    lengths = sorted(counts, reverse=True)
    room = capacity - lengths[0]
    goal, whole, sums, steps = 1 << room, (2 << room) - 1, 1, []
    for at, length in enumerate(lengths):
        left, take = min(counts[length] - (at == 0), room // length), 1
        while left > 0 and not sums & goal:
            take = min(take, left)
            steps.append((length, take, sums))
            sums |= (sums << (length * take)) & whole
            left -= take
            take *= 2
        if sums & goal:
            break
    filled, used = sums.bit_length() - 1, {lengths[0]: 1}
    for length, take, before in reversed(steps):
        if not before >> filled & 1:
            filled -= length * take
            used[length] = used.get(length, 0) + take
    return sorted(used.items(), reverse=True)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(bins, combination) until no piece is left; each step uses up at least one length's share of a combination."""
    counts, made = {k: n for k, n in histogram.items() if n > 0}, []
    while counts:
        use = fullest(counts, capacity)
        bins = min(counts[length] // times for length, times in use)
        made.append((bins, use))
        for length, times in use:
            counts[length] -= bins * times
            if not counts[length]:
                del counts[length]
    return made


def _ranges(made: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """For each length, in order of rank: (first rank, first sequence, pieces of it in a sequence, their offset)."""
    out: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for bins, use in made:
        offset = 0
        for length, times in use:
            out.setdefault(length, []).append((used.get(length, 0), sequence, times, offset))
            used[length] = used.get(length, 0) + bins * times
            offset += length * times
        sequence += bins
    return {k: np.array(v, np.int64) for k, v in out.items()}


#: What ranks pieces of one length: rows that are alike in all of it are interchangeable, however often a task is run.
PLACE = ("doc_id", "piece", "start", "ids_crc32")


def ranked(found: DataFrame, histogram: dict[int, int], share_rows: int = 5_000) -> DataFrame:
    """found with `rank`: from 0, without gaps, among the rows of the same length.

    histogram has the rows of each length, capacity entries at most, and so can be broadcast.
    """
    shares = [(length, -(-n // share_rows)) for length, n in histogram.items()]
    counts = found.sparkSession.createDataFrame(shares, "length bigint, shares bigint")
    dealt = found.join(F.broadcast(counts), "length").withColumn("share", F.pmod(F.xxhash64(*PLACE), "shares")).drop("shares")
    sizes = dealt.groupBy("length", "share").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("length", "share", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    own = Window.partitionBy("length", "share").orderBy(*PLACE)
    numbered = dealt.withColumn("own", F.row_number().over(own) - 1)
    return numbered.join(shift, ["length", "share"]).withColumn("rank", F.col("own") + F.col("shift")).drop("own", "share", "shift")


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row of docs (doc_id, text).

    Other columns are ignored. A null text counts as empty; an empty text is the end id alone, so every document has a piece. Repeated rows are
    packed as often as they come; a null doc_id stays null. An empty table gives no rows. Which of several equally
    long pieces goes to which place depends only on doc_id, piece, start and ids: rows that share a doc_id are told apart
    by their texts, and rows of one doc_id (a null one, say) are dealt out by them.
    """
    spark = docs.sparkSession
    found = written(pieces(docs, capacity), "pieces")
    histogram = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}  # capacity rows at most
    ranges = spark.sparkContext.broadcast(_ranges(plan(histogram, capacity)))

    @F.pandas_udf("struct<sequence_id: bigint, offset: bigint>")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        length, rank = lengths.to_numpy(np.int64), ranks.to_numpy(np.int64)
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for one in np.unique(length):
            own, of_length = length == one, ranges.value[int(one)]
            first, base, times, at = of_length[np.searchsorted(of_length[:, 0], rank[own], "right") - 1].T
            nth = rank[own] - first
            sequence[own], offset[own] = base + nth // times, at + nth % times * one
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = ranked(found, histogram).withColumn("at", place("length", "rank"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")
