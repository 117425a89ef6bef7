"""Spelling variants: words one edit apart, by a positional q-gram inverted index with a count filter.

Words are dealt out to shards before they are indexed. A shard is named by a length, a window and the text outside the
window: it holds the words of that length, and those one shorter, that are this text but for the window. Of two words one
edit apart, the edit lies in the left or the right half of the longer one, so they meet in one of its two shards. A shard
of more than `shard_words` words has its window halved again, until it is small or its window is one code point wide,
where no more words can differ than there are letters. So no shard is unbounded, and no pair is lost.

In a shard, the windows' padded 2-grams are listed by gram, position and length. A word one edit away keeps all but two of
them, at the same position or, after a deletion, one further left. The shortest lists of a word are merged by a heap, the
long ones are only searched for what the merge brings up, and whatever reaches the bound is compared.
"""

from __future__ import annotations

import heapq
import itertools
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barscreen.llm.common import narrow, written

LEAST_LENGTH, LEAST_COUNT, NOISE, RATIO = 7, 2, 31, 10
SHARD_WORDS = 1024
#: Oversized shards up to which their names are broadcast: some 60 bytes each. Beyond that they are joined by shuffles.
BROADCAST_SHARDS = 200_000
RUN = r"[A-Za-zÀ-ÿ]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
KEY = ("length", "a", "b", "outside")


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of the words of docs (doc_id, text) that are long and frequent enough."""
    runs = narrow(docs, "doc_id", "text").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.filter(F.length("run") >= LEAST_LENGTH).withColumn("run", F.translate("run", CAPITALS, CAPITALS.lower()))
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run")
    hashed = runs.select("run", F.crc32(key.cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % NOISE == 0, shorter).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _outside(a: Column, b: Column, length: Column) -> Column:
    """What of a word lies outside the window [a, b) of a word of the given length, which may be one longer than it."""
    tail = b - (length - F.length("word"))
    return F.concat(F.substring("word", F.lit(1), a), F.substring("word", tail + 1, F.length("word")))


def _halves(rows: DataFrame) -> DataFrame:
    """Each row (word, n, length, a, b) in the shards of the two halves of its window."""
    middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    halves = F.array(F.struct(F.col("a").alias("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("b").alias("b")))
    split = rows.withColumn("half", F.explode(halves)).select("word", "n", "length", "half.a", "half.b")
    return split.withColumn("outside", _outside(F.col("a"), F.col("b"), F.col("length")))


def grams(window: str) -> list[str]:
    padded = f"\0{window}\0"
    return [padded[k : k + 2] for k in range(len(padded) - 1)]


def one_edit(longer: str, other: str) -> bool:
    """Whether other is longer with exactly one code point replaced, or deleted if it is one shorter."""
    k = next((k for k, (x, y) in enumerate(zip(longer, other)) if x != y), len(other))
    if len(longer) == len(other):
        return k < len(longer) and longer[k + 1 :] == other[k + 1 :]
    return longer[k + 1 :] == other[k:]


def merged(lists: list[list[int]], least: int) -> Iterator[int]:
    """The numbers that come up at least `least` times in sorted lists, ascending.

    The least - 1 longest lists can't reach the bound alone, so only the others are merged; what they bring up is looked
    for in the long ones.
    """
    lists = sorted((x for x in lists if x), key=len)
    if len(lists) < least:
        return
    cut = len(lists) - least + 1
    short, long = lists[:cut], lists[cut:]
    for one, times in itertools.groupby(heapq.merge(*short)):
        count = sum(1 for _ in times)
        for k, other in enumerate(long):
            if count + len(long) - k < least:
                break
            at = bisect_left(other, one)
            count += at < len(other) and other[at] == one
        if count >= least:
            yield one


def near_in_shard(own: list[str], shorter: list[str]) -> Iterator[tuple[int, int, bool]]:
    """(index in own, index in own or shorter, whether in shorter) of the windows one edit apart, each pair once."""
    index: dict[tuple[str, int], list[int]] = {}
    for j, window in enumerate(shorter):
        for p, gram in enumerate(grams(window)):
            index.setdefault((gram, p), []).append(j)
    same: dict[tuple[str, int], list[int]] = {}
    for i, window in enumerate(own):
        listed = grams(window)
        least = len(listed) - 2  # one edit touches two grams of the longer window at most
        if shorter:
            lists = [x for p, g in enumerate(listed) for x in (index.get((g, p)), index.get((g, p - 1))) if x]
            for j in merged(lists, least) if least > 0 else range(len(shorter)):
                if one_edit(window, shorter[j]):
                    yield i, j, True
        for j in merged([same.get((g, p), []) for p, g in enumerate(listed)], least) if least > 0 else range(i):
            if one_edit(window, own[j]):
                yield i, j, False
        for p, gram in enumerate(listed):
            same.setdefault((gram, p), []).append(i)


def _searched(rows: DataFrame) -> DataFrame:
    """(word, near, near_n), both ways, of the pairs in shards (word, n and KEY)."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, words = None, []

        def found() -> list[tuple]:
            if len(words) < 2:
                return []
            length, a, b, _ = now
            own, shorter = [w for w in words if len(w[0]) == length], [w for w in words if len(w[0]) < length]
            pairs = near_in_shard([w[a:b] for w, _ in own], [w[a : b - 1] for w, _ in shorter])
            met = ((own[i], (shorter if is_shorter else own)[j]) for i, j, is_shorter in pairs)
            return [x for u, v in met for x in ((u[0], v[0], v[1]), (v[0], u[0], u[1]))]

        for batch in batches:
            out: list[tuple] = []
            for word, n, *key in zip(*(batch[c].tolist() for c in ("word", "n", *KEY)), strict=True):
                if key != now:
                    out += found()
                    now, words = key, []
                words.append((word, n))
            yield pd.DataFrame(out, columns=["word", "near", "near_n"])
        yield pd.DataFrame(found(), columns=["word", "near", "near_n"])

    dealt = rows.select("word", "n", *KEY).repartition(*KEY).sortWithinPartitions(*KEY)
    return dealt.mapInPandas(search, "word string, near string, near_n bigint")


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(word, near, near_n): every word of words (word, n) with each word that is one edit away, once, both ways."""
    lengths = F.explode(F.array(F.length("word"), F.length("word") + 1))
    rows = words.select("word", "n", lengths.alias("length")).withColumns({"a": F.lit(0), "b": F.col("length")})
    pairs = None
    while True:
        rows = _halves(rows)
        sizes = rows.filter(F.col("b") - F.col("a") > 1).groupBy(*KEY).agg(F.count("*").alias("rows"))
        large = written(sizes.filter(F.col("rows") > shard_words).select(*KEY), "large-shards")
        many = large.count()
        side = F.broadcast(large) if many <= BROADCAST_SHARDS else large
        found = _searched(rows.join(side, list(KEY), "left_anti") if many else rows)
        pairs = found if pairs is None else pairs.unionByName(found)
        if not many:
            break
        rows = written(rows.join(side, list(KEY), "left_semi"), "words-of-large-shards")
    return pairs.distinct()


def roots(forms: DataFrame, rounds: int = 40) -> DataFrame:
    """(word, root) for the words of forms (word, form): where following forms ends. Forms must not lead in a circle.

    Each round follows a path of twice the length.
    """
    paths = written(forms.select("word", F.col("form").alias("root")), "paths")
    for _ in range(rounds):
        onward = paths.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        paths = written(paths.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "paths")
        if paths.filter("moved").isEmpty():
            return paths.select("word", "root")
        paths = paths.drop("moved")
    raise RuntimeError(f"forms have not ended after {rounds} rounds")


def grouped(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of docs (doc_id, text; other columns are ignored).

    Texts are read whole; a null text has no words, a null doc_id is hashed as empty, repeated rows count again. Of near
    words with the same n the first in code-point order is the form. An empty table gives no rows.
    """
    words = written(vocabulary(docs), "words")
    pairs = near_words(words, shard_words)
    first = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), first.alias("best"))
    met = words.join(best, "word", "left").withColumns({"n_near": F.coalesce("n_near", F.lit(0).cast("bigint")), "form_n": -F.col("best.less")})
    far = F.col("form_n") >= RATIO * F.col("n")
    met = written(met.select("word", "n", "n_near", F.when(far, F.col("best.form")).alias("form"), F.when(far, F.col("form_n")).alias("form_n")), "forms")
    ends = roots(met.filter("form IS NOT NULL"))
    return met.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
