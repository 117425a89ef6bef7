"""Line deduplication by an exact set-similarity join, in Spark expressions only.

A line is the set of its lower-case words. Lines with equal sets are brought together by a 128-bit hash first, and only
the earliest line of each set goes on. Then the words of each set are put in order of rarity, counted over all documents;
two sets with a Jaccard similarity of at least t share a word among the first size - ceil(t * size) + 1 of each (prefix
filter), have sizes within a factor t (length filter), and leave room for enough common words from the first shared one on
(positional filter). Parity bits of each set go with its words: two sets differ in at least as many words as these bits
do, which stops nearly all pairs that only share a word. What passes is verified by its exact similarity.

Lists of frequent words would grow with the corpus, and the pairs in them with its square. So a prefix word that is
counted more than `FREQUENT` times is listed together with each later word of the prefix, which is longer by one word for
that: two similar sets of four words or more share the first two of their common words too. No pair is lost by that.

Only the existence of an earlier match counts, so pairs are never made, in a large family of similar lines or elsewhere:
the joins are semi-joins, which end with the first match of a row. The first one keeps the list entries of sets that an
earlier set of the list may be similar to, the second one those of the earlier sets that these may be similar to. Both
get their whole words, and a third one keeps what has an earlier set of the wanted similarity: first in one list of each
set, since similar sets share most of theirs, then in all other lists for the sets that match nothing there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barscreen.llm.common import dropped, narrow, packed, unpacked, written

#: Counters of word hashes: their number is fixed, and with it the size of what tells rare words from frequent ones.
COUNTERS = 1 << 20
STEPS = 3  # levels of rarity for each doubling of a count: 127 levels tell counts up to 2 ** 42 apart
FREQUENT = 4096  # words that are counted more often are listed with a second word
LONG = 64  # sets of more words have 128 parity bits, others 64
SPACES = "\t\r\x0b\x0c"
BROADCAST_ENTRIES = 1_000_000  # list entries that may be broadcast, 64 MB or so
BROADCAST_LINES = 4_000_000  # line numbers (and documents) that may be broadcast, 64 MB or so; beyond, the join shuffles


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def blank(line: Column) -> Column:
    """Whether a line has no word."""
    return F.btrim(line, F.lit(" " + SPACES)) == ""


def words_of(text: Column) -> Column:
    """The lower-case words of a text, repeats and empty strings included."""
    low, odd = F.lower(text), F.lit(False)
    for c in SPACES:  # rare, and slow to look for letter by letter
        odd = odd | F.contains(text, F.lit(c))
    return F.split(F.when(odd, F.translate(low, SPACES, " " * len(SPACES))).otherwise(low), " ", -1)


def _slot(hashed: Column) -> Column:
    return hashed.bitwiseAND(F.lit(COUNTERS - 1))


def level_of(count: Column) -> Column:
    """The class of rarity of a count: it rises with the logarithm and so never comes to a common end."""
    return F.least(F.floor(F.lit(STEPS) * F.log2(F.greatest(count, F.lit(1)).cast("double"))), F.lit(127)).cast("bigint")


def rarity(docs: DataFrame) -> tuple[Column, Column]:
    """Two scalars: an array of COUNTERS bytes, the level of the words whose hash ends in each slot, and the empty string's key."""
    words = docs.select(F.replace("text", F.lit("\n"), F.lit(" ")).alias("text")).select(F.explode(words_of(F.col("text"))).alias("w"))
    counts = written(words.filter("w != ''").groupBy(_slot(F.xxhash64("w")).alias("slot")).agg(F.count("*").alias("n")), "word-counts")
    slots = docs.sparkSession.range(COUNTERS).select(F.col("id").alias("slot")).join(counts, "slot", "left")
    of_slot = slots.select("slot", level_of(F.coalesce("n", F.lit(0))).cast("tinyint").alias("level"))
    ordered = F.sort_array(F.collect_list(F.struct("slot", "level")))
    levels = written(of_slot.agg(F.transform(ordered, lambda x: x["level"]).alias("levels")), "word-levels")
    return levels.agg(F.first("levels")).scalar(), levels.agg(F.first(_key(F.xxhash64(F.lit("")), F.col("levels")))).scalar()


def hashes_of(line: Column) -> Column:
    """The distinct words of a line as hashes, in no useful order."""
    return F.array_remove(F.array_distinct(F.transform(words_of(line), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _key(hashed: Column, levels: Column) -> Column:
    """A number that orders words by rarity: the level in the upper byte, the hash's upper bits in the others."""
    level = F.coalesce(F.get(levels, _slot(hashed).cast("int")), F.lit(0).cast("tinyint"))  # an array without nulls sorts fast
    return F.shiftleft(level.cast("bigint"), 56).bitwiseOR(F.shiftrightunsigned(hashed, 8))


def by_rarity(line: Column, levels: Column, none: Column) -> Column:
    """The distinct words of a line as keys in order of rarity; `none` is the key of the empty string, which is no word.

    Repeats go after the last lambda: Spark interprets what lies inside of one, and compiles what lies around it. Only one
    place may name `levels`, or each row would get a copy.
    """
    hashes = F.transform(words_of(line), lambda w: F.xxhash64(w))
    return F.sort_array(F.array_except(F.transform(hashes, lambda h: _key(h, levels)), F.array(none)))


def parity(hashes: Column) -> Column:
    """64 bits, each flipped once for every word that falls on it."""
    one = F.lit(1).cast("bigint")
    return F.aggregate(hashes, F.lit(0).cast("bigint"), lambda bits, h: bits.bitwiseXOR(F.call_function("shiftleft", one, h.bitwiseAND(F.lit(63)).cast("int"))))


def _prefix(size: Column, t: float) -> Column:
    return (size - F.ceil(F.lit(t) * size - 1e-9) + 1).cast("int")


def sketched(keyed: DataFrame, t: float) -> DataFrame:
    """keyed (doc_id, line, h: words in order of rarity) with a hash of the set, its size, parity bits and list keys.

    `bits` and `more` are the parities of one half of the words each if there are more than LONG, or else `bits` has all.
    `single` are the keys of the prefix words that are not frequent, and so come first; `double` those of the others.
    """
    size, first = F.size("h"), F.col("first")
    keyed = keyed.withColumn("first", F.slice("h", F.lit(1), _prefix(size, t)))  # cut once, outside of the lambdas below
    half = F.filter("h", lambda w: w.bitwiseAND(F.lit(64)) != 0)
    more = F.when(size > LONG, parity(half)).otherwise(F.lit(0).cast("bigint"))
    frequent = F.lit(int(STEPS * (FREQUENT.bit_length() - 1)) << 56)
    longer = F.slice("h", F.lit(1), _prefix(F.size("h"), t) + 1)
    pairs = F.transform(first, lambda w, i: F.when(w < frequent, F.array().cast("array<struct<pos: int, word: bigint>>")).otherwise(F.transform(F.filter(longer, lambda v: v > w), lambda v: F.struct(i.alias("pos"), F.xxhash64(w, v).alias("word")))))
    double = F.when(F.try_element_at(first, F.lit(-1)) >= frequent, F.flatten(pairs))
    single = F.transform(F.filter(first, lambda w: w < frequent), lambda w: F.hash(w))
    listed = (size >= t / (1 - t) - 1e-9) if t < 1 else F.lit(False)  # smaller sets are only similar to equal ones
    out = keyed.select("doc_id", "line", F.xxhash64("h").alias("h1"), F.xxhash64(F.lit(1), "h").alias("h2"), size.alias("size"), parity(F.col("h")).alias("all"), more.alias("more"), F.when(listed, single).alias("single"), F.when(listed, double).alias("double"))
    return out.withColumn("bits", F.col("all").bitwiseXOR(F.col("more"))).drop("all")


def _off(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """In how many parity bits two sets differ: never more than they differ in words."""
    bits, more = a["bits"].bitwiseXOR(b["bits"]), a["more"].bitwiseXOR(b["more"])
    both = (F.least(a["size"], b["size"]) > LONG) | (F.greatest(a["size"], b["size"]) <= LONG)
    return F.when(both, F.bit_count(bits) + F.bit_count(more)).otherwise(F.bit_count(bits.bitwiseXOR(more)))


def _passes(a: dict[str, Column], b: dict[str, Column], t: float) -> Column:
    """The length, positional and parity filters for sets that share a word at a's and b's pos, by size, pos and bits."""
    both = a["size"] + b["size"]
    needed = F.ceil(F.lit(t / (1 + t)) * both - 1e-9)  # common words that a similarity of t takes
    sizes = F.lit(t) * F.greatest(a["size"], b["size"]) <= F.least(a["size"], b["size"]) + 1e-9
    room = F.least(a["size"] - a["pos"], b["size"] - b["pos"]) >= needed
    return sizes & room & (_off(a, b) <= both - 2 * needed)


def _by_document(lines: DataFrame, name: str) -> DataFrame:
    """(doc_id, name) with the line numbers of each document, to be broadcast if there are few enough."""
    held = written(lines.groupBy("doc_id").agg(F.collect_set("line").alias(name)), "lines-by-document")
    count = held.agg(F.coalesce(F.sum(F.size(name) + 1), F.lit(0))).first()[0]
    return F.broadcast(held) if count <= BROADCAST_LINES else held


def _with_words(entries: DataFrame, words: DataFrame, name: str) -> DataFrame:
    return entries.join(words.withColumnRenamed("a", name), ["doc_id", "line", "size"])


def _word_sets(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, line, size, a) of the lines: the whole set of words as 64-bit hashes, from the texts once more."""
    texts = docs.join(_by_document(lines, "wanted"), "doc_id").withColumn("lines", lines_of(F.col("text")))
    at = F.explode(F.transform("wanted", lambda k: F.struct(k.alias("line"), F.get("lines", k).alias("words"))))
    found = texts.select("doc_id", at.alias("x")).select("doc_id", "x.line", hashes_of(F.col("x.words")).alias("a"))
    return written(found.withColumn("size", F.size("a")), "line-words")


def _listed(sets: DataFrame) -> DataFrame:
    """Each set once for each list that it is in: `word` is the list, `pos` the place of its first word."""
    own = ("doc_id", "line", "size", "bits", "more")
    single = sets.select(*own, F.posexplode("single").alias("pos", "word"))
    double = sets.filter(F.size("double") > 0).select(*own, F.explode("double").alias("x")).select(*own, "x.pos", F.hash("x.word").alias("word"))
    # the task's number adds nothing, but keeps the optimizer from joining the halves of the union one by one
    return single.union(double).withColumn("pos", F.col("pos") + F.least(F.spark_partition_id(), F.lit(0)))


ENTRY = ("doc_id", "line", "size", "pos", "bits", "more")


def _may_match(entries: DataFrame, others: DataFrame, t: float, earlier: bool, also: Column | None = None) -> DataFrame:
    """The entries with one in `others`, of the same list, that is earlier (or later) and passes the filters."""
    own, x = ({c: F.col(f"{side}.{c}") for c in ENTRY} for side in ("own", "x"))
    one, two = (x, own) if earlier else (own, x)
    in_order = (one["doc_id"] < two["doc_id"]) | ((one["doc_id"] == two["doc_id"]) & (one["line"] < two["line"]))
    met = (F.col("own.word") == F.col("x.word")) & in_order & _passes(own, x, t)
    return entries.alias("own").join(others.alias("x"), met if also is None else met & also, "left_semi")


def _matched(entries: DataFrame, earlier: DataFrame, words: DataFrame, small: Callable[[DataFrame], DataFrame], t: float) -> DataFrame:
    """The sets of the entries that an earlier set of the same list has the wanted similarity with, by their whole words."""
    common = F.size(F.array_intersect("a", "b"))
    similar = common * F.lit(1 + t) >= F.lit(t) * (F.size("a") + F.size("b")) - 1e-9  # named twice, they would be counted twice
    targets = _may_match(earlier, small(entries), t, earlier=False)
    found = _may_match(_with_words(entries, words, "a"), _with_words(targets, words, "b"), t, earlier=True, also=similar)
    return written(found.select("doc_id", "line", "size", "bits", "more").distinct(), "matched-lines")


def first_lines(docs: DataFrame, t: float = 0.8) -> DataFrame:
    """(doc_id, line) of every line (from 0) of docs (doc_id, text) with words that no earlier line matches."""
    return _first_lines(docs, t)[0].distinct()


def _first_lines(docs: DataFrame, t: float) -> tuple[DataFrame, list[DataFrame]]:
    """What first_lines returns, with repeats where rows share a doc_id, and the written tables that it is read from."""
    if not 0.5 < t <= 1:
        raise ValueError("t must be over 0.5: two similar sets of two words or more then share two words")
    docs = narrow(docs, "doc_id", "text").filter("doc_id is not null and text is not null")
    split = docs.select("doc_id", F.posexplode(lines_of(F.col("text"))).alias("line", "words"))
    levels, none = rarity(docs)
    keyed = split.withColumn("levels", levels).select("doc_id", "line", by_rarity(F.col("words"), F.col("levels"), none).alias("h"))
    first = F.min(F.struct("doc_id", "line")).alias("at")
    sets = sketched(keyed, t).groupBy("h1", "h2").agg(first, *[F.first(c).alias(c) for c in ("size", "bits", "more", "single", "double")])
    sets = written(sets.filter("size > 0").select("at.*", "size", "bits", "more", "single", "double"), "line-sets")
    lists = _listed(sets)
    later = written(_may_match(lists, lists, t, earlier=True), "line-candidates")  # both sides share one exchange
    small = F.broadcast if later.count() <= BROADCAST_ENTRIES else lambda df: df
    earlier = written(_may_match(lists, small(later), t, earlier=False), "line-targets")
    words = _word_sets(later.select("doc_id", "line").union(earlier.select("doc_id", "line")).distinct(), docs)
    which = ["doc_id", "line", "size", "bits", "more"]  # rows may share a doc_id
    first = written(later.groupBy(*which).agg(F.min(F.struct("pos", "word")).alias("x")).select(*which, "x.*"), "line-first-candidates")
    found = _matched(first, earlier, words, small, t)
    rest = written(later.join(found, which, "left_anti").join(first, [*which, "pos", "word"], "left_anti"), "line-other-candidates")
    tables = [sets, found]
    if not rest.isEmpty():
        tables.append(_matched(rest, earlier, words, small, t))
        found = found.union(tables[-1])
    dropped(later, earlier, words, first, rest)
    return sets.join(found, which, "left_anti").select("doc_id", "line"), tables


def deduplicated(docs: DataFrame, t: float = 0.8) -> DataFrame:
    """docs with every line removed that an earlier line matches; n_removed says how many.

    A line takes part if it has a word, be it one only; lines without words stay. Words are split at ASCII white space and
    compared in lower case. Earlier means a smaller doc_id, or the same doc_id and a smaller line number; whether the
    earlier line is itself removed doesn't matter; t is over 0.5. Rows with a null doc_id or text stay as they are, and so do their lines.
    Rows that share a doc_id are one document for the order: lines at the same place of both aren't earlier than each
    other, and a place is removed from all of them only if no line at it stays. All other columns are kept, but for one
    named n_removed. An empty table gives no rows; a text of any length is one row, and its lines are dealt out by word.
    """
    first, sets = _first_lines(docs, t)
    kept = _by_document(first, "kept")
    dropped(*sets)
    rows = docs.select("doc_id", packed(docs).alias("row"), F.col("text").alias("text"), lines_of(F.col("text")).alias("lines"))
    joined = rows.join(kept, "doc_id", "left").withColumn("all", F.sequence(F.lit(0), F.size("lines") - 1))
    wordless = F.filter("all", lambda k: blank(F.get("lines", k)))
    none = F.array().cast("array<int>")
    gone = F.array_except(F.array_except("all", F.coalesce("kept", none)), wordless)
    joined = joined.withColumn("gone", F.when(F.col("doc_id").isNull() | F.col("text").isNull(), none).otherwise(gone))
    rebuilt = F.array_join(F.transform(F.array_except("all", "gone"), lambda k: F.get("lines", k)), "\n")
    text = F.when(F.size("gone") == 0, F.col("text")).otherwise(rebuilt).alias("text")
    return joined.select(*unpacked("row", docs.columns, "text", "n_removed"), text, F.size("gone").cast("bigint").alias("n_removed"))
