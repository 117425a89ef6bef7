"""A prefix trie of conversations by distributed MSD radix partitioning.

Turns (role, text) get ids of a dictionary whose order is that of the texts, so conversations become short arrays of
numbers and texts are shuffled no more. Equal conversations are one sequence with a count; the digest of their ids is
taken from ranges of ids, joined to strings in many tasks, by one pass over these strings.

From the root, buckets of sequences with more than `local` turns left are counted by the prefixes of their next digit
(1 turn, then 2, 4, 8, 16): prefixes that are still too large become nodes and buckets of the next round. All other
buckets are finished in a task each, by multikey quicksort, whose recursion emits the nodes below. A node is known by its
depth and smallest member. Sums over subtrees come from the buckets, go up through the prefixes of each round's digit,
and from there to the round before.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barscreen.llm.common import narrow, written

#: Turns left in a bucket, its sequences' ends counted too, up to which one task finishes it.
LOCAL = 8192
DIGITS = (1, 2, 4, 8, 16)
#: Large prefixes of a round up to which they are broadcast: some 200 bytes each. Beyond that they are joined by shuffles.
BROADCAST_PREFIXES = 200_000
#: Turns of more than one in so many rows are looked up by a broadcast of at most so many entries.
HOT_SHARE = 1000
NONE = hashlib.sha256(b"").hexdigest()
NODES = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, id, bytes) with ids of a dictionary in the order of (role, text)."""
    rows = narrow(conversations, "conv_id", "turn", "role", "text").filter("conv_id IS NOT NULL")
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    said = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    entries = said.groupBy("role", "text").agg(F.count("*").alias("rows")).orderBy("role", "text")
    entries = entries.select(key.alias("key"), F.monotonically_increasing_id().alias("id"), F.octet_length("text").cast("bigint").alias("bytes"), "rows")
    entries = written(entries, "turn-dictionary")
    keyed = said.select("conv_id", "turn", key.alias("key"))
    total = entries.agg(F.sum("rows")).first()[0] or 0
    hot = F.col("rows") * HOT_SHARE > F.lit(total)  # fewer than HOT_SHARE entries
    often = entries.filter(hot).select("key", F.col("id").alias("hot_id"), F.col("bytes").alias("hot_bytes"))
    met = keyed.join(F.broadcast(often), "key", "left")
    rest = met.filter("hot_id IS NULL").join(entries.filter(~hot).select("key", "id", "bytes"), "key")
    return met.filter("hot_id IS NOT NULL").select("conv_id", "turn", F.col("hot_id").alias("id"), F.col("hot_bytes").alias("bytes")).union(rest.select("conv_id", "turn", "id", "bytes"))


def own_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the (id, bytes) of each conversation in order of turn (nulls first), then role, then text."""
    turn = F.sort_array(F.collect_list(F.struct("turn", "id", "bytes")))
    made = _turns(conversations).groupBy("conv_id").agg(turn.alias("t"))
    return made.select("conv_id", F.transform("t", lambda x: F.struct(x["id"].alias("id"), x["bytes"].alias("bytes"))).alias("turns"))


def rebuilt(own: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """(conv_id, turns): the first h turns of conversation c - c % group, then c's own after its first h; h = crc32(c) % most."""
    base = F.col("conv_id") - F.col("conv_id") % group
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    together = Window.partitionBy("base")  # `group` rows at most
    first = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, most - 1))).over(together)
    with_first = own.withColumns({"base": base, "h": h}).withColumn("first", first)
    head = F.coalesce(F.slice("first", F.lit(1), F.col("h")), F.array().cast(own.schema["turns"].dataType))
    tail = F.slice("turns", F.col("h") + 1, F.size("turns"))
    return with_first.select("conv_id", F.concat(head, tail).alias("turns"))


def sequences(convs: DataFrame) -> DataFrame:
    """(ids, bytes, n, conv_id, ends): each distinct sequence of turns once, its members counted, the smallest, their digest."""
    ids, sizes = F.transform("turns", lambda t: t["id"]), F.transform("turns", lambda t: t["bytes"])
    dealt = convs.select("conv_id", ids.alias("ids"), sizes.alias("bytes")).repartitionByRange("conv_id").withColumn("range", F.spark_partition_id())
    members = F.sort_array(F.collect_list("conv_id"))
    parts = dealt.groupBy("ids", "bytes", "range").agg(members.alias("m"))
    parts = parts.select("ids", "bytes", "range", F.size("m").cast("bigint").alias("n"), F.element_at("m", 1).alias("conv_id"), F.array_join(F.transform("m", lambda c: c.cast("string")), ",").alias("text"))

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, found = None, None
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                ids = tuple(r.ids)
                if now is None or ids != now[0]:
                    if now is not None:
                        out.append((*now, *found[:2], found[2].hexdigest()))
                    now, found = (ids, tuple(r.bytes)), [0, r.conv_id, hashlib.sha256()]
                else:
                    found[2].update(b",")
                found[2].update(r.text.encode())
                found[0] += r.n
            yield pd.DataFrame(out, columns=["ids", "bytes", "n", "conv_id", "ends"])
        yield pd.DataFrame([] if now is None else [(*now, *found[:2], found[2].hexdigest())], columns=["ids", "bytes", "n", "conv_id", "ends"])

    sorted_parts = parts.repartition("ids").sortWithinPartitions("ids", "range")
    return sorted_parts.mapInPandas(digests, "ids array<bigint>, bytes array<bigint>, n bigint, conv_id bigint, ends string")


def multikey_quicksort(rows: list[tuple], start: int) -> list[list]:
    """The nodes of a bucket: sequences (ids, bytes, n, conv_id, ends) that are all different and share their first `start` turns.

    Nodes are [conv_id, depth, parent's conv_id, n_convs, n_children, n_leaves, saved_tokens, ends]; those of depth start + 1
    have no parent here. Three-way partitions by the turn at a depth; the middle part is a node and goes on one turn deeper.
    """
    nodes: list[list] = []
    parents: list[int] = []
    todo = [(rows, start, -1)]  # parts that share the turns of the node at an index
    while todo:
        part, depth, parent = todo.pop()
        if not part:
            continue
        pivot = part[len(part) // 2][0][depth]
        less = [r for r in part if r[0][depth] < pivot]
        same = [r for r in part if r[0][depth] == pivot]
        more = [r for r in part if r[0][depth] > pivot]
        todo += [(more, depth, parent), (less, depth, parent)]
        n = sum(r[2] for r in same)
        ends = next((r[4] for r in same if len(r[0]) == depth + 1), NONE)
        up = None if parent < 0 else nodes[parent][0]
        nodes.append([min(r[3] for r in same), depth + 1, up, n, 0, 0, (n - 1) * int(same[0][1][depth]), ends])
        parents.append(parent)
        todo.append(([r for r in same if len(r[0]) > depth + 1], depth + 1, len(nodes) - 1))
    for k in range(len(nodes) - 1, -1, -1):  # a node comes before all nodes below it
        node = nodes[k]
        node[5] = node[5] or 1
        if parents[k] >= 0:
            up = nodes[parents[k]]
            up[4], up[5], up[6] = up[4] + 1, up[5] + node[5], up[6] + node[6]
    return nodes


def _finished(buckets: DataFrame) -> DataFrame:
    """NODES and `top` (whether the parent is outside) of buckets (depth, parent, ids, bytes, n, conv_id, ends)."""
    nexts = F.element_at("ids", (F.col("depth") + 1).cast("int"))
    dealt = buckets.withColumn("next", nexts).repartition("depth", "parent", "next").sortWithinPartitions("depth", "parent", "next")
    columns = [c.split()[0] for c in NODES.split(", ")]

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rows = None, []

        def made() -> list[list]:
            nodes = multikey_quicksort(rows, now[0]) if now else []
            return [[*n[:2], now[1] if n[2] is None else n[2], *n[3:], n[2] is None] for n in nodes]

        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if (r.depth, r.parent, r.next) != now:
                    out += made()
                    now, rows = (r.depth, r.parent, r.next), []
                rows.append((tuple(r.ids), r.bytes, r.n, r.conv_id, r.ends))
            yield pd.DataFrame(out, columns=[*columns, "top"])
        yield pd.DataFrame(made(), columns=[*columns, "top"])

    return dealt.select("depth", "parent", "next", "ids", "bytes", "n", "conv_id", "ends").mapInPandas(finish, f"{NODES}, top boolean")


def _prefixes(alive: DataFrame, step: int, *kept: str) -> DataFrame:
    """A row for each prefix of 1 to step turns that follows a row's depth."""
    js = F.sequence(F.lit(1), F.least(F.lit(step), F.size("ids") - F.col("depth").cast("int")))
    at = alive.filter(F.size("ids") > F.col("depth")).withColumn("j", F.explode(js))
    return at.select("parent", "depth", "j", F.slice("ids", (F.col("depth") + 1).cast("int"), F.col("j")).alias("prefix"), *kept)


def trie(convs: DataFrame, local: int = LOCAL, digits: tuple[int, ...] = DIGITS) -> DataFrame:
    """The nodes (NODES) of the trie of conversations (conv_id, turns), conv_id being unique and turns (id, bytes).

    The ids of one conversation (16 bytes a turn) must fit a row. Without any conversation there is no node, not even a
    root. The rows of one id may be any number: prefixes are counted in the tasks that hold them before they are shuffled.
    """
    found = written(sequences(convs), "sequences")
    turnless = F.size("ids") == 0
    root = found.agg(F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"), F.sum(F.size("ids") + 1).alias("left"), F.max(F.when(turnless, F.col("ends"))).alias("ends")).first()
    spark = convs.sparkSession
    if root["n"] is None:
        return spark.createDataFrame([], NODES)
    alive = found.filter(~turnless).withColumns({"parent": F.lit(root["conv_id"]), "depth": F.lit(0).cast("bigint")})
    rounds, buckets = [], []
    depth, large = 0, root["left"] > local
    while large:
        step = digits[min(len(rounds), len(digits) - 1)]
        last = F.size("ids") == F.col("depth") + F.col("j")
        each = _prefixes(alive, step, "ids", "bytes", "n", "conv_id", "ends").select(
            "parent", "depth", "j", "prefix", "n", "conv_id", (F.size("ids") - F.col("depth") - F.col("j") + 1).alias("left"), F.element_at("bytes", (F.col("depth") + F.col("j")).cast("int")).alias("size"), F.when(last, F.col("ends")).alias("ends")
        )
        counted = each.groupBy("parent", "depth", "j", "prefix").agg(F.sum("left").alias("left"), F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"), F.max("size").alias("size"), F.max("ends").alias("ends"))
        nodes = written(counted.filter(F.col("left") > local), "large-prefixes")
        rounds.append((depth, nodes))
        if not (many := nodes.count()):
            break
        side = nodes.select("parent", "prefix", F.col("conv_id").alias("node"))
        deepest = _prefixes(alive, step, "conv_id").join(F.broadcast(side) if many <= BROADCAST_PREFIXES else side, ["parent", "prefix"])
        deepest = deepest.groupBy("conv_id").agg(F.max(F.struct("j", "node")).alias("hit"))
        moved = alive.join(deepest, "conv_id", "left").withColumns({"went": F.coalesce("hit.j", F.lit(0)), "parent": F.coalesce("hit.node", "parent")})
        moved = moved.withColumn("depth", F.col("depth") + F.col("went")).drop("hit")
        dealt = written(moved.filter(F.size("ids") > F.col("depth")), "buckets")
        buckets.append(dealt.filter(F.col("went") < step).drop("went"))
        alive, depth = dealt.filter(F.col("went") == step).drop("went"), depth + step
        large = not alive.isEmpty()
    done = functools.reduce(DataFrame.unionByName, [*buckets, alive])
    small = written(_finished(done), "trie-nodes")
    below = small.filter("top").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias("conv_id"))
    below = below.agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    made = small.drop("top")
    for _, nodes in reversed(rounds):
        upper, below = _summed(nodes, below)
        made = made.unionByName(upper)
    whole = below.filter("depth = 0").agg(F.sum("children"), F.sum("leaves"), F.sum("saved")).first()
    top = (root["conv_id"], 0, None, root["n"], whole[0] or 0, whole[1] or 1, whole[2] or 0, root["ends"] or NONE)
    return made.unionByName(spark.createDataFrame([top], NODES))


def _or_none(name: str) -> Column:
    return F.coalesce(name, F.lit(0))


def _summed(nodes: DataFrame, below: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of a round with the sums of their subtrees; what lies below the nodes of the rounds before."""
    own = nodes.withColumns({"at": F.col("depth") + F.col("j"), "own": (F.col("n") - 1) * F.col("size")})
    sums = below.select(F.col("depth").alias("at"), "conv_id", "children", "leaves", "saved")
    own = written(own.join(sums, ["at", "conv_id"], "left"), "large-nodes")
    prefixes = own.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("j")))).select(
        "parent",
        "depth",
        F.expr("slice(prefix, 1, k)").alias("prefix"),
        F.when(F.col("k") == F.col("j"), _or_none("children")).otherwise((F.col("k") == F.col("j") - 1).cast("bigint")).alias("n_children"),
        _or_none("leaves").alias("n_leaves"),
        (F.col("own") + _or_none("saved")).alias("saved_tokens"),
    )
    total = prefixes.groupBy("parent", "depth", "prefix").agg(*[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")])
    total = written(total, "large-sums")
    parents = own.select("parent", "prefix", F.col("conv_id").alias("up"))
    made = own.join(total, ["parent", "depth", "prefix"]).withColumn("before", F.expr("slice(prefix, 1, j - 1)"))
    made = made.join(parents.withColumnRenamed("prefix", "before"), ["parent", "before"], "left")
    upper = made.select(
        "conv_id", F.col("at").alias("depth"), F.coalesce("up", "parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NONE)).alias("ends_sha256")
    )
    over = total.filter(F.size("prefix") == 0).select("depth", F.col("parent").alias("conv_id"), F.col("n_children").alias("children"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    rest = below.join(nodes.select((F.col("depth") + F.col("j")).alias("depth"), "conv_id"), ["depth", "conv_id"], "left_anti")
    joined = rest.unionByName(over).groupBy("depth", "conv_id").agg(*[F.sum(c).alias(c) for c in ("children", "leaves", "saved")])
    return upper, written(joined, "below")


def prefix_trie(conversations: DataFrame, local: int = LOCAL, digits: tuple[int, ...] = DIGITS) -> DataFrame:
    """The trie (NODES) of the rebuilt conversations (conv_id, turn, role, text; other columns are ignored).

    Turns are in order of turn (nulls first), then role, then text; repeated rows stay. A null role or text is empty; rows
    with a null conv_id are no conversation's and are left out. Texts of any length count whole. An empty table gives no
    rows. c % 5 has the sign of c.
    """
    return trie(written(rebuilt(own_turns(conversations)), "rebuilt-conversations"), local, digits)
