"""The trie of conversations by their turns: which prefixes several of them share, and how much that saves.

A node is a distinct sequence of first turns. A prefix's digest is the exclusive or of a 128-bit hash of each of its
turns with its place. A count-min sketch over all digests tells which of them surely come once: the estimate is never
too low, so that one proves a singleton. From its first singleton on, a conversation is alone, and its tail's nodes
are made where they are; only digests that may be shared are shuffled and grouped, which is exact whatever the sketch
says. Each node belongs to the smallest conversation in it, so that a conversation owns the end of its own path; what a
subtree sums up is added along the paths of the owners.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import staged

#: Turns of a conversation that one window holds; longer ones are put together from such chunks.
CHUNK = 1024
#: Ids of members that end at a node and are listed together.
LIST = 512
#: Cells of each of the sketch's two rows: four to a prefix, as a power of two, within these bounds. A cell is a bit in the end.
CELLS = (1 << 16, 1 << 26)
KEY = ["p1", "p2"]
WORDS = r"[^\x20\x09-\x0D]+"


def _running(rows: DataFrame, place: str, columns: dict[str, Callable[[Column], Column]], combine: dict[str, Callable[[Column, Column], Column]], descending: bool = False) -> DataFrame:
    """rows, with each of the columns aggregated from its conversation's first place (the last, if descending) to its own.

    Windows hold a chunk; what comes before a chunk is aggregated by chunks and joined.
    """
    order = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    rows = rows.withColumn("_chunk", F.floor(F.col(place) / CHUNK))
    inside = Window.partitionBy("conv_id", "_chunk").orderBy(order(place)).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv_id").orderBy(order("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    chunks = rows.groupBy("conv_id", "_chunk").agg(*(f(F.col(c)).alias(f"_{c}") for c, f in columns.items()))
    chunks = chunks.select("conv_id", "_chunk", *(f(F.col(f"_{c}")).over(earlier).alias(f"_{c}") for c, f in columns.items())).where(" or ".join(f"_{c} is not null" for c in columns))
    both = rows.withColumns({c: f(F.col(c)).over(inside) for c, f in columns.items()}).join(chunks, ["conv_id", "_chunk"], "left")
    return both.withColumns({c: F.when(F.col(f"_{c}").isNull(), F.col(c)).otherwise(combine[c](F.col(c), F.col(f"_{c}"))) for c in columns}).drop("_chunk", *(f"_{c}" for c in columns))


def turn_keys(turns: DataFrame) -> DataFrame:
    """(conv_id, place, h1, h2, words) of conversations(conv_id, turn, role, text): places from 1, hashes of role and text, words of the text.

    Turns go by number, null first, rows of one number by role and then by a hash of their text; null roles and texts
    count as empty; rows that repeat are turns of their own; rows of a null conv_id are left out. Further columns are
    not read.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    first = F.lit(-(1 << 62))
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), first).alias("turn"), role.alias("role"),
        F.xxhash64(F.lit(1), role, text).alias("h1"), F.xxhash64(F.lit(2), text, role).alias("h2"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"),
    ).withColumn("chunk", F.floor(F.col("turn") / CHUNK))
    inside = Window.partitionBy("conv_id", "chunk").orderBy("turn", "role", "h1", "h2")
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("conv_id", "chunk").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(earlier)).where("before is not null").drop("n")
    placed = rows.withColumn("at", F.row_number().over(inside)).join(before, ["conv_id", "chunk"], "left")
    return placed.select("conv_id", (F.coalesce("before", F.lit(0)) + F.col("at")).cast("long").alias("place"), "h1", "h2", "words")


def _sketch(prefixes: DataFrame, cells: int) -> np.ndarray:
    """The count-min sketch of all digests, of whose counters only one or more than one matters: a bit a cell, set where it is one."""
    mask = F.lit(cells - 1).cast("long")
    cell = F.explode(F.array(F.col("p1").bitwiseAND(mask), F.col("p2").bitwiseAND(mask) + cells)).alias("cell")
    ones = prefixes.select(cell).groupBy("cell").agg(F.count("*").alias("n")).where("n = 1").withColumn("cell", F.col("cell") + 1)
    blocks = ones.groupBy(F.bitmap_bucket_number("cell").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits"))
    bits = np.zeros((2 * cells // 32768, 4096), np.uint8)
    for block, part in blocks.toLocalIterator():  # as many as the sketch has, whatever the input
        bits[block - 1, : len(part)] = np.frombuffer(part, np.uint8)
    return bits.reshape(-1)


def _surely_single(prefixes: DataFrame, cells: int) -> Column:
    """Whether the sketch's estimate of a digest is one."""
    bits = prefixes.sparkSession.sparkContext.broadcast(_sketch(prefixes, cells))

    def single(p1: pd.Series, p2: pd.Series) -> pd.Series:
        found, table = np.zeros(len(p1), bool), bits.value
        for k, p in enumerate((p1, p2)):
            cell = (p.to_numpy() & np.int64(cells - 1)) + k * cells
            found |= (table[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
        return pd.Series(found)

    return F.pandas_udf(single, "boolean")("p1", "p2")


def _ends(members: DataFrame) -> DataFrame:
    """(p1, p2, ends) of (p1, p2, conv_id): by node, lists of at most LIST ids joined by commas, in order; see ends_of()."""
    part = F.floor(F.col("conv_id") / LIST).alias("part")
    lists = members.groupBy(*KEY, part).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    return lists.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("part", "ids")))["ids"].alias("ends"))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The nodes of conversations(conv_id, turn, role, text); see turn_keys() for odd rows and trie_of() for the result."""
    keys = turn_keys(turns)
    return trie_of(keys, turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id")).distinct())


def trie_of(keys: DataFrame, conversations: DataFrame, cells: int | None = None) -> DataFrame:
    """The trie's nodes, given turn_keys() and the distinct ids of all conversations, those without turns among them.

    conv_id: the smallest conversation in the node; depth: its turns, 0 for the root, which holds all conversations;
    parent_conv_id: the parent's conv_id, null for the root; n_convs: the conversations that begin with these turns;
    n_children: the nodes a turn longer; n_leaves: the nodes without children in its subtree, itself included;
    saved_tokens: over its subtree, the words of each node's last turn for every conversation in it but one; ends: the
    ids of those that end here, ascending, joined by commas, in lists that follow each other. Without conversations
    there are no nodes. Conversations that are alike share all their nodes. cells: of a row of the sketch, a power of
    two from 2**16 on; by default it follows the number of turns.
    """
    root = conversations.select("conv_id", F.lit(0).cast("long").alias("place"), *(F.lit(0).cast("long").alias(c) for c in ("h1", "h2", "words")))
    rows = keys.select("conv_id", "place", "h1", "h2", "words").union(root)
    rows = rows.withColumns({p: F.when(F.col("place") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(k), "place", "h1", "h2")) for k, p in enumerate(KEY)})
    xor = lambda c: F.bit_xor(c)
    mine = rows.select("conv_id", "place", "words", F.col("p1").alias("t1"), F.col("p2").alias("t2"), *KEY)
    paths = _running(mine, "place", dict.fromkeys(KEY, xor), dict.fromkeys(KEY, lambda a, b: a.bitwiseXOR(b)))
    length = rows.groupBy("conv_id").agg(F.max("place").alias("length"))
    parent = [F.when(F.col("place") > 0, F.col(p).bitwiseXOR(F.col(t))).alias(f"above{p}") for p, t in (("p1", "t1"), ("p2", "t2"))]
    paths = staged(paths.join(length, "conv_id").select("conv_id", F.col("place").alias("depth"), "length", "words", *KEY, *parent), "prefixes")

    if cells is None:
        cells = min(max(CELLS[0], 1 << (4 * paths.count() - 1).bit_length()), CELLS[1])
    alone = paths.withColumn("single", F.when(F.col("depth") > 0, _surely_single(paths, cells).cast("int")).otherwise(0))
    alone = alone.withColumn("at", F.col("depth"))
    alone = _running(alone, "at", {"single": F.max}, {"single": F.greatest}).drop("at")
    split = staged(alone.withColumn("single", F.col("single") == 1), "screened")
    shared, tails = split.where("not single"), split.where("single")
    # A tail's first node hangs below one that may be shared; the others below their own conversation.
    heads = tails.groupBy("conv_id").agg(F.min_by(F.struct("depth", *KEY, "abovep1", "abovep2"), "depth").alias("h")).select("conv_id", F.col("h.depth").alias("head"), *(F.col(f"h.{c}") for c in (*KEY, "abovep1", "abovep2")))

    nodes = shared.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.max("abovep1").alias("abovep1"), F.max("abovep2").alias("abovep2"),
    )
    above = [F.col(f"abovep{k}").alias(f"p{k}") for k in (1, 2)]
    children = nodes.where("depth > 0").select(*above).union(heads.select(*above)).groupBy(*KEY).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    nodes = staged(nodes.join(_ends(shared.where("depth = length").select(*KEY, "conv_id")), KEY, "left"), "nodes")

    # What owners bring: the words they save, by depth, and a leaf where their path ends without children.
    saved = (F.col("n_convs") - 1) * F.col("words")
    owned = nodes.select("conv_id", "depth", saved.alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf")).where("saved > 0 or leaf > 0")
    brought = shared.select("conv_id", "depth", *KEY).join(owned, ["conv_id", "depth"], "left").join(heads.select("conv_id", F.lit(1).cast("long").alias("tail")), "conv_id", "left")
    # A tail's leaf stands below the last depth that may be shared, and so counts from there up.
    last = split.where("not single").groupBy("conv_id").agg(F.max("depth").alias("last"))
    brought = brought.join(last, "conv_id").select(
        "conv_id", "depth", *KEY, F.coalesce("saved", F.lit(0)).alias("saved"), (F.coalesce("leaf", F.lit(0)) + F.when(F.col("depth") == F.col("last"), F.coalesce("tail", F.lit(0))).otherwise(0)).alias("leaf")
    )
    up = _running(brought, "depth", {"saved": F.sum, "leaf": F.sum}, dict.fromkeys(("saved", "leaf"), lambda a, b: a + b), descending=True)
    sums = up.where("saved > 0 or leaf > 0").groupBy(*KEY).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))

    # Parents by digest: of nodes that may be shared, and of the heads of tails.
    first = nodes.where("depth = 0").select(F.col("conv_id").alias("root_conv_id"))
    ids = nodes.where("depth > 0").select(*KEY, F.col("conv_id").alias("parent_conv_id"))
    shorter = lambda df: df.join(ids.withColumnsRenamed({"p1": "abovep1", "p2": "abovep2"}), ["abovep1", "abovep2"], "left").join(F.broadcast(first)).withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "root_conv_id")))  # noqa: E731  one row of the root
    many = shorter(nodes.join(sums, KEY, "left"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    many = many.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_leaves", "saved_tokens")), F.coalesce("ends", F.array().cast("array<string>")).alias("ends"))

    tops = shorter(heads.withColumnRenamed("head", "depth")).select("conv_id", "depth", F.col("parent_conv_id").alias("top"))
    ends = F.when(F.col("depth") == F.col("length"), F.array(F.col("conv_id").cast("string"))).otherwise(F.array().cast("array<string>"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    lone = tails.join(tops, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", F.coalesce("top", "conv_id").alias("parent_conv_id"), one.alias("n_convs"), (F.col("depth") < F.col("length")).cast("long").alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"), ends.alias("ends"),
    )
    return many.select(*out).union(lone.select(*out))
