"""Benchmark decontamination: windows of each item's size, found by SimHash and verified by their shingles.

Windows are laid where a document shares a word shingle with an item, lined up with it; any other window has
similarity 0. Which items a window is held against, the fingerprints tell: they are cut into BLOCKS blocks, so that
of two fingerprints within the radius one block differs in at most radius // BLOCKS bits. Items are indexed under all
such variants of their blocks, windows look their blocks up, and the shingles of the pairs within the radius are
compared; of those that meet beyond it, the pairs within REACH, too. Of blocks of 13 bits that may differ in 2, one pair
in nine that have nothing in common meets; of fingerprints of texts with nothing in common, three in 10,000 are within
REACH.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import checked_broadcast, staged

#: Bits of a fingerprint in which a window and its item may differ, of 128, to be sure to meet; and those in which they may
#: differ if they meet. At a similarity of 0.8 about 19 do, with a deviation of 4.
RADIUS, REACH = 29, 45
#: The blocks that each half of a fingerprint is cut into: (lowest bit, bits).
CUTS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
BLOCKS = 2 * len(CUTS)


def normal_words(text: Column) -> Column:
    """The lower-cased runs of letters and digits of a text; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def with_shingles(df: DataFrame, text_col: str, size: int) -> DataFrame:
    """df with n_words, and shingles: the hash of each run of `size` words, in order."""
    hashed = df.withColumn("_words", F.transform(normal_words(F.col(text_col)), lambda w: F.xxhash64(w))).withColumn("n_words", F.size("_words"))
    # Naming _words several times keeps the optimizer from computing it anew for each shingle.
    starts = F.sequence(F.lit(0), F.size("_words") - size)
    shingles = F.when(F.size("_words") >= size, F.transform(starts, lambda i: F.xxhash64(*(F.get("_words", i + k) for k in range(size)))))
    return hashed.withColumn("shingles", F.coalesce(shingles, F.array().cast("array<bigint>"))).drop("_words")


def simhash(hashes: str) -> Column:
    """The 64-bit SimHash of an array of hashes, an SQL expression; repeats count."""
    ones = f"aggregate({hashes}, 0, (s, h) -> s + cast(shiftright(h, b) & 1L as int))"
    return F.expr(f"aggregate(sequence(0, 63), 0L, (acc, b) -> if(2 * {ones} > size({hashes}), acc | shiftleft(1L, b), acc))")


def with_fingerprint(df: DataFrame) -> DataFrame:
    """df with fp and fp2, the halves of the 128-bit fingerprint of its shingles."""
    again = df.withColumns({"fp": simhash("shingles"), "_again": F.transform("shingles", lambda h: F.xxhash64(h))})
    return again.withColumn("fp2", simhash("_again")).drop("_again")


def blocks(errors: int = 0) -> Column:
    """An array of keys: the blocks of the fingerprint in fp and fp2, and all values that differ from them in at most `errors` bits.

    A key tells the span, the block and its value.
    """
    return F.concat(*(_block_keys(k, errors) for k in range(BLOCKS)))


def _block_keys(k: int, errors: int) -> Column:
    low, bits = CUTS[k % len(CUTS)]
    value = F.shiftrightunsigned("fp" if k < len(CUTS) else "fp2", low).bitwiseAND(F.lit((1 << bits) - 1))
    place = F.shiftleft(F.col("span").cast("long"), 20).bitwiseOR(F.lit(k << 16))
    return F.transform(F.lit(close_masks(bits, errors)).cast("array<bigint>"), lambda m: value.bitwiseXOR(m).bitwiseOR(place))


def close_masks(bits: int, errors: int) -> list[int]:
    """What a block is to be xored with for all blocks that differ from it in at most `errors` bits."""
    return [sum(1 << b for b in some) for n in range(errors + 1) for some in combinations(range(bits), n)]


def differing(a: str, b: str) -> Column:
    """In how many bits two fingerprints differ, of columns with these suffixes."""
    return sum((F.bit_count(F.col(f"{x}{a}").bitwiseXOR(F.col(f"{x}{b}"))) for x in ("fp", "fp2")), F.lit(0))


def find_passages(docs: DataFrame, items: DataFrame, size: int = 5, similarity: float = 0.8, radius: int = RADIUS, reach: int = REACH, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(id_col, item_col, start, n_words, similarity): where documents hold an item, once for each pair, at its best window.

    start counts the document's words before the window, n_words the window's. Words are lower-cased runs of letters
    and digits. similarity is the weighted Jaccard one of the shingles of window and item, each weighing as often as
    it comes; windows of at least `similarity` whose fingerprint is within the radius of the item's count, or within
    reach if a block of both is close, of equal ones the first. Items of fewer words than a shingle, null and empty texts, and null ids take no part; texts have
    no bound of length. Rows that repeat an id count as one document or item of several texts. Empty tables give an
    empty result; further columns are not read.
    """
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    known = with_shingles(items.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), F.col(text_col).alias("text")), "text", size).drop("text")
    known = staged(with_fingerprint(known.where(F.col("n_words") >= size)), "items")

    # Windows that line up a shared shingle.
    anchors = staged(known.select(F.col("n_words").alias("span"), F.posexplode("shingles").alias("at", "h")).distinct(), "anchors")
    # The outer form: for the other one the optimizer adds a filter that computes the words anew for each shingle.
    places = with_shingles(texts, "text", size).select("doc", F.posexplode_outer("shingles").alias("place", "h"))
    laid = places.join(checked_broadcast(anchors), "h").select("doc", (F.col("place") - F.col("at")).alias("start"), "span").distinct()
    laid = staged(laid, "laid")
    # Few documents hold a window: only their shingles are made again.
    holding = staged(laid.select("doc").distinct(), "holding")
    again = with_shingles(texts.join(checked_broadcast(holding), "doc", "left_semi"), "text", size).drop("text")
    windows = again.join(checked_broadcast(laid), "doc")
    first, last = F.greatest("start", F.lit(0)), F.least(F.col("start") + F.col("span"), F.col("n_words"))
    windows = windows.select("doc", "start", "span", (last - first).alias("n_words"), F.slice("shingles", first + 1, F.greatest(last - first - size + 1, F.lit(0))).alias("shingles"))
    windows = staged(with_fingerprint(windows.where(F.col("n_words") >= size)), "windows")

    # Fingerprints within the radius, and within reach.
    left = windows.select("doc", "start", "span", "n_words", "fp", "fp2", F.explode(blocks()).alias("key"))
    right = staged(known.select("item", F.col("n_words").alias("span"), "fp", "fp2").select("item", F.explode(blocks(radius // BLOCKS)).alias("key")), "index")
    prints = known.select("item", F.col("fp").alias("fp_item"), F.col("fp2").alias("fp2_item"))
    near = left.join(checked_broadcast(right), "key").join(checked_broadcast(prints), "item").where(differing("", "_item") <= max(radius, reach))
    near = staged(near.select("doc", "start", "span", "n_words", "item").distinct(), "near")

    # The shingles themselves.
    def counted(df: DataFrame, keys: list[str], n: str) -> DataFrame:
        return df.select(*keys, F.explode("shingles").alias("h")).groupBy(*keys, "h").agg(F.count("*").alias(n))

    keys = ["doc", "start", "span", "n_words"]
    windows = windows.join(near.select(*keys).distinct(), keys, "left_semi")
    sizes = windows.select(*keys, F.size("shingles").alias("n_window")).distinct()
    item_sizes = known.select("item", F.size("shingles").alias("n_item")).distinct()
    mine = near.join(counted(windows, keys, "c"), keys)
    common = mine.join(counted(known, ["item"], "d"), ["item", "h"]).groupBy(*keys, "item").agg(F.sum(F.least("c", "d")).alias("common"))
    scored = common.join(sizes, keys).join(item_sizes, "item").withColumn("similarity", F.col("common") / (F.col("n_window") + F.col("n_item") - F.col("common")))
    best = scored.where(F.col("similarity") >= similarity).groupBy("doc", "item").agg(F.max(F.struct("similarity", -F.col("start"), "n_words")).alias("b"))
    return best.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), F.greatest(-F.col("b.col2"), F.lit(0)).alias("start"), F.col("b.n_words").alias("n_words"), F.col("b.similarity").alias("similarity"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without the documents that hold an item; columns and other rows, those with a null id too, stay as they are.

    See find_passages() for when a document holds one. Of rows that repeat an id all stay or all go.
    """
    found = staged(find_passages(docs, items, id_col=id_col, **options).select(id_col).distinct(), "contaminated")
    return docs.join(checked_broadcast(found), id_col, "left_anti").select(*docs.columns)
