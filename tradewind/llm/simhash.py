"""Near-duplicates by SimHash and deletion-variant signatures, and near copies by exact shingle similarity.

A fingerprint is cut into so few segments that, within the radius, one segment of two linked fingerprints differs
by at most one bit. Each segment is indexed once for each of its bits, with that bit wiped out: two fingerprints
whose segments differ by at most one bit share such a variant. Equal variants are joined and the pairs verified.

Pairs are not made within whole buckets. First each member of a bucket is held against its smallest id, often the text
that others were copied from, and against one member that a hash draws; members that this already puts into one component need no more comparison. Only pairs of a bucket that
lie in different components then follow, all of them, so no link between components is lost.

Near copies by the similarity of their shingles are first those whose fingerprints link, by deletion variants, and whose
similarity then proves to suffice. The rest, which fingerprints lose, use the same linking, with the first shingles of each
text as keys.
There a pair counts in a bucket only if what both texts have left from that shingle on can still make them as similar
(positional filter), so that texts which merely share a frequent passage make no pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import bound_batches, checked_broadcast, collected, discard, partitions, released, staged

#: Shingles hashed at a time, which bounds the memory that a long text takes.
BLOCK = 1 << 16
#: Texts worked on at a time.
ROWS = 256
#: How many different draws of a bucket's first partner there are.
DRAWS = 8


def _signed(bits: np.ndarray) -> int:
    return int(np.packbits(bits).view(">i8")[0])


def _vote(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits, highest first."""
    votes = np.zeros(64, np.int64)
    for k in range(0, len(hashes), BLOCK):
        part = hashes[k : k + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return votes


def shingles(words: list[bytes], size: int) -> Iterator[bytes]:
    """The space-joined shingles of some words; of fewer words than size, the whole sequence; of none, nothing."""
    if len(words) <= size:
        yield from [b" ".join(words)] * bool(words)
        return
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True):
        yield line[a:b]


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash, as a signed number, of a text's word shingles (repeats count); 0 for a text without words."""
    words = (text or "").encode().lower().split()
    hashes = np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in shingles(words, size)), np.uint64)
    return _signed(2 * _vote(hashes) > len(hashes)) if len(hashes) else 0


def shingle_set(text: str | None, size: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct hashes of a text's word shingles, as signed numbers."""
    words = (text or "").encode().lower().split()
    hashes = np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in shingles(words, size)), np.uint64)
    return np.unique(hashes).view(np.int64)


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most ROWS rows, which bounds what a batch's results take."""
    for x in batches:
        for k in range(0, len(x), ROWS):
            yield x.slice(k, ROWS)


def _per_text(df: DataFrame, id_col: str, text_col: str, f: Callable, name: str, kind: str) -> DataFrame:
    """(id, name) with f of each whole text, in Arrow batches."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    arrow = {"long": pa.int64(), "array<long>": pa.list_(pa.int64())}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in sliced(batches):
            values = pa.array([f(t.as_py()) for t in x.column(1)], arrow)
            yield pa.RecordBatch.from_arrays([x.column(0), values], ["id", name])

    return bound_batches(rows).mapInArrow(released(run), f"id long, {name} {kind}")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, fp): the 64-bit fingerprint of each row. A null text counts as empty; further columns are not read."""
    return _per_text(df, id_col, text_col, lambda t: fingerprint(t, size), "fp", "long")


def deletion_variants(fp: list, segments: list[tuple[int, int, int]]):
    """An array column of bucket keys. segments: (which of the fp columns, lowest bit, number of bits up to 32)."""
    keys = []
    for s, (k, low, bits) in enumerate(segments):
        part = F.shiftrightunsigned(fp[k], low).bitwiseAND(F.lit((1 << bits) - 1))
        for i in range(bits):
            keys.append(part.bitwiseAND(F.lit(((1 << bits) - 1) ^ (1 << i))).bitwiseOR(F.lit((s << 37) | (i << 32))))
    return F.array(*keys)


def segments_for(radius: int, bits: int = 64) -> list[tuple[int, int, int]]:
    """Cuts one fingerprint into radius // 2 + 1 segments, so that one differs by at most one bit."""
    n = radius // 2 + 1
    cuts = [bits * k // n for k in range(n + 1)]
    if max(b - a for a, b in zip(cuts, cuts[1:], strict=False)) > 32:
        cuts = sorted({*cuts, *range(0, bits + 1, 32)})
    return [(0, a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def link_buckets(indexes: list[DataFrame], verify: Callable[[DataFrame], DataFrame], possible: Callable[..., Column] | None = None, known: DataFrame | None = None) -> DataFrame:
    """(node, component) of nodes that indexes(key, id) bring together and that verify() lets pass.

    The indexes share no keys; buckets of one node are left out of each in turn, which bounds the memory.
    verify takes pairs (a, b) and returns those that are linked. Buckets have no limit of size: see the module's text.
    With possible, indexes also have a node's size m and its rest r in the bucket. possible(m, r, m2, r2) is a
    condition on two nodes of a bucket; every linked pair has a bucket in which it holds.
    known: (node, component) of nodes that are linked already; pairs within a component are not verified again.
    """
    kept = []
    for part in indexes:
        shared = part.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
        kept.append(staged(part.join(shared, "key", "left_semi"), "buckets"))
    index = reduce(DataFrame.union, kept)
    if not possible:
        index = index.withColumns({"m": F.lit(0), "r": F.lit(0)})
    allowed = possible or (lambda m, r, m2, r2: F.lit(True))
    fits = allowed(F.col("m"), F.col("r"), F.col("m2"), F.col("r2"))
    draw = F.struct(F.xxhash64("id", F.pmod(F.xxhash64("key"), F.lit(DRAWS))).alias("h"), F.struct("id", "m", "r").alias("rep"))
    first = index.groupBy("key").agg(F.min(draw).alias("d"), F.min(F.struct("id", "m", "r")).alias("least"))
    first = first.select("key", F.inline(F.array_distinct(F.array("d.rep", "least"))).alias("rep", "m2", "r2"))
    pairs = index.join(first, "key").where((F.col("id") != F.col("rep")) & fits)
    pairs = pairs.select(F.greatest("id", "rep").alias("a"), F.least("id", "rep").alias("b")).distinct()
    if known:
        for end in ("a", "b"):
            pairs = pairs.join(known.select(F.col("node").alias(end), F.col("component").alias(f"c{end}")), end, "left")
        pairs = pairs.where("ca is null or cb is null or ca <> cb").select("a", "b")
    pairs = staged(pairs, "pairs")
    linked = verify(pairs)
    if known:
        linked = linked.union(known.where("node <> component"))
    linked = staged(linked, "links")
    found = connected_components(linked)
    # The pairs of a bucket that are in different components, or in none yet. All buckets that they share are open.
    grouped = index.join(found.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "m", "r", F.coalesce("component", "id").alias("component"))
    open_keys = grouped.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
    grouped = staged(grouped.join(open_keys, "key", "left_semi"), "open")
    discard(*kept)
    other = grouped.withColumnsRenamed({"id": "id2", "component": "component2", "m": "m2", "r": "r2"})
    rest = grouped.join(other, "key").where((F.col("component") < F.col("component2")) & fits)
    rest = staged(rest.select(F.greatest("id", "id2").alias("a"), F.least("id", "id2").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti"), "pairs")
    discard(grouped, pairs)
    more = staged(verify(rest), "links")
    components = staged(connected_components(linked.union(more)), "components")
    discard(rest, more, linked)
    return components


def link_fingerprints(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(fp, component): the distinct fingerprints of fps(fp) that others within the radius link; lone ones are left out.

    component is the smallest fingerprint, as a signed number, that can be reached. Null fingerprints are left out,
    repeated ones count once; an empty table gives an empty result; further columns are not read.
    """
    nodes = fps.select("fp").where("fp is not null").distinct()
    # The variants of one fingerprint are many rows; few fingerprints to a task keep their exchange in memory.
    nodes = nodes.repartition(4 * partitions(fps.sparkSession), "fp")
    index = nodes.select(F.explode(deletion_variants([F.col("fp")], segments_for(radius))).alias("key"), F.col("fp").alias("id"))
    found = link_buckets([index], lambda pairs: pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
    return found.select(F.col("node").alias("fp"), "component")


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 2) -> DataFrame:
    """(id, fp, component_id) of every row.

    Fingerprints link at radius or fewer differing bits; component_id is the smallest id that can be reached, the
    row's own included. Null and empty texts have fingerprint 0 and link like others; a null id keeps its row and
    counts for no component's smallest id (a component of such rows alone has a null component_id). Repeated rows
    stay. An empty table gives an empty result.
    """
    fps = staged(fingerprints(df, id_col, text_col, size), "fingerprints")
    least = fps.groupBy("fp").agg(F.min("id").alias("least"))
    linked = link_fingerprints(least, radius)
    named = least.join(linked, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = staged(named.join(ids, "component").select("fp", "component_id"), "named")
    return fps.join(named, "fp").select("id", "fp", "component_id")


# Near copies: similarity of word shingles.

#: The part of the documents whose shingles are counted to find frequent ones, one in so many, and about how many of these
#: are told to the tasks. Both steer the work only: any order of the shingles gives the same pairs.
COUNTED, FREQUENT = 8, 200_000
#: Steps in which the index is built.
PARTS = 4


def prefix_size(n: int, similarity: float) -> int:
    """How many of a set's n elements, first in an order that all sets share, include one of each set as similar."""
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def prefix(s: np.ndarray, frequent: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first elements of a set by rising counts (0 for those not in frequent, which is sorted), then by value."""
    count = np.zeros(len(s), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        count = np.where(frequent[at] == s, counts[at], 0)
    return s[np.lexsort((s, count))[: prefix_size(len(s), similarity)]]


def frequent_shingles(sets: DataFrame, limit: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """(about `limit` of the most frequent hashes in the arrays s of sets, none of which comes once, in order; their counts).

    A histogram of the counts tells which they are, so that no task and not the driver sorts or merges them. Of those that
    tie for the last places a range of hashes is taken. The driver gets them as columns, without an object for each.
    """
    counted = staged(sets.select(F.explode("s").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "frequent")
    least, share, left = 1, 0.0, limit
    for n, many in counted.groupBy("n").count().orderBy(F.desc("n")).collect():  # at most the root of twice the shingles
        if many > left:
            least, share = n, left / many
            break
        left -= many
    cut = int(share * 2**64) - 2**63
    often = collected(counted.where((F.col("n") > least) | ((F.col("n") == least) & (F.col("h") < F.lit(cut)))))
    discard(counted)
    frequent, counts = often["h"].to_numpy(), often["n"].to_numpy()
    order = np.argsort(frequent)
    return frequent[order], counts[order]


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8, radius: int = 2) -> DataFrame:
    """(id, component_id) of the rows whose text other rows copy, exactly or nearly; others are left out.

    Near copies have a Jaccard similarity of at least `similarity` between their sets of word shingles, which is
    verified exactly. Pairs whose fingerprints (of three-word shingles) differ in at most `radius` bits are found by
    deletion variants and verified first. No other such pair is missed, either: of n shingles, in an order that all texts share, two texts as similar
    have one in common among their first n - similarity * n + 1 (prefix filter). Frequent shingles come last in that
    order. component_id is the smallest id of the group. Null and empty texts, and rows without an id, take no part.
    Rows that repeat an id count as one.
    """
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.where(F.col("id").isNotNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]"))

    def sets(rows: DataFrame) -> DataFrame:
        return _per_text(rows, "id", "text", lambda t: shingle_set(t, size), "s", "array<long>")

    frequent, counts = frequent_shingles(sets(texts.where(F.pmod(F.xxhash64("id"), F.lit(COUNTED)) == 0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in sliced(batches):
            found = [shingle_set(t.as_py(), size) for t in x.column(1)]
            firsts = pa.array([prefix(s, frequent, counts, similarity) for s in found], pa.list_(pa.int64()))
            marks = pa.array([fingerprint(t.as_py()) for t in x.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(2), pa.array([len(s) for s in found], pa.int32()), firsts, marks], ["id", "sha", "m", "p", "fp"])

    hashed = texts.withColumn("sha", F.unhex(F.sha2("text", 256)))
    rows = staged(bound_batches(hashed).mapInArrow(released(run), "id long, sha binary, m int, p array<long>, fp long"), "prefixes")
    named = staged(rows.groupBy("sha").agg(F.min("id").alias("node"), F.count("*").alias("n")), "classes")
    # Texts of one class are equal; a repeated id may stand for two of them.
    nodes = rows.withColumnRenamed("id", "node").join(named, ["sha", "node"], "left_semi").dropDuplicates(["node"])
    nodes = staged(nodes.select("node", "m", "p", "fp"), "nodes")
    keys = nodes.select("node", "m", F.posexplode("p").alias("place", "key")).select("key", F.col("node").alias("id"), "m", (F.col("m") - F.col("place")).alias("r"))
    index = [keys.where(F.pmod("key", F.lit(PARTS)) == k) for k in range(PARTS)]

    def least(m: Column, m2: Column) -> Column:
        """Shingles that two texts as similar share at least."""
        return F.lit(similarity / (1 + similarity)) * (m + m2) - F.lit(1e-6)

    def possible(m: Column, r: Column, m2: Column, r2: Column) -> Column:
        """Positional filter: at the first shingle that two texts share, all that they share is still to come in both."""
        return F.least(r, r2) >= least(m, m2)

    def may_be_close(m: Column, m2: Column, shared: Column) -> Column:
        """Of two texts, the one whose prefix ends first in the order shares with the other no more than what both prefixes share and its rest."""
        rest = lambda n: F.ceil(F.lit(similarity) * n - F.lit(1e-9)) - 1
        return shared + F.greatest(rest(m), rest(m2)) >= least(m, m2)

    def of(table: DataFrame, end: str) -> DataFrame:
        return table.select(*(F.col(c).alias(end if c in ("id", "node") else c + end) for c in table.columns))

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.join(of(nodes.drop("fp"), "a"), "a").join(of(nodes.drop("fp"), "b"), "b")
        close = staged(both.where(may_be_close(F.col("ma"), F.col("mb"), F.size(F.array_intersect("pa", "pb")))).select("a", "b"), "close")
        wanted = staged(close.select(F.col("a").alias("id")).union(close.select("b")).distinct(), "wanted")
        full = staged(sets(texts.join(checked_broadcast(wanted), "id", "left_semi")).dropDuplicates(["id"]), "shingles")
        both = close.join(of(full, "a"), "a").join(of(full, "b"), "b")
        common = F.size(F.array_intersect("sa", "sb"))
        return both.where(common >= F.lit(similarity) * (F.size("sa") + F.size("sb") - common)).select("a", "b")

    def verify_marks(pairs: DataFrame) -> DataFrame:
        marks = nodes.select("node", "fp")
        both = pairs.join(of(marks, "a"), "a").join(of(marks, "b"), "b")
        return verify(both.where(F.bit_count(F.col("fpa").bitwiseXOR(F.col("fpb"))) <= radius).select("a", "b"))

    marked = nodes.select("node", "fp").repartition(4 * partitions(df.sparkSession), "node")
    marked = marked.select(F.explode(deletion_variants([F.col("fp")], segments_for(radius))).alias("key"), F.col("node").alias("id"))
    known = link_buckets([marked], verify_marks)
    linked = link_buckets(index, verify, possible, known).withColumnRenamed("component", "linked")
    named = named.join(linked, "node", "left").where("n > 1 or linked is not null").select("sha", F.coalesce("linked", "node").alias("component_id"))
    return rows.select("id", "sha").join(named, "sha").select("id", "component_id")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """df without the rows whose group of near copies holds a smaller id; columns and other rows stay as they are.

    Rows without an id and texts without words stay; of rows that repeat an id all stay or all go. See
    near_duplicates() for what a group is.
    """
    losers = near_duplicates(df, id_col, text_col, size, similarity).where("id > component_id").select(F.col("id").alias(id_col)).distinct()
    return df.join(checked_broadcast(staged(losers, "losers")), id_col, "left_anti").select(*df.columns)
