"""Removal of repeated byte strings by bucket-pointer refinement.

A suffix array groups positions whose texts begin alike. Here positions fall into buckets by a q-gram first, and
buckets are refined by the bucket identifiers at later offsets: positions of one bucket whose identifiers 32 bytes on
agree too are in one bucket of 64 bytes, and those of that whose own and later identifiers of 64 bytes agree are in
one of the wanted length. The identifiers of a round are used again in the next one, so each round costs one lookup.

1. Every string of `length` bytes names the q-gram in it whose hash is smallest as its anchor; equal strings have
   equal anchors at equal places. Positions with one anchor follow one another, so an anchor stands for a run of
   them. Anchors with equal q-grams make the initial buckets.
2. A bucket is refined by the identifiers of the run's first and last string, which overlap and cover all its text.
   In a refined bucket all runs are equal, so all but the earliest are repeats, and the earliest stands for them.
3. What is left of a bucket is refined by the identifiers of the half windows before and after the q-gram: a string
   that two runs share holds one of these halves, so runs alone with both halves are done.
4. The rest is refined by each position's own identifier; all but the earliest of such a bucket are repeats.

Bucket identifiers are 64-bit hashes, as ranks would need all positions to be sorted in each round; strings are equal
if they agree in that of their anchor and in their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bound_batches, checked_broadcast, staged

GRAM = 32
#: Starts of strings that are worked on at a time, which bounds the memory that a long text takes.
BLOCK = 1 << 18

_BASE = 0x5851F42D4C957F2D
_MIX = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    if n not in _powers:
        with np.errstate(over="ignore"):
            _powers[n] = tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, b, np.uint64))]) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    return _powers[n]


class Hashed:
    """Hashes of any stretch of some bytes, by sums of powers."""

    def __init__(self, data: np.ndarray, most: int):
        up, self.down = _power_tables(most)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[end] - self.sums[start]) * self.down[start]
        x = (x ^ (x >> np.uint64(31))) * _MIX
        return x ^ (x >> np.uint64(29))


def _refined(names: np.ndarray, offset: int) -> np.ndarray:
    """Bucket identifiers of stretches that are `offset` longer: of a position's identifier and that at the later offset."""
    x = names[: len(names) - offset] * _MIX + (names[offset:] ^ (names[offset:] >> np.uint64(32))) * np.uint64(_BASE)
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def _mixed(*parts: np.ndarray) -> np.ndarray:
    out = parts[0]
    for x in parts[1:]:
        out = (out * _MIX) ^ ((x.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE))
        out = out ^ (out >> np.uint64(31))
    return out


class Names:
    """The bucket identifiers of all positions of some bytes: grams, of GRAM bytes; twice, of 2 * GRAM; strings, of `length`."""

    def __init__(self, data: np.ndarray, length: int, most: int):
        at = np.arange(len(data) - GRAM + 1)
        self.size = len(data)
        self.grams = Hashed(data, most).of(at, at + GRAM)
        names, n = self.grams, GRAM
        self.twice = _refined(names, GRAM) if self.size >= 2 * GRAM else np.zeros(0, np.uint64)
        while 2 * n <= length:
            names, n = (self.twice if n == GRAM else _refined(names, n)), 2 * n
        self.strings = _refined(names, length - n) if length > n else names

    def halves(self, p: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers of the GRAM + half bytes from p on, and of the half bytes before p with the q-gram; a bucket of their own where the text ends."""
        out = []
        for start, own in ((p, np.uint64(1)), (p - half, np.uint64(2))):
            fits = (start >= 0) & (start + GRAM + half <= self.size)
            q = np.where(fits, start, 0)
            # Pieces of GRAM bytes, the last one as far on as the stretch goes, cover it.
            cover = [*range(0, half, GRAM), half]
            name = _mixed(*(self.grams[np.minimum(q + k, len(self.grams) - 1)] for k in cover))
            out.append(np.where(fits, name, self.grams[p] ^ own))
        return out[0], out[1]


def _blocks(data: bytes, length: int) -> Iterator[tuple[int, int, int, Names]]:
    """For each block of starts: where it begins, its number of starts, how far it lies in its named bytes, and these."""
    raw, half = np.frombuffer(data, np.uint8), length - GRAM
    for a in range(0, len(raw) - length + 1, BLOCK):
        n, first = min(BLOCK, len(raw) - length + 1 - a), max(a - half, 0)
        yield a, n, a - first, Names(raw[first : a + n + length + half], length, BLOCK + length + 2 * half)


def runs(data: bytes, length: int) -> list[np.ndarray]:
    """Arrays of (bucket, whole, right, left, start, end): for each anchor, the identifiers of its q-gram, of its run's text and of the halves, and the run of starts."""
    out: list[list[np.ndarray]] = []
    half, reach = (length - GRAM) // 2, length - GRAM + 1
    for a, n, off, h in _blocks(data, length):
        grams = h.grams[off : off + n + reach - 1]
        bits = np.uint64(21)
        key = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
        w = 1
        while 2 * w <= reach:
            key = np.minimum(key[:-w], key[w:])
            w *= 2
        if reach > w:
            key = np.minimum(key[: -(reach - w)], key[reach - w :])
        anchor = (key & np.uint64((1 << 21) - 1)).astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        end = np.append(begin[1:], n)
        p, lo, hi = anchor[begin] + off, begin + off, end - 1 + off
        whole = _mixed(h.strings[lo], h.strings[hi], p - lo, hi - lo)
        right, left = h.halves(p, half)
        out.append([grams[anchor[begin]], whole, right, left, begin + a, end + a])
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else []


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, copy, text): copy is 0, or for null ids and ids of several texts a hash of the text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    several = rows.groupBy("doc").agg(F.min(F.xxhash64("text")).alias("x"), F.max(F.xxhash64("text")).alias("y")).where("x <> y")
    rows = rows.join(checked_broadcast(staged(several.select("doc", F.lit(True).alias("several")), "several")), "doc", "left")
    copy = F.when(F.col("doc").isNull() | F.coalesce("several", F.lit(False)), F.xxhash64("text")).otherwise(F.lit(0))
    return rows.select(F.coalesce("doc", F.lit(-(1 << 63))).alias("doc"), F.col("doc").isNull().alias("unnamed"), copy.alias("copy"), "text")


def repeated_spans(keyed: DataFrame, length: int) -> DataFrame:
    """(doc, copy, spans): the merged stretches of documents that earlier strings of `length` bytes repeat."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, len(b), 64):
                part, columns = b.slice(k, 64), []
                for doc, copy, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                    if x := runs(text.as_py().encode(), length):
                        n = len(x[0])
                        columns.append([np.full(n, doc), np.full(n, copy), *(y.view(np.int64) for y in x[:2]), *((y >> np.uint64(32)).astype(np.uint32).view(np.int32) for y in x[2:4]), *(y.astype(np.int32) for y in x[4:])])
                if columns:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*columns, strict=True)], ["doc", "copy", "bucket", "whole", "after", "before", "start", "end"])

    anchors = bound_batches(keyed).select("doc", "copy", "text").mapInArrow(find, "doc long, copy long, bucket long, whole long, after int, before int, start int, end int")
    order = ["doc", "copy", "start"]
    bucket, whole = Window.partitionBy("bucket"), Window.partitionBy("bucket", "whole")
    dealt = anchors.repartition("bucket").withColumns({"mixed": F.min("whole").over(bucket) < F.max("whole").over(bucket), "at": F.dense_rank().over(whole.orderBy(*order))})
    dealt = staged(dealt.where("at > 1 or mixed").drop("mixed"), "runs")
    equal = dealt.where("at > 1").select("doc", "copy", "start", (F.col("end") - 1 + length).alias("end"))

    firsts = dealt.where("at = 1")
    by_half = {f"n_{c}": F.count("*").over(Window.partitionBy("bucket", c)) for c in ("after", "before")}
    rest = firsts.withColumns(by_half).where("n_after > 1 or n_before > 1")
    lists = staged(rest.groupBy("doc", "copy").agg(F.collect_list(F.struct("bucket", "start", "end")).alias("runs")), "open")

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, copy, text, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                table = own.values
                name, start, end = (np.asarray(table.field(c)) for c in ("bucket", "start", "end"))
                n = (end - start).astype(np.int64)
                at = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
                name = np.repeat(name, n)
                for a, size, off, h in _blocks(text.as_py().encode(), length):
                    mine = (at >= a) & (at < a + size)
                    s = at[mine] - a + off
                    if len(s):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), doc)), pa.array(np.full(len(s), copy)), pa.array(name[mine]), pa.array(h.strings[s].view(np.int64)), pa.array(at[mine].astype(np.int32))], ["doc", "copy", "bucket", "string", "start"])

    each = keyed.select("doc", "copy", "text").join(checked_broadcast(lists), ["doc", "copy"]).mapInArrow(strings, "doc long, copy long, bucket long, string long, start int")
    place = F.dense_rank().over(Window.partitionBy("bucket", "string").orderBy(*order))
    again = each.withColumn("at", place).where("at > 1").select("doc", "copy", "start", (F.col("start") + length).alias("end"))
    spans = equal.union(again).groupBy("doc", "copy").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return staged(spans.select("doc", "copy", _merged("spans")), "spans")


def _merged(name: str) -> Column:
    """Sorted spans with those that meet made one."""
    sql = f"""aggregate(array_sort({name}), named_struct('done', cast(array() as array<struct<start:int,end:int>>), 'a', cast(-1 as int), 'b', cast(-1 as int)),
        (acc, x) -> if(x.start <= acc.b, named_struct('done', acc.done, 'a', acc.a, 'b', greatest(acc.b, x.end)),
            named_struct('done', if(acc.a < 0, acc.done, array_append(acc.done, named_struct('start', acc.a, 'end', acc.b))), 'a', x.start, 'b', x.end)),
        acc -> array_append(acc.done, named_struct('start', acc.a, 'end', acc.b))) as spans"""
    return F.expr(sql)


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, spans, kept) of every row: the UTF-8 text's size, the stretches (start, end) of bytes to remove, what is left.

    A byte goes if a string of `length` bytes covers it that also starts earlier: in a document of a smaller id, or
    further before in the same one. Strings are judged on the input and never cross documents. Null ids come first,
    those and texts that share an id in the order of a hash of their texts; rows alike in id and text count as one
    document, and get the same result. Null texts count as empty; an empty table gives an empty result; further
    columns are not read. kept is binary, as a cut may fall inside a character.
    """
    keyed = _keyed(docs, id_col, text_col)
    found = repeated_spans(keyed, length)
    rows = keyed.join(checked_broadcast(found), ["doc", "copy"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, sizes = [], []
            for text, spans in zip(b.column(2), b.column(3).to_pylist(), strict=True):
                data, at, parts = text.as_py().encode(), 0, []
                for s in spans or []:
                    parts.append(data[at : s["start"]])
                    at = s["end"]
                kept.append(b"".join([*parts, data[at:]]))
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), b.column(3), pa.array(kept, pa.binary())], ["doc", "unnamed", "n_bytes", "spans", "kept"])

    kind = "array<struct<start:int,end:int>>"
    out = rows.select("doc", "unnamed", "text", "spans").mapInArrow(cut, f"doc long, unnamed boolean, n_bytes long, spans {kind}, kept binary")
    return out.select(F.when(~F.col("unnamed"), F.col("doc")).alias(id_col), "n_bytes", F.coalesce("spans", F.array().cast(kind)).alias("spans"), "kept")

