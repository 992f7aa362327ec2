"""Packing of tokenized documents into sequences of one length by minimum bin slack.

Documents are cut at multiples of the capacity; full pieces are sequences of their own. What is left of each
document is dealt at random into groups of bounded size. In a group each sequence takes the longest piece that is
left and the multiset of other lengths that comes closest to the capacity: a bitset holds which sums the lengths
can make, and the counts are found by going back through its states.
"""

from __future__ import annotations

import bisect
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bound_batches, released, text_or_empty

#: Pieces to a group, on average.
GROUP = 4096
#: Texts tokenized at a time.
TEXTS = 512
#: Bytes of text tokenized at a time, about.
BLOCK = 1 << 18
#: Slots of a worker's table of words, as a power of two; at two thirds of them it starts anew.
SLOTS = 21
#: Bytes of the longest word that is hashed with the others; longer ones are hashed alone.
LONGEST = 256

# What a byte of a lower-cased UTF-8 text is: white space, a part of a letter, a digit, another sign, or a reason
# to leave the whole word to the tokenizer (an apostrophe, or a character beyond the letters of Latin-1).
SPACE, LETTER, DIGIT, SIGN, OTHER = range(5)
_KINDS = np.full(256, SIGN, np.uint8)
_KINDS[list(b" \t\n\x0b\x0c\r")] = SPACE
_KINDS[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = LETTER
_KINDS[list(b"0123456789")] = DIGIT
_KINDS[0x80:0xC0] = LETTER
_KINDS[0xC0:] = OTHER
_KINDS[0xC3] = LETTER
_KINDS[[0x27, 0x97, 0xB7]] = OTHER  # the apostrophe; the signs for times and divided by

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _powers(base: int) -> np.ndarray:
    return np.array([pow(base, k, 1 << 64) for k in range(1, LONGEST + 1)], np.uint64)


_POWERS = _powers(0x5851F42D4C957F2D), _powers(0xD6E8FEB86659FD93)


class WordTable:
    """Token ids of words by two 64-bit hashes of each word, with open addressing; all steps work on arrays."""

    def __init__(self, slots: int = SLOTS):
        self.shift, self.mask = np.uint64(64 - slots), (1 << slots) - 1
        self.clear()

    def clear(self) -> None:
        n = self.mask + 1
        self.keys, self.values = np.zeros((2, n), np.uint64), np.full(n, -1, np.int32)
        self.size, self.begins, self.lengths = 0, np.zeros(n, np.int64), np.zeros(n, np.int32)
        self.pool, self.filled = np.zeros(n, np.uint32), 0

    def full(self, more: int) -> bool:
        return self.size + more > self.mask * 2 // 3

    def find(self, h: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The number of each word, -1 for those that are not there."""
        out, todo = np.full(len(h[0]), -1, np.int32), np.arange(len(h[0]))
        slot = ((h[0] * _MIX) >> self.shift).astype(np.int64)
        while len(todo):
            there = self.values[slot]
            hit = (self.keys[0][slot] == h[0][todo]) & (self.keys[1][slot] == h[1][todo]) & (there >= 0)
            out[todo[hit]] = there[hit]
            on = ~hit & (there >= 0)
            todo, slot = todo[on], (slot[on] + 1) & self.mask
        return out

    def add(self, h: tuple[np.ndarray, np.ndarray], ids: list[bytes]) -> None:
        """Adds words that are not there and differ in their first hash."""
        new = np.frombuffer(b"".join(ids), np.uint32)
        while self.filled + len(new) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.filled : self.filled + len(new)] = new
        lengths = np.array([len(x) // 4 for x in ids], np.int32)
        numbers = np.arange(self.size, self.size + len(ids), dtype=np.int32)
        self.begins[numbers], self.lengths[numbers] = self.filled + np.cumsum(lengths) - lengths, lengths
        self.size, self.filled = self.size + len(ids), self.filled + len(new)
        todo, slot = np.arange(len(ids)), ((h[0] * _MIX) >> self.shift).astype(np.int64)
        while len(todo):
            free = self.values[slot] < 0
            self.values[slot[free]] = numbers[todo[free]]
            won = self.values[slot] == numbers[todo]
            self.keys[0][slot[won]], self.keys[1][slot[won]] = h[0][todo[won]], h[1][todo[won]]
            todo, slot = todo[~won], (slot[~won] + 1) & self.mask

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some words in order, and where each word's end."""
        lengths = self.lengths[numbers].astype(np.int64)
        ends = np.cumsum(lengths)
        return self.pool[np.repeat(self.begins[numbers] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)], ends


def _cut(text: str) -> list[bytes]:
    """A text's bytes, lower-cased where that surely changes no id, in parts of about BLOCK bytes cut at white space."""
    if "<|" not in text:
        try:
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            pass
    data, out = text.encode(), []
    while len(data) > BLOCK:
        at = max(data.rfind(b" ", 0, BLOCK), data.rfind(b"\n", 0, BLOCK)) + 1 or (data.find(b" ", BLOCK) + 1 or len(data))
        out.append(data[:at])
        data = data[at:]
    return [*out, data]


class WordEncoder:
    """Token ids of texts, by a tokenizer file; ids of words are kept, as words come again and again.

    That needs a tokenizer which drops white space and splits the rest into letters, single digits and other signs
    after lower-casing (as those with word ends do); with other tokenizers whole texts are encoded.
    """

    # Fixed value: the split that the byte kinds above agree with.
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole, self.table = Tokenizer.from_file(path), WordTable()
        spec = json.loads(self.whole.to_str())
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        split = next((x for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if x["type"] == "Split"), None)
        self.by_word = steps == ["NFC", "Replace", "Lowercase"] and split is not None and split["pattern"] == {"Regex": self.SPLIT} and split["invert"] and split["behavior"] == "Removed"
        if self.by_word:
            self.part = Tokenizer.from_file(path)
            self.part.normalizer = normalizers.Sequence([])
            self.part.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.whole.encode_batch(texts, add_special_tokens=False)]

    def _word_ids(self, words: list[str], whole: np.ndarray) -> list[bytes]:
        """The ids of each word; whole: those that the tokenizer has to split."""
        out: list = [b""] * len(words)
        plain, other = np.flatnonzero(~whole).tolist(), np.flatnonzero(whole).tolist()
        if plain:
            found = self.part.encode(" ".join([words[k].lower() for k in plain]), add_special_tokens=False)
            cuts = (4 * np.searchsorted(np.array(found.word_ids), np.arange(len(plain) + 1))).tolist()
            ids = np.array(found.ids, "<u4").tobytes()
            for k, a, b in zip(plain, cuts, cuts[1:], strict=False):
                out[k] = ids[a:b]
        for k, ids in zip(other, self._ids([words[k] for k in other]), strict=True):
            out[k] = ids
        return out

    def _block(self, parts: list[bytes]) -> list[bytes]:
        """The ids of each part."""
        data = b"\n".join([*parts, b""])
        raw = np.frombuffer(data, np.uint8)
        kinds = _KINDS[raw]
        kinds[:-1][(raw[:-1] == ord("<")) & (raw[1:] == ord("|"))] = OTHER
        space = kinds == SPACE
        before = np.concatenate([[np.uint8(SPACE)], kinds[:-1]])
        starts = ~space & (before == SPACE)
        inner = ~space & ~starts & ((kinds != before) | (kinds == DIGIT))
        odd = np.flatnonzero(kinds == OTHER)
        words = np.flatnonzero(starts)
        if len(odd):
            whole = np.zeros(len(words), bool)
            whole[np.searchsorted(words, odd, "right") - 1] = True
            inside = np.flatnonzero(inner)
            inner[inside[whole[np.searchsorted(words, inside, "right") - 1]]] = False
        at = np.flatnonzero(starts | inner)
        if not len(at):
            return [b""] * len(parts)
        whole = whole[np.searchsorted(words, at, "right") - 1] if len(odd) else np.zeros(len(at), bool)
        spans = np.diff(np.append(at, len(raw)))
        place = np.minimum(np.arange(len(raw) - at[0]) - np.repeat(at - at[0], spans), LONGEST - 1)
        values = np.where(space, 0, raw.astype(np.uint64) + np.uint64(1))[at[0] :]
        h = tuple(np.add.reduceat(values * w[place], at - at[0]) for w in _POWERS)
        if spans.max() > LONGEST:
            for k in np.flatnonzero(spans > LONGEST).tolist():
                word = data[at[k] : at[k] + spans[k]].rstrip(b" \t\n\x0b\x0c\r")
                if len(word) > LONGEST:
                    long = xxhash.xxh3_128_intdigest(word)
                    h[0][k], h[1][k] = long & (1 << 64) - 1, long >> 64
        numbers = self.table.find(h)
        while len(missing := np.flatnonzero(numbers < 0)):
            first = missing[np.unique(h[0][missing], return_index=True)[1]]
            if self.table.full(len(first)):
                self.table.clear()
                numbers[:] = -1
                first = np.unique(h[0], return_index=True)[1]
            found = self._word_ids([data[a:b].decode().strip(" \t\n\x0b\x0c\r") for a, b in zip(at[first].tolist(), (at + spans)[first].tolist(), strict=True)], whole[first])
            self.table.add((h[0][first], h[1][first]), found)
            todo = np.flatnonzero(numbers < 0)
            numbers[todo] = self.table.find((h[0][todo], h[1][todo]))
        ids, ends = self.table.ids(numbers)
        lengths = np.cumsum([len(x) + 1 for x in parts])
        cuts = np.concatenate([[0], ends])[np.searchsorted(at, lengths)]
        return [ids[a:b].tobytes() for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        if not self.by_word:
            return self._ids(texts)
        out: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[int, bytes]] = []
        size = 0
        for k, text in enumerate(texts):
            for part in _cut(text):
                waiting.append((k, part))
                size += len(part)
                if size >= BLOCK:
                    self._flush(waiting, out)
                    waiting, size = [], 0
        self._flush(waiting, out)
        return [b"".join(x) for x in out]

    def _flush(self, waiting: list[tuple[int, bytes]], out: list[list[bytes]]) -> None:
        for (k, _), ids in zip(waiting, self._block([x for _, x in waiting]), strict=True):
            out[k].append(ids)


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, start, length, doc_tokens, ids): the pieces of every document, cut at multiples of capacity.

    A document is its text's ids and then end_id, so that an empty or null text has one id. start: ids of the
    document before the piece; ids: little-endian unsigned 32-bit numbers. Null ids and repeated rows are documents
    like others. An empty table gives an empty result; further columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), text_or_empty(text_col).alias("text"))
    end, width = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordEncoder(tokenizer_path)  # of this task alone: workers live on, and would keep its 100 MB through other work
        for x in batches:
            for k in range(0, len(x), TEXTS):
                part = x.slice(k, TEXTS)
                out: list[tuple] = []
                for i, ids in zip(part.column(0).to_pylist(), coder.encode(part.column(1).to_pylist()), strict=True):
                    ids += end
                    out += [(i, a // 4, min(width, len(ids) - a) // 4, len(ids) // 4, ids[a : a + width]) for a in range(0, len(ids), width)]
                kinds = [pa.int64()] * 4 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], [id_col, "start", "length", "doc_tokens", "ids"])

    return bound_batches(rows).mapInArrow(released(run), f"{id_col} long, start long, length long, doc_tokens long, ids binary")


def closest_fill(counts: dict[int, int], capacity: int, order: list[int] | None = None) -> dict[int, int]:
    """How many of each length (of counts at most) to take for the largest sum up to capacity. order: lengths, falling."""
    states, lengths, sums, mask = [], [], 1, (1 << (capacity + 1)) - 1
    order = sorted(counts, reverse=True) if order is None else order
    for length in order[bisect.bisect_left(order, -capacity, key=lambda n: -n) :]:
        if not counts[length]:
            continue
        states.append(sums)
        lengths.append(length)
        left, lot = min(counts[length], capacity // length), 1
        while left:  # lots of 1, 2, 4 ... and the rest make every count
            lot = min(lot, left)
            sums |= sums << (lot * length) & mask
            left, lot = left - lot, lot * 2
        if sums >> capacity & 1:
            break
    at, taken = sums.bit_length() - 1, {}
    for state, length in zip(reversed(states), reversed(lengths), strict=True):
        n = 0
        while not state >> at & 1:
            at, n = at - length, n + 1
        if n:
            taken[length] = n
    return taken


def minimum_bin_slack(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(sequence, offset) of each piece; sequences are numbered from 0."""
    waiting: dict[int, list[int]] = {}
    for k, length in enumerate(lengths):
        waiting.setdefault(length, []).append(k)
    counts = {n: len(x) for n, x in waiting.items()}
    order = sorted(counts, reverse=True)
    places, sequence = [(0, 0)] * len(lengths), 0
    while order:
        longest = order[0]
        counts[longest] -= 1
        taken = closest_fill(counts, capacity - longest, order) if longest < capacity else {}
        counts[longest] += 1
        offset = 0
        for length, n in [(longest, 1), *taken.items()]:
            for _ in range(n):
                places[waiting[length].pop()] = sequence, offset
                offset += length
            counts[length] -= n
        for length in {longest, *taken}:
            if not counts[length]:
                order.remove(length)
        sequence += 1
    return places


def pack(pieces: DataFrame, capacity: int = 2048, spread_by: list[str] | None = None, group: int = GROUP) -> DataFrame:
    """pieces(length, ...) with sequence_id and offset; no sequence is longer than capacity.

    Pieces are spread over groups of about `group` pieces by a hash of the columns spread_by (all of them, if none
    are named); they are counted for that, so they are best a written table. Lengths are from 1 to capacity. Rows
    that are alike in every column go to one group. An empty table gives an empty result. Columns of pieces that have
    the result's names already, or _group, in any case, are left out.
    """
    pieces = pieces.drop(*(c for c in pieces.columns if c.lower() in ("sequence_id", "offset", "_group")))
    n = max(1, math.ceil(pieces.count() / group))
    columns = pieces.columns
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(*(spread_by or columns)), F.lit(n)))
    schema = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes) + ", sequence_id long, offset long"

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.select(columns).sort_by([(c, "ascending") for c in spread_by or columns])
        places = np.array(minimum_bin_slack(rows["length"].to_pylist(), capacity), np.int64).reshape(-1, 2)
        rows = rows.append_column("sequence_id", pa.array((key[0].as_py() << 32) + places[:, 0]))
        return rows.append_column("offset", pa.array(places[:, 1]))

    return dealt.groupBy("_group").applyInArrow(run, schema)
