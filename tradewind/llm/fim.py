"""Fill-in-the-middle: documents cut between units (runs of letters, other characters) and put in another order.

Units are found eight bytes at a time: a batch's UTF-8 is one array of 64-bit words, in which the last byte of each unit
is marked by arithmetic on whole words. Counts of marks by word, added up, tell a document's units and the word that
holds the k-th mark; clearing the lowest marks of that word tells its byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bound_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

U = np.uint64
_HIGH, _LOW7 = U(0x8080808080808080), U(0x7F7F7F7F7F7F7F7F)
_ONES = ~U(0)


def _each(byte: int) -> U:
    return U(byte * 0x0101010101010101)


def _next(marks: np.ndarray) -> np.ndarray:
    """marks, each moved to the byte before."""
    out = marks >> U(8)
    out[:-1] |= marks[1:] << U(56)
    return out


def marks(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ends, begins) of UTF-8 in little-endian words: the high bits of bytes that end a unit, and that begin a character."""
    low = (words | _each(0x20)) & _LOW7
    letter = (low + _each(0x80 - ord("a"))) & ~(low + _each(0x80 - ord("z") - 1)) & ~words & _HIGH
    begins = ~(words & ~(words << U(1))) & _HIGH
    # The word after the last one counts as zeros, that is as characters that are no letters.
    after, letters = _next(begins), _next(letter)
    after[-1] |= U(1 << 63)
    return after & ~(letter & letters), begins


class Marked:
    """Rank and select of marked bytes."""

    def __init__(self, words: np.ndarray):
        self.words, counts = words, np.bitwise_count(words)
        self.before = np.zeros(len(words) + 1, np.int64)
        np.cumsum(counts, out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many marks stand before each byte."""
        word, byte = at >> 3, (at & 7).astype(U)
        inside = np.where(byte > 0, self.words[np.minimum(word, len(self.words) - 1)] & (_ONES >> (U(64) - U(8) * np.maximum(byte, U(1)))), U(0))
        return self.before[word] + np.bitwise_count(inside)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The byte of the k-th mark, counted from 1."""
        word = np.searchsorted(self.before, k, side="left") - 1
        left, skip = self.words[word], k - self.before[word] - 1
        for _ in range(7):
            left = np.where(skip > 0, left & (left - U(1)), left)
            skip = skip - 1
        return word * 8 + (np.bitwise_count((left & (~left + U(1))) - U(1)) >> 3)


def cut_places(data: np.ndarray, offsets: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, places, chars) of texts that stand one after the other in UTF-8 bytes, from offsets[i] to offsets[i + 1].

    n: units of each text. draws has two numbers a text, which modulo n + 1 tell after how many units to cut; places are
    the two bytes to cut at, in order, counted from the text's start, and chars the characters before them.
    """
    words = np.zeros(max((len(data) + 7) // 8, 1), "<u8")
    words.view(np.uint8)[: len(data)] = data
    ends, begins = marks(words)
    last = offsets[1:][offsets[1:] > offsets[:-1]] - 1  # a text's last byte ends a unit, whatever the next text begins with
    np.bitwise_or.at(ends, last >> 3, U(0x80) << (U(8) * (last & 7).astype(U)))
    ends, begins = Marked(ends), Marked(begins)
    start, stop = ends.rank(offsets[:-1]), ends.rank(offsets[1:])
    n = stop - start
    k = np.sort(draws % (n + 1)[:, None], axis=1)
    places = np.where(k > 0, ends.select(np.maximum(start[:, None] + k, 1)) + 1, offsets[:-1, None])
    return n, places - offsets[:-1, None], begins.rank(places) - begins.rank(offsets[:-1])[:, None]


def draws(id_col: str, seed: int, count: int = 4) -> list[Column]:
    """Numbers below 2**32 that follow from an id and a seed; a null id counts as empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(count)]


def fill_in_middle(docs: DataFrame, seed: int = 1, plain: int = 10, spm: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n, form, prefix_chars, middle_chars, output) of every row.

    n counts the text's units, which are runs of ASCII letters and single other characters. The id and the seed draw
    two cuts between units, the form `plain` for so many of a hundred texts, and of the others `spm` for so many of a
    hundred and `psm` for the rest. psm puts <P> prefix <S> suffix <M> middle, spm <S> suffix <P> prefix <M> middle,
    plain the text as it is, and without numbers of characters; empty texts and those that hold one of the three signs
    are plain. Null texts count as empty, a null id as empty text; rows that repeat an id draw the same numbers. An
    empty table gives an empty result; texts have no bound of length; further columns are not read. restore() is the
    way back.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    h = draws(id_col, seed)
    held = F.greatest(*(text.contains(s) for s in (PREFIX, SUFFIX, MIDDLE)))
    form = F.when((text == "") | held | (h[2] % 100 >= 100 - plain), "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    drawn = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), form.alias("form"), h[0].alias("h1"), h[1].alias("h2"))
    kind = drawn.schema["_id"].dataType.simpleString()
    signs = [s.encode() for s in (PREFIX, SUFFIX, MIDDLE)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, s, m = signs
        for b in batches:
            if not b.num_rows:
                continue
            texts = b.column(1).cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + b.num_rows + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
            n, places, chars = cut_places(data, offsets, np.column_stack([b.column(3).to_numpy(), b.column(4).to_numpy()]))
            forms, out = b.column(2).to_pylist(), []
            for i, (form, (x, y)) in enumerate(zip(forms, places.tolist(), strict=True)):
                whole = data[offsets[i] : offsets[i + 1]].tobytes()
                a, mid, z = whole[:x], whole[x:y], whole[y:]
                out.append(whole if form == "plain" else b"".join((p, a, s, z, m, mid) if form == "psm" else (s, z, p, a, m, mid)))
            off = np.array([f == "plain" for f in forms])
            columns = [b.column(0), pa.array(n, pa.int64()), b.column(2), *(pa.array(c.astype(np.int64), mask=off) for c in (chars[:, 0], chars[:, 1] - chars[:, 0])), pa.array(out, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = bound_batches(drawn).mapInArrow(cut, f"_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return rows.withColumnRenamed("_id", id_col)


def restore(output: Column, form: Column) -> Column:
    """The text that fill_in_middle() made an output of."""

    def between(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(len(first) + 1))
        x = F.substring_index(body, second, 1)
        rest = F.substr(body, F.length(x) + len(second) + 1)
        y = F.substring_index(rest, MIDDLE, 1)
        return x, y, F.substr(rest, F.length(y) + len(MIDDLE) + 1)

    a, z, mid = between(PREFIX, SUFFIX)
    z2, a2, mid2 = between(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(a, mid, z)).when(form == "spm", F.concat(a2, mid2, z2)).otherwise(output)
