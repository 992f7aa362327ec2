import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tradewind.llm import packing as P
from tradewind.llm.queries import TOKENIZER, op9_packing

TEXTS = [None, "", " ", "Hello, World's 12 o'clock!!", "ÀÉÎ ß ŉ İstanbul ΟΔΟΣ x", "a b\x1cc\u2003d\x85e", "e\u0301 \u0301x", "日本語 текст <|endoftext|>x", "\n\n a", "don't'll", "word " * 50_000, "🙂🙂 a‍b"]


def ids_of(text):
    return Tokenizer.from_file(TOKENIZER).encode(text or "", add_special_tokens=False).ids + [1]


def test_pieces_hold_each_id_once(spark):
    df = spark.createDataFrame([(i, t, 3, "x") for i, t in enumerate(TEXTS)] + [(None, "a b", 1, "y"), (3, "dup", 1, "y"), (3, "dup", 1, "y")], "doc_id long, text string, length int, ids string")
    rows = P.tokenize(df, TOKENIZER).collect()
    assert rows[0].__fields__ == ["doc_id", "start", "length", "doc_tokens", "ids"]
    for i, t in enumerate(TEXTS):
        if i == 3:
            continue
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        want = ids_of(t)
        assert list(itertools.chain.from_iterable(np.frombuffer(r.ids, "<u4").tolist() for r in mine)) == want
        assert [(r.start, r.length, r.doc_tokens) for r in mine] == [(a, min(2048, len(want) - a), len(want)) for a in range(0, len(want), 2048)]
    assert sum(r.doc_id == 3 for r in rows) == 3 and sum(r.doc_id is None for r in rows) == 1
    packed = P.pack(P.tokenize(df, TOKENIZER)).collect()
    assert len(packed) == len(rows)
    assert P.pack(P.tokenize(df.limit(0), TOKENIZER)).collect() == []


def test_other_tokenizers(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame([(1, "Two  spaces\nand more")], "doc_id long, text string")
    got = P.tokenize(df, path).first()
    assert np.frombuffer(got.ids, "<u4").tolist() == Tokenizer.from_file(path).encode("Two  spaces\nand more", add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("seed", range(20))
def test_closest_fill_is_the_best_there_is(seed):
    rng = random.Random(seed)
    items = [rng.randint(1, 40) for _ in range(rng.randint(1, 12))]
    capacity = rng.randint(1, 120)
    taken = P.closest_fill({n: items.count(n) for n in items}, capacity)
    best = max(s for k in range(len(items) + 1) for c in itertools.combinations(items, k) if (s := sum(c)) <= capacity)
    assert sum(n * c for n, c in taken.items()) == best
    assert all(c <= items.count(n) for n, c in taken.items())


def test_query(spark):
    rows = op9_packing(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: ids_of(r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert sum(r.length for r in rows) == sum(map(len, docs.values()))
    filled = {}
    for r in rows:
        part = docs[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(docs[r.doc_id])
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    padded = 0
    for parts in filled.values():
        ends = [0, *itertools.accumulate(n for _, n in sorted(parts))]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 2048
        padded += 2048 - ends[-1] if ends[-1] & (ends[-1] - 1) else 0
    assert padded <= 2048 * 2


def test_columns_that_clash(spark):
    df = spark.createDataFrame([(1, 5, "x", 9, 2), (2, 2048, "y", 9, 3), (3, 7, "z", 9, 4)], "doc_id long, length long, Sequence_ID string, offset int, _group int")
    packed = P.pack(df)
    assert packed.columns == ["doc_id", "length", "sequence_id", "offset"]
    assert sorted((r.doc_id, r.length) for r in packed.collect()) == [(1, 5), (2, 2048), (3, 7)]
    assert P.pack(df.limit(0)).collect() == []
