import hashlib
import random

import numpy as np
import pytest

from tradewind.llm import suffix_dedup as S
from tradewind.llm.queries import op2_suffix_dedup


def brute(docs, length=100):
    """(doc, n_bytes, n_removed, n_spans, sha) of documents in their order."""
    seen, out = set(), {}
    for i, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            x = data[s : s + length]
            if x in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(x)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def rows(found):
    return {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in found.collect()}


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r.doc_id: tuple(r)[1:] for r in op2_suffix_dedup(spark, sf).collect()}
    want = brute(docs)
    assert got == want and sum(x[1] for x in want.values()) > 1000


@pytest.mark.parametrize("block", [64, 1 << 18])
def test_periodic_and_edited_texts(spark, block, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", block)
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    base = word(700)
    docs = [base, "a" * 400, "ab" * 300, base[200:500] + word(50) + base[100:199], word(30) + base[300:401] + "z", base, "a" * 99, "a" * 100, "xyz" * 90 + base[:150]]
    for _ in range(12):
        t = list(base)
        for _ in range(4):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        docs.append("".join(t))
    docs = list(enumerate(docs))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(S.remove_repeats(df)) == brute(docs)


def test_odd_rows(spark):
    text, lone = (hashlib.sha512(bytes([k])).hexdigest() * 3 for k in (1, 2))
    text, lone = text[:90] + lone[:30] + text[3:120] + "-" * 63, hashlib.sha512(b"3").hexdigest() + "."
    docs = [(None, text), (1, None), (2, ""), (3, text), (3, text), (4, text[50:] + "q"), (4, "other"), (5, "x" * 600_000), (6, lone), (6, lone)]
    df = spark.createDataFrame([(*r, "c", 1) for r in docs], "doc_id long, text string, doc string, copy int")
    got = sorted(((r.doc_id or 0), r.n_bytes, sum(s.end - s.start for s in r.spans)) for r in S.remove_repeats(df).collect())
    assert got == [(0, 300, 0), (1, 0, 0), (2, 0, 0), (3, 300, 300), (3, 300, 300), (4, 5, 0), (4, 251, 250), (5, 600_000, 599_999), (6, 129, 0), (6, 129, 0)]
    assert S.remove_repeats(df.limit(0)).collect() == []


@pytest.mark.parametrize("length", [32, 40, 64, 100, 200])
def test_refined_names_tell_strings_apart(length):
    """Equal strings have equal identifiers wherever they stand, others do not; halves agree where their bytes do."""
    rng = random.Random(length)
    data = bytes(rng.choices(b"ab", k=300)) + b"abcabc" * 100 + bytes(rng.choices(b"ab", k=300))
    data += data[100:700]
    names = S.Names(np.frombuffer(data, np.uint8), length, len(data))
    seen = {}
    for k, x in enumerate(names.strings.tolist()):
        assert seen.setdefault(data[k : k + length], x) == x
    assert len(set(seen.values())) == len(seen) and len(names.strings) == len(data) - length + 1
    half = 34
    p = np.arange(len(names.grams))
    for side, shift in zip(names.halves(p, half), (0, -half)):
        seen = {}
        for k, x in zip(p.tolist(), side.tolist()):
            if 0 <= k + shift and k + shift + S.GRAM + half <= len(data):
                assert seen.setdefault(data[k + shift : k + shift + S.GRAM + half], x) == x
        assert len(set(seen.values())) == len(seen)
