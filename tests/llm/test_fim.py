import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradewind.llm import fim
from tradewind.llm.queries import op13_fill_in_middle

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
SIGNS = ["a", "Z", "z", "A", "@", "[", "`", "{", "é", "\U0001f600", "ß", " ", "\n", "1", "<", "<S", "\x00", "\x7f", "漢"]


def brute(doc_id, text):
    text, d = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = UNIT.findall(text)
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "plain" if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    return (doc_id, len(units), form, None if form == "plain" else len(p), None if form == "plain" else len(m), out, text)


@pytest.mark.parametrize("seed", range(4))
def test_places_in_random_bytes(seed):
    draw = random.Random(seed)
    for _ in range(300):
        texts = ["".join(draw.choice(SIGNS) for _ in range(draw.choice([0, 1, 2, 3, 8, 9, 30]))) for _ in range(draw.choice([1, 2, 5]))]
        sizes = [len(t.encode()) for t in texts]
        numbers = np.array([[draw.getrandbits(32), draw.getrandbits(32)] for _ in texts], np.int64)
        n, places, chars = fim.cut_places(np.frombuffer("".join(texts).encode(), np.uint8), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), numbers)
        for i, text in enumerate(texts):
            units = UNIT.findall(text)
            heads = ["".join(units[:k]) for k in sorted(int(x) % (len(units) + 1) for x in numbers[i])]
            assert n[i] == len(units) and places[i].tolist() == [len(h.encode()) for h in heads] and chars[i].tolist() == [len(h) for h in heads]


def rows(draw):
    texts = ["".join(draw.choice(SIGNS) for _ in range(draw.randrange(60))) for _ in range(300)]
    odd = [None, "", "a", "é", "x<P>y", "<S>", "a<M", "<" * 9, "ab " * 100_000, "\U0001f600" * 5000, "z" * 70_000]
    return [(k, t) for k, t in enumerate(odd * 4 + texts)] + [(7, "same"), (7, "same"), (7, "other"), (None, "no id"), (None, None)]


def test_outputs_and_back(spark):
    data = rows(random.Random(3))
    docs = spark.createDataFrame([(*r, "clash", 1) for r in data], "doc_id long, text string, form string, h1 int").repartition(3)
    cut = fim.fill_in_middle(docs)
    got = cut.select("*", fim.restore(F.col("output"), F.col("form")).alias("back")).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[6])
    assert sorted((tuple(r) for r in got), key=order) == sorted((brute(*r) for r in data), key=order)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_query_and_empty_table(spark, tmp_path):
    data = rows(random.Random(4))
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(*r[:5], sha(r[5]), sha(r[6])) for r in (brute(*x) for x in data)]
    assert sorted(map(str, map(tuple, op13_fill_in_middle(spark, str(tmp_path)).collect()))) == sorted(map(str, want))
    assert fim.fill_in_middle(spark.createDataFrame([], "doc_id string, text string")).collect() == []
