import numpy as np
import pytest
from pyspark.sql import functions as F

from tradewind.llm import ann as A
from tradewind.llm.queries import op3_nearest


def brute(vectors, queries, k):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], float)
    out = {}
    for q in queries:
        s = [(-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in zip(ids, x.tolist()) if i != q]
        out[q] = [(i, -v) for v, i in sorted(s)[:k]]
    return out


def test_recall_and_exact_scores(spark):
    sf = "/root/testdata/sf0.1"
    vectors = {r.vec_id: list(map(float, r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    want = brute(vectors, [i for i in vectors if i % 20 == 0], 20)
    got = {}
    for r in op3_nearest(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.95
    for q, found in got.items():
        assert all(abs(s - np.dot(vectors[q], vectors[i])) < 1e-12 for i, s in found)


def test_copies_ties_and_odd_rows(spark):
    rows = [(i, [1.0, 0.5]) for i in range(1, 60)] + [(100 + i, [0.1 * i, 1.0]) for i in range(8)]
    odd = [(200, None), (201, []), (202, [0.0, 0.0]), (203, [None, 1.0]), (204, [float("nan"), 1.0]), (205, [float("inf"), 1.0]), (None, [1.0, 1.0]), (206, [1.0]), (1, [1.0, 0.5])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + odd], "vec_id long, embedding array<double>, node string, id int")
    want = brute(dict(rows), [20, 40, 100], 20)
    got = {}
    for r in A.search(df, F.col("vec_id").isin(20, 40, 100, 200, 206)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    for small in (df.limit(0), df.where("vec_id = 2"), df.where("vec_id >= 200")):
        assert A.search(small, F.lit(True)).collect() == []


@pytest.mark.parametrize("beam", [1, 4])
def test_codes_come_close(beam):
    x = np.random.default_rng(3).normal(size=(500, 16)).astype(np.float32)
    coder = A.learn_codebooks(x, books=6, words=32)
    codes = coder.encode(x, beam)
    near = sum(book[codes[:, j]] for j, book in enumerate(coder.books))
    assert ((near - x) ** 2).sum() < 0.25 * (x**2).sum()
    assert np.allclose(coder.scores(coder.tables(x[:5].astype(float)), codes), x[:5] @ near.T, atol=1e-3)
    assert np.allclose(coder.norms(codes), (near**2).sum(1), rtol=1e-4)


def long_rows():
    draw = np.random.default_rng(4)
    return {i: (v * 3).tolist() for i, v in enumerate(draw.normal(size=(3000, 256)))}


def shifted_rows():
    """Norms from 1e-3 to 1e3, tight groups, and a common offset that is large beside what tells rows apart."""
    draw = np.random.default_rng(5)
    groups = draw.normal(size=(40, 24))[draw.integers(0, 40, 3000)] + draw.normal(0, 1e-4, (3000, 24))
    rows = np.concatenate([groups[:1500] + 300, groups[1500:] * 10 ** draw.uniform(-3, 3, (1500, 1))])
    return dict(enumerate(rows.tolist()))


@pytest.mark.parametrize("rows", [long_rows, shifted_rows])
@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_none_is_missed_on_rows_that_codes_tell_badly(spark, rows, metric):
    vectors = rows()
    x, queries = np.array(list(vectors.values())), [i for i in vectors if i % 50 == 0]
    want = {}
    for q in queries:
        s = np.array([np.dot(x[q], v) if metric == "ip" else -((x[q] - v) ** 2).sum() for v in x])
        s[q] = -np.inf
        want[q] = np.sort(s)[::-1][:20]
    got = {}
    for r in A.search(spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, sample=512, metric=metric).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.score)
    assert got.keys() == want.keys() and all(np.allclose(got[q], want[q], rtol=1e-11, atol=1e-9 * np.abs(want[q]).max()) for q in want)


def test_blocks_and_large_numbers(spark, monkeypatch):
    monkeypatch.setattr(A, "CODES", 100)
    monkeypatch.setattr(A, "QUERIES", 30)
    monkeypatch.setattr(A, "LANES", 7)
    x = np.random.default_rng(6).integers(-2, 3, (900, 5)) * 2.0**500
    vectors = {i: v.tolist() for i, v in enumerate(x) if v.any()}
    want = brute(vectors, [i for i in vectors if i % 20 == 0], 20)
    got = {}
    for r in A.search(spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == {q: [i for i, _ in found] for q, found in want.items()}
