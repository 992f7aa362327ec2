"""The ranking against a plain version: features by loops over characters, the optimum by its conditions, scores by hand."""

import math
import random
import zlib

import numpy as np
import pytest

from tradewind.llm import quality as Q
from tradewind.llm.queries import op4_quality

UPPER, DIGITS, STOPS, MARKS, SYMBOLS, BARS, BLANKS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:'\"()-", "!?", "#$%&*@^~+=<>\\/_", "|[]{}`", " \t\r\x0b\x0c"


def plain_features(text):
    words = text.split()
    if not words:
        return [0.0] * 17
    size = sum(len(c.encode()) for c in text)
    share = lambda chars: sum(c in chars for c in text) / size
    beyond = sum(len(c.encode()) for c in text if ord(c) > 127) / size
    lines = [x for x in text.split("\n") if x]
    return [
        math.log(1 + size), math.log(1 + len(words)), share(UPPER), share(DIGITS), share(STOPS), share(MARKS), share(SYMBOLS), share(BARS), share("\n"), share(BLANKS), beyond,
        size / len(words) / 10, sum(len(w) == 1 for w in words) / len(words), len(set(words)) / len(words), max(words.count(w) for w in set(words)) / len(words),
        len(set(lines)) / max(len(lines), 1), sum(not w[-1].isalnum() and w[-1] not in ".,;:" for w in words) / len(words),
    ]


def texts(n=240):
    draw = random.Random(1)
    word = lambda: "".join(draw.choice("abcdefg") for _ in range(draw.randrange(1, 9)))
    out = []
    for k in range(n):
        good = k % 3 != 0
        parts = [word().capitalize() if draw.random() < 0.2 else word() + draw.choice(["", ".", ","]) if good else draw.choice([word().upper(), "$$$!", "||", "12345", "buy"]) for _ in range(draw.randrange(3, 60))]
        out.append((k, draw.choice([" ", " ", "\n"]).join(parts), int(good)))
    return out


ODD = [(500, None), (501, ""), (None, "é \U0001f600 ß!"), (502, " \n\t"), (503, "x " * 50_000), (504, "same"), (504, "same")]


def test_features_equal_plain_ones():
    for text in [t for _, t, _ in texts(60)] + ["é \U0001f600 ß!", "|", "a\n\n\nb\r\n", "W" * 5000, "1 2 3 !", " "]:
        assert np.allclose(Q.features(text), plain_features(text))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("quality")
    rows = [(k, t) for k, t, _ in texts()] + ODD
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    labels = [(k, y) for k, _, y in texts()] + [(7, 1 - texts()[7][2]), (900, 1), (None, 1), (8, None)]  # two labels, no text, no id, no label
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_query_equals_a_plain_version(spark, folder):
    fold = lambda k: -1 if k is None else zlib.crc32(str(k).encode()) % 4
    known = sorted((y, plain_features(t)) for k, t, y in texts() if k != 7 and fold(k) != 2)
    x, y = np.array([f for _, f in known]), np.array([y for y, _ in known])
    wide = lambda f: np.array([*f, *(math.sqrt(abs(v)) for v in f[2:]), f[0] ** 2 / 10, f[1] ** 2 / 10])
    z = np.array([wide(f) for f in x])
    mean, scale = z.mean(0), z.std(0) + 1e-6
    z = (z - mean) / scale
    good, bad, draw = np.flatnonzero(y == 1), np.flatnonzero(y == 0), np.random.default_rng(0)
    n = 8 * min(len(good), len(bad))
    pairs = list(zip(draw.permutation(np.resize(good, n)), draw.permutation(np.resize(bad, n)), strict=True))
    ranking = Q.learn_quality(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet").where("pmod(crc32(string(doc_id)), 4) <> 2"))
    assert np.allclose(ranking.mean, mean) and np.allclose(ranking.scale, scale)
    # The weights are where the loss of the preferences, and of the weights themselves, is flat.
    slope = -ranking.weights.copy()
    for a, b in pairs:
        d = z[a] - z[b]
        slope += d / (1 + math.exp(d @ ranking.weights))
    assert np.abs(slope).max() < 1e-4
    strengths = sorted(z @ ranking.weights)
    at = len(bad) / len(y) * (len(strengths) - 1)
    cut = strengths[int(at)] + (at - int(at)) * (strengths[int(at) + 1] - strengths[int(at)])
    rows = op4_quality(spark, folder).collect()
    every = [(k, t) for k, t, _ in texts()] + ODD
    want = sorted((k is None, k or 0, 1 / (1 + math.exp(-np.clip((wide(plain_features(t or "")) - mean) / scale @ ranking.weights - cut + math.log(0.7 / 0.3), -50, 50)))) for k, t in every if len(t or "") < 50_000)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.score) for r in rows if r.doc_id != 503)
    assert len(rows) == len(every) and [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-6)
    assert all(r.held_out == (fold(r.doc_id) == 2) and r.predicted == (r.score >= 0.7) for r in rows)


def test_one_label_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    ranking = Q.learn_quality(docs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int"))
    assert {r.score for r in Q.score_quality(docs, ranking).collect()} == {0.5}
    assert {r.score for r in Q.score_quality(docs, Q.learn_quality(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int"))).collect()} == {0.5}


def test_all_labelled_documents_count(spark, monkeypatch):
    monkeypatch.setattr(Q, "BLOCK", 40)
    monkeypatch.setattr(Q, "LEAST", 5)
    monkeypatch.setattr(Q, "SORTED", 30)
    monkeypatch.setattr(Q, "BINS", 4)
    rows = [(k, t, y) for k, t, y in texts(600) if y or k % 60 == 0]  # few bad ones, less than one for each block
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, quality int")
    ranking = Q.learn_quality(docs, labels)
    z = Q.expanded(np.array([plain_features(t) for _, t, _ in rows]))
    assert np.allclose(ranking.mean, z.mean(0)) and np.allclose(ranking.scale, z.std(0) + 1e-6)
    strengths = ((z - z.mean(0)) / (z.std(0) + 1e-6)) @ ranking.weights
    assert abs(ranking.threshold - np.quantile(strengths, sum(y == 0 for *_, y in rows) / len(rows))) < 1e-6
    good = strengths[[k for k, r in enumerate(rows) if r[2]]]
    assert (good > strengths[[k for k, r in enumerate(rows) if not r[2]]].max()).mean() > 0.95


@pytest.mark.parametrize("good, bad", [(1, 300), (300, 1), (20, 400), (30, 30)])
def test_every_document_is_in_a_preference(good, bad):
    z = np.eye(good + bad)
    d = Q.preferences(z, good)
    assert (d[:, :bad] < 0).any(0).all() and (d[:, bad:] > 0).any(0).all() and np.abs(d.sum(1)).max() == 0


@pytest.mark.parametrize("share", [0.0, 0.11, 0.5, 0.77, 1.0])
def test_quantiles_are_exact(spark, monkeypatch, share):
    monkeypatch.setattr(Q, "SORTED", 10)
    monkeypatch.setattr(Q, "BINS", 4)
    x = np.concatenate([np.random.default_rng(1).normal(size=120), [0.25] * 70, [1e6, -1e6], [3.0] * 20])
    df = spark.createDataFrame([(float(v),) for v in x], "s double")
    assert abs(Q.exact_quantile(df, "s", share) - np.quantile(x, share)) < 1e-9
