import math
import random
import zlib

import numpy as np
import pytest

from tradewind.llm import lm, recurrent
from tradewind.llm.queries import op12_language


def small(seed=0):
    draw = np.random.default_rng(seed)
    model = recurrent.initial(np.sort(draw.integers(1, 50, 30))[::-1].astype(float), 5, 4, np.float64)
    return {k: v + draw.normal(0, 0.3, v.shape) for k, v in model.items()}, draw


def slow_score(model, document):
    """One unit after the other, with plain softmax."""
    k, size = model["state"].shape[0], model["unit_bias"].shape[1]
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    h, out = np.zeros(k), 0.0
    for u in document:
        c = u // size
        out += math.log(soft(h @ model["class"] + model["class_bias"])[c]) + math.log(soft(h @ model["unit"][c] + model["unit_bias"][c])[u % size])
        x, a = model["input"][u] + model["bias"], h @ model["state"]
        z, r = sigmoid(x[:k] + a[:k]), sigmoid(x[k : 2 * k] + a[k : 2 * k])
        h = (1 - z) * np.tanh(x[2 * k :] + r * a[2 * k :]) + z * h
    return out


def test_gradients():
    model, draw = small()
    units = draw.integers(0, 30, (3, 6))
    units[1, 2] = 7  # an end: the state begins anew
    h = draw.normal(0, 0.5, (3, 5))
    grads = recurrent.gradients(model, h, units, 7)[0]
    full = {k: np.zeros_like(v) for k, v in model.items()}
    full["input"][grads["input"][0]] = grads["input"][1]
    for name in ("unit", "unit_bias"):
        for c, g in grads[name].items():
            full[name][c] = g
    full |= {k: grads[k] for k in ("class", "class_bias", "state", "bias")}
    for name in model:
        for _ in range(20):
            at = tuple(draw.integers(0, s) for s in model[name].shape)
            was, losses = model[name][at], []
            for move in (1e-5, -1e-5):
                model[name][at] = was + move
                losses.append(recurrent.gradients(model, h, units, 7)[2])
            model[name][at] = was
            assert abs((losses[0] - losses[1]) / 2e-5 - full[name][at]) < 1e-5, name


def test_scores_equal_slow_ones_across_windows(monkeypatch):
    monkeypatch.setattr(recurrent, "STATES", 7)
    model, draw = small(3)
    documents = [draw.integers(0, 30, n) for n in (1, 40, 3, 40, 0, 17)]
    assert np.allclose(recurrent.score(model, documents), [slow_score(model, d) for d in documents])
    assert recurrent.score(model, []).tolist() == []
    state = np.repeat(draw.normal(0, 1, (1, 5)), model["unit_bias"].size, 0)
    assert abs(np.exp(recurrent.log_probability(model, state, np.arange(len(state)))).sum() - 1) < 1e-9


def test_training_learns_an_order():
    draw = np.random.default_rng(1)
    documents = [np.append((np.arange(n) + draw.integers(9)) % 9 + 1, 0) for n in draw.integers(5, 40, 300)]
    start = recurrent.initial(np.full(10, 1.0), 8, 3)
    trained, read = recurrent.train(start, documents, 0, lanes=16, steps=8)
    assert read == sum(map(len, documents))
    assert recurrent.score(trained, documents).sum() > 0.6 * recurrent.score(start, documents).sum()
    assert recurrent.train(start, [], 0)[1] == 0 and recurrent.train(start, [np.array([0])], 0)[1] == 1


def texts(n=300):
    draw = random.Random(2)
    out = []
    for _ in range(n):
        words = [f"w{draw.randrange(8)}"]
        while len(words) < draw.randrange(5, 60):
            k = int(words[-1][1:]) if words[-1][0] == "w" else 0
            words.append(f"w{(k + 1) % 8}" if draw.random() < 0.9 else f"rare{draw.randrange(400)}")
        out.append(" ".join(words))
    return out


DOCS = "doc_id long, text string, score double, row long"


@pytest.fixture(scope="module")
def docs(spark):
    odd = [None, "", " \t\n", "W1 w1\x0bw2 x ÉTÉ", "w1 " * 30_000, "Ünseen"]
    rows = list(enumerate(texts() + odd * 2)) + [(7, "same"), (7, "same"), (None, "w1 w2"), (None, None)]
    return spark.createDataFrame([(*r, 1.0, 1) for r in rows], DOCS).repartition(3).persist()


@pytest.fixture(scope="module")
def learnt(docs):
    return lm.learn_language(docs.where("doc_id % 5 > 0 or doc_id is null"), rounds=2, share=1)


def counts_of(rows):
    counts = {}
    for r in rows:
        for w in [*lm.words_of(r.text or ""), None]:
            counts[w] = counts.get(w, 0) + 1
    return counts


def test_counts_and_scores_equal_brute_force(docs, learnt):
    counts = counts_of(docs.where("doc_id % 5 > 0 or doc_id is null").collect())
    total, units = sum(counts.values()), learnt.units
    assert (learnt.tokens, learnt.types) == (total, len(counts))
    model = {k: v.astype(np.float64) for k, v in learnt.model.items()}
    frequent = sorted((w for w, n in counts.items() if w is not None and n > 1), key=lambda w: (-counts[w], w))[: lm.FREQUENT]
    assert set(frequent) == set(units.words)
    endings = {}
    for w, n in counts.items():
        if w is not None and w not in units.words:
            endings.setdefault(zlib.crc32(w[-2:]) % 256, []).append(n)

    def brute(text):
        words = lm.words_of(text or "")
        base = sum(math.log10((counts.get(w, 0) + 0.1) / (total + 0.1 * (len(counts) + 1))) for w in [*words, None])
        said = slow_score(model, [units.words.get(w, int(units.endings[zlib.crc32(w[-2:]) % 256])) for w in words] + [units.end]) / math.log(10)
        for w in words:
            if w not in units.words:
                own = endings.get(zlib.crc32(w[-2:]) % 256, [])
                unseen = (own.count(1) + 1) / (sum(own) + own.count(1) + 2)
                said += math.log10((1 - unseen) * counts[w] / sum(own) if w in counts else unseen)
        return len(words) + 1, sum(w in counts for w in [*words, None]), base, said

    rows = lm.score_texts(docs, learnt).collect()
    want = sorted(((r.doc_id is None, r.doc_id or 0), *brute(r.text)) for r in docs.collect() if len(r.text or "") < 10_000)
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_tokens, r.n_known, r.base_score, r.score) for r in rows if r.n_tokens < 10_000)
    assert len(rows) == docs.count() and [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want]) and np.allclose([g[4] for g in got], [w[4] for w in want], rtol=1e-4, atol=1e-4)
    assert {r.train_tokens for r in rows} == {total}


def test_small_pools_give_the_same(docs, learnt, monkeypatch):
    monkeypatch.setattr(lm, "POOL", 100)
    again = lm.score_texts(docs, learnt).collect()
    monkeypatch.undo()
    rows = lambda found: sorted(str((r.doc_id, r.n_known, round(r.base_score, 3), round(r.score, 2))) for r in found)
    assert rows(again) == rows(lm.score_texts(docs, learnt).collect())


def test_probabilities_add_up(learnt):
    """Of a first token: all words, the unseen ones of each ending, and the end."""
    units = learnt.units
    first = np.exp(recurrent.log_probability(learnt.model, np.zeros((len(units.counts), recurrent.HIDDEN), np.float32), np.arange(len(units.counts))))
    words = [(bytes(r.word), r.n) for r in learnt.vocabulary.collect()]
    total = sum(first[units.words[w]] for w, _ in words if w in units.words) + first[units.end]
    for w, n in words:
        if w not in units.words:
            k = zlib.crc32(w[-2:]) % 256
            total += first[units.endings[k]] * 10 ** learnt.per_count[k] * n
    total += sum(first[units.endings[k]] * 10 ** learnt.unseen[k] for k in range(256))
    empty = sum(first[units.endings[k]] * (1 - 10 ** learnt.unseen[k]) for k in range(256) if not any(w not in units.words and zlib.crc32(w[-2:]) % 256 == k for w, _ in words))
    assert abs(total + empty - 1) < 1e-3


def test_held_out_texts_are_likelier_than_by_counts(docs, learnt):
    rows = lm.score_texts(docs.where("doc_id % 5 = 0 and doc_id < 300"), learnt).collect()
    assert sum(r.score for r in rows) > 0.8 * sum(r.base_score for r in rows)


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], DOCS)
    model = lm.learn_language(none)
    assert lm.score_texts(none, model).collect() == []
    row = lm.score_texts(docs.where("doc_id = 3"), model).first()
    assert (row.n_known, row.train_tokens) == (0, 0) and row.score < 0 and abs(row.base_score) < 1e-9


def test_query(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = op12_language(spark, str(tmp_path)).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10 == 0) for r in rows)
    assert len({r.train_tokens for r in rows}) == 1 and all(math.isfinite(r.score) and r.score < 0 for r in rows)


def test_all_documents_are_trained_on_once(spark, monkeypatch):
    read, train = [], lm.train_round
    monkeypatch.setattr(lm, "train_round", lambda texts, model, units: read.append([r.text for r in texts.collect()]) or train(texts, model, units))
    rows = [(k, f"w{k} a b") for k in range(100)]
    lm.learn_language(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len(read) == lm.ROUNDS and all(read) and sorted(t for part in read for t in part) == sorted(t for _, t in rows)


def test_windows_take_all_classes_together(monkeypatch):
    """A window's cost does not go with its classes one by one, and classes of more rows than a chunk add up."""
    monkeypatch.setattr(recurrent, "_by_class", lambda *_: pytest.fail("classes one by one"))
    model, draw = small(5)
    units = np.minimum(draw.geometric(0.3, (9, 20)) - 1, 28)
    assert (units < 8).sum() > 3 * recurrent.CHUNK
    grads, _, loss = recurrent.gradients(model, np.zeros((9, 5)), units, 29)
    assert np.isclose(loss, -sum(slow_score(model, d) for d in units))
    for c in range(4):
        move = 1e-5 * draw.normal(0, 1, model["unit"][c].shape)
        losses = [recurrent.gradients(model | {"unit": np.concatenate([model["unit"][:c], [model["unit"][c] + s * move], model["unit"][c + 1 :]])}, np.zeros((9, 5)), units, 29)[2] for s in (1, -1)]
        assert np.isclose((losses[0] - losses[1]) / 2, (grads["unit"].get(c, 0 * move) * move).sum(), rtol=1e-3, atol=1e-9)
    before = {k: v.copy() for k, v in model.items()}
    assert recurrent.train(model, [np.append(u, 29) for u in units], 29)[1] == units.size + 9
    assert all((before[k] == model[k]).all() for k in model)
