import zlib
from itertools import product

import numpy as np
import pytest

from tradewind.llm import quality as Q
from tradewind.llm import toxicity as X
from tradewind.llm.queries import op4_quality, op5_toxicity

SF = "/root/testdata/sf0.1"
ODD = [(1, None), (2, ""), (None, "some text"), (3, "same"), (3, "same"), (4, "a " * 100_000), (5, "\n\n"), (6, "1d10t " * 3)]


def held_out(spark, query, label):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in query(spark, SF).collect() if r.held_out and r.doc_id in labels]
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    return np.array([r.predicted for r in rows]), np.array([labels[r.doc_id] for r in rows]), rows


def test_quality_on_the_fold_held_out(spark):
    got, want, rows = held_out(spark, op4_quality, "quality")
    assert {zlib.crc32(str(r.doc_id).encode()) % 4 for r in rows} == {2}
    assert (got == want).mean() > 0.97


def test_toxicity_on_the_fold_held_out(spark):
    got, want, rows = held_out(spark, op5_toxicity, "toxic")
    assert {zlib.crc32(str(r.doc_id).encode()) % 3 for r in rows} == {1}
    assert (got == want).mean() > 0.97 and got[want == 1].mean() > 0.8


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame([(1, "the idiot and the loser met a moron, what a stupid clown; trash is trash " * 50)], "doc_id long, text string")
    return X.language_model(X.count_characters(docs))


def test_counts_of_characters(spark):
    docs = spark.createDataFrame([("ab",), ("AB b",), (None,), ("",)], "text string")
    code = lambda s: sum((0 if c == " " else X.INDEX[c]) * 64 ** (2 - k) for k, c in enumerate(s))
    got = {r.code: r.n for r in X.count_characters(docs).collect() if r.code}
    assert {k: got.get(code(k), 0) for k in (" ab", "ab ", "b b", " b ", "abb")} == {" ab": 2, "ab ": 2, "b b": 1, " b ": 1, "abb": 0}


@pytest.mark.parametrize(("written", "word"), [("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("m0r0n!!", "moron"), ("l-o-s-e-r", "loser"), ("idiooooot", "idiot"), ("$tupid", "stupid"), ("tr4$h", "trash"), ("plain", "plain")])
def test_restored_words(model, written, word):
    assert X.restore(written, model).lower() == word


def test_restored_text(model):
    assert X.restore_text("you i d i o t and  l0ser\n", model) == "you idiot and  loser\n"


HIDDEN = [
    "what a l o s e r", "y o u i d i o t", "y o u i i i d i o t", "i d i o t e", "u r a m 0 r 0 n", "the s  t u p i d clown", "s\tt\tu\tp\ti\td",
    "id iot", "an i d iot.", "(st upid", "st  up\nid!", "los er", "IDI OT", "iiddiioottt ii dd", "i\nd\ni\no\nt", "iiddiioott", "i i d d i i o o t t", "stuppid", "a looser", "mmorronn!", "you 1ddi0t", "idddioott", "STUPPID",
]


@pytest.mark.parametrize("text", HIDDEN)
def test_evidence_of_spaced_and_doubled_words(model, text):
    judge = X.Toxicity(model, {f"={w}": 3.0 for w in ("idiot", "loser", "stupid", "moron")})
    assert judge.evidence(text) == 3.0


@pytest.mark.parametrize("text", ["", "the clown met a trash letter", "a b c d e", "1 2 3 4 5", "w h a t", "a " * 5000, "los er.s", "los xer", "m o r e", "the los. er"])
def test_no_evidence_in_other_words(model, text):
    judge = X.Toxicity(model, {f"={w}": 3.0 for w in ("idiot", "loser", "stupid", "moron")})
    assert judge.evidence(text) == 0


def test_doubled_letters_in_all_ways(model):
    """However many there are: as by listing all ways."""
    draw = np.random.default_rng(4)
    names = sorted({"".join(draw.choice(list("abc"), draw.integers(1, 7))) for _ in range(400)})
    judge = X.Toxicity(model, {**{f"={w}": 1.0 for w in names[::2]}, **{w: 1.0 for w in names[1::2] if 4 <= len(w) <= 7}})
    hits = 0
    for _ in range(300):
        word = "".join(str(c) * int(draw.choice([1, 2, 2, 3], p=[0.4, 0.3, 0.25, 0.05])) for c in draw.choice(list("abc"), draw.integers(1, 9)))
        runs = X._runs(word)
        ways = product(*([x, x[0]] if len(x) == 2 else [x] for x in runs))
        want = {f for w in map("".join, ways) for f in X.word_features(w) if f in judge.names}
        assert judge.of_doubled(word) == want, word
        hits += len(want)
    assert hits > 100


SIGNS = ["".join(np.random.default_rng(k).choice(list("abcdlo016!|+.€ee"), 9)) for k in range(40)]


@pytest.mark.parametrize("word", ["1d10t", "m0r.0n", "aaab", "l|1", "tr4$h", "6!6|6!6|", *SIGNS])
def test_decoding_finds_the_best_path(model, word):
    def value(path):
        text, total = "".join(x for x, _ in path), sum(c for _, c in path)
        z = [0, 0, *(X.INDEX.get(c, X.OTHER) for c in text), 0]
        return total + sum(float(model[z[k], z[k + 1], z[k + 2]]) for k in range(len(z) - 2)), text

    best = max(value(p)[0] for p in product(*X.lattice(word)))
    assert X.decode(word, model) in {t for v, t in map(value, product(*X.lattice(word))) if v > best - 1e-4}


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in ODD], "doc_id long, text string, label string, score double")
    labels = spark.createDataFrame([(2, 1, 1), (3, 0, 0), (3, 0, 0), (4, None, None), (6, 1, 0), (6, 0, 1), (None, 1, 1), (9, 0, 1)], "doc_id long, quality int, toxic int")
    for table in (labels, labels.limit(0)):
        for rows in (Q.score_quality(docs, Q.learn_quality(docs, table)).collect(), X.score_toxicity(docs, X.learn_toxicity(docs, table)).collect()):
            assert sorted((r.doc_id or 0) for r in rows) == [0, 1, 2, 3, 3, 4, 5, 6]
            assert all(0 <= r.score <= 1 for r in rows)
            assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    none = docs.limit(0)
    assert Q.score_quality(none, Q.learn_quality(none, labels)).collect() == []
    assert X.score_toxicity(none, X.learn_toxicity(none, labels)).collect() == []


def test_ranking_prefers_what_it_is_told():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, len(Q.NAMES)))
    y = (x[:, 5] + 0.1 * rng.normal(size=400) > -0.5).astype(int)
    s = Q.fit_ranking(x, y).score(x)
    assert ((s >= 0.7) == y).mean() > 0.9


def test_plain_words_have_no_features(spark):
    """Scores do not change where no word is taken as plain."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    judge = X.learn_toxicity(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    texts = [r.text or "" for r in docs.collect()] + ["iddiot stuppid loosser", "!diot aaab 1diot, (idiot) i.d.i.o.t \u0130diot"]
    fast = [judge.evidence(t) for t in texts]
    every = X.Toxicity(judge.model, judge.weights)
    every.plain = lambda token: False
    assert fast == [every.evidence(t) for t in texts] and any(fast)
