"""Toxicity of texts by noisy-channel deobfuscation.

A written word may hide another one: digits and signs stand for letters, letters repeat, spaces or dots come in
between. The channel gives each written character the letters it may stand for, which makes a lattice; Viterbi
decoding finds its likeliest path under a language model of characters that is counted over all documents. A run of
single characters is read between all blanks where words may part, and doubled letters as one and as two. Pieces beside
each other that a word of the lexicon falls into are decoded with their blanks, which may part words or not. The
restored words are then scored by the words and word beginnings that go with toxic labels.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import labelled_sample
from .shared import bound_batches, give_back_memory, released

#: Labelled documents that are learnt from, at most.
SAMPLE = 16_000
#: Features that a lexicon keeps, at most.
LEXICON = 20_000
#: Words that a worker keeps the results of; then it starts anew.
KEPT_WORDS = 120_000
#: Log-probabilities of the channel: a sign for a letter, a repeated letter that counts once or twice, a sign left out.
SIGN, REPEAT, SKIP = -1.5, -0.5, -0.7
#: Of blanks inside a run of single characters: one blank that parts words, a longer blank that does not.
PART, JOIN = -1.0, -2.0
#: Of blanks between pieces of several characters: one that does not part words.
APART = -5.0
#: Doubled letters of a word of which all ways to read them as one and as two are listed; with more, the lexicon is
#: looked up by words without doubled letters instead, which gives the same.
DOUBLES = 4
#: Letters that a word of the lexicon has at least to be looked for in pieces.
PIECES = 4
#: How much less likely than the best way to part a run of single characters another may be whose words are read, and
#: the characters that a word between two blanks of a run may have; the whole run is read in any case.
MARGIN, SPAN = 6.0, 32
#: Characters counted at a time.
BLOCK = 1 << 20

# The letters that signs stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "€": "e", "£": "l", "¡": "i"}
SEPARATORS = set(".-_*~^'`,:;/\\")

LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœ"
EDGE, OTHER, SIZE = 0, 63, 64
INDEX = {c: k for k, c in enumerate(LETTERS, 1)}
_TABLE = np.zeros(0x250, np.uint8)
_TABLE[0x80:] = OTHER
for _c, _k in INDEX.items():
    _TABLE[ord(_c)] = _k

SPACED = re.compile(r"(?<!\S)(?:\S\s+){2,}\S(?!\S)")
BLANK = re.compile(r"\s+")
TRIPLE = re.compile(r"(.)\1\1")
REPEATS = re.compile(r"(.)\1+", re.DOTALL)
DOUBLE = re.compile(r"([^\W\d_])\1")
WORD = re.compile(r"[^\W\d_]+")
#: Signs around a word that belong to no word.
EDGES = ".,;:!?#$%&*|\"'()[]{}<>-_"


def letter_codes(text: str) -> np.ndarray:
    """Letters of a lower-cased text as numbers; what is no letter is EDGE, letters beyond LETTERS are OTHER."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    return _TABLE[np.minimum(points, 0x24F)]


def count_characters(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(code, n): how often each run of three letters or word edges comes in all texts, as code a*4096 + b*64 + c.

    Each task sums its own counts; there are at most 64**3 codes. Null texts count as empty.
    """

    def add(counts: np.ndarray, texts: list[str]) -> None:
        x = letter_codes("\n".join(["", *texts, ""]))
        for k in range(0, len(x) - 2, BLOCK):
            part = x[k : k + BLOCK + 2].astype(np.int64)
            counts += np.bincount(part[:-2] * 4096 + part[1:-1] * 64 + part[2:], minlength=SIZE**3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, waiting, size = np.zeros(SIZE**3, np.int64), [], 0
        for b in batches:
            for t in b.column(0):
                waiting.append(t.as_py() or "")
                size += len(waiting[-1]) + 1
                if size >= BLOCK:
                    add(counts, waiting)
                    waiting, size = [], 0
        add(counts, waiting)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], ["code", "n"])

    return bound_batches(docs).select(F.col(text_col).cast("string").alias("text")).mapInArrow(released(run), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def language_model(counts: DataFrame) -> np.ndarray:
    """log p(c | a, b) as an array of 64 * 64 * 64, smoothed by the shorter contexts."""
    table = np.zeros(SIZE**3)
    for r in counts.collect():  # at most 64**3 rows
        table[r.code] = r.n
    table = table.reshape(SIZE, SIZE, SIZE)
    two, one = table.sum(axis=0), table.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + SIZE)
    p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
    return np.log((table + 5 * p2[None]) / (table.sum(axis=2, keepdims=True) + 5)).astype(np.float32)


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """For each run of equal characters, the letters it may stand for and their log-probabilities; blanks may part words.

    One or two blanks stand between single characters, three between pieces.
    """
    out, k, word = [], 0, word.lower()
    while k < len(word):
        c, n = word[k], 1
        while k + n < len(word) and word[k + n] == c:
            n += 1
        k += n
        if c in LEET:
            options = [(x * m, SIGN) for x in LEET[c] for m in {1, min(n, 2)}]
        elif c == " ":
            options = [("", 0.0), (" ", PART)] if n == 1 else [("", JOIN if n == 2 else APART), (" ", 0.0)]
        elif c in SEPARATORS or c.isspace():
            options = [("", SKIP)]
        elif n >= 3:
            options = [(c, REPEAT), (c * 2, REPEAT)]
        elif n == 2 and c.isalpha():
            options = [(c, REPEAT), (c * 2, 0.0)]
        else:
            options = [(c * n, 0.0)]
        out.append(options)
    return out


def decode(word: str, model: np.ndarray) -> str:
    """The likeliest path through a word's lattice, by Viterbi decoding over all states: the last two letters."""
    states = START
    for options in lattice(word):
        states = _step(states, options, model)
    return _best(states, model)[1]


START: dict = {(EDGE, EDGE): (0.0, None)}


def _step(states: dict, options: list[tuple[str, float]], model: np.ndarray) -> dict:
    after: dict = {}
    for (a, b), (score, path) in states.items():
        for letters, cost in options:
            x, y, s = a, b, score + cost
            for c in letters:
                z = INDEX.get(c, OTHER if c.isalpha() else EDGE)
                x, y, s = y, z, s + model[x, y, z]
            if (x, y) not in after or after[x, y][0] < s:
                after[x, y] = s, (path, letters)
    return after


def _best(states: dict, model: np.ndarray) -> tuple[float, str]:
    """The value and the letters of the likeliest path that ends here."""
    value, end = min(((-(kv[1][0] + model[kv[0][0], kv[0][1], EDGE])), kv[0]) for kv in states.items())
    path, out = states[end][1], []
    while path:
        path, letters = path
        out.append(letters)
    return -float(value), "".join(reversed(out))


def parted(run: str, model: np.ndarray) -> set[str]:
    """The words between any two blanks of a run of single characters whose parting is within MARGIN of the likeliest."""
    parts = re.findall(r"(\S)( *)", run)
    n = len(parts)
    known: dict = {}
    spans = []
    for i in range(n):
        window = "".join(map("".join, parts[i : i + SPAN])).rstrip(" ")
        if window not in known:
            states, found = START, []
            for c, blank in parts[i : i + SPAN]:
                states = _step(states, lattice(c)[0], model)
                found.append(_best(states, model))
                if blank:
                    states = _step(states, [("", lattice(blank)[0][0][1])], model)
            known[window] = found
        spans.append(known[window])
    # The cost of parting is that of the blank after a word.
    after = [lattice(blank)[0][1][1] if blank else 0.0 for _, blank in parts]
    ahead, back = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
    for i in range(n):
        for j, (value, _) in enumerate(spans[i], i + 1):
            ahead[j] = max(ahead[j], ahead[i] + value + after[j - 1])
    for i in reversed(range(n)):
        back[i] = max(value + after[j - 1] + back[j] for j, (value, _) in enumerate(spans[i], i + 1))
    least = ahead[n] - MARGIN
    return {word for i in range(n) for j, (value, word) in enumerate(spans[i], i + 1) if ahead[i] + value + after[j - 1] + back[j] >= least}


def hides(word: str) -> bool:
    """Whether a written word has more than one reading: signs beside letters, signs between letters, long repeats."""
    core = word.strip(EDGES)
    lead = word[:1] in LEET and len(word) > 1 and word[1].isalpha()
    if core.isalpha():
        return lead or bool(TRIPLE.search(core))
    inside = any(c in LEET or c in SEPARATORS for c in core) and any(c.isalpha() for c in core)
    return inside or lead or bool(TRIPLE.search(core))


def restore(word: str, model: np.ndarray) -> str:
    """A written word with the likeliest letters behind its signs; a word that hides nothing stays as it is."""
    if not hides(word):
        return word
    return decode(word.rstrip("!?.,;:#%&*\"')|") or word, model)


def restore_text(text: str, model: np.ndarray) -> str:
    """A whole text with spaced-out and disguised words restored; white space and other words stay as they are."""
    joined = SPACED.sub(lambda m: decode(_evened(m[0]), model) if _has_letter(m[0]) else m[0], text)
    return "".join(x if k % 2 else restore(x, model) for k, x in enumerate(re.split(r"(\s+)", joined)))


def _has_letter(word: str) -> bool:
    return any(c.isalpha() for c in word)


def _evened(run: str) -> str:
    """A run of single characters with one blank for each single white space and two for each longer one."""
    return BLANK.sub(lambda m: " " if len(m[0]) == 1 else "  ", run)


def _runs(word: str) -> list[str]:
    return [m[0] for m in re.finditer(r"(.)\1*", word, re.DOTALL)]


def undoubled(word: str) -> Iterator[str]:
    """A word with each of its doubled letters as one and as two, in all ways; with more than DOUBLES of them, as it is."""
    runs = _runs(word)
    twice = [k for k, x in enumerate(runs) if len(x) == 2 and x.isalpha()]
    if len(twice) > DOUBLES:
        twice = []
    for some in range(1 << len(twice)):
        once = {k for j, k in enumerate(twice) if some >> j & 1}
        yield "".join(x[0] if k in once else x for k, x in enumerate(runs))


def collapsed(word: str) -> str:
    """A word with one letter for each run of equal ones."""
    return REPEATS.sub(r"\1", word)


def word_features(word: str) -> list[str]:
    """A word and its beginnings of 4 to 7 letters."""
    return ["=" + word, *(word[:n] for n in range(4, 8) if len(word) >= n)]


def _tokens(text: str) -> set[str]:
    """The distinct written words of a text; runs of single characters count as one word, with their blanks."""
    found = set(text.split())
    found.update(_evened(m[0]) for m in SPACED.finditer(text))
    return found


def _readings(token: str, model: np.ndarray) -> set[str]:
    """The words of a written word as it is and as restored, lower-cased."""
    low = token.lower()
    found = set() if " " in token else set(WORD.findall(low))
    if " " in token:
        found |= _readings(token.replace(" ", ""), model)
        if _has_letter(token):
            found.update(w for x in parted(token, model) for w in WORD.findall(x))
    elif hides(token):
        for x in undoubled(low):
            found.update(WORD.findall(restore(x, model)))
    for w in [w for w in found if DOUBLE.search(w)]:
        found.update(undoubled(w))
        if TRIPLE.search(w) or len(DOUBLE.findall(w)) > DOUBLES:
            found.add(decode(w, model))
    return found


def repeated(features: Counter) -> list[str]:
    """Each feature, and again with #2 and #3 if so many of a text's words have it."""
    return [f if n == 1 else f"{f}#{n}" for f, c in features.items() for n in range(1, min(c, 3) + 1)]


@dataclass
class Toxicity:
    model: np.ndarray
    weights: dict[str, float]
    slope: float = 1.0
    offset: float = -3.0
    kept: dict[str, tuple[str, ...]] = field(default_factory=dict)
    begins: dict[str, bool] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.names = {f.partition("#")[0] for f in self.weights}
        self.heads = {collapsed(f.lstrip("="))[:3] for f in self.names}
        self.short: dict[str, list[str]] = {}
        for f in sorted(self.names):
            self.short.setdefault(collapsed(f.lstrip("=")), []).append(f)
        self.words = {f[1:] for f in self.names if f[0] == "=" and len(f) > PIECES}
        self.begun = {w[:k] for w in self.words for k in range(1, len(w))}
        self.joins: dict[str, bool] = {}

    def plain(self, token: str) -> bool:
        """Whether a written word is one of letters only that begins like no feature of the lexicon, doubled letters or not.

        Such words have no features, and nearly all words are such.
        """
        low = token.strip(EDGES).lower()
        if not low.isalpha() or token[0] in LEET:
            return False
        head = low[:6]
        near = self.begins.get(head)
        if near is None:
            if len(self.begins) > KEPT_WORDS:
                self.begins.clear()
            short = collapsed(head)
            near = self.begins[head] = any(short[:k] in self.heads for k in (1, 2, 3))
        return not near and not TRIPLE.search(low)

    def of_doubled(self, word: str) -> set[str]:
        """The lexicon's features that a word has in any way to read its doubled letters as one and as two."""
        runs = _runs(word)
        ways = [{1, 2} if len(x) == 2 and x.isalpha() else {len(x)} for x in runs]
        short, found = "".join(x[0] for x in runs), set()
        for k in {*range(1, 8), len(runs)}:
            for f in self.short.get(short[:k], ()) if k <= len(runs) else ():
                own = [len(x) for x in _runs(f.lstrip("="))]
                fits = all(n in w for n, w in zip(own[:-1], ways, strict=False))
                if fits and (own[-1] in ways[k - 1] and k == len(runs) if f[0] == "=" else own[-1] <= max(ways[k - 1])):
                    found.add(f)
        return found

    def pieced(self, text: str) -> set[str]:
        """The words of the lexicon that a text has in pieces, where it is likelier that no words part between them."""
        pieces, found = text.lower().split(), set()
        for i, piece in enumerate(pieces):
            if piece not in self.begun:
                if piece[0] not in EDGES or (piece := piece.lstrip(EDGES)) not in self.begun:
                    continue
            whole, run = piece, piece
            for j in range(i + 1, len(pieces)):
                last = pieces[j].rstrip(EDGES)
                whole, run = whole + last, f"{run}   {last}"
                if last and whole in self.words and self._joins(run, whole):
                    found.add(whole)
                if last != pieces[j] or whole not in self.begun:
                    break
        return found

    def _joins(self, run: str, word: str) -> bool:
        known = self.joins.get(run)
        if known is None:
            if len(self.joins) > KEPT_WORDS:
                self.joins.clear()
            known = self.joins[run] = decode(run, self.model) == word
        return known

    def features(self, token: str) -> tuple[str, ...]:
        """Those of a written word's features that the lexicon names."""
        found = self.kept.get(token)
        if found is None:
            if len(self.kept) > KEPT_WORDS:
                self.kept.clear()
            every = _readings(token, self.model)
            names = {f for x in every for f in word_features(x) if f in self.names}
            names.update(f for x in every if len(DOUBLE.findall(x)) > DOUBLES for f in self.of_doubled(x))
            found = self.kept[token] = tuple(names)
        return found

    def evidence(self, text: str) -> float:
        """The three strongest words' weights, each counting half as much as the one before; 0 for a clean text."""
        found = [x for x in (self.features(t) for t in _tokens(text) if not self.plain(t)) if x]
        told = {f for x in found for f in x}
        found += [tuple(f for f in word_features(w) if f in self.names) for w in self.pieced(text) if f"={w}" not in told]
        if not found:
            return 0.0
        counts = Counter(f for x in found for f in x)
        strength = {f: max(self.weights.get(r, 0.0) for r in repeated(Counter({f: c}))) for f, c in counts.items()}
        top = sorted((max(strength[f] for f in x) for x in found), reverse=True)[:3]
        return sum(w / 2**k for k, w in enumerate(top))

    def score(self, text: str) -> float:
        return 1 / (1 + math.exp(-min(max(self.slope * self.evidence(text) + self.offset, -50), 50)))


def _label_counts(sample: DataFrame, model: np.ndarray) -> DataFrame:
    """(f, toxic, clean): in how many documents of each label a feature comes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = Counter(), Counter()
        for b in batches:
            for t, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                counts[y].update(repeated(Counter(f for x in _tokens(t.as_py()) for f in {f for r in _readings(x, model) for f in word_features(r)})))
        names = sorted(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([counts[y][f] for f in names], pa.int64()) for y in (1, 0))], ["f", "toxic", "clean"])

    return sample.mapInArrow(released(run), "f string, toxic long, clean long").groupBy("f").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _evidence(sample: DataFrame, judge: Toxicity) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([judge.evidence(t.as_py()) for t in b.column(0)], pa.float64()), b.column(1)], ["e", "y"])

    return sample.mapInArrow(released(run), "e double, y int")


def learn_toxicity(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None, label: str = "toxic", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Toxicity:
    """Learns from at most `sample` labelled rows of docs; characters are counted over all of corpus (docs, if None).

    A feature joins the lexicon if it comes in toxic documents so much more often than in clean ones that among all
    features not one in ten lexicons would hold it by chance. The scores' slope and offset are those of a
    logistic regression on the sample.
    """
    model = language_model(count_characters(corpus if corpus is not None else docs, text_col))
    known = labelled_sample(docs, labels, label, sample, id_col, text_col)
    sizes = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Toxicity(model, {})
    share = toxic / (toxic + clean)
    counts = _label_counts(known, model).where("toxic > 1").persist()
    features = counts.count()
    a, n = F.col("toxic"), F.col("toxic") + F.col("clean")
    surprise = a * F.log(a / n / share) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / n / (1 - share))).otherwise(0.0)
    weight = F.log((a + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    chosen = counts.where(a / n > share).withColumn("s", surprise).withColumn("w", weight).where(F.col("s") > math.log(max(features, 1) * 10)).orderBy(F.desc("s"), "f").limit(LEXICON)
    judge = Toxicity(model, {r.f: r.w for r in chosen.collect() if r.w > 1})
    counts.unpersist()
    rows = np.array(sorted((r.e, r.y) for r in _evidence(known, judge).collect()), float).reshape(-1, 2)
    judge.slope, judge.offset = fit_line(rows[:, 0], rows[:, 1])
    return judge


def fit_line(e: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Slope and offset of the logistic regression of y on e."""
    x, w = np.stack([e, np.ones_like(e)], axis=1), np.array([0.0, math.log((y.sum() + 1) / (len(y) - y.sum() + 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        keep = np.diag([ridge, 1e-3])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def score_toxicity(docs: DataFrame, judge: Toxicity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) of every row: from 0 to 1, higher for more toxic texts.

    Null texts count as empty; null ids and repeated rows stay; an empty table gives an empty result; further
    columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("c0"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["c0"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([judge.score(t.as_py() or "") for t in b.column(1)], pa.float64())], ["c0", "score"])

    return bound_batches(rows).mapInArrow(released(run), f"c0 {kind}, score double").select(F.col("c0").alias(id_col), "score")


def with_toxicity(docs: DataFrame, judge: Toxicity, text_col: str = "text", name: str = "toxicity") -> DataFrame:
    """docs with one more column, the score of each row's text; null texts count as empty."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([judge.score(t or "") for t in texts], dtype=float)
        give_back_memory()

    return bound_batches(docs).withColumn(name, score(F.col(text_col)))
