"""Document quality by Bradley-Terry pairwise ranking.

Each labelled good document is preferred to some labelled bad ones. A document's strength is linear in features of
its text; the weights come from the logistic loss of the preferences on the features' differences. A quantile of
the strengths then gives the threshold. All labelled documents take part: they are dealt to blocks, preferences are
drawn within a block, and the blocks' slopes and curvatures are summed for each step.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import labelled
from .shared import bound_batches, staged

#: Labelled documents to a block, about, and documents of each label that a block gets at least, about.
BLOCK, LEAST = 12_000, 100
#: Preference pairs for each document of a block's rarer label; more if else some document had none.
PARTNERS = 8
#: Strengths that are sorted on the driver, at most, and bins that the others are counted in, to find the threshold.
SORTED, BINS = 50_000, 4096
#: The score that the threshold is mapped to.
CUT = 0.7

_KINDS = np.zeros(256, np.int64)
for _k, _chars in enumerate(["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:'\"()-", "!?", "#$%&*@^~+=<>\\/_", "|[]{}`", "\n", " \t\r\x0b\x0c"], 1):
    _KINDS[list(_chars.encode())] = _k
_KINDS[128:] = 9
NAMES = ["chars", "words", "upper", "digit", "stops", "marks", "symbols", "bars", "breaks", "blanks", "beyond", "length", "single", "distinct", "frequent", "lines", "glued"]


def features(text: str) -> list[float]:
    """Numbers that describe a whole text; all 0 for one without words."""
    words = text.split()
    if not words:
        return [0.0] * len(NAMES)
    raw = np.frombuffer(text.encode(), np.uint8)
    kinds = np.bincount(_KINDS, np.bincount(raw, minlength=256), 10) / len(raw)
    n, counts, lines = len(words), Counter(words), [x for x in text.split("\n") if x]
    return [
        math.log1p(len(raw)),
        math.log1p(n),
        *kinds[1:].tolist(),
        len(raw) / n / 10,
        sum(c for w, c in counts.items() if len(w) == 1) / n,
        len(counts) / n,
        max(counts.values()) / n,
        len(set(lines)) / max(len(lines), 1),
        sum(c for w, c in counts.items() if not w[-1].isalnum() and w[-1] not in ".,;:") / n,
    ]


def expanded(x: np.ndarray) -> np.ndarray:
    """Features and the square roots of the shares among them, so that small shares count."""
    return np.concatenate([x, np.sqrt(np.abs(x[:, 2:])), x[:, :2] ** 2 / 10], axis=1)


@dataclass
class Ranking:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """From 0 to 1; CUT at the threshold."""
        strength = ((expanded(x) - self.mean) / self.scale) @ self.weights
        return 1 / (1 + np.exp(-np.clip(strength - self.threshold + math.log(CUT / (1 - CUT)), -50, 50)))


def preferences(z: np.ndarray, good: int) -> np.ndarray:
    """Differences of features between good documents, of which there are `good`, last among the rows, and bad ones; every row is in one at least."""
    first = np.arange(len(z) - good)
    last = np.arange(len(z) - good, len(z))
    n = max(PARTNERS * min(len(first), len(last)), len(first), len(last))
    rng = np.random.default_rng(0)
    return z[rng.permutation(np.resize(last, n))] - z[rng.permutation(np.resize(first, n))]


def _slopes(blocks: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slope, curvature) of the log-likelihood of all blocks' preferences."""
    size = len(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                d = preferences(np.frombuffer(r["z"]).reshape(-1, size), r["good"])
                p = 1 / (1 + np.exp(-np.clip(d @ weights, -30, 30)))
                curve = (d * (p * (1 - p))[:, None]).T @ d
                yield pa.RecordBatch.from_pydict({"block": [r["block"]], "slope": [(d.T @ (1 - p)).tolist()], "curve": [curve.ravel().tolist()]})

    rows = sorted(bound_batches(blocks).mapInArrow(run, "block long, slope array<double>, curve array<double>").collect())
    return np.sum([r.slope for r in rows], axis=0), np.sum([r.curve for r in rows], axis=0).reshape(size, size)


def exact_quantile(df: DataFrame, column: str, share: float) -> float:
    """The quantile of all values, between the two that are next to it in proportion; counted in bins, which are made finer where it lies."""
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    at, below, inside = share * (n - 1), 0, n
    x = F.col(column)
    while inside > SORTED and low < high:
        width = (high - low) / BINS
        place = F.least(F.floor((x - low) / width), F.lit(BINS - 1))
        bins = sorted(df.where((x >= low) & (x <= high)).groupBy(place.alias("place")).agg(F.count("*").alias("n"), F.min(x).alias("low"), F.max(x).alias("high")).collect())
        ends = below + np.cumsum([r.n for r in bins])
        first, last = np.searchsorted(ends, [int(at), min(int(at) + 1, n - 1)], side="right")
        below, found = int(ends[first] - bins[first].n), bins[first : last + 1]
        if (found[0].low, found[-1].high) == (low, high) and len(found) > 1:  # the two are the ends of a gap
            return _between(bins[first].high, bins[last].low, at)
        low, high, inside = found[0].low, found[-1].high, sum(r.n for r in found)
    if low == high:
        return float(low)
    values = sorted(r[0] for r in df.where((x >= low) & (x <= high)).select(column).collect())
    k = int(at) - below
    return _between(values[k], values[min(k + 1, len(values) - 1)], at)


def _between(a: float, b: float, at: float) -> float:
    return float(a + (at - int(at)) * (b - a))


def fit_ranking(rows: DataFrame, ridge: float = 1.0, steps: int = 30) -> Ranking:
    """The ranking that preferences of label 1 over label 0 give, from (id, label, z), z expanded features; with one label only, all strengths are equal."""
    size = len(NAMES) + len(NAMES[2:]) + 2
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    weights = np.zeros(size)
    if len(counts) < 2:
        return Ranking(weights, weights + 1, weights, math.log(CUT / (1 - CUT)))
    each = [F.col("z")[k] for k in range(size)]
    moments = list(rows.agg(*map(F.avg, each), *map(F.stddev_pop, each)).first())
    mean, scale = np.array(moments[:size]), np.array(moments[size:]) + 1e-6

    # A document of a label that is rare is dealt to several blocks, so that none is without.
    n = -(-sum(counts.values()) // BLOCK)
    copies = F.when(F.col("label") == 1, min(n, -(-LEAST * n // counts[1]))).otherwise(min(n, -(-LEAST * n // counts[0])))
    dealt = rows.select("label", "z", F.xxhash64("id").alias("h"), F.explode(F.sequence(F.lit(1), copies)).alias("k"))
    dealt = dealt.select(F.pmod(F.col("h") + F.col("k"), F.lit(n)).cast("long").alias("block"), "label", "z")

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        x = np.array(table["z"].to_pylist()).reshape(-1, size)
        y = np.asarray(table["label"])
        order = np.lexsort((*x[:, ::-1].T, y))
        return pa.table({"block": [key[0].as_py()], "good": [int(y.sum())], "z": [((x[order] - mean) / scale).tobytes()]})

    blocks = staged(dealt.groupBy("block").applyInArrow(pack, "block long, good long, z binary"), "blocks")
    for _ in range(steps):  # Newton steps on the logistic loss of the differences
        slope, curve = _slopes(blocks, weights)
        step = np.linalg.solve(curve + ridge * np.eye(size), slope - ridge * weights)
        weights = weights + step
        if np.abs(step).max() < 1e-6:
            break

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = np.array(b.column(0).to_pylist(), float).reshape(-1, size)
            yield pa.RecordBatch.from_arrays([pa.array(((z - mean) / scale) @ weights)], ["s"])

    found = staged(rows.select("z").mapInArrow(strengths, "s double"), "strengths")
    return Ranking(mean, scale, weights, exact_quantile(found, "s", counts[0] / sum(counts.values())))


def _with_features(df: DataFrame, text_col: str, schema: str, make) -> DataFrame:
    """(first column, what make gives of the features' rows), in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py() or "") for t in b.column(1)], float).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column(0), make(x)], ["c0", "c1"])

    return bound_batches(df).mapInArrow(run, schema)


def learn_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Ranking:
    """Learns from all labelled documents; sums over them, not their texts or features, reach the driver.

    Ids without a label of 0 or 1, or with both, teach nothing, nor do null ids and ids without a document; rows that
    repeat an id teach each; null and empty texts are documents without words. With labels of one kind only, or none,
    all documents score 0.5. Further columns are not read.
    """
    texts = docs.select(F.col(id_col).alias("c0"), F.col(text_col).cast("string").alias("text")).where("c0 is not null")
    kind = texts.schema["c0"].dataType.simpleString()
    made = _with_features(texts, "text", f"c0 {kind}, c1 array<double>", lambda x: pa.array(expanded(x).tolist(), pa.list_(pa.float64())))
    known = labelled(labels, label, id_col)
    return fit_ranking(staged(made.join(known, F.col("c0") == F.col("_id")).select(F.col("c0").alias("id"), "label", F.col("c1").alias("z")), "labelled"))


def score_quality(docs: DataFrame, ranking: Ranking, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) of every row: from 0 to 1, higher for better texts; CUT and more passes.

    Null texts count as empty; null ids and repeated rows stay; an empty table gives an empty result; further
    columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("c0"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["c0"].dataType.simpleString()
    scored = _with_features(rows, "text", f"c0 {kind}, c1 double", lambda x: pa.array(ranking.score(x)))
    return scored.select(F.col("c0").alias(id_col), F.col("c1").alias("score"))
