"""Log-probabilities of documents under a gated recurrent language model, learnt where the documents are.

All training tokens are counted. The most frequent words are units of their own; other words are the unit of their last
two bytes, and then a word in it, by counts: a word that was never counted has the share of its unit that words counted
once suggest. So probabilities of a token add up to one over all words, known or not. The recurrent model predicts
units. It is trained in rounds, which share all documents out among them: every partition trains the last round's model on
its part of the round's documents, and the models are averaged, weighted by what they have read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import recurrent
from .shared import bound_batches, staged

#: Frequent words that are units, units for the last two bytes of others.
FREQUENT, ENDINGS = 3839, 256
#: Rounds of training; each reads other documents, in every part of the input, and together they read all.
ROUNDS = 3
#: Distinct words that a task holds before it hands their counts on, and tokens whose documents are scored side by side.
WORDS, POOL = 200_000, 1_500_000
#: Numbers of a model that are averaged together, and tasks whose models are averaged first.
BLOCK, FIRST = 1 << 14, 64


def words_of(text: str) -> list[bytes]:
    """Words in UTF-8 with A-Z lower-cased; bytes part at the six white spaces of ASCII only."""
    return text.encode().lower().split()


def _ending(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % ENDINGS


@dataclass
class Units:
    """Numbers of words: of frequent ones by word, of others by ending; and of the end of a document."""

    words: dict[bytes, int]
    endings: np.ndarray
    end: int
    counts: np.ndarray

    def read(self, words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """(units, the end's last; the words that are no units of their own)."""
        known = self.words
        found = np.array([*[known.get(w, -1) for w in words], self.end], np.int16)
        at = np.flatnonzero(found < 0)
        rare = [words[k] for k in at.tolist()]
        found[at] = self.endings[[_ending(w) for w in rare]]
        return found, rare


@dataclass
class LanguageModel:
    """What score_texts() needs: counted words, the tokens and their distinct words, units and their model."""

    vocabulary: DataFrame
    tokens: int
    types: int
    texts: int
    units: Units
    counted: dict[bytes, int]
    unseen: np.ndarray
    per_count: np.ndarray
    model: recurrent.Model


def _texts(docs: DataFrame, text_col: str, *more: Column) -> DataFrame:
    return docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def count_words(texts: DataFrame) -> DataFrame:
    """(word, ending, n) of text: how often each word comes, counted by task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            words = list(held)
            columns = [pa.array(words, pa.binary()), pa.array([_ending(w) for w in words], pa.int32()), pa.array(list(held.values()), pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, ["word", "ending", "n"])

        for b in batches:
            for text in b.column(0):
                held.update(words_of(text.as_py()))
                if len(held) > WORDS:
                    yield out()
        if held:
            yield out()

    rows = bound_batches(texts).mapInArrow(count, "word binary, ending int, n long")
    return rows.groupBy("word", "ending").agg(F.sum("n").alias("n"))


def _flat(model: recurrent.Model) -> np.ndarray:
    return np.concatenate([model[k].reshape(-1) for k in sorted(model)])


def _shaped(flat: np.ndarray, like: recurrent.Model) -> recurrent.Model:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(like[k].dtype)
        at += like[k].size
    return out


def _mean(table: pa.Table) -> pa.Table:
    """The mean of parts of models, weighted by what they have read."""
    weights = table["weight"].to_numpy().astype(np.float64)
    parts = [np.frombuffer(x.as_py(), np.float32) for x in table["part"]]
    mean = sum(w * p for w, p in zip(weights, parts, strict=True)) / weights.sum()
    return pa.table({"block": table["block"][:1], "weight": pa.array([weights.sum()]), "part": pa.array([mean.astype(np.float32).tobytes()], pa.binary())})


def train_round(texts: DataFrame, model: recurrent.Model, units: Units) -> recurrent.Model:
    """The mean of the models that the partitions of text have trained from this one; this one itself if there are no texts."""
    shared = texts.sparkSession.sparkContext.broadcast((model, units))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, units = shared.value
        documents = [units.read(words_of(x.as_py()))[0] for b in batches for x in b.column(0)]
        if not documents:
            return
        trained, read = recurrent.train(start, documents, units.end)
        flat, task = _flat(trained), TaskContext.get().partitionId()
        for k in range(0, len(flat), BLOCK):
            columns = [pa.array([k // BLOCK], pa.int32()), pa.array([task % FIRST], pa.int32()), pa.array([float(read)]), pa.array([flat[k : k + BLOCK].tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["block", "first", "weight", "part"])

    parts = bound_batches(texts).mapInArrow(learn, "block int, first int, weight double, part binary")
    kind = "block int, weight double, part binary"
    means = parts.groupBy("block", "first").applyInArrow(_mean, kind).groupBy("block").applyInArrow(_mean, kind)
    rows = sorted((r.block, bytes(r.part)) for r in means.collect())  # the model's size, whatever the input
    return _shaped(np.concatenate([np.frombuffer(p, np.float32) for _, p in rows]), model) if rows else model


def learn_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, share: int | None = None) -> LanguageModel:
    """A model of the language of all texts; see score_texts().

    Each document is trained on once, in one of the rounds; or once in every `share` rounds, if that is given.

    Null texts count as empty, which is a text that ends at once; rows that repeat count as often as they come. Of an
    empty table a model is learnt that knows no word. Ids only deal documents to rounds; further columns are not read.
    """
    counted = staged(count_words(_texts(docs, text_col)), "words")
    texts = docs.count()
    frequent = counted.where("n > 1").orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    stats = {r.ending: r for r in counted.groupBy("ending").agg(F.sum("n").alias("n"), F.count_if(F.col("n") == 1).alias("once"), F.count("*").alias("types")).collect()}
    tokens, types = sum(r.n for r in stats.values()) + texts, sum(r.types for r in stats.values()) + (texts > 0)
    many, once = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for k, r in stats.items():
        many[k], once[k] = r.n, r.once
    words, own = [bytes(r.word) for r in frequent], np.array([r.n for r in frequent], np.float64)
    np.subtract.at(many, [r.ending for r in frequent], own)
    # Units go by frequency: the end, words, endings. An ending without words may still come.
    counts = np.concatenate([[texts + 0.5], own, many + 0.5])
    order = np.argsort(-counts, kind="stable")
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    units = Units(dict(zip(words, number[1 : 1 + len(words)].tolist(), strict=True)), number[1 + len(words) :], int(number[0]), counts[order])
    unseen = (once + 1) / (many + once + 2)
    per_count = (1 - unseen) / np.maximum(many, 1)
    model, share = recurrent.initial(units.counts), share or rounds
    for k in range(rounds):
        part = docs.where(F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(share)) == k % share)
        model = train_round(_texts(part, text_col), model, units)
    return LanguageModel(counted.select("word", "n"), tokens, types, texts, units, dict(zip(words, own.astype(int).tolist(), strict=True)), np.log10(unseen), np.log10(per_count), model)


def score_texts(docs: DataFrame, lm: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Tokens are words, with A-Z lower-cased, and the end of the text; n_known of them were counted in training, where
    there were train_tokens. base_score is the sum of their log10((c + 0.1) / (N + 0.1 (V + 1))) by counts c of N
    tokens with V distinct ones; score is log10 of the text's probability under the model, in which the state goes on
    through the whole text. Null and empty texts have the end alone; ids may be null or repeat, and each row gets a
    result; texts have no bound of length; an empty table gives an empty result; further columns are not read.
    """
    spark = docs.sparkSession
    kind, end_known = docs.schema[id_col].dataType, int(lm.texts > 0)
    logs = np.zeros(len(lm.units.counts))  # of units that are tokens
    logs[[lm.units.words[w] for w in lm.counted]] = np.log10(np.array(list(lm.counted.values())) + 0.1)
    logs[lm.units.end] = np.log10(lm.texts + 0.1)
    shared = spark.sparkContext.broadcast((lm.model, lm.units, logs))
    rare_type = pa.struct([("word", pa.binary()), ("n", pa.int32())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, units, logs = shared.value
        task, done = TaskContext.get().partitionId(), 0
        ids, found, rare, base, known, held = [], [], [], [], [], 0

        def out() -> pa.RecordBatch:
            nonlocal done, held
            n = len(ids)
            said = recurrent.score(model, found) / np.log(10)
            sizes = np.array([len(r) for r in rare], np.int32)
            flat = pa.StructArray.from_arrays([pa.array([w for r in rare for w in r], pa.binary()), pa.array([k for r in rare for k in r.values()], pa.int32())], fields=list(rare_type))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), flat)
            rows = pa.array((np.int64(task) << 33) + np.arange(done, done + n))
            columns = [rows, pa.concat_arrays(ids), pa.array([len(f) for f in found], pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(said), lists]
            done, held = done + n, 0
            for x in (ids, found, rare, base, known):
                x.clear()
            return pa.RecordBatch.from_arrays(columns, ["row", "id", "n_tokens", "known", "base", "said", "rare"])

        for b in batches:
            for k, text in enumerate(b.column(1)):
                words = words_of(text.as_py())
                numbers, others = units.read(words)
                ids.append(b.column(0).slice(k, 1))
                found.append(numbers)
                rare.append(Counter(others))
                known.append(len(words) - len(others) + end_known)
                base.append(float(logs[numbers].sum()))
                held += len(numbers)
                if held >= POOL:
                    yield out()
        if ids:
            yield out()

    schema = f"row long, id {kind.simpleString()}, n_tokens long, known long, base double, said double, rare array<struct<word:binary,n:int>>"
    judged = staged(bound_batches(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))).mapInArrow(judge, schema), "judged")

    # Rare words meet their counts, in a shuffle at every size; of one that was not counted, the count is 0.
    n, c = F.col("_n"), F.coalesce("n", F.lit(0))
    ending = F.pmod(F.crc32(F.expr("substring(word, greatest(length(word) - 1, 1), 2)")), F.lit(ENDINGS)).cast("int")
    table = lambda values: F.element_at(F.lit([float(v) for v in values]), ending + 1)
    each = judged.select("row", F.explode("rare").alias("r")).select("row", "r.word", F.col("r.n").alias("_n")).join(lm.vocabulary.hint("merge"), "word", "left")
    within = F.when(c > 0, F.log10(c) + table(lm.per_count)).otherwise(table(lm.unseen))
    sums = each.groupBy("row").agg(F.sum(F.when(c > 0, n).otherwise(0)).alias("rare_known"), F.sum(n * F.log10(c + F.lit(0.1).cast("double"))).alias("rare_base"), F.sum(n * within).alias("rare_said"))
    scale = float(np.log10(lm.tokens + 0.1 * (lm.types + 1)))
    return judged.drop("rare").join(sums, "row", "left").select(
        F.col("id").alias(id_col), "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"), F.lit(lm.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * scale).alias("base_score"), (F.col("said") + F.coalesce("rare_said", F.lit(0.0))).alias("score"),
    )
