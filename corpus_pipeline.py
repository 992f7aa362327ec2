"""The corpus pipeline: toxicity, near-duplicates, benchmark passages, personal data, packing.

Each stage gets the documents that the one before kept, as a written table. All but the last return the columns of
documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm import decontam, packing, pii, simhash, toxicity
from tradewind.llm.shared import discard, scratch, staged


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity score is 0.7 or more; learns from all labels of these documents.

    Null and empty texts score as texts without toxic words and stay unless those do go; long texts are read whole.
    Null ids stay and teach nothing; repeated rows score alike. An empty table gives an empty one. Columns stay as they
    are, whatever their names.
    """
    judge = toxicity.learn_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = "toxicity"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return toxicity.with_toxicity(docs, judge, name=name).where(f"{name} < 0.7").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of exact and near copies.

    Texts without words and rows with a null id stay; rows that repeat an id stay or go together; ties cannot be, as
    ids decide. Texts have no bound of length. An empty table gives an empty one; further columns stay.
    """
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item.

    Null and empty texts and rows with a null id stay; rows that repeat an id stay or go together. Texts have no bound of
    length. An empty table gives an empty one; further columns stay.
    """
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars, if there is such a column, counts the new text.

    Null texts stay null, and n_chars of them is null; empty ones, null ids and repeated rows stay. Texts have no bound
    of length. An empty table gives an empty one; further columns stay.
    """
    out = pii.redact(docs)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in sequences of 2048 tokens.

    Null and empty texts give one piece of the end token; null ids and repeated rows have pieces of their own. Long
    texts are cut into many. An empty table gives an empty one; further columns are not read.
    """
    pieces = packing.tokenize(docs, public_tokenizers.path("word_bpe_49k.json"))
    pieces = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.pack(staged(pieces, "pieces"))


STAGES = [
    ("toxicity", remove_toxic),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("personal_data", redact_personal_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents; each result is written and read again, and what it was made from deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        with scratch() as made:
            kept = staged(stage(spark, docs, sf_dir), name)
        discard(*(x for x in made if x is not kept), *([docs] if k else []))
        docs = kept
    return docs


#: None: DuckDB has neither the learnt scores nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None
