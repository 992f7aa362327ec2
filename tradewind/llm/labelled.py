"""What the classifiers share: labels, a bounded sample of labelled texts, and the fold that is held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; -1 for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds)), F.lit(-1)).cast("int")


def labelled(labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """(_id, label) of all labelled ids. Ids whose label is null, neither 0 nor 1, or both, are left out, so are null ids."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label).alias("label"), F.max(label).alias("_most"))
    return known.where("label = _most").select(F.col(id_col).alias("_id"), F.col("label").cast("int").alias("label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, label) of at most `rows` labelled ids, drawn by a hash.

    The ids are few enough to be broadcast, so the texts are not shuffled. See labelled() for those left out.
    """
    known = labelled(labels, label, id_col).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(known), "_id").select("text", "label")
