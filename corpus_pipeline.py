"""From raw documents to packed sequences: quality, near-duplicates, repeated spans, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written before the next stage
reads it; all but the last return the columns of documents.

Null texts fall to the quality rules. The first three stages judge rows, not ids: rows that repeat an id and rows without one are
documents of their own, and the id only says which of a group comes first. The mix may repeat
a document, and each copy is packed. Empty tables pass through as empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packstat.llm import mixing, neardup, packing, quality, spans
from packstat.llm.common import compressed, restored, row_keys
from packstat.session import checkpoint, scratch_path, unfolded


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, in DataFrame operations only."""
    return _only(docs, quality.judge, compress=False)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the smallest id."""
    return _only(docs, neardup.grouped)


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of repeated spans; documents of which nothing is left go."""
    rows = row_keys(docs).withColumnsRenamed({"doc_id": "_own_id", "_row_key": "doc_id"})
    out = spans.remove_repeats(rows, keep_text=True).withColumnsRenamed({"doc_id": "_row_key", "_own_id": "doc_id"}).filter("n_words > n_removed").withColumnRenamed("kept_text", "text")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies."""
    return packing.pack(docs)


def _only(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], compress: bool = True) -> DataFrame:
    """The rows that ``judge`` keeps; ``compress``: texts move compressed, which Python does on the executors."""
    rows = row_keys(docs)
    judged = judge(rows.drop("doc_id").withColumnRenamed("_row_key", "doc_id"))
    kept = checkpoint(judged.filter("kept").select(F.col("doc_id").alias("_kept")))
    left = (compressed(rows) if compress else rows).join(unfolded(kept), F.col("_row_key") == F.col("_kept"), "left_semi").select(*docs.columns)
    return restored(left) if compress else left


STAGES = [("quality rules", quality_rules), ("MinHash near-dedup", near_duplicates), ("substring dedup", repeated_spans),
          ("mixing sources to target weights", source_mix), ("best-fit packing", packed_sequences)]

#: Packing and rounding are no relational expressions; tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        place = scratch_path(spark, name.replace(" ", "_"))
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return STAGES[-1][1](spark, docs, sf_dir)
