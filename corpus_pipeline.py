"""From raw documents to packed token sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes every
stage's rows as Parquet in the cluster's shared folder and reads them again for the
next one.  All but the last return the columns of documents: the classifier, the
near-dedup and the decontamination drop rows, redaction rewrites text and n_chars.

Defined cases, in each stage: a null or empty text is a text without words, is judged
like any other by the classifier (it scores low), and is linked with nothing, leaked
into by nothing, and packed as the end id alone; of repeated rows the near-dedup keeps
those of the least doc_id; rows without an id are never linked; an empty table gives an
empty one; other columns go along unread.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, neardup, packing, pii, quality
from tessera.llm._session import cut, drop_path, scratch_path, table
from tessera.llm.queries import END_ID, KEEP_FROM, PACKING_TOKENIZER, tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores KEEP_FROM or more; it learns from the labelled ones among docs."""
    labels = table(spark, sf_dir, "labels")
    known = labels.select("doc_id").where(~quality.held_out()).distinct()
    model = quality.fit(cut(quality.vectors(docs.join(known, "doc_id", "left_semi"))), labels)
    return quality.keep(docs, model, KEEP_FROM)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least doc_id, of each group of near duplicates."""
    return neardup.dedup(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind."""
    return pii.redacted(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the packed sequences."""
    return packing.pack(docs, tokenizer_path(PACKING_TOKENIZER), END_ID)


STAGES: list[tuple[str, Stage]] = [
    ("quality_filter", quality_filter),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii_redaction", pii_redaction),
    ("sequence_packing", sequence_packing),
]

#: The classifier, the redaction and the tokenizer can't be put into SQL; tests hold run() against a plain version of every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole documents table."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop_path(spark, before)
        docs, before = spark.read.parquet(path), path
    out = STAGES[-1][1](spark, docs, sf_dir)  # its pieces are materialised, so the stage before can go
    drop_path(spark, before)
    return out
