"""Corpus cleaning pipeline: toxicity, line dedup, near-duplicate removal, benchmark decontamination, tokenisation.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again by the next one. All but
the last return the columns of documents. Null texts pass every filter and give no tokens; rows without doc_id are never dropped as copies.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import shared_folder, table
from strandline.llm.decontaminate import drop_contaminated
from strandline.llm.jaccard import similar_classes
from strandline.llm.lines import drop_boilerplate
from strandline.llm.pieces import MODEL, encode_documents
from strandline.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score as toxic."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops boilerplate lines of each source; documents stay."""
    return drop_boilerplate(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each class of similar documents."""
    classes = similar_classes(docs)
    copies = classes.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded_sha256."""
    found = encode_documents(docs, public_tokenizers.path(MODEL))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("tokens", tokens)]

#: A trained model and a tokenizer are no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; results between stages go to the folder in spark.checkpoint.dir."""
    to, docs = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{to}/{k}")
        docs = spark.read.parquet(f"{to}/{k}")
    raise ValueError("STAGES is empty")
