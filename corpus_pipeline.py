"""The corpus pipeline: from documents to packed training sequences.

Each stage works on all rows that its predecessor kept; all but the last return the columns of documents. The stages'
own results (probabilities, classes, spans) are columns of the operators they call.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.components import remove_folder, shared_folder
from ledgerloom.llm.langid import held_out
from ledgerloom.llm.mixing import mixture
from ledgerloom.llm.neardup import near_duplicates
from ledgerloom.llm.packing import pack_documents
from ledgerloom.llm.quality import score_quality
from ledgerloom.llm.toxicity import fit_toxicity, score_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOXIC = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep: base rules and a posterior of one half."""
    return score_quality(docs).filter("kept").select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below TOXIC by a model of the labelled rows that are left and not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").filter(~held_out(F.col("doc_id")))
    model = fit_toxicity(docs.select("doc_id", "text"), labels)
    return score_toxicity(docs, model).filter(F.col("toxicity") < TOXIC).select(*COLUMNS)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class (five-word shingles, similarity 0.8), that with the smallest doc_id.

    Rows without a doc_id stay; of rows that repeat a kept doc_id the one with the smallest text stays.
    """
    kept = near_duplicates(docs).filter(F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    known = docs.filter(F.col("doc_id").isNotNull()).join(kept, "doc_id").select(*COLUMNS)
    one = known.groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("r")).select("doc_id", "r.*")
    return one.select(*COLUMNS).unionByName(docs.filter(F.col("doc_id").isNull()).select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources, sorted by virtual finish time; documents that it takes twice are two rows."""
    return mixture(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their ids and place: doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=True)


STAGES = [("quality rules", quality), ("toxicity", toxicity), ("near duplicates", near_duplicate), ("mixing", mix), ("packing", pack)]

#: Trained transducers, learned lexicons and local search have no SQL; tests/llm/test_pipeline.py holds the stages against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet into the shared folder and read again by the next, whose input then goes.

    The product stays in the shared folder; rows and tables may be empty, repeated or null in any column.
    """
    shared_folder(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        if number:
            remove_folder(spark, f"{folder}/{number - 1}")
    return docs
