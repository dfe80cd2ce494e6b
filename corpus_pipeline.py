"""A corpus pipeline: toxic documents go, then copies, then near copies; sources are mixed to
target weights, and the mix is packed into sequences.

Each stage takes (spark, docs, sf_dir) and gets what its predecessor kept, written and read
again. All but the last return the columns of documents. A mix repeats documents of sources
that weigh more than they have; each copy is packed.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from palimpsest.llm.common import drop_folder, shared_folder, table

#: Near copies: sets of five words, similarity 0.8.
NEAR = near_dedup.Near(words=5, percent=80)
TOKENIZER = "byte_bpe_50k.json"


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the model scores 0.5 or more; fitted on the labelled ones among them."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.keep_clean(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.dedup(docs, NEAR)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Fitting, MinHash and tokenising have no SQL form; tests hold each stage's operator, and the chain, against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """The stages over documents, each written to the shared checkpoint folder and read again.

    A folder that is named keeps every stage's rows, and stages that it holds in full are not
    run again; else what a stage has read goes when its result is written.
    """
    docs = table(spark, sf_dir, "documents")
    at = folder or f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4()}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(at).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for k, (_, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        if not files.exists(path(f"{at}/{k}/_SUCCESS")):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        if k and folder is None:
            drop_folder(spark, f"{at}/{k - 1}")
    return docs
