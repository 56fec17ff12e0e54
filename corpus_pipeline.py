"""A corpus pipeline over ``documents``: quality rules, line dedup, near-dedup, mixing, SentencePiece.

Each stage gets all that the one before has kept; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.llm import linededup, mixing, neardup, pieces, quality
from quirespark.llm.common import table, with_checkpoints
from quirespark.llm.tokencount import path_of

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that every rule lets through."""
    return quality.keep_good(docs).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten or more of them share; n_chars is that of the new text."""
    return linededup.drop_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each class of near copies."""
    return neardup.without_near_duplicates(docs).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs).select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, how many they are, and whether they decode to its text; copies have ids of their own."""
    copies = pieces.numbered(docs, "copy")
    out = pieces.round_trip(copies, path_of(pieces.MODEL), copy=F.col("copy"))
    return out.select("doc_id", "source", "pieces", F.size("pieces").cast("long").alias("n_pieces"), (F.col("decoded") == F.col("text")).alias("lossless"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("mixing", mix),
    ("sentencepiece", sentencepiece),
]

#: Signatures and merges are no SQL; tests compare the rows with plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage is written as Parquet to the shared folder and read again, and goes once
    the next one is written."""
    with_checkpoints(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{i - 1}")
            done.getFileSystem(spark._jsc.hadoopConfiguration()).delete(done, True)
    return docs
