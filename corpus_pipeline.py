"""Corpus preparation in stages, each written as Parquet and read again by the next.

Every stage takes all that its predecessor kept and returns the columns of ``documents``;
the last returns the encoded corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, table
from lodestone.llm.decontaminate import find_leaks
from lodestone.llm.jaccard_join import similarity_classes
from lodestone.llm.piece_bpe import default_model, encode_documents
from lodestone.llm.quality import classify
from lodestone.llm.substring_dedup import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return classify(docs, table(spark, sf_dir, "labels")).where("keep").select(*COLUMNS)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that of the smallest id.

    Rows that repeat an id with the same text are one; with other texts they stay or go together.
    Rows without an id are in no class and stay.
    """
    classes = similarity_classes(docs.where("doc_id IS NOT NULL")).where("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    classes = Scratch(spark, "kept").settle(classes, "classes")
    kept = docs.join(classes.hint("merge"), docs.doc_id == classes._kept, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where("doc_id IS NULL")).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand in a document of a smaller id; texts that lose nothing stay as they are."""
    kept = remove_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return kept.withColumn("text", text).where("n_removed = 0 OR n_removed < n_words").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; rows without an id can't be told apart and stay."""
    leaks = Scratch(spark, "leaking").settle(find_leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_leaks")).distinct(), "documents")
    return docs.join(leaks.hint("merge"), docs.doc_id == leaks._leaks, "left_anti").select(*COLUMNS)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and digests of ids and decoded text."""
    coded = encode_documents(docs.select("doc_id", "text", "lang", "source"), default_model())
    return coded.select(
        "doc_id",
        "lang",
        "source",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded_text", 256).alias("decoded_sha256"),
        "ids",
    )


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding and decoding", sentencepiece_encoding),
]

#: No SQL expresses the classifier, the classes of near copies and the encoding; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage makes of ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.settle(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
