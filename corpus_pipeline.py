"""The corpus pipeline: toxicity, line dedup, SimHash near-dedup, benchmark decontamination, SentencePiece encoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rangescan.llm import decontamination, line_dedup, pieces, simhash, toxicity
from rangescan.llm.common import cut


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on this stage's input, scores 0.7 or more go.

    Null and empty texts score what an empty text does; rows that repeat have one fate; an empty table stays empty.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs are deleted; documents of which nothing stays go.

    Null texts have one empty line and stay null; rows with equal id and text get the same result; an empty table stays empty.
    """
    return line_dedup.keep_first_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: that with the smallest id.

    Five-word shingles with a Jaccard similarity of 0.8: candidates by SimHash, verified, and then all pairs that
    are still between two classes. Null and empty texts are one class; rows that repeat the id that stays are all
    kept; an empty table stays empty.
    """
    return simhash.keep_one_per_class(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that they cover by more than half go.

    Null and empty texts hold none and stay; rows that repeat get the same result; an empty table stays empty.
    """
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, digests of the ids and of the text they decode to; null texts count as empty, every row has one."""
    return pieces.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("SentencePiece encoding and decoding", encode),
]

#: Model fitting, suffix sorting and tokenization have no SQL form; tests compare the run with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage-{k}")
    return docs
