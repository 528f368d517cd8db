"""Corpus preparation: language, repeated lines, near copies, benchmark overlaps, pieces.

Each stage reads the rows that the one before it kept, written as Parquet in the shared folder. SQL cannot express
the learned language filters, so ORACLE_SQL is None and the tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feltmill.llm import language_filters, line_dedup, piece_transducer, shingle_copies, spaced_seeds
from feltmill.llm.common import small_batches, table
from feltmill.session import stored

PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without texts that have no letter or no n-gram of any language learned from the rows with a lang."""
    small_batches(spark)
    return language_filters.keep_known(docs, language_filters.learn(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document holds; every document stays, be it empty."""
    small_batches(spark)
    kept = line_dedup.drop_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: texts whose five-word shingles have a Jaccard likeness of 0.8 or more.

    op4's SimHash tiles over five-word shingles give the first candidates; the likeness itself is exact, and texts that
    the fingerprints keep apart (most pairs near 0.8 differ in more than 4 bits) are found by their rarest shingles.
    """
    small_batches(spark)
    return shingle_copies.keep_one(docs).select(*docs.columns)


def benchmark_overlaps(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return spaced_seeds.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document left."""
    model = piece_transducer.compile_model(PIECE_MODEL)
    keep = [c for c in docs.columns if c not in ("text", "ids", "n_bytes", "round_trip", "n_ids")]
    return piece_transducer.encode_texts(docs, model, *keep).withColumn("n_ids", F.size("ids").cast("long"))


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_copies),
    ("benchmark_decontamination", benchmark_overlaps),
    ("sentencepiece", pieces),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
