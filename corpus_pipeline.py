"""A training corpus from ``documents``: five stages, each a DataFrame to DataFrame step over all that the last one kept.

``STAGES`` lists (name, function); every function takes (spark, docs, sf_dir). All but the last return the columns of
``documents``; the last returns one row of each sampled segmentation, with its token ids.

Defined results: rows with a null or empty text fail the quality rules; later stages, given such rows, keep them (a null
text has no segmentation, an empty one a single empty one). Rows of equal doc_id are judged one by one by their text, but
count as one document where documents are counted and are near-duplicates of one another only by their texts; null doc_ids
are never near-duplicates. Columns beyond those of ``documents`` pass through, whatever their names, up to the last stage. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import decontam_sam, gumbel_pieces, line_bloom, minhash_cps, quality_sketch
from wordloom.llm.common import table, written
from wordloom.llm.queries import tokenizer_file

#: Segmentations of each document that remains.
SAMPLES = 2


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and their group's adaptive cutoffs."""
    return quality_sketch.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines of five or more documents stay in one of them only."""
    return line_bloom.remove_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash_cps.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; lesser benchmark passages are cut out of the others."""
    return decontam_sam.remove_contamination(docs, table(spark, sf_dir, "benchmark"))


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Distinct sampled segmentations: doc_id, sample_rank, ids, log_prob, perturbed, inclusion."""
    sampled = gumbel_pieces.sample_pieces(docs.select("doc_id", "text"), tokenizer_file("piece_bpe_32k.model"), SAMPLES)
    return sampled.select("doc_id", F.inline("samples"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", piece_encoding),
]

#: Stages 3 and 5 can't be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows written as Parquet and reread by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
