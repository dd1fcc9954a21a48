"""A corpus pipeline over `documents`: each stage calls one of the training-data operators.

Every stage but the last returns the columns of its input; each works on all that the stage before it kept.

Edge cases: a null or empty text is scored by the classifier like any other, and if kept it is one of a group of copies, loses no
passage and no secret, and is packed as the end token alone. Of near copies the row with the smallest id stays, null ids last, and of
rows that share it the smallest text; of a passage that repeats the copy that comes first by id and place stays. Repeated rows are near
copies. Texts are taken whole, however long. Extra columns ride along up to the last stage. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stockroom.llm import common, minhash, packing, quality, secret_scan, suffix_dedup


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = quality.learn(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: those that operator 2 links by their fingerprints, and those that
    have 0.8 of all five-word shingles in common."""
    return minhash.keep_one(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that stand earlier too are taken off the texts; the first copy of each stays."""
    return suffix_dedup.removed(docs, shape=suffix_dedup.PASSAGES)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced."""
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in full sequences."""
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("quality_rules", good_quality),
    ("simhash_dedup", near_dedup),
    ("suffix_dedup", passage_dedup),
    ("secret_scan", secrets),
    ("best_fit_packing", packed),
]

#: Fingerprints, trained models and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stored(docs)
    return docs
