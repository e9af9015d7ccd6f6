"""Cleaning and packing a document table, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import common, langid, lines, packing, simhash

#: A document whose language is less certain than this is rejected, as is one without letters.
LEAST_SCORE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters and those whose language stays unclear; all others are kept as they are."""
    found = langid.identify(docs, langid.fit(docs, F.lit(True)))
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that many documents share out of all but one; no document goes. A null text becomes empty."""
    found = lines.dedup_lines(docs)
    row = F.col("row").withField("text", F.col("kept")).withField("n_chars", F.char_length("kept").cast("bigint"))
    return found.select(row.alias("row")).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of the smallest doc_id of each group of near copies: five-word shingles, similarity 0.8.

    SimHash fingerprints are linked as in operator 3, bands of minimal hashes
    find what they leave apart, and the sets of shingles decide every link.
    Rows are told apart by doc_id and text, so of rows that share a doc_id only
    the near copies go; rows equal in both stay together. Rows without a doc_id
    stay.
    """
    lost = simhash.near_copies(docs).where("NOT kept").select(F.col("doc_id").alias("lost_id"), "print").distinct()
    is_lost = (F.col("doc_id") == F.col("lost_id")) & (simhash.text_print(F.col("text")) == F.col("print"))
    return docs.join(lost, is_lost, "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language identification", identify_language),
    ("line dedup", drop_lines),
    ("near-copy dedup", drop_near_copies),
    ("best-fit packing", pack),
]

#: Language scores, fingerprints and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the whole table ``documents``; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stored(docs, f"stage{k}")
    return docs
