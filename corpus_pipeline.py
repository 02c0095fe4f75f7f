"""From raw documents to token ids: quality, exact copies, near copies, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents. The quality stage learns from the labels in sf_dir; the others need nothing but docs.

Defined results: rows with a null text, like those that are empty, get the score of an empty text in the first stage
and have no words to mix later; rows without an id go through; extra columns are carried along; an empty table gives
an empty result of the same columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.bpe import bpe_digests
from inkwell.llm.common import id_crc, materialize, read
from inkwell.llm.exact_dedup import drop_exact_duplicates
from inkwell.llm.mixing import mixture
from inkwell.llm.near_dup import drop_near_duplicates
from inkwell.llm.quality import fit_quality, keep_quality

QUALITY_THRESHOLD = 0.3
WEIGHTS = (5.0, 2.0, 1.0)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the raw documents that labels rate."""
    model = fit_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), train=id_crc(F.col("doc_id")) % 5 != 0)
    return keep_quality(docs, model, QUALITY_THRESHOLD)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity of 0.8 or more."""
    return drop_near_duplicates(docs, words=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source towards its target; a document that is taken several times is a row as often."""
    return mixture(docs, WEIGHTS, share=1.0, repeats=3)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("mixing", mixing_stage), ("bpe", bpe_stage)]

#: The compression classifier and the encoder can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
