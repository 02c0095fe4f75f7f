"""Fusing ranked lists, and assembling hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def reciprocal_rank_fusion(bm25: DataFrame, vector: DataFrame, limit: int = 50, rrf_k: int = 60, id_column: str = "chunk_id") -> DataFrame:
    """query_id, id, rrf_score, bm25_rank, vector_rank, rank: hits of both lists (query_id, id, rank) by the sum of
    1 / (rrf_k + rank). Ties keep the order of the BM25 list, then that of the vector list."""
    keys = ["query_id", id_column]
    both = bm25.select(*keys, F.col("rank").alias("bm25_rank")).join(vector.select(*keys, F.col("rank").alias("vector_rank")), keys, "full_outer")
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(rrf_k) + F.col(c)), F.lit(0.0))
    fused = both.withColumn("rrf_score", part("bm25_rank") + part("vector_rank"))
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), F.col("bm25_rank").asc_nulls_last(), F.col("vector_rank").asc_nulls_last(), F.col(id_column))
    return fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def linear_fusion(bm25: DataFrame, vector: DataFrame, weight: float = 0.5, limit: int = 50, id_column: str = "chunk_id") -> DataFrame:
    """query_id, id, fused_score, rank: weight * BM25 + (1 - weight) * similarity, each scaled to 0..1 inside a query's
    list; a list whose scores are all equal counts 1, a missing hit 0."""
    keys = ["query_id", id_column]

    def scaled(hits: DataFrame, score: str, out: str) -> DataFrame:
        every = Window.partitionBy("query_id")
        low, high = F.min(score).over(every), F.max(score).over(every)
        return hits.select(*keys, F.when(high > low, (F.col(score) - low) / (high - low)).otherwise(F.lit(1.0)).alias(out))

    both = scaled(bm25, "score", "b").join(scaled(vector, "similarity", "v"), keys, "full_outer")
    fused = both.select(*keys, (F.lit(weight) * F.coalesce("b", F.lit(0.0)) + F.lit(1 - weight) * F.coalesce("v", F.lit(0.0))).alias("fused_score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("fused_score"), F.col(id_column))
    return fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def assemble_hits(fused: DataFrame, chunks: DataFrame, id_column: str = "chunk_id") -> DataFrame:
    """Hit rows with content, titles and metadata. The few hits are joined with the chunks last, so that contents are
    looked up once and never ranked."""
    return fused.join(chunks, id_column).withColumn("similarity", F.col("rrf_score"))
