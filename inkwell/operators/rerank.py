"""Late-interaction reranking, full search and its result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions.vectors import maxsim
from inkwell.operators.fusion import assemble_hits, reciprocal_rank_fusion
from inkwell.operators.text_index import TextIndex, allowed_facets, pruned_search, with_filter
from inkwell.operators.vector_search import VectorCells, cell_search


def rerank(hits: DataFrame, queries: DataFrame, dim: int = 128, threshold: float = 0.3, kind: str = "int8", limit: int | None = None, id_column: str = "chunk_id", score: str | None = None) -> DataFrame:
    """Hits (query_id, id, rank, similarity, multi_vector_low_dim) by the MaxSim score with their query (query_id,
    multi): rerank_score, similarity, rerank_failed and final_rank.

    Scores below the threshold are dropped. A hit without a multi-vector stays with score 0 and keeps its similarity.
    Where the query has none, hits stay as they are with rerank_failed. Ties keep the former order. score: a column
    that already holds the MaxSim score."""
    paired = hits.join(queries.select("query_id", "multi"), "query_id", "left")
    # else the filter by threshold is pushed below, and every pair scored twice, in two workers for each core
    found = F.col(score) if score else maxsim(dim, kind).asNondeterministic()(F.col("multi"), F.col("multi_vector_low_dim"))
    lacks = F.col("multi_vector_low_dim").isNull() | (F.length("multi_vector_low_dim") == 0)
    paired = paired.withColumn("rerank_failed", F.col("multi").isNull()).withColumn("__found", found)
    scored = paired.withColumn("rerank_score", F.when(F.col("rerank_failed"), None).when(lacks, F.lit(0.0)).otherwise(F.col("__found")))
    kept = scored.filter(F.col("rerank_failed") | lacks | (F.col("rerank_score") >= threshold))
    kept = kept.withColumn("similarity", F.when(F.col("rerank_failed") | lacks, F.col("similarity")).otherwise(F.col("rerank_score")))
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc_nulls_last(), "rank", F.col(id_column))
    out = kept.withColumn("final_rank", F.row_number().over(order)).drop("multi", "multi_vector_low_dim", "__found")
    return out if limit is None else out.filter(F.col("final_rank") <= limit)


def hybrid_search(index: TextIndex, cells: VectorCells, chunks: DataFrame, queries: DataFrame, top: int = 50, rrf_k: int = 60, fixed: dict[str, str] | None = None, digits: int | None = None) -> DataFrame:
    """Fused hits of words and vectors with what chunks (chunk_id, ...) have of them. queries have query_id, query and
    vector, and may have columns named like the index's facets as filters of their own; fixed values hold for all. Chunks
    that a filter excludes are left out of postings and vector cells before anything of them is scored. cells are made with
    the facet of the index."""
    words = pruned_search(index, queries, top, digits=digits, fixed=fixed)
    filters = allowed_facets(index, queries, fixed) if index.facets else None
    near = cell_search(cells, with_filter(index, queries).filter("vector IS NOT NULL"), top, digits, filters)
    return assemble_hits(reciprocal_rank_fusion(words, near, top, rrf_k), chunks)


def full_search(index: TextIndex, cells: VectorCells, chunks: DataFrame, queries: DataFrame, limit: int = 5, top: int = 50, dim: int = 128, threshold: float = 0.3, fixed: dict[str, str] | None = None) -> DataFrame:
    """Hybrid search of the best top, reranked, the first limit for each query; nothing above the threshold: no rows."""
    return rerank(hybrid_search(index, cells, chunks, queries, top, fixed=fixed), queries, dim, threshold, limit=limit)


def api_rows(hits: DataFrame, max_results: int | Column = 5, cap: int = 10, default_version: str | None = None, id_column: str = "chunk_id") -> DataFrame:
    """Result rows: content, target_version, document_type, source_url, relevance_score, extra_meta. max_results: for
    all queries, or a column with each query's own."""
    most = max_results if isinstance(max_results, Column) else F.lit(max_results)
    extra = F.struct("document_title", "section_title", F.col(id_column).cast("string").alias("id"), "rrf_score", "rerank_score", "rerank_failed")
    return hits.filter(F.col("final_rank") <= F.least(F.coalesce(most, F.lit(cap)), F.lit(cap))).select(
        "query_id",
        "final_rank",
        F.coalesce("content", F.lit("")).alias("content"),
        F.coalesce("target_version", F.lit(default_version)).alias("target_version"),
        F.coalesce("category", F.lit("unknown")).alias("document_type"),
        F.coalesce("source_url", F.lit("")).alias("source_url"),
        F.coalesce("similarity", F.lit(0.0)).alias("relevance_score"),
        extra.alias("extra_meta"),
    )
