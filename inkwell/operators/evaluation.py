"""Search quality: relevance of hits, ranks, measures and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyword_relevance(content: Column | str, keywords: Column | str) -> Column:
    """Does the content hold any of the keywords, whatever the case?"""
    content = F.lower(F.col(content) if isinstance(content, str) else content)
    keywords = F.col(keywords) if isinstance(keywords, str) else keywords
    return F.coalesce(F.exists(keywords, lambda k: F.contains(content, F.lower(k))), F.lit(False))


def id_relevance(hit: Column | str, expected: Column | str) -> Column:
    hit, expected = (F.col(c) if isinstance(c, str) else c for c in (hit, expected))
    return F.coalesce(F.array_contains(expected, hit), F.lit(False))


def judge(golden: DataFrame, hits: DataFrame, depth: int = 5) -> DataFrame:
    """golden (query_id, expected_keywords, ...) with the first relevant rank among its hits (query_id, rank, content)
    up to depth, 0 if there is none, and the number of hits that are not relevant."""
    held = golden.select("query_id", "expected_keywords").join(hits.filter(F.col("rank") <= depth), "query_id")
    seen = held.withColumn("relevant", keyword_relevance("content", "expected_keywords"))
    ranks = seen.groupBy("query_id").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("__first"), F.count_if(~F.col("relevant")).alias("__wrong"))
    out = golden.join(ranks, "query_id", "left")
    return out.withColumns({"first_rank": F.coalesce("__first", F.lit(0)), "false_positives": F.coalesce("__wrong", F.lit(0).cast("long"))}).drop("__first", "__wrong")


def _measures(depths: Sequence[int]) -> list[Column]:
    r = F.col("first_rank")
    hit = lambda k: (F.avg(F.when((r >= 1) & (r <= k), 1.0).otherwise(0.0)) * 100).alias(f"hit_at_{k}")
    return [F.count(F.lit(1)).alias("queries"), F.avg(F.when(r > 0, 1.0 / r).otherwise(0.0)).alias("mrr"), *(hit(k) for k in depths)]


def measures(judged: DataFrame, by: Sequence[str] = (), depths: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """Queries, MRR and Hit@k in percent; one row, or one for each group. Precision@1 is Hit@1."""
    return judged.groupBy(*by).agg(*_measures(depths))


def gate(measured: DataFrame, least_mrr: float = 0.75, least_hit: float = 90.0) -> DataFrame:
    """measured with passed: both targets are met."""
    return measured.withColumn("passed", (F.col("mrr") >= least_mrr) & (F.col("hit_at_3") >= least_hit))


def failures(judged: DataFrame) -> DataFrame:
    return judged.filter("first_rank = 0")
