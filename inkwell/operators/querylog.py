"""Query-log records and what they tell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def log_records(queries: DataFrame, hits: DataFrame, tool: str = "search", at: Column | None = None, params: Sequence[str] = ()) -> DataFrame:
    """One record per query (query_id, query): timestamp, level, message, event, tool, query, params, results_count, the
    top three with title and score, and the ids of its hits (query_id, rank, id, title, score; at most a few per query)
    in order. at is the time of the call (now, if not given); params names columns of queries, kept as text in a map."""
    row = F.struct("rank", F.coalesce("title", F.lit("No Title")).alias("title"), F.coalesce("score", F.lit(0.0)).alias("score"), F.col("id").cast("string").alias("id"))
    found = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("__hits"))
    rows = queries.join(found, "query_id", "left").withColumn("__hits", F.coalesce("__hits", F.array().cast("array<struct<rank:int,title:string,score:double,id:string>>")))
    top = F.transform(F.slice("__hits", 1, 3), lambda h: F.struct(h["title"].alias("title"), h["score"].alias("score")))
    stamp = F.date_format(F.current_timestamp() if at is None else at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    message = F.concat(F.lit(f"Tool {tool} called with query: "), F.coalesce("query", F.lit("")))
    texts = lambda values: F.array(*values).cast("array<string>")
    given = F.map_from_arrays(texts([F.lit(p) for p in params]), texts([F.col(p) for p in params]))
    head = (stamp.alias("timestamp"), F.lit("INFO").alias("level"), message.alias("message"), F.lit("tool_call").alias("event"), F.lit(tool).alias("tool"))
    return rows.select("query_id", *head, "query", given.alias("params"), F.size("__hits").alias("results_count"), top.alias("top_results"), F.transform("__hits", lambda h: h["id"]).alias("chunk_ids"))


def flag_repeats(queries: DataFrame, session: str = "session", query: str = "query", order: str = "ts", key: Sequence[str] = ()) -> DataFrame:
    """queries with repeated: the same text came before in the session. Of rows that tie in order the one with the smallest
    key is first; rows that tie in all of it are first together. The first of each text is found by partial aggregates and
    joined back, so a text that fills half of a session gathers in no task."""
    place = F.struct(F.col(order).isNotNull(), F.col(order), *key)
    first = queries.groupBy(F.col(session).alias("__session"), F.col(query).alias("__query")).agg(F.min(place).alias("__first"))
    both = queries.join(first, F.col(session).eqNullSafe(F.col("__session")) & F.col(query).eqNullSafe(F.col("__query")))
    return both.withColumn("repeated", place > F.col("__first")).drop("__session", "__query", "__first")
