"""Discovery of pages over a snapshot's links, and what follows from it."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from inkwell.functions.urls import is_target_url
from inkwell.sources.files import work_folder

#: Edges in a bucket, as far as there are partitions enough.
BUCKET_ROWS = 100_000


def discover(edges: DataFrame, seeds: Sequence[str] | DataFrame, base_prefix: str | None = None, exclusions: Sequence[str] = ()) -> DataFrame:
    """url, depth of every page that links (src, dst) reach from the seeds, each once, at its smallest depth.

    Only targets that begin with the base and no exclusion are followed (None: all). The edges are written once, bucketed
    by source, and what has been visited is a table bucketed by URL, to which each round adds the pages it found. So a
    round shuffles its frontier and the targets found, never edges or visited pages, and starts from tables. There are as many
    buckets as the edges need: each round opens a file of every bucket and earlier round."""
    spark = edges.sparkSession
    links = edges.select("src", "dst").filter(F.col("dst").isNotNull())
    if base_prefix is not None:
        links = links.filter(is_target_url("dst", base_prefix, exclusions))
    start = seeds.toDF("url") if isinstance(seeds, DataFrame) else spark.createDataFrame([(s,) for s in seeds], "url string")
    folder, name = work_folder(spark), f"discover_{uuid.uuid4().hex}"
    links.distinct().write.parquet(f"{folder}/given")
    given = spark.read.schema(links.schema).parquet(f"{folder}/given")
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(spark.sparkContext.defaultParallelism, -(-given.count() // BUCKET_ROWS)))

    def add(rows: DataFrame, table: str, key: str) -> int:
        # dealt as the buckets are, each is written by one task
        seen = Observation()
        dealt = rows.observe(seen, F.count(F.lit(1)).alias("n")).repartition(buckets, key)
        dealt.write.mode("append").format("parquet").option("path", f"{folder}/{table}").bucketBy(buckets, key).sortBy(key).saveAsTable(f"{name}_{table}")
        return seen.get["n"]

    add(given, "edges", "src")
    add(start.distinct().withColumn("depth", F.lit(0)), "visited", "url")
    known, depth = spark.table(f"{name}_edges"), 0
    while True:
        depth += 1
        visited = spark.table(f"{name}_visited")
        frontier = visited.filter(F.col("depth") == depth - 1)
        near = frontier.join(known, frontier.url == known.src).select(F.col("dst").alias("url")).distinct()
        found = add(near.join(visited, "url", "left_anti").withColumn("depth", F.lit(depth)), "visited", "url")
        spark.catalog.refreshTable(f"{name}_visited")
        if not found:
            break
    out = spark.read.schema("url string, depth int").parquet(f"{folder}/visited")
    for table in ("edges", "visited"):
        spark.sql(f"DROP TABLE {name}_{table}")  # of files at a path of their own, which stay
    return out


def crawl_stats(visited: DataFrame, pages: DataFrame) -> DataFrame:
    """Of the visited URLs, how many the snapshot holds and how many it lacks: one row, ok and failed."""
    held = visited.select("url").join(pages.select("url").distinct().withColumn("held", F.lit(True)), "url", "left")
    return held.agg(F.count_if(F.col("held")).alias("ok"), F.count_if(F.col("held").isNull()).alias("failed"))


def keep_visited(documents: DataFrame, visited: DataFrame, url: str = "source_url") -> DataFrame:
    """Documents whose page was visited in this run."""
    return documents.join(visited.select(F.col("url").alias(url)), url, "left_semi")


def dedupe_by_content(pages: DataFrame, content: str, order: str) -> DataFrame:
    """One row per content, the first in order; rows whose order is null come last. Digests are grouped before rows are
    looked up, so that many copies of one content don't meet in a window."""
    hashed = pages.withColumn("content_hash", F.sha2(F.coalesce(F.col(content), F.lit("")), 256))
    first = hashed.groupBy("content_hash").agg(F.min(order).alias("__first")).withColumnRenamed("content_hash", "__hash")
    kept = hashed.join(first, (hashed.content_hash == F.col("__hash")) & hashed[order].eqNullSafe(F.col("__first")), "left_semi")
    return kept.dropDuplicates(["content_hash"])


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the largest order for each key. Rows are compared where they are, so a frequent key gathers none."""
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(F.lit(1), *order)).alias("__last"))
    return last.select("__last.*")
