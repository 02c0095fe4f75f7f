"""Markdown documents to the tables documents, sections and chunks, and their upkeep.

Identifiers are digests of what identifies a row, so that repeated runs and retried tasks give the same ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions.markdown import file_stem, front_matter_body, front_matter_value
from inkwell.functions.urls import is_listing
from inkwell.operators.chunking import JOINER
from inkwell.operators.linkgraph import latest

KEYS = ["source_path", "target_version"]
ACTIVE, INACTIVE = "Active", "Inactive"


def make_id(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def build_documents(files: DataFrame, at: Column) -> DataFrame:
    """Document rows with their body from files (source_path, content, default_version, default_category): front matter
    first, then the defaults; titles cut to 512 characters. at: the time that created_at gets."""
    value = lambda key: front_matter_value("content", key)
    docs = files.select(
        F.left(F.coalesce(value("title"), file_stem("source_path")), F.lit(512)).alias("title"),
        F.coalesce(value("target_version"), F.col("default_version")).alias("target_version"),
        F.coalesce(value("category"), F.col("default_category")).alias("category"),
        "source_path",
        F.coalesce(value("source_url"), F.lit("")).alias("source_url"),
        F.lit(ACTIVE).alias("status"),
        at.alias("created_at"),
        at.alias("updated_at"),
        front_matter_body("content").alias("body"),
        *([F.col("seq")] if "seq" in files.columns else []),
    )
    return docs.select(make_id(*KEYS).alias("id"), "*")


def last_wins(rows: DataFrame, order: str = "seq") -> DataFrame:
    """Of rows with the same path and version, the one that comes last."""
    return latest(rows, KEYS, [order])


def build_sections(chunks: DataFrame) -> DataFrame:
    """Section rows from chunks (document_id, header_context, chunk_index): one per context of a document, in order of
    first appearance, with the number of its parts as level; titles cut to 1024 characters."""
    first = chunks.groupBy("document_id", "header_context").agg(F.min("chunk_index").alias("first_index"))
    order = F.row_number().over(Window.partitionBy("document_id").orderBy("first_index", "header_context")) - 1
    return first.select(
        make_id(F.col("document_id").cast("string"), "header_context").alias("id"),
        "document_id",
        F.left("header_context", F.lit(1024)).alias("title"),
        F.size(F.split("header_context", JOINER)).alias("level"),
        order.alias("order"),
        "header_context",
    )


def build_chunks(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """Chunk rows: chunks with their section's id and title, and their place in the document as overlap_index."""
    named = sections.select("document_id", "header_context", F.col("id").alias("section_id"), F.col("title").alias("section_title"))
    return chunks.join(named, ["document_id", "header_context"]).select(make_id(F.col("document_id").cast("string"), F.col("chunk_index").cast("string")).alias("id"), "section_id", "document_id", "content", "section_title", F.col("chunk_index").alias("overlap_index"), *(F.col(c) for c in ("word_count", "token_count", "embedding", "multi_vector_low_dim") if c in chunks.columns))


def upsert(existing: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables with the new documents in place of those with the same path and version, sections and chunks too."""
    gone = existing["documents"].join(new["documents"].select(*KEYS).distinct(), KEYS, "left_semi").select(F.col("id").alias("document_id"))
    rest = {"documents": existing["documents"].join(gone.withColumnRenamed("document_id", "id"), "id", "left_anti")}
    for name in ("sections", "chunks"):
        rest[name] = existing[name].join(gone, "document_id", "left_anti")
    return {name: rest[name].unionByName(new[name]) for name in rest}


def work_list(given: DataFrame, documents: DataFrame, files: DataFrame) -> DataFrame:
    """source_path, target_version, category to ingest: the given files and those of active documents whose file is
    there, listings left out, none twice."""
    there = documents.filter(F.col("status") == ACTIVE).join(files.select("source_path"), "source_path", "left_semi").select(*KEYS, "category")
    mine = given.select(*KEYS, "category").filter(~is_listing("source_path"))
    again = there.filter(~is_listing("source_path")).join(mine, KEYS, "left_anti")
    return mine.unionByName(again).dropDuplicates(KEYS)


def reingest_files(documents: DataFrame, selected: DataFrame, files: DataFrame) -> DataFrame:
    """Files of the selected documents (id) with their stored version and category, ready for build_documents; found
    tells whether the file is there."""
    chosen = documents.join(selected.select("id"), "id", "left_semi").select("id", "source_path", F.col("target_version").alias("default_version"), F.col("category").alias("default_category"))
    return chosen.join(files.select("source_path", "content"), "source_path", "left").withColumn("found", F.col("content").isNotNull())


def quarantine(rows: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Rows without and rows with an error: a bad document doesn't end the run."""
    return rows.filter(F.col(error).isNull()), rows.filter(F.col(error).isNotNull())


def withheld(documents: DataFrame, pieces: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents and chunks of which nothing failed, and a row for each document of which something did: id, source_path,
    target_version, the number of its rows that failed and the first error. One failed chunk withholds its document with
    all its chunks."""
    bad = pieces.filter(F.col("error").isNotNull()).groupBy("document_id").agg(F.count(F.lit(1)).alias("failed_rows"), F.min("error").alias("error"))
    lost = documents.join(bad.withColumnRenamed("document_id", "id"), "id").select("id", *KEYS, "failed_rows", "error")
    good = pieces.join(bad.select("document_id"), "document_id", "left_anti").drop("error")
    return documents.join(bad.select(F.col("document_id").alias("id")), "id", "left_anti"), good, lost


def file_results(documents: DataFrame, chunks: DataFrame, lost: DataFrame) -> DataFrame:
    """source_path, error, n_chunks of every document of a run, kept or withheld: what ingest_summary takes."""
    n = chunks.groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("n_chunks"))
    kept = documents.join(n, "id", "left").select("source_path", F.lit(None).cast("string").alias("error"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))
    return kept.unionByName(lost.select("source_path", "error", F.lit(0).cast("long").alias("n_chunks")))


def key_violations(documents: DataFrame) -> DataFrame:
    """Paths and versions that stand more than once, with their number."""
    return documents.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def ingest_summary(results: DataFrame) -> DataFrame:
    """One row from results (source_path, error, n_chunks): total, successful, failed, chunks."""
    ok = F.col("error").isNull()
    return results.agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"), F.coalesce(F.sum(F.when(ok, F.col("n_chunks"))), F.lit(0)).alias("chunks"))
