"""The three workloads end to end: pages to Markdown, Markdown to tables, queries to answers and measures."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.encoders import HashingEncoder
from inkwell.functions.markdown import with_front_matter
from inkwell.functions.urls import file_path, normalize_url
from inkwell.operators.chunking import chunk_documents
from inkwell.operators.html import convert_pages
from inkwell.operators.ingest import ACTIVE, build_chunks, build_documents, build_sections, last_wins, withheld
from inkwell.operators.rerank import full_search
from inkwell.operators.text_index import TextIndex, create_index, facet_key
from inkwell.operators.vector_search import VectorCells, embed, vector_cells
from inkwell.sources.files import work_folder


def pages_to_markdown(pages: DataFrame, source: str, target_version: str, collected_at: Column, strip_prefix: str = "", seed_url: str = "", selectors: Sequence[str] = ()) -> DataFrame:
    """source, target_version, url, rel_path, title, content (with front matter), error for pages (url, html)."""
    made = convert_pages(pages.select("url", "html"), selectors).withColumn("url", normalize_url("url"))
    text = with_front_matter("markdown", "url", F.lit(target_version), collected_at, title="title")
    return made.select(F.lit(source).alias("source"), F.lit(target_version).alias("target_version"), "url", file_path("url", ".md", strip_prefix, seed_url).alias("rel_path"), "title", text.alias("content"), "error")


def ingest(files: DataFrame, at: Column, encoder: Callable[[], object] | None = None, chunk_size: int = 1500, overlap: int = 200, low: int = 128) -> dict[str, DataFrame]:
    """The tables of files (source_path, content, default_version, default_category, seq), and quarantine. Chunks are
    embedded if an encoder is given. A document that can't be cut or of which a chunk can't be encoded is withheld from all
    tables and stands in quarantine; the others go on. Documents and chunks are written to a work folder, so that no text is cut or
    encoded twice."""
    spark = files.sparkSession
    path = work_folder(spark)
    last_wins(build_documents(files, at)).write.parquet(f"{path}/documents")
    documents = spark.read.parquet(f"{path}/documents")
    pieces = chunk_documents(documents.select(F.col("id").alias("document_id"), "body"), "document_id", "body", chunk_size, overlap, errors=True)
    if encoder is not None:
        pieces = embed(pieces, encoder, "content", low, errors=True)
    pieces.write.parquet(f"{path}/pieces")
    documents, good, lost = withheld(documents, spark.read.schema(pieces.schema).parquet(f"{path}/pieces"))
    sections = build_sections(good)
    return {"documents": documents.drop("body", "seq"), "sections": sections, "chunks": build_chunks(good, sections), "quarantine": lost}


#: What queries may filter by, and the status that hits must have.
FACETS = ("status", "target_version", "category")


def with_facets(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks by chunk_id with title, URL and facets of their documents."""
    docs = documents.select(F.col("id").alias("document_id"), F.col("title").alias("document_title"), "source_url", *FACETS)
    return chunks.withColumnRenamed("id", "chunk_id").join(docs, "document_id")


def index_chunks(chunks: DataFrame, path: str) -> tuple[TextIndex, VectorCells]:
    """The text index under path and the vector cells of chunks (chunk_id, content, section_title, embedding, facets)."""
    return create_index(chunks, path, FACETS), vector_cells(chunks.withColumn("facet", facet_key(FACETS)), facet="facet")


def answers(tables: dict[str, DataFrame], queries: DataFrame, encoder: Callable[[], object], low: int = 128, limit: int = 5, top: int = 50, threshold: float = 0.3, version: str | None = None, category: str | None = None) -> DataFrame:
    """The best limit hits for each query (query_id, query, and target_version and category if queries have filters of
    their own: null, empty or All is any) over tables of embedded chunks. version and category hold for all queries. The
    tables are read more than once, so they are best written before."""
    chunks = with_facets(tables["chunks"], tables["documents"])
    index, cells = index_chunks(chunks, work_folder(queries.sparkSession))
    own = [c for c in FACETS if c in queries.columns]
    asked = embed(queries, encoder, "query", low).select("query_id", "query", *own, F.col("embedding").alias("vector"), F.col("multi_vector_low_dim").alias("multi"))
    path = f"{work_folder(queries.sparkSession)}/queries"
    asked.write.parquet(path)
    fixed = {"status": ACTIVE} | {c: v for c, v in (("target_version", version), ("category", category)) if v and v != "All"}
    return full_search(index, cells, chunks.drop("embedding", "status"), queries.sparkSession.read.schema(asked.schema).parquet(path), limit, top, low, threshold, fixed)


def default_encoder(dim: int = 64) -> Callable[[], HashingEncoder]:
    return lambda: HashingEncoder(dim)
