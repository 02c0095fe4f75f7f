"""Documents to chunks, and reports about chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.chunker import chunks
from inkwell.functions.markdown import word_count

DEFAULT_CONTEXT, JOINER = "Main", " > "


def chunk_documents(documents: DataFrame, id_column: str = "doc_id", text_column: str = "content", chunk_size: int = 1500, overlap: int = 200, errors: bool = False) -> DataFrame:
    """id, chunk_index (from 0), h1..h4, content; one row per chunk. Documents are never gathered: rows multiply where
    they are read. errors: a document that can't be cut doesn't end the job; it has one row without chunk_index, and what
    went wrong in a further column error, which is null in all other rows."""

    def cut(text: str | None) -> tuple[list, str | None]:
        try:
            return chunks(text, chunk_size, overlap), None
        except Exception as e:  # noqa: BLE001  one bad document must not end the job
            if not errors:
                raise
            return [], f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                rows = []
                for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    found, error = cut(text)
                    rows += [(i, k, h, c, None) for k, (h, c) in enumerate(found)] + ([(i, None, {}, None, error)] if error else [])
                columns = [pa.array([r[0] for r in rows], b.schema.field(0).type), pa.array([r[1] for r in rows], pa.int32())]
                columns += [pa.array([r[2].get(n) for r in rows], pa.string()) for n in (1, 2, 3, 4)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([r[3] for r in rows], pa.string()), pa.array([r[4] for r in rows], pa.string())], [id_column, "chunk_index", "h1", "h2", "h3", "h4", "content", "error"])

    kind = documents.schema[id_column].dataType.simpleString()
    made = documents.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, chunk_index int, h1 string, h2 string, h3 string, h4 string, content string, error string")
    return (made if errors else made.drop("error")).withColumn("header_context", header_context("h1", "h2", "h3", "h4")).withColumn("word_count", word_count("content"))


def header_context(*headers: Column | str) -> Column:
    """The headers that are there, joined; Main if there are none."""
    there = F.filter(F.array(*headers), lambda h: h.isNotNull())
    return F.when(F.size(there) > 0, F.array_join(there, JOINER)).otherwise(F.lit(DEFAULT_CONTEXT))


def chunk_quality(chunks: DataFrame, chunk_size: int = 1500) -> DataFrame:
    """One row: chunks, with an odd number of fence marks, longer than chunk_size without a fence, without header, with
    injected Document: or Context: lines."""
    fences = F.regexp_count("content", F.lit("(?m)^[ \t]*```"))
    return chunks.agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.count_if(fences % 2 != 0).alias("odd_fences"),
        F.count_if((F.length("content") > chunk_size) & (fences == 0)).alias("too_long"),
        F.count_if(F.col("header_context") == DEFAULT_CONTEXT).alias("without_header"),
        F.count_if(F.rlike("content", F.lit("(?m)^(Document|Context):"))).alias("injected"),
    )
