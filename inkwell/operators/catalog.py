"""Catalogue queries over documents, sections and chunks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.sources.files import work_folder


def facets(documents: DataFrame) -> DataFrame:
    """kind (version, category) and value: all that stand in documents, sorted."""
    one = lambda kind, c: documents.select(F.lit(kind).alias("kind"), F.col(c).alias("value"))
    return one("category", "category").unionByName(one("version", "target_version")).filter("value IS NOT NULL").distinct().orderBy("kind", "value")


def set_status(documents: DataFrame, selected: DataFrame, status: str, updated_at: Column | None = None) -> DataFrame:
    """documents with this status for the selected ids."""
    marked = documents.join(selected.select("id").distinct().withColumn("__on", F.lit(True)), "id", "left")
    out = marked.withColumn("status", F.when(F.col("__on"), F.lit(status)).otherwise(F.col("status")))
    if updated_at is not None:
        out = out.withColumn("updated_at", F.when(F.col("__on"), updated_at).otherwise(F.col("updated_at")))
    return out.drop("__on")


def list_documents(documents: DataFrame, version: str | None = None, category: str | None = None, status: str | None = None) -> DataFrame:
    """Documents by version, category and status; None, empty and All mean any."""
    for column, value in (("target_version", version), ("category", category), ("status", status)):
        if value and value != "All":
            documents = documents.filter(F.col(column) == value)
    return documents


def search_rows(rows: DataFrame, text: str, fields: Sequence[str]) -> DataFrame:
    """Rows in which every word of text stands in some of the fields, whatever the case."""
    for word in text.split():
        rows = rows.filter(F.greatest(*(F.coalesce(F.contains(F.lower(f), F.lit(word.lower())), F.lit(False)) for f in fields), F.lit(False)))
    return rows


#: Characters of a gram: shorter words can't be looked up. Bytes of text whose grams are taken together, and the most marks
#: of a gram in a row that are made at a time.
GRAM, GRAM_BYTES, MARKS = 3, 2 << 20, 1 << 25


def _gram_pairs(texts: Sequence[pa.Array]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct grams of columns of texts, sorted, and each pair of a gram's place and a row that holds it once, sorted."""
    keys, held = [], []
    for column in texts:
        column = column.fill_null("")
        points = np.frombuffer("".join(column.to_pylist()).encode("utf-32-le"), "<u4").astype(np.int64)
        row = np.repeat(np.arange(len(column)), pc.utf8_length(column).to_numpy())
        inside = row[GRAM - 1 :] == row[: len(row) - GRAM + 1]  # a gram stays in its text
        key = np.zeros(inside.sum(), np.int64)
        for i in range(GRAM):
            key = key << 21 | points[i : len(points) - GRAM + 1 + i][inside]
        keys.append(key)
        held.append(row[GRAM - 1 :][inside])
    coded = pa.array(np.concatenate(keys)).dictionary_encode()
    distinct = coded.dictionary.to_numpy()
    order = np.argsort(distinct)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    n = len(texts[0])
    pair = place[coded.indices.to_numpy()] * n + np.concatenate(held)
    if len(distinct) * n <= MARKS:
        marks = np.zeros(len(distinct) * n, bool)
        marks[pair] = True
        pair = np.flatnonzero(marks)
    else:
        pair = np.unique(pair)
    points = np.stack([distinct[order] >> 21 * i & 0x1FFFFF for i in reversed(range(GRAM))], axis=1)
    text = points.astype("<u4").tobytes().decode("utf-32-le")
    return [text[i : i + GRAM] for i in range(0, len(text), GRAM)], pair // n, pair % n


def write_gram_index(rows: DataFrame, fields: Sequence[str], path: str, id_column: str = "id") -> None:
    """A table of gram and ids: which three characters in a row stand in some of the fields of which rows, whatever the
    case. Rows are taken together up to GRAM_BYTES, so that a gram has one row of ids for each such part and not one for each
    id; they are made once and written, then sorted by gram, so that looking up a word reads few files. A frequent gram is cut
    over several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.cumsum(sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns[1:])) // GRAM_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts, cuts[1:], strict=False):
                grams, which, held = _gram_pairs([c.slice(i, j - i) for c in b.columns[1:]])
                if grams:
                    ids = b.column(0).slice(i, j - i).take(pa.array(held))
                    starts = pa.array(np.searchsorted(which, np.arange(len(grams) + 1)).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(grams), pa.ListArray.from_arrays(starts, ids)], ["gram", "ids"])

    kind, made = rows.schema[id_column].dataType.simpleString(), f"{work_folder(rows.sparkSession)}/grams"
    texts = rows.select(F.col(id_column).alias("id"), *(F.lower(f).alias(f"__{i}") for i, f in enumerate(fields)))
    texts.mapInArrow(run, f"gram string, ids array<{kind}>").write.parquet(made)
    parts = rows.sparkSession.read.schema(f"gram string, ids array<{kind}>").parquet(made)
    parts.repartitionByRange("gram", F.get("ids", F.lit(0))).sortWithinPartitions("gram").write.parquet(path)


def gram_search(rows: DataFrame, index: DataFrame, text: str, fields: Sequence[str], id_column: str = "id") -> DataFrame:
    """The same as search_rows, by an index (gram, ids) of the rows' fields: rows that lack a gram of a word are not looked
    at, the others are verified. Words shorter than a gram don't narrow the rows; with no other words all are scanned."""
    needed = sorted({w[i : i + GRAM] for w in text.lower().split() for i in range(len(w) - GRAM + 1)})
    if not needed:
        return search_rows(rows, text, fields)
    held = index.filter(F.col("gram").isin(needed)).select(F.explode("ids").alias("id"))
    may = held.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(needed)).select(F.col("id").alias(id_column))
    return search_rows(rows.join(may, id_column, "left_semi"), text, fields)


def chunk_catalog(chunks: DataFrame, sections: DataFrame, documents: DataFrame, version: str | None = None, category: str | None = None) -> DataFrame:
    """Chunks with the titles of their section and document."""
    docs = list_documents(documents, version, category).select(F.col("id").alias("document_id"), F.col("title").alias("document_title"), "target_version", "category")
    named = sections.select(F.col("id").alias("section_id"), "document_id").join(docs, "document_id")
    return chunks.drop("document_id").join(named, "section_id")


def document_sections(sections: DataFrame, document_id: str | int) -> DataFrame:
    return sections.filter(F.col("document_id") == document_id).orderBy("order")
