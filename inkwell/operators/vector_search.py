"""Embedding jobs and exact vector search in blocks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.vectors import low_dim, pack
from inkwell.operators.bm25 import top_k
from inkwell.sources.files import work_folder

#: Vectors in a packed row and pivots at most; bytes of vectors on a shelf, and numbers of a matrix that is made at a time.
PIECE, MOST_PIVOTS, SHELF_BYTES, BLOCK = 4096, 1024, 8 << 20, 1 << 21


def embed(rows: DataFrame, encoder: Callable[[], object], text_column: str = "content", low: int = 128, kind: str = "int8", batch: int = 64, errors: bool = False) -> DataFrame:
    """Adds embedding (array<float>), multi_vector_low_dim (packed) and token_count, in place of columns of these names.
    encoder makes the encoder, once in each Python worker; it gets batch texts at a time. errors: a text that can't be
    encoded doesn't end the job; where a batch fails its texts are encoded one by one, and what went wrong stands in a column
    error (where rows have one, what it held stays, and such rows are not encoded)."""
    made: dict[str, object] = {}

    def encoded(texts: list) -> list[tuple]:
        try:
            return [(dense.astype(np.float32), pack(low_dim(tokens, low), kind), n, None) for dense, tokens, n in made["encoder"].encode(texts)]
        except Exception as e:  # noqa: BLE001  one bad text must not end the job
            if not errors:
                raise
            return [(None, None, None, f"{type(e).__name__}: {e}")] if len(texts) == 1 else [r for t in texts for r in encoded([t])]

    @F.arrow_udf("embedding array<float>, multi_vector_low_dim binary, token_count int, error string")
    def run(texts: pa.Array, before: pa.Array) -> pa.Array:
        if "encoder" not in made:
            made["encoder"] = encoder()
        kinds = {"embedding": pa.list_(pa.float32()), "multi_vector_low_dim": pa.binary(), "token_count": pa.int32(), "error": pa.string()}
        parts = [pa.array([], pa.struct(list(kinds.items())))]
        for at in range(0, len(texts), batch):  # only so many are Python objects at a time
            out = [(None, None, None, e) for e in before.slice(at, batch).to_pylist()]
            todo, some = [i for i, r in enumerate(out) if r[3] is None], texts.slice(at, batch).to_pylist()
            for i, row in zip(todo, encoded([some[i] for i in todo]) if todo else [], strict=True):
                out[i] = row
            parts.append(pa.StructArray.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds.values())], list(kinds)))
        return pa.concat_arrays(parts)

    made_here = ("embedding", "multi_vector_low_dim", "token_count", *(["error"] if errors else []))
    before = F.col("error") if errors and "error" in rows.columns else F.lit(None).cast("string")
    # else a filter on what is made is pushed below, and every text encoded twice, in two workers for each core
    return rows.withColumn("__e", run.asNondeterministic()(F.col(text_column), before)).select(*(F.col(f"`{c}`") for c in rows.columns if c not in made_here), *(F.col(f"__e.{c}") for c in made_here))


def embed_new(rows: DataFrame, known: DataFrame, encoder: Callable[[], object], text_column: str = "content", low: int = 128, kind: str = "int8") -> DataFrame:
    """digest, embedding, multi_vector_low_dim, token_count of the texts in rows that known (the same columns) lacks, each
    text once: what a table of vectors by content digest has to be given. Written once, it serves all rows by with_vectors."""
    texts = rows.filter(F.col(text_column).isNotNull()).select(text_digest(text_column).alias("digest"), F.col(text_column).alias("text"))
    new = texts.join(known.select("digest"), "digest", "left_anti").groupBy("digest").agg(F.first("text").alias("text"))
    return embed(new, encoder, "text", low, kind).drop("text")


def with_vectors(rows: DataFrame, known: DataFrame, text_column: str = "content") -> DataFrame:
    """rows with what known (digest, embedding, multi_vector_low_dim, token_count) has for their texts."""
    keyed = rows.withColumn("__digest", text_digest(text_column))
    return keyed.join(known.withColumnRenamed("digest", "__digest"), "__digest", "left").drop("__digest")


def text_digest(text_column: str) -> Column:
    return F.sha2(text_column, 256)


@dataclass(frozen=True)
class VectorCells:
    """Vectors packed by cell: rows (dim, facet, cell, ids, units), and for each cell its number of vectors and the largest
    angle to its pivot."""

    pieces: DataFrame
    pivots: dict[int, np.ndarray]
    cells: dict[int, np.ndarray]
    id_column: str
    id_type: str


def _units(lists: pa.ListArray, dim: int) -> np.ndarray:
    """Rows at length one; those of length zero stay zero."""
    m = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), dim)
    length = np.sqrt(np.einsum("ij,ij->i", m, m))
    return m / np.where(length > 0, length, 1)[:, None]


def vector_cells(vectors: DataFrame, id_column: str = "chunk_id", vector_column: str = "embedding", facet: str | None = None) -> VectorCells:
    """Vectors dealt to the nearest of about sqrt(n / facets) pivots, which are some of them, separately for each facet (a
    column of whole numbers), and packed in rows of at most PIECE vectors, so that there are about sqrt(n facets) cells. A
    vector is shuffled once; a crowded cell is cut over several tasks and rows."""
    held = vectors.filter(F.col(vector_column).isNotNull())
    rows = held.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("v"), (F.col(facet) if facet else F.lit(0)).cast("long").alias("facet"), F.size(vector_column).alias("dim"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("facet").alias("facets")).first()
    wanted = max(1, min(MOST_PIVOTS, math.isqrt(size["n"] // max(1, size["facets"]))))
    pivots: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("id"), "id").limit(wanted).select("v").collect():  # at most MOST_PIVOTS
        v = np.array(r["v"])
        if len(v) and v.any():
            pivots.setdefault(len(v), []).append(v / np.sqrt(v @ v))
    matrix = {d: np.stack(m) for d, m in pivots.items()}
    kind = rows.schema["id"].dataType.simpleString()

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == dim))
                for at in range(0, part.num_rows, PIECE):
                    some = part.slice(at, PIECE)
                    unit = _units(some.column("v"), dim)
                    cell, angle = np.full(len(unit), -1), np.full(len(unit), np.pi)
                    if dim in matrix and dim:
                        near = unit @ matrix[dim].T
                        cell = np.where(unit.any(axis=1), near.argmax(axis=1), -1)
                        angle = np.arccos(np.clip(near.max(axis=1), -1, 1))
                    packed = pa.array([u.tobytes() for u in unit], pa.binary())
                    yield pa.RecordBatch.from_arrays([some.column("dim"), some.column("facet"), pa.array(cell, pa.int32()), some.column("id"), packed, pa.array(angle)], ["dim", "facet", "cell", "id", "unit", "angle"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in ("dim", "facet", "cell")]) if b.num_rows else np.empty((3, 0), int)
            cuts = [0, *(np.flatnonzero((np.diff(keys, axis=1) != 0).any(axis=0)) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts, cuts[1:], strict=False):
                step = max(1, min(PIECE, SHELF_BYTES // 4 // max(8, 8 * int(keys[0, i]))))
                for at in range(i, j, step):
                    part = b.slice(at, min(step, j - at))
                    ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("id"))
                    units = b"".join(part.column("unit").to_pylist())
                    yield pa.RecordBatch.from_arrays([*(part.column(c).slice(0, 1) for c in ("dim", "facet", "cell")), ids, pa.array([units], pa.binary()), pa.array([part.num_rows], pa.int64()), pa.array([max(part.column("angle").to_numpy())])], ["dim", "facet", "cell", "ids", "units", "n", "angle"])

    placed = rows.mapInArrow(dealt, f"dim int, facet long, cell int, id {kind}, unit binary, angle double")
    met = placed.hint("rebalance", "dim", "facet", "cell").sortWithinPartitions("dim", "facet", "cell", "id")
    path = work_folder(vectors.sparkSession)
    met.mapInArrow(packed, f"dim int, facet long, cell int, ids array<{kind}>, units binary, n long, angle double").write.parquet(f"{path}/cells")
    pieces = vectors.sparkSession.read.parquet(f"{path}/cells")
    stats: dict[int, list] = {}
    for r in pieces.groupBy("dim", "facet", "cell").agg(F.sum("n").alias("n"), F.max("angle").alias("angle")).orderBy("dim", "facet", "cell").collect():
        stats.setdefault(r["dim"], []).append((r["facet"], r["cell"], r["n"], r["angle"]))
    return VectorCells(pieces, matrix, {d: np.array(c, dtype=[("facet", "i8"), ("cell", "i4"), ("n", "i8"), ("angle", "f8")]) for d, c in stats.items()}, id_column, kind)


def _shelved(cells: dict[int, np.ndarray], least: int) -> tuple[dict[int, np.ndarray], int]:
    """The cells of each dimension with their number, first shelf and how many shelves they are on, and the number of
    shelves: neighbours share one until it is full, a crowded cell has several. There are at least about so many."""
    out, number, shelf = {}, 0, 0
    for dim, known in cells.items():
        full = max(1, min(SHELF_BYTES // max(8, 8 * dim), -(-int(known["n"].sum()) // least)))
        rows, filled = [], 0
        for n in known["n"].tolist():
            several = -(-n // full)
            if filled and filled + n > full:
                shelf, filled = shelf + 1, 0
            rows.append((number, shelf, several))
            number, shelf, filled = number + 1, shelf + several - 1, filled + n if several == 1 else full
        shelf += 1
        more = np.array(rows, dtype=[("number", "i4"), ("shelf", "i4"), ("shelves", "i4")])
        made = np.empty(len(known), dtype=known.dtype.descr + more.dtype.descr)
        for c in made.dtype.names:
            made[c] = (known if c in known.dtype.names else more)[c]
        out[dim] = made
    return out, max(1, shelf)


def cell_search(held: VectorCells, queries: DataFrame, k: int = 50, digits: int | None = None, filters: DataFrame | None = None, visits: list | None = None) -> DataFrame:
    """query_id, id, similarity, rank: the k vectors of largest cosine for each query (query_id, vector); a zero vector has
    similarity null and comes last; a query meets vectors of its own dimension.

    First each query visits the cells nearest to it that hold k vectors together, which gives a limit; then all cells in
    which, by the angle to their pivot and their largest angle, something may be as near as that. Cells stand on shelves of
    SHELF_BYTES. A task holds one shelf, past which the queries that visit it are streamed; a query goes once to a shelf, and
    only its best k there leave it. So pairs are never rows, and what a task holds does not grow with vectors or queries.

    filters: (filter, facet), the facets that the queries' column filter admits; other cells are not visited. visits: gets
    the rows (query_id, cell) of both rounds."""
    spark, pivots, id_column = queries.sparkSession, held.pivots, held.id_column
    cells, n_shelves = _shelved(held.cells, 2 * spark.sparkContext.defaultParallelism)
    qkind = queries.schema["query_id"].dataType.simpleString()
    rows = queries.filter("vector IS NOT NULL").select("query_id", F.col("vector").cast("array<double>").alias("vector"), F.size("vector").alias("dim"), *(["filter"] if filters is not None else []))
    if filters is None:
        rows = rows.withColumn("facets", F.lit(None).cast("array<long>"))
    else:
        admitted = filters.groupBy("filter").agg(F.collect_set("facet").alias("facets"))  # facets are few
        rows = rows.join(admitted, "filter", "left").withColumn("facets", F.coalesce("facets", F.array().cast("array<long>"))).drop("filter")
    folder = work_folder(spark)
    slack = 1e-9 if digits is None else 2.0 * 10.0**-digits

    def chosen_cells(part: pa.RecordBatch, known: np.ndarray, unit: np.ndarray, second: bool) -> np.ndarray:
        """Which of the known cells each query visits."""
        facets, limits = part.column("facets").to_pylist(), part.column("kth").to_numpy(zero_copy_only=False)
        distinct = {f: np.ones(len(known), bool) if f is None else np.isin(known["facet"], np.array(f, np.int64)) for f in {None if f is None else tuple(f) for f in facets}}
        open_ = np.stack([distinct[None if f is None else tuple(f)] for f in facets])
        # of cells without a pivot nothing is known, nor for a query of length zero
        upper = np.ones((len(unit), len(known)))
        dim = unit.shape[1]
        if dim in pivots:
            to = np.arccos(np.clip(unit @ pivots[dim].T, -1, 1))
            upper = np.cos(np.maximum(0, to[:, np.maximum(known["cell"], 0)] - known["angle"])) + 1e-7  # arccos loses half its digits near 1
            upper[:, known["cell"] < 0] = -np.inf
        upper[~unit.any(axis=1)] = np.inf
        ranked = np.where(open_, upper, -np.inf)
        order = np.argsort(-ranked, axis=1, kind="stable")
        n = np.where(open_ & (known["cell"] >= 0), known["n"], 0)
        enough = (np.cumsum(np.take_along_axis(n, order, axis=1), axis=1) < k).sum(axis=1) + 1
        chosen = np.zeros(open_.shape, bool)
        np.put_along_axis(chosen, order, np.arange(len(known)) < enough[:, None], axis=1)
        if second:
            chosen = ~chosen & (np.isnan(limits)[:, None] | (upper >= limits[:, None] - slack))
        return chosen & open_

    def visiting(second: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                dims = b.column("dim").to_numpy()
                for dim in np.unique(dims).tolist():
                    known = cells.get(dim)
                    if known is None:
                        continue
                    mine = b.filter(pa.array(dims == dim))
                    step = max(1, BLOCK // 4 // len(known))
                    for i in range(0, mine.num_rows, step):
                        part = mine.slice(i, step)
                        unit = _units(part.column("vector"), dim)
                        query, cell = np.nonzero(chosen_cells(part, known, unit, second))
                        times = known["shelves"][cell]
                        query, cell = np.repeat(query, times), np.repeat(cell, times)
                        shelf = known["shelf"][cell] + np.arange(len(cell)) - np.repeat(np.cumsum(times) - times, times)
                        order = np.lexsort((shelf, query))
                        query, cell, shelf = query[order], cell[order], shelf[order]
                        starts = np.flatnonzero(np.concatenate([[True], (np.diff(query) != 0) | (np.diff(shelf) != 0)])) if len(query) else np.empty(0, int)
                        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(query)), pa.int32()), pa.array(known["number"][cell], pa.int32()))
                        who = pa.array(query[starts], pa.int64())
                        units = pa.array([u.tobytes() for u in unit], pa.binary()).take(who)
                        yield pa.RecordBatch.from_arrays([pa.array(shelf[starts], pa.int32()), pa.array(np.full(len(who), dim), pa.int32()), part.column("query_id").take(who), units, part.column("kth").take(who), lists], ["shelf", "dim", "query_id", "unit", "kth", "cells"])

        return run

    def nearest(q: np.ndarray, limits: np.ndarray, wanted: list, v: np.ndarray, keys: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each query's best k vectors in its cells: the query, the vector and the score, which is -2 where it is null."""
        places, at = np.unique(numbers, return_inverse=True)
        asked = np.zeros((len(q), len(places)), bool)
        for i, w in enumerate(wanted):
            asked[i, np.searchsorted(places, w)] = True
        score = q @ v.T
        score[~q.any(axis=1)] = -2
        score[:, ~v.any(axis=1)] = -2
        if not asked.all():
            score[~asked[:, at]] = -np.inf
        least = np.where(np.isnan(limits), -2, limits - slack)[:, None]
        near = score >= least
        if near.sum() > 8 * k * len(q) and len(v) > k:
            near &= score >= np.partition(score, -k, axis=1)[:, -k][:, None] - slack
        who, what = np.nonzero(near)
        how = score[who, what]
        if digits is not None:
            how = np.round(how, digits)
        order = np.lexsort((keys[what], -how, who))
        who, what, how = who[order], what[order], how[order]
        first = np.searchsorted(who, np.arange(len(q)))
        kept = np.arange(len(who)) - first[who] < k
        return who[kept], what[kept], how[kept]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf, pieces, ready = None, [], None
        for b in batches:
            of = b.column("shelf").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                if of[i] != shelf:
                    shelf, pieces, ready = of[i], [], None
                part = b.slice(i, j - i)
                dim = part.column("dim")[0].as_py()
                n = len(part) - part.column("number").null_count  # pieces come first
                for r in range(n):
                    ids = part.column("ids").slice(r, 1).flatten()
                    pieces.append((ids, np.frombuffer(part.column("units")[r].as_py()).reshape(len(ids), dim), part.column("number")[r].as_py()))
                if n == len(part) or not pieces:
                    continue
                if ready is None:
                    ids = pa.concat_arrays([p[0] for p in pieces])
                    ready = ids, np.concatenate([p[1] for p in pieces]), ids.to_numpy(zero_copy_only=False), np.repeat([p[2] for p in pieces], [len(p[0]) for p in pieces])
                    pieces = [()]
                ids, v, keys, numbers = ready
                step = max(1, BLOCK // len(v))
                for at in range(n, len(part), step):
                    some = part.slice(at, step)
                    q = np.frombuffer(b"".join(some.column("unit").to_pylist())).reshape(len(some), dim)
                    who, what, how = nearest(q, some.column("kth").to_numpy(zero_copy_only=False).astype(float), some.column("cells").to_pylist(), v, keys, numbers)
                    yield pa.RecordBatch.from_arrays([some.column("query_id").take(pa.array(who)), ids.take(pa.array(what)), pa.array(how, mask=how < -1.5)], ["query_id", id_column, "similarity"])

    places = [(dim, *r) for dim, known in cells.items() for r in known[["facet", "cell", "number", "shelf", "shelves"]].tolist()]
    shelves = spark.createDataFrame(places, "dim int, facet long, cell int, number int, shelf int, shelves int")
    placed = held.pieces.join(F.broadcast(shelves), ["dim", "facet", "cell"])  # a row for each cell
    placed = placed.select((F.col("shelf") + F.pmod(F.xxhash64("ids"), F.col("shelves"))).cast("int").alias("shelf"), "dim", "number", "ids", "units")

    def met(asked: DataFrame, second: bool) -> DataFrame:
        found = asked.mapInArrow(visiting(second), f"shelf int, dim int, query_id {qkind}, unit binary, kth double, cells array<int>")
        if visits is not None:
            visits.append(found.select("query_id", F.explode("cells").alias("cell")))
        both = placed.unionByName(found, allowMissingColumns=True)
        shelved = both.repartitionById(n_shelves, "shelf").sortWithinPartitions("shelf", F.col("number").isNull())
        return shelved.mapInArrow(best, f"query_id {qkind}, {id_column} {held.id_type}, similarity double")

    order = [F.col("similarity").desc_nulls_last(), F.col(id_column)]
    met(rows.withColumn("kth", F.lit(None).cast("double")), False).write.parquet(f"{folder}/first")
    first = spark.read.parquet(f"{folder}/first")
    kth = top_k(first, "query_id", order, k).groupBy("query_id").agg(F.when(F.count("similarity") >= k, F.min("similarity")).alias("kth"))
    more = met(rows.join(kth, "query_id", "left").select("query_id", "vector", "dim", "facets", "kth"), True)
    return top_k(first.unionByName(more), "query_id", order, k)


def vector_search(vectors: DataFrame, queries: DataFrame, k: int = 50, id_column: str = "chunk_id", vector_column: str = "embedding", digits: int | None = None, facet: str | None = None, filters: DataFrame | None = None) -> DataFrame:
    """cell_search over vectors that are packed for it."""
    return cell_search(vector_cells(vectors, id_column, vector_column, facet), queries, k, digits, filters)
