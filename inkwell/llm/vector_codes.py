"""Compression of vectors to one code byte for each part, with codebooks by Ball k-means in exact integers.

A vector's components become integers floor(SCALE * x) and are cut into PARTS equal parts, each with a codebook of its
own. A codebook starts as that part of the vectors with the smallest ids; each round assigns all parts to their nearest
entry (ties to the lower index) and moves the entries to the floored means of their parts. After the rounds all parts
are assigned once more.

The first assignment compares every part with every entry. From then on the parts of an entry are its ball, whose radius
is the largest distance of its parts, made longer by the way that the entry has moved since. Entries further away than
twice the radius can't win a part of the ball; the others are its neighbours, sorted by distance. A part nearer to its
entry than half the way to the first neighbour is in the stable core and is compared with none; the others lie in rings,
bounded by half the distances of the neighbours, and are compared with the neighbours up to their own ring only. All
bounds are compared as integers, with ties inside the ring, so the result is exactly that of comparing everything.

A round is one pass without a shuffle of vectors: a task reads rows, writes them with their new codes, and adds at its end
one row for each entry it met, with the count, the sums and the radius. The rows of sums are read from that table by
their columns alone and added up; what reaches the driver and goes to the tasks are the codebooks, PARTS * ENTRIES
entries whatever the data. A repeated task writes the same rows again.

Defined results: vectors that are null or hold null, NaN or infinite components are dropped. Vectors of each dimension
are a collection with codebooks of their own; a dimension that PARTS doesn't divide is filled up with zeros; rows that
repeat an id are vectors of their own, and as first entries ordered by their components; null ids come last. With fewer
vectors than ENTRIES there are as many entries. Components beyond the range in which all squared distances fit 64 bits
(131,072 at 64 dimensions) count as its end. A sum of errors that no long holds is null. An empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import materialize, slices

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Neighbours that a ring's parts are compared with at a time.
STRIDE = 32
#: Up to so many labels their sums are broadcast; beyond, the join is left to adaptive execution.
BROADCAST_LABELS = 50_000


def finite(v: Column) -> Column:
    """Whether a vector is there and has numbers only."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True))


def limit(dim: int) -> int:
    """The largest component for which the squared distances of a vector still fit 64 bits."""
    return 1 << ((60 - max(1, dim - 1).bit_length()) // 2)


def integers(flat: np.ndarray, dim: int) -> np.ndarray:
    """rows x parts x width, from the components of vectors of one dimension laid end to end."""
    with np.errstate(over="ignore"):
        x = np.clip(np.floor(flat.astype(np.float64) * SCALE), -limit(dim), limit(dim)).astype(np.int64)
    x = x.reshape(-1, dim) if dim else x.reshape(0, 0)
    return np.pad(x, ((0, 0), (0, -dim % PARTS))).reshape(len(x), PARTS, -(-dim // PARTS))


def squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances, points x entries: by a product of doubles where these hold all its sums exactly."""
    largest = max(np.abs(points).max(initial=0), np.abs(entries).max(initial=0))
    if 4 * points.shape[1] * int(largest) ** 2 < 1 << 53:
        p, e = points.astype(np.float64), entries.astype(np.float64)
        return np.einsum("ij,ij->i", p, p)[:, None] + np.einsum("ij,ij->i", e, e)[None, :] - 2 * (p @ e.T)
    return np.stack([((points - e) ** 2).sum(axis=1) for e in entries], axis=1)


class Codebook:
    """The entries of one part position, with the neighbours of their balls once radii are known."""

    def __init__(self, entries: np.ndarray, radii: np.ndarray | None = None):
        self.entries, self.compared = entries, 0
        if radii is None:
            return
        apart = squares(entries, entries).astype(np.int64)
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.rings, self.near = [], []
        for i, row in enumerate(self.order):
            row = row[row != i]
            row = row[apart[i, row] <= 4 * radii[i] ** 2]
            self.near.append(row)
            self.rings.append((apart[i, row] + 3) // 4)  # d * 4 >= apart if and only if d >= this

    def assign(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry and squared distance, compared with all entries."""
        codes, errors = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
        for at in range(0, len(points), 4096):
            d = squares(points[at : at + 4096], self.entries)
            best = d.argmin(axis=1)
            codes[at : at + 4096], errors[at : at + 4096] = best, d[np.arange(len(d)), best]
        self.compared += len(points) * len(self.entries)
        return codes, errors

    def reassign(self, points: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same, of parts that had these codes: compared inside their rings only."""
        own = ((points - self.entries[codes]) ** 2).sum(axis=1)
        codes, errors = codes.copy(), own.copy()
        self.compared += len(points)
        first = np.array([r[0] if len(r) else np.iinfo(np.int64).max for r in self.rings])
        outside = np.flatnonzero(own >= first[codes])  # of the stable cores
        outside = outside[np.lexsort((-own[outside], codes[outside]))]
        balls = codes[outside]
        for rows in np.split(outside, np.flatnonzero(np.diff(balls)) + 1) if len(outside) else []:
            ball = codes[rows[0]]
            reach = np.searchsorted(self.rings[ball], own[rows], side="right")  # falls along the rows
            for at in range(0, int(reach[0]), STRIDE):
                some = rows[: np.searchsorted(-reach, -at, side="left")]
                other = np.sort(self.near[ball][at : at + STRIDE])
                d = squares(points[some], self.entries[other])
                self.compared += d.size
                best = d.argmin(axis=1)
                d, other = d[np.arange(len(d)), best].astype(np.int64), other[best]
                won = (d < errors[some]) | ((d == errors[some]) & (other < codes[some]))
                codes[some[won]], errors[some[won]] = other[won], d[won]
        return codes, errors


class Totals:
    """Count, sums and radius of the parts that each entry got in a task."""

    def __init__(self, shape: tuple[int, int, int]):
        parts, entries, width = shape
        self.n, self.radius, self.sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)

    def add(self, part: int, points: np.ndarray, codes: np.ndarray, errors: np.ndarray) -> None:
        if not len(codes):
            return
        order = np.argsort(codes, kind="stable")
        at = np.flatnonzero(np.diff(codes[order], prepend=-1))
        found = codes[order[at]]
        self.n[part, found] += np.diff(at, append=len(codes))
        self.radius[part, found] = np.maximum(self.radius[part, found], np.maximum.reduceat(errors[order], at))
        if points.shape[1]:
            self.sums[part, found] += np.add.reduceat(points[order], at)


def _assigned(rows: DataFrame, books: dict[int, list], radii: dict[int, list] | None, label_type: str) -> DataFrame:
    """rows (dim, id, label, v and, but for the first time, codes) with new codes and error; besides, for each task and
    entry a row with part, entry, n, radius, sums."""
    types = {"dim": "int", "id": "long", "label": label_type, "v": "array<int>", "codes": "binary", "error": "long", "part": "int", "entry": "int", "n": "long", "radius": "long", "sums": "array<long>"}
    raw = "codes" not in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = {d: [Codebook(e, None if radii is None else np.array(radii[d][p], object)) for p, e in enumerate(np.array(book, np.int64))] for d, book in books.items()}
        totals = {d: Totals(np.array(book).shape) for d, book in books.items()}
        kinds = None
        for b in slices(batches, 65_536):
            label = b.column("label")
            kinds = {"dim": pa.int32(), "id": pa.int64(), "label": label.type, "v": pa.list_(pa.int32()), "codes": pa.binary(), "error": pa.int64(), "part": pa.int32(), "entry": pa.int32(), "n": pa.int64(), "radius": pa.int64(), "sums": pa.list_(pa.int64())}
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                at = pa.array(dims == dim)
                v = b.column("v").filter(at).flatten().to_numpy(zero_copy_only=False)
                n, width = int((dims == dim).sum()), -(-dim // PARTS)
                x = integers(v, dim) if raw and dim else v.astype(np.int64).reshape(n, PARTS, width)
                old = None if raw else np.frombuffer(b"".join(b.column("codes").filter(at).to_pylist()), np.uint8).reshape(n, PARTS)
                codes, error = np.empty((n, PARTS), np.uint8), np.zeros(n, np.int64)
                for p, book in enumerate(made[dim]):
                    c, e = book.assign(x[:, p]) if raw else book.reassign(x[:, p], old[:, p].astype(np.int64))
                    totals[dim].add(p, x[:, p], c, e)
                    codes[:, p] = c
                    error += e
                flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (PARTS * width)), pa.array(x.reshape(-1), pa.int32()))
                packed = pa.Array.from_buffers(pa.binary(PARTS), n, [None, pa.py_buffer(codes.tobytes())]).cast(pa.binary())
                yield _batch(kinds, n, dim=np.full(n, dim), id=b.column("id").filter(at), label=label.filter(at), v=flat, codes=packed, error=error)
        for dim, t in totals.items() if kinds else ():
            part, entry = np.nonzero(t.n)
            if len(part):
                yield _batch(kinds, len(part), dim=np.full(len(part), dim), part=part, entry=entry, n=t.n[part, entry], radius=t.radius[part, entry], sums=t.sums[part, entry].tolist())

    return rows.mapInArrow(run, ", ".join(f"{k} {t}" for k, t in types.items()))


def _batch(kinds: dict[str, pa.DataType], rows: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns and not isinstance(columns[c], pa.Array) else columns.get(c, pa.nulls(rows, t)) for c, t in kinds.items()], list(kinds))


def first_entries(rows: DataFrame) -> dict[int, list]:
    """For each dimension the codebooks (parts x entries x width) of the vectors with the smallest ids."""
    books = {}
    for dim in sorted(r["dim"] for r in rows.select("dim").distinct().collect()):
        first = rows.filter(F.col("dim") == dim).orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(ENTRIES).collect()
        x = integers(np.array([r["v"] for r in first], np.float64).reshape(-1), dim) if dim else np.zeros((len(first), PARTS, 0), np.int64)
        books[dim] = x.transpose(1, 0, 2).tolist()
    return books


def moved(books: dict[int, list], state: DataFrame) -> tuple[dict[int, list], dict[int, list]]:
    """The codebooks at the floored means of their parts, and upper bounds of the balls' radii around them."""
    rows = state.filter("part IS NOT NULL").select("dim", "part", "entry", "n", "radius", F.posexplode_outer("sums").alias("at", "sum"))
    rows = rows.groupBy("dim", "part", "entry", "at").agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"), F.sum("n").alias("n"), F.max("radius").alias("radius"))
    new = {d: [[list(e) for e in p] for p in book] for d, book in books.items()}
    radii = {d: [[0] * len(p) for p in book] for d, book in books.items()}
    for r in rows.collect():  # one row for each component of the codebooks
        if r["at"] is not None:
            new[r["dim"]][r["part"]][r["entry"]][r["at"]] = int(r["sum"]) // r["n"]
        radii[r["dim"]][r["part"]][r["entry"]] = r["radius"]
    for d, book in books.items():
        for p, part in enumerate(book):
            for e, old in enumerate(part):
                way = sum((a - b) ** 2 for a, b in zip(old, new[d][p][e], strict=True))
                radii[d][p][e] = math.isqrt(radii[d][p][e]) + math.isqrt(way) + 2
    return new, radii


def vector_codes(vectors: DataFrame, rounds: int = ROUNDS, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> tuple[DataFrame, dict[int, list]]:
    """(vec_id, label, dim, codes (one byte for each part), error) of every kept vector, and the codebooks by dimension
    (parts x entries x width)."""
    kept = vectors.filter(finite(F.col(vector_column)))
    rows = kept.select(F.size(vector_column).alias("dim"), F.col(id_column).cast("long").alias("id"), F.col(label_column).alias("label"), F.col(vector_column).cast("array<double>").alias("v"))
    kind = rows.schema["label"].dataType.simpleString()
    books, radii, state = first_entries(rows), None, rows
    for _ in range(rounds):
        state = materialize(_assigned(state, books, radii, kind), "assigned")
        books, radii = moved(books, state)
        state = state.filter("part IS NULL").select("dim", "id", "label", "v", "codes")
    last = _assigned(state, books, radii, kind).filter("part IS NULL")
    return last.select(F.col("id").alias("vec_id"), "label", "dim", "codes", "error"), books


def book_digest(book: list) -> str:
    """sha256 of a dimension's entries: all components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(x) for part in book for entry in part for x in entry).encode()).hexdigest()


def code_report(vectors: DataFrame) -> DataFrame:
    """vec_id, code (two hex digits for each part), error, label_error (of all rows with the label), codebooks_sha256."""
    coded, books = vector_codes(vectors)
    coded = materialize(coded, "codes")
    sums = materialize(coded.groupBy(F.col("label").alias("named")).agg(F.try_sum("error").alias("label_error")), "labels")
    few = sums.count() <= BROADCAST_LABELS
    digest = F.lit(None).cast("string")
    for dim, book in books.items():
        digest = F.when(F.col("dim") == dim, F.lit(book_digest(book))).otherwise(digest)
    both = coded.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("named")))
    return both.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", digest.alias("codebooks_sha256"))
