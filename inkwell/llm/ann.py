"""Nearest neighbours by randomly rotated one-bit codes with error bounds.

The vectors are dealt at random into cells of bounded size, and every query visits every cell. There the vectors are
centred on the cell's mean, scaled to length one and turned by a random rotation (fixed seed); the code keeps one bit
per dimension, packed, with two scalars: the distance to the centre and the inner product of the unit vector with its
own code. A query is turned the same way and rounded to four bits per dimension, kept as four bit planes. Its inner
product with all vectors of a cell is estimated without bias from bit counts of codes and planes and the scalars, which
also bound the error. The nearest by estimate are measured exactly, in double precision on the original vectors; the
k-th distance among them is the limit, and only vectors whose lower bound is not above it are measured besides. The best
k of each cell meet in a small window per query.

Each vector is shuffled once and each query once for each cell, so the shuffle is N + Q N / CELL rows; the scan compares
all Q N pairs of a query and a vector by their bits (no pair is a row), which is the cost that grows fastest. Cells are
chosen by a hash of id and vector, so no key, however frequent, gathers rows, and a task holds one cell and a few
queries at a time. Nothing is broadcast.

Defined results: null or empty vectors, vectors holding null, NaN or infinite components, all-zero vectors and null
ids take no part, neither as queries nor as candidates; a query meets only vectors of its own dimension; rows that
repeat an id are candidates of their own, but a row is never a candidate for a query with its own id; a query that is
repeated is answered once per distinct vector of it. Ties go to the smaller id. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Vectors in a cell at most, and bytes of their components as doubles; cells of small tables are smaller, down to LEAST
#: vectors, so that there is one for each shuffle partition.
CELL, CELL_BYTES, LEAST = 65_536, 64 << 20, 4_096
#: Error bounds are so many standard deviations of the estimate wide.
SPREAD = 4.0
#: Bits for each dimension of a query.
PLANES = 4
#: So many times k vectors are measured for the limit.
AHEAD = 4


@lru_cache(maxsize=8)
def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random orthonormal matrix."""
    q, r = np.linalg.qr(np.random.RandomState(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def pack(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    raw = np.packbits(bits, axis=1)
    return np.pad(raw, ((0, 0), (0, -raw.shape[1] % 8))).view(np.uint64)


class Cell:
    """The codes of some vectors of one dimension, with the vectors themselves."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors, self.dim = ids, vectors, vectors.shape[1]
        self.centre = vectors.mean(axis=0, dtype=np.float64)
        moved = vectors - self.centre
        self.far = np.sqrt(np.einsum("ij,ij->i", moved, moved))
        unit = (moved / np.where(self.far > 0, self.far, 1)[:, None]) @ rotation(self.dim)
        bits = unit > 0
        self.codes, self.ones = pack(bits), bits.sum(axis=1)
        own = np.abs(unit).sum(axis=1) / np.sqrt(self.dim)
        self.own = np.where(own > 0, own, 1)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated squared distances and their error bounds, queries x vectors."""
        root = np.sqrt(self.dim)
        moved = queries - self.centre
        length = np.sqrt(np.einsum("ij,ij->i", moved, moved))
        unit = (moved / np.where(length > 0, length, 1)[:, None]) @ rotation(self.dim)
        low = unit.min(axis=1)
        step = np.maximum((unit.max(axis=1) - low) / (2**PLANES - 1), 1e-30)
        levels = np.rint((unit - low[:, None]) / step[:, None]).astype(np.uint8)
        small = np.uint16 if self.dim < 4096 else np.uint32
        counts = np.zeros((len(queries), len(self.ids)), small)
        for bit in range(PLANES):
            plane = pack((levels >> bit) & 1)
            for word in range(self.codes.shape[1]):
                counts += np.left_shift(np.bitwise_count(plane[:, word, None] & self.codes[None, :, word]), bit, dtype=small)
        # with u = low + step * level, <u, code> = (2 <u, bits> - sum of u) / sqrt(dim)
        single = lambda x: x.astype(np.float32)
        total = (low * self.dim + step * levels.sum(axis=1))[:, None]
        estimate = counts * single(2 * step)[:, None] + (single(2 * low)[:, None] * single(self.ones) - single(total))
        scale = single(2 * length)[:, None] * single(self.far)
        square = single(length**2)[:, None] + single(self.far**2)
        error = np.sqrt(single(np.maximum(0, 1 - self.own**2) / max(1, self.dim - 1)) + single(step**2 / 12)[:, None]) * single(SPREAD / self.own)
        return square - scale * estimate * single(1 / root / self.own), scale * error + 1e-5 * square + 1e-9

    def nearest(self, queries: np.ndarray, query_ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query the ids and exact distances of its k nearest here."""
        middle, width = self.bounds(queries)
        ahead = AHEAD * k
        for query, own_id, mid, wide in zip(queries, query_ids, middle, width, strict=True):
            other = self.ids != own_id
            mid[~other] = np.inf
            first = np.argpartition(mid, ahead)[:ahead] if len(mid) > ahead else np.arange(len(mid))
            first = first[other[first]]
            exact = self._distances(first, query)
            if len(mid) > ahead:
                limit = np.partition(exact, k - 1)[k - 1] ** 2 if len(exact) >= k else np.inf
                first = np.flatnonzero((mid - wide <= limit) & other)
                exact = self._distances(first, query)
            best = np.lexsort((self.ids[first], exact))[:k]
            yield self.ids[first[best]], exact[best]

    def _distances(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        gap = self.vectors[rows] - query
        return np.sqrt(np.einsum("ij,ij->i", gap, gap))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(dim, cell, kind, ids, hashes, vectors as doubles) of consecutive rows that agree on the first three."""
    for b in batches:
        if not b.num_rows:
            continue
        dim, cell, kind, ids, h = (b.column(c).to_numpy() for c in ("dim", "cell", "kind", "id", "h"))
        lists = b.column("v")
        flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
        cuts = np.flatnonzero((np.diff(dim) != 0) | (np.diff(cell) != 0) | (np.diff(kind) != 0)) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
            yield int(dim[i]), int(cell[i]), int(kind[i]), ids[i:j], h[i:j], flat[at[i] : at[j]].reshape(j - i, -1).astype(np.float64)


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding", cell: int = CELL, least: int = LEAST) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest of each query by Euclidean distance."""
    kept = vectors.filter(F.col(id_column).isNotNull() & usable(F.col(vector_column)))
    v = F.col(vector_column)
    row = [F.size(v).alias("dim"), F.col(id_column).cast("long").alias("id"), F.xxhash64(v).alias("h"), v.alias("v")]
    rows, queries = kept.select(*row), kept.filter(is_query).select(*row).distinct()
    n, dim = rows.agg(F.count(F.lit(1)), F.coalesce(F.max("dim"), F.lit(1))).first()
    cell = max(1, min(cell, CELL_BYTES // (8 * dim)))
    wanted = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = max(1, -(-n // cell), min(wanted, -(-n // min(least, cell))))
    dealt = rows.select("dim", F.pmod(F.xxhash64("id", "h", F.lit(11)), F.lit(cells)).cast("int").alias("cell"), F.lit(0).alias("kind"), "id", "h", "v")
    asked = queries.select("dim", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), F.lit(1).alias("kind"), "id", "h", "v")
    # the vectors of a cell come first, then the queries, which are read and answered a few at a time
    met = dealt.unionByName(asked).repartition(cells, "dim", "cell").sortWithinPartitions("dim", "cell", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, here = None, [], None
        for dim, number, kind, ids, h, x in _runs(batches):
            if at != (dim, number):
                at, held, here = (dim, number), [], None
            if not kind:
                held.append((ids, x))
                continue
            if here is None and held:
                here, held = Cell(np.concatenate([p[0] for p in held]), np.concatenate([p[1] for p in held])), []
            step = max(1, (1 << 18) // len(here.ids)) if here else len(ids)
            for s in range(0, len(ids) if here else 0, step):
                found = list(here.nearest(x[s : s + step], ids[s : s + step], k))
                size = [len(f[0]) for f in found]
                columns = [np.full(sum(size), dim), np.repeat(ids[s : s + step], size), np.repeat(h[s : s + step], size), np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["dim", "query_id", "h", "vec_id", "score"])

    found = met.mapInArrow(run, "dim int, query_id long, h long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("dim", "query_id", "h").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
