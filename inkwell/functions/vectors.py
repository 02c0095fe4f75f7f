"""Vectors: normalising in expressions, and the packed multi-vector format in vectorised helpers.

A packed multi-vector is the number of tokens (uint16, little-endian) and then the tokens row by row, as int8 (value *
127, cut towards zero) or as float32."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.functions.urls import _col

#: Bytes of packed multi-vectors that are unpacked at a time.
PACKED_BYTES = 1 << 20


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.transform(_col(v), lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x * x))


def rounded(x: Column, digits: int) -> Column:
    """A double rounded half away from zero as SQL engines do it on doubles: scaled, rounded and scaled back. What rounds to
    zero keeps its sign, which F.round drops."""
    whole = F.round(x * F.lit(10.0**digits))
    return F.when(whole == 0, x * F.lit(0.0)).otherwise(whole / F.lit(10.0**digits))


def dot(a: Column | str, b: Column | str) -> Column:
    terms = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column | str) -> Column:
    """The vector at length one, as doubles; a zero vector stays zero."""
    v = _col(v)
    length = norm(v)
    return F.transform(v, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(F.lit(0.0)))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; null for a zero vector."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths)


def preview(v: Column | str, shown: int = 5) -> Column:
    """The first values with four decimals and the dimension, - for null."""
    v = _col(v)
    first = F.array_join(F.transform(F.slice(v, 1, shown), lambda x: F.format_string("%.4f", x.cast("double"))), ", ")
    return F.coalesce(F.concat(F.lit("["), first, F.lit(", ... ("), F.size(v).cast("string"), F.lit(" dims)]")), F.lit("-"))


def low_dim(tokens: np.ndarray, dim: int) -> np.ndarray:
    """The first dim components of each token (rows), each at length one; zero tokens stay zero."""
    low = np.asarray(tokens, np.float64)[:, :dim]
    # added up in order, as SQL does it: the last bit can decide about a rounded value
    length = np.sqrt(np.cumsum(low**2, axis=1)[:, -1:]) if low.shape[1] else np.zeros((len(low), 1))
    return np.divide(low, length, out=np.zeros_like(low), where=length > 0)


def pack(tokens: np.ndarray, kind: str = "int8") -> bytes:
    """Packed form of normalised tokens; kind int8 or float32."""
    body = np.trunc(tokens * 127).astype("<i1") if kind == "int8" else tokens.astype("<f4")
    return len(tokens).to_bytes(2, "little") + body.tobytes()


def unpack(data: bytes | None, dim: int, kind: str = "int8") -> np.ndarray:
    """Tokens of a packed multi-vector, values of int8 over 127. Tolerant: without a whole count there are no tokens,
    of a short payload as many as are whole, and what follows the counted tokens is ignored."""
    if data is None or len(data) < 2:
        return np.empty((0, dim))
    size = dim * (1 if kind == "int8" else 4)
    n = min(int.from_bytes(data[:2], "little"), (len(data) - 2) // size)
    raw = np.frombuffer(data, "<i1" if kind == "int8" else "<f4", n * dim, 2).reshape(n, dim).astype(np.float64)
    return raw / 127 if kind == "int8" else raw


def maxsim_score(query: bytes | None, doc: bytes | None, dim: int, kind: str = "int8") -> float:
    """Mean over the query's tokens of the largest inner product with a token of the document; 0 without tokens."""
    q, d = unpack(query, dim, kind), unpack(doc, dim, kind)
    return float((q @ d.T).max(axis=1).mean()) if len(q) and len(d) else 0.0


def pack_tokens(dim: int, kind: str = "int8"):
    """Vectorised function: array of token vectors (array<array<float>>) to the packed form."""

    @F.pandas_udf(T.BinaryType())
    def run(tokens: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else pack(low_dim(np.stack(t), dim) if len(t) else np.empty((0, dim)), kind) for t in tokens], dtype=object)

    return run


def unpack_tokens(dim: int, kind: str = "int8"):
    """Vectorised function: packed form to array of token vectors."""

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
    def run(data: pd.Series) -> pd.Series:
        return pd.Series([unpack(None if d is None else bytes(d), dim, kind).tolist() for d in data], dtype=object)

    return run


def unpack_all(packed: pa.Array, dim: int, kind: str = "int8") -> tuple[np.ndarray, np.ndarray]:
    """The tokens of many packed multi-vectors, one under the other as they are stored, and how many each has."""
    size = dim * (1 if kind == "int8" else 4)
    packed = packed.cast(pa.large_binary())
    at = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset : packed.offset + len(packed) + 1]
    data = np.frombuffer(packed.buffers()[2] or b"", np.uint8)
    length = np.diff(at)
    head = np.where(length >= 2, 0, -1)
    first, second = (data[np.where(head == 0, at[:-1] + i, 0)] if len(data) else np.zeros(len(length), np.uint8) for i in (0, 1))
    n = np.where(head == 0, np.minimum(first + 256 * second.astype(np.int64), (length - 2) // size), 0)
    starts = np.cumsum(n) - n
    rows = np.arange(n.sum()) - np.repeat(starts, n)
    begins = np.repeat(at[:-1] + 2, n) + rows * size
    raw = data[begins[:, None] + np.arange(size)] if len(rows) else np.empty((0, size), np.uint8)
    return raw.view("<i1" if kind == "int8" else "<f4").reshape(-1, dim), n


def maxsim_scores(query: pa.Array, doc: pa.Array, dim: int, kind: str = "int8") -> np.ndarray:
    """maxsim_score of each pair. The documents that meet one query are one matrix: a product with it gives all inner
    products, of which the largest of each document are taken at its offsets."""
    coded = query.fill_null(b"").dictionary_encode()
    which, distinct = coded.indices.to_numpy(), coded.dictionary
    order = np.argsort(which, kind="stable")
    d, n = unpack_all(doc.fill_null(b"").take(pa.array(order)), dim, kind)
    q, m = unpack_all(distinct, dim, kind)
    scale = 127.0 if kind == "int8" else 1.0
    q_at, d_at = np.cumsum(m) - m, np.concatenate([[0], np.cumsum(n)])
    out, cuts = np.zeros(len(which)), np.searchsorted(which[order], np.arange(len(distinct) + 1))
    for i in range(len(distinct)):
        rows = np.arange(cuts[i], cuts[i + 1])
        rows = rows[n[rows] > 0]  # the others have no tokens and no place in the matrix
        if not m[i] or not len(rows):
            continue
        mine = q[q_at[i] : q_at[i] + m[i]].astype(np.float64) / scale
        # a few megabytes of inner products at a time
        step = max(1, int(len(rows) * (1 << 19) // max(1, m[i] * n[rows].sum())))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            block = d[d_at[some[0]] : d_at[some[-1] + 1]].astype(np.float64) / scale
            best = np.maximum.reduceat(mine @ block.T, d_at[some] - d_at[some[0]], axis=1)
            out[order[some]] = best.mean(axis=0)
    return out


def maxsim(dim: int, kind: str = "int8"):
    """Vectorised function: (query, document) in packed form to their score."""

    @F.arrow_udf(T.DoubleType())
    def run(query: pa.Array, doc: pa.Array) -> pa.Array:
        # unpacked, a document takes many times its bytes: so many are at a time
        filled = np.cumsum(pc.fill_null(pc.binary_length(doc), 0).to_numpy(zero_copy_only=False)) // PACKED_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(filled)) + 1).tolist(), len(doc)]
        return pa.array(np.concatenate([maxsim_scores(query.slice(i, j - i), doc.slice(i, j - i), dim, kind) for i, j in zip(cuts, cuts[1:], strict=False)]))

    return run


def split_tokens(v: Column | str, tokens: int) -> Column:
    """A vector cut into so many token vectors of equal length."""
    v = _col(v)
    width = F.floor(F.size(v) / F.lit(tokens)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(tokens - 1)), lambda i: F.slice(v, i * width + 1, width))


