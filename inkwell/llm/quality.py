"""Quality classifier by compression.

Two zstandard dictionaries are trained, one from well and one from badly rated text. A document is cut into
blocks of ``block`` bytes (all of it, however long), each block is compressed with both dictionaries, and the sizes are
summed. The difference of both sizes, divided by the document's bytes, is all that a document is judged by: a logistic
curve turns it into a score from 0 to 1. The curve is fitted on labelled rows by cross-fitting: they are dealt to FOLDS
folds, and the rows of a fold are measured with dictionaries that are trained on the other folds only. Its rows are weighted by how frequent their class is
among all labelled ids that may be learned from, so the score is calibrated to that population, however many rows of a
class the fit takes.

Defined results: a null or empty text has a difference of 0 and gets the score of that; a null doc_id is
scored like any other row and is never used for fitting; repeated rows are scored once each, and of the texts of a
repeated id the first in order is learned from; ids with both labels are not learned from; if the labels hold
only one class (or none), every score is 0.5. Columns of the input other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import id_crc, slices

LEVEL = 3
FOLDS = 16


@dataclass(frozen=True)
class QualityModel:
    """Trained dictionaries (None: nothing could be learned) and the logistic curve over the difference."""

    bad: bytes | None
    good: bytes | None
    slope: float = 0.0
    intercept: float = 0.0
    block: int = 256

    def score(self, difference: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(difference * self.slope + self.intercept, -60, 60)))


class SizeDifference:
    """Callable on a text: its size with the bad dictionary less that with the good one, over its bytes."""

    def __init__(self, model: QualityModel):
        self.block, self.by = model.block, []
        for raw in (model.bad, model.good):
            known = zstandard.ZstdCompressionDict(raw)
            known.precompute_compress(level=LEVEL)
            self.by.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_dict_id=False).compress)

    def __call__(self, text: str | None) -> float:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if not raw:
            return 0.0
        blocks = [raw[i : i + self.block] for i in range(0, len(raw), self.block)]
        bad, good = (sum(map(len, map(c, blocks))) for c in self.by)
        return (bad - good) / len(raw)


def rated_ids(labels: DataFrame, label: str, train: Column) -> DataFrame:
    """doc_id, label of the ids that may be learned from: one row each, none for ids with both labels."""
    rated = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & train)
    each = rated.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most"))
    return each.filter("label = most").drop("most")


def labelled_sample(documents: DataFrame, rated: DataFrame, per_class: int) -> DataFrame:
    """doc_id, text, label of at most per_class ids of each class, those with the smallest hash; one row for each id.

    The ids are bounded by a limit before they are joined, so that the documents are only scanned."""
    picked = [rated.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for value in (0, 1)]
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))


def class_weights(rated: DataFrame, taken: Counter[int]) -> dict[int, float]:
    """For each class its ids among all rated ones over those taken, so that weighted rows stand for all of them."""
    every = {r["label"]: r["count"] for r in rated.groupBy("label").count().collect()}
    scale = sum(taken.values()) / max(1, sum(every.get(c, 0) for c in taken))
    return {c: scale * every.get(c, 0) / n for c, n in taken.items()}


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Weights of the columns of x and intercept by Newton's method, with a weak ridge on the standardised columns;
    weight: how many rows each row stands for."""
    weight = np.ones(len(x)) if weight is None else weight
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd = np.where(sd > 0, sd, 1.0)
    z = np.column_stack([(x - mean) / sd, np.ones(len(x))])
    w, ridge = np.zeros(z.shape[1]), np.diag([*[1e-2] * x.shape[1], 1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve(z.T @ (z * (weight * p * (1 - p))[:, None]) + ridge, z.T @ (weight * (y - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1] / sd, float(w[-1] - (w[:-1] * mean / sd).sum())


def dictionary_blocks(sample: DataFrame, per_class: int, size: int) -> DataFrame:
    """label, fold, block: of all blocks of the sampled texts, whole ones, per_class of each class at most, those with the
    smallest hash of id and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            out = []
            for i, label, fold, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "label", "fold", "text")), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                out += [(label, fold, zlib.crc32(f"{i}:{at}".encode()), raw[at : at + size]) for at in range(0, len(raw), size)]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.binary()))], ["label", "fold", "place", "block"])

    blocks = sample.select(F.col("doc_id").cast("string").alias("doc_id"), "label", "fold", "text").mapInArrow(run, "label int, fold int, place long, block binary")
    parts = [blocks.filter(F.col("label") == v).orderBy("place", "block").limit(per_class) for v in (0, 1)]
    return parts[0].unionByName(parts[1])


def train_dictionary(blocks: list[bytes], size: int) -> bytes | None:
    """A zstandard dictionary from blocks of text; where there is too little to train on, their raw bytes."""
    total = sum(map(len, blocks))
    if total < 64:
        return None
    try:
        return zstandard.train_dictionary(min(size, max(256, total // 4)), blocks, k=1024, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[:size]


def fit_quality(
    documents: DataFrame, labels: DataFrame, *, train: Column | None = None, dictionary_docs: int = 4000, dictionary_blocks_kept: int = 16384, calibration_docs: int = 1500, dictionary_bytes: int = 512 * 1024, block: int = 256, block_bytes: int = 1024
) -> QualityModel:
    """Fit on a bounded sample of labelled rows: dictionary_docs of each class at most, of which calibration_docs for the
    curve; from the whole texts, dictionary_blocks_kept blocks of block_bytes. train: which ids may be learned from
    (default: all). Folds are told apart by the ids' crc32; the model's own dictionaries learn from all of them."""
    train = F.lit(True) if train is None else train
    fold = (F.floor(id_crc(F.col("doc_id")) / 7) % FOLDS).cast("int")
    rated = rated_ids(labels, "quality", train)
    sample = labelled_sample(documents, rated, dictionary_docs).withColumn("fold", fold)
    rows = dictionary_blocks(sample, dictionary_blocks_kept, block_bytes).collect()

    def trained(left_out: int | None) -> QualityModel:
        pair = (train_dictionary(sorted(bytes(r["block"]) for r in rows if r["label"] == v and r["fold"] != left_out), dictionary_bytes) for v in (0, 1))
        bad, good = pair
        return QualityModel(bad, good, block=block) if bad and good else QualityModel(None, None, block=block)

    model = trained(None)
    if model.bad is None:
        return model
    models = [trained(f) for f in range(FOLDS)]
    some = labelled_sample(documents, rated, calibration_docs).withColumn("fold", fold).filter(F.col("fold").isin([f for f, m in enumerate(models) if m.bad is not None]))
    shared = documents.sparkSession.sparkContext.broadcast(models)
    measured = _measured(some, shared, ["doc_id", "label"]).select("doc_id", "label", "difference").orderBy("doc_id").collect()
    shared.destroy()  # later stages need the memory
    x, y = np.array([[r["difference"]] for r in measured], dtype=float), np.array([r["label"] for r in measured], dtype=float)
    if len(set(y)) < 2:
        return replace(model, slope=20.0)
    by_class = class_weights(rated, Counter(r["label"] for r in measured))
    weights, intercept = logistic(x, y, np.array([by_class[r["label"]] for r in measured]))
    return replace(model, slope=float(weights[0]), intercept=intercept)


def _measured(documents: DataFrame, shared: Broadcast, keep: list[str]) -> DataFrame:
    """The columns keep, and the difference by that of the shared models which is the row's fold's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, measure = None, None  # one pair of dictionaries at a time
        for b in slices(batches):
            x = []
            for f, text in zip(b.column("fold").to_pylist(), b.column("text").to_pylist(), strict=True):
                if f != at:
                    at, measure = f, SizeDifference(shared.value[f])
                x.append(measure(text))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(x, pa.float64())], [*keep, "difference"])

    schema = ", ".join(f"`{k}` {documents.schema[k].dataType.simpleString()}" for k in keep) + ", difference double"
    return documents.select(*keep, "fold", "text").repartition(FOLDS, "fold").sortWithinPartitions("fold").mapInArrow(run, schema)


def _scored(documents: DataFrame, model: QualityModel, keep: list[str]) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = SizeDifference(shared.value)
        for b in slices(batches):
            x = [measure(t) for t in b.column("text").to_pylist()]
            score = shared.value.score(np.array(x, dtype=float))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(x, pa.float64()), pa.array(score, pa.float64())], [*keep, "difference", "score"])

    schema = ", ".join(f"`{k}` {documents.schema[k].dataType.simpleString()}" for k in keep) + ", difference double, score double"
    return documents.select(*keep, "text").mapInArrow(run, schema)


def score_quality(documents: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, difference (null: no model), score of every row, each whole text read once."""
    if model.bad is None:
        return documents.select("doc_id", F.lit(None).cast("double").alias("difference"), F.lit(0.5).alias("score"))
    return _scored(documents.select("doc_id", "text"), model, ["doc_id"])


def keep_quality(documents: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """The rows with a score of at least threshold, with all their columns; nothing is shuffled."""
    if model.bad is None:
        return documents if threshold <= 0.5 else documents.filter(F.lit(False))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = SizeDifference(shared.value)
        for b in slices(batches):
            x = np.array([measure(t) for t in b.column("text").to_pylist()], dtype=float)
            yield b.filter(pa.array(shared.value.score(x) >= threshold, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
