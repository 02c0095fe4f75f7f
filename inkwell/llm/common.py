"""Shared helpers: reading tables, cutting lineage, slicing Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts write it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder all executors see. Where none is configured a temporary one serves a local master; on a
    cluster that is an error, as executors would not see each other's files."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-inkwell-')}"
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; the driver's JVM deletes it when the application ends."""
    path = f"{shared_dir(spark)}/inkwell-{uuid.uuid4().hex}/{name}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p.getParent())
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to at most so many rows and about so many bytes (one row at least), so that Python objects of
    few documents live at a time."""
    for b in batches:
        step = max(1, min(rows, size * b.num_rows // max(1, b.nbytes))) if b.num_rows else 1
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def id_crc(c: Column) -> Column:
    """crc32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def id_crc_py(i: int | None) -> int:
    return zlib.crc32(b"" if i is None else str(i).encode())


#: Words of 64 bits in the bitmap of within_keys: its size, whatever the data.
BITMAP_WORDS = 1 << 18


def _marked(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """rows with __hit: may the column be among keys (one column)?

    The keys set bits in a bitmap of fixed size, which is small enough to broadcast by construction. With very many
    keys all rows may be hits."""
    word = lambda c: F.xxhash64(c).bitwiseAND(F.lit(BITMAP_WORDS - 1)).cast("int")
    bit = lambda c: F.shiftrightunsigned(F.xxhash64(c), 58).cast("int")
    key = keys.columns[0]
    maps = keys.select(word(key).alias("__word"), bit(key).alias("__bit")).groupBy("__word").agg(F.bit_or(F.expr("shiftleft(1L, __bit)")).alias("__bits"))
    marked = rows.withColumns({"__word": word(column), "__bit": bit(column)}).join(F.broadcast(maps), "__word", "left")
    return marked.withColumn("__hit", F.expr("coalesce(shiftrightunsigned(__bits, __bit) & 1, 0) = 1")).drop("__word", "__bit", "__bits")


def within_keys(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows whose column may be among keys, before a join that makes sure of it: few other rows are shuffled."""
    return _marked(rows, column, keys).filter("__hit").drop("__hit")


def without_keys(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows whose column is not among keys (materialized, one column, no nulls); most of them are not shuffled."""
    marked, key = _marked(rows, column, keys), keys.columns[0]
    doubt = marked.filter("__hit").drop("__hit")
    return marked.filter("NOT __hit").drop("__hit").unionByName(doubt.join(keys.withColumnRenamed(key, "__key"), doubt[column] == F.col("__key"), "left_anti"))


class Memory:
    """Results (bytes, or None) by text in two generations of about so many bytes together: what is asked for again
    outlives the rest."""

    #: Bytes that an entry takes in a dictionary, with the headers of key and value.
    ENTRY = 186

    def __init__(self, limit: int):
        self.limit, self.size, self.young, self.old = limit, 0, {}, {}

    def add(self, made: dict[str, bytes | None]) -> None:
        self.young.update(made)
        self.size += self.ENTRY * len(made) + sum(map(len, made)) + sum(map(len, filter(None, made.values())))

    def missing(self, keys: set[str]) -> set[str]:
        """Makes room, and returns the keys that have to be added; all others are in young afterwards."""
        if 2 * self.size > self.limit:
            self.old, self.young, self.size = self.young, {}, 0
        new = keys.difference(self.young)
        known = new.intersection(self.old)
        self.add({k: self.old[k] for k in known})
        return new - known
