"""Token ids in seekable binary files.

File format, all integers little-endian. A file holds the documents of one range of ids, in ascending order:

    frames      independent zstandard frames (content size and checksum in each); a frame holds the 32-bit token ids
                of consecutive documents, each followed by the end id, and ends with the document that fills it
    lists       zstandard frames between them, one after every 65,536 documents and one at the end: doc_id (int64),
                flag (uint8: 1 if the id is null), frame (uint32), offset in its raw bytes (uint64) and number of ids
                (uint64) of each document, column after column
    seek table  for each frame: place (uint64), compressed bytes (uint64), raw bytes (uint64), crc32 of the compressed
                bytes (uint32); then the same for each list with documents (uint64), first and last doc_id (int64)
    trailer     frames (uint64), lists (uint64), documents (uint64), crc32 of the seek table (uint32), magic "IWTOK002"

A reader fetches the trailer and the table, and then only the lists and frames that hold what it wants. Writer and
reader hold one frame and one list at a time, whatever the size of the file.

The rows are range-sorted by doc_id, each task encodes its range and writes one file under a name that depends on the
range only (to a temporary name first, then renamed), so a task that runs again replaces its file by an equal one. The
number of files follows from the bytes of the texts.

Defined results: null texts are empty, and such documents hold the end id only; null ids come first; rows that repeat
a doc_id are documents of their own (ordered by text); an empty table gives no files and no rows.
"""

from __future__ import annotations

import io
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.llm.bpe import byte_alphabet
from inkwell.llm.common import Memory, materialize, slices

MAGIC = b"IWTOK002"
TRAILER = struct.Struct("<QQQI8s")
SEEK = np.dtype([("at", "<u8"), ("size", "<u8"), ("raw", "<u8"), ("crc", "<u4")])
LIST = np.dtype([*SEEK.descr, ("docs", "<u8"), ("first", "<i8"), ("last", "<i8")])
COLUMNS = np.dtype([("id", "<i8"), ("null", "u1"), ("frame", "<u4"), ("offset", "<u8"), ("count", "<u8")])
FRAME_BYTES, LIST_DOCS = 1 << 20, 1 << 16
#: Bytes of text that make a file; of small tables a file holds less, so that there is one for each shuffle partition.
FILE_BYTES, LEAST_BYTES = 128 << 20, 8 << 20
#: What an encoder may remember; a Python worker holds one encoder for each tokenizer file that it meets.
MEMORY_BYTES = 224 << 20
#: Letters, and after them marks that make a token run of their own.
PLAIN = re.compile("(\0?([A-Za-zÀ-ÖØ-öø-ɏ]+))([.,!?;:|]{0,4})")
ALPHABET = dict(enumerate(byte_alphabet()))
#: Begins the key of a piece without a space before it.
FIRST = "\0"


class PieceEncoder:
    """The ids of texts as the tokenizers library gives them, with a memory of pieces.

    A byte-level pre-tokenizer always cuts before a single space, and around a single line end, between characters
    that are no white space. So the pieces between such cuts can be encoded one by one, and each distinct piece once;
    pieces of letters and closing marks go straight to the library's model, the others through all of it. Texts with
    other white space at a cut are encoded whole."""

    def __init__(self, tokenizer_path: str, memory_bytes: int = MEMORY_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memory = Memory(memory_bytes)
        self.tails: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    @staticmethod
    def pieces(text: str) -> list[str]:
        """Keys of the pieces: those that stand after a space, FIRST and those that don't, and line ends."""
        if FIRST in text:
            return [FIRST]
        out = []
        for line in text.split("\n"):
            words = line.split(" ")
            words[0] = FIRST + words[0]
            out += words
            out.append("\n")
        out.pop()
        return out

    def _learn(self, new: Iterable[str]) -> None:
        """Remember the ids of new pieces, None for those that begin or end with white space besides the cut."""
        tokenize, known, tails = self.tokenizer.model.tokenize, self.memory.young, self.tails
        made: dict[str, bytes | None] = {}
        others: dict[str, str] = {}
        for p in new:
            plain = PLAIN.fullmatch(p)
            if plain is None:
                bare = p.removeprefix(FIRST)
                if p == "\n":
                    made[p] = self._whole(p)
                elif not bare or bare[0].isspace() or bare[-1].isspace():
                    made[p] = None
                else:
                    others[p] = bare if p != bare else " " + bare
                continue
            base, word, tail = plain.groups()
            ids = made.get(base) or known.get(base)
            if ids is None:
                mapped = (word if base != word else " " + word).encode().decode("latin-1").translate(ALPHABET)
                made[base] = ids = array("I", [t.id for t in tokenize(mapped)]).tobytes()
            if tail:
                if tail not in tails:
                    tails[tail] = self._whole(tail)
                made[p] = ids + tails[tail]
        keys = list(others)
        for at in range(0, len(keys), 4096):
            part = keys[at : at + 4096]
            done = self.tokenizer.encode(list(map(others.__getitem__, part)), is_pretokenized=True, add_special_tokens=False)
            ids = np.array(done.ids, "<u4").tobytes()
            cuts = (4 * np.searchsorted(np.array(done.word_ids, np.int64), np.arange(len(part) + 1))).tolist()
            made.update((p, ids[i:j]) for p, i, j in zip(part, cuts, cuts[1:], strict=False))
        self.memory.add(made)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids as little-endian 32-bit integers."""
        cut = [self.pieces(t) if t else [] for t in texts]
        self._learn(self.memory.missing(set().union(*cut)))
        known, out = self.memory.young.__getitem__, []
        for text, pieces in zip(texts, cut, strict=True):
            try:
                out.append(b"".join(map(known, pieces)))
            except TypeError:  # one of the pieces is None
                out.append(self._whole(text))
        return out


@lru_cache(maxsize=2)
def piece_encoder(tokenizer_path: str) -> PieceEncoder:
    """The encoder of this Python worker; what it remembers serves all of the worker's tasks."""
    return PieceEncoder(tokenizer_path)


class FileWriter:
    """Writes the documents of one file; frames and lists are compressed as they fill."""

    def __init__(self, out: io.IOBase, frame_bytes: int = FRAME_BYTES, level: int = 3, list_docs: int = LIST_DOCS):
        self.out, self.limit, self.list_docs = out, frame_bytes, list_docs
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.buffer, self.filled, self.at, self.n_docs, self.n_ids = [], 0, 0, 0, 0
        self.seek, self.lists, self.docs = [], [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(self.seek), self.filled, len(ids) // 4))
        self.n_docs, self.n_ids = self.n_docs + 1, self.n_ids + len(ids) // 4
        self.buffer.append(ids)
        self.filled += len(ids)
        if self.filled >= self.limit:
            self._end_frame()
        if len(self.docs) >= self.list_docs:
            self._end_list()

    def _write(self, raw: bytes) -> tuple[int, int, int, int]:
        done = self.compressor.compress(raw)
        self.out.write(done)
        self.at += len(done)
        return self.at - len(done), len(done), len(raw), zlib.crc32(done)

    def _end_frame(self) -> None:
        if self.buffer:
            self.seek.append(self._write(b"".join(self.buffer)))
            self.buffer, self.filled = [], 0

    def _end_list(self) -> None:
        if self.docs:
            table = np.array(self.docs, COLUMNS)
            self.lists.append((*self._write(b"".join(table[c].tobytes() for c in COLUMNS.names)), len(table), int(table["id"].min()), int(table["id"].max())))
            self.docs = []

    def close(self) -> tuple[int, int]:
        """Writes the rest; returns the numbers of documents and ids."""
        self._end_frame()
        self._end_list()
        table = np.array(self.seek, SEEK).tobytes() + np.array(self.lists, LIST).tobytes()
        self.out.write(table)
        self.out.write(TRAILER.pack(len(self.seek), len(self.lists), self.n_docs, zlib.crc32(table), MAGIC))
        return self.n_docs, self.n_ids


class FileReader:
    """Random access to one file: documents(), all or some."""

    def __init__(self, source: pa.NativeFile):
        self.source, end = source, source.size()
        frames, lists, self.n_docs, crc, magic = TRAILER.unpack(self._at(end - TRAILER.size, TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        size = frames * SEEK.itemsize + lists * LIST.itemsize
        table = self._at(end - TRAILER.size - size, size)
        if zlib.crc32(table) != crc:
            raise ValueError("the seek table is damaged")
        self.seek = np.frombuffer(table, SEEK, frames)
        self.lists = np.frombuffer(table, LIST, lists, frames * SEEK.itemsize)

    def _at(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def _raw(self, entry: np.void, what: str) -> bytes:
        data = self._at(int(entry["at"]), int(entry["size"]))
        if zlib.crc32(data) != entry["crc"]:
            raise ValueError(f"{what} is damaged")
        return zstandard.ZstdDecompressor().decompress(data)

    def frame(self, k: int) -> bytes:
        """The raw ids of frame k; raises if its checksum is wrong."""
        return self._raw(self.seek[k], f"frame {k}")

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, bytes]]:
        """(doc_id, ids) in file order; with wanted, only these ids, and only their lists and frames are read."""
        some = None if wanted is None else np.unique(np.fromiter(wanted, np.int64))
        held, raw = -1, b""
        for k, entry in enumerate(self.lists):
            if some is not None and np.searchsorted(some, entry["first"]) == np.searchsorted(some, entry["last"], "right"):
                continue
            block, n, columns, at = self._raw(entry, f"list {k}"), int(entry["docs"]), {}, 0
            for c in COLUMNS.names:
                columns[c] = np.frombuffer(block, COLUMNS[c], n, at)
                at += n * COLUMNS[c].itemsize
            rows = range(n) if some is None else np.flatnonzero(np.isin(columns["id"], some) & (columns["null"] == 0)).tolist()
            for r in rows:
                if (f := int(columns["frame"][r])) != held:
                    held, raw = f, self.frame(f)
                start = int(columns["offset"][r])
                yield (None if columns["null"][r] else int(columns["id"][r])), raw[start : start + 4 * int(columns["count"][r])]


def write_tokens(documents: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, frame_bytes: int = FRAME_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode every whole text and write the files under folder (a URI that all executors reach). Runs the job.

    Returns one row per file: path, part (their order), n_docs, n_ids."""
    spark = documents.sparkSession
    total = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // file_bytes), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // LEAST_BYTES)))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = path = temp = writer = stream = part = None
        end = np.array([end_id], "<u4").tobytes()
        for b in slices(batches, 2048, 8 << 20):
            if b.num_rows and writer is None:
                part = b.column("part")[0].as_py()
                store, base = fs.FileSystem.from_uri(folder)
                path = f"{base}/part-{part:06d}.tok"
                temp = f"{base}/_writing-{uuid.uuid4().hex}"
                store.create_dir(base, recursive=True)
                stream = store.open_output_stream(temp)
                writer, encoder = FileWriter(stream, frame_bytes), piece_encoder(tokenizer_path)
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), encoder.encode(b.column("text").to_pylist()) if b.num_rows else [], strict=True):
                writer.add(doc_id, ids + end)
        if writer is not None:
            n_docs, n_ids = writer.close()
            stream.close()
            store.move(temp, path)
            yield pa.RecordBatch.from_pydict({"path": pa.array([f"part-{part:06d}.tok"]), "part": pa.array([part], pa.int32()), "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([n_ids], pa.int64())})

    return materialize(rows.mapInArrow(run, "path string, part int, n_docs long, n_ids long"), "files")


def read_tokens(files: DataFrame, folder: str) -> DataFrame:
    """Read files back: doc_id, start (ids of all documents before), ids (little-endian 32-bit, end id included).

    files: path, part, n_ids of each file; they bound the offsets. A file is read by one task, a frame at a time."""
    before = Window.partitionBy(F.lit(1)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    listed = files.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = fs.FileSystem.from_uri(folder)
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
                with store.open_input_file(f"{at}/{path}") as source:
                    out, size = ([], [], []), 0
                    for doc_id, ids in FileReader(source).documents():
                        for column, value in zip(out, (doc_id, start, ids), strict=True):
                            column.append(value)
                        start, size = start + len(ids) // 4, size + len(ids)
                        if size > 1 << 23:
                            yield _rows(out)
                            out, size = ([], [], []), 0
                    yield _rows(out)

    n = max(1, files.count())
    return listed.repartition(n, "path").mapInArrow(run, "doc_id long, start long, ids binary")


def _rows(out: tuple[list, list, list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "start", "ids"])
