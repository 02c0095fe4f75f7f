"""Reading snapshots of pages and Markdown files, and writing tables and exports."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from fnmatch import fnmatchcase
from functools import reduce
from itertools import batched
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("documents", "sections", "chunks")
#: Bytes of files that one task reads, and of contents that a Python worker holds at a time.
TASK_BYTES, HELD_BYTES = 32 << 20, 4 << 20
#: Entries after which the task that lists the first folders leaves the others to more tasks; names in a batch.
LISTED, NAMES = 10_000, 10_000
#: What the path of a URI can't hold as it stands.
ILLEGAL = re.compile(r"[^\w.~/:@!$&'()*,;=+\u00a1-\U0010ffff-]|\s")


def read_texts(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """path (a URI) and content of every file under path whose name matches; a single file is read whatever its folder.

    Tasks list the folders, each its own, and tasks read the files; the driver gets their number of bytes only. A path that
    only Spark's readers can open, or that stands for several, is left to them: they list files in the driver, and leave out
    empty ones and names with _ or . in front."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toUri()
    uri, root = where.toASCIIString(), re.sub("^file:/+", "file:/", where.toString())
    try:
        store, base = pa.fs.FileSystem.from_uri(uri)
        kind = store.get_file_info(base).type
    except (pa.ArrowInvalid, OSError):
        kind = pa.fs.FileType.NotFound
    tasks = 4 * spark.sparkContext.defaultParallelism
    if kind == pa.fs.FileType.NotFound:
        texts = spark.read.format("binaryFile").load(path, recursiveFileLookup=True, pathGlobFilter=pattern)
        # a file counts as 4 MB when files are dealt to tasks: of small ones a task gets few
        size = texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        texts = texts.coalesce(max(tasks, -(-int(size) // TASK_BYTES)))
        return texts.select(F.col("_metadata.file_path").alias("path"), F.col("content").cast("string").alias("content"))
    files = spark.range(0, 1, 1, 1).select(F.lit(base).alias("path"), F.lit(-1).cast("long").alias("size"))
    if kind == pa.fs.FileType.Directory:
        entries = "path string, size long"
        files = files.mapInArrow(_lister(uri, pattern, tasks), entries).repartition(tasks, "path").mapInArrow(_lister(uri, pattern), entries)
    else:
        files = files.filter(F.lit(fnmatchcase(base.rpartition("/")[2], pattern)))
    size = files.agg(F.sum("size")).first()[0] or 0
    dealt = files.select("path").repartition(max(tasks, -(-size // TASK_BYTES)), "path")
    return dealt.mapInArrow(_reader(uri, base, root), "path string, content binary").withColumn("content", F.col("content").cast("string"))


def _lister(uri: str, pattern: str, enough: int | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Files and their sizes below the folders given, which have the size -1; files given pass. With enough it ends when that
    many folders, or LISTED entries, are found, and gives the folders that are left."""

    def entries(given: Iterator[tuple[str, int]]) -> Iterator[tuple[str, int]]:
        (store, _), folders, seen = pa.fs.FileSystem.from_uri(uri), deque(), 0
        for path, size in given:
            if size < 0:
                folders.append(path)
            else:
                yield path, size
        while folders and (enough is None or len(folders) < enough and seen < LISTED):
            found = store.get_file_info(pa.fs.FileSelector(folders.popleft()))
            seen += len(found)
            for x in found:
                if x.type == pa.fs.FileType.Directory:
                    folders.append(x.path)
                elif x.type == pa.fs.FileType.File and fnmatchcase(x.base_name, pattern):
                    yield x.path, x.size
        yield from ((path, -1) for path in folders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = (row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for rows in batched(entries(given), NAMES):
            paths, sizes = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["path", "size"])

    return run


def _reader(uri: str, base: str, root: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """URI and content of each file."""

    def batch(paths: list[str], contents: list[bytes]) -> pa.RecordBatch:
        names = [root + ILLEGAL.sub(lambda m: quote(m[0], safe=""), p[len(base) :]) for p in paths]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pa.fs.FileSystem.from_uri(uri)
        for b in batches:
            paths, contents, size = [], [], 0
            for path in b.column(0).to_pylist():
                with store.open_input_stream(path, compression=None) as f:
                    contents.append(f.read())
                paths.append(path)
                size += len(contents[-1])
                if size >= HELD_BYTES:
                    yield batch(paths, contents)
                    paths, contents, size = [], [], 0
            yield batch(paths, contents)

    return run


def read_html_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """path and html of the .html files of a folder and its subfolders."""
    return read_texts(spark, path, "*.html").withColumnRenamed("content", "html")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """path and content of the .md files of a folder and its subfolders, or of one file."""
    return read_texts(spark, path, "*.md")


def write_text_files(rows: DataFrame, path: str, name: str = "rel_path", content: str = "content") -> int:
    """One file for each row that has a content, at its relative path under path, which all executors must see; returns
    their number. Tasks write their own rows; a repeated task writes the same files again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (store, base), folders = pa.fs.FileSystem.from_uri(path), set()
        for b in batches:
            for file, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if ".." in file.split("/"):
                    raise ValueError(f"{file} leaves the folder")
                target = f"{base}/{file}"
                folder = target.rpartition("/")[0]
                if folder not in folders:
                    store.create_dir(folder, recursive=True)
                    folders.add(folder)
                with store.open_output_stream(target) as out:
                    out.write(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    there = rows.select(name, content).filter(F.col(name).isNotNull() & F.col(content).isNotNull())
    return there.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_markdown_docs(docs: DataFrame, path: str) -> None:
    """Converted documents with their relative paths, one folder for each source and version; replaces what is there."""
    docs.write.mode("overwrite").partitionBy("source", "target_version").parquet(path)


def write_store(tables: dict[str, DataFrame], path: str) -> None:
    """The tables documents, sections and chunks; documents by version. Replaces what is there, so write to a new path
    if the tables were read from the old one, and publish the new path when all are written."""
    for name in TABLES:
        writer = tables[name].write.mode("overwrite")
        (writer.partitionBy("target_version") if name == "documents" else writer).parquet(f"{path}/{name}")


def read_store(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of write_store; versions like 4.20 stay text."""
    key = "spark.sql.sources.partitionColumnTypeInference.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        return {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}
    finally:
        spark.conf.set(key, before)


def last_commit(spark: SparkSession, path: str) -> tuple[int, dict | None]:
    """Number and content of the last commit under path; 0 and None before the first."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/_commits")
    fs = folder.getFileSystem(conf)
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    numbers = [int(n[:8]) for n in names if re.fullmatch(r"\d{8}\.json", n)]
    if not numbers:
        return 0, None
    stream = fs.open(jvm.org.apache.hadoop.fs.Path(folder, f"{max(numbers):08d}.json"))
    try:
        return max(numbers), json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def try_commit(spark: SparkSession, path: str, number: int, content: dict) -> bool:
    """Adds commit number; False if another writer has added it. The file is written aside and gets its name in one step
    that fails if the name is taken: a hard link on a local disk, elsewhere a rename without overwriting, which must be
    atomic in the file system of path."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    aside, target = (jvm.org.apache.hadoop.fs.Path(f"{path}/_commits/{n}") for n in (f"_{uuid.uuid4().hex}", f"{number:08d}.json"))
    fs = aside.getFileSystem(conf)
    out = fs.create(aside, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    try:
        if fs.getScheme() == "file":
            where = [jvm.java.io.File(p.toUri().getPath()).toPath() for p in (target, aside)]
            jvm.java.nio.file.Files.createLink(*where)
        else:
            options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), conf).rename(aside, target, options)
    except Exception:
        if fs.exists(target):
            return False
        raise
    finally:
        fs.delete(aside, False)
    return True


def publish_store(tables: dict[str, DataFrame], path: str, name: str) -> None:
    """The three tables as a new version of the store, visible all at once: they are written to a folder of their own,
    and a commit makes it the current one, in place of whatever is. Tables read from an earlier version stay readable."""
    write_store(tables, f"{path}/{name}")
    spark = tables[TABLES[0]].sparkSession
    files = {n: {"": name} for n in TABLES}
    while not try_commit(spark, path, last_commit(spark, path)[0] + 1, {"folders": files}):
        pass


def published_store(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the version published last: each is made of the partitions that the commit names."""
    number, commit = last_commit(spark, path)
    if commit is None:
        raise ValueError(f"nothing is published under {path}")
    return _tables(spark, path, commit)


def _tables(spark: SparkSession, path: str, commit: dict) -> dict[str, DataFrame]:
    out = {}
    for name in TABLES:
        parts = []
        for folder in sorted(set(commit["folders"][name].values())):
            df = read_store(spark, f"{path}/{folder}")[name]
            mine = [p for p, f in commit["folders"][name].items() if f == folder]
            if mine != [""]:
                parts.append(df.filter(F.col(PART).isin([int(p) for p in mine])).drop(PART))
            else:
                parts.append(df)
        out[name] = reduce(lambda a, b: a.unionByName(b), parts)
    return out


#: Column that holds the part of a partitioned store that a document belongs to; all rows of a document are in one.
PART = "__part"


def upsert_store(spark: SparkSession, path: str, new: dict[str, DataFrame], parts: int = 32, name: str | None = None) -> int:
    """Puts the new tables' documents in place of those with the same path and version, and returns the commit's number.

    A store of this kind is cut into parts by a hash of path and version, so that old and new of a document meet in one;
    only parts that hold new documents are written again, under a new folder, and the commit names the folder of every part.
    Several writers may work at once: a commit fails if another was first, and what changed meanwhile is looked at
    again. The first call makes the store."""
    name, attempt = name or f"upsert-{uuid.uuid4().hex}", 0
    placed = _placed(new, parts)
    touched = sorted(r[0] for r in placed["documents"].select(PART).distinct().collect())
    while True:
        number, commit = last_commit(spark, path)
        folders = {n: dict(commit["folders"][n]) for n in TABLES} if commit else {n: {} for n in TABLES}
        if commit and (commit.get("parts") != parts):
            raise ValueError(f"the store has {commit.get('parts')} parts")
        written = {n: placed[n] for n in TABLES}
        folder, again = f"{name}-{attempt}", {n: {p: f for p, f in folders[n].items() if int(p) in touched} for n in TABLES}
        if any(again.values()):
            old = {n: _kept_parts(spark, path, again[n], n) for n in TABLES}
            gone = old["documents"].join(new["documents"].select("source_path", "target_version").distinct(), ["source_path", "target_version"], "left_semi").select(F.col("id").alias("document_id"))
            rest = {"documents": old["documents"].join(gone.withColumnRenamed("document_id", "id"), "id", "left_anti")}
            rest |= {n: old[n].join(gone, "document_id", "left_anti") for n in ("sections", "chunks")}
            written = {n: rest[n].unionByName(placed[n]) for n in TABLES}
        for n in TABLES:
            written[n].repartition(PART).write.partitionBy(PART).parquet(f"{path}/{folder}/{n}")
            folders[n].update({str(p): folder for p in touched})
        if try_commit(spark, path, number + 1, {"folders": folders, "parts": parts}):
            return number + 1
        attempt += 1


def _placed(tables: dict[str, DataFrame], parts: int) -> dict[str, DataFrame]:
    """The tables with the part of each row's document."""
    part = F.pmod(F.xxhash64("source_path", "target_version"), F.lit(parts)).cast("int")
    docs = tables["documents"].withColumn(PART, part)
    of = docs.select(F.col("id").alias("document_id"), PART)
    return {"documents": docs, **{n: tables[n].join(of, "document_id") for n in ("sections", "chunks")}}


def _kept_parts(spark: SparkSession, path: str, where: dict[str, str], name: str) -> DataFrame:
    """The rows of parts of one table, by part and folder."""
    rows = [read_store(spark, f"{path}/{folder}")[name].filter(F.col(PART).isin([int(p) for p, f in where.items() if f == folder])) for folder in sorted(set(where.values()))]
    return reduce(lambda a, b: a.unionByName(b), rows)


def write_json_log(events: DataFrame, path: str) -> None:
    """Query-log events as JSON lines, added to what is there."""
    events.write.mode("append").json(path)


def work_folder(spark: SparkSession) -> str:
    """A new folder where all executors can write: in spark.checkpoint.dir. Where that is unset a local master gets a
    temporary one, and a cluster an error. The driver's JVM deletes it at its end."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-inkwell-')}"
    path = f"{base}/work-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def as_json(*columns: Column | str) -> Column:
    return F.to_json(F.struct(*columns))
