"""A BM25 index kept as tables: increments, search that prunes exactly, and filters for each query.

The index is a list of segments, named by the last commit under its path. A segment has these tables:

- chunks: chunk_id, the lengths of its fields, its facet, the counts of its terms, and a signature, bits that its terms set;
- postings: term, field, facet, tier, chunk_id, tf, length, range-sorted by term, so that a frequent term is cut over many
  files and a reader of few terms skips most. The tier says how much of the most that a term can add to a score a posting adds;
- tiers: for each term, field, facet and tier the number of postings, the largest addition and the largest tf;
- terms and fields: df, chunks and lengths. They are signed: a segment that replaces or deletes chunks takes away
  what these had, so sums over segments are those of the chunks that are left;
- gone: the ids whose rows in earlier segments are dead.

An increment reads the new chunks and, of the old ones, the stored counts of those it replaces, in the buckets of ids they
are in. When increments have grown, merge writes one segment from the stored counts. Several writers may work at once.

A search fixes each query's k-th score first: of the tiers of its terms it reads those that lower the bound of unread
postings most per posting, until a few times k postings are met, and scores the best chunks of these exactly. Then it reads
tiers in the same order until a chunk that is in none of them can't reach that score. For chunks met, a bound adds to what
was read the most that unread tiers can add, for terms that the signature doesn't rule out; what stays below the k-th
score is dropped, and the rest is scored exactly. Chunks that a query's filter excludes are left out by the facet of
postings and tiers, before anything is read of them or scored."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType
from pyspark.sql.window import Window

from inkwell.operators.bm25 import FIELDS, small, tokens, top_k
from inkwell.sources.files import last_commit, try_commit, work_folder

#: Steps between the least and the most that a posting can add, bits of a chunk's signature, and buckets of ids.
TIERS, SIGNATURE, ID_BUCKETS = 32, 2048, 64
#: The first pass meets so many times k postings and scores so many times k chunks.
FIRST_POSTINGS, FIRST_CHUNKS = 400, 4
#: A query whose terms have up to so many postings is scored from all of them, without bounds.
DIRECT = 200_000
#: Chunks of a batch that are counted at a time.
COUNTED = 512
TABLES = ("chunks", "postings", "tiers", "terms", "fields", "gone")


@dataclass(frozen=True)
class TextIndex:
    """The segments of a commit, oldest first, with the average lengths at which their tiers were cut."""

    spark: SparkSession
    path: str
    segments: tuple[dict, ...]
    facets: tuple[str, ...]
    k1: float
    b: float
    schema: dict

    def table(self, name: str) -> DataFrame:
        """A table of all segments, with the segment's number."""
        read = self.spark.read.schema(StructType.fromJson(self.schema)) if name == "chunks" else self.spark.read
        parts = [read.parquet(f"{self.path}/{s['name']}/{name}").withColumn("segment", F.lit(i)) for i, s in enumerate(self.segments)]
        return reduce(lambda x, y: x.unionByName(y), parts)

    def live_chunks(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """The chunks that no later segment replaces or deletes; of some buckets of ids, if they are given."""
        chunks = self.table("chunks")
        if buckets is not None:
            chunks = chunks.filter(F.col("id_bucket").isin([int(i) for i in buckets]))
        if len(self.segments) == 1:
            return chunks
        gone = self.table("gone").groupBy(F.col("chunk_id").alias("__gone")).agg(F.max("segment").alias("__until"))
        return chunks.join(gone, F.col("chunk_id") == F.col("__gone"), "left").filter("__until IS NULL OR __until <= segment").drop("__gone", "__until")

    def terms(self) -> DataFrame:
        """term, field, df."""
        return self.table("terms").groupBy("term", "field").agg(F.sum("df").alias("df")).filter("df > 0")

    def fields(self) -> DataFrame:
        """field, n, avg_length: one row for each field."""
        return self.table("fields").groupBy("field").agg(F.sum("n").alias("n"), F.sum("length").alias("length")).select("field", "n", F.when(F.col("n") > 0, F.col("length") / F.col("n")).alias("avg_length"))


def open_index(spark: SparkSession, path: str) -> TextIndex:
    commit = last_commit(spark, path)[1]
    if commit is None:
        raise ValueError(f"no index under {path}")
    return TextIndex(spark, path, tuple(commit["segments"]), tuple(commit["facets"]), commit["k1"], commit["b"], commit["schema"])


def saturation(tf: Column, length: Column, avg: Column, k1: float, b: float) -> Column:
    """What a posting adds to a score, over its weight: less than k1 + 1."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avg))


def term_bit(term: Column | str, field: Column | str) -> Column:
    return F.pmod(F.xxhash64(term, field), F.lit(SIGNATURE)).cast("int")


def facet_key(facets: Sequence[str]) -> Column:
    """The number of a combination of facets."""
    return F.xxhash64(*(F.col(c) for c in facets)) if facets else F.lit(0).cast("long")


def _marks(bits: pa.Array) -> pa.Array:
    """Lists of bits as signatures."""
    rows = np.repeat(np.arange(len(bits)), np.diff(bits.offsets.to_numpy()))
    marks = np.zeros((len(bits), SIGNATURE), bool)
    marks[rows, bits.flatten().to_numpy(zero_copy_only=False)] = True
    words = np.packbits(marks, axis=1, bitorder="little").view(np.int64)
    width = SIGNATURE // 64
    return pa.ListArray.from_arrays(pa.array(np.arange(len(bits) + 1, dtype=np.int32) * width), pa.array(words.reshape(-1)))


@F.arrow_udf(ArrayType(LongType()))
def _signature(bits: pa.Array) -> pa.Array:
    return pa.concat_arrays([_marks(bits.slice(at, COUNTED)) for at in range(0, max(1, len(bits)), COUNTED)])


@F.arrow_udf(ArrayType(StructType().add("term", StringType()).add("field", StringType()).add("tf", LongType())))
def _counts(*words: pa.Array) -> pa.Array:
    """Of the words of each field how often each stands there; rows of a batch are counted in parts."""
    kind = pa.list_(pa.struct([("term", pa.string()), ("field", pa.string()), ("tf", pa.int64())]))
    out = [pa.array([], kind)]
    for at in range(0, len(words[0]), COUNTED):
        some = [w.slice(at, COUNTED) for w in words]
        flat = pa.concat_arrays([w.flatten().cast(pa.string()) for w in some]).dictionary_encode()
        n_terms, code = max(1, len(flat.dictionary)), flat.indices.to_numpy().astype(np.int64)
        row = np.concatenate([np.repeat(np.arange(len(w)), pc.fill_null(pc.list_value_length(w), 0).to_numpy()) for w in some])
        field = np.repeat(np.arange(len(some)), [len(w.flatten()) for w in some])
        key, tf = np.unique((row * len(some) + field) * n_terms + code, return_counts=True)
        cuts = pa.array(np.searchsorted(key, np.arange(len(some[0]) + 1) * len(some) * n_terms).astype(np.int32))
        named = pa.array(FIELDS).take(pa.array(key // n_terms % len(some)))
        terms = pa.StructArray.from_arrays([flat.dictionary.take(pa.array(key % n_terms)), named, pa.array(tf.astype(np.int64))], ["term", "field", "tf"])
        out.append(pa.ListArray.from_arrays(cuts, terms))
    return pa.concat_arrays(out)


def _counted(chunks: DataFrame, facets: Sequence[str]) -> DataFrame:
    """chunk_id, id_bucket, facet and its columns, lengths, terms (term, field, tf) and signature of chunks."""
    rows = chunks.select("chunk_id", *facets, *(tokens(f).alias(f) for f in FIELDS))

    rows = rows.select("chunk_id", *facets, *(F.size(f).alias(f"{f}_length") for f in FIELDS), _counts(*(F.col(f) for f in FIELDS)).alias("terms"))
    return rows.select("chunk_id", F.pmod(F.xxhash64("chunk_id"), F.lit(ID_BUCKETS)).cast("int").alias("id_bucket"), facet_key(facets).alias("facet"), *facets, *(f"{f}_length" for f in FIELDS), "terms", _signature(F.transform("terms", lambda t: term_bit(t["term"], t["field"]))).alias("signature"))


def _write_chunks(rows: DataFrame, path: str) -> DataFrame:
    """Each bucket of ids is written by a few tasks, so that there are few files."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64("chunk_id", F.lit(1)), F.lit(max(1, parts // ID_BUCKETS)))
    rows = rows.select(*(c for c in rows.columns if c != "id_bucket"), "id_bucket")
    rows.repartition(parts, "id_bucket", salt).write.mode("overwrite").partitionBy("id_bucket").parquet(f"{path}/chunks")
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/chunks")


def _field_sums(chunks: DataFrame, sign: int = 1) -> DataFrame:
    parts = [chunks.select(F.lit(f).alias("field"), F.col(f"{f}_length").alias("length")) for f in FIELDS]
    return parts[0].unionByName(parts[1]).groupBy("field").agg((F.count(F.lit(1)) * sign).alias("n"), (F.coalesce(F.sum("length"), F.lit(0)) * sign).alias("length"))


def _term_sums(chunks: DataFrame, sign: int = 1) -> DataFrame:
    return chunks.select(F.inline("terms")).groupBy("term", "field").agg((F.count(F.lit(1)) * sign).alias("df"))


def _write_postings(chunks: DataFrame, path: str, avg: dict[str, float], k1: float, b: float) -> None:
    """Postings and tiers of a segment's chunks."""
    length = F.when(F.col("field") == FIELDS[0], F.col(f"{FIELDS[0]}_length")).otherwise(F.col(f"{FIELDS[1]}_length"))
    mean = F.when(F.col("field") == FIELDS[0], F.lit(avg[FIELDS[0]])).otherwise(F.lit(avg[FIELDS[1]]))
    rows = chunks.select("chunk_id", "facet", *(f"{f}_length" for f in FIELDS), F.inline("terms")).withColumn("length", length)
    share = saturation(F.col("tf"), F.col("length"), mean, k1, b) / (k1 + 1)
    rows = rows.select("term", "field", "facet", F.floor((1 - share) * TIERS).cast("int").alias("tier"), "chunk_id", "tf", "length")
    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(parts, "term", "field", "facet", "tier", "chunk_id").sortWithinPartitions("term", "field", "facet", "tier", "chunk_id").write.mode("overwrite").parquet(f"{path}/postings")
    held = chunks.sparkSession.read.parquet(f"{path}/postings")
    tiers = held.groupBy("term", "field", "facet", "tier").agg(F.count(F.lit(1)).alias("n"), F.max(saturation(F.col("tf"), F.col("length"), mean, k1, b)).alias("top"), F.max("tf").alias("most"))
    tiers.write.mode("overwrite").parquet(f"{path}/tiers")


def _averages(fields: DataFrame) -> dict[str, float]:
    found = {r["field"]: r["avg_length"] for r in fields.collect()}  # one row for each field
    return {f: found.get(f) or 1.0 for f in FIELDS}


def create_index(chunks: DataFrame, path: str, facets: Sequence[str] = (), k1: float = 1.2, b: float = 0.75) -> TextIndex:
    """The index of chunks (chunk_id, content, section_title and the columns facets that queries may filter by; ids are
    unique) under path, where none is yet."""
    spark, name = chunks.sparkSession, f"segment-{uuid.uuid4().hex}"
    folder = f"{path}/{name}"
    held = _write_chunks(_counted(chunks, facets), folder)
    _field_sums(held).write.parquet(f"{folder}/fields")
    avg = _averages(spark.read.parquet(f"{folder}/fields").withColumn("avg_length", F.expr("CASE WHEN n > 0 THEN length / n END")))
    _write_postings(held, folder, avg, k1, b)
    spark.read.parquet(f"{folder}/tiers").groupBy("term", "field").agg(F.sum("n").alias("df")).write.parquet(f"{folder}/terms")
    held.select("chunk_id").limit(0).write.parquet(f"{folder}/gone")
    commit = {"segments": [{"name": name, "avg": avg}], "facets": list(facets), "k1": k1, "b": b, "schema": held.schema.jsonValue()}
    if not try_commit(spark, path, 1, commit):
        raise ValueError(f"there is an index under {path}")
    return open_index(spark, path)


def update_index(index: TextIndex, chunks: DataFrame, deleted: DataFrame | None = None) -> TextIndex:
    """The index with chunks in place of those with the same ids, and without the deleted ones (chunk_id). Texts of
    other chunks are not read, nor their counts outside the buckets of ids that change."""
    spark, name = index.spark, f"segment-{uuid.uuid4().hex}"
    folder = f"{index.path}/{name}"
    held = _write_chunks(_counted(chunks, index.facets), folder)
    gone = held.select("chunk_id")
    if deleted is not None:
        gone = gone.unionByName(deleted.select("chunk_id"))
    gone.distinct().write.mode("overwrite").parquet(f"{folder}/gone")
    gone = spark.read.parquet(f"{folder}/gone")
    buckets = [r[0] for r in gone.select(F.pmod(F.xxhash64("chunk_id"), F.lit(ID_BUCKETS)).cast("int")).distinct().collect()]
    avg = _averages(index.fields())
    _write_postings(held, folder, avg, index.k1, index.b)
    while True:
        number, commit = last_commit(spark, index.path)
        now = open_index(spark, index.path)
        dead = now.live_chunks(buckets).join(gone, "chunk_id", "left_semi")
        for table, sums, keys in (("fields", _field_sums, ["field"]), ("terms", _term_sums, ["term", "field"])):
            both = sums(held).unionByName(sums(dead, -1))
            both.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in both.columns if c not in keys)).write.mode("overwrite").parquet(f"{folder}/{table}")
        if try_commit(spark, index.path, number + 1, {**commit, "segments": [*commit["segments"], {"name": name, "avg": avg}]}):
            return open_index(spark, index.path)


def merge_index(index: TextIndex, share: float = 0.0) -> TextIndex:
    """The index as one segment, made of the stored counts, if the later segments hold more than a share of the chunks of the
    first; else as it is. Fails if another writer commits meanwhile; nothing is lost then."""
    sizes = {r["segment"]: r["n"] for r in index.table("chunks").groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()}
    later = sum(n for s, n in sizes.items() if s)
    if len(index.segments) == 1 or (later <= share * sizes.get(0, 0) and share):
        return index
    spark, name = index.spark, f"segment-{uuid.uuid4().hex}"
    number, commit = last_commit(spark, index.path)
    if [s["name"] for s in commit["segments"]] != [s["name"] for s in index.segments]:
        raise ValueError("the index has changed")
    folder, avg = f"{index.path}/{name}", _averages(index.fields())
    held = _write_chunks(index.live_chunks().drop("segment"), folder)
    _field_sums(held).write.parquet(f"{folder}/fields")
    _write_postings(held, folder, avg, index.k1, index.b)
    spark.read.parquet(f"{folder}/tiers").groupBy("term", "field").agg(F.sum("n").alias("df")).write.parquet(f"{folder}/terms")
    held.select("chunk_id").limit(0).write.parquet(f"{folder}/gone")
    if not try_commit(spark, index.path, number + 1, {**commit, "segments": [{"name": name, "avg": avg}]}):
        raise ValueError("the index has changed")
    return open_index(spark, index.path)


def allowed_facets(index: TextIndex, queries: DataFrame, fixed: dict[str, str] | None = None) -> DataFrame:
    """(filter, facet): for each filter among the queries the facets it admits. A query's filter are its columns named
    like facets (null, empty or All: any); fixed values hold for all queries."""
    own = [c for c in index.facets if c in queries.columns]
    asked = queries.select(*own).distinct().select(_filter(own).alias("filter"), *(F.col(c).alias(f"__{c}") for c in own))
    known = index.table("chunks").select("facet", *index.facets).distinct()
    for column, value in (fixed or {}).items():
        known = known.filter(F.col(column) == value)
    fits = reduce(lambda x, y: x & y, [F.coalesce(F.col(f"__{c}"), F.lit("")).isin("", "All") | (F.col(c) == F.col(f"__{c}")) for c in own], F.lit(True))
    return known.join(F.broadcast(asked), fits).select("filter", "facet").distinct()


def with_filter(index: TextIndex, queries: DataFrame) -> DataFrame:
    """queries with the number of their filter, as allowed_facets has it."""
    return queries.withColumn("filter", _filter([c for c in index.facets if c in queries.columns]))


def _filter(columns: Sequence[str]) -> Column:
    return F.xxhash64(F.lit(0), *(F.coalesce(F.col(c), F.lit("")) for c in columns))


class _Search:
    """One batch of queries over an index; the tables between its passes are written to a work folder."""

    def __init__(self, index: TextIndex, queries: DataFrame, title_boost: float, fixed: dict[str, str] | None, direct: int):
        self.index, self.spark = index, index.spark
        self.folder = work_folder(self.spark)
        own = [c for c in index.facets if c in queries.columns]
        self.filters = self.held(allowed_facets(index, queries, fixed)) if own or fixed else None
        asked = queries.select("query_id", _filter(own).alias("filter"), F.explode(F.array_distinct(tokens("query"))).alias("term"))
        idf = F.log(F.lit(1.0) + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weight = idf * F.when(F.col("field") == "section_title", F.lit(title_boost)).otherwise(F.lit(1.0))
        weights = asked.join(index.terms(), "term").join(F.broadcast(index.fields()), "field")
        total = F.sum("df").over(Window.partitionBy("query_id"))
        every = self.held(weights.select("query_id", "filter", "term", "field", weight.alias("weight"), "avg_length", total.alias("total")))
        #: Terms of the queries that are scored from all their postings, and of those that need bounds.
        self.few, self.weights = (every.filter(c).drop("total") for c in (F.col("total") <= direct, F.col("total") > direct))
        self.bounds = not self.weights.isEmpty()
        if self.bounds:
            self.words = self.held(self.weights.select("term", "field").distinct())
            self.heads = self.held(self._heads())

    def kept(self, df: DataFrame) -> DataFrame:
        """df as a table."""
        path = f"{self.folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def held(self, df: DataFrame) -> DataFrame:
        """df for several uses: broadcast if it is small, else as a table."""
        return small(df)

    def _heads(self) -> DataFrame:
        """A row for each query, term, field and tier: the postings in it, the bound top of what one can add from here on,
        and best, the order in which tiers are read."""
        tiers = self.index.table("tiers").join(self.words, ["term", "field"])
        keys = ["term", "field", "tier", "segment"]
        if self.filters is not None:
            tiers, keys = tiers.join(self.filters, "facet"), ["filter", *keys]
        tiers = tiers.groupBy(*keys).agg(F.sum("n").alias("n"), F.max("top").alias("top"), F.max("most").alias("most"))
        both = tiers.join(self.weights, [c for c in ("filter", "term", "field") if c in tiers.columns])
        # tiers were cut at another average length: a longer one lets postings add more, by the ratio at most
        cut = reduce(lambda x, s: F.when((F.col("segment") == s[0]) & (F.col("field") == s[1]), F.lit(s[2])).otherwise(x), [(i, f, s["avg"][f]) for i, s in enumerate(self.index.segments) for f in FIELDS], F.lit(1.0))
        both = both.withColumn("top", F.col("weight") * F.col("top") * F.greatest(F.lit(1.0), F.col("avg_length") / cut))
        rows = both.groupBy("query_id", "filter", "term", "field", "tier", "weight", "avg_length").agg(F.sum("n").alias("n"), F.max("top").alias("top"), F.max("most").alias("most"))
        of = Window.partitionBy("query_id", "term", "field").orderBy("tier")
        onward = of.rowsBetween(0, Window.unboundedFollowing)
        rows = rows.withColumn("top", F.max("top").over(onward)).withColumn("most", F.max("most").over(onward))
        rows = rows.withColumn("drop", F.col("top") - F.coalesce(F.lead("top").over(of), F.lit(0.0))).withColumn("most_after", F.coalesce(F.lead("most").over(of), F.lit(0)))
        rows = rows.withColumn("best", F.min(F.col("drop") / F.col("n")).over(of.rowsBetween(Window.unboundedPreceding, 0)))
        # at most TIERS rows for each term of a query
        order = Window.partitionBy("query_id").orderBy(F.desc("best"), "term", "field", "tier")
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        every = F.sum("drop").over(Window.partitionBy("query_id"))
        return rows.withColumn("met", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("bound", every - F.coalesce(F.sum("drop").over(before), F.lit(0.0)))

    def whole(self) -> DataFrame:
        """query_id, chunk_id, score of all chunks that the queries with few postings meet."""
        rows = self.index.table("postings").join(self.few, ["term", "field"])
        if self.filters is not None:
            rows = rows.join(self.filters, ["filter", "facet"], "left_semi")
        found = rows.groupBy("query_id", "chunk_id", "segment").agg(F.sum(self._adds()).alias("score"))
        return self.live(found).select("query_id", "chunk_id", "score")

    def met(self, taken: DataFrame) -> DataFrame:
        """query_id, chunk_id, segment, partial (exact, of the tiers taken) and over (the same less the bounds of the terms
        met) of chunks in the tiers taken; sets the cuts that go with them."""
        last = taken.groupBy("query_id", "term", "field").agg(F.max("tier").alias("through"), F.min_by(F.struct("top", "drop", "most_after"), -F.col("tier")).alias("at"))
        last = last.select("query_id", "term", "field", "through", F.greatest(F.col("at.top") - F.col("at.drop"), F.lit(0.0)).alias("rest"), "at.most_after")
        # of terms of which nothing is taken all is unread
        first = self.heads.groupBy("query_id", "filter", "term", "field", "weight", "avg_length").agg(F.max("top").alias("whole"), F.max("most").alias("most"))
        cuts = first.join(last, ["query_id", "term", "field"], "left").withColumns({"through": F.coalesce("through", F.lit(-1)), "rest": F.coalesce("rest", "whole"), "most": F.coalesce("most_after", "most")})
        self.cuts = self.held(cuts.select("query_id", "filter", "term", "field", "weight", "avg_length", "through", "rest", "most"))
        rows = self.index.table("postings").join(self.cuts.filter("through >= 0"), ["term", "field"]).filter("tier <= through")
        if self.filters is not None:
            rows = rows.join(self.filters, ["filter", "facet"], "left_semi")
        instead = F.when((F.col("rest") > 0) & (F.col("most") > 0), self._unread(F.col, F.col("length"))).otherwise(F.lit(0.0))
        adds = self._adds()
        return rows.groupBy("query_id", "chunk_id", "segment").agg(F.sum(adds).alias("partial"), F.sum(adds - instead).alias("over"))

    def _adds(self) -> Column:
        return F.col("weight") * saturation(F.col("tf"), F.col("length"), F.col("avg_length"), self.index.k1, self.index.b)

    def _unread(self, of, length: Column) -> Column:
        """The most that an unread posting of a cut can add to a chunk of this length."""
        return F.least(of("rest"), of("weight") * saturation(of("most"), length, of("avg_length"), self.index.k1, self.index.b))

    def live(self, met: DataFrame, *columns: str) -> DataFrame:
        """The rows met whose chunk has not been replaced or deleted, with columns of their chunks."""
        if len(self.index.segments) == 1 and not columns:
            return met
        return met.join(self.index.live_chunks().select("chunk_id", "segment", *columns), ["chunk_id", "segment"])

    def bounded(self, met: DataFrame) -> DataFrame:
        """The live rows met with upper, which their score can't exceed."""
        cut = F.struct(term_bit("term", "field").alias("bit"), (F.col("field") == FIELDS[0]).alias("content"), "weight", "most", "avg_length", "rest")
        open_ = self.cuts.filter("rest > 0 AND most > 0").groupBy("query_id").agg(F.collect_list(cut).alias("open"))  # one entry for each term of a query

        def add(total: Column, cut: Column) -> Column:
            length = F.when(cut["content"], F.col(f"{FIELDS[0]}_length")).otherwise(F.col(f"{FIELDS[1]}_length"))
            return total + F.when(_has_bit(F.col("signature"), cut["bit"]), self._unread(lambda c: cut[c], length)).otherwise(F.lit(0.0))

        both = self.live(met, "signature", *(f"{f}_length" for f in FIELDS)).join(self.held(open_), "query_id", "left")
        upper = F.col("over") + F.when(F.col("open").isNull(), F.lit(0.0)).otherwise(F.aggregate("open", F.lit(0.0), add))
        return both.select("query_id", "chunk_id", "segment", "partial", upper.alias("upper"))

    def exact(self, rows: DataFrame) -> DataFrame:
        """query_id, chunk_id, score of rows met last: what unread tiers add is looked up by chunk and term."""
        rows = self.kept(rows.select("query_id", "chunk_id", "segment", "partial"))
        unread = self.cuts.filter("rest > 0").select("query_id", "term", "field", "through", "weight", "avg_length", term_bit("term", "field").alias("bit"))
        missing = self.live(rows, "signature").join(unread, "query_id").filter(_has_bit(F.col("signature"), F.col("bit"))).drop("signature", "partial", "bit")
        held = self.index.table("postings").join(self.words, ["term", "field"], "left_semi").select("chunk_id", "segment", "term", "field", "tier", "tf", "length")
        more = missing.join(held, ["chunk_id", "segment", "term", "field"]).filter("tier > through").select("query_id", "chunk_id", self._adds().alias("part"))
        return rows.select("query_id", "chunk_id", F.col("partial").alias("part")).unionByName(more).groupBy("query_id", "chunk_id").agg(F.sum("part").alias("score"))


def _has_bit(signature: Column, bit: Column) -> Column:
    return F.get(signature, F.floor(bit / 64).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)))) != 0


def pruned_search(index: TextIndex, queries: DataFrame, k: int = 50, title_boost: float = 3.0, digits: int | None = None, fixed: dict[str, str] | None = None, direct: int = DIRECT, counted: list | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank: the best k chunks of each query (query_id, query, and any of the index's facets
    as its own filter), the same rows as bm25.search gives. digits: round scores before ranking. fixed: facet values that
    hold for all queries. direct: queries whose terms have up to so many postings are scored from all of them at once; bounds
    would cost more than they save. counted: gets the rows (query_id, chunk_id) that were scored exactly."""
    run = _Search(index, queries, title_boost, fixed, direct)
    order = [F.desc("score"), F.col("chunk_id")]
    final = lambda c: c if digits is None else F.round(c, digits)
    scored = run.whole()
    if run.bounds:
        near = run.live(run.met(run.heads.filter(F.col("met") < FIRST_POSTINGS * k)))
        seeded = run.held(run.exact(top_k(near, "query_id", [F.desc("partial"), F.col("chunk_id")], FIRST_CHUNKS * k)))
        kth = top_k(seeded, "query_id", order, k).groupBy("query_id").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
        # what rounding may lift, and the sums' own error
        slack = F.lit(0.0 if digits is None else 2.0 * 10.0**-digits) + F.lit(1e-9)
        kth = run.held(kth.select("query_id", (F.col("kth") * (1 - 1e-9) - slack).alias("kth")))
        met = run.met(run.heads.join(kth, "query_id", "left").filter("kth IS NULL OR bound >= kth").drop("kth"))
        rest = run.exact(run.bounded(met).join(kth, "query_id", "left").filter("kth IS NULL OR upper >= kth"))
        scored = scored.unionByName(rest)
        if counted is not None:
            counted.append(seeded.select("query_id", "chunk_id"))
    if counted is not None:
        scored = run.kept(scored)
        counted.append(scored.select("query_id", "chunk_id"))
    return top_k(scored.withColumn("score", final(F.col("score"))), "query_id", order, k)
