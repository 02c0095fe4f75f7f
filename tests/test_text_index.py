"""The stored index against the search that scores everything."""

import random

import pytest
from pyspark.sql import functions as F

from inkwell.operators import bm25, text_index


def made(spark, n, seed=0, words=400, length=60, first=0):
    """Chunks of words with frequencies like those of prose."""
    rng = random.Random(seed)
    vocabulary, weights = [f"w{i}" for i in range(words)], [1 / (i + 2) for i in range(words)]
    rows = [(first + i, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, length))), rng.choice(["w1 w30", "guide", ""]), rng.choice(["en", "de"]), rng.choice(["a", "b", None])) for i in range(n)]
    return spark.createDataFrame(rows, "chunk_id long, content string, section_title string, target_version string, category string")


def asked(spark, seed=1, n=12, of=400, size=4, **columns):
    rng = random.Random(seed)
    rows = [(i, " ".join(f"w{int(of * rng.random() ** 3)}" for _ in range(size))) for i in range(n)] + [(100, "nothing"), (101, ""), (102, None), (103, "w1 W1 w2.w3")]
    df = spark.createDataFrame(rows, "query_id int, query string")
    for name, values in columns.items():
        df = df.withColumn(name, F.element_at(F.array(*(F.lit(v) for v in values)), (F.col("query_id") % len(values) + 1).cast("int")))
    return df


def rows_of(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in df.collect())


def index_rows(index):
    return {(r["term"], r["field"]): r["df"] for r in index.terms().collect()}, {r["field"]: (r["n"], r["avg_length"]) for r in index.fields().collect()}


@pytest.mark.parametrize("k,size", [(3, 4), (10, 12), (400, 3)])
def test_same_rows_as_scoring_everything(spark, tmp_path, k, size):
    chunks = made(spark, 600)
    index = text_index.create_index(chunks, f"file://{tmp_path}/i")
    queries = asked(spark, size=size)
    want = rows_of(bm25.search(bm25.build_index(chunks), queries, k, digits=6))
    for direct in (0, 500, text_index.DIRECT):  # all, some and none of the queries with bounds
        assert rows_of(text_index.pruned_search(index, queries, k, digits=6, direct=direct)) == want


def test_common_words_score_few_pairs(spark, tmp_path):
    chunks = made(spark, 20_000, words=2_000, length=120).cache()
    index = text_index.create_index(chunks, f"file://{tmp_path}/i")
    queries = spark.createDataFrame([(1, "w0 w1 w2"), (2, "w3 w7 w10 w12"), (3, "w0 w20"), (4, "w5 w6 w40 w1500")], "query_id int, query string")
    counted = []
    got = rows_of(text_index.pruned_search(index, queries, 10, digits=6, direct=0, counted=counted))
    held = bm25.build_index(chunks)
    assert got == rows_of(bm25.search(held, queries, 10, digits=6))
    matches = queries.select("query_id", F.explode(bm25.tokens("query")).alias("term")).join(held["postings"], "term").select("query_id", "chunk_id").distinct().count()
    scored = counted[0].unionByName(counted[1]).distinct().count()
    assert scored < matches / 10, (scored, matches)
    chunks.unpersist()


def test_filters_of_queries(spark, tmp_path):
    chunks = made(spark, 500)
    index = text_index.create_index(chunks, f"file://{tmp_path}/i", ["target_version", "category"])
    queries = asked(spark, target_version=["en", "All", None, "fr"], category=["a", "", "b"])
    counted = []
    got = text_index.pruned_search(index, queries, 10, digits=6, direct=0, counted=counted)
    assert rows_of(got) == rows_of(bm25.search(bm25.build_index(chunks), queries, 10, allowed=chunks, digits=6))
    # none that a filter excludes is scored
    own = queries.select("query_id", F.col("target_version").alias("v"), F.col("category").alias("c"))
    outside = counted[1].unionByName(counted[0]).join(chunks, "chunk_id").join(own, "query_id").filter("(v NOT IN ('All') AND v <> target_version) OR (c <> '' AND NOT c <=> category)")
    assert outside.count() == 0
    fixed = text_index.pruned_search(index, asked(spark), 5, digits=6, fixed={"target_version": "de"})
    assert rows_of(fixed) == rows_of(bm25.search(bm25.build_index(chunks), asked(spark), 5, allowed=chunks.filter("target_version = 'de'").select("chunk_id"), digits=6))


def test_increments(spark, tmp_path):
    chunks, path = made(spark, 300), f"file://{tmp_path}/i"
    first = text_index.create_index(chunks, path, ["target_version"])
    new = made(spark, 40, seed=7, length=200, first=280)  # twenty replaced, twenty added
    index = text_index.update_index(first, new)
    index = text_index.update_index(index, chunks.limit(0), spark.createDataFrame([(3,), (290,), (999,)], "chunk_id long"))
    index = text_index.update_index(index, made(spark, 5, seed=8, first=1))
    now = chunks.filter("chunk_id < 280").unionByName(new).filter("chunk_id NOT IN (3, 290)").filter("chunk_id NOT BETWEEN 1 AND 5").unionByName(made(spark, 5, seed=8, first=1))
    plain = text_index.create_index(now, f"file://{tmp_path}/plain", ["target_version"])
    assert index_rows(index) == index_rows(plain)
    queries = asked(spark, target_version=["en", "All"])
    want = rows_of(bm25.search(bm25.build_index(now), queries, 10, allowed=now.select("chunk_id", "target_version"), digits=6))
    for direct in (0, text_index.DIRECT):
        assert rows_of(text_index.pruned_search(index, queries, 10, digits=6, direct=direct)) == want
    assert text_index.merge_index(index, share=0.5).segments == index.segments
    merged = text_index.merge_index(index)
    assert len(merged.segments) == 1 and index_rows(merged) == index_rows(plain)
    assert rows_of(text_index.pruned_search(merged, queries, 10, digits=6)) == want
    # a reader that opened the index before still has its own segments
    assert index_rows(first) == index_rows(text_index.create_index(chunks, f"file://{tmp_path}/first"))
    with pytest.raises(ValueError, match="changed"):
        text_index.merge_index(index)


def test_writers_at_once_lose_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/i"
    first = text_index.create_index(made(spark, 50), path)
    one = text_index.update_index(first, made(spark, 5, seed=2, first=45))
    two = text_index.update_index(first, made(spark, 5, seed=3, first=48))  # opened before the other's commit
    assert len(one.segments) == 2 and len(two.segments) == 3
    now = made(spark, 50).filter("chunk_id < 45").unionByName(made(spark, 5, seed=2, first=45).filter("chunk_id < 48")).unionByName(made(spark, 5, seed=3, first=48))
    assert index_rows(two) == index_rows(text_index.create_index(now, f"file://{tmp_path}/plain"))


def test_empty_index(spark, tmp_path):
    none = made(spark, 1).limit(0)
    index = text_index.create_index(none, f"file://{tmp_path}/i")
    assert text_index.pruned_search(index, asked(spark), 5).count() == 0
    index = text_index.update_index(index, made(spark, 3))
    assert index.fields().filter("n = 3").count() == 2
    with pytest.raises(ValueError, match="there is an index"):
        text_index.create_index(none, f"file://{tmp_path}/i")
