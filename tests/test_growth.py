"""What may not grow with the tables: rows between stages, what a Python worker holds, rows and files of tables."""

import tracemalloc
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkwell.functions import vectors
from inkwell.functions.encoders import WordLengthEncoder
from inkwell.operators import bm25, html, vector_search
from inkwell.plans.queries import QUERIES


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["r3_bm25", "r5_rrf", "v1_keyword_relevance", "v6_failures"])
def test_pairs_of_queries_and_chunks_are_no_rows(spark, sf_dir, name):
    made = plan(QUERIES[name](spark, sf_dir))
    assert "InMemoryRelation" not in made and "query_id#" in made
    assert not [line for line in made.splitlines() if "Aggregate [query_id" in line and "chunk_id" in line]


def test_best_of_each_task_are_those_of_all(spark):
    """Ties, copies, null and empty texts, over several batches of a task; the same rows as by joins, with and without digits."""
    rows = [(i, [None, "", "a b", "a a c", "b c d e", "x"][i % 6], "a t" if i % 4 else None) for i in range(700)]
    chunks = spark.createDataFrame(rows, "chunk_id int, content string, section_title string").repartition(3)
    queries = spark.createDataFrame([("p", "a b"), ("q", "c c z"), ("r", "z"), ("s", None)], "query_id string, query string")
    index = bm25.build_index(chunks)
    joined = {k: v for k, v in index.items() if k != "chunks"}
    for digits in (None, 6):
        got, want = ([(r["query_id"], r["chunk_id"], round(r["score"], 9), r["rank"]) for r in bm25.search(i, queries, 9, digits=digits).orderBy("query_id", "rank").collect()] for i in (index, joined))
        assert got == want and len(got) == 18


def test_counted_terms_are_those_asked():
    words = pa.array([["b", "a", "b"], [], None, ["z"]] * 300)
    places, counts = bm25._counted_terms(words, pa.array(["a", "b", "c"]))
    assert places.to_pylist() == [[0, 1], [], [], []] * 300 and counts.to_pylist() == [[1, 2], [], [], []] * 300


def held_by(monkeypatch, make, *columns):
    """The most bytes of Python objects and numpy arrays while a vectorised function runs over columns, and its result."""
    found, real = [], F.arrow_udf
    monkeypatch.setattr(F, "arrow_udf", lambda kind: lambda f: found.append(f) or real(kind)(f))
    make()
    monkeypatch.undo()
    tracemalloc.start()
    made = found[0](*columns)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak, made


def test_pages_of_a_batch_are_not_all_python_objects(spark, monkeypatch):
    pages = pa.array([f"<h1>T{i}</h1>" + "x" * 20_000 for i in range(500)] + [None])
    made_of = spark.createDataFrame([], "url string, html string")
    peak, made = held_by(monkeypatch, lambda: html.convert_pages(made_of), pages, pa.array([None] * 501, pa.string()))
    assert peak < 8_000_000 and len(made) == 501
    assert made[499]["title"].as_py() == "T499" and made[500]["error"].as_py() == "ValueError: no html" and made[500]["markdown"].as_py() is None


def test_rows_of_a_batch_are_encoded_in_parts(spark, monkeypatch):
    texts, errors = ["a bb " * 2_000 + str(i) for i in range(1_000)] + ["no", None], [None] * 1_000 + ["E", None]
    rows = spark.createDataFrame([], "content string, error string")
    peak, made = held_by(monkeypatch, lambda: vector_search.embed(rows, lambda: WordLengthEncoder(4), low=4, errors=True), pa.array(texts), pa.array(errors, pa.string()))
    assert peak < 8_000_000 and len(made) == 1_002
    assert made[7]["token_count"].as_py() == 4_001 and made[1_000]["error"].as_py() == "E" and made[1_001]["token_count"].as_py() == 0


def test_packed_vectors_are_unpacked_in_parts(monkeypatch):
    made = np.random.default_rng(1).normal(size=(200, 16))
    doc, query = vectors.pack(vectors.low_dim(made, 16)), vectors.pack(vectors.low_dim(made[:9], 16))
    peak, score = held_by(monkeypatch, lambda: vectors.maxsim(16), pa.array([query] * 4_000 + [None]), pa.array([doc, None] * 2_000 + [doc]))
    assert peak < 40_000_000 and np.allclose(score[0].as_py(), vectors.maxsim_score(query, doc, 16)) and score[1].as_py() == score[4_000].as_py() == 0


def test_words_are_counted_in_parts(monkeypatch):
    """Counts by field, in rows that are null, empty or hold a word in both fields; not sorted word by word in expressions."""
    from inkwell.operators import text_index

    monkeypatch.setattr(text_index, "COUNTED", 2)
    content, title = pa.array([["b", "a", "b"], None, [], ["z"], ["a"]]), pa.array([["b"], ["c", "c"], [], None, ["a", "q"]])
    got = [sorted((t["term"], t["field"], t["tf"]) for t in row) for row in text_index._counts.func(content, title).to_pylist()]
    c, t = bm25.FIELDS
    assert got == [[("a", c, 1), ("b", c, 2), ("b", t, 1)], [("c", t, 2)], [], [("z", c, 1)], [("a", c, 1), ("a", t, 1), ("q", t, 1)]]


def test_python_runs_once_for_each_row_under_a_filter(spark, sf_dir):
    """A filter on what Python made is not pushed below it, which would run it twice, in two workers for each core."""
    runs = lambda df: df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [")
    from inkwell.operators import rerank
    from inkwell.plans.queries import page_files

    assert runs(page_files(spark, sf_dir)) == 1
    texts = spark.createDataFrame([(1, "a b"), (2, "no")], "id int, content string")
    made = vector_search.embed(texts, lambda: WordLengthEncoder(4, "no"), low=4, errors=True).filter("error IS NULL")
    assert runs(made) == 1 and [r["id"] for r in made.collect()] == [1]
    packed = vectors.pack(vectors.low_dim(np.eye(4), 4))
    hits = spark.createDataFrame([(1, 7, 1, 0.5, packed)], "query_id int, chunk_id int, rank int, similarity double, multi_vector_low_dim binary")
    best = rerank.rerank(hits, spark.createDataFrame([(1, packed)], "query_id int, multi binary"), 4)
    assert runs(best) == 1 and best.first()["rerank_score"] == 1.0


@pytest.mark.parametrize("marks", [1 << 25, 0])
def test_a_gram_has_a_row_for_each_part_not_for_each_id(spark, tmp_path, monkeypatch, marks):
    """Of nulls, short texts, characters beyond 16 bits and several parts of a batch the same pairs as by plain Python."""
    from inkwell.operators import catalog

    monkeypatch.setattr(catalog, "MARKS", marks)
    given = [(f"s{i}", ["The the", "", None, "ab", "\U0001f600ßx\ny", "thethe" * 20][i % 6], "Thx" if i % 2 else None) for i in range(600)]
    rows = spark.createDataFrame(given, "id string, content string, title string").repartition(2)
    catalog.write_gram_index(rows, ["content", "title"], f"{tmp_path}/grams")
    index = spark.read.parquet(f"{tmp_path}/grams")
    want = {(t.lower()[k : k + 3], i) for i, *texts in given for t in texts if t for k in range(len(t) - 2)}
    got = [(r["gram"], i) for r in index.collect() for i in r["ids"]]
    assert len(got) == len(set(got)) and set(got) == want
    assert index.count() <= 2 * len({g for g, _ in want})
    assert not list(catalog._gram_pairs([pa.array(["ab", None])])[0])


def test_small_files_do_not_get_a_task_each(spark, tmp_path):
    """Texts as they were written, other bytes than ASCII too, by tasks whose number follows from their bytes."""
    from inkwell.sources import files

    key, rows = "spark.sql.files.maxPartitionBytes", [(f"{i % 3}/{i} é.md", f"# é\r\n{i}\U0001f600") for i in range(60)]
    files.write_text_files(spark.createDataFrame(rows, "rel_path string, content string"), f"file://{tmp_path}/out")
    before = spark.conf.get(key)
    spark.conf.set(key, "4m")
    try:
        read = files.read_markdown(spark, f"file://{tmp_path}/out")
        assert read.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
        assert sorted(r["content"] for r in read.collect()) == sorted(t for _, t in rows)
    finally:
        spark.conf.set(key, before)


@pytest.mark.parametrize("listed", [10_000, 1])
def test_files_are_listed_by_tasks(spark, tmp_path, monkeypatch, listed):
    """The driver holds no list of files. Each is read once, at any depth, an empty one and one named like the page of a root too."""
    from inkwell.sources import files

    monkeypatch.setattr(files, "LISTED", listed)
    monkeypatch.setattr(files, "NAMES", 2)
    names = ["_root_.md", "empty.md", "a b/100% é#.md", "x=1/y/z/deep.md", *(f"many/{i}/{i}.md" for i in range(40))]
    rows = spark.createDataFrame([(n, "" if n == "empty.md" else n) for n in [*names, "x.txt", "a b/x.md.txt"]], "rel_path string, content string")
    files.write_text_files(rows, f"file://{tmp_path}/out")
    read = files.read_markdown(spark, f"{tmp_path}/out")
    assert "binaryFile" not in plan(read) and read.inputFiles() == []
    assert sorted((unquote(r["path"]), r["content"]) for r in read.collect()) == sorted((f"file:{tmp_path}/out/{n}", "" if n == "empty.md" else n) for n in names)
    assert [r["path"] for r in files.read_markdown(spark, f"{tmp_path}/out/a b").collect()] == [f"file:{tmp_path}/out/a%20b/100%25%20é%23.md"]
    assert files.read_markdown(spark, f"{tmp_path}/out/x.txt").collect() == []
    # a pattern of folders is left to Spark's reader
    assert [r["content"] for r in files.read_markdown(spark, f"{tmp_path}/out/x=*/y").collect()] == ["x=1/y/z/deep.md"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_markdown(spark, f"{tmp_path}/none")


def test_buckets_of_a_discovery_follow_from_its_edges(spark, monkeypatch):
    """Many partitions of shuffles don't make many files of few pages, which every round opens."""
    from inkwell.operators import linkgraph

    made = []
    monkeypatch.setattr(linkgraph, "work_folder", lambda s, real=linkgraph.work_folder: made.append(real(s)) or made[-1])
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, "40")
    try:
        edges = spark.createDataFrame([(f"p{i}", f"p{2 * i + k}") for i in range(200) for k in (1, 2)] + [("p9", "p0"), ("p9", None)], "src string, dst string")
        found = linkgraph.discover(edges, ["p0"]).collect()
        assert {r["url"] for r in found} == {f"p{i}" for i in range(401)} and len(found) == 401 and max(r["depth"] for r in found) == 8
        monkeypatch.setattr(linkgraph, "BUCKET_ROWS", 1)
        assert sorted(linkgraph.discover(edges, ["p0"]).collect()) == sorted(found)
        files = [len(spark.read.parquet(f"{p}/edges").inputFiles()) for p in made]
        assert files[0] <= spark.sparkContext.defaultParallelism < files[1]
    finally:
        spark.conf.set(key, before)
