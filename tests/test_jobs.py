import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.functions import vectors
from inkwell.functions.encoders import HashingEncoder
from inkwell.operators import bm25, catalog, chunking, evaluation, fusion, html, ingest, linkgraph, querylog, rerank, vector_search
from inkwell.plans import workflows
from inkwell.sources import files


def now():
    return F.lit("2024-01-02").cast("timestamp")


def test_discover(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("c", "a"), ("b", "x/no"), ("q", "r"), ("c", None)], "src string, dst string")
    seen = {tuple(r) for r in linkgraph.discover(edges, ["a"], "", ["x/"]).collect()}
    assert seen == {("a", 0), ("b", 1), ("c", 2)}
    pages = spark.createDataFrame([("a",), ("b",), ("b",)], "url string")
    assert linkgraph.crawl_stats(linkgraph.discover(edges, ["a"]), pages).first().asDict() == {"ok": 2, "failed": 2}


def test_rounds_do_not_shuffle_edges(spark, monkeypatch):
    """Edges and visited pages are bucketed, so only the frontier and what it finds are exchanged in a round."""
    edges = spark.range(3000).select(F.concat(F.lit("p"), F.col("id") % 1000).alias("src"), F.concat(F.lit("p"), (F.col("id") * 7 + 1) % 1000).alias("dst"))
    plans, table = [], type(spark).table

    def watched(self, name):
        plans.append(name)
        return table(self, name)

    monkeypatch.setattr(type(spark), "table", watched)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        seen = {r["url"]: r["depth"] for r in linkgraph.discover(edges, ["p0", "p5"]).collect()}
        links = {}
        for r in edges.collect():
            links.setdefault(r["src"], set()).add(r["dst"])
        want, at, depth = {"p0": 0, "p5": 0}, {"p0", "p5"}, 0
        while at:
            depth += 1
            at = set().union(*(links.get(u, set()) for u in at)) - want.keys()
            want |= dict.fromkeys(at, depth)
        assert seen == want and len(plans) > 3
        monkeypatch.undo()
        edges.write.bucketBy(4, "src").mode("overwrite").saveAsTable("some_edges")
        some = spark.createDataFrame([("p1",)], "url string").repartition(4, "url").join(spark.table("some_edges"), F.col("url") == F.col("src"))
        plan = some._jdf.queryExecution().executedPlan().toString()
        assert not any("Exchange" in line and "src" in line for line in plan.splitlines()), plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS some_edges")
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("discover_")]


def test_store_of_two_writers(spark, tmp_path):
    """Neither is lost; parts without new documents keep their files."""
    path = f"file://{tmp_path}/store"

    def tables(ids, text, version="1"):
        docs = spark.createDataFrame([(f"{i}-{text}", f"d{i}.md", version) for i in ids], "id string, source_path string, target_version string")
        sections = docs.select(F.concat(F.lit("s"), "id").alias("id"), F.col("id").alias("document_id"))
        return {"documents": docs, "sections": sections, "chunks": sections.withColumn("content", F.lit(text))}

    files.upsert_store(spark, path, tables(range(40), "old"), parts=8)
    first = files.last_commit(spark, path)[1]["folders"]["chunks"]
    real, raced = files.try_commit, []

    def slow(spark_, path_, number, content):
        if not raced:  # another writer commits between this one's reading and its commit
            raced.append(number)
            files.upsert_store(spark, path, tables([2, 50], "other"), parts=8)
        return real(spark_, path_, number, content)

    files.try_commit = slow
    try:
        assert files.upsert_store(spark, path, tables([1, 2, 60], "mine"), parts=8) == 3
    finally:
        files.try_commit = real
    now = files.published_store(spark, path)
    got = {r["document_id"] for r in now["chunks"].collect()}
    assert got == {f"{i}-old" for i in range(40) if i not in (1, 2)} | {"50-other", "1-mine", "2-mine", "60-mine"}
    assert {r["id"] for r in now["documents"].collect()} == got and now["sections"].count() == len(got) and files.PART not in now["chunks"].columns
    last = files.last_commit(spark, path)[1]["folders"]["chunks"]
    assert 0 < sum(first[p] == last[p] for p in first) < len(first)
    assert not files.try_commit(spark, path, 3, {})
    with pytest.raises(ValueError, match="parts"):
        files.upsert_store(spark, path, tables([1], "x"), parts=4)


def test_dedupe(spark):
    pages = spark.createDataFrame([(2, "x"), (1, "x"), (3, None), (4, "")], "id int, html string")
    assert sorted(r["id"] for r in linkgraph.dedupe_by_content(pages, "html", "id").collect()) == [1, 3]


def test_dedupe_keeps_contents_without_an_id(spark):
    pages = spark.createDataFrame([(None, "x"), (None, "x"), (None, "y"), (2, "y")], "id int, html string")
    assert sorted(linkgraph.dedupe_by_content(pages, "html", "id").select("html", "id").collect(), key=str) == [("x", None), ("y", 2)]
    rows = spark.createDataFrame([("a", 1, "p"), ("a", 3, "q"), ("a", None, "r"), ("b", None, "s")], "k string, seq int, v string")
    assert sorted((r["k"], r["v"]) for r in linkgraph.latest(rows, ["k"], ["seq"]).collect()) == [("a", "q"), ("b", "s")]


def test_deep_page_and_clashing_columns(spark):
    pages = spark.createDataFrame([("http://h/", "<div>" * 3000 + "<h1>T</h1>deep", "old", "old")], "url string, html string, title string, error string")
    made = html.convert_pages(pages)
    assert sorted(made.columns) == ["error", "html", "markdown", "title", "url"]
    assert (made.first()["markdown"], made.first()["error"]) == ("# T\n\ndeep\n", None)


def test_queries_meet_vectors_of_their_dimension(spark):
    held = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0, 0.0])], "chunk_id int, embedding array<float>")
    asked = spark.createDataFrame([(7, [1.0, 0.1]), (8, [1.0, 0.0, 0.0])], "query_id int, vector array<float>")
    got = [(r["query_id"], r["rank"], r["chunk_id"]) for r in vector_search.vector_search(held, asked, 5).collect()]
    assert sorted(got) == [(7, 1, 1), (7, 2, 2), (8, 1, 3)]


def test_postings_against_plain_counts(spark):
    rng = random.Random(0)
    rows = [(i, " ".join(rng.choices("abcde", k=rng.randrange(12)))) for i in range(50)]
    index = bm25.build_index(spark.createDataFrame(rows, "chunk_id int, content string").withColumn("section_title", F.lit("a b a")))
    got = {(r["term"], r["chunk_id"]): r["tf"] for r in index["postings"].filter("field = 'content'").collect()}
    assert got == {(w, i): n for i, t in rows for w, n in Counter(t.split()).items()}
    assert "Exchange" not in index["postings"]._jdf.queryExecution().executedPlan().toString()


def test_ingest_and_upsert(spark, tmp_path):
    rows = [("docs/a.md", "---\ntitle: Ingest Test\ntarget_version: 5.0\n---\n# Introduction\nHello\n\n## Section 1\nText", "1.0", "Guide", 1), ("docs/b.md", "plain body", "1.0", "Guide", 2), ("docs/b.md", "plain later", "1.0", "Guide", 3)]
    source = spark.createDataFrame(rows, "source_path string, content string, default_version string, default_category string, seq long")
    tables = workflows.ingest(source, now())
    docs = {r["source_path"]: r for r in tables["documents"].collect()}
    assert (docs["docs/a.md"]["title"], docs["docs/a.md"]["target_version"], docs["docs/b.md"]["title"]) == ("Ingest Test", "5.0", "b")
    assert tables["sections"].filter(F.col("document_id") == docs["docs/a.md"]["id"]).count() == 2
    assert [r["content"] for r in tables["chunks"].filter(F.col("document_id") == docs["docs/b.md"]["id"]).collect()] == ["plain later"]
    again = ingest.upsert(tables, workflows.ingest(source.filter("seq = 2"), now()))
    assert again["documents"].count() == 2 and [r["content"] for r in again["chunks"].filter("content LIKE 'plain%'").collect()] == ["plain body"]
    assert ingest.key_violations(again["documents"]).count() == 0
    files.write_store(tables, f"{tmp_path}/store")
    back = files.read_store(spark, f"{tmp_path}/store")
    assert {n: back[n].count() for n in back} == {"documents": 2, "sections": 3, "chunks": 3}
    assert back["documents"].filter("target_version = '5.0'").count() == 1


def test_read_files(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.html").write_text("<p>one\ntwo")
    (tmp_path / "in/sub/b.html").write_text("<p>three")
    (tmp_path / "in/c.md").write_text("# x")
    assert sorted(r["html"] for r in files.read_html_snapshot(spark, f"{tmp_path}/in").collect()) == ["<p>one\ntwo", "<p>three"]
    assert [r["content"] for r in files.read_markdown(spark, f"{tmp_path}/in/c.md").collect()] == ["# x"]
    log = spark.createDataFrame([(1, "a")], "id int, q string")
    files.write_json_log(log, f"{tmp_path}/log")
    files.write_json_log(log, f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 2
    docs = spark.createDataFrame([("s", "5.2", "a.md", "x")], "source string, target_version string, rel_path string, content string")
    files.write_markdown_docs(docs, f"{tmp_path}/docs")
    files.write_markdown_docs(docs, f"{tmp_path}/docs")
    assert spark.read.parquet(f"{tmp_path}/docs").count() == 1


def test_text_files_are_written_and_read(spark, tmp_path):
    rows = spark.createDataFrame([("a/x.html", "<p>\u00e9\r\ntwo"), ("b.html", "t"), ("c.html", None), (None, "t")], "rel_path string, content string")
    assert files.write_text_files(rows, f"file://{tmp_path}/out") == 2
    assert files.write_text_files(rows, f"file://{tmp_path}/out") == 2
    assert sorted(r["html"] for r in files.read_html_snapshot(spark, f"file://{tmp_path}/out").collect()) == ["<p>\u00e9\r\ntwo", "t"]
    assert files.write_text_files(rows.limit(0), f"file://{tmp_path}/out") == 0
    with pytest.raises(Exception, match="leaves the folder"):
        files.write_text_files(spark.createDataFrame([("../x", "t")], "rel_path string, content string"), f"file://{tmp_path}/out")


def test_store_is_published_whole(spark, tmp_path):
    tables = lambda n: {"documents": spark.createDataFrame([(n, "4.20")], "id int, target_version string"), "sections": spark.range(n), "chunks": spark.range(n)}
    files.publish_store(tables(1), f"file://{tmp_path}", "one")
    files.publish_store(tables(2), f"file://{tmp_path}", "two")
    files.write_store(tables(3), f"file://{tmp_path}/three")
    now = files.published_store(spark, f"file://{tmp_path}")
    assert (now["documents"].first().asDict(), now["chunks"].count()) == ({"id": 2, "target_version": "4.20"}, 2)


def test_log_record_has_all_fields(spark):
    asked = spark.createDataFrame([(1, "q", 5), (2, None, None)], "query_id int, query string, max_results int")
    hits = spark.createDataFrame([], "query_id int, rank int, id int, title string, score double")
    one, two = querylog.log_records(asked, hits, at=now(), params=["max_results"]).orderBy("query_id").collect()
    assert (one["timestamp"], one["level"], one["message"], one["params"]) == ("2024-01-02T00:00:00.000000+00:00", "INFO", "Tool search called with query: q", {"max_results": "5"})
    assert two["params"] == {"max_results": None} and two["results_count"] == 0


def test_bad_page_is_quarantined(spark, monkeypatch):
    pages = spark.createDataFrame([("http://h/", "<h1>T</h1>x"), (None, None)], "url string, html string")
    good, bad = ingest.quarantine(html.convert_pages(pages))
    assert good.count() == 2 and bad.count() == 0
    assert html.convert_pages(pages.limit(1)).first()["markdown"] == "# T\n\nx\n"


def test_packed_vectors(spark):
    assert vectors.pack(np.array([[1.0, 0.0]])).hex() == "01007f00"
    tokens = vectors.low_dim(np.array([[3.0, 4.0, 9.0], [0.0, 0.0, 1.0]]), 2)
    assert tokens.tolist() == [[0.6, 0.8], [0.0, 0.0]]
    assert vectors.unpack(vectors.pack(tokens), 2).tolist() == [[76 / 127, 101 / 127], [0, 0]]
    assert len(vectors.unpack(b"\x01", 2)) == len(vectors.unpack(None, 2)) == 0
    assert vectors.unpack(b"\x05\x00\x7f\x00\x7f", 2).tolist() == [[1, 0]]
    assert vectors.maxsim_score(b"\x00\x00", b"\x01\x00\x7f\x00", 2) == 0.0
    a, b = np.random.RandomState(0).standard_normal((3, 8)), np.random.RandomState(1).standard_normal((5, 8))
    slow = np.mean([max(float(x @ y) for y in b.astype("f4").astype(float)) for x in a.astype("f4").astype(float)])
    assert math.isclose(vectors.maxsim_score(vectors.pack(a, "float32"), vectors.pack(b, "float32"), 8, "float32"), slow, rel_tol=1e-9)
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, z array<float>").select(vectors.l2_normalize("a"), vectors.l2_normalize("z"), vectors.cosine("a", "z"), vectors.preview("a")).first()
    assert list(row) == [[0.6, 0.8], [0.0, 0.0], None, "[3.0000, 4.0000, ... (2 dims)]"]


def test_bm25_against_plain_python(spark):
    texts = {1: "hello world hello", 2: "say hello to Spark", 3: "nothing here", 4: "", 5: None}
    rows = [(i, t, "Title world" if i == 3 else "Main") for i, t in texts.items()]
    index = bm25.build_index(spark.createDataFrame(rows, "chunk_id int, content string, section_title string"))
    asked = spark.createDataFrame([(1, "Hello, world hello"), (2, "absent"), (3, None)], "query_id int, query string")
    hits = {(r["query_id"], r["chunk_id"]): r["score"] for r in bm25.search(index, asked).collect()}
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    expected: Counter = Counter()
    for boost, field in ((1.0, 1), (3.0, 2)):
        docs = {r[0]: words(r[field]) for r in rows}
        avg = sum(map(len, docs.values())) / len(docs)
        for t in ("hello", "world"):
            df = sum(t in d for d in docs.values())
            for i, d in docs.items():
                if t in d:
                    tf = d.count(t)
                    expected[1, i] += boost * math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / avg))
    assert hits == pytest.approx(expected)
    only = bm25.search(index, asked, allowed=spark.createDataFrame([(2,)], "chunk_id int"))
    assert [r["chunk_id"] for r in only.collect()] == [2]


@pytest.mark.parametrize("parts", [1, 5])
def test_vector_search_against_numpy(spark, parts):
    rng = np.random.RandomState(0)
    m = rng.standard_normal((300, 8)).round(3)
    m[7] = 0
    held = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(999, None)], "chunk_id int, embedding array<double>").repartition(parts)
    asked = spark.createDataFrame([(i, m[i].tolist()) for i in range(0, 300, 50)], "query_id int, vector array<double>")
    got = vector_search.vector_search(held, asked, 10).collect()
    unit = m / np.where((n := np.linalg.norm(m, axis=1)) > 0, n, 1)[:, None]
    for q in range(0, 300, 50):
        want = np.argsort(-(unit @ unit[q]), kind="stable")[:10].tolist()
        assert [r["chunk_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want


def test_fusion_and_rerank(spark):
    hits = lambda rows: spark.createDataFrame(rows, "query_id int, chunk_id int, rank int")
    fused = fusion.reciprocal_rank_fusion(hits([(1, 10, 1), (1, 11, 2)]), hits([(1, 12, 1), (1, 11, 2)]))
    assert [r["chunk_id"] for r in fused.orderBy("rank").collect()] == [11, 10, 12]
    one = vectors.pack(np.array([[1.0, 0.0]]))
    other = vectors.pack(np.array([[0.0, 1.0]]))
    rows = [(1, 1, 1, 0.03, bytearray(one)), (1, 2, 2, 0.02, bytearray(other)), (1, 3, 3, 0.01, None), (1, 4, 4, 0.01, bytearray(b"\x00\x00")), (2, 5, 1, 0.03, bytearray(one))]
    found = spark.createDataFrame(rows, "query_id int, chunk_id int, rank int, similarity double, multi_vector_low_dim binary")
    queries = spark.createDataFrame([(1, bytearray(one)), (2, None)], "query_id int, multi binary")
    out = {r["chunk_id"]: r for r in rerank.rerank(found, queries, dim=2).collect()}
    assert set(out) == {1, 3, 5}
    assert (out[1]["final_rank"], out[1]["similarity"], out[3]["rerank_score"], out[3]["similarity"]) == (1, 1.0, 0.0, 0.01)
    assert out[5]["rerank_failed"] and out[5]["rerank_score"] is None


def test_search_end_to_end(spark):
    docs = [(f"d/{w}.md", f"# {w}\n\nHow to {w} querysets with the {w} method", "5.2", "Guide", i) for i, w in enumerate(["filter", "order", "join"])]
    source = spark.createDataFrame(docs, "source_path string, content string, default_version string, default_category string, seq long")
    tables = workflows.ingest(source, now(), workflows.default_encoder(32), low=16)
    asked = spark.createDataFrame([(1, "filter querysets"), (2, "zzz")], "query_id int, query string")
    rows = rerank.api_rows(workflows.answers(tables, asked, workflows.default_encoder(32), low=16)).orderBy("query_id", "final_rank").collect()
    assert "filter" in rows[0]["content"] and rows[0]["relevance_score"] >= 0.3 and rows[0]["document_type"] == "Guide"
    off = tables | {"documents": catalog.set_status(tables["documents"], tables["documents"], "Inactive")}
    assert workflows.answers(off, asked, workflows.default_encoder(32), low=16).count() == 0


def test_evaluation(spark):
    golden = spark.createDataFrame([(i, ["Q objects"], "ORM") for i in range(4)], "query_id int, expected_keywords array<string>, category string")
    hits = spark.createDataFrame([(q, r, "uses q OBJECTS" if r == first else "no") for q, first in ((0, 1), (1, 3), (2, 5), (3, 0)) for r in range(1, 6)], "query_id int, rank int, content string")
    judged = evaluation.judge(golden, hits)
    m = evaluation.gate(evaluation.measures(judged)).first()
    assert m["mrr"] == pytest.approx((1 + 1 / 3 + 1 / 5) / 4) and (m["hit_at_1"], m["hit_at_3"], m["hit_at_5"], m["passed"]) == (25.0, 50.0, 75.0, False)
    assert [r["query_id"] for r in evaluation.failures(judged).collect()] == [3]
    assert {r["query_id"]: r["false_positives"] for r in judged.collect()} == {0: 4, 1: 4, 2: 4, 3: 5}


def test_log(spark):
    queries = spark.createDataFrame([(1, "a"), (2, "b")], "query_id int, query string")
    hits = spark.createDataFrame([(1, r, f"c{r}", None if r == 2 else "T", 0.5) for r in (2, 1, 3, 4)], "query_id int, rank int, id string, title string, score double")
    out = {r["query_id"]: r for r in querylog.log_records(queries, hits).collect()}
    assert out[1]["chunk_ids"] == ["c1", "c2", "c3", "c4"] and [t["title"] for t in out[1]["top_results"]] == ["T", "No Title", "T"]
    assert (out[2]["results_count"], out[2]["top_results"]) == (0, [])


def test_chunk_job_and_report(spark):
    docs = spark.createDataFrame([(1, "# A\n\ntext\n\n```\ncode\n```"), (2, None), (3, "no header")], "doc_id int, content string")
    made = chunking.chunk_documents(docs)
    assert sorted((r["doc_id"], r["header_context"], r["word_count"]) for r in made.collect()) == [(1, "A", 6), (3, "Main", 2)]
    assert chunking.chunk_quality(made).first().asDict() == {"n_chunks": 2, "odd_fences": 0, "too_long": 0, "without_header": 1, "injected": 0}


def test_encoder_is_deterministic():
    a, b = HashingEncoder(8).encode(["Hello world"]), HashingEncoder(8).encode(["hello WORLD"])
    assert np.allclose(a[0][0], b[0][0]) and a[0][2] == 2 and HashingEncoder(8).encode([None])[0][2] == 0


def test_gram_index_finds_what_a_scan_finds(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choices("abcÄß \n\U0001f600", k=rng.randrange(60))), rng.choice([None, "Title", "ab"])) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, content string, title string")
    catalog.write_gram_index(df, ["content", "title"], f"{tmp_path}/grams")
    index = spark.read.parquet(f"{tmp_path}/grams")
    for text in ("abc", "AB ca", "äß", "title abc b", "ß\U0001f600a", "", "zzz", "abab"):
        want = {r["id"] for r in catalog.search_rows(df, text, ["content", "title"]).collect()}
        assert {r["id"] for r in catalog.gram_search(df, index, text, ["content", "title"]).collect()} == want
    assert catalog.gram_search(df, index, "abab", ["content", "title"]).count() > 0
    assert catalog.gram_search(df.limit(0), index.limit(0), "abc", ["content"]).count() == 0


def test_repeats_with_ties_and_nulls(spark):
    rows = [("s", "q", 1, 2), ("s", "q", 1, 1), ("s", "q", None, 0), (None, "q", 5, 1), (None, "q", 4, 1), ("s", None, 1, 1), ("s", None, 2, 1), ("t", "q", 1, 1)]
    df = spark.createDataFrame(rows, "session string, query string, ts int, n int")
    got = {(r["session"], r["query"], r["ts"], r["n"]): r["repeated"] for r in querylog.flag_repeats(df, key=["n"]).collect()}
    assert [k for k, v in got.items() if not v and k[0] == "s" and k[1] == "q"] == [("s", "q", None, 0)]
    assert got["s", "q", 1, 1] and got["s", "q", 1, 2] and not got[None, "q", 4, 1] and got[None, "q", 5, 1] and not got["s", None, 1, 1] and got["s", None, 2, 1] and not got["t", "q", 1, 1]


def test_maxsim_of_blocks_against_pairs(spark):
    import pyarrow as pa

    rng = np.random.RandomState(0)
    packed = [None, b"", b"\x01", b"\x02\x00" + bytes(5)] + [vectors.pack(vectors.low_dim(rng.standard_normal((n, 6)), 4), "int8") + bytes(n % 3) for n in (0, 1, 3, 7, 2)]
    pairs = [(packed[i], packed[j]) for i in range(len(packed)) for j in range(len(packed))]
    order = rng.permutation(len(pairs))
    q, d = (pa.array([pairs[i][k] for i in order], pa.binary()) for k in (0, 1))
    want = [vectors.maxsim_score(*pairs[i], 4) for i in order]
    assert vectors.maxsim_scores(q, d, 4) == pytest.approx(want)
    assert vectors.maxsim_scores(q.slice(7, 20), d.slice(7, 20), 4) == pytest.approx(want[7:27])
    assert len(vectors.maxsim_scores(q.slice(0, 0), d.slice(0, 0), 4)) == 0


def test_failed_chunk_withholds_its_document(spark):
    from inkwell.functions.encoders import WordLengthEncoder

    long = "\n\n".join(f"paragraph {i} of some length to fill a chunk " * 12 for i in range(8))
    rows = [("a.md", "# One\n\nfine text"), ("b.md", long + "\n\na bad word"), ("c.md", ""), ("d.md", "bad"), ("e.md", None)]
    source = spark.createDataFrame(rows, "source_path string, content string").withColumns({"default_version": F.lit("1"), "default_category": F.lit("c"), "seq": F.lit(1)})
    made = workflows.ingest(source, now(), lambda: WordLengthEncoder(8, "bad"), low=8)
    assert sorted(r["source_path"] for r in made["documents"].collect()) == ["a.md", "c.md", "e.md"]
    assert {(r["source_path"], r["failed_rows"]) for r in made["quarantine"].collect()} == {("b.md", 1), ("d.md", 1)}
    assert made["chunks"].count() == made["sections"].count() == 1 and "error" not in made["chunks"].columns
    assert ingest.ingest_summary(ingest.file_results(made["documents"], made["chunks"], made["quarantine"])).first().asDict() == {"total": 5, "successful": 3, "failed": 2, "chunks": 1}
    with pytest.raises(Exception, match="bad"):
        vector_search.embed(spark.createDataFrame([("bad",)], "content string"), lambda: WordLengthEncoder(8, "bad")).collect()
