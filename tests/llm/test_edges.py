"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from inkwell.llm.ann import nearest
from inkwell.llm.bpe import bpe_digests
from inkwell.llm.exact_dedup import drop_exact_duplicates, exact_groups
from inkwell.llm.html_text import extract_text
from inkwell.llm.licenses import scan_licenses
from inkwell.llm.mixing import fair_queue, mixture
from inkwell.llm.near_dup import drop_near_duplicates, near_duplicates
from inkwell.llm.quality import fit_quality, keep_quality, labelled_sample, rated_ids, score_quality
from inkwell.llm.token_store import read_tokens, write_tokens
from inkwell.llm.toxicity import fit_toxicity, lexicon_model, score_toxicity

LONG = " ".join(f"word{i}" for i in range(30_000))
ROWS = [
    (5, "Some words  of\ttext that repeat", "a"),
    (2, "Some words of text that repeat", "a"),
    (3, None, None),
    (4, "", "b"),
    (None, "null id, MIT License", "b"),
    (None, None, None),
    (7, LONG, "c"),
    (8, LONG + " end", "c"),
    (9, " \n\t ", "c"),
    (9, " \n\t ", "c"),
    (1, "Ωmega ΣΑΣ ǅ 漢字 \U0001f600 <|endoftext|> 's 123", "d"),
]
# besides the columns that count, some with the names that the operators use inside
SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for name in ("size", "h", "key", "label", "score", "row", "n", "norm", "kept", "cls", "target", "diff", "part", "word", "shuffle", "component"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_exact(docs, none):
    out = {(r["doc_id"], r["text_sha256"]): r for r in exact_groups(docs).collect()}
    sha = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
    groups = defaultdict(list)
    for i, t, _ in ROWS:
        groups[sha(t)].append(i)
    assert set(out) == {(i, sha(t)) for i, t, _ in ROWS}
    for (i, s), r in out.items():
        ids = [x for x in groups[s] if x is not None]
        keep = min(ids) if ids else None
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(groups[s]), i == keep)
    left = drop_exact_duplicates(docs)
    assert left.columns == docs.columns and sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 1, 2, 3, 7, 8, 9]
    assert exact_groups(none).count() == drop_exact_duplicates(none).count() == 0


def test_near(docs, none):
    out = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs, 3, 85).collect()]
    assert sorted(out, key=str) == sorted(
        [(5, 4, 2, False), (2, 4, 2, True), (3, 0, 3, True), (4, 0, 4, True), (None, 2, None, False), (None, 0, None, False), (7, 29_998, 7, True), (8, 29_999, 7, False), (9, 0, 9, True), (9, 0, 9, True), (1, 6, 1, True)], key=str
    )
    left = drop_near_duplicates(docs)
    assert left.columns == docs.columns and sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 0, 1, 2, 3, 4, 7, 9, 9]
    assert near_duplicates(none).count() == drop_near_duplicates(none).count() == 0


def test_near_with_repeated_ids(spark):
    """A repeated id brings no other text of its rows into its class: none, a blank one, or one of another class."""
    a, b = [f"a{i}" for i in range(60)], " ".join(f"b{i}" for i in range(60))
    rows = [(7, " ".join(a)), (7, None), (7, " "), (7, b), (9, " ".join([*a, "end"])), (9, None), (9, ""), (3, b), (11, b + " end"), (12, " ".join(f"c{i}" for i in range(60)))]
    out = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert out == {(7, 58, 7), (7, 0, 7), (7, 58, 3), (9, 59, 7), (9, 0, 9), (3, 58, 3), (11, 59, 3), (12, 58, 12)}


def test_mixing(spark, docs, none):
    rows = fair_queue(docs, (5, 2, 1)).collect()
    sizes = Counter()
    for _, t, s in ROWS:
        sizes[s] += len((t or "").split())
    assert len(rows) == len(ROWS) and all(0 <= r["taken_copies"] <= 3 for r in rows)
    targets = {r["source"]: r["target"] for r in rows}
    total, open_, fixed = sum(sizes.values()), {s: w for s, w in zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2], strict=True)}, {}
    while True:
        share = (total - sum(fixed.values())) / sum(open_.values())
        over = [s for s, w in open_.items() if share * w > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            fixed[s] = 3.0 * sizes[s]
            del open_[s]
    assert targets == pytest.approx(fixed | {s: share * w for s, w in open_.items()})
    assert sum(r["size"] * r["taken_copies"] for r in rows) <= total
    assert fair_queue(none, (5, 2, 1)).count() == mixture(none, (5, 2, 1)).count() == 0
    assert mixture(docs, (5, 2, 1)).columns == docs.columns
    # rows without an id and rows that repeat id and text stay documents of their own
    twins = [(None, "a b c", "s"), (None, "a b c", "s"), (None, "a b c", "s"), (1, "d e f", "s"), (1, "d e f", "s"), (2, "x", "t")]
    assert mixture(spark.createDataFrame(twins, SCHEMA), (1.0,)).groupBy("doc_id", "text").count().count() == 3
    mixed = Counter(r["text"] for r in mixture(spark.createDataFrame(twins[:5], SCHEMA), (1.0,)).collect())
    assert mixed == {"a b c": 3, "d e f": 2}
    many = spark.createDataFrame([(i, "w " * (1 + i % 7), f"s{i % 5}" if i % 3 else "hot") for i in range(900)], SCHEMA)
    once, again = (sorted(map(tuple, fair_queue(many.repartition(n), (5, 2, 1)).collect())) for n in (1, 5))
    assert once == again
    by = defaultdict(lambda: [0, 0.0])
    for _, s, size, _, target, _, taken in once:
        by[s] = [by[s][0] + size * taken, target]
    assert all(abs(got - want) <= 7 for got, want in by.values())


def test_tokens(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    path = public_tokenizers.path("byte_bpe_50k.json")
    files = write_tokens(docs, f"file://{tmp_path}/a", path, frame_bytes=4096)
    back = [(r["doc_id"], r["start"], bytes(r["ids"])) for r in read_tokens(files, f"file://{tmp_path}/a").orderBy("start").collect()]
    assert [b[0] for b in back] == [None, None, 1, 2, 3, 4, 5, 7, 8, 9, 9]
    at = 0
    for (i, start, ids), text in zip(back, [None, "null id, MIT License", *(dict((r[0], r[1]) for r in ROWS)[b[0]] for b in back[2:])], strict=True):
        want = t.encode(text or "", add_special_tokens=False).ids + [0]
        assert start == at and np.frombuffer(ids, "<u4").tolist() == want, i
        at += len(want)
    nothing = write_tokens(none, f"file://{tmp_path}/b", path)
    assert nothing.count() == read_tokens(nothing, f"file://{tmp_path}/b").count() == 0


def test_bpe(docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = [tuple(r) for r in bpe_digests(docs, path).collect()]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, text, _ in ROWS:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert bpe_digests(none, path).count() == 0


def test_licenses(docs, none):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = {i: i + 32 for i in range(65, 91)}
    rows = scan_licenses(docs).collect()
    assert Counter(r["n_words"] for r in rows) == Counter(len(word.findall((t or "").translate(lower))) for _, t, _ in ROWS)
    hit = [r for r in rows if r["n_base"]]
    assert [(r["doc_id"], r["first_word"], r["last_word"], r["labels"]) for r in hit] == [(None, 2, 2, "mit")]
    assert all(r["first_word"] is None and r["labels"] == "" and r["score"] == 0 for r in rows if not r["n_base"])
    assert scan_licenses(none).count() == 0


def test_classifiers(spark, docs, none):
    labels = spark.createDataFrame([(2, 1, 0), (2, 1, 0), (7, 0, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0)):
        model = fit_quality(docs, given)
        scores = [r["score"] for r in score_quality(docs, model).collect()]
        assert len(scores) == len(ROWS) and all(0 <= s <= 1 for s in scores)
        assert keep_quality(docs, model).columns == docs.columns
        model = fit_toxicity(docs, given)
        scores = [r["score"] for r in score_toxicity(docs, model).collect()]
        assert len(scores) == len(ROWS) and all(0 <= s <= 1 for s in scores)
    torn = spark.createDataFrame([(7, 1), (7, 0), (2, 1)], "doc_id long, quality int")
    assert [r["doc_id"] for r in rated_ids(torn, "quality", F.lit(True)).collect()] == [2]
    again = docs.unionByName(docs).unionByName(docs)
    assert labelled_sample(again, rated_ids(labels, "quality", F.lit(True)), 10).count() == 2
    assert score_quality(none, fit_quality(none, labels)).count() == 0
    assert score_toxicity(none, lexicon_model({"bad": 1.0})).count() == 0
    assert keep_quality(docs, fit_quality(docs, labels.limit(0))).count() == len(ROWS)


def test_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "v", "a &amp; b\n c"), (3, "w", "<article><p>x<p>y" + "<b>" * 3000), (3, "w", "<nav>n</nav>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("z"))
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in extract_text(pages).collect()) == [(0, "a & b c", 7), (1, "", 0), (2, "", 0), (3, "", 0), (3, "x\ny", 3)]
    assert extract_text(pages.limit(0)).count() == 0


def test_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, []), (8, [1.0, 1.0, 1.0]), (None, [1.0, 0.0]), (100, [0.0, 1.0]), (200, None), (2, [1.0, 0.0]), (9, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1)).withColumn("dim", F.lit(1))
    out = nearest(df, F.col("vec_id") % 100 == 0, k=3)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in out.collect())
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 2, 0.0), (100, 1, 0, 1.414214), (100, 2, 1, 1.414214), (100, 3, 2, 1.414214)]
    assert nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_pipeline_on_edges(spark, docs, none, tmp_path):
    """Nulls, repeats, blank and very long texts, clashing names, and no rows at all."""
    import corpus_pipeline

    odd = docs.withColumns({n: F.lit("x") for n in ("__row", "__word", "__hit", "__key", "whole", "taken", "rest", "copy")})
    labels = spark.createDataFrame([(2, 1, 0), (7, 0, 1), (8, 1, 0)], "doc_id long, quality int, toxic int")
    for name, table in (("some", odd), ("none", none)):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        (labels if name == "some" else labels.limit(0)).write.parquet(f"{tmp_path}/{name}/labels.parquet")
    stage_docs = spark.read.parquet(f"{tmp_path}/some/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, stage_docs, f"{tmp_path}/some").columns == odd.columns
    got = corpus_pipeline.run(spark, f"{tmp_path}/some").collect()
    worded = {i for i, t, _ in ROWS if (t or "").split()}
    assert got and all(r["doc_id"] in worded for r in got)
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_stages_keep_clashing_columns_and_agree(spark):
    """A column with a name of the work's own keeps its values, and which of equal rows stays does not hang on partitions."""
    names = ("__row", "__word", "__bit", "__hit", "__key", "whole", "row", "kept")
    rows = [(1, "a b c d e f", "s", *(f"{n}{k}" for n in names)) for k in range(6)] + [(2, "g h i j k l", "s", *("z" for _ in names)), (3, "g h i j k l", "s", *("y" for _ in names))]
    df = spark.createDataFrame(rows, f"doc_id long, text string, source string, {', '.join(f'`{n}` string' for n in names)}")
    left = {tuple(r) for n in (1, 5) for r in drop_exact_duplicates(df.repartition(n)).collect()}
    assert left == {rows[0], rows[6]}
    assert {tuple(r) for r in drop_near_duplicates(df.filter("doc_id > 1")).collect()} == {rows[6]}
    mixed = mixture(df.filter("doc_id > 1"), (1.0,)).collect()
    assert {tuple(r) for r in mixed} == {rows[6], rows[7]} and len(mixed) == 2
