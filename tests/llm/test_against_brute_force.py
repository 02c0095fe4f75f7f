"""Operators against slow, plain versions on the smallest tables, and the parts that need no Spark."""

import io
import random
import zlib
from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from inkwell.llm import html_text, queries
from inkwell.llm.ann import Cell, nearest
from inkwell.llm.bpe import PairIndexEncoder
from inkwell.llm.common import read
from inkwell.llm.licenses import rules, scan_licenses
from inkwell.llm.near_dup import Shingler, components, merged, near_duplicates, neighbours, orders, sketches
from inkwell.llm.quality import class_weights, fit_quality, logistic, score_quality
from inkwell.llm.token_store import FileReader, FileWriter, PieceEncoder
from inkwell.llm.toxicity import Matcher, ToxicityModel, choose_entries, fit_toxicity, fold, lexicon_model, score_toxicity, terms

WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = [" ", "  ", "a", "b", "C", "\n", "\t", "\x1c", "é", "<|endoftext|>", "<|startoftext|>", "'s", "1", "22", "!", "!!", "\u3000", "\0", "Foo", "\xa0", "\u0301", "Σ", "İ", "漢", "😀", "aaa", "the", "ing", ".", "\u0338", ">"]
TEXTS = st.lists(st.sampled_from(ALPHABET), max_size=16).map("".join)


@pytest.fixture(scope="module")
def word_bpe():
    from tokenizers import Tokenizer

    return PairIndexEncoder(WORD_BPE), Tokenizer.from_file(WORD_BPE)


@pytest.fixture(scope="module")
def byte_bpe():
    from tokenizers import Tokenizer

    return PieceEncoder(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, max_size=8))
def test_pair_index_gives_the_librarys_ids(word_bpe, texts):
    mine, library = word_bpe
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert mine.ids(text) == want
        assert mine.decode(want) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, max_size=8))
def test_pieces_give_the_librarys_ids(byte_bpe, texts):
    mine, library = byte_bpe
    assert [np.frombuffer(b, "<u4").tolist() for b in mine.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_file_reads_single_documents():
    out = io.BytesIO()
    writer = FileWriter(out, frame_bytes=64, list_docs=16)
    docs = [(None, b"\0\0\0\0"), *((i, np.arange(i, dtype="<u4").tobytes()) for i in range(40))]
    for d in docs:
        writer.add(*d)
    assert writer.close() == (41, 1 + sum(range(40)))
    raw = out.getvalue()
    reader = FileReader(pa.PythonFile(io.BytesIO(raw), "r"))
    assert list(reader.documents()) == docs
    assert list(reader.documents([7, 30])) == [docs[8], docs[31]]
    asked = []
    reader.frame = lambda k, frame=reader.frame: asked.append(k) or frame(k)
    list(reader.documents([39]))
    assert len(asked) == 1 < len(reader.seek) and len(reader.lists) == 3 and not list(reader.documents([99]))
    broken = bytearray(raw)
    broken[5] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        list(FileReader(pa.PythonFile(io.BytesIO(bytes(broken)), "r")).documents())


def test_memories_stay_within_their_bytes():
    texts = [" ".join(f"{chr(97 + i % 26)}word{j}" for j in range(i, i + 300)) for i in range(0, 30_000, 100)]
    for small, large in ((PairIndexEncoder(WORD_BPE, 1 << 18), PairIndexEncoder(WORD_BPE)), (PieceEncoder(BYTE_BPE, 1 << 18), PieceEncoder(BYTE_BPE))):
        for at in range(0, len(texts), 4):
            assert small.encode(texts[at : at + 4]) == large.encode(texts[at : at + 4])
            assert small.memory.size < 1 << 19
        assert large.memory.size > 1 << 20


def test_components_merge_with_later_links(spark):
    """Components found in rounds are those of all links at once: chains, stars, links inside a component, none at all."""
    rng = np.random.RandomState(3)
    chain, star = [(i, i + 1) for i in range(40)], [(100, i) for i in range(101, 160)]
    loose = [tuple(sorted(p)) for p in rng.randint(0, 300, (60, 2)).tolist() if p[0] != p[1]]
    rounds, label, done = [chain[::2] + star, [], chain[1::2] + loose[:30], [(0, 1), (5, 9)], loose[30:]], None, []
    for links in rounds:
        done += links
        frame = spark.createDataFrame(links, "a long, b long")
        label = components(frame) if label is None else merged(label, frame)
        root = {v: v for p in done for v in p}
        for _ in root:
            for a, b in done:
                root[a] = root[b] = min(root[a], root[b])
        got = label.collect()
        assert {r["cls"]: r["component"] for r in got} == root and len(got) == len(root)


def slow_components(docs, words, percent):
    sets, parent = {}, {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + words]) for j in range(max(1, len(w) - words + 1))} if w else set()
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_of_table(spark, sf_dir, words, percent):
    docs = read(spark, sf_dir, "documents")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(docs, words, percent).collect()}
    assert got == slow_components([(r["doc_id"], r["text"]) for r in docs.collect()], words, percent)


def test_large_family_of_near_copies(spark):
    """Far more close copies than a region holds, with others at the edge of the threshold."""
    rng = random.Random(1)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(150):
        copy = list(base)
        for _ in range(rng.choice([1, 1, 2, 3, 4])):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, region=8).collect()}
    assert got == slow_components(rows, 3, 85)


@pytest.mark.parametrize(("words", "percent", "run"), [(5, 80, 40), (3, 85, 30)])
def test_dense_family_at_the_threshold(spark, words, percent, run):
    """Variants that are close to the base only, at the threshold itself, in a family of far more than a region."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(400)]
    rows = [(0, " ".join(base))]
    for i in range(1, 300):
        at = rng.randrange(words, 400 - run - words)
        rows.append((i, " ".join([*base[:at], *(f"x{i}-{j}" for j in range(run)), *base[at + run :]])))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words, percent).collect()}
    assert got == slow_components(rows, words, percent) and {c for _, c in got.values()} == {0}


def test_dense_family_around_a_class_in_the_middle(spark):
    """The one class that all others are close to is not the first of them; no two of the others are close."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(400)]
    rows = [(500, " ".join(base))]
    for i in [*range(500), *range(501, 1000)]:
        at = rng.randrange(3, 367)
        rows.append((i, " ".join([*base[:at], *(f"x{i}-{j}" for j in range(30)), *base[at + 30 :]])))
    got = {r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == {0}


def test_neighbours_of_sorted_orders(spark, sf_dir):
    from inkwell.llm.near_dup import ORDER, OWN, SHALLOW, TREES

    docs = read(spark, sf_dir, "documents")
    rows = sketches(docs, 3).filter("sig IS NOT NULL").selectExpr("doc_id AS cls", "n_shingles AS n", "sig").collect()
    want = set()
    for t in range(TREES):
        around = {r["cls"]: (bytes(r["sig"]) * 2)[4 * OWN * t :][: 4 * ORDER] for r in rows}
        by_prefix = defaultdict(list)
        for c, p in around.items():
            by_prefix[p[: 4 * SHALLOW]].append((p, c))
        for group in by_prefix.values():
            group.sort()
            want |= {tuple(sorted((x[1], y[1]))) for x, y in zip(group, group[1:], strict=False)}
    n = {r["cls"]: r["n"] for r in rows}
    want = {(a, b) for a, b in want if 100 * min(n[a], n[b]) >= 85 * max(n[a], n[b])}
    nodes = spark.createDataFrame(rows, "cls long, n long, sig binary")
    assert {(r["a"], r["b"]) for r in neighbours(orders(nodes), 85, TREES).collect()} == want and want


def test_shingles_are_sets():
    cut = Shingler(3)
    assert len(cut.shingles("a b c a b c a")) == 3 and len(cut.shingles("A b")) == 1 and len(cut.shingles(" ")) == 0
    assert np.array_equal(cut.shingles("a\tB c"), cut.shingles("A b\nC")) and not np.array_equal(cut.shingles("a b"), cut.shingles("b a"))


@pytest.mark.parametrize("dim", [3, 48, 64, 130])
def test_bounds_hold(dim):
    rng = np.random.RandomState(3)
    v, q = rng.standard_normal((500, dim)), rng.standard_normal((20, dim))
    middle, width = Cell(np.arange(500), v).bounds(q)
    exact = ((q[:, None] - v[None]) ** 2).sum(axis=2)
    assert (np.abs(exact - middle) <= width).mean() > 0.999


def slow_nearest(m, k):
    out = {}
    for q in (i for i in m if i % 100 == 0):
        near = sorted((float(np.sqrt(((m[i] - m[q]) ** 2).sum())), i) for i in m if i != q and len(m[i]) == len(m[q]))[:k]
        out[q] = [i for _, i in near]
    return out


def test_nearest_in_batches_of_any_size(spark):
    """Batches, cells and dimensions cut queries and vectors in many ways; the result stays."""
    rng = np.random.RandomState(5)
    m = {i: rng.standard_normal([8, 64, 70][i % 3] if i % 100 else [8, 64, 70][i // 100 % 3]).astype(np.float32).astype(float) for i in range(1500)}
    m |= {i: m[100] for i in range(1500, 1800)}  # a vector that is very common
    df = spark.createDataFrame([(i, x.tolist()) for i, x in m.items()], "vec_id long, embedding array<float>")
    want = slow_nearest(m, 10)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch, cell in (("1", 200), ("7", 64), ("10000", 200), ("10000", 5000)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            got = defaultdict(list)
            for r in sorted(nearest(df, F.col("vec_id") % 100 == 0, cell=cell, least=cell).collect(), key=lambda r: r["rank"]):
                got[r["query_id"]].append(r["vec_id"])
            assert got == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_nearest_recall(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").collect()
    m = {r["vec_id"]: np.array(r["embedding"], float) for r in rows}
    got = defaultdict(list)
    for r in sorted(queries.op9_one_bit_ann(spark, sf_dir).collect(), key=lambda r: r["rank"]):
        got[r["query_id"]].append(r["vec_id"])
    want = slow_nearest(m, 10)
    recall = sum(len({*got[q]} & {*want[q]}) for q in want) / sum(map(len, want.values()))
    print(f"recall {recall:.4f}")
    assert recall >= 0.99


def held_out(spark, sf_dir, name, label):
    labels = {r["doc_id"]: r[label] for r in read(spark, sf_dir, "labels").collect()}
    rows = [r for r in queries.QUERIES[name](spark, sf_dir).collect() if r["held_out"] and r["doc_id"] in labels]
    return [(r["predicted"], labels[r["doc_id"]]) for r in rows]


def test_quality_held_out(spark, sf_dir):
    pairs = held_out(spark, sf_dir, "op1_quality_classifier", "quality")
    assert sum(p == y for p, y in pairs) >= 0.85 * len(pairs)


def test_toxicity_held_out(spark, sf_dir):
    pairs = held_out(spark, sf_dir, "op3_toxicity", "toxic")
    assert sum(p == y for p, y in pairs) >= 0.85 * len(pairs)


def test_held_out_rows_are_not_learned_from(spark, sf_dir):
    rows = queries.op1_quality_classifier(spark, sf_dir).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_quality_against_plain_sizes(spark, sf_dir):
    import zstandard

    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = fit_quality(docs, labels)
    want = {}
    for r in docs.collect():
        raw, sizes = (r["text"] or "").encode(), []
        for dictionary in (model.bad, model.good):
            c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_dict_id=False)
            sizes.append(sum(len(c.compress(raw[i : i + 256])) for i in range(0, len(raw), 256)))
        b, g = sizes
        x = (b - g) / len(raw) if raw else 0
        want[r["doc_id"]] = 1 / (1 + np.exp(-model.slope * x - model.intercept))
    got = {r["doc_id"]: r["score"] for r in score_quality(docs, model).collect()}
    assert got == pytest.approx(want, abs=1e-9)


def test_curve_stands_for_all_rows(spark):
    """Rows of a class that stand for ten give the curve of the ten."""
    rng = np.random.RandomState(0)
    x, y = rng.standard_normal((300, 2)), (rng.random_sample(300) < 0.3).astype(float)
    x[y == 1] += 0.8
    many = np.repeat(np.arange(300), np.where(y == 1, 10, 1))
    few, all_ = logistic(x, y, np.where(y == 1, 10.0, 1.0)), logistic(x[many], y[many])
    at = lambda m: 1 / (1 + np.exp(-(x @ m[0] + m[1])))
    assert np.abs(at(few) - at(all_)).max() < 0.02
    rated = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(1000)], "doc_id long, label int")
    weights = class_weights(rated, Counter({1: 50, 0: 50}))
    assert weights[0] == pytest.approx(9 * weights[1]) and 50 * weights[0] + 50 * weights[1] == pytest.approx(100)


def slow_matches(folded, model):
    """All places of all patterns, one by one."""
    spans = [(i, i + len(p), w) for p, w in [*model.entries.items(), *((p, None) for p in model.exceptions)] for i in range(len(folded)) if folded.startswith(p, i)]
    safe, out = [s for s in spans if s[2] is None], {}
    for s in sorted((s for s in spans if s[2] is not None), key=lambda s: s[2]):
        out[s[0]] = s
    return sorted(s for s in out.values() if not any(e[0] <= s[0] and s[1] <= e[1] for e in safe))


def test_lexicon_against_plain_counts(spark):
    rng = random.Random(4)
    plain = [f"word{c}{d}" for c in "abcdefgh" for d in "xyz"]
    rows = []
    for i in range(400):
        words = rng.choices(plain, k=30)
        if i % 4 == 0:
            words.insert(rng.randrange(30), rng.choice(["vermin", "v3rmins", "sсum"]))
        elif i % 4 == 1:
            words[5:5] = ["scum", "of", "milk"] if i % 8 == 1 else ["pond", "scum"]
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = fit_toxicity(docs, labels, min_weight=0.5)
    learned = [(fold(t), y) for i, t, y in rows if (zlib.crc32(str(i).encode()) // 7) % 4]
    n = [sum(y == v for _, y in learned) for v in (0, 1)]
    count = {v: Counter(x for f, y in learned if y == v for x in terms(f)) for v in (0, 1)}
    odds = lambda c, m: np.log((c + 0.5) / (m - c + 0.5))
    weight = {x: odds(count[1][x], n[1]) - odds(count[0][x], n[0]) for x in count[1] if count[1][x] >= 4}
    assert model.entries == pytest.approx(choose_entries({x: w for x, w in weight.items() if w >= 0.5}))
    assert any(e.startswith("\1verm") for e in model.entries)
    assert any(len(e.strip("\1").split("\1")) > 1 for e in model.exceptions)
    for _, text, _ in rows:
        assert Matcher(model).spans(fold(text)) == slow_matches(fold(text), model)
    scores = {r["doc_id"]: r["score"] for r in score_toxicity(docs, model).collect()}
    for i, text, _ in rows:
        value = sum(w for _, _, w in slow_matches(fold(text), model)) / len(text.split()) ** 0.25
        assert scores[i] == pytest.approx(1 / (1 + np.exp(-model.slope * value - model.intercept)), abs=1e-9)


def test_words_that_harm_alone_and_not_in_phrases(spark):
    """At the query's own thresholds: words that clean documents hold in phrases only become entries, and the phrases
    exceptions; words that both use alike become neither."""
    rng = random.Random(9)
    plain = [f"word{c}{d}" for c in "abcdefgh" for d in "xyz"]
    rows = []
    for i in range(600):
        words = rng.choices(plain, k=30)
        words[4:4] = rng.choice([["loud"], []])
        if i % 2:
            words[9:9] = [rng.choice(["scum", "vermin"])]
            words[20:20] = rng.choice([["utter", "scum"], ["such", "vermin"]])
        elif i % 3:
            words[9:9] = rng.choice([["pond", "scum", "grows"], ["vermin", "control", "firm"]])
        rows.append((i, " ".join(words), i % 2))
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = fit_toxicity(docs, labels)
    mine = lambda w: any(fold(w).startswith(e) or e == fold(w) for e in model.entries)
    assert mine("scum") and mine("vermin") and not mine("loud")
    assert {fold("pond scum"), fold("vermin control")} <= set(model.exceptions)
    total = lambda t: sum(w for _, _, w in Matcher(model).spans(fold(t)))
    assert total("the pond scum grows") == total("a vermin control firm came") == total("a loud word") == 0 < min(total("you scum"), total("they are vermin"))
    # log-odds outside the harmless phrases, by plain counts
    learned = [(fold(t), y) for i, t, y in rows if (zlib.crc32(str(i).encode()) // 7) % 4]
    n = [sum(y == v for _, y in learned) for v in (0, 1)]
    only = ToxicityModel({fold("scum"): 1.0, fold("vermin"): 1.0}, model.exceptions)
    odds = lambda c, m: np.log((c + 0.5) / (m - c + 0.5))
    for w in ("scum", "vermin"):
        held = [sum(any(f[s:e] == fold(w) for s, e, _ in slow_matches(f, only)) for f, y in learned if y == v) for v in (0, 1)]
        assert model.entries[fold(w)] == pytest.approx(odds(held[1], n[1]) - odds(held[0], n[0]))
    scores = {r["doc_id"]: r["score"] for r in score_toxicity(docs, model).collect()}
    assert all((scores[i] >= 0.3) == bool(y) for i, _, y in rows)


def test_no_lexicon_is_cut(spark):
    """Thousands of entries stay entries."""
    rows = [(i, " ".join(f"bad{'abcdefghij'[j % 10]}q{'klmnopqrst'[j // 10 % 10]}x{'abcdefghij'[j // 100 % 10]}v{'abcdefghij'[j // 1000]}" for j in range(6000)) if i % 2 else "harmless words", i % 2) for i in range(40)]
    model = fit_toxicity(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"), min_weight=1.0)
    folded = fold(rows[1][1])
    assert len(Matcher(model).spans(folded)) == 6000


def test_lexicon():
    model = lexicon_model({"idiot": 3.0, "mor*": 2.0, "go away": 1.0}, exceptions=("moral", "village idiot"))
    found = lambda t: [(s, w) for s, _, w in Matcher(model).spans(fold(t))]
    total = lambda t: sum(w for _, w in found(t))
    assert total("You IDIOT") == total("y0u 1d1ot") == total("уоu іdіоt") == 3.0
    assert sum(w for _, _, w in Matcher(lexicon_model({"kill": 1.0})).spans(fold("ki1l k1ll kil1 KILL"))) == 4
    assert total("idiots") == 0 and total("morons") == 2.0 and total("moral") == 0 and total("the village idiot") == 0
    assert total("please go, away!") == 1.0 and total(None) == total("") == 0
    assert Matcher(lexicon_model({}))("any text") == (0, 2)


def slow_licenses(text, known):
    import re

    canon = re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", text.translate({i: i + 32 for i in range(65, 91)})).strip()
    spans = [(m.start(), m.end(), r.priority, r.label) for r in known if r.keyword in canon for m in re.finditer(r.pattern, canon)]
    inside = lambda s, o: o[0] <= s[0] and s[1] <= o[1] and o[2] <= s[2] and o != s and ((o[0], o[1]) != (s[0], s[1]) or (o[2], o[3]) < (s[2], s[3]))
    return sorted({s[3] for s in set(spans) if not any(inside(s, o) for o in spans)})


def test_license_rules(spark):
    texts = ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: GPL-2.0-or-later", "GNU General Public License v3 or later and the MIT license", "Creative Commons Attribution-ShareAlike 4.0", "https://creativecommons.org/licenses/by-nc/4.0/", "GNU Lesser General Public License, version 2.1", "Permission is hereby granted, free of charge, to any person obtaining a copy", "BSD 3-clause", "new BSD license", "All rights reserved. MIT License MIT License", "no words here"]
    got = {r["doc_id"]: r for r in scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    base = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    for i, t in enumerate(texts):
        low = " ".join(t.lower().replace(",", " ").replace(".", " ").split())
        assert got[i]["labels"].split(",") == (sorted({*slow_licenses(t, rules()), *(v for k, v in base.items() if k in low)}) or [""]), t
    assert got[0]["labels"] == "apache,apache-2.0" and got[9]["n_base"] == 2 and (got[9]["first_word"], got[9]["last_word"]) == (3, 5)
    assert len(rules()) > 300


def test_license_keywords_lose_nothing(spark):
    """Each alternative alone, without other words that hold a keyword by chance, against rules without keywords."""
    texts = ["Expat License", "under the Internet Systems Consortium License", "Berkeley Software Distribution License", "PSF License version 2", "PSF licence", "GNU GPL version 3", "GPL license", "released under the GNU GPL v2", "licensed under the Expat Licence"]
    got = {r["doc_id"]: r["labels"] for r in scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    ungated = [replace(r, keyword="") for r in rules()]
    for i, t in enumerate(texts):
        want = slow_licenses(t, ungated)
        assert want and got[i].split(",") == want, t


def test_article_is_found_among_boilerplate():
    page = """<body><div class="cookie-notice">We use cookies on this very long notice text, accept or not</div><header><h1>Site</h1></header>
    <div id="sidebar"><p>Side text</p></div><div class="content"><h2>Title</h2><p>One &amp; two&nbsp;three <a href=x>link</a>.<p>Second para with quite some text<ul><li>a<li>b</ul></div>
    <div class="comments"><p>nice post!!!</p></div><form><label>x</label></form><footer>f</footer></body>"""
    assert html_text.main_text(page) == "Title\nOne & two three link.\nSecond para with quite some text\na\nb"
    assert html_text.main_text("<main><nav>n</nav><article><header><h1>H</h1></header><p>x &lt; y</p><div class='ad'>buy</div></article></main>") == "H\nx < y"
    assert html_text.main_text("<div class='layout with-sidebar'><div class='sidebar'><p>side</p></div><article><p>kept</p></article></div>") == "kept"
    assert html_text.main_text("<main><p>text</p></main><div id='comments'><article>hm</article></div>") == "text"


def test_text_beside_the_densest_subtree_stays():
    long = "words of a paragraph " * 15
    para = long.strip()
    assert html_text.main_text(f"<body><h1>Head</h1><div><p>{long}</p><p>{long}</p></div><p>The end</p></body>") == f"Head\n{para}\n{para}\nThe end"
    assert html_text.main_text(f"<body>loose <b>text</b> with <a href=x>link</a><div><p>{long}</p><p>{long}</p></div>tail</body>") == f"loose text with link\n{para}\n{para}\ntail"
    assert html_text.main_text(f"<body><ul><li><a href=x>one</a><li><a href=y>two</a></ul><h2><a href=z>Linked</a></h2><div><p>{long}</p><p>{long}</p></div></body>") == f"Linked\n{para}\n{para}"
    assert html_text.main_text(f"<main><h1>Head</h1><article><p>{long}</p><p>{long}</p></article></main>") == f"Head\n{para}\n{para}"
    assert html_text.main_text(f"<body><article><p>first</p></article><article><p>{long}</p></article></body>") == f"first\n{para}"


P1 = "The first paragraph of the article says what it is about, in a sentence or two of the usual length."
P2 = "The second one goes on with details, names some figures, and ends where a reader would expect it to end."
P3 = "A third closes the matter, with a remark on what is still open and where more of it may be found."
MENU = "<ul><li><a href=/a>Home</a></li><li><a href=/b>Products</a></li><li><a href=/c>About us</a></li><li><a href=/d>Contact</a></li></ul>"
TEXT = f"<p>{P1}</p><p>{P2}</p><p>{P3}</p>"
WANT = [P1, P2, P3]
# body of a page, blocks of its main text
PAGES = {
    "paragraphs only": (TEXT, WANT),
    "menu without a name": (f"{MENU}<div>{TEXT}</div>", WANT),
    "menu in nav": (f"<nav>{MENU}</nav><div>{TEXT}</div>", WANT),
    "menu by role": (f"<div role=navigation>{MENU}</div><div>{TEXT}</div>", WANT),
    "menu after the text": (f"<div>{TEXT}</div>{MENU}", WANT),
    "no article, named content": (f"<div class=menu>{MENU}</div><div class=content><h1>Title</h1>{TEXT}</div>", ["Title", *WANT]),
    "article": (f"<nav>{MENU}</nav><article><h1>Title</h1>{TEXT}</article><footer>Imprint</footer>", ["Title", *WANT]),
    "two articles": (f"<article><p>{P1}</p></article><article><p>{P2}</p></article>", [P1, P2]),
    "nested articles": (f"<article><h1>Title</h1><p>{P1}</p><article><p>{P2}</p></article><p>{P3}</p></article>", ["Title", *WANT]),
    "empty article": (f"<article></article><div>{TEXT}</div>", WANT),
    "short article beside the text": (f"<article><p>Short</p></article><div>{TEXT}</div>", ["Short", *WANT]),
    "main with a headline": (f"<main><h1>Title</h1><article>{TEXT}</article></main>", ["Title", *WANT]),
    "headline outside": (f"<h1>Title</h1><div>{TEXT}</div><p>The end.</p>", ["Title", *WANT, "The end."]),
    "header of an article": (f"<header><a href=/>Site name</a></header><article><header><h1>Title</h1></header>{TEXT}</article>", ["Title", *WANT]),
    "related work": (f"<article>{TEXT}<section id=related-work><h2>Related work</h2><p>{P2}</p></section></article>", [*WANT, "Related work", P2]),
    "share price": (f"<article>{TEXT}<div class=share-price>The share price fell by four per cent on Monday.</div></article>", [*WANT, "The share price fell by four per cent on Monday."]),
    "alert paragraph": (f"<article>{TEXT}<p class=alert>Never mix the two, as the fumes are harmful to the lungs.</p></article>", [*WANT, "Never mix the two, as the fumes are harmful to the lungs."]),
    "word in a named span": (f"<div><p>{P1}</p><p>Take <span class=alert>great</span> care, and read all of it <b>twice</b> before you start.</p><p>{P3}</p></div>", [P1, "Take great care, and read all of it twice before you start.", P3]),
    "advert beside": (f"<div class=ad>Buy one now and get two!</div><article>{TEXT}</article>", WANT),
    "advert inside": (f"<article><p>{P1}</p><div class='ad-slot'>Buy one now and get two!</div><p>{P2}</p><p>{P3}</p></article>", WANT),
    "cookie notice": (f"<div id=cookie-notice><p>We use cookies to make this site better. Accept?</p><button>Yes</button></div><div>{TEXT}</div>", WANT),
    "sidebar": (f"<div class=page><div class=main>{TEXT}</div><div class=sidebar><h3>Topics</h3><p>Some of the topics of this week.</p></div></div>", WANT),
    "wrapper named after its sidebar": (f"<div class='layout with-sidebar'><div class=sidebar><p>Topics of the week</p></div><div>{TEXT}</div></div>", WANT),
    "reader comments": (f"<article>{TEXT}</article><section id=comments><h3>Two comments</h3><p>Nice one, thanks.</p><p>I do not agree with a word of it.</p></section>", WANT),
    "reader comments inside": (f"<article>{TEXT}<div class='comments-list'><p>Nice one, thanks.</p><p>I do not agree with it.</p></div></article>", WANT),
    "search form": (f"<form><label>Search the site</label><input name=q></form><div>{TEXT}</div>", WANT),
    "text inside a form": (f"<form id=aspnetForm><input type=hidden><div>{TEXT}</div></form>", WANT),
    "links in the text": (f"<div><p>{P1} <a href=x>See the report</a>.</p><p>{P2}</p></div>", [f"{P1} See the report.", P2]),
    "list of sources": (f"<nav>{MENU}</nav><div>{TEXT}<h2>Sources</h2><ul><li><a href=x>The report</a></li><li><a href=y>The figures</a></li></ul></div>", [*WANT, "Sources", "The report", "The figures"]),
    "link-heavy page": (f"{MENU}{MENU}<div>{TEXT}</div>{MENU}", WANT),
    "table": (f"<nav>{MENU}</nav><div>{TEXT}<table><tr><td>1</td><td>2</td></tr></table></div>", [*WANT, "1", "2"]),
    "code": (f"<nav>{MENU}</nav><div>{TEXT}<pre>a = 1\nb = 2</pre></div>", [*WANT, "a = 1 b = 2"]),
    "loose text": (f"{P1}<br>{P2}<div>{P3}</div>", [f"{P1} {P2}", P3]),
    "scripts": (f"<script>var t='</p>';</script><style>p{{}}</style><div>{TEXT}<noscript>no</noscript></div>", WANT),
    "one long paragraph with bold": (f"<nav>{MENU}</nav><div><h1>Title</h1><p><b>{P1} {P2} {P3}<br><p>Short.</p></div>", ["Title", f"{P1} {P2} {P3}", "Short."]),
    "deep": ("<div>" * 2000 + TEXT, WANT),
    "formula and button among words": (f"<div><p>{P1}</p><p>Euler wrote <math><mi>e</mi></math> in a letter. Press <button>Save</button> to keep the file.</p><p>{P3}</p></div>", [P1, "Euler wrote e in a letter. Press Save to keep the file.", P3]),
    "button beside the text": (f"<div>{TEXT}<div><button>Save</button></div></div>", WANT),
    "notice in a paragraph": (f"<p class=notice>We use cookies on this site. Read our policy.</p><div>{TEXT}</div>", WANT),
    "long thread of comments": (f"<article>{TEXT}</article><section id=comments>{''.join(f'<p>{P2} {P1}</p>' for _ in range(9))}</section>", WANT),
    **{f"short box, {name}": (f"<article>{TEXT}</article><div class={name}><p>Three other things to see here.</p></div>", WANT) for name in ("related", "social", "share", "login", "widget", "newsletter")},
    **{f"prose in {name}": (f"<article>{TEXT}</article><section class={name}>{TEXT}<p>{P2} {P1}</p></section>", [*WANT, *WANT, f"{P2} {P1}"]) for name in ("related", "social", "share", "login", "widget", "newsletter")},
    **{f"prose in {name} inside": (f"<article><p>{P1}</p><div class={name}>{TEXT}<p>{P2} {P1}</p></div><p>{P3}</p></article>", [P1, *WANT, f"{P2} {P1}", P3]) for name in ("related", "social", "share")},
    **{f"menu without a name, {n} times": (f"{MENU * n}<div><h1>Title</h1>{TEXT}</div>", ["Title", *WANT]) for n in (2, 3, 4, 6, 9)},
}


def test_densities_decide(monkeypatch):
    """With the same density everywhere, at least a tenth of the pages get another text: boxes are told from prose by their density,
    and menus without a name from lists."""
    assert len(PAGES) >= 60
    measured = html_text.measure

    def flat(root):
        nodes = measured(root)
        for x in nodes:
            x.density = 1.0
        for x in nodes:
            x.rank = sum(c.density * c.names[1] for c in x.elements() if not c.dropped)
        return nodes

    monkeypatch.setattr(html_text, "measure", flat)
    changed = [name for name, (body, want) in PAGES.items() if html_text.main_text(f"<html><body>{body}</body></html>").split("\n") != want]
    assert len(changed) >= len(PAGES) / 10
    assert any("prose" in c for c in changed) and any("menu" in c for c in changed), changed


@pytest.mark.parametrize("name", PAGES)
def test_varied_pages(name):
    body, want = PAGES[name]
    page = f"<html><head><title>T</title></head><body>{body}</body></html>"
    assert html_text.main_text(page).split("\n") == want
    if "header of" not in name and "<main>" not in body:
        renamed = page.replace("<article>", "<div>").replace("</article>", "</div>")
        assert html_text.main_text(renamed).split("\n") == want


def test_density_is_the_published_one():
    """Against the formula written out, and the path's threshold by hand."""
    root = html_text.parse("<body><div><p>aaaa bbbb cccc</p><p>dddd <a>ee</a></p></div><ul><li><a>ff</a></li></ul></body>")
    html_text.measure(root)
    body = root.elements()[0]
    div, ul = body.elements()
    c, lc, t, lt, all_c, all_lc = 18, 2, 3, 1, 20, 4
    y = c / (c - lc) * lc + all_lc / all_c * c + np.e
    assert (div.chars, div.links, div.tags, div.link_tags) == (c, lc, t, lt)
    assert div.density == pytest.approx(c / t * np.log(c / lc * t / lt) / np.log(np.log(y)))
    assert div.rank == pytest.approx(sum(p.density for p in div.elements()))
    y = 2 / max(1, 0) * 2 + all_lc / all_c * 2 + np.e
    assert ul.density == pytest.approx(2 / 2 * np.log(2 / 2 * 2 / 1) / np.log(np.log(y)))
    best, path, threshold = html_text.densest(body)
    assert best is div and path == {id(div), id(body)} and threshold == pytest.approx(min(div.density, body.density))


def test_pages_of_table(spark, sf_dir):
    import html
    import re

    pages = read(spark, sf_dir, "pages")
    want = {}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        want[r["page_id"]] = "\n".join(p for p in parts if p)
    assert {r["page_id"]: r["text"] for r in queries.op7_html_extraction(spark, sf_dir).collect()} == want
    renamed = pages.withColumn("html", F.regexp_replace("html", "(</?)article>", "$1div>"))
    assert {r["page_id"]: r["text"] for r in html_text.extract_text(renamed).collect()} == want


def test_pipeline(spark, sf_dir):
    """Stage by stage against plain versions of what each must leave."""
    docs = read(spark, sf_dir, "documents").cache()
    good = corpus_pipeline.quality_stage(spark, docs, sf_dir).cache()
    scores = {r["doc_id"]: r["score"] for r in queries.op1_quality_classifier(spark, sf_dir).collect()}
    assert {r["doc_id"] for r in good.collect()} == {i for i, s in scores.items() if s >= 0.3}
    exact = corpus_pipeline.exact_stage(spark, good, sf_dir).cache()
    first = {}
    for r in sorted(good.collect(), key=lambda r: r["doc_id"]):
        first.setdefault(" ".join(__import__("re").split(r"[\x20\x09-\x0D]+", r["text"] or "")), r["doc_id"])
    assert sorted(r["doc_id"] for r in exact.collect()) == sorted(first.values())
    near = corpus_pipeline.near_stage(spark, exact, sf_dir).cache()
    slow = slow_components([(r["doc_id"], r["text"]) for r in exact.collect()], 5, 80)
    assert sorted(r["doc_id"] for r in near.collect()) == sorted(i for i, (_, c) in slow.items() if i == c)
    mixed = corpus_pipeline.mixing_stage(spark, near, sf_dir).cache()
    assert mixed.columns == docs.columns
    total = sum(len((r["text"] or "").encode().split()) for r in near.collect())
    assert 0.9 * total <= sum(len((r["text"] or "").encode().split()) for r in mixed.collect()) <= total
    assert corpus_pipeline.run(spark, sf_dir).count() == mixed.count()
