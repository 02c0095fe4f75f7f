"""Cells of vectors against plain products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.operators.vector_search import cell_search, vector_cells, vector_search


def plain(held, asked, k, allowed=None):
    """Rows (query, rank, id, similarity) by the words of the contract."""
    out = []
    for q, v in asked:
        rows = []
        for i, w, *rest in held:
            if v is None or w is None or len(v) != len(w) or (allowed and not allowed(q, rest[0])):
                continue
            a, b = np.array(v, float), np.array(w, float)
            s = round(float(a @ b) / np.sqrt(float(a @ a) * float(b @ b)), 6) if a.any() and b.any() else None
            rows.append((s is None, -(s or 0), i, s))
        out += [(q, n + 1, i, s) for n, (_, _, i, s) in enumerate(sorted(rows)[:k])]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r["query_id"], r["rank"], r["chunk_id"], None if r["similarity"] is None else r["similarity"] + 0.0) for r in df.collect()), key=str)


@pytest.mark.parametrize("k", [1, 7, 400])
def test_cells_give_the_plain_rows(spark, k):
    rng = np.random.RandomState(k)
    centres = rng.standard_normal((9, 6))
    held = [(i, (centres[rng.randint(9)] + rng.standard_normal(6) * 0.2).astype(np.float32).tolist()) for i in range(300)]
    held += [(1000, [0.0] * 6), (1001, None), (1002, [1.0, 0.0]), (1003, held[3][1]), (1004, held[3][1]), (1005, [])]
    asked = [(i, held[i * 7][1]) for i in range(30)] + [(90, [0.0] * 6), (91, None), (92, [0.5, 0.5]), (93, [1.0] * 9), (94, [])]
    df = spark.createDataFrame(held, "chunk_id int, embedding array<float>").repartition(3)
    got = vector_search(df, spark.createDataFrame(asked, "query_id int, vector array<float>"), k, digits=6)
    assert rows_of(got) == plain(held, asked, k)
    assert vector_search(df.limit(0), spark.createDataFrame(asked, "query_id int, vector array<float>"), k).count() == 0
    assert vector_search(df, spark.createDataFrame(asked, "query_id int, vector array<float>").limit(0), k).count() == 0


def test_cells_far_away_are_skipped(spark):
    rng = np.random.RandomState(0)
    centres = rng.standard_normal((20, 8))
    held = [(i, (centres[i % 20] + rng.standard_normal(8) * 0.02).tolist()) for i in range(2000)]
    df = spark.createDataFrame(held, "chunk_id int, embedding array<double>")
    cells, visits = vector_cells(df), []
    asked = spark.createDataFrame(held[:50], "query_id int, vector array<double>")
    got = cell_search(cells, asked, 10, digits=6, visits=visits)
    assert rows_of(got) == plain(held, held[:50], 10)
    met = visits[0].unionByName(visits[1]).groupBy("query_id").count().agg(F.max("count")).first()[0]
    assert met < len(cells.cells[8]) / 3
    # vectors are packed once, whatever the number of queries
    assert cells.pieces.select(F.explode("ids")).count() == 2000


def test_filters_are_cells(spark):
    rng = np.random.RandomState(1)
    held = [(i, rng.standard_normal(4).tolist(), i % 3) for i in range(200)]
    asked = [(i, rng.standard_normal(4).tolist()) for i in range(9)]
    allowed = {0: [0], 1: [1, 2], 2: []}
    df = spark.createDataFrame(held, "chunk_id int, embedding array<double>, kind int")
    queries = spark.createDataFrame([(q, v, q % 3) for q, v in asked], "query_id int, vector array<double>, filter long")
    filters = spark.createDataFrame([(f, k) for f, kinds in allowed.items() for k in kinds], "filter long, facet long")
    got = vector_search(df, queries, 5, digits=6, facet="kind", filters=filters)
    assert rows_of(got) == plain(held, asked, 5, lambda q, kind: kind in allowed[q % 3])
