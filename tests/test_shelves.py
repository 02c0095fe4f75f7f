"""Vector search by shelves of cells: what a batch in a Python worker holds."""

import numpy as np
from test_vector_cells import plain, rows_of

from inkwell.operators import vector_search
from inkwell.operators.vector_search import _shelved, cell_search, vector_cells


def test_shelves_are_bounded():
    cells = np.zeros(5, dtype=[("facet", "i8"), ("cell", "i4"), ("n", "i8"), ("angle", "f8")])
    cells["n"] = [10, 30, 2_000_000, 5, 16_000]
    made, shelves = _shelved({64: cells}, 2)
    full = vector_search.SHELF_BYTES // (8 * 64)
    load = np.zeros(shelves)
    for c in made[64]:
        load[c["shelf"] : c["shelf"] + c["shelves"]] += c["n"] / c["shelves"]
    assert round(load.sum()) == cells["n"].sum() and load.max() <= full and made[64]["shelves"].max() > 100


def test_crowded_cells_and_full_shelves_give_the_plain_rows(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "SHELF_BYTES", 40 * 8 * 4)  # 40 vectors
    monkeypatch.setattr(vector_search, "BLOCK", 400)
    rng = np.random.RandomState(0)
    held = [(i, rng.standard_normal(4).tolist()) for i in range(150)]
    held += [(1000 + i, held[3][1]) for i in range(200)]  # copies, more than a shelf
    df = spark.createDataFrame(held, "chunk_id int, embedding array<double>").repartition(3)
    asked = held[:40]
    cells = vector_cells(df)
    assert _shelved(cells.cells, 1)[1] >= 8
    assert rows_of(cell_search(cells, spark.createDataFrame(asked, "query_id int, vector array<double>"), 7, digits=6)) == plain(held, asked, 7)
