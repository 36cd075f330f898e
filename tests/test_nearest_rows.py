"""Forest neighbours without the pairs of rows."""

import pytest

from timberline import catalog
from timberline.operators import proximity


@pytest.mark.parametrize("block", [6, 1000])
def test_equals_neighbours_from_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(proximity, "BLOCK", block)
    leaf = spark.createDataFrame([(r, t, (r * (t + 2)) % 7 % 3) for r in range(30) for t in range(3)], "row_id long, tree int, leaf int")
    want = proximity.k_neighbors(proximity.similarity(leaf, 3), 4)
    assert set(map(tuple, proximity.nearest_rows(leaf, 3, 4).collect())) == set(map(tuple, want.select("i", "j", "dist", "rank").collect()))


def test_no_pairs_of_rows(spark):
    found = catalog.queries()["forest_knn"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in found and "least(" not in found
