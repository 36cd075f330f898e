"""Neighbours by blocks of rows: no table of all pairs, and the same results for any block size."""

import numpy as np
import pytest

from timberline import catalog
from timberline.operators import info

SF = "/root/testdata/sf0.001"


def points(spark, n):
    rng = np.random.default_rng(0)
    xyz = np.round(rng.random((n, 3)), 1)  # many ties
    return xyz, spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(xyz)], "row_id long, a double, b double, c double")


@pytest.mark.parametrize("block", [7, 1000])
def test_nearest_and_counts_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(info, "BLOCK", block)
    monkeypatch.setattr(info, "TILE", 5)
    xyz, rows = points(spark, 40)
    gap = np.abs(xyz[:, None] - xyz[None]).astype(float)
    d = gap.max(2)
    want = {(i, j) for i in range(40) for j in sorted((j for j in range(40) if j != i), key=lambda j: (d[i, j], j))[:3]}
    assert {(r["i"], r["j"]) for r in info.nearest(rows, ["a", "b", "c"], 3).collect()} == want
    eps = [sorted(d[i, [j for j in range(40) if j != i]])[2] for i in range(40)]
    near = lambda i, c: sum(j != i and gap[i, j, c].max() < eps[i] for j in range(40))
    got = {r["row_id"]: (r["eps"], r["nx"], r["ny"], r["nz"]) for r in info.ksg_counts(rows, ["a"], ["b"], ["c"], 3).collect()}
    assert got == {i: (eps[i], near(i, [0, 2]), near(i, [1, 2]), near(i, [2])) for i in range(40)}


@pytest.mark.parametrize("name", ["ksg_neighbor_counts", "conditional_resample", "restricted_permutation"])
def test_no_table_of_row_pairs(spark, name):
    found = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in found and "NOT (i#" not in found


@pytest.mark.parametrize("block", [6, 1000])
def test_nearest_of_blocks_by_place(spark, monkeypatch, block):
    monkeypatch.setattr(info, "NEAR_BLOCK", block)
    xyz, _ = points(spark, 60)
    xyz[:20] = 0.3  # more equal rows than a block has
    cells = [[None if (i, c) in {(21, 0), (22, 1), (23, 0), (23, 1)} else float(v) for c, v in enumerate(r)] for i, r in enumerate(xyz)]
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(cells)], "row_id long, a double, b double, c double")
    both = lambda i, j: [abs(x - y) for x, y in zip(cells[i][:2], cells[j][:2]) if x is not None and y is not None]
    want = set()
    for i in range(60):
        d = sorted((max(both(i, j)), j) for j in range(60) if j != i and both(i, j))
        want |= {(i, j, gap, n + 1) for n, (gap, j) in enumerate(d[:3])}
    assert {tuple(r) for r in info.nearest(rows, ["a", "b"], 3).select("i", "j", "dist", "rank").collect()} == want


def test_far_blocks_do_not_meet(spark, monkeypatch):
    """Rows on a line ask the blocks beside their own, not all of them."""
    asked = []
    monkeypatch.setattr(info, "NEAR_BLOCK", 50)
    keep = info.checkpointed
    monkeypatch.setattr(info, "checkpointed", lambda df: asked.append(keep(df)) or asked[-1])
    rows = spark.range(1000).selectExpr("id as row_id", "double(id) as a")
    got = info.nearest(rows, ["a"], 2)
    assert {(r.i, r.j) for r in got.filter("i = 500").collect()} == {(500, 499), (500, 501)} and got.count() == 2000
    blocks, first = asked
    assert blocks.count() >= 20 and first.filter("y is not null").count() <= 3 * blocks.count()


def test_permutation_takes_its_columns_only(spark):
    near = spark.createDataFrame([(i, (i + k) % 9, k) for i in range(9) for k in (1, 2)], "i long, j long, rank int")
    want = {tuple(r) for r in info.restricted_permutation(near).collect()}
    more = near.selectExpr("*", "make_interval(1) as dist")  # has no form in workers
    assert {tuple(r) for r in info.restricted_permutation(more).collect()} == want and len(want) == 9
