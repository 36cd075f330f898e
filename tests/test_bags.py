"""Bags and posteriors of large tables: draws are made once, and rows aren't dealt by their id."""

import pytest
from pyspark.sql import functions as F

from timberline import catalog
from timberline.functions.draws import uniform
from timberline.operators import bagging

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_draw_is_made_once(spark):
    assert plan(bagging.bootstrap(spark.range(10).toDF("row_id"), 3, 1.6)).count("md5(") == 1


def test_average_deals_no_rows_by_id(spark):
    assert "hashpartitioning(row_id" not in plan(catalog.queries()["forest_posterior_average"](spark, SF))


@pytest.mark.parametrize("n", [1, 7, 40_000])
def test_honest_cut_is_exact(spark, n):
    bag = spark.range(n).select(F.col("id").alias("row_id"), F.lit(0).alias("tree"), (F.col("id") % 3).alias("mult"))
    rows = bag.withColumn("u", uniform("s", "row_id", "tree")).collect()
    want = {r["row_id"] for r in sorted(rows, key=lambda r: (r["u"], r["row_id"]))[: int(n * 0.5)]}
    assert {r["row_id"] for r in bagging.honest_partition(bag, None, 0.5, "s").filter("role = 'honest'").collect()} == want
    _, sums = bagging.honest_cut(bag, ["tree"], 0.5, "s")
    assert sum(r["weight"] for r in sums.collect()) == sum(k % 3 for k in want)


@pytest.mark.parametrize("name", ["honest_decision_function", "posterior_per_tree_oob"])
def test_honest_posteriors_deal_no_rows_by_id(spark, name):
    found = plan(catalog.queries()[name](spark, SF))
    assert "hashpartitioning(row_id" not in found and "SortMergeJoin [row_id" not in found
