"""Scores of cuts that leave few rows beside many, against exact arithmetic."""

import math
from fractions import Fraction

from pyspark.sql import functions as F

from timberline.operators.splits import cut_table


def exact_fastbic(side, other):
    """Score of a cut from whole numbers: the sums are exact, only the logarithms round."""
    n = len(side) + len(other)
    mean = lambda z: Fraction(sum(z), len(z))
    var = [sum((x - mean(z)) ** 2 for x in z) / len(z) for z in (side, other)]
    pooled = (len(side) * var[0] + len(other) * var[1]) / n
    cost = lambda z, v: -2.0 * (len(z) * math.log(len(z) / n) - 0.5 * len(z) * math.log(2 * math.pi * float(v) + 1e-7))
    return -min(cost(side, var[0]) + cost(other, var[1]), cost(side, pooled) + cost(other, pooled))


def test_small_side_has_its_own_sums(spark):
    tail = [10**9 + k % 2 for k in range(100)]
    bulk = [k * 999_983 for k in range(1000)]
    rows = spark.createDataFrame([(float(z),) for z in bulk + tail], "z double").withColumn("proj", F.lit(0))
    cut = cut_table(rows, ["proj"], "fastbic", min_leaf=100).filter("n_right = 100").first()
    assert abs(cut["score"] - exact_fastbic(bulk, tail)) < 1e-3
