"""Linear combinations of feature arrays, and row-major index arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def linear(features: Column, index: Column, weight: Column) -> Column:
    """sum_k weight[k] * features[index[k]], in double precision."""
    terms = F.zip_with(index, weight, lambda i, w: F.get(features, i).cast("double") * w)
    return F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)


def ravel(coords: list[Column], dims: list[int]) -> Column:
    """Flat row-major index of coordinates."""
    out = coords[0]
    for c, d in zip(coords[1:], dims[1:]):
        out = out * d + c
    return out


def unravel(flat: Column, dims: list[int]) -> list[Column]:
    """Coordinates of a flat row-major index."""
    out = []
    for d in reversed(dims):
        out.append(F.pmod(flat, F.lit(d)))
        flat = F.floor(flat / d)
    return out[::-1]


def goes_left(z: Column, threshold: Column, missing_left: Column | None = None) -> Column:
    """Whether a value goes to the left child; NaN goes where the node sends it."""
    nan = F.lit(False) if missing_left is None else missing_left
    return F.when(F.isnan(z), nan).otherwise(z <= threshold)
