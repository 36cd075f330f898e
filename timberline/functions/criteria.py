"""Split criteria as column expressions over sums left and right of a cut.

A criterion names the sums it needs per row and gives a score to maximise; criteria of
one family differ only there. The numpy growers use the same definitions (numpy twins).
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added to variances before a logarithm.
TINY = 1e-7

Sums = dict[str, Column]


def _xlogx_over(x: Column, total: Column) -> Column:
    return F.when(x > 0, x * F.ln(x / total)).otherwise(F.lit(0.0))


def _add(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def _gini(s: Sums) -> Column:
    ks = [k for k in s if k.startswith("c")]
    return _add([s[k] * s[k] for k in ks]) / s["w"]


def _entropy(s: Sums) -> Column:
    return _add([_xlogx_over(s[k], s["w"]) for k in s if k.startswith("c")])


def _mean_square(s: Sums) -> Column:
    return s["s"] * s["s"] / s["w"]


def _poisson(s: Sums) -> Column:
    return _xlogx_over(s["s"], s["w"])


def _variance(s: Sums, mean_of: Sums | None = None) -> Column:
    return F.greatest((s["q"] - s["s"] * s["s"] / s["w"]) / s["w"], F.lit(0.0))


def _fast_bic(left: Sums, right: Sums) -> Column:
    n = left["w"] + right["w"]

    def cost(side: Sums, variance: Column) -> Column:
        return -2.0 * (side["w"] * F.ln(side["w"] / n) - 0.5 * side["w"] * F.ln(2 * math.pi * variance + TINY))

    vl, vr = _variance(left), _variance(right)
    pooled = (left["w"] * vl + right["w"] * vr) / n
    return -F.least(cost(left, vl) + cost(right, vr), cost(left, pooled) + cost(right, pooled))


@dataclass(frozen=True)
class Criterion:
    """kind: which sums it takes ("class", "target" or "value"); score of the two sides."""

    name: str
    kind: str
    score: Callable[[Sums, Sums], Column]


def _both(side: Callable[[Sums], Column]):
    return lambda left, right: side(left) + side(right)


def _friedman(left: Sums, right: Sums) -> Column:
    gap = left["s"] / left["w"] - right["s"] / right["w"]
    return gap * gap * left["w"] * right["w"] / (left["w"] + right["w"])


CRITERIA = {
    c.name: c
    for c in (
        Criterion("gini", "class", _both(_gini)),
        Criterion("entropy", "class", _both(_entropy)),
        Criterion("log_loss", "class", _both(_entropy)),
        Criterion("squared_error", "target", _both(_mean_square)),
        Criterion("friedman_mse", "target", _friedman),
        Criterion("poisson", "target", _both(_poisson)),
        Criterion("twomeans", "value", _both(_mean_square)),
        Criterion("fastbic", "value", _fast_bic),
    )
}


# numpy twins: arrays of sums, one entry per cut


def _np_xlogx_over(x, total):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(x > 0, x * np.log(x / total), 0.0)


def np_score(name: str, left: dict, right: dict) -> np.ndarray:
    """Score of every cut from the sums on its sides: w, and c (cuts x classes), or s
    and q (sums of values and of their squares)."""
    if name == "gini":
        return sum((x["c"] ** 2).sum(-1) / x["w"] for x in (left, right))
    if name in ("entropy", "log_loss"):
        return sum(_np_xlogx_over(x["c"], x["w"][..., None]).sum(-1) for x in (left, right))
    if name in ("squared_error", "twomeans"):
        return sum(x["s"] ** 2 / x["w"] for x in (left, right))
    if name == "friedman_mse":
        gap = left["s"] / left["w"] - right["s"] / right["w"]
        return gap**2 * left["w"] * right["w"] / (left["w"] + right["w"])
    if name == "poisson":
        return sum(_np_xlogx_over(x["s"], x["w"]) for x in (left, right))
    if name == "fastbic":
        n = left["w"] + right["w"]
        var = [np.maximum((x["q"] - x["s"] ** 2 / x["w"]) / x["w"], 0) for x in (left, right)]
        pooled = (left["w"] * var[0] + right["w"] * var[1]) / n

        def cost(x, v):
            return -2.0 * (x["w"] * np.log(x["w"] / n) - 0.5 * x["w"] * np.log(2 * math.pi * v + TINY))

        return -np.minimum(cost(left, var[0]) + cost(right, var[1]), cost(left, pooled) + cost(right, pooled))
    raise ValueError(f"unknown criterion {name!r}")


def np_impurity(name: str, s: dict) -> float:
    """Impurity of a node by the criterion's definition."""
    w = s["w"]
    if name == "gini":
        return float(1 - ((s["c"] / w) ** 2).sum())
    if name in ("entropy", "log_loss"):
        return float(-_np_xlogx_over(s["c"], w).sum() / w)
    if name == "poisson":
        return float(-_np_xlogx_over(np.asarray(s["s"]), w) / w)
    if name == "fastbic":
        v = max((s["q"] - s["s"] ** 2 / w) / w, 0)
        return float(math.log(2 * math.pi * v + TINY))
    return float(max((s["q"] - s["s"] ** 2 / w) / w, 0))
