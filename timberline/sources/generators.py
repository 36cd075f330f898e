"""Synthetic data as Spark plans: every value is a portable draw of (row, dimension)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import normal, uniform

# The mixtures of Marron and Wand (1992), as (weight, mean, standard deviation).
MARRON_WAND = {
    "gaussian": [(1, 0, 1)],
    "skewed_unimodal": [(1 / 5, 0, 1), (1 / 5, 1 / 2, 2 / 3), (3 / 5, 13 / 12, 5 / 9)],
    "strongly_skewed": [(1 / 8, 3 * ((2 / 3) ** i - 1), (2 / 3) ** i) for i in range(8)],
    "kurtotic_unimodal": [(2 / 3, 0, 1), (1 / 3, 0, 1 / 10)],
    "outlier": [(1 / 10, 0, 1), (9 / 10, 0, 1 / 10)],
    "bimodal": [(1 / 2, -1, 2 / 3), (1 / 2, 1, 2 / 3)],
    "separated_bimodal": [(1 / 2, -3 / 2, 1 / 2), (1 / 2, 3 / 2, 1 / 2)],
    "skewed_bimodal": [(3 / 4, 0, 1), (1 / 4, 3 / 2, 1 / 3)],
    "trimodal": [(9 / 20, -6 / 5, 3 / 5), (9 / 20, 6 / 5, 3 / 5), (1 / 10, 0, 1 / 4)],
    "claw": [(1 / 2, 0, 1), *[(1 / 10, i / 2 - 1, 1 / 10) for i in range(5)]],
    "double_claw": [(49 / 100, -1, 2 / 3), (49 / 100, 1, 2 / 3), *[(1 / 350, (i - 3) / 2, 1 / 100) for i in range(7)]],
    "asymmetric_claw": [(1 / 2, 0, 1), *[(2 ** (1 - i) / 31, i + 1 / 2, 2**-i / 10) for i in range(-2, 3)]],
    "asymmetric_double_claw": [
        *[(46 / 100, 2 * i - 1, 2 / 3) for i in range(2)], *[(1 / 300, -i / 2, 1 / 100) for i in range(1, 4)],
        *[(7 / 300, i / 2, 7 / 100) for i in range(1, 4)],
    ],
    "smooth_comb": [(2 ** (5 - i) / 63, (65 - 96 / 2**i) / 21, 32 / 63 / 2**i) for i in range(6)],
    "discrete_comb": [*[(2 / 7, (12 * i - 15) / 7, 2 / 7) for i in range(3)], *[(1 / 21, 2 * i / 7, 1 / 21) for i in range(8, 11)]],
}


def moving_average_cov(n: int, rho: float) -> np.ndarray:
    """1 on the diagonal, rho next to it, 0 elsewhere."""
    i = np.arange(n)
    gap = np.abs(i[:, None] - i)
    return np.where(gap <= 1, float(rho) ** gap, 0.0)


def autoregressive_cov(n: int, rho: float) -> np.ndarray:
    i = np.arange(n)
    return float(rho) ** np.abs(i[:, None] - i)


def covariance_table(spark: SparkSession, n: int, rho: float, band: str = "ma") -> DataFrame:
    """(i, j, cov) of the matrices above, as a plan."""
    a, b = spark.range(n).withColumnRenamed("id", "i"), spark.range(n).withColumnRenamed("id", "j")
    gap = F.abs(F.col("i") - F.col("j"))
    value = F.pow(F.lit(float(rho)), gap)
    if band == "ma":
        value = F.when(gap <= 1, value).otherwise(0.0)
    elif band != "ar":
        raise ValueError(f"band type {band!r} is neither ma nor ar")
    return a.join(b, F.lit(True)).select("i", "j", value.alias("cov"))


def _correlated(salt: str, d: int, factor: np.ndarray | None, key: str = "row_id") -> list[Column]:
    """d normal draws with covariance factor @ factor.T (independent without a factor)."""
    base = [normal(f"{salt}{k}", key) for k in range(d)]
    if factor is None:
        return base
    out = []
    for r in range(d):
        terms = [float(factor[r, k]) * base[k] for k in range(r + 1) if factor[r, k]]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        out.append(total)
    return out


def _rows(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "row_id")


def _finish(rows: DataFrame, columns: list[Column], label: Column, n_dim: int, salt: str) -> DataFrame:
    noise = [normal(f"{salt}noise{k}", "row_id") for k in range(len(columns), n_dim)]
    return rows.select("row_id", F.array(*columns, *noise).alias("features"), label.cast("int").alias("label"))


def make_quadratic_classification(spark: SparkSession, n_samples: int, n_features: int, noise: bool = False, seed: int = 0) -> DataFrame:
    """2 n rows: class 0 standard normal x, class 1 (c_i x_i)^2 of the same x, c_i =
    exp(-0.0325 (i + 24)), plus normal noise if wanted."""
    rows = _rows(spark, 2 * n_samples)
    base = F.pmod("row_id", F.lit(n_samples))
    one = F.col("row_id") >= n_samples
    cols = []
    for k in range(n_features):
        x = normal(f"q{seed}_{k}", base)
        y = F.pow(x * math.exp(-0.0325 * (k + 24)), 2)
        if noise:
            y = y + normal(f"qe{seed}_{k}", base)
        cols.append(F.when(one, y).otherwise(x))
    return _finish(rows, cols, one, n_features, f"q{seed}")


def _factor(n: int, rho: float, band: str, scale: float = 1.0) -> np.ndarray | None:
    if rho == 0 and scale == 1:
        return None
    if band not in ("ma", "ar"):
        raise ValueError(f"band type {band!r} is neither ma nor ar")
    cov = np.eye(n) if rho == 0 else moving_average_cov(n, rho) if band == "ma" else autoregressive_cov(n, rho)
    return np.linalg.cholesky(scale * cov)


def _check_dims(n_dim: int, n_informative: int) -> None:
    if n_dim < n_informative:
        raise ValueError(f"{n_informative} informative of {n_dim} dimensions")


def make_trunk_classification(spark: SparkSession, n_samples: int, n_dim: int = 10, n_informative: int = 10, mu_0: float = 0.0,
                              mu_1: float = 1.0, rho: float = 0.0, band_type: str = "ma", scaling_factor: float = 1.0, seed: int = 0) -> DataFrame:
    """Two Gaussians of means mu / sqrt(i) in dimension i, half of the rows each; noise
    dimensions follow."""
    _check_dims(n_dim, n_informative)
    rows = _rows(spark, 2 * (n_samples // 2))
    one = F.col("row_id") >= n_samples // 2
    cols = [
        x + F.when(one, mu_1 / math.sqrt(k + 1)).otherwise(mu_0 / math.sqrt(k + 1))
        for k, x in enumerate(_correlated(f"t{seed}_", n_informative, _factor(n_informative, rho, band_type, scaling_factor)))
    ]
    return _finish(rows, cols, one, n_dim, f"t{seed}")


def make_trunk_mixture_classification(spark: SparkSession, n_samples: int, n_dim: int = 10, n_informative: int = 10, mu_0: float = 0.0,
                                      mu_1: float = 1.0, mix: float = 0.5, rho: float = 0.0, band_type: str = "ma", seed: int = 0) -> DataFrame:
    """Class 0 a centred Gaussian; class 1 one of mean mu_0 / sqrt(i) with probability mix,
    else of mu_1 / sqrt(i)."""
    _check_dims(n_dim, n_informative)
    if not 0 <= mix <= 1:
        raise ValueError("mix must lie between 0 and 1")
    rows = _rows(spark, 2 * (n_samples // 2))
    one = F.col("row_id") >= n_samples // 2
    first = uniform(f"tm{seed}mix", "row_id") < mix
    cols = [
        x + F.when(one, F.when(first, mu_0 / math.sqrt(k + 1)).otherwise(mu_1 / math.sqrt(k + 1))).otherwise(0.0)
        for k, x in enumerate(_correlated(f"tm{seed}_", n_informative, _factor(n_informative, rho, band_type)))
    ]
    return _finish(rows, cols, one, n_dim, f"tm{seed}")


def make_marron_wand_classification(spark: SparkSession, n_samples: int, n_dim: int = 10, n_informative: int = 10,
                                    simulation: str = "gaussian", rho: float = 0.0, band_type: str = "ma", seed: int = 0) -> DataFrame:
    """Class 0 normal; class 1 (1 - w) normal + w G with w = 1 / sqrt(i) and G from a
    Marron-Wand mixture, one component per row."""
    _check_dims(n_dim, n_informative)
    if simulation not in MARRON_WAND:
        raise ValueError(f"simulation is not one of {sorted(MARRON_WAND)}")
    rows = _rows(spark, 2 * (n_samples // 2))
    one = F.col("row_id") >= n_samples // 2
    parts = MARRON_WAND[simulation]
    u = uniform(f"mw{seed}mix", "row_id")
    edges = np.cumsum([w for w, *_ in parts])
    mean, sd = F.lit(float(parts[-1][1])), F.lit(float(parts[-1][2]))
    for (_, m, s), edge in reversed(list(zip(parts[:-1], edges))):
        mean, sd = F.when(u < float(edge), float(m)).otherwise(mean), F.when(u < float(edge), float(s)).otherwise(sd)
    factor = _factor(n_informative, rho, band_type)
    plain = _correlated(f"mw{seed}_", n_informative, factor)
    inner = _correlated(f"mwg{seed}_", n_informative, factor)
    cols = []
    for k, (x, g) in enumerate(zip(plain, inner)):
        w = 1 / math.sqrt(k + 1)
        cols.append(F.when(one, (1 - w) * x + w * (mean + sd * g)).otherwise(x))
    return _finish(rows, cols, one, n_dim, f"mw{seed}")


def make_gaussian_mixture(spark: SparkSession, centers, covariances, n_samples: int = 100, transform="linear", noise: float | None = None,
                          noise_dims: int | None = None, class_probs=None, seed: int = 0) -> DataFrame:
    """Two views (row_id, view0, view1, label) of a latent Gaussian mixture: the latent
    point, and it rotated ("linear"), squared ("poly"), its sine ("sin"), or what a
    function of a column makes of each coordinate; noise is added to both, and noise
    dimensions appended."""
    centers = [np.atleast_1d(c) for c in centers]
    d, k = len(centers[0]), len(centers)
    probs = np.full(k, 1 / k) if class_probs is None else np.asarray(class_probs, float)
    if len(probs) != k or abs(probs.sum() - 1) > 1e-9:
        raise ValueError("class probabilities must be one per centre and sum to 1")
    rows = _rows(spark, n_samples)
    u, label = uniform(f"gm{seed}class", "row_id"), F.lit(k - 1)
    for j in range(k - 2, -1, -1):
        label = F.when(u < float(probs[: j + 1].sum()), j).otherwise(label)
    rows = rows.withColumn("label", label)
    latent = []
    draws = [_correlated(f"gm{seed}_", d, np.linalg.cholesky(np.atleast_2d(c))) for c in covariances]
    for a in range(d):
        v = draws[-1][a] + float(centers[-1][a])
        for j in range(k - 2, -1, -1):
            v = F.when(F.col("label") == j, draws[j][a] + float(centers[j][a])).otherwise(v)
        latent.append(v)
    rows = rows.withColumn("_z", F.array(*latent))
    z = [F.get("_z", F.lit(a)) for a in range(d)]
    if transform == "linear":
        q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
        second = [sum((float(q[a, b]) * z[b] for b in range(d)), F.lit(0.0)) for a in range(d)]
    elif transform == "poly":
        second = [x * x for x in z]
    elif transform == "sin":
        second = [F.sin(x) for x in z]
    elif callable(transform):
        second = [transform(x) for x in z]
    else:
        raise TypeError(f"unknown transform {transform!r}")
    if noise:
        z = [x + float(noise) * normal(f"gm{seed}n0_{a}", "row_id") for a, x in enumerate(z)]
        second = [x + float(noise) * normal(f"gm{seed}n1_{a}", "row_id") for a, x in enumerate(second)]
    extra = [[normal(f"gm{seed}x{v}_{a}", "row_id") for a in range(noise_dims or 0)] for v in (0, 1)]
    return rows.select("row_id", F.array(*z, *extra[0]).alias("view0"), F.array(*second, *extra[1]).alias("view1"), F.col("label").cast("int"))


def make_joint_factor_model(spark: SparkSession, n_views: int, n_features, n_samples: int = 100, joint_rank: int = 1,
                            noise_std: float = 1.0, m: float = 1.5, seed: int = 0) -> DataFrame:
    """Views U diag(s) W^T + noise that share the factors U: s falls linearly in rank, each
    view's W has orthonormal columns (QR of a small matrix on the driver)."""
    sizes = [n_features] * n_views if isinstance(n_features, int) else list(n_features)
    if len(sizes) != n_views or joint_rank > min(*sizes, n_samples):
        raise ValueError("one size per view, none below the rank, is needed")
    rng = np.random.default_rng(seed)
    spectrum = np.arange(1, joint_rank + 1)[::-1] * m * noise_std * max(1.0, (n_samples * max(sizes)) ** 0.25) / joint_rank
    rows = _rows(spark, n_samples)
    factors = [normal(f"jf{seed}u{r}", "row_id") / math.sqrt(n_samples) for r in range(joint_rank)]
    rows = rows.select("row_id", F.array(*factors).alias("factors"))
    views = []
    for v, p in enumerate(sizes):
        w, _ = np.linalg.qr(rng.normal(size=(p, joint_rank)))
        cols = []
        for a in range(p):
            total = float(noise_std) * normal(f"jf{seed}v{v}_{a}", "row_id")
            for r in range(joint_rank):
                total = total + float(spectrum[r] * w[a, r]) * F.get("factors", F.lit(r))
            cols.append(total)
        views.append(F.array(*cols).alias(f"view{v}"))
    return rows.select("row_id", *views, "factors")


def simulate_helix(spark: SparkSession, n_samples: int, radius_a: float = 0.0, radius_b: float = 1.0, seed: int = 0) -> DataFrame:
    """Points of a helix: p = 5 pi + 3 pi r, (p cos p, p sin p, p) / (8 pi)."""
    r = radius_a + uniform(f"hx{seed}", "row_id") * (radius_b - radius_a)
    p = F.lit(5 * math.pi) + F.lit(3 * math.pi) * r
    scale = F.lit(8 * math.pi)
    return _rows(spark, n_samples).withColumn("p", p).select(
        "row_id", "p", (F.col("p") * F.cos("p") / scale).alias("x"), (F.col("p") * F.sin("p") / scale).alias("y"), (F.col("p") / scale).alias("z")
    )


def simulate_sphere(spark: SparkSession, n_samples: int, radius: float = 1.0, seed: int = 0) -> DataFrame:
    """Uniform points of a sphere: latitude uniform on [0, 2 pi), longitude arccos(1 - 2 u)."""
    lat = uniform(f"sa{seed}", "row_id") * F.lit(2 * math.pi)
    lon = F.acos(1 - 2 * uniform(f"so{seed}", "row_id"))
    rows = _rows(spark, n_samples).select("row_id", lat.alias("latitude"), lon.alias("longitude"))
    return rows.select(
        "*", (radius * F.sin("longitude") * F.cos("latitude")).alias("x"), (radius * F.sin("longitude") * F.sin("latitude")).alias("y"),
        (radius * F.cos("longitude")).alias("z"),
    )


def simulate_multivariate_gaussian(spark: SparkSession, mean, cov, n_samples: int, seed: int = 0) -> DataFrame:
    """Rows of a Gaussian; the covariance must be symmetric and positive definite."""
    cov = np.atleast_2d(cov)
    if not np.allclose(cov, cov.T):
        raise RuntimeError("covariance must be symmetric")
    try:
        factor = np.linalg.cholesky(cov)
    except np.linalg.LinAlgError as e:
        raise RuntimeError("covariance must be positive definite") from e
    cols = [x + float(m) for x, m in zip(_correlated(f"mg{seed}_", len(cov), factor), mean)]
    return _rows(spark, n_samples).select("row_id", F.array(*cols).alias("features"))
