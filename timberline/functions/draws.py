"""Reproducible random draws from md5, equal in Spark and in standard SQL engines.

A draw depends on a salt and on key columns only, so any task can make it again after
a lost executor, and no draw depends on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _as_column(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def digest(salt: str, *keys) -> Column:
    """Hexadecimal md5 of the keys and the salt, joined by underscores."""
    return F.md5(F.concat_ws("_", *[_as_column(k).cast("string") for k in keys], F.lit(salt)))


def uniform(salt: str, *keys) -> Column:
    """A draw from [0, 1) with 32 bits."""
    return F.conv(F.substring(digest(salt, *keys), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def with_uniforms(rows: DataFrame, salt: str, key: str, numbers: list[int], rate: float | None = None) -> DataFrame:
    """rows with the draws uniform(salt, key, k) as u<k>, for each of the numbers, or with their
    poisson_count() at a rate: made in workers, where both cost a fraction of what the columns take."""
    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields, *[T.StructField(f"u{k}", T.DoubleType()) for k in numbers]])
    steps = None if rate is None else poisson_steps(rate)
    tails = [f"{k}_{salt}".encode() for k in numbers]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        try:
            from _md5 import md5
        except ImportError:
            from hashlib import md5
        for b in batches:
            keys = b.column("_key").to_pylist()
            cols = list(b.drop_columns(["_key"]).columns)
            for tail in tails:
                heads = b"".join([md5(k + tail).digest()[:4] for k in keys])
                u = np.frombuffer(heads, ">u4").astype(np.float64) / 4294967296.0
                cols.append(pa.array(u if steps is None else np.searchsorted(steps, u, "right").astype(np.float64)))
            yield pa.RecordBatch.from_arrays(cols, schema.fieldNames())

    text = F.coalesce(F.concat(F.col(key).cast("string"), F.lit("_")), F.lit(""))  # concat_ws leaves nulls out
    return rows.withColumn("_key", text.cast("binary")).mapInArrow(run, schema)


def normal(salt: str, *keys) -> Column:
    """A standard normal draw, by Box and Muller's rule from two uniform ones."""
    u = F.lit(1.0) - uniform(salt + "a", *keys)
    v = uniform(salt + "b", *keys)
    return F.sqrt(F.lit(-2.0) * F.ln(u)) * F.cos(F.lit(2 * 3.141592653589793) * v)


def content_id(*keys) -> Column:
    """A 60-bit row id from the values that identify a row: no global numbering."""
    text = F.concat_ws("|", *[_as_column(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def poisson_steps(rate: float) -> list[float]:
    """Distribution function of a Poisson count at 0, 1, ..., up to where no draw of 32 bits
    lies above."""
    import math

    out, total, k = [], 0.0, 0
    while True:
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) if rate > 0 else 1.0
        out.append(total)
        if total >= 1 - 2.0**-33 or (k > rate and out[-1] == out[-2]):
            return out
        k += 1


def poisson_count(u: Column, rate: float) -> Column:
    """Poisson quantile of a uniform draw: bootstrap multiplicities without a global
    draw, and without a greatest one."""
    out = F.lit(0)
    for step in poisson_steps(rate):
        out = out + F.when(u >= step, 1).otherwise(0)
    return out


# The same draws as SQL text, for the twins of registered queries.


def uniform_sql(salt: str, *keys: str) -> str:
    parts = ", ".join([*(f"CAST({k} AS VARCHAR)" for k in keys), f"'{salt}'"])
    return f"(CAST('0x' || substr(md5(concat_ws('_', {parts})), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


def normal_sql(salt: str, *keys: str) -> str:
    u, v = uniform_sql(salt + "a", *keys), uniform_sql(salt + "b", *keys)
    return f"(sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {u})) * cos({2 * 3.141592653589793!r}::DOUBLE * {v}))"


def poisson_sql(u: str, rate: float) -> str:
    return "(" + " + ".join(f"CASE WHEN {u} >= {step!r}::DOUBLE THEN 1 ELSE 0 END" for step in poisson_steps(rate)) + ")"
