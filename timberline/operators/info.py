"""Information estimates and resampling: ranks, nearest neighbours, KSG, permutations."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import uniform
from ..functions.prefix import draw_rank
from ..functions.special import digamma
from ..sources.storage import checkpointed
from .metrics import average_rank


def rank_transform(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Average ranks (ties share their mean) in place of the columns."""
    for c in columns:
        rows = average_rank(rows, c, out=f"_rank_{c}").drop(c).withColumnRenamed(f"_rank_{c}", c)
    return rows


def uniform_transform(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Empirical distribution function: share of rows with a value not above one's own."""
    from ..functions.prefix import running_sums

    for c in columns:
        run = running_sums(rows.groupBy(c).agg(F.count(F.lit(1)).cast("double").alias("n")), [], c, ["n"])
        rows = rows.join(run.select(c, (F.col("left_n") / F.col("total_n")).alias("_u")), c).drop(c).withColumnRenamed("_u", c)
    return rows


def standardize(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population standard deviation; constant columns become 0."""
    stats = rows.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    rows = rows.crossJoin(F.broadcast(stats))
    for c in columns:
        rows = rows.withColumn(c, F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0))
    return rows.drop(*[f"_{k}_{c}" for k in "ms" for c in columns])


#: Rows of a block: two blocks meet in a worker. Work within a pair of blocks goes by tiles of TILE rows.
BLOCK = 16384
TILE = 256
#: Rows of a block of rows that lie together.
NEAR_BLOCK = 4096
#: Most partitions of blocks; as many tasks as their square make the pairs.
PARTS = 32


def _block_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(x, y, p, q): all pairs of blocks of two tables (block, p), each block packed into one
    binary. Pairs of rows exist only within a task and are never rows of a table."""
    return left.select(F.col("block").alias("x"), "p").join(right.select(F.col("block").alias("y"), F.col("p").alias("q")))


def _doubles(rows: DataFrame, cols: list[str], *more) -> DataFrame:
    return rows.select(*more, F.col("row_id").cast("long").alias("row_id"), *[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(cols)])


def _packed(dealt: DataFrame, n: int, width: int) -> DataFrame:
    """(block, p, lo, hi): rows packed by blocks, ids first and then the columns as doubles, and
    the columns' ranges. Blocks are kept, since each is read many times."""

    def pack(pdf):
        import pandas as pd

        cells = np.stack([pdf[f"c{k}"].to_numpy(np.float64) for k in range(width)])
        data = np.concatenate([pdf["row_id"].to_numpy(np.int64).view(np.float64)[None], cells])
        return pd.DataFrame({
            "block": [pdf["block"].iloc[0]], "p": [np.ascontiguousarray(data).tobytes()], "lo": [cells.min(1)], "hi": [cells.max(1)],
        })

    kind = "block int, p binary, lo array<double>, hi array<double>"
    return checkpointed(dealt.repartition(min(n, PARTS), "block").groupBy("block").applyInPandas(pack, kind))


def _blocks(rows: DataFrame, columns: list[str], more: list[str] | None = None) -> DataFrame:
    """Blocks of about BLOCK rows, by the hash of their ids."""
    cols = [*columns, *(more or [])]
    n = -(-max(rows.count(), 1) // BLOCK)
    block = F.pmod(F.xxhash64("row_id"), F.lit(n)).cast("int")
    return _packed(_doubles(rows, cols, block.alias("block")), n, len(cols))


def _near_blocks(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Blocks of at most about NEAR_BLOCK rows that lie together: slabs of the first column, cut by
    the second one, at quantiles. Cells with more rows, of equal values, are dealt out by id, and rows
    that lack a value are in cells of their own. Where the cuts lie is a matter of speed only."""
    width = len(columns)
    rows = _doubles(rows, columns)
    n = -(-max(rows.count(), 1) // NEAR_BLOCK)
    slabs = math.ceil(math.sqrt(n)) if width > 1 else n
    cuts = lambda v, m: F.percentile_approx(F.when(~F.isnan(v), F.col(v)), [k / m for k in range(1, m)], 10_000)
    first = np.array(rows.agg(cuts("c0", slabs)).first()[0] or [], float) if slabs > 1 else np.zeros(0)
    many = -(-n // slabs)
    second = {}
    if many > 1:
        slab = F.aggregate(F.array(*[F.lit(float(x)) for x in first]), F.lit(0), lambda s, x: s + (x < F.col("c0")).cast("int")) if len(first) else F.lit(0)
        found = rows.groupBy(slab.alias("s")).agg(cuts("c1", many).alias("q")).collect()
        second = {r["s"]: np.array(r["q"] or [], float) for r in found}

    def cells(x: np.ndarray) -> np.ndarray:
        slab = np.searchsorted(first, x[0])
        at = slab * many
        for s, q in second.items():
            own = slab == s
            at[own] += np.searchsorted(q, x[1][own])
        lacks = np.isnan(x)
        return np.where(lacks.any(0), (len(first) + 1) * many + (lacks * 2 ** np.arange(width)[:, None]).sum(0), at)

    names = [f"c{k}" for k in range(width)]

    def counted(batches):
        import pandas as pd

        for pdf in batches:
            cell, size = np.unique(cells(pdf[names].to_numpy(np.float64).T), return_counts=True)
            yield pd.DataFrame({"cell": cell, "n": size})

    sizes = rows.mapInPandas(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").toPandas()
    cell, shares = sizes["cell"].to_numpy(np.int64), -(-sizes["n"].to_numpy(np.int64) // NEAR_BLOCK)
    start = np.cumsum(shares) - shares

    def dealt(batches):
        for pdf in batches:
            at = np.searchsorted(cell, cells(pdf[names].to_numpy(np.float64).T))
            mixed = (pdf["row_id"].to_numpy(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            yield pdf.assign(block=(start[at] + mixed.astype(np.int64) % shares[at]).astype(np.int32))

    kind = "row_id long, " + ", ".join(f"{c} double" for c in names) + ", block int"
    return _packed(rows.mapInPandas(dealt, kind), max(int(shares.sum()), 1), width)


def _unpacked(p: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(p, np.float64).reshape(width + 1, -1)
    return data[0].view(np.int64), data[1:]


def _np_gap(a: np.ndarray, b: np.ndarray, which) -> np.ndarray:
    """Largest coordinate distance between the rows of a and of b, over the columns `which`;
    coordinates that one of them lacks don't count."""
    out, most = None, np.fmax if np.isnan(a).any() or np.isnan(b).any() else np.maximum
    for k in which:
        d = np.abs(a[k][:, None] - b[k][None, :])
        out = d if out is None else most(out, d, out=out)
    return out


def _knn(i: np.ndarray, a: np.ndarray, eps: np.ndarray, j: np.ndarray, b: np.ndarray, k: int):
    """(place of the row in i, other id, distance) of the k nearest rows of (j, b) to each row of
    (i, a) that aren't beyond its eps, nearest first and ties by id."""
    order = np.argsort(j, kind="stable")  # so that ties are by id
    j, b = j[order], b[:, order]
    for lo in range(0, len(i), TILE):
        own = i[lo : lo + TILE]
        d = _np_gap(a[:, lo : lo + TILE], b, range(len(a)))
        d[(own[:, None] == j[None, :]) | np.isnan(d) | (d > eps[lo : lo + TILE, None])] = np.inf
        m = min(k, len(j))
        edge = np.partition(d, m - 1, axis=1)[:, m - 1]
        r, c = np.nonzero((d <= edge[:, None]) & (d < np.inf))
        dist = d[r, c]
        place = np.lexsort((c, dist, r))
        r, c, dist = r[place], c[place], dist[place]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        yield lo + r[rank < k], j[c[rank < k]], dist[rank < k]


def nearest(rows: DataFrame, columns: list[str], k: int) -> DataFrame:
    """(i, j, dist, rank): the k nearest other rows by largest coordinate distance, ties by id.

    Rows are blocked by place. A row's k nearest of its own block bound its distance, and it
    asks only the blocks that reach into it; so exact results need few of the pairs of blocks,
    unless values repeat very often. Only a row's k nearest of each block asked leave a worker."""
    packed = _near_blocks(rows, columns)
    width = len(columns)
    boxes = packed.select("block", "lo", "hi").orderBy("block").toPandas()
    block = boxes["block"].to_numpy(np.int32)
    low, high = (np.stack(boxes[c].to_numpy()).astype(np.float64) if len(boxes) else np.zeros((0, width)) for c in ("lo", "hi"))

    def inside(batches):
        """Answers of a row's own block (y null), and what it asks of others."""
        import pandas as pd

        for pdf in batches:
            for x, p in zip(pdf["block"], pdf["p"]):
                i, a = _unpacked(p, width)
                parts = list(_knn(i, a, np.full(len(i), np.inf), i, a, k))
                r, j, dist = (np.concatenate(v) for v in zip(*parts))
                found = np.bincount(r, minlength=len(i))
                eps = np.full(len(i), np.inf)
                last = np.cumsum(found)[found == k] - 1
                eps[found == k] = dist[last]
                answers = np.stack([i[r].view(np.float64), j.view(np.float64), dist])
                asked, packs = [None], [answers.tobytes()]
                for y, lo, hi in zip(block, low, high):
                    if y == x:
                        continue
                    gap = np.maximum(lo[:, None] - a, a - hi[:, None])
                    own = ~(np.where(np.isnan(gap), 0.0, gap).max(0) > eps)  # a lacking value bounds nothing
                    if own.any():
                        asked.append(y)
                        packs.append(np.concatenate([i[own].view(np.float64)[None], a[:, own], eps[own][None]]).tobytes())
                yield pd.DataFrame({"y": pd.array(asked, "Int32"), "q": packs})

    def unpack(batches):
        import pandas as pd

        for pdf in batches:
            for q in pdf["q"]:
                i, j, dist = np.frombuffer(q, np.float64).reshape(3, -1)
                yield pd.DataFrame({"i": i.view(np.int64), "j": j.view(np.int64), "dist": dist})

    def across(batches):
        import pandas as pd

        for pdf in batches:
            for q, p in zip(pdf["q"], pdf["p"]):
                i, a = _unpacked(q, width + 1)
                for r, j, dist in _knn(i, a[:width], a[width], *_unpacked(p, width), k):
                    yield pd.DataFrame({"i": i[r], "j": j, "dist": dist})

    first = checkpointed(packed.select("block", "p").mapInPandas(inside, "y int, q binary"))
    kind = "i long, j long, dist double"
    own = first.filter("y is null").select("q").mapInPandas(unpack, kind)
    asked = first.filter("y is not null").join(packed.select(F.col("block").alias("y"), "p"), "y").select("q", "p")
    near = own.unionByName(asked.mapInPandas(across, kind))
    w = Window.partitionBy("i").orderBy("dist", "j")
    kind = rows.schema["row_id"].dataType
    best = near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return best.select(F.col("i").cast(kind).alias("i"), F.col("j").cast(kind).alias("j"), "dist", "rank")


def ksg_counts(rows: DataFrame, x: list[str], y: list[str], z: list[str] | None = None, k: int = 3) -> DataFrame:
    """Per row the distance eps to its k-th neighbour in the joint space (the last one where
    there are fewer), and how many other rows lie strictly nearer in each subspace."""
    z = z or []
    cols = [*x, *y, *z]
    eps = nearest(rows, cols, k).groupBy("i").agg(F.max("dist").alias("eps")).withColumnRenamed("i", "row_id")
    asked = _blocks(rows.select("row_id", *cols).join(eps, "row_id"), cols, ["eps"])
    packed = _blocks(rows, cols)
    place = {c: n for n, c in enumerate(cols)}
    spaces = {"nx": x + z, "ny": y + z, **({"nz": z} if z else {})}
    width = len(cols)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for p, q in zip(pdf["p"], pdf["q"]):
                i, a = _unpacked(p, width + 1)
                j, b = _unpacked(q, width)
                for lo in range(0, len(i), TILE):
                    part = a[:, lo : lo + TILE]
                    other = i[lo : lo + TILE][:, None] != j[None, :]
                    counts = {n: ((_np_gap(part, b, [place[v] for v in c]) < part[width][:, None]) & other).sum(1) for n, c in spaces.items()}
                    yield pd.DataFrame({"row_id": i[lo : lo + TILE], "eps": part[width], **counts})

    kinds = ", ".join(f"{n} long" for n in spaces)
    found = _block_pairs(asked, packed).select("p", "q").mapInPandas(run, f"row_id long, eps double, {kinds}")
    out = found.groupBy("row_id", "eps").agg(*[F.sum(n).alias(n) for n in spaces])
    return out.withColumn("row_id", F.col("row_id").cast(rows.schema["row_id"].dataType))


def mutual_info_ksg(rows: DataFrame, x: list[str], y: list[str], z: list[str] | None = None, k: int = 3) -> DataFrame:
    """One row (mi): the Kraskov-Stoegbauer-Grassberger estimate of I(X; Y), or with z the
    conditional one of Frenzel and Pompe."""
    c = ksg_counts(rows, x, y, z, k)
    psi = lambda n: digamma(F.col(n) + 1)
    head = digamma(F.lit(float(k)))
    if z:
        return c.agg((F.first(head) + F.avg(psi("nz") - psi("nx") - psi("ny"))).alias("mi"))
    return c.agg((F.first(head) + digamma(F.count(F.lit(1))) - F.avg(psi("nx") + psi("ny"))).alias("mi"))


def conditional_resample(rows: DataFrame, columns: list[str], k: int = 5, replace: bool = True, salt: str = "resample") -> DataFrame:
    """(place, row_id, picked): for each place a row (drawn with replacement, or each row
    once), and one of its k nearest neighbours instead of it."""
    numbered = draw_rank(rows.select("row_id"), [], uniform(salt + "num", "row_id"), "row_id", "place")
    numbered = numbered.select("row_id", (F.col("place") - 1).alias("place"))
    if replace:
        n = numbered.agg(F.count(F.lit(1)).alias("n"))
        picks = numbered.select("place").crossJoin(F.broadcast(n)).select(
            "place", F.floor(uniform(salt, "place") * F.col("n")).alias("at")
        )
        chosen = picks.join(numbered.withColumnRenamed("place", "at"), "at").select("place", "row_id")
    else:
        chosen = numbered
    near = nearest(rows, columns, k)
    want = chosen.withColumn("rank", (F.floor(uniform(salt + "k", "place") * k) + 1).cast("int"))
    return want.join(near.withColumnRenamed("i", "row_id"), ["row_id", "rank"]).select("place", "row_id", F.col("j").alias("picked"))


def restricted_permutation(neighbors: DataFrame, seed: int = 0) -> DataFrame:
    """(row_id, picked): rows are visited in random order and take their nearest neighbour
    that is not taken yet, or the last one tried if all are. The order makes this a
    sequential rule, so one stratum (column group, 0 if absent) is one task."""
    import pandas as pd

    if "group" not in neighbors.columns:
        neighbors = neighbors.withColumn("group", F.lit(0))

    def visit(pdf: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((pdf["rank"], pdf["i"]))
        own, near = pdf["i"].to_numpy()[order], pdf["j"].to_numpy()[order].tolist()
        ids, start = np.unique(own, return_index=True)
        stop = np.append(start[1:], len(own))
        turn = np.arange(len(ids))
        np.random.default_rng([seed, len(ids)]).shuffle(turn)
        used: set = set()
        picked = []
        for lo, hi in zip(start[turn].tolist(), stop[turn].tolist()):
            pick = next((j for j in near[lo:hi] if j not in used), near[hi - 1])
            used.add(pick)
            picked.append(pick)
        return pd.DataFrame({"row_id": ids[turn], "picked": picked})

    return neighbors.select("group", "i", "j", "rank").groupBy("group").applyInPandas(visit, "row_id long, picked long")


def grid_mutual_information(spark, means, covs, weights, span: float = 10.0, cells: int = 200) -> DataFrame:
    """One row (mi): H(X) - H(X | Y) of a Gaussian mixture with Y its component, H(X) by a
    Riemann sum over a grid on [-span, span]^d, H(X | Y) in closed form."""
    from ..functions.special import entropy_gaussian

    d = len(means[0])
    step = 2 * span / cells
    grid = spark.range(cells**d)
    coords = []
    rest = F.col("id")
    for _ in range(d):
        coords.append(-span + (F.pmod(rest, F.lit(cells)) + 0.5) * step)
        rest = F.floor(rest / cells)
    density = F.lit(0.0)
    for m, c, w in zip(means, covs, weights):
        density = density + float(w) * gaussian_density(coords, m, c)
    grid = grid.select(density.alias("f"))
    h = F.sum(F.when(F.col("f") > 0, -F.col("f") * F.ln("f")).otherwise(0.0)) * float(step**d)
    given = float(sum(w * entropy_gaussian(c) for w, c in zip(weights, covs)))
    return grid.agg((h - given).alias("mi"))


def gaussian_density(coords: list, mean, cov):
    """Density of a Gaussian as an expression of coordinate columns."""
    inv, d = np.linalg.inv(np.atleast_2d(cov)), len(mean)
    norm = float(1 / np.sqrt((2 * np.pi) ** d * np.linalg.det(np.atleast_2d(cov))))
    q = F.lit(0.0)
    for a in range(d):
        for b in range(d):
            if inv[a, b]:
                q = q + float(inv[a, b]) * (coords[a] - float(mean[a])) * (coords[b] - float(mean[b]))
    return norm * F.exp(-0.5 * q)


def sampled_mutual_information(rows: DataFrame, columns: list[str], means, covs, weights) -> DataFrame:
    """One row (mi): H(Y) - E H(Y | X) by Bayes posteriors at the rows of a sample."""
    coords = [F.col(c) for c in columns]
    dens = [float(w) * gaussian_density(coords, m, c) for m, c, w in zip(means, covs, weights)]
    total = dens[0]
    for x in dens[1:]:
        total = total + x
    h = F.lit(0.0)
    for x in dens:
        p = x / total
        h = h + F.when(p > 0, -p * F.ln(p)).otherwise(0.0)
    hy = float(-sum(w * np.log(w) for w in weights))
    return rows.agg((F.lit(hy) - F.avg(h)).alias("mi"))
