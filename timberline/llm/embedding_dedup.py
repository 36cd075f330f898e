"""Embedding near-dedup: exact threshold pairs by dual traversal of cover trees."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import components, materialize

#: Least cosine of a link.
COSINE = 0.93
#: Rows of a block, about; a label of more rows is dealt to cells around pivots.
BLOCK_ROWS = 4096
#: Most pivots of a label.
MAX_PIVOTS = 256
#: Nodes of a cover tree with so few rows are leaves.
LEAF_ROWS = 48

#: Cells or pairs of rows that are looked at at once.
STEP = 1 << 15

_SLACK = 1e-9
#: Nodes this much nearer than the threshold link whole, whatever rounding does.
_SURE = 1e-6
_CHUNKS = 1 << 32  # numbers (cell, chunk) pairs

TASK_SCHEMA = "id long, n_links long, other long"


class CoverTree:
    """Nested levels with halving radii over unit vectors.

    A node is a centre, a radius that covers its rows, and its rows. The children of a
    node are a net of its rows at half its radius: a row becomes a new centre unless
    one is that near, and every row goes to its nearest centre. Nodes of few rows, or
    of no extent, are leaves. Nodes are kept by level, rows as ranges of one order.
    """

    def __init__(self, x: np.ndarray):
        self.x = x
        n = len(x)
        self.order = np.arange(n)
        self.centre, self.radius, self.lo, self.hi, self.kids = [], [], [], [], []
        if n:
            self._grow()

    def _node(self, centre: int, radius: float, lo: int, hi: int) -> int:
        self.centre.append(centre)
        self.radius.append(radius)
        self.lo.append(lo)
        self.hi.append(hi)
        self.kids.append(())
        return len(self.centre) - 1

    def _grow(self) -> None:
        x, order = self.x, self.order
        far = _distance(x, x[:1])[:, 0]
        todo = [(self._node(0, float(far.max()), 0, len(x)), float(far.max()))]
        while todo:
            node, scale = todo.pop()
            lo, hi = self.lo[node], self.hi[node]
            if hi - lo <= LEAF_ROWS or self.radius[node] <= 0:
                continue
            rows = order[lo:hi].copy()
            scale /= 2
            near = np.full(len(rows), np.inf)
            owner = np.zeros(len(rows), np.int64)
            centres: list[int] = []
            own = x[rows]
            at = 0
            while True:
                c = len(centres)
                centres.append(at)
                d = _distance(own, own[at : at + 1])[:, 0]
                closer = d < near
                near[closer], owner[closer] = d[closer], c
                at = int(near.argmax())
                if near[at] <= scale or len(centres) >= len(rows):
                    break
            perm = np.argsort(owner, kind="stable")
            order[lo:hi] = rows[perm]
            ends = np.searchsorted(owner[perm], np.arange(len(centres) + 1))
            radii = np.maximum.reduceat(near[perm], ends[:-1])
            kids = []
            for c, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
                kid = self._node(int(rows[centres[c]]), float(radii[c]), lo + int(a), lo + int(b))
                kids.append(kid)
                todo.append((kid, scale))
            self.kids[node] = tuple(kids)

    def frozen(self) -> None:
        self.c_row = np.array(self.centre, np.int64)
        self.c = self.x[self.c_row]
        self.r = np.array(self.radius)
        self.lo_, self.hi_ = np.array(self.lo), np.array(self.hi)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit vectors, never below the true ones by more than rounding."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0) + 1e-14)


def dual_pairs(a: CoverTree, b: CoverTree, cosine: float, same: bool):
    """What a traversal of two trees (or of one with itself: `same`) leaves to compare.

    Yields (rows of a, rows of b, kind): "rows" are compared row by row, "all" every row of
    one with every row of the other, "own" all pairs within one leaf; "linked" are linked
    whole, every row of one to every row of the other, and "group" all rows of one node
    to each other. A pair of nodes is dropped if its centres lie farther apart than both
    radii and the threshold's distance together, and linked whole if even the farthest
    rows that they may hold are nearer than that distance.
    """
    if not len(a.x) or not len(b.x):
        return
    a.frozen()
    b.frozen()
    reach = np.sqrt(2 - 2 * cosine) + _SLACK
    sure = reach - _SURE
    if same and 2 * a.r[0] <= sure:
        if len(a.x) > 1:
            yield a.order, a.order, "group"
        return
    todo = [(np.array([0]), np.array([0]))]
    while todo:
        p, q = todo.pop()
        if len(p) > 1024:
            todo.append((p[1024:], q[1024:]))
            p, q = p[:1024], q[:1024]
        for n, m in zip(p.tolist(), q.tolist()):
            left, right = a.kids[n], b.kids[m]
            if not left and not right:
                yield a.order[a.lo[n] : a.hi[n]], b.order[b.lo[m] : b.hi[m]], "own" if same and n == m else "all"
                continue
            left, right = np.array(left or (n,)), np.array(right or (m,))
            step = max(1, STEP // len(right))
            for k in range(0, len(left), step):
                part = left[k : k + step]
                apart = _distance(a.c[part], b.c[right])
                radii = a.r[part][:, None] + b.r[right][None, :]
                near = apart <= radii + reach
                if same and n == m:
                    near &= part[:, None] <= right[None, :]
                x, y = np.nonzero(near)
                i, j = part[x], right[y]
                whole = (apart + radii)[x, y] <= sure
                one = same & (i == j)
                whole[one] = (2 * a.r[i[one]] <= sure) & (a.hi_[i[one]] - a.lo_[i[one]] > 1)
                single = (a.hi_[i] - a.lo_[i] == 1) & (b.hi_[j] - b.lo_[j] == 1) & ~one
                whole &= ~single
                for u, v in zip(i[whole].tolist(), j[whole].tolist()):
                    yield a.order[a.lo[u] : a.hi[u]], b.order[b.lo[v] : b.hi[v]], "group" if same and u == v else "linked"
                if single.any():  # their centres are all there is to compare
                    yield a.c_row[i[single]], b.c_row[j[single]], "rows"
                rest = ~(whole | single)
                if rest.any():
                    todo.append((i[rest], j[rest]))


def threshold_links(x: np.ndarray, y: np.ndarray | None, cosine: float):
    """All pairs of rows of x and y (of x alone if y is None) with cosine of at least the
    threshold, in double precision. Yields (i, j, kind): "rows" are single pairs, "linked"
    and "group" as in dual_pairs."""
    tree = CoverTree(x)
    other = tree if y is None else CoverTree(y)
    target = x if y is None else y
    for i, j, kind in dual_pairs(tree, other, cosine, y is None):
        if kind in ("linked", "group"):
            yield i, j, kind
            continue
        if kind == "rows":
            for k in range(0, len(i), STEP):
                u, v = i[k : k + STEP], j[k : k + STEP]
                ok = np.einsum("ij,ij->i", x[u], target[v]) >= cosine
                if ok.any():
                    yield u[ok], v[ok], "rows"
            continue
        step = max(1, STEP // max(len(j), 1))
        for k in range(0, len(i), step):
            hit = x[i[k : k + step]] @ target[j].T >= cosine
            s, t = np.nonzero(np.triu(hit, k + 1) if kind == "own" else hit)
            if len(s):
                yield i[k : k + step][s], j[t], "rows"


def threshold_pairs(x: np.ndarray, y: np.ndarray | None, cosine: float):
    """The same, as index arrays (i, j) of single pairs only (i < j if y is None)."""
    for i, j, kind in threshold_links(x, y, cosine):
        if kind == "linked":
            i, j = np.repeat(i, len(j)), np.tile(j, len(i))
        elif kind == "group":
            s, t = np.triu_indices(len(i), 1)
            i, j = i[s], i[t]
        yield (i, j) if y is not None else (np.minimum(i, j), np.maximum(i, j))


def _joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Component labels after the links i - j: a label is the least row of its component."""
    while True:
        a, b = root[i], root[j]
        if (a == b).all():
            return root
        low = np.minimum(a, b)
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while True:
            hop = new[new]
            if (hop == new).all():
                break
            new = hop
        root = new


def _task(table: pa.Table, cosine: float) -> pa.Table:
    """One block of a label against itself or against another: links per row, weighted
    by copies, and each linked row's smallest fellow of the block as an edge."""
    ids = np.asarray(table["id"])
    copies = np.asarray(table["copies"])
    side = np.asarray(table["side"])
    flat = np.asarray(pa.chunked_array(table["unit"]).combine_chunks().flatten(), dtype=np.float64)
    x = flat.reshape(len(ids), -1) if len(ids) else np.zeros((0, 1))
    links = np.zeros(len(ids), np.int64)
    root = np.arange(len(ids))
    home, guest = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if len(guest):
        found = ((home[i], guest[j], k) for i, j, k in threshold_links(x[home], x[guest], cosine))
    elif np.asarray(table["cross"])[0]:
        found = ()
    else:
        found = ((home[i], home[j], k) for i, j, k in threshold_links(x[home], None, cosine))
    for i, j, kind in found:  # links are counted and joined as they come, not kept
        if kind == "rows":
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            root = _joined(root, i, j)
            continue
        if kind == "group":
            links[i] += copies[i].sum() - copies[i]
        else:
            links[i] += copies[j].sum()
            links[j] += copies[i].sum()
        both = np.concatenate([i, j])
        root = _joined(root, both, np.full(len(both), i[0]))
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, root, ids)
    on = links > 0
    return pa.table({"id": ids[on], "n_links": links[on], "other": least[root][on]})


def _unit_batches(batches):
    """Unit vectors in double precision; no row for vectors that link with nothing."""
    for b in batches:
        ids, labels, units, raw = [], [], [], []
        for i, label, v in zip(b.column("id").to_pylist(), b.column("label").to_pylist(), b.column("vector")):
            if label is None or i is None or not v.is_valid:
                continue
            if v.values.null_count or not len(v.values):
                continue
            x = np.asarray(v.values, dtype=np.float64)
            if not np.isfinite(x).all() or not x.any():
                continue
            x = x / np.abs(x).max()
            x = x / np.sqrt(x @ x)
            ids.append(i)
            labels.append(label)
            units.append(x)
            raw.append(x.tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(units, pa.list_(pa.float64())),
             pa.array(raw, pa.binary()), pa.array([len(u) for u in units], pa.int32())],
            ["id", "label", "unit", "raw", "width"],
        )


def _cells(reps: DataFrame, block_rows: int, max_pivots: int) -> DataFrame:
    """Deals each label's rows to cells around pivots, cells to chunks of about
    `block_rows`. Pivots are the rows of smallest digest: one per half block, at most
    `max_pivots`. Returns (group, id, copies, unit, cell, chunk, chunks, far)."""
    from pyspark.sql import Window

    sizes = reps.groupBy("group").agg(F.count(F.lit(1)).alias("rows"))
    wanted = sizes.select("group", F.least(F.ceil(F.col("rows") / (block_rows // 2)), F.lit(max_pivots)).alias("pivots"))
    # candidates by a digest threshold first, so that no label is sorted whole
    keyed = reps.join(sizes, "group").select("group", "id", "unit", "rows", F.abs(F.xxhash64("id") % 1_000_003).alias("h"))
    share = F.least(F.lit(1.0), 8.0 * (max_pivots + 8) / F.col("rows"))
    w = Window.partitionBy("group").orderBy("h", "id")
    parts = F.ceil(F.col("rows") / block_rows).cast("int")
    pivots = (
        keyed.filter(F.col("h") <= share * 1_000_003).withColumn("cell", F.row_number().over(w)).join(wanted, "group")
        .filter("cell <= pivots").select("group", "cell", F.col("unit").alias("at"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    )
    dealt = reps.join(sizes, "group").withColumn("part", F.pmod(F.xxhash64("id", F.lit(3)), parts).cast("int")).drop("rows")
    # the pivots come once to every part of a label, not with every row
    pivots = materialize(pivots, "pivots")
    return dealt.groupBy("group", "part").cogroup(pivots.groupBy("group", "part")).applyInArrow(
        _deal, "group string, id long, copies long, unit array<double>, cell int, far double, reach array<double>"
    )


def _deal(rows: pa.Table, pivots: pa.Table) -> pa.Table:
    """Each row's nearest pivot, and its distances to all of them."""
    matrix = lambda c: np.asarray(c.combine_chunks().flatten()).reshape(len(c), -1)
    cells, fars, reaches = np.zeros(0, np.int32), np.zeros(0), []
    if len(rows):
        net = matrix(pivots.sort_by("cell")["at"])
        d = _distance(matrix(rows["unit"]), net)
        cells = d.argmin(1).astype(np.int32)
        fars, reaches = d.min(1), list(d)
    return pa.table({
        "group": rows["group"], "id": rows["id"], "copies": rows["copies"], "unit": rows["unit"], "cell": pa.array(cells, pa.int32()),
        "far": pa.array(fars, pa.float64()), "reach": pa.array(reaches, pa.list_(pa.float64())),
    })


def _tasks(dealt: DataFrame, cosine: float, block_rows: int) -> DataFrame:
    """Rows by task. A row meets the chunks of its own cell, once each, and those of
    every later cell whose covering radius and the threshold's distance reach it: by the
    triangle inequality no other cell holds a partner."""
    reach = float(np.sqrt(2 - 2 * cosine) + _SLACK)
    info = dealt.groupBy("group", "cell").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("rows"))
    info = info.withColumn("chunks", F.ceil(F.col("rows") / block_rows).cast("int"))
    nets = info.groupBy("group").agg(F.collect_list(F.struct("cell", "radius", "chunks")).alias("cells"))
    rows = dealt.join(nets, "group")
    here = F.filter("cells", lambda c: c["cell"] == F.col("cell"))[0]["chunks"]
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(2)), here).cast("int")).withColumn("chunks", here)
    task = lambda cell, a, b, cross, side: F.struct(
        cell.cast("int").alias("cell"), a.cast("long").alias("a"), b.cast("long").alias("b"), cross.alias("cross"), side.alias("side")
    )
    own = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1),
        lambda k: task(
            F.col("cell"), F.least(k, F.col("chunk")), F.greatest(k, F.col("chunk")), k != F.col("chunk"),
            F.when(k < F.col("chunk"), 1).otherwise(0),
        ),
    )
    near = F.filter("cells", lambda c: (c["cell"] > F.col("cell")) & (F.get("reach", c["cell"]) <= c["radius"] + reach))
    this = F.col("cell").cast("long") * _CHUNKS + F.col("chunk")
    columns = ["group", "t.cell", "t.a", "t.b", "t.cross", "t.side", "id", "copies", "unit"]
    inner = rows.select("group", "id", "copies", "unit", F.explode(own).alias("t")).select(*columns)
    visits = rows.select("group", "id", "copies", "unit", F.explode(near).alias("c"), (-this - 1).alias("b"))
    guests = visits.select(
        "group", F.col("c.cell").alias("cell"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("c.chunks").cast("long") - 1)).alias("a"), "b",
        F.lit(True).alias("cross"), F.lit(1).alias("side"), "id", "copies", "unit",
    )
    # a cell's own rows go to the tasks that guests come to, and to no others
    hosts = visits.select("group", F.col("c.cell").alias("cell"), "b").distinct()
    homes = rows.select("group", "cell", F.col("chunk").cast("long").alias("a"), "id", "copies", "unit").join(hosts, ["group", "cell"]).select(
        "group", "cell", "a", "b", F.lit(True).alias("cross"), F.lit(0).alias("side"), "id", "copies", "unit"
    )
    return inner.unionByName(guests).unionByName(homes)


def near_vectors(
    vectors: DataFrame,
    cosine: float = COSINE,
    block_rows: int = BLOCK_ROWS,
    max_pivots: int = MAX_PIVOTS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """Links of vectors of one label by cosine of at least `cosine`, in double precision.

    Equal vectors of a label are one class. A label's classes are dealt to cells around
    pivots (the top level); a pair of cells, or a row and a cell, is left out where the
    covering radius can't bridge the distance. Within a task cover trees of the blocks
    are traversed together, dropping pairs of nodes by the same bound, and what remains
    is compared exactly. Tasks give sums of links and one edge per linked row.

    Returns per row: id, n_links (other rows linked directly), component_id (smallest id
    reachable), kept (id = component_id). Null or zero vectors, and those with null or
    non-finite parts, link with nothing, as do rows of null label or id, and vectors of
    another length. Ids are taken to be unique: rows that repeat an id count as copies
    of it. An empty table gives no rows; other columns are ignored.
    """
    base = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("vector")
    )
    units = materialize(
        base.mapInArrow(_unit_batches, "id long, label string, unit array<double>, raw binary, width int")
        .withColumn("group", F.concat_ws(":", F.col("width").cast("string"), "label"))
        .withColumn("d1", F.xxhash64("group", "raw")).withColumn("d2", F.xxhash64("group", "raw", F.lit(1)))
        .drop("raw", "label"),
        "units",
    )
    classes = units.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes, "classes")
    names = classes.select(F.col("rep").alias("id"), "d1", "d2", "copies")
    reps = materialize(units.join(names, ["id", "d1", "d2"]).dropDuplicates(["id", "d1", "d2"]).select("group", "id", "copies", "unit"), "reps")
    dealt = materialize(_cells(reps, block_rows, max_pivots), "cells")
    tasks = _tasks(dealt, cosine, block_rows)
    found = tasks.groupBy("group", "cell", "a", "b").applyInArrow(lambda t: _task(t, cosine), TASK_SCHEMA)
    found = materialize(found, "links")
    comps = components(found.select(F.col("id").alias("u"), F.col("other").alias("v")))
    per_class = (
        classes.join(found.groupBy(F.col("id").alias("rep")).agg(F.sum("n_links").alias("links")), "rep", "left")
        .join(comps.withColumnRenamed("id", "rep"), "rep", "left")
        .select("d1", "d2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                F.coalesce("component_id", "rep").alias("component_id"))
    )
    linked = units.select("id", "d1", "d2").join(per_class, ["d1", "d2"]).select("id", "n_links", "component_id")
    linked = linked.groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = base.select("id").join(linked, "id", "left").select(
        "id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))).withColumnRenamed("id", id_col)
