"""Operators on the shape of trees: runs in a box, rerooting, alignment to root points, proximity, density."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .arrays import CHUNK
from .nodes import K
from .tree import closure, fiber_ends

NODE = [K, "id", "type", "x", "y", "z", "radius", "parent"]


def roi_fibers(nodes: DataFrame, low, high) -> DataFrame:
    """Runs of each fiber inside a closed box: leaf_id, pos of the first node, n_nodes, first_id, last_id.

    A run that ends at the leaf has two nodes at least; others may have one.
    """

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        f = A.Forest(key, t)
        p, ids, rows = f.xyz(), f.ids.tolist(), []
        inside = ((p >= np.array(low)) & (p <= np.array(high))).all(1).tolist()
        for leaf in fiber_ends(f):
            way, first = f.path(leaf)[::-1], None
            for pos, i in enumerate([*way, -1]):
                if i >= 0 and inside[i]:
                    first = pos if first is None else first
                elif first is not None:
                    if pos - first > 1 or i >= 0:
                        rows.append((ids[leaf], first, pos - first, ids[way[first]], ids[way[pos - 1]]))
                    first = None
        return A.table(key, dict(zip(("leaf_id", "pos", "n_nodes", "first_id", "last_id"), np.array(rows, np.int64).reshape(-1, 5).T, strict=True)))

    return A.each(nodes.select(K, "id", "parent", "x", "y", "z"), run, f"{K} bigint, leaf_id bigint, pos bigint, n_nodes bigint, first_id bigint, last_id bigint")


def non_adjacent_pairs(nodes: DataFrame, threshold: float = 5.0, steps: int = 10) -> DataFrame:
    """a < b, dist of nodes nearer than threshold that share none of their first `steps` ids upwards; neurons of three nodes or more."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        f = A.Forest(key, t)
        i, j, d = A.pairs_within(f.ids, f.xyz(), threshold if f.n > 2 else 0.0)
        # Paths of a and b end in different places beyond their roots.
        pa_, pb = (np.empty((f.n, steps), np.int64) for _ in range(2))
        at = np.arange(f.n)
        for k in range(steps):
            pa_[:, k], pb[:, k] = at, np.where(at < 0, -2, at)
            at = np.where(at < 0, -1, f.up[at]) if f.n else at
        met = np.zeros(len(i), bool)
        for k in range(steps):
            met |= np.logical_or.reduce([pa_[i, m] == pb[j, k] for m in range(steps)])
        i, j, d = i[~met], j[~met], d[~met]
        return A.table(key, {"a": f.ids[i], "b": f.ids[j], "dist": d})

    return A.each(nodes.where(f"{K} IS NOT NULL AND id IS NOT NULL").select(K, "id", "parent", "x", "y", "z"), run, f"{K} bigint, a bigint, b bigint, dist double")


def _turned(nodes: DataFrame, at: DataFrame) -> DataFrame:
    """rerooted, and place: a node's rank among its new siblings (a former parent first, then by id)."""
    up = closure(nodes, at)
    up = up.select(K, F.col("anc").alias("id"), F.col("dist").alias("hops"), F.expr(f"coalesce(lag(anc) OVER (PARTITION BY {K}, id ORDER BY dist), -1)").alias("to"))
    out = nodes.join(up, [K, "id"], "left").withColumns({"place": F.when(F.col("hops") > 0, 0).otherwise(F.col("id")).cast("long"), "parent": F.coalesce("to", "parent")})
    return out.select(*NODE, "place")


def rerooted(nodes: DataFrame, at: DataFrame) -> DataFrame:
    """Trees with at(neuron_id, id), one node a tree at most, as their roots; ids stay, edges on the way to the old root turn round."""
    return _turned(nodes, at).drop("place")


def align_roots(nodes: DataFrame, points: DataFrame, threshold: float = 20.0) -> DataFrame:
    """Trees rerooted at the nodes nearest to points(neuron_id, x, y, z), no further than threshold.

    The nearest node counts for a tree that several points reach, ties to the least
    id. Ids are dealt anew: trees by distance, those no point reaches last, and
    breadth first within a tree. Only points and nodes of neighbouring cells meet.
    """

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        f = A.Forest(key, left)
        p, q = f.xyz(), A.real(right, *"xyz") if key[0].is_valid else np.zeros((0, 3))
        some, q, ids, order = np.flatnonzero(np.isfinite(p).all(1)), q[np.isfinite(q).all(1)], f.ids.tolist(), f.order()
        root = list(range(f.n))
        for i in order:
            root[i] = root[f.up[i]] if f.up[i] >= 0 else i
        heads: dict[int, tuple[float, int]] = {}
        for i, j in A.neighbours(q, p[some], threshold):
            j = some[j]
            d = A.distance(p[j], q[i])
            near = np.flatnonzero(d <= threshold)
            near = near[np.lexsort((j[near], d[near], i[near]))]
            near = near[np.diff(i[near], prepend=-1) != 0]
            for at, x in zip(j[near].tolist(), d[near].tolist(), strict=True):
                heads[root[at]] = min(heads.get(root[at], (np.inf, at)), (x, at))
        up, place = f.up.copy(), np.array(ids, np.int64)
        for _, head in heads.values():
            way = f.path(head)
            up[way[1:]], up[head], place[way[1:]] = way[:-1], -1, 0
        below: list[list[int]] = [[] for _ in ids]
        for i in np.argsort(place, kind="stable").tolist():
            if up[i] >= 0:
                below[up[i]].append(i)
        out: list[int] = []
        for _, _, top in sorted((*heads.get(root[i], (np.inf, 0))[:1], ids[i], i) for i in order if up[i] < 0):
            tree = [top]
            for i in tree:
                tree += below[i]
            out += tree
        new = np.full(f.n + 1, -1)
        new[out] = np.arange(1, len(out) + 1)
        t = f.table.take(pa.array(out, pa.int64()))
        return pa.table({c: pa.array(new[out]) if c == "id" else pa.array(new[up[out]]) if c == "parent" else t.column(c) for c in NODE})

    return A.both(nodes.select(*NODE), points.select(K, *(F.col(c).cast("double").alias(c) for c in "xyz")), run, nodes.select(*NODE).schema)


def nearest_unrelated(p: np.ndarray, parent: np.ndarray, hops: int) -> np.ndarray:
    """Distance of each point to the nearest that is over `hops` edges away; parent: its parent's place, or -1. inf if there is none."""
    out, near = np.full(len(p), np.inf), [{i} for i in range(len(p))]
    touch: list[set[int]] = [set() for _ in p]
    for i, u in enumerate(parent.tolist()):
        if u >= 0:
            touch[i].add(u)
            touch[u].add(i)
    for _ in range(hops):
        near = [s.union(*(touch[i] for i in s)) for s in near]
    size = max(1, CHUNK // max(1, len(p)))
    for i in range(0, len(p), size):
        d = ((p[i : i + size, None] - p[None]) ** 2).sum(-1)
        for row, s in enumerate(near[i : i + size]):
            d[row, list(s)] = np.inf
        out[i : i + size] = np.sqrt(d.min(1))
    return out


def density(nodes: DataFrame, step: float = 10.0, drop: float = 0.3, hops: int = 1) -> DataFrame:
    """neuron_id, density: how near each resampled node's nearest neighbour over `hops` edges away is, from 0 (far) to 1.

    The farthest share `drop` of nodes is left out, and trees of up to 2 + hops
    nodes; 0 where no tree is larger; NaN where there are too few nodes to leave any out.
    """

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        new = A.resampled(A.Forest(key, t), step)
        f = A.Forest(key, pa.table({c: new[c] for c in ("id", "parent", *"xyz")}))
        root = np.arange(f.n)
        for i in f.order():
            root[i] = root[f.up[i]] if f.up[i] >= 0 else i
        kept = np.bincount(root, minlength=f.n)[root] > 2 + hops
        if not kept.any():
            return A.table(key, {"density": np.zeros(1)})
        at = np.where(kept, np.cumsum(kept) - 1, -1)
        up = np.where(f.up >= 0, at[f.up], -1)[kept]
        d = nearest_unrelated(f.xyz()[kept], up, hops)
        d = np.sort(d[np.isfinite(d)])
        n = int(len(d) * drop)
        return A.table(key, {"density": np.array([float(np.clip(1 - d[: len(d) - n].mean() / (step * hops * 2), 0.0, 1.0)) if n else float("nan")])})

    return A.each(nodes.select(K, "id", "parent", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "radius"))), run, f"{K} bigint, density double")
