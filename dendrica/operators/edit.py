"""Orders of nodes, nearest nodes, subtrees, adding and removing trees, bounds and graph components."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..plans.forest import written
from . import arrays as A
from .nodes import K, edges, roots
from .tree import rooted

NODE = [K, "id", "type", "x", "y", "z", "radius", "parent"]


def _ordered(nodes: DataFrame, sign: int) -> DataFrame:
    """neuron_id, id, place from 1: each node before its subtree, siblings and roots by sign * id."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        f = A.Forest(key, t)
        below, out, todo = f.below(), [], np.flatnonzero(f.up < 0).tolist()[::-sign]
        while todo:
            out.append(i := todo.pop())
            todo += below[i][::-sign]
        return A.table(key, {"id": f.ids[out], "place": np.arange(1, len(out) + 1)})

    return A.each(nodes.select(K, "id", "parent"), run, f"{K} bigint, id bigint, place bigint")


def preorder(nodes: DataFrame) -> DataFrame:
    """Places with the first root and the first child first."""
    return _ordered(nodes, 1)


def node_list(nodes: DataFrame) -> DataFrame:
    """Places with the last root and the last child first."""
    return _ordered(nodes, -1)


def nearest_nodes(nodes: DataFrame, points: DataFrame, k: int = 1, start: float = 16.0) -> DataFrame:
    """neuron_id, point, id, rank, dist: the k nearest nodes of its neuron (all, if fewer) of each of points(neuron_id, point, x, y, z), ties to the least id.

    In each neuron, points meet nodes of neighbouring cells only; those that find too few
    within a cell's width go on with cells twice as wide. Points of absent neurons have no rows.
    """
    kind = points.schema["point"].dataType.simpleString()

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        ids, p, q = A.whole(left, "id"), A.real(left, *"xyz"), A.real(right, *"xyz")
        ok = np.flatnonzero(np.isfinite(p).all(1))
        todo, width, rows = np.flatnonzero(np.isfinite(q).all(1)), start, [(ok[:0], ok[:0], ok[:0], np.zeros(0))]
        want = min(k, len(ok)) if key[0].is_valid else 0
        while len(todo) and want:
            found, whole = np.zeros(len(todo), bool), len(todo) * len(ok) <= 1 << 14
            for i, j in A.neighbours(q[todo], p[ok], width):
                j = ok[j]
                d = A.distance(p[j], q[todo[i]])
                near = np.flatnonzero((d <= width) | whole)
                near = near[np.lexsort((ids[j[near]], d[near], i[near]))]
                i, j, d = i[near], j[near], d[near]
                first = np.flatnonzero(np.diff(i, prepend=-1))
                n = np.diff(first, append=len(i))
                rank = np.arange(len(i)) - np.repeat(first, n)
                found[i[first[n >= want]]] = True
                some = found[i] & (rank < want)
                rows.append((todo[i[some]], j[some], rank[some], d[some]))
            todo, width = todo[~found], width * 2
        point, at, rank, d = (np.concatenate(x) for x in zip(*rows, strict=True))
        return A.table(key, {"point": right.column("point").take(pa.array(point)), "id": ids[at], "rank": (rank + 1).astype(np.int32), "dist": d})

    cols = (F.col(c).cast("double").alias(c) for c in "xyz")
    return A.both(nodes.select(K, "id", *(F.col(c).cast("double").alias(c) for c in "xyz")), points.select(K, "point", *cols), run, f"{K} bigint, point {kind}, id bigint, rank int, dist double")


def in_ball(nodes: DataFrame, center: tuple[float, float, float], radius: float, inner: float | None = None) -> DataFrame:
    """Nodes in a closed ball; with `inner`, outside of the closed ball of that radius in it."""
    d = G.distance(G.point(), tuple(F.lit(float(c)) for c in center))
    return nodes.where(d <= radius) if inner is None else nodes.where((d <= radius) & (d > inner))


def without_isolated(nodes: DataFrame) -> DataFrame:
    """Nodes that an edge touches."""
    e = edges(nodes).select(K, "id", "parent")
    ends = e.select(K, "id").unionByName(e.select(K, F.col("parent").alias("id")))
    return nodes.join(ends, [K, "id"], "left_semi")


def valid_edges(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """links(neuron_id, a, b) whose ends are both nodes."""
    ids = nodes.select(K, "id")
    return links.join(ids.withColumnRenamed("id", "a"), [K, "a"], "left_semi").join(ids.withColumnRenamed("id", "b"), [K, "b"], "left_semi")


def _below(nodes: DataFrame, tops: DataFrame, keep: Callable[[A.Forest], np.ndarray] | None = None) -> DataFrame:
    """subtree, of the nodes that keep has. A top's own subtree only is walked."""

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        f = A.Forest(key, left)
        below, kept, rows = f.below(), None if keep is None else keep(f).tolist(), []
        for top in f.find(A.whole(right, "id")).tolist() if key[0].is_valid else ():
            todo = [(top, 0)] if top >= 0 else []
            for i, d in todo:
                todo += [(c, d + 1) for c in below[i]]
                if len(todo) > f.n:
                    raise ValueError("cycle of parents")
            rows += [(top, i, d) for i, d in todo if kept is None or kept[i]]
        top, at, d = np.array(rows, np.int64).reshape(-1, 3).T
        return A.table(key, {"top": f.ids[top], "id": f.ids[at], "dist": d})

    return A.both(nodes.select(K, "id", "parent"), tops.select(K, "id"), run, f"{K} bigint, top bigint, id bigint, dist bigint")


def subtree(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """neuron_id, top, id, dist: nodes at or below tops(neuron_id, id)."""
    return _below(nodes, tops)


def subtree_leaves(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """neuron_id, top, id: childless nodes, roots apart, at or below each top."""
    return _below(nodes, tops, lambda f: f.childless() & ~f.root & (f.parent != A.NONE)).select(K, "top", "id")


def remove_subtrees(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """Without the nodes at or below tops(neuron_id, id)."""

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        f = A.Forest(key, left)
        below, gone = f.below(), np.zeros(f.n, bool)
        todo = [i for i in set(f.find(A.whole(right, "id")).tolist()) if i >= 0 and key[0].is_valid]
        while todo:
            if not gone[i := todo.pop()]:
                gone[i] = True
                todo += below[i]
        return f.table.filter(pa.array(~gone))

    return A.both(nodes, tops.select(K, "id"), run, nodes.schema)


def remove_trees(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """Without the trees whose roots are tops(neuron_id, id)."""
    gone = rooted(nodes).join(tops.select(K, F.col("id").alias("root_id")), [K, "root_id"], "left_semi")
    return nodes.join(gone, [K, "id"], "left_anti")


def add_nodes(nodes: DataFrame, more: DataFrame) -> DataFrame:
    """Both, with the parents that each has; an id that both have is an error."""
    both = nodes.select(*NODE).unionByName(more.select(*NODE))
    twice = both.groupBy(K, "id").agg(F.count("*").alias("n"), F.max(F.struct(*NODE)).alias("row"))
    id_ = F.when(F.col("n") == 1, F.col("id")).otherwise(F.raise_error(F.concat(F.lit("repeated id: "), F.col("id").cast("string"))).cast("bigint"))
    return twice.select(K, id_.alias("id"), *(F.col("row").getField(c).alias(c) for c in NODE[2:]))


def append_nodes(nodes: DataFrame, more: DataFrame) -> DataFrame:
    """nodes and more(neuron_id, type, x, y, z, radius, parent), which take the next ids of their neuron, by parent and place."""
    top = nodes.groupBy(K).agg(F.max("id").alias("top"))
    new = more.join(top, K, "left").withColumn("id", F.coalesce("top", F.lit(0)) + F.expr(f"row_number() OVER (PARTITION BY {K} ORDER BY parent, x, y, z, type, radius)"))
    return nodes.select(*NODE).unionByName(new.select(*NODE))


def unmatched(ids: DataFrame, matched: DataFrame, *key: str) -> DataFrame:
    """ids that matched has not."""
    return ids.join(matched, list(key), "left_anti")


def bounds(nodes: DataFrame) -> DataFrame:
    """Box of each neuron's spheres."""
    each = [f(F.col(c) + s * F.col("radius")).alias(f"{n}_{c}") for n, f, s in (("min", F.min, -1), ("max", F.max, 1)) for c in "xyz"]
    return nodes.groupBy(K).agg(*each)


def scale_ratio(lengths: tuple[float, float, float]) -> Column:
    """Least ratio of `lengths` to the extent of bounds(), over the axes with one."""
    return F.least(*(F.lit(float(n)) / F.nullif(F.col(f"max_{c}") - F.col(f"min_{c}"), F.lit(0.0)) for c, n in zip("xyz", lengths, strict=True)))


def in_ellipsoid(voxels: DataFrame, center: tuple[float, float, float], radii: tuple[float, float, float]) -> DataFrame:
    """voxels(z, y, x) in an ellipsoid; radii under 1 count as 1."""
    return voxels.where(" + ".join(f"pow(({c} - {float(m)}D) / {max(float(r), 1.0)}D, 2)" for c, m, r in zip("zyx", center, radii, strict=True)) + " <= 1")


def graph_components(links: DataFrame, vertices: DataFrame) -> DataFrame:
    """neuron_id, id, component (its least id) of vertices(neuron_id, id) under undirected links(neuron_id, a, b): least labels of neighbours, and their labels' labels."""
    both = written(links.select(K, "a", "b").unionByName(links.select(K, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = written(vertices.select(K, "id", F.col("id").alias("label")))
    while True:
        near = both.join(state.select(K, F.col("id").alias("b"), "label"), [K, "b"]).groupBy(K, F.col("a").alias("id")).agg(F.min("label").alias("least"))
        low = written(state.join(near, [K, "id"], "left").select(K, "id", "label", F.least("label", "least").alias("new")))
        up = low.select(K, F.col("id").alias("new"), F.col("new").alias("far"))
        now = written(low.join(up, [K, "new"], "left").select(K, "id", "label", F.least("new", "far").alias("to")))
        if now.where("to <> label").isEmpty():
            return now.select(K, "id", F.col("to").alias("component"))
        state = now.select(K, "id", F.col("to").alias("label"))


def tree_roots(nodes: DataFrame, every: int) -> DataFrame:
    """Roots whose id is divisible by `every`."""
    return roots(nodes).where(F.col("id") % every == 0).select(K, "id")
