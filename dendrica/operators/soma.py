"""Somas annotated as straight spokes around a root of type 1."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..plans.forest import written
from .nodes import K

NODE = [K, "id", "type", "x", "y", "z", "radius", "parent"]


def _through(points: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """Least ball with all (at most four) points on it."""
    if not points:
        return np.zeros(3), -1.0
    first = points[0]
    d = np.array([p - first for p in points[1:]]).reshape(-1, 3)
    off = np.linalg.lstsq(2 * d, (d**2).sum(1), rcond=None)[0] if len(d) else np.zeros(3)
    return first + off, float(off @ off)


def least_ball(points: np.ndarray, on: tuple = ()) -> tuple[np.ndarray, float]:
    """Centre and squared radius of the least ball around points, those of `on` on its rim (Welzl, 1991)."""
    center, sq = _through(list(on))
    if len(on) == 4:
        return center, sq
    for i, p in enumerate(points):
        if ((p - center) ** 2).sum() > sq * (1 + 1e-10) + 1e-12 * (sq >= 0):
            center, sq = least_ball(points[:i], (*on, p))
    return center, sq


def spokes(nodes: DataFrame, angle: float = 5.0) -> DataFrame:
    """root_id, end_id, inner ids, and the soma's x, y, z, radius, a row for each spoke of each root of type 1.

    A spoke ends at a leaf, at each child of a branch, or behind a turn of over
    `angle` degrees as seen from the root. The soma is the least ball around its
    ends; roots without a child have none.
    """

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        ids, kind, up = (t.column(c).to_pylist() for c in ("id", "type", "parent"))
        at = dict(zip(ids, np.stack([t.column(c).to_numpy().astype(float) for c in "xyz"], 1), strict=True))
        below: dict[int, list[int]] = {}
        for i, u in zip(ids, up, strict=True):
            below.setdefault(u, []).append(i)
        rows = []
        for root in (i for i, k, u in zip(ids, kind, up, strict=True) if k == 1 and u == -1):
            found = []
            for i in below.get(root, ()):
                inner, turned = [], False
                while len(kids := below.get(i, ())) == 1 and not turned:
                    u, v = at[i] - at[root], at[kids[0]] - at[i]
                    size = np.linalg.norm(u) * np.linalg.norm(v)
                    turned = size > 0 and np.degrees(np.arccos(np.clip(u @ v / size, -1, 1))) > angle
                    inner.append(i)
                    i = kids[0]
                if turned or not kids:
                    found.append((i, inner))
                else:
                    found += [(c, [*inner, i]) for c in kids]
            if found:
                center, sq = least_ball(np.array([at[e] for e, _ in found]))
                rows += [(root, e, inner, *center.tolist(), float(np.sqrt(max(sq, 0.0)))) for e, inner in found]
        cols = list(zip(*rows, strict=True)) or [()] * 7
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.float64()] * 4]
        names = ["root_id", "end_id", "inner", "x", "y", "z", "radius"]
        return pa.table({K: pa.array([key[0].as_py()] * len(rows), pa.int64())} | {n: pa.array(c, k) for n, c, k in zip(names, cols, kinds, strict=True)})

    some = nodes.where("type = 1 AND parent = -1").select(K).distinct()
    cols = (K, "id", "type", "parent", "x", "y", "z")
    return nodes.join(some, K, "left_semi").select(*cols).groupBy(K).applyInArrow(run, f"{K} bigint, root_id bigint, end_id bigint, inner array<bigint>, x double, y double, z double, radius double")


def somas(nodes: DataFrame, angle: float = 5.0) -> DataFrame:
    """neuron_id, root_id, centre, radius and number of spokes of each soma."""
    return spokes(nodes, angle).groupBy(K, "root_id", "x", "y", "z", "radius").agg(F.count("*").alias("n_spokes"))


def refine_somas(nodes: DataFrame, step: float = 2.0, angle: float = 5.0) -> DataFrame:
    """Roots of somas at their balls' centres, with straight spokes of a node every step in place of the inner nodes.

    The last whole step before an end is left out. Ends keep their ids and subtrees;
    new nodes are numbered past the neuron's largest id and take type and radius of the end.
    """
    s = written(spokes(nodes, angle))
    gone = s.select(K, F.explode("inner").alias("id")).distinct()
    centers = s.select(K, F.col("root_id").alias("id"), *(F.col(c).alias(f"c{c}") for c in "xyz")).distinct()
    ends = s.select(K, "root_id", F.col("end_id").alias("id"), *(F.col(c).alias(f"c{c}") for c in "xyz")).join(nodes.select(K, "id", "type", "x", "y", "z", "radius"), [K, "id"])
    ends = ends.withColumn("size", G.distance(G.point(), G.point("c")))
    last = F.floor(F.col("size") / step) - 1
    new = ends.withColumn("k", F.explode(F.when(last >= 1, F.sequence(F.lit(1).cast("long"), last)).otherwise(F.array().cast("array<bigint>"))))
    top = nodes.groupBy(K).agg(F.max("id").alias("top"))
    new = new.join(top, K).withColumn("new", F.expr(f"top + row_number() OVER (PARTITION BY {K} ORDER BY root_id, id, k)"))
    new = new.withColumn("up", F.expr(f"coalesce(lag(new) OVER (PARTITION BY {K}, root_id, id ORDER BY k), root_id)"))
    new = written(new.select(K, "id", "new", "up", "k", "type", "radius", *((F.col(f"c{c}") + (F.col(c) - F.col(f"c{c}")) * (F.col("k") * step / F.col("size"))).alias(c) for c in "xyz")))
    hung = ends.select(K, "id", "root_id").join(new.groupBy(K, "id").agg(F.max_by("new", "k").alias("tip")), [K, "id"], "left").select(K, "id", F.coalesce("tip", "root_id").alias("to"))
    kept = nodes.join(gone, [K, "id"], "left_anti").join(centers, [K, "id"], "left").join(hung, [K, "id"], "left")
    kept = kept.withColumns({"parent": F.coalesce("to", "parent")} | {c: F.coalesce(f"c{c}", c) for c in "xyz"})
    return kept.select(*NODE).unionByName(new.select(K, F.col("new").alias("id"), "type", "x", "y", "z", "radius", F.col("up").alias("parent")))
