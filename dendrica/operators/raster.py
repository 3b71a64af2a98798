"""Forests as sparse voxels (z, y, x): only those set are rows. Nodes are dealt by neuron; a neuron's voxels are made and told apart in its task."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .nodes import K


def _inside(df: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    return df.where(" AND ".join(f"{c} >= 0 AND {c} < {n}" for c, n in zip("zyx", shape, strict=True)))


#: Codes of voxels in `shape`, ascending and once each.
Marks = Iterable[np.ndarray]


def _voxels(nodes: DataFrame, shape: tuple[int, int, int], marks: Callable[[A.Forest], Marks]) -> DataFrame:
    """The voxels that marks gives of each neuron, once each."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        found = np.zeros(0, np.int64)
        for code in marks(A.Forest(key, t)):
            found = _union(found, code)
        z, rest = np.divmod(found, shape[1] * shape[2])
        y, x = np.divmod(rest, shape[2])
        return A.table(key, {"z": z.astype(np.int32), "y": y.astype(np.int32), "x": x.astype(np.int32)})

    return A.each(nodes.select(K, "id", "parent", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "radius"))), run, f"{K} bigint, z int, y int, x int")


def _union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    both = np.sort(np.concatenate([a, b]))
    return both[np.diff(both, prepend=-1) != 0]


def _code(shape: tuple[int, int, int], z: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (z.astype(np.int64) * shape[1] + y.astype(np.int64)) * shape[2] + x.astype(np.int64)


def _blocks(work: np.ndarray) -> Iterable[slice]:
    """Stretches of about CHUNK of work, of one item at least."""
    total, start = np.cumsum(work), 0
    while start < len(work):
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + A.CHUNK, "right")))
        yield slice(start, stop)
        start = stop


def _edges(f: A.Forest) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower and upper place, and length, of edges with finite ends."""
    p = f.xyz()
    low = np.flatnonzero((f.up >= 0) & np.isfinite(f.sizes(p)))
    return low, f.up[low], A.distance(p[low], p[f.up[low]])


def line_voxels(nodes: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """Voxels on edges, sampled at int(length) + 2 points rounded half to even."""

    def marks(f: A.Forest) -> Marks:
        p, (low, high, size) = f.xyz()[:, ::-1], _edges(f)
        n = np.floor(size).astype(np.int64) + 1
        for s in _blocks(n + 1):
            e, k = A.spread(n[s] + 1)
            a, b, share = p[low[s]][e], p[high[s]][e], k / n[s][e]
            v = [np.rint(a[:, c] + (b[:, c] - a[:, c]) * share) for c in range(3)]
            ok = np.logical_and.reduce([(c >= 0) & (c < m) for c, m in zip(v, shape, strict=True)])
            yield _code(shape, *(c[ok] for c in v))

    return _voxels(nodes, shape, marks)


def dilate(voxels: DataFrame, radius: int, shape: tuple[int, int, int]) -> DataFrame:
    """Voxels within radius of one that is set."""
    ball = [(i, j, k) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) for k in range(-radius, radius + 1) if i * i + j * j + k * k <= radius * radius]
    near = F.explode(F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in zip("zyx", o, strict=True))) for o in ball)))
    moved = voxels.withColumn("o", near).select(K, *((F.col(c) + F.col(f"o.{c}")).alias(c) for c in "zyx"))
    return _inside(moved, shape).distinct()


def _range(low: np.ndarray, high: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First and number of the whole numbers from low to high, inside 0 .. size - 1."""
    a, b = np.maximum(np.ceil(low), 0), np.minimum(np.floor(high), size - 1)
    n = np.maximum(b - a + 1, 0).astype(np.int64)
    return np.where(n > 0, a, 0).astype(np.int64), n


def _spheres(f: A.Forest, shape: tuple[int, int, int], scale: float) -> Marks:
    p, r = f.xyz()[:, ::-1], A.real(f.table, "radius")[:, 0] * scale
    ok = np.isfinite(p).all(1) & np.isfinite(r) & (r >= 0)
    p, r = p[ok], r[ok]
    first, n = zip(*(_range(p[:, c] - r, p[:, c] + r, shape[c]) for c in range(3)), strict=True)
    work = n[0] * n[1] * n[2]
    for s in _blocks(work):
        e, k = A.spread(work[s])
        k, i = np.divmod(k, n[2][s][e])
        k, j = np.divmod(k, n[1][s][e])
        z, y, x = k + first[0][s][e], j + first[1][s][e], i + first[2][s][e]
        q, m = p[s][e], r[s][e]
        dz, dy, dx = z - q[:, 0], y - q[:, 1], x - q[:, 2]
        hit = dz * dz + dy * dy + dx * dx <= m * m
        yield _code(shape, z[hit], y[hit], x[hit])


def _cones(f: A.Forest, shape: tuple[int, int, int], scale: float) -> Marks:
    p, r, (low, high, size) = f.xyz(), A.real(f.table, "radius")[:, 0] * scale, _edges(f)
    ok = (size > 0) & np.isfinite(r[low]) & np.isfinite(r[high]) & (np.maximum(r[low], r[high]) >= 0)
    low, high, size = low[ok], high[ok], size[ok]
    wide = r[low] >= r[high]
    base = np.where(wide[:, None], p[low], p[high])
    u = np.where(wide[:, None], p[high] - p[low], p[low] - p[high]) / size[:, None]
    big, small = np.maximum(r[low], r[high]), np.minimum(r[low], r[high])
    # Planes across the axis along which an edge runs farthest; in a plane, points within `big` of the line lie in this box about where it passes.
    main = np.abs(u).argmax(1)
    rows = np.arange(len(low))
    others = np.array([(1, 2), (0, 2), (0, 1)])[main]
    dims = np.array(shape[::-1])
    um, bm = u[rows, main], base[rows, main]
    # The discs across its ends reach past them.
    past = big * np.sqrt(np.maximum(0, 1 - um * um)) + 1e-6 * (1 + np.abs(bm) + size)
    a, b = np.minimum(bm, bm + um * size) - past, np.maximum(bm, bm + um * size) + past
    first, n = np.maximum(np.ceil(a), 0), np.minimum(np.floor(b), dims[main] - 1)
    n = np.maximum(n - first + 1, 0).astype(np.int64)
    slope = u[rows[:, None], others] / um[:, None]
    reach = big[:, None] * np.sqrt(1 + slope * slope) + 1e-6 * (1 + np.abs(base).max(1, initial=0) + size)[:, None]
    for s in _blocks(n * np.ceil(2 * reach + 1).prod(1).astype(np.int64)):
        e, k = A.spread(n[s])
        e += s.start
        c = first[e] + k
        mid = base[e[:, None], others[e]] + (c - bm[e])[:, None] * slope[e]
        start, count = zip(*(_range_of(mid[:, i] - reach[e, i], mid[:, i] + reach[e, i], dims[others[e, i]]) for i in (0, 1)), strict=True)
        o, k = A.spread(count[0] * count[1])
        k, j = np.divmod(k, count[1][o])
        e = e[o]
        v = np.empty((3, len(o)))
        at = np.arange(len(o))
        v[main[e], at], v[others[e, 0], at], v[others[e, 1], at] = c[o], start[0][o] + k, start[1][o] + j
        x, y, z = v
        bx, by, bz = base[e].T
        ux, uy, uz = u[e].T
        dx, dy, dz, length = x - bx, y - by, z - bz, size[e]
        h = dx * ux + dy * uy + dz * uz
        px, py, pz = dx - h * ux, dy - h * uy, dz - h * uz
        rho = np.sqrt(px * px + py * py + pz * pz)
        wide_, small_ = big[e], small[e]
        hit = (h >= 0) & (h <= length) & (rho <= wide_) & ((rho <= small_) | ((wide_ - rho) * length >= h * (wide_ - small_)))
        yield _code(shape, z[hit], y[hit], x[hit])


def _range_of(low: np.ndarray, high: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.maximum(np.ceil(low), 0), np.minimum(np.floor(high), size - 1)
    return a, np.maximum(b - a + 1, 0).astype(np.int64)


def sphere_voxels(nodes: DataFrame, shape: tuple[int, int, int], scale: float = 1.0) -> DataFrame:
    """Voxels within each node's radius."""
    return _voxels(nodes, shape, lambda f: _spheres(f, shape, scale))


def cone_voxels(nodes: DataFrame, shape: tuple[int, int, int], scale: float = 1.0) -> DataFrame:
    """Voxels in the truncated cones between the spheres of each edge's ends; edges without length have none.

    Tried are the points near the edge in each plane that it crosses, not the box of the whole edge.
    """
    return _voxels(nodes, shape, lambda f: _cones(f, shape, scale))


def sphere_cone_voxels(nodes: DataFrame, shape: tuple[int, int, int], scale: float = 1.0) -> DataFrame:
    """Spheres of nodes and cones of edges."""
    return _voxels(nodes, shape, lambda f: (x for part in (_spheres, _cones) for x in part(f, shape, scale)))


def adjacency(voxels: DataFrame, connectivity: int = 26) -> DataFrame:
    """Neighbouring pairs of voxels, each once: half of the offsets looked up among a neuron's voxels, in its task."""
    half = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) > (0, 0, 0) and (connectivity == 26 or abs(i) + abs(j) + abs(k) == 1)]

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        v = np.stack([A.whole(t, c) for c in "zyx"])
        # Ranks with one gap where cells are missing, so that codes of any voxels fit.
        rank, size = np.empty_like(v), []
        for c in range(3):
            value, at = np.unique(v[c], return_inverse=True)
            step = 1 + np.concatenate([[0], np.cumsum(np.where(np.diff(value) == 1, 1, 2))])
            rank[c] = step[at]
            size.append(int(step[-1]) + 2)
        code = (rank[0] * size[1] + rank[1]) * size[2] + rank[2]
        order = np.argsort(code, kind="stable")
        code, v = code[order], v[:, order].astype(np.int32)
        a, b = [], []
        for i, j, k in half:
            want = code + (i * size[1] + j) * size[2] + k
            at = np.minimum(np.searchsorted(code, want), len(code) - 1)
            some = np.flatnonzero(code[at] == want)
            a.append(some)
            b.append(at[some])
        a, b = np.concatenate(a), np.concatenate(b)
        return A.table(key, {c: v[i][b] for i, c in enumerate("zyx")} | {f"a{c}": v[i][a] for i, c in enumerate("zyx")})

    known = voxels.where(" AND ".join(f"{c} IS NOT NULL" for c in (K, *"zyx"))).select(K, "z", "y", "x")
    return known.groupBy(K).applyInArrow(run, f"{K} bigint, z int, y int, x int, az int, ay int, ax int")
